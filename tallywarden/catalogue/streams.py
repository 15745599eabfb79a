"""Registered streaming queries: each runs its stream to the end of the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywarden.catalogue.common import rounded
from tallywarden.session import shared_folder
from tallywarden.sources.alerts import to_alerts
from tallywarden.sources.tables import load, stream_events
from tallywarden.schemas import ALERT
from tallywarden.streaming import sinks, state, windows


def _naive(*names):
    return [F.col(n).cast("timestamp_ntz").alias(n) for n in names]


def _windowed(stream, purpose):
    table, _ = sinks.run_to_table(stream, purpose)
    return table.select("user_id", *_naive("window_start", "window_end"), "n", rounded("amount", 2))


def stream_events_query(spark, sf_dir):
    table, _ = sinks.run_to_table(stream_events(spark, sf_dir), "events")
    return table.select("event_id", *_naive("ts"), "user_id", "event_type", "value", "props")


def stream_tumbling(spark, sf_dir):
    return _windowed(windows.tumbling(stream_events(spark, sf_dir), "user_id", "value", "60 minutes"), "tumbling")


def stream_sliding(spark, sf_dir):
    return _windowed(
        windows.sliding(stream_events(spark, sf_dir), "user_id", "value", "60 minutes", "15 minutes"), "sliding"
    )


def stream_sessions(spark, sf_dir):
    return _windowed(windows.sessions(stream_events(spark, sf_dir), "user_id", "value", "30 minutes"), "sessions")


def stream_sessions_stitched(spark, sf_dir):
    hours = 6 * 3600
    parts = windows.partial_sessions(stream_events(spark, sf_dir), "user_id", "value", "30 minutes", hours)
    table, query = sinks.run_to_table(parts, "partial-sessions")
    rows = windows.stitched(table, "user_id", "30 minutes", hours, sinks.final_watermark(query))
    return rows.select("user_id", *_naive("window_start", "window_end"), "n", rounded("amount", 2))


def stream_dedup(spark, sf_dir):
    # Two feeds that deliver the same events.
    feeds = stream_events(spark, sf_dir).union(stream_events(spark, sf_dir))
    table, _ = sinks.run_to_table(windows.deduplicate(feeds, ["event_id"]), "dedup")
    return table.select("event_id", *_naive("ts"), "user_id")


def stream_sequence(spark, sf_dir):
    kind = F.col("event_type")
    hits = windows.sequence(stream_events(spark, sf_dir), "user_id", kind == "error", kind == "purchase", 1800)
    table, _ = sinks.run_to_table(hits, "sequence")
    return table.select("event_id", "user_id", *_naive("ts"))


def stream_enrich(spark, sf_dir):
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    table, _ = sinks.run_to_table(windows.enrich(stream_events(spark, sf_dir), "user_id", customers, "c_custkey"), "enrich")
    return table.select("event_id", "user_id", *_naive("ts"), "c_mktsegment", "c_nationkey")


def stream_profile(spark, sf_dir):
    folder = shared_folder(spark, "profile")
    stream = state.with_past(stream_events(spark, sf_dir), "user_id", "value")
    sinks.run_batches(stream, state.state_scorer(folder, "user_id", ["ts", "event_id"], "value", 5, 4.0), f"{folder}/checkpoint")
    schema = "event_id bigint, ts timestamp, user_id bigint, value double, n_prior bigint, zscore double"
    alerts = spark.read.schema(schema).parquet(f"{folder}/alerts")
    return alerts.select("event_id", "user_id", *_naive("ts"), "n_prior", rounded("zscore"))


def stream_alerts(spark, sf_dir):
    folder = shared_folder(spark, "stream-alerts")
    large = stream_events(spark, sf_dir).where("value > 150")
    alerts = to_alerts(large, "large_amount", "user_id", F.col("value"), F.col("event_type"), "event_id")
    sinks.run_batches(alerts, sinks.alert_sink(f"{folder}/alerts"), f"{folder}/checkpoint")
    return spark.read.schema(ALERT).parquet(f"{folder}/alerts").select(
        "detector", "entity_id", "txn_id", "score", "detail"
    )


def late_report(spark, sf_dir):
    # Ten days arrive at a time, every fiftieth event with the ten days after its own.
    folder = shared_folder(spark, "late")
    events = load(spark, sf_dir, "events")
    arrival = F.floor(F.datediff("ts", F.lit("2024-01-01")) / 10) + F.when(F.col("event_id") % 50 == 0, 1).otherwise(0)
    counter = sinks.late_counter(f"{folder}/late", "10 minutes", "60 minutes")
    for n in range(events.agg(F.max(arrival)).first()[0] + 1):
        events.where(arrival == n).write.mode("append").parquet(f"{folder}/events.parquet")
        sinks.run_batches(stream_events(spark, folder), counter, f"{folder}/checkpoint")
    return sinks.late_rows(spark, f"{folder}/late").withColumn("watermark", F.col("watermark").cast("timestamp_ntz"))


QUERIES = {
    "stream_events": stream_events_query,
    "stream_tumbling": stream_tumbling,
    "stream_sliding": stream_sliding,
    "stream_sessions": stream_sessions,
    "stream_sessions_stitched": stream_sessions_stitched,
    "stream_dedup": stream_dedup,
    "stream_sequence": stream_sequence,
    "stream_enrich": stream_enrich,
    "stream_profile": stream_profile,
    "stream_alerts": stream_alerts,
    "late_report": late_report,
}

# Only windows the watermark has closed are emitted.
_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTES FROM events)"
_SUM = "round(sum(round(value * 100)::bigint)::double / 100, 2) AS amount"

ORACLE = {
    "stream_events": "SELECT * FROM events",
    "stream_tumbling": f"""
        WITH w AS (SELECT user_id, value, time_bucket(INTERVAL 60 MINUTES, ts) AS window_start FROM events)
        SELECT user_id, window_start, window_start + INTERVAL 60 MINUTES AS window_end, count(*) AS n, {_SUM}
        FROM w GROUP BY ALL HAVING window_end <= {_CLOSED}
    """,
    "stream_sliding": f"""
        WITH w AS (SELECT user_id, value, time_bucket(INTERVAL 15 MINUTES, ts) - (i * INTERVAL 15 MINUTES) AS window_start
                   FROM events, range(4) r(i))
        SELECT user_id, window_start, window_start + INTERVAL 60 MINUTES AS window_end, count(*) AS n, {_SUM}
        FROM w GROUP BY ALL HAVING window_end <= {_CLOSED}
    """,
    "stream_sessions": f"""
        WITH s AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS starts
                   FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        n AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                          ROWS UNBOUNDED PRECEDING) AS session FROM s),
        g AS (SELECT user_id, session, min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTES AS window_end,
                     count(*) AS n, {_SUM} FROM n GROUP BY user_id, session)
        SELECT * EXCLUDE (session) FROM g WHERE window_end <= {_CLOSED}
    """,
    "stream_sessions_stitched": f"""
        WITH s AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS starts
                   FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        n AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                          ROWS UNBOUNDED PRECEDING) AS session FROM s),
        g AS (SELECT user_id, session, min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTES AS window_end,
                     count(*) AS n, {_SUM} FROM n GROUP BY user_id, session)
        SELECT * EXCLUDE (session) FROM g 
        WHERE time_bucket(INTERVAL 6 HOURS, window_end) + INTERVAL 6 HOURS + INTERVAL 30 MINUTES <= {_CLOSED}
    """,
    "stream_dedup": "SELECT event_id, ts, user_id FROM events",
    "stream_sequence": """
        SELECT event_id, user_id, ts FROM events b WHERE event_type = 'purchase' AND EXISTS
            (SELECT 1 FROM events a WHERE a.user_id = b.user_id AND a.event_type = 'error' AND a.ts < b.ts
             AND b.ts <= a.ts + INTERVAL 30 MINUTES)
    """,
    "stream_enrich": """
        SELECT event_id, user_id, ts, c_mktsegment, c_nationkey FROM events LEFT JOIN customer ON user_id = c_custkey
    """,
    "stream_profile": """
        WITH c AS (SELECT *, round(value * 100)::bigint AS cents FROM events),
        w AS (SELECT event_id, user_id, ts, cents, count(*) OVER p AS n, sum(cents::hugeint) OVER p AS s,
                     stddev_samp(cents::double) OVER p AS sd
              FROM c WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        z AS (SELECT *, (cents::double - s::double / n::double) / sd AS zscore
              FROM w WHERE n >= 5 AND sd > 1e-6)
        SELECT event_id, user_id, ts, n AS n_prior, round(zscore, 4) AS zscore FROM z WHERE abs(zscore) > 4
    """,
    "stream_alerts": """
        SELECT 'large_amount' AS detector, user_id AS entity_id, event_id AS txn_id, value AS score,
               event_type AS detail FROM events WHERE value > 150
    """,
    "late_report": """
        WITH a AS (SELECT ts, date_diff('day', TIMESTAMP '2024-01-01', ts) // 10
                     + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS batch_id FROM events),
        m AS (SELECT batch_id, max(ts) AS newest FROM a GROUP BY batch_id),
        w AS (SELECT batch_id, date_trunc('millisecond', max(newest) OVER (ORDER BY batch_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) - INTERVAL 10 MINUTES AS watermark FROM m)
        SELECT batch_id, count(*) AS input_rows, count(*) FILTER (ts < watermark) AS behind_rows,
          count(*) FILTER (time_bucket(INTERVAL 60 MINUTES, ts) + INTERVAL 60 MINUTES <= watermark) AS late_rows,
          any_value(watermark) AS watermark
        FROM a JOIN w USING (batch_id) GROUP BY batch_id
    """,
}
