"""Registered time-behaviour queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywarden.catalogue.common import rounded
from tallywarden.operators import behaviour as ops
from tallywarden.sources.tables import load


def velocity(spark, sf_dir):
    hits = ops.velocity(load(spark, sf_dir, "events"), "user_id", "ts", "value", "60 MINUTES", 3)
    return hits.select("user_id", "ts", "n", rounded("amount", 2))


def structuring(spark, sf_dir):
    hits = ops.structuring(
        load(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_totalprice", 400_000, 500_000, "90 DAYS", 3
    )
    return hits.select("o_custkey", "o_orderdate", "n", rounded("amount", 2))


def dormant_reactivation(spark, sf_dir):
    hits = ops.dormant_reactivation(load(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey", 365)
    return hits.select("o_orderkey", "o_custkey", "o_orderdate", "gap_days")


def sequence(spark, sf_dir):
    kind = F.col("event_type")
    hits = ops.sequence(
        load(spark, sf_dir, "events"), "user_id", "ts", "event_id", kind == "error", kind == "purchase", "30 MINUTES"
    )
    return hits.select("event_id", "user_id", "ts", "first_ts")


def asof_last(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    found = ops.asof_last(
        events.where("event_type = 'error'"),
        events.where("event_type = 'purchase'"),
        "user_id",
        "ts",
        "event_id",
        "value",
    )
    return found.select("event_id", "user_id", "ts", "last_ts", rounded("last_value"))


def sessions(spark, sf_dir):
    found = ops.sessions(load(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value", "30 MINUTES")
    return found.select("user_id", "session_start", "session_end", "n", rounded("amount", 2))


def daily_burst(spark, sf_dir):
    hits = ops.daily_burst(load(spark, sf_dir, "events"), "user_id", "ts", "value", 7, 3.0, 3)
    return hits.select("user_id", "day", "n_prior", rounded("total", 2), rounded("prior_mean"))


def off_hours(spark, sf_dir):
    rows = ops.off_hours(load(spark, sf_dir, "events"), "user_id", "ts", 0, 5)
    return rows.select("user_id", "n", "n_off", *(rounded(c, 6) for c in ("share", "overall", "lift")))


def gap_stats(spark, sf_dir):
    return ops.gap_stats(load(spark, sf_dir, "events"), "user_id", "ts", "event_id")


def drift_psi(spark, sf_dir):
    edges = [25_000.0 * i for i in range(1, 20)]
    rows = ops.drift_psi(
        load(spark, sf_dir, "orders"), "o_totalprice", "o_orderdate", edges, "1998-07-01 00:00:00"
    )
    return rows.select("bin", "n_before", "n_after", rounded("psi", 8))


def period_change(spark, sf_dir):
    hits = ops.period_change(load(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_totalprice", "quarter", 5.0)
    return hits.select("o_custkey", "period", *(rounded(c, 2) for c in ("total", "previous")), rounded("ratio"))


def calendar_change(spark, sf_dir):
    hits = ops.calendar_change(load(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_totalprice", "quarter", 5.0)
    return hits.select("o_custkey", "first_period", "last_period", *(rounded(c, 2) for c in ("total", "previous")), "change")


QUERIES = {
    "velocity": velocity,
    "structuring": structuring,
    "dormant_reactivation": dormant_reactivation,
    "sequence": sequence,
    "asof_last": asof_last,
    "sessions": sessions,
    "daily_burst": daily_burst,
    "off_hours": off_hours,
    "gap_stats": gap_stats,
    "drift_psi": drift_psi,
    "period_change": period_change,
    "calendar_change": calendar_change,
}

_SHARE_BEFORE = "greatest(n_before / (sum(n_before) OVER ())::double, 1e-6::double)"
_SHARE_AFTER = "greatest(n_after / (sum(n_after) OVER ())::double, 1e-6::double)"

ORACLE = {
    "velocity": """
        SELECT DISTINCT user_id, ts, n, round(cents::double / 100, 2) AS amount FROM (
            SELECT user_id, ts, count(*) OVER w AS n, sum(round(value * 100)::bigint) OVER w AS cents FROM events
            WINDOW w AS (PARTITION BY user_id ORDER BY ts
                         RANGE BETWEEN INTERVAL 60 MINUTES PRECEDING AND CURRENT ROW))
        WHERE n >= 3
    """,
    "structuring": """
        SELECT DISTINCT o_custkey, o_orderdate, n, round(cents::double / 100, 2) AS amount FROM (
            SELECT o_custkey, o_orderdate, count(*) OVER w AS n, sum(round(o_totalprice * 100)::bigint) OVER w AS cents
            FROM orders WHERE o_totalprice >= 400000 AND o_totalprice < 500000
            WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate
                         RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW))
        WHERE n >= 3
    """,
    "dormant_reactivation": """
        SELECT * FROM (
            SELECT o_orderkey, o_custkey, o_orderdate, date_diff('day', lag(o_orderdate) OVER
                   (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate) AS gap_days FROM orders)
        WHERE gap_days >= 365
    """,
    "sequence": """
        SELECT b.event_id, b.user_id, b.ts, max(a.ts) AS first_ts FROM events b JOIN events a USING (user_id)
        WHERE b.event_type = 'purchase' AND a.event_type = 'error' AND a.ts < b.ts
          AND b.ts <= a.ts + INTERVAL 30 MINUTES
        GROUP BY ALL
    """,
    "asof_last": """
        SELECT b.event_id, b.user_id, b.ts, a.ts AS last_ts, round(a.value, 4) AS last_value
        FROM (FROM events WHERE event_type = 'purchase') b
        ASOF LEFT JOIN (FROM events WHERE event_type = 'error') a ON a.user_id = b.user_id AND a.ts < b.ts
    """,
    "sessions": """
        WITH s AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS starts
                   FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        n AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                          ROWS UNBOUNDED PRECEDING) AS session FROM s)
        SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTES AS session_end, count(*) AS n,
               round(sum(round(value * 100)::bigint)::double / 100, 2) AS amount
        FROM n GROUP BY user_id, session
    """,
    "daily_burst": """
        WITH d AS (SELECT user_id, ts::date AS day, sum(round(value * 100)::bigint) AS cents FROM events GROUP BY ALL),
        w AS (SELECT *, sum(cents) OVER p AS prior, count(*) OVER p AS n_prior FROM d
              WINDOW p AS (PARTITION BY user_id ORDER BY day
                           RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING))
        SELECT user_id, day, n_prior, round(cents::double / 100, 2) AS total,
               round(prior::double / 100 / n_prior, 4) AS prior_mean
        FROM w WHERE n_prior >= 3 AND cents::double / 100 > 3 * (prior::double / 100 / n_prior)
    """,
    "off_hours": """
        WITH o AS (SELECT count(*) FILTER (hour(ts) < 6) / count(*)::double AS overall FROM events),
        u AS (SELECT user_id, count(*) AS n, count(*) FILTER (hour(ts) < 6) AS n_off FROM events GROUP BY ALL)
        SELECT user_id, n, n_off, round(n_off / n::double, 6) AS share, round(overall, 6) AS overall,
               round(n_off / n::double / overall, 6) AS lift FROM u, o
    """,
    "gap_stats": """
        WITH g AS (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))
                   AS gap FROM events)
        SELECT user_id, min(gap) AS min_gap, median(gap) AS median_gap, max(gap) AS max_gap
        FROM g WHERE gap IS NOT NULL GROUP BY ALL
    """,
    "drift_psi": f"""
        WITH c AS (SELECT least(floor(o_totalprice / 25000), 19)::int AS bin,
                          count(*) FILTER (o_orderdate < TIMESTAMP '1998-07-01') AS n_before,
                          count(*) FILTER (o_orderdate >= TIMESTAMP '1998-07-01') AS n_after FROM orders GROUP BY ALL)
        SELECT bin, n_before, n_after,
               round(({_SHARE_AFTER} - {_SHARE_BEFORE}) * ln({_SHARE_AFTER} / {_SHARE_BEFORE}), 8) AS psi FROM c
    """,
    "period_change": """
        WITH t AS (SELECT o_custkey, date_trunc('quarter', o_orderdate) AS period,
                          sum(round(o_totalprice * 100)::bigint)::double / 100 AS total FROM orders GROUP BY ALL),
        l AS (SELECT *, lag(total) OVER (PARTITION BY o_custkey ORDER BY period) AS previous FROM t)
        SELECT o_custkey, period, round(total, 2) AS total, round(previous, 2) AS previous,
               round(total / previous, 4) AS ratio
        FROM l WHERE total / previous >= 5
    """,
    "calendar_change": """
        WITH t AS (SELECT o_custkey, date_trunc('quarter', o_orderdate) AS period,
                          sum(round(o_totalprice * 100)::bigint) AS cents FROM orders GROUP BY ALL),
        spine AS (SELECT o_custkey, unnest(generate_series(min(period)::timestamp,
                         (SELECT max(period) FROM t)::timestamp, INTERVAL 3 MONTHS)) AS period FROM t GROUP BY o_custkey),
        filled AS (SELECT s.o_custkey, s.period::timestamp AS period, coalesce(cents, 0) AS cents
                   FROM spine s LEFT JOIN t ON t.o_custkey = s.o_custkey AND t.period = s.period),
        l AS (SELECT *, lag(cents) OVER w AS before, (cents = 0 AND coalesce(lag(cents) OVER w, 1) = 0)::int AS goes_on
              FROM filled WINDOW w AS (PARTITION BY o_custkey ORDER BY period)),
        runs AS (SELECT *, sum(1 - goes_on) OVER (PARTITION BY o_custkey ORDER BY period) AS run FROM l),
        r AS (SELECT o_custkey, run, min(period) AS first_period, max(period) AS last_period, max(cents) AS now,
                     arg_min(before, period) AS before FROM runs GROUP BY o_custkey, run)
        SELECT o_custkey, first_period, last_period, round(now::double / 100, 2) AS total,
               round(before::double / 100, 2) AS previous,
               CASE WHEN now = 0 THEN 'silence' WHEN before = 0 THEN 'restart' ELSE 'rise' END AS change
        FROM r WHERE before IS NOT NULL AND ((now = 0) <> (before = 0) OR (before > 0 AND now::double / before::double >= 5))
    """,
}
