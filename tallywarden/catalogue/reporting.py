"""Registered scoring and reporting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywarden.catalogue.common import rounded
from tallywarden.operators import amounts, behaviour, reporting as ops, sketches
from tallywarden.session import shared_folder
from tallywarden.sources.alerts import to_alerts
from tallywarden.sources.tables import load

# Binary fractions, so that weighted sums are exact in any order.
WEIGHTS = {"iqr_fence": 0.25, "velocity": 2.0, "dormant": 0.5}


def _alerts(spark, sf_dir):
    events, orders = load(spark, sf_dir, "events"), load(spark, sf_dir, "orders")
    fence = amounts.iqr_fence(events, "event_type", "value", 1.5)
    burst = behaviour.velocity(events, "user_id", "ts", "value", "60 MINUTES", 3)
    woken = behaviour.dormant_reactivation(orders, "o_custkey", "o_orderdate", "o_orderkey", 365)
    return ops.union_alerts(
        to_alerts(fence, "iqr_fence", "user_id", rounded("value", 2), F.col("event_type"), "event_id"),
        to_alerts(burst, "velocity", "user_id", F.col("n"), F.lit("60 minutes")),
        to_alerts(woken, "dormant", "o_custkey", F.col("gap_days"), F.col("o_orderpriority"), "o_orderkey"),
    )


def union_alerts(spark, sf_dir):
    return _alerts(spark, sf_dir)


def risk_score(spark, sf_dir):
    return ops.risk_score(_alerts(spark, sf_dir), WEIGHTS)


def top_risk(spark, sf_dir):
    return ops.top_risk(risk_score(spark, sf_dir), 20)


def alert_cube(spark, sf_dir):
    return ops.alert_cube(_alerts(spark, sf_dir), ["detector", "detail"])


def order_cube(spark, sf_dir):
    return ops.alert_cube(load(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


PROBS = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99}


def amount_profile(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    rows = ops.amount_profile(lines, "l_returnflag", "l_extendedprice", PROBS)
    return rows.select("l_returnflag", "n", *(rounded(c, 2) for c in ("smallest", "largest")), *(rounded(c) for c in PROBS))


def amount_profile_approx(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    path = shared_folder(spark, "sketches")
    sketches.store_days(sketches.daily_sketches(lines, "l_returnflag", "l_shipdate", "l_suppkey", "l_extendedprice", "month"), path)
    rows = sketches.checked_quantiles(lines, "l_returnflag", "l_extendedprice", spark.read.parquet(path), PROBS)
    return rows.select(F.col("group").alias("l_returnflag"), "n", *(f"{c}_within" for c in PROBS))


def distinct_entities(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    path = shared_folder(spark, "sketches")
    sketches.store_days(sketches.daily_sketches(events, "event_type", "ts", "user_id", "value"), path)
    rows = sketches.checked_distinct(events, "event_type", "user_id", spark.read.parquet(path))
    return rows.select(F.col("group").alias("event_type"), "exact", "within_bound")


def evaluate(spark, sf_dir):
    # No table has fraud labels, so one detector is measured against another.
    events = load(spark, sf_dir, "events")
    fence = amounts.iqr_fence(events, "event_type", "value", 1.5)
    robust = amounts.mad_score(events, "event_type", "value", 3.5)
    rows = ops.evaluate(fence.select("event_id"), robust.select("event_id"), "event_id")
    return rows.select("tp", "fp", "fn", *(rounded(c, 6) for c in ("precision", "recall", "f1")))


QUERIES = {
    "union_alerts": union_alerts,
    "risk_score": risk_score,
    "top_risk": top_risk,
    "alert_cube": alert_cube,
    "order_cube": order_cube,
    "amount_profile": amount_profile,
    "amount_profile_approx": amount_profile_approx,
    "distinct_entities": distinct_entities,
    "evaluate": evaluate,
}

_ALERTS = """
    c AS (SELECT *, round(value * 100)::bigint AS cents FROM events),
    q AS (SELECT event_type, quantile_cont(cents, 0.25) AS q1, quantile_cont(cents, 0.75) AS q3
          FROM c GROUP BY ALL),
    fence AS (SELECT 'iqr_fence' AS detector, user_id AS entity_id, event_id AS txn_id,
                     round(value, 2) AS score, event_type AS detail
              FROM c JOIN q USING (event_type) WHERE cents > q3 + 1.5::double * (q3 - q1)),
    burst AS (SELECT DISTINCT 'velocity' AS detector, user_id AS entity_id, NULL::bigint AS txn_id, ts,
                     n::double AS score, '60 minutes' AS detail
              FROM (SELECT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts
                           RANGE BETWEEN INTERVAL 60 MINUTES PRECEDING AND CURRENT ROW) AS n FROM events)
              WHERE n >= 3),
    woken AS (SELECT 'dormant' AS detector, o_custkey AS entity_id, o_orderkey AS txn_id,
                     gap::double AS score, o_orderpriority AS detail
              FROM (SELECT *, date_diff('day', lag(o_orderdate) OVER
                           (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate) AS gap FROM orders)
              WHERE gap >= 365),
    alerts AS (FROM fence UNION ALL SELECT * EXCLUDE (ts) FROM burst UNION ALL FROM woken)
"""
_RISK = f"""
    WITH {_ALERTS} SELECT entity_id, count(*) AS n_alerts, sum(CASE detector WHEN 'iqr_fence' THEN 0.25::double
        WHEN 'velocity' THEN 2 WHEN 'dormant' THEN 0.5 END) AS score FROM alerts GROUP BY ALL
"""

ORACLE = {
    "union_alerts": f"WITH {_ALERTS} FROM alerts",
    "risk_score": _RISK,
    "top_risk": f"SELECT * FROM ({_RISK}) ORDER BY score DESC, entity_id LIMIT 20",
    "alert_cube": f"""
        WITH {_ALERTS} SELECT detector, detail, grouping(detector, detail) AS level, count(*) AS n
        FROM alerts GROUP BY CUBE (detector, detail)
    """,
    "order_cube": """
        SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority) AS level, count(*) AS n
        FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
    """,
    "amount_profile": """
        SELECT l_returnflag, count(*) AS n, round(min(l_extendedprice), 2) AS smallest,
               round(max(l_extendedprice), 2) AS largest,
               round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50,
               round(quantile_cont(l_extendedprice, 0.75), 4) AS q75, round(quantile_cont(l_extendedprice, 0.99), 4) AS q99
        FROM lineitem GROUP BY ALL
    """,
    "amount_profile_approx": """
        SELECT l_returnflag, count(*) AS n, true AS q25_within, true AS q50_within, true AS q75_within, true AS q99_within
        FROM lineitem GROUP BY l_returnflag
    """,
    "distinct_entities": """
        SELECT event_type, count(DISTINCT user_id) AS exact, true AS within_bound FROM events GROUP BY event_type
    """,
    "evaluate": """
        WITH v AS (SELECT *, round(value * 100)::bigint AS cents FROM events),
        q AS (SELECT event_type, quantile_cont(cents, 0.25) AS q1, quantile_cont(cents, 0.75) AS q3,
                     median(cents) AS med FROM v GROUP BY ALL),
        m AS (SELECT event_type, median(abs(cents - med)) AS mad FROM v JOIN q USING (event_type) GROUP BY ALL),
        f AS (SELECT cents > q3 + 1.5::double * (q3 - q1) AS a,
                     mad > 0 AND abs(0.6745::double * (cents - med) / mad) > 3.5 AS t
              FROM v JOIN q USING (event_type) JOIN m USING (event_type)),
        c AS (SELECT count(*) FILTER (a AND t) AS tp, count(*) FILTER (a AND NOT t) AS fp,
                     count(*) FILTER (t AND NOT a) AS fn FROM f)
        SELECT tp, fp, fn, round(tp / (tp + fp)::double, 6) AS precision, round(tp / (tp + fn)::double, 6) AS recall,
               round(2 * tp / (2 * tp + fp + fn)::double, 6) AS f1 FROM c
    """,
}
