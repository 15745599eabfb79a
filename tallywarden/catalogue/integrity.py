"""Registered source, sink and integrity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywarden.catalogue.common import rounded
from tallywarden.operators import amounts, integrity as ops
from tallywarden.session import shared_folder
from tallywarden.sources.alerts import read_alerts, to_alerts, write_alerts
from tallywarden.sources.tables import load
from tallywarden.sources.transactions import parse_props, to_transactions


def load_orders(spark, sf_dir):
    return load(spark, sf_dir, "orders")


def transactions(spark, sf_dir):
    orders, lines, events = (load(spark, sf_dir, t) for t in ("orders", "lineitem", "events"))
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    parts = {"orders": orders, "lines": joined, "events": events}
    canonical = [to_transactions(df, source) for source, df in parts.items()]
    return canonical[0].unionByName(canonical[1]).unionByName(canonical[2])


def event_props(spark, sf_dir):
    return parse_props(load(spark, sf_dir, "events")).select("event_id", "k")


def _order_rules():
    return {
        "amount_over_limit": F.col("o_totalprice") > 490_000,
        "amount_small": F.col("o_totalprice") < 1_500,
        "status_pending": F.col("o_orderstatus") == "P",
    }


def quarantine_bad(spark, sf_dir):
    _, bad = ops.quarantine(load(spark, sf_dir, "orders"), _order_rules())
    return bad.select("o_orderkey", F.concat_ws(",", "reasons").alias("reasons"))


def quarantine_good(spark, sf_dir):
    good, _ = ops.quarantine(load(spark, sf_dir, "orders"), _order_rules())
    return good.select("o_orderkey", "o_custkey")


def write_alerts_query(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    hits = amounts.iqr_fence(events, "event_type", "value", 1.5)
    path = shared_folder(spark, "alerts")
    alerts = to_alerts(hits, "iqr_fence", "user_id", F.col("value"), F.col("event_type"), "event_id")
    write_alerts(alerts, path, "2024-02-01", ["iqr_fence"])
    return read_alerts(spark, path)


def duplicate_keys(spark, sf_dir):
    return ops.duplicate_keys(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def orphans(spark, sf_dir):
    found = ops.orphans(
        load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey"
    )
    return found.select("o_orderkey", "o_custkey")


def time_order(spark, sf_dir):
    late = ops.time_order(
        load(spark, sf_dir, "orders"),
        load(spark, sf_dir, "lineitem"),
        "o_orderkey",
        "l_orderkey",
        "o_orderdate",
        "l_shipdate",
    )
    return late.select("o_orderkey", "l_linenumber", "o_orderdate", "l_shipdate")


def reconcile(spark, sf_dir):
    found = ops.reconcile(load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem"), 0.01)
    return found.select("o_orderkey", rounded("lines_total", 6), rounded("difference", 6))


def domain_rules(spark, sf_dir):
    return ops.domain_rules(
        load(spark, sf_dir, "lineitem"),
        {
            "discount_over_9_percent": F.col("l_discount") > 0.09,
            "quantity_not_positive": F.col("l_quantity") <= 0,
            "flag_unknown": ~F.col("l_returnflag").isin("A", "N"),
            "shipped_after_2000": F.col("l_shipdate") >= F.lit("2001-01-01").cast("timestamp_ntz"),
        },
    )


def near_duplicates(spark, sf_dir):
    found = ops.near_duplicates(
        load(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", 100_000, 30
    )
    return found.select("o_orderkey", "o_custkey", "o_orderdate", rounded("o_totalprice", 2))


def exact_repeats(spark, sf_dir):
    found = ops.exact_repeats(load(spark, sf_dir, "events"), ["user_id", "event_type", "value"])
    return found.select("user_id", "event_type", rounded("value"), "n")


def control_totals(spark, sf_dir):
    month = F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month")
    rows = ops.control_totals(
        load(spark, sf_dir, "lineitem"), [month, "l_returnflag"], "l_extendedprice", "l_orderkey"
    )
    return rows.select("month", "l_returnflag", "n_rows", rounded("amount", 2), "n_keys")


def run_diff(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    previous = orders.where("o_orderdate < timestamp_ntz'1999-01-01 00:00:00'")
    current = orders.where("o_orderpriority <> '5-LOW'")
    cols = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    return ops.run_diff(previous.select(*cols), current.select(*cols))


QUERIES = {
    "load_orders": load_orders,
    "to_transactions": transactions,
    "parse_props": event_props,
    "quarantine_bad": quarantine_bad,
    "quarantine_good": quarantine_good,
    "write_alerts": write_alerts_query,
    "duplicate_keys": duplicate_keys,
    "orphans": orphans,
    "time_order": time_order,
    "reconcile": reconcile,
    "domain_rules": domain_rules,
    "near_duplicates": near_duplicates,
    "exact_repeats": exact_repeats,
    "control_totals": control_totals,
    "run_diff": run_diff,
}

_BAD_ORDER = "o_totalprice > 490000 OR o_totalprice < 1500 OR o_orderstatus = 'P'"

ORACLE = {
    "load_orders": "SELECT * FROM orders",
    "to_transactions": """
        SELECT o_orderkey AS txn_id, o_custkey AS entity_id, NULL::bigint AS counterparty_id, o_orderdate AS ts,
               o_totalprice AS amount, 'order' AS kind, o_orderpriority AS attrs FROM orders
        UNION ALL
        SELECT l_orderkey, o_custkey, l_suppkey, o_orderdate, l_extendedprice, 'line', l_returnflag
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        UNION ALL
        SELECT event_id, user_id, NULL, ts, value, event_type, props FROM events
    """,
    "parse_props": "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS int) AS k FROM events",
    "quarantine_bad": f"""
        SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice > 490000 THEN 'amount_over_limit' END,
               CASE WHEN o_totalprice < 1500 THEN 'amount_small' END,
               CASE WHEN o_orderstatus = 'P' THEN 'status_pending' END) AS reasons
        FROM orders WHERE {_BAD_ORDER}
    """,
    "quarantine_good": f"SELECT o_orderkey, o_custkey FROM orders WHERE NOT ({_BAD_ORDER})",
    "write_alerts": """
        WITH c AS (SELECT *, round(value * 100)::bigint AS cents FROM events),
        q AS (SELECT event_type, quantile_cont(cents, 0.25) AS q1, quantile_cont(cents, 0.75) AS q3
              FROM c GROUP BY ALL)
        SELECT 'iqr_fence' AS detector, user_id AS entity_id, event_id AS txn_id, value AS score,
               event_type AS detail, DATE '2024-02-01' AS run_date
        FROM c JOIN q USING (event_type) WHERE cents > q3 + 1.5::double * (q3 - q1)
    """,
    "duplicate_keys": """
        SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING n > 1
    """,
    "orphans": """
        SELECT o_orderkey, o_custkey FROM orders
        WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
    """,
    "time_order": """
        SELECT o_orderkey, l_linenumber, o_orderdate, l_shipdate
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate
    """,
    "reconcile": """
        WITH s AS (SELECT l_orderkey, sum(round(l_extendedprice * 100)::hugeint
                          * (100 - round(l_discount * 100)::int) * (100 + round(l_tax * 100)::int)) AS lines
                   FROM lineitem GROUP BY ALL),
        d AS (SELECT o_orderkey, lines, lines - round(o_totalprice * 100)::hugeint * 10000 AS diff
              FROM orders JOIN s ON o_orderkey = l_orderkey)
        SELECT o_orderkey, round(lines::double / 1000000, 6) AS lines_total,
               round(diff::double / 1000000, 6) AS difference
        FROM d WHERE abs(diff::double / 1000000) > 0.01
    """,
    "domain_rules": """
        SELECT count(*) AS n_rows, 'discount_over_9_percent' AS rule,
               count(*) FILTER (l_discount > 0.09::double) AS n_bad FROM lineitem
        UNION ALL SELECT count(*), 'quantity_not_positive', count(*) FILTER (l_quantity <= 0) FROM lineitem
        UNION ALL SELECT count(*), 'flag_unknown', count(*) FILTER (l_returnflag NOT IN ('A', 'N')) FROM lineitem
        UNION ALL SELECT count(*), 'shipped_after_2000', count(*) FILTER (l_shipdate >= TIMESTAMP '2001-01-01')
        FROM lineitem
    """,
    "near_duplicates": """
        SELECT o_orderkey, o_custkey, o_orderdate, round(o_totalprice, 2) AS o_totalprice FROM orders a
        WHERE EXISTS (SELECT 1 FROM orders b WHERE a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey
                      AND abs(round(a.o_totalprice * 100)::bigint - round(b.o_totalprice * 100)::bigint) <= 100000
                      AND abs(date_diff('day', a.o_orderdate, b.o_orderdate)) <= 30)
    """,
    "exact_repeats": """
        SELECT user_id, event_type, round(value, 4) AS value, count(*) AS n FROM events
        GROUP BY user_id, event_type, events.value HAVING n > 1
    """,
    "control_totals": """
        SELECT date_trunc('month', l_shipdate) AS month, l_returnflag, count(*) AS n_rows,
               round(sum(round(l_extendedprice * 100)::bigint)::double / 100, 2) AS amount,
               count(DISTINCT l_orderkey) AS n_keys
        FROM lineitem GROUP BY ALL
    """,
    "run_diff": """
        WITH p AS (SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders
                   WHERE o_orderdate < TIMESTAMP '1999-01-01'),
        c AS (SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW'),
        a AS (SELECT *, 'added' AS change FROM (FROM c EXCEPT ALL FROM p)),
        r AS (SELECT *, 'removed' AS change FROM (FROM p EXCEPT ALL FROM c))
        SELECT *, count(*) AS copies FROM (FROM a UNION ALL FROM r) GROUP BY ALL
    """,
}
