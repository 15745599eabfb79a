"""Registered counterparty queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywarden.catalogue.common import rounded
from tallywarden.operators import counterparties as ops
from tallywarden.sources.tables import load
from tallywarden.sources.transactions import payments


def _edges(spark, sf_dir):
    return payments(load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem"))


def pair_concentration(spark, sf_dir):
    pairs = ops.pair_concentration(_edges(spark, sf_dir), 4)
    return pairs.select("payer", "payee", "n", rounded("amount", 2))


def new_counterparty(spark, sf_dir):
    return ops.new_counterparty(_edges(spark, sf_dir))


def hhi(spark, sf_dir):
    return ops.hhi(_edges(spark, sf_dir)).select("payer", "n_payees", rounded("hhi", 8))


def top_counterparties(spark, sf_dir):
    top = ops.top_counterparties(_edges(spark, sf_dir), 3)
    return top.select("payer", "payee", rounded("amount", 2), "rank")


def shared_counterparties(spark, sf_dir):
    large = load(spark, sf_dir, "orders").where("o_totalprice > 499500")
    flagged = large.select(F.col("o_custkey").alias("payer"))
    return ops.shared_counterparties(_edges(spark, sf_dir), flagged, 5)


def shared_pairs(spark, sf_dir):
    return ops.shared_pairs(_edges(spark, sf_dir), 30)


def degree_outliers(spark, sf_dir):
    found = ops.degree_outliers(_edges(spark, sf_dir), 2.0)
    return found.select("side", "entity_id", "degree", rounded("score"))


def linked_groups(spark, sf_dir):
    pairs = ops.pair_concentration(_edges(spark, sf_dir), 4)
    # Payers become even ids and payees odd ones.
    links = pairs.select((F.col("payer") * 2).alias("a"), (F.col("payee") * 2 + 1).alias("b"))
    return ops.linked_groups(links, "a", "b")


QUERIES = {
    "pair_concentration": pair_concentration,
    "new_counterparty": new_counterparty,
    "hhi": hhi,
    "top_counterparties": top_counterparties,
    "shared_counterparties": shared_counterparties,
    "shared_pairs": shared_pairs,
    "degree_outliers": degree_outliers,
    "linked_groups": linked_groups,
}

_PAIRS = """p AS (SELECT o_custkey AS payer, l_suppkey AS payee, count(*) AS n,
                         sum(round(l_extendedprice * 100)::bigint) AS cents
                  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"""

ORACLE = {
    "pair_concentration": f"""
        WITH {_PAIRS} SELECT payer, payee, n, round(cents::double / 100, 2) AS amount FROM p WHERE n >= 4
    """,
    "new_counterparty": """
        SELECT o_custkey AS payer, l_suppkey AS payee, o_orderdate AS first_ts, o_orderkey AS first_txn
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey
        QUALIFY row_number() OVER (PARTITION BY o_custkey, l_suppkey ORDER BY o_orderdate, o_orderkey) = 1
    """,
    "hhi": f"""
        WITH {_PAIRS} SELECT payer, count(*) AS n_payees,
               round(sum(cents::hugeint * cents::hugeint)::double / (sum(cents)::double * sum(cents)::double), 8) AS hhi
        FROM p GROUP BY ALL
    """,
    "top_counterparties": f"""
        WITH {_PAIRS}, r AS (SELECT *, rank() OVER (PARTITION BY payer ORDER BY cents DESC) AS rank FROM p)
        SELECT payer, payee, round(cents::double / 100, 2) AS amount, rank::int AS rank FROM r WHERE rank <= 3
    """,
    "shared_counterparties": f"""
        WITH {_PAIRS}, f AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 499500),
        w AS (SELECT DISTINCT payee FROM p WHERE payer IN (FROM f))
        SELECT payer, count(*) AS n_payees, count(*) FILTER (payee IN (FROM w)) AS n_shared
        FROM p WHERE payer NOT IN (FROM f) GROUP BY ALL HAVING n_shared >= 5
    """,
    "shared_pairs": f"""
        WITH {_PAIRS} SELECT a.payer AS payer_a, b.payer AS payer_b, count(*) AS n_shared
        FROM p a JOIN p b ON a.payee = b.payee AND a.payer < b.payer GROUP BY ALL HAVING n_shared >= 30
    """,
    "degree_outliers": f"""
        WITH {_PAIRS}, d AS (SELECT 'out' AS side, payer AS entity_id, count(*) AS degree FROM p GROUP BY payer
                             UNION ALL SELECT 'in', payee, count(*) FROM p GROUP BY payee),
        m AS (SELECT side, median(degree) AS med FROM d GROUP BY ALL),
        a AS (SELECT side, median(abs(degree - med)) AS mad FROM d JOIN m USING (side) GROUP BY ALL)
        SELECT side, entity_id, degree, round(0.6745::double * (degree - med) / mad, 4) AS score
        FROM d JOIN m USING (side) JOIN a USING (side)
        WHERE mad > 0 AND abs(0.6745::double * (degree - med) / mad) > 2
    """,
    "linked_groups": f"""
        WITH RECURSIVE {_PAIRS}, e AS (SELECT payer * 2 AS a, payee * 2 + 1 AS b FROM p WHERE n >= 4),
        s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r AS (SELECT a AS node, a AS reached FROM s UNION SELECT r.node, s.b FROM r JOIN s ON r.reached = s.a)
        SELECT node, min(reached) AS "group" FROM r GROUP BY ALL
    """,
}
