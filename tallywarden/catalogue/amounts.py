"""Registered amount-anomaly queries."""

from __future__ import annotations

from tallywarden.catalogue.common import rounded
from tallywarden.operators import amounts as ops
from tallywarden.operators.amounts import BENFORD
from tallywarden.sources.tables import load


def zscore_global(spark, sf_dir):
    hits = ops.zscore_global(load(spark, sf_dir, "events"), "value", 3.0)
    return hits.select("event_id", "user_id", rounded("value"), rounded("zscore"))


def mad_score(spark, sf_dir):
    hits = ops.mad_score(load(spark, sf_dir, "events"), "event_type", "value", 3.5)
    return hits.select(
        "event_id", "event_type", *(rounded(c) for c in ("value", "median", "mad", "score"))
    )


def iqr_fence(spark, sf_dir):
    hits = ops.iqr_fence(load(spark, sf_dir, "events"), "event_type", "value", 1.5)
    return hits.select("event_id", "event_type", rounded("value"), rounded("fence"))


def prior_zscore(spark, sf_dir):
    hits = ops.prior_zscore(
        load(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", 5, 3.0
    )
    return hits.select("o_orderkey", "o_custkey", "n_prior", rounded("zscore"))


def rolling_median(spark, sf_dir):
    rows = ops.rolling_median(load(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 10)
    return rows.select(
        "event_id", "user_id", rounded("value"), rounded("median_prior"), rounded("deviation")
    )


def peer_rank(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    customers = load(spark, sf_dir, "customer")
    top = ops.peer_rank(orders, "c_custkey", "o_totalprice", customers, "c_mktsegment", 0.99)
    return top.select("c_custkey", "c_mktsegment", rounded("total", 2), rounded("percent_rank", 6))


def benford(spark, sf_dir):
    rows = ops.benford(load(spark, sf_dir, "lineitem"), "l_extendedprice")
    return rows.select("digit", "n", rounded("share", 6), rounded("expected", 6))


def benford_by_entity(spark, sf_dir):
    rows = ops.benford_by_entity(load(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", 10)
    return rows.select("o_custkey", "n", rounded("chi2", 6))


def round_amounts(spark, sf_dir):
    rows = ops.round_amounts(load(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", 1)
    return rows.select("o_custkey", "n", "n_round", rounded("share", 6))


def mahalanobis(spark, sf_dir):
    rows = ops.mahalanobis(load(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 4.0)
    return rows.select(
        "l_orderkey", "l_linenumber", "l_quantity", rounded("l_extendedprice", 2), rounded("d2")
    )


def mahalanobis_3(spark, sf_dir):
    rows = ops.mahalanobis_distance(load(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], 6.0)
    return rows.select(
        "l_orderkey", "l_linenumber", "l_quantity", rounded("l_extendedprice", 2), rounded("l_discount", 2), rounded("d2")
    )


def multivariate(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    hits = ops.multivariate(lines, ["l_quantity", "l_extendedprice", "l_discount"], 4, 1.6)
    return hits.select("l_orderkey", "l_linenumber", "cluster", rounded("distance"))


QUERIES = {
    "zscore_global": zscore_global,
    "mad_score": mad_score,
    "iqr_fence": iqr_fence,
    "prior_zscore": prior_zscore,
    "rolling_median": rolling_median,
    "peer_rank": peer_rank,
    "benford": benford,
    "benford_by_entity": benford_by_entity,
    "round_amounts": round_amounts,
    "mahalanobis": mahalanobis,
    "mahalanobis_3": mahalanobis_3,
    "multivariate": multivariate,
}

_DIGIT_VALUES = ", ".join(f"({d}, {p!r}::double)" for d, p in enumerate(BENFORD, 1))
_CHI2 = " + ".join(f"d{d}::double * d{d} / (n * {p!r}::double)" for d, p in enumerate(BENFORD, 1))
_DIGIT_COUNTS = ", ".join(f"count(*) FILTER (digit = '{d}') AS d{d}" for d in range(1, 10))

ORACLE = {
    "zscore_global": """
        WITH c AS (SELECT *, round(value * 100)::bigint AS cents FROM events),
        m AS (SELECT count(*) AS n, sum(cents::hugeint) AS s, stddev_samp(cents::double) AS sd FROM c),
        z AS (SELECT event_id, user_id, value,
                     (cents::double - s::double / n::double) / sd AS zscore FROM c, m)
        SELECT event_id, user_id, round(value, 4) AS value, round(zscore, 4) AS zscore
        FROM z WHERE abs(zscore) > 3
    """,
    "mad_score": """
        WITH c AS (SELECT *, round(value * 100)::bigint AS cents FROM events),
        m AS (SELECT event_type, median(cents) AS median FROM c GROUP BY ALL),
        d AS (SELECT c.*, median, abs(cents - median) AS distance FROM c JOIN m USING (event_type)),
        a AS (SELECT event_type, median(distance) AS mad FROM d GROUP BY ALL)
        SELECT event_id, event_type, round(value, 4) AS value, round(median / 100, 4) AS median,
               round(mad / 100, 4) AS mad, round(0.6745::double * (cents - median) / mad, 4) AS score
        FROM d JOIN a USING (event_type)
        WHERE mad > 0 AND abs(0.6745::double * (cents - median) / mad) > 3.5
    """,
    "iqr_fence": """
        WITH c AS (SELECT *, round(value * 100)::bigint AS cents FROM events),
        q AS (SELECT event_type, quantile_cont(cents, 0.25) AS q1, quantile_cont(cents, 0.75) AS q3
              FROM c GROUP BY ALL)
        SELECT event_id, event_type, round(value, 4) AS value,
               round((q3 + 1.5::double * (q3 - q1)) / 100, 4) AS fence
        FROM c JOIN q USING (event_type) WHERE cents > q3 + 1.5::double * (q3 - q1)
    """,
    "prior_zscore": """
        WITH c AS (SELECT *, round(o_totalprice * 100)::bigint AS cents FROM orders),
        w AS (SELECT o_orderkey, o_custkey, cents, count(*) OVER p AS n,
                     sum(cents::hugeint) OVER p AS s, stddev_samp(cents::double) OVER p AS sd
              FROM c WINDOW p AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        z AS (SELECT *, (cents::double - s::double / n::double) / sd AS zscore
              FROM w WHERE n >= 5 AND sd > 1e-6)
        SELECT o_orderkey, o_custkey, n AS n_prior, round(zscore, 4) AS zscore FROM z WHERE abs(zscore) > 3
    """,
    "rolling_median": """
        SELECT event_id, user_id, round(value, 4) AS value, round(median(value) OVER p, 4) AS median_prior,
               round(value - median(value) OVER p, 4) AS deviation
        FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id
                                 ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)
    """,
    "peer_rank": """
        WITH t AS (SELECT c_custkey, c_mktsegment, sum(round(o_totalprice * 100)::bigint::hugeint) AS cents
                   FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
        r AS (SELECT *, percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY cents) AS pr FROM t)
        SELECT c_custkey, c_mktsegment, round(cents::double / 100, 2) AS total, round(pr, 6) AS percent_rank
        FROM r WHERE pr >= 0.99::double
    """,
    "benford": f"""
        WITH x AS (SELECT substr((abs(round(l_extendedprice * 100)::bigint))::varchar, 1, 1)::int AS digit
                   FROM lineitem WHERE round(l_extendedprice * 100) <> 0),
        c AS (SELECT digit, count(*) AS n FROM x GROUP BY ALL)
        SELECT digit, n, round(n::double / sum(n) OVER (), 6) AS share, round(p, 6) AS expected
        FROM c JOIN (VALUES {_DIGIT_VALUES}) v(digit, p) USING (digit)
    """,
    "benford_by_entity": f"""
        WITH x AS (SELECT o_custkey, substr((round(o_totalprice * 100)::bigint)::varchar, 1, 1) AS digit
                   FROM orders),
        c AS (SELECT o_custkey, count(*) AS n, {_DIGIT_COUNTS} FROM x GROUP BY ALL)
        SELECT o_custkey, n, round({_CHI2} - n, 6) AS chi2 FROM c WHERE n >= 10
    """,
    "round_amounts": """
        SELECT o_custkey, count(*) AS n, count(*) FILTER (round(o_totalprice * 100)::bigint % 100 = 0) AS n_round,
               round(count(*) FILTER (round(o_totalprice * 100)::bigint % 100 = 0) / count(*)::double, 6) AS share
        FROM orders GROUP BY ALL HAVING n_round > 0
    """,
    "mahalanobis": """
        WITH c AS (SELECT *, round(l_quantity * 100)::bigint AS a, round(l_extendedprice * 100)::bigint AS b
                   FROM lineitem),
        m AS (SELECT avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS cab
              FROM c),
        d AS (SELECT c.*, (vb * (a - ma) * (a - ma) - 2 * cab * (a - ma) * (b - mb) + va * (b - mb) * (b - mb))
                          / (va * vb - cab * cab) AS d2 FROM c, m)
        SELECT l_orderkey, l_linenumber, l_quantity, round(l_extendedprice, 2) AS l_extendedprice,
               round(d2, 4) AS d2
        FROM d WHERE d2 > 4
    """,
    "mahalanobis_3": """
        WITH c AS (SELECT *, round(l_quantity * 100)::bigint AS a, round(l_extendedprice * 100)::bigint AS b,
                          round(l_discount * 100)::bigint AS c FROM lineitem),
        m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, stddev_samp(a) AS sa, stddev_samp(b) AS sb,
                     stddev_samp(c) AS sc, corr(a, b) AS p, corr(a, c) AS q, corr(b, c) AS r FROM c),
        z AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, (a - ma) / sa AS x,
                     (b - mb) / sb AS y, (c - mc) / sc AS z, p, q, r FROM c, m),
        d AS (SELECT *, ((1 - r * r) * x * x + (1 - q * q) * y * y + (1 - p * p) * z * z
                         + 2 * (q * r - p) * x * y + 2 * (p * r - q) * x * z + 2 * (p * q - r) * y * z)
                        / (1 + 2 * p * q * r - p * p - q * q - r * r) AS d2 FROM z)
        SELECT l_orderkey, l_linenumber, l_quantity, round(l_extendedprice, 2) AS l_extendedprice,
               round(l_discount, 2) + 0.0 AS l_discount, round(d2, 4) AS d2 FROM d WHERE d2 > 6
    """,
}
