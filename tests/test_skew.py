"""Detectors give the same rows whether or not a key counts as too large for one task.

A third of the rows and more belong to one entity, as exact copies and shared
instants too.
"""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallywarden.operators import amounts, behaviour, counterparties, integrity, reporting

LIMIT = 40
WIDE = 10**9


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(17)
    data = []
    for i in range(1200):
        who = 1 if i % 2 else rng.randint(2, 40)
        minute = 777 if i % 5 == 0 else rng.randint(0, 3000)
        amount = 50.0 if i % 7 == 0 else round(rng.lognormvariate(4, 0.7), 2)
        kind = rng.choice(["error", "purchase", "view"])
        data.append((i, who, datetime(2024, 1, 1) + timedelta(minutes=minute), amount, kind))
    frame = spark.createDataFrame(data, "id bigint, who bigint, ts timestamp_ntz, amount double, kind string")
    return frame.repartition(5)


ORDER = ["ts", "id"]
KIND = "kind"
DETECTORS = {
    "mad_score": lambda d, n: amounts.mad_score(d, "who", "amount", 2.0, n),
    "iqr_fence": lambda d, n: amounts.iqr_fence(d, "kind", "amount", 1.0, n),
    "prior_zscore": lambda d, n: amounts.prior_zscore(d, "who", ORDER, "amount", 3, 1.5, n),
    "rolling_median": lambda d, n: amounts.rolling_median(d, "who", ORDER, "amount", 7, n),
    "peer_rank": lambda d, n: amounts.peer_rank(
        d, "id", "amount", d.select("id", F.lit("p").alias("peer")), "peer", 0.8, n
    ),
    "velocity": lambda d, n: behaviour.velocity(d, "who", "ts", "amount", "45 MINUTES", 4, n),
    "dormant": lambda d, n: behaviour.dormant_reactivation(d, "who", "ts", "id", 1, n),
    "sequence": lambda d, n: behaviour.sequence(
        d, "who", "ts", "id", F.col("kind") == "error", F.col("kind") == "purchase", "10 MINUTES", n
    ),
    "asof_last": lambda d, n: behaviour.asof_last(
        d.where("kind = 'error'"), d.where("kind = 'purchase'"), "who", "ts", "id", "amount", n
    ),
    "sessions": lambda d, n: behaviour.sessions(d, "who", "ts", "id", "amount", "9 MINUTES", n),
    "gap_stats": lambda d, n: behaviour.gap_stats(d, "who", "ts", "id", n),
    "near_duplicates": lambda d, n: integrity.near_duplicates(d, "who", "id", "ts", "amount", 150, 1, n),
    "degree_outliers": lambda d, n: counterparties.degree_outliers(
        d.select(F.col("who").alias("payer"), (F.col("id") % 91).alias("payee")), 1.0, n
    ),
    "amount_profile": lambda d, n: reporting.amount_profile(d, "kind", "amount", {"q": 0.3, "m": 0.5}, n),
}


def collected(df):
    cells = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    return sorted((cells(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("name", DETECTORS)
def test_same_rows_with_and_without_blocks(rows, name):
    blocked, plain = DETECTORS[name](rows, LIMIT), DETECTORS[name](rows, WIDE)
    want = collected(plain)
    assert want and collected(blocked) == want


def test_near_duplicates_against_all_pairs(rows):
    data = [(r["id"], r["who"], r["ts"], round(r["amount"] * 100)) for r in rows.collect()]
    want = set()
    for a, b in itertools.combinations(data, 2):
        if a[1] == b[1] and abs(a[3] - b[3]) <= 150 and abs((a[2].date() - b[2].date()).days) <= 1:
            want |= {a[0], b[0]}
    got = integrity.near_duplicates(rows, "who", "id", "ts", "amount", 150, 1, LIMIT)
    assert {r["id"] for r in got.collect()} == want


def test_result_does_not_depend_on_partitions(rows):
    one = collected(amounts.prior_zscore(rows.coalesce(1), "who", ORDER, "amount", 3, 1.5, LIMIT))
    many = collected(amounts.prior_zscore(rows.repartition(13, "amount"), "who", ORDER, "amount", 3, 1.5, LIMIT))
    assert one == many
