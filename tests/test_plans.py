"""The block-wise plans must give what the plain window gives, with one key holding most rows."""

import random

import pytest
from pyspark.sql import Window, functions as F

from tallywarden.plans.ordered import (
    FRAME,
    OWN,
    last_before,
    ordering,
    preceding_frames,
    running_sums,
    trailing_totals,
)
from tallywarden.plans.quantiles import exact_quantiles
from tallywarden.plans import skew
from tallywarden.plans.skew import attach, cut_points, key_profile, with_blocks

LIMIT = 50


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        key = 1 if i % 3 else (None if i % 27 == 0 else rng.randint(2, 60))
        # Many instants are shared, one of them by a large part of the large key.
        minute = 500 if rng.random() < 0.2 else rng.randint(0, 900)
        # One small key has no known value at all.
        value = None if key == 7 or rng.random() < 0.05 else round(rng.gauss(100, 30), 2)
        rows.append((i, key, minute, value))
    frame = spark.createDataFrame(rows, "id bigint, key bigint, minute int, value double")
    return frame.withColumn(
        "ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, minute)")
    ).repartition(6)


def by(df):
    found = ordering(df, ["key"], ["ts", "id"], LIMIT)
    assert found.cuts is not None
    return found


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_profile_lists_only_large_keys(skewed):
    profile = key_profile(skewed, ["key"], LIMIT)
    assert profile.rows == 3000
    assert {r["key"] for r in profile.hot} >= {1, None}
    assert not key_profile(skewed, ["key"], 3000).hot


def test_blocks_split_the_large_key_in_order(skewed):
    cuts = cut_points(skewed, ["key"], ["ts", "id"], LIMIT)
    blocks = with_blocks(skewed, ["key"], ["ts", "id"], cuts)
    assert blocks.count() == 3000
    spans = (
        blocks.where("key = 1")
        .groupBy("_block")
        .agg(F.count("*").alias("n"), F.min(F.struct("ts", "id")).alias("a"), F.max(F.struct("ts", "id")).alias("b"))
        .orderBy("_block")
        .collect()
    )
    assert len(spans) > 10
    assert max(s["n"] for s in spans) < 10 * LIMIT
    assert all(x["b"] < y["a"] for x, y in zip(spans, spans[1:]))
    # Even the rows of one instant are split.
    assert blocks.where("key = 1 AND minute = 500").select("_block").distinct().count() > 2


def test_running_sums(skewed):
    w = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    cents = F.round(F.col("value") * 100).cast("bigint")
    want = skewed.select(
        "id", F.sum(cents).over(w).alias("s"), F.sum(F.lit(1)).over(w).alias("n")
    )
    got = running_sums(skewed, by(skewed), {"s": cents, "n": F.lit(1)})
    assert collected(got.select("id", "s", "n")) == collected(want)


def test_last_before(skewed):
    w = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    sometimes = F.when(F.col("id") % 40 == 0, F.col("id"))
    want = skewed.select("id", F.last(sometimes, True).over(w), F.lag("ts").over(Window.partitionBy("key").orderBy("ts", "id")))
    got = last_before(skewed, by(skewed), {"x": sometimes, "t": F.col("ts")})
    assert collected(got.select("id", "x", "t")) == collected(want)


@pytest.mark.parametrize("n", [3, 120])
def test_preceding_frames(skewed, n):
    w = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(-n, -1)
    want = skewed.select("id", F.sort_array(F.collect_list("id").over(w)))
    framed = preceding_frames(skewed, by(skewed), n, LIMIT)
    wf = Window.partitionBy("key", FRAME).orderBy("ts", "id").rowsBetween(-n, -1)
    got = framed.withColumn("x", F.sort_array(F.collect_list("id").over(wf))).where(OWN)
    assert collected(got.select("id", "x")) == collected(want)
    assert framed.groupBy("key", FRAME).count().agg(F.max("count")).first()[0] <= max(LIMIT, n) + n


@pytest.mark.parametrize("limit", [LIMIT, 10**6])
def test_trailing_totals_include_both_ends_and_ties(skewed, limit):
    cents = F.round(F.col("value") * 100).cast("bigint")
    skewed.createOrReplaceTempView("skewed")
    want = skewed.sparkSession.sql(
        """SELECT DISTINCT key, ts, count(*) OVER w AS n,
                  sum(cast(round(value * 100) AS bigint)) OVER w AS amount
           FROM skewed WINDOW w AS (PARTITION BY key ORDER BY ts
                                    RANGE BETWEEN INTERVAL 30 MINUTES PRECEDING AND CURRENT ROW)"""
    )
    got = trailing_totals(skewed, ["key"], "ts", "30 MINUTES", cents, limit)
    assert collected(got.select("key", "ts", "n", "amount")) == collected(want)


def test_quantiles(skewed):
    probs = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "p99": 0.99, "hi": 1.0}
    got = exact_quantiles(skewed, ["key"], "value", probs, LIMIT)
    want = skewed.where("value IS NOT NULL").groupBy("key").agg(*(F.percentile("value", p).alias(n) for n, p in probs.items()))
    ours, theirs = ({r["key"]: r for r in x.collect()} for x in (got, want))
    assert ours.keys() == theirs.keys()
    for key, row in theirs.items():
        assert list(ours[key]) == pytest.approx(list(row), abs=1e-9)


def test_quantiles_when_most_values_are_equal(spark):
    rows = [(1, 5.0)] * 700 + [(1, float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "key bigint, value double")
    got = exact_quantiles(df, ["key"], "value", {"q": 0.5, "p": 0.9}, LIMIT).first()
    want = df.agg(F.percentile("value", 0.5), F.percentile("value", 0.9)).first()
    assert (got["q"], got["p"]) == pytest.approx(tuple(want))


def test_large_key_sketch_bracket_is_exact_on_many_rows(spark):
    df = spark.range(200_000).select(
        F.lit("a").alias("key"), ((F.col("id") * 7919) % 200_003).cast("double").alias("value")
    )
    got = exact_quantiles(df, ["key"], "value", {"q": 0.123, "m": 0.5}, 1000).first()
    want = df.agg(F.percentile("value", 0.123), F.percentile("value", 0.5)).first()
    assert (got["q"], got["m"]) == pytest.approx(tuple(want))


def test_attach_gives_the_same_rows_by_every_join(skewed, monkeypatch):
    per_key = skewed.groupBy("key").agg(F.max("minute").alias("latest"))
    profile = key_profile(skewed, ["key"], LIMIT)
    want = collected(attach(skewed, per_key, ["key"], profile).select("id", "key", "latest"))
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 1)
    split = attach(skewed, per_key, ["key"], profile).select("id", "key", "latest")
    whole = attach(skewed, per_key, ["key"], key_profile(skewed, ["key"])).select("id", "key", "latest")
    assert len(want) == 3000
    assert collected(split) == want
    assert collected(whole) == want


def test_every_large_key_is_cut_however_many_there_are(spark):
    df = spark.range(200_000).select((F.col("id") % 2_000).alias("key"), "id")
    assert len(key_profile(df, ["key"], LIMIT).hot) == 2_000
    blocks = with_blocks(df, ["key"], ["id"], cut_points(df, ["key"], ["id"], LIMIT // 2))
    sizes = blocks.groupBy("key", "_block").count()
    assert sizes.agg(F.max("count")).first()[0] < 4 * LIMIT
    assert sizes.agg(F.sum("count")).first()[0] == 200_000


@pytest.mark.parametrize("most", [1, 10**6])
def test_blocks_are_the_same_by_broadcast_and_by_shuffle(skewed, monkeypatch, most):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", most)
    w = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.select("id", F.sum("minute").over(w))
    cut = by(skewed)
    assert cut.cuts.small == (most > 1)
    assert collected(running_sums(skewed, cut, {"s": F.col("minute")}).select("id", "s")) == collected(want)
