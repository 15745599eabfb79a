"""Shared payees, calendar periods, accents and many features, against plain Python."""

import random
from datetime import datetime
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywarden.functions.text import edit_classes, edited_forms, normalise, without_accents
from tallywarden.operators import amounts, behaviour, counterparties, protection, reporting, sketches


def rings(seed):
    """Random payers, all of whom pay two hubs, and two rings of payers with payees of their own."""
    rng = random.Random(seed)
    edges = [(p, q) for p in range(60) for q in {1, 2, *(rng.randint(10, 80) for _ in range(rng.randint(1, 8)))}]
    edges += [(100 + p, 500 + q) for p in range(4) for q in range(6) if (p + q) % 5]
    edges += [(200, q) for q in range(10, 81)]  # one payer who pays almost everyone
    return edges + edges[:20]


@pytest.mark.parametrize(("min_shared", "limit"), [(1, 10**6), (3, 10**6), (4, 5)])
def test_shared_pairs_equal_brute_force(spark, min_shared, limit):
    rows = rings(min_shared)
    payees = {}
    for p, q in rows:
        payees.setdefault(p, set()).add(q)
    want = {(a, b, len(payees[a] & payees[b])) for a, b in combinations(sorted(payees), 2)}
    edges = spark.createDataFrame([*rows, (None, 1), (3, None)], "payer bigint, payee bigint").withColumn("amount", F.lit(1.0))
    got = {tuple(r) for r in counterparties.shared_pairs(edges, min_shared, limit).collect()}
    assert got == {w for w in want if w[2] >= min_shared} and got


def test_prefixes_leave_hubs_out(spark):
    rows = [(p, q) for p in range(300) for q in (1, 2, 1000 + 2 * p, 1001 + 2 * p)]
    pairs = spark.createDataFrame(rows, "payer bigint, payee bigint")
    prefixes = counterparties.payee_prefixes(pairs, 3)
    # Two of four payees are kept, the payer's own ones: of 44,850 pairs that share both hubs none is formed.
    assert prefixes.where("payee < 1000").count() == 0 and prefixes.count() == 600
    assert counterparties.shared_pairs(pairs, 3).count() == 0
    assert counterparties.payee_prefixes(pairs, 5).count() == 0


def test_calendar_counts_silent_periods_as_nothing(spark):
    def month(m, amount, who=1, year=2024):
        return who, datetime(year, m, 15), amount

    rows = [month(1, 10.0), month(2, 60.0), month(6, 5.0), month(7, 5.0), month(12, 7.0, year=2023), month(3, 4.0, 2), month(9, 1.0, 3), month(9, 2.0, None)]
    rows += [(4, None, 5.0), (4, datetime(2024, 1, 1), None)]
    df = spark.createDataFrame(rows, "who bigint, ts timestamp_ntz, amount double")
    got = {tuple(r) for r in behaviour.calendar_change(df, "who", "ts", "amount", "month", 5.0).collect()}
    first = lambda m: datetime(2024, m, 1)
    assert got == {
        (1, first(2), first(2), 60.0, 10.0, "rise"),
        (1, first(3), first(5), 0.0, 60.0, "silence"),
        (1, first(6), first(6), 5.0, 0.0, "restart"),
        (1, first(8), first(9), 0.0, 5.0, "silence"),
        (2, first(4), first(9), 0.0, 4.0, "silence"),
    }
    assert behaviour.calendar_change(df.where("false"), "who", "ts", "amount", "month", 5.0).count() == 0


def test_accented_names_match_plain_ones(spark):
    names = ["José Müller", "José Müller", "JOSE MULLER", "Łódź", "Ångström", "Việt Nguyễn", "Ελλάδα", "Й", "ñ"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select(normalise(F.col("name")).alias("n"))
    assert [r["n"] for r in rows.collect()] == ["jose muller"] * 3 + ["łodz", "angstrom", "viet nguyen", "ελλαδα", "и", "n"]
    (row,) = spark.range(1).select(without_accents(F.lit(None).cast("string")).alias("a"), without_accents(F.lit("")).alias("b")).collect()
    assert row["a"] is None and row["b"] == ""
    people = spark.createDataFrame([(1, "José Müller"), (2, "Jose Mueller"), (3, "Ana Peña")], "id int, name string")
    listed = spark.createDataFrame([("jose muller",), ("ANA PENA",)], "entry string")
    assert sorted(r["id"] for r in protection.screen_exact(people, "name", listed, "entry").collect()) == [1, 3]
    found = protection.screen_fuzzy(people, "name", listed, "entry", 1).collect()
    assert sorted((r["id"], r["distance"]) for r in found) == [(1, 0), (2, 1), (3, 0)]


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_distance_in_many_features(spark, k):
    rng = np.random.default_rng(k)
    mixed = rng.normal(size=(200, k)) @ rng.normal(size=(k, k)) + 1000
    points = np.round(mixed * 10, 2)
    names = [f"f{i}" for i in range(k)]
    df = spark.createDataFrame([tuple(map(float, p)) for p in points] + [(None,) * k], ", ".join(f"{n} double" for n in names))
    centred = points - points.mean(0)
    want = np.einsum("ij,jk,ik->i", centred, np.linalg.inv(np.atleast_2d(np.cov(points.T))), centred)
    got = [r["d2"] for r in amounts.mahalanobis_distance(df, names).collect()]
    assert got[-1] is None and got[:-1] == pytest.approx(list(want), rel=1e-6)
    assert amounts.mahalanobis_distance(df, names, 4.0).count() == (want > 4).sum()


def test_a_singular_matrix_gives_no_distance(spark):
    df = spark.createDataFrame([(float(i), float(2 * i), 3.0, float(i * i)) for i in range(9)], "a double, b double, c double, d double")
    for names in (["a", "b"], ["a", "c"], ["d", "a", "b"]):
        assert {r["d2"] for r in amounts.mahalanobis_distance(df, names).collect()} == {None}
        assert amounts.mahalanobis_distance(df, names, 1.0).count() == 0
    assert amounts.mahalanobis_distance(df.where("false"), ["a", "d"]).count() == 0
    assert amounts.mahalanobis_distance(df, ["a", "d"]).where("d2 IS NULL").count() == 0


def test_stored_days_merge_and_are_replaced(spark, tmp_path):
    rng = random.Random(5)
    rows = [("a" if i % 3 else None, datetime(2024, 1, 1 + i % 9), rng.randint(1, 4000), float(rng.lognormvariate(3, 1))) for i in range(9000)]
    rows += [("empty", datetime(2024, 1, 1), None, None)]
    df = spark.createDataFrame(rows, "grp string, ts timestamp_ntz, who bigint, amount double")
    path = f"{tmp_path}/sketches"
    make = lambda d: sketches.daily_sketches(d, "grp", "ts", "who", "amount")
    sketches.store_days(make(df.where("day(ts) < 7")), path)
    sketches.store_days(make(df.where("day(ts) >= 5")), path)  # days 5 and 6 once more
    stored = spark.read.parquet(path)
    assert stored.agg(F.sum("n")).first()[0] == len(rows)
    exact = {r["group"]: r for r in sketches.checked_distinct(df, "grp", "who", stored).collect()}
    want = {g: len({r[2] for r in rows if r[0] == g and r[2]}) for g in ("a", None, "empty")}
    assert {g: r["exact"] for g, r in exact.items()} == want and all(r["within_bound"] for r in exact.values())
    found = {r["group"]: r for r in sketches.checked_quantiles(df, "grp", "amount", stored, {"q10": 0.1, "q90": 0.9}).collect()}
    assert set(found) == {"a", None} and all(r["q10_within"] and r["q90_within"] for r in found.values())
    # Some days only: the answer comes from their sketches.
    some = sketches.distinct_estimate(stored.where("day = DATE '2024-01-02'")).where("group = 'a'").first()["estimate"]
    assert some == pytest.approx(len({r[2] for r in rows if r[0] == "a" and r[1].day == 2}), rel=sketches.COUNT_BOUND)
    # A wrong sketch is noticed.
    doubled = df.withColumns({"who": F.col("who") % 100, "amount": F.col("amount") * 2})
    assert not any(r["within_bound"] for r in sketches.checked_distinct(df.where("grp = 'a'"), "grp", "who", make(doubled)).collect())
    assert not any(r["q90_within"] for r in sketches.checked_quantiles(df, "grp", "amount", make(doubled), {"q90": 0.9}).collect())


def test_unknown_entities_and_groups_have_a_rank(spark):
    pay = spark.createDataFrame([(None, 9.0), (1, 5.0), (2, 7.0), (3, 1.0)], "who bigint, amount double")
    peers = spark.createDataFrame([(None, "x"), (1, "x"), (2, None), (3, None)], "who bigint, peer string")
    found = amounts.peer_rank(pay, "who", "amount", peers, "peer", 0.5)
    assert {(r["who"], r["peer"], r["percent_rank"]) for r in found.collect()} == {(None, "x", 1.0), (2, None, 1.0)}


def test_scores_of_decimal_weights_do_not_depend_on_order(spark):
    alerts = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("a", 2), ("z", 2)], "detector string, entity_id bigint")
    found = reporting.risk_score(alerts, {"a": 0.1, "b": 0.2, "c": 0.3}).collect()
    assert {(r["entity_id"], r["n_alerts"], r["score"]) for r in found} == {(1, 3, 0.6), (2, 2, 0.1)}


def test_indexed_screening_finds_nearly_all_of_the_exact_hits(spark):
    rng = random.Random(8)
    syllables = ["ka", "ro", "lin", "mar", "te", "sö", "bel", "dan", "vi", "ho"]
    listed = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 3))) for _ in range(300)]

    def edited(name):
        at = rng.randrange(len(name))
        return name[:at] + rng.choice(["", "x", name[at] + "y"]) + name[at + 1 :]

    people = [(i, edited(edited(n)) if i % 2 else edited(n).upper()) for i, n in enumerate(listed * 2)] + [(9999, None), (9998, "--")]
    df = spark.createDataFrame(people, "id int, name string")
    entries = spark.createDataFrame([(n,) for n in [*listed, None]], "entry string")
    index = protection.index_names(entries, "entry", 2)
    sizes = index.groupBy(F.length("entry") > protection.SHORT, "entry").count().toDF("long", "entry", "n")
    assert {r["n"] for r in sizes.where("long").collect()} == {protection.BANDS} and sizes.agg(F.max("n")).first()[0] <= 56
    found = protection.screen_indexed(df, "name", index, 2).collect()
    exact = protection.screen_fuzzy(df, "name", entries, "entry", 2).select("id", normalise(F.col("entry")).alias("e"), "distance").distinct()
    want = {tuple(r) for r in exact.collect()}
    got = {(r["id"], r["entry"], r["distance"]) for r in found}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 500
    short = {w for w in want if len(w[1]) <= protection.SHORT}
    assert short <= got and short
    (row,) = protection.screening_recall(df, "name", entries, "entry", 2, index).collect()
    assert 0.9 <= row["recall"] <= 1 and row["n_found"] <= row["n_exact"]
    (row,) = protection.screening_recall(df.where("false"), "name", entries, "entry", 2, index).collect()
    assert (row["n_exact"], row["n_found"], row["recall"]) == (0, 0, None)


def test_bitmaps_exclude_no_pair_that_shares_enough(spark):
    # Payer 0 pays nearly everyone; payers 1 and 2 share 40 payees, 3 and 4 share 29.
    sets = {0: range(900), 1: range(100, 150), 2: range(110, 160), 3: range(2000, 2035), 4: range(2006, 2041)}
    rows = [(a, b) for a, payees in sets.items() for b in payees] + [(None, 100), (1, None)]
    pairs = spark.createDataFrame(rows, "payer int, payee int")
    maps = {r["payer"]: r for r in counterparties.payee_bitmaps(pairs.dropna()).collect()}
    longs = [f"bits_{i}" for i in range(counterparties.BITMAP_LONGS)]
    for a in sets:
        assert maps[a]["slack"] == len(sets[a]) - sum((maps[a][c] % 2**64).bit_count() for c in longs)
        for b in sets:
            common = sum((maps[a][c] & maps[b][c] & (2**64 - 1)).bit_count() for c in longs)
            assert len(set(sets[a]) & set(sets[b])) <= common + min(maps[a]["slack"], maps[b]["slack"])
    edges = pairs.selectExpr("payer", "payee", "1L AS txn_id", "current_date() AS ts", "1.0D AS amount")
    found = {(r["payer_a"], r["payer_b"]): r["n_shared"] for r in counterparties.shared_pairs(edges, 30).collect()}
    assert found == {(0, 1): 50, (0, 2): 50, (1, 2): 40}


def test_recall_takes_each_pair_of_names_once(spark):
    names = ["Anna Bergström", "anna bergstrom", "Anna Bergstrom Ltd", "Jo", "Jon", "..."]
    df = spark.createDataFrame([(n,) for n in names] * 50, "name string")
    listed = df.select(F.col("name").alias("entry"))
    near = protection._near(protection._distinct(df, "name", "_name"), protection._distinct(listed, "entry", "_entry"), 2)
    assert near.count() == 6  # four names with themselves, Jo and Jon both ways; the longer name is 4 edits off
    index = protection.index_names(listed, "entry", 2)
    row = protection.screening_recall(df, "name", listed, "entry", 2, index).first()
    assert (row["n_exact"], row["n_found"]) == (6, 6)


def test_forms_of_names_are_shared_only_by_near_ones(spark):
    rng = random.Random(21)
    texts = ["", "a", "ab", "ba", "aab", "0012", "0021", "0102", "1200"] + ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(50)]
    texts = sorted(set(texts))
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for depth in (0, 1, 2, 3):
        met = set()
        for c in edit_classes(depth):
            ours, theirs = (rows.select(F.col("t").alias(n), F.explode(edited_forms(F.col("t"), c, depth, n == "b")).alias("f")) for n in "ab")
            met |= {tuple(r) for r in ours.join(theirs, "f").select("a", "b").distinct().collect()}
        near = rows.alias("x").join(rows.alias("y"), F.levenshtein("x.t", "y.t") <= depth)
        assert met == {tuple(r) for r in near.select("x.t", "y.t").collect()}


def test_recall_looks_only_at_near_names(spark):
    # Nearly all names share a signature and many a shortened text; pairs that are near are few.
    df = spark.range(400).select(F.format_string("Supplier#%09d", F.col("id") * 977).alias("name"))
    listed = df.where("name like '%1' or name like '%4'").select(F.translate("name", "ui", "úï").alias("entry"))
    other = spark.createDataFrame([("supplier 000000009",), (None,)], "entry string")
    index = protection.index_names(listed.limit(60).unionByName(other), "entry", 2)
    found = protection.screening_recall(df, "name", listed, "entry", 2, index)
    exact = protection.screen_fuzzy(df, "name", listed, "entry", 2).count()
    hits = protection.screen_indexed(df, "name", index, 2).count()
    row = found.first()
    assert (row["n_exact"], row["n_found"], row["recall"]) == (exact, hits, hits / exact)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Names meet by their forms, by the list and by their own signatures, never by a signature alone.
    assert "signature" in plan and "_signature#" not in plan
