"""Small cases worked out by hand: empty input, no spread, nulls, ties, values on the threshold."""

import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallywarden.functions.text import luhn_valid, masked, normalise, within_deletions
from tallywarden.operators import amounts, behaviour, counterparties, integrity, protection, reporting
from tallywarden.session import shared_root
from tallywarden.sources.alerts import to_alerts
from tallywarden.sources.transactions import parse_props

T0 = datetime(2024, 1, 1)
SCHEMA = "id bigint, who bigint, ts timestamp_ntz, amount double"


@pytest.fixture(scope="module")
def frame(spark):
    def build(rows, schema=SCHEMA):
        return spark.createDataFrame(rows, schema)

    return build


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


def test_detectors_accept_empty_input(frame):
    empty = frame([])
    order = ["ts", "id"]
    results = [
        amounts.zscore_global(empty, "amount", 3.0),
        amounts.mad_score(empty, "who", "amount", 3.5),
        amounts.iqr_fence(empty, "who", "amount", 1.5),
        amounts.prior_zscore(empty, "who", order, "amount", 2, 3.0),
        amounts.rolling_median(empty, "who", order, "amount", 3),
        amounts.benford(empty, "amount"),
        amounts.mahalanobis(empty, "amount", "id", 1.0),
        behaviour.velocity(empty, "who", "ts", "amount", "1 HOUR", 2),
        behaviour.sessions(empty, "who", "ts", "id", "amount", "1 HOUR"),
        behaviour.gap_stats(empty, "who", "ts", "id"),
        integrity.near_duplicates(empty, "who", "id", "ts", "amount", 100, 3),
    ]
    assert [r.count() for r in results] == [0] * len(results)


def test_no_spread_gives_no_scores(frame):
    same = frame([(i, 1, at(i), 5.0) for i in range(10)] + [(10, 1, at(10), 50.0)])
    assert amounts.mad_score(same, "who", "amount", 3.5).count() == 0
    assert amounts.prior_zscore(same, "who", ["ts", "id"], "amount", 2, 1.0).count() == 0
    flat = same.where("id < 10")
    assert amounts.zscore_global(flat, "amount", 0.0).count() == 0


def test_mad_score_by_hand(frame):
    # Median 3, distances 2 1 0 1 97, so a MAD of 1.
    rows = frame([(i, 1, at(i), a) for i, a in enumerate([1.0, 2.0, 3.0, 4.0, 100.0])])
    hit = amounts.mad_score(rows, "who", "amount", 3.5).first()
    assert (hit["id"], hit["median"], hit["mad"]) == (4, 3.0, 1.0)
    assert hit["score"] == pytest.approx(0.6745 * 97)


def test_null_amounts_are_not_scored_and_not_counted(frame):
    rows = frame([(i, 1, at(i), a) for i, a in enumerate([1.0, 3.0, None, 2.0, 90.0, None])])
    hits = amounts.prior_zscore(rows, "who", ["ts", "id"], "amount", 3, 3.0).collect()
    assert [(h["id"], h["n_prior"]) for h in hits] == [(4, 3)]
    assert ids(amounts.mad_score(rows, "who", "amount", 3.5)) == [4]


def test_later_rows_do_not_change_earlier_scores(frame):
    values = [10.0, 12.0, 11.0, 13.0, 60.0, 12.0, 300.0]
    rows = frame([(i, 1, at(i), a) for i, a in enumerate(values)])
    score = lambda df: {
        r["id"]: r["zscore"] for r in amounts.prior_zscore(df, "who", ["ts", "id"], "amount", 2, 0.0).collect()
    }
    full, part = score(rows), score(rows.where("id < 5"))
    assert part and all(full[i] == part[i] for i in part)


def test_tighter_threshold_gives_a_subset(frame):
    rows = frame([(i, i % 3, at(i), float((i * 37) % 101)) for i in range(200)])
    loose = set(ids(amounts.mad_score(rows, "who", "amount", 1.0)))
    tight = set(ids(amounts.mad_score(rows, "who", "amount", 1.2)))
    assert tight < loose


def test_planted_anomalies_are_found(frame):
    ordinary = [(i, i % 5, at(i * 60), 100.0 + (i * 7) % 11) for i in range(300)]
    planted = [(1000, 2, at(9999), 5000.0), (1001, 3, at(9999), 7000.0)]
    rows = frame(ordinary + planted)
    assert ids(amounts.mad_score(rows, "who", "amount", 10.0)) == [1000, 1001]
    assert ids(amounts.iqr_fence(rows, "who", "amount", 3.0)) == [1000, 1001]
    assert set(ids(amounts.prior_zscore(rows, "who", ["ts", "id"], "amount", 5, 20.0))) == {1000, 1001}
    assert ids(amounts.zscore_global(rows, "amount", 5.0)) == [1000, 1001]


def test_velocity_includes_the_edge_and_ties(frame):
    rows = frame([(1, 1, at(0), 1.0), (2, 1, at(60), 2.0), (3, 1, at(60), 3.0), (4, 1, at(121), 4.0), (5, 2, at(60), 9.0)])
    hits = behaviour.velocity(rows, "who", "ts", "amount", "60 MINUTES", 2).collect()
    assert [(h["who"], h["ts"], h["n"], h["amount"]) for h in hits] == [(1, at(60), 3, 6.0)]


def test_structuring_band_is_half_open(frame):
    rows = frame([(1, 1, at(0), 9000.0), (2, 1, at(1), 9999.99), (3, 1, at(2), 10000.0), (4, 1, at(3), 8999.99)])
    hits = behaviour.structuring(rows, "who", "ts", "amount", 9000, 10000, "1 DAY", 2).collect()
    assert [(h["ts"], h["n"]) for h in hits] == [(at(1), 2)]


def test_sequence_counts_each_end_once(frame):
    kinds = "id bigint, who bigint, ts timestamp_ntz, kind string"
    rows = frame(
        [(1, 1, at(0), "a"), (2, 1, at(1), "a"), (3, 1, at(5), "b"), (4, 1, at(31), "b"), (5, 1, at(32), "b"), (6, 2, at(1), "b")],
        kinds,
    )
    hits = behaviour.sequence(rows, "who", "ts", "id", F.col("kind") == "a", F.col("kind") == "b", "30 MINUTES")
    assert ids(hits) == [3, 4]


def test_sessions_split_after_the_gap(frame):
    rows = frame([(1, 1, at(0), 1.0), (2, 1, at(30), 2.0), (3, 1, at(61), 4.0), (4, 2, at(0), 8.0)])
    found = behaviour.sessions(rows, "who", "ts", "id", "amount", "30 MINUTES").orderBy("who", "session_start")
    assert [(r["who"], r["n"], r["amount"], r["session_end"]) for r in found.collect()] == [
        (1, 2, 3.0, at(60)),
        (1, 1, 4.0, at(91)),
        (2, 1, 8.0, at(30)),
    ]


def test_asof_takes_the_latest_earlier_row(frame):
    earlier = frame([(1, 1, at(0), 1.0), (2, 1, at(10), 2.0), (3, 2, at(0), 3.0)])
    later = frame([(4, 1, at(10), 0.0), (5, 1, at(11), 0.0), (6, 3, at(1), 0.0)])
    found = behaviour.asof_last(earlier, later, "who", "ts", "id", "amount").orderBy("id").collect()
    assert [(r["id"], r["last_value"]) for r in found] == [(4, 1.0), (5, 2.0), (6, None)]


def test_drift_gives_empty_bins_a_small_share(frame):
    rows = frame([(1, 1, at(0), 5.0), (2, 1, at(0), 15.0), (3, 1, at(100), 5.0)])
    found = behaviour.drift_psi(rows, "amount", "ts", [10.0], str(at(50))).orderBy("bin").collect()
    assert [(r["n_before"], r["n_after"]) for r in found] == [(1, 1), (1, 0)]
    assert found[1]["psi"] > 0


def test_benford_counts_missing_digits(frame):
    rows = frame([(i, 1, at(i), 100.0) for i in range(10)])
    found = amounts.benford_by_entity(rows, "who", "amount", 1).first()
    n, want = 10, 0.0
    for d, p in enumerate(amounts.BENFORD, 1):
        seen = 10 if d == 1 else 0
        want += (seen - n * p) ** 2 / (n * p)
    assert found["chi2"] == pytest.approx(want)


def test_peer_rank_ties_share_a_rank(frame):
    rows = frame([(i, i, at(0), a) for i, a in enumerate([1.0, 2.0, 3.0, 3.0])])
    top = amounts.peer_rank(rows, "who", "amount", rows.select("who", F.lit("x").alias("peer")), "peer", 0.6)
    assert sorted((r["who"], round(r["percent_rank"], 4)) for r in top.collect()) == [(2, 0.6667), (3, 0.6667)]


def test_near_duplicates_on_the_edge(frame):
    day = 24 * 60
    rows = frame(
        [(1, 1, at(0), 10.0), (2, 1, at(3 * day), 11.0), (3, 1, at(7 * day), 11.0), (4, 1, at(0), 12.01), (5, 2, at(0), 10.0)]
    )
    assert ids(integrity.near_duplicates(rows, "who", "id", "ts", "amount", 100, 3)) == [1, 2]


def test_quarantine_treats_null_as_kept(frame):
    rows = frame([(1, 1, at(0), None), (2, 1, at(0), -1.0), (3, None, at(0), -5.0)])
    good, bad = integrity.quarantine(rows, {"negative": F.col("amount") < 0, "nobody": F.col("who").isNull()})
    assert ids(good) == [1]
    assert {r["id"]: r["reasons"] for r in bad.collect()} == {2: ["negative"], 3: ["negative", "nobody"]}


def test_run_diff_counts_copies(frame):
    rows = lambda *xs: frame([(x,) for x in xs], "x int")
    found = integrity.run_diff(rows(1, 1, 2, 3), rows(1, 2, 2, 4)).collect()
    assert sorted((r["x"], r["change"], r["copies"]) for r in found) == [
        (1, "removed", 1),
        (2, "added", 1),
        (3, "removed", 1),
        (4, "added", 1),
    ]


def test_reconcile_tolerance(frame):
    orders = frame([(1, 108.0), (2, 50.0)], "o_orderkey bigint, o_totalprice double")
    lines = frame(
        [(1, 100.0, 0.0, 0.08), (2, 50.0, 0.1, 0.0)],
        "l_orderkey bigint, l_extendedprice double, l_discount double, l_tax double",
    )
    found = integrity.reconcile(orders, lines, 0.01).collect()
    assert [(r["o_orderkey"], r["lines_total"], r["difference"]) for r in found] == [(2, 45.0, -5.0)]


def test_text_functions(spark):
    row = (
        spark.range(1)
        .select(
            normalise(F.lit(" ACME, Ltd. ")).alias("n"),
            masked(F.lit("4111111111111111"), 4).alias("m"),
            masked(F.lit("abc"), 4).alias("short"),
            luhn_valid(F.lit("4111 1111 1111 1111")).alias("good"),
            luhn_valid(F.lit("4111111111111112")).alias("bad"),
            F.sort_array(within_deletions(F.lit("abc"), 1)).alias("d1"),
            F.size(within_deletions(F.lit("abc"), 2)).alias("d2"),
            within_deletions(F.lit(""), 2).alias("empty"),
        )
        .first()
    )
    assert row["n"] == "acme ltd"
    assert (row["m"], row["short"]) == ("XXXXXXXXXXXX1111", "abc")
    assert (row["good"], row["bad"]) == (True, False)
    assert row["d1"] == ["ab", "abc", "ac", "bc"]
    assert (row["d2"], row["empty"]) == (7, [""])


def test_props_that_are_not_numbers_are_null(frame):
    rows = frame([(1, '{"k": 7}'), (2, '{"k": "x"}'), (3, "{}"), (4, None)], "id bigint, props string")
    assert [r["k"] for r in parse_props(rows).orderBy("id").collect()] == [7, None, None, None]


def test_pseudonyms_join_but_depend_on_the_salt(frame):
    rows = frame([(1, "ann"), (2, "ann"), (3, "bob")], "id bigint, name string")
    a = [r["name"] for r in protection.pseudonymise(rows, ["name"], "s1").orderBy("id").collect()]
    b = [r["name"] for r in protection.pseudonymise(rows, ["name"], "s2").orderBy("id").collect()]
    assert a[0] == a[1] != a[2] and a[0] != b[0]
    unknown = frame([(1, None), (2, "")], "id bigint, name string")
    tokens = [r["name"] for r in protection.pseudonymise(unknown, ["name"], "s1").orderBy("id").collect()]
    assert tokens[0] is None and tokens[1] is not None


def test_screening_knows_other_scripts(frame):
    rows = frame([(1, "Иван Петров"), (2, "王芳"), (3, "-- !"), (4, "Пётр Иванов")], "id bigint, name string")
    listed = frame([("ИВАН  ПЕТРОВ",), ("?",)], "entry string")
    exact = protection.screen_exact(rows, "name", listed, "entry")
    fuzzy = protection.screen_fuzzy(rows, "name", listed, "entry", 1)
    assert [r["id"] for r in exact.collect()] == [1] and [r["id"] for r in fuzzy.collect()] == [1]


def test_fuzzy_screening_misses_nothing(frame):
    import itertools
    import random

    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(120)})
    rows, listed = frame(list(enumerate(names)), "id bigint, name string"), frame(
        [(n,) for n in names[::4]], "entry string"
    )

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for limit in (1, 2):
        got = protection.screen_fuzzy(rows, "name", listed, "entry", limit)
        want = sorted(
            (a, b, distance(a, b))
            for a, b in itertools.product(names, names[::4])
            # A name with nothing left of it matches none.
            if a and b and distance(a, b) <= limit
        )
        assert sorted((r["name"], r["entry"], r["distance"]) for r in got.collect()) == want


def test_exact_screening_normalises(frame):
    rows = frame([(1, "Acme Ltd."), (2, "Other")], "id bigint, name string")
    assert ids(protection.screen_exact(rows, "name", frame([("ACME  LTD",)], "entry string"), "entry")) == [1]


def test_risk_score_by_hand(frame):
    alerts = frame(
        [("a", 1), ("a", 1), ("b", 1), ("b", 2), ("unknown", 3)], "detector string, entity_id bigint"
    )
    scores = reporting.risk_score(alerts, {"a": 2.0, "b": 0.5})
    assert sorted(map(tuple, scores.collect())) == [(1, 3, 4.5), (2, 1, 0.5), (3, 1, 0.0)]
    assert [r["entity_id"] for r in reporting.top_risk(scores, 2).collect()] == [1, 2]


def test_evaluate_by_hand(frame):
    truth = frame([(1,), (2,), (3,)], "txn_id bigint")
    alerts = frame([(2,), (2,), (3,), (9,)], "txn_id bigint")
    got = reporting.evaluate(alerts, truth, "txn_id").first()
    assert (got["tp"], got["fp"], got["fn"]) == (2, 1, 1)
    assert got["precision"] == got["recall"] == got["f1"] == pytest.approx(2 / 3)
    none = reporting.evaluate(alerts.where("txn_id > 99"), truth, "txn_id").first()
    assert (none["precision"], none["recall"]) == (None, 0.0)


def test_cube_tells_totals_from_nulls(frame):
    rows = frame([("x", None), ("x", "p"), (None, "p")], "a string, b string")
    got = {(r["a"], r["b"], r["level"]): r["n"] for r in reporting.alert_cube(rows, ["a", "b"]).collect()}
    assert got[("x", None, 0)] == 1 and got[("x", None, 1)] == 2 and got[(None, None, 3)] == 3


def test_shared_counterparties(frame):
    edges = frame([(1, 10), (1, 11), (2, 10), (2, 11), (2, 12), (3, 12), (4, 11)], "payer bigint, payee bigint")
    got = counterparties.shared_counterparties(edges, frame([(1,)], "payer bigint"), 1)
    assert sorted(map(tuple, got.collect())) == [(2, 3, 2), (4, 1, 1)]


def test_alert_layout(frame):
    rows = frame([(1, 7, at(0), 5.0)])
    got = to_alerts(rows, "d", "who", F.col("amount"), F.lit("x"), "id").first()
    assert tuple(got) == ("d", 7, 1, 5.0, "x")


def test_writing_a_run_again_replaces_only_its_own_rows(spark, frame, tmp_path):
    from tallywarden.sources.alerts import read_alerts, write_alerts

    rows = frame([(1, 7, at(0), 5.0), (2, 8, at(0), 6.0)])
    alerts = {d: to_alerts(rows, d, "who", F.col("amount"), F.lit("x"), "id") for d in ("a", "b")}
    path = f"{tmp_path}/alerts"
    write_alerts(alerts["a"].unionByName(alerts["b"]), path, "2024-01-01", ["a", "b"])
    write_alerts(alerts["a"].where("entity_id = 7"), path, "2024-01-01", ["a"])
    write_alerts(alerts["a"], path, "2024-01-02", ["a"])
    counts = read_alerts(spark, path).groupBy("detector", F.col("run_date").cast("string")).count().collect()
    assert sorted(map(tuple, counts)) == [("a", "2024-01-01", 1), ("a", "2024-01-02", 2), ("b", "2024-01-01", 2)]
    # A run that finds nothing leaves nothing of the earlier one, and other detectors as they were.
    write_alerts(alerts["a"].where("false"), path, "2024-01-01", ["a"])
    counts = read_alerts(spark, path).groupBy("detector", F.col("run_date").cast("string")).count().collect()
    assert sorted(map(tuple, counts)) == [("a", "2024-01-02", 2), ("b", "2024-01-01", 2)]
    with pytest.raises(Exception, match="not listed"):
        write_alerts(alerts["b"], path, "2024-01-01", ["a"])


def test_near_duplicates_refuse_an_empty_grid(frame):
    with pytest.raises(ValueError):
        integrity.near_duplicates(frame([]), "who", "id", "ts", "amount", 0, 3)


def test_rows_without_a_time_are_not_counted(frame):
    rows = frame([(1, 1, None, 1.0), (2, 1, None, 1.0), (3, 1, at(0), 1.0), (4, 1, at(1), 1.0)])
    hits = behaviour.velocity(rows, "who", "ts", "amount", "1 HOUR", 2).collect()
    assert [(h["ts"], h["n"]) for h in hits] == [(at(1), 2)]


def test_linked_groups_on_chains_stars_and_loops(frame):
    import random

    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(100, 160)]  # a chain
    pairs += [(500, i) for i in range(501, 700)]  # a hub
    pairs += [(900, 900)]  # linked to itself only
    pairs += [(rng.randint(1000, 1200), rng.randint(1000, 1200)) for _ in range(120)]
    rng.shuffle(pairs)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    got = counterparties.linked_groups(frame(pairs, "a bigint, b bigint"), "a", "b").collect()
    assert {r["node"]: r["group"] for r in got} == {x: find(x) for x in list(root)}
    assert len(got) == len(root)


def test_linked_groups_report_a_limit_that_is_too_low(frame):
    pairs = frame([(1, 2)], "a bigint, b bigint")
    with pytest.raises(RuntimeError):
        counterparties.linked_groups(pairs, "a", "b", max_rounds=0)


def test_multivariate_flags_the_far_row(frame):
    rows = [(i, i % 2, at(i), (10.0 if i % 2 else 100.0) + i % 3) for i in range(400)] + [(999, 0, at(0), 160.0)]
    assert ids(amounts.multivariate(frame(rows), ["amount"], 2, 5.0)) == [999]


def test_scores_of_large_amounts_with_a_small_spread(frame):
    amounts_ = [50_000_000.00, 50_000_000.01, 50_000_000.02] * 4 + [50_000_005.00]
    rows = frame([(i, 1, at(i), a) for i, a in enumerate(amounts_)])
    (hit,) = amounts.prior_zscore(rows, "who", ["ts", "id"], "amount", 5, 100.0).collect()
    cents = [round(a * 100) for a in amounts_[:-1]]
    assert hit["zscore"] == pytest.approx((5_000_000_500 - statistics.mean(cents)) / statistics.stdev(cents), rel=1e-9)
    everything = [*cents, 5_000_000_500]
    (hit,) = amounts.zscore_global(rows, "amount", 3.0).collect()
    assert hit["zscore"] == pytest.approx(
        (5_000_000_500 - statistics.mean(everything)) / statistics.stdev(everything), rel=1e-9
    )


def test_unknown_amounts_give_an_unknown_total_whatever_the_plan(frame):
    # One entity is large; the other has a known amount long before a span with none.
    rows = frame([(i, 1, at(i), 1.0) for i in range(40)] + [(100, 2, at(0), 3.0), (101, 2, at(600), None), (102, 2, at(601), None)])
    for limit in (5, 10**6):
        totals = behaviour.trailing_totals(rows, ["who"], "ts", "60 MINUTES", F.col("amount"), limit).where("who = 2")
        assert sorted((r["n"], r["amount"]) for r in totals.collect() if r["amount"] is None) == [(1, None), (2, None)]


def test_before_means_strictly_earlier(frame):
    rows = frame([(1, 1, at(0), 1.0), (2, 1, at(5), 2.0), (3, 1, at(5), 3.0), (4, 2, at(5), 4.0), (5, 2, at(5), 5.0)])
    marks, wanted = rows.where("id <> 3"), rows.where("id = 3 OR id = 5")
    found = behaviour.asof_last(marks, wanted, "who", "ts", "id", "amount").collect()
    assert sorted((r["id"], r["last_value"]) for r in found) == [(3, 1.0), (5, None)]
    first, then = F.col("id") != 3, F.col("id").isin(2, 3, 5)
    hits = behaviour.sequence(rows, "who", "ts", "id", first, then, "1 HOUR").collect()
    assert sorted(r["id"] for r in hits) == [2, 3]


def test_near_duplicates_of_an_unknown_entity_are_found(frame):
    rows = frame([(1, None, at(0), 5.0), (2, None, at(1), 5.0), (3, 4, at(0), 5.0)])
    hits = integrity.near_duplicates(rows, "who", "id", "ts", "amount", 1, 3).collect()
    assert sorted(r["id"] for r in hits) == [1, 2]


@pytest.mark.parametrize("master", ["local-cluster[2,1,1024]", "spark://host:7077", "yarn"])
def test_no_temporary_folder_on_a_cluster(master):
    class Unset:
        def get(self, key, default=None):
            return default

    class Context:
        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Unset(), Context()

    Session.sparkContext.master = master
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(Session())
