"""Streams over several files, with late rows, repeats and repeated batches."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallywarden.catalogue.streams import stream_profile
from tallywarden.operators import amounts, behaviour
from tallywarden.sources.tables import stream_events
from tallywarden.streaming import sinks, state, windows
from tallywarden.streaming.profile import profile_scorer

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event(i, minute, user=1, kind="view", value=1.0):
    return (i, T0 + timedelta(minutes=minute), user, kind, value, "{}")


@pytest.fixture
def feed(spark, tmp_path):
    """Store batches as separate files that a stream reads one at a time."""

    def build(*batches):
        for rows in batches:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
        return str(tmp_path)

    return build


def test_late_rows_are_dropped_and_reported(spark, feed):
    folder = feed(
        [event(1, 0), event(2, 5), event(3, 200)],
        [event(4, 300)],
        [event(5, 1), event(6, 400)],  # the first row is far behind the watermark
    )
    counted = windows.tumbling(stream_events(spark, folder, "10 minutes", 1), "user_id", "value", "60 minutes")
    table, query = sinks.run_to_table(counted, "test-late")
    assert {r["window_start"]: r["n"] for r in table.collect()}[T0] == 2
    report = sinks.late_report(spark, query)
    total = report.agg(F.sum("input_rows"), F.sum("late_rows")).first()
    assert tuple(total) == (6, 1)


def test_repeats_across_files_are_dropped(spark, feed):
    folder = feed([event(1, 0), event(2, 1)], [event(2, 1), event(3, 2)])
    kept, _ = sinks.run_to_table(windows.deduplicate(stream_events(spark, folder, "10 minutes", 1), ["event_id"]), "test-dedup")
    assert sorted(r["event_id"] for r in kept.collect()) == [1, 2, 3]


def test_sequence_across_files_counts_each_end_once(spark, feed):
    folder = feed(
        [event(1, 0, kind="error"), event(2, 20, kind="error")],
        [event(3, 29, kind="purchase"), event(4, 49, kind="purchase"), event(5, 55, kind="purchase")],
    )
    kind = F.col("event_type")
    hits = windows.sequence(stream_events(spark, folder, "10 minutes", 1), "user_id", kind == "error", kind == "purchase", 1800)
    found, _ = sinks.run_to_table(hits, "test-sequence")
    assert sorted(r["event_id"] for r in found.collect()) == [3, 4]


def test_unknown_entities_stay_in_the_enriched_stream(spark, feed):
    folder = feed([event(1, 0, user=1), event(2, 1, user=2)])
    names = spark.createDataFrame([(1, "a")], "key bigint, name string")
    found, _ = sinks.run_to_table(windows.enrich(stream_events(spark, folder), "user_id", names, "key"), "test-enrich")
    assert {r["event_id"]: r["name"] for r in found.collect()} == {1: "a", 2: None}


@pytest.mark.parametrize("limit", [5, 10**6])
def test_profile_over_batches_equals_one_batch(spark, feed, tmp_path, limit):
    rows = [event(i, i, user=1 if i % 3 else 2, value=float(10 + (i * 7) % 13 + (300 if i % 29 == 0 else 0))) for i in range(120)]
    folder = feed(rows[:30], rows[30:45], rows[45:90], rows[90:])
    out = f"{tmp_path}/profile"
    scorer = profile_scorer(out, "user_id", ["ts", "event_id"], "value", 3, 3.0, compact_every=2, limit=limit)
    sinks.run_batches(stream_events(spark, folder, "10 minutes", 1), scorer, f"{out}/checkpoint")
    got = spark.read.parquet(f"{out}/alerts")
    assert got.select("batch_id").distinct().count() > 1
    batch = spark.createDataFrame(rows, SCHEMA)
    want = amounts.prior_zscore(batch, "user_id", ["ts", "event_id"], "value", 3, 3.0)
    key = lambda df: sorted((r["event_id"], r["n_prior"], round(r["zscore"], 9)) for r in df.collect())
    assert key(got) == key(want) != []

    # A batch that is run again leaves the same result.
    scorer(spark.createDataFrame(rows[90:], SCHEMA), 3)
    assert key(spark.read.parquet(f"{out}/alerts")) == key(want)


def test_alert_sink_is_idempotent(spark, tmp_path):
    sink = sinks.alert_sink(f"{tmp_path}/alerts")
    alerts = spark.createDataFrame([(1,), (2,)], "txn_id bigint")
    sink(alerts, 0)
    sink(alerts, 0)
    sink(alerts, 1)
    assert spark.read.parquet(f"{tmp_path}/alerts").count() == 4


def spread_rows():
    return [event(i, i, user=1 if i % 3 else 2 + i % 2, value=float(10 + (i * 7) % 13 + (300 if i % 29 == 0 else 0))) for i in range(120)]


def alerts_key(df):
    return sorted((r["event_id"], r["n_prior"], round(r["zscore"], 9)) for r in df.collect())


@pytest.mark.parametrize("limit", [5, 10**6])
def test_state_over_files_and_a_restart_equals_batch(spark, feed, tmp_path, limit):
    rows = spread_rows()
    out = f"{tmp_path}/state"
    for part in (rows[:30], rows[30:45]), (rows[45:90], rows[90:]):
        folder = feed(*part)  # the second time the query starts again from its checkpoint
        stream = state.with_past(stream_events(spark, folder, "10 minutes", 1), "user_id", "value")
        sinks.run_batches(stream, state.state_scorer(out, "user_id", ["ts", "event_id"], "value", 3, 3.0, limit), f"{out}/checkpoint")
    got = spark.read.parquet(f"{out}/alerts")
    assert got.select("batch_id").distinct().count() > 1
    want = amounts.prior_zscore(spark.createDataFrame(rows, SCHEMA), "user_id", ["ts", "event_id"], "value", 3, 3.0)
    assert alerts_key(got) == alerts_key(want) != []


def test_a_batch_reads_the_state_of_its_own_entities_only(spark, feed, tmp_path):
    folder = feed([event(i, i, user=i) for i in range(200)], [event(300, 300, user=7)])
    out = f"{tmp_path}/state"
    seen = {}

    def keep(batch, batch_id):
        batch = batch.persist()
        seen[batch_id] = [(r["user_id"], int(r["_prior_n"])) for r in batch.where("_prior").collect()]
        batch.unpersist()

    query = sinks.run_batches(state.with_past(stream_events(spark, folder, "10 minutes", 1), "user_id", "value"), keep, f"{out}/checkpoint")
    assert len(seen[0]) == 200 and seen[1] == [(7, 1)]
    last = [p for p in query.recentProgress if p["batchId"] == 1][0]["stateOperators"][0]
    assert last["numRowsTotal"] >= 200 and last["numRowsUpdated"] == 1
    # One entity's state is looked up a few times, whatever the number of entities in the store.
    assert last["customMetrics"]["rocksdbGetCount"] <= 4


def test_a_quiet_entity_is_forgotten(spark, feed, tmp_path):
    folder = feed([event(1, 0), event(2, 5)], [event(3, 500, user=2)], [event(4, 600)], [event(5, 610)])
    out = f"{tmp_path}/state"
    seen = {}

    def keep(batch, batch_id):
        seen[batch_id] = [(r["user_id"], int(r["_prior_n"])) for r in batch.where("_prior").collect()]

    stream = state.with_past(stream_events(spark, folder, "10 minutes", 1), "user_id", "value", quiet_ms=60 * 60_000)
    sinks.run_batches(stream, keep, f"{out}/checkpoint")
    assert [r for b in sorted(seen) for r in seen[b]] == [(1, 0), (2, 0), (1, 0), (1, 1)]


def test_unknown_rows_and_exact_sums(spark, feed, tmp_path):
    large = 90_000_000_000.01
    rows = [event(i, i, user=5, value=large + i) for i in range(6)] + [event(50, 50, user=5, value=3 * large)]
    folder = feed([(*r[:2], None, *r[3:]) for r in rows[:1]] + rows[:3], rows[3:] + [event(60, 60, user=5, value=None)])
    out = f"{tmp_path}/state"
    stream = state.with_past(stream_events(spark, folder, "10 minutes", 1), "user_id", "value")
    sinks.run_batches(stream, state.state_scorer(out, "user_id", ["ts", "event_id"], "value", 3, 3.0), f"{out}/checkpoint")
    want = amounts.prior_zscore(spark.createDataFrame(rows, SCHEMA), "user_id", ["ts", "event_id"], "value", 3, 3.0)
    assert alerts_key(spark.read.parquet(f"{out}/alerts")) == alerts_key(want) != []


def test_profile_in_a_session_with_the_default_state_store(spark, feed):
    values = [10.0, 11.0, 9.0, 10.0, 11.0, 9.0, 500.0, 10.0]
    folder = feed([event(i, i, value=v) for i, v in enumerate(values)])
    before = spark.conf.get(sinks.STORE)
    default = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(sinks.STORE, default)
    try:
        found = stream_profile(spark, folder).collect()
        assert spark.conf.get(sinks.STORE) == default
    finally:
        spark.conf.set(sinks.STORE, before)
    assert [(r["event_id"], r["n_prior"]) for r in found] == [(6, 6)]


def test_late_rows_are_counted_one_by_one(spark, feed, tmp_path):
    folder = feed(
        [event(1, 0), event(2, 300)],
        # Watermark 290: three rows of one closed window, one of an open one, one behind it in an open window.
        [event(3, 1), event(4, 2), event(5, 3), event(6, 295), event(7, 280), event(8, 500)],
        [event(9, 200)],
    )
    counter = sinks.late_counter(f"{tmp_path}/late", "10 minutes", "60 minutes")
    sinks.run_batches(stream_events(spark, folder, "10 minutes", 1), counter, f"{tmp_path}/checkpoint")
    got = {r["batch_id"]: tuple(r)[1:4] for r in sinks.late_rows(spark, f"{tmp_path}/late").collect()}
    assert got == {0: (2, 0, 0), 1: (6, 4, 3), 2: (1, 1, 1)}


def test_late_rows_of_more_than_a_hundred_batches(spark, tmp_path):
    counter = sinks.late_counter(f"{tmp_path}/late", "1 minute", "1 minute")
    for i in range(103):
        # Every tenth batch repeats an old time; the first batch of all is run twice.
        counter(spark.createDataFrame([event(i, 0 if i % 10 == 9 else 10 * i)], SCHEMA), i)
    counter(spark.createDataFrame([], SCHEMA), 103)
    counter(spark.createDataFrame([event(102, 1020)], SCHEMA), 102)
    rows = sinks.late_rows(spark, f"{tmp_path}/late").orderBy("batch_id").collect()
    assert len(rows) == 104 and [r["batch_id"] for r in rows if r["late_rows"]] == list(range(9, 103, 10))
    assert rows[103]["input_rows"] == 0 and rows[103]["watermark"] == T0 + timedelta(minutes=1019)


@pytest.mark.parametrize("limit", [4, 10**6])
def test_stitched_sessions_equal_batch(spark, feed, limit):
    # One entity goes on for hours over many buckets and two files, another pauses.
    rows = [event(i, 7 * i, user=1, value=float(i)) for i in range(80)] + [event(100 + i, 45 * i, user=2) for i in range(12)]
    rows += [event(200, 600, user=1), event(201, 620, user=1), event(202, 651, user=3), event(203, 680, user=3)]
    folder = feed([r for r in rows if r[1] < T0 + timedelta(hours=4)], [r for r in rows if r[1] >= T0 + timedelta(hours=4)], [event(300, 2000, user=9)])
    parts = windows.partial_sessions(stream_events(spark, folder, "10 minutes", 1), "user_id", "value", "30 minutes", 3600)
    table, query = sinks.run_to_table(parts, "test-parts")
    # No part, and so no state row, reaches beyond its bucket.
    assert table.where("floor(unix_seconds(last_ts) / 3600) <> bucket OR floor(unix_seconds(first_ts) / 3600) <> bucket").count() == 0
    got = windows.stitched(table, "user_id", "30 minutes", 3600, sinks.final_watermark(query), limit)
    want = behaviour.sessions(spark.createDataFrame(rows, SCHEMA), "user_id", "ts", "event_id", "value", "30 minutes")
    key = lambda df, start, end: sorted((r["user_id"], r[start], r[end], r["n"], r["amount"]) for r in df.collect())
    assert key(got, "window_start", "window_end") == key(want, "session_start", "session_end")


def test_sessions_that_may_go_on_are_held_back(spark, feed):
    folder = feed([event(i, 20 * i, user=1) for i in range(10)] + [event(50, 205, user=2)])
    parts = windows.partial_sessions(stream_events(spark, folder), "user_id", "value", "30 minutes", 3600)
    table, query = sinks.run_to_table(parts, "test-open")
    # The watermark of 195 minutes has passed some buckets' parts, but not the session's last one.
    assert table.count() > 0
    assert windows.stitched(table, "user_id", "30 minutes", 3600, sinks.final_watermark(query)).count() == 0
