"""Ties, clashing columns and large values of operators that are tested elsewhere for the rest."""

import pytest
from pyspark.sql import functions as F

from tallywarden.llm import chat, mixing, nearest


def test_tied_turns_go_by_role_and_text(spark):
    rows = [(1, 0, "user", c) for c in "hgfedcba"] + [(1, 0, "assistant", "z"), (1, None, "user", "first")]
    log = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for limit in (1_000_000, 3):
        (row,) = chat.format_conversations(log, 64, limit).collect()
        said = [part.split("\n")[1] for part in row["text"].split("<|im_end|>\n") if part]
        assert said == ["first", "z", *"abcdefgh"]


def test_mixing_keeps_columns_of_its_own_names(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "a" if i % 2 else "b") for i in range(60)], "doc_id long, text string, source string")
    plain = mixing.mix_sources(docs, {"a": 0.7}, 3.0).select("doc_id", "copy", "shuffle_key")
    names = ["_table", "_draws", "_times", "_named_of", "_named", "_mean", "_rate", "__times", "n_bytes"]
    more = mixing.mix_sources(docs.withColumns({c: F.lit(c) for c in names}), {"a": 0.7}, 3.0)
    assert sorted(more.select(*plain.columns).collect()) == sorted(plain.collect())
    assert {tuple(r) for r in more.select(*names).distinct().collect()} == {tuple(names)}


def test_large_components_are_exact(spark):
    vectors = {0: [1e9, 1.0], 1: [1e9, 2.0], 2: [-1e9, 0.5], 3: [3.0, 4.0], 4: [1e-3, 5e8], 20: [2.0, 7.0]}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    whole = {i: [int(64 * x // 1) for x in v] for i, v in vectors.items()}
    got = nearest.top_scores(df, F.col("vec_id") == 20, 20).collect()
    score = {i: sum(a * b for a, b in zip(whole[20], v, strict=True)) for i, v in whole.items() if i != 20}
    want = sorted(score.items(), key=lambda s: (-s[1], s[0]))
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == want
    with pytest.raises(Exception, match="does not fit"):
        nearest.top_scores(df, F.col("vec_id") == 0, 20).collect()


def test_filter_of_keys_stands_in_no_plan(spark):
    from tallywarden.llm.common import may_be_in

    few = spark.range(0, 400, 4).union(spark.createDataFrame([(None,)], "id long"))
    rows = spark.range(400).union(spark.createDataFrame([(None,)], "id long"))
    passed = rows.where(may_be_in(few, "id"))
    got = [r["id"] for r in passed.collect()]
    assert None in got and set(range(0, 400, 4)) <= set(got) and len(got) < 120
    assert [r["id"] for r in rows.where(may_be_in(few.limit(0), "id")).collect()] == []
    # As a constant the filter takes a hundred kilobytes when empty, and more than a megabyte when full.
    assert len(passed._jdf.queryExecution().toString()) < 20_000
