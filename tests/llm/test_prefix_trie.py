"""The trie of conversations against plain Python, whole and cut into short segments."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallywarden.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def sequences(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = own.get(base, [])[:h] + turns[h:]
    return built


def expected(rows):
    members = {}
    built = sequences(rows)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)

    def below(path):
        leaves, saved = 0, (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
        for child in children.get(path, []):
            a, b = below(child)
            leaves, saved = leaves + a, saved + b
        return (leaves or (0 if path in children else 1)), saved

    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(path))
        yield (
            min(convs),
            len(path),
            min(members[path[:-1]]) if path else None,
            len(convs),
            len(children.get(path, [])),
            *below(path),
            hashlib.sha256(ends.encode()).hexdigest(),
        )


def rows_of(seed, convs, turns, texts):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(rng.randint(1, turns)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(texts)))
    return rows


def same(spark, rows, segment=prefix_trie.SEGMENT, limit=10**6):
    log = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in prefix_trie.rebuilt_trie(log, segment, limit).collect()]
    assert sorted(got, key=str) == sorted(expected(rows), key=str)
    return got


@pytest.fixture
def many_shards(spark):
    """Ranges as small as they come, so that most nodes near the top are shared."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize(("seed", "segment"), [(1, 512), (2, 2), (3, 3)])
def test_equals_brute_force(spark, many_shards, seed, segment):
    same(spark, rows_of(seed, range(-7, 60), 12, ["a", "é", "long text"]), segment)


def test_one_conversation_copied_over_all_shards(spark, many_shards):
    # Ids divisible by 5 are their own base, so these stay equal; others differ in places.
    rows = [(c, t, "user", f"t{t}") for c in range(0, 400, 5) for t in range(4)]
    rows += rows_of(4, range(1000, 1040), 5, ["t0", "t1"])
    same(spark, rows)
    same(spark, rows, segment=2)


def test_a_long_conversation(spark, many_shards):
    rows = [(c, t, "user", str(t // 7)) for c in (5, 10, 15) for t in range(90 + c)] + rows_of(5, range(20, 30), 4, ["0"])
    same(spark, rows, segment=8, limit=50)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(0, None, "user", "z"), (0, None, None, "b"), (0, 1, "user", None), (0, 1, "user", "x"), (0, 1, "assistant", "x")]
    rows += [(1, 0, "user", "w"), (1, 0, "user", "w"), (None, 0, "user", "no conversation"), (2, 5, "", ""), (7, 0, "user", "x" * 100_000)]
    same(spark, rows)


def test_turnless_conversations_and_empty_table(spark):
    # Conversations whose base is missing and whose few turns are all dropped are members of the root alone.
    got = same(spark, [(c, 0, "user", "hello") for c in range(1, 5)])
    assert any(r[1] == 0 and r[7] != prefix_trie.NOBODY for r in got)
    assert prefix_trie.rebuilt_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clashing_columns(spark):
    rows = rows_of(6, range(20), 5, ["a", "b"])
    log = spark.createDataFrame(rows, SCHEMA)
    more = log.withColumns({c: F.lit(1) for c in ("n", "key", "size", "seg", "root", "path", "_tied", "_role", "shard", "length")})
    assert sorted(prefix_trie.rebuilt_trie(more).collect(), key=str) == sorted(prefix_trie.rebuilt_trie(log).collect(), key=str)
