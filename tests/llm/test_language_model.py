"""The tries against plain Python, on ordinary and frequent words, nulls, empty and long texts."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywarden.llm import language_model as lm
from tallywarden.llm.ngram_trie import DISCOUNT, STEPS, EliasFano

SCHEMA = "doc_id bigint, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


class Model:
    def __init__(self, rows):
        self.one, self.two, self.three = Counter(), defaultdict(Counter), defaultdict(Counter)
        for doc_id, text in rows:
            if held(doc_id):
                continue
            said = [lm.START, *words(text), lm.END]
            self.one.update(said[1:])
            for i in range(1, len(said)):
                self.two[said[i - 1]][said[i]] += 1
                if i > 1:
                    self.three[said[i - 2], said[i - 1]][said[i]] += 1
        self.n, self.v = sum(self.one.values()), len(self.one)

    def steps(self, u, v, w):
        cost = lambda p: math.ceil(-math.log10(p) * STEPS)
        spent = 0
        for seen in ([self.three.get((u, v))] if u else []) + [self.two.get(v)]:
            if seen and w in seen:
                return spent + cost((seen[w] - DISCOUNT) / sum(seen.values()))
            if seen:
                spent += cost(DISCOUNT * len(seen) / sum(seen.values()))
        return spent + cost((self.one[w] + 1) / (self.n + self.v + 1))

    def row(self, doc_id, text):
        said = [None, lm.START, *words(text), lm.END]
        steps = sum(self.steps(*said[i - 2 : i + 1]) for i in range(2, len(said)))
        base = sum(math.log10((self.one[w] + 1) / (self.n + self.v + 1)) for w in said[2:])
        known = sum(self.one[w] > 0 for w in said[2:])
        return doc_id, held(doc_id), len(said) - 2, known, self.n, round(base, 6), -steps / STEPS


def check(spark, rows, **sizes):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r) for r in lm.scores(docs, lm.seventh_held_out(), **sizes).collect()]
    model = Model(rows)
    order = lambda r: (r[0] is not None, r[0] or 0, r[2:])
    rounded = sorted(((*r[:5], round(r[5], 6), r[6]) for r in got), key=order)
    assert rounded == sorted((model.row(*r) for r in rows), key=order)
    return model


def prose(seed, n, most=60):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(40)]
    return [(i, " ".join("The" if rng.random() < 0.3 else rng.choice(pool) if rng.random() < 0.95 else f"odd{rng.random()}" for _ in range(rng.randint(0, most)))) for i in range(n)]


@pytest.mark.parametrize(("shard_bytes", "piece_bytes"), [(1 << 20, 1 << 20), (300, 500)])
def test_equals_brute_force(spark, shard_bytes, piece_bytes):
    model = check(spark, prose(1, 150), shard_bytes=shard_bytes, piece_bytes=piece_bytes)
    assert any(held(i) for i in range(150))
    every = [*model.one, "never seen"]
    for u, v in [(None, lm.START), (lm.START, "the"), ("the", "the"), ("w1", "w2"), ("never", "the"), ("never", "seen")]:
        assert sum(10 ** (-model.steps(u, v, w) / STEPS) for w in every) <= 1 + 1e-9


def test_odd_texts_and_ids(spark):
    rows = [(None, "A b"), (None, None), (3, ""), (3, ""), (4, " \t\n"), (5, "É é A a b \x0b c\x1cd"), (6, "x " * 50_000), (7, "y" * 200_000), (7, "A b")]
    check(spark, rows + [(i, "a b\r\nc d") for i in range(100, 130)])


def test_nothing_to_learn_from(spark):
    taboo = next(i for i in range(100) if held(i))
    check(spark, [(taboo, "all of it is held out")])
    assert lm.scores(spark.createDataFrame([], SCHEMA), lm.seventh_held_out()).count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame(prose(2, 40), SCHEMA)
    more = docs.withColumns({c: F.lit(1) for c in ("v", "w", "n", "steps", "batch", "doc", "shard", "kind", "body", "held_out")})
    run = lambda d: sorted(map(tuple, lm.scores(d, lm.seventh_held_out()).collect()))
    assert run(more) == run(docs)


@pytest.mark.parametrize(("n", "universe"), [(0, 4), (1, 1), (7, 7), (900, 1000), (900, 1 << 55), (3, 1 << 60)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe, n))
    found = EliasFano(values, universe)
    if n:
        assert (found.get(np.arange(n)) == values).all()
        asked, start = rng.integers(0, universe, 500), rng.integers(0, n, 500)
        end = np.minimum(n, start + rng.integers(0, n + 1, 500))
        assert (found.successor(asked, start, end) == np.clip(np.searchsorted(values, asked), start, end)).all()


def test_better_than_single_words_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = lm.scores(docs, lm.seventh_held_out()).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (sums[0] - sums[1]) / sums[2] > 0.5  # log10 per token
