"""The manifest against plain Python, over trees of many sizes, nulls, ties and an empty table."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tallywarden.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    parts = (doc_id, source, lang, n_chars, text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in parts))


def climb(nodes):
    """The root, and for each node its (left, right) siblings level by level."""
    place, sides, level = list(range(len(nodes))), [[] for _ in nodes], nodes
    while len(level) > 1:
        for k, at in enumerate(place):
            run = level[at // 8 * 8 : at // 8 * 8 + 8]
            sides[k].append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        place = [at // 8 for at in place]
    return level[0], sides


def expected(rows):
    parts = {}
    for row in rows:
        parts.setdefault(row[2], []).append(row)
    langs = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    built = []
    for lang in langs:
        ordered = sorted(parts[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        built.append((ordered, *climb([leaf(r, r[1]) for r in ordered])))
    root, upper = climb([b[1] for b in built])
    for (ordered, subroot, sides), over in zip(built, upper, strict=True):
        for row, own in zip(ordered, sides, strict=True):
            doc_id, text = row[:2]
            hit = doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
            found = leaf(row, text.translate(LOWER) if hit else text)
            for left, right in own + over:
                found = sha(left + found + right)
            proof = sha("".join(left + right for left, right in own + over))
            yield doc_id, leaf(row, text), subroot, root, proof, found, found == root


def check(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in merkle.manifest(docs, merkle.tampered(docs)).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(expected(rows), key=key)
    return got


def test_sizes_around_powers_of_the_arity(spark):
    sizes = {"a": 1, "bb": 2, "é": 8, "z": 9, None: 7, "": 64, "c": 65, "d": 73, "e": 3, "f": 10}
    rows = [(1000 * i + k, f"Text {k} of {lang}", lang, f"s{k % 3}", k) for i, (lang, n) in enumerate(sizes.items()) for k in range(n)]
    found = check(spark, rows)
    tampered = [r for r in found if zlib.crc32(str(r[0]).encode()) % 3 == 0]
    # Every text has a capital, so tampering shows everywhere and nowhere else.
    assert {r[-1] for r in tampered} == {False} and all(r[-1] for r in found if r not in tampered)


@pytest.mark.parametrize("rows", [[(5, "One", "en", "s", 3)], [(None, None, None, None, None)], [(1, "", "en", None, 0), (2, "x" * 300_000, "en", "s", None)]])
def test_few_rows(spark, rows):
    check(spark, rows)


def test_null_repeated_and_unordered_ids(spark):
    rows = [(None, "A", "en", "s", 1), (None, "B", "en", "s", 1), (-3, "C", "en", "s", 1), (7, "D", "en", "s", 1), (7, "D", "en", "s", 1)]
    check(spark, rows + [(7, "E", "en", "s", 1), (10**15, "F", None, "s", 1)] + [(3, "same", "fr", "s", 4)] * 20)


def test_empty_table_and_columns_of_the_operators_own_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(empty).count() == 0
    rows = [(i, f"T{i}", "en", "s", i) for i in range(9)]
    plain = spark.createDataFrame(rows, SCHEMA)
    more = plain.withColumns({c: F.lit(1) for c in ("tree", "node", "pos", "path", "run", "_at", "_task", "_checked", "left", "root")})
    assert sorted(merkle.manifest(more).collect()) == sorted(merkle.manifest(plain).collect())


def test_numbers_do_not_depend_on_partitions(spark):
    rows = spark.range(1000).select(F.lit("").alias("tree"), (F.col("id") * 7 % 1000).alias("k"))
    for n in (1, 13):
        got = merkle.numbered(rows.repartition(n), ["k"])
        assert got.where("pos <> k").count() == 0 and got.count() == 1000
