"""The operators of the text subpackage on small and odd inputs, against brute force."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from tallywarden.llm import byte_bpe, chat, jaccard, lines, mixing, nearest, repeats, token_counts, toxicity, winnowing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _key string, spans int, line string, n long"
R = random.Random(5)
VOCABULARY = ["".join(R.choice("abcdeéß") for _ in range(R.randint(2, 7))) for _ in range(300)]


def prose(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


def edited(text, share):
    return " ".join(R.choice(VOCABULARY) if R.random() < share else w for w in text.split(" "))


BASE, PASSAGE = prose(120), prose(80)
TEXTS = [None, "", " ", "a", "\n\n", BASE, BASE, edited(BASE, 0.01), edited(BASE, 0.02), edited(BASE, 0.3), "x" * 3000]
TEXTS += [prose(40) + " " + PASSAGE + " " + prose(R.randint(1, 60)) for _ in range(12)]
TEXTS += [prose(R.randint(1, 30)) + "\nthe same line of words in many texts\n" + prose(10) for _ in range(12)]
TEXTS += ["the idiot moron " + prose(20), "日本語 🤖 \x00 é <s>", "a\nb\n" + prose(3000)]
ROWS = [(i if i else None, t, None, R.choice(["src0", "src1", "z", None]), None, "k", 1, "l", 2) for i, t in enumerate(TEXTS)]
ROWS.append(ROWS[5])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def multiset(df, *columns):
    return sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))


@pytest.mark.parametrize("most", [1000, 2])
def test_repeats_against_brute_force(docs, most):
    got = multiset(repeats.remove_repeats(docs, 400, most), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    raws = [(r[0], (r[1] or "").encode()) for r in ROWS]
    seen = {}
    for _, raw in raws:
        for p in range(len(raw) - 399):
            seen[raw[p : p + 400]] = seen.get(raw[p : p + 400], 0) + 1
    want = []
    for doc_id, raw in raws:
        gone = bytearray(len(raw))
        for p in range(len(raw) - 399):
            if seen[raw[p : p + 400]] > 1:
                gone[p : p + 400] = b"\1" * 400
        left = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        want.append(repr((doc_id, len(raw), len(raw) - len(left), spans, hashlib.sha256(left).hexdigest())))
    assert got == sorted(want)


def test_groups_list_all_occurrences(spark):
    a, b, c = prose(30), prose(100)[:450], prose(30)
    df = spark.createDataFrame([(b"1", "x" + a + b + "q"), (b"2", "y" + b + c), (b"3", "z" + c + b)], "key binary, text string")
    groups = repeats.repeat_groups(df).groupBy("group").agg(F.count("*").alias("n"), F.max("size").alias("size")).collect()
    assert max(r["n"] for r in groups) == 3
    assert max(r["size"] for r in groups) >= 400


@pytest.mark.parametrize("points", [1000, 4])
def test_jaccard_against_brute_force(docs, points):
    got = multiset(jaccard.similar_groups(docs, points=points), "doc_id", "n_shingles", "component_id")
    sets = []
    for r in ROWS:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    ids = [r[0] for r in ROWS]
    name = {g: min((x for x, h in zip(ids, group, strict=True) if h == g and x is not None), default=None) for g in group}
    want = [(x, len(s), name[g] if s else x) for x, s, g in zip(ids, sets, group, strict=True)]
    assert got == sorted(map(repr, want))


def test_points_are_kept_once_while_trees_are_searched(docs, monkeypatch):
    alive, held = {}, []

    def kept(df, purpose, real=jaccard.kept):
        table = real(df, purpose)
        alive[table.kept_at] = (purpose, table.columns)
        if purpose == "large":
            held.extend(p for p, columns in alive.values() if {"point", "first", "least"} & set(columns))
        return table

    def dropped(*tables, real=jaccard.dropped):
        real(*tables)
        for t in tables:
            alive.pop(t.kept_at, None)

    monkeypatch.setattr(jaccard, "kept", kept)
    monkeypatch.setattr(jaccard, "dropped", dropped)
    jaccard.similar_groups(docs).collect()
    assert held == ["groups"]


def test_count_tree_loses_no_point():
    rng = np.random.default_rng(3)
    own = jaccard.Shingler(1)
    base = own.shingles(prose(400))
    sets = [np.unique(np.concatenate([rng.choice(base, k), rng.integers(0, 1 << 60, 20).astype(np.uint64)])) for k in rng.integers(20, 400, 120)]
    points, sizes = np.array([jaccard.point(s) for s in sets]), np.array([len(s) for s in sets])
    asks, at = jaccard.CountTree(points, sizes).search(points, sizes)
    found = set(zip(asks.tolist(), at.tolist(), strict=True))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both):
                assert (i, j) in found


def test_wide_counts_bound_the_overlap():
    rng = np.random.default_rng(5)
    low = False
    for n in (jaccard.WIDE_FROM, 2_047, 2_048, 5_000, 9_000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64) << np.uint64(1))
        for keep in (1.0, 0.9, 0.5, 0.01):
            more = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64))
            b = np.unique(np.concatenate([rng.choice(a, int(keep * len(a)), replace=False), more[: n - int(keep * n)], more[: n // 5]]))
            both = len(np.intersect1d(a, b))
            bound = jaccard.wide_overlap(jaccard.wide_point(a), jaccard.wide_point(b))
            assert both <= bound == jaccard.wide_overlap(jaccard.wide_point(b), jaccard.wide_point(a))
            low |= bound < 0.7 * len(a)
    assert low
    assert jaccard.wide_point(a[:100]) == b""
    # One group that is too full for a byte bounds nothing.
    full = np.arange(2_000, dtype=np.uint64)
    assert jaccard.wide_overlap(jaccard.wide_point(full), jaccard.wide_point(full)) >= 2_000


@pytest.mark.parametrize("points", [1_000, 3])
def test_long_documents_with_shared_passages(spark, points):
    rng = random.Random(12)

    def said(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    passage = said(120)
    bodies = [said(1_300) + passage for _ in range(12)]
    near = [b[:i] + said(1) + b[i + 1 :] for b in bodies[:4] for i in (100, 700)]
    # About one shingle in six differs, some pairs on either side of the limit.
    edge = [b[:200] + said(k) + b[200 + k :] for b in bodies[4:8] for k in (105, 108, 120)]
    texts = [" ".join(w) for w in bodies + near + edge]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(docs, points=points).collect()}
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (t.split() for t in texts)]
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                old, new = sorted((group[i], group[j]), reverse=True)
                group = [new if g == old else g for g in group]
    assert len(set(group)) > 12
    assert got == dict(enumerate(group))


@pytest.mark.parametrize("small", [200, 2])
def test_lines_keep_one_of_each_group(docs, small):
    out = {r["doc_id"]: r for r in lines.dedup_lines(docs, small).collect()}
    assert len(out) == len(TEXTS)
    same = [i for i, r in out.items() if r["text"] and "the same line of words" in r["text"]]
    assert len(same) == 1
    assert out[None]["text"] is None and out[2]["text"] == " " and out[4]["text"] == "\n\n"
    assert out[5]["text"] == BASE and out[6]["text"] == "" and out[7]["text"] == ""
    assert out[9]["text"] == TEXTS[9]


def test_simhash_counts_bits(spark):
    words = prose(20).split(" ")
    df = spark.createDataFrame([(words,)], "w array<string>").select(F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    row = df.select("h", lines.simhash(F.col("h")).alias("sim")).first()
    h, sim = set(row["h"]), row["sim"]
    for i in range(8):
        for lane in range(7):
            ones = sum((x >> (7 * i + lane)) & 1 for x in h)
            assert (sim >> (8 * lane + i)) & 1 == int(ones > len(h) // 2)


def test_units_are_the_text(docs):
    df = docs.where("text is not null").select("text", F.array_join(lines.units(F.col("text")), "").alias("again"))
    assert df.where("text <> again").count() == 0


def test_mixture_rates_and_copies(spark, docs):
    out = mixing.mix_sources(docs, {"src0": 0.5}, 40.0, 3)
    assert {"copy", "shuffle_key"} <= set(out.columns)
    assert multiset(out, "doc_id", "copy") == multiset(mixing.mix_sources(docs.repartition(7), {"src0": 0.5}, 40.0, 3), "doc_id", "copy")
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("a").alias("source"))
    counts = [r["n"] for r in mixing.mix_sources(many, {"a": 1.0}, 20.0).groupBy("doc_id").agg(F.count("*").alias("n")).collect()]
    assert abs(np.mean(counts) - 20) < 0.3 and abs(np.var(counts) - 20) < 2


def winnowed(spark, parts, size):
    """Positions kept of all hashes of so many parts in a row."""
    df = spark.createDataFrame([(parts[i : i + size],) for i in range(len(parts) - size + 1)], "w array<string>").coalesce(1)
    h = [x[0] for x in df.select(F.shiftrightunsigned(F.xxhash64(*(F.xxhash64(F.get("w", F.lit(i))) for i in range(size))), 28)).collect()]
    if len(h) <= winnowing.WINDOW:
        return list(range(len(h)))
    picks = set()
    for i in range(len(h) - winnowing.WINDOW + 1):
        part = h[i : i + winnowing.WINDOW]
        picks.add(max(i + j for j, x in enumerate(part) if x == min(part)))
    return sorted(picks)


def test_winnowing_against_brute_force(spark, docs):
    more = spark.createDataFrame([("これは長い文です。" * 9,), ("one two",), ("a b c d e f g h i j",), (" ".join("abcdefghijklmnopqrst"),), ("x" * 25,)], "text string")
    got = docs.select("text").union(more).select("text", winnowing.fingerprint(F.coalesce("text", F.lit(""))).alias("f")).collect()
    for r in got:
        words = [w for w in re.split("[ \n\t\r]", r["text"] or "") if w]
        words = [u for w in words for u in (w if len(w) > winnowing.LONG_WORD else [w])]
        where = [winnowing.LAST_POSITION - (x & winnowing.LAST_POSITION) for x in r["f"]]
        if len(words) >= winnowing.SHORT:
            assert sorted(where) == winnowed(spark, words, winnowing.GRAM)
            continue
        letters = list(" ".join(words))
        all_grams = list(range(len(words) - 2)) if len(words) > 2 else [0] * bool(words)
        assert where == all_grams + list(range(len(letters) - winnowing.LETTERS + 1))


@pytest.mark.parametrize("text", ["ab cd ef", "one two three four five six seven eight nine ten", "今日はとても良い天気ですね。" * 60, "Donaudampfschiff", prose(19), prose(40), "日本語 の テキスト です"])
def test_half_a_text_shows_at_every_length(spark, text):
    other = "completely different material, " * 200
    docs = spark.createDataFrame([(1, text), (2, other)], "doc_id long, text string")
    row = winnowing.compare_with_edited(docs).where("doc_id = 1").first()
    assert 0 < row["near_edited"] < 1 and row["near_next"] < 0.05


def test_edited_texts(docs, empty):
    out = {(r["doc_id"], r["n_chars"]): r for r in winnowing.compare_with_edited(docs).collect()}
    n = len(BASE)
    assert out[(5, n)]["edited_sha256"] == hashlib.sha256((BASE[: n - n // 2] + BASE[: n // 2]).encode()).hexdigest()
    assert out[(5, n)]["fingerprint"] == out[(6, n)]["fingerprint"]
    last = TEXTS[-1]
    assert out[(len(TEXTS) - 1, len(last))]["edited_sha256"] == hashlib.sha256(last[: len(last) - len(last) // 2].encode()).hexdigest()
    assert winnowing.compare_with_edited(empty).count() == 0


def test_conversations(spark):
    rows = [(c, t, "user", f"say {t}") for c, n in ((1, 3), (2, 5), (3, 5), (4, 1), (None, 2)) for t in range(n)]
    rows += [(9, 0, "user", "other"), (9, 1, None, None), (9, 1, None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, _n string")
    for limit in (1_000_000, 2):
        out = chat.format_conversations(df, 2, limit).collect()
        assert {(r["conv_id"], r["turns"], r["copies"]) for r in out} == {(2, 5, 2), (9, 3, 1)}
        assert "".join(r["text"] for r in sorted(out, key=lambda r: r["segment"]) if r["conv_id"] == 2) == "".join(
            f"<|im_start|>user\nsay {t}<|im_end|>\n" for t in range(5)
        )
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = {i: rng.normal(size=8).round(2).tolist() for i in range(200)}
    vectors |= {i: vectors[3] for i in range(200, 300)}
    odd = [(400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in [*vectors.items(), *odd, (3, vectors[3])]], "vec_id long, embedding array<double>, ids int")
    got = multiset(nearest.top_scores(df, F.col("vec_id") % 20 == 0, 20), "query_id", "rank", "vec_id", "score")
    whole = {i: np.floor(64 * np.array(v)).astype(int) for i, v in vectors.items()}
    want = []
    for q in range(0, 300, 20):
        best = sorted(((-int(whole[q] @ x), i) for i, x in whole.items() if i != q))[:20]
        want += [repr((q, rank, i, -s)) for rank, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    assert nearest.top_scores(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def odd_texts():
    alphabet = "ab c\n\t'sdtre1 9.,▁é🤖中　\x85"
    return [t or "" for t in TEXTS] + ["".join(R.choice(alphabet) for _ in range(R.randrange(60))) for _ in range(500)]


def test_token_counts_are_the_library_s(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    df = spark.createDataFrame([(t,) for t in odd_texts()], "text string")
    for r in token_counts.token_counts(df, path).collect():
        assert r["n_tokens"] == len(model.encode(r["text"]))


def test_decoding_holds_no_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    only = byte_bpe.decoder(path)
    assert not hasattr(only, "tokenizer") and only.decode(b"") == b""
    text = "Ünïcode 日本 \U0001f600 \x00 end"
    ids = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(path), special_tokens={}).encode(text)
    assert only.decode(np.array(ids, dtype="<u4").tobytes()) == text.encode()


def ranks_of(path):
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def test_byte_bpe_is_tiktoken(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(t,) for t in odd_texts()], "text string")
    encoded = byte_bpe.encode(df, path, public_tokenizers.PATTERN, offsets="at")
    for r in byte_bpe.decode(encoded, path, public_tokenizers.PATTERN).collect():
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == theirs.encode_ordinary(r["text"]) and r["decoded"].decode() == r["text"]
        assert len(r["at"]) == len(ids) and all(0 <= x["start"] <= x["end"] <= len(r["text"]) for x in r["at"])
    plain = byte_bpe.encode(df, path, public_tokenizers.PATTERN)
    assert multiset(plain, "text", "ids") == multiset(encoded, "text", "ids")


def test_grammar_and_learning(spark):
    g = toxicity.Grammar(["idiot"])
    names = dict(zip(toxicity.PATTERNS, g.counts("You idiots. Not an idiot! He said an idiot came; kill you"), strict=True))
    assert names == {"insult": 0, "insult_target": 1, "insult_negated": 1, "insult_reported": 1, "threat": 1, "threat_target": 0}
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = toxicity.predictions(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out")
    right = judged.where("predicted = toxic").count()
    assert right >= 0.97 * judged.count()


def test_empty_tables(spark, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for out in (
        repeats.remove_repeats(empty),
        jaccard.similar_groups(empty),
        lines.dedup_lines(empty),
        mixing.mix_sources(empty, {"a": 0.5}),
        token_counts.over_limit(empty, path),
        toxicity.predictions(empty, labels),
    ):
        assert out.count() == 0


def test_toxicity_without_labels(docs, spark):
    out = toxicity.predictions(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)


def test_workers_of_count_trees_get_few_texts_at_once(spark, docs, monkeypatch):
    key, sizes = "spark.sql.execution.arrow.maxRecordsPerBatch", {}

    def kept(df, purpose, real=jaccard.kept):
        sizes[purpose] = int(spark.conf.get(key))
        return real(df, purpose)

    before = spark.conf.get(key)
    monkeypatch.setattr(jaccard, "kept", kept)
    assert jaccard.similar_groups(docs).count() == len(ROWS)
    assert {"signed", "pairs", "links"} <= set(sizes) and set(sizes.values()) == {jaccard.BATCH_ROWS}
    assert spark.conf.get(key) == before
