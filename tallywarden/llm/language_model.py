"""Scoring documents with an n-gram model of the corpus itself, held in tries that no task holds whole.

A word's probability depends on the two words before it (``ngram_trie.NgramTrie``). Each task reads documents and
sends every three words in a row, with the place of their document in its batch, to the shard of the
middle word. So one shuffle, in packed batches, carries both what the model learns and what it is asked:
a shard counts its n-grams, builds its tries and answers each batch with one sum a document. The middle word
is also the token itself, so its count in the corpus, which the base score needs, is known there too.

Words that are a hundredth of the corpus, or more than a shard's worth, are found in a sample, and their
triples dealt out by the first two words instead. Their pairs, and the first words of documents, are then
counted by a shuffle of counts; what no trie of a shard could answer (unseen pairs, and unseen triples of
such words) is answered by joins with these counts and with the counts of single words. The
sample decides only where work is done; counts and results are those of all documents.

Defined cases. A null text is empty: one end token. A null id has no checksum: its row is learned from.
Rows with equal ids are documents of their own. Scores of an empty table are no rows; with nothing to learn from
N and V are 0 and every token has probability 1. Columns of other names are not looked at.
"""

from __future__ import annotations

import ctypes
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tallywarden.llm.common import importable, kept, whole
from tallywarden.llm.ngram_trie import DISCOUNT, STEPS, NgramTrie
from tallywarden.plans.skew import match

# UTF-8 bytes of text that one shard's words come from, and that one batch of triples is taken from.
SHARD_BYTES = 8 << 20
PIECE_BYTES = 6 << 20
# Documents (expected) that frequent words are looked for in, and the shares of tokens looked for: a shard's, but
# within these limits, so that up to a hundred shards treat the same words as frequent.
SAMPLED, LEAST_SHARE, MOST_SHARE = 2_000, 1e-4, 1e-2
# Marks before and after a document; no word has white space.
START, END = " <", " >"
BREAK = "[\\x20\\x09-\\x0D]+"

# Kinds of rows: a batch's documents, sums for a batch, count of a word, count of a pair, questions for the
# pair counts and for the word counts.
DOCUMENTS, SUMS, WORD, PAIR, ASK_PAIR, ASK_WORD = range(6)
ROWS = "shard int, kind int, batch bigint, doc int, v string, w string, n bigint, steps bigint, body binary"
TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
SCHEMA = pa.schema(list(zip([c.split()[0] for c in ROWS.split(", ")], TYPES, strict=True)))
SCORED = "batch bigint, doc int, doc_id {}, held_out boolean, n_tokens bigint, n_known bigint, base double, steps bigint"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def packed(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays and byte strings in one compressed block; integers from 0 up go as planes of their bytes."""
    parts, head = [], []
    for a in arrays:
        if isinstance(a, bytes):
            kind, part = -1, a
        elif a.dtype.kind == "f":
            kind, part = 0, a.tobytes()
        else:
            kind = max(1, -(-int(a.max()).bit_length() // 8)) if a.size else 1
            part = b"".join((a >> 8 * k).astype(np.uint8).tobytes() for k in range(kind))
        parts.append(part)
        head.append(struct.pack("<qq", kind, len(part)))
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<q", len(head)) + b"".join(head + parts))


def unpacked(block: bytes) -> list[np.ndarray | bytes]:
    data = zstandard.ZstdDecompressor().decompress(block)
    count = struct.unpack_from("<q", data)[0]
    at, out = 8 + 16 * count, []
    for i in range(count):
        kind, size = struct.unpack_from("<qq", data, 8 + 16 * i)
        part = data[at : at + size]
        at += size
        if kind < 0:
            out.append(part)
        elif kind == 0:
            out.append(np.frombuffer(part, np.float64))
        else:
            wide = np.int32 if kind < 4 else np.int64
            planes = np.frombuffer(part, np.uint8).reshape(kind, -1)
            value = planes[0].astype(wide)
            for k in range(1, kind):
                value |= planes[k].astype(wide) << 8 * k
            out.append(value)
    return out


def table_of(rows: dict[str, object], n: int) -> pa.RecordBatch:
    """Rows as in ``ROWS``; columns not given are null."""
    given = {c: a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a, t) for (c, a), t in ((x, SCHEMA.field(x[0]).type) for x in rows.items())}
    columns = [given[c].cast(t) if c in given else pa.nulls(n, t) for c, t in zip(SCHEMA.names, TYPES, strict=True)]
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=SCHEMA)


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word numbers, the words in order, and the number of words of each text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = split.flatten()
    full = pc.not_equal(flat, "")
    parts = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    real = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    ends = np.cumsum(parts)
    coded = flat.filter(full).dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(order.size, np.int32)
    rank[order] = np.arange(order.size, dtype=np.int32)
    return rank[coded.indices.to_numpy(zero_copy_only=False)], coded.dictionary.take(pa.array(order)), real[ends] - real[ends - parts]


def hashes_of(words: pa.Array) -> np.ndarray:
    """A 31-bit polynomial hash of each word's bytes; no word is empty."""
    text = words.cast(pa.large_binary())
    bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    if len(text) == 0:
        return np.zeros(0, np.int64)
    letters = np.frombuffer(text.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].astype(np.uint64) + np.uint64(1)
    place = np.arange(letters.size) - np.repeat(bounds[:-1] - bounds[0], np.diff(bounds))
    powers = np.cumprod(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
    sums = np.add.reduceat(letters * powers[place], bounds[:-1] - bounds[0])
    return (sums >> np.uint64(33)).astype(np.int64)


def triples_of(piece: pa.RecordBatch, batch: int, shards: int, frequent: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """The rows that one piece of documents (doc_id, text, held_out) sends: one for each shard, and its documents."""
    word, names, per_text = tokens(piece.column("text"))
    names = pa.concat_arrays([names, pa.array([START, END])])
    texts, words = piece.num_rows, len(names)
    start, end = words - 2, words - 1
    ends = np.cumsum(per_text + 2) - 1
    full = np.full(int(ends[-1]) + 1, end, np.int32)
    begins = ends - per_text - 1
    full[begins] = start
    inner = np.ones(full.size, bool)
    inner[begins] = inner[ends] = False
    full[inner] = word
    before = np.roll(full, 1)
    before[begins] = start
    inner[begins] = True  # every place but the ends of documents
    after = np.roll(full, -1)
    v, u, w = full[inner], before[inner], after[inner]
    del full, before, after, inner
    doc = np.repeat(np.arange(texts, dtype=np.int32), per_text + 1)
    held = piece.column("held_out").to_numpy(zero_copy_only=False).astype(np.int32)

    hashes = hashes_of(names)
    rank = pc.fill_null(pc.index_in(names, pa.array(list(frequent), pa.string())), -1).to_numpy()
    shard = hashes[v] % shards
    split = np.flatnonzero(rank[v] >= 0)
    shard[split] = (hashes[u[split]] * 31 + hashes[v[split]]) % shards
    first = np.flatnonzero(v == start)
    shard[first] = hashes[w[first]] % shards
    # Of frequent words each document keeps its counts, until the words' own are known.
    pair, times = np.unique(doc[split].astype(np.int64) * max(len(frequent), 1) + rank[v[split]], return_counts=True)
    body = packed(per_text, pair, times)
    ids = piece.select(["doc_id", "held_out"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, ids.schema) as out:
        out.write_batch(ids)
    yield table_of({"shard": [batch % shards], "kind": [DOCUMENTS], "batch": [batch], "body": [packed(body, sink.getvalue().to_pybytes())]}, 1)

    order = np.argsort((shard * words + v) * texts + doc)
    shard = shard[order]
    present, cuts = np.unique(shard, return_index=True)
    v, u, w, doc = v[order], u[order], w[order], doc[order]
    listed = names.to_pylist()
    bodies, flags, number = [], np.zeros(words, bool), np.zeros(words, np.int32)
    for a, b in zip(cuts, [*cuts[1:], v.size], strict=True):
        three = (v[a:b], u[a:b], w[a:b])
        if 24 * (b - a) > words:
            flags[:] = False
            for x in three:
                flags[x] = True
            used = np.flatnonzero(flags)
        else:
            used = np.unique(np.concatenate(three))
        number[used] = np.arange(used.size, dtype=np.int32)
        local = [number[x] for x in three]
        local[0] = np.diff(local[0], prepend=np.int32(0))
        bodies.append(packed("\n".join([listed[i] for i in used.tolist()]).encode(), *local, doc[a:b] * 2 + held[doc[a:b]]))
    yield table_of({"shard": present, "kind": [SUMS] * len(bodies), "batch": [batch] * len(bodies), "body": bodies}, len(bodies))


def released() -> None:
    """Give memory of finished work back, for a worker lives through many pieces and shards."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; elsewhere nothing is needed
    if trim:
        trim(0)


def sender(shards: int, frequent: dict[str, int], piece_bytes: int) -> Callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = TaskContext.get().partitionId() << 32
        for rows in batches:
            sizes = pc.binary_length(rows.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
            piece = np.cumsum(sizes) // piece_bytes
            cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), rows.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    yield from triples_of(rows.slice(a, b - a), batch, shards, frequent)
                    batch += 1
                    released()

    return send


def distinct(v: np.ndarray, u: np.ndarray, w: np.ndarray, words: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The number of each row's triple, and the distinct triples in order."""
    if words < 1 << 21:
        key = (v.astype(np.int64) * words + u) * words + w
        order = np.argsort(key)
        key = key[order]
        new = key[1:] != key[:-1]
    else:
        order = np.lexsort((w, u, v))
        new = (np.diff(v[order]) != 0) | (np.diff(u[order]) != 0) | (np.diff(w[order]) != 0)
    new = np.concatenate([[True], new])
    number = np.empty(v.size, np.int64)
    number[order] = np.cumsum(new) - 1
    at = order[new]
    return number, (v[at].astype(np.int64), u[at].astype(np.int64), w[at].astype(np.int64))


def answered(shard: pa.Table, frequent: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Count one shard's triples, build its tries, and answer its batches."""
    kinds = shard.column("kind").to_numpy()
    passed = shard.filter(pa.array(kinds == DOCUMENTS))
    yield from passed.combine_chunks().to_batches()
    rows = np.flatnonzero(kinds == SUMS)
    if not rows.size:
        return
    batches = shard.column("batch").to_numpy()[rows]
    bodies, names, sizes, ways = shard.column("body").take(pa.array(rows)), [], [], []
    for block in bodies:
        text, v, u, w, doc = unpacked(block.as_py())
        names.append(pc.split_pattern(pa.array([text.decode()]), "\n").flatten())
        ways.append((np.cumsum(v, dtype=np.int32), u, w, doc))
        sizes.append(v.size)
    coded = pa.concat_arrays(names).dictionary_encode()
    numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    vocabulary, words = coded.dictionary, len(coded.dictionary)
    starts = np.cumsum([0, *(len(x) for x in names)])
    v, u, w = (np.concatenate([numbers[starts[i] : starts[i + 1]][way[k]] for i, way in enumerate(ways)]) for k in range(3))
    doc = np.concatenate([way[3] for way in ways])
    # Documents are numbered through all batches of the shard.
    first_doc = np.cumsum([0, *(int(way[3].max() >> 1) + 1 for way in ways)])
    taught = doc & 1 == 0
    doc = (doc >> 1) + np.repeat(first_doc[:-1], sizes)
    del ways, names, numbers, coded
    first = pc.equal(vocabulary, START).to_numpy(zero_copy_only=False)
    whole_ = ~(first | pc.is_in(vocabulary, pa.array(list(frequent), pa.string())).to_numpy(zero_copy_only=False))

    triple, (tv, tu, tw) = distinct(v, u, w, words)
    del u, w
    counts = np.bincount(triple[taught], minlength=tv.size)
    own = np.flatnonzero((counts > 0) & ~first[tv])
    trie = NgramTrie(tv[own], tu[own], tw[own], counts[own], words, whole_)
    released()
    steps, done = np.zeros(tv.size, np.int64), np.zeros(tv.size, bool)
    # The triples that made the trie have their places in it; those of other documents are looked up.
    steps[own], done[own] = trie.triple_codes, True
    asked = np.bincount(triple[~taught], minlength=tv.size) > 0
    asked = np.flatnonzero(asked & ~first[tv])
    steps[asked], done[asked] = trie.cost(tv[asked], tu[asked], tw[asked])

    # Sums for each document of a batch, over the words that are whole in this shard.
    known = trie.total
    docs, place = np.arange(first_doc[-1]), doc
    if docs.size > 4 * doc.size:
        docs, place = np.unique(doc, return_inverse=True)
    log = np.log10(known + 1)
    log[~whole_] = 0
    base = np.bincount(place, log[v], docs.size)
    n_known = np.bincount(place, (whole_ & (known > 0))[v], docs.size).astype(np.int64)
    settled = done[triple]
    total = np.bincount(place, np.where(settled, steps[triple], 0), docs.size).astype(np.int64)
    cuts = np.searchsorted(docs, first_doc)
    sums = []
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        some = a + np.flatnonzero((total[a:b] > 0) | (base[a:b] > 0))  # else nothing to add
        sums.append(packed(np.diff(docs[some] - first_doc[i], prepend=0), n_known[some], total[some], base[some]))
    yield table_of({"kind": [SUMS] * len(sums), "batch": batches, "body": sums}, len(sums))

    seen = np.flatnonzero(whole_ & (known > 0))
    yield table_of({"kind": pa.array(np.full(seen.size, WORD)), "w": vocabulary.take(pa.array(seen)), "n": pa.array(known[seen].astype(np.int64))}, seen.size)
    part = (counts > 0) & ~whole_[tv]
    both, at = np.unique(tv[part].astype(np.int64) * words + tw[part], return_inverse=True)
    often = np.bincount(at, counts[part], both.size).astype(np.int64)
    yield table_of(
        {"kind": pa.array(np.full(both.size, PAIR)), "v": vocabulary.take(pa.array(both // words)), "w": vocabulary.take(pa.array(both % words)), "n": pa.array(often)},
        both.size,
    )
    left = np.flatnonzero(~settled)
    asked, times = np.unique(doc[left] * tv.size + triple[left], return_counts=True)
    where, which = asked // tv.size, asked % tv.size
    of = np.searchsorted(first_doc, where, side="right") - 1
    kind = np.where(whole_[tv[which]], ASK_WORD, ASK_PAIR)
    yield table_of(
        {
            "kind": pa.array(kind),
            "batch": pa.array(batches[of]),
            "doc": pa.array((where - first_doc[of]).astype(np.int32)),
            "v": vocabulary.take(pa.array(tv[which])),
            "w": vocabulary.take(pa.array(tw[which])),
            "n": pa.array(times),
            "steps": pa.array(steps[which]),
        },
        asked.size,
    )


def assembled(group: pa.Table, counts: np.ndarray, id_type: pa.DataType) -> pa.Table:
    """The documents of one batch with their sums over all shards and over frequent words."""
    kinds = group.column("kind").to_numpy()
    bodies = group.column("body")
    front, ids = unpacked(bodies[int(np.flatnonzero(kinds == DOCUMENTS)[0])].as_py())
    per_text, pair, times = unpacked(front)
    n = per_text.size
    known, steps, base = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    for i in np.flatnonzero(kinds == SUMS):
        gaps, some, cost, log = unpacked(bodies[int(i)].as_py())
        doc = np.cumsum(gaps)
        known[doc] += some
        steps[doc] += cost
        base[doc] += log
    if pair.size:
        doc, word = pair // counts.size, counts[pair % counts.size]
        known += np.bincount(doc, times * (word > 0), n).astype(np.int64)
        base += np.bincount(doc, times * np.log10(word + 1), n)
    named = pa.ipc.open_stream(ids).read_all()
    return pa.table(
        {
            "batch": pa.array(np.full(n, group.column("batch")[0].as_py())),
            "doc": pa.array(np.arange(n), pa.int32()),
            "doc_id": named.column("doc_id").cast(id_type),
            "held_out": named.column("held_out"),
            "n_tokens": pa.array(per_text.astype(np.int64) + 1),
            "n_known": pa.array(known),
            "base": pa.array(base),
            "steps": pa.array(steps),
        }
    )


def frequent_words(docs: DataFrame, rows: int, share: float) -> list[str]:
    """Words of a sample that are more than ``share`` of its tokens: at most 1 / share."""
    some = docs.sample(min(1.0, SAMPLED / max(rows, 1)), 5)
    words = some.select(F.explode(F.split(lower_ascii(F.col("text")), BREAK)).alias("w")).where("w <> ''")
    counts = words.groupBy("w").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    return sorted(r["w"] for r in counts.where(F.col("count") > share * total).collect())


def cost_of(probability: Column) -> Column:
    return F.ceil(-F.log10(probability) * STEPS)


def scores(docs: DataFrame, held_out: Column, shard_bytes: int = SHARD_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Score all texts with a model of those that are not ``held_out``.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score. ``score`` is the sum of log10
    probabilities that the tries hold, each rounded down to 1 / STEPS; the probabilities after any two words sum to 1 at most.
    Documents are read once as they lie, so ``docs`` should be a stored table, whose tasks can be repeated.
    """
    spark = docs.sparkSession
    importable(spark)
    rows = docs.select("doc_id", whole("text").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    shards = max(-(-(size["bytes"] or 0) // shard_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    frequent = {w: i for i, w in enumerate(frequent_words(rows, size["rows"], max(min(1 / shards, MOST_SHARE), LEAST_SHARE)))}
    told = spark.sparkContext.broadcast(frequent)  # 1 / LEAST_SHARE words at most

    sent = rows.mapInArrow(sender(shards, frequent, piece_bytes), ROWS)

    def answer(shard: pa.Table) -> pa.Table:
        found = pa.Table.from_batches(list(answered(shard, told.value)), SCHEMA)
        released()
        return found

    out = kept(sent.repartition(shards, "shard").groupBy("shard").applyInArrow(answer, ROWS), "answers")

    def of(kind: int) -> DataFrame:
        return out.where(F.col("kind") == kind)

    pairs = kept(of(PAIR).groupBy("v", "w").agg(F.sum("n").alias("n")), "pairs")
    heads = pairs.groupBy("v").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("spread")).collect()
    total = {r["v"]: r["total"] for r in heads}
    counts = np.array([total.get(w, 0) for w in frequent] or [0], np.int64)
    taught = total.get(START, 0)  # documents learned from, which are as many ends
    single = [(w, n) for w, n in total.items() if w != START] + ([(END, taught)] if taught else [])
    vocabulary = of(WORD).select("w", "n").unionByName(spark.createDataFrame(single, "w string, n bigint"))
    seen = vocabulary.agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).first()
    tokens_, floor = seen["n"] or 0, (seen["n"] or 0) + seen["v"] + 1

    # Pairs of frequent words, then single words, for what the tries left open.
    after = spark.createDataFrame([tuple(r) for r in heads], "v string, total bigint, spread bigint")
    found = match(of(ASK_PAIR), pairs.withColumnRenamed("n", "_pair"), ["v", "w"], "left").join(F.broadcast(after), "v", "left")
    spared = F.when(F.col("total") > 0, cost_of(DISCOUNT * F.col("spread") / F.col("total"))).otherwise(0)
    step = F.when(F.col("_pair") > 0, cost_of((F.col("_pair") - DISCOUNT) / F.col("total"))).otherwise(spared)
    priced = found.withColumn("steps", F.col("steps") + step)
    columns = ["batch", "doc", "w", "n", "steps"]
    last = of(ASK_WORD).select(*columns).unionByName(priced.where("_pair IS NULL").select(*columns))
    worded = match(last, vocabulary.withColumnRenamed("n", "_count"), ["w"], "left")
    one = cost_of((F.coalesce("_count", F.lit(0)) + 1) / F.lit(float(floor)))
    settled = worded.withColumn("steps", F.col("steps") + one).unionByName(priced.where("_pair IS NOT NULL").select(*columns, F.lit(0).alias("_count")))
    more = settled.groupBy("batch", "doc").agg(F.sum(F.col("n") * F.col("steps")).alias("_more"))

    id_type = rows.schema["doc_id"].dataType.simpleString()
    arrow_type = pa.int64() if id_type == "bigint" else pa.int32() if id_type == "int" else pa.string()

    def gather(group: pa.Table) -> pa.Table:
        return assembled(group, counts, arrow_type)

    summed = out.where(F.col("kind").isin(DOCUMENTS, SUMS)).select("kind", "batch", "body").groupBy("batch").applyInArrow(gather, SCORED.format(id_type))
    final = summed.join(more, ["batch", "doc"], "left")
    known_end = int(taught > 0)
    end_log = float(np.log10(taught + 1))
    return final.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + known_end).alias("n_known"),
        F.lit(tokens_).cast("bigint").alias("train_tokens"),
        (F.col("base") + end_log - F.col("n_tokens") * float(np.log10(floor))).alias("base_score"),
        (-(F.col("steps") + F.coalesce("_more", F.lit(0))) / STEPS).alias("score"),
    )


def seventh_held_out() -> Column:
    """The documents whose id's checksum leaves 2 when divided by 7."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
