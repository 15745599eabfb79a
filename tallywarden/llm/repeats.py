"""Repeated passages by the interval tree of a sparse enhanced suffix array.

Every string of ``LENGTH`` bytes contains an anchor: the place of the smallest hash
of ``GRAM`` bytes in it, the last of equals. Equal strings have their anchors
at the same place. So it is enough to sort the suffixes that start at anchors and hold the bytes
before each. Suffixes are dealt to tasks by the hash at their anchor. A task sorts them, computes the
common prefixes of neighbours and scans these with a stack, which gives the tree of
common-prefix intervals. Within an interval the bytes before the anchors, sorted
backwards and scanned in the same way, tell how far groups of occurrences extend to the left; a
group whose occurrences differ on both sides is a maximal repeat and is put out with all of them.

Contexts equal in all their bytes are one member, however many texts hold them.
Hashes with more members than a task should hold are split at the first
byte in which a member leaves a pivot, on the left or on the right; there the repeats put out are
those of a member and the pivot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tallywarden.llm.common import importable, kept, may_be_in, text_key, whole

LENGTH = 400
GRAM = 32
# Members a task takes at once.
MEMBERS = 1_000
# Bytes hashed at once, and the bits that hold a place among them.
CHUNK, PLACE_BITS = 1 << 19, 20
# Longs in the table of repeated hashes, of 64 bits each: a fixed size of two megabytes.
TABLE = 1 << 18

BASE = 0x9E3779B97F4A7C15
POWERS = np.multiply.accumulate(np.array([1] + [BASE] * (CHUNK + 2 * LENGTH), dtype=np.uint64))
INVERSE = np.multiply.accumulate(np.array([1] + [pow(BASE, -1, 1 << 64)] * (CHUNK + 2 * LENGTH), dtype=np.uint64))


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place; the same wherever these bytes stand."""
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * POWERS[: len(raw)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * INVERSE[: len(raw) - GRAM + 1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def anchors(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all strings of ``length`` bytes, ascending, and their hashes."""
    raw = np.frombuffer(text, dtype=np.uint8)
    width = length - GRAM + 1
    places, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    for start in range(0, len(raw) - length + 1, CHUNK):
        h = gram_hashes(raw[start : start + CHUNK + length - 1])
        place = np.arange(len(h), dtype=np.uint64)
        marked = ((h >> np.uint64(PLACE_BITS)) << np.uint64(PLACE_BITS)) | (np.uint64((1 << PLACE_BITS) - 1) - place)
        # Smallest of each window, from running minima of blocks of the window's width in both directions.
        padded = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[: len(h)] = marked
        blocks = padded.reshape(-1, width)
        onward = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(h) - width + 1
        smallest = np.minimum(back[:n], onward[width - 1 : width - 1 + n])
        new = np.flatnonzero(np.diff(smallest, prepend=smallest[:1] + np.uint64(1)))
        at = np.unique((1 << PLACE_BITS) - 1 - (smallest[new] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64))
        places.append(at + start)
        hashes.append(h[at])
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def repeated_hashes(docs: DataFrame, length: int) -> DataFrame:
    """Hashes of anchors that stand at two places or more; copies of a text count as one."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            h, at = [], []
            for key, text in zip(rows["key"], rows["text"], strict=True):
                place, hashes = anchors(text.encode("utf-8"), length)
                h.append(hashes)
                # A number for the place in the text, the same in each copy.
                at.append(place.astype(np.uint64) * np.uint64(BASE) + np.uint64(int.from_bytes(key[:8], "big")))
            yield pd.DataFrame({"h": np.concatenate(h).view("<i8"), "at": np.concatenate(at).view("<i8")} if h else {"h": [], "at": []}).astype("int64")

    rows = docs.mapInPandas(found, "h long, at long")
    return rows.groupBy("h").agg(F.min("at").alias("low"), F.max("at").alias("high")).where("low <> high").select("h")


def bit_table(hashes: DataFrame) -> np.ndarray:
    place = F.col("h").bitwiseAND(F.lit(TABLE - 1)).alias("place")
    bits = hashes.groupBy(place).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 18) & 63 as int))")).alias("bits"))
    table = np.zeros(TABLE, dtype=np.uint64)
    for r in bits.collect():
        table[r["place"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    return table


def contexts(docs: DataFrame, table: np.ndarray, length: int) -> DataFrame:
    """(h, context, back, ahead, key, places): bytes around the anchors whose hash may be repeated.

    ``back`` holds the bytes before the anchor from right to left, ``ahead`` those from it on, up to what a string
    of ``length`` bytes around the anchor can reach. Equal contexts of a text are one row.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for key, text in zip(rows["key"], rows["text"], strict=True):
                raw = text.encode("utf-8")
                place, hashes = anchors(raw, length)
                known = (table[(hashes & np.uint64(TABLE - 1)).astype(np.int64)] >> ((hashes >> np.uint64(18)) & np.uint64(63))) & np.uint64(1)
                own: dict = {}
                for p, h in zip(place[known == 1].tolist(), hashes[known == 1].view("<i8").tolist(), strict=True):
                    back, ahead = raw[max(0, p - length + GRAM) : p][::-1], raw[p : p + length]
                    own.setdefault((h, back, ahead), []).append(p)
                for (h, back, ahead), places in own.items():
                    name = hashlib.md5(len(back).to_bytes(4, "big") + back + ahead).digest()
                    out.append((h, name, back, ahead, key, places))
            yield pd.DataFrame(out, columns=["h", "context", "back", "ahead", "key", "places"])

    return docs.mapInPandas(cut, "h long, context binary, back binary, ahead binary, key binary, places array<long>")


def common(rows: list[bytes]) -> np.ndarray:
    """For sorted byte strings, the length of the common prefix of each with the one before; 0 for the first."""
    lengths = np.array([len(r) for r in rows])
    wide = np.zeros((len(rows), max(int(lengths.max()), 1)), dtype=np.uint8)
    for i, r in enumerate(rows):
        wide[i, : len(r)] = np.frombuffer(r, dtype=np.uint8)
    differs = wide[1:] != wide[:-1]
    first = np.where(differs.any(1), differs.argmax(1), wide.shape[1])
    return np.concatenate(([0], np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))))


def intervals(prefixes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals (depth, first, last) by a scan with a stack of open ones, inner ones first."""
    stack = [(0, 0)]
    for i, depth in enumerate([*prefixes[1:].tolist(), -1], start=1):
        left = i - 1
        while stack and depth < stack[-1][0]:
            open_depth, left = stack.pop()
            yield open_depth, left, i - 1
        if depth >= 0 and (not stack or depth > stack[-1][0]):
            stack.append((depth, left))


class RangeMinimum:
    """Smallest value of any stretch of an array."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            last, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-half], last[half:]))
        self.wide = np.full((len(self.rows), len(values)), np.iinfo(values.dtype).max, dtype=values.dtype)
        for i, r in enumerate(self.rows):
            self.wide[i, : len(r)] = r

    def between(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        level = np.frexp(last - first + 1)[1] - 1
        return np.minimum(self.wide[level, first], self.wide[level, last + 1 - (1 << level)])


class Bucket:
    """The interval tree of the contexts of one hash."""

    def __init__(self, back: list[bytes], ahead: list[bytes], length: int = LENGTH):
        self.length = length
        order = sorted(range(len(ahead)), key=ahead.__getitem__)
        back_order = sorted(range(len(back)), key=back.__getitem__)
        self.suffixes = common([ahead[i] for i in order])
        shared = common([back[i] for i in back_order])
        self.deepest, self.farthest = int(self.suffixes.max()), int(shared.max())
        rank = np.empty(len(back), dtype=np.int64)
        rank[back_order] = np.arange(len(back))
        self.ranks, self.named = rank[order], np.array(back_order)
        self.place = np.empty(len(ahead), dtype=np.int64)
        self.place[order] = np.arange(len(ahead))
        self.shared, self.onward = RangeMinimum(shared), RangeMinimum(self.suffixes)

    def _intervals(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(depth, members by the bytes before them, bytes each of these has in common with the one before it)."""
        if self.deepest + self.farthest < self.length:
            return
        for depth, first, last in intervals(self.suffixes):
            if last > first and depth + self.farthest >= self.length:
                inside = np.sort(self.ranks[first : last + 1])
                left = np.concatenate(([0], self.shared.between(inside[:-1] + 1, inside[1:])))
                # With the same byte before all occurrences, the repeat begins further left.
                if left.max() + depth >= self.length:
                    yield depth, inside, left

    def groups(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(bytes before the anchor, bytes from it on, members) of each maximal repeat.

        Members are numbers of contexts; all that hold the repeat are listed.
        """
        for depth, inside, left in self._intervals():
            for extent, low, high in intervals(left):
                if high > low and extent + depth >= self.length:
                    members = self.named[inside[low : high + 1]]
                    at = np.sort(self.place[members])
                    # Occurrences that all go on alike to the right belong to a deeper interval.
                    if self.onward.between(at[:-1] + 1, at[1:]).min() == depth:
                        yield extent, depth, members

    def extents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(members, bytes before the anchor, bytes from it on) of the widest repeats each member is in.

        In an interval an occurrence reaches as far to the left as the neighbour most like it. Repeats
        inside another of the same member are left out.
        """
        found = [(np.zeros(0, dtype=np.int64),) * 3]
        for depth, inside, left in self._intervals():
            reach = np.maximum(left, np.append(left[1:], 0))
            wide = np.flatnonzero(reach + depth >= self.length)
            found.append((self.named[inside[wide]], reach[wide], np.full(len(wide), depth)))
        member, extent, depth = (np.concatenate([f[i] for f in found]).astype(np.int64) for i in range(3))
        by_depth = np.lexsort((-extent, -depth, member))
        member, extent, depth = member[by_depth], extent[by_depth], depth[by_depth]
        # Going from deep to shallow, only a repeat that reaches further left than all before is new.
        mark = member * (2 * self.length) + extent + 1
        before = np.concatenate(([-1], np.maximum.accumulate(mark)[:-1]))
        new = (mark > before) if len(mark) else np.zeros(0, dtype=bool)
        return member[new], extent[new], depth[new]


def agreeing(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle)
    return low


def split_large(members: DataFrame, length: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Members by bucket, none above ``most``, and repeats found on the way as (context, extent, depth).

    The members of a larger bucket are compared with one of them, the pivot. All strings around a member's
    anchor that lie in what it has in common with the pivot are settled by that. A string that reaches
    beyond, to the left or to the right, can only be shared with members that leave the pivot at the same place
    with the same byte: these are a new bucket. A string that does so on both sides is sought on the left
    only. A new bucket lacks the pivot at least, so this ends.
    """

    def against_pivot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                extent, depth = agreeing(r.back, r.pivot_back), agreeing(r.ahead, r.pivot_ahead)
                least, highest = max(r.least, length - len(r.ahead)), min(r.highest, len(r.back))
                moves = []
                if max(least, extent + 1) <= highest:
                    moves.append((f"l{extent},{r.back[extent]}", max(least, extent + 1), highest))
                if depth < len(r.ahead) and least <= min(highest, extent, length - 1 - depth):
                    moves.append((f"r{depth},{r.ahead[depth]}", least, min(highest, extent, length - 1 - depth)))
                if r.context != r.pivot:
                    out.append((r.bucket, r.context, r.back, r.ahead, r.pivot, extent, depth, moves))
            yield pd.DataFrame(out, columns=["bucket", "context", "back", "ahead", "pivot", "extent", "depth", "moves"])

    schema = (
        "bucket long, context binary, back binary, ahead binary, pivot binary, extent int, depth int, "
        "moves array<struct<way: string, least: int, highest: int>>"
    )
    # Offsets of strings still sought: bytes between the string's start and the anchor.
    left = members.withColumns({"bucket": F.xxhash64("h"), "least": F.lit(0), "highest": F.lit(length - GRAM)}).drop("h")
    done, shared = [], []
    while True:
        sizes = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("pivot"))
        # Few rows: one for each ``most`` members at the most.
        large = kept(sizes.where(F.col("n") > most).select("bucket", "pivot"), "large")
        done.append(left.join(large, "bucket", "left_anti").select("bucket", "context", "back", "ahead"))
        if large.isEmpty():
            break
        pivots = left.select("bucket", F.col("context").alias("pivot"), F.col("back").alias("pivot_back"), F.col("ahead").alias("pivot_ahead"))
        pivots = large.join(pivots, ["bucket", "pivot"])
        compared = kept(left.join(pivots, "bucket").mapInPandas(against_pivot, schema), "compared")
        near = compared.where(F.col("extent") + F.col("depth") >= length)
        shared += [near.select(F.col(c).alias("context"), "extent", "depth").distinct() for c in ("context", "pivot")]
        moved = compared.select("bucket", "context", "back", "ahead", F.inline("moves"))
        left = moved.select(F.xxhash64("bucket", "way").alias("bucket"), "context", "back", "ahead", "least", "highest")
    return reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, shared) if shared else None


def found_repeats(docs: DataFrame, length: int, most: int, whole_groups: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repeats as (context, extent, depth), the contexts, and where these stand as (context, key, place)."""
    importable(docs.sparkSession)
    table = bit_table(repeated_hashes(docs, length))
    around = kept(contexts(docs, table, length), "contexts")
    where = around.select("context", "key", F.explode("places").alias("place"))
    at = F.xxhash64("key", F.get("places", F.lit(0)))
    members = around.groupBy("h", "context").agg(
        F.any_value("back").alias("back"),
        F.any_value("ahead").alias("ahead"),
        ((F.min(at) != F.max(at)) | (F.max(F.size("places")) > 1)).alias("several"),
    )
    members = kept(members, "members")
    equal = members.where("several").select("context", F.length("back").alias("extent"), F.length("ahead").alias("depth"))
    equal = equal.where(F.col("extent") + F.col("depth") >= length)
    buckets, shared = split_large(members.select("h", "context", "back", "ahead"), length, most)

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        names = rows["context"].to_numpy()
        bucket = Bucket(rows["back"].tolist(), rows["ahead"].tolist(), length)
        if whole_groups:
            out = [(names[m], e, d) for e, d, found in bucket.groups() for m in found]
            return pd.DataFrame(out, columns=["context", "extent", "depth"])
        member, extent, depth = bucket.extents()
        return pd.DataFrame({"context": names[member], "extent": extent.astype("int32"), "depth": depth.astype("int32")})

    def by_bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by bucket; a bucket has ``most`` rows at most."""
        held = None
        for rows in batches:
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            cut = np.flatnonzero(np.diff(rows["bucket"].to_numpy())) + 1
            edges = [0, *cut.tolist()]
            found = [scan(rows.iloc[start:end]) for start, end in zip(edges, edges[1:], strict=False)]
            if found:
                yield pd.concat(found)
            held = rows.iloc[edges[-1] :].reset_index(drop=True)
        if held is not None and len(held):
            yield scan(held)

    schema = "context binary, extent int, depth int"
    found = buckets.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(by_bucket, schema)
    found = found.unionByName(equal)
    return (found.unionByName(shared) if shared is not None else found).distinct(), members, where


def repeat_groups(docs: DataFrame, length: int = LENGTH, most: int = MEMBERS) -> DataFrame:
    """Maximal repeats of ``length`` bytes or more: (group, size, key, start), a row per occurrence.

    ``docs`` has (key, text), a key for each different text; rows of equal key are one text. ``group`` is a digest of the repeated
    bytes and ``size`` their number. A repeat is seen as far as ``length`` bytes from an anchor: a longer one is put
    out as several that overlap. Texts of fewer bytes have no repeats.
    """
    found, members, where = found_repeats(docs, length, most, whole_groups=True)
    found = found.join(members.select("context", "back", "ahead"), "context")
    repeated = F.concat(F.reverse(F.expr("hex(substring(back, 1, extent))")), F.lit("|"), F.expr("hex(substring(ahead, 1, depth))"))
    named = found.select("context", "extent", F.md5(repeated).alias("group"), (F.col("extent") + F.col("depth")).alias("size"))
    return named.join(where, "context").select("group", "size", "key", (F.col("place") - F.col("extent")).alias("start"))


def repeat_spans(docs: DataFrame, length: int = LENGTH, most: int = MEMBERS) -> DataFrame:
    """(key, start, end) of bytes in repeats; what ``repeat_groups`` covers, without telling the groups apart."""
    found, _, where = found_repeats(docs, length, most, whole_groups=False)
    start = (F.col("place") - F.col("extent")).alias("start")
    return found.join(where, "context").select("key", start, (F.col("place") + F.col("depth")).alias("end")).distinct()


def remove_repeats(docs: DataFrame, length: int = LENGTH, most: int = MEMBERS) -> DataFrame:
    """What is left of each document without bytes in strings of ``length`` bytes that also start elsewhere.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left). Null texts are empty. Repeated
    rows are copies of each other.
    """
    importable(docs.sparkSession)
    docs = docs.select("doc_id", whole("text").alias("text"))
    texts = docs.withColumn("key", text_key("text"))
    spans = repeat_spans(texts.where(F.octet_length("text") >= length).select("key", "text"), length, most)
    spans = kept(spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")), "spans")
    copied = texts.groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("copied"))
    marked = kept(spans.join(copied, "key", "full"), "marked")
    touched = may_be_in(marked, "key") & (F.octet_length("text") >= length)

    def leave(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for doc_id, text, spans, copied in zip(rows["doc_id"], rows["text"], rows["spans"], rows["copied"], strict=True):
                raw = text.encode("utf-8")
                merged: list[list[int]] = []
                for s in [{"start": 0, "end": len(raw)}] if copied is True else spans if spans is not None else []:
                    if merged and s["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["end"])
                    else:
                        merged.append([s["start"], s["end"]])
                edges = [0, *(x for m in merged for x in m), len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc_id, len(raw), len(raw) - len(left), len(merged), left))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]).astype({"doc_id": rows["doc_id"].dtype})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    changed = texts.where(touched).join(marked, "key", "left").select("doc_id", "text", "spans", F.coalesce("copied", F.lit(False)).alias("copied"))
    size = F.octet_length("text").cast("long")
    same = texts.where(~touched).select(
        "doc_id", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept")
    )
    both = changed.mapInPandas(leave, schema).unionByName(same)
    return both.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "kept")
