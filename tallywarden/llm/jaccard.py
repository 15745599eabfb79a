"""Groups of documents whose word n-gram sets have a high Jaccard similarity.

An n-gram is hashed into one of ``GROUPS`` groups; a document is the point of its group
counts. The overlap of two sets is at most the sum of the smaller count in each group,
and the overlap with any set below a tree node is at most that with the node's largest
counts. An R-tree over the points prunes by these bounds; surviving pairs are verified
on the whole sets.

An R-tree over a whole corpus would be one task's work, so points are dealt to
trees first, without losing a pair: sets of similarity t share one of their first
(1 - t) n + 1 members in any fixed order. The order puts frequent n-grams last, which keeps the
trees small. A pair is put out only where its first common member can be, which leaves it enough members
to follow. Large sets, for which the groups of a point are too few, are bounded by wider counts before their
texts are read. Only groups matter, so a first round links what resembles one leader, and the trees
look for links between different groups alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType

from tallywarden.llm.common import dropped, importable, kept, may_be_in, text_key, whole
from tallywarden.operators.counterparties import linked_groups
from tallywarden.session import configured

# Link at similarity of SHARE / 100 and more; words in an n-gram.
SHARE, WORDS = 85, 4
GROUPS = 128
# Smallest members that name a document's leaders.
LEADERS = 4
# Part of the texts, picked by a hash, in which frequent n-grams are counted, and what counts as frequent there.
SAMPLED, FREQUENT = 32, 8
# Longs in the table of frequent n-grams, of 64 bits each: a fixed size of half a megabyte.
TABLE = 1 << 16
# Points in one tree; a larger share of points is dealt to trees by pairs of parts.
POINTS = 1_000
LEAF = 16
PAIRS_AT_ONCE = 65_536
MOST_COUNT = 255
# Rows that a Python worker gets at once, so that it holds few whole texts.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000
# Sets of so many members and more have wide counts too, of a group for every two to four members.
WIDE_FROM = 1_024

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed n-grams. Words are what lies between spaces and the controls 9 to 13."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.powers = self._powers(64)

    @staticmethod
    def _powers(n: int) -> np.ndarray:
        powers = np.full(n, 0x9E3779B97F4A7C15, dtype=np.uint64)
        powers[0] = 1
        return np.multiply.accumulate(powers)

    def word_hashes(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
        inside = (raw != 32) & ((raw < 9) | (raw > 13))
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(starts):
            return np.zeros(0, dtype=np.uint64)
        lengths = ends - starts
        if lengths.max() > len(self.powers):
            self.powers = self._powers(2 * int(lengths.max()))
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        place = np.arange(lengths.sum()) - np.repeat(first, lengths)
        terms = (raw[inside].astype(np.uint64) + np.uint64(1)) * self.powers[place]
        return mixed(np.add.reduceat(terms, first) + lengths.astype(np.uint64) * MIX1)

    def shingles(self, text: str | None) -> np.ndarray:
        """The distinct n-grams in ascending order; all words as one if there are fewer."""
        w = self.word_hashes(text or "")
        n = min(self.words, len(w))
        if not n:
            return w
        h = np.full(len(w) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            h = mixed(h * MIX2 + w[i : len(w) - n + 1 + i])
        return np.unique(h)


def same_set(s: np.ndarray) -> bytes:
    """A 128-bit digest of a set."""
    a, b = mixed(s ^ MIX1), mixed(s + MIX2)
    return int(a.sum(dtype=np.uint64)).to_bytes(8, "big") + int((b ^ (b >> np.uint64(7))).sum(dtype=np.uint64)).to_bytes(8, "big")


def point(s: np.ndarray) -> np.ndarray:
    """Group counts; if one is too large for a byte all are set to the largest, which bounds nothing."""
    counts = np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=GROUPS)
    return (counts if counts.max() < MOST_COUNT else np.full(GROUPS, MOST_COUNT)).astype(np.uint8)


def wide_point(s: np.ndarray) -> bytes:
    """Counts of a large set in a power of two of groups, so that the counts of a larger one fold into its groups; empty for others."""
    if len(s) < WIDE_FROM:
        return b""
    bits = len(s).bit_length() - 2
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return (counts if counts.max() < MOST_COUNT else np.full(1 << bits, MOST_COUNT)).astype(np.uint8).tobytes()


def wide_overlap(a: bytes, b: bytes) -> int:
    """The largest overlap that two sets with these wide counts can have."""
    p, q = (np.frombuffer(x, dtype=np.uint8).astype(np.int64) for x in sorted((a, b), key=len))
    return int(np.minimum(p, q.reshape(len(p), -1).sum(1)).sum())


def points_of(packed: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(-1, GROUPS)


def may_link(p: np.ndarray, n: np.ndarray, q: np.ndarray, m: np.ndarray, share: int) -> np.ndarray:
    """Whether sets of n and m members at points p and q can link, row by row."""
    good = 100 * np.minimum(n, m) >= share * np.maximum(n, m)
    at = np.flatnonzero(good)
    for cut in range(0, len(at), PAIRS_AT_ONCE):
        i = at[cut : cut + PAIRS_AT_ONCE]
        good[i] = np.minimum(p[i], q[i]).sum(1, dtype=np.int64) >= np.minimum(least_overlap(n[i], m[i], share), GROUPS * MOST_COUNT)
    return good


def prefix_length(n: int, share: int = SHARE) -> int:
    return n - -(-share * n // 100) + 1


def least_overlap(n: np.ndarray, m: np.ndarray, share: int = SHARE) -> np.ndarray:
    """The smallest overlap of sets of n and m members that link."""
    return -(-share * (n + m) // (100 + share))


class CountTree:
    """An R-tree over count vectors, packed by size; nodes hold the largest count of each group."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, share: int = SHARE):
        self.share = share
        # By size, then by the fullest group, so that neighbours are alike.
        self.order = np.lexsort((points.argmax(1), sizes))
        sizes = sizes[self.order]
        self.levels = [(points[self.order], sizes, sizes)]
        while len(self.levels[-1][0]) > LEAF:
            most, low, high = self.levels[-1]
            cut = np.arange(0, len(most), LEAF)
            parts = (np.maximum, most), (np.minimum, low), (np.maximum, high)
            self.levels.append(tuple(f.reduceat(x, cut) for f, x in parts))

    def search(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For many points at once: which of them may link with which point of the tree."""
        top = len(self.levels[-1][0])
        asks, at = np.repeat(np.arange(len(points)), top), np.tile(np.arange(top), len(points))
        for depth in range(len(self.levels) - 1, -1, -1):
            good = np.concatenate([self._near(depth, points, sizes, asks[c : c + PAIRS_AT_ONCE], at[c : c + PAIRS_AT_ONCE]) for c in range(0, max(len(at), 1), PAIRS_AT_ONCE)])
            asks, at = asks[good], at[good]
            if depth:
                at = (at[:, None] * LEAF + np.arange(LEAF)[None, :]).ravel()
                asks = np.repeat(asks, LEAF)
                inside = at < len(self.levels[depth - 1][0])
                asks, at = asks[inside], at[inside]
        return asks, self.order[at]

    def _near(self, depth: int, points: np.ndarray, sizes: np.ndarray, asks: np.ndarray, at: np.ndarray) -> np.ndarray:
        most, low, high = (x[at] for x in self.levels[depth])
        size = sizes[asks]
        # The smallest set below the node that is large enough needs the smallest overlap.
        least = np.maximum(low, -(-self.share * size // 100))
        enough = np.minimum(least_overlap(size, least, self.share), GROUPS * MOST_COUNT)
        good = (100 * high >= self.share * size) & (self.share * low <= 100 * size)
        i = np.flatnonzero(good)
        good[i] = np.minimum(most[i], points[asks[i]]).sum(1, dtype=np.int64) >= enough[i]
        return good


def frequent_table(docs: DataFrame, words: int) -> np.ndarray:
    """Bits of the n-grams that are frequent in a sample. Only the order of n-grams depends on it."""

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Shingler(words)
        for rows in batches:
            yield pd.DataFrame({"h": [own.shingles(t).view("<i8") for t in rows["text"]]})

    sample = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    counts = sample.mapInPandas(shingled, "h array<long>").select(F.explode("h").alias("h")).groupBy("h").count()
    often = counts.where(F.col("count") >= FREQUENT)
    bits = often.groupBy(F.col("h").bitwiseAND(F.lit(TABLE - 1)).alias("place")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 16) & 63 as int))")).alias("bits")
    )
    table = np.zeros(TABLE, dtype=np.uint64)
    for r in bits.collect():
        table[r["place"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    return table


def signed(docs: DataFrame, words: int, share: int) -> DataFrame:
    """Set size, digest, point, wide counts, smallest members, prefix and digest of the text of each document."""
    table = frequent_table(docs, words)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Shingler(words)
        for rows in batches:
            out = []
            for doc_id, text, tkey in zip(rows["doc_id"], rows["text"], rows["tkey"], strict=True):
                s = own.shingles(text)
                often = (table[(s & np.uint64(TABLE - 1)).astype(np.int64)] >> ((s >> np.uint64(16)) & np.uint64(63))) & np.uint64(1)
                first = s[np.argsort(often, kind="stable")][: prefix_length(len(s), share) if len(s) else 0]
                out.append((doc_id, len(s), same_set(s), point(s).tobytes(), wide_point(s), s[:LEADERS].view("<i8"), first.view("<i8"), tkey))
            frame = pd.DataFrame(out, columns=["doc_id", "n", "sid", "point", "wide", "least", "first", "tkey"])
            yield frame.astype({"doc_id": rows["doc_id"].dtype})

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, sid binary, point binary, wide binary, least array<long>, first array<long>, tkey binary"
    return docs.select("doc_id", "text", text_key("text").alias("tkey")).mapInPandas(sign, schema)


def texts_of(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(sid, text) of the given sets, of which (sid, tkey) names a text each; only these texts are shuffled."""
    named = docs.select(text_key("text").alias("tkey"), "text").where(may_be_in(sets, "tkey"))
    # Copies of a text are one row before they meet the sets.
    return kept(named.dropDuplicates(["tkey"]).join(sets, "tkey").select("sid", "text"), "texts")


def verified(pairs: DataFrame, texts: DataFrame, words: int, share: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    a, b = (texts.select(F.col("sid").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Shingler(words)
        for rows in batches:
            good = []
            for x, y in zip(rows["text_a"], rows["text_b"], strict=True):
                x, y = own.shingles(x), own.shingles(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= share * (len(x) + len(y) - both))
            yield rows.loc[np.array(good, dtype=bool), ["a", "b"]]

    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInPandas(check, "a binary, b binary")


def near_by_wide(pairs: DataFrame, classes: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) that may link by their wide counts, where both sets have these."""
    large = classes.where(F.length("wide") > 0)
    a, b = (large.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}")) for c in "ab")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            good = (rows["wide_a"].isna() | rows["wide_b"].isna()).to_numpy()
            large = rows[~good]
            sides = zip(large["n_a"].astype(int), large["n_b"].astype(int), large["wide_a"], large["wide_b"], strict=True)
            good[~good] = [wide_overlap(x, y) >= least_overlap(n, m, share) for n, m, x, y in sides]
            yield rows.loc[good, ["a", "b"]]

    return pairs.join(a, "a", "left").join(b, "b", "left").mapInPandas(near, "a binary, b binary")


def led_pairs(classes: DataFrame, share: int) -> DataFrame:
    """Pairs of each set with the leaders named by its smallest members: the most frequent set that has the member."""
    named = classes.select(F.explode("least").alias("h"), "sid", "n", "point", "copies")
    leader = F.max(F.struct("copies", "sid", "n", "point")).alias("led")
    leaders = named.groupBy("h").agg(leader, F.count(F.lit(1)).alias("n_led")).where("n_led > 1").drop("n_led")
    led = named.join(leaders, "h").where("sid <> led.sid")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            n, m = rows["n"].to_numpy(), rows["led_n"].to_numpy()
            good = may_link(points_of(rows["point"]), n, points_of(rows["led_point"]), m, share)
            yield rows.loc[good, ["a", "b"]]

    rows = led.select(
        F.col("led.sid").alias("a"), F.col("sid").alias("b"), "point", "n", F.col("led.point").alias("led_point"), F.col("led.n").alias("led_n")
    )
    return rows.mapInPandas(near, "a binary, b binary").distinct()


def tree_pairs(members: DataFrame, share: int, points: int = POINTS) -> DataFrame:
    """Pairs of sets of different groups that share a key and may link by the bound of a tree.

    ``members`` has (key, at, sid, component, n, point), where ``at`` is the key's place in the order of the set's members.
    A pair is put out by its first common member: members before it are in one set only, so that the overlap is
    at most what is left of either. Other keys put it out again, or not at all. Keys with more than ``points`` members are dealt to
    parts, and each pair of parts is a task's work.
    """
    large = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / points).cast("int").alias("parts")).where("parts > 1")
    # Few rows: one for each ``points`` members at the most.
    parts = F.coalesce("parts", F.lit(1))
    placed = members.join(kept(large, "large"), "key", "left").withColumn("parts", parts)
    placed = placed.withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = placed.select("key", "sid", "component", "n", "at", "point", "part", other)
    dealt = dealt.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    cell = F.xxhash64("key", "low", "high").alias("cell")
    dealt = dealt.select(cell, "sid", "component", "n", "at", "point", F.col("part") == F.col("low"), (F.col("low") == F.col("high")).alias("alone"))
    dealt = dealt.toDF("cell", "sid", "component", "n", "at", "point", "asks", "alone")

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        """The pairs of all cells among these rows, which are sorted by cell."""
        cell, asks, alone = (rows[c].to_numpy() for c in ("cell", "asks", "alone"))
        component = pd.factorize(rows["component"])[0]
        p, n = points_of(rows["point"]), rows["n"].to_numpy()
        left = n - rows["at"].to_numpy()
        starts = np.flatnonzero(np.diff(cell, prepend=cell[:1] - 1))
        ends = np.append(starts[1:], len(cell))
        found = []
        # Cells that fit a leaf are their own tree: their pairs are taken over all such cells at once.
        in_leaf = np.repeat(ends - starts <= LEAF, ends - starts)
        for step in range(1, LEAF):
            i = np.flatnonzero(in_leaf[:-step] & (cell[:-step] == cell[step:]) & (component[:-step] != component[step:]))
            i = i[alone[i] | (asks[i] != asks[i + step])]
            i = i[np.minimum(left[i], left[i + step]) >= least_overlap(n[i], n[i + step], share)]
            i = i[may_link(p[i], n[i], p[i + step], n[i + step], share)]
            found.append((i, i + step))
        for start, end in zip(starts, ends, strict=True):
            if end - start > LEAF:
                inside = np.arange(start, end)
                asking, sought = (inside, inside) if alone[start] else (inside[asks[inside]], inside[~asks[inside]])
                if len(asking) and len(sought):
                    a, b = CountTree(p[sought], n[sought], share).search(p[asking], n[asking])
                    a, b = asking[a], sought[b]
                    good = (component[a] != component[b]) & (np.minimum(left[a], left[b]) >= least_overlap(n[a], n[b], share))
                    found.append((a[good], b[good]))
        a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        sid = rows["sid"].to_numpy()
        pairs = {(min(x, y), max(x, y)) for x, y in zip(sid[a], sid[b], strict=True)}
        return pd.DataFrame(list(pairs), columns=["a", "b"], dtype=object)

    def by_cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by cell; a cell has 2 * points rows at most, about."""
        held = None
        for rows in batches:
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            ended = rows["cell"] != rows["cell"].iloc[-1]
            held = rows[~ended].reset_index(drop=True)
            if ended.any():
                yield search(rows[ended].reset_index(drop=True))
        if held is not None and len(held):
            yield search(held)

    in_order = dealt.repartition("cell").sortWithinPartitions("cell")
    return in_order.mapInPandas(by_cell, "a binary, b binary").distinct()


def similar_groups(docs: DataFrame, words: int = WORDS, share: int = SHARE, points: int = POINTS) -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set), component_id.

    The component's id is the smallest doc_id that links lead to, itself included. Documents
    without words link with nothing. Null texts are empty; null ids never name a component unless all
    its ids are null. Ids are integers, or digests of bytes. Repeated rows each have a row. ``share`` is in hundredths.
    """
    importable(docs.sparkSession)
    # Python workers only run while tables are kept, not for the result.
    with configured(docs.sparkSession, BATCH, str(BATCH_ROWS)):
        return grouped(docs, words, share, points)


def grouped(docs: DataFrame, words: int, share: int, points: int) -> DataFrame:
    """The rows of ``similar_groups``."""
    doc_id = F.col("doc_id") if docs.schema["doc_id"].dataType == BinaryType() else F.col("doc_id").cast("long")
    docs = docs.select(doc_id.alias("doc_id"), whole("text").alias("text"))
    described = kept(signed(docs, words, share), "signed")
    classes = described.where("n > 0").groupBy("sid").agg(
        F.count(F.lit(1)).alias("copies"),
        *(F.any_value(c).alias(c) for c in ("n", "point", "wide", "least", "first")),
        F.min("tkey").alias("tkey"),
    )
    classes = kept(classes, "classes")
    # Of a document only its set is asked again; what describes a set is in its class.
    known = kept(described.select("doc_id", "n", "sid"), "known")
    dropped(described)

    def links(pairs: DataFrame) -> DataFrame:
        pairs = kept(pairs, "pairs")
        sids = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        sets = kept(classes.select("sid", "tkey").join(sids, "sid", "left_semi"), "sets")
        texts = texts_of(docs, sets)
        found = kept(verified(pairs, texts, words, share), "links")
        dropped(pairs, sets, texts)
        return found

    first_links = links(led_pairs(classes, share))
    components = linked_groups(first_links, "a", "b").select(F.col("node").alias("sid"), F.col("group").alias("component"))
    components = kept(components, "components")
    # Only sets that may be in a group are shuffled to find it.
    maybe = may_be_in(components, "sid")
    columns = ["sid", "n", "point", "first"]
    joined = classes.where(maybe).select(*columns).join(components, "sid", "left")
    joined = joined.withColumn("component", F.coalesce("component", "sid"))
    alone = classes.where(~maybe).select(*columns, F.col("sid").alias("component"))
    in_groups = kept(joined.unionByName(alone), "groups")
    # Points and prefixes are read from the groups from here on.
    wide = kept(classes.select("sid", "n", "wide", "tkey"), "wide")
    dropped(components, classes)
    classes = wide
    narrow = in_groups.select(F.explode("first").alias("key"), F.xxhash64("component").alias("c"))
    contested = narrow.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    contested = kept(contested.select("key"), "contested")
    members = in_groups.select("sid", "component", "n", "point", F.posexplode("first").alias("at", "key")).where(may_be_in(contested, "key"))
    more_links = links(near_by_wide(tree_pairs(members, share, points), classes, share))
    dropped(classes, in_groups, contested)

    groups = linked_groups(first_links.unionByName(more_links), "a", "b")
    groups = known.where("n > 0").join(groups, F.col("sid") == F.col("node"), "left")
    groups = groups.select("doc_id", "n", F.coalesce("group", "sid").alias("group"))
    names = groups.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    linked = groups.join(names, "group").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = known.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
