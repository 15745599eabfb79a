"""The trie of all beginnings of conversations, with counts and sums for every node.

Conversations are sorted by the digests of their turns and dealt out in that order. A node's members then
lie next to each other, so a task finishes every node in one pass over its rows, but for the nodes that its
neighbours share. Those are exactly the beginnings of the splitters, the rows at which tasks begin. The
splitters are broadcast (one a task); a task puts out partial results for the nodes on their paths, the
skeleton, and these are added up by node. Anything a skeleton node must count once (its own bytes, itself as
a child or as a leaf) is counted by the one task that the splitters single out.

A conversation is cut into segments of ``SEGMENT`` turns, so that no row, path or splitter grows with one. A
segment's trie hangs below the node where the segment before it ended; what lies below is summed first, credited
to the smallest conversation that passes there, and handed up as running sums over segments. The number of
passes is two however long a conversation is, and one if none is longer than a segment.

Defined cases. Rows without a ``conv_id`` belong to no conversation and take no part. Turns go by ``turn``,
nulls first, ties by role and text; null role and text are empty. Repeated rows are repeated turns. An
empty table has no nodes. Columns of other names are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywarden.llm.common import importable, kept
from tallywarden.plans.ordered import ordering, running_sums
from tallywarden.plans.skew import BROADCAST_ROWS, ROWS_PER_TASK, join_sized, match
from tallywarden.session import written

# Turns of a segment: the longest path that a row holds.
SEGMENT = 512
# Bytes of a turn's digest in a path.
KEY = 16
# Characters of member ids that one row carries.
IDS_PER_ROW = 1 << 16
# Of the query: a conversation takes over the first turns of the one whose id ends its block of so many.
BLOCK, MOST_BORROWED = 5, 8

PATH_ORDER = ["seg", "root", "path", "more", "conv_id"]
# What a task puts out: a finished node with its parent's id, one whose parent is in the skeleton, a part of
# a skeleton node, and member ids of one.
FINISHED, OPEN, PART, IDS = range(4)
OUTPUT = (
    "kind int, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string, key string, parent_key string, next_key string, ids string"
)
NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NOBODY = hashlib.sha256(b"").hexdigest()


def numbered_turns(turns: DataFrame, limit: int = ROWS_PER_TASK) -> DataFrame:
    """conv_id, n (from 1), key (digest of role and text) and size (UTF-8 bytes of the text) of every turn.

    Texts stay where they are read, but for turns of one conversation with the same number: these are compared
    by role and text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id",
        "turn",
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit("|"), role, text))).alias("key"),
        F.octet_length(text).cast("bigint").alias("size"),
        role.alias("_role"),
        text.alias("_text"),
    )
    ties = kept(said.groupBy("conv_id", "turn").count().where("count > 1").select("conv_id", "turn", F.lit(True).alias("_tied")), "ties")
    order = ["turn"]
    if not ties.isEmpty():
        marked = match(said, ties, ["conv_id", "turn"], "left")
        said = marked.withColumns({c: F.when(F.col("_tied"), F.col(c)) for c in ("_role", "_text")}).drop("_tied")
        order = ["turn", "_role", "_text"]
    else:
        said = said.drop("_role", "_text")
    by = ordering(said, ["conv_id"], order, limit)
    return kept(running_sums(said, by, {"n": F.lit(1)}).select("conv_id", F.col("n").cast("bigint").alias("n"), "key", "size"), "turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of their block's first one, as (items, lengths).

    Conversation c takes the first h turns of c - c % BLOCK, or as many as there are, then its own after its
    first h; h is the checksum of its decimal id modulo MOST_BORROWED + 1.
    """
    sizes = kept(turns.groupBy("conv_id").agg(F.max("n").alias("own")), "lengths")
    named = sizes.select(
        "conv_id",
        "own",
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_BORROWED + 1)).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"),
    )
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    lengths = kept(
        named.join(bases, "base", "left").select(
            "conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")
        ),
        "rebuilt",
    )
    later = turns.join(lengths, "conv_id").where(F.col("n") > F.col("h"))
    first = turns.where((F.col("n") <= MOST_BORROWED) & (F.col("conv_id") % BLOCK == 0)).withColumnRenamed("conv_id", "base")
    borrowed = lengths.join(first, "base").where(F.col("n") <= F.col("taken"))
    items = later.select("conv_id", (F.col("n") - F.col("h") + F.col("taken")).alias("pos"), "key", "size", "length").unionByName(
        borrowed.select("conv_id", F.col("n").alias("pos"), "key", "size", "length")
    )
    return items, lengths.select("conv_id", "length")


def segments(items: DataFrame, lengths: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, bool]:
    """A row for each ``segment`` turns of a conversation, and whether any conversation has several.

    ``root`` stands for all turns before the segment: sums of position-bound digests, 120 bits. ``more`` tells
    that the conversation goes on; ``next_root`` is then the root of its next segment.
    """
    seg = F.floor((F.col("pos") - 1) / segment).cast("bigint")
    together = F.array_sort(F.collect_list(F.struct("pos", "key", "size")))
    grouped = items.groupBy("conv_id", seg.alias("seg")).agg(together.alias("_turns"), F.max("length").alias("length"))
    filled = grouped.select(
        "conv_id",
        "seg",
        F.unhex(F.array_join(F.transform("_turns", lambda x: F.hex(x["key"])), "")).alias("path"),
        F.col("_turns.size").alias("sizes"),
        ((F.col("seg") + 1) * segment < F.col("length")).alias("more"),
    )
    silent = lengths.where("length = 0").select(
        "conv_id",
        F.lit(0).cast("bigint").alias("seg"),
        F.lit(b"").alias("path"),
        F.array().cast("array<bigint>").alias("sizes"),
        F.lit(False).alias("more"),
    )
    rows = filled.unionByName(silent)
    zero = {"below_leaves": F.lit(0).cast("bigint"), "below_saved": F.lit(0).cast("bigint")}
    if (lengths.agg(F.max("length")).first()[0] or 0) <= segment:
        return rows.withColumns({"root": F.lit(""), "next_root": F.lit(None).cast("string"), **zero}), False
    digest = F.md5(F.concat(F.col("seg").cast("string"), F.lit("|"), F.hex("path")))
    upto = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")).over(upto) for at in (1, 16)]
    known = rows.withColumn("_upto", F.concat_ws("|", *(s.cast("string") for s in sums)))
    earlier = F.lag("_upto").over(Window.partitionBy("conv_id").orderBy("seg"))
    named = known.withColumns({"root": F.coalesce(earlier, F.lit("")), "next_root": F.when(F.col("more"), F.col("_upto"))})
    return named.drop("_upto").withColumns(zero), True


def node_key(seg: int, root: str, path: bytes) -> str:
    return hashlib.md5(f"{seg}|{root}|".encode() + path).hexdigest()


def key_of(seg: Column, root: Column) -> Column:
    """``node_key`` of the node that a segment hangs below."""
    return F.md5(F.concat(seg.cast("string"), F.lit("|"), root, F.lit("|")))


class Node:
    """A node on the path being read. In the skeleton, all sums are this task's part of them."""

    __slots__ = ("depth", "convs", "least", "size", "children", "longer", "leaves", "saved", "more", "sha", "waiting", "key", "on", "ids", "first")

    def __init__(self, depth: int, size: int, on: tuple[bool, bool, bool], key: str | None):
        self.depth, self.size, self.on, self.key = depth, size, on, key
        self.convs = self.children = self.leaves = self.saved = 0
        self.least = self.more = self.sha = self.first = None
        self.longer = False
        self.waiting: list[tuple] = []
        self.ids: list[str] = []


class Shard:
    """One pass over the sorted rows of a task.

    ``before``, ``own`` and ``after`` are the splitters of the task before, this task and the next one, each
    (seg, root, path) or None. Held in memory are the nodes of one path, and finished children of nodes that lie
    wholly in this task.
    """

    def __init__(self, before, own, after, segment: int):
        self.splitters, self.segment = (before, own, after), segment
        self.group = self.path = None
        self.stack: list[Node] = []
        self.out: list[tuple] = []

    def on_splitters(self, node: Node, step: bytes) -> tuple[bool, ...]:
        """Which of the three splitters begin with the child of ``node`` at ``step``."""
        at = node.depth * KEY
        return tuple(known and s[2][at : at + KEY] == step for known, s in zip(node.on, self.splitters, strict=True))

    def read(self, seg, root, path, more, conv, sizes, next_root, below_leaves, below_saved) -> None:
        shared = 0
        if self.group != (seg, root):
            self.close(-1)
            self.group = (seg, root)
            on = tuple(s is not None and s[:2] == self.group for s in self.splitters)
            self.stack.append(Node(0, 0, on, node_key(seg, root, b"")))
        else:
            most = min(len(path), len(self.path))
            while shared < most and path[shared : shared + KEY] == self.path[shared : shared + KEY]:
                shared += KEY
            self.close(shared // KEY)
        for at in range(shared, len(path), KEY):
            on = self.on_splitters(self.stack[-1], path[at : at + KEY])
            key = node_key(seg, root, path[: at + KEY]) if on[1] or on[2] else None
            self.stack[-1].longer = True
            self.stack.append(Node(at // KEY + 1, sizes[at // KEY], on, key))
        self.path = path
        node = self.stack[-1]
        node.convs += 1
        node.least = conv if node.least is None else min(node.least, conv)
        node.leaves += below_leaves
        node.saved += below_saved
        if more:
            node.more = node_key(seg + 1, next_root, b"")
        elif node.key:
            if node.first is None:
                node.first = conv
            node.ids.append(str(conv))
            if len(node.ids) * 8 > IDS_PER_ROW:
                self.put_ids(node)
        elif node.sha is None:
            node.sha = hashlib.sha256(str(conv).encode())
        else:
            node.sha.update(f",{conv}".encode())

    def put(self, kind, node, parent_conv, children, leaves, saved, ends, key, parent_key, ids=None) -> tuple:
        depth = self.group[0] * self.segment + node.depth
        return (kind, depth, node.least, parent_conv, node.convs, children, leaves, saved, ends, key, parent_key, node.more, ids)

    def put_ids(self, node: Node) -> None:
        if node.ids:
            self.out.append((IDS, None, node.first, *[None] * 6, node.key, None, None, ",".join(node.ids)))
            node.ids, node.first = [], None

    def close(self, depth: int) -> None:
        """Finish all nodes below ``depth``."""
        while self.stack and self.stack[-1].depth > depth:
            node = self.stack.pop()
            parent = self.stack[-1] if self.stack else None
            childless = not node.longer and not node.more
            if node.key:
                before, own, after = node.on
                once = not before if own else not after
                leaves = node.leaves + (childless and not after)
                saved = node.saved + (node.convs - once) * node.size
                self.put_ids(node)
                self.out.append(self.put(PART, node, None, node.children, leaves, saved, None, node.key, parent.key if parent else None))
            else:
                once = True
                leaves, saved = node.leaves + childless, node.saved + (node.convs - 1) * node.size
                ends = node.sha.hexdigest() if node.sha else NOBODY
                self.out += [(FINISHED, r[1], r[2], node.least, *r[4:]) for r in node.waiting]
                row = self.put(OPEN, node, None, node.children, leaves, saved, ends, None, parent.key)
                (self.out if parent.key else parent.waiting).append(row)
            if parent:
                parent.children += once
                parent.convs += node.convs
                parent.least = node.least if parent.least is None else min(parent.least, node.least)
                parent.leaves += leaves
                parent.saved += saved


def local_tries(rows: DataFrame, segment: int) -> DataFrame:
    """Sort segments, deal them out by range and read each task's trie; rows as in ``OUTPUT``."""
    spark = rows.sparkSession
    importable(spark)
    # A checkpoint keeps the partitions and their order, and so the splitters.
    ranged = written(rows.repartitionByRange(*PATH_ORDER).sortWithinPartitions(*PATH_ORDER))
    shard = F.spark_partition_id().alias("shard")
    # One row a task, of at most a segment's path.
    firsts = ranged.groupBy(shard).agg(F.min(F.struct(*PATH_ORDER)).alias("first")).orderBy("shard").collect()
    splitters = [(r["first"]["seg"], r["first"]["root"], bytes(r["first"]["path"])) for r in firsts]
    place = {r["shard"]: i for i, r in enumerate(firsts)}
    shared = spark.sparkContext.broadcast((splitters, place))
    names = ["seg", "root", "path", "more", "conv_id", "sizes", "next_root", "below_leaves", "below_saved"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters, place = shared.value
        types = [pa.int32()] + [pa.int64()] * 7 + [pa.string()] * 5
        schema = pa.schema(list(zip(NAMES, types, strict=True)))
        task = None

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*task.out, strict=True)) or [[]] * len(NAMES)
            task.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema=schema)

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", *names)]
            for shard, *row in zip(*columns, strict=True):
                if task is None:
                    at = place[shard]
                    task = Shard(*(splitters[i] if 0 <= i < len(splitters) else None for i in (at - 1, at, at + 1)), segment)
                task.read(*row)
                if len(task.out) >= 10_000:
                    yield flushed()
        if task is not None:
            task.close(-1)
            yield flushed()

    return kept(ranged.select(shard, *names).mapInArrow(read, OUTPUT), "tries")


def ends_digests(ids: DataFrame) -> DataFrame:
    """Digest of all member ids of each skeleton node that ended there, ascending.

    A digest is made in order by its nature; rows of many ids stream through it in bounded memory.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            done = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        done.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            yield pa.RecordBatch.from_pydict({"key": pa.array([d[0] for d in done], pa.string()), "ends": pa.array([d[1] for d in done], pa.string())})
        if key is not None:
            yield pa.RecordBatch.from_pydict({"key": [key], "ends": [sha.hexdigest()]})

    in_order = ids.select("key", "conv_id", "ids").repartition("key").sortWithinPartitions("key", "conv_id")
    return in_order.mapInArrow(read, "key string, ends string")


def reduced(tries: DataFrame) -> DataFrame:
    """Skeleton nodes, added up from the tasks' parts."""
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    return (
        tries.where(F.col("kind") == PART)
        .groupBy("key")
        .agg(
            F.max("depth").alias("depth"),
            F.min("conv_id").alias("conv_id"),
            *(F.sum(c).alias(c) for c in sums),
            F.max("parent_key").alias("parent_key"),
            F.max("next_key").alias("next_key"),
        )
    )


def with_below(rows: DataFrame, tries: DataFrame) -> DataFrame:
    """Give every segment the leaves and savings below its end that its conversation is credited with."""
    stubs = reduced(tries).where(F.col("parent_key").isNull() & (F.col("depth") > 0))
    credit = stubs.select("key", "conv_id", F.col("n_leaves").alias("_leaves"), F.col("saved_tokens").alias("_saved"))
    placed = rows.withColumn("key", key_of(F.col("seg"), F.col("root"))).join(credit, ["key", "conv_id"], "left").drop("key")
    later = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(1, Window.unboundedFollowing)
    given = {c: F.coalesce(F.sum(f"_{c}").over(later), F.lit(0)).cast("bigint") for c in ("leaves", "saved")}
    return placed.withColumns({f"below_{c}": x for c, x in given.items()}).drop("_leaves", "_saved")


def prefix_trie(items: DataFrame, lengths: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row for each distinct beginning of the sequences: the columns of ``NODE``.

    ``items`` has conv_id, pos (from 1, without gaps), key (16 bytes), size and length; ``lengths`` has each
    conv_id with its number of items, 0 included.
    """
    rows, deep = segments(items, lengths, segment)
    rows = kept(rows, "segments")
    if deep:
        rows = kept(with_below(rows, local_tries(rows, segment)), "credited")
    tries = local_tries(rows, segment)
    skeleton = kept(reduced(tries), "skeleton")
    small = skeleton.count() <= BROADCAST_ROWS
    # Below a segment's end the nodes' parents are those that the segment before put out.
    stub = F.col("parent_key").isNull() & (F.col("depth") > 0)
    names = skeleton.where(~stub).select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    if deep:
        ends = tries.where(F.col("kind").isin(FINISHED, OPEN)).select("next_key", "conv_id").unionByName(skeleton.select("next_key", "conv_id"))
        names = names.unionByName(ends.where("next_key IS NOT NULL").select(F.col("next_key").alias("parent_key"), F.col("conv_id").alias("_parent")))
    columns = [*NODE, "next_key"]
    finished = tries.where(F.col("kind") == FINISHED).select(*columns)
    waiting = join_sized(tries.where(F.col("kind") == OPEN), names, ["parent_key"], small and not deep)
    shared = join_sized(skeleton.where(~stub), names, ["parent_key"], small and not deep, "left").join(
        ends_digests(tries.where(F.col("kind") == IDS)), "key", "left"
    )
    nodes = (
        finished.unionByName(waiting.withColumn("parent_conv_id", F.col("_parent")).select(*columns)).unionByName(
            shared.withColumns({"parent_conv_id": F.col("_parent"), "ends_sha256": F.coalesce("ends", F.lit(NOBODY))}).select(*columns)
        )
    )
    if deep:
        below = skeleton.where(stub).select(F.col("key").alias("next_key"), F.col("n_children").alias("_more"))
        joined = nodes.join(below, "next_key", "left")
        nodes = joined.withColumn("n_children", F.col("n_children") + F.coalesce("_more", F.lit(0)))
    return nodes.select(*NODE)


def rebuilt_trie(turns: DataFrame, segment: int = SEGMENT, limit: int = ROWS_PER_TASK) -> DataFrame:
    """The trie of a log's conversations after ``rebuilt``."""
    return prefix_trie(*rebuilt(numbered_turns(turns, limit)), segment)
