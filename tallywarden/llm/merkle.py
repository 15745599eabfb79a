"""A manifest of a dataset: one hash tree per part, one over the parts, and a proof for every row.

Nodes of a tree are numbered from 0 and met in runs of ``ARITY``. Within a run, lag and lead at fixed
offsets, masked by the node's slot and the run's length, supply the siblings, and the first child hashes
the parent. A tree's levels shrink by ``ARITY``, so all levels together cost little more than the first.
Proofs are put together from the top down: a node's path is its siblings followed by its parent's path.

Defined cases. A null part is a part of its own, ordered first; null columns hash as ``-``. Null ids come
first. Rows of one id go by their leaf, so equal rows are interchangeable and each keep a row. An empty
table has no rows and no root. Columns of other names are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywarden.llm.common import kept

ARITY = 8
# Columns of a row that its leaf covers, in this order.
COVERED = ("doc_id", "source", "lang", "n_chars", "text")
SIDES = "struct<left:string,right:string>"


def hashed(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of texts joined without a separator; null parts are left out."""
    return F.sha2(F.concat(*(F.coalesce(p, F.lit("")) for p in parts)), 256)


def field(value: Column) -> Column:
    """A value as it enters a leaf: byte count and text, so that neighbours can't run together."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**values: Column) -> Column:
    """Hash of the covered columns; ``values`` replaces some of them."""
    return hashed(*(field(values.get(c, F.col(c))) for c in COVERED))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Number the rows of each ``tree`` from 0 in the given order, as ``pos``.

    Rows are dealt out by range, so a tree may span any number of tasks and no window holds one whole.
    Equal rows are told apart by where they were read, which splits them over tasks as well. What came
    before a task's rows is a table of one row for each task and tree in it.
    """
    placed = rows.withColumn("_read", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange("tree", *order, "_read").sortWithinPartitions("tree", *order, "_read")
    # Ids rise by one from row to row of a partition, from its number times 2^33.
    stored = kept(ranged.drop("_read").withColumn("_at", F.monotonically_increasing_id()), "numbered")
    task = F.shiftright("_at", 33).alias("_task")
    pieces = stored.groupBy("tree", task).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("tree").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("tree", "_task", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    joined = stored.withColumn("_task", task).join(starts, ["tree", "_task"])
    return joined.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_task", "_shift")


def with_siblings(level: DataFrame) -> DataFrame:
    """Add ``run``, ``slot``, ``left`` and ``right`` (a run's nodes before and after this one) and ``top``.

    ``top`` marks a tree's only node: it is no run of one but the tree's root.
    """
    in_run = Window.partitionBy("tree", "run")
    in_order = in_run.orderBy("pos")
    offsets = range(1, ARITY)
    placed = level.withColumns({"run": F.floor(F.col("pos") / ARITY).cast("bigint"), "slot": F.col("pos") % ARITY})
    seen = placed.select(
        "*",
        F.count(F.lit(1)).over(in_run).alias("length"),
        *(F.lag("node", j).over(in_order).alias(f"lag{j}") for j in offsets),
        *(F.lead("node", j).over(in_order).alias(f"lead{j}") for j in offsets),
    )
    before = [F.when(F.col("slot") >= j, F.col(f"lag{j}")) for j in reversed(offsets)]
    after = [F.when(F.col("slot") + j < F.col("length"), F.col(f"lead{j}")) for j in offsets]
    return seen.select(
        *level.columns,
        "run",
        "slot",
        F.concat(*(F.coalesce(x, F.lit("")) for x in before)).alias("left"),
        F.concat(*(F.coalesce(x, F.lit("")) for x in after)).alias("right"),
        ((F.col("run") == 0) & (F.col("length") == 1)).alias("top"),
    )


def parents(siblings: DataFrame) -> DataFrame:
    """The next level: first children hash their runs."""
    first = siblings.where((F.col("slot") == 0) & ~F.col("top"))
    return first.select("tree", F.col("run").alias("pos"), hashed(F.col("node"), F.col("right")).alias("node"))


@dataclass(frozen=True)
class Forest:
    """Trees by level, lowest first. ``roots`` has tree, node and ``height``, the level where it stands alone."""

    levels: list[DataFrame]
    roots: DataFrame


def grown(leaves: DataFrame) -> Forest:
    """Hash numbered nodes (tree, pos, node) upwards until every tree has one node left.

    Levels above the first are stored; their number is the logarithm of the largest tree's size.
    """
    largest = leaves.agg(F.max("pos")).first()[0]
    nodes, levels, roots = (largest + 1 if largest is not None else 0), [leaves.select("tree", "pos", "node")], []
    while True:
        here = with_siblings(levels[-1])
        roots.append(here.where("top").select("tree", "node", F.lit(len(levels) - 1).alias("height")))
        if nodes <= 1:
            break
        levels.append(kept(parents(here), "level"))
        nodes = -(-nodes // ARITY)
    together = roots[0]
    for more in roots[1:]:
        together = together.unionByName(more)
    return Forest(levels, kept(together, "roots"))


def own_sides() -> Column:
    return F.when(F.col("top"), F.array().cast(f"array<{SIDES}>")).otherwise(F.array(F.struct("left", "right")))


def paths(forest: Forest, above: DataFrame, leaves: DataFrame) -> DataFrame:
    """Add ``path`` to numbered leaves: the siblings met on the way up, one entry a level.

    ``above`` has tree, height, ``path`` beyond the tree's root, and columns to hand down to every leaf. Parents
    are joined by the run that their children were dealt out by, so the rows of a level move once.
    """
    handed = [c for c in above.columns if c not in ("tree", "height", "path")]
    known = None
    for height in range(len(forest.levels) - 1, -1, -1):
        over = above.where(F.col("height") == height).select("tree", F.lit(0).cast("bigint").alias("run"), F.col("path").alias("_path"), *handed)
        if known is not None:
            over = over.unionByName(known.select("tree", F.col("pos").alias("run"), F.col("path").alias("_path"), *handed))
        level = with_siblings(leaves if height == 0 else forest.levels[height])
        known = level.join(over, ["tree", "run"]).withColumn("path", F.concat(own_sides(), "_path")).drop("_path")
    return known.drop("run", "slot", "left", "right", "top")


def proof_digest(path: Column) -> Column:
    """Hash of all siblings, level by level from the leaf, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, node, lambda found, s: F.sha2(F.concat(s["left"], found, s["right"]), 256))


def manifest(docs: DataFrame, checked: Column | None = None) -> DataFrame:
    """One row for each document: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    A tree for each ``lang``, rows ascending by ``doc_id``; its root is the subroot. The subroots, ordered by
    ``lang``, make the tree of the root. ``checked`` is the text to verify in place of the stored one, by
    default the same: ``folded_root`` comes from its leaf and the manifest's siblings, ``verified`` tells
    whether that is the root. Only the ids and two hashes of a row are shuffled, never its text.
    """
    part = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))  # null first, then by bytes
    leaves = docs.select(
        "doc_id", part.alias("tree"), leaf().alias("node"), (leaf() if checked is None else leaf(text=checked)).alias("_checked")
    )
    # Hex is half as long as bytes; a row that was not changed needs one hash.
    changed = F.when(F.col("_checked") != F.col("node"), F.unhex("_checked"))
    slim = leaves.select("doc_id", "tree", F.unhex("node").alias("node"), changed.alias("_checked"))
    rows = numbered(slim, ["doc_id", "node"]).withColumn("node", F.lower(F.hex("node")))
    parts = grown(rows)
    subroots = numbered(parts.roots.select(F.lit("").alias("tree"), F.col("tree").alias("_part"), "height", "node"), ["_part"])
    whole = grown(subroots)
    top = whole.roots.select("tree", "height", F.col("node").alias("root"), F.array().cast(f"array<{SIDES}>").alias("path"))
    upper = paths(whole, top, subroots.withColumnRenamed("height", "_height"))
    over = kept(upper.select(F.col("_part").alias("tree"), F.col("_height").alias("height"), F.col("node").alias("subroot"), "root", "path"), "subroots")
    proved = paths(parts, over, rows)
    told = F.coalesce(F.lower(F.hex("_checked")), F.col("node"))
    found = proved.select(
        "doc_id",
        F.col("node").alias("leaf"),
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        folded(told, F.col("path")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered(docs: DataFrame) -> Column:
    """The text, lower-cased where 3 divides the checksum of the decimal ``doc_id``; rows without an id are left alone."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return F.when(hit, lower_ascii(F.col("text"))).otherwise(F.col("text"))
