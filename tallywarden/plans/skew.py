"""Finding keys that are too large for one task, and cutting them into blocks.

A window or a sort puts all rows of a key into one task. That is right for most
keys and wrong for a key that holds a large share of the table, so the row
counts are looked at first. If no key is large, the plain window is used. If
some are, their rows are cut at sampled values of the ordering columns. The cut
points are plain values by the time the plan is built, so every use of them,
and every retried task, sees the same blocks.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Row, Window, functions as F

# Rows of one key that a single task may sort.
ROWS_PER_TASK = 5_000_000
# Above this many rows a per-key table is joined by shuffle, not broadcast.
BROADCAST_ROWS = 100_000
# Tables of large keys or cuts above this size are joined by shuffle as well.
BROADCAST_BYTES = 64 << 20
# Sampled rows per cut.
SAMPLES_PER_PIECE = 20

BLOCK = "_block"


@dataclass(frozen=True)
class KeyProfile:
    """Row counts of a table by key, and the keys above the limit."""

    rows: int
    groups: int
    hot: list[Row] = field(default_factory=list)


def key_profile(df: DataFrame, keys: list[str], limit: int = ROWS_PER_TASK) -> KeyProfile:
    """Count rows by key and list the keys with more rows than one task should hold.

    The list has fewer than rows / limit entries, whatever the table looks like.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    seen = counts.agg(
        F.sum("_rows").alias("rows"), F.count(F.lit(1)).alias("groups"), F.max("_rows").alias("largest")
    ).first()
    rows, largest = seen["rows"] or 0, seen["largest"] or 0
    if largest <= limit:
        return KeyProfile(rows, seen["groups"])
    return KeyProfile(rows, seen["groups"], counts.where(F.col("_rows") > limit).collect())


def match(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equality join that keeps only the left side's key columns."""
    other = other.withColumnsRenamed({k: f"_other_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys])
    joined = df.join(other, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*(f"_other_{k}" for k in keys))


def join_small(df: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join with a table whose row count the caller has bounded."""
    return match(df, F.broadcast(small), keys, how)


def fits(rows: list) -> bool:
    """Whether a table of these rows, held by the driver, is small enough to broadcast."""
    return len(rows) <= BROADCAST_ROWS and sum(len(repr(r)) for r in rows) <= BROADCAST_BYTES


def join_sized(df: DataFrame, other: DataFrame, keys: list[str], small: bool, how: str = "inner") -> DataFrame:
    """Broadcast a table that was found small; else shuffle, where Spark splits skewed partitions."""
    return join_small(df, other, keys, how) if small else match(df, other, keys, how)


def split_hot(df: DataFrame, keys: list[str], profile: KeyProfile) -> tuple[DataFrame, DataFrame]:
    """The rows of ordinary keys and those of large keys."""
    names = [tuple(r[k] for k in keys) for r in profile.hot]
    hot = df.sparkSession.createDataFrame(names, df.select(*keys).schema)
    small = fits(names)
    return join_sized(df, hot, keys, small, "left_anti"), join_sized(df, hot, keys, small, "left_semi")


def attach(df: DataFrame, per_key: DataFrame, keys: list[str], profile: KeyProfile) -> DataFrame:
    """Add per-key columns.

    With few keys they are broadcast. With many, the join shuffles by key, but
    the rows of large keys stay where they are and get their few keys broadcast.
    """
    if profile.groups <= BROADCAST_ROWS:
        return join_small(df, per_key, keys)
    if not profile.hot:
        return match(df, per_key, keys)
    ordinary, large = split_hot(df, keys, profile)
    few, some = split_hot(per_key, keys, profile)
    return match(ordinary, few, keys).unionByName(join_sized(large, some, keys, fits(profile.hot)))


@dataclass(frozen=True)
class Cuts:
    """Where large keys are cut, and whether tables of one row per key or block may be broadcast."""

    table: DataFrame
    small: bool


def cut_points(df: DataFrame, keys: list[str], order: list[str], limit: int = ROWS_PER_TASK) -> Cuts | None:
    """For each large key, the sorted ordering values at which to cut it; None if no key is large.

    There are at most about rows / limit cuts in all, which is what the driver holds. ``_cuts`` holds the values in chunks of ``_width``, so that a row finds its
    place by looking through the chunk heads and then through one chunk.
    """
    hot = key_profile(df, keys, limit).hot
    if not hot:
        return None
    spark = df.sparkSession
    names = [tuple(r[k] for k in keys) for r in hot]
    some = df.select(*keys, F.struct(*order).alias("_at")).where(F.rand(11) < SAMPLES_PER_PIECE / limit)
    sampled = join_sized(some, spark.createDataFrame(names, df.select(*keys).schema), keys, fits(names))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_at"))
    picked = (
        sampled.withColumn("_nth", nth)
        .where(F.col("_nth") % SAMPLES_PER_PIECE == 0)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set("_at")).alias("_cuts"))
    )
    rows = []
    for r in picked.collect():
        cuts = r["_cuts"]
        width = max(1, round(len(cuts) ** 0.5))
        chunks = [cuts[i : i + width] for i in range(0, len(cuts), width)]
        rows.append((*(r[k] for k in keys), chunks, width))
    if not rows:
        return None
    schema = df.select(*keys, F.array(F.array(F.struct(*order))).alias("_cuts")).schema
    # Totals per block have one more row per key than there are cuts.
    blocks = [cut for r in rows for chunk in r[-2] for cut in chunk] + rows
    return Cuts(spark.createDataFrame(rows, schema.add("_width", "integer")), fits(blocks))


def with_blocks(df: DataFrame, keys: list[str], order: list[str], cuts: Cuts) -> DataFrame:
    """Add the block number of each row; keys that are not cut are one block, 0."""
    at = F.struct(*order)
    joined = join_sized(df, cuts.table, keys, cuts.small, "left")
    chunk = F.size(F.filter("_cuts", lambda c: c[0] <= at))
    inside = F.size(F.filter(F.get("_cuts", chunk - 1), lambda c: c <= at))
    number = F.when(F.coalesce(chunk, F.lit(0)) <= 0, 0).otherwise((chunk - 1) * F.col("_width") + inside)
    cut = F.col("_cuts").isNotNull().alias("_cut")
    return joined.select("*", number.alias(BLOCK), cut).drop("_cuts", "_width")
