"""Ordered calculations per key that hold up when one key is most of the table.

Each function gives exactly what the plain window would. The ordering columns
must make the rows of a key unique, otherwise the result depends on chance.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tallywarden.plans.skew import BLOCK, ROWS_PER_TASK, Cuts, cut_points, join_sized, key_profile, with_blocks


@dataclass(frozen=True)
class Ordering:
    """Rows by key in order, with the cuts of the keys too large for one task, if any."""

    keys: list[str]
    order: list[str]
    cuts: Cuts | None = None

    def window(self, *more_keys: str) -> WindowSpec:
        return Window.partitionBy(*self.keys, *more_keys).orderBy(*self.order)

    def through_blocks(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def ordering(df: DataFrame, keys: list[str], order: list[str], limit: int = ROWS_PER_TASK) -> Ordering:
    """Look at the row counts of ``df`` and cut its large keys.

    The result also serves tables derived from ``df`` row by row.
    """
    return Ordering(keys, order, cut_points(df, keys, order, limit))


def running_sums(df: DataFrame, by: Ordering, sums: dict[str, Column]) -> DataFrame:
    """Add running sums up to and including each row.

    A sum is null before the first known value. Large keys are summed block by block. What came before a block is the sum of
    the earlier block totals, a table no longer than the list of cuts.
    """
    start = Window.unboundedPreceding
    if by.cuts is None:
        window = by.window().rowsBetween(start, 0)
        return df.select("*", *(F.sum(c).over(window).alias(name) for name, c in sums.items()))
    blocks = with_blocks(df, by.keys, by.order, by.cuts)
    window = by.window(BLOCK).rowsBetween(start, 0)
    local = blocks.select("*", *(F.sum(c).over(window).alias(name) for name, c in sums.items()))
    totals = (
        blocks.where("_cut")
        .groupBy(*by.keys, BLOCK)
        .agg(*(F.sum(c).alias(f"_before_{name}") for name, c in sums.items()))
    )
    before = totals.select(
        *by.keys,
        BLOCK,
        *(F.sum(f"_before_{name}").over(by.through_blocks()).alias(f"_before_{name}") for name in sums),
    )
    joined = join_sized(local, before, [*by.keys, BLOCK], by.cuts.small, "left")
    return joined.select(
        *df.columns,
        *(
            F.coalesce(F.col(f"_before_{name}") + F.col(name), f"_before_{name}", name)
            .cast(local.schema[name].dataType)
            .alias(name)
            for name in sums
        ),
    )


def last_before(df: DataFrame, by: Ordering, values: dict[str, Column]) -> DataFrame:
    """Add the latest non-null value found before each row."""
    start = Window.unboundedPreceding
    if by.cuts is None:
        window = by.window().rowsBetween(start, -1)
        return df.select(
            "*", *(F.last(c, ignorenulls=True).over(window).alias(name) for name, c in values.items())
        )
    blocks = with_blocks(df, by.keys, by.order, by.cuts)
    window = by.window(BLOCK).rowsBetween(start, -1)
    local = blocks.select(
        "*", *(F.last(c, ignorenulls=True).over(window).alias(name) for name, c in values.items())
    )
    at = F.struct(*by.order)
    tails = (
        blocks.where("_cut")
        .groupBy(*by.keys, BLOCK)
        .agg(
            *(F.max_by(c, F.when(c.isNotNull(), at)).alias(f"_before_{name}") for name, c in values.items())
        )
    )
    before = tails.select(
        *by.keys,
        BLOCK,
        *(
            F.last(f"_before_{name}", ignorenulls=True).over(by.through_blocks()).alias(f"_before_{name}")
            for name in values
        ),
    )
    joined = join_sized(local, before, [*by.keys, BLOCK], by.cuts.small, "left")
    return joined.select(
        *df.columns, *(F.coalesce(F.col(name), F.col(f"_before_{name}")).alias(name) for name in values)
    )


FRAME, OWN = "_frame", "_own"


def preceding_frames(df: DataFrame, by: Ordering, n: int, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Prepare rows for a window over the ``n`` rows before each one.

    Adds ``_frame``, to be part of the window's partitioning, and ``_own``, to
    filter on afterwards. Where a key was cut, rows go to frames of ``limit``
    rows; the last ``n`` rows of a frame are repeated at the start of the next.
    """
    if by.cuts is None:
        return df.select("*", F.lit(0).cast("bigint").alias(FRAME), F.lit(True).alias(OWN))
    length = max(limit, n)
    placed = running_sums(df, by, {"_pos": F.lit(1)})
    pos = F.col("_pos") - 1
    home = F.floor(pos / length).cast("bigint")
    places = F.array(
        F.struct(home.alias(FRAME), F.lit(True).alias(OWN)),
        F.when(pos % length >= length - n, F.struct((home + 1).alias(FRAME), F.lit(False).alias(OWN))),
    )
    return placed.select(*df.columns, F.inline(F.array_compact(places)))


def trailing_totals(
    df: DataFrame,
    keys: list[str],
    ts: str,
    span: str,
    amount: Column,
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Rows and amount in the time ``span`` up to and including each instant, per key.

    Spark adds up a sliding range frame again for every row. Here each instant
    enters once and leaves once ``span`` later, and the totals are running sums
    over both, so the cost does not depend on how many rows a span holds. The amount
    of a span without a known amount is null.
    """
    source = df.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).alias("_ts"), amount.alias("_amount"))
    hot = bool(key_profile(source, keys, limit).hot)
    if not hot:
        # One shuffle then serves the grouping and the window.
        source = source.repartition(*keys)
    instants = source.groupBy(*keys, "_ts").agg(
        F.count(F.lit(1)).alias("_n"), F.count("_amount").alias("_known"), F.sum("_amount").alias("_amount")
    )
    moves = instants.select(
        *keys,
        F.inline(
            F.array(
                F.struct(
                    F.col("_ts").alias("_at"), F.lit(0).alias("_leaves"), F.col("_n"), F.col("_known"), F.col("_amount")
                ),
                F.struct(
                    (F.col("_ts") + F.expr(f"INTERVAL {span}")).alias("_at"),
                    F.lit(1).alias("_leaves"),
                    (-F.col("_n")).alias("_n"),
                    (-F.col("_known")).alias("_known"),
                    (-F.col("_amount")).alias("_amount"),
                ),
            )
        ),
    )
    order = ["_at", "_leaves"]
    by = ordering(moves, keys, order, limit) if hot else Ordering(keys, order)
    summed = running_sums(moves, by, {"n": F.col("_n"), "known": F.col("_known"), "amount": F.col("_amount")})
    known_amount = F.when(F.col("known") > 0, F.col("amount")).alias("amount")
    return summed.where("_leaves = 0").select(*keys, F.col("_at").alias(ts), "n", known_amount)
