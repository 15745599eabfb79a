"""Checks that records are complete, consistent and not repeated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallywarden.functions.exact import scaled, total
from tallywarden.plans.ordered import Ordering, last_before, ordering
from tallywarden.plans.skew import ROWS_PER_TASK, match
from tallywarden.session import written


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split rows into good and bad; bad rows carry the codes of the rules they break.

    A rule is the condition for a row to be bad. A rule that is null counts as kept.
    """
    codes = F.array_compact(F.array(*(F.when(bad, F.lit(code)) for code, bad in rules.items())))
    broken = reduce(lambda a, b: a | b, (F.coalesce(bad, F.lit(False)) for bad in rules.values()))
    return df.where(~broken), df.where(broken).withColumn("reasons", codes)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of ``child`` without a matching row in ``parent``.

    The parent's keys are made distinct before they are shuffled, so a key
    repeated in most of its rows costs one row per task.
    """
    known = parent.select(F.col(parent_key).alias("_known")).distinct()
    return child.join(known, F.col(child_key) == F.col("_known"), "left_anti")


def time_order(
    first: DataFrame, second: DataFrame, first_key: str, second_key: str, first_ts: str, second_ts: str
) -> DataFrame:
    """Pairs of linked records whose second step is dated before the first."""
    return first.join(second, F.col(first_key) == F.col(second_key)).where(
        F.col(second_ts) < F.col(first_ts)
    )


def reconcile(orders: DataFrame, lineitem: DataFrame, tol: float) -> DataFrame:
    """Orders whose total differs from the sum of their lines by more than ``tol``.

    A line is price x (1 - discount) x (1 + tax), summed in millionths.
    """
    line = (
        scaled("l_extendedprice").cast("decimal(18,0)")
        * (100 - scaled("l_discount")).cast("decimal(5,0)")
        * (100 + scaled("l_tax")).cast("decimal(5,0)")
    )
    sums = lineitem.groupBy("l_orderkey").agg(F.sum(line).alias("_lines"))
    difference = F.col("_lines") - scaled("o_totalprice").cast("decimal(18,0)") * 10_000
    return (
        orders.join(sums, F.col("o_orderkey") == F.col("l_orderkey"))
        .withColumn("lines_total", F.col("_lines").cast("double") / 1_000_000)
        .withColumn("difference", difference.cast("double") / 1_000_000)
        .where(F.abs("difference") > tol)
        .drop("_lines", "l_orderkey")
    )


def domain_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows each rule finds bad, in one pass over the table."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *(F.count_if(bad).alias(c) for c, bad in rules.items()))
    return counts.unpivot("_rows", list(rules), "rule", "n_bad").withColumnRenamed("_rows", "n_rows")


def near_duplicates(
    df: DataFrame,
    entity: str,
    tie: str,
    ts: str,
    amount: str,
    tol_cents: int,
    days: int,
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Rows with another row of the same entity, amount within ``tol_cents``, date within ``days``.

    First only rows with a neighbour in amount are kept, by looking one row back
    in both directions; ``tie`` is a unique number that orders equal amounts.
    These are placed on a grid with cells of ``tol_cents`` by ``days``. Two rows
    in one cell always match. For the eight cells around, the lowest and highest
    amount of each day decide, so a cell is summarised by at most two values a
    day and no pairs of rows are formed, however many copies there are.
    """
    if tol_cents < 1 or days < 1:
        raise ValueError("tol_cents and days must be at least 1; for equal rows use exact_repeats")
    cells = df.where(F.col(ts).isNotNull() & F.col(amount).isNotNull()).select(
        "*",
        scaled(amount).alias("_cents"),
        (-scaled(amount)).alias("_down"),
        (-F.col(tie)).alias("_tie_down"),
        F.datediff(ts, F.lit("1970-01-01")).alias("_day"),
    )
    up = ordering(cells, [entity], ["_cents", tie], limit)
    down = Ordering([entity], ["_down", "_tie_down"])
    if up.cuts is not None:
        down = ordering(cells, [entity], ["_down", "_tie_down"], limit)
    beside = last_before(cells, up, {"_below": F.col("_cents")})
    beside = last_before(beside, down, {"_above": F.col("_cents")})
    close = (F.col("_cents") - F.col("_below") <= tol_cents) | (F.col("_above") - F.col("_cents") <= tol_cents)
    # Kept once: both the summaries and the final lookup read it.
    placed = written(
        beside.where(close).select(
            *cells.columns,
            F.floor(F.col("_cents") / tol_cents).cast("bigint").alias("_row"),
            F.floor(F.col("_day") / days).cast("int").alias("_col"),
        )
    )
    daily = placed.groupBy(entity, "_row", "_col", "_day").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_cents").alias("_low"), F.max("_cents").alias("_high")
    )
    # Each daily summary is sent to its own cell and to the eight around it.
    steps = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1)))
    seen = (
        daily.select("*", F.explode(steps).alias("_to"))
        .groupBy(
            entity,
            (F.col("_row") + F.col("_to.r")).alias("_row"),
            (F.col("_col") + F.col("_to.c")).alias("_col"),
        )
        .agg(
            F.sum(F.when((F.col("_to.r") == 0) & (F.col("_to.c") == 0), F.col("_n"))).alias("_mine"),
            # At most 3 x days x 3 summaries, whatever the number of rows.
            F.collect_list(
                F.when(
                    (F.col("_to.r") != 0) | (F.col("_to.c") != 0),
                    F.struct("_day", "_low", "_high"),
                )
            ).alias("_around"),
        )
        .where("_mine IS NOT NULL")
    )

    def near(d: Column) -> Column:
        close = F.abs(d["_day"] - F.col("_day")) <= days
        return close & (
            F.col("_cents").between(d["_low"] - tol_cents, d["_low"] + tol_cents)
            | F.col("_cents").between(d["_high"] - tol_cents, d["_high"] + tol_cents)
        )

    return (
        match(placed, seen, [entity, "_row", "_col"])
        .where((F.col("_mine") > 1) | F.exists("_around", near))
        .select(*df.columns)
    )


def exact_repeats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Payloads that occur more than once."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def control_totals(df: DataFrame, by: list[str | Column], amount: str, key: str) -> DataFrame:
    """Row count, amount in cents and distinct keys per partition.

    Rows are first reduced to one per partition and key, so a busy partition is
    counted by many tasks.
    """
    keyed = df.groupBy(*by, F.col(key).alias("_key")).agg(
        F.count(F.lit(1)).alias("_n"), total(scaled(amount)).alias("_cents")
    )
    names = [c for c in keyed.columns if not c.startswith("_")]
    return keyed.groupBy(*names).agg(
        F.sum("_n").alias("n_rows"),
        (F.sum("_cents").cast("double") / 100).alias("amount"),
        F.count("_key").alias("n_keys"),
    )


def run_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Rows added or removed between two runs, each as often as the counts differ.

    Both runs are counted in one grouping instead of being compared twice.
    """
    cols = current.columns
    both = current.select(*cols, F.lit(1).alias("_d")).unionByName(
        previous.select(*cols, F.lit(-1).alias("_d"))
    )
    changed = both.groupBy(*cols).agg(F.sum("_d").alias("_d")).where("_d != 0")
    return changed.select(
        *cols,
        F.when(F.col("_d") > 0, "added").otherwise("removed").alias("change"),
        F.abs("_d").alias("copies"),
    )
