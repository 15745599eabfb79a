"""Scoring each arrival against its entity's own past, as data streams in.

Each batch is scored with the same block-wise running sums as in batch mode, so
one busy entity is spread over tasks; state kept per key could not do that. An
entity's past is three exact sums, stored as one small table version per batch.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tallywarden.functions.exact import deviation, mean, scaled
from tallywarden.plans.ordered import ordering, running_sums
from tallywarden.plans.skew import ROWS_PER_TASK
from tallywarden.streaming.sinks import write_batch

SUMS = ("n", "s", "ss")


def outliers(
    batch: DataFrame, past: DataFrame, entity: str, order: list[str], amount: str, min_n: int, k: float, limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Rows of a batch far from what came before them: ``past`` (entity and exact sums) and earlier rows of the batch."""
    cents = scaled(amount)
    wide = cents.cast("decimal(18,0)")
    own = {"n": F.lit(1), "s": wide, "ss": (wide * wide).cast("decimal(28,0)")}
    carried = past.select(F.col(entity).alias("_entity"), *(F.col(c).alias(f"_past_{c}") for c in SUMS))
    by = ordering(batch, [entity], order, limit)
    within = running_sums(batch, by, {f"_{c}": own[c] for c in SUMS})
    before = {c: F.coalesce(F.col(f"_past_{c}"), F.lit(0)) + F.col(f"_{c}") - own[c] for c in SUMS}
    return (
        within.join(carried, F.col(entity) == F.col("_entity"), "left")
        .withColumns({f"_b{c}": before[c] for c in SUMS})
        .withColumn("n_prior", F.col("_bn").cast("bigint"))
        .withColumn(
            "zscore",
            F.try_divide(
                cents - mean(F.col("_bn"), F.col("_bs")), deviation(F.col("_bn"), F.col("_bs"), F.col("_bss"))
            ),
        )
        .where((F.col("n_prior") >= min_n) & (F.abs("zscore") > k))
        .select(*batch.columns, "n_prior", "zscore")
    )


def profile_scorer(
    folder: str,
    entity: str,
    order: list[str],
    amount: str,
    min_n: int,
    k: float,
    compact_every: int = 50,
    limit: int = ROWS_PER_TASK,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` handler that writes outliers to ``folder``/alerts.

    Version ``b`` of the profile holds the sums of batch ``b`` only; every
    ``compact_every`` batches it holds all sums so far, so that few versions
    have to be read. Rows are compared with everything that arrived in earlier
    batches and with the rows before them in their own batch. A repeated batch
    reads the same versions and overwrites its own output.
    """

    def earlier(batch: DataFrame, batch_id: int) -> DataFrame:
        since = max(batch_id - 1, 0) // compact_every * compact_every
        key = batch.schema[entity].dataType.simpleString()
        schema = f"{entity} {key}, n decimal(38,0), s decimal(38,0), ss decimal(38,0)"
        if batch_id == 0:
            return batch.sparkSession.createDataFrame([], schema)
        # One folder per version; batches are numbered without gaps.
        paths = [f"{folder}/profile/batch_id={b}" for b in range(since, batch_id)]
        return batch.sparkSession.read.schema(schema).parquet(*paths)

    def merged(parts: list[DataFrame]) -> DataFrame:
        union = reduce(DataFrame.unionByName, parts)
        return union.groupBy(entity).agg(*(F.sum(c).cast("decimal(38,0)").alias(c) for c in SUMS))

    def handle(batch: DataFrame, batch_id: int) -> None:
        # A row without an amount or entity has no score and teaches nothing.
        batch = batch.where(F.col(entity).isNotNull() & F.col(amount).isNotNull()).persist()
        try:
            wide = scaled(amount).cast("decimal(18,0)")
            square = (wide * wide).cast("decimal(28,0)")
            fresh = batch.groupBy(entity).agg(
                F.count(F.lit(1)).cast("decimal(38,0)").alias("n"),
                F.sum(wide).cast("decimal(38,0)").alias("s"),
                F.sum(square).cast("decimal(38,0)").alias("ss"),
            )
            past = earlier(batch, batch_id)
            here = batch.select(F.col(entity).alias("_here")).distinct()
            carried = merged([past.join(here, F.col(entity) == F.col("_here"), "left_semi")])
            scored = outliers(batch, carried, entity, order, amount, min_n, k, limit)
            write_batch(scored, f"{folder}/alerts", batch_id)
            full = batch_id % compact_every == 0
            write_batch(merged([past, fresh]) if full else fresh, f"{folder}/profile", batch_id)
        finally:
            batch.unpersist()

    return handle
