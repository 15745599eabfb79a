"""Streaming twins of the time-based rules.

Each takes and returns a streaming DataFrame. Windowed results are emitted once,
when the watermark has passed their end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallywarden.functions.exact import scaled, total
from tallywarden.plans.ordered import last_before, ordering, running_sums
from tallywarden.plans.skew import ROWS_PER_TASK


def _measures(amount: str) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        (total(scaled(amount)).cast("double") / 100).alias("amount"),
    ]


def tumbling(events: DataFrame, entity: str, amount: str, size: str) -> DataFrame:
    """Count and amount per entity and fixed window.

    Rows are added up before they are shuffled, so a busy entity costs one row
    per task and window.
    """
    return _flat(events.groupBy(F.window("ts", size), entity).agg(*_measures(amount)), "window")


def sliding(events: DataFrame, entity: str, amount: str, size: str, slide: str) -> DataFrame:
    """Count and amount per entity and overlapping window."""
    return _flat(events.groupBy(F.window("ts", size, slide), entity).agg(*_measures(amount)), "window")


def sessions(events: DataFrame, entity: str, amount: str, gap: str) -> DataFrame:
    """Count and amount per entity and session.

    With ``spark.sql.sessionWindow.merge.sessions.in.local.partition``, set in
    the library's session, each task merges its sessions before the shuffle.
    """
    return _flat(events.groupBy(F.session_window("ts", gap), entity).agg(*_measures(amount)), "session_window")


def partial_sessions(events: DataFrame, entity: str, amount: str, gap: str, bucket_seconds: int) -> DataFrame:
    """Sessions cut at time buckets: entity, bucket, first_ts, last_ts, n and cents.

    The bucket is part of the state's key. An entity that never rests is so spread over tasks, and no state row
    or task holds more of a session than a bucket of it. ``stitched`` puts the parts together.
    """
    bucket = F.floor(F.unix_micros("ts") / F.lit(bucket_seconds * 1_000_000)).cast("bigint").alias("bucket")
    grouped = events.groupBy(F.session_window("ts", gap), entity, bucket).agg(
        F.count(F.lit(1)).alias("n"), total(scaled(amount)).alias("cents")
    )
    return grouped.select(
        entity,
        "bucket",
        F.col("session_window.start").alias("first_ts"),
        (F.col("session_window.end") - F.expr(f"INTERVAL {gap}")).alias("last_ts"),
        "n",
        "cents",
    )


def stitched(
    parts: DataFrame, entity: str, gap: str, bucket_seconds: int, watermark: str, limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Whole sessions from stored parts: parts no further apart than ``gap`` are one session.

    Only sessions that nothing can continue any more are returned: a part that begins before a session's end
    lies in the bucket of that end or earlier, and has been stored once the ``watermark`` (UTC) is a gap beyond that bucket.
    An entity has a row for each bucket and pause, and a large one is cut as in batch mode.
    """
    by = ordering(parts, [entity], ["first_ts"], limit)
    pause = F.expr(f"INTERVAL {gap}")
    known = last_before(parts, by, {"_before": F.col("last_ts")})
    begins = F.when(F.col("_before").isNull() | (F.col("first_ts") > F.col("_before") + pause), 1).otherwise(0)
    numbered = running_sums(known, by, {"_session": begins})
    sessions_ = numbered.groupBy(entity, "_session").agg(
        F.sum("n").alias("n"),
        (F.sum("cents").cast("double") / 100).alias("amount"),
        F.min("first_ts").alias("window_start"),
        (F.max("last_ts") + pause).alias("window_end"),
    )
    width = F.lit(bucket_seconds * 1_000_000)
    bucket_end = F.timestamp_micros(((F.floor(F.unix_micros("window_end") / width) + 1) * width).cast("bigint"))
    return sessions_.where(bucket_end + pause <= F.to_timestamp(F.lit(watermark))).drop("_session")


def _flat(df: DataFrame, window: str) -> DataFrame:
    rest = [c for c in df.columns if c != window]
    return df.select(
        *rest, F.col(f"{window}.start").alias("window_start"), F.col(f"{window}.end").alias("window_end")
    )


def deduplicate(events: DataFrame, keys: list[str]) -> DataFrame:
    """Drop repeats that arrive within the watermark delay of the first copy."""
    return events.dropDuplicatesWithinWatermark(keys)


def sequence(
    events: DataFrame, entity: str, first: Column, then: Column, span_seconds: int
) -> DataFrame:
    """Rows matching ``then`` after a row matching ``first`` within the span, each once.

    A semi-join stops at the first match and emits no pairs. Time buckets of one
    span are part of the key: a busy entity is spread over tasks, and a row meets
    only rows at most two spans away. A ``first`` row serves its own bucket and the next.
    """
    bucket = F.floor(F.unix_micros("ts") / F.lit(span_seconds * 1_000_000)).cast("bigint")
    starts = events.where(first).select(
        F.col(entity).alias("_entity"),
        F.col("ts").alias("_first_ts"),
        F.explode(F.array(bucket, bucket + 1)).alias("_bucket"),
    )
    ends = events.where(then).withColumn("_own", bucket)
    near = (
        (F.col(entity) == F.col("_entity"))
        & (F.col("_own") == F.col("_bucket"))
        & (F.col("_first_ts") < F.col("ts"))
        & (F.col("ts") <= F.col("_first_ts") + F.expr(f"INTERVAL {span_seconds} SECONDS"))
    )
    return ends.join(starts, near, "left_semi").drop("_own")


def enrich(events: DataFrame, entity: str, profile: DataFrame, key: str) -> DataFrame:
    """Add attributes from a stored table; events of unknown entities are kept.

    Spark chooses the join by the table's size in every batch.
    """
    return events.join(profile, F.col(entity) == F.col(key), "left").drop(key)
