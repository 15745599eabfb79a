"""From alerts to scores and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tallywarden.plans.quantiles import VALUES_PER_TASK, exact_quantiles
from tallywarden.plans.skew import attach, key_profile


def union_alerts(*alerts: DataFrame) -> DataFrame:
    """One alert table from several detectors."""
    return reduce(DataFrame.unionByName, alerts)


def risk_score(alerts: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Alerts and weighted score per entity; a detector without a weight counts zero.

    Alerts are first counted per entity and detector, so that the weights are
    applied to counts and a busy entity is counted by many tasks. Weights are added up as
    decimals, so that a score does not depend on the order of its alerts.
    """
    counts = alerts.groupBy("entity_id", "detector").agg(F.count(F.lit(1)).alias("_n"))
    weight = F.coalesce(
        *(F.when(F.col("detector") == d, F.lit(str(w)).cast("decimal(18,9)")) for d, w in weights.items()),
        F.lit(0).cast("decimal(18,9)"),
    )
    return counts.groupBy("entity_id").agg(
        F.sum("_n").alias("n_alerts"), F.sum((F.col("_n") * weight).cast("decimal(28,9)")).cast("double").alias("score")
    )


def top_risk(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` highest scores, ties broken by the smaller id."""
    return scores.orderBy(F.desc("score"), "entity_id").limit(k)


def alert_cube(df: DataFrame, dims: list[str]) -> DataFrame:
    """Counts for all combinations of dimensions; ``level`` tells totals from null values.

    Rows are counted per full combination first: the cube then multiplies these
    counts and not the rows.
    """
    finest = df.groupBy(*dims).agg(F.count(F.lit(1)).alias("_n"))
    return finest.cube(*dims).agg(
        F.grouping_id(*dims).cast("bigint").alias("level"), F.sum("_n").alias("n")
    )


def amount_profile(
    df: DataFrame,
    group: str,
    amount: str,
    probs: dict[str, float],
    limit: int = VALUES_PER_TASK,
    approximate: bool = False,
) -> DataFrame:
    """Count, extremes and quantiles per group; ``approximate`` trades exactness for a single pass."""
    basics = df.groupBy(group).agg(
        F.count(amount).alias("n"),
        F.min(amount).alias("smallest"),
        F.max(amount).alias("largest"),
        *((F.percentile_approx(amount, p).alias(name) for name, p in probs.items()) if approximate else ()),
    )
    if approximate:
        return basics
    profile = key_profile(df, [group], limit)
    return attach(basics, exact_quantiles(df, [group], amount, probs, limit, profile), [group], profile)


def distinct_entities(df: DataFrame, group: str, entity: str) -> DataFrame:
    """Exact and approximate number of distinct entities per group, side by side."""
    per_entity = df.groupBy(group, entity).agg(F.count(F.lit(1)).alias("_n"))
    return per_entity.groupBy(group).agg(
        F.count(entity).alias("exact"), F.approx_count_distinct(entity).alias("approximate")
    )


def evaluate(alerts: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Precision, recall and F1 of alerted keys against true keys, one row.

    Both sides are counted in one grouping, which also removes repeated alerts.
    """
    marked = alerts.select(key, F.lit(1).alias("_alert"), F.lit(0).alias("_true")).unionByName(
        truth.select(key, F.lit(0).alias("_alert"), F.lit(1).alias("_true"))
    )
    keys = marked.groupBy(key).agg(F.max("_alert").alias("_alert"), F.max("_true").alias("_true"))
    counts = keys.agg(
        F.count_if((F.col("_alert") == 1) & (F.col("_true") == 1)).alias("tp"),
        F.count_if((F.col("_alert") == 1) & (F.col("_true") == 0)).alias("fp"),
        F.count_if((F.col("_alert") == 0) & (F.col("_true") == 1)).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "*",
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )
