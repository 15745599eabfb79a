"""Exact quantiles per key.

``percentile`` keeps every distinct value of a key in one task's memory. Keys
too large for that are done in two passes: an approximate quantile sketch, whose
rank error is bounded, gives a narrow bracket around each quantile; then only
the values inside the bracket are counted and ordered. The result is exact. If
a bracket should miss its quantile the query fails instead of answering wrongly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallywarden.plans.ordered import ordering, running_sums
from tallywarden.plans.skew import KeyProfile, join_small, key_profile, split_hot
from tallywarden.session import written

# Distinct values of one key that ``percentile`` may hold in one task's memory.
VALUES_PER_TASK = 1_000_000

# Inverse of the sketch's rank error, and the bracket's half width in units of that error.
ACCURACY = 10_000
SLACK = 4


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    limit: int = VALUES_PER_TASK,
    profile: KeyProfile | None = None,
) -> DataFrame:
    """One row per key with the interpolated quantiles named in ``probs``.

    Nulls are ignored; a key without values has no row.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    profile = profile or key_profile(rows, keys, limit)
    if not profile.hot:
        return _by_percentile(rows, keys, probs)
    ordinary, large = split_hot(rows, keys, profile)
    both = _by_percentile(ordinary, keys, probs).unionByName(_by_bracket(large, keys, probs, limit))
    # Callers join this one row per key back to the rows, often more than once.
    return written(both)


def _by_percentile(rows: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    # One call for all quantiles, so that the values of a key are held once.
    found = rows.groupBy(*keys).agg(F.percentile("_v", list(probs.values())).alias("_q"))
    return found.select(*keys, *(F.col("_q")[i].alias(name) for i, name in enumerate(probs)))


def _by_bracket(rows: DataFrame, keys: list[str], probs: dict[str, float], limit: int) -> DataFrame:
    names, ps = list(probs), list(probs.values())
    # Every key here has more than ``limit`` rows; two ranks cover rounding and interpolation.
    reach = SLACK / ACCURACY + 2 / limit
    edges = [max(p - reach, 0.0) for p in ps] + [min(p + reach, 1.0) for p in ps]
    sketch = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", edges, ACCURACY).alias("_edges")
    )
    # The extreme quantiles are open ended. One row per large key.
    brackets = written(
        sketch.select(
            *keys,
            "_n",
            *((F.col("_edges")[i] if p > reach else F.lit(float("-inf"))).alias(f"_lo{i}") for i, p in enumerate(ps)),
            *(
                (F.col("_edges")[i + len(ps)] if p < 1 - reach else F.lit(float("inf"))).alias(f"_hi{i}")
                for i, p in enumerate(ps)
            ),
        )
    )

    def place(i: int) -> Column:
        """The row's part in the bracket of quantile ``i``; null if it lies above."""
        below = F.col("_v") < F.col(f"_lo{i}")
        # Everything below a bracket is counted under one mark that sorts before it.
        marked = F.when(below, float("-inf")).otherwise(F.col("_v"))
        entry = F.struct(F.lit(i).alias("_i"), (~below).alias("_inside"), marked.alias("_v"))
        return F.when(F.col("_v") <= F.col(f"_hi{i}"), entry)

    highest = F.greatest(*(F.col(f"_hi{i}") for i in range(len(ps)))) if len(ps) > 1 else F.col("_hi0")
    inside = written(
        join_small(rows, brackets, keys)
        .where(F.col("_v") <= highest)
        .select(*keys, "_n", F.inline(F.array_compact(F.array(*(place(i) for i in range(len(ps)))))))
        .groupBy(*keys, "_i", "_n", "_inside", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    by = ordering(inside, [*keys, "_i"], ["_inside", "_v"], limit)
    counted = running_sums(inside, by, {"_upto": F.col("_c")})
    position = F.element_at(F.array(*(F.lit(p) for p in ps)), F.col("_i") + 1) * (F.col("_n") - 1)
    last = F.col("_upto") - 1
    first = last - F.col("_c") + 1

    def at(rank):
        return F.max(F.when(F.col("_inside") & (first <= rank) & (rank <= last), F.col("_v")))

    floor, ceil = F.floor(position), F.ceil(position)
    found = counted.groupBy(*keys, "_i").agg(
        at(floor).alias("_low"), at(ceil).alias("_high"), F.max(position - floor).alias("_part")
    )
    exact = F.when(
        F.col("_low").isNull() | F.col("_high").isNull(),
        F.raise_error(F.lit("quantile outside its bracket")).cast("double"),
    ).otherwise(
        F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(
            (1 - F.col("_part")) * F.col("_low") + F.col("_part") * F.col("_high")
        )
    )
    return found.groupBy(*keys).agg(
        *(F.max(F.when(F.col("_i") == i, exact)).alias(name) for i, name in enumerate(names))
    )
