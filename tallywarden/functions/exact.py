"""Column expressions whose result does not depend on the order rows are added in.

Sums of doubles change with the order of addition, so the same query can give
another last digit on another cluster. Money is therefore summed as integers
and turned into doubles once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def scaled(col: Column | str, factor: int = 100) -> Column:
    """A decimal-like double as the nearest integer count of 1/factor units.

    ``rint`` works on the double itself; ``round`` would go through a decimal per row.
    """
    col = F.col(col) if isinstance(col, str) else col
    return F.rint(col * F.lit(factor)).cast("bigint")


def total(col: Column) -> Column:
    """Integer sum that cannot overflow at any realistic number of rows."""
    return F.sum(col.cast("decimal(20,0)"))


def total_product(a: Column, b: Column) -> Column:
    """Integer sum of products, exact beyond 64 bits."""
    return F.sum((a.cast("decimal(18,0)") * b.cast("decimal(18,0)")).cast("decimal(28,0)"))


def mean(n: Column, s: Column) -> Column:
    return F.try_divide(s.cast("double"), n.cast("double"))


def covariance(n: Column, sx: Column, sy: Column, sxy: Column) -> Column:
    """Sample covariance from exact sums; null for fewer than two rows.

    The sums are first moved, as integers, to the whole numbers next to the means. Only what is
    left becomes a double, so that large values with a small spread keep their digits.
    """
    whole = n.cast("decimal(20,0)")

    def near_mean(s: Column) -> Column:
        return F.rint(mean(n, s)).cast("decimal(18,0)")

    qx, qy = near_mean(sx), near_mean(sy)
    rx, ry = sx - whole * qx, sy - whole * qy
    moved = (sxy - qx * sy - qy * rx).cast("double")
    spread = moved - F.try_divide(rx.cast("double") * ry.cast("double"), n.cast("double"))
    return F.when(n > 1, F.try_divide(spread, n.cast("double") - 1))


def deviation(n: Column, s: Column, ss: Column) -> Column:
    """Sample standard deviation from exact sums; null where it is zero or undefined."""
    variance = covariance(n, s, s, ss)
    return F.when(variance > 0, F.sqrt(variance))


def moments(df: DataFrame, columns: dict[str, Column]) -> tuple[dict[str, Column], dict[tuple[str, str], Column]]:
    """Means, and covariances per pair, of integer columns over all rows.

    One pass whose single row is taken to the driver, so that later plans hold
    plain numbers instead of repeating the pass wherever a number is used.
    """
    names = list(columns)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = df.agg(
        F.count(F.lit(1)).alias("n"),
        *(total(columns[a]).alias(f"s_{a}") for a in names),
        *(total_product(columns[a], columns[b]).alias(f"s_{a}_{b}") for a, b in pairs),
    )
    n = F.col("n")
    row = sums.select(
        *(mean(n, F.col(f"s_{a}")).alias(f"mean_{a}") for a in names),
        *(
            covariance(n, F.col(f"s_{a}"), F.col(f"s_{b}"), F.col(f"s_{a}_{b}")).alias(f"cov_{a}_{b}")
            for a, b in pairs
        ),
    ).first()

    def number(key: str) -> Column:
        return F.lit(row[key]).cast("double")

    return (
        {a: number(f"mean_{a}") for a in names},
        {(a, b): number(f"cov_{a}_{b}") for a, b in pairs},
    )
