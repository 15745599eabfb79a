"""Amounts that do not fit: against everyone, a group, the entity's own past, or a known distribution."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywarden.functions.exact import deviation, mean, moments, scaled, total
from tallywarden.plans.ordered import FRAME, OWN, ordering, preceding_frames, running_sums
from tallywarden.plans.quantiles import VALUES_PER_TASK, exact_quantiles
from tallywarden.plans.skew import ROWS_PER_TASK, attach, join_small, key_profile, match
from tallywarden.session import written

# Scales the median absolute deviation to a standard deviation for normal data.
MAD_TO_SD = 0.6745
# Expected share of first digits 1 to 9.
BENFORD = [math.log10(1 + 1 / d) for d in range(1, 10)]


def zscore_global(df: DataFrame, amount: str, k: float) -> DataFrame:
    """Rows further than ``k`` standard deviations from the mean of all rows."""
    cents = scaled(amount)
    mean_, cov = moments(df.where(F.col(amount).isNotNull()), {"x": cents})
    variance = cov["x", "x"]
    deviation_ = F.when(variance > 0, F.sqrt(variance))
    return df.withColumn("zscore", F.try_divide(cents - mean_["x"], deviation_)).where(F.abs("zscore") > k)


def mad_score(
    df: DataFrame, group: str, amount: str, k: float, limit: int = VALUES_PER_TASK
) -> DataFrame:
    """Rows whose robust score within their group exceeds ``k``.

    The score is the distance from the median in units of the median absolute
    deviation, both taken in whole cents. A group with no spread has no scores.
    """
    profile = key_profile(df, [group], limit)
    cents = df.withColumn("_cents", scaled(amount))
    medians = exact_quantiles(cents, [group], "_cents", {"_median": 0.5}, limit, profile)
    distances = attach(cents, medians, [group], profile).withColumn(
        "_distance", F.abs(F.col("_cents") - F.col("_median"))
    )
    mads = exact_quantiles(distances, [group], "_distance", {"_mad": 0.5}, limit, profile)
    score = F.try_divide(F.lit(MAD_TO_SD) * (F.col("_cents") - F.col("_median")), F.col("_mad"))
    return (
        attach(distances, mads, [group], profile)
        .select(
            *df.columns,
            (F.col("_median") / 100).alias("median"),
            (F.col("_mad") / 100).alias("mad"),
            score.alias("score"),
        )
        .where(F.abs("score") > k)
    )


def iqr_fence(
    df: DataFrame, group: str, amount: str, m: float, limit: int = VALUES_PER_TASK
) -> DataFrame:
    """Rows above the upper quartile by more than ``m`` interquartile ranges of their group, in cents."""
    profile = key_profile(df, [group], limit)
    cents = df.withColumn("_cents", scaled(amount))
    quartiles = exact_quantiles(cents, [group], "_cents", {"_q1": 0.25, "_q3": 0.75}, limit, profile)
    fences = quartiles.select(
        group, (F.col("_q3") + m * (F.col("_q3") - F.col("_q1"))).alias("_fence")
    )
    return (
        attach(cents, fences, [group], profile)
        .where(F.col("_cents") > F.col("_fence"))
        .select(*df.columns, (F.col("_fence") / 100).alias("fence"))
    )


def prior_zscore(
    df: DataFrame,
    entity: str,
    order: list[str],
    amount: str,
    min_n: int,
    k: float,
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Rows that deviate from the entity's earlier rows by more than ``k`` standard deviations.

    Later rows never change an earlier score. ``min_n`` earlier rows are needed.
    """
    cents = scaled(amount)
    known = F.col(amount).isNotNull()
    wide = F.coalesce(cents, F.lit(0)).cast("decimal(18,0)")
    square = (wide * wide).cast("decimal(28,0)")
    by = ordering(df, [entity], order, limit)
    summed = running_sums(df, by, {"_n": known.cast("bigint"), "_s": wide, "_ss": square})
    n = F.col("_n") - known.cast("bigint")
    s, ss = F.col("_s") - wide, F.col("_ss") - square
    return (
        summed.withColumns({"n_prior": n, "_mean": mean(n, s), "_sd": deviation(n, s, ss)})
        .withColumn("zscore", F.try_divide(cents - F.col("_mean"), F.col("_sd")))
        .where((F.col("n_prior") >= min_n) & (F.abs("zscore") > k))
        .drop("_n", "_s", "_ss", "_mean", "_sd")
    )


def rolling_median(
    df: DataFrame, entity: str, order: list[str], amount: str, n: int, limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Each row's deviation from the median of the entity's previous ``n`` rows."""
    by = ordering(df, [entity], order, limit)
    framed = preceding_frames(df, by, n, limit)
    window = by.window(FRAME).rowsBetween(-n, -1)
    return (
        framed.withColumn("median_prior", F.percentile(amount, 0.5).over(window))
        .where(OWN)
        .drop(FRAME, OWN)
        .withColumn("deviation", F.col(amount) - F.col("median_prior"))
    )


def peer_rank(
    df: DataFrame,
    entity: str,
    amount: str,
    peers: DataFrame,
    peer: str,
    p: float,
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Entities whose total is in the top share of their peer group, by percent rank.

    ``peers`` has one row per entity with its group. Rows are added up before
    the group is looked up, so a busy entity costs one row per task. A null entity or
    group counts as one of its own. Equal totals share a rank, so only distinct totals are ordered.
    """
    sums = df.groupBy(entity).agg(total(scaled(amount)).alias("_total"))
    totals = written(match(sums, peers.select(entity, peer), [entity]))
    tied = totals.groupBy(peer, "_total").agg(F.count(F.lit(1)).alias("_tied"))
    upto = running_sums(tied, ordering(tied, [peer], ["_total"], limit), {"_upto": F.col("_tied")})
    sizes = totals.groupBy(peer).agg(F.count(F.lit(1)).alias("_size"))
    rank = F.try_divide(F.col("_upto") - F.col("_tied"), F.col("_size") - 1)
    ranked = (
        match(upto, sizes, [peer])
        .withColumn("percent_rank", F.coalesce(rank, F.lit(0.0)))
        .where(F.col("percent_rank") >= p)
        .select(peer, "_total", "percent_rank")
    )
    return match(totals, ranked, [peer, "_total"]).select(
        entity, peer, (F.col("_total").cast("double") / 100).alias("total"), "percent_rank"
    )


def first_digit(amount: str) -> Column:
    """First significant digit of an amount in cents; null for zero and null."""
    cents = F.abs(scaled(amount))
    return F.when(cents > 0, F.substring(cents.cast("string"), 1, 1).cast("int"))


def benford(df: DataFrame, amount: str) -> DataFrame:
    """Observed share of each first digit beside the share Benford's law expects."""
    digits = df.select(first_digit(amount).alias("digit")).where("digit IS NOT NULL")
    counts = digits.groupBy("digit").agg(F.count(F.lit(1)).alias("n"))
    # At most nine rows are left for the unpartitioned window.
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    expected = F.element_at(F.array(*(F.lit(e) for e in BENFORD)), F.col("digit"))
    return counts.select("digit", "n", share.alias("share"), expected.alias("expected"))


def benford_by_entity(df: DataFrame, entity: str, amount: str, min_n: int) -> DataFrame:
    """Chi-square distance of each entity's first digits from Benford's law.

    Written as sum(observed^2 / expected) - n, in which a digit that never
    occurs adds nothing and so needs no row.
    """
    digit = first_digit(amount)
    per_digit = [F.count(F.when(digit == d, 1)).alias(f"_d{d}") for d in range(1, 10)]
    counts = df.groupBy(entity).agg(F.count(digit).alias("n"), *per_digit).where(F.col("n") >= min_n)
    squares = [
        F.col(f"_d{d}") * F.col(f"_d{d}") / (F.col("n") * F.lit(BENFORD[d - 1])) for d in range(1, 10)
    ]
    return counts.select(entity, "n", (sum(squares[1:], squares[0]) - F.col("n")).alias("chi2"))


def round_amounts(df: DataFrame, entity: str, amount: str, unit: int) -> DataFrame:
    """Entities with amounts that are whole multiples of ``unit``, and their share."""
    whole = scaled(amount) % (unit * 100) == 0
    return (
        df.groupBy(entity)
        .agg(
            F.count(amount).alias("n"),
            F.count(F.when(whole, 1)).alias("n_round"),
        )
        .where("n_round > 0")
        .withColumn("share", F.col("n_round") / F.col("n"))
    )


def mahalanobis(df: DataFrame, x: str, y: str, threshold: float) -> DataFrame:
    """Rows whose squared distance in two correlated features exceeds ``threshold``.

    Features are taken in hundredths, so that the covariance sums are exact.
    """
    a, b = scaled(x), scaled(y)
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    mean_, cov = moments(known, {"x": a, "y": b})
    vx, vy, cxy = cov["x", "x"], cov["y", "y"], cov["x", "y"]
    dx, dy = a - mean_["x"], b - mean_["y"]
    distance = F.try_divide(vy * dx * dx - 2 * cxy * dx * dy + vx * dy * dy, vx * vy - cxy * cxy)
    return known.withColumn("d2", distance).where(F.col("d2") > threshold)


def inverse(matrix: list[list[float]], tiny: float = 1e-12) -> list[list[float]] | None:
    """Inverse of a symmetric positive matrix by its Cholesky factor; None if a pivot vanishes."""
    n = len(matrix)
    lower = [[0.0] * n for _ in range(n)]
    for i in range(n):
        for j in range(i + 1):
            rest = matrix[i][j] - sum(lower[i][k] * lower[j][k] for k in range(j))
            if i != j:
                lower[i][j] = rest / lower[j][j]
            elif rest <= tiny:
                return None
            else:
                lower[i][i] = rest**0.5
    # Rows of the factor's inverse, by substitution.
    back = [[0.0] * n for _ in range(n)]
    for i in range(n):
        back[i][i] = 1 / lower[i][i]
        for j in range(i):
            back[i][j] = -sum(lower[i][k] * back[k][j] for k in range(j, i)) / lower[i][i]
    return [[sum(back[k][i] * back[k][j] for k in range(max(i, j), n)) for j in range(n)] for i in range(n)]


def mahalanobis_distance(df: DataFrame, features: list[str], threshold: float | None = None) -> DataFrame:
    """Add ``d2``, the squared distance of a row in any number of correlated features.

    Means and covariances come from one pass whose single row reaches the driver, where the correlations are
    inverted; rows are then scored with plain numbers. ``d2`` is null for rows with an unknown feature and for
    all rows if a feature is constant or a mixture of others. With a ``threshold`` only rows above it are returned.
    """
    units = {f: scaled(f) for f in features}
    means, covariances = moments(df.dropna(subset=features), units)
    names = [*means, *(f"{a}\n{b}" for a, b in covariances)]
    numbers = df.sparkSession.range(1).select(F.array(*means.values(), *covariances.values()).alias("all")).first()["all"]
    value = dict(zip(names, numbers, strict=True))

    def cov(a: str, b: str) -> float | None:
        return value.get(f"{a}\n{b}", value.get(f"{b}\n{a}"))

    spread = [(cov(f, f) or 0.0) ** 0.5 for f in features]
    inverted = None
    if all(spread):
        inverted = inverse([[cov(a, b) / (sa * sb) for b, sb in zip(features, spread)] for a, sa in zip(features, spread)])
    if inverted is None:
        return df.withColumn("d2", F.lit(None).cast("double")).where("false" if threshold is not None else "true")
    steps = [(units[f] - value[f]) / s for f, s in zip(features, spread)]
    terms = [steps[i] * steps[j] * (inverted[i][j] * (1 if i == j else 2)) for i in range(len(steps)) for j in range(i + 1)]
    scored = df.withColumn("d2", reduce(lambda x, y: x + y, terms))
    return scored if threshold is None else scored.where(F.col("d2") > threshold)


def multivariate(
    df: DataFrame, features: list[str], clusters: int, k: float, rounds: int = 10, seed: int = 7
) -> DataFrame:
    """Rows far from their nearest cluster centre, in standardised features.

    Only the centres, ``clusters`` small vectors, reach the driver. "Far" means
    more than ``k`` times the root mean square distance of the row's cluster.
    """
    known = df.dropna(subset=features)
    spread = known.agg(*(F.struct(F.avg(f).alias("m"), F.stddev(f).alias("s")).alias(f) for f in features)).first()
    shares = [
        F.coalesce(F.try_divide(F.col(f) - F.lit(spread[f]["m"]), F.lit(spread[f]["s"])), F.lit(0.0)).alias(f)
        for f in features
    ]
    points = VectorAssembler(inputCols=features, outputCol="_x").transform(known.select(*shares)).select("_x")
    model = KMeans(k=clusters, maxIter=rounds, seed=seed, featuresCol="_x").fit(points)
    squares = [
        sum(
            ((share - float(c)) * (share - float(c)) for share, c in zip(shares[1:], centre[1:])),
            (shares[0] - float(centre[0])) * (shares[0] - float(centre[0])),
        )
        for centre in model.clusterCenters()
    ]
    # The nearest centre, from the centres as numbers: no model is run per row.
    nearest = F.array_min(F.array(*(F.struct(d.alias("d2"), F.lit(i).alias("cluster")) for i, d in enumerate(squares))))
    placed = known.withColumn("_nearest", nearest).select(
        "*", F.col("_nearest.cluster").alias("cluster"), F.col("_nearest.d2").alias("_d2")
    )
    typical = placed.groupBy("cluster").agg(F.avg("_d2").alias("_mean_d2"))
    # One row per cluster.
    return (
        join_small(placed, typical, ["cluster"])
        .where(F.col("_d2") > k * k * F.col("_mean_d2"))
        .withColumn("distance", F.sqrt("_d2"))
        .drop("_nearest", "_d2", "_mean_d2")
    )
