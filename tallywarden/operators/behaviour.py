"""Behaviour over time: bursts, gaps, sequences, sessions and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywarden.functions.exact import scaled, total
from tallywarden.plans.ordered import last_before, ordering, running_sums, trailing_totals
from tallywarden.plans.quantiles import VALUES_PER_TASK, exact_quantiles
from tallywarden.plans.skew import ROWS_PER_TASK, key_profile

# A share this small stands in for an empty bin in the stability index.
EMPTY_SHARE = 1e-6


def velocity(
    df: DataFrame, entity: str, ts: str, amount: str, span: str, min_n: int, limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Instants at which an entity has at least ``min_n`` rows in the trailing ``span``."""
    totals = trailing_totals(df, [entity], ts, span, scaled(amount), limit)
    return totals.where(F.col("n") >= min_n).withColumn("amount", F.col("amount").cast("double") / 100)


def structuring(
    df: DataFrame,
    entity: str,
    ts: str,
    amount: str,
    low: float,
    high: float,
    span: str,
    min_n: int,
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Repeated amounts in the band just below a threshold, within a trailing ``span``."""
    band = df.where((F.col(amount) >= low) & (F.col(amount) < high))
    return velocity(band, entity, ts, amount, span, min_n, limit)


def dormant_reactivation(
    df: DataFrame, entity: str, ts: str, tie: str, days: int, limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Rows that follow at least ``days`` days without a row of the same entity."""
    by = ordering(df, [entity], [ts, tie], limit)
    before = last_before(df, by, {"_previous": F.col(ts)})
    gap = F.datediff(ts, F.col("_previous")).cast("bigint")
    return before.withColumn("gap_days", gap).where(F.col("gap_days") >= days).drop("_previous")


def asof_last(
    earlier: DataFrame,
    later: DataFrame,
    entity: str,
    ts: str,
    tie: str,
    value: str,
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """For each row of ``later``, the time and value of the latest row of ``earlier`` before it.

    Before means strictly earlier; of several at the latest instant the one with the largest ``tie`` counts.
    Both sides are merged into one ordered pass, so no pairs are compared. Rows
    of ``later`` without an earlier row have nulls.
    """
    # At one instant the wanted rows come first, so that its marks are not before them.
    marks = earlier.select(
        entity, ts, tie, F.lit(False).alias("_wanted"), F.struct(F.col(ts), F.col(value)).alias("_mark")
    )
    wanted = later.select(entity, ts, tie, F.lit(True).alias("_wanted"), F.lit(None).alias("_mark"))
    merged = marks.unionByName(wanted).withColumn("_mark_side", ~F.col("_wanted"))
    by = ordering(merged, [entity], [ts, "_mark_side", tie], limit)
    found = last_before(merged, by, {"_last": F.col("_mark")})
    return found.where("_wanted").select(
        entity, ts, tie, F.col("_last")[ts].alias("last_ts"), F.col("_last")[value].alias("last_value")
    )


def sequence(
    df: DataFrame,
    entity: str,
    ts: str,
    tie: str,
    first: Column,
    then: Column,
    span: str,
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Rows matching ``then`` with a row matching ``first`` at most ``span`` before, each once.

    Before means strictly earlier. Only the latest ``first`` row can decide that, so it is looked up
    instead of joined. A row that matches both plays both parts.
    """
    # At one instant the rows that ask come before those that answer.
    parts = F.array_compact(F.array(F.when(then, 0), F.when(first, 1)))
    kept = df.where(first | then).select("*", F.explode(parts).alias("_part"))
    by = ordering(kept, [entity], [ts, "_part", tie], limit)
    found = last_before(kept, by, {"first_ts": F.when(F.col("_part") == 1, F.col(ts))})
    soon = F.col(ts) <= F.col("first_ts") + F.expr(f"INTERVAL {span}")
    return found.where((F.col("_part") == 0) & soon).drop("_part")


def sessions(
    df: DataFrame, entity: str, ts: str, tie: str, amount: str, gap: str, limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Runs of rows with at most ``gap`` between neighbours: start, end, count and amount.

    ``session_window`` would merge all sessions of an entity in one task; here
    sessions are numbered block by block and then aggregated.
    """
    step = F.expr(f"INTERVAL {gap}")
    by = ordering(df, [entity], [ts, tie], limit)
    before = last_before(df, by, {"_previous": F.col(ts)})
    starts = before.withColumn(
        "_starts", F.when(F.col("_previous").isNull() | (F.col(ts) > F.col("_previous") + step), 1).otherwise(0)
    )
    numbered = running_sums(starts, by, {"_session": F.col("_starts")})
    return (
        numbered.groupBy(entity, "_session")
        .agg(
            F.min(ts).alias("session_start"),
            (F.max(ts) + step).alias("session_end"),
            F.count(F.lit(1)).alias("n"),
            (total(scaled(amount)).cast("double") / 100).alias("amount"),
        )
        .drop("_session")
    )


def daily_burst(
    df: DataFrame, entity: str, ts: str, amount: str, days: int, k: float, min_days: int
) -> DataFrame:
    """Days whose total exceeds ``k`` times the mean of the entity's active days before it.

    The mean covers the previous ``days`` calendar days, of which ``min_days``
    must have rows. The window runs over daily totals, at most one row a day.
    """
    daily = df.groupBy(entity, F.to_date(ts).alias("day")).agg(total(scaled(amount)).alias("_cents"))
    numbered = daily.withColumn("_day", F.datediff("day", F.lit("1970-01-01")))
    window = Window.partitionBy(entity).orderBy("_day").rangeBetween(-days, -1)
    return (
        numbered.withColumn("_prior", F.sum("_cents").over(window))
        .withColumn("n_prior", F.count(F.lit(1)).over(window))
        .where(F.col("n_prior") >= min_days)
        .select(
            entity,
            "day",
            "n_prior",
            (F.col("_cents").cast("double") / 100).alias("total"),
            (F.col("_prior").cast("double") / 100 / F.col("n_prior")).alias("prior_mean"),
        )
        .where(F.col("total") > k * F.col("prior_mean"))
    )


def off_hours(df: DataFrame, entity: str, ts: str, first_hour: int, last_hour: int) -> DataFrame:
    """Each entity's share of rows in the given hours, beside the share over all rows."""
    quiet = F.hour(ts).between(first_hour, last_hour)
    overall = df.agg((F.count_if(quiet) / F.count(F.lit(1))).alias("share")).scalar()
    return (
        df.groupBy(entity)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(quiet).alias("n_off"))
        .withColumn("share", F.col("n_off") / F.col("n"))
        .withColumn("overall", overall)
        .withColumn("lift", F.try_divide("share", "overall"))
    )


def gap_stats(df: DataFrame, entity: str, ts: str, tie: str, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Shortest, median and longest time between an entity's rows, in microseconds."""
    by = ordering(df, [entity], [ts, tie], limit)
    before = last_before(df, by, {"_previous": F.col(ts)})
    micros = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_previous").cast("timestamp"))
    gaps = before.select(entity, micros.alias("_gap")).where("_gap IS NOT NULL")
    values = min(limit, VALUES_PER_TASK)
    # The extremes are the outer quantiles, so one pass gives all three.
    found = exact_quantiles(
        gaps,
        [entity],
        "_gap",
        {"_min": 0.0, "median_gap": 0.5, "_max": 1.0},
        values,
        # An entity has one gap less than rows.
        key_profile(df, [entity], values),
    )
    return found.select(
        entity,
        F.col("_min").cast("bigint").alias("min_gap"),
        "median_gap",
        F.col("_max").cast("bigint").alias("max_gap"),
    )


def drift_psi(df: DataFrame, amount: str, ts: str, edges: list[float], split: str) -> DataFrame:
    """Population stability index per amount bin between the time before and from ``split``.

    Both periods are counted in one pass. A bin without rows in one period takes
    a small share there instead of an infinite index.
    """
    value = F.col(amount)
    bin_ = sum((F.when(value >= e, 1).otherwise(0) for e in edges[1:]), F.when(value >= edges[0], 1).otherwise(0))
    later = F.col(ts) >= F.lit(split).cast("timestamp_ntz")
    counts = (
        df.where(value.isNotNull())
        .groupBy(bin_.alias("bin"))
        .agg(F.count_if(~later).alias("n_before"), F.count_if(later).alias("n_after"))
    )
    # At most one row per bin is left for the unpartitioned window.
    everything = Window.partitionBy()

    def share(n: str) -> Column:
        return F.greatest(F.col(n) / F.sum(n).over(everything), F.lit(EMPTY_SHARE))

    before, after = share("n_before"), share("n_after")
    return counts.select("bin", "n_before", "n_after", ((after - before) * F.ln(after / before)).alias("psi"))


def period_change(
    df: DataFrame, entity: str, ts: str, amount: str, period: str, ratio: float
) -> DataFrame:
    """Periods whose total is at least ``ratio`` times the entity's previous active period.

    The window runs over period totals, at most one row a period and entity.
    """
    totals = df.groupBy(entity, F.date_trunc(period, ts).cast("timestamp_ntz").alias("period")).agg(
        total(scaled(amount)).alias("_cents")
    )
    window = Window.partitionBy(entity).orderBy("period")
    return (
        totals.withColumn("_previous", F.lag("_cents").over(window))
        .select(
            entity,
            "period",
            (F.col("_cents").cast("double") / 100).alias("total"),
            (F.col("_previous").cast("double") / 100).alias("previous"),
        )
        .withColumn("ratio", F.try_divide("total", "previous"))
        .where(F.col("ratio") >= ratio)
    )


# Lengths of the calendar's periods.
STEP = {"day": "1 DAY", "week": "7 DAYS", "month": "1 MONTH", "quarter": "3 MONTHS", "year": "1 YEAR"}


def calendar_change(df: DataFrame, entity: str, ts: str, amount: str, period: str, ratio: float) -> DataFrame:
    """Rises, restarts and silences of each entity, against the calendar period before.

    A period without transactions has a total of 0. An entity's calendar runs from its first period to the
    table's last; silent periods in a row are one row from ``first_period`` to ``last_period``, so nothing
    is stored for empty periods. ``change`` is ``rise`` (at least ``ratio`` times the previous total),
    ``restart`` (after silence) or ``silence``. Rows without a time or amount are left out; null entities are one.
    """
    start = F.date_trunc(period, ts).cast("timestamp_ntz")
    known = df.where(F.col(ts).isNotNull() & F.col(amount).isNotNull())
    totals = known.groupBy(F.col(entity), start.alias("_period")).agg(total(scaled(amount)).alias("_cents"))
    end = F.lit(known.agg(F.max(start)).first()[0]).cast("timestamp_ntz")
    step = F.expr(f"INTERVAL {STEP[period]}")
    window = Window.partitionBy(entity).orderBy("_period")
    beside = totals.select(
        "*",
        F.lag("_period").over(window).alias("_before"),
        F.lag("_cents").over(window).alias("_earlier"),
        F.lead("_period").over(window).alias("_after"),
    )
    previous = F.when(F.col("_before") + step == F.col("_period"), F.col("_earlier")).when(F.col("_before").isNotNull(), 0)
    nothing = F.lit(0).cast("decimal(30,0)")
    active = F.struct(
        F.col("_period").alias("first_period"),
        F.col("_period").alias("last_period"),
        F.col("_cents").cast("decimal(30,0)").alias("_now"),
        previous.cast("decimal(30,0)").alias("_then"),
    )
    silent = F.struct(
        (F.col("_period") + step).alias("first_period"),
        (F.coalesce(F.col("_after") - step, end)).alias("last_period"),
        nothing.alias("_now"),
        F.col("_cents").cast("decimal(30,0)").alias("_then"),
    )
    quiet = F.col("_period") + step <= F.coalesce(F.col("_after") - step, end)
    runs = beside.select(entity, F.inline(F.array_compact(F.array(active, F.when(quiet, silent)))))
    change = (
        F.when((F.col("_now") == 0) & (F.col("_then") > 0), "silence")
        .when((F.col("_then") == 0) & (F.col("_now") > 0), "restart")
        .when((F.col("_then") > 0) & (F.try_divide(F.col("_now").cast("double"), F.col("_then").cast("double")) >= ratio), "rise")
    )
    return runs.select(
        entity,
        "first_period",
        "last_period",
        (F.col("_now").cast("double") / 100).alias("total"),
        (F.col("_then").cast("double") / 100).alias("previous"),
        change.alias("change"),
    ).where("change IS NOT NULL")
