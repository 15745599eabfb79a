"""Mixing sources to target shares by Poisson replication.

A source that should make up more of the output than its size allows has its
documents repeated, one that should make up less has some left out. How often a
document occurs is a Poisson number whose mean is its source's repetition rate.
The number comes from a hash of the document's id by inverting the distribution
function, so that every run and every retry draws the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywarden.llm.common import free_prefix, whole

# Means above this are drawn as the sum of several draws with equal parts of the mean.
MEAN_PER_DRAW = 8.0
# Values of the distribution function kept; what lies beyond has a chance under 1e-30 at that mean.
STEPS = 64


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from a hash of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def repetition_rates(docs: DataFrame, shares: dict[str, float], epochs: float) -> DataFrame:
    """One row per named source and one, with null, for all others: bytes, mean repetition rate.

    ``shares`` are parts of the output in bytes. What they leave of 1 goes to the other
    sources in proportion to their size. The output has ``epochs`` times the bytes of the input.
    Each document counts one byte more than its text, so that sources of empty texts have a size.
    """
    named = F.when(F.col("source").isin(list(shares)), F.col("source"))
    sizes = docs.groupBy(named.alias("_named")).agg(
        F.sum(F.octet_length(whole("text")).cast("long") + 1).alias("n_bytes")
    )
    rest = 1.0 - sum(shares.values())
    if rest < -1e-9 or min(shares.values(), default=0.0) < 0:
        raise ValueError("shares must not be negative, nor add up to more than 1")
    share = F.lit(max(rest, 0.0))
    for name, part in shares.items():
        share = F.when(F.col("_named") == name, F.lit(float(part))).otherwise(share)
    # The window has one row per named source, a parameter's length.
    total = F.sum("n_bytes").over(Window.partitionBy())
    return sizes.select("_named", "n_bytes", (F.lit(float(epochs)) * total * share / F.col("n_bytes")).alias("_rate"))


def inverse_table(rate: Column) -> Column:
    """Values of the Poisson distribution function at 0, 1, 2 and so on."""
    first = F.exp(-rate)

    def step(state: Column, k: Column) -> Column:
        chance = state["chance"] * rate / k
        upto = state["upto"] + chance
        return F.struct(
            chance.alias("chance"), upto.alias("upto"), F.concat(state["all"], F.array(upto)).alias("all")
        )

    start = F.struct(first.alias("chance"), first.alias("upto"), F.array(first).alias("all"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)["all"]


def mix_sources(docs: DataFrame, shares: dict[str, float], epochs: float = 1.0, seed: int = 0) -> DataFrame:
    """Documents repeated to the target shares, in a global random order.

    Adds ``copy`` (from 1) and ``shuffle_key``; columns of these names are replaced. Documents
    drawn zero times are left out; an empty table gives none. A null text counts as empty. A share of a source that
    has no documents is not dealt to others. A null source belongs to the others. A null id draws
    by its text. Repeated rows draw the same number, each of its own. The rows are dealt to partitions
    by ``shuffle_key`` and sorted by it within each.
    """
    own = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    free = free_prefix(docs.columns)
    named_of, rate_of, table, number, times_ = (free + name for name in ("named_of", "rate_of", "table", "draws", "times"))
    rates = repetition_rates(docs, shares, epochs)
    draws = F.greatest(F.ceil(F.col("_rate") / MEAN_PER_DRAW), F.lit(1)).cast("int")
    rates = rates.select("_named", draws.alias("_draws"), (F.col("_rate") / draws).alias("_mean"))
    rates = rates.select(F.col("_named").alias(rate_of), F.col("_draws").alias(number), inverse_table(F.col("_mean")).alias(table))
    named = F.when(F.col("source").isin(list(shares)), F.col("source"))
    placed = docs.select(*own).withColumn(named_of, named)
    # The table of rates has a row per named source and one more.
    joined = placed.join(F.broadcast(rates), F.col(named_of).eqNullSafe(F.col(rate_of)))
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(whole("text")))

    def drawn(count: Column, draw: Column) -> Column:
        at = uniform(F.lit(str(seed)), draw.cast("string"), name)
        # Bound once, so that the hash isn't taken for each step of the table.
        return count + F.transform(F.array(at), lambda u: F.size(F.filter(table, lambda c: c <= u)))[0]

    counts = F.aggregate(F.sequence(F.lit(1), F.col(number)), F.lit(0), drawn)
    times = joined.select(*own, counts.alias(times_)).where(F.col(times_) > 0)
    copies = times.select(*own, F.explode(F.sequence(F.lit(1), F.col(times_))).alias("copy"))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed} order"), name, "copy")), 1, 15), 16, 10)
    keyed = copies.withColumn("shuffle_key", key.cast("long"))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "doc_id")
