"""Who pays whom: concentration, new and shared counterparties, linked groups.

``edges`` has one row per payment with payer, payee, txn_id, ts and amount.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallywarden.functions.exact import scaled, total, total_product
from tallywarden.operators.amounts import mad_score
from tallywarden.plans.ordered import ordering, running_sums
from tallywarden.plans.quantiles import VALUES_PER_TASK
from tallywarden.plans.skew import ROWS_PER_TASK
from tallywarden.session import dropped, kept, written


def pair_totals(edges: DataFrame) -> DataFrame:
    """Payments and amount in cents per payer and payee."""
    return edges.groupBy("payer", "payee").agg(
        F.count(F.lit(1)).alias("n"), total(scaled("amount")).alias("cents")
    )


def pair_concentration(edges: DataFrame, min_n: int) -> DataFrame:
    """Pairs with at least ``min_n`` payments."""
    return (
        pair_totals(edges)
        .where(F.col("n") >= min_n)
        .select("payer", "payee", "n", (F.col("cents").cast("double") / 100).alias("amount"))
    )


def new_counterparty(edges: DataFrame) -> DataFrame:
    """The first payment of each pair; an aggregate, so nothing has to be sorted."""
    first = edges.groupBy("payer", "payee").agg(F.min(F.struct("ts", "txn_id")).alias("_first"))
    return first.select(
        "payer", "payee", F.col("_first.ts").alias("first_ts"), F.col("_first.txn_id").alias("first_txn")
    )


def hhi(edges: DataFrame) -> DataFrame:
    """Concentration of each payer's spend: the sum of squared payee shares, 1 for a single payee."""
    cents = F.col("cents").cast("decimal(18,0)")
    sums = (
        pair_totals(edges)
        .groupBy("payer")
        .agg(
            F.count(F.lit(1)).alias("n_payees"),
            F.sum("cents").cast("double").alias("_s"),
            total_product(cents, cents).cast("double").alias("_ss"),
        )
    )
    return sums.select("payer", "n_payees", F.try_divide("_ss", F.col("_s") * F.col("_s")).alias("hhi"))


def top_counterparties(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest payees of each payer, with ties.

    Spark cuts each task's rows to rank ``k`` before the shuffle.
    """
    window = Window.partitionBy("payer").orderBy(F.desc("cents"))
    return (
        pair_totals(edges)
        .withColumn("rank", F.rank().over(window))
        .where(F.col("rank") <= k)
        .select("payer", "payee", (F.col("cents").cast("double") / 100).alias("amount"), "rank")
    )


def shared_counterparties(edges: DataFrame, flagged: DataFrame, min_shared: int) -> DataFrame:
    """Payers that share at least ``min_shared`` payees with the flagged payers.

    Every payer is compared with the payees of the flagged set, not with every
    other payer, so the work grows with the number of payments. ``flagged`` has
    one column, payer.
    """
    pairs = written(edges.select("payer", "payee").distinct())
    listed = flagged.select(F.col("payer").alias("_listed")).distinct()
    watched = (
        pairs.join(listed, F.col("payer") == F.col("_listed"), "left_semi")
        .select(F.col("payee").alias("_payee"))
        .distinct()
        .withColumn("_watched", F.lit(1))
    )
    others = pairs.join(listed, F.col("payer") == F.col("_listed"), "left_anti")
    return (
        others.join(watched, F.col("payee") == F.col("_payee"), "left")
        .groupBy("payer")
        .agg(F.count(F.lit(1)).alias("n_payees"), F.count("_watched").alias("n_shared"))
        .where(F.col("n_shared") >= min_shared)
    )


def payee_prefixes(pairs: DataFrame, min_shared: int, limit: int = ROWS_PER_TASK, meet: int = 1) -> DataFrame:
    """The rarest payees of each payer: enough of them that payers sharing ``min_shared`` payees share ``meet`` of these.

    Payees are ordered by rarity, ties by id. Of n payees the first n - min_shared + meet are kept, with their
    place ``pos`` (from 1) and n; payers with fewer than ``min_shared`` payees have none. Payees that almost
    everyone pays come last and seldom remain.
    """
    spread = pairs.groupBy(F.col("payee").alias("_payee")).agg(F.count(F.lit(1)).alias("degree"))
    rated = pairs.join(spread, F.col("payee") == F.col("_payee")).drop("_payee")
    sizes = pairs.groupBy(F.col("payer").alias("_payer")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_shared)
    by = ordering(rated, ["payer"], ["degree", "payee"], limit)
    placed = running_sums(rated, by, {"pos": F.lit(1)}).join(sizes, F.col("payer") == F.col("_payer"))
    return placed.where(F.col("pos") <= F.col("n") - min_shared + meet).select("payer", "payee", "pos", "n")


# Longs of 64 bits in the bitmap of a payer's payees.
BITMAP_LONGS = 4


def payee_bitmaps(pairs: DataFrame) -> DataFrame:
    """For each payer a bitmap of fixed size, ``bits_0`` and on, with a bit set for every payee, and its ``slack``.

    The slack is how many payees found their bit already set. Two payers share at most as many payees as
    their bitmaps share bits, and the smaller slack.
    """
    place = F.pmod(F.xxhash64("payee"), F.lit(64 * BITMAP_LONGS)).cast("int")
    placed = pairs.select("payer", (place % 64).alias("_bit"), F.floor(place / 64).cast("int").alias("_long"))
    bit = F.expr("shiftleft(1L, _bit)")
    longs = [F.bit_or(F.when(F.col("_long") == i, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"bits_{i}") for i in range(BITMAP_LONGS)]
    each = placed.groupBy("payer").agg(F.count(F.lit(1)).alias("_n"), *longs)
    used = sum((F.bit_count(f"bits_{i}") for i in range(BITMAP_LONGS)), F.lit(0))
    return each.select("payer", (F.col("_n") - used).cast("int").alias("slack"), *(f"bits_{i}" for i in range(BITMAP_LONGS)))


def shared_pairs(edges: DataFrame, min_shared: int, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Pairs of payers with at least ``min_shared`` payees in common, and how many they share.

    Exact for any data, hubs included. Only payers that meet in their prefixes are compared, and only if
    the payees that can still follow there, and the bits their bitmaps share, are enough; the rest is counted
    payee by payee, so no payer's payees are gathered into one row. The bitmaps travel with the prefixes, so that
    pairs they exclude are not shuffled. Rows without a payer or payee share nothing.
    """
    known = edges.where("payer IS NOT NULL AND payee IS NOT NULL").select("payer", "payee").distinct()
    pairs = kept(known, "pairs")
    # With larger overlaps to find, payers have to meet several times in slightly longer prefixes.
    meet = max(1, min_shared // 6)
    bitmaps = payee_bitmaps(pairs).withColumnRenamed("payer", "_payer")
    prefixes = payee_prefixes(pairs, min_shared, limit, meet).join(bitmaps, F.col("payer") == F.col("_payer")).drop("_payer")
    prefixes = kept(prefixes, "prefixes")
    # Shuffled before the columns are renamed, both sides read the same files.
    by_payee = prefixes.repartition("payee")
    bits = [f"bits_{i}" for i in range(BITMAP_LONGS)]
    left, right = (
        by_payee.select(F.col("payee").alias(f"_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in ("payer", "pos", "n", "slack", *bits)))
        for x in "ab"
    )
    ahead = 1 + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    alike = sum((F.bit_count(F.col(f"{b}_a").bitwiseAND(F.col(f"{b}_b"))) for b in bits), F.least("slack_a", "slack_b"))
    near = (ahead > min_shared - meet) & (alike >= min_shared)
    met = left.join(right, (F.col("_a") == F.col("_b")) & (F.col("payer_a") < F.col("payer_b")) & near)
    candidates = kept(met.groupBy("payer_a", "payer_b").count().where(F.col("count") >= meet).drop("count"), "candidates")
    dropped(prefixes)
    first = candidates.join(pairs, F.col("payer_a") == F.col("payer")).select("payer_a", "payer_b", F.col("payee").alias("_payee"))
    both = first.join(pairs, (F.col("payer_b") == F.col("payer")) & (F.col("_payee") == F.col("payee")))
    return both.groupBy("payer_a", "payer_b").agg(F.count(F.lit(1)).alias("n_shared")).where(F.col("n_shared") >= min_shared)


def degree_outliers(edges: DataFrame, k: float, limit: int = VALUES_PER_TASK) -> DataFrame:
    """Payers and payees whose number of distinct counterparties is unusual for their side."""
    pairs = written(edges.select("payer", "payee").distinct())

    def degrees(column: str, side: str) -> DataFrame:
        return pairs.groupBy(F.col(column).alias("entity_id")).agg(
            F.lit(side).alias("side"), F.count(F.lit(1)).cast("double").alias("degree")
        )

    both = written(degrees("payer", "out").unionByName(degrees("payee", "in")))
    return mad_score(both, "side", "degree", k, limit).withColumn("degree", F.col("degree").cast("bigint"))


def linked_groups(pairs: DataFrame, a: str, b: str, max_rounds: int = 64) -> DataFrame:
    """Connected groups of linked ids; a group is named after its smallest id.

    Each round points every id to its smallest neighbour, follows the pointers
    to their ends, and contracts the links to those ends. Of two linked ids the
    larger one always disappears; groups not done after ``max_rounds`` are an error.
    Every round is checkpointed to the shared folder: the plan stays short, and
    a lost executor costs one round at most.
    """
    links = pairs.select(F.col(a).alias("_a"), F.col(b).alias("_b")).where("_a IS NOT NULL AND _b IS NOT NULL")
    links = written(links)
    # An id alone, linked only to itself, is a group too.
    ends = links.select(F.inline(F.array(F.struct(F.col("_a").alias("node")), F.struct(F.col("_b").alias("node")))))
    groups = ends.distinct().select("node", F.col("node").alias("group"))
    links = written(_tidy(links))
    for _ in range(max_rounds):
        if links.isEmpty():
            return groups
        roots = _roots(links)
        # Roots are unique by id; links of a busy id are split over tasks by AQE.
        ra, rb = (roots.select(F.col("id").alias(f"_id{c}"), F.col("root").alias(f"_root{c}")) for c in "ab")
        contracted = links.join(ra, F.col("_a") == F.col("_ida")).join(rb, F.col("_b") == F.col("_idb"))
        links = written(_tidy(contracted.select(F.col("_roota").alias("_a"), F.col("_rootb").alias("_b"))))
        renamed = groups.join(roots, F.col("group") == F.col("id"), "left")
        groups = written(renamed.select("node", F.coalesce("root", "group").alias("group")))
    raise RuntimeError(f"groups not complete after {max_rounds} rounds")


def _tidy(links: DataFrame) -> DataFrame:
    """Each link once, smaller id first, without links of an id to itself."""
    return (
        links.where("_a <> _b")
        .select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b"))
        .distinct()
    )


def _roots(links: DataFrame) -> DataFrame:
    """Where each id ends up by always stepping to its smallest neighbour."""
    steps = links.select(
        F.inline(
            F.array(
                F.struct(F.col("_a").alias("id"), F.col("_b").alias("to")),
                F.struct(F.col("_b").alias("id"), F.col("_a").alias("to")),
            )
        )
    )
    roots = written(steps.groupBy("id").agg(F.least("id", F.min("to")).alias("root")))
    while True:
        onward = roots.select(F.col("id").alias("_id"), F.col("root").alias("_onward"))
        moved = (F.col("_onward") != F.col("root")).alias("_moved")
        jumped = written(
            roots.join(onward, F.col("root") == F.col("_id")).select("id", F.col("_onward").alias("root"), moved)
        )
        roots = jumped.select("id", "root")
        if jumped.where("_moved").isEmpty():
            return roots
