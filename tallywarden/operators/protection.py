"""Protecting records and screening names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallywarden.functions.text import (
    CARD,
    EMAIL,
    PHONE,
    band_signatures,
    edit_classes,
    edited_forms,
    luhn_valid,
    masked,
    normalise,
    pseudonym,
    within_deletions,
)


def pseudonymise(df: DataFrame, cols: list[str], salt: str) -> DataFrame:
    """Replace columns by salted tokens that still join with each other."""
    return df.withColumns({c: pseudonym(salt, F.col(c)) for c in cols})


def mask(df: DataFrame, rules: dict[str, int]) -> DataFrame:
    """Hide all but the last characters; ``rules`` gives how many to keep per column."""
    return df.withColumns({c: masked(F.col(c), keep) for c, keep in rules.items()})


def k_anonymity(df: DataFrame, quasi: list[str], k: int) -> DataFrame:
    """Combinations of quasi-identifiers shared by fewer than ``k`` rows."""
    return df.groupBy(*quasi).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < k)


def screen_exact(df: DataFrame, name: str, watchlist: DataFrame, listed: str) -> DataFrame:
    """Rows whose normalised name is on the list.

    No broadcast is forced: the list may be long, and Spark picks the join by its size.
    """
    entries = watchlist.select(normalise(F.col(listed)).alias("_entry")).distinct()
    return df.join(entries, normalise(F.col(name)) == F.col("_entry"), "left_semi")


def screen_fuzzy(
    df: DataFrame, name: str, watchlist: DataFrame, listed: str, max_dist: int
) -> DataFrame:
    """Rows with listed names at most ``max_dist`` edits from their own, both normalised.

    Distinct names are matched through the forms both have after that many edits, which
    misses nothing and compares only names that are alike. Copies of a
    name are matched once and rejoined afterwards. The columns of ``watchlist``
    are added to those of ``df``.
    """
    ours = df.withColumn("_name", normalise(F.col(name)))
    theirs = watchlist.withColumn("_entry", normalise(F.col(listed)))
    near = _near(_distinct(df, name, "_name"), _distinct(watchlist, listed, "_entry"), max_dist)
    return ours.join(near, "_name").join(theirs, "_entry").drop("_name", "_entry")


def _distinct(table: DataFrame, name: str, alias: str) -> DataFrame:
    """Each normalised name once."""
    return table.select(normalise(F.col(name)).alias(alias)).where(F.col(alias).isNotNull()).distinct()


def _near(names: DataFrame, entries: DataFrame, max_dist: int) -> DataFrame:
    """Pairs of ``_name`` and ``_entry`` at most ``max_dist`` edits apart, with their distance, each once."""
    left, right = _forms(names, "_name", entries, "_entry", max_dist, False), _forms(entries, "_entry", names, "_name", max_dist, True)
    return (
        left.join(right, "_form")
        .select("_name", "_entry", F.levenshtein("_name", "_entry", max_dist).alias("distance"))
        .where("distance >= 0")
        .distinct()
    )


def _dealt(table: DataFrame, column: str) -> DataFrame:
    """Names are few bytes and much work, so that the number of their partitions must not follow from their size.

    By the name itself the partitions of a grouping would be kept, which Spark puts together by size.
    """
    return table.repartition(table.sparkSession.sparkContext.defaultParallelism * 4, F.xxhash64(column))


def _forms(table: DataFrame, column: str, others: DataFrame, other: str, max_dist: int, listed: bool) -> DataFrame:
    """Each text with its ``edited_forms`` of the classes that lead to a length of some text of the others."""
    # One row for each length.
    lengths = F.broadcast(others.select(F.length(other).alias("_length")).distinct())
    classes = edit_classes(max_dist)
    each = _dealt(table, column).select(column, F.explode(F.array(*(F.lit(k) for k in range(len(classes))))).alias("_class"))
    longer = F.element_at(F.array(*(F.lit(d - i if listed else i - d) for d, i in classes)), F.col("_class") + 1)
    met = each.join(lengths, F.length(column) + longer == F.col("_length"), "left_semi")
    forms = (F.when(F.col("_class") == k, edited_forms(F.col(column), c, max_dist, listed)) for k, c in enumerate(classes))
    # No name is without forms; the outer form keeps Spark from making them a second time to see that.
    return met.select(column, F.explode_outer(F.coalesce(*forms)).alias("_form"))


# Bands of an index of names, and hashes in each.
BANDS, ROWS_PER_BAND = 20, 2
# Names up to this length share too few letter pairs with near ones. They are indexed by what is left after deletions.
SHORT = 10


def _signatures(name: Column, max_dist: int, longest: int) -> Column:
    """Signatures of a name's bands and, up to a length, of all texts it can be shortened to."""
    shortened = F.transform(within_deletions(name, max_dist), lambda v: F.xxhash64(F.lit("shortened"), v))
    bands = band_signatures(name, BANDS, ROWS_PER_BAND)
    both = F.when(F.length(name) <= longest, F.concat(bands, shortened)).otherwise(bands)
    return F.when(F.length(name) <= F.lit(SHORT), shortened).otherwise(both)


def index_names(watchlist: DataFrame, listed: str, max_dist: int) -> DataFrame:
    """Index of a list of names for screenings with up to ``max_dist`` edits, to be stored and used any number of times.

    Each distinct normalised name is there under its signatures: ``BANDS`` of them, or for names of up to
    ``SHORT`` characters all that deletions make of them, a number that ``SHORT`` bounds.
    """
    entries = watchlist.select(normalise(F.col(listed)).alias("entry")).where("entry IS NOT NULL").distinct()
    return entries.select("entry", F.explode(_signatures(F.col("entry"), max_dist, SHORT)).alias("signature"))


def screen_indexed(df: DataFrame, name: str, index: DataFrame, max_dist: int) -> DataFrame:
    """Rows with indexed names at most ``max_dist`` edits from their own: ``entry`` and ``distance`` are added.

    Names that share a signature are compared letter by letter, so every hit is a true one. None is missed
    among names of up to ``SHORT`` characters, few among longer ones. ``screen_fuzzy`` misses none at all but
    needs about (length ^ max_dist) / max_dist! rows a name.
    """
    ours = df.withColumn("_name", normalise(F.col(name)))
    near = _near_indexed(_distinct(df, name, "_name"), index, max_dist).withColumnRenamed("_name", "_found")
    return ours.join(near, F.col("_name") == F.col("_found")).drop("_name", "_found")


def _near_indexed(names: DataFrame, index: DataFrame, max_dist: int) -> DataFrame:
    """Pairs of ``_name`` and indexed ``entry`` that share a signature and are near, with their distance, each once."""
    signed = _dealt(names, "_name").select("_name", F.explode(_signatures(F.col("_name"), max_dist, SHORT + max_dist)).alias("_signature"))
    together = signed.join(index, F.col("_signature") == F.col("signature"))
    return (
        together.select("_name", "entry")
        .distinct()
        .withColumn("distance", F.levenshtein("_name", "entry", max_dist))
        .where("distance >= 0")
    )


def screening_recall(df: DataFrame, name: str, watchlist: DataFrame, listed: str, max_dist: int, index: DataFrame) -> DataFrame:
    """How many of the exact near matches an index finds: n_exact, n_found and recall, one row.

    Matches are pairs of different normalised names, not rejoined with the copies of either. The index finds a match
    if the two share a signature there, which is all that ``screen_indexed`` asks of them besides; so only matches are looked at,
    not all names that share one. A match with an entry that only the index has is found, but none of the exact ones.
    """
    names = _distinct(df, name, "_name")
    indexed = index.groupBy(F.col("entry").alias("_entry")).agg(F.collect_set("signature").alias("_indexed"))
    entries = _distinct(watchlist, listed, "_entry").withColumn("_listed", F.lit(True)).join(indexed, "_entry", "full")
    signed = _dealt(names, "_name").select("_name", _signatures(F.col("_name"), max_dist, SHORT + max_dist).alias("_signed"))
    pairs = _near(names, entries.select("_entry"), max_dist).select("_name", "_entry")
    both = pairs.join(entries, "_entry").join(signed, "_name")
    return both.agg(
        F.count_if(F.col("_listed")).alias("n_exact"), F.count_if(F.arrays_overlap("_indexed", "_signed")).alias("n_found")
    ).withColumn("recall", F.try_divide("n_found", "n_exact"))


def scan_sensitive(df: DataFrame, text: str, by: str) -> DataFrame:
    """Per store of records: how many hold e-mail addresses, phone and card numbers, and how many of each.

    A control report on where personal and card data has ended up. Card-like
    numbers count only with a valid check digit. Whole texts are read.
    """

    def found(pattern: str) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    counted = df.select(
        by,
        F.size(found(EMAIL)).alias("_email"),
        F.size(found(PHONE)).alias("_phone"),
        F.size(F.filter(found(CARD), luhn_valid)).alias("_card"),
    )
    return counted.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_records"),
        *(F.count_if(F.col(f"_{kind}") > 0).alias(f"with_{kind}") for kind in ("email", "phone", "card")),
        *(F.sum(F.greatest(F.col(f"_{kind}"), F.lit(0))).alias(f"n_{kind}") for kind in ("email", "phone", "card")),
    )
