"""Winnowed fingerprints of documents.

Every ``GRAM`` words in a row are hashed. Of every ``WINDOW`` hashes in a row the
smallest is kept, the rightmost of equals, with its position. Two texts that share
GRAM + WINDOW - 1 words in a row therefore share a kept hash. Texts too short for that
keep all their hashes and some of their letters', and a word as long as a sentence counts
letter by letter, as scripts without spaces have them. All of it is column
expressions, so it runs inside the JVM without shuffling the text for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywarden.llm.common import text_key, whole

GRAM = 3
WINDOW = 8
# Longer words are taken letter by letter. Texts with fewer words keep all grams, of words and of letters.
LONG_WORD, SHORT, LETTERS = 24, 20, 3
# A kept hash has 36 bits; the 27 below them hold its position counted from the largest.
POSITION_BITS = 27
LAST_POSITION = (1 << POSITION_BITS) - 1
# Parts per shuffle partition that documents are cut into by id, and their number at most.
PARTS_PER_PARTITION = 4
MOST_PARTS = 4_000


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Parts between white space; a text without any is one word."""
    for mark in "\n\t\r":
        text = F.replace(text, F.lit(mark), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def units(text: Column) -> Column:
    """The words of a text; of words of more than ``LONG_WORD`` characters, the characters."""

    def split(all_words: Column) -> Column:
        apart = F.flatten(F.transform(all_words, lambda w: F.when(F.length(w) > LONG_WORD, F.split(w, "")).otherwise(F.array(w))))
        return F.when(F.exists(all_words, lambda w: F.length(w) > LONG_WORD), F.array_remove(apart, "")).otherwise(all_words)

    return bound(words(text), split)


def packed(hashed: Column, position: Column) -> Column:
    """Hash and position in one number: the smallest is the smallest hash, rightmost first."""
    return F.shiftleft(F.shiftrightunsigned(hashed, 64 - 36), POSITION_BITS).bitwiseOR(
        F.lit(LAST_POSITION).cast("long") - position.cast("long").bitwiseAND(F.lit(LAST_POSITION).cast("long"))
    )


def fingerprint(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Kept hashes with positions, packed, in the order of the text.

    Fewer than ``gram`` words are hashed as one; a text without words has no hashes. The
    guarantee: texts with gram + window - 1 words in a row in common share a kept hash. Texts of fewer than ``SHORT``
    words keep all hashes, followed by those of ``LETTERS`` characters in a row: with the longest word, some 500.
    """

    def grams(h: Column, size: int) -> Column:
        return F.when(
            F.size(h) >= size,
            F.transform(
                F.sequence(F.lit(0), F.size(h) - size),
                lambda i: packed(F.xxhash64(*(F.get(h, i + j) for j in range(size))), i),
            ),
        )

    def minima(g: Column) -> Column:
        return F.when(
            F.size(g) > window,
            F.array_distinct(
                F.transform(F.sequence(F.lit(1), F.size(g) - window + 1), lambda i: F.array_min(F.slice(g, i, window)))
            ),
        ).otherwise(g)

    nothing = F.array().cast("array<long>")

    def of_few(w: Column, h: Column) -> Column:
        one = F.when(F.size(h) > 0, F.array(packed(F.xxhash64(h), F.lit(0)))).otherwise(nothing)
        letters = F.transform(F.array_remove(F.split(F.array_join(w, " "), ""), ""), lambda c: F.xxhash64(c))
        spelled = bound(letters, lambda c: grams(c, LETTERS))
        return F.concat(F.coalesce(grams(h, gram), one), F.coalesce(spelled, nothing))

    def kept(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        return bound(hashes, lambda h: F.when(F.size(h) >= max(SHORT, gram), bound(grams(h, gram), minima)).otherwise(of_few(w, h)))

    return bound(units(text), kept)


def shown(kept: Column) -> Column:
    """A fingerprint as text: position and hash of each kept gram."""
    return F.array_join(
        F.transform(
            kept,
            lambda x: F.concat(
                (F.lit(LAST_POSITION).cast("long") - x.bitwiseAND(F.lit(LAST_POSITION).cast("long"))).cast("string"),
                F.lit(":"),
                F.lower(F.hex(F.shiftright(x, POSITION_BITS))),
            ),
        ),
        ",",
    )


def hash_set(kept: Column) -> Column:
    return F.array_distinct(F.transform(kept, lambda x: F.shiftright(x, POSITION_BITS)))


def likeness(a: Column, b: Column) -> Column:
    """Share of kept hashes in common; 1 for two empty sets."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def part_of(doc_id: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below an id, by looking through chunk heads and then one chunk."""
    if not cuts:
        return F.lit(0)
    width = max(1, round(len(cuts) ** 0.5))
    chunks = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    heads = F.array(*(F.lit(c[0]) for c in chunks))
    table = F.array(*(F.array(*(F.lit(x) for x in c)) for c in chunks))
    chunk = F.size(F.filter(heads, lambda c: c <= doc_id))
    inside = F.size(F.filter(F.get(table, chunk - 1), lambda c: c <= doc_id))
    return F.when(doc_id.isNull() | (chunk == 0), 0).otherwise((chunk - 1) * width + inside)


def with_next(docs: DataFrame, carried: dict[str, Column]) -> DataFrame:
    """Add to each document, as ``_next_``, the named values of the next one by ascending ``doc_id``.

    After the last comes the first; a single document is its own next. Null ids come first,
    rows of equal id go by a hash of their text. Documents are cut into parts by id; the first of each part
    is copied to the end of the part before, so that a window over each part is enough.
    Rows that share one id stay in one part. Returns doc_id, text and ``_next_`` columns.
    """
    spark = docs.sparkSession
    parts = min(MOST_PARTS, PARTS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 100 * parts)).first()[0] if shares else None
    cuts = sorted({*(found or [])})
    rows = docs.select("doc_id", whole("text").alias("text")).withColumn("_part", part_of(F.col("doc_id"), cuts))
    # At most one row for each part: its smallest id.
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id"))["doc_id"]
    heads = sorted((r["_part"], r["doc_id"]) for r in docs.groupBy(part_of(F.col("doc_id"), cuts).alias("_part")).agg(first.alias("doc_id")).collect())
    moved = [(heads[i - 1][0], head) for i, (_, head) in enumerate(heads)]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    small = spark.createDataFrame(moved, f"_to int, _head {id_type}")
    copies = rows.join(F.broadcast(small), rows["doc_id"].eqNullSafe(F.col("_head"))).select(
        "doc_id", "text", F.col("_to").alias("_part"), F.lit(False).alias("_own")
    )
    together = rows.withColumn("_own", F.lit(True)).unionByName(copies).repartition("_part")
    valued = together.withColumns({"_key": text_key("text"), **carried})
    in_order = Window.partitionBy("_part").orderBy(F.desc("_own"), F.asc_nulls_first("doc_id"), "_key")
    return (
        valued.select(
            "doc_id",
            "text",
            "_own",
            *carried,
            F.lead("text").over(in_order).alias("_next_text"),
            *(F.lead(c).over(in_order).alias(f"_next{c}") for c in carried),
        )
        .where("_own")
        .drop("_own")
    )


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and the next document's are.

    The edited text has the last half of the code points replaced by the first as many of the next document.
    Null texts are empty. Repeated rows each have a row. An empty table gives none. Other columns are not looked at.
    """
    rows = with_next(docs, {"_print": fingerprint(F.col("text"))})
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("_next_text"), F.lit(1), half)
    )
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "_print", "_next_print", edited.alias("_edited"))
    rows = rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("_edited"), 256).alias("edited_sha256"),
        "_print",
        fingerprint(F.col("_edited")).alias("_edited_print"),
        hash_set(F.col("_next_print")).alias("_next_set"),
    )
    rows = rows.withColumns({"_set": hash_set(F.col("_print")), "_edited_set": hash_set(F.col("_edited_print"))})
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown(F.col("_print")).alias("fingerprint"),
        shown(F.col("_edited_print")).alias("edited_fingerprint"),
        likeness(F.col("_set"), F.col("_edited_set")).alias("near_edited"),
        likeness(F.col("_set"), F.col("_next_set")).alias("near_next"),
    )
