"""Column expressions on names and free text."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, functions as F

# Patterns for personal and card data in free text.
EMAIL = r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
PHONE = r"\+[0-9]{1,3}[ -]?\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4}"
CARD = r"\b[0-9](?:[ -]?[0-9]){12,18}\b"


@cache
def _accented() -> tuple[str, str]:
    """Letters of Unicode's basic plane that are one other letter with marks, and those letters."""
    bare = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in (*range(0xC0, 0x2000), *range(0x2C60, 0x2E00), *range(0xA720, 0xAC00))}
    single = {k: v[0] for k, v in bare.items() if len(v) > 1 and all(unicodedata.combining(m) for m in v[1:])}
    return "".join(single), "".join(single.values())


def without_accents(col: Column) -> Column:
    """Letters without their accents, whether these are part of the letter or follow it."""
    return F.regexp_replace(F.translate(col, *_accented()), r"[\u0300-\u036F]+", "")


def normalise(col: Column) -> Column:
    """Lower case, no accents, letters and digits of any script only, single spaces; null if none are left.

    Texts without letters or digits say nothing about a name, so they must not equal each other.
    """
    spaced = F.trim(F.regexp_replace(without_accents(F.lower(col)), r"[^\p{L}\p{N}]+", " "))
    return F.when(spaced != "", spaced)


def pseudonym(salt: str, *cols: Column) -> Column:
    """A salted token that is equal wherever the same values are hashed with the same salt.

    A null value stays null, so that unknown values don't join with each other. Several
    values are told apart by their lengths.
    """
    texts = [c.cast("string") for c in cols]
    if len(texts) > 1:
        texts = [F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts]
    # Unlike concat_ws, concat is null if a part is.
    return F.sha2(F.concat(F.lit(salt), *(x for t in texts for x in (F.lit("|"), t))), 256)


def masked(col: Column, keep: int, fill: str = "X") -> Column:
    """Hide all but the last ``keep`` characters."""
    hidden = F.greatest(F.length(col) - keep, F.lit(0))
    return F.concat(F.repeat(F.lit(fill), hidden), F.right(col, F.least(F.length(col), F.lit(keep))))


def luhn_valid(number: Column) -> Column:
    """Check-digit test for a card-like number; separators are ignored."""
    digits = F.split(F.reverse(F.regexp_replace(number, "[^0-9]", "")), "")

    def weigh(d: Column, i: Column) -> Column:
        doubled = d.cast("int") * (i % 2 + 1)
        return F.when(doubled > 9, doubled - 9).otherwise(doubled)

    checksum = F.aggregate(F.transform(digits, weigh), F.lit(0), lambda acc, x: acc + x)
    return checksum % 10 == 0


def within_deletions(col: Column, depth: int) -> Column:
    """Every text reachable by deleting up to ``depth`` characters.

    Two texts within edit distance ``depth`` always share one of these, so an
    equality join on them finds every near match without comparing all pairs.
    """
    reach = F.array(col)
    for _ in range(depth):
        reach = F.array_distinct(F.concat(reach, F.flatten(F.transform(reach, _one_deletion))))
    return reach


def _one_deletion(text: Column) -> Column:
    return F.when(
        F.length(text) > 0,
        F.transform(
            F.sequence(F.lit(1), F.length(text)),
            lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))),
        ),
    ).otherwise(F.array().cast("array<string>"))


def edit_classes(depth: int) -> list[tuple[int, int]]:
    """(deletions, insertions) of the ways to edit a text ``depth`` times; the other edits replace a character."""
    return [(d, i) for d in range(depth + 1) for i in range(depth + 1 - d)]


def edited_forms(col: Column, edits: tuple[int, int], depth: int, listed: bool) -> Column:
    """Hashes of what is left of a text by one of the ``edit_classes``: characters deleted, others replaced by a sign that no normalised text has.

    Of two texts the first one loses its deletions and the second one, which is ``listed``, what is inserted. They share such a hash for some class
    if they are at most ``depth`` edits apart and, but for equal hashes of different forms, only then.
    """
    reach = F.array(col)
    for _ in range(edits[listed]):
        reach = F.array_distinct(F.flatten(F.transform(reach, _one_deletion)))
    for _ in range(depth - sum(edits)):
        reach = F.array_distinct(F.flatten(F.transform(reach, _one_replaced)))
    return F.transform(reach, lambda form: F.xxhash64(F.lit(edits[0]), F.lit(edits[1]), form))


def _one_replaced(text: Column) -> Column:
    return F.when(
        F.length(text) > 0,
        F.transform(
            F.sequence(F.lit(1), F.length(text)),
            lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.lit("?"), F.substring(text, i + 1, F.length(text))),
        ),
    ).otherwise(F.array(text))


def band_signatures(name: Column, bands: int, rows: int) -> Column:
    """MinHash signatures of a name's letter pairs, one for each band of ``rows`` hashes.

    Names that share a large part of their pairs share a signature with high probability: 1 - (1 - j^rows)^bands
    for a Jaccard similarity j. The name's ends count as letters, so that a name of one letter has pairs too.
    """
    padded = F.concat(F.lit("^"), name, F.lit("$"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2)))

    def least(seed: int) -> Column:
        return F.array_min(F.transform(pairs, lambda g: F.xxhash64(g, F.lit(seed))))

    signatures = [F.xxhash64(F.lit(b), *(least(b * rows + r) for r in range(rows))) for b in range(bands)]
    return F.when(name.isNotNull(), F.array(*signatures))
