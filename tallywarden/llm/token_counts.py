"""Token counts by byte-pair merging, without producing the tokens.

Each word is a doubly linked list of characters. A heap holds the adjacent
pairs that form a piece of the vocabulary; the pair of lowest rank, leftmost
first, is merged until none is left. The count is the number of characters
less the number of merges. A character that is no piece itself counts once for
each of its UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tallywarden.llm.common import importable, whole

SPACE = "▁"
# Words whose counts a worker remembers; beyond that it starts anew.
REMEMBERED = 600_000
# Longer words are counted each time instead of being remembered.
LONGEST_REMEMBERED = 200


def merged_count(word: str, ranks: dict[str, int]) -> int:
    """Tokens of one word: characters less merges, bytes for characters that are no piece."""
    n = len(word)
    base = n + 1
    end = [*range(1, base)]  # where the symbol that starts here ends; 0 if it was merged away
    before = [*range(-1, n)]  # where the symbol that ends here, or the one before it, starts
    # A heap entry is rank, start and end of a pair in one number, which orders as they do.
    find = ranks.get
    heap = [
        (rank * base + i) * base + i + 2 for i in range(n - 1) if (rank := find(word[i : i + 2])) is not None
    ]
    heapify(heap)
    merges = 0
    while heap:
        rest, stop = divmod(heappop(heap), base)
        i = rest % base
        middle = end[i]
        if not middle or middle >= stop or end[middle] != stop:
            continue
        merges += 1
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            after = end[stop]
            rank = find(word[i:after])
            if rank is not None:
                heappush(heap, (rank * base + i) * base + after)
        left = before[i]
        if left >= 0:
            rank = find(word[left:stop])
            if rank is not None:
                heappush(heap, (rank * base + left) * base + stop)
    if n > 1 and merges == n - 1:
        return 1
    spelled = sum(len(c.encode()) - 1 for i, c in enumerate(word) if end[i] == i + 1 and c not in ranks)
    return n - merges + spelled


class PieceCounter:
    """Counts for one vocabulary file of the sentencepiece library.

    The file must be a BPE model that leaves texts as they are, but for a space
    put in front, and spells unknown characters in bytes. Other models are refused.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        sample = "ﬁ a  b\né "
        if model.normalize(sample) != SPACE + sample.replace(" ", SPACE):
            raise ValueError("the model changes texts before it merges")
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ranks = {model.id_to_piece(i): round(-model.get_score(i)) for i in plain}
        if not any(model.is_byte(i) for i in ids):
            raise ValueError("the model doesn't spell unknown characters in bytes")
        if any(SPACE in p.lstrip(SPACE) for p in self.ranks):
            raise ValueError("a piece goes on after a space")
        joined = set("".join(p for p in self.ranks if len(p) > 1))
        # No merge crosses the front of a space, nor a line break that no longer piece holds.
        rest = f"[^{SPACE}]" if "\n" in joined else f"[^{SPACE}\n]"
        self.words = re.compile(f"{SPACE}+{rest}*|{rest}+|\n")
        self.known: dict[str, int] = {}

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, known = 0, self.known
        for word, times in Counter(self.words.findall(SPACE + text.replace(" ", SPACE))).items():
            n = known.get(word)
            if n is None:
                n = merged_count(word, self.ranks)
                if len(word) <= LONGEST_REMEMBERED:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = n
            total += n * times
        return total


@cache
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of each whole text; null and empty texts have none.

    ``path`` is the vocabulary file, at the same place on every machine. All other
    columns stay; one called ``out`` is replaced. Repeated rows are counted each.
    """
    importable(docs.sparkSession)

    @F.pandas_udf("long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = counter(path)
        for texts in batches:
            yield pd.Series([pieces.count(t) for t in texts], dtype="int64")

    return docs.withColumn(out, counts(text))


def over_limit(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """Size in bytes and tokens of each document, and whether it exceeds ``limit`` tokens."""
    counted = token_counts(docs.select("doc_id", whole("text").alias("text")), path)
    return counted.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
