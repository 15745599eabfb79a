"""Byte-level BPE encoding and decoding with the tokenizers library.

A byte-level tokenizer writes each byte as one printable character, so that it
can work on text. Tokens may therefore end inside a character; decoding turns
the characters of all tokens back into bytes before it reads them as UTF-8.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from tallywarden.llm.common import importable, whole

# Characters outside the long settled blocks of Unicode. Libraries that know different versions of
# Unicode disagree on which of these are letters, so texts that hold any are split by tokenizers itself.
UNSETTLED = re.compile("[^\\x00-\u036f\u0400-\u0481\u048a-\u0527\u2010-\u2027\u20ac]")
# Matches whose ids a worker remembers, and the longest of them; beyond that it starts anew.
REMEMBERED = 200_000
LONGEST_REMEMBERED = 200
# Texts given to the library at once are no longer than this, unless one is.
CHARS_AT_ONCE = 1 << 20


def byte_characters() -> list[str]:
    """The character for each byte: itself if printable, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Decoder:
    """The bytes of each rank of a file. A worker that only decodes holds no tokenizer."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]
        self.bytes_of = [b""] * (max(rank for _, rank in ranks) + 1)
        for token, rank in ranks:
            self.bytes_of[rank] = token

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


class Codec(Decoder):
    """Encoder and decoder for one file of ranks."""

    def __init__(self, path: str, pattern: str):
        super().__init__(path)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        shown = byte_characters()
        vocab = {"".join(shown[b] for b in token): rank for token, rank in ranks.items()}
        # Any two tokens that join to a third may merge, in the order of the third's rank.
        merges = [
            (token[:i], token[i:])
            for token in sorted(vocab, key=vocab.get)
            for i in range(1, len(token))
            if token[:i] in vocab and token[i:] in vocab
        ]
        self.tokenizer = Tokenizer(models.BPE(vocab, merges, ignore_merges=True))
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), byte_level]
        )
        # For single matches of the pattern, which the library needn't split again.
        self.of_matches = Tokenizer(self.tokenizer.model)
        self.of_matches.pre_tokenizer = byte_level
        self.matches = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        A match that came before isn't given to the library again.
        """
        return [self._encode(text) for text in texts]

    def _whole(self, text: str) -> bytes:
        return b"".join(np.array(e.ids, dtype="<u4").tobytes() for e in self._batches(self.tokenizer, [text]))

    def _encode(self, text: str) -> bytes:
        if UNSETTLED.search(text):
            return self._whole(text)
        words = self.matches.findall(text)
        known = self.known
        new = [w for w in set(words) if w not in known]
        if not new:
            return b"".join(map(known.__getitem__, words))
        own = {w: np.array(e.ids, dtype="<u4").tobytes() for w, e in zip(new, self._batches(self.of_matches, new), strict=True)}
        packed = b"".join([own[w] if w in own else known[w] for w in words])
        if len(known) + len(own) > REMEMBERED:
            known.clear()
        known.update((w, ids) for w, ids in own.items() if len(w) <= LONGEST_REMEMBERED)
        return packed

    def encode_with_offsets(self, texts: list[str]) -> list[tuple[bytes, list[dict]]]:
        """As ``encode``, and for each token the characters it lies in; split characters are in several."""
        return [
            (np.array(e.ids, dtype="<u4").tobytes(), [{"start": a, "end": b} for a, b in e.offsets])
            for e in self._batches(self.tokenizer, texts, offsets=True)
        ]

    @staticmethod
    def _batches(tokenizer, texts: list[str], offsets: bool = False):
        run = tokenizer.encode_batch if offsets else tokenizer.encode_batch_fast
        part, size = [], 0
        for text in texts:
            part.append(text)
            size += len(text)
            if size >= CHARS_AT_ONCE:
                yield from run(part, add_special_tokens=False)
                part, size = [], 0
        yield from run(part, add_special_tokens=False)


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


@cache
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encode(
    docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", offsets: str | None = None
) -> DataFrame:
    """Add the ids of each whole text, packed as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. With ``offsets`` a column of that name holds the start and
    end of each token in characters. Strings of special tokens are ordinary text. All other
    columns stay; columns of the new names are replaced.
    """
    importable(docs.sparkSession)
    if offsets is None:

        @F.pandas_udf("binary")
        def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = codec(path, pattern)
            for texts in batches:
                yield pd.Series(own.encode([t or "" for t in texts]), dtype=object)

        # Marked so that the optimizer doesn't repeat it for each use of the column.
        return docs.withColumn(out, ids.asNondeterministic()(text))

    @F.pandas_udf("ids binary, offsets array<struct<start: int, end: int>>")
    def located(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern)
        for texts in batches:
            yield pd.DataFrame(own.encode_with_offsets([t or "" for t in texts]), columns=["ids", "offsets"])

    both = docs.withColumn("_located", located.asNondeterministic()(text))
    return both.withColumns({out: F.col("_located.ids"), offsets: F.col("_located.offsets")}).drop("_located")


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes of each row's ids; null ids give no bytes. Unknown ids fail the query."""
    importable(encoded.sparkSession)

    @F.pandas_udf("binary")
    def bytes_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = decoder(path)
        for packed in batches:
            yield pd.Series([own.decode(p or b"") for p in packed], dtype=object)

    return encoded.withColumn(out, bytes_of.asNondeterministic()(ids))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Number and digest of each document's ids, and digest of what they decode to."""
    encoded = encode(docs.select("doc_id", whole("text").alias("text")), path, pattern)
    return decode(encoded, path, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
