"""Toxicity by a weighted grammar of clauses.

Three finite-state steps are composed. The first rewrites each word of a clause
as a symbol: insult, threat, target, negation, reported speech or nothing. The
second reads the symbols and remembers, for a few words, that a target or a
negation came, and for the rest of the clause that someone is quoted. The third
turns each insult or threat in that state into one of the patterns below. A text's
score is a logistic function of how often each pattern matched. Which word
beginnings insult and what each pattern weighs is learned from labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallywarden.llm.common import importable, kept, text_key, whole

# Labelled rows that words and weights are learned from, as expected number: a hash picks them.
LEARN_ROWS = 20_000
# Lengths of word beginnings that are tried as insults; whole words are tried too, with WHOLE behind them.
SHORTEST, LONGEST = 3, 8
WHOLE = "$"
# A beginning must occur in this many toxic texts, with this share of them among all that have it ...
LEAST_TEXTS, PURITY = 6, 0.95
# ... and must explain this many toxic texts that those chosen before don't, so that few overlap.
LEAST_NEW = 1
# Matches of one pattern beyond this add nothing.
MOST_MATCHES = 4
# Words for which a target or a negation stays in mind.
REACH = 4

# Words with a role in the grammar, in English, French, German and Spanish.
INSULTS = "idiot moron imbecile scum loser pathetic worthless stupid disgusting scumbag bastard".split()
THREATS = "kill murder hurt destroy strangle stab töten umbringen tuer matar".split()
TARGETS = "you your he she they them his her these those du ihr tu vous toi usted ustedes tú is are was were".split()
NEGATIONS = "not never no isn't aren't wasn't nicht kein keine nie pas jamais nunca jamás".split()
REPORTS = "said says called wrote quoted claimed sagte sagt nannte dit disait appelle dijo dice llamó".split()

PATTERNS = ["insult", "insult_target", "insult_negated", "insult_reported", "threat", "threat_target"]
# What a match weighs where labels say nothing, and how firmly.
PRIOR = np.array([2.0, 2.5, 0.5, 0.5, 1.0, 2.0])
FIRMNESS = 0.05

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:\n]+")


class Grammar:
    """The composed transducers for a given set of insulting word beginnings."""

    def __init__(self, stems: list[str]):
        self.words = frozenset(s.removesuffix(WHOLE) for s in stems if s.endswith(WHOLE))
        self.insults = frozenset(s for s in stems if not s.endswith(WHOLE))
        self.lengths = sorted({len(s) for s in self.insults})
        self.threats = frozenset(THREATS)
        self.roles = {w: role for role, ws in (("target", TARGETS), ("not", NEGATIONS), ("told", REPORTS)) for w in ws}

    def hits(self, words: list[str]) -> bool:
        insults, alone = self.insults, self.threats | self.words
        return not alone.isdisjoint(words) or any(w[:n] in insults for n in self.lengths for w in words)

    def symbols(self, words: list[str]) -> Iterator[str]:
        for w in words:
            if w in self.words or any(w[:n] in self.insults for n in self.lengths):
                yield "insult"
            elif w in self.threats:
                yield "threat"
            else:
                yield self.roles.get(w, "")

    def patterns(self, symbols: Iterator[str]) -> Iterator[str]:
        aimed = denied = 0
        told = False
        for s in symbols:
            if s in ("insult", "threat"):
                if s == "insult" and told:
                    yield "insult_reported"
                elif s == "insult" and denied:
                    yield "insult_negated"
                else:
                    yield f"{s}_target" if aimed else s
            aimed = REACH if s == "target" else max(aimed - 1, 0)
            denied = REACH if s == "not" else max(denied - 1, 0)
            told = told or s == "told"

    def counts(self, text: str | None) -> list[int]:
        found = dict.fromkeys(PATTERNS, 0)
        lower = (text or "").lower()
        if self.hits(WORD.findall(lower)):
            for clause in CLAUSE.split(lower):
                for p in self.patterns(self.symbols(WORD.findall(clause))):
                    found[p] += 1
        return list(found.values())


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept for testing; one without an id is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learning_texts(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> DataFrame:
    """(text, toxic) of about ``rows`` labelled rows outside the held-out part, each text once.

    Rows without an id or label teach nothing. A text with different labels counts as toxic.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    n = usable.count()
    few = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, rows / max(n, 1)) * (1 << 30)))
    few = few.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # The sample is bounded by ``rows``.
    joined = docs.select("doc_id", whole("text").alias("text")).join(F.broadcast(few), "doc_id")
    return joined.groupBy(text_key("text").alias("_key")).agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).drop("_key")


def learn_stems(texts: DataFrame) -> list[str]:
    """Word beginnings that mark toxic texts, chosen so that each explains texts the others don't."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{%d,})" % SHORTEST), F.lit(1)))
    starts = F.array_distinct(
        F.flatten(
            F.transform(
                words,
                lambda w: F.array(
                    *(F.substring(w, 1, n) for n in range(SHORTEST, LONGEST + 1)), F.concat(w, F.lit(WHOLE))
                ),
            )
        )
    )
    by_text = texts.select(F.xxhash64("text").alias("id"), "toxic", F.explode(starts).alias("stem"))
    pure = (
        by_text.groupBy("stem")
        .agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad"), F.count(F.lit(1)).alias("n"))
        .where((F.col("bad") >= LEAST_TEXTS) & (F.col("bad") >= PURITY * F.col("n")))
    )
    # Bounded by the number of learning rows.
    marked = by_text.where("toxic = 1").join(F.broadcast(pure), "stem").groupBy("stem").agg(F.collect_set("id").alias("ids"))
    left = {r["stem"]: set(r["ids"]) for r in marked.collect()}
    stems = []
    while left:
        # Of equals a beginning before a whole word, and the longer, so that no more words than needed are caught.
        best = max(left, key=lambda s: (len(left[s]), not s.endswith(WHOLE), len(s), s))
        explained = left.pop(best)
        if len(explained) < LEAST_NEW:
            break
        stems.append(best)
        left = {s: ids - explained for s, ids in left.items()}
    return sorted({*stems, *INSULTS})


def pattern_counts(docs: DataFrame, stems: list[str], text: str = "text", out: str = "_patterns") -> DataFrame:
    """Add how often each pattern matches in the whole text, nulls read as empty."""
    importable(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grammar = Grammar(stems)
        for texts in batches:
            yield pd.Series([grammar.counts(t) for t in texts])

    return docs.withColumn(out, counts.asNondeterministic()(text))


def learn_weights(texts: DataFrame, stems: list[str]) -> list[float]:
    """Bias and pattern weights of a logistic regression that leans to the prior weights."""
    capped = F.transform("_patterns", lambda c: F.least(c, F.lit(MOST_MATCHES)))
    table = pattern_counts(texts, stems).groupBy(capped.alias("x"), "toxic").count().collect()
    x = np.array([[1, *r["x"]] for r in table], dtype=float).reshape(len(table), len(PATTERNS) + 1)
    y = np.array([r["toxic"] for r in table], dtype=float)
    n = np.array([r["count"] for r in table], dtype=float)
    prior = np.array([-3.0, *PRIOR])
    firm = np.full(len(prior), FIRMNESS)
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - firm * (w - prior)
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(firm)
        w = w + np.clip(np.linalg.solve(curve, slope), -2, 2)
    return w.tolist()


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> DataFrame:
    """Documents with ``score`` between 0 and 1; a column of that name is replaced.

    ``labels`` (doc_id, toxic) are used for learning only, never those of the held-out part.
    Without usable labels the prior lexicon and weights are applied. Null texts are empty.
    """
    texts = kept(learning_texts(docs, labels, rows), "learning")
    stems = learn_stems(texts)
    bias, *weights = learn_weights(texts, stems)
    counted = pattern_counts(docs, stems)
    z = F.lit(bias)
    for i, weight in enumerate(weights):
        z = z + F.lit(weight) * F.least(F.get("_patterns", F.lit(i)), F.lit(MOST_MATCHES))
    return counted.withColumn("score", 1 / (1 + F.exp(-z))).drop("_patterns")


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and verdict for each document."""
    scored = toxicity(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
