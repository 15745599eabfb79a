"""Exact top-k search by inner product as a Voronoi join.

Vectors are grouped by the nearest of a few pivots. For each group of queries
the distance of its farthest query from the pivot and the k-th score its queries
reach on a sample bound what other vectors can score: by Cauchy-Schwarz no query
q of the group with pivot p and radius r scores more than p.x + r|x| with x. Only
vectors above the bound are sent to the group, and each group is solved in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywarden.llm.common import importable, kept

# Groups of queries, and vectors sampled for the bounds: parameters that don't grow with the data.
PIVOTS = 16
SAMPLE = 2_048
# Rows a task solves at once.
QUERIES_PER_BLOCK = 512
VECTORS_PER_BLOCK = 16_384


def integer_vectors(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, vec): components as floor(scale * x); rows that can't take part are left out.

    These are rows without an id, null vectors and vectors with a null or non-finite component.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))


def matrix(packed: pd.Series, width: int) -> np.ndarray:
    """Packed vectors as whole numbers; components take four bytes, or eight where any needs them."""
    if not len(packed):
        return np.zeros((0, width), np.int64)
    kind = f"<i{len(packed.iloc[0]) // width}"
    return np.frombuffer(b"".join(packed), dtype=kind).reshape(len(packed), width).astype(np.int64)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as int64, exact at any size that fits; beyond it an error."""
    largest = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if largest < 2**63:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    if any(abs(x) >= 2**63 for x in exact.ravel()):
        raise OverflowError("a score does not fit a long")
    return exact.astype(np.int64)


def grouped(vectors: DataFrame, width: int, pivots: np.ndarray, kind: str = "<i4") -> DataFrame:
    """Pack each distinct vector and add its pivot, its distance from it and its length."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = np.zeros((len(rows), width), dtype=kind)
            for i, v in enumerate(rows["vec"]):
                x[i, : len(v)] = v
            wide = x.astype(np.float64)
            away = (wide**2).sum(1)[:, None] - 2 * wide @ pivots.T + (pivots**2).sum(1)[None, :]
            group = away.argmin(1)
            yield pd.DataFrame(
                {
                    "vid": rows["vid"],
                    "ids": rows["ids"],
                    "asks": rows["asks"],
                    "packed": [r.tobytes() for r in x],
                    "cell": group.astype("int32"),
                    "radius": np.sqrt(((wide - pivots[group]) ** 2).sum(1)),
                }
            )

    schema = "vid string, ids array<long>, asks boolean, packed binary, cell int, radius double"
    return vectors.mapInPandas(assign, schema)


def top_scores(embeddings: DataFrame, asks: Column, k: int = 20, scale: int = 64, pivots: int = PIVOTS) -> DataFrame:
    """The k highest scores of each query row against all other rows, ties to the smaller id.

    ``asks`` marks the query rows by ``vec_id``. Shorter vectors count as padded with zeros. Rows equal in id
    and vector count once. Components may be as large as scores fit a long; a score that does not is an error. With fewer than k other rows all are returned; an empty table gives none.
    Returns query_id, rank (from 1), vec_id, score.
    """
    spark = embeddings.sparkSession
    importable(spark)
    rows = integer_vectors(embeddings, scale).distinct()
    rows = rows.withColumn("vid", F.md5(F.concat_ws(",", "vec")))
    # Of equal vectors only the k + 1 smallest ids can be among a query's first k.
    nth = F.row_number().over(Window.partitionBy("vid").orderBy("vec_id"))
    firsts = rows.withColumn("_nth", nth).where(F.col("_nth") <= k + 1)
    distinct = firsts.groupBy("vid").agg(
        F.first("vec").alias("vec"), F.array_sort(F.collect_list("vec_id")).alias("ids")
    )
    queries = kept(rows.where(asks).select("vid", F.col("vec_id").alias("query_id")), "queries")
    asked = queries.select("vid").distinct().withColumn("asks", F.lit(True))
    vectors = kept(distinct.join(asked, "vid", "left").fillna(False, ["asks"]), "vectors")
    largest = F.max(F.greatest(F.abs(F.array_max("vec")), F.abs(F.array_min("vec")))).alias("largest")
    seen = vectors.agg(F.max(F.size("vec")).alias("width"), F.count(F.lit(1)).alias("n"), largest).first()
    width, n = seen["width"] or 1, seen["n"]
    kind = "<i4" if (seen["largest"] or 0) < 2**31 else "<i8"

    # Hash order makes the sample random and the same in every run.
    sample = [r["vec"] for r in vectors.orderBy("vid").limit(SAMPLE).select("vec").collect()]
    known = np.zeros((len(sample), width), np.int64)
    for i, v in enumerate(sample):
        known[i, : len(v)] = v
    centres = known[:pivots].astype(np.float64) if len(known) else np.zeros((1, width))
    cells = kept(grouped(vectors, width, centres, kind), "cells")

    @F.pandas_udf("double")
    def reached(packed: pd.Series) -> pd.Series:
        """The (k+1)-th score on the sample, a lower bound of the (k+1)-th on all rows."""
        if len(known) <= k:
            return pd.Series(np.full(len(packed), -np.inf))
        return pd.Series(np.partition(scores(matrix(packed, width), known), -k - 1, axis=1)[:, -k - 1].astype(float))

    # One row for each pivot at most.
    summary = (
        cells.where("asks")
        .withColumn("_reached", reached("packed"))
        .groupBy("cell")
        .agg(F.max("radius").alias("radius"), F.min("_reached").alias("reached"), F.count(F.lit(1)).alias("n"))
        .orderBy("cell")
        .collect()
    )
    which = np.array([r["cell"] for r in summary], dtype="int32")
    radius = np.array([r["radius"] for r in summary])
    floor = np.array([r["reached"] for r in summary])
    blocks = max(1, -(-n // VECTORS_PER_BLOCK))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            x = matrix(part["packed"], width).astype(np.float64)
            length = np.sqrt((x**2).sum(1))[:, None]
            # A little more than the bound, for the rounding of roots and products.
            slack = 1 + 1e-9 * length * (radius + np.sqrt((centres[which] ** 2).sum(1)))[None, :]
            most = x @ centres[which].T + radius[None, :] * length + slack
            row, cell = np.nonzero(most >= floor[None, :])
            taken = part.iloc[row]
            yield pd.DataFrame({"cell": which[cell], "vid": taken["vid"].values, "ids": taken["ids"].values, "packed": taken["packed"].values})

    parts = F.create_map(*(F.lit(x) for r in summary for x in (r["cell"], -(-r["n"] // QUERIES_PER_BLOCK)))) if summary else None
    if parts is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    block = F.pmod(F.xxhash64("vid"), F.lit(blocks)).cast("int").alias("block")
    sent = cells.select("vid", "ids", "packed").mapInPandas(send, "cell int, vid string, ids array<long>, packed binary")
    sent = sent.select("cell", block, F.explode(F.sequence(F.lit(0), (parts[F.col("cell")] - 1).cast("int"))).alias("part"), "ids", "packed")
    part = F.pmod(F.xxhash64(F.lit("part"), "vid"), parts[F.col("cell")]).cast("int").alias("part")
    asking = cells.where("asks").select("cell", part, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vid", "packed")

    def solve(asking: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asking) and len(sent):
            times = sent["ids"].str.len().to_numpy()
            ids = np.concatenate(sent["ids"].to_numpy())
            of = np.repeat(np.arange(len(sent)), times)
            # By id, so that a stable sort by score gives ties to the smaller one.
            order = np.argsort(ids, kind="stable")
            ids, of = ids[order], of[order]
            all_scores = scores(matrix(asking["packed"], width), matrix(sent["packed"], width))
            for vid, row in zip(asking["vid"], all_scores, strict=True):
                own = row[of]
                if len(own) > k + 1:
                    near = np.flatnonzero(own >= np.partition(own, -k - 1)[-k - 1])
                else:
                    near = np.arange(len(own))
                best = near[np.argsort(-own[near], kind="stable")][: k + 1]
                found.append(pd.DataFrame({"vid": vid, "vec_id": ids[best], "score": own[best]}))
        if not found:
            return pd.DataFrame({"vid": pd.Series(dtype=str), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        return pd.concat(found)

    keys = ["cell", "part", "block"]
    best = asking.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(solve, "vid string, vec_id long, score long")
    in_order = [F.desc("score"), F.asc("vec_id")]
    first = best.withColumn("_nth", F.row_number().over(Window.partitionBy("vid").orderBy(*in_order))).where(F.col("_nth") <= k + 1)
    others = queries.join(first.drop("_nth"), "vid").where("query_id != vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*in_order)).alias("rank")
    return others.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)
