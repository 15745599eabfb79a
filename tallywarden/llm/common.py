"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallywarden.session import dropped, kept, shuffles_deleted  # noqa: F401

# Longs in the filter of ``may_be_in``, of 62 bits each: a fixed size of half a megabyte.
FILTER_LONGS = 1 << 16


def importable(spark: SparkSession) -> None:
    """Let Python workers of this machine import the package from where the driver found it.

    On a cluster the package is shipped like any other, with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole(text: str | Column) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def free_prefix(columns: list[str]) -> str:
    """More underscores than any column begins with, so that names made with it clash with none."""
    return "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in columns), default=0))


def text_key(text: str | Column) -> Column:
    return F.unhex(F.md5(whole(text)))


def _bits(key: str) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    return F.pmod(h, F.lit(FILTER_LONGS)).cast("int"), F.pmod(F.shiftrightunsigned(h, 20), F.lit(62)).cast("int")


def stored_table(rows: DataFrame, size: int) -> DataFrame:
    """One row with an array of ``size`` longs: at each place the bits of the rows (place, bits) for it, else zero.

    Plans read it as a scalar subquery. As a constant it would stand in the text of every plan, and so in the
    driver's memory and event log, with each of its numbers.
    """
    zeros = rows.sparkSession.range(size).select(F.col("id").cast("int").alias("place"), F.lit(0).cast("long").alias("bits"))
    filled = rows.unionByName(zeros).groupBy("place").agg(F.bit_or("bits").alias("bits"))
    in_order = filled.agg(F.sort_array(F.collect_list(F.struct("place", "bits"))).alias("all"))
    return kept(in_order.select(F.col("all.bits").alias("longs")), "table")


def may_be_in(few: DataFrame, key: str) -> Column:
    """A filter of fixed size that passes all keys of ``few`` and little else while these are few. Not for use within lambdas."""
    place, bit = _bits(key)
    rows = few.select(place.alias("place"), bit.alias("bit")).select("place", F.expr("shiftleft(1L, bit)").alias("bits"))
    return F.getbit(F.get(stored_table(rows, FILTER_LONGS).scalar(), place), bit) == 1
