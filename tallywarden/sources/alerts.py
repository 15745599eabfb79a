"""The alert table: layout and batch sink."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from tallywarden.schemas import ALERT


def to_alerts(
    df: DataFrame,
    detector: str,
    entity: str,
    score: Column,
    detail: Column,
    txn: str | None = None,
) -> DataFrame:
    """Project a detector's result to the common alert columns."""
    return df.select(
        F.lit(detector).alias("detector"),
        F.col(entity).cast("bigint").alias("entity_id"),
        (F.col(txn) if txn else F.lit(None)).cast("bigint").alias("txn_id"),
        score.cast("double").alias("score"),
        detail.cast("string").alias("detail"),
    )


def write_alerts(df: DataFrame, path: str, run_date: str, detectors: list[str]) -> None:
    """Write the alerts of ``detectors``, partitioned by run date and detector.

    What an earlier run of the same date left for these detectors is replaced, also where
    nothing was found this time. Other detectors keep theirs; alerts of detectors that are
    not listed raise an error. Rebalancing gathers a detector's rows into few files, and
    still splits a busy detector over several tasks.
    """
    strange = [d for d in detectors if not re.fullmatch(r"[A-Za-z0-9_-]+", d)]
    if strange:
        raise ValueError(f"not the name of a detector: {strange}")
    listed = F.coalesce(F.col("detector").isin(detectors), F.lit(False))
    checked = df.where(listed | F.raise_error(F.lit("an alert's detector is not listed")).cast("boolean"))
    found = Observation()
    (
        checked.observe(found, *(F.count_if(F.col("detector") == d).alias(d) for d in detectors))
        .withColumn("run_date", F.to_date(F.lit(run_date)))
        .hint("rebalance", "detector")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_date", "detector")
        .parquet(path)
    )
    nothing = df.sparkSession.createDataFrame([], df.drop("detector").schema)
    # Metrics of an input that Spark found to be empty can be missing.
    for detector in (d for d in detectors if not found.get.get(d)):
        nothing.write.mode("overwrite").parquet(f"{path}/run_date={run_date}/detector={detector}")


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{ALERT}, run_date date").parquet(path)
