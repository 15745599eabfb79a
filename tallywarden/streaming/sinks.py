"""Running streams and writing their results so that a repeated batch changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallywarden.session import SETTINGS, configured, shared_folder

# The state store that ``transformWithState`` needs; Spark's default one can't hold its column families.
STORE = "spark.sql.streaming.stateStore.providerClass"

LATE = "batch_id bigint, input_rows bigint, behind_rows bigint, late_rows bigint, watermark timestamp, newest timestamp"
REPORT = "batch_id bigint, input_rows bigint, late_rows bigint, state_rows bigint, watermark string"


def run_to_table(stream: DataFrame, purpose: str) -> tuple[DataFrame, StreamingQuery]:
    """Process what is available into a new table in the shared folder."""
    spark = stream.sparkSession
    base = shared_folder(spark, purpose)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{base}/data")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data"), query


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand what is available to ``handle`` batch by batch; state is held in RocksDB, whatever the session's default.

    A stream takes the session's settings when it starts, and a restarted one those in its checkpoint.
    """
    with configured(stream.sparkSession, STORE, SETTINGS[STORE]):
        query = (
            stream.writeStream.foreachBatch(handle)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    return query


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch to its own partition, replacing what an earlier attempt left there."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def alert_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` handler that stores alerts exactly once."""
    return lambda alerts, batch_id: write_batch(alerts, path, batch_id)


def final_watermark(query: StreamingQuery) -> str:
    """The watermark of a query's last batch."""
    return query.recentProgress[-1]["eventTime"]["watermark"]


def late_report(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """Per batch: rows read, rows dropped as late, rows held in state.

    Spark keeps the latest progress reports only (numRecentProgressUpdates).
    """
    rows = [
        (
            p["batchId"],
            p["numInputRows"],
            sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"]),
            sum(s["numRowsTotal"] for s in p["stateOperators"]),
            p["eventTime"].get("watermark"),
        )
        for p in query.recentProgress
    ]
    return spark.createDataFrame(rows, REPORT)


def late_counter(folder: str, delay: str, size: str, ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` handler that counts a stream's own rows against the watermark of their batch.

    A batch's watermark is the newest time of all batches before it less ``delay``, in whole milliseconds, as Spark
    keeps it. ``behind_rows`` are older than that; ``late_rows`` are those that tumbling windows of ``size`` no
    longer take in. Every batch has one row in ``folder``, made from the row before it and one pass over the batch,
    so nothing is forgotten, and a repeated batch replaces its own row.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = None
        if batch_id:
            newest = spark.read.schema(LATE).parquet(f"{folder}/batch_id={batch_id - 1}").select(F.unix_micros("newest")).first()[0]
        last = F.timestamp_micros(F.lit(newest).cast("bigint"))
        watermark = F.date_trunc("MILLISECOND", last) - F.expr(f"INTERVAL {delay}")
        counted = batch.select(F.col(ts).alias("_ts"), F.window(F.col(ts), size)["end"].alias("_end"), watermark.alias("_mark")).agg(
            F.count(F.lit(1)).alias("input_rows"),
            F.count_if(F.col("_ts") < F.col("_mark")).alias("behind_rows"),
            F.count_if(F.col("_end") <= F.col("_mark")).alias("late_rows"),
            F.max("_ts").alias("_newest"),
        )
        row = counted.select("input_rows", "behind_rows", "late_rows", watermark.alias("watermark"), F.greatest("_newest", last).alias("newest"))
        write_batch(row, folder, batch_id)

    return handle


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What ``late_counter`` found, one row for each batch so far."""
    return spark.read.schema(LATE).parquet(folder).select("batch_id", "input_rows", "behind_rows", "late_rows", "watermark")
