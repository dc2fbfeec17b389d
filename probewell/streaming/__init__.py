"""Continuous ingest of pings: pings and progress in one commit, failure rates of providers by tumbling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def failure_rates(pings: DataFrame, window: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """(rid, start, n, failed) from pings (rid, ts, failed), batch or stream. Late pings count within `lateness`.

    Pings are a bag: equal ones all count, unless they carry a ping_id, by which a stream drops repeats.
    """
    if pings.isStreaming:
        pings = pings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
        if "ping_id" in pings.columns:
            pings = pings.dropDuplicatesWithinWatermark(["ping_id"])
    by = pings.groupBy("rid", F.window("ts", window).alias("w")).agg(F.count("*").alias("n"), F.count_if("failed").alias("failed"))
    return by.select("rid", F.col("w.start").alias("start"), "n", "failed")


def write_rates(rates: DataFrame, path: str, checkpoint: str):
    """Appends closed windows; the checkpoint makes a restart go on where it stopped."""
    return rates.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


JOB_COLUMNS = ("rid", "lui", "random", "url")


def write_batch(pings: DataFrame, batch_id: int, path: str) -> None:
    """A micro-batch of pings (rid, lui, random, url, ...) as rows of `pings` and of `progress` (the jobs done), both or neither.

    Both go to folders of the batch, and then its number to `commits`. Readers look at committed batches only. A batch that was
    stopped in between comes again with the same number and overwrites what it had left, so no row stands twice.
    """
    pings.persist()
    try:
        for name, rows in (("pings", pings), ("progress", pings.select(*JOB_COLUMNS))):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        one = pings.sparkSession.range(1).select(F.lit(batch_id).cast("long").alias("committed"))
        one.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch={batch_id}")
    finally:
        pings.unpersist()


def ingest(pings: DataFrame, path: str, checkpoint: str):
    """Writes a stream of pings by write_batch(); a restart goes on with the batch that was stopped."""
    return pings.writeStream.foreachBatch(lambda df, n: write_batch(df, n, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of `pings` or `progress` of all committed batches, with the column batch. Batches that aren't committed aren't read."""
    done = spark.read.option("basePath", f"{path}/commits").parquet(f"{path}/commits").select(F.col("committed").alias("batch"))
    return spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}").withColumn("batch", F.col("batch").cast("long")).join(done, "batch", "left_semi")
