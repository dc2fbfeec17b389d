"""Intermediate tables in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one on a local master, as in tests, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="probewell-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def stored(df: DataFrame, key: str | None = None, buckets: int = 1) -> DataFrame:
    """df written once to the shared folder and read again, so that later plans start from it; with a key in buckets by it, so that it
    need not be shuffled to meet other rows by that key."""
    name = uuid.uuid4().hex
    path = f"{shared_folder(df.sparkSession)}/tables/{name}"
    if key:
        df.write.format("parquet").option("compression", "zstd").bucketBy(buckets, key).option("path", path).saveAsTable(f"stored_{name}")
        out = df.sparkSession.table(f"stored_{name}")
    else:
        df.write.option("compression", "zstd").parquet(path)
        out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def parts_of(df: DataFrame, rows: int) -> int:
    """The number of partitions for at most about `rows` rows in each, and no fewer than shuffles have."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def discard(*tables: DataFrame) -> None:
    """Removes tables that stored() returned and nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
