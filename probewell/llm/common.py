"""What the operators of this subpackage share: stored intermediate tables, ranks and components."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


_scratch: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one on a local master, as in tests, else an error:
    a folder of the driver's machine is of no use to executors on others."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="probewell-"))
        folder = spark.sparkContext.getCheckpointDir()
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back.

    Cuts the lineage, so that a lost executor costs no more than the tasks it was running, makes
    non-deterministic columns fixed, and gives later plans a known size to choose joins by. Within scratch() the
    table is removed at its end, and discard() removes it before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame | None) -> None:
    """Removes tables that stored() returned and nothing reads any more."""
    for t in tables:
        if t is not None:
            _remove(t.sparkSession, t.stored_at)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what operators have stored within it. The result must be written before."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _remove(spark, path)


def marked(rows: DataFrame, known: DataFrame, key: str, name: str, least: int = 8192, most: int = 100_000) -> DataFrame:
    """rows with a column `name`: whether their `key` is in known (key, n), n the number of rows that have it; a key is there once.

    Keys of over `least` rows and over 1 / `most` of all are fewer than `most`, so they are broadcast, and their rows
    aren't shuffled; the others meet theirs in a join. Both tables should be stored ones.
    """
    cut = max(least, (known.agg(F.sum("n")).first()[0] or 0) // most)
    heavy = F.broadcast(known.filter(F.col("n") > cut).select("key").withColumnRenamed("key", key).withColumn(name, F.lit(True)))  # fewer than `most` rows
    light = known.filter(F.col("n") <= cut).select("key").withColumnRenamed("key", key).withColumn(name, F.lit(True))
    rows = rows.join(heavy, key, "left")
    others = rows.filter(F.col(name).isNull()).drop(name).join(light, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return rows.filter(name).unionByName(others)


def prefix_sums(df: DataFrame, within: list[str], bucket: str, value: str, out: str) -> DataFrame:
    """One row for each (within, bucket) with the sum of `value` over the smaller buckets of `within`.

    The window only sees one row per bucket, never the rows of df.
    """
    sums = df.groupBy(*within, bucket).agg(F.sum(value).alias("_own"))
    w = Window.partitionBy(*[F.col(c) for c in within]).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*within, bucket, "_own", F.coalesce(F.sum("_own").over(w), F.lit(0)).cast("long").alias(out))


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (u > v). Minima are pre-aggregated, then joined."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    joined = large.join(low, "u")
    small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of undirected edges (a, b), both long, but the roots; root is the smallest node of the component.

    Alternating large-star and small-star steps until the edge set is a set of stars. Each round is written to the
    shared folder. No component is ever gathered: a hub's edges meet only in a pre-aggregated minimum and a join.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = stored(e)
    mark = F.struct(F.count("*"), F.bit_xor(F.xxhash64("u", "v")))
    before = tuple(e.agg(mark.alias("m")).first()["m"])
    for _ in range(rounds):
        last, e = e, stored(_star(e))
        discard(last)
        now = tuple(e.agg(mark.alias("m")).first()["m"])
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def whole_groups(batches, keys: list[str]):
    """Arrow tables that hold whole groups, from batches of a partition sorted by integer key columns.

    What waits for the next batch is one group at most, so the caller must bound groups.
    """
    wait: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if wait and all(wait[-1][k][-1].as_py() == b[k][-1].as_py() for k in keys):
            wait.append(b)
            continue
        new = np.zeros(b.num_rows, bool)
        for k in keys:
            v = b[k].to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
        table = pa.Table.from_batches([*wait, b.slice(0, cut)]) if wait or cut else None
        if table is not None and table.num_rows:
            yield table
        wait = [b.slice(cut)]
    if wait:
        yield pa.Table.from_batches(wait)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which the groups of a sorted table start."""
    new = np.ones(table.num_rows, bool)
    new[1:] = False
    for k in keys:
        v = table[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def ragged_arange(sizes: np.ndarray) -> np.ndarray:
    """0 .. size-1 for each size, in a row."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def smallest_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For 0 .. n-1 linked by pairs (a, b): the smallest number of each one's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label
