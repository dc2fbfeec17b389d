"""Line dedup over levelled sorted runs of line hashes.

A run is a table (h, docs, top) of line keys, bucketed and sorted by the 128-bit hash h of the key: how many documents of
the run's batch hold it and the largest of their ids. A new batch is summed up to such a table, and a merge-anti-join with each run leaves
the keys that no run has: these become a run of their own, so a key stands in one run only. What the batch adds to
known keys goes to a list of repeats, which is far smaller than the runs, as most lines of a corpus are met once. When a
level has `fan` runs, they are merged into one run of the next level. Runs and batch are bucketed alike, so neither the anti-joins
nor the merges shuffle anything.
"""

from __future__ import annotations

import functools
import uuid

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probewell.llm.common import discard, shared_folder, stored

#: What is stripped from both ends of a line.
BLANK = " \t\n\x0b\x0c\r"


def line_hash(line: str, least: int) -> bytes | None:
    """128-bit hash of the line's key (stripped, A-Z in lower case); None if the key has fewer than `least` code points."""
    key = line.strip(BLANK)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= least else None  # bytes.lower() only touches A-Z


def line_hashes(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, th, h): the distinct keys of each row's text; th is a hash of the text, which tells rows of one id apart."""

    def run(batches):
        for b in batches:
            at, found = [], []
            for i, t in enumerate(b["text"].to_pylist()):
                keys = {line_hash(line, least) for line in t.split("\n")} - {None} if t else ()
                at += [i] * len(keys)
                found += keys
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(at), b["th"].take(at), pa.array(found, pa.binary())], ["doc_id", "th", "h"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, f"doc_id {kind}, th long, h binary")


class LineRuns:
    """The levels of runs of all batches added so far, as bucketed tables below the shared folder."""

    def __init__(self, spark: SparkSession, fan: int = 3, buckets: int | None = None):
        self.spark, self.fan = spark, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.repeats: list[DataFrame] = []

    def _write(self, df: DataFrame) -> str:
        name = f"probewell_run_{uuid.uuid4().hex}"
        path = f"{shared_folder(self.spark).rstrip('/')}/tables/{name}"
        df.select("h", "docs", "top").write.bucketBy(self.buckets, "h").sortBy("h").option("path", path).format("parquet").saveAsTable(name)
        return name

    def _remove(self, name: str) -> None:
        path = self.spark.sql(f"describe table extended {name}").filter("col_name = 'Location'").first()["data_type"]
        self.spark.sql(f"drop table {name}")
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """Adds a batch of lines (doc_id, h), each key once for each document."""
        own = lines.groupBy("h").agg(F.count("*").alias("docs"), F.max("doc_id").alias("top"))
        runs = self.runs()
        if runs:
            batch = self._write(own)
            own = self.spark.table(batch)
            known = functools.reduce(DataFrame.unionByName, [own.join(r.hint("merge"), "h", "left_semi") for r in runs])
            self.repeats.append(stored(known))
            self.levels[0].append(self._write(functools.reduce(lambda left, r: left.join(r.hint("merge"), "h", "left_anti"), runs, own)))
            self._remove(batch)
        else:
            self.levels[0].append(self._write(own))
        self._compact()

    def _compact(self) -> None:
        """Merges the runs of each full level into one of the next; their keys are disjoint."""
        for k, level in enumerate(self.levels):
            if len(level) >= self.fan:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(functools.reduce(DataFrame.unionByName, [self.spark.table(name) for name in level])))
                for name in level:
                    self._remove(name)
                level.clear()

    def frequent(self, docs: int) -> DataFrame:
        """(h, docs, top) of the keys in at least `docs` documents."""
        if not self.repeats:
            return functools.reduce(DataFrame.unionByName, [r.filter(F.col("docs") >= docs) for r in self.runs()])
        again = functools.reduce(DataFrame.unionByName, self.repeats).groupBy("h").agg(F.sum("docs").alias("more"), F.max("top").alias("later"))
        again = stored(again)
        found = [r.join(again, "h", "left").select("h", (F.col("docs") + F.coalesce("more", F.lit(0))).alias("docs"), F.greatest("top", "later").alias("top")) for r in self.runs()]
        return functools.reduce(DataFrame.unionByName, found).filter(F.col("docs") >= docs)

    def drop(self) -> None:
        """Removes the tables of all runs."""
        for level in self.levels:
            for name in level:
                self._remove(name)
        discard(*self.repeats)
        self.levels, self.repeats = [[]], []


def repeated_lines(docs: DataFrame, least: int = 40, copies: int = 5, batches: int = 4, fan: int = 3) -> DataFrame:
    """(doc_id, th, gone): the hashes of the lines that each text of docs loses; texts that lose none are left out."""
    hashes = line_hashes(docs, least).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    spark = docs.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    hashes.write.partitionBy("batch").parquet(path)
    hashes = spark.read.schema(hashes.schema).parquet(path)
    runs = LineRuns(spark, fan)
    for b in range(batches):
        runs.add(hashes.filter(F.col("batch") == b).select("doc_id", "h"))
    frequent = stored(runs.frequent(copies).select("h", "top"))
    runs.drop()
    # Of stored size, so that few keys are broadcast; many are met by a merge join, whose common keys are split at run time.
    lost = hashes.join(frequent, "h").filter("top is not null and (doc_id is null or doc_id < top)")
    return stored(lost.groupBy("doc_id", "th").agg(F.collect_set("h").alias("gone")))


def dedup_lines(docs: DataFrame, least: int = 40, copies: int = 5, batches: int = 4, fan: int = 3) -> DataFrame:
    """docs with `text` less its repeated lines, and columns n_lines (before) and n_dropped; all rows and other columns stay.

    A line's key is the line without white space (space, \\t to \\r) at both ends and with A-Z in lower case. Keys of at least `least`
    code points that `copies` documents hold lose all their lines except in the largest doc_id that holds them. Each row is a
    document; rows that share the largest id all keep the line. Null ids are smaller than all others; a key that only
    they hold stays. Null and empty texts are one empty line and become the empty text. An empty table gives no rows.
    A text's lines meet in one task. docs is read twice, so it should be a stored table.
    """
    gone = repeated_lines(docs.select("doc_id", "text"), least, copies, batches, fan)
    gone = gone.select(F.col("doc_id").alias("_lines_id"), F.col("th").alias("_lines_th"), F.col("gone").alias("_lines_gone"))
    rows = docs.withColumn("_lines_own", F.xxhash64("text"))
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_lines_id")) & (F.col("_lines_own") == F.col("_lines_th")), "left")

    @F.pandas_udf("text string, dropped long")
    def cut(text: pd.Series, drops: pd.Series) -> pd.DataFrame:
        kept, dropped = [], []
        for t, d in zip(text, drops):
            if t is None:
                kept.append(None)
                dropped.append(0)
                continue
            lines, lost = t.split("\n"), {bytes(x) for x in d}
            stay = [line for line in lines if line_hash(line, least) not in lost]
            kept.append("\n".join(stay))
            dropped.append(len(lines) - len(stay))
        return pd.DataFrame({"text": kept, "dropped": dropped})

    # Only texts that lose a line go to Python.
    rows = rows.withColumn("_lines_cut", cut(F.when(F.col("_lines_gone").isNotNull(), F.col("text")), "_lines_gone"))
    whole = F.coalesce("text", F.lit(""))
    n = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    text = F.coalesce("_lines_cut.text", whole)
    others = [F.col(c) for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    return rows.select(*others, text.alias("text"), n.cast("long").alias("n_lines"), F.col("_lines_cut.dropped").alias("n_dropped"))
