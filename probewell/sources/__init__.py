"""Readers and writers. All are plain DataFrame readers with fixed schemas; damaged records are kept apart, not lost."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from probewell import schemas
from probewell.operators.stored import parts_of, stored

CORRUPT = "_corrupt_record"


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False, strict: bool = False, recursive: bool = False) -> DataFrame:
    """JSON by a fixed schema, gzip or plain. A damaged record has its text in _corrupt_record and nulls elsewhere; strict: it is an error."""
    reader = spark.read.schema(schema if strict else f"{schema}, {CORRUPT} string").option("multiLine", multi_line).option("recursiveFileLookup", recursive)
    reader = reader.option("mode", "FAILFAST") if strict else reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return reader.json(path)


def bad_records(df: DataFrame) -> DataFrame:
    """(file, n) of damaged records for each source file, from what read_json() returns."""
    # The reader gives no damaged records unless another column is read along.
    others = F.to_json(F.struct(*[c for c in df.columns if c != CORRUPT]))
    bad = df.filter(F.col(CORRUPT).isNotNull() & (F.coalesce(F.length(others), F.lit(0)) >= 0))
    return bad.select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count("*").alias("n"))


def opened(content: bytes) -> str | None:
    """The text of a file, gzip or plain by its first bytes; None if it can't be unpacked."""
    try:
        return (gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content).decode("utf-8", "replace")
    except (OSError, EOFError, zlib.error):
        return None


@F.pandas_udf(StringType())
def _opened(content: pd.Series) -> pd.Series:
    return content.map(opened)


def read_json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record for each file, gzip or plain by its first bytes, whatever its name: (file, record). A damaged file's record is null."""
    files = spark.read.format("binaryFile").load(path)
    text = _opened("content")
    return files.select(F.col("path").alias("file"), F.from_json(text, schema, {"mode": "PERMISSIVE"}).alias("record"), text.alias("text")).select("file", F.when(F.try_parse_json("text").isNotNull(), F.col("record")).alias("record"))


def broken_rules(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """df with the names of the rules (name -> SQL condition) that a row breaks, as an array. Null conditions count as kept."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(True)), F.lit(n)) for n, c in rules.items()]))
    return df.withColumn("broken_rules", broken)


def unknown_fields(spark: SparkSession, path: str, schema: str) -> list[str]:
    """Paths of fields in the files that a closed schema doesn't have, nested ones as a.b."""

    def paths(kind, at: str = "") -> set[str]:
        if isinstance(kind, ArrayType):
            return paths(kind.elementType, at)
        if isinstance(kind, StructType):
            return {p for f in kind for p in ({at + f.name} | paths(f.dataType, f"{at}{f.name}."))}
        return set()

    new = paths(spark.read.json(path).schema) - paths(spark.createDataFrame([], schema).schema)
    return sorted(p for p in new if p.rpartition(".")[0] not in new)


def access_log(spark: SparkSession, path: str) -> DataFrame:
    """(url): one row for each request of the JSON arrays under a folder. A record without a URL is dropped, its file isn't."""
    return read_json(spark, path, schemas.ACCESS_LOG, multi_line=True, recursive=True).select(F.col("httpRequest.requestUrl").alias("url")).filter("url is not null")


def unreadable_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, n): the files of access_log() that can't be parsed."""
    return bad_records(read_json(spark, path, schemas.ACCESS_LOG, multi_line=True, recursive=True))


def first_by_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")


def flatten_registry(registry: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(namespaces, resources, institutions) from nested rows. Of repeated keys the first stays."""
    ns = registry.select(F.posexplode("namespaces").alias("at", "n")).select("at", "n.*")
    namespaces = first_by_key(ns.drop("resources"), ["prefix"], ["at"]).drop("at")
    res = ns.select("prefix", "at", F.posexplode("resources").alias("r_at", "r")).select("prefix", "at", "r_at", "r.*")
    resources = first_by_key(res.withColumn("institution_id", F.col("institution.id")).drop("institution"), ["id"], ["at", "r_at"]).drop("at", "r_at")
    inst = res.filter("institution is not null").select("at", "r_at", "institution.*")
    return namespaces, resources, first_by_key(inst, ["id"], ["at", "r_at"]).drop("at", "r_at")


def read_registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return flatten_registry(read_json(spark, path, schemas.REGISTRY, multi_line=True))


def read_pings(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of pings. Where a record has no rid, it comes from a file name pings_<number>; other files are left out."""
    df = read_json(spark, path, schemas.PING)
    rid = F.coalesce("rid", F.regexp_extract(F.col("_metadata.file_name"), r"^pings_(\d+)\b", 1).try_cast("bigint"))
    return df.withColumn("rid", rid).filter("rid is not null")


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, schemas.JOB, strict=True)


def known_ids(maps: DataFrame) -> DataFrame:
    """Distinct (namespace, lui) from rows with a map `known`; null ids are dropped."""
    return maps.select(F.explode("known").alias("namespace", "luis")).select("namespace", F.explode("luis").alias("lui")).filter("lui is not null").distinct()


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """Completed jobs; any damage is an error."""
    return read_json(spark, path, schemas.JOB, strict=True)


def read_academine(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, schemas.ACADEMINE)


def read_session(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, schemas.SESSION, strict=True)


def tags_of(identities: DataFrame, tags: DataFrame) -> DataFrame:
    """identities with their tags; one without any has an empty list."""
    return identities.join(tags, "identity", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def nest_datamine(pings: DataFrame, analysis: DataFrame | None = None, part_size: int | None = None, rows_per_part: int = 250_000) -> DataFrame:
    """One row for each provider: its pings in order of date and id, and its analysis, null where there is none.

    With part_size a provider's pings are dealt to rows (id, part, ...) of about so many, by hash, each in that order: for
    providers with more pings than a row should hold. The analysis is on part 0 then. The number of tasks goes with that of pings, so
    that what a task gathers doesn't grow with the table.
    """
    p = pings.select(F.col("rid").alias("id"), F.lit(0).cast("long").alias("part"), F.struct("date", "lui", "random", "redirects", F.col("content").isNull().alias("empty_content")).alias("p"))
    if part_size:
        # Most providers have one part: only the others, stored so that Spark knows how few they are, are looked up.
        parts = stored(p.filter("id is not null").groupBy("id").agg(F.ceil(F.count("*") / part_size).alias("parts")).filter("parts > 1"))
        p = p.filter("id is not null").join(parts, "id", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("p.lui", "p.date", "p.random"), "parts"), F.lit(0).cast("long"))).drop("parts")
    p = p.repartition(parts_of(pings, rows_per_part), "id", "part").groupBy("id", "part").agg(F.sort_array(F.collect_list("p")).alias("pings"))
    p = p.withColumn("pings", F.transform("pings", lambda x: F.struct(x.lui.alias("lui"), x.random.alias("random"), x.date.alias("date"), x.redirects.alias("redirects"), x.empty_content.alias("empty_content"))))
    if analysis is None:
        p = p.withColumn("analysis", F.lit(None).cast(f"array<{schemas.ANALYSIS}>"))
    else:
        a = analysis.groupBy(F.col("rid").alias("id")).agg(F.sort_array(F.collect_list(F.struct("lui", "information_content", "length", "noise"))).alias("analysis"))
        p = p.join(a.withColumn("part", F.lit(0).cast("long")), ["id", "part"], "left")
    return p if part_size else p.drop("part")


def write_json(df: DataFrame, path: str, mode: str = "errorifexists", gzip: bool = False) -> None:
    """Null properties are left out. The commit protocol makes a rerun or an append whole or nothing."""
    df.write.mode(mode).option("compression", "gzip" if gzip else "none").option("ignoreNullFields", True).json(path)


def write_known_ids(ids: DataFrame, path: str) -> None:
    """(namespace, lui) as one record for each namespace, compressed."""
    write_json(ids.groupBy("namespace").agg(F.array_sort(F.collect_set("lui")).alias("luis")), path, gzip=True)


def append_progress(jobs: DataFrame, path: str) -> None:
    write_json(jobs, path, mode="append")


def academine(institutions: DataFrame, matches: DataFrame, details: DataFrame) -> DataFrame:
    """institutions (id, string) with their entities from matches (id, uuid, match) and details (uuid, name, homeUrl, ...).

    An entity without details keeps its matches only.
    """
    m = matches.groupBy("id", "uuid").agg(F.array_sort(F.collect_set("match")).alias("matches")).join(details, "uuid", "left")
    fields = ["uuid", "matches", *[c for c in ("name", "homeUrl", "description", "rorId", "location") if c in details.columns]]
    e = m.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("entities"))
    return institutions.select("id", "string").join(e, "id", "left")


def upsert_tags(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """stored (identity, tags) with the lists of changed put in place of the old ones, each tag once."""
    new = changed.select("identity", F.array_distinct("tags").alias("new"))
    return stored.join(new, "identity", "full_outer").select("identity", F.coalesce("new", "tags").alias("tags"))


def save_session(session: DataFrame, seen: DataFrame) -> DataFrame:
    """session with the entries of seen (position) added to visited, and the last one as its position."""
    s = seen.agg(F.array_sort(F.collect_set("position")).alias("new"), F.max("position").alias("last"))
    out = session.crossJoin(F.broadcast(s))  # one row each
    return out.withColumn("visited", F.array_sort(F.array_union("visited", "new"))).withColumn("position", F.coalesce("last", "position")).drop("new", "last")


def session_complete(session: DataFrame, entries: int) -> DataFrame:
    """session with `complete`: whether all of so many entries were visited."""
    return session.withColumn("complete", F.size("visited") >= entries)


def discard_session(spark: SparkSession, path: str) -> None:
    """Removes a saved session."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
