"""Files against a closed schema: which path of which record breaks it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, NumericType, StructType

from probewell.sources import _opened


def schema_rows(kind: DataType, at: str = "") -> list[tuple[str, str]]:
    """(path, kind) of a schema: object, open object (a map), array, string, number, integer or boolean; items of an array are path[], values of a map path.*"""
    if isinstance(kind, StructType):
        return [(at, "object"), *(r for f in kind for r in schema_rows(f.dataType, f"{at}.{f.name}" if at else f.name))]
    if isinstance(kind, ArrayType):
        return [(at, "array"), *schema_rows(kind.elementType, f"{at}[]")]
    if isinstance(kind, MapType):
        return [(at, "map"), *schema_rows(kind.valueType, f"{at}.*")]
    if isinstance(kind, BooleanType):
        return [(at, "boolean")]
    if isinstance(kind, NumericType):
        return [(at, "integer" if kind.typeName() in ("byte", "short", "integer", "long") else "number")]
    return [(at, "string")]


def _kind(variant) -> Column:
    t = F.schema_of_variant(variant)
    whole = (t == "BIGINT") | t.startswith("TINYINT") | t.startswith("SMALLINT") | (t == "INT")
    return F.when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t == "BOOLEAN", "boolean").when(t == "STRING", "string").when(t == "VOID", "null").when(whole, "integer").otherwise("number")


def schema_errors(records: DataFrame, schema: StructType) -> DataFrame:
    """(file, record, path, rule) of records (file, record, text): every place that breaks a closed schema, in one pass over each level of nesting.

    rule is `not JSON` (path null), `unknown` for a field that the schema doesn't have, or `not <kind>` for a value of another kind. Nulls fit
    every kind; a whole number is a number too. path has the numbers of items (pings[3].lui). What lies under a bad place isn't looked at.
    A record is a row of its own at every level, so large records are split, not gathered.
    """
    spark = records.sparkSession
    closed = F.broadcast(spark.createDataFrame(schema_rows(schema), "place string, want string"))  # as many rows as the schema has fields
    deepest = max(p.count(".") + p.count("[]") for p, _ in schema_rows(schema)) + 2
    v = records.select("file", "record", F.try_parse_json("text").alias("v"))
    # Errors go along as rows without a value, so that each record is read and parsed once, whatever the depth.
    level = v.select("file", "record", F.when(F.col("v").isNotNull(), "").alias("path"), F.lit("").alias("place"), "v", F.when(F.col("v").isNull(), "not JSON").alias("rule"))
    for _ in range(deepest):
        seen = level.withColumn("kind", _kind("v")).join(closed, "place", "left")
        fits = (F.col("kind") == "null") | (F.col("kind") == F.col("want")) | ((F.col("want") == "map") & (F.col("kind") == "object")) | ((F.col("want") == "number") & (F.col("kind") == "integer"))
        rule = F.when(F.col("want").isNull(), "unknown").when(~fits, F.concat(F.lit("not "), F.when(F.col("want") == "map", "object").otherwise(F.col("want"))))
        seen = seen.withColumn("rule", F.coalesce("rule", rule)).filter("rule is not null or kind in ('object', 'array')")
        inner = seen.select("file", "record", "path", "place", "want", "rule", F.when(F.col("rule").isNull(), F.col("v")).alias("v"))
        level = spark.sql(
            """select file, record, case when rule is not null then t.path when e.key is null then concat(t.path, '[', e.pos, ']') when t.path = '' then e.key else concat(t.path, '.', e.key) end as path,
                case when rule is not null then '' when e.key is null then concat(t.place, '[]') when t.want = 'map' then concat(t.place, '.*') when t.place = '' then e.key else concat(t.place, '.', e.key) end as place, e.value as v, rule
               from {t} t, lateral variant_explode_outer(t.v) e where rule is not null or e.pos is not null""",
            t=inner,
        )
    return level.filter("rule is not null").select("file", "record", "path", "rule")


def check_files(spark: SparkSession, path: str, schema: str | StructType, lines: bool = True) -> DataFrame:
    """schema_errors() of files, gzip or plain by their first bytes: each line is a record (numbered from 1), or the whole file (1) without `lines`.

    A file that can't be unpacked gives one row with record and path null and the rule `unreadable`; the others are checked all the same.
    """
    kind = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), _opened("content").alias("text"))
    broken = files.filter("text is null").select("file", F.lit(None).cast("int").alias("record"), F.lit(None).cast("string").alias("path"), F.lit("unreadable").alias("rule"))
    if lines:
        rows = files.filter("text is not null").select("file", F.posexplode(F.split("text", "\n")).alias("pos", "text")).filter("trim(text) <> ''").select("file", (F.col("pos") + 1).alias("record"), "text")
    else:
        rows = files.filter("text is not null").select("file", F.lit(1).alias("record"), "text")
    return broken.unionByName(schema_errors(rows, kind))
