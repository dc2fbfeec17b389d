"""Ignoring issues by tags, statistics over them, and the cursor over reported entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probewell.functions import identity_type


def mark_ignored(issues: DataFrame, tags: DataFrame, ignored: list[str]) -> DataFrame:
    """issues (identity, ...) with `ignored`: whether one of its tags is among those given."""
    out = issues.join(tags, "identity", "left")
    hit = F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")), F.array(*[F.lit(t) for t in ignored]).cast("array<string>"))
    return out.withColumn("ignored", F.coalesce(hit, F.lit(False))).drop("tags")


def statistics(issues: DataFrame) -> DataFrame:
    """(type, open, ignored) from issues (identity, ignored), the most frequent first."""
    by = issues.groupBy(identity_type("identity").alias("type")).agg(F.count_if(~F.col("ignored")).alias("open"), F.count_if("ignored").alias("ignored"))
    return by.orderBy((F.col("open") + F.col("ignored")).desc(), "type")


def entry_statistics(issues: DataFrame) -> DataFrame:
    """(open, ignored) numbers of entries (rid): an entry is open if one of its issues is."""
    by = issues.groupBy("rid").agg(F.bool_or(~F.col("ignored")).alias("is_open"))
    return by.agg(F.count_if("is_open").alias("open"), F.count_if(~F.col("is_open")).alias("ignored"))


def cursor(entries: DataFrame, order: str, valid: str, visited: DataFrame | None = None) -> DataFrame:
    """Reported entries with position, next and previous entry, wrapping around at the ends; `visited` (order) adds a column that says
    whether an entry was seen.

    An entry (order, valid) is reported if it isn't valid. The entries are one list, as a curator goes through it, and of a
    curator's size.
    """
    shown = entries.filter(~F.col(valid))
    w, whole = Window.orderBy(order), Window.partitionBy()
    first, last = F.min(order).over(whole), F.max(order).over(whole)
    out = shown.select(order, F.row_number().over(w).alias("position"), F.count("*").over(whole).alias("total"), F.coalesce(F.lead(order).over(w), first).alias("next"), F.coalesce(F.lag(order).over(w), last).alias("previous"))
    if visited is None:
        return out
    return out.join(visited.select(order).distinct().withColumn("visited", F.lit(True)), order, "left").withColumn("visited", F.coalesce("visited", F.lit(False)))


def step(shown: DataFrame, order: str, at: int, forward: bool = True) -> int | None:
    """The reported entry after or before index `at`; from the other end if there is none, None if nothing is reported."""
    side = F.col(order) > at if forward else F.col(order) < at
    best = F.min if forward else F.max
    near = shown.agg(best(F.when(side, F.col(order))).alias("near"), best(order).alias("end")).first()
    return near["near"] if near["near"] is not None else near["end"]


def total_label(visited: int, entries: int, found: int) -> str:
    """n+ until every entry has been looked at, then n."""
    return f"{found}" if visited >= entries else f"{found}+"
