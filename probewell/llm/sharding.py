"""Sharding by balanced label propagation. Native: DataFrame functions only.

Documents with equal texts are linked. Labels start at random; in each round every set of linked documents pulls its
members towards the shard that holds most of them, in exchange for as many rows the other way or as far as that shard's
quota has room. Rows without links then fill what is left, so the counts end at most one apart (law "rows").
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probewell.llm.common import prefix_sums, stored

#: A group's rows that start on a shard are dealt to so many cells, which move one by one.
PARTS = 16


def _places(rows: DataFrame, label: str, buckets: int) -> DataFrame:
    """rows with _place: a gapless number from 0 within each label, from bucket counts and windows within a bucket."""
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets))).withColumn("_one", F.lit(1))
    starts = prefix_sums(rows, [label], "_bucket", "_one", "_start").drop("_own")
    own = F.row_number().over(Window.partitionBy(label, "_bucket").orderBy("_row"))
    return rows.withColumn("_own", own).join(starts, [label, "_bucket"]).withColumn("_place", F.col("_start") + F.col("_own") - 1).drop("_bucket", "_one", "_own", "_start")


def _ahead(cells: DataFrame, within: list[str], out: str) -> DataFrame:
    """cells with `out`: the sum of n up to and with each cell, within `within`, in the order of _bucket and hash."""
    starts = prefix_sums(cells, within, "_bucket", "n", "_start").drop("_own")
    own = F.sum("n").over(Window.partitionBy(*within, "_bucket").orderBy("_hash", "group", "start").rowsBetween(Window.unboundedPreceding, 0))
    return cells.withColumn("_upto", own).join(starts, [*within, "_bucket"]).withColumn(out, F.col("_start") + F.col("_upto")).drop("_start", "_upto")


def _round(cells: DataFrame, shards: int, quota: int, buckets: int, nth: int) -> DataFrame:
    """One round of label propagation on cells (group, start, n, label, refused): parts of a group that started together.

    A group wants its fullest label; one that was refused there wants its next one, and only if it is small does all of it
    go. Between two labels as many rows may cross one way as the other, and what is free of a quota takes more. Large gains
    go first, equal ones in an order that changes with every round.
    """
    held = cells.groupBy("group", "label").agg(F.sum("n").alias("_n"))
    group = held.groupBy("group").agg(F.sum("_n").alias("_all"))
    refused = cells.groupBy("group").agg(F.max("refused").alias("_refused"))
    order = F.struct(F.col("label") != F.coalesce("_refused", F.lit(-1)), "_n", F.xxhash64("group", "label"), "label")
    best = held.join(refused, "group").groupBy("group").agg(F.max(order).alias("_b")).select("group", F.col("_b._n").alias("_there"), F.col("_b.label").alias("_to"))
    wish = cells.join(held.withColumnRenamed("_n", "_here"), ["group", "label"]).join(best, "group").join(group, "group")
    gain = F.col("_there") - F.col("_here")
    ties = (gain == 0) & (F.xxhash64("group", "_to") > F.xxhash64("group", "label"))
    wish = wish.filter("label <> _to").filter((gain > 0) | ties | (F.col("_all") <= max(1, quota // 64)))
    rank = F.lit(40) - F.floor(F.log2(F.greatest(gain, F.lit(0)) + 1)).cast("int")
    wish = wish.withColumn("_hash", F.xxhash64(F.lit(nth), "group", "start")).withColumn("_bucket", rank * buckets + F.pmod("_hash", F.lit(buckets)))
    wish = _ahead(wish.select("group", "start", "n", "label", "_to", "_hash", "_bucket"), ["label", "_to"], "_upto_pair")
    flow = wish.groupBy("label", "_to").agg(F.sum("n").alias("_flow"))
    back = flow.select(F.col("_to").alias("label"), F.col("label").alias("_to"), F.col("_flow").alias("_back"))
    wish = stored(wish.join(F.broadcast(back), ["label", "_to"], "left").withColumn("_swap", F.col("_upto_pair") <= F.coalesce("_back", F.lit(0))).drop("_back"))
    # One row for each label: what its quota has free after the swaps.
    there = cells.groupBy("label").agg(F.sum("n").alias("_n"))
    into = wish.filter("_swap").groupBy(F.col("_to").alias("label")).agg(F.sum("n").alias("_in"))
    out = wish.filter("_swap").groupBy("label").agg(F.sum("n").alias("_out"))
    room = there.join(into, "label", "full").join(out, "label", "full").select(F.col("label").alias("_to"), (F.lit(quota) - F.coalesce("_n", F.lit(0)) - F.coalesce("_in", F.lit(0)) + F.coalesce("_out", F.lit(0))).alias("_room"))
    rest = _ahead(wish.filter("not _swap"), ["_to"], "_upto_all").join(F.broadcast(room), "_to", "left")
    rest = rest.select("group", "start", "_to", (F.col("_upto_all") <= F.coalesce("_room", F.lit(quota))).alias("_ok"))
    asked = wish.filter("_swap").select("group", "start", "_to", F.lit(True).alias("_ok")).unionByName(rest)
    moved = cells.drop("refused").join(asked, ["group", "start"], "left")
    return moved.select("group", "start", "n", F.when(F.col("_ok"), F.col("_to")).otherwise(F.col("label")).alias("label"), F.when(~F.col("_ok"), F.col("_to")).alias("refused"))


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = 4, bucket_rows: int = 2000) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs (doc_id, text).

    size: UTF-8 bytes of the text (null: none) plus 1. A null text links like an equal text, as an empty one does. Repeated
    rows are rows of their own; ids may be null. An empty table gives no rows. grown_shard is null: the law is "rows".

    Groups of any size are split over shards where one shard's quota can't hold them: rounds work on counts per group and
    starting label, and no group is ever gathered.
    """
    data = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data.cast("binary")).alias("text_crc32"), F.xxhash64(data).alias("_hash"))
    slim = stored(slim.withColumn("_row", F.monotonically_increasing_id()))
    n = slim.count()
    buckets, quota = max(1, -(-n // bucket_rows)), -(-n // shards)
    group = F.xxhash64("_hash", "text_crc32", "size")
    rows = slim.withColumn("group", group).withColumn("start", F.pmod(F.xxhash64("doc_id", "_row"), F.lit(shards * PARTS)).cast("int"))
    cells = rows.groupBy("group", "start").agg(F.count("*").alias("n"))
    linked = cells.groupBy("group").agg(F.sum("n").alias("_n")).filter("_n > 1").select("group")
    cells = stored(cells.join(linked, "group").select("group", "start", "n", (F.col("start") % shards).alias("label"), F.lit(None).cast("int").alias("refused")))
    for nth in range(rounds):
        cells = stored(_round(cells, shards, quota, buckets, nth))
    rows = rows.join(cells.select("group", "start", "label"), ["group", "start"], "left").select("_row", "doc_id", "size", "text_crc32", "label")
    # Linked rows stay where the rounds put them as far as the exact quota goes; the rest fill the gaps.
    spark = docs.sparkSession
    exact = spark.range(shards).select(F.col("id").cast("int").alias("label"), (F.lit(n // shards) + (F.col("id") < n % shards).cast("int")).cast("long").alias("_quota"))
    placed = stored(_places(rows.withColumn("label", F.coalesce("label", F.lit(-1))), "label", buckets).join(F.broadcast(exact), "label", "left").withColumn("_stays", (F.col("label") >= 0) & (F.col("_place") < F.col("_quota"))))
    stay = placed.filter("_stays")
    pool = placed.filter("not _stays").select("_row", "doc_id", "size", "text_crc32", F.lit(-1).alias("_pool"))
    gaps = exact.join(stay.groupBy("label").agg(F.count("*").alias("_held")), "label", "left").withColumn("_held", F.coalesce("_held", F.lit(0)))
    gap = F.col("_quota") - F.col("_held")
    upto = F.sum(gap).over(Window.orderBy("label"))
    # One row for each shard: the range of pool numbers that it takes.
    gaps = gaps.select("label", "_held", (upto - gap).alias("_from"), upto.alias("_upto")).filter("_upto > _from")
    filled = _places(pool, "_pool", buckets).join(F.broadcast(gaps), (F.col("_place") >= F.col("_from")) & (F.col("_place") < F.col("_upto")))
    cols = ["doc_id", "size", "text_crc32"]
    out = stay.select(*cols, F.col("label").alias("shard"), F.col("_place").alias("slot")).unionByName(filled.select(*cols, F.col("label").alias("shard"), (F.col("_place") - F.col("_from") + F.col("_held")).alias("slot")))
    return out.select(*cols, F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
