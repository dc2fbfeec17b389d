"""Mixing sources to target weights: hash-random keys, distributed prefix sums, an exact cut at each source's budget.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probewell.llm.common import WORD, prefix_sums, stored


def word_count(text: str):
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) from sizes (source, source_size, ...): one row per source.

    Sources in code-point order, null last, get the weights in turn and share the sum of all sizes; a target stops at
    `cap` times its source's size and the excess is shared anew by weight. Sorted by cap / weight, the capped sources are
    a prefix, so one running sum over the sources' table finds them.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy()
    t = t.withColumn("_all", F.sum("source_size").over(everything).cast("double")).withColumn("_wall", F.sum("_w").over(everything))
    before = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_c", F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_v", F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    t = t.withColumn("_full", F.col("_cap") <= F.col("_w") * (F.col("_all") - F.col("_c")) / (F.col("_wall") - F.col("_v")))
    kept = lambda c: F.coalesce(F.sum(F.when(F.col("_full"), F.col(c))).over(everything), F.lit(0.0))
    t = t.withColumn("_cs", kept("_cap")).withColumn("_vs", kept("_w"))
    share = F.col("_w") * (F.col("_all") - F.col("_cs")) / (F.col("_wall") - F.col("_vs"))
    return t.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(share)).drop("_w", "_cap", "_all", "_wall", "_c", "_v", "_full", "_cs", "_vs")


def mix(docs: DataFrame, keys: list[str], text: str = "text", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 17, bucket_rows: int = 2000, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row of docs as (keys, size, source_size, target, taken).

    A source's rows stand in the order of a hash-random key. Of its budget, floor(target), whole epochs take every row
    once each; the rest is cut in that order at the exact word, so at most one row of a source is taken in part. The key
    is split in ranges of about bucket_rows rows; a range's offset is a prefix sum over ranges, and only rows of
    one range meet in a window, whatever share of all rows a source holds.

    Null text counts 0 words. Null sources are one source. Repeated rows are rows of their own. An empty table gives none.
    """
    rows = docs.select(*[F.col(k) for k in keys], *[F.col(c) for c in carry], F.col(source).alias("_source"), word_count(text).alias("size"), F.xxhash64(F.lit(seed), *keys, text).alias("_key"))
    rows = stored(rows)
    sums = targets(rows.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("_n")), weights, cap)
    sums = sums.select(F.col("source").alias("_of"), "source_size", "target", F.ceil(F.col("_n") / bucket_rows).cast("long").alias("_nb"))
    # The key's upper 31 bits, without sign, scaled to the source's number of ranges: monotone in the key's unsigned order.
    place = F.shiftrightunsigned("_key", 33)
    rows = rows.join(sums, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of").withColumn("_place", place).withColumn("_bucket", F.floor(F.col("_place") * F.col("_nb") / F.lit(float(2**31))).cast("long"))
    starts = prefix_sums(rows, ["_source"], "_bucket", "size", "_start").select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), "_start")
    rows = rows.join(starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    own = Window.partitionBy("_source", "_bucket").orderBy("_place", "_key", *keys, "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_start") + F.coalesce(F.sum("size").over(own), F.lit(0))
    budget = F.floor("target").cast("long")
    epochs = F.coalesce(F.floor(F.try_divide(F.floor("target"), F.col("source_size"))).cast("long"), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - epochs * F.col("source_size") - before))
    return rows.select(*keys, *carry, "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as the mix takes them: one copy for each epoch, the row at the cut with its first words only.

    The columns are those of docs; n_chars, where there is one, follows a shortened text. A row's number is fixed by
    writing it out, so clashing or null ids and repeated rows do no harm.
    """
    numbered = stored(docs.withColumn("_mix_row", F.monotonically_increasing_id()))
    # The key is hashed from the row's own columns, so that reruns agree whatever the partitions.
    taken = mix(numbered, [c for c in ("doc_id",) if c in docs.columns], carry=("_mix_row",), **options)
    taken = taken.filter("taken > 0").select("_mix_row", F.col("size").alias("_mix_size"), F.col("taken").alias("_mix_taken"))
    rows = numbered.join(taken, "_mix_row")
    copies = F.sequence(F.lit(1), F.ceil(F.col("_mix_taken") / F.col("_mix_size")).cast("int"))
    rows = rows.withColumn("_mix_copy", F.explode(copies)).withColumn("_mix_left", F.col("_mix_taken") - (F.col("_mix_copy") - 1) * F.col("_mix_size"))
    cut = F.col("_mix_left") < F.col("_mix_size")
    # Each piece is a word with the white space before it, so the pieces join to a prefix of the text.
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    first = F.array_join(F.slice(pieces, F.lit(1), F.col("_mix_left").cast("int")), "")
    rows = rows.withColumn("text", F.when(cut, first).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
