"""Tokens of what providers answer, less the ids of the provider itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probewell import functions as pf
from probewell.operators.issues import analysable
from probewell.operators.stored import stored

#: A run of word characters; exclusions begin and end at the border of one.
WORD_RUN = "[a-z0-9_]+"


def relevant_forms(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(key, forms): for each of texts (key, rid, text) the exclusion forms of its provider's ids (rid, lui) that may stand in it.

    A form can only match where the text has each of its runs of word characters as a run of its own. So the runs of the texts meet
    the longest run of each form in a join (of equal length the last one, since ids of a provider often begin alike), and a text gets the
    few forms that it may hold instead of the thousands that its provider has. Forms without word characters go to every text of their
    provider. Texts without forms are left out.
    """
    forms = ids.filter("lui is not null").select("rid", F.explode(pf.exclusion_forms(F.col("lui"))).alias("form")).distinct()
    sized = F.transform(F.regexp_extract_all(F.lower("form"), F.lit(WORD_RUN), F.lit(0)), lambda r, i: F.struct(F.length(r).alias("n"), i.alias("i"), r.alias("r")))
    forms = forms.withColumn("run", F.coalesce(F.array_max(sized)["r"], F.lit("")))
    runs = F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(F.lower("text"), F.lit(WORD_RUN), F.lit(0))))
    held = texts.select("key", "rid", F.explode(runs).alias("run"))
    return held.join(forms, ["rid", "run"]).groupBy("key").agg(F.collect_set("form").alias("forms"))


def analysed_tokens(pings: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(rid, lui, ord, tokens) of pings (rid, lui, ord, redirects, content): those with content and a final status of 200, less addresses and
    the ids of their provider (rid, lui); without ids, those of the pings count. Null providers have no ids."""
    known = pings.select("rid", "lui").distinct() if ids is None else ids.select("rid", "lui").distinct()
    rows = analysable(pings).select("rid", "lui", "ord", pf.plain_text("content").alias("text"))
    rows = stored(rows.withColumn("key", F.monotonically_increasing_id()))
    forms = relevant_forms(rows.select("key", "rid", "text"), known)
    out = rows.join(forms, "key", "left").withColumn("pattern", pf.pattern_of_forms(F.coalesce("forms", F.array().cast("array<string>"))))
    return out.select("rid", "lui", "ord", pf.tokens_of_text("text", F.col("pattern")).alias("tokens"))
