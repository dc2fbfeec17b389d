"""Planning of probes: known and random ids of each resource, quotas, repetition, resumption."""

from __future__ import annotations

import random
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probewell import functions as pf
from probewell.operators.stored import stored


def live_resources(namespaces: DataFrame, resources: DataFrame) -> DataFrame:
    """Resources that aren't deprecated, of namespaces that aren't."""
    ns = namespaces.filter("not deprecated").select("prefix", "pattern", F.col("sampleId").alias("namespace_sample"), F.col("namespaceEmbeddedInLui").alias("embedded"))
    return resources.filter("not deprecated").join(ns, "prefix")


def sample_ids(resources: DataFrame, num_valid: int) -> DataFrame:
    """(rid, lui): the namespace's and the resource's sample ids, the first num_valid of them, each once."""
    ids = F.slice(F.filter(F.array("namespace_sample", "sampleId"), lambda x: x.isNotNull()), 1, num_valid)
    return resources.select(F.col("id").alias("rid"), F.explode(F.array_distinct(ids)).alias("lui"))


def mined_ids(log: DataFrame, namespaces: DataFrame, host: str = "identifiers.org") -> DataFrame:
    """(namespace, lui) known from requests (url): distinct compact ids that the namespace's pattern accepts.

    Deprecated namespaces and ids that don't parse are dropped. Ids are made distinct before the join.
    """
    # Out of an array, so that no filter on the id is pushed down and makes it again.
    compact = F.filter(F.array(pf.compact_id_of_url("url", host)), lambda c: c.contains(":"))
    ids = log.select(F.explode(compact).alias("compact")).distinct()
    parts = ids.withColumn("prefix", F.lower(F.substring_index("compact", ":", 1))).withColumn("lui", F.expr("substring(compact, instr(compact, ':') + 1)"))
    ns = namespaces.filter("not deprecated").select("prefix", "pattern", "namespaceEmbeddedInLui")
    return parts.join(ns, "prefix").filter(F.regexp_like("lui", "pattern")).select(F.col("prefix").alias("namespace"), pf.without_namespace("lui", "namespaceEmbeddedInLui").alias("lui")).distinct()


def pick(spare: DataFrame, quota: DataFrame, seed: int = 0) -> DataFrame:
    """A random sample of spare (rid, lui) of as many rows for each rid as quota (rid, n) says, in a seeded hash order."""
    w = Window.partitionBy("rid").orderBy(F.xxhash64("rid", "lui", F.lit(seed)), "lui")
    return spare.join(quota, "rid").withColumn("_r", F.row_number().over(w)).filter("_r <= n").drop("_r", "n")


def redistribute(need: DataFrame) -> DataFrame:
    """(rid, n) from need (rid, wanted, available): what a resource lacks is shared evenly by those that have ids to spare.

    Water filling: resources in order of spare ids are filled to a common level, the last ones take the remainder one each.
    The running sums are over one row for each resource.
    """
    n = need.withColumn("own", F.least("wanted", "available")).withColumn("spare", F.col("available") - F.col("own"))
    total = n.agg(F.sum(F.col("wanted") - F.col("own")).alias("missing"))
    has = n.filter("spare > 0")
    w = Window.orderBy("spare", "rid")
    before = F.coalesce(F.sum("spare").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.count("*").over(Window.partitionBy()) - F.row_number().over(w) + 1
    has = has.crossJoin(F.broadcast(total)).withColumn("before", before).withColumn("left", left)  # total is one row
    # A resource is emptied if an even share of what is missing after the smaller ones is not less than its spare ids.
    has = has.withColumn("full", F.col("spare") * F.col("left") <= F.col("missing") - F.col("before"))
    level = F.struct(F.coalesce(F.sum(F.when(F.col("full"), F.col("spare"))).over(Window.partitionBy()), F.lit(0)).alias("given"), F.count_if(~F.col("full")).over(Window.partitionBy()).alias("open"))
    has = has.withColumn("l", level).withColumn("at", F.row_number().over(Window.partitionBy("full").orderBy("spare", "rid")))
    rest = F.greatest(F.lit(0), F.col("missing") - F.col("l.given"))
    share = F.floor(F.try_divide(rest, F.col("l.open"))) + (F.col("at") <= F.pmod(rest, F.greatest(F.col("l.open"), F.lit(1)))).cast("int")
    more = has.select("rid", F.when(F.col("full"), F.col("spare")).otherwise(F.least("spare", share)).alias("more"))
    return n.join(more, "rid", "left").select("rid", (F.col("own") + F.coalesce("more", F.lit(0))).cast("long").alias("n"))


def available(resources: DataFrame, known: DataFrame, held: DataFrame) -> DataFrame:
    """(rid, available): how many of its namespace's known ids (prefix, lui) a resource doesn't hold (rid, lui) yet.

    Known ids are counted once for each namespace, so nothing is multiplied by the resources of a namespace.
    """
    r, k = resources.select(F.col("id").alias("rid"), "prefix"), known.select("prefix", "lui").distinct()
    sizes = k.groupBy("prefix").agg(F.count("*").alias("total"))
    used = held.select("rid", "lui").distinct().join(r, "rid").join(k, ["prefix", "lui"], "left_semi").groupBy("rid").agg(F.count("*").alias("used"))
    return r.join(sizes, "prefix").join(used, "rid", "left").select("rid", (F.col("total") - F.coalesce("used", F.lit(0))).alias("available"))


def ranked(known: DataFrame, seed: int = 0, bucket: int = 100_000) -> DataFrame:
    """(prefix, lui, pos): known ids of each namespace numbered from 0 in a seeded hash order.

    A namespace is dealt to buckets of about `bucket` ids by hash; the running sums see one row for each bucket.
    """
    k = known.select("prefix", "lui").distinct().withColumn("h", F.xxhash64("prefix", "lui", F.lit(seed)))
    parts = k.groupBy("prefix").agg(F.ceil(F.count("*") / bucket).alias("parts"))
    k = k.join(parts, "prefix").withColumn("b", F.pmod("h", "parts"))
    w = Window.partitionBy("prefix").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = k.groupBy("prefix", "b").agg(F.count("*").alias("n")).select("prefix", "b", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("prefix", "b").orderBy("h", "lui"))
    return k.withColumn("at", at).join(before, ["prefix", "b"]).select("prefix", "lui", (F.col("before") + F.col("at") - 1).alias("pos"))


def draw(resources: DataFrame, known: DataFrame, held: DataFrame, quota: DataFrame, seed: int = 0) -> DataFrame:
    """(rid, lui): as many of the namespace's known ids as quota (rid, n) says, none of those held (rid, lui).

    Each resource reads its namespace's hash order from a place of its own, around the end, so only as many rows as
    are taken (and held) meet, instead of every resource with every id. quota must not exceed what is available.
    """
    r = resources.select(F.col("id").alias("rid"), "prefix").join(quota.filter("n > 0"), "rid")
    sizes = known.select("prefix", "lui").distinct().groupBy("prefix").agg(F.count("*").alias("total"))
    own = held.select("rid", "lui").distinct()
    r = r.join(sizes, "prefix").join(own.groupBy("rid").agg(F.count("*").alias("own")), "rid", "left")
    reads = F.least("total", F.col("n") + F.coalesce("own", F.lit(0)))
    r = r.select("rid", "prefix", "n", "total", F.explode(F.sequence(F.lit(0).cast("long"), reads - 1)).alias("i"))
    r = r.withColumn("pos", F.pmod(F.pmod(F.xxhash64("rid", F.lit(seed)), "total") + F.col("i"), F.col("total")))
    found = r.join(ranked(known, seed), ["prefix", "pos"]).select("rid", "lui", "n", "i").join(own, ["rid", "lui"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("rid").orderBy("i"))
    return found.withColumn("_r", nth).filter("_r <= n").select("rid", "lui")


def plan(resources: DataFrame, samples: DataFrame, known: DataFrame, num_valid: int, pings: int = 1, seed: int = 0) -> DataFrame:
    """Jobs (rid, lui, random, url), each repeated `pings` times: samples, then other known ids up to num_valid for each resource.

    The distinct known ids and the quotas are written once, as several steps read them.
    """
    ids, ks = stored(samples.distinct()), stored(known.select(F.col("namespace").alias("prefix"), "lui").distinct())
    have = ids.groupBy("rid").agg(F.count("*").alias("have"))
    free = available(resources, ks, ids)
    need = resources.select(F.col("id").alias("rid")).join(have, "rid", "left").join(free, "rid", "left").select("rid", F.greatest(F.lit(0), num_valid - F.coalesce("have", F.lit(0))).alias("wanted"), F.coalesce("available", F.lit(0)).alias("available"))
    chosen = ids.unionByName(draw(resources, ks, ids, stored(redistribute(stored(need))), seed))
    return emit(chosen, resources, ks.withColumnRenamed("prefix", "namespace"), pings, seed)


def emit(chosen: DataFrame, resources: DataFrame, known: DataFrame, pings: int, seed: int = 0) -> DataFrame:
    """Jobs of chosen (rid, lui): random unless the namespace knows the id; repeated; in a seeded order."""
    r = resources.select(F.col("id").alias("rid"), "prefix", "urlPattern")
    k = known.select(F.col("namespace").alias("prefix"), "lui", F.lit(True).alias("_known")).distinct()
    jobs = chosen.join(r, "rid").join(k, ["prefix", "lui"], "left").select("rid", "lui", F.col("_known").isNull().alias("random"), pf.fill_pattern("urlPattern", "lui").alias("url"))
    return jobs.withColumn("ping", F.explode(F.sequence(F.lit(1), F.lit(pings)))).orderBy(F.xxhash64("rid", "lui", "ping", F.lit(seed))).drop("ping")


def remaining(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs without one for each completed one: a difference of bags."""
    return jobs.exceptAll(done.select(*jobs.columns))


URL_SAFE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"
CATEGORIES = {"CATEGORY_DIGIT": "0123456789", "CATEGORY_WORD": URL_SAFE[:62] + "_", "CATEGORY_SPACE": " "}


def random_match(pattern: str, rng: random.Random, most: int = 10) -> str | None:
    """A random string that a pattern matches; None for what isn't supported (lookarounds, back references).

    Groups, alternatives, classes, \\d, \\w, dots (URL-safe characters) and repeats, the unbounded ones up to `most`.
    """

    def chars(items) -> str:
        out, negated = set(), False
        for op, arg in items:
            if str(op) == "NEGATE":
                negated = True
            elif str(op) == "RANGE":
                out.update(map(chr, range(arg[0], arg[1] + 1)))
            elif str(op) == "CATEGORY":
                out.update(CATEGORIES[str(arg)])
            else:
                out.add(chr(arg))
        return "".join(sorted(set(URL_SAFE) - out if negated else out))

    def one(op, arg) -> str:
        match str(op):
            case "LITERAL":
                return chr(arg)
            case "ANY":
                return rng.choice(URL_SAFE)
            case "IN":
                return rng.choice(chars(arg))
            case "MAX_REPEAT" | "MIN_REPEAT":
                low, high, inner = arg
                return "".join(many(inner) for _ in range(rng.randint(low, max(low, most) if high == re._constants.MAXREPEAT else high)))
            case "SUBPATTERN":
                return many(arg[-1])
            case "BRANCH":
                return many(rng.choice(arg[1]))
            case "AT":
                return ""
        raise ValueError(op)

    def many(items) -> str:
        return "".join(one(op, arg) for op, arg in items)

    try:
        return many(re._parser.parse(pattern))
    except (ValueError, KeyError, IndexError, re.error):
        return None


def random_ids(resources: DataFrame, held: DataFrame, num_random: int, seed: int = 0) -> DataFrame:
    """(rid, lui): up to num_random random ids of each resource (id, pattern), none of those held (rid, lui); ten tries for each."""

    @F.pandas_udf("string")
    def draw(pattern: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([random_match(p, random.Random(k)) if isinstance(p, str) else None for p, k in zip(pattern, key)], dtype=object)

    tries = resources.select(F.col("id").alias("rid"), "pattern", F.explode(F.sequence(F.lit(1), F.lit(10 * num_random))).alias("try"))
    drawn = tries.select("rid", "try", draw("pattern", F.xxhash64("rid", "try", F.lit(seed))).alias("lui")).filter("lui is not null")
    new = drawn.groupBy("rid", "lui").agg(F.min("try").alias("try")).join(held, ["rid", "lui"], "left_anti")
    w = Window.partitionBy("rid").orderBy("try")
    return new.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= num_random).select("rid", "lui")
