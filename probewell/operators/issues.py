"""Issues of providers found in their pings.

A ping is one row (rid, lui, random, redirects, empty_content, compact_id); the pings are a bag, hops stay nested in their row.
A validator is a function pings, parameters -> issues (rid, type, level, signature, compact_id, random, n, total).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probewell import functions as pf
from probewell.operators.stored import parts_of, stored

# The names by which HTTP status codes go, in the spelling of reports.
STATUS_NAMES = """
100 continue
101 switching protocols
102 processing
103 checkpoint
122 uri too long, request uri too long
200 ok, okay, all ok, all okay, all good, \u2713
201 created
202 accepted
203 non authoritative info, non authoritative information
204 no content
205 reset content, reset
206 partial content, partial
207 multi status, multiple status, multi stati, multiple stati
208 already reported
226 im used
300 multiple choices
301 moved permanently, moved
302 found
303 see other, other
304 not modified
305 use proxy
306 switch proxy
307 temporary redirect, temporary moved, temporary
308 permanent redirect, resume incomplete, resume
400 bad request, bad
401 unauthorized
402 payment required, payment
403 forbidden
404 not found, -o-
405 method not allowed, not allowed
406 not acceptable
407 proxy authentication required, proxy auth, proxy authentication
408 request timeout, timeout
409 conflict
410 gone
411 length required
412 precondition failed, precondition
413 request entity too large
414 request uri too large
415 unsupported media type, unsupported media, media type
416 requested range not satisfiable, requested range, range not satisfiable
417 expectation failed
418 im a teapot, teapot, i am a teapot
421 misdirected request
422 unprocessable entity, unprocessable
423 locked
424 failed dependency, dependency
425 unordered collection, unordered
426 upgrade required, upgrade
428 precondition required, precondition
429 too many requests, too many
431 header fields too large, fields too large
444 no response, none
449 retry with, retry
450 blocked by windows parental controls, parental controls
451 unavailable for legal reasons, legal reasons
499 client closed request
500 internal server error, server error, \u2717
501 not implemented
502 bad gateway
503 service unavailable, unavailable
504 gateway timeout
505 http version not supported, http version
506 variant also negotiates
507 insufficient storage
509 bandwidth limit exceeded, bandwidth
510 not extended
511 network authentication required, network auth, network authentication
"""
NAMES = {int(line[:3]): line[4:] for line in STATUS_NAMES.split("\n") if line}
RESOLVER = "https://identifiers.org/resolve?query="


def status_name(status: Column) -> Column:
    """404 (not found, -o-); a missing status is None (unknown)."""
    names = F.create_map(*[F.lit(x) for k, v in NAMES.items() for x in (k, v)])
    return F.concat(F.coalesce(status.cast("string"), F.lit("None")), F.lit(" ("), F.coalesce(F.try_element_at(names, status), F.lit("unknown")), F.lit(")"))


def answered(pings: DataFrame) -> DataFrame:
    """Pings with at least one hop, with their final status."""
    return pings.withColumn("_last", _last_hop()).withColumn("status", F.col("_last.status")).drop("_last")


def _last_hop() -> Column:
    """A generated row of the last hop, none without hops: so hops are made once, and no filter on it makes them again."""
    return F.explode(_hops_from_last())


def _hops_from_last() -> Column:
    return F.filter(F.slice("redirects", -1, 1), lambda h: F.lit(True))


def status_frequency(pings: DataFrame) -> DataFrame:
    """(rid, status, n); unknown statuses are left out."""
    return answered(pings).filter("status is not null").groupBy("rid", "status").agg(F.count("*").alias("n"))


def status_errors(pings: DataFrame, valid_rate: float = 0.0, random_rate: float = 1.0) -> DataFrame:
    """Error statuses (300 or more) whose rate among a provider's answered pings exceeds the rate given for known or random ids.

    Pings of unknown status count in the totals. One shuffle: statuses are pre-aggregated with the totals as a window over them.
    """
    return _status_rates(pings, valid_rate, random_rate)


def _status_rates(pings: DataFrame, valid_rate: float, random_rate: float, *more: Column) -> DataFrame:
    known, random = F.count_if(~F.col("random")), F.count_if(F.col("random"))
    by = answered(pings).groupBy("rid", "status").agg(known.alias("n_valid"), random.alias("n_random"), *more)
    w = Window.partitionBy("rid")
    by = by.withColumn("valid_total", F.sum("n_valid").over(w)).withColumn("random_total", F.sum("n_random").over(w)).filter("status >= 300")
    over = lambda n, total, rate: F.coalesce(F.try_divide(n, total) > rate, F.lit(False))
    by = by.withColumn("valid_over", over(F.col("n_valid"), F.col("valid_total"), valid_rate)).withColumn("random_over", over(F.col("n_random"), F.col("random_total"), random_rate))
    return by.filter("valid_over or random_over")


def collected(examples: DataFrame, pings: DataFrame, keys: tuple[str, ...] = ("signature",)) -> DataFrame:
    """Examples (rid, keys, compact_id, random) counted, each with the number of all pings of its compact id.

    Only the pings of ids with examples are counted.
    """
    n = examples.groupBy("rid", *keys, "compact_id", "random").agg(F.count("*").alias("n"))
    return n.join(_totals(n, pings), ["rid", "compact_id"])


def _totals(n: DataFrame, pings: DataFrame) -> DataFrame:
    """(rid, compact_id, total): all pings of the compact ids in n."""
    return pings.select("rid", "compact_id").join(n.select("rid", "compact_id").distinct(), ["rid", "compact_id"], "left_semi").groupBy("rid", "compact_id").agg(F.count("*").alias("total"))


def _example(x) -> Column:
    return F.concat(x.n.cast("string"), F.lit("/"), x.total.cast("string"), F.lit(" x ["), x.compact_id, F.lit(f"]({RESOLVER}"), x.compact_id, F.lit(") "), F.when(x.random, "(random)").otherwise("(non-random)"))


def example_text(issues: DataFrame) -> DataFrame:
    """One row for each (rid, type, signature): its examples as texts, the most frequent first, then by compact id."""
    e = F.struct((-F.col("n")).alias("m"), "compact_id", "random", "n", "total")
    return issues.groupBy("rid", "type", "signature").agg(F.transform(F.sort_array(F.collect_list(e)), _example).alias("examples"))


def _issue(df: DataFrame, kind, level: int, value=None) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select("rid", kind.alias("type"), F.lit(level).alias("level"), F.col("signature").cast("string").alias("signature"), F.lit(value).cast("double").alias("value") if value is None else value.alias("value"), "compact_id", "random", "n", "total")


def http_status_error(pings: DataFrame, valid_rate: float = 0.0, random_rate: float = 1.0, **_) -> DataFrame:
    """Examples of the statuses of status_errors() by the final URL: a signature is the status with its names and the URL as a link of lui_link()."""
    errors = status_errors(pings, valid_rate, random_rate).select("rid", "status", "valid_over", "random_over")
    hops = pings.select("rid", "lui", "compact_id", "random", _last_hop().alias("last")).select("rid", "lui", "compact_id", "random", "last.status", "last.url")
    hit = hops.join(errors, ["rid", "status"]).filter((~F.col("random") & F.col("valid_over")) | (F.col("random") & F.col("random_over")))
    # The same id gives the same few URLs again and again, so links are made of counted rows.
    n = hit.groupBy("rid", "lui", "compact_id", "random", "status", "url").agg(F.count("*").alias("same"))
    n = n.withColumn("signature", F.concat_ws(" ", status_name(F.col("status")), pf.lui_link("url", "lui")))
    n = n.groupBy("rid", "signature", "compact_id", "random").agg(F.sum("same").alias("n"))
    return _issue(n.join(_totals(n, pings), ["rid", "compact_id"]), "HTTPStatusError", 3)


#: The flag of a hop and the type of issue that it makes, by validator.
FLAGS = {"dns-error": ("dns_error", "DNSError"), "invalid-response": ("invalid_response", "InvalidResponseError"), "ssl-error": ("ssl_error", "SSLError")}


def flag_errors(pings: DataFrame, flags: dict[str, str]) -> DataFrame:
    """One example for each hop that has a flag of `flags` (flag -> type), all flags in one pass: (rid, type, signature, ...)."""
    hops = pings.select("rid", "lui", "compact_id", "random", F.explode("redirects").alias("hop"))
    kinds = F.array_compact(F.array(*[F.when(F.col(f"hop.{f}"), F.lit(kind)) for f, kind in flags.items()]))
    hits = hops.select("rid", "lui", "compact_id", "random", "hop.url", F.explode(kinds).alias("type"))
    return collected(hits.withColumn("signature", pf.lui_link("url", "lui")), pings, ("type", "signature"))


def _flag(name: str) -> Callable[..., DataFrame]:
    return lambda pings, **_: _issue(flag_errors(pings, dict([FLAGS[name]])), F.col("type"), 2)


def neighbour_hops(pings: DataFrame) -> DataFrame:
    """Each hop with the next one of its ping, without leaving the ping's row."""
    pairs = F.filter(F.transform("redirects", lambda h, i: F.struct(h.url.alias("url"), F.try_element_at("redirects", i + 2)["url"].alias("next"), i.alias("pos"))), lambda p: p.pos < F.size("redirects") - 1)
    return pings.select("rid", "compact_id", "lui", "random", F.explode(pairs).alias("p")).select("rid", "compact_id", "lui", "random", F.col("p.url").alias("url"), F.col("p.next").alias("next"))


def _scheme_only_hops(pings: DataFrame) -> DataFrame:
    hops = neighbour_hops(pings).filter((F.col("url") != F.col("next")) & (pf.without_scheme(F.col("url")) == pf.without_scheme(F.col("next"))))
    return hops.withColumn("signature", F.concat(pf.lui_link("url", "lui"), F.lit(" => "), pf.lui_link("next", "lui")))


def scheme_only_redirects(pings: DataFrame) -> DataFrame:
    """Neighbouring hops that differ in the scheme alone, by their links: from => to."""
    return collected(_scheme_only_hops(pings), pings)


def scheme_only_redirect(pings: DataFrame, **_) -> DataFrame:
    return _issue(scheme_only_redirects(pings), "SchemaRedirectError", 2)


def redirect_chains(pings: DataFrame, rows_per_part: int = 250_000) -> DataFrame:
    """Whole chains as JSON lists of URL and HTTP Status, the empty one included. A URL is a link as of lui_link().

    Pings go to the task of their compact id, of which there are the more the more pings there are, and nothing is shuffled after
    that: a compact id's total is the sum of its chains.
    """
    hop = lambda h: F.struct(pf.lui_link(h.url, F.col("lui")).alias("URL"), status_name(h.status).alias("HTTP Status"))
    known = pings.filter("rid is not null and compact_id is not null").select("rid", "lui", "compact_id", "random", "redirects")
    known = known.repartition(parts_of(pings, rows_per_part), "rid", "compact_id")
    chains = known.groupBy("rid", "lui", "compact_id", "random", "redirects").agg(F.count("*").alias("same"))
    n = chains.withColumn("signature", F.to_json(F.transform("redirects", hop))).groupBy("rid", "signature", "compact_id", "random").agg(F.sum("same").alias("n"))
    return n.select("rid", "compact_id", "signature", "random", "n", F.sum("n").over(Window.partitionBy("rid", "compact_id")).alias("total"))


def redirection_chain(pings: DataFrame, **_) -> DataFrame:
    return _issue(redirect_chains(pings), "RedirectChain", 2)


def analysable(pings: DataFrame) -> DataFrame:
    """The pings whose text is worth analysing: those that have content and a final status of 200."""
    return answered(pings).filter("content is not null and status = 200").drop("status")


def low_content(pings: DataFrame, analysis: DataFrame, threshold: float = 0.1, rows_per_part: int = 250_000) -> DataFrame:
    """Pings with content and status 200 of providers whose best id has at most `threshold` of content of its own: counted examples
    with `value`, that best content, and the content, length and noise of each example's id, null where it wasn't analysed.

    Pings are counted by id, met by the analysis of that, and summed by compact id: one shuffle each.
    """
    low = stored(analysis.groupBy("rid").agg(F.max("information_content").alias("value")).filter(F.col("value") <= threshold))
    low = F.broadcast(low) if low.count() <= 1_000_000 else low
    # Of several analyses the last by ord counts, or else the largest.
    last = F.col("ord") if "ord" in analysis.columns else F.lit(0)
    item = F.struct(last.alias("ord"), F.struct("information_content", "length", "noise").alias("i"))
    parts = parts_of(pings, rows_per_part)
    items = analysis.repartition(parts, "rid", "lui").groupBy("rid", "lui").agg(F.max(item).alias("item"))
    p = pings.filter("compact_id is not null").select("rid", "lui", "compact_id", "random", "empty_content", F.explode_outer(_hops_from_last()).alias("last"))
    good = (F.col("last.status") == 200) & ~F.col("empty_content")
    kinds = {"yes": F.col("random"), "no": ~F.col("random"), "unknown": F.col("random").isNull()}
    p = p.select("rid", "lui", "compact_id", *[(good & is_kind).alias(k) for k, is_kind in kinds.items()]).join(low, "rid").repartition(parts, "rid", "lui")
    ids = p.groupBy("rid", "lui", "compact_id", "value").agg(F.count("*").alias("total"), *[F.count_if(k).alias(k) for k in kinds])
    ids = ids.join(items, ["rid", "lui"], "left").select("rid", "compact_id", "value", "item", "total", *kinds).repartition(parts, "rid", "compact_id")
    found = ids.groupBy("rid", "compact_id", "value").agg(F.max("item").alias("item"), F.sum("total").alias("total"), *[F.sum(k).alias(k) for k in kinds])
    counts = [F.struct(F.lit(r).cast("boolean").alias("random"), F.col(k).alias("n")) for k, r in zip(kinds, (True, False, None))]
    found = found.withColumn("e", F.explode(F.array(*counts))).filter("e.n > 0")
    return found.select("rid", "compact_id", pf.percent(F.col("value")).alias("signature"), "e.random", "e.n", "total", "value", "item.i.*")


def information_content(pings: DataFrame, analysis: DataFrame | None = None, threshold: float = 0.1, **_) -> DataFrame:
    """Providers whose best id has at most `threshold` of content of its own."""
    if analysis is None:
        raise ValueError("information-content needs the analysis of the pings")
    return _issue(low_content(pings, analysis, threshold), "InformationContent", 1, F.col("value"))


def content_report(pings: DataFrame, analysis: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(rid, content, examples): for each provider of low_content() its analysed examples, those with most content first, each as
    (id, content, length, noise) in words."""
    found = low_content(pings, analysis, threshold).filter("information_content is not null")
    row = F.struct((-F.col("information_content")).alias("m"), (-F.col("n")).alias("k"), "compact_id", "random", "n", "total", "information_content", "length", "noise")
    text = lambda x: F.struct(_example(x).alias("id"), pf.percent(x.information_content).alias("content"), F.concat(x.length.cast("string"), F.lit(" words")).alias("length"), x.noise.alias("noise"))
    return found.groupBy("rid", F.col("signature").alias("content")).agg(F.transform(F.sort_array(F.collect_list(row)), text).alias("examples"))


@dataclass
class Verdict:
    """What a validator may return instead of issues alone: issues, and entries (rid) that are excluded whatever others found."""

    issues: DataFrame
    excluded: DataFrame


VALIDATORS: dict[str, Callable[..., DataFrame]] = {
    "dns-error": _flag("dns-error"),
    "http-status-error": http_status_error,
    "information-content": information_content,
    "invalid-response": _flag("invalid-response"),
    "redirection-chain": redirection_chain,
    "scheme-only-redirect": scheme_only_redirect,
    "ssl-error": _flag("ssl-error"),
}
#: Parameters that a validator takes in a specification, with their types.
PARAMETERS: dict[str, dict[str, type]] = {"information-content": {"threshold": float}, "http-status-error": {"valid_rate": float, "random_rate": float}}


def register(name: str, validator: Callable[..., DataFrame], **parameters: type) -> None:
    """Adds a validator: a function of pings and named parameters that gives issues."""
    VALIDATORS[name], PARAMETERS[name] = validator, parameters


@dataclass(frozen=True)
class Spec:
    name: str
    parameters: dict = field(default_factory=dict)


def parse_spec(text: str) -> Spec:
    """name or name:param=value,flag. Unknown names and parameters are errors; a flag is True."""
    m = re.fullmatch(r"([^:]+)(?::(.*))?", text)
    name = m[1] if m else ""
    if name not in VALIDATORS:
        raise ValueError(f"unknown validator {name!r}")
    known, found = PARAMETERS.get(name, {}), {}
    for part in filter(None, (m[2] or "").split(",")):
        key, is_set, value = part.partition("=")
        if key not in known:
            raise ValueError(f"unknown parameter {key!r} of {name}")
        found[key] = known[key](value) if is_set else True
    return Spec(name, found)


def find_issues(pings: DataFrame, registry: DataFrame, specs: list[str], **shared) -> DataFrame:
    """Issues of all validators for the providers in the registry (rid); others are left out before any validator runs.

    A validator returns issues, or a Verdict: entries that one excludes have no issues at all. Flags are looked for in one pass.
    """
    known = pings.join(registry.select("rid").distinct(), "rid", "left_semi")
    parsed, found, excluded = [parse_spec(s) for s in specs], [], None
    flags = dict(FLAGS[s.name] for s in parsed if s.name in FLAGS and VALIDATORS[s.name].__module__ == __name__)
    if len(flags) > 1:
        found.append(_issue(flag_errors(known, flags), F.col("type"), 2))
        parsed = [s for s in parsed if not (s.name in FLAGS and FLAGS[s.name][0] in flags)]
    for spec in parsed:
        got = VALIDATORS[spec.name](known, **shared | spec.parameters)
        if isinstance(got, Verdict):
            gone = got.excluded.select("rid").distinct()
            excluded, got = gone if excluded is None else excluded.unionByName(gone), got.issues
        found.append(got)
    if not found:
        raise ValueError("no validator given")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out if excluded is None else out.join(excluded, "rid", "left_anti").select(out.columns)


def _status_signatures(pings: DataFrame, valid_rate: float = 0.0, random_rate: float = 1.0) -> DataFrame:
    """The statuses of http_status_error(), of which identities hold no more."""
    named = F.col("compact_id").isNotNull()
    held = [F.max(named & k).alias(c) for c, k in (("valid", ~F.col("random")), ("invalid", F.col("random")))]
    by = _status_rates(pings, valid_rate, random_rate, *held).filter("(valid and valid_over) or (invalid and random_over)")
    return by.select("rid", F.lit("HTTPStatusError").alias("type"), F.col("status").cast("string").alias("signature"))


def _redirect_signatures(pings: DataFrame) -> DataFrame:
    hops = _scheme_only_hops(pings).filter("compact_id is not null")
    return hops.select("rid", F.lit("SchemaRedirectError").alias("type"), "signature").distinct()


def _flag_signatures(flags: dict[str, str]) -> Callable[[DataFrame], DataFrame]:
    def run(pings: DataFrame) -> DataFrame:
        any_hop = lambda flag: F.exists("redirects", lambda h: F.coalesce(h[flag], F.lit(False)))
        kinds = F.array_compact(F.array(*[F.when(any_hop(f), F.lit(kind)) for f, kind in flags.items()]))
        return pings.filter("compact_id is not null").select("rid", F.explode(kinds).alias("type")).distinct().withColumn("signature", F.lit(None).cast("string"))

    return run


def _chain_signatures(pings: DataFrame) -> DataFrame:
    return pings.filter("compact_id is not null").select("rid", F.lit("RedirectChain").alias("type"), F.lit(None).cast("string").alias("signature")).distinct()


#: What identities need of the issues of a validator: (rid, type, signature), each once, pre-aggregated and without examples.
SIGNATURES: dict[str, Callable[..., DataFrame]] = {
    "http-status-error": _status_signatures,
    "redirection-chain": _chain_signatures,
    "scheme-only-redirect": _redirect_signatures,
    **{name: _flag_signatures(dict([flag])) for name, flag in FLAGS.items()},
}
_OWN = {name: VALIDATORS[name] for name in SIGNATURES}


def find_identities(pings: DataFrame, registry: DataFrame, specs: list[str], **shared) -> DataFrame:
    """identities() of find_issues(). Where no validator needs them, examples are not collected: pings are aggregated by provider before
    anything is shuffled, and providers that aren't in the registry go from the result."""
    parsed = [parse_spec(s) for s in specs]
    if not parsed or any(VALIDATORS[s.name] is not _OWN.get(s.name) for s in parsed):
        return identities(find_issues(pings, registry, specs, **shared))
    flags = dict(FLAGS[s.name] for s in parsed if s.name in FLAGS)
    found = [_flag_signatures(flags)(pings)] if flags else []
    found += [SIGNATURES[s.name](pings, **s.parameters) for s in parsed if s.name not in FLAGS]
    known = functools.reduce(DataFrame.unionByName, found).join(registry.select("rid").distinct(), "rid", "left_semi")
    return identities(known.withColumn("value", F.lit(None).cast("double")))


def identities(issues: DataFrame) -> DataFrame:
    """(rid, type, identity): one row for each issue of a provider, with the key that tags refer to."""
    g = issues.groupBy("rid", "type").agg(F.array_sort(F.collect_set("signature")).alias("s"), F.round(F.max("value"), 1).alias("v"))
    codes = F.array_sort(F.array_distinct(F.transform("s", lambda x: F.regexp_extract(x, r"^\d+", 0).try_cast("int"))))
    fields = {
        "HTTPStatusError": F.struct("rid", codes.alias("status_code"), "type"),
        "SchemaRedirectError": F.struct(F.col("s").alias("redirects"), "rid", "type"),
        "InformationContent": F.struct("rid", F.col("v").alias("total_information_content"), "type"),
    }
    id_ = F.to_json(F.struct("rid", "type"))
    for kind, struct in fields.items():
        id_ = F.when(F.col("type") == kind, F.to_json(struct)).otherwise(id_)
    return g.select("rid", "type", id_.alias("identity")).withColumn("identity", pf.ascii_json("identity"))
