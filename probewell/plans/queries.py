"""Queries over the benchmark tables, each with the same result in SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probewell import functions as pf
from probewell.operators import content, curation, fragments, issues, jobs, linking, suffixes
from probewell.operators.stored import parts_of, shared_folder, stored
from probewell.plans.views import pings, view, with_views
from probewell.sources import checks
from probewell.sources import known_ids as known_id_rows
from probewell.sources import nest_datamine, read_jobs, upsert_tags, write_json, write_known_ids
from probewell.streaming import failure_rates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql.strip())
        return f

    return add


ANSWERED = "a as (select * from v_ping where n_hops > 0)"
TOTALS = "c as (select rid, compact_id, count(*) as total from v_ping group by all)"


def _link(url: str) -> str:
    return f"case when contains({url}, lui) then replace({url}, lui, '{{$id}}') else concat('<', {url}, '>') end"

ERRORS = f"""{ANSWERED}, t as (select rid, count(*) filter (where not random) as valid_total, count(*) filter (where random) as random_total from a group by rid),
 e as (select rid, final_status as status, count(*) filter (where not random) as n_valid, count(*) filter (where random) as n_random from a where final_status >= 300 group by 1, 2),
 x as (select e.*, valid_total, random_total, coalesce(n_valid / nullif(valid_total, 0)::double > 0.2, false) as valid_over, coalesce(n_random / nullif(random_total, 0)::double > 0.3, false) as random_over from e join t using (rid))"""


@query(f"with {ERRORS} select rid, status, n_valid, n_random, valid_total, random_total, valid_over, random_over from x where valid_over or random_over")
def status_error(spark, d):
    return issues.status_errors(pings(spark, d), 0.2, 0.3)


STATUS = "case final_status when 200 then '200 (ok, okay, all ok, all okay, all good, \u2713)' when 404 then '404 (not found, -o-)' when 500 then '500 (internal server error, server error, \u2717)' else 'None (unknown)' end"
FINAL = _link("case when n_hops = 2 then second_url else first_url end")


@query(f"""with {ERRORS}, h as (select a.rid, concat({STATUS}, ' ', {FINAL}) as signature, compact_id, random, count(*) as n from a join x on a.rid = x.rid and a.final_status = x.status
  where (not random and valid_over) or (random and random_over) group by all), {TOTALS}
 select h.rid, 'HTTPStatusError' as type, 3 as level, signature, cast(null as double) as value, h.compact_id, random, n, total from h join c on h.rid = c.rid and h.compact_id = c.compact_id""")
def status_error_examples(spark, d):
    return issues.http_status_error(pings(spark, d), 0.2, 0.3)


@query("select rid, final_status as status, count(*) as n from v_ping where n_hops > 0 and final_status is not null group by all")
def status_frequency(spark, d):
    return issues.status_frequency(pings(spark, d))


def _flag(name: str, flag: str, kind: str) -> None:
    def f(spark, d):
        return issues.flag_errors(pings(spark, d), {flag: kind})

    f.__name__ = name
    query(f"""with h as (select rid, '{kind}' as type, {_link("first_url")} as signature, compact_id, random, count(*) as n from v_ping where n_hops > 0 and {flag} group by all),
    {TOTALS} select h.*, total from h join c using (rid, compact_id)""")(f)


_flag("flag_error_dns", "dns_error", "DNSError")
_flag("flag_error_ssl", "ssl_error", "SSLError")
_flag("flag_error_invalid", "invalid_response", "InvalidResponseError")


@query(f"""with h as (select rid, concat({_link("first_url")}, ' => ', {_link("second_url")}) as signature, compact_id, random, count(*) as n from v_ping
  where n_hops = 2 and first_url <> second_url and substr(first_url, 8) = substr(second_url, 9) group by all), {TOTALS}
 select h.*, total from h join c using (rid, compact_id)""")
def scheme_only_redirect(spark, d):
    return issues.scheme_only_redirects(pings(spark, d))


@query(f"""with n as (select *, {STATUS} as s, {_link("first_url")} as u, {_link("second_url")} as v from v_ping),
 h as (select rid, concat('[', case n_hops when 0 then '' when 1 then concat('{{"URL":"', u, '","HTTP Status":"', s, '"}}')
   else concat('{{"URL":"', u, '","HTTP Status":"301 (moved permanently, moved)"}},{{"URL":"', v, '","HTTP Status":"', s, '"}}') end, ']') as signature, compact_id, random, count(*) as n from n group by all), {TOTALS}
 select h.*, total from h join c using (rid, compact_id)""")
def redirect_chain(spark, d):
    return issues.redirect_chains(pings(spark, d))


@query(f"""with {ERRORS}, s as (select distinct a.rid, a.final_status from a join x on a.rid = x.rid and a.final_status = x.status where (not random and valid_over) or (random and random_over)),
  h as (select rid, concat('{{"rid":', rid, ',"status_code":[', string_agg(final_status, ',' order by final_status), '],"type":"HTTPStatusError"}}') as identity, 'HTTPStatusError' as type from s group by rid),
  f as (select distinct rid, concat({_link("first_url")}, ' => ', {_link("second_url")}) as l from v_ping where n_hops = 2 and first_url <> second_url and substr(first_url, 8) = substr(second_url, 9)),
  g as (select rid, concat('{{"redirects":["', string_agg(l, '","' order by l), '"],"rid":', rid, ',"type":"SchemaRedirectError"}}') as identity, 'SchemaRedirectError' as type from f group by rid),
  z as (select distinct rid, concat('{{"rid":', rid, ',"type":"SSLError"}}') as identity, 'SSLError' as type from v_ping where ssl_error and n_hops > 0)
 select rid, type, identity from h union all select rid, type, identity from g union all select rid, type, identity from z""")
def issue_identities(spark, d):
    """The keys under which curators tag issues."""
    return issues.find_identities(pings(spark, d), view(spark, d, "v_resource"), ["http-status-error:valid_rate=0.2,random_rate=0.3", "scheme-only-redirect", "ssl-error"])


#: An analysis of ids by arithmetic on the pings, so that the oracle has it too.
ANALYSIS = "y as (select rid, lui, count(*) % 11 / 100.0::double + (rid % 9) / 100.0::double as information_content, count(*) as length, min(cast(lui as bigint)) % 4 as noise from v_ping group by rid, lui)"
LOW = f"""{ANALYSIS}, b as (select rid, max(information_content) as value from y group by rid having max(information_content) <= 0.1),
 h as (select v.rid, v.lui, v.compact_id, random, value, count(*) as n from v_ping v join b on v.rid = b.rid where n_hops > 0 and final_status = 200 and not empty_content group by all), {TOTALS}"""


def _analysis(spark, d) -> DataFrame:
    per = (F.count("*") % 11).cast("double") / 100.0 + (F.col("rid") % 9).cast("double") / 100.0
    v = view(spark, d, "v_ping")
    # As low_content() wants them, which shuffles them no more then.
    return v.repartition(parts_of(v, 250_000), "rid", "lui").groupBy("rid", "lui").agg(per.alias("information_content"), F.count("*").alias("length"), (F.min(F.col("lui").cast("bigint")) % 4).alias("noise"))


@query(f"with {LOW} select h.rid, h.compact_id, random, h.n, total, value, information_content, length, noise from h join c on h.rid = c.rid and h.compact_id = c.compact_id join y on h.rid = y.rid and h.lui = y.lui")
def information_content_issue(spark, d):
    """Examples of providers whose best id has little content of its own, with each id's analysis."""
    return issues.low_content(pings(spark, d), _analysis(spark, d)).drop("signature")


ISSUES = """i as (select distinct rid, 'DNSError' as type from v_ping where dns_error and n_hops > 0 union all select distinct rid, 'SSLError' from v_ping where ssl_error union all
 select distinct rid, 'InvalidResponseError' from v_ping where invalid_response), j as (select rid, type, rid % 7 = 0 and type = 'DNSError' as ignored from i)"""


def _tagged(spark, d) -> DataFrame:
    p = pings(spark, d)
    found = issues.find_identities(p, view(spark, d, "v_resource"), ["dns-error", "ssl-error", "invalid-response"])
    tags = found.filter("rid % 7 = 0 and type = 'DNSError'").select("identity", F.array(F.lit("known"), F.lit("later")).alias("tags"))
    return curation.mark_ignored(found, tags, ["known"])


@query(f"""with {ISSUES} select type, count(*) filter (where not ignored) as "open", count(*) filter (where ignored) as ignored from j group by type""")
def issue_statistics(spark, d):
    return curation.statistics(_tagged(spark, d))


@query(f"""with {ISSUES}, e as (select rid, bool_or(not ignored) as o from j group by rid) select count(*) filter (where o) as "open", count(*) filter (where not o) as ignored from e""")
def entry_statistics(spark, d):
    return curation.entry_statistics(_tagged(spark, d))


@query("select rid, lui, random, url from v_job except all select rid, lui, random, url from v_progress")
def resume_jobs(spark, d):
    return jobs.remaining(view(spark, d, "v_job"), view(spark, d, "v_progress"))


@query("""with k as (select distinct regexp_replace(regexp_replace(url, '^https?://', ''), '^[^/]*/', '') as rest from v_log), h as (select case when contains(rest, ':') then regexp_replace(rest, '[?#].*$', '') else rest end as r from k)
 select trim(r, '/') as compact, count(*) as n from h group by 1""")
def log_ids(spark, d):
    rest = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*/", "https://identifiers.org/"), "^", "")
    urls = view(spark, d, "v_log").select(rest.alias("url")).distinct()
    return urls.select(pf.compact_id_of_url("url").alias("compact")).groupBy("compact").agg(F.count("*").alias("n"))


@query("select url, regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') as normalised, regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', '') as bare from v_log")
def url_normalise(spark, d):
    return view(spark, d, "v_log").select("url", pf.normalised_url("url").alias("normalised"), pf.without_scheme(F.col("url")).alias("bare"))


@query("""select k.prefix, k.lui, case when embedded then k.lui else concat(k.prefix, ':', k.lui) end as compact from v_known k join v_namespace n on k.prefix = n.prefix where not deprecated""")
def compact_id(spark, d):
    k = view(spark, d, "v_known").join(view(spark, d, "v_namespace").filter("not deprecated"), "prefix")
    return k.select("prefix", "lui", pf.compact_id("prefix", "lui", "embedded").alias("compact"))


@query("select prefix, count(*) as n from (select prefix, lui from v_known union select prefix, sample_id from v_namespace where not deprecated) group by prefix")
def known_ids(spark, d):
    samples = view(spark, d, "v_namespace").filter("not deprecated").select("prefix", F.col("sample_id").alias("lui"))
    return view(spark, d, "v_known").union(samples).distinct().groupBy("prefix").agg(F.count("*").alias("n"))


@query("select rid, lui, case when n_hops = 0 then null when n_hops = 1 then first_url else second_url end as url, case when n_hops = 0 then null else final_status end as status, count(*) as n from v_ping group by all")
def final_hop(spark, d):
    p = pings(spark, d).withColumn("hop", pf.final_hop())
    return p.groupBy("rid", "lui", F.col("hop.url").alias("url"), F.col("hop.status").alias("status")).agg(F.count("*").alias("n"))


@query("""select rid as id, lui, random, cast(cast(ts as date) as varchar) as day, empty_content, n_hops, count(*) as n from v_ping group by all""")
def datamine_flattened(spark, d):
    """Pings nested in rows of about a thousand for each provider and taken out again."""
    p = pings(spark, d).withColumn("content", F.when(~F.col("empty_content"), "x")).withColumn("date", F.col("ts").cast("date").cast("string"))
    nested = nest_datamine(p.select("rid", "lui", "random", "date", "redirects", "content"), part_size=1000)
    flat = nested.select("id", "part", F.explode("pings").alias("p")).select("id", "part", "p.lui", "p.random", F.col("p.date").alias("day"), "p.empty_content", F.size("p.redirects").alias("n_hops"))
    # Equal pings have one part, so they are counted where they were nested.
    return flat.groupBy(*flat.columns).agg(F.count("*").alias("n")).drop("part")


@query("select rid as id, count(*) as pings, count(*) filter (where not empty_content) as with_content from v_ping group by rid")
def datamine(spark, d):
    p = pings(spark, d).withColumn("content", F.when(~F.col("empty_content"), "x")).withColumn("date", F.col("ts").cast("string"))
    nested = nest_datamine(p.select("rid", "lui", "random", "date", "redirects", "content"))
    return nested.select("id", F.size("pings").cast("long").alias("pings"), F.size(F.filter("pings", lambda x: ~x.empty_content)).cast("long").alias("with_content"))


JOBS = """r as (select v.rid, n.prefix, v.sample_id, n.sample_id as ns_sample from v_resource v join v_namespace n on v.nid = n.nid where not v.deprecated and not n.deprecated),
 s as (select distinct rid, x as lui from (select rid, sample_id as x from r union all select rid, ns_sample from r)),
 a as (select r.rid, count(*) as available from r join v_known k on r.prefix = k.prefix where not exists (select 1 from s where s.rid = r.rid and s.lui = k.lui) group by r.rid),
 q as (select r.rid, greatest(0, 30 - (select count(*) from s where s.rid = r.rid)) as wanted, coalesce(available, 0) as available from r left join a on r.rid = a.rid)"""


def _resources(spark, d) -> DataFrame:
    ns = view(spark, d, "v_namespace").select("nid", "prefix", "pattern", F.col("sample_id").alias("sampleId"), "deprecated", F.col("embedded").alias("namespaceEmbeddedInLui"))
    res = view(spark, d, "v_resource").join(ns.select("nid", "prefix"), "nid").select(F.col("rid").alias("id"), "prefix", F.col("url_pattern").alias("urlPattern"), F.col("sample_id").alias("sampleId"), "deprecated")
    return jobs.live_resources(ns.drop("nid"), res)


@query(f"""with {JOBS}, g as (select *, least(wanted, available) as own, available - least(wanted, available) as spare from q), m as (select sum(wanted - own) as missing, sum(spare) as spare from g)
 select count(*) as resources, cast(sum(own) + min(least(missing, m.spare)) as bigint) as ids, max(available) as most from g, m""")
def quota_totals(spark, d):
    r = _resources(spark, d)
    s = jobs.sample_ids(r, 2)
    known = view(spark, d, "v_known")
    spare = jobs.available(r, known, s)
    have = s.groupBy("rid").agg(F.count("*").alias("have"))
    need = r.select(F.col("id").alias("rid")).join(have, "rid").join(spare, "rid", "left").select("rid", F.greatest(F.lit(0), 30 - F.col("have")).alias("wanted"), F.coalesce("available", F.lit(0)).alias("available"))
    given = jobs.redistribute(need).join(need, "rid")
    return given.agg(F.count("*").alias("resources"), F.sum("n").alias("ids"), F.max("available").alias("most"))


@query()
def job_plan(spark, d):
    r = _resources(spark, d)
    known = view(spark, d, "v_known").withColumnRenamed("prefix", "namespace")
    return jobs.plan(r, jobs.sample_ids(r, 2), known, num_valid=10, pings=2)


@query(f"""with {JOBS}, g as (select q.rid, available, wanted, (select count(*) from s where s.rid = q.rid) as have, (select count(*) from s join r on r.rid = s.rid left join v_known k on k.prefix = r.prefix and k.lui = s.lui where s.rid = q.rid and k.lui is null) as unknown from q)
 select rid, 2 * (have + least(available, greatest(0, 6 - have))) as jobs, 2 * unknown as random, 0 as wrong from g where available >= 6""")
def job_plan_counts(spark, d):
    """Jobs, random ones, and addresses that aren't the filled pattern, for each resource whose namespace knows enough ids."""
    r = _resources(spark, d)
    known = view(spark, d, "v_known").withColumnRenamed("prefix", "namespace")
    s = jobs.sample_ids(r, 2)
    free = jobs.available(r, known.withColumnRenamed("namespace", "prefix"), s).filter("available >= 6").select("rid")
    plan = jobs.plan(r, s, known, num_valid=6, pings=2).join(free, "rid", "left_semi")
    good = F.concat(F.lit("https://p"), F.col("rid").cast("string"), F.lit(".example.org/"), F.col("lui"))
    return plan.groupBy("rid").agg(F.count("*").alias("jobs"), F.count_if("random").alias("random"), F.count_if(F.col("url") != good).alias("wrong"))


def _plain(spark, d, table="v_content") -> DataFrame:
    c = view(spark, d, table)
    return c.select("grp", F.col("lui").alias("doc"), F.filter(F.split(F.regexp_replace(F.lower("content"), "[^a-z]+", " "), " "), lambda t: t != "").alias("tokens"))


@query("""with w as (select grp, lui as doc, list_filter(string_split(regexp_replace(lower(content), '[^a-z]+', ' ', 'g'), ' '), lambda t: t <> '') as tokens from v_content)
 select grp, doc, len(tokens) as n, coalesce(tokens[1], '') as first, coalesce(tokens[len(tokens)], '') as last from w""")
def tokenise_plain(spark, d):
    at = lambda i: F.coalesce(F.try_element_at("tokens", F.lit(i)), F.lit(""))
    return _plain(spark, d).select("grp", "doc", F.size("tokens").cast("long").alias("n"), at(1).alias("first"), at(-1).alias("last"))


@query("""with w as (select grp, lui as doc, list_filter(string_split(regexp_replace(lower(content), '[^a-z]+', ' ', 'g'), ' '), lambda t: t <> '') as tokens from v_content),
 s as (select grp, doc, tokens, unnest(generate_series(1, 5)) as k from w), p as (select grp, doc, k, tokens, unnest(generate_series(1, len(tokens) - k + 1)) as pos from s where len(tokens) >= k),
 h as (select grp, doc, k, pos, array_to_string(tokens[pos:pos + k - 1], ' ') as t from p), c as (select grp, k, t from h group by all having min(doc) <> max(doc)),
 m as (select h.grp, doc, pos, max(h.k) as m from h join c on h.grp = c.grp and h.k = c.k and h.t = c.t group by 1, 2, 3)
 select grp, doc, count(*) as matched, cast(sum(m) as bigint) as total from m group by 1, 2""")
def shingle_match_any(spark, d):
    """Longest matches of up to five tokens with any other document of the source."""
    m = fragments.shingle_matches(_plain(spark, d), 5, "any")
    return m.groupBy("grp", "doc").agg(F.count("*").alias("matched"), F.sum("m").cast("long").alias("total"))


@query("""with w as (select cast(lui as bigint) // 2 as grp, lui as doc, list_filter(string_split(regexp_replace(lower(content), '[^a-z]+', ' ', 'g'), ' '), lambda t: t <> '') as tokens from v_content),
 q as (select grp, count(distinct doc) as need from w group by grp), s as (select grp, doc, tokens, unnest(generate_series(1, 3)) as k from w), p as (select grp, doc, k, tokens, unnest(generate_series(1, len(tokens) - k + 1)) as pos from s where len(tokens) >= k),
 h as (select grp, doc, k, pos, array_to_string(tokens[pos:pos + k - 1], ' ') as t from p), c as (select h.grp, k, t from h join q using (grp) group by h.grp, k, t, need having count(distinct doc) = need),
 m as (select h.grp, doc, pos, max(h.k) as m from h join c on h.grp = c.grp and h.k = c.k and h.t = c.t group by 1, 2, 3)
 select grp, doc, count(*) as matched, cast(sum(m) as bigint) as total from m group by 1, 2""")
def shingle_match_all(spark, d):
    """Longest matches of up to three tokens with all other documents of a pair of neighbouring ids."""
    pairs = _plain(spark, d).withColumn("grp", F.expr("cast(doc as bigint) div 2"))
    m = fragments.shingle_matches(pairs, 3, "all")
    return m.groupBy("grp", "doc").agg(F.count("*").alias("matched"), F.sum("m").cast("long").alias("total"))


@query("""with w as (select grp, lui as doc, list_filter(string_split(regexp_replace(lower(content), '[^a-z]+', ' ', 'g'), ' '), lambda t: t <> '') as tokens from v_content),
 p as (select grp, doc, tokens, unnest(generate_series(1, len(tokens) - 2)) as pos from w where len(tokens) >= 3), h as (select grp, doc, pos, array_to_string(tokens[pos:pos + 2], ' ') as t from p),
 c as (select grp, t from h group by all having min(doc) <> max(doc)), v as (select distinct h.grp, doc, pos + unnest([0, 1, 2]) as at from h join c on h.grp = c.grp and h.t = c.t) select grp, doc, count(*) as covered from v group by 1, 2""")
def shared_coverage(spark, d):
    """How many tokens of each document lie in runs of three or more that another document of its source has too."""
    m = fragments.shingle_matches(_plain(spark, d), 3, "any").filter("m = 3")
    return m.select("grp", "doc", F.explode(F.sequence(F.col("pos"), F.col("pos") + 2)).alias("at")).distinct().groupBy("grp", "doc").agg(F.count("*").alias("covered"))


PLAIN = "list_filter(string_split(regexp_replace(lower(content), '[^a-z]+', ' ', 'g'), ' '), lambda t: t <> '')"


def _match_sql(documents: str, levels: int = 15) -> str:
    """Longest matches without a limit, in SQL: ranks of suffixes by doubling, then the common prefixes of neighbours in the order, down the
    levels. documents: (grp, doc, tokens); gives y (grp, doc, pos, m)."""
    parts = [
        f"w as materialized ({documents})",
        "u as materialized (select grp, tokens, min(doc) as d, count(*) as copies from w where len(tokens) > 0 group by grp, tokens)",
        "p as materialized (select grp, d, len(tokens) as size, unnest(tokens) as t, generate_subscripts(tokens, 1) as pos from u)",
        "r0 as materialized (select d, pos, dense_rank() over (order by grp, t) as r from p)",
    ]
    for k in range(levels):
        parts.append(f"r{k + 1} as materialized (select a.d, a.pos, dense_rank() over (order by a.r, coalesce(b.r, 0)) as r from r{k} a left join r{k} b on b.d = a.d and b.pos = a.pos + {2**k})")
    parts += [
        f"o as (select *, row_number() over (order by r, d, pos) as i from r{levels})",
        "c as (select *, sum(case when d = before then 0 else 1 end) over (order by i rows unbounded preceding) as run from (select *, coalesce(lag(d) over (order by i), '') as before from o))",
        "e as materialized (select run, arg_min(d, i) as d1, arg_min(pos, i) as p1, arg_max(d, i) as d2, arg_max(pos, i) as p2 from c group by run)",
        f"q{levels} as materialized (select c.d, c.pos, e.d2 as od, e.p2 as opos, 0 as n from c join e on e.run = c.run - 1 union all select c.d, c.pos, e.d1, e.p1, 0 from c join e on e.run = c.run + 1)",
    ]
    for k in reversed(range(levels)):
        parts.append(f"q{k} as materialized (select q.d, q.pos, od, opos, case when a.r = b.r then n + {2**k} else n end as n from q{k + 1} q left join r{k} a on a.d = q.d and a.pos = q.pos + q.n left join r{k} b on b.d = q.od and b.pos = q.opos + q.n)")
    parts += [
        "x as (select d, pos, max(n) as n from q0 group by d, pos)",
        "y as (select w.grp, w.doc, p.pos, case when copies > 1 then size - p.pos + 1 else least(coalesce(n, 0), size - p.pos + 1) end as m from w join u on w.grp = u.grp and w.tokens = u.tokens join p on p.d = u.d left join x on x.d = p.d and x.pos = p.pos)",
    ]
    return ", ".join(parts)


@query(f"""with {_match_sql(f"select grp, lui as doc, {PLAIN} as tokens from v_content")}
 select grp, doc, count(*) as size, count(*) filter (where m > 0) as matched, cast(sum(m) as bigint) as total, max(m) as longest, cast(sum(m * (pos % 1009)) as bigint) as mark from y group by grp, doc""")
def match_lengths(spark, d):
    """Longest matches of any length with any other document of the source: counts, sums and a checksum of each document's positions."""
    return _match_marks(suffixes.match_lengths(_plain(spark, d), keep=()))


def _match_marks(found) -> DataFrame:
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    marked = F.transform("m", lambda x, i: x.cast("long") * ((i + 1) % 1009))
    out = found.select("grp", "doc", F.size("m").cast("long").alias("size"), F.size(F.filter("m", lambda x: x > 0)).cast("long").alias("matched"), total("m").alias("total"), F.array_max("m").alias("longest"), total(marked).alias("mark"))
    return out.filter("size > 0")


THREES = f"select cast(lui as bigint) // 3 as g, cast(lui as bigint) % 3 as k, {PLAIN} as tokens from v_content"


@query(f"""with thr as materialized ({THREES}), fst as (select g, k, tokens from thr qualify row_number() over (partition by g order by k) = 1),
 oth as (select thr.g, thr.k, thr.tokens, fst.tokens as head from thr join fst on thr.g = fst.g and thr.k <> fst.k),
 {_match_sql("select concat(g, '-', k) as grp, concat(g, '-', k, 'o') as doc, tokens from oth union all select concat(g, '-', k), concat(g, '-', k, 'h'), head from oth")},
 low as (select string_split(grp, '-')[1] as g, pos, min(m) as m from y where doc like '%h' group by 1, 2),
 lone as (select g from thr group by g having count(*) = 1),
 l as (select cast(fst.g as varchar) as grp, case when fst.g in (select g from lone) then len(tokens) - i + 1 else coalesce(low.m, 0) end as m from (select *, unnest(generate_series(1, len(tokens))) as i from fst where len(tokens) > 0) fst left join low on low.g = cast(fst.g as varchar) and low.pos = fst.i)
 select grp, count(*) as size, count(*) filter (where m > 0) as matched, cast(sum(m) as bigint) as total from l group by grp""")
def common_lengths(spark, d):
    """Longest runs of the first of three neighbouring documents that all of them hold; where it stands alone, all of it."""
    doc = F.col("doc").cast("long")
    t = _plain(spark, d).select(F.floor(doc / 3).cast("string").alias("grp"), (doc % 3).alias("ord"), "tokens")
    total = F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x)
    found = suffixes.first_common(t, "ord")
    return found.filter(F.size("m") > 0).select("grp", F.size("m").cast("long").alias("size"), F.size(F.filter("m", lambda x: x > 0)).cast("long").alias("matched"), total.alias("total"))


@query("""with p as (select qid % 50 as rid, qid, string_split(label, ' ') as w from v_kb_label), ids as (select distinct rid, unnest(w) as word from p where qid % 7 = 0)
 select p.qid, coalesce(array_to_string(list_filter(w, lambda t: not list_contains(coalesce(x.words, []), t)), ' '), '') as tokens from p left join (select rid, list(word) as words from ids group by rid) x on p.rid = x.rid""")
def tokens_without_ids(spark, d):
    """Texts less the ids of their provider: labels less the words of every seventh label of the provider."""
    l_ = view(spark, d, "v_kb_label").select((F.col("qid") % 50).alias("rid"), F.col("qid").cast("string").alias("lui"), F.col("qid").alias("ord"), F.col("label").alias("content"))
    ids = l_.filter("ord % 7 = 0").select("rid", F.explode(F.split("content", " ")).alias("lui"))
    good = F.array(F.struct(F.lit("http://a").alias("url"), F.lit(200).alias("status")))
    found = content.analysed_tokens(l_.withColumn("redirects", good), ids)
    return found.select(F.col("ord").alias("qid"), F.array_join("tokens", " ").alias("tokens"))


@query("""with l as (select cast(l_orderkey % 97 as varchar) as grp, l_partkey as p, l_linenumber % 2 as hop from lineitem), json as (select * from l where p % 11 <> 0),
 e as (select grp, null as path, 'not JSON' as rule from l where p % 11 = 0 union all select grp, 'lui', 'not string' from json where p % 3 = 0 union all select grp, 'redirects[0].status', 'not integer' from json where p % 4 = 0
  union all select grp, concat('redirects[', hop, '].host'), 'unknown' from json where p % 5 = 0 union all select grp, 'extra', 'unknown' from json where p % 6 = 0)
 select grp, path, rule, count(*) as n from e group by all""")
def schema_paths(spark, d):
    """The places at which records of pings break their schema."""
    l_ = spark.read.parquet(f"{d}/lineitem.parquet")
    p = F.col("l_partkey")
    lui = F.when(p % 3 == 0, p.cast("string")).otherwise(F.concat(F.lit('"'), p.cast("string"), F.lit('"')))
    status = F.when(p % 4 == 0, F.lit('"ok"')).otherwise(F.lit("200"))
    host = F.when(p % 5 == 0, F.lit(', "host": {"a": [1]}')).otherwise(F.lit(""))
    hop = lambda i: F.concat(F.lit('{"url": null, "status": '), status if i == 0 else F.lit("1"), F.when(F.col("l_linenumber") % 2 == i, host).otherwise(F.lit("")), F.lit("}"))
    text = F.concat(F.lit('{"rid": 1, "lui": '), lui, F.lit(', "redirects": ['), hop(0), F.lit(", "), hop(1), F.lit("]"), F.when(p % 6 == 0, F.lit(', "extra": 1')).otherwise(F.lit("")), F.lit("}"))
    text = F.when(p % 11 == 0, F.lit('{"rid": ')).otherwise(text)
    records = l_.select((F.col("l_orderkey") % 97).cast("string").alias("file"), F.col("l_linenumber").alias("record"), text.alias("text"))
    closed = spark.createDataFrame([], "rid bigint, lui string, redirects array<struct<url string, status int>>").schema
    return checks.schema_errors(records, closed).groupBy(F.col("file").alias("grp"), "path", "rule").agg(F.count("*").alias("n"))


@query()
def tokens_of_pages(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html")
    return p.select("page_id", F.size(t := pf.tokens("html")).alias("n"), F.array_join(F.slice(t, 1, 5), " ").alias("first"))


@query()
def information_content(spark, d):
    """What two pings of an id have in common and their source's other ids don't hold; two neighbouring documents are an id's pings."""
    doc = F.col("lui").cast("long")
    t = view(spark, d, "v_content").select("grp", F.floor(doc / 2).cast("string").alias("lui"), (doc % 2).alias("ord"), pf.plain_tokens(F.col("content")).alias("tokens"))
    return fragments.content_scores(fragments.shared_by_group(fragments.common_by_id(t)))


@query("""with recursive c(class_id, ancestor) as (select class_id, class_id from v_kb_class union select super_id, super_id from v_kb_class union select c.class_id, k.super_id from c join v_kb_class k on c.ancestor = k.class_id)
 select class_id, ancestor from c""".replace("with recursive c(", "with c("))
def class_closure(spark, d):
    return linking.class_closure(view(spark, d, "v_kb_class"))


ORACLES["class_closure"] = ORACLES["class_closure"].replace("with v_kb_class", "with recursive v_kb_class", 1)


WORDS = "list_sort(list_distinct(list_filter(string_split(lower(replace({0}, ' / ', ' ')), ' '), lambda t: t <> '')))"
PAIRS = f"""n as (select distinct string, {WORDS.format("string")} as x from v_name), l as (select qid, label, {WORDS.format("label")} as y from v_kb_label),
 nw as (select distinct x, unnest(x) as word from n), ly as (select distinct y from l), lw as (select y, unnest(y) as word from ly), xy as (select x, y, count(*)::double / (len(x) + len(y) - count(*)) as iou from nw join lw using (word) group by x, y)"""


@query(f"""with {PAIRS}, b as (select x, max(iou) as iou from xy group by x), r as (select xy.x, l.qid, l.label, xy.iou, row_number() over (partition by xy.x order by l.qid, l.label) as k from xy join b on xy.x = b.x and xy.iou = b.iou join l on l.y = xy.y)
 select string, qid, label, iou from n join r using (x) where k = 1""")
def name_iou_top1(spark, d):
    """The label with the largest word overlap for each name, among all labels that share a word with it."""
    n = view(spark, d, "v_name").select(F.col("string").alias("candidate")).distinct()
    best = linking.top_by_overlap(n, view(spark, d, "v_kb_label"), k=1)
    return best.select(F.col("candidate").alias("string"), "qid", "label", "iou")


@query(f"""with {PAIRS.replace("from v_name", "from (select label as string from v_kb_label where qid % 3 = 0)")}, f as (select n.string as candidate, l.qid, l.label, len(n.x)::double / len(l.y) as score from n join lw on lw.word = n.x[1] join l on l.y = lw.y where len(list_intersect(n.x, l.y)) = len(n.x)),
 r as (select candidate, qid, label, count(*) over (partition by candidate) as hits, row_number() over (partition by candidate order by score desc, qid, label) as rank from f) select candidate, qid, label, hits, rank from r where rank <= 10""")
def strict_search(spark, d):
    """Labels that hold all words of a candidate, the best ten."""
    l_ = view(spark, d, "v_kb_label")
    return linking.search(l_.filter("qid % 3 = 0").select(F.col("label").alias("candidate")), l_)


@query("""with recursive_c as (select class_id, class_id as a from v_kb_class), i as (select qid, qid % 40 + 2 as class_id from v_kb_label), p as (select qid, class_id, floor(class_id / 2)::bigint as s1, floor(class_id / 4)::bigint as s2, floor(class_id / 8)::bigint as s3, floor(class_id / 16)::bigint as s4, floor(class_id / 32)::bigint as s5 from i),
 f as (select qid, 4 in (class_id, s1, s2, s3, s4, s5) as o, 9 in (class_id, s1, s2, s3, s4, s5) as t, 17 in (class_id, s1, s2, s3, s4, s5) as p, 5 in (class_id, s1, s2, s3, s4, s5) as l from p)
 select qid, case when o and not t and not p then 'ORGANISATION' else 'LOCATION' end as type from f where (o and not t and not p) or l""")
def entity_types(spark, d):
    """Organisations and places among the labels, by the closure of their classes."""
    i = view(spark, d, "v_kb_label").select("qid", (F.col("qid") % 40 + 2).alias("class_id"))
    return linking.entity_types(i, linking.class_closure(view(spark, d, "v_kb_class").filter("class_id <= 64")), 4, 9, 17, 5)


@query("""with e as (select p_partkey as uuid, p_partkey % 5 as iid from part), x as (select e.uuid, r.rid from e join v_resource r on e.iid = r.iid)
 select uuid, count(distinct rid) as n, min(rid) as first, max(rid) as last from x group by uuid""".replace("from part", "from (select qid as p_partkey from v_kb_label)"))
def entity_occurrences(spark, d):
    e = view(spark, d, "v_kb_label").select(F.col("qid").alias("uuid"), (F.col("qid") % 5).alias("iid"))
    members, classes = linking.occurrence_classes(e, view(spark, d, "v_resource").select("rid", "iid"))
    of = stored(classes.select("iids", F.size("resources").cast("long").alias("n"), F.array_min("resources").alias("first"), F.array_max("resources").alias("last")))
    return members.join(of, "iids").select("uuid", "n", "first", "last")


DIFF = """r as (select s_suppkey as iid, s_name as name, concat('http://', lower(s_name), '.org') as homeUrl, case when s_suppkey % 3 = 0 then 'CURATOR_REVIEW' else s_name end as description, case when s_suppkey % 4 = 0 then null else cast(s_suppkey as varchar) end as rorId,
  case when s_suppkey % 5 <> 0 then concat('c', s_nationkey) end as code, case when s_suppkey % 5 <> 0 then concat('Land ', s_nationkey) end as land from supplier),
 l as (select s_suppkey as iid, s_name as string, s_suppkey * 10 + k as uuid, s_name as name, concat('https://', lower(s_name), '.org', case k when 0 then case when s_suppkey % 7 = 0 then '//' else '/' end else '/x' end) as homeUrl, concat(s_name, '!') as description, case when s_suppkey % 2 = 0 then cast(s_suppkey as varchar) end as rorId,
  case when s_suppkey % 7 <> 1 then concat('c', case when s_suppkey % 8 = 0 then s_nationkey + 1 else s_nationkey end) end as code, case when s_suppkey % 7 <> 1 then concat('Land ', s_nationkey) end as land from supplier, (select 0 as k union all select 1) t where s_suppkey % 6 <> 5 and (k = 0 or s_suppkey % 5 = 0))"""
VERDICT = """case when o is null and n is null then 'MISSING' when o is null then 'ADD' when n is null then 'KEEP' when o = n then 'SAME'
  when property = 'homeUrl' and regexp_replace(regexp_replace(o, '^[A-Za-z]+://', ''), '/+$', '') = regexp_replace(regexp_replace(n, '^[A-Za-z]+://', ''), '/+$', '') then 'KEEP' when property = 'description' and single then 'KEEP' else 'REPLACE' end"""
DIFF_ROWS = f"""{DIFF}, c as (select iid, count(*) = 1 as single from l group by iid), b as (
 select l.iid, uuid, single, 'name' as property, r.name as o, l.name as n from l join r using (iid) join c using (iid) union all select l.iid, uuid, single, 'homeUrl', r.homeUrl, l.homeUrl from l join r using (iid) join c using (iid) union all
 select l.iid, uuid, single, 'description', nullif(r.description, 'CURATOR_REVIEW'), l.description from l join r using (iid) join c using (iid) union all select l.iid, uuid, single, 'rorId', r.rorId, l.rorId from l join r using (iid) join c using (iid) union all
 select l.iid, uuid, single, 'location', case when r.code is not null then concat('{{"countryCode":"', r.code, '","countryName":"', r.land, '"}}') end, case when l.code is not null then concat('{{"countryCode":"', l.code, '","countryName":"', l.land, '"}}') end from l join r using (iid) join c using (iid)),
 v as (select iid, uuid, property, o as old, n as "new", {VERDICT} as verdict from b)"""


def _diff(spark, d):
    spark.read.parquet(f"{d}/supplier.parquet").createOrReplaceTempView("supplier")
    place = F.when(F.col("code").isNotNull(), F.struct(F.col("code").alias("countryCode"), F.col("land").alias("countryName")))
    rows = [spark.sql(f"with {DIFF} select * from {t}".replace("varchar)", "string)")) for t in "rl"]
    return tuple(t.withColumn("location", place).drop("code", "land") for t in rows)


@query()
def institution_diff(spark, d):
    return linking.property_differences(*_diff(spark, d))


@query()
def diff_verdict(spark, d):
    registry, linked = _diff(spark, d)
    return linking.verdicts(registry, linking.property_differences(registry, linked))


ORACLES["institution_diff"] = f"with {DIFF_ROWS} select * from v"
ORACLES["diff_verdict"] = f"with {DIFF_ROWS} select r.iid, coalesce(bool_and(verdict in ('KEEP', 'SAME')), true) as ok from r left join v on r.iid = v.iid group by 1"


@query()
def candidate_order(spark, d):
    """Candidates of each institution by the number of equal, then of filled properties."""
    return linking.candidate_order(linking.property_differences(*_diff(spark, d)))


@query()
def institution_issues(spark, d):
    """One issue for each candidate of an institution that is to change."""
    registry, linked = _diff(spark, d)
    entities = linked.select("iid", "uuid", F.array("string").alias("matches"))
    s = spark.read.parquet(f"{d}/supplier.parquet")
    code = F.when(F.col("s_suppkey") % 2 == 0, "CURATOR_REVIEW").otherwise(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")))
    resources = s.select(F.col("s_suppkey").alias("rid"), (F.col("s_suppkey") - F.col("s_suppkey") % 2).alias("iid"), code.alias("providerCode"), F.lit("MIR").alias("mirId"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("prefix"))
    found = linking.institution_issues(registry, linking.property_differences(registry, linked), entities, resources)
    of = lambda path: F.get_json_object("detail", path)
    return found.select("iid", "uuid", "name", "level", "identity", of("$.location.type").alias("place"), of("$.location.new.countryCode").alias("new_code"), of("$.matches[0]").alias("match"), F.coalesce(of("$.occurrences[0]"), F.lit("")).alias("first"), F.coalesce(of("$.occurrences[1]"), F.lit("")).alias("second"))


ORACLES["candidate_order"] = f"""with {DIFF_ROWS}, g as (select iid, uuid, count(*) filter (where verdict = 'SAME') as same, count(*) filter (where "new" is not null) as filled from v group by 1, 2)
 select *, row_number() over (partition by iid order by same desc, filled desc, uuid) as rank from g"""
ORACLES["institution_issues"] = f"""with {DIFF_ROWS}, x as (select iid from v group by iid having not bool_and(verdict in ('KEEP', 'SAME'))),
 y as (select iid, uuid, max(case when property = 'name' then case when verdict = 'SAME' then old else coalesce("new", old) end end) as name,
  max(case when property = 'rorId' then concat(case when verdict <> 'SAME' and "new" is not null then concat('"new":"<', "new", '>",') else '' end, case when verdict <> 'SAME' and old is not null then concat('"old":"<', old, '>",') else '' end, case when verdict = 'SAME' then concat('"same":"<', old, '>",') else '' end, '"type":"', verdict, '"') end) as ror,
  max(case when property = 'location' then verdict end) as place, max(case when property = 'location' and verdict <> 'SAME' then "new" end) as "new" from v where iid in (select iid from x) group by 1, 2),
 k as (select s_suppkey - s_suppkey % 2 as iid, string_agg(concat('[', case when s_suppkey % 2 = 0 then 'MIR' else concat('p', s_suppkey) end, '/n', s_nationkey, '](https://registry.identifiers.org/registry/n', s_nationkey, ')'), ' ' order by s_suppkey) as links from supplier group by 1)
 select y.iid, uuid, name, 3 as level, place, json_extract_string("new", '$.countryCode') as new_code, name as match, coalesce(nullif(split_part(links, ' ', 1), ''), '') as "first", coalesce(split_part(links, ' ', 2), '') as "second", concat('{{"iid":', y.iid, ',"name":"', name, '","rorId":{{', ror, '}},"type":"InstitutionValidator"}}') as identity from y left join k on y.iid = k.iid"""


@query("""with c as (select 'c0' as code, 'Country 0' as name union all select 'c1', 'Country 1'), d as (select qid // 2 as uuid, qid as ord, label as name, case when qid % 5 = 0 then null else concat('http://', qid) end as homeUrl, cast(qid as varchar) as r, concat('c', qid % 3) as country from v_kb_label),
 l as (select *, row_number() over (partition by uuid order by ord desc) as k from d) select uuid, l.name, homeUrl, concat('https://ror.org/', r) as rorId, c.name as country from l left join c on country = code where k = 1 and uuid % 2 = 0""")
def entity_details(spark, d):
    """Details of entities, the last row of each, with addresses of their ROR ids and names of their countries."""
    l_ = view(spark, d, "v_kb_label")
    details = l_.select(F.expr("qid div 2").alias("uuid"), F.col("qid").alias("ord"), F.col("label").alias("name"), F.when(F.col("qid") % 5 != 0, F.concat(F.lit("http://"), F.col("qid").cast("string"))).alias("homeUrl"), F.lit(None).cast("string").alias("description"), F.col("qid").cast("string").alias("rorId"), F.concat(F.lit("c"), (F.col("qid") % 3).cast("string")).alias("country"))
    countries = spark.createDataFrame([("c0", "Country 0"), ("c1", "Country 1")], "code string, name string")
    found = linking.entity_details(details.filter("uuid % 2 = 0").select("uuid"), details, countries)
    return found.select("uuid", "name", "homeUrl", "rorId", F.col("location.countryName").alias("country"))


@query("""with m as (select l_orderkey as id, l_linenumber * 2 as s, l_linenumber * 2 + 1 + l_partkey % 3 as e, concat('m', l_partkey % 20) as text from lineitem), x as (select distinct * from m),
 n as (select a.*, (select min(b.s) from x b where b.id = a.id and b.s >= a.e) as t from x a) select n.id, n.s as start, n.e as "end", n.text, n.t as next_start, y.e as next_end, y.text as next_text from n left join x y on y.id = n.id and y.s = n.t""")
def next_mentions(spark, d):
    """Each mention in a text with those that start first after its end."""
    l_ = spark.read.parquet(f"{d}/lineitem.parquet")
    m = l_.select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") * 2).alias("start"), (F.col("l_linenumber") * 2 + 1 + F.col("l_partkey") % 3).alias("end"), F.concat(F.lit("m"), (F.col("l_partkey") % 20).cast("string")).alias("text"))
    return linking.next_mentions(m.repartition(parts_of(l_, 250_000), *m.columns).distinct())


MENTIONS = "select distinct o_custkey as id, (o_orderkey % 400) * 3 as s, (o_orderkey % 400) * 3 + 1 + o_orderkey % 3 as e, concat('m', o_orderkey % 11) as text from orders"


@query(f"""with recursive x as materialized ({MENTIONS}), k as (select distinct text from x where text not in ('m3', 'm7')), n as (select a.*, (select min(b.s) from x b where b.id = a.id and b.s >= a.e) as t from x a),
 f as materialized (select n.id, n.s, n.e, y.s as ns, y.e as ne, y.text as nt from n join x y on y.id = n.id and y.s = n.t where y.text in (select text from k)),
 c as (select id, s, e, text as candidate from x where text in (select text from k) union select c.id, f.ns, f.ne, concat(c.candidate, ' ', f.nt) from c join f on c.id = f.id and c.s = f.s and c.e = f.e)
 select distinct id, candidate, true as strict from c union select distinct id, text, false from x where text not in (select text from k)""")
def chained_candidates(spark, d):
    """Mentions and the chains that following mentions make with them, without a limit to their number."""
    spark.read.parquet(f"{d}/orders.parquet").createOrReplaceTempView("orders")
    m = spark.sql(MENTIONS).select("id", F.col("s").alias("start"), F.col("e").alias("end"), "text")
    return linking.chained_candidates(m, m.filter("text not in ('m3', 'm7')").select("text"))


@query(f"""with {PAIRS}, r as (select xy.x, l.qid, l.label, xy.iou, row_number() over (partition by xy.x order by iou desc, l.qid, l.label) as rank from xy join l on l.y = xy.y)
 select string as candidate, qid, label, iou, rank from n join r using (x) where rank <= 10""")
def loose_search(spark, d):
    """The ten labels of largest word overlap for each name, among all that share a word with it."""
    n = view(spark, d, "v_name").select(F.col("string").alias("candidate")).distinct()
    return linking.top_by_overlap(n, view(spark, d, "v_kb_label"), k=10)


@query("""select event_id, case when event_type = 'error' then case when user_id % 3 = 0 then 408 else 434 end else coalesce(case when user_id % 4 = 0 then 226 end, 200) end as ftp_status, event_type = 'error' and user_id % 3 <> 0 as ftp_dns,
  case when user_id % 5 in (0, 4) then case when event_type = 'error' then 408 end else 200 + user_id % 5 end as http_status, concat('10.0.0.', user_id % 250, ':', 80 + event_id % 2) as ip_port, case user_id % 3 when 0 then 'http' when 1 then 'ftp' else 'unsupported' end as client from events""")
def hop_outcomes(spark, d):
    """Outcomes of HTTP and FTP probes, addresses as text, and the client that a URL needs."""
    e = spark.read.parquet(f"{d}/events.parquet")
    failed, u = F.col("event_type") == "error", F.col("user_id")
    e = e.withColumn("code", F.when(u % 4 == 0, 226)).withColumn("message", F.when(failed, F.when(u % 3 == 0, "reply 115 timed out").otherwise("error 434: no host")))
    e = e.withColumn("status", F.when(u % 5 == 0, 204).otherwise(200 + u % 5)).withColumn("url", F.concat(F.element_at(F.array(F.lit("https"), F.lit("ftp"), F.lit("gopher")), (u % 3 + 1).cast("int")), F.lit("://a/b")))
    e = e.withColumn("late", failed).withColumn("ip", F.concat(F.lit("10.0.0."), (u % 250).cast("string"))).withColumn("port", 80 + F.col("event_id") % 2)
    ftp = pf.ftp_outcome("code", "message")
    return e.select("event_id", ftp["status"].alias("ftp_status"), ftp["dns_error"].alias("ftp_dns"), pf.http_status("status", "late").alias("http_status"), pf.ip_port("ip", "port").alias("ip_port"), pf.scheme_class("url").alias("client"))


@query("""with u as (select distinct lower(n_name) as prefix, l_partkey from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey), i as (select prefix, case l_partkey % 3 when 0 then concat('x', l_partkey) else cast(l_partkey as varchar) end as lui from u)
 select distinct i.prefix as namespace, i.lui from i join v_namespace n on n.prefix = i.prefix where not deprecated and regexp_matches(lui, '^[0-9]+$')""")
def mined_ids(spark, d):
    """Ids known from requests: those that live namespaces accept."""
    t = {n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("lineitem", "supplier", "nation")}
    u = t["lineitem"].join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey")).join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
    lui = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("x"), F.col("l_partkey").cast("string"))).otherwise(F.col("l_partkey").cast("string"))
    log = u.select(F.concat(F.lit("https://identifiers.org/"), F.lower("n_name"), F.lit(":"), lui, F.lit("?via=log")).alias("url"))
    ns = view(spark, d, "v_namespace").select("prefix", "pattern", "deprecated", F.lit(False).alias("namespaceEmbeddedInLui"))
    return jobs.mined_ids(log, ns)


@query("select rid, lui, random, url from v_job where rid % 5 = 0")
def jobs_round_trip(spark, d):
    """Jobs written as JSON lines to the shared folder and read again by their schema."""
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    write_json(view(spark, d, "v_job").filter("rid % 5 = 0"), path, gzip=True)
    return read_jobs(spark, path).select("rid", "lui", "random", "url")


@query("select distinct prefix as namespace, lui from v_known")
def known_id_maps(spark, d):
    """Known ids written as a map for each namespace and read again."""
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    write_known_ids(view(spark, d, "v_known").withColumnRenamed("prefix", "namespace"), path)
    maps = spark.read.schema("namespace string, luis array<string>").json(path)
    return known_id_rows(maps.select(F.create_map("namespace", "luis").alias("known")))


@query("""with j as (select s_suppkey, s_suppkey % 4 as r from supplier) select s_suppkey as iid, case when r = 0 then null else concat('e', s_suppkey % 7) end as uuid, case when r = 1 or r = 0 then null else concat('Name ', s_suppkey % 7) end as name from j where r <> 1 or true""".replace(" where r <> 1 or true", ""))
def entities_with_details(spark, d):
    """Entities with details, those without any field left empty."""
    s = spark.read.parquet(f"{d}/supplier.parquet").withColumn("r", F.col("s_suppkey") % 4)
    e = s.select(F.col("s_suppkey").alias("iid"), "r", F.when(F.col("r") != 0, F.concat(F.lit("e"), (F.col("s_suppkey") % 7).cast("string"))).alias("uuid"))
    e = e.withColumn("key", F.when(F.col("r") > 1, F.col("uuid")).otherwise(F.concat(F.lit("no"), F.col("iid").cast("string"))))
    details = e.filter("r > 1").select(F.col("key").alias("uuid"), F.concat(F.lit("Name "), (F.substring("uuid", 2, 9))).alias("name")).distinct().unionByName(e.filter("r <= 1").select(F.col("key").alias("uuid"), F.lit(None).cast("string").alias("name")))
    return linking.with_details(e.select("iid", F.col("uuid").alias("own"), F.col("key").alias("uuid")), details).select("iid", F.col("own").alias("uuid"), "name")


@query()
def greedy_linking(spark, d):
    """Names linked by their runs of words that are labels as a whole, few hits first."""
    names = view(spark, d, "v_name").select(F.col("iid").alias("id"), F.col("string").alias("name"))
    grams = linking.ngrams(names, 3, ("name",))
    labels = view(spark, d, "v_kb_label").groupBy(F.array_join(pf.words("label"), " ").alias("candidate")).agg(F.count("*").alias("hits"))
    # Stored, so that Spark knows how few they are and doesn't bring all names of a label to one task.
    m = stored(grams.join(stored(labels), "candidate").select("id", "name", "candidate", "hits"))
    return linking.extract_greedy(m).select("id", F.array_join("chosen", " | ").alias("chosen"))


@query("""with e as (select nid as entry, nid % 3 = 1 as valid from v_namespace), s as (select entry from e where not valid)
 select entry, row_number() over (order by entry) as position, count(*) over () as total, coalesce(lead(entry) over (order by entry), min(entry) over ()) as next, coalesce(lag(entry) over (order by entry), max(entry) over ()) as previous from s""")
def curation_cursor(spark, d):
    e = view(spark, d, "v_namespace").select(F.col("nid").alias("entry"), (F.col("nid") % 3 == 1).alias("valid"))
    return curation.cursor(e, "entry", "valid")


@query("""with o as (select nid, concat('old', cast(nid % 4 as varchar)) as t from v_namespace where nid % 2 = 0), n as (select nid, concat('new', cast(nid % 3 as varchar)) as t from v_namespace where nid % 3 = 0)
 select cast(coalesce(n.nid, o.nid) as varchar) as identity, coalesce(n.t, o.t) as tags from o full outer join n on o.nid = n.nid""")
def tag_upsert(spark, d):
    v = view(spark, d, "v_namespace").withColumn("identity", F.col("nid").cast("string"))
    old = v.filter("nid % 2 = 0").select("identity", F.array(F.concat(F.lit("old"), (F.col("nid") % 4).cast("string"))).alias("tags"))
    new = v.filter("nid % 3 = 0").select("identity", F.array(t := F.concat(F.lit("new"), (F.col("nid") % 3).cast("string")), t).alias("tags"))
    return upsert_tags(old, new).select("identity", F.array_join("tags", ",").alias("tags"))


@query("select rid, date_trunc('day', ts) as start, count(*) as n, count(*) filter (where failed) as failed from v_event_ping group by all")
def failure_rate_windows(spark, d):
    return failure_rates(view(spark, d, "v_event_ping"))
