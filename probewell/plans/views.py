"""Views that give the shapes of registry, pings, jobs and names on the benchmark tables. One SQL text for Spark and the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "v_namespace": "select n_nationkey as nid, lower(n_name) as prefix, '^[0-9]+$' as pattern, '1' as sample_id, (n_nationkey % 10 = 9) as deprecated, (n_nationkey % 4 = 0) as embedded from nation",
    "v_institution": "select r_regionkey as iid, r_name as name from region",
    "v_resource": "select s.s_suppkey as rid, s.s_nationkey as nid, n.n_regionkey as iid, s.s_name as name, concat('https://p', cast(s.s_suppkey as varchar(20)), '.example.org/{$id}') as url_pattern, cast(1 + s.s_suppkey % 50 as varchar(20)) as sample_id, (s.s_suppkey % 9 = 8) as deprecated from supplier s join nation n on s.s_nationkey = n.n_nationkey",
    "v_ping": """select l_suppkey as rid, cast(l_partkey as varchar(20)) as lui, concat('ns', cast(l_suppkey % 25 as varchar(20)), ':', cast(l_partkey as varchar(20))) as compact_id, (l_linestatus = 'O') as random, l_shipdate as ts, (l_returnflag = 'R') as empty_content,
        case when l_quantity = 3 then 0 when l_linenumber % 2 = 0 then 2 else 1 end as n_hops,
        case when l_quantity = 3 then null else concat('http://p', cast(l_suppkey as varchar(20)), '.example.org/', case when l_partkey % 10 = 0 then 'home' else cast(l_partkey as varchar(20)) end) end as first_url,
        case when l_quantity = 3 or l_linenumber % 2 = 1 then null else concat('https://p', cast(l_suppkey as varchar(20)), '.example.org/', cast(l_partkey as varchar(20))) end as second_url,
        case when l_quantity = 3 or l_quantity = 13 then null when l_returnflag = 'R' then 500 when l_returnflag = 'N' and l_quantity > 25 then 404 else 200 end as final_status,
        (l_quantity = 7 and l_linenumber % 2 = 1) as dns_error, (l_quantity = 8) as ssl_error, (l_quantity = 9) as invalid_response from lineitem""",
    "v_job": "select l_suppkey as rid, cast(l_partkey as varchar(20)) as lui, (l_linestatus = 'O') as random, concat('https://p', cast(l_suppkey as varchar(20)), '.example.org/', cast(l_partkey as varchar(20))) as url from lineitem",
    "v_progress": "select l_suppkey as rid, cast(l_partkey as varchar(20)) as lui, (l_linestatus = 'O') as random, concat('https://p', cast(l_suppkey as varchar(20)), '.example.org/', cast(l_partkey as varchar(20))) as url from lineitem where l_orderkey % 3 = 0",
    "v_known": "select distinct lower(n_name) as prefix, cast(l_partkey as varchar(20)) as lui from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey where l_linestatus = 'F'",
    "v_log": "select url from pages",
    "v_content": "select source as grp, cast(doc_id as varchar(20)) as lui, text as content from documents",
    "v_kb_class": "select p_partkey as class_id, cast(floor(p_partkey / 2) as bigint) as super_id from part where p_partkey > 1",
    "v_kb_label": "select p_partkey as qid, p_name as label from part",
    "v_name": "select a.p_partkey as iid, concat(a.p_name, ' / ', b.p_name) as string from part a join part b on b.p_partkey = a.p_partkey + 7",
    "v_event_ping": "select event_id as ping_id, user_id as rid, ts, (event_type = 'error') as failed from events",
}
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of VIEWS over the tables in a folder."""
    for t in TABLES:
        if f" {t}" in VIEWS[name]:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(VIEWS[name])


def with_views(sql: str) -> str:
    """sql with the views it names as common table expressions."""
    used = [v for v in VIEWS if v in sql]
    if not used:
        return sql
    ctes = ", ".join(f"{v} as ({VIEWS[v]})" for v in used)
    return f"with {ctes}, {sql[5:]}" if sql.lower().startswith("with ") else f"with {ctes} {sql}"


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_ping with its hops nested: of two hops the first is a redirect; all flags sit on the first."""
    p = view(spark, sf_dir, "v_ping")
    no = F.lit(False)
    first = F.struct(F.col("first_url").alias("url"), F.when(F.col("n_hops") == 2, 301).otherwise(F.col("final_status")).alias("status"), "dns_error", "ssl_error", "invalid_response")
    second = F.struct(F.col("second_url").alias("url"), F.col("final_status").alias("status"), no.alias("dns_error"), no.alias("ssl_error"), no.alias("invalid_response"))
    hops = F.slice(F.array(first, second), F.lit(1), F.col("n_hops"))
    return p.select("rid", "lui", "random", "ts", "empty_content", hops.alias("redirects"), "compact_id")
