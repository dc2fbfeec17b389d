import gzip
import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from probewell import functions as pf
from probewell import sources
from probewell.operators import curation, issues, jobs, linking
from probewell.plans.queries import ORACLES, QUERIES
from probewell.plans.views import TABLES
from probewell.streaming import failure_rates, write_rates

SF = "/root/testdata/sf0.001"


def value(x):
    return None if x is None or x != x else round(x, 9) if isinstance(x, float) else x if isinstance(x, (int, str)) else str(x).replace("+00:00", "")


def rows(columns, found):
    return sorted((tuple(value(r[i]) for i in columns) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in ORACLES:
        assert got
        return
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    assert rows(cols, got) == rows([want.columns.index(x) for x in cols], want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def ping(spark, data):
    hop = "struct<url string, status int, dns_error boolean, ssl_error boolean, invalid_response boolean>"
    return spark.createDataFrame(data, f"rid bigint, lui string, random boolean, redirects array<{hop}>, empty_content boolean, compact_id string")


def hop(url, status, dns=False):
    return (url, status, dns, False, False)


def test_status_errors_at_the_threshold(spark):
    data = [(1, "a", False, [hop("u", s)], False, "a") for s in (500, 200)] + [(1, "b", False, [], False, "b"), (2, "c", False, [hop("u", None)], False, "c"), (2, "c", False, [hop("u", 404)], False, "c")]
    p = ping(spark, data)
    assert {(r["rid"], r["status"], r["valid_total"]) for r in issues.status_errors(p, 0.0, 1.0).collect()} == {(1, 500, 2), (2, 404, 2)}
    assert issues.status_errors(p, 0.5, 1.0).count() == 0


def test_scheme_only_redirects(spark):
    data = [
        (1, "7", False, [hop("http://a/7", 301), hop("https://a/7", 200)], False, "7"),
        (1, "8", False, [hop("http://a/8", 301), hop("https://a/8/x", 200)], False, "8"),
        (1, "9", False, [hop("http://a/9", 301), hop("http://a/9", 200, True)], False, "9"),
    ]
    assert [(r["compact_id"], r["signature"]) for r in issues.scheme_only_redirects(ping(spark, data)).collect()] == [("7", "http://a/{$id} => https://a/{$id}")]
    assert [(r["compact_id"], r["type"]) for r in issues.flag_errors(ping(spark, data), {"dns_error": "D", "ssl_error": "S"}).collect()] == [("9", "D")]


def test_links_hold_the_id_not_the_compact_id(spark):
    p = ping(spark, [(1, "7", False, [hop("http://a/7", 301, True), hop("http://b/home", None)], False, "go:7")])
    assert [r["signature"] for r in issues.flag_errors(p, {"dns_error": "DNSError"}).collect()] == ["http://a/{$id}"]
    chain = json.loads(issues.redirect_chains(p).first()["signature"])
    assert chain == [{"URL": "http://a/{$id}", "HTTP Status": "301 (moved permanently, moved)"}, {"URL": "<http://b/home>", "HTTP Status": "None (unknown)"}]


def test_identities_and_texts(spark):
    p = ping(spark, [(1, "7", False, [hop("http://a/7", s)], False, "go:7") for s in (500, 404, 500)] + [(1, "8", True, [hop("http://a/8", 301), hop("https://a/8", 404)], False, "go:8")])
    a = spark.createDataFrame([(1, "7", 0.05, 9, 0)], "rid bigint, lui string, information_content double, length bigint, noise bigint")
    registry = spark.createDataFrame([(1,)], "rid bigint")
    found = issues.find_issues(p, registry, ["http-status-error", "scheme-only-redirect", "redirection-chain"])
    assert {r["identity"] for r in issues.identities(found).collect()} == {'{"rid":1,"status_code":[404,500],"type":"HTTPStatusError"}', '{"redirects":["http://a/{$id} => https://a/{$id}"],"rid":1,"type":"SchemaRedirectError"}', '{"rid":1,"type":"RedirectChain"}'}
    texts = {r["signature"]: list(r["examples"]) for r in issues.example_text(found).filter("type = 'HTTPStatusError'").collect()}
    assert texts["500 (internal server error, server error, \u2717) http://a/{$id}"] == ["2/3 x [go:7](https://identifiers.org/resolve?query=go:7) (non-random)"]
    ok = ping(spark, [(1, "7", False, [hop("u", 200)], False, "go:7"), (1, "9", False, [hop("u", 200)], False, "go:9")])
    low = issues.find_issues(ok, registry, ["information-content"], analysis=a)
    assert [r["identity"] for r in issues.identities(low).collect()] == ['{"rid":1,"total_information_content":0.1,"type":"InformationContent"}']
    report = issues.content_report(ok, a).first()
    assert report["content"] == "5.0%" and [tuple(e) for e in report["examples"]] == [("1/1 x [go:7](https://identifiers.org/resolve?query=go:7) (non-random)", "5.0%", "9 words", 0)]


def test_a_validator_may_exclude_an_entry(spark):
    p = ping(spark, [(i, "7", False, [hop("http://a/7", 500)], False, "go:7") for i in (1, 2)])
    none = lambda pings, **_: issues.Verdict(issues.http_status_error(pings).limit(0), spark.createDataFrame([(2,)], "rid bigint"))
    issues.register("not-two", none)
    try:
        found = issues.find_issues(p, p.select("rid"), ["http-status-error", "not-two"])
        assert [r["rid"] for r in found.collect()] == [1]
    finally:
        del issues.VALIDATORS["not-two"], issues.PARAMETERS["not-two"]


def test_specs():
    assert issues.parse_spec("information-content:threshold=0.2") == issues.Spec("information-content", {"threshold": 0.2})
    for bad in ("nothing", "dns-error:x=1"):
        with pytest.raises(ValueError):
            issues.parse_spec(bad)


def test_registry_filter_and_information_content(spark):
    p = ping(spark, [(1, "7", False, [hop("u7", 200)], False, "7"), (5, "7", False, [hop("u7", 200, True)], False, "7")])
    a = spark.createDataFrame([(1, "7", 0.05, 9, 0)], "rid bigint, lui string, information_content double, length bigint, noise bigint")
    registry = spark.createDataFrame([(1,)], "rid bigint")
    found = issues.find_issues(p, registry, ["dns-error", "information-content:threshold=0.1"], analysis=a).collect()
    assert [(r["rid"], r["type"], r["signature"]) for r in found] == [(1, "InformationContent", "5.0%")]


def test_redistribute(spark):
    need = spark.createDataFrame([(1, 10, 3), (2, 10, 12), (3, 10, 30), (4, 10, 11), (5, 0, 0)], "rid bigint, wanted bigint, available bigint")
    got = {r["rid"]: r["n"] for r in jobs.redistribute(need).collect()}
    assert got == {1: 3, 2: 12, 3: 14, 4: 11, 5: 0}


def test_draw_takes_each_quota_of_other_ids(spark):
    resources = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "id bigint, prefix string")
    known = spark.createDataFrame([("a", str(i)) for i in range(40)] + [("a", "7"), ("b", "x"), ("b", "y")], "prefix string, lui string")
    held = spark.createDataFrame([(1, "7"), (1, "8"), (1, "none"), (3, "x"), (4, "q")], "rid bigint, lui string")
    free = {r["rid"]: r["available"] for r in jobs.available(resources, known, held).collect()}
    assert free == {1: 38, 2: 40, 3: 1}
    order = [tuple(r) for r in jobs.ranked(known, seed=3, bucket=5).collect()]
    assert sorted(p for n, _, p in order if n == "a") == list(range(40)) and len({x for n, x, _ in order if n == "a"}) == 40
    for quota in ({1: 38, 2: 40, 3: 1}, {1: 10, 2: 3, 3: 0}):
        q = spark.createDataFrame(list(quota.items()), "rid bigint, n bigint")
        got = [tuple(r) for r in jobs.draw(resources, known, held, q, seed=3).collect()]
        assert len(got) == len(set(got)) and not set(got) & {(1, "7"), (1, "8"), (3, "x")}
        assert {i: sum(r == i for r, _ in got) for i in quota} == quota
        assert sorted(got) == sorted(tuple(r) for r in jobs.draw(resources, known, held, q, seed=3).collect())
    assert jobs.draw(resources, known.limit(0), held, q).count() == 0


def test_bag_difference(spark):
    a = spark.createDataFrame([(1,), (1,), (1,), (2,)], "x int")
    assert sorted(r[0] for r in jobs.remaining(a, spark.createDataFrame([(1,), (2,), (2,)], "x int")).collect()) == [1, 1]


def test_random_ids(spark):
    r = spark.createDataFrame([(1, r"^\d$"), (2, "(?=x)")], "id bigint, pattern string")
    held = spark.createDataFrame([(1, str(i)) for i in range(8)], "rid bigint, lui string")
    got = [tuple(x) for x in jobs.random_ids(r, held, 3).collect()]
    assert set(got) <= {(1, "8"), (1, "9")} and len(got) == len(set(got))


def test_cursor(spark):
    e = spark.createDataFrame([(1, False), (2, True), (3, False)], "i int, ok boolean")
    shown = curation.cursor(e, "i", "ok")
    assert [tuple(r) for r in shown.orderBy("position").collect()] == [(1, 1, 2, 3, 3), (3, 2, 2, 1, 1)]
    assert [curation.step(shown, "i", at) for at in (1, 3, 7)] == [3, 1, 1] and curation.step(shown, "i", 1, False) == 3
    assert [curation.total_label(v, 3, n) for v, n in ((1, 1), (2, 2), (3, 2))] == ["1+", "2+", "2"]


def test_linking(spark):
    m = spark.createDataFrame([(1, "a b c a", "a b", 5), (1, "a b c a", "c", 1), (1, "a b c a", "b c", 9), (1, "a b c a", "a", 9)], "id int, name string, candidate string, hits bigint")
    assert linking.extract_greedy(m).first()["chosen"] == ["c", "a b", "a"]
    cyc = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "class_id bigint, super_id bigint")
    assert linking.class_closure(cyc).count() == 9
    inst = spark.createDataFrame([(10, 1), (11, 1), (11, 2), (12, 4), (13, 9)], "qid bigint, class_id bigint")
    closure = spark.createDataFrame([(c, c) for c in (1, 2, 3, 4, 9)], "class_id bigint, ancestor bigint")
    assert {tuple(r) for r in linking.entity_types(inst, closure, 1, 2, 3, 4).collect()} == {(10, "ORGANISATION"), (12, "LOCATION")}
    labels = spark.createDataFrame([(1, "red house"), (2, "red"), (3, "blue house")], "qid bigint, label string")
    c = spark.createDataFrame([("red house",)], "candidate string")
    assert [r["qid"] for r in linking.search(c, labels).collect()] == [1] and linking.search(c, labels, strict=False).count() == 3


def test_mentions_and_chains(spark):
    m = spark.createDataFrame([(1, 0, 2, "Uni A"), (1, 2, 3, "of"), (1, 2, 4, "of B"), (1, 5, 6, "C"), (2, 0, 1, "x")], "id int, start int, end int, text string")
    got = {(r["text"], r["next_text"]) for r in linking.next_mentions(m).collect()}
    assert got == {("Uni A", "of"), ("Uni A", "of B"), ("of", "C"), ("of B", "C"), ("C", None), ("x", None)}
    hits = spark.createDataFrame([("uni a",), ("of b",), ("c",)], "text string")
    got = {(r["candidate"], r["strict"]) for r in linking.chained_candidates(m, hits, 3).collect()}
    assert got == {("uni a", True), ("of b", True), ("c", True), ("uni a of b", True), ("of b c", True), ("uni a of b c", True), ("of", False), ("x", False)}


def test_institution_issues(spark):
    place = "struct<countryCode string, countryName string>"
    registry = spark.createDataFrame([(1, "Ä \u65e5 \U0001f600", "http://a", None, "0x", ("DE", "Germany")), (2, "B", "http://b", "d", "r", ("FR", "France")), (3, "C", "http://c.org", "d", None, None)], f"iid int, name string, homeUrl string, description string, rorId string, location {place}")
    linked = spark.createDataFrame([(1, "Ä \u65e5 \U0001f600", "u", "Ä \u65e5 \U0001f600", "https://b", None, "0y", ("DE", "Germany")), (2, "B", "v", "B", None, None, "r", ("FR", "France")), (3, "C", "u", "C", "https://c.org//", "e", None, ("IT", "Italy"))], f"iid int, string string, uuid string, name string, homeUrl string, description string, rorId string, location {place}")
    found = linked.select("iid", "uuid", F.array("string").alias("matches"))
    resources = spark.createDataFrame([(10, 1, "p", "M10", "go"), (11, 3, "CURATOR_REVIEW", "M11", "x"), (12, 2, "q", "M12", "y")], "rid int, iid int, providerCode string, mirId string, prefix string")
    differences = linking.property_differences(registry, linked)
    assert {(r["property"], r["verdict"]) for r in differences.filter("iid = 3").collect()} == {("name", "SAME"), ("homeUrl", "KEEP"), ("description", "KEEP"), ("rorId", "MISSING"), ("location", "ADD")}
    got = {r["iid"]: r for r in linking.institution_issues(registry, differences, found, resources).collect()}
    assert sorted(got) == [1, 3]
    # Fixed value: what the tag store's keys look like.
    assert got[1]["identity"] == '{"iid":1,"name":"\\u00c4 \\u65e5 \\ud83d\\ude00","rorId":{"new":"<0y>","old":"<0x>","type":"REPLACE"},"type":"InstitutionValidator"}'
    detail = json.loads(got[3]["detail"])
    assert detail["location"] == {"new": {"countryCode": "IT", "countryName": "Italy"}, "type": "ADD"} and detail["matches"] == ["C"]
    assert detail["occurrences"] == ["[p/go](https://registry.identifiers.org/registry/go)", "[M11/x](https://registry.identifiers.org/registry/x)"]
    ranks = {(r["iid"], r["same"], r["filled"]) for r in linking.candidate_order(differences).collect()}
    assert ranks == {(1, 2, 4), (2, 3, 3), (3, 1, 4)}


@pytest.mark.parametrize("text", ["plain", "é \u65e5\u672c \U0001f600 \x7f", 'quote " back \\ slash / \\u00', "\x01\x1f\n\t\r\b\f", "\u2028\ufeff"])
def test_canonical_json_is_ascii(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(pf.identity("Kind", name=F.col("t")).alias("i")).first()["i"]
    assert got == json.dumps({"name": text, "type": "Kind"}, separators=(",", ":"), sort_keys=True)


@pytest.mark.parametrize("old,new,want", [("http://a.org", "https://a.org//", "KEEP"), ("http://a.org/x?", "http://a.org/x#", "KEEP"), ("http://a.org/x?y", "http://a.org/x", "REPLACE"), ("ftp://a.org///", "a.org", "KEEP")])
def test_addresses_are_compared_bare(spark, old, new, want):
    df = spark.createDataFrame([("homeUrl", old, new)], "p string, o string, n string")
    assert df.select(pf.property_verdict("p", "o", "n", F.lit(False)).alias("v")).first()["v"] == want


def test_content_gate_and_percent(spark):
    p = spark.createDataFrame([(1, [hop("u", 301), hop("v", 200)], "x"), (2, [hop("v", 200)], None), (3, [hop("v", 404)], "x"), (4, [], "x"), (5, [hop("v", None)], "x")], "rid int, redirects array<struct<url string, status int, dns_error boolean, ssl_error boolean, invalid_response boolean>>, content string")
    assert [r["rid"] for r in issues.analysable(p).collect()] == [1]
    assert spark.range(1).select(pf.percent(F.lit(12.3456)).alias("p")).first()["p"] == "1234.6%"
    assert spark.createDataFrame([("CURATOR_REVIEW", "M", "go")], "p string, m string, n string").select(pf.resource_label("p", "m", "n").alias("l")).first()["l"] == "M/go"
    h = spark.createDataFrame([("http://a", 30000)], "u string, ms int").select(pf.timeout_hops("u", "ms").alias("h")).first()["h"]
    assert [(x["url"], x["status"], x["response_time"], x["dns_error"]) for x in h] == [("http://a", 408, 30000, False)]


def test_damaged_and_unknown(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"rid": 1, "lui": "x"}\nbroken\nbroken too\n')
    (tmp_path / "b.json").write_text('{"rid": 2, "lui": "y"}\n')
    bad = sources.bad_records(sources.read_json(spark, str(tmp_path), "rid bigint, lui string"))
    assert [(r["file"].rpartition("/")[2], r["n"]) for r in bad.collect()] == [("a.json", 2)]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "c.json").write_text("[broken")
    assert [(r["file"].rpartition("/")[2], r["n"]) for r in sources.unreadable_logs(spark, str(tmp_path / "log")).collect()] == [("c.json", 1)]
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "packed.json").write_bytes(gzip.compress(b'{"n": 1}'))
    (tmp_path / "z" / "plain.gz").write_text('{"n": 2}')
    (tmp_path / "z" / "bad").write_text('{"n": ')
    (tmp_path / "z" / "cut.gz").write_bytes(gzip.compress(b'{"n": 1}' * 99)[:30])
    (tmp_path / "z" / "torn.gz").write_bytes(gzip.compress(b'{"n": 1}')[:10] + b"\xff" * 20)
    got = {r["file"].rpartition("/")[2]: r["record"] and r["record"]["n"] for r in sources.read_json_files(spark, str(tmp_path / "z"), "n int").collect()}
    assert got == {"packed.json": 1, "plain.gz": 2, "bad": None, "cut.gz": None, "torn.gz": None}
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "u.json").write_text('{"a": {"b": 1, "c": 2}, "d": {"e": 1}, "l": [{"x": 1}]}')
    assert sources.unknown_fields(spark, str(tmp_path / "u"), "a struct<b bigint>, l array<struct<y bigint>>") == ["a.c", "d", "l.x"]


def test_functions_of_hops(spark):
    df = spark.createDataFrame([("::1", 80, {"x-dns-error": "1", "x-ssl-error": ""}), (None, 1, {})], "ip string, port int, h map<string, string>")
    got = df.select(pf.ip_port("ip", "port").alias("t"), pf.hop_flags(F.col("h")).alias("f")).collect()
    assert [(r["t"], tuple(r["f"])) for r in got] == [("[::1]:80", (True, False, False)), (None, (False, False, False))]
    e = spark.createDataFrame([("<p>caf&eacute; &#233;&lt;b",)], "t string").select(pf.markup_text(F.col("t")).alias("t")).first()
    assert e["t"].strip() == "café é<b"


def test_sources(spark, tmp_path):
    (tmp_path / "log" / "sub").mkdir(parents=True)
    (tmp_path / "log" / "a.json").write_text(json.dumps([{"httpRequest": {"requestUrl": "https://identifiers.org/a:1"}}, {"x": 1}]))
    (tmp_path / "log" / "sub" / "b.json").write_text("[broken")
    assert [r["url"] for r in sources.access_log(spark, str(tmp_path / "log")).collect()] == ["https://identifiers.org/a:1"]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "pings_12.json").write_text('{"lui": "1", "random": false}\n')
    (tmp_path / "p" / "other.json").write_text('{"lui": "2", "random": false}\nbad\n')
    assert [(r["rid"], r["lui"]) for r in sources.read_pings(spark, str(tmp_path / "p")).collect()] == [(12, "1")]
    registry = {"namespaces": [{"prefix": "go", "resources": [{"id": 1, "institution": {"id": 5, "name": "I"}}, {"id": 1, "name": "again"}]}]}
    (tmp_path / "r.json").write_text(json.dumps(registry))
    ns, res, inst = sources.read_registry(spark, str(tmp_path / "r.json"))
    assert (ns.count(), [(r["id"], r["institution_id"]) for r in res.collect()], [r["name"] for r in inst.collect()]) == (1, [(1, 5)], ["I"])
    ids = spark.createDataFrame([({"go": ["1", None, "1"], "x": []},)], "known map<string, array<string>>")
    known = sources.known_ids(ids)
    assert [tuple(r) for r in known.collect()] == [("go", "1")]
    sources.write_known_ids(known, str(tmp_path / "k"))
    assert list(tmp_path.glob("k/*.gz"))
    rules = sources.broken_rules(spark.createDataFrame([(-1,), (None,)], "n int"), {"n at least 0": "n >= 0"})
    assert [r["broken_rules"] for r in rules.collect()] == [["n at least 0"], []]


def test_session(spark):
    s = spark.createDataFrame([(["a"], 0, 100, 0, [0])], "validators array<string>, valid_luis_threshold int, random_luis_threshold int, position int, visited array<int>")
    got = sources.save_session(s, spark.createDataFrame([(2,), (1,)], "position int")).first()
    assert got["visited"] == [0, 1, 2] and got["position"] == 2
    assert [sources.session_complete(s, n).first()["complete"] for n in (1, 2)] == [True, False]


def test_session_is_discarded(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "s"))
    sources.discard_session(spark, str(tmp_path / "s"))
    assert not (tmp_path / "s").exists()


def test_stream(spark, tmp_path):
    src = spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_id").alias("ping_id"), F.col("user_id").alias("rid"), "ts", (F.col("event_type") == "error").alias("failed"))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = write_rates(failure_rates(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    out, whole = spark.read.parquet(str(tmp_path / "out")), failure_rates(src.withColumn("ts", F.col("ts").cast("timestamp")))
    assert 0 < out.count() <= whole.count() and out.exceptAll(whole).count() == 0


def test_identities_need_no_examples(spark, monkeypatch):
    data = [
        (1, "7", False, [hop("http://a/7", 301), hop("https://a/7", 404)], False, "go:7"),
        (1, "8", True, [hop("http://a/8", 500, True)], False, "go:8"),
        (1, "8", None, [hop("http://a/8", 503)], False, "go:8"),
        (2, "9", False, [hop(None, 404)], False, "go:9"),
        (2, None, True, [hop("http://b/1", 301, True), hop("https://b/1", 404)], False, None),
        (2, "1", True, [hop("http://b/1", 502)], False, None),
        (3, "1", False, [hop("http://b/1", None)], False, "go:1"),
        (4, "1", False, [], False, "go:1"),
        (5, "1", False, [hop("http://b/1", 404, True)], False, "go:1"),
        (None, "1", False, [hop("http://b/1", 404, True)], False, "go:1"),
    ]
    p, registry = ping(spark, data), spark.createDataFrame([(1,), (1,), (2,), (3,), (4,), (None,)], "rid bigint")
    lots = [["http-status-error"], ["http-status-error:valid_rate=0.0,random_rate=0.0"], ["http-status-error:random_rate=0.4", "scheme-only-redirect", "redirection-chain"], ["dns-error", "ssl-error"], ["dns-error"], ["invalid-response", "scheme-only-redirect"], ["http-status-error:valid_rate=-1,random_rate=-1"]]
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = [rows(issues.identities(issues.find_issues(p, registry, specs))) for specs in lots]
    assert sum(map(len, want)) > 10
    for name in ("collected", "_totals"):
        monkeypatch.setattr(issues, name, lambda *_: pytest.fail("identities need no examples"))
    assert [rows(issues.find_identities(p, registry, specs)) for specs in lots] == want


def test_identities_of_validators_that_exclude_entries(spark):
    p = ping(spark, [(i, "7", False, [hop("http://a/7", 500)], False, "go:7") for i in (1, 2)])
    own = issues.VALIDATORS["scheme-only-redirect"]
    issues.register("scheme-only-redirect", lambda pings, **_: issues.Verdict(issues.http_status_error(pings).limit(0), spark.createDataFrame([(2,)], "rid bigint")))
    try:
        assert [r["rid"] for r in issues.find_identities(p, p.select("rid"), ["http-status-error", "scheme-only-redirect"]).collect()] == [1]
    finally:
        issues.VALIDATORS["scheme-only-redirect"] = own
        del issues.PARAMETERS["scheme-only-redirect"]
