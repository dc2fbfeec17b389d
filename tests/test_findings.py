"""What the findings of round 3 asked for."""

import tracemalloc

import numpy as np
import pyarrow as pa
from probewell import functions as pf
from probewell import sources
from probewell.operators import issues, jobs, linking, suffixes
from probewell.sources import checks
from pyspark.sql import functions as F


def test_resources_of_a_class_are_gathered_once(spark):
    entities = spark.createDataFrame([(i % 2, f"e{i}") for i in range(100)] + [(1, "e0"), (7, "e1"), (None, "e2"), (None, "x")], "iid long, uuid string")
    resources = spark.createDataFrame([(10, 0), (11, 1), (12, 1), (13, 5)], "rid long, iid long")
    members, classes = linking.occurrence_classes(entities, resources)
    assert {tuple(r.iids): list(r.resources) for r in classes.collect()} == {(0,): [10], (1,): [11, 12], (0, 1): [10, 11, 12], (1, 7): [11, 12]}
    assert members.count() == 100
    got = {r.uuid: list(r.resources) for r in linking.occurrences(entities, resources).collect()}
    assert got == {f"e{i}": [10, 11, 12] if i == 0 else [[10], [11, 12]][i % 2] for i in range(100)}


def test_filtered_classes_say_what_filter_matches_says(spark):
    labels = [(i, ["red ring", "ring red", "red bolt", "blue bolt"][i % 4], "LOCATION" if i % 4 == 2 else [None, "ORGANISATION", "LOCATION"][(i // 4) % 3]) for i in range(1, 60)]
    l_ = spark.createDataFrame(labels, "qid long, label string, type string")
    names = spark.createDataFrame([("red ring",), ("Ring / red",), ("blue bolt old",), ("red bolt",), ("none",)], "match string")
    pairs = names.crossJoin(l_).filter(linking.iou(F.array_distinct(pf.words("match")), F.array_distinct(pf.words("label"))) >= 0.3).select("match", "qid", "label")
    types = l_.select("qid", "type").filter("type is not null")
    want = {r.match: (len(r.qids), min(r.qids), sum(r.qids)) for r in linking.filter_matches(pairs, types).collect()}
    word_set = lambda c: F.array_sort(F.array_distinct(pf.words(c)))
    y = l_.select(word_set("label").alias("y"), "qid", "type").filter("type is not null")
    x = names.select("match", word_set("match").alias("x"))
    links = x.select("x").distinct().crossJoin(y.select("y").distinct()).withColumn("iou", linking.iou(F.col("x"), F.col("y"))).filter("iou >= 0.3")
    got = x.join(linking.filter_match_classes(links, y), "x").groupBy("match").agg(F.sum("n").alias("n"), F.min("first").alias("f"), F.sum("total").alias("t"))
    assert {r.match: (r.n, r.f, r.t) for r in got.collect()} == want and len(want) == 3


def test_best_labels_of_many_equal_ones(spark, monkeypatch):
    kept, stored = [], linking.stored
    monkeypatch.setattr(linking, "stored", lambda df: kept.append(stored(df)) or kept[-1])
    labels = [(i, "red ring" if i % 3 else "ring red blue") for i in range(200, 0, -1)]
    l_ = spark.createDataFrame(labels, "qid long, label string")
    got = linking.top_by_overlap(spark.createDataFrame([("red ring",)], "candidate string"), l_, 3)
    assert sorted((r.rank, r.qid) for r in got.collect()) == [(1, 1), (2, 2), (3, 4)]
    # Three labels of either word set are ranked, not two hundred.
    assert kept[-1].columns == ["qid", "label", "lw"] and kept[-1].count() == 6


def test_records_are_parsed_once(spark):
    closed = spark.createDataFrame([], "rid bigint, lui string, redirects array<struct<url string, status int>>").schema
    rows = [("f", 1, '{"rid": 1, "lui": 3, "redirects": [{"url": null, "status": "x", "host": {"a": [1]}}, {}], "extra": [1]}'), ("f", 2, "{"), ("f", 3, "{}"), ("f", 4, '{"redirects": [], "lui": null}'), ("f", 5, "[]"), ("f", 6, None)]
    found = checks.schema_errors(spark.createDataFrame(rows, "file string, record int, text string"), closed)
    assert sorted((r.record, r.path or "", r.rule) for r in found.collect()) == [(1, "extra", "unknown"), (1, "lui", "not string"), (1, "redirects[0].host", "unknown"), (1, "redirects[0].status", "not integer"), (2, "", "not JSON"), (5, "", "not object"), (6, "", "not JSON")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("try_parse_json") + found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") <= 1


def test_ids_of_requests_are_parsed_once(spark):
    log = spark.createDataFrame([("https://identifiers.org/a:1?x=1",), ("https://identifiers.org/A:1",), ("https://identifiers.org/a",), ("http://else/a:2",), (None,)], "url string")
    ns = spark.createDataFrame([("a", "^[0-9]+$", False, False)], "prefix string, pattern string, deprecated boolean, namespaceEmbeddedInLui boolean")
    found = jobs.mined_ids(log, ns)
    assert [tuple(r) for r in found.collect()] == [("a", "1")]
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert len([line for line in plan if "identifiers[.]org" in line]) == 1


def test_the_last_hop_is_made_once(spark):
    hop = lambda s: F.struct(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), (F.col("id") + s).alias("status"))
    p = spark.range(6).select(F.lit(1).alias("rid"), F.slice(F.array(hop(0), hop(100)), F.lit(1), (F.col("id") % 3).cast("int")).alias("redirects"), "id")
    found = issues.answered(p.unionByName(p.limit(1).withColumn("redirects", F.lit(None).cast(p.schema["redirects"].dataType))))
    assert sorted((r.id, r.status) for r in found.collect()) == [(1, 1), (2, 102), (4, 4), (5, 105)]
    plan = issues.answered(p).filter("status > 3").select("rid", "status")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert len([line for line in plan if "concat(u" in line]) == 1


def test_texts_go_to_python_in_small_batches(spark):
    df = spark.createDataFrame([("<p>a &amp; b</p>",), ('x {"k": ["v"]}',), (None,), ("",)], "html string").select(pf.plain_text("html").alias("t"))
    assert [r.t and r.t.split() for r in df.collect()] == [["a", "&", "b"], ["x", "v"], None, ""]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_tasks_of_the_greedy_pick_go_with_its_candidates(spark):
    names = spark.range(300).select("id", F.concat(F.lit("red ring / blue "), F.when(F.col("id") % 2 == 0, "bolt").otherwise("ring")).alias("name"))
    grams = linking.ngrams(names, 2, ("name",))
    labels = spark.createDataFrame([("red ring", 5), ("blue", 9), ("bolt", 1), ("ring blue", 1)], "candidate string, hits long")
    m = grams.join(labels, "candidate").select("id", "name", "candidate", "hits")
    found = linking.extract_greedy(m.unionByName(m), rows_per_part=50)
    assert {(r.id % 2, tuple(r.chosen)) for r in found.collect()} == {(0, ("ring blue", "bolt")), (1, ("ring blue", "red ring"))} and found.count() == 300
    # 1,050 candidates, twice each, go to tasks of about 50.
    assert found.rdd.getNumPartitions() == 42


def test_closure_takes_few_rounds(spark, monkeypatch):
    kept, stored = [], linking.stored
    monkeypatch.setattr(linking, "stored", lambda df: kept.append(stored(df)) or kept[-1])
    edges = {(i, i + 1) for i in range(33)} | {(50, 51), (51, 52), (52, 50), (52, 3), (7, 3), (60, 60)}
    rows = [*edges, (70, None), (None, 3)]
    want, new = {(x, x) for e in edges for x in e}, edges
    while not new <= want:
        want, new = want | new, {(a, d) for a, b in new for c, d in edges if b == c}
    got = [tuple(r) for r in linking.class_closure(spark.createDataFrame(rows, "class_id long, super_id long")).collect()]
    assert sorted(got) == sorted(want)
    # Three tables to begin with and two a round; one a step would make over thirty.
    assert len(kept) <= 17


def test_pings_are_nested_by_tasks_of_so_many(spark):
    p = spark.range(400).select(F.when(F.col("id") < 380, F.col("id") % 4).alias("rid"), F.col("id").cast("string").alias("lui"), F.lit(False).alias("random"), F.lit("d").alias("date"), F.lit(None).cast("array<string>").alias("redirects"), F.lit("x").alias("content"))
    p = p.withColumn("rid", F.when(F.col("lui").cast("int") % 2 == 0, 9).otherwise(F.col("rid")))
    found = sources.nest_datamine(p, part_size=100, rows_per_part=10)
    rows = found.collect()
    assert {(r.id, r.part) for r in rows} == {(9, 0), (9, 1), (1, 0), (3, 0)} and sum(len(r.pings) for r in rows) == 390
    assert found.rdd.getNumPartitions() == 40


def test_chains_are_shuffled_once(spark):
    p = spark.createDataFrame([(1, "a", "c", i % 2 == 0, [("http://x/a", 301), ("http://y", 200 + i % 2)]) for i in range(6)] + [(1, "b", "c", True, []), (1, "b", None, True, []), (None, "b", "c", True, [])], "rid long, lui string, compact_id string, random boolean, redirects array<struct<url string, status int>>")
    found = issues.redirect_chains(p, rows_per_part=2)
    assert sorted((r.rid, r.compact_id, r.random, r.n, r.total) for r in found.collect()) == [(1, "c", False, 3, 7), (1, "c", True, 1, 7), (1, "c", True, 3, 7)]
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1 and found.rdd.getNumPartitions() == 5


def test_low_content_is_shuffled_by_id_and_by_compact_id(spark):
    rows = [(1, lui, c, random, False, [("u", 200)]) for lui, c, random in (("a", "c", True), ("a", "c", False), ("a", "c", None), ("b", "c", True), ("n", "d", True), (None, "e", True), ("a", None, True))]
    rows += [(1, "a", "c", True, True, [("u", 200)]), (1, "a", "c", True, False, [("u", 404)]), (1, "a", "c", True, False, []), (1, "x", "z", True, False, [("u", 500)]), (2, "a", "c", True, False, [("u", 200)]), (3, "a", "c", True, False, [("u", 200)])]
    p = spark.createDataFrame(rows, "rid long, lui string, compact_id string, random boolean, empty_content boolean, redirects array<struct<url string, status int>>")
    a = spark.createDataFrame([(1, "a", 0.05, 10, 1, 2), (1, "a", 0.04, 11, 1, 3), (1, "b", 0.09, 12, 1, 1), (2, "a", 0.5, 1, 0, 1)], "rid long, lui string, information_content double, length long, noise long, ord long")
    last = {("c", True): (2, 7), ("c", False): (1, 7), ("c", None): (1, 7), ("d", True): (1, 1), ("e", True): (1, 1)}
    for analysis, of in ((a, (0.04, 11)), (a.drop("ord"), (0.09, 12))):
        found = issues.low_content(p, analysis)
        got = {(r.compact_id, r.random): (r.n, r.total, r.value, r.information_content, r.length) for r in found.collect()}
        assert got == {k: (*n, 0.09, *(of if k[0] == "c" else (None, None))) for k, n in last.items()}
        assert found.count() == 5 and found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 3


def test_lists_of_runs_meet_in_little_memory():
    rng = np.random.default_rng(1)
    lists = [np.unique(rng.integers(1, 400_000, 150_000).astype(np.uint64)) for _ in range(2)]
    runs = [suffixes._bytes_apart(np.append(x[:1], np.diff(x))) for x in lists]
    rows = pa.table({"lot": pa.array([0, 1], pa.int64()), "part": pa.array([0, 0], pa.int64()), "runs": pa.array(runs, pa.binary())})
    tracemalloc.start()
    found = suffixes._met(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for own, other, bits in zip(lists, lists[::-1], found["bits"].to_pylist()):
        assert (np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool) == np.isin(own, other)).all()
    assert peak < 40 * sum(map(len, lists))
