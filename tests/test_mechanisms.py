"""Closures, as-of joins, chains, set-similarity search, exclusions, schema paths, batch commits and versioned stores against brute force."""

import gzip
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from probewell import functions as pf
from probewell import streaming
from probewell.operators import content, linking
from probewell.sources import checks, stores


def brute_closure(edges):
    nodes = {x for e in edges for x in e}
    out = {(n, n) for n in nodes}
    while True:
        more = out | {(a, d) for a, b in out for c, d in edges if b == c}
        if more == out:
            return out
        out = more


def test_closure_with_cycles(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 40), r.randint(0, 40)) for _ in range(45)] + [(50, 51), (51, 52), (52, 50), (60, 60)] + [(i, i + 1) for i in range(70, 100)]
    df = spark.createDataFrame([*edges, *edges[:5], (None, 1), (2, None)], "class_id int, super_id int")
    assert {tuple(x) for x in linking.class_closure(df).collect()} == brute_closure(edges)
    assert linking.class_closure(df.limit(0)).count() == 0


def test_closure_as_one_recursive_query(spark):
    edges = [(i, i // 2) for i in range(2, 80)] + [(9, 2), (80, 3)]
    df = spark.createDataFrame(edges, "class_id int, super_id int")
    assert {tuple(x) for x in linking.class_closure(df, acyclic=True).collect()} == brute_closure(edges)


@pytest.mark.parametrize("block", [4096, 5])
def test_next_mentions(spark, block):
    r = random.Random(2)
    rows = {(r.randint(0, 6), s := r.randint(0, 60), s + r.randint(0, 9), r.choice("ab")) for _ in range(150)}
    m = spark.createDataFrame([*rows, (None, 1, 2, "n")], "id int, start int, end int, text string")
    got = sorted(tuple(x) for x in linking.next_mentions(m, block).collect())
    want = []
    for i, s, e, t in rows:
        after = [x for x in rows if x[0] == i and x[1] >= e]
        first = min((x[1] for x in after), default=None)
        follow = [(first, x[2], x[3]) for x in after if x[1] == first] or [(None, None, None)]
        want += [(i, s, e, t, *f) for f in follow]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    plan = linking.next_mentions(m)._jdf.queryExecution().toString()
    assert "collect_set" not in plan and "collect_list" not in plan


def test_next_mentions_deals_rows_to_more_tasks(spark):
    m = spark.range(3000).selectExpr("id", "explode(array(1, 3)) as start").selectExpr("id", "start", "start + 1 as end", "'t' as text")
    got = linking.next_mentions(m, rows_per_part=500)
    assert got.agg(F.count("*"), F.count("next_start")).first() == (6000, 3000)
    # 6,000 mentions, at most about 500 for each task of a shuffle.
    plan = got._jdf.queryExecution().toString()
    assert "hashpartitioning(id" in plan and all(int(n) >= 12 for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\)", plan))


def test_chains_have_no_limit(spark):
    rows = [(1, 10 * i, 10 * i + 5, f"m{i}") for i in range(10)] + [(2, 3, 3, "m1"), (2, 3, 3, "m2")]
    m = spark.createDataFrame(rows, "id int, start int, end int, text string")
    hits = spark.createDataFrame([(f"M{i}",) for i in range(10)], "text string")
    got = {x["candidate"] for x in linking.chained_candidates(m, hits).filter("id = 1").collect()}
    assert got == {" ".join(f"m{k}" for k in range(i, j)) for i in range(10) for j in range(i + 1, 11)}
    assert {x["candidate"] for x in linking.chained_candidates(m, hits).filter("id = 2").collect()} == {"m1", "m2"}  # no way on from mentions of no length
    assert max(len(x["candidate"].split()) for x in linking.chained_candidates(m, hits, 3).collect()) == 3
    names = spark.createDataFrame([(1, "a b c d e f g"), (2, ""), (3, None)], "id int, name string")
    assert linking.ngrams(names).count() == 28 and linking.ngrams(names, 2).count() == 13


def test_top_by_overlap(spark):
    r = random.Random(3)
    words = ["the"] * 30 + [f"w{i}" for i in range(60)]
    labels = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 6)))) for i in range(400)] + [(500, "..."), (501, None), (7, "w1 the")]
    names = [" ".join(r.choice(words) for _ in range(r.randint(1, 6))) for _ in range(80)] + ["unheard of", "", "the", "w1 W1 the!"]
    c = spark.createDataFrame([(n,) for n in names] + [(None,)], "candidate string")
    l_ = spark.createDataFrame(labels, "qid int, label string")
    split = lambda t: frozenset(pf_words(t))
    for k in (1, 10):
        looked: list[int] = []
        got = sorted((x["candidate"], x["rank"], x["qid"], x["label"]) for x in linking.top_by_overlap(c, l_, k, looked_at=looked).collect())
        want = []
        for n in set(names):
            x = split(n)
            found = sorted((-len(x & y) / len(x | y), q, t) for q, t in labels if t and (y := split(t)) & x)
            want += [(n, i, q, t) for i, (_, q, t) in enumerate(found[:k], 1)]
        assert got == sorted(want)
        if k == 1:  # frequent words are looked up for few candidates
            sets, asked = {split(t) for _, t in labels if t}, {split(n) for n in names}
            assert sum(looked) < 0.75 * sum(bool(x & y) for x in asked for y in sets)


def pf_words(t):
    return [w for w in "".join(ch if ch.isalnum() or ch == "_" else " " for ch in t.lower()).split()]


def test_thousands_of_exclusions(spark):
    r = random.Random(4)
    ids = [(1, f"id{i}") for i in range(10_000)] + [(1, f"GO:{i:07}") for i in range(3000)] + [(1, "a.b-1"), (1, "x#y"), (1, "ab_c#d"), (1, "--"), (1, "GO:0001"), (1, None), (2, "word")]
    texts = [(1, " ".join(r.choice(["id7", "ID70", "id99999", "x", "ab", "ab_c", "a.b-1", "a.b-12", "go:0001", "GO:0000042", "go 0000043", "-- word", "<b>i</b>d8", "http://a/id7", '{"k": "id9"}'] + [f"id{r.randint(0, 9999)}"]) for _ in range(12))) for _ in range(30)] + [(2, "word wording id7"), (3, "id7"), (None, "id7")]
    rows = [(rid, f"p{i}", i, [("u", 200)], t) for i, (rid, t) in enumerate(texts)] + [(1, "q", 99, [("u", 404)], "id7"), (1, "q", 98, [("u", 200)], None)]
    p = spark.createDataFrame(rows, "rid int, lui string, ord int, redirects array<struct<url string, status int>>, content string")
    i = spark.createDataFrame(ids, "rid int, lui string")
    got = {x["ord"]: list(x["tokens"]) for x in content.analysed_tokens(p, i).collect()}
    by_regex = p.filter("ord < 90").join(i.filter("lui is not null").groupBy("rid").agg(F.collect_set("lui").alias("ids")), "rid", "left")
    pattern = pf.exclusion_pattern(F.coalesce("ids", F.array().cast("array<string>")))
    want = {x["ord"]: list(x["t"]) for x in by_regex.select("ord", pf.tokens("content", pattern).alias("t")).collect()}
    assert got == want
    few = content.relevant_forms(p.select(F.col("ord").alias("key"), "rid", F.col("content").alias("text")), i).agg(F.max(F.size("forms"))).first()[0]
    assert few < 30  # of ten thousand


def test_paths_of_errors(spark, tmp_path):
    good = {"rid": 1, "lui": "x", "hops": [{"url": "u", "ms": 1.5}, {"url": None}], "known": {"go": ["1", None]}}
    bad = {"rid": 1.5, "lui": 3, "hops": [{"url": "u", "ms": "slow"}, 7, {"link": {"deep": 1}}], "known": {"go": "1"}, "more": [1]}
    (tmp_path / "a.json").write_text("\n".join([json.dumps(good), "", json.dumps(bad), "[1]", "{"]))
    (tmp_path / "packed").write_bytes(gzip.compress(json.dumps({"lui": False}).encode()))
    (tmp_path / "cut.gz").write_bytes(gzip.compress(b"{}" * 500)[:20])
    schema = "rid bigint, lui string, hops array<struct<url string, ms double>>, known map<string, array<string>>"
    got = {(x["file"].rpartition("/")[2], x["record"], x["path"], x["rule"]) for x in checks.check_files(spark, str(tmp_path), schema).collect()}
    assert got == {
        *(("a.json", 3, p, r) for p, r in [("rid", "not integer"), ("lui", "not string"), ("hops[0].ms", "not number"), ("hops[1]", "not object"), ("hops[2].link", "unknown"), ("known.go", "not array"), ("more", "unknown")]),
        ("a.json", 4, "", "not object"),
        ("a.json", 5, None, "not JSON"),
        ("packed", 1, "lui", "not string"),
        ("cut.gz", None, None, "unreadable"),
    }


def test_pings_and_progress_are_committed_together(spark, tmp_path, monkeypatch):
    jobs = [(i, str(i), i % 2 == 0, f"u{i}") for i in range(20)]
    src = spark.createDataFrame(jobs, "rid bigint, lui string, random boolean, url string").withColumn("date", F.lit("2020"))
    src.repartition(2).write.parquet(str(tmp_path / "in"))
    out, check = str(tmp_path / "out"), str(tmp_path / "cp")
    stream = lambda: spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    real, calls = streaming.F.lit, []

    def dies(value):  # the commit of the second batch is where it stops: both tables are written by then, the mark isn't
        calls.append(value)
        if value == 1 and calls.count(1) == 1:
            raise RuntimeError("killed")
        return real(value)

    monkeypatch.setattr(streaming.F, "lit", dies)
    with pytest.raises(Exception, match="killed"):
        q = streaming.ingest(stream(), out, check)
        q.awaitTermination(120)
    monkeypatch.undo()
    for name in ("pings", "progress"):
        assert streaming.committed(spark, out, name).count() == 10 and spark.read.parquet(f"{out}/{name}").count() == 20
    streaming.ingest(stream(), out, check).awaitTermination(120)
    for name in ("pings", "progress"):
        rows = streaming.committed(spark, out, name)
        assert sorted(x["rid"] for x in rows.collect()) == list(range(20)) and {x["batch"] for x in rows.select("batch").distinct().collect()} == {0, 1}


def test_tag_store(spark, tmp_path):
    store = stores.TagStore(spark, str(tmp_path / "tags"))
    tags = lambda *rows: spark.createDataFrame(list(rows), "identity string, tags array<string>")
    assert store.read().count() == 0
    assert store.upsert(tags(("a", ["x", "x"]), ("b", ["y"]))) == 1
    before = store.read()
    assert store.upsert(tags(("b", ["z"]), ("c", []))) == 2
    assert {x["identity"]: list(x["tags"]) for x in store.read().collect()} == {"a": ["x"], "b": ["z"], "c": []}
    assert {x["identity"]: list(x["tags"]) for x in before.collect()} == {"a": ["x"], "b": ["y"]}  # a reader keeps what it began with
    # Half a version, as a lost writer leaves it, is never seen.
    (tmp_path / "tags" / "v=3").mkdir()
    (tmp_path / "tags" / "v=3" / "part-0.parquet").write_bytes(b"half")
    assert store.versions() == [1, 2] and store.read().count() == 3
    with pytest.raises(RuntimeError, match="half"):
        store.upsert(tags(("a", ["w"])))
    store.clear()
    assert store.upsert(tags(("a", ["w"]))) == 3 and store.versions() == [2, 3]
    with pytest.raises(RuntimeError, match="has come after"):
        store.write(tags(("a", [])), after=2)
    found = {x["identity"]: list(x["tags"]) for x in stores.tags_in(store, spark.createDataFrame([("a",), ("q",)], "identity string")).collect()}
    assert found == {"a": ["w"], "q": []}


def test_session_store(spark, tmp_path):
    store = stores.SessionStore(spark, str(tmp_path / "session"))
    store.start(["dns-error"], 5, 50)
    with pytest.raises(RuntimeError):
        store.start(["ssl-error"])
    seen = lambda *at: spark.createDataFrame([(i,) for i in at], "position int")
    store.save(seen(0, 2))
    again = stores.SessionStore(spark, str(tmp_path / "session"))  # resumed
    assert not again.complete(3)
    again.save(seen(1))
    row = again.read().first()
    assert (list(row["visited"]), row["position"], row["valid_luis_threshold"], list(row["validators"])) == ([0, 1, 2], 1, 5, ["dns-error"])
    assert again.complete(3)
    again.discard()
    assert store.read().count() == 0 and not (tmp_path / "session").exists()
