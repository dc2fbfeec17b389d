"""Operators 11 to 13 against brute force on small tables, with nulls, ties, repeats, long texts, clashing columns and empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from probewell.llm import lexical, lines, queries, spelling

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NONE = "doc_id long, text string, h binary, rank int"


# 11 -----------------------------------------------------------------------------------------------------------------
def brute_lines(rows, least, copies):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    docs, top = collections.Counter(), {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            docs[k] += 1
            if i is not None:
                top[k] = max(top.get(k, i), i)
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        stay = [x for x in all_ if not (len(k := key(x)) >= least and docs[k] >= copies and k in top and (i is None or i < top[k]))]
        out.append((i, len(all_), len(all_) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


def line_rows():
    r = random.Random(11)
    pool = ["A common line of boilerplate, ÄÖ %02d" % i for i in range(12)] + ["short"]
    rows = [(i, "\n".join(r.choice([x := r.choice(pool), f"  {x.upper()}\t", x + "\r", f"own {r.random()} text of this document alone"]) for _ in range(r.randint(0, 9)))) for i in range(150)]
    return rows + [(None, pool[0]), (None, None), (900, None), (901, ""), (3, pool[1]), (3, pool[1]), (902, "\n".join([pool[2], "x", ""] * 4000)), (903, "\n" * 5)]


@pytest.mark.parametrize("batches,fan", [(1, 2), (5, 2)])
def test_lines(spark, batches, fan):
    rows = line_rows()
    docs = spark.createDataFrame([(i, t, b"x", 1) for i, t in rows], NONE).repartition(5)
    before = {t.name for t in spark.catalog.listTables()}
    got = lines.dedup_lines(docs, least=30, copies=5, batches=batches, fan=fan)
    assert got.columns == ["doc_id", "h", "rank", "text", "n_lines", "n_dropped"]
    out = [(x.doc_id, x.n_lines, x.n_dropped, hashlib.sha256(x.text.encode()).hexdigest()) for x in got.collect()]
    assert sorted(out, key=repr) == brute_lines(rows, 30, 5)
    assert {t.name for t in spark.catalog.listTables()} == before
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_line_runs_hold_a_key_once(spark):
    runs = lines.LineRuns(spark, fan=2, buckets=3)
    for b in range(5):
        runs.add(spark.createDataFrame([(b * 10 + i, bytes([i % 4 if i else b + 50])) for i in range(6)], "doc_id long, h binary"))
    assert len(runs.levels) == 3  # merges at two levels
    held = [x.h for t in runs.runs() for x in t.collect()]
    assert len(held) == len(set(held))
    plan = runs.runs()[0].join(runs.runs()[-1].hint("merge"), "h", "left_anti")._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("== Physical Plan ==")[1]  # runs are bucketed alike
    found = {bytes(x.h): (x.docs, x.top) for x in runs.frequent(5).collect()}
    assert found == {b"\x00": (5, 44), b"\x01": (10, 45), b"\x02": (5, 42), b"\x03": (5, 43)}
    runs.drop()


def test_line_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = sorted((tuple(x) for x in queries.op11_lines(spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert got == brute_lines([(x.doc_id, x.text) for x in docs], 40, 5)


# 12 -----------------------------------------------------------------------------------------------------------------
def brute_search(docs, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    held = [(d, collections.Counter(split(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, length = len(held), sum(n for *_, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for at, (d, c, n) in enumerate(held):
            m = 50 + (50 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(split(text)) if t in c)
            if s > 0:
                scores.append((-s, d is None, d if d is not None else 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def search_tables():
    r = random.Random(12)
    vocabulary = ["alpha", "Beta", "ÄÖ", "naïve", "x1", "日本", "zz", "q"] + [f"w{i}" for i in range(40)]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", "-", "\n", "_", "  "]) for _ in range(n))
    docs = [(i, text(r.randint(0, 30))) for i in range(400)] + [(7, "alpha w1"), (None, "alpha w1 w2"), (None, None), (501, ""), (502, "…"), (503, "w3 " * 60000)]
    docs += [(600 + i, "Beta w5 tie") for i in range(70)]
    items = [(i, text(r.randint(1, 12))) for i in range(40)] + [(3, "alpha"), (None, "w1 w2"), (50, None), (51, "unheard"), (52, "tie TIE"), (53, " ".join(vocabulary))]
    return docs, items


@pytest.mark.parametrize("most", [1_000_000, 60])
def test_search(spark, most):
    docs, items = search_tables()
    d = spark.createDataFrame([(*x, b"", 1) for x in docs], NONE).repartition(6)
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, item int").repartition(2)
    got = sorted((tuple(x) for x in lexical.search(d, i, k=10, most=most).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert got == brute_search(docs, items, 10)


def test_search_of_empty_tables(spark):
    d, i = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(d.limit(0), i).count() == 0 and lexical.search(d, i.limit(0)).count() == 0


def test_tiles_of_the_vocabulary_add_up():
    rng = np.random.default_rng(12)
    items = [np.unique(rng.integers(0, 300, 60)) for _ in range(30)]
    weights = rng.integers(0, 20_000, 300)
    starts = np.arange(0, 4001, 20)
    ids = np.concatenate([rng.choice(300, 20, replace=False) for _ in range(200)])
    impact = rng.integers(1, 10**6, 4000)
    one, many = lexical.Tiles(items, weights, 7), lexical.Tiles(items, weights, 7, item_tile=4, term_tile=11, doc_tile=13)
    for t in (one, many):
        t.add(np.arange(200), starts, ids, impact)
    assert all((a == b).all() for a, b in zip(one.best, many.best)) and len(one.best[0]) == 210


# 13 -----------------------------------------------------------------------------------------------------------------
def brute_words(docs, every=199):
    n = collections.Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in n}
    form = {w: min(xs, key=lambda x: (-n[x], x)) for w, xs in near.items() if xs}
    form = {w: f for w, f in form.items() if n[f] >= 5 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def test_variants(spark):
    r = random.Random(13)
    base = ["".join(r.choice("abcé") for _ in range(r.randint(5, 9))) for _ in range(60)]
    docs = [(i, " ".join(r.choice(base) if r.random() < 0.9 else r.choice(base)[1:] + "ü" for _ in range(60))) for i in range(60)]
    docs += [(70, "Word-ändern " * 30), (71, "word×ändern wörd÷x " * 7), (72, "ändern1ändert " * 40), (None, "ändert " * 5), (None, None), (73, ""), (70, "ändere " * 6), (74, ("ab" * 30000 + " ") * 5 + ("ab" * 30000 + "c ") * 25)]
    docs += [(80, "chaina " * 5 + "chainb " * 25 + "chaibb " * 125 + "chabbb " * 625)]
    d = spark.createDataFrame([(*x, b"", 1) for x in docs], NONE).repartition(6)
    got = spelling.variants(d)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_variants(brute_words(docs))
    assert sorted(tuple(x) for x in got.collect()) == want
    assert ("chaina", "chainb", "chabbb", 5, 1, 25) in want
    assert spelling.variants(d.limit(0)).count() == 0


@pytest.mark.parametrize("block,letters", [(2048, 1 << 18), (7, 1 << 18), (2048, 60)])
def test_near_words_in_blocks(spark, block, letters):
    r = random.Random(130)
    n = {"".join(r.choice("ab") + r.choice("cd") for _ in range(r.randint(2, 4))) + r.choice(["", "a", "é"]): r.randint(1, 5) for _ in range(300)} | {"a": 2, "b": 2, "": 3}
    v = spark.createDataFrame(list(n.items()), "word string, n long").filter("word <> ''")
    n.pop("")
    got = {x.word: (x.n_near, x.best_n, x.best) for x in spelling.near_words(v, block, letters).collect()}
    for w in n:
        near = [x for x in n if one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        assert got.get(w) == ((len(near), n[best], best) if near else None), w


def test_spelling_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = sorted(tuple(x) for x in queries.op13_spelling(spark, "/root/testdata/sf0.001").collect())
    assert got == brute_variants(brute_words([(x.doc_id, x.text) for x in docs]))
