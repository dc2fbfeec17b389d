import random
import re

import pytest
from pyspark.sql import functions as F

from probewell import functions as pf
from probewell.operators.jobs import random_match

TOKENS = [
    ("Protein KINASE c2", [], "protein kinase c2"),
    ("two  words\t\n here\r\n and   there ", [], "two words here and there"),
    ("the cell's pre-mRNA v1.2+b, a:b and under_score; (end)", [], "the cell's pre-mrna v1.2+b a:b and under_score end"),
    ("see https://data.example.org/entry/12?x=%20#top for more", [], "see for more"),
    ("files at FTP://host.example.net/a+b/ are old", [], "files at are old"),
    ("id P1.2 and xP1.2 and P1.2x", ["P1.2"], "id and xp1.2 and p1.2x"),
    ('{"b": [1, true], "a": {"z": null, "y": "Red Fox"}} end', [], "red fox none 1 true end"),
    ("<data><name lang='en'>Alpha</name><!-- hidden --><name>Beta</name></data>", [], "alpha beta"),
    ("<head><title>Entry 5</title><style>p { x: y }</style></head><p>bro<b>ken</b> word</p><script>run()</script><p>next", [], "entry 5 broken word next"),
    ('<div>[1, oops {"k": "kept"}</div> Some drop words', ["drop", "kept"], "1 oops some words"),
]


@pytest.mark.parametrize("content,exclusions,expected", TOKENS)
def test_tokens(spark, content, exclusions, expected):
    df = spark.createDataFrame([(content, exclusions)], "content string, ex array<string>")
    assert " ".join(df.select(pf.tokens("content", pf.exclusion_pattern(F.col("ex"))).alias("t")).first()["t"]) == expected


def test_urls(spark):
    rows = ["https://identifiers.org/go:GO:1?x=1#f", " http://identifiers.org/a/b/ ", "https://identifiers.org/x:y;p/", "https://other.org/a", None]
    df = spark.createDataFrame([(r,) for r in rows], "url string")
    assert [r[0] for r in df.select(pf.compact_id_of_url("url")).collect()] == ["go:GO:1", "a/b", "x:y;p", None, None]
    one = spark.createDataFrame([("http://a.b/7/x7/#q", "7")], "url string, lui string")
    assert one.select(pf.lui_link("url", "lui"), pf.normalised_url("url"), pf.without_scheme(F.col("url"))).first()[:] == ("http://a.b/{$id}/x{$id}/#q", "http://a.b/7/x7", "a.b/7/x7/#q")


def test_outcomes(spark):
    df = spark.createDataFrame([(204, True, 1.23456), (204, False, 0.0005), (200, False, 2.0)], "s int, t boolean, x double")
    assert [tuple(r) for r in df.select(pf.http_status("s", "t"), pf.milliseconds("x")).collect()] == [(408, 1235), (None, 1), (200, 2000)]
    ftp = spark.createDataFrame([(None, None), (226, None), (None, "434 no host"), (None, "115 soon"), (None, "odd")], "c int, m string")
    got = [tuple(r[0]) for r in ftp.select(pf.ftp_outcome("c", "m")).collect()]
    assert got == [(200, False, False), (226, False, False), (434, True, True), (408, False, True), (None, False, True)]


def test_identity(spark):
    row = spark.range(1).select(pf.identity("DNSError", rid=F.lit(3)).alias("i")).select("i", pf.identity_type("i"), pf.identity_type(F.lit("x").cast("string"))).first()
    assert tuple(row) == ('{"rid":3,"type":"DNSError"}', "DNSError", "Unidentified")


@pytest.mark.parametrize("pattern", [r"^\d{7}$", r"^[A-Z]{2}\d+(\.\d)?$", r"^(GO|HP):\d{3}$", r"^\w+$"])
def test_random_match(pattern):
    rng = random.Random(1)
    assert all(re.search(pattern, random_match(pattern, rng)) for _ in range(50))
    assert random_match(r"(?=a)b", rng) is None
