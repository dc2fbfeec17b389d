"""What the findings of round 3 asked for."""

import random

import pandas as pd
from probewell.llm import bpe, simhash
from pyspark.sql import functions as F


def test_no_partner_of_a_large_bucket_is_dropped(spark):
    r = random.Random(3)
    # One bucket of eighty classes in forty pairs, each pair with shingles of its own.
    classes = spark.createDataFrame([(i, r.getrandbits(63), [7]) for i in range(80)], "cid long, fp long, bands array<long>")
    sets = spark.createDataFrame([(i, [1000 * (i % 40) + k for k in range(20)]) for i in range(80)], "cid long, shingles array<long>")
    found = simhash.groups_of(classes, lambda wanted: sets.join(wanted, "cid", "left_semi"), 0.8, 4)
    assert sorted((x.node, x.root) for x in found.collect()) == [(i + 40, i) for i in range(40)]
    # Blocks of a bucket meet each other.
    rows = spark.createDataFrame([(0, 7, i, i % 3) for i in range(30)], "band int, key long, cid long, root long")
    want = sorted((a, b) for a in range(30) for b in range(a + 1, 30) if a % 3 != b % 3)
    assert sorted((x.a, x.b) for x in simhash.unlinked_pairs(rows, 4).collect()) == want


def test_classes_of_a_frequent_part_do_not_all_meet(spark):
    r = random.Random(5)
    # One bucket: 300 classes have 60 shingles in common and 20 to 30 of their own; every tenth one has a partner that differs in 2 to 16 of 80.
    sets = [list(range(60)) + [1000 * (i + 1) + k for k in range(r.randint(20, 30))] for i in range(300)]
    for i in range(0, 300, 10):
        n = r.randint(1, 8)
        sets.append(sets[i][:-n] + [10**6 + 1000 * i + k for k in range(n)])
    sets += [list(range(n)) for n in (1, 2, 4, 5)]
    held = spark.createDataFrame(list(enumerate(sets)), "cid long, shingles array<long>")
    rows = spark.createDataFrame([(0, 7, i, i) for i in range(len(sets))], "band int, key long, cid long, root long")
    brute = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(common := set(sets[a]) & set(sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - len(common))}
    pairs = simhash.rare_pairs(rows, held, 0.8)
    met = {(x.a, x.b) for x in pairs.collect()}
    assert brute <= met and len(brute) >= 25
    assert len(met) < 1000 < simhash.unlinked_pairs(rows).count()
    assert {(x.a, x.b) for x in simhash.linked(pairs, held, 0.8).collect()} == brute
    # Those of one root have met before.
    assert simhash.rare_pairs(rows.withColumn("root", F.lit(1)), held, 0.8).isEmpty()


def test_texts_are_encoded_a_million_characters_at_a_time():
    rows = pd.DataFrame({"doc_id": range(8), "text": ["a" * 400_000] * 8})
    lots = list(bpe.chunks([rows]))
    assert sum(map(len, lots)) == 8 and max(x["text"].str.len().sum() for x in lots) <= 1_400_000
