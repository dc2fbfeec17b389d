"""Ranked lexical search by dense blocked products.

A lot of items has a compact vocabulary: the terms that its items hold. Documents are scanned once for the counts of those terms.
A tile of documents becomes a dense matrix of their impacts, a tile of the vocabulary a matrix of the weights of its terms in the
lot's items, and one product of the two in float64 gives partial scores. Impacts and weights are whole numbers, and a
tile of the vocabulary is short enough for its sums to stay below 2 ** 53, so products are exact; tiles are added in 64-bit integers.
Each task keeps the best documents of an item, ties to the smaller id, over all its tiles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probewell.llm.common import discard, stored

#: Bytes that aren't part of a term are made spaces, A-Z lower case. Other code points than ASCII are all letters of terms.
_TABLE = bytes(c | 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
IMPACT, HIGHEST = 10**9, np.iinfo(np.int64).max


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode().translate(_TABLE).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """Whole-number impact of a term that stands tf times in a document of n terms."""
    m = 50 + (50 * n * n_docs) // length
    return (IMPACT * tf) // (1000 * tf + 20 * m)


class Tiles:
    """The items (lists of term numbers) of a lot as blocks, each with its own compact vocabulary, and the best documents so far."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, k: int, item_tile: int = 256, term_tile: int = 4096, doc_tile: int = 1024):
        self.k, self.doc_tile, self.blocks = k, doc_tile, []
        heaviest = max(1, int(weights.max(initial=1)))
        term_tile = max(1, min(term_tile, 2**53 // (heaviest * 10**6) - 1))  # an impact is below 10 ** 6
        for at in range(0, len(items), item_tile):
            block = items[at : at + item_tile]
            who = np.repeat(np.arange(len(block)), [len(x) for x in block])
            vocabulary, column = np.unique(np.concatenate([*block, np.empty(0, np.int64)]).astype(np.int64), return_inverse=True)
            tiles = []
            for lo in range(0, len(vocabulary), term_tile):
                own = (column >= lo) & (column < lo + term_tile)
                part = vocabulary[lo : lo + term_tile]
                tiles.append((part, column[own] - lo, who[own], weights[part].astype(np.float64)))
            self.blocks.append((at, len(block), tiles))
        self.remap = np.full(len(weights), -1, np.int64)
        self.floor = np.zeros(len(items), np.int64)  # what a document must reach to be among an item's best
        self.best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))  # item, score, doc

    def add(self, docs: np.ndarray, starts: np.ndarray, ids: np.ndarray, impact: np.ndarray) -> None:
        """Documents with the impacts of their terms: those of the i-th stand from starts[i] to starts[i + 1]."""
        for lo in range(0, len(docs), self.doc_tile):
            hi = min(lo + self.doc_tile, len(docs))
            part = slice(starts[lo], starts[hi])
            row = np.repeat(np.arange(hi - lo), np.diff(starts[lo : hi + 1]))
            found = [self.best]
            for at, n_items, tiles in self.blocks:
                scores = np.zeros((hi - lo, n_items), np.int64)
                for vocabulary, column, who, w in tiles:
                    self.remap[vocabulary] = np.arange(len(vocabulary))
                    own = self.remap[ids[part]]
                    self.remap[vocabulary] = -1
                    hit = own >= 0
                    left, right = np.zeros((hi - lo, len(vocabulary))), np.zeros((len(vocabulary), n_items))
                    left[row[hit], own[hit]] = impact[part][hit]
                    right[column, who] = w[column]
                    scores += (left @ right).astype(np.int64)
                doc, item = np.nonzero((scores > 0) & (scores >= self.floor[at : at + n_items]))
                found.append((item + at, scores[doc, item], docs[lo:hi][doc]))
            item, score, doc = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((doc, -score, item))
            item, score, doc = item[order], score[order], doc[order]
            first = np.searchsorted(item, item)
            stay = np.arange(len(item)) - first < self.k
            self.best = item[stay], score[stay], doc[stay]
            last = np.arange(len(item)) - first == self.k - 1
            self.floor[item[last]] = score[last]


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, terms): the distinct terms of each row of items (item_id, text), numbered by `item`."""

    def run(batches):
        for b in batches:
            found = [sorted(set(terms(t))) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["item"], b["item_id"], pa.array(found, pa.list_(pa.binary()))], ["item", "item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    numbered = items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    return stored(numbered.mapInArrow(run, f"item long, item_id {kind}, terms array<binary>"))


def postings(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc, n, ids, tfs) of each row with terms: its number of terms and, for those of the broadcast vocabulary (term: number), how often."""

    def run(batches):
        number = vocabulary.value
        for b in batches:
            ns, ids, tfs = [], [], []
            for t in b["text"].to_pylist():
                found = terms(t)
                own, times = np.unique(np.fromiter((number.get(x, -1) for x in found), np.int64, len(found)), return_counts=True)
                known = own >= 0
                ns.append(len(found))
                ids.append(own[known])
                tfs.append(times[known])
            yield pa.RecordBatch.from_arrays([b["doc"], pa.array(ns, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(tfs, pa.list_(pa.int64()))], ["doc", "n", "ids", "tfs"])

    numbered = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(HIGHEST))).alias("doc"), "text")
    return numbered.mapInArrow(run, "doc long, n long, ids array<long>, tfs array<long>").filter("n > 0")


def _best_of_lot(spark: SparkSession, docs: DataFrame, lot: DataFrame, k: int) -> DataFrame:
    """(item, doc, score): at least the k best documents for each item of a lot (item, terms), of bounded size."""
    found = lot.orderBy("item").toPandas()
    names = sorted({t for ts in found["terms"] for t in ts})
    number = {t: i for i, t in enumerate(names)}
    items = [np.fromiter((number[t] for t in ts), np.int64, len(ts)) for ts in found["terms"]]
    held = spark.sparkContext.broadcast(number)
    post = stored(postings(docs, held))
    n_docs, length = post.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.full(len(names), weight(n_docs, 0), np.int64)
    for term, df in post.select(F.explode("ids").alias("term")).groupBy("term").count().collect():  # a row for each term of the lot at most
        weights[term] = weight(n_docs, df)
    numbers = found["item"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast((items, weights, numbers))

    def run(batches):
        items, weights, numbers = shared.value
        tiles = Tiles(items, weights, k)
        for b in batches:
            ids, tfs = b["ids"], b["tfs"]
            starts = ids.offsets.to_numpy().astype(np.int64)
            n = np.repeat(b["n"].to_numpy(), np.diff(starts))
            values = ids.values.to_numpy()[starts[0] : starts[-1]]
            impact = impacts(tfs.values.to_numpy()[tfs.offsets[0].as_py() : tfs.offsets[-1].as_py()], n, n_docs, length)
            tiles.add(b["doc"].to_numpy(), starts - starts[0], values, impact)
        item, score, doc = tiles.best
        yield pa.RecordBatch.from_arrays([pa.array(numbers[item]), pa.array(doc), pa.array(score)], ["item", "doc", "score"])

    out = stored(post.mapInArrow(run, "item long, doc long, score long"))
    discard(post)
    held.destroy()
    shared.destroy()
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 50, most: int = 1_000_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) for each row of items (item_id, text), scores above 0 only.

    Terms are runs of ASCII letters, digits and all code points beyond ASCII, A-Z in lower case. Scores are whole numbers; equal ones go by
    doc_id, null ids last. Null texts have no term; rows that repeat an id are documents, or items, of their own. Items
    without terms, and those that no document matches, give no rows; so does an empty table on either side.
    Items go in lots of about `most` terms; a lot's vocabulary and items are collected and broadcast, and documents are scanned once for each lot.
    """
    spark = docs.sparkSession
    asked = item_terms(items)
    n = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    lots = max(1, -(-n // most))
    own = F.pmod(F.xxhash64("item"), F.lit(lots))
    found = None
    for lot in range(lots):
        best = _best_of_lot(spark, docs, asked.filter(own == lot).select("item", "terms"), k)
        found = best if found is None else found.unionByName(best)
    # Each task gave k rows for each item; parts of them are cut to k before an item's meet in one task.
    part = F.pmod(F.xxhash64("doc"), F.lit(64))
    order = [F.desc("score"), F.asc("doc")]
    near = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= k)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    doc = F.when(F.col("doc") != int(HIGHEST), F.col("doc")).cast(docs.schema["doc_id"].dataType)
    return best.join(asked.select("item", "item_id"), "item").select("item_id", "rank", doc.alias("doc_id"), "score")
