"""Spelling variants grouped by blocked Gram matrices of letter counts.

One inserted or deleted letter changes a word's letter counts by a squared distance of 1, a replaced one by 2 (or, with another word of
the same letters, by none, which is no single edit). So words go into blocks by their length and by how many of their letters fall
into each of a few classes, which one edit changes in at most two places. A block meets itself, the blocks of one letter more and those of a
letter moved between two classes. For two blocks NumPy gives all squared distances by one product of their count matrices; pairs
at most two apart are verified letter by letter. No pair leaves its task: it gives each word's number of near words
and its best one.
"""

from __future__ import annotations

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probewell.llm.common import discard, group_starts, stored, whole_groups

CLASSES = 5


def letter_runs(text: str, least: int) -> list[str]:
    """Maximal runs of at least `least` letters, A-Z in lower case."""
    return re.findall(f"[a-zÀ-ÿ]{{{least},}}", text.encode().lower().decode()) if text else []


def misspelt(doc_id, run: str, every: int) -> str:
    """The run, or the run less one letter where the checksum of document and run says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    at = h % len(run)
    return run[:at] + run[at + 1 :] if h % every == 0 else run


def words(docs: DataFrame, least: int, times: int, every: int) -> DataFrame:
    """(word, n): the distinct words of at least `least` letters that occur `times` times or more."""

    def run(batches):
        for b in batches:
            n = collections.Counter()
            for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                for r, k in collections.Counter(letter_runs(t, least)).items():
                    n[misspelt(d, r, every)] += k
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    counts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter((F.col("n") >= times) & (F.length("word") >= least))


def _cells(batches):
    """Adds to (word, n) the cell: how many letters of each class a word has, as text."""
    for b in batches:
        found = []
        for w in b["word"].to_pylist():
            n = np.bincount(np.frombuffer(w.encode("utf-32-le"), np.uint32) % CLASSES, minlength=CLASSES)
            found.append(",".join(map(str, n)))
        yield pa.RecordBatch.from_arrays([b["word"], b["n"], pa.array(found, pa.string())], ["word", "n", "cell"])


def _neighbours(batches):
    """(a, b): each cell with itself, with those of one letter more, and with the later ones that differ by a moved letter."""
    for batch in batches:
        a, b = [], []
        for c in batch["cell"].to_pylist():
            n = list(map(int, c.split(",")))
            for i in range(CLASSES):
                n[i] += 1
                a.append(c)
                b.append(",".join(map(str, n)))
                for j in range(CLASSES):
                    if n[j]:
                        n[j] -= 1
                        if n >= list(map(int, c.split(","))) and (i != j or i == 0):  # itself once
                            a.append(c)
                            b.append(",".join(map(str, n)))
                        n[j] += 1
                n[i] -= 1
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])


def letters_of(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of code points, padded with 0, and their lengths."""
    size = np.fromiter(map(len, found), np.int64, len(found))
    out = np.zeros((len(found), int(size.max(initial=0))), np.uint32)
    flat = np.frombuffer("".join(found).encode("utf-32-le"), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out, size


def near_pairs(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, lot: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of words of x and of y one edit apart; the words of y are as long as those of x, or all longer by one letter."""
    letters = np.unique(np.concatenate([np.unique(x), np.unique(y)]))
    letters = letters[letters > 0]
    counts = []
    for words_, n in ((x, nx), (y, ny)):
        at = np.searchsorted(letters, words_) + np.arange(len(words_))[:, None] * len(letters)
        inside = np.arange(words_.shape[1]) < n[:, None]
        counts.append(np.bincount(at[inside], minlength=len(words_) * len(letters)).reshape(len(words_), len(letters)).astype(np.float64))
    a, b = counts
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    same = nx[0] == ny[0]
    i, j = np.nonzero(square == 2 if same else square == 1)
    ok = np.zeros(len(i), bool)
    for lo in range(0, len(i), lot):
        p, q = x[i[lo : lo + lot]], y[j[lo : lo + lot]]
        if same:
            ok[lo : lo + lot] = (p != q).sum(axis=1) == 1
        else:
            # One letter more: the letters equal from the start and those equal from the end make up the shorter word.
            head = np.cumprod(p == q[:, : p.shape[1]], axis=1).sum(axis=1)
            tail = np.cumprod((p == q[:, 1:])[:, ::-1], axis=1).sum(axis=1)
            ok[lo : lo + lot] = head + tail >= p.shape[1]
    return i[ok], j[ok]


def _compare(batches):
    """(word, near, best_n, best): for each word of a pair of blocks its near words in the other."""
    keys = ["a", "b", "i", "j"]
    for table in whole_groups(batches, keys):
        starts = group_starts(table, keys)
        ends = np.append(starts[1:], table.num_rows)
        out = ([], [], [], [])
        for lo, hi in zip(starts, ends):
            side = table["side"][lo:hi].to_numpy()
            group = table["word"][lo:hi].to_pylist()
            n = table["n"][lo:hi].to_numpy()
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            itself = len(right) == 0 and table["a"][lo].as_py() == table["b"][lo].as_py() and table["i"][lo].as_py() == table["j"][lo].as_py()
            if itself:
                right = left
            if not len(left) or not len(right):
                continue
            x, nx = letters_of([group[k] for k in left])
            y, ny = (x, nx) if itself else letters_of([group[k] for k in right])
            p, q = near_pairs(x, nx, y, ny)
            p, q = left[p], right[q]
            if not itself:
                p, q = np.concatenate([p, q]), np.concatenate([q, p])
            if not len(p):
                continue
            order = np.argsort(np.array(group, dtype=object), kind="stable")
            rank = np.empty(len(group), np.int64)
            rank[order] = np.arange(len(group))  # code-point order
            at = np.lexsort((rank[q], -n[q], p))
            p, q = p[at], q[at]
            first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            out[0].extend(group[k] for k in p[first])
            out[1].extend(np.diff(np.append(first, len(p))).tolist())
            out[2].extend(n[q[first]].tolist())
            out[3].extend(group[k] for k in q[first])
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], ["word", "near", "best_n", "best"])


def near_words(vocabulary: DataFrame, block: int = 2048, letters: int = 1 << 18) -> DataFrame:
    """(word, n_near, best_n, best) for each word of vocabulary (word, n; distinct, stored) that has words one edit away: how many, and of these
    the one of largest n, ties to the smaller in code-point order. Empty words have no cell of their own size and take part like others.

    A cell is dealt in blocks of `block` words, fewer where words are long, so that a pair of blocks is bounded whatever a cell's size.
    """
    held = stored(vocabulary.select("word", "n").mapInArrow(_cells, "word string, n long, cell string"))
    rows = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(letters / F.greatest(F.lit(1), F.max(F.length("word"))))))
    cells = stored(held.groupBy("cell").agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks")))
    pairs = cells.select("cell").mapInArrow(_neighbours, "a string, b string").distinct()
    size = lambda c: cells.select(F.col("cell").alias(c), F.col("blocks").alias(f"n{c}"))
    pairs = stored(pairs.join(size("a"), "a").join(size("b"), "b"))
    own = held.join(cells, "cell").withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")).drop("blocks")
    upto = lambda lo, hi: F.explode(F.sequence(lo, hi))
    same = F.col("a") == F.col("b")
    left = own.withColumnRenamed("cell", "a").join(pairs, "a").withColumnRenamed("own", "i").withColumn("j", upto(F.when(same, F.col("i")).otherwise(0), F.col("nb") - 1))
    right = own.withColumnRenamed("cell", "b").join(pairs, "b").withColumnRenamed("own", "j")
    # A cell met with itself: block j is the right side of the blocks before it, and alone with itself.
    right = right.filter(~same | (F.col("j") > 0)).withColumn("i", upto(F.lit(0), F.when(same, F.col("j") - 1).otherwise(F.col("na") - 1)))
    keys = ["a", "b", "i", "j"]
    both = left.select(*keys, F.lit(0).alias("side"), "word", "n").unionByName(right.select(*keys, F.lit(1).alias("side"), "word", "n"))
    found = both.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word")))
    out = stored(found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")))
    discard(held, cells, pairs)
    return out.select("word", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form of each word of forms (word, form), by doubling of steps; a form is more frequent than its word, so
    there are no circles."""
    steps = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        then = steps.select(F.col("word").alias("root"), F.col("root").alias("then"))
        joined = stored(steps.join(then, "root", "left").select("word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")))
        discard(steps)
        steps = joined.select("word", "root")
        steps.stored_at = joined.stored_at
        if joined.filter("moved").isEmpty():
            return steps


def variants(docs: DataFrame, least: int = 6, times: int = 5, factor: int = 5, every: int = 199) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of docs (doc_id, text).

    Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, some less one letter by `misspelt`, of at least
    `least` code points and `times` occurrences. The form is the near word (one letter inserted, deleted or replaced) of
    largest n, if that is at least `factor` times the word's; the root is the last of the forms. Null texts have no
    words; each row is a text, so repeated rows count again; a null id is written as nothing in the checksum. An empty table gives no rows.
    """
    vocabulary = stored(words(docs, least, times, every))
    near = near_words(vocabulary)
    found = vocabulary.join(near, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    is_form = F.col("best_n") >= factor * F.col("n")
    found = stored(found.select("word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    last = roots(found.filter("form is not null").select("word", "form"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
