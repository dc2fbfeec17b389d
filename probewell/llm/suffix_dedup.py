"""Removal of repeated 400-byte strings with a logarithmic family of sparse suffix arrays.

A suffix is sampled where its first 128 bytes have the smallest hash of a 400-byte window. Which suffix a window picks depends
on the window's bytes alone, so equal windows pick equal suffixes at equal offsets, and no match of 400 bytes is missed.
A sparse suffix array is a table of sampled suffixes, range-partitioned and sorted by their first eight bytes and then by
the hash of their first 128, with equal ones as one entry. A new batch of documents becomes such a run; it is merge-scanned
with every level, neighbour against neighbour, for matches of 128 bytes, and levels of one size merge into the next.

Suffixes that meet another go on with their windows, in ranges of neighbouring offsets. A range's core is what all its windows
hold, its hull what they hold together. If a hull stands twice, all windows of the range do and are removed; if a core
stands once, none does; otherwise the range is split, down to single windows, along with one range for each removed hull
of the same core, as windows that are still open may be equal to one of its. Strings are counted by 128-bit BLAKE2b
digests of their bytes, across tasks, so it doesn't matter how many texts share a passage: nobody gathers them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probewell.llm.common import discard, marked, stored

PREFIX = 128
#: Numbers of neighbouring windows in a range, from the first look to the last.
WIDTHS = (64, 8, 1)
KEY = ["head", "hash"]
SEGMENT = 1 << 20
_random = np.random.default_rng(20240229)
BYTES = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse, modulo 2**64, to the powers 0 .. n-1 at least."""
    if len(_powers.get("up", ())) < n:
        for name, x in (("up", BASE), ("down", BACK)):
            p = np.full(n, x, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def substring_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of data[i:i+k] for each i."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * down[: len(data) - k + 1])


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of v[i:i+width] for each i, from running minima of blocks, forwards and backwards."""
    n = len(v) - width + 1
    full = np.full(-(-len(v) // width) * width, np.iinfo(v.dtype).max, v.dtype)
    full[: len(v)] = v
    blocks = full.reshape(-1, width)
    forth = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], forth[width - 1 : width - 1 + n])


def sample(data: np.ndarray, length: int, prefix: int = PREFIX) -> tuple[np.ndarray, ...]:
    """(positions, first, last, hashes) of the sampled suffixes; windows that start from first to last picked the suffix.

    Works through long texts in overlapping segments.
    """
    found = []
    width, low = length - prefix + 1, np.uint64(SEGMENT * 2 - 1)
    for at in range(0, len(data) - length + 1, SEGMENT):
        part = data[at : at + SEGMENT + length - 1]
        h = substring_hashes(part, prefix)
        # The low bits fall with the position: of equal hashes in a window the last one is picked.
        ranked = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
        least = sliding_min(ranked, width)
        pos = (low - (least & low)).astype(np.int64)
        first = np.flatnonzero(np.append(True, pos[1:] != pos[:-1]))
        last = np.append(first[1:], len(pos)) - 1
        found.append((pos[first] + at, first + at, last + at, h[pos[first]]))
    if not found:
        return (*(np.empty(0, np.int64),) * 3, np.empty(0, np.uint64))
    places, first, last, hashes = (np.concatenate(x) for x in zip(*found))
    new = np.flatnonzero(np.append(True, places[1:] != places[:-1]))  # one at the seam of two segments is there twice
    return places[new], first[new], last[np.append(new[1:], len(places)) - 1], hashes[new]


def heads(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first eight bytes of each suffix as signed integers of the same order."""
    first = np.ascontiguousarray(data[places[:, None] + np.arange(8)])
    return (first.view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def scanned(batches):
    """A sorted partition of entries (head, hash, n, new) with neighbours of equal head and hash made one, counts added up."""
    rest = None
    for b in batches:
        cols = [b[k].to_numpy() for k in (*KEY, "n", "new")]
        if rest is not None:
            cols = [np.concatenate([r, c]) for r, c in zip(rest, cols)]
        if not len(cols[0]):
            continue
        start = np.flatnonzero(np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])))
        cols = [cols[0][start], cols[1][start], np.add.reduceat(cols[2], start), np.add.reduceat(cols[3], start)]
        rest = [c[-1:] for c in cols]
        yield pa.RecordBatch.from_arrays([pa.array(c[:-1]) for c in cols], [*KEY, "n", "new"])
    if rest is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in rest], [*KEY, "n", "new"])


class SuffixIndexFamily:
    """Levels of sampled suffixes: level i is empty or the sparse suffix array of 2**i batches, a table (head, hash, n)."""

    def __init__(self):
        self.levels: list[DataFrame | None] = []

    @staticmethod
    def merge_scan(run: DataFrame, level: DataFrame) -> DataFrame:
        """Entries of both in suffix order; `new` counts what came by the run."""
        both = run.select(*KEY, "n", "new").unionByName(level.select(*KEY, "n", F.lit(0).cast("long").alias("new")))
        return both.repartitionByRange(*KEY).sortWithinPartitions(*KEY).mapInArrow(scanned, "head long, hash long, n long, new long")

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch (head, hash) of suffixes; returns (hash, n) for those in it that stand elsewhere in it or on a level.

        n counts the suffix in the batch and the levels that it was merged with.
        """
        counted = batch.groupBy(*KEY).agg(F.count("*").alias("n")).withColumn("new", F.col("n"))
        run = own = stored(counted.repartitionByRange(*KEY).sortWithinPartitions(*KEY))
        met, merging = [run.filter("n > 1")], True
        for i, level in enumerate(self.levels):
            if level is None:
                if merging:
                    self.levels[i], merging = run, False
                continue
            if merging:
                run = stored(self.merge_scan(run, level))
                self.levels[i] = None
                met.append(run.filter("new > 0 and n > new"))
            else:
                met.append(self.merge_scan(own, level).filter("new > 0 and n > new"))
        if merging:
            self.levels.append(run)
        found = met[0]
        for m in met[1:]:
            found = found.unionByName(m)
        return found.groupBy("hash").agg(F.max("n").alias("n"))


def ranges(data: bytes, place: int, lows: range, width: int, length: int):
    """(low, core, hull) for ranges of `width` offsets from each of lows on: digests, the hull's None where the text ends before.

    A window's offset is the number of its bytes before the suffix at `place`. Ranges without a window in the text are left out.
    """
    for low in lows:
        high = low + width - 1
        if low > place or high < place + length - len(data):
            continue
        tag = b"%d %d " % (low, width)
        hull = None
        if high <= place and low >= place + length - len(data):
            hull = hashlib.blake2b(tag + b"h" + data[place - high : place - low + length], digest_size=16).digest()
        yield low, hashlib.blake2b(tag + b"c" + data[place - low : place - high + length], digest_size=16).digest(), hull


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes in the union of the spans."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _data(text: str | None) -> bytes:
    return text.encode() if text else b""


def repeated_windows(texts: DataFrame, length: int) -> DataFrame:
    """(id, start, end) of ranges of repeated windows, by texts (id, text, todo): todo holds structs (place, low, high, known) of a
    suffix and the offsets of its windows; known ones stand for removed windows and are only there to be met."""
    kinds = "id binary, place int, low int, known int, core binary, hull binary"

    def looked_at(width: int):
        def run(batches):
            for b in batches:
                out = []
                for i, data, todo in zip(b["id"].to_pylist(), b["text"].to_pylist(), b["todo"].to_pylist()):
                    for x in todo:
                        lows = range(x["low"] // width * width, x["high"] + 1, width)
                        out += [(i, x["place"], low, x["known"], core, hull) for low, core, hull in ranges(data, x["place"], lows, width, length)]
                    if len(out) > 50_000:
                        yield batch_of(out, kinds)
                        out = []
                yield batch_of(out, kinds)

        return run

    spans, todo = None, texts
    for width in WIDTHS:
        looked = stored(todo.mapInArrow(looked_at(width), kinds))
        weight = (F.col("known") + 1).alias("n")  # a known one is there twice at least
        keys = looked.select(F.col("core").alias("key"), weight).unionByName(looked.filter("hull is not null").select(F.col("hull").alias("key"), weight))
        twice = stored(keys.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1"))
        found = marked(looked, twice, "core", "some").filter("some").drop("some")
        found = stored(marked(found, twice, "hull", "all"))
        done, open_ = found.filter("all"), found.filter("not all")
        own = done.filter("known = 0").select("id", (F.col("place") - F.col("low") - (width - 1)).cast("long").alias("start"), (F.col("place") - F.col("low") + length).cast("long").alias("end"))
        spans = own if spans is None else spans.unionByName(own)
        if width == 1:
            return spans
        met = stored(twice.join(open_.select(F.col("core").alias("key")).distinct(), "key", "left_semi"))
        known = done.groupBy("core", "hull").agg(F.min(F.struct("id", "place", "low")).alias("one")).select("core", "one.*")
        known = marked(known, met, "core", "open").filter("open")
        rows = open_.select("id", "place", "low", "known").unionByName(known.select("id", "place", "low", F.lit(1).alias("known")))
        need = rows.groupBy("id").agg(F.collect_list(F.struct("place", "low", (F.col("low") + width - 1).alias("high"), "known")).alias("todo"))
        todo = texts.select("id", "text").join(need, "id")
        discard(looked)


def batch_of(rows: list[tuple], kinds: str) -> pa.RecordBatch:
    """Rows as a batch of the columns that `kinds` names, as Spark writes a schema."""
    of = {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64()}
    names, types = zip(*(k.split() for k in kinds.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, of[k]) for c, k in zip(zip(*rows) if rows else [()] * len(names), types)], names)


def repeated_spans(docs: DataFrame, length: int = 400, batches: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of docs (doc_id, text), with equal texts as one entry: rows, texts, spans.

    rows: (doc_id, id, n_bytes, whole) for each row of docs, whole as the text's SHA-256. texts: (id, text) for texts that hold a
    sampled suffix found elsewhere. spans: (id, start, end), some overlapping, in bytes.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sampled(batches_):
        for b in batches_:
            whole, sizes, cols = [], [], ([], [], [], [], [])
            for t in b["text"].to_pylist():
                data = _data(t)
                whole.append(hashlib.sha256(data).digest())
                sizes.append(len(data))
                array = np.frombuffer(data, np.uint8)
                p, first, last, h = sample(array, length)
                for col, values in zip(cols, (p, p - last, p - first, heads(array, p) if len(p) else p, h.view(np.int64))):
                    col.append(values)
            kinds = (pa.int32(), pa.int16(), pa.int16(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(whole, pa.binary()), pa.array(sizes, pa.int64()), *(pa.array([x.astype(k.to_pandas_dtype()) for x in c], pa.list_(k)) for c, k in zip(cols, kinds))], ["doc_id", "whole", "n_bytes", "place", "low", "high", "head", "hash"])

    docs = docs.select("doc_id", "text")
    rows = stored(docs.mapInArrow(sampled, f"doc_id {kind}, whole binary, n_bytes long, place array<int>, low array<short>, high array<short>, head array<long>, hash array<long>"))
    rows = rows.withColumn("id", F.substring("whole", 1, 16))
    columns = ["place", "low", "high", "head", "hash"]
    once_each = rows.filter(F.size("hash") > 0).select("id", *columns).dropDuplicates(["id"])
    suffixes = stored(once_each.select("id", F.inline(F.arrays_zip(*columns))))
    family, found = SuffixIndexFamily(), []
    for i in range(batches):
        found.append(family.add(suffixes.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == i).select(*KEY)))
    met = found[0]
    for f in found[1:]:
        met = met.unionByName(f)
    # A suffix first met by a later batch is one for the earlier texts too: the join marks both sides.
    met = stored(met.groupBy(F.col("hash").alias("key")).agg(F.max("n").alias("n")))
    discard(*family.levels)
    many = marked(suffixes.drop("head"), met, "hash", "met").filter("met")
    need = many.groupBy("id").agg(F.collect_list(F.struct("place", F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high"), F.lit(0).alias("known"))).alias("todo"))

    def once(batches_):
        seen: set[bytes] = set()
        for b in batches_:
            texts = [_data(t) for t in b["text"].to_pylist()]
            ids = [hashlib.sha256(t).digest()[:16] for t in texts]
            new = [i for i, x in enumerate(ids) if len(texts[i]) >= length and not (x in seen or seen.add(x))]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in new], pa.binary()), pa.array([texts[i] for i in new], pa.binary())], ["id", "text"])

    texts = stored(docs.select("text").mapInArrow(once, "id binary, text binary").join(need, "id").dropDuplicates(["id"]))
    discard(suffixes, met)
    return rows.select("doc_id", "id", "n_bytes", "whole"), texts.select("id", "text"), repeated_windows(texts, length)


def remove_repeats(docs: DataFrame, length: int = 400, with_text: bool = False, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs (doc_id, text); kept bytes on request.

    Every byte is removed that a string of `length` bytes covers which also starts elsewhere, in the same document or another;
    repeated rows are documents of their own. Null text is empty. Ids may be null. An empty table gives no rows. Texts of
    equal bytes are handled once: if there are several and they are long enough, all of each is removed.
    """
    rows, texts, spans = repeated_spans(docs, length, **options)

    def cut(batches_):
        for b in batches_:
            out = []
            for i, data, s in zip(b["id"].to_pylist(), b["text"].to_pylist(), b["spans"].to_pylist()):
                runs = merge_spans([(x["start"], x["end"]) for x in s])
                kept = b"".join(data[e:f] for e, f in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(data)]))
                out.append((i, len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], ["id", "removed", "runs", "digest", "kept"])

    found = texts.join(spans.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "id").mapInArrow(cut, "id binary, removed long, runs long, digest string, kept binary")
    copies = rows.groupBy("id").agg((F.count("*") > 1).alias("copied"))
    out = rows.join(copies, "id").join(found, "id", "left")
    gone = F.col("copied") & (F.col("n_bytes") >= length)
    pick = lambda all_, some, none: F.when(gone, all_).otherwise(F.coalesce(some, none))
    out = out.select("doc_id", "n_bytes", pick(F.col("n_bytes"), F.col("removed"), F.lit(0)).cast("long").alias("n_removed"), pick(F.lit(1), F.col("runs"), F.lit(0)).cast("long").alias("n_spans"), pick(F.lit(hashlib.sha256().hexdigest()), F.col("digest"), F.lower(F.hex("whole"))).alias("kept_sha256"), *([F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_text else []))
    return out
