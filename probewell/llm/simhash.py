"""SimHash near-dedup with Gray-order hierarchical indices.

Fingerprints at most four bits apart agree on two of six segments of their 64 bits, whichever bits differ. So there are
fifteen indices, one for each pair of segments, and the top nodes of an index are the patterns of its two segments: groups
that share one have no difference there yet. Below a top node the fingerprints stand in Gray order, in which neighbours
differ in few bits; runs of eight form a node, runs of eight nodes the next, and each node holds the bits that all its members
share. A self-join walks pairs of nodes down the levels, adds the differences in the bits that are new at each
level, and drops a pair of groups as soon as the sum is over the limit.

Spark deals the top nodes to tasks. Equal fingerprints are one entry. A top node with many entries is dealt as
pairs of blocks. A task gives no pairs, but a spanning star for each component that it sees.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probewell.llm.common import components, discard, group_starts, ragged_arange, smallest_labels, stored, whole_groups

FAN = 8
#: First bits and widths of the six segments.
SEGMENTS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []  # both touch ASCII letters and white space only


def shingle_hashes(words: list[bytes], shingle: int, seed: int):
    """The 64-bit hashes of all word shingles, repeats included, in lots of 100,000. Fewer words than a shingle make one."""
    data, n = b" ".join(words), max(1, len(words) - shingle + 1) if words else 0
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[:n].tolist(), ends[len(ends) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 100_000):
        yield np.array([digest(data[a:b], seed) for a, b in zip(starts[at : at + 100_000], ends[at : at + 100_000])], np.uint64)


def majority(lots, n: int) -> int:
    """Bits that are set in over half of n hashes."""
    ones = np.zeros(64, np.int64)
    for h in lots:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 if there is no word."""
    words = words_of(text)
    return majority(shingle_hashes(words, shingle, seed), max(1, len(words) - shingle + 1)) if words else 0


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) with fp as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in b["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def gray_rank(v: np.ndarray) -> np.ndarray:
    """Position of each value in the reflected Gray code."""
    v = v.copy()
    for k in (1, 2, 4, 8, 16, 32):
        v ^= v >> np.uint64(k)
    return v


def near_in_groups(fp: np.ndarray, starts: np.ndarray, limit: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at most `limit` bits apart within each group; fp is in Gray order within groups that start at `starts`."""
    sizes = np.diff(np.append(starts, len(fp)))
    all_and, all_or, child_at, levels = fp, fp, None, []
    while True:
        levels.append((all_and, ~(all_and ^ all_or), child_at))  # pattern, shared bits, where a node's children start
        if (sizes <= 1).all():
            break
        parents = -(-sizes // FAN)
        first = np.repeat(np.cumsum(sizes) - sizes, parents) + FAN * ragged_arange(parents)
        child_at = np.append(first, len(all_and))
        all_and, all_or, sizes = np.bitwise_and.reduceat(all_and, first), np.bitwise_or.reduceat(all_or, first), parents
    # The roots: one node for each group, joined with itself.
    a = b = np.arange(len(levels[-1][0]))
    shared, sum_ = levels[-1][1], np.zeros(len(a), np.int64)
    for k in range(len(levels) - 2, -1, -1):
        child_at = levels[k + 1][2]
        na, nb = child_at[a + 1] - child_at[a], child_at[b + 1] - child_at[b]
        pair, nth = np.repeat(np.arange(len(a)), na * nb), ragged_arange(na * nb)
        ca, cb = child_at[a][pair] + nth // nb[pair], child_at[b][pair] + nth % nb[pair]
        once = (ca < cb) if k == 0 else (ca <= cb)
        ca, cb, pair = ca[once], cb[once], pair[once]
        pattern, bits, _ = levels[k]
        both = bits[ca] & bits[cb]
        sum_ = sum_[pair] + np.bitwise_count((pattern[ca] ^ pattern[cb]) & both & ~shared[pair])
        near = sum_ <= limit
        a, b, shared, sum_ = ca[near], cb[near], both[near], sum_[near]
    return (a, b) if len(levels) > 1 else (a[:0], b[:0])


def star_edges(table: pa.Table, keys: list[str], limit: int) -> pa.RecordBatch:
    """Edges (a, b) from the smallest-numbered member of each component to the others, group by group."""
    start = group_starts(table, keys)
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, table.num_rows)))
    fp = table["fp"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.lexsort((gray_rank(fp), group))
    fp, sizes = fp[order], np.bincount(group)
    out_a, out_b = [], []
    # Groups go in lots, so that the pairs of nodes of a level stay within some millions.
    lot = np.cumsum(sizes.astype(np.float64) ** 2) // 4e6
    for lo, hi in itertools.pairwise([0, *(np.flatnonzero(np.diff(lot)) + 1), len(sizes)]):
        s = start[lo:hi]
        part = fp[s[0] : start[hi] if hi < len(start) else len(fp)]
        a, b = near_in_groups(part, s - s[0], limit)
        root = smallest_labels(len(part), a, b)
        at = np.flatnonzero(root != np.arange(len(part)))
        out_a.append(part[root[at]].view(np.int64))
        out_b.append(part[at].view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_a, out_b)], ["a", "b"])


def near_edges(fps: DataFrame, limit: int = 4, block: int = 1024) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fps (fp), whose components are those of all pairs within the limit.

    limit is 4 at most: more differing bits could touch all but one of the six segments. Top nodes of over `block`
    entries are dealt as pairs of random blocks.
    """
    if not 0 <= limit <= 4:
        raise ValueError("the six segments prove two to be equal for limits up to 4 only")
    masks = [((1 << SEGMENTS[i][1]) - 1) << SEGMENTS[i][0] | ((1 << SEGMENTS[j][1]) - 1) << SEGMENTS[j][0] for i, j in itertools.combinations(range(6), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tops = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("index", "top"))
    large = tops.groupBy("index", "top").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    rows = tops.join(large, ["index", "top"], "left").withColumn("k", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda x: x != F.col("own")))))
    keys = ["index", "top", "lo", "hi"]
    rows = rows.select("index", "top", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        for table in whole_groups(batches, keys):
            yield star_edges(table, keys, limit)

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, limit: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text).

    component_id is the smallest doc_id whose fingerprint is reachable by steps of at most `limit` bits. Null and empty
    texts have fingerprint 0 and link like any other. Null ids are never a component's id, unless it has no other;
    repeated rows are rows of their own. An empty table gives no rows.
    """
    rows = stored(fingerprints(docs, shingle, seed))
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_edges(nodes.select("fp"), limit))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Odd multipliers that make further hashes of a shingle from its first one.
_MORE = np.random.default_rng(64).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's word shingles."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(words_of(text), shingle, seed)]))


def mixed_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Further hash number n of a set of shingles."""
    h = hashes * _MORE[n]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band: of the least values of `rows` hashes over the set."""
    least = np.array([mixed_hashes(hashes, i).min() for i in range(bands * rows)], np.uint64).reshape(bands, rows)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least)], np.uint64).view(np.int64)


def simhash_pairs(classes: DataFrame, limit: int) -> DataFrame:
    """(a, b): pairs of classes (cid, fp) with equal fingerprints, or with ones that the index puts into one component; the smaller one first."""
    own = stored(classes.select("cid", "fp"))
    nodes = stored(own.groupBy("fp").agg(F.min("cid").alias("first")))
    near = near_edges(nodes.select("fp"), limit).distinct()
    near = near.join(nodes.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(nodes.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    same = own.join(nodes, "fp").filter("cid <> first")
    both = near.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(same.select(F.col("first").alias("a"), F.col("cid").alias("b")))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole sets (cid, shingles) reach the similarity, stored. A set that stands in many pairs is split among tasks at run time."""
    both = pairs.join(sets.select(F.col("cid").alias("b"), "shingles"), "b").join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("held")), "a")
    common = F.size(F.array_intersect("shingles", "held"))
    return stored(both.filter(common >= similarity * (F.size("shingles") + F.size("held") - common)).select("a", "b"))


def unlinked_pairs(rows: DataFrame, block: int = 1024) -> DataFrame:
    """(a, b): all pairs of rows (band, key, cid, root) of a bucket whose roots differ, the smaller cid first. Large buckets are dealt as blocks.
    Quadratic in a bucket's classes: what rare_pairs() is held against."""
    split = rows.groupBy("band", "key").agg(F.count_distinct("root").alias("roots"), F.ceil(F.count("*") / block).cast("int").alias("blocks")).filter("roots > 1")
    rows = stored(rows.join(split.drop("roots"), ["band", "key"]))
    one = rows.select("band", "key", F.col("cid").alias("a"), F.col("root").alias("x"), F.pmod(F.xxhash64("cid"), "blocks").cast("int").alias("nth"))
    other = rows.select("band", "key", F.col("cid").alias("b"), F.col("root").alias("y"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("nth"))
    return one.join(other, ["band", "key", "nth"]).filter("a < b and x <> y").select("a", "b").distinct()


def rare_pairs(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of rows (band, key, cid, root) of buckets that hold several roots, which have different roots and can reach the similarity; the
    smaller cid first.

    The hashes of a set (cid, shingles) are ordered from the rarest on. Two sets of n and m hashes that reach the similarity t have c = t (n + m) / (1 + t)
    in common at least, so one of those is among the first n - c + 1 of the one and the first m - c + 1 of the other. Only such pairs are given:
    classes that have the frequent part of a bucket in common and differ too much in the rest don't meet.
    """
    several = rows.groupBy("band", "key").agg(F.count_distinct("root").alias("roots")).filter("roots > 1")
    of = rows.join(several, ["band", "key"], "left_semi").select("cid", "root").distinct()
    held = stored(sets.join(of, "cid").select("cid", "root", F.size("shingles").alias("size"), F.explode("shingles").alias("h")))
    often = held.groupBy("h").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("cid").orderBy("often", "h"))
    most = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1
    first = stored(held.join(often, "h").withColumn("place", place).filter((F.col("place") <= most) & (F.col("often") > 1)))
    one, other = (first.select("h", F.col("cid").alias(c), F.col("root").alias(r), F.col("size").alias(n), F.col("place").alias(p)) for c, r, n, p in (("a", "x", "n", "p"), ("b", "y", "m", "q")))
    common = F.ceil((F.col("n") + F.col("m")) * (similarity / (1 + similarity)) - 1e-9)
    near = (F.col("p") <= F.col("n") - common + 1) & (F.col("q") <= F.col("m") - common + 1)
    return one.join(other, (one["h"] == other["h"]) & F.expr("a < b and x <> y") & near).select("a", "b").distinct()


def groups_of(classes: DataFrame, sets_of, similarity: float, limit: int, small: int = 24, rounds: int = 4) -> DataFrame:
    """(node, root): the class that each of classes (cid, fp, bands) is linked to by steps, if it isn't that class itself; root is the smallest cid.

    Candidates share a fingerprint component or a band. In a bucket of up to `small` classes all pairs are compared. A larger one compares
    all with one of them, its head; while some of it aren't of the head's group, one class of each group is compared with a new
    head, in at most `rounds` rounds; then those of other groups are looked up by their rarest shingles, so no partner is dropped.
    Pairs are verified by their whole sets; sets_of (classes) gives those (cid, shingles).
    """
    rows = stored(classes.select("cid", F.posexplode("bands").alias("band", "key")))
    full = rows.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("cid").alias("head")).filter("n > 1")
    buckets = stored(rows.join(full, ["band", "key"]))
    few = buckets.filter(F.col("n") <= small)
    all_pairs = few.select("band", "key", F.col("cid").alias("a")).join(few.select("band", "key", F.col("cid").alias("b")), ["band", "key"]).filter("a < b").select("a", "b")
    many = buckets.filter(F.col("n") > small)
    stars = many.filter("cid <> head").select(F.col("head").alias("a"), F.col("cid").alias("b"))
    pairs = stored(all_pairs.unionByName(stars).unionByName(simhash_pairs(classes, limit)).distinct())
    wanted = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    sets = stored(sets_of(wanted))
    links = linked(pairs, sets, similarity)
    found = components(links)
    large = stored(many.select("band", "key", "cid"))
    discard(rows, buckets)
    if large.isEmpty():
        return found
    grouped = lambda: large.join(found.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    for n in range(rounds):
        known = grouped()
        # One class of each group in a bucket, another one in each round.
        pick = F.min_by("cid", F.xxhash64("cid", F.lit(n)))
        one = known.groupBy("band", "key", "root").agg(pick.alias("cid"))
        heads = one.groupBy("band", "key").agg(F.min_by("cid", F.xxhash64("root", F.lit(n))).alias("head"), F.count("*").alias("n")).filter("n > 1")
        open_ = stored(one.join(heads, ["band", "key"]).filter("cid <> head").select(F.least("cid", "head").alias("a"), F.greatest("cid", "head").alias("b")).distinct())
        if open_.isEmpty():
            break
        more = linked(open_, sets, similarity)
        if more.isEmpty():
            continue
        links = links.unionByName(more)
        found = components(links)
    more = linked(stored(rare_pairs(grouped(), sets, similarity)), sets, similarity)
    return found if more.isEmpty() else components(links.unionByName(more))


def deduplicate(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, limit: int = 4, bands: int = 12, rows_per_band: int = 5) -> DataFrame:
    """The rows of docs less those that repeat another one: equal words, or a Jaccard similarity of at least `similarity` between the sets of
    their shingles. Of rows that are linked so, by steps, one stays.

    Texts of equal words (white space and the case of A-Z don't count) are a class, of which the row with the smallest doc_id stays, as it
    does of a group of classes; null ids come last, then the number that the row got when it was read. Two classes are compared
    if their SimHashes are at most `limit` bits apart, also by steps, or one of `bands` hashes of `rows_per_band` least values is equal:
    at a similarity of 0.8 that is so for 99 of 100 pairs, at which SimHash alone finds few. The similarity is then computed from the
    whole sets, so nothing goes that is less similar to all others. Texts without words, null ones among them, are one class. Rows
    that repeat a doc_id with other texts are documents of their own. Extra columns stay; an empty table gives no rows. Columns are
    those of docs.
    """
    numbered = stored(docs.withColumn("_dedup_row", F.monotonically_increasing_id()))

    def prints_of(batches):
        for b in batches:
            rows = []
            for t in b["text"].to_pylist():
                words = words_of(t)
                h = shingle_set(t, shingle)
                fp = np.array([majority([h], len(h)) if words else 0], np.uint64).view(np.int64)[0]
                rows.append((hashlib.blake2b(b" ".join(words), digest_size=16).digest(), fp, band_keys(h, bands, rows_per_band) if words else np.zeros(bands, np.int64)))
            same, fps, keys = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b["_dedup_row"], b["doc_id"], pa.array(same, pa.binary()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["_dedup_row", "doc_id", "same", "fp", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(numbered.select("_dedup_row", "doc_id", "text").mapInArrow(prints_of, f"_dedup_row long, doc_id {kind}, same binary, fp long, bands array<long>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "_dedup_row"))
    classes = rows.groupBy("same").agg(first.alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    # Numbered in the order of their first rows, so that the smallest cid of a component is the smallest doc_id.
    classes = stored(classes.repartitionByRange("first").sortWithinPartitions("first").withColumn("cid", F.monotonically_increasing_id()).select("cid", F.col("first._dedup_row").alias("_dedup_row"), "fp", "bands"))

    def sets_of(batches):
        for b in batches:
            sets = [shingle_set(t, shingle).view(np.int64) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["cid"], pa.array(sets, pa.list_(pa.int64()))], ["cid", "shingles"])

    def sets(wanted: DataFrame) -> DataFrame:
        of = classes.join(wanted, "cid", "left_semi").select("cid", "_dedup_row")
        return numbered.select("_dedup_row", "text").join(of, "_dedup_row").select("cid", "text").mapInArrow(sets_of, "cid long, shingles array<long>")

    found = groups_of(classes, sets, similarity, limit)
    stay = classes.join(found.select(F.col("node").alias("cid")), "cid", "left_anti").select("_dedup_row")
    return numbered.join(stay, "_dedup_row", "left_semi").select(*docs.columns)
