"""Embedding near-dedup by lattice hashing.

A table projects unit vectors at random to two times eight dimensions and decodes each eight to the nearest point of the E8
lattice; the two points name the vector's cell. Besides its own cell a vector probes those of the nearest neighbouring
points, one lattice at a time. Two vectors are a candidate pair if one's own cell is among the other's cells in any
table; a pair is a link if its cosine, in double precision, reaches the threshold.

Measured on random pairs at a cosine of exactly 0.95: a table finds 53 % of them, six tables 98.9 %; at 0.97 over 99.9 %.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probewell.llm.common import components, group_starts, ragged_arange, smallest_labels, stored, whole_groups

KEYS = ["table", "cell", "lo", "hi"]


@functools.lru_cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    two = [[(i == a) * p + (i == b) * q for i in range(8)] for a, b in itertools.combinations(range(8), 2) for p in (1, -1) for q in (1, -1)]
    half = [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array([*two, *half], float)


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """The nearest E8 point: integers with an even sum, or the same moved by one half, whichever is closer."""

    def even(v):
        r = np.rint(v)
        off, rows = v - r, np.arange(len(v))
        worst = np.abs(off).argmax(axis=1)
        odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) & 1)
        r[rows[odd], worst[odd]] += np.where(off[odd, worst[odd]] >= 0, 1.0, -1.0)
        return r

    a, b = even(y), even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


@functools.lru_cache(maxsize=64)
def projection(dims: int, table: int) -> np.ndarray:
    """Sixteen orthonormal directions, scaled so that a unit vector's projection has a deviation of half a lattice step."""
    wide = max(dims, 16)
    q = np.linalg.qr(np.random.default_rng((977, dims, table)).normal(size=(wide, wide)))[0]
    return q[:dims, :16] * (np.sqrt(wide) / 2)


_WEIGHTS = np.random.default_rng(31).integers(1, 1 << 62, 16, dtype=np.int64) | 1


def cells(unit: np.ndarray, table: int, probes: int) -> np.ndarray:
    """For each row its cell, then the 2 * probes cells that it probes, as 64-bit hashes."""
    y = unit @ projection(unit.shape[1], table)
    points, near = [], []
    for part in (y[:, :8], y[:, 8:]):
        p = nearest_e8(part)
        # The closest neighbouring points are those along the residual.
        near.append(np.argsort(-((part - p) @ neighbours().T), axis=1, kind="stable")[:, :probes])
        points.append(p)
    with np.errstate(over="ignore"):
        own = [(2 * p).astype(np.int64) @ w for p, w in zip(points, (_WEIGHTS[:8], _WEIGHTS[8:]))]
        step = [(2 * neighbours()).astype(np.int64) @ w for w in (_WEIGHTS[:8], _WEIGHTS[8:])]
        home = own[0] + own[1]
        return np.column_stack([home, *(home[:, None] + s[n] for s, n in zip(step, near))])


def units(vectors: pa.Array, dims: int, dtype) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors.to_pylist()), dtype).reshape(-1, dims).astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _first_meeting(x: np.ndarray, a: np.ndarray, b: np.ndarray, table: np.ndarray, cell: np.ndarray, tables: int, probes: int) -> np.ndarray:
    """Whether (table, cell) is the first place at which the rows a and b of x meet."""
    rows, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = inverse[: len(a)], inverse[len(a) :]
    first = np.ones(len(a), bool)
    for t in range(tables):
        c = cells(x[rows], t, probes)
        own_a, own_b = c[a, 0], c[b, 0]
        a_at_b, b_at_a = (c[a, 1:] == own_b[:, None]).any(axis=1), (c[b, 1:] == own_a[:, None]).any(axis=1)
        met = (own_a == own_b) | a_at_b | b_at_a
        first &= (table <= t) | ~met
        # Two cells of one table hold the pair: the smaller counts.
        first &= (table != t) | ~(a_at_b & b_at_a & (own_a != own_b)) | (cell == np.minimum(own_a, own_b))
    return first


def links(table: pa.Table, threshold: float, tables: int, probes: int, dims: int, dtype) -> pa.RecordBatch:
    """(cid, root, links): links is the weight of new links of cid; root, where not null, is joined to cid by links."""
    start = group_starts(table, KEYS)
    sizes = np.diff(np.append(start, table.num_rows))
    keep = np.repeat(sizes > 1, sizes)
    table = table.filter(pa.array(keep))
    sizes = sizes[sizes > 1]
    start = np.cumsum(sizes) - sizes
    x = units(table["vector"], dims, dtype)
    cid, weight, home, t, cell, block, lo, hi = (table[k].to_numpy() for k in ("cid", "n", "home", "table", "cell", "block", "lo", "hi"))
    out = []

    def pairs(a, b):
        ok = (home[a] | home[b]) & ((lo[a] == hi[a]) | (block[a] != block[b])) & (cid[a] != cid[b])
        a, b = a[ok], b[ok]
        near = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
        return a[near], b[near]

    def add(a, b):
        if not len(a):
            return
        new = _first_meeting(x, a, b, t[a], cell[a], tables, probes)
        both, other = np.concatenate([a[new], b[new]]), np.concatenate([b[new], a[new]])
        n = np.bincount(both, weights=weight[other], minlength=len(x))
        at = np.flatnonzero(n)
        out.append((cid[at], np.full(len(at), -1), n[at].astype(np.int64)))
        rows, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = smallest_labels(len(rows), inverse[: len(a)], inverse[len(a) :])
        at = np.flatnonzero(label != np.arange(len(rows)))
        out.append((cid[rows[at]], cid[rows[label[at]]], np.zeros(len(at), np.int64)))

    small = sizes <= 64
    s, f = sizes[small], start[small]
    lots = np.cumsum(s.astype(float) ** 2) // 200_000
    for i, j in itertools.pairwise([0, *(np.flatnonzero(np.diff(lots)) + 1), len(s)]) if len(s) else []:
        square = s[i:j] ** 2
        nth, of = ragged_arange(square), np.repeat(np.arange(i, j), square)
        a, b = nth // s[of], nth % s[of]
        once = a < b
        add(*pairs(f[of[once]] + a[once], f[of[once]] + b[once]))
    for n, at in zip(sizes[~small], start[~small]):
        for i in range(0, n, 512):  # a strip of the group against what stands after its start
            near = x[at + i : at + min(n, i + 512)] @ x[at + i : at + n].T >= threshold - 1e-9
            a, b = np.nonzero(np.triu(near, 1))
            add(*pairs(at + i + a, at + i + b))
    cols = [np.concatenate(c) if out else np.empty(0, np.int64) for c in (zip(*out) if out else [()] * 3)]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64(), mask=cols[1] < 0), pa.array(cols[2], pa.int64())], ["cid", "root", "links"])


def class_links(classes: DataFrame, dims: int, threshold: float, tables: int, probes: int, block: int) -> DataFrame:
    """links() of all classes (cid, n, embedding) whose vectors have `dims` components."""
    dtype = "<f4" if "float" in classes.schema["embedding"].dataType.simpleString() else "<f8"
    classes = classes.filter(F.size("embedding") == dims)

    def emit(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = b["embedding"].flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, dims)
            vectors = pa.array([r.tobytes() for r in v], pa.binary())
            x = units(vectors, dims, dtype)
            for t in range(tables):
                c = cells(x, t, probes)
                for p in range(c.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(c[:, p]), b["cid"], b["n"], pa.array(np.full(len(x), p == 0)), vectors], ["table", "cell", "cid", "n", "home", "vector"])

    rows = classes.select("cid", "n", "embedding").mapInArrow(emit, "table int, cell long, cid long, n long, home boolean, vector binary")
    large = stored(rows.groupBy("table", "cell").agg(F.count("*").alias("_n")).filter(F.col("_n") > block).select("table", "cell", F.ceil(F.col("_n") / block).cast("int").alias("k")))
    rows = rows.join(large, ["table", "cell"], "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("k")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("table", "cell", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "cid", "n", "home", "vector")
    rows = rows.repartition(*KEYS).sortWithinPartitions(*KEYS)

    def meet(batches):
        for table in whole_groups(batches, KEYS):
            yield links(table, threshold, tables, probes, dims, dtype)

    return rows.mapInArrow(meet, "cid long, root long, links long")


def near_vectors(vectors: DataFrame, threshold: float = 0.95, tables: int = 6, probes: int = 2, block: int = 2048) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding).

    Vectors that are null, empty, all zero or hold null or non-finite components link with nothing, and vectors of unequal length
    don't link. Equal vectors are one class with a weight, so copies are counted, not compared. A repeated row is a vector of
    its own. A null vec_id counts as a link of others, and is a component's id only if there is no other; its row isn't
    kept. An empty table gives no rows. A cell of over `block` entries is dealt as pairs of blocks.
    """
    e = F.col("embedding")
    sound = F.coalesce((F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(sound, e).alias("embedding"))
    classes = rows.filter("embedding is not null").groupBy("embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()))
    lengths = [r[0] for r in classes.select(F.size("embedding")).distinct().collect()]  # of vectors: a handful at most
    found = None
    for dims in lengths:
        part = class_links(classes, dims, threshold, tables, probes, block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = stored(found)
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.filter("root is not null").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = classes.join(counts, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    named = named.withColumn("n_links", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("embedding", "n_links", "component_id")
    out = rows.join(named, "embedding", "left")
    of = F.when(F.col("embedding").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), of.alias("component_id"), F.coalesce(F.col("vec_id") == of, F.lit(False)).alias("kept"))
