"""Embedding near-duplicates by Euclidean p-stable hashing with exact cosine checks.

Vectors are normalised; a table's key combines quantised Gaussian projections floor((a.x + b) / width), so vectors at
a small Euclidean distance (a high cosine) often share a key. Every pair that shares a key in any of the tables, and
whose 64-bit sign sketches are as near as such a pair's are, is checked in double precision. The number of
projections grows with the logarithm of the number of vectors, so that unrelated vectors stay rare in a bucket, and
the number of tables with it, so that a pair at the threshold is found with the same probability (`RECALL`) at
every size. Slots of 24 bytes are shuffled for every vector and table; vectors travel only where a sketch calls for a
check. Identical vectors are collapsed first, so copies cost one row however many there are.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import acos, ceil, comb, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.arrow import grouped
from rasterloom.llm.common import cut, discard, small_batches, table
from rasterloom.operators.components import connected_components

THRESHOLD = 0.95
#: Chance that some table holds a pair of exactly the threshold's cosine; nearer pairs are found more often.
RECALL = 0.99
#: Unrelated vectors that a bucket holds for each of its own, about.
MATES = 512
WIDTH = 2.0
SEED = 7
#: Chance that the sketches of a pair of exactly the threshold's cosine differ in too many bits.
SKETCH_MISS = 1e-3
#: Rows of a bucket that one block holds; a larger bucket becomes pairs of blocks.
BLOCK = 1024
#: Projections and components in fixed point: their products and sums are exact doubles, so that a vector has the same keys wherever they are computed.
FINE_X, FINE_A = 1 << 20, 1 << 10


def same_cell(distance: float, width: float) -> float:
    """Chance that one quantised Gaussian projection puts two points at this distance into one cell."""
    c = width / distance
    return erf(c / sqrt(2)) - 2 / (sqrt(2 * pi) * c) * (1 - exp(-c * c / 2))


def plan_tables(n: int, threshold: float = THRESHOLD, recall: float = RECALL, width: float = WIDTH, mates: int = MATES) -> tuple[int, int]:
    """(tables, projections of each) for n vectors."""
    k = max(1, ceil(log(max(n, 1) / mates) / -log(same_cell(sqrt(2), width)))) if n > mates else 1
    p = same_cell(max(sqrt(max(0.0, 2 - 2 * threshold)), 1e-9), width) ** k
    return max(1, ceil(log(1 - recall) / log(1 - min(p, 1 - 1e-12)))), k


def sketch_bits(threshold: float = THRESHOLD, miss: float = SKETCH_MISS) -> int:
    """Differing bits of 64 that a pair at the threshold exceeds with a chance of at most `miss`."""
    p, tail, t = acos(max(-1.0, min(1.0, threshold))) / pi, 1.0, -1
    while tail > miss and t < 64:
        t += 1
        tail -= comb(64, t) * p**t * (1 - p) ** (64 - t)
    return t


@lru_cache(maxsize=8)
def projections(dim: int, tables: int, k: int, width: float, seed: int):
    rng = np.random.default_rng([seed, dim])
    planes = rng.standard_normal((dim, 64))
    return planes, np.rint(rng.standard_normal((dim, tables * k)) * FINE_A), rng.uniform(0, width, tables * k), rng.integers(1, 2**62, (tables, k)) * 2 + 1


def keys_of(x: np.ndarray, tables: int, k: int, width: float, seed: int) -> np.ndarray:
    """int64 key of each normalised row in each table; the table and the length of the vectors are part of it."""
    _, a, b, odd = projections(x.shape[1], tables, k, width, seed)
    cells = np.floor((np.rint(x * FINE_X) @ a / (FINE_X * FINE_A) + b) / width).astype(np.int64).reshape(len(x), tables, k)
    mixed = (cells * odd).sum(2).astype(np.uint64) + (np.arange(tables, dtype=np.uint64) + np.uint64(tables) * np.uint64(x.shape[1])) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed ^ (mixed >> np.uint64(32))).view(np.int64)


def sketches(x: np.ndarray, tables: int, k: int, width: float, seed: int) -> np.ndarray:
    bits = x @ projections(x.shape[1], tables, k, width, seed)[0] > 0
    return np.packbits(bits, axis=1).view(np.uint64)[:, 0]


def normalised(blobs: pa.Array, kind: type):
    """(rows of the batch, their vectors scaled to length one) for each length of vectors."""
    sizes = np.diff(np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]) if len(blobs) else np.zeros(0, int)
    whole = b"".join(blobs.to_pylist())
    starts = np.r_[0, np.cumsum(sizes)]
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        if len(own) == len(sizes):
            x = np.frombuffer(whole, kind).reshape(len(own), -1)
        else:
            x = np.stack([np.frombuffer(whole, kind, size // kind().itemsize, starts[i]) for i in own])
        x = x.astype(np.float64)
        x = x / np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        yield own, x


def prepared(vectors: DataFrame, id_col: str, vec_col: str, with_vectors: bool) -> tuple[DataFrame, type]:
    """(vec_id, h1, h2[, raw]): a 128-bit digest of each usable vector and its components as bytes; nulls for the others.

    Usable: not null, not empty, every component finite, not all zero. Floats stay floats, other numbers become doubles.
    """
    short = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    kind, arrow = (np.float32, pa.float32()) if short else (np.float64, pa.float64())

    def run(batches):
        for b in batches:
            lists = b.column(1)
            offsets = np.asarray(lists.offsets)
            values = lists.values.cast(arrow)
            fine = np.asarray(values.is_valid())
            x = np.asarray(values.fill_null(0)) + kind(0)
            fine &= np.isfinite(x)
            broken, filled = np.r_[0, np.cumsum(~fine)], np.r_[0, np.cumsum(x != 0)]
            usable = np.asarray(lists.is_valid()) & (broken[offsets[1:]] == broken[offsets[:-1]]) & (filled[offsets[1:]] > filled[offsets[:-1]])
            blobs = [x[a:z].tobytes() if u else None for a, z, u in zip(offsets[:-1].tolist(), offsets[1:].tolist(), usable.tolist())]
            digests = np.frombuffer(b"".join(b"\0" * 16 if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in blobs), "<i8").reshape(-1, 2)
            cols = [b.column(0), pa.array(digests[:, 0], mask=~usable), pa.array(digests[:, 1], mask=~usable)]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(blobs, pa.binary())] * with_vectors, ["vec_id", "h1", "h2"] + ["raw"] * with_vectors)

    id_kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<float>" if short else "array<double>").alias("vec"))
    return rows.mapInArrow(run, f"vec_id {id_kind}, h1 long, h2 long" + ", raw binary" * with_vectors), kind


def candidates(k: np.ndarray, starts: np.ndarray, home: np.ndarray, sketch: np.ndarray, bits: int) -> np.ndarray:
    """Which rows have a partner in their run whose sketch differs in at most `bits` bits. k: (key, r, s); r = s compares a block with itself, else rows of block r with rows of block s."""
    out, sizes = np.zeros(len(k), bool), np.diff(starts)
    short = (sizes > 1) & (sizes <= 24)
    run = np.repeat(np.where(short, np.arange(len(sizes)), -1 - np.arange(len(sizes))), sizes)
    for d in range(1, 24):
        i = np.flatnonzero((run[:-d] == run[d:]) & (run[:-d] >= 0)) if len(run) > d else np.zeros(0, int)
        if not len(i):
            break
        i = i[(np.bitwise_count(sketch[i] ^ sketch[i + d]) <= bits) & ((k[i, 1] == k[i, 2]) | (home[i] != home[i + d]))]
        out[i] = out[i + d] = True
    for at in np.flatnonzero(sizes > 24):
        lo, hi = starts[at], starts[at + 1]
        own = np.arange(lo, hi)
        i, j = (own, own) if k[lo, 1] == k[lo, 2] else (own[home[lo:hi] == k[lo, 1]], own[home[lo:hi] == k[lo, 2]])
        near = np.bitwise_count(sketch[i][:, None] ^ sketch[j][None, :]) <= bits
        if i is j:
            np.fill_diagonal(near, False)
        out[i[near.any(1)]] = True
        out[j[near.any(0)]] = True
    return out


def verify_run(key: int, ids: np.ndarray, home: np.ndarray, n: np.ndarray, x: np.ndarray, keys: np.ndarray, r: int, s: int, threshold: float):
    """Links of a block pair: per row the weight of its new partners, and a spanning star forest of the new links.

    A pair counts in the first table where it shares a key, so a run whose rows all share an earlier key is done
    there; r = s compares a block with itself, else only rows of block r with rows of block s, so every pair of the
    bucket is counted once.
    """
    weight, none = np.zeros(len(ids), np.int64), np.zeros(0, np.int64)
    t = int((keys[0] == key).argmax())
    if (keys[:, :t] == keys[0, :t]).all(0).any():
        return weight, none, none
    i, j = (np.arange(len(ids)),) * 2 if r == s else (np.flatnonzero(home == r), np.flatnonzero(home == s))
    near = x[i] @ x[j].T >= threshold
    if r == s:
        np.fill_diagonal(near, False)
    for earlier in range(t):
        near &= keys[i, earlier][:, None] != keys[j, earlier][None, :]
    weight[i] += near @ n[j]
    if r != s:
        weight[j] += n[i] @ near
    a, b, free_i, free_j = [], [], np.ones(len(i), bool), np.ones(len(j), bool)
    for root in np.flatnonzero(near.any(1)):
        if not free_i[root]:
            continue
        front = np.array([root])
        while len(front):
            free_i[front] = False
            there = np.flatnonzero(near[front].any(0) & free_j)
            free_j[there] = False
            a.append(np.r_[ids[i[front]], ids[j[there]]])
            b.append(np.full(len(front) + len(there), ids[i[root]]))
            front = np.flatnonzero(near[:, there].any(1) & free_i) if len(there) else there
    return weight, np.concatenate([none, *a]), np.concatenate([none, *b])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, width: float = WIDTH, seed: int = SEED, block: int = BLOCK, mates: int = MATES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Null, empty, zero vectors and those with null or non-finite components link with nothing and are components
    of their own; vectors of different lengths never link. Identical vectors always link (they are told by a 128-bit
    digest). Repeated rows stay and link with one another. An empty table gives an empty result; other columns
    are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    own, kind = prepared(vectors, id_col, vec_col, True)
    whole = cut(own.where("raw IS NOT NULL").groupBy("h1", "h2").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"), F.first("raw").alias("raw"))
                .withColumn("rep", F.monotonically_increasing_id()), "distinct")
    tables, k = plan_tables(whole.count(), threshold, recall, width, mates)
    hashing, bits = (tables, k, width, seed), sketch_bits(threshold)

    def spread(batches):
        for b in batches:
            reps = np.asarray(b.column(0))
            for at, x in normalised(b.column(1), kind):
                yield pa.RecordBatch.from_arrays([pa.array(keys_of(x, *hashing).T.ravel()), pa.array(np.tile(reps[at], tables)), pa.array(np.tile(sketches(x, *hashing).view(np.int64), tables))], ["key", "rep", "sketch"])

    slots = whole.select("rep", "raw").mapInArrow(spread, "key long, rep long, sketch long")
    hot = cut(slots.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > block).select("key", F.ceil(F.col("c") / block).cast("int").alias("nb")), "hot")
    dealt = (slots.join(hot, "key", "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
             .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
             .select("key", "rep", "sketch", "own", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
             .select("key", F.least("own", "other").alias("r"), F.greatest("own", "other").alias("s"), "own", "rep", "sketch"))
    order = ["key", "r", "s"]

    def sift(batches):
        for b, keys, starts in grouped(batches, 3):
            mark = candidates(keys, starts, np.asarray(b.column(3)), np.asarray(b.column(5)).view(np.uint64), bits)
            if mark.any():
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(mark)) for c in b.columns[:5]], [*order, "own", "rep"])

    called = cut(dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(sift, "key long, r int, s int, own int, rep long"), "called")
    work = called.join(whole.select("rep", "n", "raw"), "rep").select(*order, "own", "rep", "n", "raw")

    def check(batches):
        for b, keys, starts in grouped(batches, 3):
            home, rep, n = (np.asarray(b.column(i)).astype(np.int64) for i in (3, 4, 5))
            out = [[np.zeros(0, np.int64)] for _ in range(4)]
            for lo, hi in zip(starts[:-1], starts[1:]):
                if hi - lo < 2:
                    continue
                for at, x in normalised(b.column(6).slice(lo, hi - lo), kind):
                    at = lo + at
                    weight, a, z = verify_run(int(keys[lo, 0]), rep[at], home[at], n[at], x, keys_of(x, *hashing), int(keys[lo, 1]), int(keys[lo, 2]), threshold)
                    linked, loose = weight > 0, a != z
                    for held, new in zip(out, (rep[at][linked], weight[linked], a[loose], z[loose])):
                        held.append(new)
            ids, weights, a, z = map(np.concatenate, out)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[ids, a]), pa.array(np.r_[np.full(len(ids), -1), z]), pa.array(np.r_[weights, np.zeros(len(a), np.int64)]), pa.array(np.arange(len(ids) + len(a)) >= len(ids))], ["a", "b", "w", "edge"])

    found = cut(work.repartition(*order).sortWithinPartitions(*order).mapInArrow(check, "a long, b long, w long, edge boolean"), "found")
    roots = connected_components(found.where("edge").select("a", "b"))
    weights = found.where("not edge").groupBy(F.col("a").alias("rep")).agg(F.sum("w").alias("w"))
    ids = whole.select("rep", "h1", "h2", "first_id", "n")
    smallest = cut(roots.join(ids.select(F.col("rep").alias("node"), "first_id"), "node").groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    classes = roots.join(smallest, "root").select(F.col("node").alias("rep"), "component_id")
    # Only vectors with a link or a copy: the others are components of their own without links.
    named = cut(ids.join(weights, "rep", "left").join(classes, "rep", "left").where("n > 1 OR w IS NOT NULL OR component_id IS NOT NULL")
                .select("h1", "h2", (F.coalesce("w", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id")), "named")
    discard(whole, hot, called, found, roots, smallest)
    out = prepared(vectors, id_col, vec_col, False)[0].join(named, ["h1", "h2"], "left")
    comp = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(False)).alias("kept"))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x, sqrt(list_sum(list_transform(embedding, lambda c: c::DOUBLE * c::DOUBLE))) AS size FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x)
  WHERE list_dot_product(p.x, q.x) / (p.size * q.size) >= 0.95),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT reach.vec_id, l.b FROM reach JOIN l ON l.a = reach.other),
c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n ON n.a = c.vec_id
"""
