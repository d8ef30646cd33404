"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within `max_bits` differing bits are found without missing any: the 64 bits are dealt into groups
of correlated bits, group i gets a threshold t_i with sum(t) = max_bits - groups + 1 (-1 skips a group), and two
fingerprints within max_bits agree in at least one group i up to t_i bits. Thresholds come from dynamic
programming over the candidate counts estimated on a bounded sample of fingerprints; they steer cost only,
never the result. A group with t_i bits of slack is probed by masking every choice of t_i of its bits.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import column, cut, discard, fresh, small_batches, table
from rasterloom.operators.components import connected_components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Fingerprints whose pairs give the estimated candidate counts (taken in hash order; only cost depends on them).
SAMPLE = 4096
#: Rows of a bucket that one block holds; a larger bucket becomes pairs of blocks, so no task gets it whole.
BLOCK = 512
#: Cost of dealing out one row for one mask, in comparisons of two fingerprints.
PROBE = 20


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the words' shingles; no words: zero."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxh64_intdigest(b" ".join(words), seed)]
    else:
        hashes = [xxh64_intdigest(s, seed) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle))))]
    votes, step = np.zeros(64, np.int64), 1 << 16
    for i in range(0, len(hashes), step):
        part = np.array(hashes[i : i + step], "<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, row: Column | None = None) -> DataFrame:
    """(doc_id, fp): fp is the unsigned fingerprint's bits in a signed long. Null texts count as empty. row: one more column, a long."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *b.columns[2:]], ["doc_id", "fp", *b.schema.names[2:]])

    kind = docs.schema[id_col].dataType.simpleString()
    more = [] if row is None else [row.alias("row")]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *more).mapInArrow(run, f"doc_id {kind}, fp long" + ", row long" * len(more))


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 matrix of joint one-counts, by grouped sums of per-partition sums."""
    def run(batches):
        n, ones = 0, np.zeros((64, 64))
        for b in batches:
            bits = np.unpackbits(np.asarray(b.column(0)).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n, ones = n + len(bits), ones + bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(np.r_[n, ones.ravel()])], ["k", "v"])

    rows = fps.select("fp").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(4097)
    for r in rows:
        flat[r.k] = r.v
    return int(flat[0]), flat[1:].reshape(64, 64)


def correlated_groups(n: int, ones: np.ndarray, groups: int) -> list[list[int]]:
    """64 bits in groups of nearly equal width; each group takes the bits that correlate most with its own."""
    p = np.diag(ones) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(ones / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, out = list(range(64)), []
    for g in range(groups):
        width = (len(left) + groups - g - 1) // (groups - g)
        own = [min(left, key=lambda b: (spread[b], b))]
        left.remove(own[0])
        while len(own) < width:
            best = max(left, key=lambda b: (corr[b, own].mean(), -b))
            own.append(best)
            left.remove(best)
        out.append(sorted(own))
    return out


def allocate(costs: np.ndarray, total: int) -> tuple[float, list[int]]:
    """Least sum of costs[i][t_i + 1] with t_i >= -1 and sum(t) = total, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for k, cost in enumerate(row):
                t = k - 1
                if s + t not in following or c + cost < following[s + t][0]:
                    following[s + t] = (c + cost, ts + [t])
        best = following
    return best[total]


def distances(values: np.ndarray, most: int) -> np.ndarray:
    """How many pairs of values (each pair once, none with itself) differ in 0, 1, .. most bits."""
    out = np.zeros(most + 1)
    for a in range(0, len(values), 256):
        rows = values[a : a + 256]
        d = np.bitwise_count(rows[:, None] ^ values[None, a:])
        later = np.arange(d.shape[1])[None, :] > np.arange(len(rows))[:, None]
        out += [np.count_nonzero((d == t) & later) for t in range(most + 1)]
    return out


def independent(differ: np.ndarray, most: int) -> np.ndarray:
    """Chance that 0, 1, .. most bits differ if bits differed independently: the least that shares too rare for the sample are taken to be."""
    out = np.r_[1.0, np.zeros(most)]
    for q in differ:
        out = out * (1 - q) + np.r_[0.0, out[:-1] * q]
    return out


def plan_masks(fps: DataFrame, max_bits: int = MAX_BITS) -> list[int]:
    """The bit masks (signed longs) whose equality joins together find every pair within max_bits."""
    n, ones = bit_statistics(fps)
    sample = np.array([r.fp for r in fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    pairs = max(1, len(sample) * (len(sample) - 1) // 2)
    p = np.diag(ones) / max(n, 1)
    choices = []
    for groups in range(1, max_bits + 3):
        parts = correlated_groups(n, ones, groups)
        costs = np.zeros((groups, max_bits + 2))
        for i, part in enumerate(parts):
            seen = distances(sample & np.uint64(sum(1 << b for b in part)), max_bits) / pairs
            share = np.maximum(seen, independent(2 * p[part] * (1 - p[part]), max_bits))
            for t in range(max_bits + 1):
                # A pair at distance d in the group meets under every choice of t free bits that holds those d.
                met = sum(share[d] * comb(len(part) - d, t - d) for d in range(t + 1))
                costs[i, t + 1] = comb(len(part), t) * n * PROBE + met * n * n / 2
        cost, ts = allocate(costs, max_bits - groups + 1)
        choices.append((cost, groups, parts, ts))
    _, _, parts, ts = min(choices, key=lambda c: c[:2])
    masks = [sum(1 << b for b in set(part) - set(free)) for part, t in zip(parts, ts) if t >= 0 for free in combinations(part, t)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def local_stars(values: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the link graph among a block's fingerprints: far fewer rows than its pairs."""
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= max_bits
    a, b, free = [], [], np.ones(len(values), bool)
    for root in range(len(values)):
        if not free[root]:
            continue
        free[root] = False
        front = np.flatnonzero(near[root] & free)
        while len(front):
            free[front] = False
            a.append(np.full(len(front), root))
            b.append(front)
            front = np.flatnonzero(near[front].any(0) & free)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def link_runs(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Linking edges inside runs of equal keys (rows sorted by key)."""
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(keys)])
    short = (sizes > 1) & (sizes <= 16)
    run = np.repeat(np.where(short, np.arange(len(starts)), -1 - np.arange(len(starts))), sizes)
    a, b = [], []
    for d in range(1, 16):
        i = np.flatnonzero((run[:-d] == run[d:]) & (run[:-d] >= 0)) if len(run) > d else np.zeros(0, int)
        if not len(i):
            break
        i = i[(np.bitwise_count(fps[i] ^ fps[i + d]) <= max_bits) & (fps[i] != fps[i + d])]
        a.append(fps[i])
        b.append(fps[i + d])
    for s, size in zip(starts[sizes > 16], sizes[sizes > 16]):
        own = np.unique(fps[s : s + size])
        i, j = local_stars(own, max_bits)
        a.append(own[i])
        b.append(own[j])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def common_neighbours(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star in each run of equal keys (rows sorted by key): all of a run are within two bits of one another."""
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else np.zeros(0, int)
    first = np.repeat(fps[starts], np.diff(np.r_[starts, len(keys)]))
    return first[first != fps], fps[first != fps]


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, enough to connect all that link within max_bits.

    fps: one row per distinct fingerprint, as a written table. Every bucket with more than `block` rows is dealt
    into blocks and each pair of blocks is a group of its own; buckets are never gathered whole. Where that makes
    more blocks than a fingerprint has neighbours at one bit or none, and max_bits is 2, a bucket's fingerprints
    meet at those neighbours instead: two are within two bits if and only if they have one in common, and at most
    65 fingerprints have the same one. So a bucket's work grows with its size and not with the square of it.
    """
    masks = plan_masks(fps, max_bits)
    rows = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)])).alias("k")).select("k.m", "k.v", "fp")
    sizes = rows.groupBy("m", "v").agg(F.count("*").alias("n")).where("n > 1")
    # The bits outside the mask, which the bucket's fingerprints may differ in.
    bits = F.element_at(F.array(*[F.lit(m).cast("long") for m in masks]), F.col("m") + 1)
    free = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(bits, b) == 0)
    neighbours = F.concat(F.array("fp"), F.transform(free, lambda b: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))))
    group = lambda v, r, s: F.struct(v.alias("v"), r.alias("r"), s.alias("s"))
    at_neighbours = F.transform(neighbours, lambda v: group(v, F.lit(-1), F.lit(-1)))
    in_blocks = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: group(F.col("v"), F.least("own", o), F.greatest("own", o)))
    many = F.lit(max_bits == 2) & (F.col("nb") > 65 - F.bit_count(bits))
    dealt = (rows.join(sizes, ["m", "v"]).withColumn("nb", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
             .select("m", "fp", F.explode(F.when(many, at_neighbours).otherwise(in_blocks)).alias("g")).select("m", "g.v", "g.r", "g.s", "fp"))
    keys = ["m", "v", "r", "s"]

    def run(batches):
        held_k, held_f = np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)
        def edges(k, f):
            met = k[:, 2] < 0
            a, b = (np.concatenate(x) for x in zip(link_runs(k[~met], f[~met], max_bits), common_neighbours(k[met], f[met])))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
        for batch in batches:
            k = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(4)], 1)
            f = np.asarray(batch.column(4)).astype(np.int64).view(np.uint64)
            k, f = np.concatenate([held_k, k]), np.concatenate([held_f, f])
            at = len(k)
            if at:
                same = (k == k[-1]).all(1)
                at = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
            yield edges(k[:at], f[:at])
            held_k, held_f = k[at:], f[at:]
        yield edges(held_k, held_f)

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def components(own: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root, component_id) for each distinct fingerprint of own: root tells components apart, component_id is the smallest id in one."""
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = connected_components(links(distinct, max_bits))
    labelled = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = cut(labelled.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    classes = cut(labelled.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id"), "classes")
    discard(distinct, roots, smallest)
    return classes


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    Whole texts; null and empty texts have fingerprint zero and link like any other. component_id is the smallest
    id reachable over links; a null id never becomes a component's id unless the component has no other. Repeated
    rows stay. An empty table gives an empty result; other columns of docs are not read.
    """
    own = cut(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    return own.join(components(own, max_bits).drop("root"), "fp").select("doc_id", "fp", "component_id")


def row_hash(docs: DataFrame, text_col: str) -> Column:
    """Hash of a whole row, its text first; what cannot be hashed counts as a string."""
    odd = lambda c: any(k in docs.schema[c].dataType.simpleString() for k in ("map<", "variant"))
    return F.xxhash64(column(text_col), *[column(c).cast("string") if odd(c) else column(c) for c in docs.columns])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row of docs for each near-duplicate group: the first by (id with nulls last, fingerprint, hash of the row).

    Ids may repeat or be null: rows of different groups never replace one another. Texts are not shuffled but for
    kept rows that repeat as a whole: the (id, hash) of the rows that go, and of those that repeat, are joined
    against, which the planner broadcasts while they are small.
    """
    own = cut(fingerprints(docs, id_col, text_col, shingle, seed, row_hash(docs, text_col)), "fingerprints")
    members = cut(own.join(components(own, max_bits).drop("component_id"), "fp").select("root", "doc_id", "fp", "row"), "members")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "row")
    first = cut(members.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
                .select("root", F.col("first.doc_id").alias("first_id"), F.col("first.row").alias("first_row")), "first")
    grouped = members.join(first, "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("row") == F.col("first_row")))
    i, r = fresh("id__", docs), fresh("row__", docs)
    pairs = grouped.select("stays", F.col("doc_id").alias(i), F.col("row").alias(r))
    gone = cut(pairs.where("NOT stays").select(i, r).distinct(), "gone")
    again = cut(pairs.where("stays").groupBy(i, r).count().where("count > 1").select(i, r), "again")
    discard(own, members, first)
    this = lambda: column(id_col).eqNullSafe(F.col(i)) & (row_hash(docs, text_col) == F.col(r))
    left = docs.join(gone, this(), "left_anti")
    if again.isEmpty():
        discard(again)
        return left
    once = left.join(again, this(), "left_semi").withColumn(r, row_hash(docs, text_col)).dropDuplicates([id_col, r]).drop(r)
    return left.join(again, this(), "left_anti").unionAll(once)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    d = near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
