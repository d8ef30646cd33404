"""Exact top-k inner-product search with M-trees.

Inner product becomes a metric by one more component sqrt(M^2 - |x|^2) (queries: 0), M the largest norm of all
vectors: d^2 = M^2 + |q|^2 - 2 q.x. Vectors are quantised to integers and go to the nearest of a bounded number of
pivots; a pivot's cell is one or more shards, each an M-tree of pages whose routing objects carry a covering radius
and whose entries carry the distance to their parent. A query first searches a shard of its nearest cell, which
bounds how far its k best may lie, and then only shards that the pivots' covering radii do not rule out. In a tree
it goes best-first by lower bounds; entries whose stored parent distance already rules them out by the triangle
inequality are never computed. Scores are exact integers; floating distances only prune, with slack.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import cut, discard, small_batches, table

SCALE = 1024
K = 10
#: Vectors of a shard (one tree), entries of a page, queries that search a shard together.
SHARD = 8192
PAGE = 256
QUERIES = 8192
#: Pivots at most, and rows that a driver and every worker hold of them: larger cells are several shards.
PIVOTS = 1024
SLACK = 1e-6


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Points of the metric space: integer vectors with the component that makes all norms sqrt(top)."""
    f = x.astype(np.float64)
    return np.concatenate([f, np.sqrt(np.maximum(top - (f * f).sum(1), 0))[:, None]], 1)


class MTree:
    """Bulk-loaded M-tree over integer vectors, as flat arrays.

    Node i: routing object centre[i], radius[i]; its children are nodes kids[first[i] : last[i]] with their distances to it
    in parent, or, where leaf[i], rows first[i] : last[i] of ids and x, sorted by their distance to it in near. Rows
    of a page lie together.
    """

    ARRAYS = ("ids", "x", "centre", "radius", "first", "last", "leaf", "kids", "parent", "near")

    def __init__(self, ids: np.ndarray, x: np.ndarray, page: int = PAGE, top: float | None = None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.page = ids[order], x[order], page
        self.top = max(float((x.astype(np.float64) ** 2).sum(1).max(initial=0)), top or 0.0)

    def finish(self) -> MTree:
        """Build the pages, by number of rows top down."""
        ids, x, page = self.ids, self.x, self.page
        points, rng = lifted(x, self.top), np.random.default_rng(len(ids))
        nodes, rows_of, order, kids, parent = [], [], [], [], []

        def add(rows: np.ndarray) -> int:
            mean = points[rows].mean(0)
            centre = points[rows[int(((points[rows] - mean) ** 2).sum(1).argmin())]]
            d = np.sqrt(((points[rows] - centre) ** 2).sum(1))
            nodes.append([centre, float(d.max()), 0, 0, len(rows) <= page])
            rows_of.append((rows, d))
            return len(nodes) - 1

        if len(ids):
            add(np.arange(len(ids)))
        at = placed = 0
        near = []
        while at < len(nodes):
            rows, d = rows_of[at]
            rows_of[at] = None
            if nodes[at][4]:
                by = np.argsort(d, kind="stable")
                order.append(rows[by])
                near.append(d[by])
                nodes[at][2:4] = placed, placed + len(rows)
                placed += len(rows)
            else:
                fan = min(16, -(-len(rows) // page) + 1)
                seeds = points[rng.choice(rows, fan, replace=False)]
                own = (((points[rows] ** 2).sum(1)[:, None] - 2 * points[rows] @ seeds.T) + (seeds**2).sum(1)).argmin(1)
                parts = [p for g in range(fan) if len(p := rows[own == g])]
                if len(parts) < 2:  # equal points: any cut will do
                    parts = np.array_split(rows, fan)
                nodes[at][2] = len(kids)
                for p in parts:
                    kid = add(p)
                    kids.append(kid)
                    parent.append(float(np.sqrt(((nodes[kid][0] - nodes[at][0]) ** 2).sum())))
                nodes[at][3] = len(kids)
            at += 1
        order = np.concatenate([np.zeros(0, int), *order])
        self.ids, self.x, self.near = ids[order], x[order].astype(np.min_scalar_type(-int(np.abs(x).max(initial=0)) - 1)), np.concatenate([np.zeros(0), *near])
        self.centre = np.array([n[0] for n in nodes]).reshape(len(nodes), -1)
        self.radius, self.first, self.last, self.leaf = (np.array([n[i] for n in nodes], t) for i, t in ((1, float), (2, np.int64), (3, np.int64), (4, bool)))
        self.kids, self.parent = np.array(kids, np.int64), np.array(parent, float)
        return self._ready()

    def _ready(self) -> MTree:
        self.points = lifted(self.x, self.top)
        self.exact = float(np.abs(self.points[:, :-1]).max(initial=0))
        self.scored = 0  # rows whose score was computed, over all searches
        return self

    def __reduce__(self):
        return MTree.of_arrays, (self.top, self.arrays())

    def arrays(self) -> list[tuple[str, bytes]]:
        """(type and shape, bytes) of each of ARRAYS."""
        return [(f"{a.dtype.str} {' '.join(map(str, a.shape))}", a.tobytes()) for a in (getattr(self, n) for n in self.ARRAYS)]

    @classmethod
    def of_arrays(cls, top: float, arrays: list[tuple[str, bytes]]) -> MTree:
        tree = cls.__new__(cls)
        tree.top = top
        for name, (kind, data) in zip(cls.ARRAYS, arrays):
            dtype, *shape = kind.split(" ")
            setattr(tree, name, np.frombuffer(data, dtype).reshape([int(n) for n in shape]))
        return tree._ready()

    def search(self, query: np.ndarray, k: int, skip: int | None, least: int | None = None) -> list[tuple[int, int]]:
        """(score, id) of the k best rows but `skip`, ties to the smaller id; all rows if fewer. least: a score that k rows elsewhere reach, below which none is needed."""
        if not len(self.ids):
            return []
        q = np.r_[query.astype(np.float64), 0.0]
        qq = float(q @ q)
        whole = self.exact * float(np.abs(query.astype(object)).max(initial=0)) * max(len(query), 1) < 2**53
        slack = SLACK * (np.sqrt(self.top + qq) + 1)

        def within(score):
            return np.sqrt(max(self.top + qq - 2 * float(score), 0.0)) + slack

        reach = np.inf if least is None else within(least)
        best: list[tuple[int, int]] = []  # heap of (score, -id)
        d = float(np.sqrt(((self.centre[0] - q) ** 2).sum()))
        queue = [(max(0.0, d - self.radius[0]), 0, d)]
        while queue:
            low, at, d = heapq.heappop(queue)
            if low > reach:
                break
            lo, hi = int(self.first[at]), int(self.last[at])
            if not self.leaf[at]:
                kids = self.kids[lo:hi]
                kids = kids[np.abs(d - self.parent[lo:hi]) - self.radius[kids] <= reach]
                if len(kids):
                    dk = np.sqrt(((self.centre[kids] - q) ** 2).sum(1))
                    for kid, floor, dist in zip(kids.tolist(), np.maximum(dk - self.radius[kids], 0).tolist(), dk.tolist()):
                        if floor <= reach:
                            heapq.heappush(queue, (floor, kid, dist))
                continue
            if reach < np.inf:
                a, z = np.searchsorted(self.near[lo:hi], [d - reach, d + reach + slack])
                lo, hi = lo + max(int(a) - 1, 0), min(lo + int(z) + 1, hi)
            self.scored += hi - lo
            if whole:
                scores = (self.points[lo:hi, :-1] @ q[:-1]).astype(np.int64)
            else:
                scores = np.array([sum(int(a) * int(b) for a, b in zip(r, query)) for r in self.x[lo:hi]], object)
            for i in np.flatnonzero(scores >= best[0][0]) if len(best) == k else range(hi - lo):
                one = int(self.ids[lo + i])
                if one == skip:
                    continue
                item = (int(scores[i]), -one)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                reach = min(reach, within(best[0][0]))
        return [(s, -i) for s, i in sorted(best, key=lambda b: (-b[0], -b[1]))]


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, dim, x, norm): floor(scale * component) as integers in bytes (see narrow) and the squared norm; null ids, null vectors, null or non-finite components drop out. Beyond the range of a long a component is the range's end."""
    small_batches(vectors.sparkSession)

    def run(batches):
        for b in batches:
            lists = b.column(1)
            offsets, values = np.asarray(lists.offsets).astype(np.int64), lists.values
            fine = np.asarray(values.is_valid()) & np.isfinite(x := np.asarray(values.fill_null(0)))
            broken = np.r_[0, np.cumsum(~fine)]
            at = np.flatnonzero(np.asarray(lists.is_valid()) & (broken[offsets[1:]] == broken[offsets[:-1]]))
            v = np.floor(np.where(fine, x, 0) * scale)
            v = np.where(v >= 2.0**63, np.int64(2**63 - 1), np.clip(v, -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64))
            blobs = [narrow(v[s:e]) for s, e in zip(offsets[at].tolist(), offsets[at + 1].tolist())]
            norms = [float((v[s:e].astype(float) ** 2).sum()) for s, e in zip(offsets[at].tolist(), offsets[at + 1].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array((offsets[at + 1] - offsets[at]).astype(np.int32)), pa.array(blobs, pa.binary()), pa.array(norms, pa.float64())], ["vec_id", "dim", "x", "norm"])

    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.mapInArrow(run, "vec_id long, dim int, x binary, norm double")


def narrow(v: np.ndarray) -> bytes:
    """Integers as bytes, 2 for each where that holds them all, else 8."""
    return v.astype(np.int16).tobytes() if np.abs(v.clip(-(1 << 15), 1 << 15) + 0.5).max(initial=0) < 1 << 15 else v.tobytes()


def matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    """Vectors of one length, written by narrow(), as rows of longs."""
    out = np.zeros((len(blobs), dim), np.int64)
    for size, kind in ((2, np.int16), (8, np.int64)):
        if own := [i for i, v in enumerate(blobs) if dim and len(v) == size * dim]:
            out[own] = np.frombuffer(b"".join([blobs[i] for i in own]), kind).reshape(-1, dim)
    return out


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Euclidean distances of all points to all centres, to within SLACK of the norms."""
    square = (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)
    return np.sqrt(np.maximum(square, 0))


def cells(rows: DataFrame, shard: int, most: int) -> dict[int, tuple[float, np.ndarray]]:
    """Per length of vectors (top, pivots): the largest squared norm and at most `most` pivots, vectors that come first by the hash of their ids, one for every `shard` rows."""
    out = {}
    for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect():
        want = min(most, -(-r.n // shard))
        first = rows.where(F.col("dim") == r.dim).orderBy(F.xxhash64("vec_id"), "x").limit(want).select("x").toArrow().column("x").to_pylist()
        out[r.dim] = (r.top, lifted(matrix(first, r.dim), r.top))
    return out


def with_pivots(df: DataFrame, own: list[str], schema: str, pivots, work) -> DataFrame:
    """Arrow batches of df by length of vectors through work(batch, top, pivot points)."""
    def run(batches):
        for b in batches:
            dims = np.asarray(b.column(b.schema.get_field_index("dim")))
            for dim in np.unique(dims):
                if int(dim) in pivots.value:
                    yield work(b.filter(pa.array(dims == dim)), *pivots.value[int(dim)])

    return df.select(*own).mapInArrow(run, schema)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, shard: int = SHARD, block: int = QUERIES, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` its k best rows of `vectors` but those with its own id.

    Rows take part if their id is not null and their vector has only finite components; a query meets vectors of
    its own length. Repeated ids among the candidates each count as a row; queries count once per distinct (id,
    vector), and different vectors under one id each have results of their own, ranked from 1. Empty tables give
    an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = cut(quantised(vectors, id_col, vec_col, scale), "rows")
    asked = quantised(queries, id_col, vec_col, scale).select("vec_id", "dim", "x").distinct().withColumn("q", F.monotonically_increasing_id())
    shared = spark.sparkContext.broadcast(cells(rows, shard, pivots))

    def assign(b, top, centres):
        d = distances(lifted(matrix(b.column(2).to_pylist(), b.column(1)[0].as_py()), top), centres)
        cell = d.argmin(1)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["vec_id", "dim", "x", "cell", "d"])

    dealt = with_pivots(rows, ["vec_id", "dim", "x"], "vec_id long, dim int, x binary, cell int, d double", shared, assign)
    # A cell's rows, its covering radius and its shards: at most PIVOTS of them for each length of vectors.
    sizes = {(r.dim, r.cell): (r.radius, -(-r.n // shard)) for r in dealt.groupBy("dim", "cell").agg(F.max("d").alias("radius"), F.count("*").alias("n")).collect()}
    bounds = spark.sparkContext.broadcast({dim: (top, centres, *(np.array([sizes.get((dim, c), (-np.inf, 0))[i] for c in range(len(centres))]) for i in (0, 1))) for dim, (top, centres) in shared.value.items()})
    parts = spark.createDataFrame([(d, c, int(n)) for (d, c), (_, n) in sizes.items()], "dim int, cell int, parts int")
    tops = {dim: top for dim, (top, _) in shared.value.items()}
    kinds = "dim int, cell int, part int, top double, arrays array<struct<kind:string,data:binary>>"

    def build(key, t):
        tree = MTree(np.asarray(t.column("vec_id"), np.int64), matrix(t.column("x").to_pylist(), key[0].as_py()), top=tops[key[0].as_py()]).finish()
        arrays = pa.array([[{"kind": a, "data": z} for a, z in tree.arrays()]], pa.list_(pa.struct([("kind", pa.string()), ("data", pa.binary())])))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([key[2].as_py()], pa.int32()), pa.array([tree.top]), arrays], names=["dim", "cell", "part", "top", "arrays"])

    trees = cut(dealt.join(F.broadcast(parts), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
                .select("dim", "cell", "part", "vec_id", "x").groupBy("dim", "cell", "part").applyInArrow(build, kinds), "trees")

    def search(pairs: DataFrame) -> DataFrame:
        """(q, query_id, vec_id, score) of pairs (dim, cell, part, q, vec_id, x, least), a written table: every shard meets its queries in blocks, each block a task's work of its own."""
        shards, keys = ["dim", "cell", "part"], ["dim", "cell", "part", "block"]
        counts = pairs.groupBy(*shards).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        blocked = pairs.join(counts, shards).withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int"))
        blocks = counts.select(*[F.col(c).alias(c) for c in shards], F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        every = trees.join(blocks, shards)

        def run(left, right):
            out = [[], [], [], []]
            for dim, top, arrays in zip(*(left.column(c).to_pylist() for c in ("dim", "top", "arrays"))):
                tree = MTree.of_arrays(top, [(a["kind"], a["data"]) for a in arrays])
                queries = matrix(right.column("x").to_pylist(), dim)
                for x, q, i, least in zip(queries, *(right.column(c).to_pylist() for c in ("q", "vec_id", "least"))):
                    for score, one in tree.search(x, k, i, least):
                        for c, v in zip(out, (q, i, one, score)):
                            c.append(v)
            return pa.table([pa.array(c, pa.int64()) for c in out], names=["q", "query_id", "vec_id", "score"])

        return every.groupBy(*keys).cogroup(blocked.select(*keys, "q", "vec_id", "x", "least").groupBy(*keys)).applyInArrow(run, "q long, query_id long, vec_id long, score long")

    def ranked(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def nearest(b, _, __):
        dim = b.column(1)[0].as_py()
        top, centres, radius, parts = bounds.value[dim]
        d = distances(lifted(matrix(b.column(2).to_pylist(), dim), top) * np.r_[np.ones(centres.shape[1] - 1), 0], centres)
        cell = np.where(parts > 0, d, np.inf).argmin(1)
        own = np.asarray(b.column(3)) % np.maximum(parts[cell], 1)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(own.astype(np.int32)), pa.nulls(len(d), pa.int64())], ["vec_id", "dim", "x", "q", "cell", "part", "least"])

    pair = "vec_id long, dim int, x binary, q long, cell int, part int, least long"
    seeds = cut(with_pivots(asked, ["vec_id", "dim", "x", "q"], pair, shared, nearest), "seeds")
    first = cut(ranked(search(seeds)), "first")
    least = first.where(F.col("rank") == k).select("q", F.col("score").alias("reached"))

    def surviving(b, _, __):
        dim = b.column(1)[0].as_py()
        top, centres, radius, parts = bounds.value[dim]
        points = lifted(matrix(b.column(2).to_pylist(), dim), top) * np.r_[np.ones(centres.shape[1] - 1), 0]
        qq, reached = (points**2).sum(1), b.column(6)
        slack = SLACK * (np.sqrt(top + qq) + 1) + 1e-7 * (np.sqrt(qq) + np.sqrt(top))
        score = np.asarray(reached.fill_null(0)).astype(float)
        reach = np.where(np.asarray(reached.is_valid()), np.sqrt(np.maximum(top + qq - 2 * score, 0)) + slack, np.inf)
        i, cell = np.nonzero((distances(points, centres) - radius <= reach[:, None]) & (parts > 0))
        times = parts[cell].astype(np.int64)
        i, cell, part = np.repeat(i, times), np.repeat(cell, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        new = (cell != np.asarray(b.column(4))[i]) | (part != np.asarray(b.column(5))[i])
        i = pa.array(i[new])
        return pa.RecordBatch.from_arrays([*(b.column(c).take(i) for c in range(4)), pa.array(cell[new].astype(np.int32)), pa.array(part[new].astype(np.int32)), reached.take(i)], ["vec_id", "dim", "x", "q", "cell", "part", "least"])

    more = cut(with_pivots(seeds.drop("least").join(least, "q", "left"), ["vec_id", "dim", "x", "q", "cell", "part", "reached"], pair, shared, surviving), "pairs")
    out = cut(ranked(first.drop("rank").unionByName(search(more))).select("query_id", "rank", "vec_id", "score"), "best")
    discard(rows, trees, seeds, first, more)
    return out


def op3_topk(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 100 = 0"))


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q, v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
