"""Neighbourhood operators: one halo-tile runner and a relational twin.

Pixels are dealt to tiles together with a halo; a numpy kernel then sees each tile once. Indices are clipped to the
tile's rows and columns, which is the image's border where the tile touches it and never bites elsewhere, because
the halo reaches as far as any tap. Borders replicate, and clamped duplicates count again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.arrow import grouped

TILE_ROWS, TILE_COLS = 64, 1024
PARTS = 64


def part_of():
    """Which of PARTS parts of its image a pixel is in; strips of pixels take turns."""
    return F.pmod(F.floor(F.col("row") / TILE_ROWS) + F.floor(F.col("col") / TILE_COLS), F.lit(PARTS)).cast("int")


def join_by_image(px: DataFrame, few: DataFrame, keys: list[str], having: str | None = None) -> DataFrame:
    """px joined on keys with the few rows that an image has; its parts meet them apart, so a large image is not one task's work.

    having: a column of few, dropped, with bit k set (bit_or of 1 << part_of()) where the image has part k; else few goes to all parts.
    """
    every = F.sequence(F.lit(0), F.lit(PARTS - 1))
    dealt = few.select("*", F.explode(F.filter(every, lambda k: F.getbit(F.col(having), k) == 1) if having else every).alias("part__"))
    return px.withColumn("part__", part_of()).join(dealt.drop(having) if having else dealt, [*keys, "part__"]).drop("part__")


class Tile:
    """A stack of tiles of one shape and place. values: dict of (tiles, rows, columns) arrays with halo; rows, cols: indices of the core within them; row0, col0: place of index 0."""

    def __init__(self, values: dict[str, np.ndarray], rows: np.ndarray, cols: np.ndarray, row0: int, col0: int):
        self.values, self.rows, self.cols, self.row0, self.col0 = values, rows, cols, row0, col0

    def tap(self, name: str, di: int, dj: int, rows: np.ndarray | None = None, cols: np.ndarray | None = None) -> np.ndarray:
        """The planes shifted by (di, dj) with clamped indices, over the core or the given rows and columns."""
        plane = self.values[name]
        r = np.clip((self.rows if rows is None else rows) + di, 0, plane.shape[-2] - 1)
        c = np.clip((self.cols if cols is None else cols) + dj, 0, plane.shape[-1] - 1)
        return plane[..., r[:, None], c[None, :]]


def apply_stencil(px: DataFrame, kernel: Callable[[Tile], dict[str, np.ndarray]], radius: int, inputs=("v",), outputs: dict[str, str] | None = None, tile_rows: int = TILE_ROWS, tile_cols: int = TILE_COLS) -> DataFrame:
    """(image_id, row, col, outputs): kernel on every tile. outputs: name to Spark type, 'v int' unless given.

    Tiles come sorted; those of one shape and place that arrive together (many small images, say) go through the
    kernel as one stack.
    """
    outputs = outputs or {"v": "int"}
    types = {"int": pa.int32(), "float": pa.float32(), "double": pa.float64(), "long": pa.int64()}
    names = list(inputs)
    sizes = ((tile_rows, 1), (tile_cols, 2))

    def tiles(c: str, size: int):
        low = F.greatest(F.lit(0), F.floor((F.col(c) - radius) / size).cast("int"))
        return F.explode(F.sequence(low, F.floor((F.col(c) + radius) / size).cast("int")))

    dealt = (px.select("image_id", "row", "col", *names, tiles("row", tile_rows).alias("tr"))
             .select("*", tiles("col", tile_cols).alias("tc")).select("image_id", "tr", "tc", "row", "col", *names))
    schema = pa.schema([("image_id", pa.int64()), ("row", pa.int32()), ("col", pa.int32()), *((k, types[t]) for k, t in outputs.items())])

    def run(batches):
        for batch, keys, starts in grouped(batches, 3):
            at = (np.asarray(batch.column(3)).astype(np.int64), np.asarray(batch.column(4)).astype(np.int64))
            low = [np.minimum.reduceat(x, starts[:-1]) for x in at]
            size = [np.maximum.reduceat(x, starts[:-1]) - lo + 1 for x, lo in zip(at, low)]
            tile_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            first = keys[starts[:-1]]
            core = [(np.maximum(0, first[:, k] * n - lo), np.minimum(sz, (first[:, k] + 1) * n - lo)) for (n, k), lo, sz in zip(sizes, low, size)]
            places = np.stack([*low, *size, *core[0], *core[1]], 1)
            kinds, which = np.unique(places, axis=0, return_inverse=True)
            for kind, (r0, c0, h, w, ra, rz, ca, cz) in enumerate(kinds.tolist()):
                if rz <= ra or cz <= ca:
                    continue
                own = np.flatnonzero(which.ravel() == kind)
                slot = np.full(len(first), -1)
                slot[own] = np.arange(len(own))
                rows_in = slot[tile_of]
                there = rows_in >= 0
                values = {}
                for c in names:
                    column = np.asarray(batch.column(batch.schema.get_field_index(c)))
                    plane = np.zeros((len(own), h, w), column.dtype)
                    plane[rows_in[there], at[0][there] - r0, at[1][there] - c0] = column[there]
                    values[c] = plane
                rows, cols = np.arange(ra, rz), np.arange(ca, cz)
                out = kernel(Tile(values, rows, cols, r0, c0))
                many = len(rows) * len(cols)
                grid = [np.repeat(first[own, 0], many), np.tile(np.repeat(rows + r0, len(cols)), len(own)), np.tile(cols + c0, len(rows) * len(own))]
                yield pa.RecordBatch.from_arrays([pa.array(a, f.type, from_pandas=False) for a, f in zip([*grid, *(np.asarray(out[k]).ravel() for k in outputs)], schema)], schema=schema)

    ddl = "image_id long, row int, col int" + "".join(f", {k} {t}" for k, t in outputs.items())
    tile = ["image_id", "tr", "tc"]
    return dealt.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(run, ddl)


def pull_taps(px: DataFrame, offsets: list[tuple], extra: tuple[str, ...] = ()) -> DataFrame:
    """Relational twin: (image_id, row, col, di, dj, extra.., n): every pixel's clamped neighbours, as an equi-join."""
    size = px.groupBy("image_id").agg(F.max("row").alias("mr"), F.max("col").alias("mc"))
    taps = F.explode(F.array(*[F.struct(F.lit(o[0]).alias("di"), F.lit(o[1]).alias("dj"), *(F.lit(x).alias(e) for e, x in zip(extra, o[2:]))) for o in offsets]))
    pulled = px.join(size, "image_id").select("image_id", "row", "col", "mr", "mc", taps.alias("o")).select(
        "image_id", "row", "col", "o.*",
        F.greatest(F.lit(0), F.least("mr", F.col("row") + F.col("o.di"))).alias("nr"),
        F.greatest(F.lit(0), F.least("mc", F.col("col") + F.col("o.dj"))).alias("nc"))
    near = px.select("image_id", F.col("row").alias("nr"), F.col("col").alias("nc"), F.col("v").alias("n"))
    return pulled.join(near, ["image_id", "nr", "nc"]).drop("nr", "nc")
