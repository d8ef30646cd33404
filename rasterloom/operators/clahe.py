"""Contrast-limited adaptive histogram equalisation (Zuiderveld 1994) with equal tiles over a mirrored border."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 256


def tables(counts: np.ndarray, area: int, clip: float) -> np.ndarray:
    """Look-up tables (tiles, 256) of tile histograms (tiles, 256), in single precision.

    Counts over the limit are cut off and handed out: a whole share for every level, the rest one each at an even
    stride from level 0.
    """
    limit = max(1, int(clip * area / LEVELS))
    excess = np.maximum(counts - limit, 0).sum(1)
    rest = excess % LEVELS
    stride = np.maximum(LEVELS // np.maximum(rest, 1), 1)[:, None]
    level = np.arange(LEVELS)
    more = (level % stride == 0) & (level // stride < rest[:, None])
    flat = np.minimum(counts, limit) + (excess // LEVELS)[:, None] + more
    scaled = np.cumsum(flat, axis=1).astype(np.float32) * (np.float32(LEVELS - 1) / np.float32(area))
    return np.clip(np.rint(scaled), 0, LEVELS - 1).astype(np.int32)


def tiles_of(c: str, n: str, pad: Column, size: Column) -> Column:
    """Tiles that a pixel counts in: its own and, for the last ones, those where the border mirrors it (the last pixel itself is not repeated)."""
    own = F.floor(F.col(c) / size).cast("int")
    period = F.greatest(F.lit(1), 2 * (F.col(n) - 1))

    def source(p):
        m = p % period
        return F.when(F.col(n) == 1, 0).when(m < F.col(n), m).otherwise(period - m)

    beyond = F.filter(F.sequence(F.col(n), F.col(n) + pad - 1), lambda p: source(p) == F.col(c))
    mirrored = F.concat(F.array(own), F.transform(beyond, lambda p: F.floor(p / size).cast("int")))
    return F.when((pad == 0) | (F.col(c) < F.col(n) - 1 - pad), F.array(own)).otherwise(mirrored)


def clahe(px: DataFrame, clip: float = 2.0, tiles_x: int = 8, tiles_y: int = 8, value: str = "v") -> DataFrame:
    """Bilinear mix of the tables of the four tiles whose centres surround a pixel.

    Where the tiles do not divide both sides, the image is mirrored to the next multiples (a whole tile number more on
    a side that they do divide), and tiles are equal. Tables use single precision and round halves to even.
    tiles < 1 become 1, clip <= 0 becomes 0.1. One row of tables an image is joined to the pixels; levels are looked
    up by position, so no level is a key.
    """
    tiles_x, tiles_y, clip = max(1, tiles_x), max(1, tiles_y), clip if clip > 0 else 0.1
    size = px.groupBy("image_id").agg((F.max("row") + 1).alias("h__"), (F.max("col") + 1).alias("w__"))
    even = (F.col("h__") % tiles_y == 0) & (F.col("w__") % tiles_x == 0)
    pads = {n: F.when(even, 0).otherwise(t - F.col(n) % t) for n, t in (("h__", tiles_y), ("w__", tiles_x))}
    size = size.select("*", pads["h__"].alias("ph__"), pads["w__"].alias("pw__"))
    size = size.select("*", ((F.col("h__") + F.col("ph__")) / tiles_y).cast("int").alias("th__"), ((F.col("w__") + F.col("pw__")) / tiles_x).cast("int").alias("tw__"))
    counted = (px.join(size, "image_id")
               .select("image_id", "th__", "tw__", F.col("col"), "w__", "pw__", F.col(value).alias("level__"), F.explode(tiles_of("row", "h__", F.col("ph__"), F.col("th__"))).alias("ty__"))
               .select("image_id", "th__", "tw__", "level__", "ty__", F.explode(tiles_of("col", "w__", F.col("pw__"), F.col("tw__"))).alias("tx__"))
               .groupBy("image_id", "th__", "tw__", ((F.col("ty__") * tiles_x + F.col("tx__")) * LEVELS + F.col("level__")).alias("cell__")).agg(F.count("*").alias("n__")))
    whole = counted.groupBy("image_id", "th__", "tw__").agg(F.collect_list("cell__").alias("cells__"), F.collect_list("n__").alias("ns__"))

    def run(batches):
        for b in batches:
            luts = []
            for th, tw, cells, ns in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4))):
                counts = np.zeros(tiles_x * tiles_y * LEVELS, np.int64)
                counts[np.array(cells)] = ns
                luts.append(tables(counts.reshape(-1, LEVELS), th * tw, clip).ravel())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(luts, pa.list_(pa.int32()))], ["image_id", "th__", "tw__", "lut__"])

    luts = whole.mapInArrow(run, "image_id long, th__ int, tw__ int, lut__ array<int>")
    one, half = F.lit(1.0).cast("float"), F.lit(0.5).cast("float")

    def axis(c, n, tiles):
        """First and second tile and the weights of both, in single precision."""
        at = F.col(c).cast("float") * (one / F.col(n).cast("float")).cast("float") - half
        low = F.floor(at).cast("int")
        share = at - low.cast("float")
        return F.greatest(low, F.lit(0)), F.least(low + 1, F.lit(tiles - 1)), one - share, share

    out = px.join(luts, "image_id")
    names = {}
    for k, (c, n, tiles) in {"y": ("row", "th__", tiles_y), "x": ("col", "tw__", tiles_x)}.items():
        names |= {f"{k}{i}__": column for i, column in enumerate(axis(c, n, tiles))}
    out = out.select("*", *[column.alias(k) for k, column in names.items()])

    def level(ty, tx):
        return F.get("lut__", (F.col(ty) * tiles_x + F.col(tx)) * LEVELS + F.col(value)).cast("float")

    mixed = (level("y0__", "x0__") * F.col("x2__") + level("y0__", "x1__") * F.col("x3__")) * F.col("y2__") + (level("y1__", "x0__") * F.col("x2__") + level("y1__", "x1__") * F.col("x3__")) * F.col("y3__")
    rounded = F.greatest(F.lit(0), F.least(F.lit(255), F.rint(mixed).cast("int")))
    return out.select(*[F.col(c) if c != value else rounded.alias(value) for c in px.columns])
