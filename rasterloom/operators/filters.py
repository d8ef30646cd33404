"""Demosaicing, smoothing, denoising and Sobel edges on the stencil runner."""

from __future__ import annotations

from math import exp

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.color import gray
from rasterloom.operators.stencil import Tile, apply_stencil, join_by_image, part_of
from rasterloom.operators.validate import odd, percent, positive

RGB = ("r", "g", "b")


def half_away(x: np.ndarray) -> np.ndarray:
    """Halves away from zero for non-negative x, exact at every double."""
    low = np.floor(x)
    return (low + (x - low >= 0.5)).clip(0, 255).astype(np.int32)


def bayer_site(row, col):
    """Column with 'r', 'g' or 'b': the colour sampled at a site (rows start G R and B G)."""
    return F.when((row % 2 == 0) & (col % 2 == 1), "r").when((row % 2 == 1) & (col % 2 == 0), "b").otherwise("g")


def demosaic(cfa: DataFrame) -> DataFrame:
    """(image_id, row, col, v) to (.., r, g, b), bilinear with truncating division; borders replicate samples as they lie."""
    def kernel(t: Tile):
        p = {(i, j): t.tap("v", i, j).astype(np.int64) for i in (-1, 0, 1) for j in (-1, 0, 1)}
        odd_row = ((t.rows + t.row0) % 2 == 1)[:, None]
        odd_col = ((t.cols + t.col0) % 2 == 1)[None, :]
        cross = (p[-1, 0] + p[1, 0] + p[0, -1] + p[0, 1]) // 4
        corner = (p[-1, -1] + p[-1, 1] + p[1, -1] + p[1, 1]) // 4
        flat, tall = (p[0, -1] + p[0, 1]) // 2, (p[-1, 0] + p[1, 0]) // 2
        red, blue = ~odd_row & odd_col, odd_row & ~odd_col
        own = p[0, 0]
        r = np.where(red, own, np.where(blue, corner, np.where(odd_row, tall, flat)))
        b = np.where(blue, own, np.where(red, corner, np.where(odd_row, flat, tall)))
        return {"r": r, "g": np.where(red | blue, cross, own), "b": b}

    return apply_stencil(cfa, kernel, 1, outputs={c: "int" for c in RGB})


def uniform_weights(k: int) -> list[tuple[int, int, float]]:
    odd(k)
    return [(i, j, 1.0 / (k * k)) for i in range(-(k // 2), k // 2 + 1) for j in range(-(k // 2), k // 2 + 1)]


def gaussian_weights(k: int, sigma: float) -> list[tuple[int, int, float]]:
    odd(k)
    positive(sigma, "sigma")
    raw = [(i, j, exp(-(i * i + j * j) / (2 * sigma * sigma))) for i, j, _ in uniform_weights(k)]
    total = 0.0
    for _, _, w in raw:
        total += w
    return [(i, j, w / total) for i, j, w in raw]


def convolve(px: DataFrame, weights: list[tuple[int, int, float]], planes=("v",)) -> DataFrame:
    """Weighted sum of taps in row-major order, rounded halves away from zero and clamped; planes are independent."""
    def kernel(t: Tile):
        out = {}
        for c in planes:
            total = 0.0
            for i, j, w in weights:
                total = total + w * t.tap(c, i, j)
            out[c] = half_away(total)
        return out

    return apply_stencil(px, kernel, max(abs(i) for i, _, _ in weights), planes, {c: "int" for c in planes})


def uniform_filter(px: DataFrame, k: int, planes=("v",)) -> DataFrame:
    return convolve(px, uniform_weights(k), planes)


def gaussian_filter(px: DataFrame, k: int, sigma: float, planes=("v",)) -> DataFrame:
    return convolve(px, gaussian_weights(k, sigma), planes)


def bilateral_filter(px: DataFrame, k: int, sigma_space: float, sigma_range: float) -> DataFrame:
    odd(k)
    positive(sigma_space, "sigma_space")
    positive(sigma_range, "sigma_range")
    near = np.array([exp(-(d * d) / (2 * sigma_range * sigma_range)) for d in range(256)])
    taps = [(i, j, exp(-(i * i + j * j) / (2 * sigma_space * sigma_space))) for i, j, _ in uniform_weights(k)]

    def kernel(t: Tile):
        centre = t.tap("v", 0, 0).astype(np.int64)
        top, bottom = np.zeros(centre.shape), np.zeros(centre.shape)
        for i, j, s in taps:
            v = t.tap("v", i, j).astype(np.int64)
            w = s * near[np.abs(v - centre)]
            top += w * v
            bottom += w
        return {"v": np.where(bottom > 0, half_away(top / np.where(bottom > 0, bottom, 1)), centre)}

    return apply_stencil(px, kernel, k // 2)


def median_filter(px: DataFrame, k: int, planes=("v",)) -> DataFrame:
    odd(k)
    taps = [(i, j) for i, j, _ in uniform_weights(k)]

    def kernel(t: Tile):
        return {c: np.partition(np.stack([t.tap(c, i, j) for i, j in taps]), k * k // 2, axis=0)[k * k // 2] for c in planes}

    return apply_stencil(px, kernel, k // 2, planes, {c: "int" for c in planes})


def nlm(px: DataFrame, h: float, patch: int, search: int, planes=("v",), a: float | None = None) -> DataFrame:
    """Non-local means. Gray with `a`: Gaussian-weighted mean patch distance, the pixel itself left out. Without `a`:
    plain sum over the patch and all planes, the pixel itself included, one weight for all planes."""
    odd(patch, "patch size")
    odd(search, "search window")
    positive(h, "h")
    half, reach = patch // 2, search // 2
    spots = [(i, j) for i in range(-half, half + 1) for j in range(-half, half + 1)]
    g = [exp(-(i * i + j * j) / (2 * (a if a > 0 else 1.0) ** 2)) for i, j in spots] if a is not None else None
    norm = sum(g) if g else 1.0

    def kernel(t: Tile):
        base = [[t.tap(c, i, j).astype(np.float64) for c in planes] for i, j in spots]
        top, bottom = [0.0 for _ in planes], 0.0
        limit = t.values[planes[0]].shape[-2:]
        for si in range(-reach, reach + 1):
            r = np.clip(t.rows + si, 0, limit[0] - 1)
            for sj in range(-reach, reach + 1):
                c = np.clip(t.cols + sj, 0, limit[1] - 1)
                dist = 0.0
                for s, (i, j) in enumerate(spots):
                    for p, name in enumerate(planes):
                        d = base[s][p] - t.tap(name, i, j, r, c)
                        dist = dist + (d * d * g[s] if g else d * d)
                w = np.exp(-(dist / norm) / (h * h))
                if g:
                    w = np.where((r == t.rows)[:, None] & (c == t.cols)[None, :], 0.0, w)
                for p, name in enumerate(planes):
                    top[p] = top[p] + w * t.values[name][..., r[:, None], c[None, :]]
                bottom = bottom + w
        safe = np.where(bottom > 0, bottom, 1)
        return {name: np.where(bottom > 0, half_away(top[p] / safe), t.tap(name, 0, 0)) for p, name in enumerate(planes)}

    return apply_stencil(px, kernel, half + reach, planes, {c: "int" for c in planes})


def median_then_gaussian(rgb: DataFrame, k: int, gk: int, sigma: float) -> DataFrame:
    gaussian_weights(gk, sigma)
    return median_filter(rgb, k, RGB).transform(lambda d: gaussian_filter(d, gk, sigma, RGB))


def median_then_nlm(rgb: DataFrame, k: int, h: float, patch: int, search: int) -> DataFrame:
    odd(patch), odd(search), positive(h, "h")
    return median_filter(rgb, k, RGB).transform(lambda d: nlm(d, h, patch, search, RGB))


def sobel_gradients(px: DataFrame) -> DataFrame:
    """(image_id, row, col, gx, gy): correlation with the 3 x 3 Sobel kernels; gy is positive upwards."""
    def kernel(t: Tile):
        p = {(i, j): t.tap("v", i, j).astype(np.int32) for i in (-1, 0, 1) for j in (-1, 0, 1)}
        gx = p[-1, 1] + 2 * p[0, 1] + p[1, 1] - p[-1, -1] - 2 * p[0, -1] - p[1, -1]
        gy = p[-1, -1] + 2 * p[-1, 0] + p[-1, 1] - p[1, -1] - 2 * p[1, 0] - p[1, 1]
        return {"gx": gx, "gy": gy}

    return apply_stencil(px, kernel, 1, outputs={"gx": "int", "gy": "int"})


def normalise(df: DataFrame, *planes: str) -> DataFrame:
    """Each plane scaled to 0..255 by its image's range in single precision; a flat plane gives 0."""
    ends = df.groupBy("image_id").agg(*[f(c).cast("float").alias(f"{c}_{n}") for c in planes for n, f in (("lo", F.min), ("hi", F.max))],
                                       F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), part_of())).alias("parts"))
    one = F.lit(1.0).cast("float")

    def scaled(c):
        x, lo, hi = F.col(c).cast("float"), F.col(f"{c}_lo"), F.col(f"{c}_hi")
        span = (hi - lo).cast("float")
        ratio = ((x - lo).cast("float") / F.when(span < 1e-12, one).otherwise(span)).cast("float")
        return F.when(span < 1e-12, F.lit(0)).otherwise(F.round((ratio * F.lit(255.0).cast("float")).cast("float")).cast("int")).alias(c)

    return join_by_image(df, ends, ["image_id"], "parts").select(*[scaled(c) if c in planes else F.col(c) for c in df.columns])


def sobel_magnitude(px: DataFrame) -> DataFrame:
    """(image_id, row, col, gx, gy, mag), each normalised to 0..255."""
    g = sobel_gradients(px)
    mag = F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("double")).cast("float")
    return normalise(g.withColumn("mag", mag), "gx", "gy", "mag")


def threshold_of(share: float) -> int:
    """Gray level of a percentage: round(percent / 100 * 255)."""
    percent(share)
    return int(float(np.float32(np.float32(share) / np.float32(100)) * np.float32(255)) + 0.5)


def edge_map(strength: DataFrame, share: float, value: str = "mag") -> DataFrame:
    """Dark edges: 0 where the strength reaches the threshold, 255 elsewhere."""
    return strength.select("image_id", "row", "col", F.when(F.col(value) >= threshold_of(share), 0).otherwise(255).alias("v"))


def invert_binary(px: DataFrame) -> DataFrame:
    """Nonzero to 0, zero to 255."""
    return px.select("image_id", "row", "col", F.when(F.col("v") != 0, 0).otherwise(255).alias("v"))


def sobel_edges(px: DataFrame, share: float = 25.0) -> DataFrame:
    return edge_map(sobel_magnitude(px), share)


def sobel_pipeline(rgb: DataFrame, share: float = 25.0) -> DataFrame:
    """RGB to (image_id, row, col, gray, gx, gy, mag, edge): the five rasters of the detector."""
    g = gray(rgb, "float")
    m = sobel_magnitude(g)
    return g.withColumnRenamed("v", "gray").join(m, ["image_id", "row", "col"]).withColumn("edge", F.when(F.col("mag") >= threshold_of(share), 0).otherwise(255))
