"""Colour-space projections; all stay in generated code."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.rounding import clamp, clamp_trunc

#: Video-range luma and chroma weights (r, g, b, offset) and their inverse (y, u, v).
YUV = {"y": (0.257, 0.504, 0.098, 16.0), "u": (-0.148, -0.291, 0.439, 128.0), "v": (0.439, -0.368, -0.071, 128.0)}
Y_GAIN, R_V, G_V, G_U, B_U = 1.164, 1.596, 0.813, 0.391, 2.018
GRAY = (0.2989, 0.5870, 0.1140)


def yuv(r: Column, g: Column, b: Column) -> dict[str, Column]:
    def plane(w):
        return clamp_trunc(F.lit(w[0]) * r + F.lit(w[1]) * g + F.lit(w[2]) * b + F.lit(w[3]))

    return {name: plane(w) for name, w in YUV.items()}


def rgb_to_yuv(df: DataFrame, y="y", u="u", v="v") -> DataFrame:
    """(.., r, g, b) to integer planes y, u, v."""
    planes = yuv(F.col("r"), F.col("g"), F.col("b"))
    keep = [c for c in df.columns if c not in ("r", "g", "b")]
    return df.select(*keep, planes["y"].alias(y), planes["u"].alias(u), planes["v"].alias(v))


def yuv_to_rgb(df: DataFrame, y="y", u="u", v="v") -> DataFrame:
    """Integer planes to (.., r, g, b); lossy against rgb_to_yuv because the planes are quantised."""
    luma, du, dv = F.lit(Y_GAIN) * (F.col(y) - 16), F.col(u) - 128, F.col(v) - 128
    keep = [c for c in df.columns if c not in (y, u, v)]
    return df.select(*keep, clamp_trunc(luma + F.lit(R_V) * dv).alias("r"), clamp_trunc(luma - F.lit(G_V) * dv - F.lit(G_U) * du).alias("g"), clamp_trunc(luma + F.lit(B_U) * du).alias("b"))


def gray(df: DataFrame, kind: str = "double") -> DataFrame:
    """(.., r, g, b) to (.., v); kind 'float' computes in single precision, which rounds differently at times."""
    r, g, b = (F.lit(w).cast(kind) * F.col(c).cast(kind) for w, c in zip(GRAY, "rgb"))
    total = ((r + g).cast(kind) + b).cast(kind)
    keep = [c for c in df.columns if c not in ("r", "g", "b")]
    return df.select(*keep, clamp(F.round(total)).cast("int").alias("v"))


def to_long(df: DataFrame) -> DataFrame:
    """(image_id, row, col, r, g, b) to (image_id, row, col, ch, v)."""
    return df.select("image_id", "row", "col", F.explode(F.array(*[F.struct(F.lit(i).alias("ch"), F.col(c).alias("v")) for i, c in enumerate("rgb")])).alias("p")).select("image_id", "row", "col", "p.ch", "p.v")


def to_wide(df: DataFrame) -> DataFrame:
    """The inverse of to_long; a missing channel gives null."""
    return df.groupBy("image_id", "row", "col").agg(*[F.max(F.when(F.col("ch") == i, F.col("v"))).alias(c) for i, c in enumerate("rgb")])


def first_channel(df: DataFrame) -> DataFrame:
    return df.where("ch = 0").select("image_id", "row", "col", "v")
