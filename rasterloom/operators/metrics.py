"""White balance and fidelity metrics."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.rounding import clamp_trunc

IDENTICAL = 1e9


def channel_means(rgb: DataFrame) -> DataFrame:
    return rgb.groupBy("image_id").agg(*[F.avg(c).alias(f"mean_{c}") for c in "rgb"])


def gray_world_gains(rgb: DataFrame) -> DataFrame:
    """(image_id, mean_*, gain_*): gains that give every channel the mean of the means; 1 where a channel is empty."""
    m = channel_means(rgb)
    mu = (F.col("mean_r") + F.col("mean_g") + F.col("mean_b")) / 3
    return m.select("*", *[F.when(F.col(f"mean_{c}") <= 1e-12, F.lit(1.0)).otherwise(mu / F.when(F.col(f"mean_{c}") <= 1e-12, 1.0).otherwise(F.col(f"mean_{c}"))).alias(f"gain_{c}") for c in "rgb"])


def gray_world(rgb: DataFrame) -> DataFrame:
    g = gray_world_gains(rgb).select("image_id", "gain_r", "gain_g", "gain_b")
    return rgb.join(g, "image_id").select("image_id", "row", "col", *[clamp_trunc(F.col(f"gain_{c}") * F.col(c)).alias(c) for c in "rgb"])


def psnr_of(mse):
    return F.when(mse == 0, F.lit(IDENTICAL)).otherwise(F.lit(10.0) * F.log10(F.lit(65025.0) / F.when(mse == 0, 1.0).otherwise(mse)))


def aligned(a: DataFrame, b: DataFrame, planes: str) -> DataFrame:
    """(image_id, squared difference of each plane) of every pixel; a pixel that one raster lacks raises."""
    other = b.select("image_id", "row", "col", *[F.col(c).alias(f"{c}__") for c in planes])
    pairs = a.select("image_id", "row", "col", *planes).join(other, ["image_id", "row", "col"], "full")

    def square(c):
        d = F.col(c) - F.col(f"{c}__")
        lost = F.raise_error(F.format_string("pixel (%d, %d) of image %d is in one raster only", "row", "col", "image_id"))
        return F.when(d.isNull(), lost.cast("long")).otherwise((d * d).cast("long")).alias(c)

    return pairs.select("image_id", *[square(c) for c in planes])


def psnr_gray(a: DataFrame, b: DataFrame) -> DataFrame:
    """(image_id, mse, psnr) of two rasters with the same pixels; the sentinel 1e9 for identical ones."""
    return aligned(a, b, "v").groupBy("image_id").agg(F.avg("v").alias("mse")).select("image_id", "mse", psnr_of(F.col("mse")).alias("psnr"))


def psnr_rgb(a: DataFrame, b: DataFrame) -> DataFrame:
    """(image_id, psnr_r, psnr_g, psnr_b, psnr_avg): the average is of the three values in dB."""
    m = aligned(a, b, "rgb").groupBy("image_id").agg(*[F.avg(c).alias(c) for c in "rgb"])
    p = m.select("image_id", *[psnr_of(F.col(c)).alias(f"psnr_{c}") for c in "rgb"])
    return p.withColumn("psnr_avg", (F.col("psnr_r") + F.col("psnr_g") + F.col("psnr_b")) / 3)
