"""Rasters built from the test tables; each has a DuckDB twin in sql.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.rounding import clamp


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quantise(x):
    return clamp(F.floor((x.cast("double") + 0.5) * 255 + 0.5)).cast("int")


def elements(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", "i", quantise(F.col("x")).alias("v"))


def f1(spark, sf_dir: str) -> DataFrame:
    """Gray: a row for each vector, a column for each component."""
    return elements(spark, sf_dir).select(F.lit(0).cast("long").alias("image_id"), F.col("vec_id").cast("int").alias("row"), F.col("i").alias("col"), "v")


def f1b(spark, sf_dir: str) -> DataFrame:
    """f1 without its last column: a pixel count that 256 does not divide."""
    return f1(spark, sf_dir).where("col < 63")


def f2(spark, sf_dir: str) -> DataFrame:
    """A batch of 8 x 8 images, one a vector."""
    return elements(spark, sf_dir).select(F.col("vec_id").alias("image_id"), F.floor(F.col("i") / 8).cast("int").alias("row"), (F.col("i") % 8).alias("col"), "v")


def f3(spark, sf_dir: str) -> DataFrame:
    """RGB: three vectors a row; an incomplete last row is left out."""
    e = elements(spark, sf_dir).select(F.floor(F.col("vec_id") / 3).cast("int").alias("row"), (F.col("vec_id") % 3).alias("ch"), F.col("i").alias("col"), "v")
    wide = e.groupBy("row", "col").agg(F.count("*").alias("n"), *[F.max(F.when(F.col("ch") == i, F.col("v"))).alias(c) for i, c in enumerate("rgb")])
    return wide.where("n = 3").select(F.lit(0).cast("long").alias("image_id"), "row", "col", "r", "g", "b")


def noisy(v, row, col):
    k = (31 * row + 17 * col) % 97
    return F.when(k == 0, 255).when(k == 1, 0).otherwise(clamp(v + (7919 * row + 104729 * col) % 41 - 20)).cast("int")


def f5(spark, sf_dir: str) -> DataFrame:
    return f1(spark, sf_dir).withColumn("v", noisy(F.col("v"), F.col("row"), F.col("col")))


def f5rgb(spark, sf_dir: str) -> DataFrame:
    return f3(spark, sf_dir).select("image_id", "row", "col", *[noisy(F.col(c), F.col("row") + i, F.col("col")).alias(c) for i, c in enumerate("rgb")])


def f7(spark, sf_dir: str) -> DataFrame:
    """Skewed gray from event values."""
    e = table(spark, sf_dir, "events")
    return e.select(F.lit(0).cast("long").alias("image_id"), F.floor(F.col("event_id") / 100).cast("int").alias("row"), (F.col("event_id") % 100).cast("int").alias("col"), clamp(F.floor(F.col("value").cast("double") + 0.5)).cast("int").alias("v"))


def f8(spark, sf_dir: str, rows: int = 60, cols: int = 96) -> DataFrame:
    """Piecewise smooth: ramps with wraps."""
    r, c = F.floor(F.col("id") / cols).cast("int"), (F.col("id") % cols).cast("int")
    return spark.range(rows * cols).select(F.lit(0).cast("long").alias("image_id"), r.alias("row"), c.alias("col"), ((3 * r + 2 * c) % 256).cast("int").alias("v"))
