"""Histograms, cumulative distributions and equalisation."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.color import rgb_to_yuv, yuv_to_rgb
from rasterloom.functions.rounding import clamp_round

LEVELS = 256
#: Rows of a strip within which occurrences are numbered; ranks never need a whole image in one task.
STRIP = 64


def histogram(px: DataFrame, keys=("image_id",), value="v") -> DataFrame:
    """(keys, level, n), dense over 0..255. Partial aggregation leaves at most 256 rows a key before the shuffle."""
    counted = px.groupBy(*keys, F.col(value).alias("level")).agg(F.count("*").alias("n"))
    tallies = counted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("m"))
    return (tallies.select(*keys, "m", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"))
            .select(*keys, "level", F.coalesce(F.try_element_at("m", F.col("level")), F.lit(0)).cast("long").alias("n")))


def cdf(px: DataFrame, keys=("image_id",), value="v") -> DataFrame:
    """(keys, level, n, cdf, total); the window runs over 256 rows of a key."""
    by = Window.partitionBy(*keys)
    run = by.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return histogram(px, keys, value).withColumn("cdf", F.sum("n").over(run)).withColumn("total", F.sum("n").over(by))


def cdf_normalized(px: DataFrame) -> DataFrame:
    return cdf(px).select("image_id", "level", (F.col("cdf") / F.col("total")).alias("cdf"))


def intensity_range(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id").agg(F.min("v").alias("v_min"), F.max("v").alias("v_max"))


def transfer_function(px: DataFrame, value="v") -> DataFrame:
    """(image_id, level, mapped): equalising look-up table; a constant image maps to 0, levels below the first occupied to 0."""
    first = F.min(F.when(F.col("n") > 0, F.col("cdf"))).over(Window.partitionBy("image_id"))
    t = cdf(px, value=value).withColumn("first", first)
    span = F.col("total") - F.col("first")
    mapped = F.when(span == 0, F.lit(0)).otherwise(clamp_round(F.lit(255.0) * (F.col("cdf") - F.col("first")) / F.when(span == 0, 1).otherwise(span)))
    return t.select("image_id", "level", mapped.cast("int").alias("mapped"))


def apply_lut(px: DataFrame, lut: DataFrame, value="v") -> DataFrame:
    """Replace `value` by the table's mapping: one row of 256 levels an image is joined, so no level is a key however common it is. Levels that the table lacks become null; images that it lacks drop out."""
    level = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.try_element_at(F.col("m__"), k))
    tables = lut.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("level", "mapped"))).alias("m__")).select("image_id", level.alias("lut__"))
    return px.join(tables, "image_id").select(*[F.col(c) if c != value else F.get("lut__", F.col(value)).alias(value) for c in px.columns])


def equalize_lut(px: DataFrame, value="v") -> DataFrame:
    return apply_lut(px, transfer_function(px, value), value)


def equalize_bucket(px: DataFrame, value="v") -> DataFrame:
    """Bucket filling: pixels ranked by level, then scan order; output floor(256 rank / N).

    The rank is a prefix of counts by (level, strip) plus the occurrence number within (level, strip).
    """
    cut = px.withColumn("strip__", F.floor(F.col("row") / STRIP).cast("int"))
    keys = ["image_id", value, "strip__"]
    counts = cut.groupBy(*keys).agg(F.count("*").alias("n__"))
    run = Window.partitionBy("image_id").orderBy(value, "strip__").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = counts.select(*keys, (F.sum("n__").over(run) - F.col("n__")).alias("base__"), F.sum("n__").over(Window.partitionBy("image_id")).alias("total__"))
    occurrence = F.row_number().over(Window.partitionBy(*keys).orderBy("row", "col")) - 1
    ranked = cut.withColumn("occ__", occurrence).join(bases, keys)
    out = F.least(F.lit(255), F.floor((F.col("base__") + F.col("occ__")) * LEVELS / F.col("total__"))).cast("int")
    return ranked.select(*[F.col(c) if c != value else out.alias(value) for c in px.columns])


def equalize_luma(rgb: DataFrame, method: str = "lut") -> DataFrame:
    """RGB through YUV, luma equalised by 'lut', 'bucket' or a callable on (image_id, row, col, y, ..), and back."""
    planes = rgb_to_yuv(rgb, v="vv")
    how = {"lut": equalize_lut, "bucket": equalize_bucket}.get(method, method)
    return yuv_to_rgb(how(planes, "y"), v="vv")
