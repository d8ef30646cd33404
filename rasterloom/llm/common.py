"""Shared helpers of the training-data operators: tables, batches, column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.sources.shared import cut, discard, shared_dir  # noqa: F401

#: Rows in an Arrow batch handed to Python; texts can be long, so batches stay small.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts within a Python worker's memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name like `name` that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str):
    """A column by its literal name, dots and backquotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def held_out(doc_id="doc_id"):
    """True where crc32 of the decimal id leaves remainder 1 modulo 3; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
