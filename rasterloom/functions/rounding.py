"""The roundings that the operators use, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: int = 0, high: int = 255) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def clamp_trunc(x: Column) -> Column:
    """Clamp to 0..255, then truncate x + 0.5."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), x)) + F.lit(0.5)).cast("int")


def clamp_round(x: Column) -> Column:
    """Round halves away from zero, then clamp to 0..255."""
    return clamp(F.round(x)).cast("int")
