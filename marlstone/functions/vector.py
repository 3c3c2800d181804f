"""Vector functions as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null where a vector is."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null where a vector has no length."""
    return F.try_divide(dot(a, b), F.nullif(norm(a) * norm(b), F.lit(0.0)))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    return F.when(norm(a) > 0, F.transform(a, lambda v: v.cast("double") / norm(a))).otherwise(F.transform(a, lambda v: v.cast("double")))


def majority_length(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector has the most common length (the smaller of two as common); null vectors drop out."""
    sizes = df.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("_size")).agg(F.count(F.lit(1)).alias("_n"))
    common = sizes.orderBy(F.desc("_n"), "_size").first()
    return df.where(F.size(column) == common["_size"]) if common else df.where(F.lit(False))


def min_max(value: Column, over: Window | None = None) -> Column:
    """Value scaled to 0..1 within its window; all ones where all are equal."""
    w = over if over is not None else Window.partitionBy(F.lit(0))
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi == lo, F.lit(1.0)).otherwise((value - lo) / (hi - lo))


def scaled(df: DataFrame, column: str, out: str) -> DataFrame:
    """``min_max`` over the whole table by its two bounds, so that no single task has to hold the table."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    value = F.lit(1.0) if lo == hi else (F.col(column) - F.lit(lo)) / F.lit(None if lo is None else hi - lo)
    return df.withColumn(out, F.when(F.col(column).isNotNull(), value))
