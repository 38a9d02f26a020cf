"""Top-n over a frame and per group, always with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_n_per(df: DataFrame, by: str, n: int, *order: Column | str, rank: str = "rank") -> DataFrame:
    """The n first rows per `by`; Spark prunes each map task to n before the shuffle."""
    window = Window.partitionBy(by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row per key of a dimension: the lowest remaining column values win."""
    rest = [c for c in df.columns if c != key]
    return (
        df.groupBy(key)
        .agg(F.min(F.struct(*rest)).alias("__row"))
        .select(key, *[F.col(f"__row.{c}").alias(c) for c in rest])
    )
