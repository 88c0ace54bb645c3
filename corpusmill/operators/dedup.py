"""Exact duplicates by content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedup_first(df: DataFrame, key: Column | str, order: str = "row_id") -> DataFrame:
    """The first row, by the unique column ``order``, of each ``key``.

    The minimum per key is taken over ``(key, order)`` alone and merged within each task
    before the shuffle, so very many copies of one text weigh nothing. The rows themselves
    are then kept by their unique id: they move once at most and are sorted by no window.
    """
    key = F.col(key) if isinstance(key, str) else key
    first = df.groupBy(key.alias("_key")).agg(F.min(order).alias(order)).select(order)
    return df.join(first, order, "left_semi").select(*df.columns)


def duplicate_fraction(df: DataFrame, key: Column | str) -> DataFrame:
    """One row: share of rows that repeat an earlier key."""
    key = F.col(key) if isinstance(key, str) else key
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(key).alias("n_distinct"),
        (1 - F.count_distinct(key) / F.count(F.lit(1))).alias("duplicate_fraction"),
    )
