"""Joins with lists and tables that are unique on their key, safe against hot keys on the left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join with a list that is unique on ``keys``, by one plan for lists of any length.

    Spark broadcasts the list when its measured size allows; in a shuffled join AQE splits the
    left rows of a hot key, each part meeting the list's one row.
    """
    return left.join(right, keys, "left")


def spread_lookup(
    left: DataFrame, right: DataFrame, keys: list[str], n_left: str, spread: Column, hot_share: int = 1024
) -> DataFrame:
    """Left join with a large table that is unique on ``keys`` and counts the left rows of each.

    Keys of at least one in ``hot_share`` left rows are at most ``hot_share`` many by that
    definition, so their right rows are broadcast. Their left rows then pass the shuffled join
    under a salt made from ``spread``: they go everywhere and match nothing there.
    """
    values = [c for c in right.columns if c not in (*keys, n_left)]
    total = right.agg(F.sum(n_left)).scalar()
    hot = right.filter(F.col(n_left) * hot_share >= total).select(
        *keys, F.struct(*values).alias("_hot"), F.lit(True).alias("_is_hot")
    )
    marked = left.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_is_hot"), F.xxhash64(spread)).otherwise(F.lit(0).cast("long"))
    )
    # a hot row whose salt happens to be 0 may match below; it then finds the same values
    cold = right.select(*keys, F.lit(0).cast("long").alias("_salt"), F.struct(*values).alias("_cold"))
    joined = marked.join(cold, [*keys, "_salt"], "left")
    return joined.select(
        *left.columns, *[F.coalesce(F.col(f"_hot.{v}"), F.col(f"_cold.{v}")).alias(v) for v in values]
    )
