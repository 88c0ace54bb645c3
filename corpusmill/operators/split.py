"""Exact splits. Rows are compared with a cut key per group; only keys are ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.lookup import lookup
from corpusmill.operators.position import Order, by_hash, by_id, rank_cut, within_cut


def slice_splits(
    df: DataFrame, n_ft: int = 500_000, n_valid: int = 100_000, id_col: str = "row_id"
) -> DataFrame:
    """Add ``split``: the first rows by id fine-tune, the next validate, the rest train."""
    cuts = rank_cut(df.select(id_col), by_id(id_col), [lambda total: F.lit(n_ft), lambda total: F.lit(n_ft + n_valid)])
    last = [F.max(F.when(F.col("which") == i, F.col("cut0"))).alias(f"c{i}") for i in (0, 1)]
    marked = df.withColumn("_last", cuts.agg(*last).select(F.struct("c0", "c1")).scalar())
    split = F.when(F.col(id_col) <= F.col("_last.c0"), "ft").when(F.col(id_col) <= F.col("_last.c1"), "valid")
    return marked.withColumn("split", split.otherwise("train")).drop("_last")


def _share(pct: float):
    # the product of a count and a decimal fraction, cut to whole rows as int() does
    return lambda total: F.floor(total * F.lit(float(pct)))


def _split(df: DataFrame, order: Order, pct: float, groups: list[str], id_col: str, names: tuple[str, str]) -> DataFrame:
    first, rest = names
    cuts = rank_cut(df.select(*groups, id_col), order, [_share(pct)], groups)
    key = F.struct(*[F.col(f"cut{i}") for i in range(len(order.columns))]).alias("_cut")
    if groups:
        marked = lookup(df, cuts.select(*groups, key), groups)
    else:
        marked = df.withColumn("_cut", cuts.select(key).scalar())
    split = F.when(within_cut(order, F.col("_cut")), first).otherwise(rest)
    return marked.withColumn("split", split).select(*df.columns, "split")


def stratified_split(
    df: DataFrame, by: str = "api", pct: float = 0.10, seed: int = 42, id_col: str = "row_id"
) -> DataFrame:
    """Per value of ``by`` a seeded random share of the rows is ``test``, the rest ``train``."""
    return _split(df, by_hash(seed, id_col), pct, [by], id_col, ("test", "train"))


def random_split_exact(df: DataFrame, pct: float = 0.10, seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """A seeded random share of exact size is ``test``, the rest ``train``."""
    return _split(df, by_hash(seed, id_col), pct, [], id_col, ("test", "train"))


def prefix_split(
    df: DataFrame, pct: float = 0.10, groups: list[str] | None = None, id_col: str = "row_id"
) -> DataFrame:
    """Per group the first share of rows, by id, is ``valid``, the rest ``train``."""
    groups = groups or []
    return _split(df, by_id(id_col), pct, groups, id_col, ("valid", "train"))
