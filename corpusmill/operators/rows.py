"""Projections, filters, labels of rows and stage counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.position import by_id, rank_cut

# The ordinal of each domain in a continual run, and the label of rows outside them.
TASKS = {"general": 0, "security": 1, "android": 2, "web": 3, "guava": 4}
NO_LABEL = "NaN"


def drop_columns(df: DataFrame, cols: Sequence[str], strict: bool = True) -> DataFrame:
    """Drop columns; a missing one is an error, which ``DataFrame.drop`` would hide."""
    missing = [c for c in cols if c not in df.columns]
    if strict and missing:
        raise ValueError(f"no such columns: {missing}")
    return df.drop(*cols)


def keep_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep those of ``cols`` that exist, in table order."""
    return df.select(*[c for c in df.columns if c in cols])


def ensure_labels(df: DataFrame) -> DataFrame:
    """Add constant ``domain`` and ``api`` columns where both are absent."""
    if "domain" in df.columns or "api" in df.columns:
        return df
    return df.withColumns({"domain": F.lit(NO_LABEL), "api": F.lit(NO_LABEL)})


def filter_domain(df: DataFrame, domain: str) -> DataFrame:
    return df if domain == "all" else df.filter(F.col("domain") == domain)


def task_id(tasks: dict[str, int] = TASKS, column: str = "domain") -> Column:
    """Ordinal of the domain as a literal map lookup; null for unlisted domains."""
    pairs = [F.lit(x) for item in tasks.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.col(column))


def assign_task(df: DataFrame, domains: Sequence[str] = tuple(TASKS)) -> DataFrame:
    """Tag rows with their ``task_id`` in one pass; rows of other domains drop out."""
    chosen = {d: TASKS[d] for d in domains}
    return df.filter(F.col("domain").isin(*chosen)).withColumn("task_id", task_id(chosen))


def tag_experience(df: DataFrame, domains: Sequence[str] = tuple(TASKS)) -> DataFrame:
    """Tag rows with ``exp_id``, the place of their domain in the training order."""
    order = {d: i for i, d in enumerate(domains)}
    return df.filter(F.col("domain").isin(*order)).withColumn("exp_id", task_id(order))


def filter_max_lines(df: DataFrame, n: int = 250, column: str = "lines") -> DataFrame:
    return df.filter(F.col(column) <= n)


def filter_token_len(df: DataFrame, column: str, n: int = 30, n_special: int = 0) -> DataFrame:
    """Keep rows of at most ``n`` tokens, ``n_special`` added ones included."""
    return df.filter(F.size(column) + n_special <= n)


def filter_nonempty(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.size(column) > 0)


def concat_sets(*dfs: DataFrame) -> DataFrame:
    """All rows of all tables, repeated ones included."""
    return reduce(DataFrame.unionByName, dfs)


def stage_counts(**dfs: DataFrame) -> DataFrame:
    """One row ``(stage, n_rows)`` per table."""
    return concat_sets(
        *[df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("stage"), "n_rows") for name, df in dfs.items()]
    )


def head_rows(df: DataFrame, n: int, batch: int = 1000, id_col: str = "row_id") -> DataFrame:
    """The first ``n`` rows by id, rounded up to whole batches.

    Only ids are ranked; the rows are then filtered by the id at the cut.
    """
    order = by_id(id_col)
    rows = -(-n // batch) * batch
    cut = rank_cut(df.select(id_col), order, [lambda total: F.lit(rows)])
    return df.filter(F.col(id_col) <= cut.select("cut0").scalar())


def score_batches(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Hook for a user's model: ``fn`` maps one Arrow batch to another, of any number of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)
