"""Completion samples from the API usages listed with each method."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators.rows import NO_LABEL


def explode_usages(df: DataFrame) -> DataFrame:
    """One row per well-formed usage: the method's columns plus ``usage_no, cls, call, idx, fqn``."""
    usages = df.select("*", F.posexplode(X.parse_api_seq("api_seq")).alias("usage_no", "_u"))
    return usages.select(
        *df.columns,
        "usage_no",
        F.col("_u.cls").alias("cls"),
        F.col("_u.call").alias("call"),
        F.col("_u.idx").alias("idx"),
        X.fqn("_u.cls", "_u.call").alias("fqn"),
    )


def malformed_count(df: DataFrame) -> DataFrame:
    """How many methods hold a usage entry that cannot be read."""
    return df.agg(F.count_if(X.parse_api_seq("api_seq").isNull()).alias("n_malformed"))


def usage_is_valid(with_unlabelled: bool = True) -> Column:
    """No constructor, the class is the labelled API, and the call name stands at its index.

    Unlabelled rows are left to the catalogue, see :func:`in_catalog`; validation samples
    have no such branch (``with_unlabelled=False``).
    """
    right_class = F.col("cls") == F.col("api")
    if with_unlabelled:
        right_class = right_class | (F.col("api") == NO_LABEL)
    at_index = F.substring(F.col("source_code"), F.col("idx") + 1, F.length("call")) == F.col("call")
    return (F.col("call") != "<init>") & right_class & (F.col("idx") >= 0) & at_index


def _listed(usages: DataFrame, catalog: DataFrame, id_col: str) -> DataFrame:
    """``(id_col, _listed)``: the numbers of the unlabelled usages of a row that the catalogue lists.

    Only ids, numbers and names move. A name in very many usages is a hot key of the join,
    whose left side AQE splits.
    """
    asked = usages.filter(F.col("api") == NO_LABEL).select(id_col, "usage_no", "fqn")
    known = asked.join(catalog.select("fqn").distinct(), "fqn", "left_semi")
    return known.groupBy(id_col).agg(F.collect_list("usage_no").alias("_listed"))


def in_catalog(usages: DataFrame, catalog: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Drop usages of unlabelled rows whose ``Class.call`` the catalogue does not list."""
    marked = usages.join(_listed(usages, catalog, id_col), id_col, "left")
    listed = F.coalesce(F.array_contains("_listed", F.col("usage_no")), F.lit(False))
    return marked.filter((F.col("api") != NO_LABEL) | listed).select(*usages.columns)


def _valid_usages(df: DataFrame, catalog: DataFrame | None) -> DataFrame:
    """Valid usages with their method's columns; a text is moved once, before its usages are unfolded."""
    if catalog is None:
        return explode_usages(df).filter(usage_is_valid())
    asked = explode_usages(df.filter(F.col("api") == NO_LABEL)).filter(usage_is_valid())
    marked = explode_usages(df.join(_listed(asked, catalog, "row_id"), "row_id", "left")).filter(usage_is_valid())
    listed = F.coalesce(F.array_contains("_listed", F.col("usage_no")), F.lit(False))
    return marked.filter((F.col("api") != NO_LABEL) | listed).drop("_listed")


def call_samples(df: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """``(row_id, usage_no, source_code, domain, api, ground_truth)``: the code before each call."""
    return _valid_usages(df, catalog).select(
        "row_id",
        "usage_no",
        X.prefix("source_code", "idx").alias("source_code"),
        "domain",
        "api",
        F.col("fqn").alias("ground_truth"),
    )


def usage_samples(df: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """``(row_id, usage_no, context, ground_truth, domain, api)``: the whole call with its arguments."""
    located = _valid_usages(df, catalog).withColumn("_at", X.usage_start("source_code", "idx", "cls", "call"))
    closed = located.withColumn("_end", X.balanced_end("source_code", "_at.end")).filter(F.col("_end").isNotNull())
    return closed.select(
        "row_id",
        "usage_no",
        X.prefix("source_code", "_at.start").alias("context"),
        X.span(F.col("source_code"), F.col("_at.start"), F.col("_end")).alias("ground_truth"),
        "domain",
        "api",
    )


def valid_samples(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``(row_id, usage_no, context, ground_truth, *keep)`` for validation while fine-tuning."""
    return explode_usages(df).filter(usage_is_valid(with_unlabelled=False)).select(
        "row_id",
        "usage_no",
        X.prefix("source_code", "idx").alias("context"),
        F.col("call").alias("ground_truth"),
        *keep,
    )
