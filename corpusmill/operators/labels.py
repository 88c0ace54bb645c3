"""Out-of-distribution labels and the joins that apply them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten_ood_stats(stats: DataFrame) -> DataFrame:
    """Nested ``{domain: {api: [ids]}}`` to rows ``(domain, api, api_order, row_id)``.

    Column ``stats``: map of domain to a struct with ``sample_ids_per_api``, a map of API to a
    struct with ``api_in_samples``. The table may hold the map in any number of rows.
    """
    domains = stats.select(F.explode(F.map_entries("stats")).alias("d"))
    apis = domains.select(
        F.col("d.key").alias("domain"), F.posexplode(F.map_entries("d.value.sample_ids_per_api")).alias("api_order", "a")
    )
    return apis.select(
        "domain",
        F.col("a.key").alias("api"),
        "api_order",
        F.explode("a.value.api_in_samples").alias("row_id"),
    )


def select_ood(df: DataFrame, labels: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Rows of each domain; a row of two domains comes out twice."""
    wanted = labels.select("domain", F.col("row_id").alias(id_col)).distinct()
    return df.join(wanted, id_col)


def first_api(labels: DataFrame) -> DataFrame:
    """Per domain and row the API that is first in label order."""
    return labels.groupBy("domain", "row_id").agg(F.min_by("api", "api_order").alias("api"))


def attach_api(df: DataFrame, labels: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``api`` to rows that carry ``domain``; ``strict`` raises for rows no API claims."""
    labelled = df.join(first_api(labels), ["domain", "row_id"], "left")
    if strict:
        missing = F.raise_error(F.concat(F.lit("no API for row "), F.col("row_id").cast("string")))
        labelled = labelled.withColumn("api", F.coalesce("api", missing.cast("string")))
    return labelled


def select_id(df: DataFrame, labels: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Rows of no domain."""
    return df.join(labels.select(F.col("row_id").alias(id_col)), id_col, "left_anti")
