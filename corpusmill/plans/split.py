"""From the published corpus to labelled and sliced sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.labels import first_api
from corpusmill.operators.position import by_id, rank_cut
from corpusmill.operators.rows import NO_LABEL


def split_corpus(df: DataFrame, labels: DataFrame, n_ft: int = 500_000, n_valid: int = 100_000) -> DataFrame:
    """All rows with ``domain, api, split``: ``ood`` rows per domain, the others sliced by id.

    Ids alone are ranked for the cuts. The rows are then labelled in one pass: one join says
    which are out of distribution, and the others are compared with the cuts.
    """
    first = first_api(labels)
    rest = df.select("row_id").join(first.select("row_id"), "row_id", "left_anti")
    cuts = rank_cut(rest, by_id("row_id"), [lambda total: F.lit(n_ft), lambda total: F.lit(n_ft + n_valid)])
    ends = [F.max(F.when(F.col("which") == i, F.col("cut0"))).alias(f"c{i}") for i in (0, 1)]
    last = cuts.agg(*ends).select(F.struct("c0", "c1")).scalar()
    named = [c for c in first.columns if c != "row_id"]
    marked = df.drop(*named).join(first.withColumn("_ood", F.lit(True)), "row_id", "left").withColumn("_last", last)
    split = F.when(F.col("_ood"), "ood").when(F.col("row_id") <= F.col("_last.c0"), "ft").when(F.col("row_id") <= F.col("_last.c1"), "valid")
    labelled = {c: F.when(F.col("_ood"), F.col(c)).otherwise(NO_LABEL) for c in named}
    return marked.withColumns({**labelled, "split": split.otherwise("train")}).drop("_ood", "_last")
