"""Hit rates of ranked candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hits_at_k(samples: DataFrame, ks: Sequence[int] = (1, 5, 10), truth: str = "call", preds: str = "preds") -> DataFrame:
    """Hits per ``(api, call)``, with totals per API and overall in the same pass.

    A hit at ``k`` is an exact match among the first ``k`` candidates. ``level`` is 0 for a
    call, 1 for an API, 3 for the grand total; ``rate_k`` is rounded to four places.
    """
    place = F.array_position(preds, F.col(truth))
    calls = samples.select("api", "call", place.alias("_at")).groupBy("api", "call").agg(
        *[F.count_if(F.col("_at").between(1, k)).alias(f"hit_{k}") for k in ks], F.count(F.lit(1)).alias("n_test")
    )
    # the rows are counted once; only the counts are rolled up
    sums = [F.sum(c).alias(c) for c in [*(f"hit_{k}" for k in ks), "n_test"]]
    rolled = calls.rollup("api", "call").agg(F.grouping_id().alias("level"), *sums)
    rates = [F.round(F.col(f"hit_{k}") / F.col("n_test"), 4).alias(f"rate_{k}") for k in ks]
    return rolled.select("*", *rates)


def debug_lines(samples: DataFrame, preds: str = "preds") -> DataFrame:
    """``(sample_id, truth, candidates)`` as readable text."""
    return samples.select(
        "sample_id",
        F.concat_ws(" ", "domain", "api", "ground_truth").alias("truth"),
        F.array_join(preds, " ").alias("candidates"),
    )
