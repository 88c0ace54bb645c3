"""Reports over logged losses and metrics of training runs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.scores import safe_exp
from corpusmill.operators.position import running, running_max, running_min
from corpusmill.session import cut_lineage


def thin_log(log: DataFrame, every: int = 50, skip_zero: bool = False) -> DataFrame:
    """Every ``every``-th step; evaluation points leave out step 0."""
    kept = log.filter(F.col("step") % every == 0)
    return kept.filter(F.col("step") > 0) if skip_zero else kept


def perplexity(
    log: DataFrame, by: Sequence[str] = (), batch_size: int | None = None, n_rows: int | None = None
) -> DataFrame:
    """``(*by, loss, perplexity)`` from batch losses.

    Losses are weighted by their ``n_rows``; a missing loss has no weight. With ``batch_size`` every batch counts that often
    instead, and ``n_rows`` cuts the sequence of losses behind so many rows.
    """
    weight = F.col("n_rows") if batch_size is None else F.lit(batch_size)
    if batch_size is not None and n_rows is not None:
        weight = F.greatest(F.least(weight, n_rows - F.col("batch") * batch_size), F.lit(0))
    mean = F.try_divide(F.sum(F.col("loss") * weight), F.sum(F.when(F.col("loss").isNotNull(), weight)))
    return log.groupBy(*by).agg(mean.alias("loss")).withColumn("perplexity", safe_exp("loss"))


def best_checkpoint(log: DataFrame, value: str = "perplexity", by: Sequence[str] = ()) -> DataFrame:
    """The first step that reaches the lowest value."""
    lowest = F.min(F.struct(F.col(value).alias("value"), F.col("step").alias("step")))
    best = log.groupBy(*by).agg(lowest.alias("_b"))
    return best.select(*by, F.col("_b.step").alias("best_step"), F.col("_b.value").alias(f"best_{value}"))


def loss_report(log: DataFrame) -> DataFrame:
    """Row-weighted mean loss per minibatch, epoch, experience and stream, in one pass.

    ``grain`` is the grouping id over ``(exp_id, epoch, batch)``: 0, 1, 3 and 7.
    """
    sets = [["exp_id", "epoch", "batch"], ["exp_id", "epoch"], ["exp_id"], []]
    return log.groupingSets(sets, "exp_id", "epoch", "batch").agg(
        F.grouping_id().alias("grain"),
        F.try_divide(F.sum(F.col("loss") * F.col("n_rows")), F.sum(F.when(F.col("loss").isNotNull(), F.col("n_rows")))).alias("loss"),
    )


def _updates(records: DataFrame, groups: list[str], margin: float) -> DataFrame:
    """Records that beat the best value before them by more than ``margin``.

    Each depends on the one before, so they are read in step order, batch by batch, with the
    best value as the only state. Only running records get here.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, best = None, None
        for batch in batches:
            keep = []
            for key, value in zip(batch[groups].itertuples(index=False, name=None), batch["_v"]):
                if key != group:
                    group, best, update = key, value, True
                else:
                    update = value < best and value - best < -margin
                    best = value if update else best
                keep.append(update)
            yield batch[keep]

    ordered = records.repartition(*groups).sortWithinPartitions(*groups, "step")
    return ordered.mapInPandas(scan, ordered.schema)


def early_stop(
    log: DataFrame, patience: int = 2, mode: str = "min", margin: float = 0.0, criteria: str = "exp", value: str = "loss"
) -> DataFrame:
    """``(exp_id, best_step, best_value, stop_step)`` per experience, or once for the stream.

    A run stops at the first step that is ``patience`` or more behind the best one; the state
    is that of the stop, or of the last step. The first value counts as best from step 0 and
    cannot stop the run. An improvement must also pass the margin, which only binds for a
    positive one in ``max`` mode and a negative one in ``min`` mode.
    """
    if mode not in ("min", "max"):
        raise ValueError("mode is 'min' or 'max'")
    sign, slack = (1, max(0.0, -margin)) if mode == "min" else (-1, max(0.0, margin))
    groups = ["exp_id"]
    rows = log.select(
        (F.col("exp_id") if criteria == "exp" else F.lit(0)).alias("exp_id"), "step", (F.col(value) * sign).alias("_v")
    )
    first = running_min(F.col("step"))
    if slack == 0:
        best = running_min(F.struct("_v", "step"))
        state = running(rows, groups, "step", {"_first": first, "_best": best}).select(
            *groups, "step", "_first", F.col("_best._v").alias("_best_v"), F.col("_best.step").alias("_best_at")
        )
    else:
        seen = running(rows, groups, "step", {"_first": first, "_earlier": running_min(F.col("_v"), before=True)})
        seen = cut_lineage(seen)
        records = seen.filter(F.col("_earlier").isNull() | (F.col("_v") < F.col("_earlier")))
        updates = _updates(records.select(*groups, "step", "_v"), groups, slack)
        marked = seen.join(updates.withColumnRenamed("_v", "_new"), [*groups, "step"], "left")
        at = F.when(F.col("_new").isNotNull(), F.col("step"))
        state = running(marked, groups, "step", {"_best_v": running_min(F.col("_new")), "_best_at": running_max(at)})
    state = state.withColumn("_best_at", F.when(F.col("_best_at") == F.col("_first"), 0).otherwise(F.col("_best_at")))
    stops = (F.col("step") > F.col("_first")) & (F.col("step") - F.col("_best_at") >= patience)
    now = F.struct("_best_at", "_best_v")
    ends = state.groupBy(*groups).agg(
        F.min(F.when(stops, F.col("step"))).alias("stop_step"),
        F.coalesce(F.min_by(now, F.when(stops, F.col("step"))), F.max_by(now, F.col("step"))).alias("_b"),
    )
    return ends.select(
        *groups, F.col("_b._best_at").alias("best_step"), (F.col("_b._best_v") * sign).alias("best_value"), "stop_step"
    )
