"""A count-based language model over token blocks, in the place of a neural one.

It shares the table contract of a model run: block losses go to the perplexity report and
ranked next tokens to the hit rates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.lookup import spread_lookup
from corpusmill.session import cut_lineage

START = -1


def context_counts(blocks: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """``(*keys, ctx, next, cnt)``: each token after the ``n - 1`` tokens before it in its block."""
    padded = F.concat(F.array_repeat(F.lit(START), n - 1), F.col("input_ids"))
    rows = blocks.filter(F.size("input_ids") > 0).select(*keys, padded.alias("_ids"))
    steps = F.transform(
        F.sequence(F.lit(1), F.size("_ids") - (n - 1)),
        lambda i: F.struct(
            F.array_join(F.transform(F.slice("_ids", i, F.lit(n - 1)), lambda t: t.cast("string")), " ").alias("ctx"),
            F.get("_ids", i + (n - 2)).alias("next"),
        ),
    )
    grams = rows.select(*keys, F.explode(steps).alias("_g"))
    return grams.groupBy(*keys, "_g.ctx", "_g.next").agg(F.count(F.lit(1)).alias("cnt"))


def train_ngram(blocks: DataFrame, n: int = 3) -> DataFrame:
    """The model: ``(ctx, next, cnt, ctx_cnt)``."""
    # one row per known successor, so at most a vocabulary of rows per context
    context = Window.partitionBy("ctx")
    return context_counts(blocks, n).withColumn("ctx_cnt", F.sum("cnt").over(context))


def score_ngram(
    blocks: DataFrame, model: DataFrame, vocab_size: int, n: int = 3, k: float = 1.0, keys: Sequence[str] = ()
) -> DataFrame:
    """``(*keys, n_tokens, loss)``: mean negative log probability with ``k`` added to each count.

    Every distinct gram is scored once; only a report by ``keys`` joins the scores back.
    """
    grams = context_counts(blocks, n, keys)
    distinct = grams.groupBy("ctx", "next").agg(
        F.sum("cnt").alias("seen"), F.count(F.lit(1)).alias("n_rows")
    )
    totals = model.select("ctx", "ctx_cnt").distinct()
    known = distinct.join(model.select("ctx", "next", "cnt"), ["ctx", "next"], "left").join(totals, "ctx", "left")
    p = (F.coalesce("cnt", F.lit(0)) + k) / (F.coalesce("ctx_cnt", F.lit(0)) + k * vocab_size)
    scored = known.select("ctx", "next", "seen", "n_rows", (-F.log(p)).alias("nll"))
    if not keys:
        return scored.agg(
            F.sum("seen").alias("n_tokens"), (F.sum(F.col("nll") * F.col("seen")) / F.sum("seen")).alias("loss")
        )
    scored = cut_lineage(scored.drop("seen"))
    rows = spread_lookup(grams, scored, ["ctx", "next"], "n_rows", F.struct(*keys))
    return rows.groupBy(*keys).agg(
        F.sum("cnt").alias("n_tokens"), (F.sum(F.col("nll") * F.col("cnt")) / F.sum("cnt")).alias("loss")
    )


def topk_next(model: DataFrame, k: int = 10) -> DataFrame:
    """``(ctx, preds)``: the ``k`` most frequent next tokens, best first."""
    best_first = Window.partitionBy("ctx").orderBy(F.desc("cnt"), "next")
    top = model.withColumn("_rank", F.row_number().over(best_first)).filter(F.col("_rank") <= k)
    ranked = F.array_sort(F.collect_list(F.struct("_rank", "next")))
    return top.groupBy("ctx").agg(ranked.alias("_top")).select("ctx", F.col("_top.next").alias("preds"))
