"""Composite score of predicted code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.bleu import corpus_bleu, weighted_bleu
from corpusmill.operators.dataflow import dataflow_match
from corpusmill.operators.trees import syntax_match

PARTS = ("ngram_match", "weighted_ngram_match", "syntax_match", "dataflow_match")


def code_bleu(
    pairs: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    keywords: Sequence[str],
    params: Sequence[float] = (0.25, 0.25, 0.25, 0.25),
    by: Sequence[str] = (),
) -> DataFrame:
    """``(*by, ngram_match, weighted_ngram_match, syntax_match, dataflow_match, code_bleu)``.

    ``by`` columns must be in all three tables.
    """
    keys = (*by, "pair_id")
    frames = [
        corpus_bleu(pairs, keep=by).withColumnRenamed("bleu", "score"),
        weighted_bleu(pairs, keywords, keep=by).withColumnRenamed("bleu", "score"),
        syntax_match(nodes, keys, by),
        dataflow_match(edges, keys, by),
    ]
    long = reduce(DataFrame.unionByName, [f.withColumn("part", F.lit(p)) for f, p in zip(frames, PARTS)])
    scores = [F.coalesce(F.sum(F.when(F.col("part") == p, F.col("score"))), F.lit(0.0)).alias(p) for p in PARTS]
    total = reduce(lambda a, b: a + b, [F.col(p) * float(w) for p, w in zip(PARTS, params)])
    return long.groupBy(*by).agg(*scores).withColumn("code_bleu", total)
