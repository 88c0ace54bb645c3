"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next.

Each stage works on all that its predecessor kept and returns the columns of ``documents``; the last adds tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.decontaminate import contamination
from corpusmill.llm.minhash import near_duplicates
from corpusmill.llm.quality import fit_quality, score_quality
from corpusmill.llm.queries import GOOD, SENTENCEPIECE_MODEL, table
from corpusmill.llm.secrets import redact_secrets
from corpusmill.llm.sentencepiece import encode_texts
from corpusmill.session import cut_lineage, scratch_path

NEAR_PERCENT = 80
"""Near-duplicates share so much of their sets of five-word runs; the 85 of op2 is that query's own."""


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores ``GOOD`` or better."""
    weights = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, weights, column="_score").filter(F.col("_score") >= GOOD).drop("_score")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, linked from ``NEAR_PERCENT`` on; of repeated rows one.

    Rows are told apart by id and text: those that share an id but not their text stand for themselves.
    """
    found = near_duplicates(docs, percent=NEAR_PERCENT).filter("first").groupBy(F.col("doc_id").alias("_id"), "text_key")
    firsts = cut_lineage(found.agg(F.count(F.lit(1)).alias("times")))
    rows = docs.withColumn("_text", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("text_key"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "_text").orderBy("doc_id"))
    once = rows.join(firsts.filter("times = 1"), same, "left_semi")  # texts of rows that are not repeated are not sorted
    repeated = rows.join(firsts.filter("times > 1"), same, "left_semi").withColumn("_nth", nth).filter("_nth = 1").drop("_nth")
    return once.unionByName(repeated).drop("_text")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    found = contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated")
    hit = found.select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("_hit")), "left_anti")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; ``n_chars`` is that of the new text."""
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, tokens, same_text``: ids of the whole texts, and whether they decode to them."""
    out = encode_texts(docs, SENTENCEPIECE_MODEL)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return out.select("doc_id", "lang", "source", F.size("tokens").cast("long").alias("n_tokens"), "tokens", same.alias("same_text"))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("tokens", tokens_stage),
]

ORACLE_SQL = None
"""SQL can express neither the classifier nor the tokenizer; the tests run the stages against plain Python."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each result but the last written to the shared scratch folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
