"""From the corpus to encoded training sets, and from predictions to scores, each as one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.arrays import completion_features, keep_last, mlm_mask
from corpusmill.functions.text import clean_prediction, flatten_lines
from corpusmill.operators.blocks import assign_batches, causal_labels, pack_blocks
from corpusmill.operators.bpe import Bpe, encode
from corpusmill.operators.rows import filter_nonempty, filter_token_len, keep_columns
from corpusmill.operators.split import prefix_split
from corpusmill.operators.usages import usage_samples, valid_samples

BLOCK_BITS = 32
"""Blocks of a packing group are numbered below ``2**BLOCK_BITS``."""


def pretraining_blocks(
    df: DataFrame,
    bpe: Bpe,
    length: int = 1024,
    group_size: int = 1000,
    batch_size: int = 12,
    seed: int = 42,
    mlm: float | None = None,
    mask_id: int = 0,
    text: str = "source_code",
) -> DataFrame:
    """``(batch, slot, block_id, input_ids, labels)``: the encoded corpus in blocks, in shuffled batches.

    Labels are the ids, or with ``mlm`` those of the positions that were chosen with that
    probability; the draws depend on ``seed`` and the block alone.
    """
    blocks = pack_blocks(encode(keep_columns(df, ["row_id", text]), bpe, text), length, group_size)
    number = F.shiftleft(F.col("block_group").cast("long"), BLOCK_BITS) + F.col("block_no")
    blocks = assign_batches(blocks.select(number.alias("block_id"), "input_ids"), batch_size, seed, "block_id")
    if mlm is None:
        labelled = causal_labels(blocks)
    else:
        masked = mlm_mask("input_ids", "block_id", mlm, seed, mask_id, len(bpe.tokens))
        labelled = blocks.withColumn("_m", masked).select("batch", "slot", "block_id", "_m.input_ids", "_m.labels")
    return labelled.select("batch", "slot", "block_id", "input_ids", "labels")


def finetuning_features(
    df: DataFrame, bpe: Bpe, length: int = 1024, valid_share: float = 0.1, max_target: int = 30, pad_id: int = 0, group_size: int = 1000
) -> tuple[DataFrame, DataFrame]:
    """Training blocks ``(domain, block_group, block_no, input_ids, labels)`` and validation features
    ``(row_id, usage_no, domain, input_ids, labels)``.

    Per domain the first share of the rows validates: the calls in them, up to ``max_target``
    tokens long, are the labels. The other rows are packed within their domain.
    """
    split = prefix_split(df, valid_share, ["domain"])
    train = encode(split.filter("split = 'train'").select("row_id", "domain", "source_code"), bpe)
    blocks = causal_labels(pack_blocks(train, length, group_size, keep=["domain"]))
    samples = valid_samples(split.filter("split = 'valid'"), keep=["domain"])
    encoded = encode(encode(samples, bpe, "context", "_ctx"), bpe, "ground_truth", "_gt")
    short = filter_token_len(filter_nonempty(encoded, "_ctx"), "_gt", min(max_target, length - 1))
    made = short.select("row_id", "usage_no", "domain", completion_features("_ctx", "_gt", length, pad_id).alias("_f"))
    return blocks, made.select("row_id", "usage_no", "domain", "_f.input_ids", "_f.labels")


def completion_contexts(df: DataFrame, bpe: Bpe, catalog: DataFrame | None = None, length: int = 1024) -> DataFrame:
    """``(row_id, usage_no, domain, api, ground_truth, input_ids)``: what a model completes.

    Contexts are cut on the left; samples without any context are left out.
    """
    encoded = encode(usage_samples(df, catalog), bpe, "context")
    kept = filter_nonempty(encoded, "input_ids").withColumn("input_ids", keep_last("input_ids", length))
    return kept.select("row_id", "usage_no", "domain", "api", "ground_truth", "input_ids")


def completion_pairs(samples: DataFrame, predictions: DataFrame, keep: Sequence[str] = ("domain",)) -> DataFrame:
    """``(row_id, usage_no, *keep, refs, hyp)`` from ``predictions(row_id, usage_no, prediction)``.

    Predictions are cleaned and both sides put on one line; a sample without prediction stays,
    with an empty one.
    """
    joined = samples.join(predictions.select("row_id", "usage_no", "prediction"), ["row_id", "usage_no"], "left")
    hyp = F.coalesce(flatten_lines(clean_prediction("prediction")), F.lit(""))
    return joined.select("row_id", "usage_no", *keep, F.array(flatten_lines("ground_truth")).alias("refs"), hyp.alias("hyp"))
