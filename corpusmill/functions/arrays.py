"""Array columns: n-grams, truncation, training features, masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: positions with this label take no part in the loss.
IGNORED = -100


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ngrams(arr: Column | str, n: int | Column, left_pad: Column | None = None, right_pad: Column | None = None) -> Column:
    """All runs of ``n`` neighbours; a pad symbol adds ``n - 1`` copies of it on that side."""
    arr = _col(arr)
    n = F.lit(n) if isinstance(n, int) else n
    if left_pad is not None:
        arr = F.concat(F.array_repeat(left_pad, n - 1), arr)
    if right_pad is not None:
        arr = F.concat(arr, F.array_repeat(right_pad, n - 1))
    starts = F.sequence(F.lit(1), F.greatest(F.size(arr) - n + 1, F.lit(1)))
    grams = F.transform(starts, lambda i: F.slice(arr, i, n))
    # sequence() would count down for a short input, hence the guard on the full length
    return F.filter(grams, lambda g: F.size(g) == n)


def keep_last(arr: Column | str, n: int | Column) -> Column:
    """The last ``n`` elements."""
    arr = _col(arr)
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(arr, F.greatest(F.size(arr) - n + 1, F.lit(1)), F.greatest(n, F.lit(0)))


def completion_features(ctx: Column | str, gt: Column | str, length: int, pad_id: int) -> Column:
    """Struct ``(input_ids, labels)`` of fixed length: context cut on the left, padding on the right.

    Labels cover the ground truth only. A ground truth that does not fit raises an error.
    """
    ctx, gt = _col(ctx), _col(gt)
    context = keep_last(ctx, F.lit(length) - F.size(gt))
    n_ctx, n_pad = F.size(context), F.lit(length) - F.size(context) - F.size(gt)
    fits = (F.size(gt) < length) | ((F.size(gt) == length) & (F.size(ctx) == 0))
    pad = F.greatest(n_pad, F.lit(0))
    ids = F.concat(context, gt, F.array_repeat(F.lit(pad_id), pad))
    labels = F.concat(F.array_repeat(F.lit(IGNORED), n_ctx), gt, F.array_repeat(F.lit(IGNORED), pad))
    error = F.raise_error(F.lit(f"ground truth does not fit into {length} tokens"))
    return F.struct(
        F.when(fits, ids).otherwise(error.cast("array<int>")).alias("input_ids"),
        F.when(fits, labels).otherwise(error.cast("array<int>")).alias("labels"),
    )


def mlm_mask(
    ids: Column | str,
    row_id: Column | str,
    p: float,
    seed: int,
    mask_id: int,
    vocab_size: int,
    special_mask: Column | str | None = None,
) -> Column:
    """Struct ``(input_ids, labels)`` for masked language modelling.

    Each position is chosen with probability ``p``; of the chosen ones 80 % become the mask
    token, 10 % another token, 10 % stay. The draws come from one digest per position of
    ``seed:row_id:index``, so a rerun or another partitioning gives the same masks. Positions
    flagged in ``special_mask`` are never chosen.
    """
    ids, row_id = _col(ids), _col(row_id)

    def below(digest: Column, start: int, share: float) -> Column:
        # eight hex digits as a number below 2**32; their text has the same order
        return F.substring(digest, start, 8) < f"{int(share * 2**32):08x}"

    def digested(x: Column, i: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), row_id.cast("string"), i.cast("string")))
        may = F.lit(True) if special_mask is None else F.get(_col(special_mask), i) == 0
        return F.named_struct(F.lit("x"), x, F.lit("d"), digest, F.lit("chosen"), may & below(digest, 1, p))

    def drawn(t: Column) -> Column:
        other = (F.conv(F.substring(t["d"], 17, 8), 16, 10).cast("long") % vocab_size).cast("int")
        new = F.when(below(t["d"], 9, 0.8), mask_id).when(below(t["d"], 9, 0.9), other).otherwise(t["x"])
        return F.named_struct(
            F.lit("id"), F.when(t["chosen"], new).otherwise(t["x"]), F.lit("label"), F.when(t["chosen"], t["x"]).otherwise(IGNORED)
        )

    tokens = F.transform(F.transform(ids, digested), drawn)
    return F.struct(tokens["id"].alias("input_ids"), tokens["label"].alias("labels"))
