"""Token rows to blocks and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.position import by_hash, by_id, dense_position


def causal_labels(df: DataFrame) -> DataFrame:
    """Labels of a causal model: the ids themselves."""
    return df.withColumn("labels", F.col("input_ids"))


def pack_blocks(
    df: DataFrame,
    length: int,
    group_size: int = 1000,
    cols: Sequence[str] = ("input_ids",),
    pos: str | None = None,
    id_col: str = "row_id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """``(*keep, block_group, block_no, *cols)``: token lists of consecutive rows cut into blocks.

    Within each group of ``group_size`` rows the lists are joined and cut every ``length``
    tokens; the remainder is dropped unless it is all the group has. ``pos`` names a dense
    position column if there is one already. Every row is cut at the block borders it
    crosses, so a group is never put together as a whole: only its sizes are summed, and a
    block collects at most ``length`` pieces.
    """
    if pos is None:
        pos = "_pos"
        df = dense_position(df, by_id(id_col), list(keep), pos)
    rows = df.select(
        *keep, F.floor(F.col(pos) / group_size).alias("block_group"), F.col(pos).alias("_at"), *cols
    ).withColumn("_size", F.size(cols[0]).cast("long"))
    group = Window.partitionBy(*keep, "block_group")
    before = group.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumns(
        {"_start": F.coalesce(F.sum("_size").over(before), F.lit(0)), "_total": F.sum("_size").over(group)}
    )
    n_blocks = F.greatest(F.floor(F.col("_total") / length), F.lit(1))
    first = F.floor(F.col("_start") / length)
    last = F.least(F.floor((F.col("_start") + F.col("_size") - 1) / length), n_blocks - 1)
    pieces = (
        placed.filter(F.col("_size") > 0)
        .withColumn("_first", first)
        .withColumn("_last", last)
        .filter(F.col("_first") <= F.col("_last"))
        .withColumn("block_no", F.explode(F.sequence("_first", "_last")))
    )
    begin = F.greatest(F.col("block_no") * length - F.col("_start"), F.lit(0))
    end = F.least((F.col("block_no") + 1) * length - F.col("_start"), F.col("_size"))
    cut = [F.slice(c, (begin + 1).cast("int"), (end - begin).cast("int")).alias(c) for c in cols]
    parts = pieces.select(*keep, "block_group", "block_no", F.struct("_at", *cut).alias("_p"))
    blocks = parts.groupBy(*keep, "block_group", "block_no").agg(F.array_sort(F.collect_list("_p")).alias("_ps"))
    return blocks.select(
        *keep, "block_group", "block_no", *[F.flatten(F.col(f"_ps.{c}")).alias(c) for c in cols]
    )


def assign_batches(
    df: DataFrame, size: int, seed: int | None = None, id_col: str = "row_id", groups: Sequence[str] = ()
) -> DataFrame:
    """Add ``batch`` and ``slot``: rows in id order, or in seeded random order, ``size`` at a time."""
    order = by_id(id_col) if seed is None else by_hash(seed, id_col)
    placed = dense_position(df, order, list(groups), "_pos")
    return placed.withColumns(
        {"batch": F.floor(F.col("_pos") / size), "slot": F.col("_pos") % size}
    ).drop("_pos")
