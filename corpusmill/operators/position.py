"""Positions, rank cuts and running values without one task seeing a whole group.

An unpartitioned ``row_number()`` moves the table to one task, and one partitioned by a hot
key moves a third of it. Here rows are first split into buckets of the ordering key; one
small count (or maximum, ...) per bucket is scanned over the buckets and added to the value
inside the bucket. Integer keys are unique within their group, so a bucket of ``2**bits``
neighbouring keys holds at most that many rows however the keys are spread.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.lookup import lookup

BITS = 14


@dataclass(frozen=True)
class Order:
    """An ordering: the sort columns and bucket expressions from coarse to fine."""

    columns: tuple[Column, ...]
    buckets: tuple[Column, ...]


def by_id(column: str = "row_id", bits: int = BITS) -> Order:
    """Order by a unique integer.

    Three bucket levels bound every scan to ``2**bits`` rows up to ids of ``2**(4 * bits)``, and
    a dense table of ids has one bucket for so many rows: its tasks grow with it.
    """
    c = F.col(column).cast("long")
    return Order((c,), tuple(F.shiftright(c, level * bits) for level in (3, 2, 1)))


def seed_key(seed: int, column: str = "row_id") -> Column:
    """Pseudo-random sort key that every engine and every partitioning reproduces."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")))


def by_hash(seed: int, column: str = "row_id", digits: tuple[int, ...] = (2, 5)) -> Order:
    """Seeded random order. The leading hex digits are even buckets by construction: up to a million of them."""
    key = seed_key(seed, column)
    return Order((key, F.col(column).cast("long")), tuple(F.substring(key, 1, n) for n in digits))


def seeded_shuffle(df: DataFrame, seed: int, column: str = "row_id") -> DataFrame:
    """The whole table in seeded random order."""
    return df.orderBy(seed_key(seed, column), F.col(column))


def _bucket_names(order: Order) -> list[str]:
    return [f"_bucket{i}" for i in range(len(order.buckets))]


def _offsets(counts: DataFrame, groups: list[str], names: list[str]) -> DataFrame:
    """Rows before each finest bucket of its group (``_before``) and in the group (``_total``)."""
    before = None
    for depth in range(len(names)):
        level = counts.groupBy(*groups, *names[: depth + 1]).agg(F.sum("_n").alias("_n"))
        # bounded: at most one row per bucket below one parent bucket
        window = Window.partitionBy(*groups, *names[:depth])
        upto = window.orderBy(names[depth]).rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
        if before is None:
            before = level.withColumn("_total", F.sum("_n").over(window))
        else:
            parent = before.select(
                *groups, *names[:depth], F.col("_before").alias("_above"), F.col("_total")
            )
            before = level.join(parent, [*groups, *names[:depth]]).withColumn(
                "_before", F.col("_before") + F.col("_above")
            )
    return before.select(*groups, *names, "_before", "_n", "_total")


def _bucketed(df: DataFrame, order: Order, groups: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    names = _bucket_names(order)
    if not groups:
        df = df.withColumn("_all", F.lit(0))
        groups.append("_all")
    for name, bucket in zip(names, order.buckets):
        df = df.withColumn(name, bucket)
    counts = df.groupBy(*groups, *names).agg(F.count(F.lit(1)).alias("_n"))
    return df, counts, names


def dense_position(
    df: DataFrame, order: Order, groups: list[str] | None = None, out: str = "pos", total: str | None = None
) -> DataFrame:
    """Add the 0-based position of each row within its group, and on request the group size."""
    groups = list(groups or [])
    rows, counts, names = _bucketed(df, order, groups)
    offsets = _offsets(counts, groups, names).drop("_n")
    window = Window.partitionBy(*groups, *names).orderBy(*order.columns)
    placed = rows.join(offsets, [*groups, *names]).withColumn(
        out, F.col("_before") + F.row_number().over(window) - 1
    )
    if total:
        placed = placed.withColumn(total, F.col("_total"))
    return placed.select(*df.columns, out, *([total] if total else []))


def running_sum(df: DataFrame, order: Order, value: str, groups: list[str] | None = None, out: str = "before") -> DataFrame:
    """Add the sum of ``value`` over the rows before each row of its group; no null in ``groups`` (wrap it in a struct)."""
    groups = list(groups or [])
    rows, _, names = _bucketed(df, order, groups)
    sums = rows.groupBy(*groups, *names).agg(F.sum(value).alias("_n"))
    offsets = _offsets(sums, groups, names).drop("_n", "_total")
    window = Window.partitionBy(*groups, *names).orderBy(*order.columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(offsets, [*groups, *names]).withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(window), F.lit(0)))
    return placed.select(*df.columns, out)


def rank_cut(
    df: DataFrame, order: Order, ks: list[Callable[[Column], Column]], groups: list[str] | None = None
) -> DataFrame:
    """Per group and entry of ``ks`` the sort key of its ``k``-th row, as ``which, cut0, cut1, ...``.

    Each ``k`` maps the group size to a rank. Only the buckets that hold those ranks are
    sorted, so the rows themselves never move: compare their key with the cut instead.
    Ranks below 1 give no row; a rank behind the end means the last row.
    """
    groups = list(groups or [])
    wanted = list(groups)
    rows, counts, names = _bucketed(df, order, groups)
    ranks = F.array(*[F.least(k(F.col("_total")).cast("long"), F.col("_total")) for k in ks])
    target = (
        _offsets(counts, groups, names)
        .select("*", F.posexplode(ranks).alias("which", "_k"))
        .filter((F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_before") + F.col("_n")))
        .groupBy(*groups, *names)
        .agg(F.collect_list(F.struct("which", (F.col("_k") - F.col("_before")).alias("nth"))).alias("_wanted"))
    )
    keys = [c.alias(f"cut{i}") for i, c in enumerate(order.columns)]
    window = Window.partitionBy(*groups, *names).orderBy(*[F.col(f"cut{i}") for i in range(len(keys))])
    # one bucket per group and rank: all other rows are dropped before the shuffle
    found = lookup(rows.select(*groups, *names, *keys), target, [*groups, *names])
    ranked = (
        found.filter(F.col("_wanted").isNotNull())
        .withColumn("_rn", F.row_number().over(window))
        .select("*", F.explode(F.filter("_wanted", lambda w: w["nth"] == F.col("_rn"))).alias("_w"))
    )
    return ranked.select(*wanted, F.col("_w.which").alias("which"), *[f"cut{i}" for i in range(len(keys))])


def within_cut(order: Order, cut: Column) -> Column:
    """Is the row at or before the cut, a struct ``(cut0, ...)``? A null cut is before all rows."""
    key = F.struct(*[c.alias(f"cut{i}") for i, c in enumerate(order.columns)])
    return F.coalesce(key <= cut, F.lit(False))


@dataclass(frozen=True)
class Running:
    """A running aggregate; with ``before`` only over smaller keys.

    ``combine`` merges the value carried in from earlier buckets with the one inside the
    bucket and must pass nulls over, as ``F.least`` and ``F.greatest`` do.
    """

    value: Column
    agg: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]
    before: bool = False


def running_min(value: Column, before: bool = False) -> Running:
    return Running(value, F.min, lambda a, b: F.least(a, b), before)


def running_max(value: Column, before: bool = False) -> Running:
    return Running(value, F.max, lambda a, b: F.greatest(a, b), before)


def running(df: DataFrame, groups: list[str], order: str, outs: dict[str, Running], bits: int = 16) -> DataFrame:
    """Add running aggregates along ``order``. Rows with equal keys see the same value."""
    rows = df.withColumn("_bucket", F.shiftright(F.col(order).cast("long"), bits)).withColumns(
        {f"_value_{name}": r.value for name, r in outs.items()}
    )
    per_bucket = rows.groupBy(*groups, "_bucket").agg(
        *[r.agg(F.col(f"_value_{name}")).alias(f"_carry_{name}") for name, r in outs.items()]
    )
    earlier = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(
        *groups, "_bucket", *[r.agg(F.col(f"_carry_{name}")).over(earlier).alias(f"_carry_{name}") for name, r in outs.items()]
    )
    inside = Window.partitionBy(*groups, "_bucket").orderBy(order)

    def total(name: str, r: Running) -> Column:
        frame = inside.rangeBetween(Window.unboundedPreceding, -1 if r.before else 0)
        return r.combine(F.col(f"_carry_{name}"), r.agg(F.col(f"_value_{name}")).over(frame)).alias(name)

    return rows.join(carried, [*groups, "_bucket"]).select(*df.columns, *[total(n, r) for n, r in outs.items()])
