"""Training sets, memories and evaluation cells of a continual run over ordered domains."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.blocks import assign_batches
from corpusmill.operators.lookup import lookup
from corpusmill.operators.position import by_hash, dense_position, rank_cut, seed_key, within_cut
from corpusmill.session import cut_lineage


def from_task_on(n_exp: int, column: str = "task_id", start: int = 0) -> Column:
    """The experiences from a task's own one (plus ``start``) to the last."""
    first = F.col(column).cast("int") + start
    experiences = F.sequence(F.least(first, F.lit(n_exp)), F.lit(n_exp - 1))
    return F.explode(F.when(first < n_exp, experiences).otherwise(F.array().cast("array<int>")))


def eval_grid(domains: DataFrame, n_exp: int = 5) -> DataFrame:
    """``(exp_id, domain)``: after experience ``i`` the domains up to ``i`` are evaluated."""
    return domains.select(from_task_on(n_exp, "ord").alias("exp_id"), "domain")


def eval_matrix(
    preds: DataFrame, metric: Callable[[DataFrame, list[str]], DataFrame], value: str, domains: Sequence[str]
) -> DataFrame:
    """A metric per experience (row) and domain (column), all cells in one job.

    ``preds`` has ``exp_id`` and ``domain``; ``metric(rows, keys)`` gives ``value`` per key.
    """
    order = {d: i for i, d in enumerate(domains)}
    listed = F.create_map(*[F.lit(x) for item in order.items() for x in item])
    cells = preds.filter(F.col("domain").isin(*domains) & (F.try_element_at(listed, F.col("domain")) <= F.col("exp_id")))
    scores = metric(cells, ["exp_id", "domain"])
    return scores.groupBy("exp_id").pivot("domain", list(domains)).agg(F.first(value))


def cumulative_sets(df: DataFrame, n_exp: int = 5) -> DataFrame:
    """Experience ``t`` trains on all rows of tasks up to ``t``."""
    return df.select("*", from_task_on(n_exp).alias("exp_id"))


def memory_sets(df: DataFrame, size: int = 200, n_exp: int = 5, seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """The reservoir that experience ``t`` starts with: ``size`` rows of the tasks before it."""
    earlier = df.select("*", from_task_on(n_exp, start=1).alias("exp_id"))
    return episodic_memory(earlier, size, seed, id_col)


def strategy_sets(
    df: DataFrame, strategy: str = "naive", n_exp: int = 5, mem_size: int = 200, seed: int = 42
) -> DataFrame:
    """Rows with the ``exp_id`` they are trained in.

    ``naive``: the own domain's; ``joint``: all in one; ``cumulative``: all so far; ``replay``:
    the own domain's and the memory of those before, told apart by ``from_memory``.
    """
    if strategy == "naive":
        return df.withColumn("exp_id", F.col("task_id").cast("int"))
    if strategy == "joint":
        return df.withColumn("exp_id", F.lit(0))
    if strategy == "cumulative":
        return cumulative_sets(df, n_exp)
    if strategy == "replay":
        own = df.withColumn("exp_id", F.col("task_id").cast("int")).withColumn("from_memory", F.lit(False))
        return own.unionByName(memory_sets(df, mem_size, n_exp, seed).withColumn("from_memory", F.lit(True)))
    raise ValueError(f"strategy {strategy!r} is not one of naive, joint, cumulative, replay")


# --- memories -----------------------------------------------------------------------------


def episodic_memory(df: DataFrame, n: int = 250, seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """At most ``n`` seeded random rows per experience.

    The rows are filtered by the key of the ``n``-th one, so they are neither sorted nor moved.
    """
    order = by_hash(seed, id_col)
    cuts = rank_cut(df.select("exp_id", id_col), order, [lambda total: F.lit(n)], ["exp_id"])
    cuts = cuts.select("exp_id", F.struct("cut0", "cut1").alias("_cut"))
    marked = lookup(df, cuts, ["exp_id"])
    return marked.filter(within_cut(order, F.col("_cut"))).select(*df.columns)


def balanced_sample(
    mem: DataFrame, sample_size: int = 6, steps: int = 1, seed: int = 42, id_col: str = "row_id"
) -> DataFrame:
    """``(step, exp_id, id)``: each step draws the same number of rows from every buffer.

    Buffers are read in seeded order and from the start again when used up.
    """
    # a memory of bounded size, read several times below
    placed = cut_lineage(dense_position(mem.select("exp_id", id_col), by_hash(seed, id_col), ["exp_id"], "pos", "size"))
    n_buffers = placed.select("exp_id").distinct().count()
    per_buffer = sample_size // n_buffers if n_buffers else 0
    buffers = placed.groupBy("exp_id").agg(F.first("size").alias("size"))
    numbered = buffers.withColumn("_buffer", F.row_number().over(Window.orderBy("exp_id")) - 1)  # one row per buffer
    draws = mem.sparkSession.range(steps * per_buffer * n_buffers).select(
        (F.col("id") % max(n_buffers, 1)).cast("int").alias("_buffer"),
        F.floor(F.col("id") / max(n_buffers, 1)).alias("_draw"),
    )
    wanted = draws.join(numbered, "_buffer").select(
        F.floor(F.col("_draw") / max(per_buffer, 1)).alias("step"),
        "exp_id",
        (F.col("_draw") % F.col("size")).alias("pos"),
        "_draw",
    )
    return wanted.join(placed.drop("size"), ["exp_id", "pos"]).select("step", "exp_id", "_draw", id_col).withColumn(
        "slot", F.col("_draw") % max(per_buffer, 1)
    ).drop("_draw")


def reservoir(df: DataFrame, k: int = 200, seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """``k`` seeded random rows. Lowest keys win, so reservoirs of parts merge into that of the whole."""
    return df.orderBy(seed_key(seed, id_col), id_col).limit(k)


def _n_batches(batches: DataFrame, by: list[str], name: str) -> DataFrame:
    return batches.groupBy(*by).agg((F.max("batch") + 1).alias(name))


def replay_batches(
    cur: DataFrame,
    mem: DataFrame,
    batch_size: int = 2,
    batch_size_mem: int = 2,
    seed: int = 42,
    id_col: str = "row_id",
    by: Sequence[str] = (),
    balance: str | None = None,
) -> DataFrame:
    """``(*by, batch, slot, from_memory, id)``: each batch joins current rows and memory rows.

    The side with fewer batches starts over until the other one ends. With an empty memory
    there are the current rows alone. ``by`` names columns of both tables, such as ``exp_id``,
    whose values have batches of their own, all in one plan. With ``balance``, a column of
    ``mem`` such as ``task_id``, the rows of each of its values are batched apart and every
    batch takes ``batch_size_mem`` of each; slots then count within the value.
    """
    all_ = ["_all"]
    cur, mem = cur.withColumn("_all", F.lit(0)), mem.withColumn("_all", F.lit(0))
    keys = [*by, *all_]
    inner = [*keys, balance] if balance else keys
    current = assign_batches(cur.select(*keys, id_col), batch_size, seed, id_col, keys)
    memory = assign_batches(mem.select(*inner, id_col), batch_size_mem, seed, id_col, inner)
    # the batches there are: those of the side that has more of them
    turns = current.select(*keys, "batch").union(memory.select(*keys, "batch")).distinct().withColumnRenamed("batch", "_turn")

    def taken(side: DataFrame, groups: list[str], from_memory: bool) -> DataFrame:
        mine = turns.join(_n_batches(side, groups, "_n"), keys).withColumn("batch", F.col("_turn") % F.col("_n"))
        rows = mine.join(side, [*groups, "batch"])
        return rows.select(*by, F.col("_turn").alias("batch"), "slot", F.lit(from_memory).alias("from_memory"), id_col)

    return taken(current, keys, False).unionByName(taken(memory, inner, True))
