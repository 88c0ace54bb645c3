"""Dataflow edges ``(pair_id, side, name, pos, relation, parents, parent_pos)`` and their match.

An edge may be split over several rows with the same position; ``ord`` orders those rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.position import running, running_max
from corpusmill.session import cut_lineage

DOC = ("pair_id", "side")


def def_use_edges(tokens: DataFrame, doc: Sequence[str] = DOC) -> DataFrame:
    """Edges of straight-line code from ``(*doc, pos, stmt_id, name, is_def)``.

    A use comes from the latest definition in an earlier statement; an assigned variable is
    computed from each variable used in its statement. Either may have no source.
    """
    keys = list(doc)
    own_def = F.when(F.col("is_def"), F.col("pos"))
    seen = running(tokens, [*keys, "name"], "stmt_id", {"_def_pos": running_max(own_def, before=True)})
    found = F.col("_def_pos").isNotNull()
    uses = seen.filter(~F.col("is_def")).select(
        *keys, "name", "pos", F.lit("comesFrom").alias("relation"),
        F.when(found, F.array("name")).otherwise(F.array().cast("array<string>")).alias("parents"),
        F.when(found, F.array("_def_pos")).otherwise(F.array().cast("array<bigint>")).alias("parent_pos"),
        F.col("pos").alias("ord"),
    )
    sources = tokens.filter(~F.col("is_def")).select(
        *keys, "stmt_id", F.col("name").alias("_from"), F.col("pos").alias("_from_pos")
    )
    targets = tokens.filter("is_def").join(sources, [*keys, "stmt_id"], "left")
    computed = F.col("_from_pos").isNotNull()
    defs = targets.select(
        *keys, "name", "pos", F.when(computed, "computedFrom").otherwise("comesFrom").alias("relation"),
        F.when(computed, F.array("_from")).otherwise(F.array().cast("array<string>")).alias("parents"),
        F.when(computed, F.array("_from_pos")).otherwise(F.array().cast("array<bigint>")).alias("parent_pos"),
        F.coalesce("_from_pos", "pos").alias("ord"),
    )
    return uses.unionByName(defs)


def _union_parents() -> list:
    """Distinct parents, sorted; built from single values so that tasks merge them first."""
    return [
        F.array_sort(F.collect_set("_parent")).alias("parents"),
        F.array_sort(F.collect_set("_parent_pos")).alias("parent_pos"),
    ]


def _single_parents(edges: DataFrame) -> DataFrame:
    zipped = F.arrays_zip(F.col("parents").alias("_parent"), F.col("parent_pos").alias("_parent_pos"))
    return edges.select("*", F.explode_outer(zipped).alias("_z")).select("*", "_z._parent", "_z._parent_pos").drop("_z")


def connected_edges(edges: DataFrame, doc: Sequence[str] = DOC) -> DataFrame:
    """Drop edges whose position neither has parents nor is one."""
    keys = list(doc)
    with_parents = edges.filter(F.size("parents") > 0)
    used = with_parents.select(*keys, F.explode(F.concat(F.array("pos"), "parent_pos")).alias("pos"))
    return edges.join(used.distinct(), [*keys, "pos"], "left_semi").select(*edges.columns)


def merge_edges(edges: DataFrame, doc: Sequence[str] = DOC) -> DataFrame:
    """One edge per position: all its parents, name and relation of its last row."""
    last = F.max(F.struct("ord", "name", "relation"))
    return (
        _single_parents(edges)
        .groupBy(*doc, "pos")
        .agg(last.alias("_l"), *_union_parents())
        .select(*doc, F.col("_l.name").alias("name"), "pos", F.col("_l.relation").alias("relation"), "parents", "parent_pos")
    )


def merge_loop_edges(edges: DataFrame, doc: Sequence[str] = DOC) -> DataFrame:
    """Edges found on several passes over a loop: one per name, position and relation."""
    merged = _single_parents(edges).groupBy(*doc, "name", "pos", "relation").agg(*_union_parents())
    return merged.select(*doc, "name", "pos", "relation", "parents", "parent_pos")


def normalize_edges(edges: DataFrame, doc: Sequence[str] = DOC) -> DataFrame:
    """``(*doc, pos, var, relation, par_vars)`` with variables renamed by first appearance.

    Edges are read by position, parents before the target; the first name seen is ``var_0``.
    """
    keys = list(doc)
    names = edges.select(*keys, "pos", "relation", F.posexplode(F.concat("parents", F.array("name"))).alias("k", "_name"))
    # one shuffle by document; the windows and the grouping stay in its partition
    names = names.repartition(*keys)
    first = F.min(F.struct("pos", "k")).over(Window.partitionBy(*keys, "_name"))
    number = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_first")) - 1
    numbered = names.withColumn("_first", first).withColumn("_var", F.concat(F.lit("var_"), number.cast("string")))
    renamed = numbered.groupBy(*keys, "pos").agg(
        F.max("relation").alias("relation"), F.array_sort(F.collect_list(F.struct("k", "_var"))).alias("_vars")
    )
    variables = F.col("_vars._var")
    return renamed.select(
        *keys,
        "pos",
        F.element_at(variables, -1).alias("var"),
        "relation",
        F.slice(variables, F.lit(1), F.size(variables) - 1).alias("par_vars"),
    )


def edge_matches(edges: DataFrame, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """``(*keys, matched, total)``: normalised edges as multisets, each candidate edge used once."""
    counts = edges.groupBy(*keys, "var", "relation", F.array_join("par_vars", " ").alias("_par")).agg(
        F.count_if(F.col("side") == "ref").alias("in_ref"), F.count_if(F.col("side") == "hyp").alias("in_hyp")
    )
    return counts.groupBy(*keys).agg(
        F.sum(F.least("in_ref", "in_hyp")).alias("matched"), F.sum("in_ref").alias("total")
    )


def normalized(edges: DataFrame, doc: Sequence[str] = DOC) -> DataFrame:
    """Raw edges to connected, merged and renamed ones.

    Merging first gives the same edges and fewer of them; they are written once, as the
    steps after it read them several times.
    """
    merged = cut_lineage(merge_edges(edges, doc))
    return normalize_edges(connected_edges(merged, doc), doc)


def dataflow_match(edges: DataFrame, keys: Sequence[str] = ("pair_id",), by: Sequence[str] = ()) -> DataFrame:
    """``(*by, score)`` from raw edges: matched share of the reference edges, 0 without any."""
    matches = edge_matches(normalized(edges, (*keys, "side")), keys)
    share = F.try_divide(F.sum("matched").cast("double"), F.sum("total"))
    return matches.groupBy(*by).agg(F.coalesce(share, F.lit(0.0)).alias("score"))
