"""Syntax trees, dataflow edges and the composite score."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import dataflow as D
from corpusmill.operators import trees as T
from corpusmill.plans.evaluate import code_bleu
from corpusmill.registry.base import AST_NODES, VAR_TOKENS, joined, pairs, r6, register, sql_view, view
from corpusmill.registry.scores import RECALL, WEIGHTED, bleu_sql, smooth_sql, sums_sql, with_counts
from corpusmill.sources.reference_lists import keyword_list

NODES, TOKENS = sql_view(AST_NODES), sql_view(VAR_TOKENS)


def nodes(spark, folder):
    return view(spark, folder, AST_NODES)


def tokens(spark, folder):
    return view(spark, folder, VAR_TOKENS)


# three levels: the leaves' text, then their parents', then the root's
SUBTREES = f"""n AS (SELECT * FROM {NODES}),
l3 AS (SELECT *, '(' || type || ')' AS sexp FROM n WHERE node > 2),
l2 AS (SELECT n.*, '(' || n.type || coalesce((SELECT string_agg(' ' || c.sexp, '' ORDER BY c.node) FROM l3 c WHERE c.pair_id = n.pair_id AND c.side = n.side AND c.parent = n.node), '') || ')' AS sexp FROM n WHERE node IN (1, 2)),
l1 AS (SELECT n.*, '(' || n.type || coalesce((SELECT string_agg(' ' || c.sexp, '' ORDER BY c.node) FROM l2 c WHERE c.pair_id = n.pair_id AND c.side = n.side AND c.parent = n.node), '') || ')' AS sexp FROM n WHERE node = 0),
sub AS (SELECT pair_id, side, node, sexp, 1 AS depth FROM l1 UNION ALL
        SELECT pair_id, side, node, sexp, 2 FROM l2 WHERE EXISTS (SELECT 1 FROM l3 c WHERE c.pair_id = l2.pair_id AND c.side = l2.side AND c.parent = l2.node))"""
MATCHED = """tm AS (SELECT pair_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE EXISTS (
  SELECT 1 FROM sub c WHERE c.side = 'hyp' AND c.pair_id = s.pair_id AND c.sexp = s.sexp)) AS BIGINT) AS matched FROM sub s WHERE side = 'ref' GROUP BY pair_id)"""


@register("subtrees", f"WITH {SUBTREES} SELECT pair_id, side, node, sexp, CAST(depth AS BIGINT) AS depth FROM sub")
def _(spark, folder):
    return T.subtrees(nodes(spark, folder)).withColumn("depth", F.col("depth").cast("long"))


@register("subtree_matches", f"""WITH {SUBTREES}, {MATCHED} SELECT pair_id, coalesce(matched, 0) AS matched, coalesce(total, 0) AS total
FROM (SELECT DISTINCT pair_id FROM sub) LEFT JOIN tm USING (pair_id)""")
def _(spark, folder):
    return T.subtree_matches(T.subtrees(nodes(spark, folder)))


@register("syntax_match", f"WITH {SUBTREES}, {MATCHED} SELECT round(sum(matched) / sum(total), 6) AS score FROM tm")
def _(spark, folder):
    return T.syntax_match(nodes(spark, folder)).withColumn("score", r6("score"))


EDGES = f"""t AS (SELECT * FROM {TOKENS}),
e AS (
  SELECT pair_id, side, name, pos, 'comesFrom' AS relation, CASE WHEN d IS NULL THEN [] ELSE [name] END AS parents, CASE WHEN d IS NULL THEN [] ELSE [d] END AS parent_pos, pos AS ord
  FROM (SELECT *, (SELECT max(x.pos) FROM t x WHERE x.pair_id = t.pair_id AND x.side = t.side AND x.name = t.name AND x.is_def AND x.stmt_id < t.stmt_id) AS d FROM t WHERE NOT is_def)
  UNION ALL
  SELECT a.pair_id, a.side, a.name, a.pos, CASE WHEN b.pos IS NULL THEN 'comesFrom' ELSE 'computedFrom' END, CASE WHEN b.pos IS NULL THEN [] ELSE [b.name] END,
         CASE WHEN b.pos IS NULL THEN [] ELSE [b.pos] END, coalesce(b.pos, a.pos)
  FROM t a LEFT JOIN t b ON a.pair_id = b.pair_id AND a.side = b.side AND a.stmt_id = b.stmt_id AND NOT b.is_def WHERE a.is_def)"""
CONNECTED = """used AS (SELECT DISTINCT pair_id, side, unnest(list_concat([pos], parent_pos)) AS pos FROM e WHERE len(parents) > 0),
ce AS (SELECT e.* FROM e SEMI JOIN used USING (pair_id, side, pos))"""
MERGED = """me AS (SELECT pair_id, side, pos, max_by(name, ord) AS name, max_by(relation, ord) AS relation,
  list_sort(list_distinct(flatten(list(parents)))) AS parents, list_sort(list_distinct(flatten(list(parent_pos)))) AS parent_pos FROM ce GROUP BY pair_id, side, pos)"""
NORMAL = """nm AS (SELECT pair_id, side, pos, relation, unnest(list_concat(parents, [name])) AS v, unnest(range(len(parents) + 1)) AS k FROM me),
fa AS (SELECT pair_id, side, v, row_number() OVER (PARTITION BY pair_id, side ORDER BY min(pos * 1000 + k)) - 1 AS no FROM nm GROUP BY pair_id, side, v),
ne AS (SELECT pair_id, side, pos, any_value(relation) AS relation, list('var_' || no ORDER BY k) AS vs FROM nm JOIN fa USING (pair_id, side, v) GROUP BY pair_id, side, pos)"""
EDGE_COUNTS = """ec AS (SELECT pair_id, vs, relation, count(*) FILTER (WHERE side = 'ref') AS r, count(*) FILTER (WHERE side = 'hyp') AS h FROM ne GROUP BY pair_id, vs, relation),
em AS (SELECT pair_id, CAST(sum(least(r, h)) AS BIGINT) AS matched, CAST(sum(r) AS BIGINT) AS total FROM ec GROUP BY pair_id)"""
LISTS = "array_to_string(parents, ' ') AS parents, array_to_string(parent_pos, ' ') AS parent_pos"


def flat(edges, *extra):
    return edges.select("pair_id", "side", "name", "pos", "relation", joined("parents").alias("parents"), joined("parent_pos").alias("parent_pos"), *extra)


@register("def_use_edges", f"WITH {EDGES} SELECT pair_id, side, name, pos, relation, {LISTS} FROM e")
def _(spark, folder):
    return flat(D.def_use_edges(tokens(spark, folder)))


@register("connected_edges", f"WITH {EDGES}, {CONNECTED} SELECT pair_id, side, name, pos, relation, {LISTS} FROM ce")
def _(spark, folder):
    return flat(D.connected_edges(D.def_use_edges(tokens(spark, folder))))


@register("merge_edges", f"WITH {EDGES}, {CONNECTED}, {MERGED} SELECT pair_id, side, name, pos, relation, {LISTS} FROM me ORDER BY pair_id, side, pos")
def _(spark, folder):
    merged = D.merge_edges(D.connected_edges(D.def_use_edges(tokens(spark, folder))))
    return flat(merged).orderBy("pair_id", "side", "pos")


@register(
    "merge_loop_edges",
    f"""WITH {EDGES}, tw AS (SELECT * FROM e UNION ALL SELECT pair_id, side, name, pos, relation, list_concat(parents, [name]), list_concat(parent_pos, [pos]), ord FROM e)
        SELECT pair_id, side, name, pos, relation, array_to_string(list_sort(list_distinct(flatten(list(parents)))), ' ') AS parents,
               array_to_string(list_sort(list_distinct(flatten(list(parent_pos)))), ' ') AS parent_pos FROM tw GROUP BY pair_id, side, name, pos, relation""",
)
def _(spark, folder):
    # a second pass over the loop finds each variable once more
    once = D.def_use_edges(tokens(spark, folder))
    again = once.withColumns(
        {"parents": F.concat("parents", F.array("name")), "parent_pos": F.concat("parent_pos", F.array("pos"))}
    )
    return flat(D.merge_loop_edges(once.unionByName(again)))


@register("normalize_edges", f"WITH {EDGES}, {CONNECTED}, {MERGED}, {NORMAL} SELECT pair_id, side, pos, vs[len(vs)] AS var, relation, array_to_string(vs[1:len(vs) - 1], ' ') AS par_vars FROM ne")
def _(spark, folder):
    edges = D.normalized(D.def_use_edges(tokens(spark, folder)))
    return edges.withColumn("par_vars", joined("par_vars"))


@register("edge_matches", f"WITH {EDGES}, {CONNECTED}, {MERGED}, {NORMAL}, {EDGE_COUNTS} SELECT pair_id, matched, total FROM em")
def _(spark, folder):
    return D.edge_matches(D.normalized(D.def_use_edges(tokens(spark, folder))))


@register("dataflow_match", f"WITH {EDGES}, {CONNECTED}, {MERGED}, {NORMAL}, {EDGE_COUNTS} SELECT round(coalesce(sum(matched) / nullif(sum(total), 0), 0), 6) AS score FROM em")
def _(spark, folder):
    return D.dataflow_match(D.def_use_edges(tokens(spark, folder))).withColumn("score", r6("score"))


PLAIN = smooth_sql(1, lambda n: f"mm{n}", lambda n: f"dd{n}", "hl")
WSUM = ", ".join(f"sum(m{n}) AS mm{n}, sum(d{n}) AS dd{n}" for n in range(1, 5))
COMPOSITE = (
    RECALL
    + f""", s1 AS ({sums_sql()}), a AS (SELECT {bleu_sql(PLAIN, 'rl', 'hl', 'mm1')} AS v FROM s1),
s2 AS (SELECT {WSUM}, sum(hyp_len) AS hl, 2 * count(*) AS rl FROM rec), b AS (SELECT {bleu_sql(PLAIN, 'rl', 'hl', 'mm1')} AS v FROM s2),
{SUBTREES}, {MATCHED}, c AS (SELECT sum(matched) / sum(total) AS v FROM tm),
{EDGES}, {CONNECTED}, {MERGED}, {NORMAL}, {EDGE_COUNTS}, d AS (SELECT coalesce(sum(matched) / nullif(sum(total), 0), 0) AS v FROM em)
SELECT round(a.v, 6) AS ngram_match, round(b.v, 6) AS weighted_ngram_match, round(c.v, 6) AS syntax_match, round(d.v, 6) AS dataflow_match,
       round(0.1 * a.v + 0.2 * b.v + 0.3 * c.v + 0.4 * d.v, 6) AS code_bleu FROM a, b, c, d"""
)


@register("code_bleu", COMPOSITE)
def _(spark, folder):
    score = code_bleu(
        pairs(spark, folder), nodes(spark, folder), D.def_use_edges(tokens(spark, folder)),
        keyword_list("python"), (0.1, 0.2, 0.3, 0.4),
    )
    return score.select(*[r6(c).alias(c) for c in score.columns])
