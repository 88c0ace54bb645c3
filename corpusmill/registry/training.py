"""The training plans, and the further modes of earlier operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import bleu as B
from corpusmill.operators import runlog as G
from corpusmill.operators import trees as T
from corpusmill.plans import training as P
from corpusmill.registry.base import METRIC_LOG, PAIRS, documents, joined, methods, pairs, register, sql_view, table, view
from corpusmill.registry.models import METRICS, stop_sql
from corpusmill.registry.samples import CLOSED, catalog
from corpusmill.registry.scores import TOK, words
from corpusmill.registry.tokens import ENCODED, ints, small_bpe
from corpusmill.session import cut_lineage
from corpusmill.sources.reference_lists import keyword_list

BLOCKS = ENCODED + f""", d AS (SELECT doc_id AS row_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents),
g AS (SELECT CAST(floor(pos / 50) AS BIGINT) AS g, flatten(list(ids ORDER BY pos)) AS a FROM d JOIN doc_ids USING (row_id) GROUP BY 1),
p AS (SELECT g, unnest(range(n)) AS b, unnest(list_transform(range(n), lambda i: a[i * 128 + 1:(i + 1) * 128])) AS ids
      FROM (SELECT g, a, greatest(len(a) // 128, 1) AS n FROM g WHERE len(a) > 0)),
q AS (SELECT g * 4294967296 + b AS block_id, ids FROM p)
SELECT CAST(r // 12 AS BIGINT) AS batch, CAST(r % 12 AS BIGINT) AS slot, block_id, md5({ints('ids')}) AS ids_md5
FROM (SELECT *, row_number() OVER (ORDER BY md5(concat('42:', block_id)), block_id) - 1 AS r FROM q)"""


@register("pretraining_blocks", BLOCKS)
def _(spark, folder):
    made = P.pretraining_blocks(documents(spark, folder), small_bpe(spark, folder), length=128, group_size=50)
    same = F.when(F.col("labels") == F.col("input_ids"), F.md5(joined("input_ids")))
    return made.select(F.col("batch").cast("long").alias("batch"), F.col("slot").cast("long").alias("slot"), "block_id", same.alias("ids_md5"))


@register("finetuning_features")
def _(spark, folder):
    _, valid = P.finetuning_features(methods(spark, folder), small_bpe(spark, folder), length=64)
    return valid.select("row_id", "usage_no", "domain", joined("input_ids").alias("input_ids"), joined("labels").alias("labels"))


@register(
    "completion_scores",
    f"""SELECT domain, count(*) AS n_samples, round(100.0::DOUBLE * avg(CASE WHEN (row_id + usage_no) % 3 = 0 THEN 1 ELSE 0 END), 2) AS accuracy
        FROM ({CLOSED}) WHERE start_at > 0 GROUP BY domain""",
)
def _(spark, folder):
    samples = P.completion_contexts(methods(spark, folder), small_bpe(spark, folder), catalog(spark, folder), length=64)
    samples = cut_lineage(samples.select("row_id", "usage_no", "domain", "ground_truth"))  # read twice
    # every third prediction is right, every seventh missing
    right = (F.col("row_id") + F.col("usage_no")) % 3 == 0
    predictions = samples.select("row_id", "usage_no", F.when(right, F.concat(F.lit(" "), "ground_truth")).otherwise("nothing()").alias("prediction"))
    predictions = predictions.filter(right | (F.col("row_id") % 7 > 0))
    return B.exact_match(P.completion_pairs(samples, predictions), ["domain"], "n_samples")


# --- several references, missing predictions ------------------------------------------------

GRAMS = "unnest(list_transform(range(1, len({w}) - n + 2), lambda i: array_to_string({w}[i:i + n - 1], ' ')))"
TWO_REFS = f"""WITH p AS (SELECT pair_id, {words('ref')} AS r0, {words("left(hyp, length(hyp) // 2)")} AS r1,
  CASE WHEN pair_id % 7 = 0 THEN [] ELSE {words('hyp')} END AS h FROM {sql_view(PAIRS)}),
o AS (SELECT pair_id, r0, r1, h, unnest(range(1, 5)) AS n FROM p),
gh AS (SELECT pair_id, n, g, count(*) AS c FROM (SELECT pair_id, n, {GRAMS.format(w='h')} AS g FROM o WHERE len(h) >= n) GROUP BY ALL),
gr AS (SELECT pair_id, n, g, max(c) AS c FROM (
  SELECT pair_id, n, k, g, count(*) AS c FROM (
    SELECT pair_id, n, 0 AS k, {GRAMS.format(w='r0')} AS g FROM o WHERE len(r0) >= n UNION ALL SELECT pair_id, n, 1, {GRAMS.format(w='r1')} FROM o WHERE len(r1) >= n) GROUP BY ALL) GROUP BY ALL),
m AS (SELECT pair_id, n, sum(least(gh.c, gr.c)) AS m FROM gh JOIN gr USING (pair_id, n, g) GROUP BY ALL)
SELECT pair_id, {", ".join(f"CAST(coalesce((SELECT m FROM m WHERE m.pair_id = p.pair_id AND n = {n}), 0) AS BIGINT) AS m{n}" for n in range(1, 5))},
  CAST(len(h) AS BIGINT) AS hyp_len, CAST(least(len(r0), len(r1)) AS BIGINT) AS min_ref_len,
  CAST(CASE WHEN abs(len(r0) - len(h)) < abs(len(r1) - len(h)) OR (abs(len(r0) - len(h)) = abs(len(r1) - len(h)) AND len(r0) < len(r1)) THEN len(r0) ELSE len(r1) END AS BIGINT) AS closest_ref_len
FROM p"""


@register("clipped_matches_two_refs", TWO_REFS)
def _(spark, folder):
    rows = pairs(spark, folder).withColumns(
        {
            "refs": F.array(F.get("refs", F.lit(0)), F.left("hyp", F.floor(F.length("hyp") / 2).cast("int"))),
            "hyp": F.when(F.col("pair_id") % 7 > 0, F.col("hyp")),
        }
    )
    return B.bleu_terms(rows).select("pair_id", *[f"m{n}" for n in range(1, 5)], "hyp_len", "min_ref_len", "closest_ref_len")


def _keyword_query(lang: str):
    listed = ", ".join(f"'{k}'" for k in keyword_list(lang))

    @register(f"keyword_weight_{lang}", f"SELECT token, CASE WHEN token IN ({listed}) THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END AS weight FROM (SELECT DISTINCT unnest(r) AS token FROM ({TOK}))")
    def _(spark, folder):
        tokens = pairs(spark, folder).select(F.explode(X.ws_tokens(F.get("refs", F.lit(0)))).alias("token"))
        return B.keyword_weight(tokens, keyword_list(lang))


for _lang in ("java", "c_sharp"):
    _keyword_query(_lang)


# --- early stopping: other modes ----------------------------------------------------------


def _open(stops):
    return stops.withColumn("stop_step", F.coalesce("stop_step", F.lit(-1)))


NEGATED = f"(SELECT exp_id, step, -loss AS loss FROM {METRICS})"


@register("early_stop_max", f"SELECT exp_id, best_step, -best_value AS best_value, stop_step FROM ({stop_sql(60).replace(METRICS, NEGATED)})")
def _(spark, folder):
    return _open(G.early_stop(view(spark, folder, METRIC_LOG), patience=60, mode="max"))


ONE_SERIES = "(SELECT 0 AS exp_id, event_id AS step, round(value, 2) AS loss FROM events)"


@register("early_stop_stream", stop_sql(400).replace(METRICS, ONE_SERIES))
def _(spark, folder):
    log = table(spark, folder, "events").select((F.col("event_id") % 5).alias("exp_id"), F.col("event_id").alias("step"), F.round("value", 2).alias("loss"))
    return _open(G.early_stop(log, patience=400, criteria="stream"))


MARGIN = f"""WITH RECURSIVE r AS (SELECT exp_id, step, loss, row_number() OVER (PARTITION BY exp_id ORDER BY step) AS i FROM {METRICS}),
s AS (SELECT exp_id, i, step, step AS first_step, loss AS best, CAST(0 AS BIGINT) AS best_at FROM r WHERE i = 1
      UNION ALL
      SELECT r.exp_id, r.i, r.step, s.first_step, CASE WHEN r.loss < s.best AND r.loss - s.best < -2 THEN r.loss ELSE s.best END,
             CASE WHEN r.loss < s.best AND r.loss - s.best < -2 THEN r.step ELSE s.best_at END
      FROM s JOIN r ON r.exp_id = s.exp_id AND r.i = s.i + 1),
d AS (SELECT *, min(CASE WHEN step > first_step AND step - best_at >= 60 THEN step END) OVER (PARTITION BY exp_id) AS stop_step, max(step) OVER (PARTITION BY exp_id) AS last_step FROM s)
SELECT exp_id, best_at AS best_step, best AS best_value, coalesce(stop_step, -1) AS stop_step FROM d WHERE step = coalesce(stop_step, last_step)"""


@register("early_stop_margin", MARGIN)
def _(spark, folder):
    return _open(G.early_stop(view(spark, folder, METRIC_LOG), patience=60, margin=-2.0))


# --- deep and wide trees ------------------------------------------------------------------

DEEP_NODES = """SELECT CAST(floor(event_id / 80) AS BIGINT) AS pair_id, CASE WHEN CAST(floor(event_id / 40) AS BIGINT) % 2 = 0 THEN 'ref' ELSE 'hyp' END AS side,
 event_id % 40 AS node, CASE WHEN event_id % 40 = 0 THEN NULL WHEN event_id % 40 < 25 THEN event_id % 40 - 1 ELSE CAST(24 AS BIGINT) END AS parent, event_type AS type FROM {events}"""
DEEP = f"""WITH t AS (SELECT * FROM {sql_view(DEEP_NODES)}), k AS (SELECT pair_id, side, max(node) AS last FROM t GROUP BY ALL)
SELECT a.pair_id, a.side, a.node, CAST(a.node + 1 AS BIGINT) AS depth,
  (SELECT string_agg('(' || b.type, ' ' ORDER BY b.node) FROM t b WHERE b.pair_id = a.pair_id AND b.side = a.side AND b.node BETWEEN a.node AND 24)
  || coalesce((SELECT string_agg(' (' || b.type || ')', '' ORDER BY b.node) FROM t b WHERE b.pair_id = a.pair_id AND b.side = a.side AND b.node > 24), '')
  || repeat(')', CAST(least(24, k.last) - a.node + 1 AS INT)) AS sexp
FROM t a JOIN k USING (pair_id, side) WHERE a.node <= 24 AND (a.node < k.last OR a.node = 0)"""


@register("subtrees_deep", DEEP)
def _(spark, folder):
    return T.subtrees(view(spark, folder, DEEP_NODES)).withColumn("depth", F.col("depth").cast("long"))


@register("node_depth", f"SELECT pair_id, side, node, CAST(CASE WHEN node < 25 THEN node + 1 ELSE 26 END AS BIGINT) AS depth FROM {sql_view(DEEP_NODES)}")
def _(spark, folder):
    found = T.node_depth(view(spark, folder, DEEP_NODES))
    return found.select("pair_id", "side", "node", F.col("depth").cast("long").alias("depth"))
