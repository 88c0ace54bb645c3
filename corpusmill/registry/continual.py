"""Training sets, memories and evaluation cells per experience."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import continual as C
from corpusmill.operators.bleu import corpus_bleu_smooth, exact_match
from corpusmill.operators.rows import TASKS, assign_task, task_id
from corpusmill.registry.base import METHODS, PAIRS, methods, pairs, register, sql_view
from corpusmill.registry.scores import with_counts

P = sql_view(PAIRS)
ORD = "CASE domain WHEN 'general' THEN 0 WHEN 'security' THEN 1 WHEN 'android' THEN 2 WHEN 'web' THEN 3 WHEN 'guava' THEN 4 END"
TASKED = f"SELECT row_id, domain, {ORD} AS task_id FROM {sql_view(METHODS)} WHERE domain <> 'NaN'"
EXPS = "(SELECT unnest(range(5)) AS exp_id)"
HASHED = "md5(concat('42:', CAST(row_id AS VARCHAR))), row_id"
DOMAINS = list(TASKS)


def tasked(spark, folder):
    return assign_task(methods(spark, folder).select("row_id", "domain"))


@register("eval_grid", f"SELECT exp_id, domain, n_pairs FROM (SELECT domain, {ORD} AS ord, count(*) AS n_pairs FROM {P} GROUP BY domain) JOIN {EXPS} ON ord <= exp_id")
def _(spark, folder):
    sizes = pairs(spark, folder).groupBy("domain").agg(F.count("*").alias("n_pairs"))
    grid = C.eval_grid(sizes.select("domain", task_id().alias("ord")))
    return grid.join(sizes, "domain").select(F.col("exp_id").cast("long").alias("exp_id"), "domain", "n_pairs")


def predictions(spark, folder):
    """Predictions of all experiences: some become right later on."""
    every = pairs(spark, folder).select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("exp_id"))
    right = (F.col("pair_id") + F.col("exp_id")) % 4 == 0
    return every.withColumn("hyp", F.when(right, F.get("refs", F.lit(0))).otherwise(F.col("hyp")))


PREDS = f"SELECT pair_id, domain, exp_id, ref, CASE WHEN (pair_id + exp_id) % 4 = 0 THEN ref ELSE hyp END AS hyp FROM {P}, {EXPS} WHERE {ORD} <= exp_id"


def pivot_sql(value: str) -> str:
    return ", ".join(f"coalesce(max(CASE WHEN domain = '{d}' THEN {value} END), -1) AS {d}" for d in DOMAINS)


@register("eval_matrix_accuracy", f"SELECT exp_id, {pivot_sql('v')} FROM (SELECT exp_id, domain, round(100.0::DOUBLE * avg(CASE WHEN ref = hyp THEN 1 ELSE 0 END), 2) AS v FROM ({PREDS}) GROUP BY exp_id, domain) GROUP BY exp_id")
def _(spark, folder):
    matrix = C.eval_matrix(predictions(spark, folder), lambda df, keys: exact_match(df, keys), "accuracy", DOMAINS)
    return matrix.select(F.col("exp_id").cast("long").alias("exp_id"), *[F.coalesce(d, F.lit(-1.0)).alias(d) for d in DOMAINS])


def _cell_bleu() -> str:
    """Per cell: smoothed BLEU over the predictions, by the same terms keyed by pair and experience."""
    text = with_counts().replace("pair_id", "pk")
    tokens = "SELECT pk, domain, exp_id," + text.split("SELECT pk, domain,")[1].split("FROM (")[0]
    tok = f"{tokens} FROM (SELECT *, pair_id * 10 + exp_id AS pk FROM ({PREDS}))"
    rest = text[text.index("\nk AS (SELECT") :]
    return f"""WITH tok AS ({tok}), {rest}, cells AS (SELECT tok.exp_id, terms.* FROM terms JOIN tok USING (pk)),
s AS (SELECT exp_id, domain, {", ".join(f"ln((sum(m{n}) + 1)::DOUBLE / (sum(h{n}) + 1)) AS l{n}" for n in range(1, 5))}, sum(hyp_len)::DOUBLE / sum(ref_len) AS ratio FROM cells GROUP BY exp_id, domain),
v AS (SELECT exp_id, domain, round(100 * exp(0.25 * (l1 + l2 + l3 + l4)) * CASE WHEN ratio > 1 THEN 1.0 ELSE exp(1 - 1 / ratio) END, 2) AS v FROM s)
SELECT exp_id, {pivot_sql('v')} FROM v GROUP BY exp_id"""


@register("eval_matrix_bleu", _cell_bleu())
def _(spark, folder):
    matrix = C.eval_matrix(predictions(spark, folder), lambda df, keys: corpus_bleu_smooth(df, keep=keys), "bleu_percent", DOMAINS)
    return matrix.select(F.col("exp_id").cast("long").alias("exp_id"), *[F.coalesce(d, F.lit(-1.0)).alias(d) for d in DOMAINS])


@register("cumulative_sets", f"SELECT row_id, exp_id FROM ({TASKED}) JOIN {EXPS} ON task_id <= exp_id")
def _(spark, folder):
    return C.cumulative_sets(tasked(spark, folder)).select("row_id", F.col("exp_id").cast("long").alias("exp_id"))


NAIVE = f"SELECT row_id, CAST(task_id AS BIGINT) AS exp_id FROM ({TASKED})"
MEMORY = f"SELECT row_id, exp_id FROM (SELECT row_id, exp_id, row_number() OVER (PARTITION BY exp_id ORDER BY {HASHED}) AS rn FROM ({TASKED}) JOIN {EXPS} ON task_id < exp_id) WHERE rn <= 200"


@register(
    "strategy_sets",
    f"""SELECT 'naive' AS strategy, row_id, exp_id, false AS from_memory FROM ({NAIVE}) UNION ALL SELECT 'joint', row_id, 0, false FROM ({NAIVE}) UNION ALL
        SELECT 'cumulative', row_id, exp_id, false FROM ({TASKED}) JOIN {EXPS} ON task_id <= exp_id UNION ALL
        SELECT 'replay', row_id, exp_id, false FROM ({NAIVE}) UNION ALL SELECT 'replay', row_id, exp_id, true FROM ({MEMORY})""",
)
def _(spark, folder):
    rows, parts = tasked(spark, folder), []
    for name in ("naive", "joint", "cumulative", "replay"):
        part = C.strategy_sets(rows, name)
        if "from_memory" not in part.columns:
            part = part.withColumn("from_memory", F.lit(False))
        parts.append(part.select(F.lit(name).alias("strategy"), "row_id", F.col("exp_id").cast("long").alias("exp_id"), "from_memory"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def remembered(spark, folder):
    return C.episodic_memory(tasked(spark, folder).withColumn("exp_id", F.col("task_id").cast("long")))


REMEMBERED = f"SELECT row_id, exp_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY exp_id ORDER BY {HASHED}) AS rn FROM ({NAIVE})) WHERE rn <= 250"


@register("episodic_memory", f"SELECT row_id, exp_id FROM ({REMEMBERED})")
def _(spark, folder):
    return remembered(spark, folder).select("row_id", "exp_id")


@register(
    "balanced_sample",
    f"""SELECT CAST(floor(d / 2) AS BIGINT) AS step, b.exp_id, d % 2 AS slot, row_id
        FROM (SELECT exp_id, count(*) AS n FROM ({REMEMBERED}) GROUP BY exp_id) b, (SELECT unnest(range(600)) AS d)
        JOIN ({REMEMBERED}) m ON m.exp_id = b.exp_id AND m.rn - 1 = d % b.n""",
)
def _(spark, folder):
    return C.balanced_sample(remembered(spark, folder), sample_size=13, steps=300)


@register("reservoir", f"SELECT row_id, domain FROM ({TASKED}) ORDER BY {HASHED} LIMIT 200")
def _(spark, folder):
    return C.reservoir(tasked(spark, folder)).select("row_id", "domain")


EARLIER = f"(SELECT e.exp_id, r.row_id, r.task_id FROM ({TASKED}) r JOIN (SELECT unnest(range(1, 5)) AS exp_id) e ON r.task_id < e.exp_id)"
RANKED = f"SELECT *, row_number() OVER (PARTITION BY exp_id ORDER BY {HASHED}) - 1 AS place FROM {EARLIER}"
REPLAYED = f"""WITH cur AS (SELECT task_id AS exp_id, row_id, row_number() OVER (PARTITION BY task_id ORDER BY {HASHED}) - 1 AS pos FROM ({TASKED})),
mem AS (SELECT exp_id, row_id, place AS pos FROM ({RANKED}) WHERE place < 201),
c AS (SELECT exp_id, max(pos) // 2 + 1 AS c FROM cur GROUP BY exp_id), m AS (SELECT exp_id, max(pos) // 2 + 1 AS m FROM mem GROUP BY exp_id),
t AS (SELECT exp_id, unnest(range(greatest(c, coalesce(m, 0)))) AS batch, c, m FROM c LEFT JOIN m USING (exp_id))
SELECT CAST(t.exp_id AS BIGINT) AS exp_id, batch, pos % 2 AS slot, false AS from_memory, row_id FROM t JOIN cur ON cur.exp_id = t.exp_id AND cur.pos // 2 = batch % c
UNION ALL SELECT t.exp_id, batch, pos % 2, true, row_id FROM t JOIN mem ON mem.exp_id = t.exp_id AND mem.pos // 2 = batch % m"""


def _with_memory(spark, folder, k):
    rows = tasked(spark, folder).select("row_id", "task_id")
    cur = rows.withColumn("exp_id", F.col("task_id").cast("int"))
    return cur, C.memory_sets(rows, k)


@register("replay_batches", REPLAYED)
def _(spark, folder):
    cur, mem = _with_memory(spark, folder, 201)
    made = C.replay_batches(cur, mem, by=["exp_id"])
    return made.withColumn("exp_id", F.col("exp_id").cast("long"))


BALANCED = f"""WITH cur AS (SELECT task_id AS exp_id, row_id, row_number() OVER (PARTITION BY task_id ORDER BY {HASHED}) - 1 AS pos FROM ({TASKED})),
mem AS (SELECT *, row_number() OVER (PARTITION BY exp_id, task_id ORDER BY {HASHED}) - 1 AS pos FROM ({RANKED}) WHERE place < 201),
c AS (SELECT exp_id, max(pos) // 2 + 1 AS c FROM cur GROUP BY exp_id), m AS (SELECT exp_id, task_id, max(pos) // 3 + 1 AS m FROM mem GROUP BY exp_id, task_id),
n AS (SELECT exp_id, max(m) AS m FROM m GROUP BY exp_id),
t AS (SELECT exp_id, unnest(range(greatest(c, coalesce(n.m, 0)))) AS batch, c FROM c LEFT JOIN n USING (exp_id))
SELECT CAST(t.exp_id AS BIGINT) AS exp_id, batch, pos % 2 AS slot, false AS from_memory, row_id FROM t JOIN cur ON cur.exp_id = t.exp_id AND cur.pos // 2 = batch % c
UNION ALL SELECT t.exp_id, batch, pos % 3, true, mem.row_id FROM t JOIN m USING (exp_id) JOIN mem ON mem.exp_id = t.exp_id AND mem.task_id = m.task_id AND mem.pos // 3 = batch % m.m"""


@register("replay_batches_balanced", BALANCED)
def _(spark, folder):
    cur, mem = _with_memory(spark, folder, 201)
    made = C.replay_batches(cur, mem, batch_size_mem=3, by=["exp_id"], balance="task_id")
    return made.withColumn("exp_id", F.col("exp_id").cast("long"))
