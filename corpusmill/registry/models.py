"""The count-based model, run logs and the hook for a model of one's own."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import ngram_model as N
from corpusmill.operators import rows as R
from corpusmill.operators import runlog as G
from corpusmill.registry.base import LOSS_LOG, METRIC_LOG, documents, joined, r6, register, sql_view, table, view
from corpusmill.registry.scores import words
from corpusmill.registry.tokens import IDS, word_length_ids
from corpusmill.session import cut_lineage

LOSSES, METRICS = sql_view(LOSS_LOG), sql_view(METRIC_LOG)
V = 64


def train_test(spark, folder):
    """Trained on the documents, tested on the conversations."""
    turns = table(spark, folder, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("row_id"),
        F.transform(X.ws_tokens("text"), lambda t: F.length(t)).alias("input_ids"),
    )
    return word_length_ids(spark, folder), turns


TURNS = f"SELECT conv_id * 100 + turn AS row_id, list_transform({words('text')}, lambda t: length(t)) AS ids FROM conversations"


def grams_sql(ids: str) -> str:
    """Contexts of two tokens, -1 before the start of a row."""
    return f"""SELECT row_id, concat(p[i], ' ', p[i + 1]) AS ctx, p[i + 2] AS next, count(*) AS cnt FROM (
      SELECT row_id, p, unnest(range(1, len(p) - 1)) AS i FROM (SELECT row_id, list_concat([-1, -1], ids) AS p FROM ({ids})))
      GROUP BY ALL"""


MODEL = f"""g AS (SELECT * FROM ({grams_sql(TURNS)})),
model AS (SELECT ctx, next, CAST(sum(cnt) AS BIGINT) AS cnt, CAST(sum(sum(cnt)) OVER (PARTITION BY ctx) AS BIGINT) AS ctx_cnt FROM ({grams_sql(IDS)}) GROUP BY ctx, next),
scored AS (SELECT g.row_id, g.cnt, -ln((coalesce(m.cnt, 0) + 0.5::DOUBLE) / (coalesce(c.ctx_cnt, 0) + 0.5::DOUBLE * {V})) AS nll FROM g
  LEFT JOIN model m ON g.ctx = m.ctx AND g.next = m.next LEFT JOIN (SELECT DISTINCT ctx, ctx_cnt FROM model) c ON g.ctx = c.ctx)"""
TOP = """top AS (SELECT ctx, list(next ORDER BY rn) AS preds FROM (SELECT ctx, next, row_number() OVER (PARTITION BY ctx ORDER BY cnt DESC, next) AS rn FROM model) WHERE rn <= 10 GROUP BY ctx)"""


@register("train_ngram", f"WITH {MODEL} SELECT ctx, CAST(next AS BIGINT) AS next, cnt, ctx_cnt FROM model")
def _(spark, folder):
    return N.train_ngram(train_test(spark, folder)[0], 3).withColumn("next", F.col("next").cast("long"))


@register("score_ngram", f"WITH {MODEL} SELECT row_id, CAST(sum(cnt) AS BIGINT) AS n_tokens, round(sum(nll * cnt) / sum(cnt), 6) AS loss FROM scored GROUP BY row_id")
def _(spark, folder):
    train, test = train_test(spark, folder)
    model = cut_lineage(N.train_ngram(train, 3))  # read three times
    return N.score_ngram(test, model, V, 3, 0.5, keys=["row_id"]).withColumn("loss", r6("loss"))


@register("ngram_perplexity", f"WITH {MODEL} SELECT CAST(sum(cnt) AS BIGINT) AS n_tokens, round(sum(nll * cnt) / sum(cnt), 6) AS loss, round(exp(sum(nll * cnt) / sum(cnt)), 6) AS perplexity FROM scored")
def _(spark, folder):
    train, test = train_test(spark, folder)
    model = cut_lineage(N.train_ngram(train, 3))  # read twice
    report = N.score_ngram(test, model, V, 3, 0.5)
    return report.select("n_tokens", r6("loss").alias("loss"), r6(F.exp("loss")).alias("perplexity"))


@register("topk_next", f"WITH {MODEL}, {TOP} SELECT ctx, array_to_string(preds, ' ') AS preds FROM top")
def _(spark, folder):
    return N.topk_next(N.train_ngram(train_test(spark, folder)[0], 3)).withColumn("preds", joined("preds"))


@register(
    "ngram_hits",
    f"""WITH {MODEL}, {TOP}, s AS (SELECT list_position(preds, next) AS place, cnt FROM g LEFT JOIN top USING (ctx))
        SELECT CAST(coalesce(sum(cnt) FILTER (WHERE place = 1), 0) AS BIGINT) AS hit_1, CAST(coalesce(sum(cnt) FILTER (WHERE place <= 5), 0) AS BIGINT) AS hit_5,
               CAST(coalesce(sum(cnt) FILTER (WHERE place <= 10), 0) AS BIGINT) AS hit_10, CAST(sum(cnt) AS BIGINT) AS n_test FROM s""",
)
def _(spark, folder):
    # the model's candidates as a predictions table: one sample per distinct gram
    train, test = train_test(spark, folder)
    preds = N.topk_next(N.train_ngram(train, 3))
    grams = N.context_counts(test, 3).join(preds, "ctx", "left")
    place = F.coalesce(F.array_position("preds", F.col("next")), F.lit(0))
    sums = [F.sum(F.when(place.between(1, k), F.col("cnt")).otherwise(0)).alias(f"hit_{k}") for k in (1, 5, 10)]
    return grams.agg(*sums, F.sum("cnt").alias("n_test"))


# --- run logs -----------------------------------------------------------------------------


@register("thin_log", f"SELECT exp_id, step, loss FROM {METRICS} WHERE step % 50 = 0 AND step > 0")
def _(spark, folder):
    return G.thin_log(view(spark, folder, METRIC_LOG), 50, skip_zero=True)


@register("perplexity", f"SELECT exp_id, round(sum(loss * n_rows) / sum(n_rows), 6) AS loss, round(exp(sum(loss * n_rows) / sum(n_rows)), 4) AS perplexity FROM {LOSSES} GROUP BY exp_id")
def _(spark, folder):
    report = G.perplexity(view(spark, folder, LOSS_LOG), ["exp_id"])
    return report.select("exp_id", r6("loss").alias("loss"), F.round("perplexity", 4).alias("perplexity"))


@register(
    "perplexity_cut",
    f"""SELECT round(sum(loss * w) / sum(w), 6) AS loss, round(exp(sum(loss * w) / sum(w)), 4) AS perplexity
        FROM (SELECT loss, greatest(least(12, (SELECT count(*) * 9 FROM events) - batch * 12), 0) AS w FROM {LOSSES})""",
)
def _(spark, folder):
    log = view(spark, folder, LOSS_LOG)
    report = G.perplexity(log, batch_size=12, n_rows=9 * log.count())  # the last quarter is cut off
    return report.select(r6("loss").alias("loss"), F.round("perplexity", 4).alias("perplexity"))


@register("best_checkpoint", f"SELECT exp_id, step AS best_step, loss AS best_loss FROM (SELECT *, row_number() OVER (PARTITION BY exp_id ORDER BY loss, step) AS rn FROM {METRICS}) WHERE rn = 1")
def _(spark, folder):
    return G.best_checkpoint(view(spark, folder, METRIC_LOG), "loss", ["exp_id"])


@register(
    "loss_report",
    f"""SELECT coalesce(exp_id, -1) AS exp_id, coalesce(epoch, -1) AS epoch, coalesce(batch, -1) AS batch,
          CAST(GROUPING(exp_id, epoch, batch) AS BIGINT) AS grain, round(sum(loss * n_rows) / sum(n_rows), 6) AS loss
        FROM {LOSSES} GROUP BY GROUPING SETS ((exp_id, epoch, batch), (exp_id, epoch), (exp_id), ())""",
)
def _(spark, folder):
    report = G.loss_report(view(spark, folder, LOSS_LOG))
    keys = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("exp_id", "epoch", "batch")]
    return report.select(*keys, "grain", r6("loss").alias("loss"))


def stop_sql(patience: int) -> str:
    """Margin 0: the best so far is a running minimum of value and step, the first at step 0."""
    return f"""WITH a AS (SELECT *, CASE WHEN step = min(step) OVER (PARTITION BY exp_id) THEN 0 ELSE step END AS place FROM {METRICS}),
b AS (SELECT *, min(loss) OVER w AS best_value, min(step) OVER (PARTITION BY exp_id) AS first_step FROM a WINDOW w AS (PARTITION BY exp_id ORDER BY step)),
c AS (SELECT *, max(CASE WHEN loss = best_value AND (prev IS NULL OR loss < prev) THEN place END) OVER (PARTITION BY exp_id ORDER BY step) AS best_step
      FROM (SELECT *, lag(best_value) OVER (PARTITION BY exp_id ORDER BY step) AS prev FROM b)),
d AS (SELECT *, min(CASE WHEN step > first_step AND step - best_step >= {patience} THEN step END) OVER (PARTITION BY exp_id) AS stop_step, max(step) OVER (PARTITION BY exp_id) AS last_step FROM c)
SELECT exp_id, best_step, best_value, coalesce(stop_step, -1) AS stop_step FROM d WHERE step = coalesce(stop_step, last_step)"""


@register("early_stop", stop_sql(3))
def _(spark, folder):
    stops = G.early_stop(view(spark, folder, METRIC_LOG), patience=3)
    return stops.withColumn("stop_step", F.coalesce("stop_step", F.lit(-1)))


@register("early_stop_patient", stop_sql(60))
def _(spark, folder):
    stops = G.early_stop(view(spark, folder, METRIC_LOG), patience=60)
    return stops.withColumn("stop_step", F.coalesce("stop_step", F.lit(-1)))


# --- a model of one's own -----------------------------------------------------------------


@register("score_batches", "SELECT doc_id AS row_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(length(text) - length(replace(text, 'e', '')) AS BIGINT) AS n_e FROM documents")
def _(spark, folder):
    def score(batch: pd.DataFrame) -> pd.DataFrame:
        text = batch["source_code"]
        return pd.DataFrame({"row_id": batch["row_id"], "n_chars": text.str.len(), "n_e": text.str.count("e")})

    docs = documents(spark, folder).select("row_id", "source_code")
    return R.score_batches(docs, score, "row_id long, n_chars long, n_e long")
