"""Text scores of predictions against references, and line-aligned files."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import scores as SC
from corpusmill.functions import text as X
from corpusmill.functions.arrays import ngrams
from corpusmill.operators import bleu as B
from corpusmill.operators.hits import hits_at_k
from corpusmill.registry.base import (
    CALL_PREDS_LONG,
    PAIRS,
    call_preds,
    documents,
    joined,
    pairs,
    r6,
    register,
    sql_view,
)
from corpusmill.session import scratch_path
from corpusmill.sources.lines import read_line_pairs, read_lines, write_line_pairs, zip_lines
from corpusmill.sources.reference_lists import keyword_list, read_keywords

P = sql_view(PAIRS)
KEYS = ", ".join(f"'{k}'" for k in keyword_list("python"))


def words(c: str) -> str:
    return rf"list_filter(string_split_regex({c}, '\s+'), lambda t: t <> '')"


TOK = f"SELECT pair_id, domain, {words('ref')} AS r, {words('hyp')} AS h FROM {P}"


def _grams(side: str, top: int) -> str:
    orders = ", ".join(f"({n})" for n in range(1, top + 1))
    return f"""SELECT pair_id, n, '{side}' AS side, unnest(list_transform(range(1, len({side}) - n + 2),
        lambda i: array_to_string({side}[i:i + n - 1], ' '))) AS gram FROM tok, (VALUES {orders}) o(n) WHERE len({side}) >= n"""


def with_counts(top: int = 4) -> str:
    """CTEs: tokens, n-gram counts per side, and one row of terms per pair."""
    ms = ", ".join(f"coalesce(sum(CASE WHEN n = {n} THEN least(cr, ch) END), 0) AS m{n}" for n in range(1, top + 1))
    hs = ", ".join(f"greatest(len(h) - {n - 1}, 0) AS h{n}" for n in range(1, top + 1))
    return f"""WITH tok AS ({TOK}),
k AS (SELECT pair_id, n, gram, count(*) FILTER (WHERE side = 'r') AS cr, count(*) FILTER (WHERE side = 'h') AS ch
      FROM ({_grams('r', top)} UNION ALL {_grams('h', top)}) GROUP BY pair_id, n, gram),
m AS (SELECT pair_id, {ms} FROM k GROUP BY pair_id),
terms AS (SELECT tok.pair_id, domain, len(h) AS hyp_len, len(r) AS ref_len, {hs},
          {", ".join(f"coalesce(m{n}, 0) AS m{n}" for n in range(1, top + 1))} FROM tok LEFT JOIN m ON tok.pair_id = m.pair_id)
"""


def bp_sql(ref: str, hyp: str) -> str:
    return f"CASE WHEN {hyp} > {ref} THEN 1.0 WHEN {hyp} = 0 THEN 0.0 ELSE exp(1 - {ref}::DOUBLE / {hyp}) END"


def bleu_sql(ps: list[str], ref: str, hyp: str, first: str) -> str:
    logs = " + ".join(f"{1 / len(ps)} * ln({p})" for p in ps)
    return f"CASE WHEN {first} = 0 THEN 0.0 ELSE {bp_sql(ref, hyp)} * exp({logs}) END"


def smooth_sql(method: int, num, den, hyp: str, top: int = 4) -> list[str]:
    if method == 0:
        return [f"CASE WHEN {num(n)} = 0 THEN 2.2250738585072014e-308 ELSE {num(n)}::DOUBLE / {den(n)} END" for n in range(1, top + 1)]
    if method == 1:
        return [f"CASE WHEN {num(n)} = 0 THEN 0.1 / {den(n)} ELSE {num(n)}::DOUBLE / {den(n)} END" for n in range(1, top + 1)]
    if method == 2:
        return [f"(({num(n)} + 1)::DOUBLE / ({den(n)} + 1))" for n in range(1, top + 1)]
    if method == 3:
        zeros = lambda n: " + ".join(f"CASE WHEN {num(i)} = 0 THEN 1 ELSE 0 END" for i in range(1, n + 1))
        return [f"CASE WHEN {num(n)} = 0 THEN 1 / (pow(2.0, {zeros(n)}) * {den(n)}) ELSE {num(n)}::DOUBLE / {den(n)} END" for n in range(1, top + 1)]
    return [
        f"CASE WHEN {num(n)} = 0 AND {hyp} > 1 THEN ({n - 1} + 5 / ln({hyp})) / {den(n)} ELSE {num(n)}::DOUBLE / {den(n)} END"
        for n in range(1, top + 1)
    ]


def sums_sql(top: int = 4, by: str = "") -> str:
    """Corpus sums ``M1.. D1.. hl rl`` of the terms, denominators at least 1 per row."""
    cols = ", ".join(f"sum(m{n}) AS mm{n}, sum(greatest(h{n}, 1)) AS dd{n}, sum(h{n}) AS pp{n}" for n in range(1, top + 1))
    group = f" GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"SELECT {lead}{cols}, sum(hyp_len) AS hl, sum(ref_len) AS rl FROM terms{group}"


# --- tokens and n-grams -------------------------------------------------------------------


@register("ws_tokens", f"SELECT row_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, '|')) AS tokens_md5 FROM (SELECT doc_id AS row_id, {words('text')} AS t FROM documents)")
def _(spark, folder):
    tokens = documents(spark, folder).select("row_id", X.ws_tokens("source_code").alias("t"))
    return tokens.select("row_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", "|")).alias("tokens_md5"))


@register(
    "ngrams_padded",
    f"""SELECT pair_id, len(g) AS n_grams, md5(array_to_string(g, '|')) AS grams_md5 FROM (
        SELECT pair_id, list_transform(range(1, len(p) - 1), lambda i: array_to_string(p[i:i + 2], ' ')) AS g
        FROM (SELECT pair_id, list_concat(list_concat(['<s>', '<s>'], r), ['</s>', '</s>']) AS p FROM ({TOK})))""",
)
def _(spark, folder):
    tokens = pairs(spark, folder).select("pair_id", X.ws_tokens(F.get("refs", F.lit(0))).alias("r"))
    grams = ngrams("r", 3, F.lit("<s>"), F.lit("</s>"))
    text = F.transform(grams, lambda g: F.array_join(g, " "))
    return tokens.select(
        "pair_id", F.size(text).cast("long").alias("n_grams"), F.md5(F.array_join(text, "|")).alias("grams_md5")
    )


@register("ngram_counts", with_counts() + "SELECT pair_id, CAST(n AS BIGINT) AS n, gram, ch AS cnt FROM k WHERE ch > 0")
def _(spark, folder):
    tokens = pairs(spark, folder).select("pair_id", X.ws_tokens("hyp").alias("h"))
    return B.ngram_counts(tokens, "h", 4).withColumn("n", F.col("n").cast("long"))


@register("keyword_weight", f"SELECT token, CASE WHEN token IN ({KEYS}) THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END AS weight FROM (SELECT DISTINCT unnest(r) AS token FROM ({TOK}))")
def _(spark, folder):
    tokens = pairs(spark, folder).select(F.explode(X.ws_tokens(F.get("refs", F.lit(0)))).alias("token"))
    return B.keyword_weight(tokens, keyword_list("python"))


@register("read_keywords", f"SELECT k AS keyword, count(*) AS n_docs FROM (SELECT unnest([{KEYS}]) AS k) JOIN (SELECT DISTINCT doc_id, unnest({words('text')}) AS w FROM documents) ON k = w GROUP BY k")
def _(spark, folder):
    # how many documents use each keyword of the list
    used = documents(spark, folder).select("row_id", F.explode(F.array_distinct(X.ws_tokens("source_code"))).alias("keyword"))
    known = F.broadcast(read_keywords(spark, "python"))  # 35 fixed rows
    return used.join(known, "keyword").groupBy("keyword").agg(F.count("*").alias("n_docs"))


# --- line-aligned files -------------------------------------------------------------------


def _line_folder(spark, folder, name):
    path = scratch_path(spark, name)
    rows = pairs(spark, folder).select(
        F.col("pair_id").alias("sample_id"),
        X.flatten_lines(F.get("refs", F.lit(0))).alias("ground_truth"),
        X.flatten_lines("hyp").alias("prediction"),
    )
    write_line_pairs(rows, path)
    return path


FLAT = r"array_to_string(list_transform(string_split({c}, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+\z', '', 'g')), ' ')"
LINED = f"SELECT row_number() OVER (ORDER BY pair_id) - 1 AS line_no, {FLAT.format(c='ref')} AS gt, {FLAT.format(c='hyp')} AS pred FROM {P}"


@register("read_line_pairs", rf"SELECT line_no AS pair_id, regexp_replace(gt, '^\s+|\s+\z', '', 'g') AS ref, regexp_replace(pred, '^\s+|\s+\z', '', 'g') AS hyp FROM ({LINED})")
def _(spark, folder):
    path = _line_folder(spark, folder, "lines")
    rows = read_line_pairs(spark, [f"{path}/gt"], f"{path}/predictions")
    return rows.select("pair_id", F.get("refs", F.lit(0)).alias("ref"), "hyp")


@register("write_line_pairs", f"SELECT line_no, pred AS value FROM ({LINED})")
def _(spark, folder):
    return read_lines(spark, f"{_line_folder(spark, folder, 'written')}/predictions")


@register("zip_lines", f"SELECT line_no, gt, pred FROM ({LINED})")
def _(spark, folder):
    path = _line_folder(spark, folder, "zipped")
    return zip_lines(gt=read_lines(spark, f"{path}/gt"), pred=read_lines(spark, f"{path}/predictions"))


# --- matches ------------------------------------------------------------------------------


@register(
    "clipped_matches",
    with_counts() + "SELECT pair_id, " + ", ".join(f"CAST(m{n} AS BIGINT) AS m{n}, CAST(h{n} AS BIGINT) AS h{n}" for n in range(1, 5)) + " FROM terms",
)
def _(spark, folder):
    return B.bleu_terms(pairs(spark, folder)).select("pair_id", *[f"{x}{n}" for n in range(1, 5) for x in "mh"])


W = f"CASE WHEN n > 1 OR gram IN ({KEYS}) THEN 1.0 ELSE 0.2 END"
RECALL = with_counts() + f""", rec AS (SELECT tok.pair_id, len(h) AS hyp_len, len(r) AS ref_len, {", ".join(
    f"coalesce(m{n}, 0.0) AS m{n}, greatest(coalesce(d{n}, 0.0), 1.0) AS d{n}" for n in range(1, 5))}
  FROM tok LEFT JOIN (SELECT pair_id, {", ".join(
    f"sum(CASE WHEN n = {n} THEN ({W})::DOUBLE * least(cr, ch) END) AS m{n}, sum(CASE WHEN n = {n} THEN ({W})::DOUBLE * cr END) AS d{n}" for n in range(1, 5))}
    FROM k GROUP BY pair_id) x ON tok.pair_id = x.pair_id)
"""


@register("recall_matches", RECALL + "SELECT pair_id, " + ", ".join(f"round(m{n}, 6) AS m{n}, round(d{n}, 6) AS d{n}" for n in range(1, 5)) + " FROM rec")
def _(spark, folder):
    terms = B.recall_terms(pairs(spark, folder), keyword_list("python"))
    return terms.select("pair_id", *[r6(f"{x}{n}").alias(f"{x}{n}") for n in range(1, 5) for x in "md"])


# --- scores -------------------------------------------------------------------------------


@register("exact_match", f"SELECT domain, round(100.0::DOUBLE * avg(CASE WHEN ref = hyp THEN 1 ELSE 0 END), 2) AS accuracy FROM (SELECT domain, ref, CASE WHEN pair_id % 3 = 0 THEN ref ELSE hyp END AS hyp FROM {P}) GROUP BY domain")
def _(spark, folder):
    rows = pairs(spark, folder)
    some_equal = F.when(F.col("pair_id") % 3 == 0, F.get("refs", F.lit(0))).otherwise(F.col("hyp"))
    return B.exact_match(rows.withColumn("hyp", some_equal), keep=["domain"])


@register(
    "corpus_bleu_smooth",
    with_counts()
    + f""", s AS ({sums_sql()}), q AS (SELECT *, {", ".join(f"(mm{n} + 1)::DOUBLE / (pp{n} + 1) AS p{n}" for n in range(1, 5))},
        hl::DOUBLE / rl AS ratio FROM s),
      b AS (SELECT *, CASE WHEN ratio > 1 THEN 1.0 ELSE exp(1 - 1 / ratio) END AS bp, exp(0.25 * (ln(p1) + ln(p2) + ln(p3) + ln(p4))) AS gm FROM q)
      SELECT round(gm * bp, 6) AS bleu, round(100 * gm * bp, 2) AS bleu_percent, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3, round(p4, 6) AS p4,
        round(bp::DOUBLE, 6) AS bp, round(ratio, 6) AS ratio, CAST(hl AS BIGINT) AS hyp_len, CAST(rl AS BIGINT) AS ref_len FROM b""",
)
def _(spark, folder):
    score = B.corpus_bleu_smooth(pairs(spark, folder))
    ps = [r6(F.get("precisions", F.lit(i))).alias(f"p{i + 1}") for i in range(4)]
    return score.select(r6("bleu").alias("bleu"), "bleu_percent", *ps, r6("bp").alias("bp"), r6("ratio").alias("ratio"), "hyp_len", "ref_len")


def _corpus(method: int, top: int = 4) -> str:
    ps = smooth_sql(method, lambda n: f"mm{n}", lambda n: f"dd{n}", "hl", top)
    return with_counts(top) + f", s AS ({sums_sql(top, 'domain')}) SELECT domain, round({bleu_sql(ps, 'rl', 'hl', 'mm1')}, 6) AS bleu FROM s"


@register("corpus_bleu", _corpus(1))
def _(spark, folder):
    return B.corpus_bleu(pairs(spark, folder), keep=["domain"]).withColumn("bleu", r6("bleu"))


@register("corpus_bleu_5_orders", _corpus(2, 5))
def _(spark, folder):
    scores = B.corpus_bleu(pairs(spark, folder), weights=(0.2,) * 5, method=2, keep=["domain"])
    return scores.withColumn("bleu", r6("bleu"))


def _sentence(method: int) -> str:
    ps = smooth_sql(method, lambda n: f"m{n}", lambda n: f"greatest(h{n}, 1)", "hyp_len")
    return f"SELECT {method} AS method, pair_id, round({bleu_sql(ps, 'ref_len', 'hyp_len', 'm1')}, 6) AS bleu FROM terms"


@register("sentence_bleu", with_counts() + f"SELECT pair_id, bleu FROM ({_sentence(1)})")
def _(spark, folder):
    return B.sentence_bleu(pairs(spark, folder)).withColumn("bleu", r6("bleu"))


@register(
    "smooth",
    with_counts()
    + "SELECT pair_id, "
    + ", ".join(
        f"round({p}, 6) AS s{m}_{i + 1}"
        for m in range(5)
        for i, p in enumerate(smooth_sql(m, lambda n: f"m{n}", lambda n: f"greatest(h{n}, 1)", "hyp_len"))
    )
    + " FROM terms",
)
def _(spark, folder):
    terms = B.bleu_terms(pairs(spark, folder))
    nums = [F.col(f"m{n}") for n in range(1, 5)]
    dens = [F.greatest(F.col(f"h{n}"), F.lit(1)) for n in range(1, 5)]
    cols = [
        r6(p).alias(f"s{method}_{i + 1}")
        for method in range(5)
        for i, p in enumerate(SC.smooth(nums, dens, method, F.col("hyp_len")))
    ]
    return terms.select("pair_id", *cols)


M567 = """, p AS (SELECT *, {ps}, m5::DOUBLE / greatest(h5, 1) AS p5 FROM terms),
  n AS (SELECT *, {qs} FROM p),
  a AS (SELECT *, (p1 + 1 + p1 + p2) / 3 AS a1, (q1 + 1 + q1 + q2) / 3 AS b1 FROM n),
  b AS (SELECT *, (a1 + p2 + p3) / 3 AS a2, (b1 + q2 + q3) / 3 AS b2 FROM a),
  c AS (SELECT *, (a2 + p3 + p4) / 3 AS a3, (b2 + q3 + q4) / 3 AS b3 FROM b),
  d AS (SELECT *, (a3 + p4 + p5) / 3 AS a4, (b3 + q4 + p5) / 3 AS b4 FROM c),
  e AS (SELECT *, (m3 + 5 * CASE WHEN p1 = 0 THEN 0 ELSE p2 * p2 / p1 END) / (h3 + 5) AS c3 FROM d),
  f AS (SELECT *, (m4 + 5 * CASE WHEN p2 = 0 THEN 0 ELSE c3 * c3 / p2 END) / (h4 + 5) AS c4 FROM e)
SELECT pair_id, {cols} FROM f"""


@register(
    "smooth_sentence",
    with_counts(5)
    + M567.format(
        ps=", ".join(f"m{n}::DOUBLE / greatest(h{n}, 1) AS p{n}" for n in range(1, 5)),
        qs=", ".join(f"{q} AS q{i + 1}" for i, q in enumerate(smooth_sql(4, lambda n: f"m{n}", lambda n: f"greatest(h{n}, 1)", "hyp_len"))),
        cols=", ".join(f"round(a{n}, 6) AS s5_{n}, round(b{n}, 6) AS s7_{n}" for n in range(1, 5))
        + ", CASE WHEN m3 = 0 THEN -1 ELSE round(c3, 6) END AS s6_3, CASE WHEN m3 = 0 THEN -1 ELSE round(c4, 6) END AS s6_4",
    ),
)
def _(spark, folder):
    terms = B.bleu_terms(pairs(spark, folder), 5)
    nums = [F.col(f"m{n}") for n in range(1, 5)]
    dens = [F.greatest(F.col(f"h{n}"), F.lit(1)) for n in range(1, 5)]
    fifth = F.col("m5").cast("double") / F.greatest(F.col("h5"), F.lit(1))
    cols = [
        r6(p).alias(f"s{method}_{i + 1}")
        for method in (5, 7)
        for i, p in enumerate(SC.smooth(nums, dens, method, F.col("hyp_len"), fifth))
    ]
    six = SC.smooth(nums, dens, 6, F.col("hyp_len"))
    cols += [F.coalesce(r6(six[i]), F.lit(-1.0)).alias(f"s6_{i + 1}") for i in (2, 3)]
    return terms.select("pair_id", *cols)


@register("modified_precision", with_counts() + "SELECT pair_id, CAST(m2 AS BIGINT) AS numerator, CAST(greatest(h2, 1) AS BIGINT) AS denominator FROM terms")
def _(spark, folder):
    return B.modified_precision(pairs(spark, folder), 2)


@register(
    "closest_ref_len",
    f"""SELECT pair_id, CAST(CASE WHEN abs(len(r) - len(h)) < abs(len(h) + 3 - len(h)) OR (abs(len(r) - len(h)) = 3 AND len(r) < len(h) + 3) THEN len(r) ELSE len(h) + 3 END AS BIGINT) AS closest FROM ({TOK})""",
)
def _(spark, folder):
    # a second reference, three tokens longer than the hypothesis
    lens = pairs(spark, folder).select("pair_id", F.size(X.ws_tokens("hyp")).alias("h"), F.size(X.ws_tokens(F.get("refs", F.lit(0)))).alias("r"))
    return lens.select("pair_id", SC.closest_ref_len(F.array(F.col("r"), F.col("h") + 3), F.col("h")).cast("long").alias("closest"))


@register("brevity_penalty", f"SELECT pair_id, round(({bp_sql('len(r)', 'len(h)')})::DOUBLE, 6) AS bp, round(({bp_sql('len(h)', 'len(r)')})::DOUBLE, 6) AS bp_swapped FROM ({TOK})")
def _(spark, folder):
    lens = pairs(spark, folder).select("pair_id", F.size(X.ws_tokens("hyp")).alias("h"), F.size(X.ws_tokens(F.get("refs", F.lit(0)))).alias("r"))
    r, h = F.col("r"), F.col("h")
    return lens.select("pair_id", r6(SC.brevity_penalty(r, h)).alias("bp"), r6(SC.brevity_penalty(h, r)).alias("bp_swapped"))


WPS = smooth_sql(1, lambda n: f"mm{n}", lambda n: f"dd{n}", "hl")
WSUM = ", ".join(f"sum(m{n}) AS mm{n}, sum(d{n}) AS dd{n}" for n in range(1, 5))
WEIGHTED = RECALL + f""", s AS (SELECT {WSUM}, sum(hyp_len) AS hl, 2 * count(*) AS rl2, sum(ref_len) AS rl FROM rec)
SELECT round({bleu_sql(WPS, 'rl2', 'hl', 'mm1')}, 6) AS bleu, round({bleu_sql(WPS, 'rl', 'hl', 'mm1')}, 6) AS bleu_tokens FROM s"""


@register("weighted_bleu", WEIGHTED)
def _(spark, folder):
    scores = B.weighted_bleu(pairs(spark, folder), keyword_list("python"), ref_len_mode="both")
    return scores.select(r6("bleu").alias("bleu"), r6("bleu_tokens").alias("bleu_tokens"))


@register("safe_exp", "SELECT event_id, round(exp(value / 50), 6) AS small, exp(value * 1000) = 'inf'::DOUBLE AS overflow FROM events")
def _(spark, folder):
    from corpusmill.registry.base import table

    events = table(spark, folder, "events")
    return events.select("event_id", r6(SC.safe_exp(F.col("value") / 50)).alias("small"), (SC.safe_exp(F.col("value") * 1000) == float("inf")).alias("overflow"))


@register(
    "hits_at_k",
    f"""WITH s AS (SELECT sample_id, any_value(api) AS api, any_value(call) AS call, min(CASE WHEN pred = call THEN rank END) AS hit_at FROM {sql_view(CALL_PREDS_LONG)} GROUP BY sample_id)
        SELECT coalesce(api, '*') AS api, coalesce(call, '*') AS call, CAST(GROUPING(api, call) AS BIGINT) AS level,
          count(*) FILTER (WHERE hit_at <= 1) AS hit_1, count(*) FILTER (WHERE hit_at <= 5) AS hit_5, count(*) FILTER (WHERE hit_at <= 10) AS hit_10, count(*) AS n_test,
          round(count(*) FILTER (WHERE hit_at <= 1) / count(*), 4) AS rate_1, round(count(*) FILTER (WHERE hit_at <= 5) / count(*), 4) AS rate_5, round(count(*) FILTER (WHERE hit_at <= 10) / count(*), 4) AS rate_10
        FROM s GROUP BY ROLLUP (api, call)""",
)
def _(spark, folder):
    report = hits_at_k(call_preds(spark, folder))
    return report.withColumns({"api": F.coalesce("api", F.lit("*")), "call": F.coalesce("call", F.lit("*"))})
