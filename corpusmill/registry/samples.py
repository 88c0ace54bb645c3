"""API usages, completion samples and the clean-up of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import usages as U
from corpusmill.registry.base import METHODS, PAIRS, call_preds, joined, methods, pairs, register, sql_view, table
from corpusmill.registry.base import CALL_PREDS_LONG
from corpusmill.sources.reference_lists import read_api_catalog

M, P = sql_view(METHODS), sql_view(PAIRS)

# catalogue of the fixture: the calls of unlabelled rows that have an even value
CATALOG = "SELECT DISTINCT concat('Map.', event_type) AS fqn FROM events WHERE event_type <> 'purchase'"


def catalog(spark, folder):
    calls = table(spark, folder, "events").filter("event_type <> 'purchase'")
    return read_api_catalog(calls.select(F.concat(F.lit("Map."), "event_type").alias("fqn")))


USAGES = rf"""
SELECT row_id, domain, api, source_code, usage_no, cls, call, idx FROM (
  SELECT *, split_part(trim(split_part(e, '.', 1)), ' ', 1) AS cls,
         split_part(trim(split_part(e, '.', 2)), ' ', 1) AS call,
         TRY_CAST(split_part(trim(split_part(e, '.', 2)), ' ', 2) AS INT) AS idx
  FROM (SELECT *, unnest(list_filter(string_split(api_seq, '|'), lambda e: e <> '')) AS e,
               CAST(generate_subscripts(list_filter(string_split(api_seq, '|'), lambda e: e <> ''), 1) - 1 AS BIGINT) AS usage_no
        FROM {M}))"""

VALID = f"""
SELECT * FROM ({USAGES}) WHERE call <> '<init>' AND (api = 'NaN' OR cls = api)
  AND substr(source_code, idx + 1, length(call)) = call
  AND (api <> 'NaN' OR concat(cls, '.', call) IN (SELECT fqn FROM ({CATALOG})))"""

# the closing parenthesis is found by counting over the characters behind the call
LOCATED = f"""
SELECT *, CASE WHEN receiver THEN idx - length(cls) - 1 ELSE idx END AS start_at, idx + length(call) AS call_end FROM (
  SELECT *, idx - length(cls) - 1 >= 0 AND substr(source_code, idx - length(cls), length(cls)) = cls AS receiver FROM ({VALID}))"""
CLOSED = f"""
SELECT * FROM (
  SELECT *, list_position(list_transform(range(1, length(rest) + 1), lambda i:
      length(replace(substr(rest, 1, i), '(', '')) - length(replace(substr(rest, 1, i), ')', ''))), 0) AS n_close
  FROM (SELECT *, substr(source_code, call_end + 1) AS rest FROM ({LOCATED}))) WHERE n_close IS NOT NULL"""


@register("parse_api_seq", f"SELECT row_id, usage_no, cls, call, CAST(idx AS BIGINT) AS idx FROM ({USAGES})")
def _(spark, folder):
    parsed = U.explode_usages(methods(spark, folder))
    return parsed.select("row_id", F.col("usage_no").cast("long").alias("usage_no"), "cls", "call", F.col("idx").cast("long").alias("idx"))


@register("malformed_count", f"""SELECT count(*) FILTER (WHERE row_id % 9 = 4) AS n_malformed FROM {M}""")
def _(spark, folder):
    broken = F.when(F.col("row_id") % 9 == 4, F.concat("api_seq", F.lit("noDot|"))).otherwise(F.col("api_seq"))
    return U.malformed_count(methods(spark, folder).withColumn("api_seq", broken))


@register("prefix", f"SELECT row_id, usage_no, substr(source_code, 1, idx) AS context FROM ({USAGES}) WHERE idx >= 0")
def _(spark, folder):
    usages = U.explode_usages(methods(spark, folder)).filter("idx >= 0")
    return usages.select("row_id", F.col("usage_no").cast("long").alias("usage_no"), X.prefix("source_code", "idx").alias("context"))


@register("usage_start", f"SELECT row_id, usage_no, CAST(start_at AS BIGINT) AS start_at, CAST(call_end AS BIGINT) AS end_at FROM ({LOCATED})")
def _(spark, folder):
    usages = U.explode_usages(methods(spark, folder)).filter(U.usage_is_valid())
    at = U.in_catalog(usages, catalog(spark, folder)).withColumn("at", X.usage_start("source_code", "idx", "cls", "call"))
    return at.select(
        "row_id",
        F.col("usage_no").cast("long").alias("usage_no"),
        F.col("at.start").cast("long").alias("start_at"),
        F.col("at.end").cast("long").alias("end_at"),
    )


@register(
    "balanced_end",
    r"""SELECT pair_id, CAST(CASE WHEN length(t) = 1 THEN 1 ELSE list_position(list_transform(range(2, length(t) + 1), lambda i:
            length(replace(substr(t, 2, i - 1), '(', '')) - length(replace(substr(t, 2, i - 1), ')', ''))), 0) + 1 END AS BIGINT) AS end_at
        FROM (SELECT pair_id, concat('f(', replace(replace(ref, '.', ')'), ',', '('), ')') AS t FROM """ + P + r""") WHERE
        list_position(list_transform(range(2, length(t) + 1), lambda i:
            length(replace(substr(t, 2, i - 1), '(', '')) - length(replace(substr(t, 2, i - 1), ')', ''))), 0) IS NOT NULL""",
)
def _(spark, folder):
    # sentences as argument lists: a full stop closes, a comma opens
    nested = F.translate(F.get("refs", F.lit(0)), ".,", ")(")
    code = pairs(spark, folder).select("pair_id", F.concat(F.lit("f("), nested, F.lit(")")).alias("code"))
    ends = code.select("pair_id", X.balanced_end("code", F.lit(1)).cast("long").alias("end_at"))
    return ends.filter("end_at IS NOT NULL")


@register("split_fqn", f"SELECT row_id, usage_no, concat(cls, '.', call) AS fqn, cls AS api, call FROM ({USAGES})")
def _(spark, folder):
    usages = U.explode_usages(methods(spark, folder)).select("row_id", F.col("usage_no").cast("long").alias("usage_no"), "fqn")
    return usages.withColumn("parts", X.split_fqn("fqn")).select("row_id", "usage_no", "fqn", "parts.api", "parts.call")


@register("usage_is_valid", f"""SELECT row_id, usage_no, cls, call FROM ({USAGES}) WHERE call <> '<init>' AND (api = 'NaN' OR cls = api)
  AND substr(source_code, idx + 1, length(call)) = call""")
def _(spark, folder):
    usages = U.explode_usages(methods(spark, folder)).filter(U.usage_is_valid())
    return usages.select("row_id", F.col("usage_no").cast("long").alias("usage_no"), "cls", "call")


@register("read_api_catalog", CATALOG)
def _(spark, folder):
    return catalog(spark, folder)


@register("in_catalog", f"SELECT row_id, usage_no, api, concat(cls, '.', call) AS fqn FROM ({VALID})")
def _(spark, folder):
    usages = U.explode_usages(methods(spark, folder)).filter(U.usage_is_valid())
    return U.in_catalog(usages, catalog(spark, folder)).select("row_id", F.col("usage_no").cast("long").alias("usage_no"), "api", "fqn")


@register("call_samples", f"SELECT row_id, usage_no, substr(source_code, 1, idx) AS source_code, domain, api, concat(cls, '.', call) AS ground_truth FROM ({VALID})")
def _(spark, folder):
    samples = U.call_samples(methods(spark, folder), catalog(spark, folder))
    return samples.withColumn("usage_no", F.col("usage_no").cast("long"))


@register(
    "usage_samples",
    f"""SELECT row_id, usage_no, substr(source_code, 1, start_at) AS context,
               substr(source_code, start_at + 1, call_end + n_close - start_at) AS ground_truth, domain, api FROM ({CLOSED})""",
)
def _(spark, folder):
    samples = U.usage_samples(methods(spark, folder), catalog(spark, folder))
    return samples.withColumn("usage_no", F.col("usage_no").cast("long"))


@register(
    "valid_samples",
    f"""SELECT row_id, usage_no, substr(source_code, 1, idx) AS context, call AS ground_truth FROM ({USAGES})
        WHERE call <> '<init>' AND cls = api AND substr(source_code, idx + 1, length(call)) = call""",
)
def _(spark, folder):
    return U.valid_samples(methods(spark, folder)).withColumn("usage_no", F.col("usage_no").cast("long"))


# --- predictions: page sources hold parentheses of all kinds --------------------------------


@register(
    "clean_prediction",
    r"""SELECT page_id, md5(CASE WHEN extra > 0 AND right(cut, extra) = repeat(')', extra) THEN left(cut, length(cut) - extra) ELSE cut END) AS cleaned_md5
        FROM (SELECT page_id, cut, (length(cut) - length(replace(cut, ')', ''))) - (length(cut) - length(replace(cut, '(', ''))) AS extra
              FROM (SELECT page_id, regexp_extract(concat(regexp_replace(html, '^\s+|\s+\z', '', 'g'), repeat(')', CAST(page_id % 4 AS INT))), '(?s)^(.*\))', 1) AS cut FROM pages))""",
)
def _(spark, folder):
    raw = F.concat(X.strip("html"), F.repeat(F.lit(")"), (F.col("page_id") % 4).cast("int")))
    return table(spark, folder, "pages").select("page_id", F.md5(X.clean_prediction(raw)).alias("cleaned_md5"))


@register(
    "flatten_lines",
    r"""SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+\z', '', 'g')), ' ') AS flat FROM documents""",
)
def _(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.flatten_lines("text").alias("flat"))


@register(
    "is_complete",
    r"""SELECT page_id % 10 AS batch, bool_and(
            (opens > 0 AND closes >= opens) OR contains(html, chr(10) || '//') OR contains(html, chr(10) || '@')
            OR contains(html, chr(10) || 'if') OR contains(html, ');') OR contains(html, ') {') OR contains(html, chr(10) || '{')
            OR contains(html, ')' || chr(10)) OR contains(html, ').')) AS done, count(*) AS n_rows
        FROM (SELECT *, length(html) - length(replace(html, '(', '')) AS opens, length(html) - length(replace(html, ')', '')) AS closes FROM pages)
        GROUP BY page_id % 10""",
)
def _(spark, folder):
    pages = table(spark, folder, "pages").groupBy((F.col("page_id") % 10).alias("batch"))
    return pages.agg(F.bool_and(X.is_complete("html")).alias("done"), F.count("*").alias("n_rows"))


@register(
    "debug_lines",
    f"""SELECT sample_id, string_agg(pred, ' ' ORDER BY rank) AS candidates, any_value(concat('NaN ', api, ' ', api, '.', call)) AS truth
        FROM {sql_view(CALL_PREDS_LONG)} GROUP BY sample_id""",
)
def _(spark, folder):
    from corpusmill.operators.hits import debug_lines

    rows = call_preds(spark, folder).withColumns({"domain": F.lit("NaN"), "ground_truth": X.fqn("api", "call")})
    return debug_lines(rows)
