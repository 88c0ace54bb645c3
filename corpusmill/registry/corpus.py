"""Corpus preparation, labels and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import labels as L
from corpusmill.operators import rows as R
from corpusmill.operators import split as S
from corpusmill.operators.dedup import dedup_first, duplicate_fraction
from corpusmill.operators.position import seed_key, seeded_shuffle
from corpusmill.plans.prepare import prepare_corpus
from corpusmill.plans.split import split_corpus
from corpusmill.registry.base import (
    DOCUMENTS,
    METHODS,
    OOD_LABELS,
    documents,
    methods,
    ood_labels,
    r6,
    register,
    sql_view,
    table,
)
from corpusmill.session import scratch_path
from corpusmill.sources.corpus import read_corpus, read_json_corpus, read_raw_corpus, read_shards, write_corpus

HASH = r"md5(regexp_replace(source_code, '\s+', '', 'g'))"
# splitlines: a final line break opens no line
LINES = (
    r"CASE WHEN length(source_code) = 0 THEN 0 ELSE "
    r"len(string_split_regex(regexp_replace(source_code, '(\r\n|[\n\r\x0b\x0c])\z', ''), '\r\n|[\n\r\x0b\x0c]')) END"
)
MARKED = f"SELECT *, {HASH} AS hash, CAST({LINES} AS BIGINT) AS lines FROM ({DOCUMENTS})"
FIRST = f"""SELECT row_id, source_code, domain, lines FROM (
  SELECT *, row_number() OVER (PARTITION BY hash ORDER BY row_id) AS rn FROM ({MARKED})) WHERE rn = 1"""
M, LBL = sql_view(METHODS), sql_view(OOD_LABELS)
SHUFFLED = "md5(concat('42:', CAST(row_id AS VARCHAR))), row_id"


# --- sources and sinks --------------------------------------------------------------------


@register("read_json_corpus", f"SELECT row_id, md5(source_code) AS text_md5, domain FROM ({DOCUMENTS})")
def _(spark, folder):
    path = scratch_path(spark, "json")
    documents(spark, folder).write.json(path)
    back = read_json_corpus(spark, path, "row_id long, source_code string, domain string")
    return back.select("row_id", F.md5("source_code").alias("text_md5"), "domain")


@register(
    "read_corpus",
    "SELECT source AS domain, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars, min(md5(text)) AS least_md5 FROM documents GROUP BY source",
)
def _(spark, folder):
    docs = read_corpus(spark, f"{folder}/documents.parquet")
    return docs.groupBy(F.col("source").alias("domain")).agg(
        F.count("*").alias("n_rows"), F.sum(F.length("text")).alias("n_chars"), F.min(F.md5("text")).alias("least_md5")
    )


@register("prepare_raw", f"SELECT md5(source_code) AS text_md5, count(*) AS n FROM (SELECT source_code FROM ({MARKED}) QUALIFY row_number() OVER (PARTITION BY hash ORDER BY row_id) = 1) GROUP BY 1")
def _(spark, folder):
    # written without ids, in the order of the ids, and numbered when it is read
    path = scratch_path(spark, "raw")
    documents(spark, folder).orderBy("row_id").select("source_code", "domain").write.json(path)
    raw = read_raw_corpus(spark, path, "source_code string, domain string")
    return prepare_corpus(raw, line_max=1 << 30).groupBy(F.md5("source_code").alias("text_md5")).agg(F.count("*").alias("n"))


@register("write_corpus", f"SELECT row_id, md5(source_code) AS text_md5, domain FROM ({DOCUMENTS})")
def _(spark, folder):
    path = scratch_path(spark, "corpus")
    write_corpus(documents(spark, folder), path, max_records=300, partition_by=["domain"])
    return read_corpus(spark, path).select("row_id", F.md5("source_code").alias("text_md5"), "domain")


MAX_BYTES = 40_000
SIZED = "SELECT doc_id, coalesce(strlen(text), 0) AS b FROM documents"
SHARD_SIZES = f"""WITH s AS ({SIZED}), small AS (SELECT doc_id, b, coalesce(sum(b) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s WHERE 2 * b <= {MAX_BYTES}),
shards AS (SELECT CAST(before // ({MAX_BYTES} + 1 - (SELECT max(b) FROM small)) AS BIGINT) AS shard, doc_id, b FROM small UNION ALL SELECT -1 - doc_id, doc_id, b FROM s WHERE 2 * b > {MAX_BYTES})
SELECT shard, count(*) AS n_rows, CAST(sum(b) AS BIGINT) AS n_bytes, min(doc_id) AS first_id, count(*) = 1 OR sum(b) <= {MAX_BYTES} AS fits FROM shards GROUP BY shard"""


@register("write_shards", SHARD_SIZES)
def _(spark, folder):
    # lengths differ by orders of magnitude; the folders of the shards are read back
    path = scratch_path(spark, "shards")
    write_corpus(documents(spark, folder), path, max_bytes=MAX_BYTES)
    sizes = read_shards(spark, path, "row_id long, source_code string").groupBy("shard").agg(
        F.count("*").alias("n_rows"), F.sum(F.coalesce(F.octet_length("source_code"), F.lit(0))).cast("long").alias("n_bytes"), F.min("row_id").alias("first_id")
    )
    return sizes.withColumn("fits", (F.col("n_rows") == 1) | (F.col("n_bytes") <= MAX_BYTES))


@register("flatten_ood_stats", f"SELECT domain, api, CAST(api_order AS BIGINT) AS api_order, row_id FROM {LBL}")
def _(spark, folder):
    # nested input derived from the label rows: one map per domain and per 1024 ids
    per_api = ood_labels(spark, folder).groupBy("domain", "api", "api_order", F.shiftright("row_id", 10).alias("chunk")).agg(
        F.collect_list("row_id").alias("ids")
    )
    entries = per_api.groupBy("domain", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("api_order", "api", "ids"))).alias("apis")
    )
    by_api = F.map_from_entries(
        F.transform("apis", lambda a: F.struct(a["api"], F.struct(a["ids"].alias("api_in_samples"))))
    )
    stats = entries.select(F.create_map("domain", F.struct(by_api.alias("sample_ids_per_api"))).alias("stats"))
    flat = L.flatten_ood_stats(stats)
    return flat.withColumn("api_order", F.col("api_order").cast("long"))


# --- projections and filters --------------------------------------------------------------


@register("drop_columns", "SELECT doc_id, lang, source FROM documents")
def _(spark, folder):
    return R.drop_columns(table(spark, folder, "documents"), ["text", "n_chars"])


@register("keep_columns", "SELECT doc_id, n_chars FROM documents")
def _(spark, folder):
    return R.keep_columns(table(spark, folder, "documents"), ["n_chars", "doc_id", "absent"])


@register("ensure_labels", "SELECT doc_id, 'NaN' AS domain, 'NaN' AS api FROM documents")
def _(spark, folder):
    return R.ensure_labels(table(spark, folder, "documents").select("doc_id"))


@register("filter_domain", f"SELECT row_id, domain, api FROM {M} WHERE domain = 'android'")
def _(spark, folder):
    return R.filter_domain(methods(spark, folder), "android").select("row_id", "domain", "api")


@register(
    "assign_task",
    f"""SELECT row_id, domain, CAST(CASE domain WHEN 'general' THEN 0 WHEN 'security' THEN 1 WHEN 'android' THEN 2
        WHEN 'web' THEN 3 WHEN 'guava' THEN 4 END AS BIGINT) AS task_id FROM {M} WHERE domain <> 'NaN'""",
)
def _(spark, folder):
    return R.assign_task(methods(spark, folder)).select("row_id", "domain", F.col("task_id").cast("long").alias("task_id"))


@register(
    "tag_experience",
    f"SELECT row_id, CAST(CASE domain WHEN 'web' THEN 0 WHEN 'general' THEN 1 WHEN 'guava' THEN 2 WHEN 'android' THEN 3 WHEN 'security' THEN 4 END AS BIGINT) AS exp_id FROM {M} WHERE domain <> 'NaN'",
)
def _(spark, folder):
    tagged = R.tag_experience(methods(spark, folder), ["web", "general", "guava", "android", "security"])
    return tagged.select("row_id", F.col("exp_id").cast("long").alias("exp_id"))


@register("filter_max_lines", f"SELECT row_id, lines FROM ({MARKED}) WHERE lines <= 20")
def _(spark, folder):
    docs = documents(spark, folder).withColumn("lines", X.line_count("source_code").cast("long"))
    return R.filter_max_lines(docs, 20).select("row_id", "lines")


# --- scalar functions ---------------------------------------------------------------------


@register("content_hash", f"SELECT row_id, hash FROM ({MARKED})")
def _(spark, folder):
    return documents(spark, folder).select("row_id", X.content_hash("source_code").alias("hash"))


@register("line_count", f"SELECT row_id, lines FROM ({MARKED})")
def _(spark, folder):
    return documents(spark, folder).select("row_id", X.line_count("source_code").cast("long").alias("lines"))


@register(
    "is_autogenerated",
    r"""SELECT page_id, len(list_filter(string_split_regex(html, '\r\n|[\n\r\x0b\x0c]')[1:5],
          lambda x: regexp_matches(lower(x), 'auto-generated|autogenerated|automatically generated'))) > 0 AS autogenerated
        FROM (SELECT page_id, concat(CASE WHEN page_id % 7 = 0 THEN concat(chr(10), '// Auto-Generated by x', chr(10)) ELSE '' END, html) AS html FROM pages)""",
)
def _(spark, folder):
    mark = F.when(F.col("page_id") % 7 == 0, "\n// Auto-Generated by x\n").otherwise("")
    return table(spark, folder, "pages").select(
        "page_id", X.is_autogenerated(F.concat(mark, "html")).alias("autogenerated")
    )


@register(
    "strip_comments",
    r"""SELECT page_id, md5(array_to_string(list_filter(string_split(code, chr(10)), lambda l: regexp_matches(l, '\S')), chr(10))) AS code_md5
        FROM (SELECT page_id, array_to_string(list_transform(
                regexp_extract_all(html, '(?s)//[^\n]*|/\*.*?\*/|''(?:\\.|[^\\''])*''|"(?:\\.|[^\\"])*"|[^/''"]+|.'),
                lambda p: CASE WHEN starts_with(p, '//') OR starts_with(p, '/*') THEN ' ' ELSE p END), '') AS code FROM pages)""",
)
def _(spark, folder):
    pages = table(spark, folder, "pages")
    return pages.select("page_id", F.md5(X.strip_comments("html")).alias("code_md5"))


# --- dedup and counts ---------------------------------------------------------------------


@register("dedup_first", f"SELECT row_id FROM ({FIRST})")
def _(spark, folder):
    return dedup_first(documents(spark, folder), X.content_hash("source_code")).select("row_id")


@register(
    "duplicate_fraction",
    f"""SELECT count(*) AS n_rows, count(DISTINCT hash) AS n_distinct,
               round(1 - count(DISTINCT hash) / count(*), 6) AS duplicate_fraction FROM ({MARKED})""",
)
def _(spark, folder):
    report = duplicate_fraction(documents(spark, folder), X.content_hash("source_code"))
    return report.withColumn("duplicate_fraction", r6("duplicate_fraction"))


@register(
    "stage_counts",
    f"""SELECT 'raw' AS stage, count(*) AS n_rows FROM documents UNION ALL
        SELECT 'unique', count(*) FROM ({FIRST}) UNION ALL
        SELECT 'kept', count(*) FROM ({FIRST}) WHERE lines <= 20""",
)
def _(spark, folder):
    docs = documents(spark, folder)
    return R.stage_counts(
        raw=docs,
        unique=dedup_first(docs, X.content_hash("source_code")),
        kept=prepare_corpus(docs, line_max=20),
    )


@register("prepare_corpus", f"SELECT row_id, source_code, domain FROM ({FIRST}) WHERE lines <= 20")
def _(spark, folder):
    return prepare_corpus(documents(spark, folder), line_max=20)


# --- labels -------------------------------------------------------------------------------

FIRST_API = f"SELECT domain, row_id, min_by(api, api_order) AS api FROM {LBL} GROUP BY domain, row_id"


@register("select_ood", f"SELECT l.domain, m.row_id, m.api_seq FROM {M} m JOIN (SELECT DISTINCT domain, row_id FROM {LBL}) l ON m.row_id = l.row_id")
def _(spark, folder):
    corpus = methods(spark, folder).select("row_id", "api_seq")
    return L.select_ood(corpus, ood_labels(spark, folder)).select("domain", "row_id", "api_seq")


@register("attach_api", f"SELECT domain, row_id, api FROM ({FIRST_API})")
def _(spark, folder):
    labels = ood_labels(spark, folder)
    corpus = methods(spark, folder).select("row_id")
    return L.attach_api(L.select_ood(corpus, labels), labels, strict=True).select("domain", "row_id", "api")


@register("select_id", f"SELECT row_id, source_code FROM {M} WHERE row_id NOT IN (SELECT row_id FROM {LBL})")
def _(spark, folder):
    return L.select_id(methods(spark, folder), ood_labels(spark, folder)).select("row_id", "source_code")


@register("concat_sets", f"SELECT row_id, domain FROM {M} UNION ALL SELECT row_id, domain FROM {M} WHERE domain = 'web'")
def _(spark, folder):
    rows = methods(spark, folder).select("row_id", "domain")
    parts = [R.filter_domain(rows, d) for d in ("general", "security", "android", "web", "guava", "NaN")]
    return R.concat_sets(*parts, parts[3])


# --- order and splits ---------------------------------------------------------------------


@register("seeded_shuffle", f"SELECT row_id, row_number() OVER (ORDER BY {SHUFFLED}) - 1 AS place FROM ({DOCUMENTS})")
def _(spark, folder):
    from corpusmill.operators.position import by_hash, dense_position

    docs = documents(spark, folder).select("row_id")
    return seeded_shuffle(dense_position(docs, by_hash(42), out="place"), 42)


@register("head_rows", f"SELECT row_id, domain FROM ({DOCUMENTS}) ORDER BY row_id LIMIT 300")
def _(spark, folder):
    return R.head_rows(documents(spark, folder), 250, batch=100).select("row_id", "domain")


@register(
    "slice_splits",
    f"""SELECT row_id, CASE WHEN pos < 300 THEN 'ft' WHEN pos < 400 THEN 'valid' ELSE 'train' END AS split
        FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM ({DOCUMENTS}))""",
)
def _(spark, folder):
    return S.slice_splits(documents(spark, folder), 300, 100).select("row_id", "split")


@register(
    "stratified_split",
    f"""SELECT row_id, api, CASE WHEN rn <= floor(n * 0.1::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM (
        SELECT row_id, api, row_number() OVER (PARTITION BY api ORDER BY {SHUFFLED}) AS rn,
               count(*) OVER (PARTITION BY api) AS n FROM {M})""",
)
def _(spark, folder):
    return S.stratified_split(methods(spark, folder)).select("row_id", "api", "split")


@register(
    "random_split_exact",
    f"""SELECT row_id, CASE WHEN rn <= floor(n * 0.1::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM (
        SELECT row_id, row_number() OVER (ORDER BY {SHUFFLED}) AS rn, count(*) OVER () AS n FROM ({DOCUMENTS}))""",
)
def _(spark, folder):
    return S.random_split_exact(documents(spark, folder)).select("row_id", "split")


@register(
    "prefix_split",
    f"""SELECT row_id, domain, CASE WHEN rn <= floor(n * 0.1::DOUBLE) THEN 'valid' ELSE 'train' END AS split FROM (
        SELECT row_id, domain, row_number() OVER (PARTITION BY domain ORDER BY row_id) AS rn,
               count(*) OVER (PARTITION BY domain) AS n FROM {M})""",
)
def _(spark, folder):
    return S.prefix_split(methods(spark, folder), groups=["domain"]).select("row_id", "domain", "split")


@register(
    "split_corpus",
    f"""SELECT m.row_id, a.domain, a.api, 'ood' AS split FROM {M} m JOIN ({FIRST_API}) a ON m.row_id = a.row_id
        UNION ALL
        SELECT row_id, 'NaN', 'NaN', CASE WHEN pos < 500 THEN 'ft' WHEN pos < 700 THEN 'valid' ELSE 'train' END FROM (
          SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM {M} WHERE row_id NOT IN (SELECT row_id FROM {LBL}))""",
)
def _(spark, folder):
    corpus = methods(spark, folder).select("row_id", "source_code")
    return split_corpus(corpus, ood_labels(spark, folder), 500, 200).select("row_id", "domain", "api", "split")
