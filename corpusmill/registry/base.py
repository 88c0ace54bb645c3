"""Registration, table access and the views that stand in for the corpus tables.

The view texts run unchanged on Spark and on DuckDB; ``{name}`` is a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Deal out the rows if the session asks for it by ``corpusmill.deal``, a number of partitions.

    A file of a single row group is read by one task. A local session over such files sets
    this; on a cluster, where tables have many files, nobody does and nothing is moved.
    """
    parts = df.sparkSession.conf.get("corpusmill.deal", None)
    return df if parts is None else df.repartition(int(parts))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus: ``row_id, source_code, domain``."""
    return dealt(table(spark, folder, "documents")).select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("source_code"), F.col("source").alias("domain")
    )


DOCUMENTS = "SELECT doc_id AS row_id, text AS source_code, source AS domain FROM documents"

METHODS = """
SELECT row_id, domain, api, concat(pre, s1, s2) AS source_code,
       concat(cls, '.<init> 0|', cls, '.', call, ' ', CAST(length(pre) + length(cls) + 1 AS STRING), '|',
              cls, '.', call, ' ', CAST(length(pre) + length(s1) + 2 AS STRING), '|Foo.bar 3|') AS api_seq
FROM (
  SELECT *, CASE WHEN domain = 'NaN' THEN 'NaN' ELSE cls END AS api,
         concat('void m', CAST(row_id % 3 AS STRING), '(int a) {{', chr(10), '  ') AS pre,
         concat(cls, '.', call, '(a, f(', CAST(user_id AS STRING), '));', chr(10), '  ') AS s1,
         concat('x.', call, '(', CAST(v AS STRING), ');', chr(10), '}}') AS s2
  FROM (
    SELECT event_id AS row_id, event_type AS call, user_id, CAST(floor(value) AS INT) AS v,
           CASE event_id % 6 WHEN 0 THEN 'general' WHEN 1 THEN 'security' WHEN 2 THEN 'android'
                             WHEN 3 THEN 'web' WHEN 4 THEN 'guava' ELSE 'NaN' END AS domain,
           CASE event_id % 6 WHEN 0 THEN 'List' WHEN 1 THEN 'Cipher' WHEN 2 THEN 'Intent'
                             WHEN 3 THEN 'Servlet' WHEN 4 THEN 'Multimap' ELSE 'Map' END AS cls
    FROM {events}) b) p
"""

OOD_LABELS = """
SELECT domain, api, api_order, row_id FROM (
  SELECT event_id AS row_id, 0 AS api_order,
         CASE event_id % 6 WHEN 0 THEN 'general' WHEN 1 THEN 'security' WHEN 2 THEN 'android' WHEN 3 THEN 'web' ELSE 'guava' END AS domain,
         CASE event_id % 6 WHEN 0 THEN 'List' WHEN 1 THEN 'Cipher' WHEN 2 THEN 'Intent' WHEN 3 THEN 'Servlet' ELSE 'Multimap' END AS api
  FROM {events} WHERE event_id % 6 < 5
  UNION ALL SELECT event_id, 1, 'general', 'Collection' FROM {events} WHERE event_id % 12 = 0
  UNION ALL SELECT event_id, 0, 'web', 'Servlet' FROM {events} WHERE event_id % 30 = 1) u
"""

PAIRS = """
SELECT a.conv_id * 100 + a.turn AS pair_id,
       CASE a.conv_id % 5 WHEN 0 THEN 'general' WHEN 1 THEN 'security' WHEN 2 THEN 'android' WHEN 3 THEN 'web' ELSE 'guava' END AS domain,
       a.text AS ref, b.text AS hyp
FROM {conversations} a JOIN {conversations} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
WHERE a.role = 'user' AND b.role = 'assistant'
"""

CALL_PREDS_LONG = """
SELECT e.event_id AS sample_id, k.k AS rank,
       CASE (e.event_id + 3 * k.k + e.user_id) % 11 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'signup'
            WHEN 3 THEN 'error' WHEN 4 THEN 'purchase' ELSE 'other' END AS pred,
       CASE e.event_id % 6 WHEN 0 THEN 'List' WHEN 1 THEN 'Cipher' WHEN 2 THEN 'Intent' WHEN 3 THEN 'Servlet'
                           WHEN 4 THEN 'Multimap' ELSE 'Map' END AS api,
       e.event_type AS call
FROM {events} e CROSS JOIN (VALUES (1),(2),(3),(4),(5),(6),(7),(8),(9),(10)) AS k(k)
"""

# All events: the series of one experience grows with the table.
METRIC_LOG = """
SELECT event_id % 5 AS exp_id, CAST(floor(event_id / 5) AS BIGINT) AS step, round(value, 2) AS loss
FROM {events}
"""

LOSS_LOG = """
SELECT event_id % 5 AS exp_id, CAST(floor(event_id / 5) AS BIGINT) % 4 AS epoch, event_id AS batch,
       1 + event_id % 12 AS n_rows, round(value / 10, 3) AS loss
FROM {events}
"""

AST_NODES = """
SELECT CAST(floor(event_id / 14) AS BIGINT) AS pair_id,
       CASE WHEN CAST(floor(event_id / 7) AS BIGINT) % 2 = 0 THEN 'ref' ELSE 'hyp' END AS side,
       event_id % 7 AS node,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(floor((event_id % 7 - 1) / 2) AS BIGINT) END AS parent,
       CASE WHEN event_id % 7 < 3 THEN 'block' ELSE event_type END AS type
FROM {events}
"""

VAR_TOKENS = """
SELECT CAST(floor(event_id / 24) AS BIGINT) AS pair_id,
       CASE WHEN CAST(floor(event_id / 12) AS BIGINT) % 2 = 0 THEN 'ref' ELSE 'hyp' END AS side,
       event_id % 12 AS pos, CAST(floor((event_id % 12) / 3) AS BIGINT) AS stmt_id,
       chr(CAST(97 + user_id % 4 AS INT)) AS name, event_id % 3 = 0 AS is_def
FROM {events}
"""


def view(spark: SparkSession, folder: str, text: str) -> DataFrame:
    names = [n for n in ("events", "conversations", "documents") if "{%s}" % n in text]
    return spark.sql(text, **{n: dealt(table(spark, folder, n)) for n in names})


def sql_view(text: str) -> str:
    """The same text for DuckDB, as a subquery."""
    return "(" + text.format(events="events", conversations="conversations", documents="documents").strip() + ")"


def methods(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, METHODS)


def ood_labels(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, OOD_LABELS)


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """``pair_id, domain, refs, hyp`` with one reference per row."""
    return view(spark, folder, PAIRS).select("pair_id", "domain", F.array("ref").alias("refs"), "hyp")


def call_preds(spark: SparkSession, folder: str) -> DataFrame:
    """``sample_id, api, call, preds`` with ten ranked candidates per sample."""
    calls = ["click", "view", "signup", "error", "purchase"]
    apis = ["List", "Cipher", "Intent", "Servlet", "Multimap", "Map"]
    names = F.array(*[F.lit(c) for c in calls])

    def pred(k: Column) -> Column:
        which = (F.col("event_id") + 3 * k + F.col("user_id")) % 11
        return F.coalesce(F.get(names, which.cast("int")), F.lit("other"))

    return dealt(table(spark, folder, "events")).select(
        F.col("event_id").alias("sample_id"),
        F.get(F.array(*[F.lit(a) for a in apis]), (F.col("event_id") % 6).cast("int")).alias("api"),
        F.col("event_type").alias("call"),
        F.transform(F.sequence(F.lit(1), F.lit(10)), pred).alias("preds"),
    )


def joined(arr: Column | str) -> Column:
    """An array as text, so that both engines hash it alike."""
    arr = F.col(arr) if isinstance(arr, str) else arr
    return F.array_join(F.transform(arr, lambda x: x.cast("string")), " ")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)
