"""The operators as named queries over the driver tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.ann import nearest
from corpusmill.llm.decontaminate import contamination
from corpusmill.llm import conversation_repair, licenses, merkle, pii, secrets, sentencepiece, warc
from corpusmill.llm.html_text import main_text
from corpusmill.llm.minhash import near_duplicates
from corpusmill.llm.quality import fit_quality, held_out, score_quality
from corpusmill.llm.substring_dedup import remove_repeats
from corpusmill.registry.base import dealt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

REPEATS = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 34], ' ') AS t
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS p FROM w)),
again AS (SELECT t FROM win GROUP BY t HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, p + unnest(range(0, 35)) AS p FROM win SEMI JOIN again USING (t)),
gone AS (SELECT doc_id, list(p) AS ps FROM hit GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(coalesce(ps, [])) AS n_removed,
       sha256(array_to_string(list_filter(ws, lambda x, i: ps IS NULL OR NOT list_contains(ps, i)), ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""


@query("op1_substring_dedup", REPEATS)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), length=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
common AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM x p JOIN x q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, e.b FROM reach JOIN both_ways e ON e.a = reach.r)
SELECT doc_id, any_value(n) AS n_shingles, min(r) AS component_id, min(r) = doc_id AS kept
FROM reach JOIN n USING (doc_id) GROUP BY doc_id
"""


@query("op2_minhash", NEAR)
def minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), percent=85, words=5)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SHARED = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex({LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex({LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
i AS (SELECT DISTINCT item_id, least(10, len(ws)) AS size, unnest(list_transform(range(1, len(ws) - least(10, len(ws)) + 2), lambda p: array_to_string(ws[p:p + least(10, len(ws)) - 1], ' '))) AS t
      FROM b WHERE len(ws) > 0),
w AS (SELECT doc_id, size, unnest(range(1, len(ws) - size + 2)) AS p, ws FROM d, (SELECT DISTINCT size FROM i) WHERE len(ws) >= size),
hit AS (SELECT doc_id, p, w.size AS size, item_id FROM w JOIN i ON i.size = w.size AND i.t = array_to_string(ws[p:p + w.size - 1], ' ')),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, p + unnest(range(0, size)) AS q FROM hit) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


@query("op3_decontamination", SHARED)
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def _kind_sql(kind: str, order: int, pattern: str, check: str) -> str:
    """Matches of one kind with their offsets, from the pieces between them; ``check`` is a condition on match ``m``."""
    return f"""
SELECT doc_id, {order} AS k, '{kind}' AS kind, start, start + length(m) AS stop, m FROM (
  SELECT doc_id, m, list_sum(list_transform(ps[1:i], lambda x: length(x))) + list_sum(list_transform(list_prepend('', ms[1:i - 1]), lambda x: length(x))) AS start
  FROM (SELECT doc_id, ms, ps, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS i
        FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps FROM t)))
WHERE {check}"""


def _spans_sql(kinds: list[tuple[str, str, str]], counts: str) -> str:
    """Counts and the digest of the base spans; the list of all spans is left out."""
    union = " UNION ALL ".join(_kind_sql(k, i, p, c) for i, (k, p, c) in enumerate(kinds))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({union}),
g AS (SELECT doc_id, string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, k) AS spans, {counts} FROM s GROUP BY doc_id)
SELECT doc_id, {{columns}}, sha256(coalesce(spans, '')) AS base_sha256 FROM t LEFT JOIN g USING (doc_id)
"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""length({_DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i:
  CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN CAST({_DIGITS}[i] AS INT)
       ELSE 2 * CAST({_DIGITS}[i] AS INT) - CASE WHEN CAST({_DIGITS}[i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0"),
    ("card", r"[0-9]([\x20-]?[0-9])+", _LUHN),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
]
_COUNTS = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, _, _ in PERSONAL)
_COLUMNS = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, _, _ in PERSONAL)


@query("op4_pii")
def personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    base = F.filter("pii", lambda x: x["order"] < len(pii.BASE))
    counts = [_times("pii", kind) for kind in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.span_list(base), 256).alias("base_sha256"), pii.span_list(F.col("pii")).alias("spans"))


def _times(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


SECRETS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""", r"""length(regexp_extract(m, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6"""),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
    ("hex", "[0-9a-f]+", "length(m) >= 24"),
]
_SECRET_COUNTS = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, _, _ in SECRETS)
_SECRET_COLUMNS = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, _, _ in SECRETS)


@query("op5_secrets")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    base = F.filter("secrets", lambda x: x["kind"].isin(*secrets.BASE))
    counts = [_times("secrets", kind) for kind in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.span_list(base), 256).alias("base_sha256"), pii.span_list(F.col("secrets")).alias("spans"))


GOOD = 0.7
"""Documents that score less are rejected."""


@query("op6_quality")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


@query("op7_ann")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def _header(name: str, alias: str) -> Column:
    return F.get(F.filter("headers", lambda h: h["name"] == name), 0)["value"].alias(alias)


@query("op8_warc")
def warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derived_records(warc.response_records(table(spark, sf_dir, "pages")))
    return records.select(
        _header("WARC-Type", "warc_type"),
        _header("WARC-Record-ID", "record_id"),
        _header("WARC-Refers-To", "refers_to"),
        _header("WARC-Target-URI", "target_uri"),
        _header("WARC-Source-Payload-Digest", "source_payload_digest"),
        _header("WARC-Block-Digest", "block_digest"),
        F.octet_length("content").cast("long").alias("content_length"),
        F.sha2("content", 256).alias("content_sha256"),
    )


SENTENCEPIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query("op9_sentencepiece")
def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), SENTENCEPIECE_MODEL)
    return out.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.sha2(F.array_join("tokens", ","), 256).alias("tokens_sha256"), "same")


@query("op10_html_text")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)),
  lambda r, b: list_reduce(list_prepend(xor(r, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, zero: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
"""CRC-32 of an ASCII text, bit by bit."""


def _leaf_sql(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(concat(" + ", ".join(f"coalesce(CAST(strlen({f}) AS VARCHAR) || ':' || {f}, '-')" for f in fields) + "))"


def _levels_sql(name: str, start: str) -> str:
    """All levels over lists of digests: ``tree, l, nodes``."""
    up = "list_transform(range(0, (len(nodes) + 15) // 16), lambda i: sha256(array_to_string(nodes[16 * i + 1:16 * i + 16], '')))"
    return f"{name}(tree, l, nodes) AS ({start} UNION ALL SELECT tree, l + 1, {up} FROM {name} WHERE len(nodes) > 1)"


def _steps_sql(place: str) -> str:
    """The siblings and the place in the run at each level, from a 0-based place among the leaves."""
    p = f"({place} // CAST(pow(16, l) AS BIGINT))"
    return f"CAST({p} % 16 AS BIGINT) AS k, list_filter(nodes[16 * ({p} // 16) + 1:16 * ({p} // 16) + 16], lambda x, i: i <> 1 + {p} % 16) AS others"


MERKLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf_sql("text")} AS leaf,
    CASE WHEN {_CRC.format(text="CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM d),
{_levels_sql("lower_levels", "SELECT tree, 0, list(leaf ORDER BY p) FROM placed GROUP BY tree")},
subroots AS (SELECT tree, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS q FROM lower_levels WHERE len(nodes) = 1),
{_levels_sql("upper_levels", "SELECT '', 0, list(subroot ORDER BY q) FROM subroots")},
top AS (SELECT nodes[1] AS root FROM upper_levels WHERE len(nodes) = 1),
steps AS (SELECT tree, p, l, {_steps_sql("p")} FROM placed JOIN lower_levels USING (tree) WHERE len(nodes) > 1
  UNION ALL SELECT tree, p, 1000 + l, {_steps_sql("q")} FROM placed JOIN subroots USING (tree), upper_levels u(none, l, nodes) WHERE len(nodes) > 1),
numbered AS (SELECT tree, p, row_number() OVER (PARTITION BY tree, p ORDER BY l) AS i, k, others FROM steps),
fold(tree, p, i, node) AS (SELECT tree, p, 0, coalesce(changed, leaf) FROM placed
  UNION ALL SELECT f.tree, f.p, f.i + 1, sha256(concat(array_to_string(others[1:k], ''), node, array_to_string(others[k + 1:], '')))
  FROM fold f JOIN numbered n ON n.tree = f.tree AND n.p = f.p AND n.i = f.i + 1),
proof AS (SELECT tree, p, string_agg(array_to_string(others, ''), '' ORDER BY i) AS others, count(*) AS n FROM numbered GROUP BY tree, p)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(others, '')) AS proof_sha256, node AS folded_root, node = root AS verified
FROM placed JOIN subroots USING (tree) CROSS JOIN top LEFT JOIN proof USING (tree, p) JOIN fold f ON f.tree = placed.tree AND f.p = placed.p AND f.i = coalesce(n, 0)
"""


@query("op13_merkle", MERKLE)
def merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_query(table(spark, sf_dir, "documents"))


def merkle_query(docs: DataFrame) -> DataFrame:
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = [F.col(c) for c in merkle.FIELDS if c != "text"]
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf_digest(*fields, lowered))
    proofs = merkle.dataset_proofs(docs, changed=changed)
    found = proofs.withColumn("folded_root", merkle.folded(F.coalesce("changed", "leaf"), F.col("steps")))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
_ENDS = r"[.!?][\x20\x09-\x0D]*$"


def _way(state: str, cost: str, letter: str, line: str) -> str:
    """One more edit: cost, letters so far, lines so far."""
    return f"{{{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': list_concat({state}.t, {line})}}}}".replace("{{", "{").replace("}}", "}")


def _least_sql(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _inserted_sql(source: str) -> str:
    """States 2 and 3 with rows inserted: after any state a user row, after that an assistant row."""
    two = _least_sql("v2", *(_way(v, "2", "I", "['user:']") for v in ("v0", "v1", "v3")))
    return f"SELECT * EXCLUDE (v2, v3), w2 AS v2, {_least_sql('v3', _way('w2', '2', 'I', chr(91) + chr(39) + 'assistant:' + chr(39) + chr(93)))} AS v3 FROM (SELECT *, {two} AS w2 FROM {source})"


def _row_sql() -> str:
    """The states behind a row, from those in front of it."""
    none, line, far = "CAST([] AS VARCHAR[])", "[role || ':' || text]", "CASE WHEN {} THEN open ELSE 1000000 END"
    keep = lambda v, c: _way(v, far.format(f"NOT bad AND role[1] = '{c}'"), "K", line)
    name = lambda v, role: _way(v, far.format("NOT bad") + " + 2", "R", f"['{role}:' || text]")
    gone = lambda v: _way(v, "3", "D", none)
    two = [gone("v2"), *(keep(v, "u") for v in ("v0", "v1", "v3")), *(name(v, "user") for v in ("v0", "v1", "v3"))]
    return ", ".join([gone("v0"), _least_sql(gone("v1"), keep("v0", "s")), _least_sql(*two), _least_sql(gone("v3"), keep("v2", "a"), name("v2", "assistant"))])


_EMPTY = "{'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}"
_FAR = "{'c': CAST(1000000 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}"
REPAIR = f"""
WITH RECURSIVE given AS (SELECT conv_id, coalesce('=' || conv_id, '') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format(text=_KEY)} % 20 AS h FROM conversations),
damaged AS (SELECT conv, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(0, CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM given),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text), copy) - 1 AS i FROM damaged),
judged AS (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '{_ENDS}') AS cut, lag(role) OVER (PARTITION BY conv ORDER BY i) AS before FROM placed),
f AS (SELECT conv, i, role, text, blank OR again AS bad, CAST(cut AS INT) AS open FROM judged),
counts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
    count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated, count(*) FILTER (before IS NOT NULL AND before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
    FROM judged GROUP BY conv),
walk(conv, nth, v0, v1, v2, v3) AS (SELECT conv, 0, {_EMPTY}, {_FAR}, {_FAR}, {_FAR} FROM counts
  UNION ALL SELECT conv, nth + 1, {_row_sql()} FROM ({_inserted_sql("walk")}) JOIN f USING (conv) WHERE f.i = nth),
done AS (SELECT conv, {_least_sql("v0", "v3")} AS best FROM ({_inserted_sql("(SELECT walk.* FROM walk JOIN counts USING (conv) WHERE nth = n)")}))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM given) LEFT JOIN counts USING (conv) LEFT JOIN done USING (conv)
"""


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults, by the checksum of conversation and turn."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    fault = lambda k: F.col("_fault") == k
    hit = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("_fault")).filter(~fault(0))
    said = F.when(fault(1), "").when(fault(2), F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(fault(3), 2).otherwise(1)))
    return hit.select("conv_id", "turn", F.when(fault(4), "user").otherwise(F.col("role")).alias("role"), said.alias("text"), copies.alias("_copy")).drop("_copy")


@query("op12_conversation_repair", REPAIR)
def repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_query(table(spark, sf_dir, "conversations"))


def repair_query(rows: DataFrame) -> DataFrame:
    repair = conversation_repair.repair_conversations(damaged(rows), whole=True)
    digests = conversation_repair.conversation_digests(repair.rows)
    every = rows.select("conv_id").distinct().withColumn("conv", conversation_repair.conv_key(F.col("conv_id")))
    out = every.join(repair.reports, "conv", "left").join(digests, "conv", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


NOTICES = f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex({LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
p(label, phrase) AS (VALUES ('cc-by', ['cc', 'by']), ('gpl', ['general', 'public', 'license']), ('reserved', ['all', 'rights', 'reserved'])),
places AS (SELECT doc_id, label, unnest(list_filter(range(0, len(ws)), lambda i: ws[i + 1:i + len(phrase)] = phrase)) AS i FROM w, p),
g AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM w LEFT JOIN g USING (doc_id)
"""


@query("op11_licenses")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_query(table(spark, sf_dir, "documents"))


def license_query(docs: DataFrame) -> DataFrame:
    found = licenses.find_licenses(docs.select("doc_id", "text")).select("doc_id", "n_words", "licenses", licenses.base_places(F.col("licenses")).alias("base"))
    words = F.transform("base", lambda x: x["word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        licenses.label_list(F.col("base")).alias("base_labels"),
        licenses.label_list(F.col("licenses")).alias("labels"),
        licenses.certainty(F.col("licenses")).alias("score"),
        licenses.openness(F.col("licenses")).alias("openness"),
    )


CHECKS = {"op5_secrets": _spans_sql(SECRETS, _SECRET_COUNTS).format(columns=_SECRET_COLUMNS), "op4_pii": _spans_sql(PERSONAL, _COUNTS).format(columns=_COLUMNS), "op11_licenses": NOTICES}
"""SQL for those columns of a query that SQL can give; tests compare with it."""
