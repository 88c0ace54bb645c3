"""Vocabulary training, encoding, blocks, masks and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import arrays as A
from corpusmill.functions import text as X
from corpusmill.operators import rows as R
from corpusmill.operators.blocks import assign_batches, causal_labels, pack_blocks
from corpusmill.operators.bpe import encode, load_bpe, pre_tokens, train_bpe, word_counts, write_vocab
from corpusmill.operators.position import by_id, dense_position
from corpusmill.registry.base import documents, joined, register
from corpusmill.registry.scores import words
from corpusmill.session import scratch_path

# word lengths stand in for token ids where the vocabulary does not matter
IDS = f"SELECT doc_id AS row_id, list_transform({words('text')}, lambda t: length(t)) AS ids FROM documents"


def word_length_ids(spark, folder):
    docs = documents(spark, folder)
    return docs.select("row_id", F.transform(X.ws_tokens("source_code"), lambda t: F.length(t)).alias("input_ids"))


def ints(c: str) -> str:
    return f"array_to_string({c}, ' ')"


# the look-ahead of the word pattern, by a mark before the last blank of a run
WORDS = r"""SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM (SELECT doc_id, regexp_extract_all(
    regexp_replace(text, '(\s)(\S)', chr(1) || '\1\2', 'g'),
    '''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x01]+|\s+') AS w FROM documents)"""
N_MERGES = 3


def bpe_sql(n: int = N_MERGES) -> str:
    """CTEs ``w0..wn`` (words with symbols) and ``b1..bn`` (the best pair of each round)."""
    parts = [
        f"toks AS (SELECT * FROM ({WORDS}))",
        """w0 AS (SELECT word, regexp_replace(hex(encode(word)), '(..)', '<\\1>', 'g') AS s, count(*) AS cnt
             FROM toks GROUP BY word)""",
    ]
    for i in range(1, n + 1):
        parts.append(
            f"""b{i} AS (SELECT l, r, CAST(sum(cnt) AS BIGINT) AS cnt FROM (
              SELECT unnest(x[1:len(x) - 1]) AS l, unnest(x[2:]) AS r, cnt FROM (SELECT regexp_extract_all(s, '<([0-9A-F]+)>', 1) AS x, cnt FROM w{i - 1}) WHERE len(x) > 1)
              GROUP BY l, r ORDER BY cnt DESC, l, r LIMIT 1)"""
        )
        parts.append(
            f"""w{i} AS (SELECT word, replace(s, (SELECT '<' || l || '><' || r || '>' FROM b{i}), (SELECT '<' || l || r || '>' FROM b{i})) AS s, cnt FROM w{i - 1})"""
        )
    return "WITH " + ",\n".join(parts)


MERGE_ROWS = " UNION ALL ".join(f"SELECT {i - 1} AS rank, l AS \"left\", r AS \"right\", cnt FROM b{i}" for i in range(1, N_MERGES + 1))
VOCAB_IDS = " ".join(f"WHEN t = (SELECT l || r FROM b{i}) THEN {256 + i}" for i in range(1, N_MERGES + 1))
ENCODED = f"""{bpe_sql()}, wi AS (SELECT word, list(CASE {VOCAB_IDS} ELSE TRY_CAST('0x' || t AS INT) + 1 END ORDER BY j) AS ids FROM (
  SELECT word, unnest(x) AS t, unnest(range(len(x))) AS j FROM (SELECT word, regexp_extract_all(s, '<([0-9A-F]+)>', 1) AS x FROM w{N_MERGES})) GROUP BY word),
doc_ids AS (SELECT doc_id AS row_id, flatten(list(ids ORDER BY i)) AS ids FROM toks JOIN wi USING (word) GROUP BY doc_id)
"""


def small_bpe(spark, folder):
    return train_bpe(documents(spark, folder), 257 + N_MERGES, n_rows=None, index=False)


@register("word_counts", bpe_sql(0) + " SELECT word, s AS symbols, cnt FROM w0")
def _(spark, folder):
    return word_counts(documents(spark, folder))


@register("train_bpe", f"{bpe_sql()} {MERGE_ROWS}")
def _(spark, folder):
    return small_bpe(spark, folder).merge_table(spark)


MANY_MERGES = 32
MANY_ROWS = " UNION ALL ".join(f"SELECT {i - 1} AS rank, l AS \"left\", r AS \"right\", cnt FROM b{i}" for i in range(1, MANY_MERGES + 1))


@register("train_bpe_indexed", f"{bpe_sql(MANY_MERGES).replace(' AS (', ' AS MATERIALIZED (')} {MANY_ROWS}")
def _(spark, folder):
    return train_bpe(documents(spark, folder), 257 + MANY_MERGES).merge_table(spark)


@register(
    "encode",
    ENCODED
    + f"""SELECT d.doc_id AS row_id, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_tokens, md5(coalesce({ints('ids')}, '')) AS ids_md5
          FROM documents d LEFT JOIN doc_ids ON d.doc_id = doc_ids.row_id""",
)
def _(spark, folder):
    tokens = encode(documents(spark, folder), small_bpe(spark, folder))
    return tokens.select("row_id", F.size("input_ids").cast("long").alias("n_tokens"), F.md5(joined("input_ids")).alias("ids_md5"))


@register(
    "encode_with_masks",
    ENCODED
    + """SELECT row_id, CAST(len(ids) + 2 AS BIGINT) AS n_tokens, CAST(len(ids) + 2 AS BIGINT) AS attended, CAST(2 AS BIGINT) AS special,
         CAST(256 + list_sum(ids) AS BIGINT) AS id_sum FROM doc_ids""",
)
def _(spark, folder):
    tokens = encode(documents(spark, folder), small_bpe(spark, folder), bos_id=0, eos_id=256, masks=True)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return tokens.select(
        "row_id",
        F.size("input_ids").cast("long").alias("n_tokens"),
        total("attention_mask").alias("attended"),
        total("special_tokens_mask").alias("special"),
        total("input_ids").alias("id_sum"),
    )


VOCAB_ROWS = f"""SELECT 0 AS id, '<|endoftext|>' AS token, -1 AS rank UNION ALL
  SELECT CAST(b + 1 AS BIGINT), upper(lpad(to_hex(b), 2, '0')), -1 FROM (SELECT unnest(range(256)) AS b) UNION ALL
  SELECT 257 + rank, "left" || "right", rank FROM ({MERGE_ROWS})"""


@register("write_vocab", f"{bpe_sql()} {VOCAB_ROWS}")
def _(spark, folder):
    path = scratch_path(spark, "vocab")
    write_vocab(small_bpe(spark, folder), spark, path)
    bpe = load_bpe(spark.read.parquet(f"{path}/merges"), spark.read.parquet(f"{path}/vocab"))
    merged = bpe.merge_table(spark).select(F.concat("left", "right").alias("token"), "rank")
    rows = bpe.vocab_table(spark).join(merged, "token", "left")
    return rows.select(F.col("id").cast("long").alias("id"), "token", F.coalesce("rank", F.lit(-1)).cast("long").alias("rank"))


# --- lengths ------------------------------------------------------------------------------


@register("filter_token_len", f"SELECT row_id, CAST(len(ids) AS BIGINT) AS n FROM ({IDS}) WHERE len(ids) + 2 <= 30")
def _(spark, folder):
    kept = R.filter_token_len(word_length_ids(spark, folder), "input_ids", 30, n_special=2)
    return kept.select("row_id", F.size("input_ids").cast("long").alias("n"))


@register("filter_nonempty", f"SELECT row_id FROM ({IDS}) WHERE len(list_filter(ids, lambda x: x > 9)) > 0")
def _(spark, folder):
    long_words = word_length_ids(spark, folder).withColumn("input_ids", F.filter("input_ids", lambda x: x > 9))
    return R.filter_nonempty(long_words, "input_ids").select("row_id")


@register("keep_last", f"SELECT row_id, {ints('ids[greatest(len(ids) - 49, 1):]')} AS ids FROM ({IDS})")
def _(spark, folder):
    return word_length_ids(spark, folder).select("row_id", joined(A.keep_last("input_ids", 50)).alias("ids"))


FEATURES = f"""SELECT row_id, {ints("list_concat(list_concat(c, g), list_transform(range(64 - len(c) - len(g)), lambda i: 0))")} AS input_ids,
  {ints("list_concat(list_concat(list_transform(c, lambda x: -100), g), list_transform(range(64 - len(c) - len(g)), lambda i: -100))")} AS labels
  FROM (SELECT row_id, ctx[greatest(len(ctx) - (64 - len(g)) + 1, 1):] AS c, g FROM (
    SELECT row_id, ids[:greatest(len(ids) - 5, 0)] AS ctx, ids[greatest(len(ids) - 4, 1):] AS g FROM ({IDS})))"""


@register("completion_features", FEATURES)
def _(spark, folder):
    tokens = word_length_ids(spark, folder)
    gt = A.keep_last("input_ids", 5)
    ctx = F.slice("input_ids", F.lit(1), F.greatest(F.size("input_ids") - 5, F.lit(0)))
    made = tokens.select("row_id", A.completion_features(ctx, gt, 64, 0).alias("f"))
    return made.select("row_id", joined("f.input_ids").alias("input_ids"), joined("f.labels").alias("labels"))


@register("causal_labels", f"SELECT row_id, {ints('ids')} AS input_ids, {ints('ids')} AS labels FROM ({IDS})")
def _(spark, folder):
    rows = causal_labels(word_length_ids(spark, folder))
    return rows.select("row_id", joined("input_ids").alias("input_ids"), joined("labels").alias("labels"))


DRAWN = f"""SELECT row_id, i, x, CAST('0x' || substr(d, 1, 8) AS BIGINT) < {int(0.15 * 2**32)} AS chosen,
  CASE WHEN CAST('0x' || substr(d, 9, 8) AS BIGINT) < {int(0.8 * 2**32)} THEN 4
       WHEN CAST('0x' || substr(d, 9, 8) AS BIGINT) < {int(0.9 * 2**32)} THEN CAST('0x' || substr(d, 17, 8) AS BIGINT) % 1000 ELSE x END AS new
  FROM (SELECT *, md5(concat('7:', row_id, ':', i)) AS d FROM (SELECT row_id, unnest(ids) AS x, unnest(range(len(ids))) AS i FROM ({IDS})))"""


@register(
    "mlm_mask",
    f"""SELECT row_id, string_agg(CASE WHEN chosen THEN new ELSE x END, ' ' ORDER BY i) AS input_ids,
        string_agg(CASE WHEN chosen THEN x ELSE -100 END, ' ' ORDER BY i) AS labels FROM ({DRAWN}) GROUP BY row_id""",
)
def _(spark, folder):
    rows = R.filter_nonempty(word_length_ids(spark, folder), "input_ids")
    masked = rows.select("row_id", A.mlm_mask("input_ids", "row_id", 0.15, 7, 4, 1000).alias("m"))
    return masked.select("row_id", joined("m.input_ids").alias("input_ids"), joined("m.labels").alias("labels"))


# --- blocks and batches -------------------------------------------------------------------

POSITIONED = f"SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM ({IDS})"
PACKED = f"""SELECT g AS block_group, unnest(range(n)) AS block_no, unnest(list_transform(range(n), lambda i: a[i * 128 + 1:(i + 1) * 128])) AS ids FROM (
  SELECT g, a, CASE WHEN len(a) >= 128 THEN len(a) // 128 ELSE 1 END AS n FROM (
    SELECT CAST(floor(pos / 50) AS BIGINT) AS g, flatten(list(ids ORDER BY pos)) AS a FROM ({POSITIONED}) GROUP BY g) WHERE len(a) > 0)"""


@register("dense_position", POSITIONED.replace("SELECT *,", "SELECT row_id,"))
def _(spark, folder):
    return dense_position(word_length_ids(spark, folder).select("row_id"), by_id(), out="pos")


@register("pack_blocks", f"SELECT block_group, block_no, {ints('ids')} AS input_ids FROM ({PACKED})")
def _(spark, folder):
    blocks = pack_blocks(word_length_ids(spark, folder), 128, group_size=50)
    return blocks.select("block_group", "block_no", joined("input_ids").alias("input_ids"))


@register("assign_batches", f"SELECT row_id, CAST(floor(pos / 12) AS BIGINT) AS batch, pos % 12 AS slot FROM ({POSITIONED})")
def _(spark, folder):
    return assign_batches(documents(spark, folder).select("row_id"), 12)


@register(
    "assign_batches_shuffled",
    f"""SELECT row_id, CAST(floor(pos / 12) AS BIGINT) AS batch, pos % 12 AS slot FROM (
        SELECT row_id, row_number() OVER (ORDER BY md5(concat('42:', CAST(row_id AS VARCHAR))), row_id) - 1 AS pos FROM ({IDS}))""",
)
def _(spark, folder):
    return assign_batches(documents(spark, folder).select("row_id"), 12, seed=42)
