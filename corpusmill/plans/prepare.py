"""From the raw corpus to the published one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import content_hash, is_autogenerated, line_count
from corpusmill.operators.dedup import dedup_first
from corpusmill.operators.rows import drop_columns, filter_max_lines


def prepare_corpus(
    df: DataFrame,
    text: str = "source_code",
    row_id: str = "row_id",
    line_max: int = 250,
    drop_generated: bool = False,
) -> DataFrame:
    """Exact dedup and the length filter in one lazy plan; whole rows are shuffled once at most.

    The first copy of a text claims its hash even when it is too long to stay, so a shorter
    copy of it goes as well. Rows are told apart by ``row_id``; a null one is an error, see
    :func:`corpusmill.sources.corpus.with_row_ids` for a corpus without ids.
    """
    known = F.when(F.col(row_id).isNotNull(), F.col(row_id)).otherwise(F.raise_error("a row has no id").cast(df.schema[row_id].dataType))
    marked = df.withColumn(row_id, known).withColumns({"hash": content_hash(text), "lines": line_count(text).cast("int")})
    kept = filter_max_lines(dedup_first(marked, "hash", row_id), line_max)
    if drop_generated:
        kept = kept.filter(~is_autogenerated(F.col(text)))
    return drop_columns(kept, ["lines", "hash"])
