"""Small reference tables: language keywords and the API catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The keywords of each language, in the order of its list.
KEYWORDS = {
    "java": """abstract assert boolean break byte case catch char class const continue default do double else
        enum extends final finally float for goto if implements import instanceof int interface long native
        new package private protected public return short static strictfp super switch synchronized this
        throw throws transient try void volatile while""",
    "c_sharp": """abstract as base bool break byte case catch char checked class const continue decimal default
        delegate do double else enum event explicit extern false finally fixed float for foreach goto if
        implicit in int interface internal is lock long namespace new null object operator out override
        params private protected public readonly ref return sbyte sealed short sizeof stackalloc static
        string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual
        void volatile while add alias ascending async await by descending dynamic equals from get global
        group into join let nameof notnull on orderby partial remove select set unmanaged value var when
        where yield""",
    "python": """False None True and as assert async await break class continue def del elif else except finally
        for from global if import in is lambda nonlocal not or pass raise return try while with yield""",
}


def keyword_list(lang: str) -> list[str]:
    if lang not in KEYWORDS:
        raise ValueError(f"no keyword list for {lang!r}; there are {sorted(KEYWORDS)}")
    return KEYWORDS[lang].split()


def read_keywords(spark: SparkSession, lang: str) -> DataFrame:
    """``(lang, keyword)``."""
    return spark.createDataFrame([(lang, k) for k in keyword_list(lang)], "lang string, keyword string")


def read_api_catalog(df: DataFrame, column: str = "fqn") -> DataFrame:
    """The distinct ``Class.call`` names of a table."""
    return df.select(F.col(column).alias("fqn")).where(F.col(column).isNotNull()).distinct()
