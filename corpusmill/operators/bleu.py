"""BLEU family over a table ``(pair_id, refs, hyp)``.

Each row is a pair. Its n-grams are counted and clipped inside the row, in array columns, so neither
they nor the texts are shuffled, and a task holds those of one pair at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.arrays import ngrams
from corpusmill.functions.scores import DEFAULT_WEIGHTS, bleu, closest_ref_len
from corpusmill.functions.text import ws_tokens


def ngram_counts(df: DataFrame, arr: str, max_order: int, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """``(*keys, n, gram, cnt)`` for all orders up to ``max_order``; tokens hold no spaces."""
    orders = df.select(*keys, arr, F.explode(F.sequence(F.lit(1), F.lit(max_order))).alias("n"))
    grams = orders.select(*keys, "n", F.explode(ngrams(arr, F.col("n"))).alias("_g"))
    return grams.groupBy(*keys, "n", F.array_join("_g", " ").alias("gram")).agg(F.count(F.lit(1)).alias("cnt"))


LENGTHS = ["hyp_len", "min_ref_len", "closest_ref_len"]


def _tokens(pairs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``_refs`` and ``_hyp``, the tokens of each side, and the pair's lengths.

    A missing text counts as empty, and no reference as one empty reference.
    """
    refs = F.when(F.size("refs") > 0, F.col("refs")).otherwise(F.array(F.lit("")))
    tokens = pairs.select(
        *keep,
        "pair_id",
        F.transform(refs, lambda r: ws_tokens(F.coalesce(r, F.lit("")))).alias("_refs"),
        ws_tokens(F.coalesce("hyp", F.lit(""))).alias("_hyp"),
    )
    hyp_len = F.size("_hyp").cast("long")
    ref_lens = F.transform("_refs", lambda r: F.size(r).cast("long"))
    return tokens.select(
        *keep,
        "pair_id",
        "_refs",
        "_hyp",
        hyp_len.alias("hyp_len"),
        F.array_min(ref_lens).alias("min_ref_len"),
        closest_ref_len(ref_lens, hyp_len).alias("closest_ref_len"),
    )


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _numbered(tokens: Column, n: int) -> Column:
    """Each n-gram with its how-manieth occurrence before it, such as ``1:a b`` and ``2:a b``; no two are equal.

    What two such arrays share is as large as the clipped matches of their sides.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0)))
    grams = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(tokens, i + j) for j in range(n)]))

    def runs(grams: Column) -> Column:
        last = F.size(grams) - 1
        firsts = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get(grams, i) != F.get(grams, i - 1)))

        def of_run(firsts: Column, first: Column, run: Column) -> Column:
            times = F.coalesce(F.get(firsts, run + 1), F.size(grams)) - first
            return F.transform(F.sequence(F.lit(1), times), lambda k: F.concat_ws(":", k.cast("string"), F.get(grams, first)))

        return _named(firsts, lambda firsts: F.flatten(F.transform(firsts, lambda first, run: of_run(firsts, first, run))))

    return F.when(F.size(tokens) >= n, _named(F.sort_array(grams), runs)).otherwise(F.array().cast("array<string>"))


def bleu_terms(pairs: DataFrame, max_order: int = 4, keep: Sequence[str] = ()) -> DataFrame:
    """One row per pair: ``m1..`` clipped matches, ``h1..`` n-grams of the hypothesis, lengths.

    A match is clipped at the largest count in any one reference.
    """

    def matches(n: int) -> Column:
        in_refs = F.flatten(F.transform("_refs", lambda ref: _numbered(ref, n)))
        return F.size(F.array_intersect(_numbered(F.col("_hyp"), n), in_refs)).cast("long").alias(f"m{n}")

    orders = range(1, max_order + 1)
    possible = [F.greatest(F.col("hyp_len") - (n - 1), F.lit(0)).alias(f"h{n}") for n in orders]
    return _tokens(pairs, keep).select(*keep, "pair_id", *[matches(n) for n in orders], *LENGTHS, *possible)


def recall_terms(
    pairs: DataFrame, keywords: Sequence[str] = (), max_order: int = 4, keep: Sequence[str] = (), other_weight: float = 0.2
) -> DataFrame:
    """One row per pair: ``m1..`` matched and ``d1..`` all n-grams of the references, summed over them.

    Unigrams count 1 if they are a keyword and ``other_weight`` if not; every reference adds
    at least 1 to each denominator.
    """
    def weighed(grams: Column, word: Callable[[Column], Column]) -> Column:
        known = F.size(F.filter(grams, lambda g: word(g).isin(list(keywords))))
        return known * 1.0 + (F.size(grams) - known) * float(other_weight)

    def matched(n: int) -> Column:
        def of_ref(ref: Column, in_hyp: Column) -> Column:
            both = F.array_intersect(_numbered(ref, n), in_hyp)
            if n > 1:
                return F.size(both).cast("double")
            return _named(both, lambda both: weighed(both, lambda g: F.regexp_replace(g, "^[0-9]+:", "")))

        per_ref = lambda in_hyp: _sum(F.transform("_refs", lambda ref: of_ref(ref, in_hyp)))
        return _named(_numbered(F.col("_hyp"), n), per_ref).alias(f"m{n}")

    def possible(n: int) -> Column:
        def of_ref(ref: Column) -> Column:
            all_ = weighed(ref, lambda g: g) if n == 1 else (F.size(ref) - (n - 1)).cast("double")
            return F.greatest(all_, F.lit(1.0))

        return _sum(F.transform("_refs", of_ref)).alias(f"d{n}")

    orders = range(1, max_order + 1)
    terms = [f(n) for f in (matched, possible) for n in orders]
    return _tokens(pairs, keep).select(*keep, "pair_id", *terms, *LENGTHS)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda total, x: total + x)


def exact_match(pairs: DataFrame, keep: Sequence[str] = (), n_rows: str | None = None) -> DataFrame:
    """Share of all rows whose hypothesis equals its first reference, in per cent; a missing text equals none.

    ``n_rows`` names a column for the number of rows, from the same pass.
    """
    same = F.coalesce((F.get("refs", F.lit(0)) == F.col("hyp")).cast("int"), F.lit(0))
    counts = [F.count(F.lit(1)).alias(n_rows)] if n_rows else []
    return pairs.groupBy(*keep).agg(*counts, F.round(100 * F.avg(same), 2).alias("accuracy"))


def corpus_bleu_smooth(
    pairs: DataFrame, max_order: int = 4, smooth: bool = True, keep: Sequence[str] = ()
) -> DataFrame:
    """BLEU with one added to every match and possible count: score, precisions, ``bp``, ``ratio``, lengths.

    Without ``smooth`` one order without a match makes the score 0. An empty side does, too.
    """
    orders = range(1, max_order + 1)
    sums = bleu_terms(pairs, max_order, keep).groupBy(*keep).agg(
        *[F.sum(f"{x}{n}").alias(f"{x}{n}") for x in "mh" for n in orders],
        F.sum("hyp_len").alias("hyp_len"),
        F.sum("min_ref_len").alias("ref_len"),
    )
    one = 1 if smooth else 0
    p = [F.coalesce(F.try_divide(F.col(f"m{n}") + one, (F.col(f"h{n}") + one).cast("double")), F.lit(0.0)) for n in orders]
    ratio = F.try_divide(F.col("hyp_len").cast("double"), F.col("ref_len"))
    empty = (F.col("hyp_len") == 0) | (F.col("ref_len") == 0)
    bp = F.when(empty, 0.0).when(ratio > 1, 1.0).otherwise(F.exp(1 - F.try_divide(F.lit(1.0), ratio)))
    logs = F.lit(0.0)
    for x in p:
        logs = logs + F.log(x) * (1.0 / max_order)
    geo_mean = F.when(F.least(*p) > 0, F.exp(logs)).otherwise(0.0) if max_order > 1 else p[0]
    score = F.when(empty, 0.0).otherwise(geo_mean * bp)
    return sums.select(
        *keep,
        score.alias("bleu"),
        F.round(100 * score, 2).alias("bleu_percent"),
        F.array(*p).alias("precisions"),
        bp.alias("bp"),
        ratio.alias("ratio"),
        "hyp_len",
        "ref_len",
    )


def _min_one(c: Column) -> Column:
    return F.greatest(c, F.lit(1))


def corpus_bleu(
    pairs: DataFrame,
    weights: Sequence[float] = DEFAULT_WEIGHTS,
    method: int = 1,
    auto_reweigh: bool = False,
    keep: Sequence[str] = (),
    **constants: float,
) -> DataFrame:
    """BLEU with free weights: matches and n-grams summed over the corpus, then smoothed.

    Methods 5 to 7 look at single sentences, use :func:`sentence_bleu` for them.
    """
    if method > 4:
        raise ValueError("smoothing methods 5 to 7 are defined per sentence")
    orders = range(1, len(weights) + 1)
    sums = bleu_terms(pairs, len(weights), keep).groupBy(*keep).agg(
        *[F.sum(f"m{n}").alias(f"m{n}") for n in orders],
        *[F.sum(_min_one(F.col(f"h{n}"))).alias(f"h{n}") for n in orders],
        F.sum("hyp_len").alias("hyp_len"),
        F.sum("closest_ref_len").alias("ref_len"),
    )
    score = bleu(
        [F.col(f"m{n}") for n in orders],
        [F.col(f"h{n}") for n in orders],
        F.col("ref_len"),
        F.col("hyp_len"),
        weights,
        method,
        auto_reweigh,
        **constants,
    )
    return sums.select(*keep, score.alias("bleu"))


def sentence_bleu(
    pairs: DataFrame,
    weights: Sequence[float] = DEFAULT_WEIGHTS,
    method: int = 1,
    auto_reweigh: bool = False,
    keep: Sequence[str] = (),
    **constants: float,
) -> DataFrame:
    """The same score for every single pair."""
    orders = range(1, len(weights) + 1)
    with_fifth = method in (5, 7)
    terms = bleu_terms(pairs, max(len(weights), 5) if with_fifth else len(weights), keep)
    fifth = F.col("m5").cast("double") / _min_one(F.col("h5")) if with_fifth else None
    score = bleu(
        [F.col(f"m{n}") for n in orders],
        [_min_one(F.col(f"h{n}")) for n in orders],
        F.col("closest_ref_len"),
        F.col("hyp_len"),
        weights,
        method,
        auto_reweigh,
        fifth,
        **constants,
    )
    return terms.select(*keep, "pair_id", score.alias("bleu"))


def modified_precision(pairs: DataFrame, n: int) -> DataFrame:
    """``(pair_id, numerator, denominator)`` of order ``n``, not reduced."""
    terms = bleu_terms(pairs, n)
    return terms.select("pair_id", F.col(f"m{n}").alias("numerator"), _min_one(F.col(f"h{n}")).alias("denominator"))


def weighted_bleu(
    pairs: DataFrame,
    keywords: Sequence[str],
    weights: Sequence[float] = DEFAULT_WEIGHTS,
    method: int = 1,
    ref_len_mode: str = "reference",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Recall of reference n-grams with keyword-weighted unigrams.

    The published scores take every reference to be 2 long in the brevity penalty;
    ``ref_len_mode="tokens"`` counts its tokens instead, and ``"both"`` adds that score as
    ``bleu_tokens`` from the same sums.
    """
    if method not in (1, 2):
        raise ValueError("smoothing methods 1 and 2 are defined here")
    if ref_len_mode not in ("reference", "tokens", "both"):
        raise ValueError("ref_len_mode is 'reference', 'tokens' or 'both'")
    orders = range(1, len(weights) + 1)
    sums = recall_terms(pairs, keywords, len(weights), keep).groupBy(*keep).agg(
        *[F.sum(f"{x}{n}").alias(f"{x}{n}") for x in "md" for n in orders],
        F.sum("hyp_len").alias("hyp_len"),
        F.sum(F.lit(2)).alias("reference"),
        F.sum("closest_ref_len").alias("tokens"),
    )
    matched, possible = ([F.col(f"{x}{n}") for n in orders] for x in "md")
    score = {m: bleu(matched, possible, F.col(m), F.col("hyp_len"), weights, method) for m in ("reference", "tokens")}
    if ref_len_mode == "both":
        return sums.select(*keep, score["reference"].alias("bleu"), score["tokens"].alias("bleu_tokens"))
    return sums.select(*keep, score[ref_len_mode].alias("bleu"))


def keyword_weight(tokens: DataFrame, keywords: Sequence[str], column: str = "token", other_weight: float = 0.2) -> DataFrame:
    """The distinct tokens with weight 1 for keywords and ``other_weight`` for others."""
    weight = F.when(F.col(column).isin(list(keywords)), 1.0).otherwise(other_weight)
    return tokens.select(column).distinct().withColumn("weight", weight)
