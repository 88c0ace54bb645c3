"""Score columns: brevity penalty, smoothing of precisions, weighted geometric mean.

Numerators and denominators stay apart until the last division, since sums over the corpus
and the smoothing methods read them one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the smoothing methods, and the smallest positive normal double.
EPSILON = 0.1
ALPHA = 5
K = 5
TINY = 2.2250738585072014e-308

DEFAULT_WEIGHTS = (0.25, 0.25, 0.25, 0.25)


def brevity_penalty(ref_len: Column, hyp_len: Column) -> Column:
    """1 for a longer hypothesis, 0 for an empty one, else ``exp(1 - ref/hyp)``."""
    return F.when(hyp_len > ref_len, 1.0).when(hyp_len == 0, 0.0).otherwise(F.exp(1 - F.try_divide(ref_len, hyp_len)))


def closest_ref_len(ref_lens: Column, hyp_len: Column) -> Column:
    """The reference length nearest to the hypothesis; the shorter one on a tie."""
    best = F.array_min(F.transform(ref_lens, lambda n: F.named_struct(F.lit("gap"), F.abs(n - hyp_len), F.lit("len"), n)))
    return best["len"]


def safe_exp(c: Column | str) -> Column:
    """Exponential that overflows to infinity."""
    return F.exp(c)


def smooth(
    nums: Sequence[Column],
    dens: Sequence[Column],
    method: int = 1,
    hyp_len: Column | None = None,
    fifth: Column | None = None,
    epsilon: float = EPSILON,
    alpha: float = ALPHA,
    k: float = K,
) -> list[Column]:
    """Smoothed precisions, one per order, by one of the eight published methods (0 to 7).

    ``fifth`` is the precision of order 5, which methods 5 and 7 look at. Method 6 is
    undefined, and null here, where no trigram matches.
    """
    p = [F.try_divide(n.cast("double"), d) for n, d in zip(nums, dens)]
    orders = range(len(p))
    zero = [n == 0 for n in nums]

    def method4() -> list[Column]:
        return [
            F.when(zero[i] & (hyp_len != 0), F.try_divide(i + F.try_divide(F.lit(float(k)), F.log(hyp_len)), dens[i])).otherwise(p[i])
            for i in orders
        ]

    def neighbours(q: list[Column]) -> list[Column]:
        following, below, out = [*q[1:], fifth], q[0] + 1, []
        for i in orders:
            below = (below + q[i] + following[i]) / 3
            out.append(below)
        return out

    if method == 0:
        return [F.when(zero[i], TINY).otherwise(p[i]) for i in orders]
    if method == 1:
        return [F.when(zero[i], F.try_divide(nums[i] + epsilon, dens[i])).otherwise(p[i]) for i in orders]
    if method == 2:
        return [(nums[i] + 1) / (dens[i] + 1) for i in orders]
    if method == 3:
        seen, out = F.lit(0), []
        for i in orders:
            seen = seen + zero[i].cast("int")
            out.append(F.when(zero[i], 1 / (F.pow(F.lit(2.0), seen) * dens[i])).otherwise(p[i]))
        return out
    if method == 4:
        return method4()
    if method == 5:
        return neighbours(p)
    if method == 6:
        out = list(p[:2])
        for i in orders[2:]:
            prior = F.when(out[i - 2] == 0, 0.0).otherwise(F.try_divide(out[i - 1] * out[i - 1], out[i - 2]))
            in_hyp = F.greatest(hyp_len - i, F.lit(0))
            value = (nums[i] + alpha * prior) / (in_hyp + alpha)
            out.append(F.when(nums[2] != 0, value))
        return out
    if method == 7:
        return neighbours(method4())
    raise ValueError(f"smoothing method {method} is not one of 0 to 7")


def weighted_mean(p: Sequence[Column], weights: Sequence[Column]) -> Column:
    """``exp`` of the weighted sum of logarithms, added up in order of ``n``."""
    total = F.lit(0.0)
    for precision, weight in zip(p, weights):
        total = total + weight * F.log(precision)
    return F.exp(total)


def bleu(
    nums: Sequence[Column],
    dens: Sequence[Column],
    ref_len: Column,
    hyp_len: Column,
    weights: Sequence[float] = DEFAULT_WEIGHTS,
    method: int = 1,
    auto_reweigh: bool = False,
    fifth: Column | None = None,
    **constants: float,
) -> Column:
    """The score from its terms; 0 when not one unigram matches.

    ``auto_reweigh`` spreads the default weights over the orders a hypothesis of fewer than
    four tokens has.
    """
    w = [F.lit(float(x)) for x in weights]
    if auto_reweigh and tuple(weights) == DEFAULT_WEIGHTS:
        w = [
            F.when(hyp_len >= 4, w[i]).when(i < hyp_len, F.try_divide(F.lit(1.0), hyp_len)).otherwise(0.0)
            for i in range(len(w))
        ]
    p = smooth(nums, dens, method, hyp_len, fifth, **constants)
    return F.when(F.coalesce(nums[0], F.lit(0)) == 0, 0.0).otherwise(brevity_penalty(ref_len, hyp_len) * weighted_mean(p, w))
