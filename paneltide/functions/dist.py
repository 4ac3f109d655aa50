"""Distribution functions that Spark lacks.

The normal and Student distributions are column expressions of a fixed number of terms:
series with positive terms only for the distribution functions, Newton steps for their
quantiles. The exact signed-rank distribution is computed in workers, once per pattern of ties.
"""

from __future__ import annotations

from functools import lru_cache
from math import pi
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

from paneltide.functions.columns import let

_NORMAL = NormalDist()
EXACT_RANKS = 3000
DIRECT_RANKS = 64  # ranks whose distribution is added up directly, before it is multiplied with others


def _number(x) -> Column:
    return (x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)).cast("double")


def norm_cdf(x) -> Column:
    """Normal distribution function; null for null and NaN."""

    def at(v: Column) -> Column:
        q = F.least(F.abs(v), F.lit(9.0))  # beyond, it is 0 or 1 in double precision
        step = lambda a, k: let(a["term"] * q * q / (2 * k + 1), lambda t: F.struct(t.alias("term"), (a["sum"] + t).alias("sum")))
        series = F.reduce(F.sequence(F.lit(1), F.lit(160)), F.struct(q.alias("term"), q.alias("sum")), step, lambda a: a["sum"])
        half = series * F.exp(-q * q / 2) / F.lit((2 * pi) ** 0.5)
        return F.when(~F.isnan(v), 0.5 + F.signum(v) * half)

    return let(_number(x), at)


def norm_quantile(p) -> Column:
    """Normal quantile for 0 < p < 1, else null: a rational start and Newton steps."""

    def at(v: Column) -> Column:
        tail = F.least(v, 1.0 - v)
        t = F.sqrt(-2.0 * F.log(tail))
        low = -(t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1.0 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t))
        newton = lambda x, _: x - (norm_cdf(x) - tail) / (F.exp(-x * x / 2) / F.lit((2 * pi) ** 0.5))
        root = F.reduce(F.sequence(F.lit(1), F.lit(5)), low, newton)
        return F.when((v > 0) & (v < 1), F.signum(0.5 - v) * root)

    return let(_number(p), at)


def _terms(n: Column) -> Column:
    """1 .. n, empty for n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _student_cdf(x: Column, n: Column) -> Column:
    """Finite trigonometric series for n whole degrees of freedom."""
    odd = n % 2 == 1
    cos2 = n / (n + x * x)
    more = F.when(odd, (n - 1) / 2).otherwise(n / 2).cast("int")

    def step(a: Column, j: Column) -> Column:
        ratio = F.when(odd, 2.0 * j / (2 * j + 1)).otherwise((2.0 * j - 1) / (2 * j))
        return let(a["term"] * ratio * cos2, lambda t: F.struct(t.alias("term"), (a["sum"] + t).alias("sum")))

    one = F.lit(1.0)
    series = F.reduce(_terms(more - 1), F.struct(one.alias("term"), one.alias("sum")), step, lambda a: a["sum"])
    series = F.when(more >= 1, series).otherwise(0.0)
    angle = F.atan(F.abs(x) / F.sqrt(n))
    sine, cosine = F.sin(angle), F.cos(angle)
    between = F.when(odd, (angle + sine * cosine * series) * F.lit(2 / pi)).otherwise(sine * series)
    return 0.5 * (1.0 + F.signum(x) * between)


def _pair(x, df, use) -> Column:
    both = F.struct(_number(x).alias("x"), _number(df).alias("n"))
    known = lambda v: v["x"].isNotNull() & ~F.isnan(v["x"]) & (v["n"] >= 1) & (v["n"] == F.floor(v["n"]))
    return let(both, lambda v: F.when(known(v), use(v["x"], v["n"])))


def t_cdf(t, df) -> Column:
    """Student distribution function for whole degrees of freedom; null for others and for null."""
    return _pair(t, df, _student_cdf)


def t_quantile(p, df) -> Column:
    """Student quantile for 0 < p < 1 and whole degrees of freedom.

    Newton steps from the normal quantile: in a tail the distribution function is concave,
    so they come nearer from one side only.
    """

    def at(v: Column, n: Column) -> Column:
        high = F.greatest(v, 1.0 - v)
        odd = n % 2 == 1
        # gamma((n + 1) / 2) / gamma(n / 2), in steps of two
        first = F.when(odd, F.lit(pi**-0.5)).otherwise(F.lit(pi**0.5 / 2))
        grow = lambda g, j: let(2.0 * j - F.when(odd, 1).otherwise(0), lambda k: g * (k + 1) / k)
        ratio = F.reduce(_terms(F.floor((n - 1) / 2).cast("int")), first, grow)
        scale = ratio / F.sqrt(n * F.lit(pi))

        def solve(s: Column) -> Column:
            newton = lambda x, _: x + (high - _student_cdf(x, n)) / (s * F.pow(1.0 + x * x / n, -(n + 1) / 2))
            return F.reduce(F.sequence(F.lit(1), F.lit(40)), norm_quantile(high), newton)

        root = let(scale, solve)
        return F.when((v > 0) & (v < 1), F.signum(v - 0.5) * root)

    return _pair(p, df, at)


def _shifted(p: np.ndarray, rank: int) -> np.ndarray:
    """One more rank, positive or negative with chance 1/2 each."""
    out = np.zeros(len(p) + rank)
    out[: len(p)] += p / 2
    out[rank:] += p / 2
    return out


def _product(parts: list[np.ndarray]) -> np.ndarray:
    """Product of polynomials, by fast Fourier transforms of pairs of like degree."""
    while len(parts) > 1:
        parts.sort(key=len)
        out = []
        for a, b in zip(parts[::2], parts[1::2]):
            n = len(a) + len(b) - 1
            size = 1 << (n - 1).bit_length()
            out.append(np.maximum(np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)[:n], 0.0))
        parts = out + (parts[-1:] if len(parts) % 2 else [])
    return parts[0]


@lru_cache(maxsize=256)
def signed_rank_law(n: int, tied: tuple[tuple[int, int], ...] = ()) -> tuple[np.ndarray, int]:
    """Chances of every value of the positive ranks' sum, and the unit its index counts in (1, or 2 for halves).

    ``tied`` has (twice the mean rank, size) of each group of equal differences; all other ranks are whole.
    """
    covered, ranks = set(), []
    for twice, size in tied:
        first = (twice - size + 1) // 2
        covered.update(range(first, first + size))
        ranks += [twice] * size
    ranks += [2 * r for r in range(1, n + 1) if r not in covered]
    unit = 2 if any(r % 2 for r in ranks) else 1
    ranks = sorted(r if unit == 2 else r // 2 for r in ranks)
    parts = []
    for at in range(0, len(ranks), DIRECT_RANKS):
        p = np.ones(1)
        for r in ranks[at : at + DIRECT_RANKS]:
            p = _shifted(p, r)
        parts.append(p)
    return _product(parts or [np.ones(1)]), unit


def signed_rank_tail(w: float, n: int, tied: tuple[tuple[int, int], ...] = ()) -> tuple[float, float]:
    """Exact P(W <= w) and P(W >= w)."""
    p, unit = signed_rank_law(n, tied)
    at = int(round(w * unit))
    return min(1.0, float(p[: at + 1].sum())), min(1.0, float(p[at:].sum()))


def signed_rank_p(w: float, n: float, tied: tuple[tuple[int, int], ...], side: float) -> float:
    """p of the signed-rank statistic; side 0 two-sided, 1 greater, -1 less.

    Exact with and without ties up to ``EXACT_RANKS`` differences; the normal form with tie
    correction beyond, where both agree to about 1 / n.
    """
    n = int(n)
    if n == 0:
        return float("nan")
    if n <= EXACT_RANKS:
        low, high = signed_rank_tail(w, n, tied)
    else:
        sd = np.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - sum(t**3 - t for _, t in tied) / 48.0)
        z = (w - n * (n + 1) / 4.0) / sd
        low, high = _NORMAL.cdf(z), _NORMAL.cdf(-z)
    if side > 0:
        return high
    if side < 0:
        return low
    return min(1.0, 2.0 * min(low, high))


@F.pandas_udf(DoubleType())
def wilcoxon_p(w: pd.Series, n: pd.Series, twice: pd.Series, size: pd.Series, side: pd.Series) -> pd.Series:
    """``twice`` and ``size``: twice the mean rank and the size of each group of ties, as arrays."""
    out = [
        None if w_ is None or w_ != w_ else signed_rank_p(w_, n_, tuple(zip(map(int, t), map(int, s))), side_)
        for w_, n_, t, s, side_ in zip(w, n, twice, size, side)
    ]
    return pd.Series(out, dtype="float64")
