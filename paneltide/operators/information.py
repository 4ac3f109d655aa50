"""Mutual information of masks and labels, and Sharpe ratio statistics."""

from __future__ import annotations

from math import e

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from paneltide.functions.dist import norm_cdf, norm_quantile
from paneltide.functions.draws import draw_int
from paneltide.session import cut

EULER_GAMMA = 0.5772156649015329


def mi_from_counts(n11: Column, n1: Column, m1: Column, n: Column) -> Column:
    """Plug-in mutual information (nats) of a 2 x 2 table plus the Miller-Madow term.

    n11 both, n1 first, m1 second, n all.
    """
    cells = [
        (n11, n1, m1),
        (n1 - n11, n1, n - m1),
        (m1 - n11, n - n1, m1),
        (n - n1 - m1 + n11, n - n1, n - m1),
    ]
    total, filled = F.lit(0.0), F.lit(0)
    for both, a, b in cells:
        total = total + F.when(both > 0, both / n * F.log(both * n / (a * b))).otherwise(0.0)
        filled = filled + (both > 0).cast("int")
    return total + F.greatest(filled - 3, F.lit(0)) / (2.0 * n)


def mask_cells(masks: DataFrame, episodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, asset, c): how often a mask cell is visited."""
    return (
        masks.join(episodes.select("seed", "dt", "t"), ["seed", "dt"])
        .groupBy(*keys, "t", "asset")
        .agg(F.count("*").alias("c"))
    )


def visit_counts(masks: DataFrame, episodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, visits): how often a date with a mask is visited."""
    has = masks.select("selector", "seed", "dt").distinct()
    return (
        has.join(episodes.select("seed", "dt", "t"), ["seed", "dt"])
        .groupBy(*keys, "t")
        .agg(F.count("*").alias("visits"))
    )


def mutual_information(
    masks: DataFrame, labels: DataFrame, episodes: DataFrame, keys: list[str] = ("selector",)
) -> DataFrame:
    """(keys, mi, n_pairs): information of "in the mask" about "promising"."""
    keys = list(keys)
    assets = labels.agg(F.count_distinct("asset")).scalar()
    good = labels.where("is_promising").select("t", "asset")
    per_t = good.groupBy("t").agg(F.count("*").alias("_g"))
    cells = mask_cells(masks, episodes, keys)
    visits = visit_counts(masks, episodes, keys)
    inside = cells.join(good.withColumn("_y", F.lit(1)), ["t", "asset"], "left").groupBy(*keys).agg(
        F.sum("c").alias("n1"), F.sum(F.when(F.col("_y") == 1, F.col("c")).otherwise(0)).alias("n11")
    )
    outside = visits.join(per_t, "t", "left").groupBy(*keys).agg(
        F.sum(F.col("visits") * F.coalesce("_g", F.lit(0))).alias("m1"), (F.sum("visits") * assets).alias("n")
    )
    mi = mi_from_counts(F.col("n11"), F.col("n1"), F.col("m1"), F.col("n"))
    return inside.join(outside, keys).select(*keys, mi.alias("mi"), F.col("n").alias("n_pairs"))


def circular_counts(n: int):
    """Sums of c(t) * g(t + off) for off = 0 .. n - 1 around the calendar, from sparse series of whole numbers.

    A product of Fourier transforms, so a pair of series costs n log n and not n^2.
    """

    @F.pandas_udf("array<bigint>")
    def counts(t: pd.Series, c: pd.Series, at: pd.Series, g: pd.Series) -> pd.Series:
        out = []
        for t_, c_, at_, g_ in zip(t, c, at, g):
            left, right = np.zeros(n), np.zeros(n)
            np.add.at(left, np.asarray(t_, int), np.asarray(c_, float))
            np.add.at(right, np.asarray(at_, int), np.asarray(g_, float))
            both = np.fft.irfft(np.conj(np.fft.rfft(left)) * np.fft.rfft(right), n)
            out.append(np.rint(both).astype(np.int64))
        return pd.Series(out)

    return counts


def _series(rows: DataFrame, keys: list[str], t: str, value: str, name: str) -> DataFrame:
    """One row per key: the dates and values of a sparse series, at most one entry per date."""
    held = rows.groupBy(*keys).agg(F.collect_list(F.struct(F.col(t).alias("t"), F.col(value).alias("v"))).alias(name))
    return held.select(*keys, F.col(name)["t"].alias(f"{name}_t"), F.col(name)["v"].alias(f"{name}_v"))


def mi_by_offset(
    masks: DataFrame, labels: DataFrame, episodes: DataFrame, n_dates: int
) -> DataFrame:
    """(selector, off, mi) for labels moved by ``off`` dates around the calendar.

    The cells of a selector and asset are one row, a series over the calendar; the counts
    of all offsets are its circular correlation with the asset's promising dates. So the
    rows shuffled are those of the cells, and of one sum per selector and offset.
    """
    assets = labels.agg(F.count_distinct("asset")).scalar()
    good = labels.where("is_promising").select("t", "asset")
    cells = cut(mask_cells(masks, episodes, ["selector"]))
    correlate = circular_counts(n_dates)

    def by_offset(rows: DataFrame, name: str) -> DataFrame:
        moved = rows.select("selector", F.posexplode(correlate("c_t", "c_v", "g_t", "g_v")).alias("off", "n"))
        return moved.groupBy("selector", "off").agg(F.sum("n").alias(name))

    marked = _series(good.withColumn("one", F.lit(1)), ["asset"], "t", "one", "g")
    n11 = by_offset(_series(cells, ["selector", "asset"], "t", "c", "c").join(marked, "asset"), "n11")
    visits = visit_counts(masks, episodes, ["selector"])
    per_t = good.groupBy("t").agg(F.count("*").alias("g"))
    every = per_t.agg(F.collect_list(F.struct("t", "g"))).scalar()  # one entry per date
    seen = _series(visits, ["selector"], "t", "visits", "c").withColumns({"g_t": every["t"], "g_v": every["g"]})
    size = visits.groupBy("selector").agg((F.sum("visits") * assets).alias("n"))
    m1 = by_offset(seen, "m1").join(size, "selector")
    n1 = cells.groupBy("selector").agg(F.sum("c").alias("n1"))
    both = m1.join(n11, ["selector", "off"], "left").join(n1, "selector")
    mi = mi_from_counts(F.coalesce("n11", F.lit(0)), F.col("n1"), F.col("m1"), F.col("n"))
    return both.select("selector", "off", F.round(mi, 12).alias("mi"))


def mi_permutation(
    by_offset: DataFrame, n_dates: int, horizon: int = 5, n_perm: int = 1000
) -> DataFrame:
    """(selector, mi, null_mean, p): the observed value against random offsets.

    Offsets are drawn from [horizon + 1, dates - horizon - 1).
    """
    observed = by_offset.where(F.col("off") == 0).select("selector", "mi")
    span = n_dates - 2 * horizon - 2
    draws = (
        observed.select("selector")
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
        .withColumn("off", horizon + 1 + draw_int(span, "offset", F.col("i")))
    )
    null = draws.join(by_offset.withColumnRenamed("mi", "_null"), ["selector", "off"]).join(observed, "selector")
    return null.groupBy("selector").agg(
        F.max("mi").alias("mi"),
        F.avg("_null").alias("null_mean"),
        F.avg((F.col("_null") >= F.col("mi")).cast("double")).alias("p"),
        F.count("*").alias("n_perm"),
    )


def series_moments(series: DataFrame, eps: float = 1e-12) -> DataFrame:
    """(name, n, mean, sd, sharpe, skew, kurt): population skew and Pearson kurtosis."""
    return series.groupBy("name").agg(
        F.count("x").alias("n"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("sd"),
        (F.avg("x") / (F.stddev_samp("x") + eps)).alias("sharpe"),
        F.skewness("x").alias("skew"),
        (F.kurtosis("x") + 3.0).alias("kurt"),
    )


def expected_max(sd: Column, k: Column) -> Column:
    """Expected largest Sharpe ratio of k unskilled trials."""
    z1 = norm_quantile(1.0 - 1.0 / k)
    z2 = norm_quantile(1.0 - 1.0 / (k * e))
    return sd * ((1.0 - EULER_GAMMA) * z1 + EULER_GAMMA * z2)


def sampling_variance() -> Column:
    """Variance of a Sharpe estimate from its own moments."""
    sr = F.col("sharpe")
    return (1.0 - F.col("skew") * sr + (F.col("kurt") - 1.0) / 4.0 * sr * sr) / (F.col("n") - 1)


def expected_max_sharpe(moments: DataFrame, k: int, trials: DataFrame | None = None) -> DataFrame:
    """Adds ``sr_star``; the spread is that of the trials' Sharpe ratios when
    given, else the sampling deviation of the series itself."""
    if trials is None:
        sd = F.sqrt(F.greatest(sampling_variance(), F.lit(0.0)))
        return moments.withColumn("k", F.lit(float(k))).withColumn("sr_star", expected_max(sd, F.col("k")))
    spread = trials.agg(F.stddev_samp("sharpe").alias("_sd"), F.count("*").cast("double").alias("k"))
    sd, n = spread.select("_sd").scalar(), spread.select("k").scalar()
    return moments.withColumns({"_sd": sd, "k": n}).withColumn(
        "sr_star", expected_max(F.col("_sd"), F.col("k"))
    ).drop("_sd")


def deflated_sharpe(with_star: DataFrame) -> DataFrame:
    """Adds ``dsr``: the chance that the true ratio exceeds ``sr_star``."""
    sr = F.col("sharpe")
    spread = F.sqrt(
        F.greatest(1.0 - F.col("skew") * sr + (F.col("kurt") - 1.0) / 4.0 * sr * sr, F.lit(1e-12))
    )
    return with_star.withColumn(
        "dsr", norm_cdf((sr - F.col("sr_star")) * F.sqrt(F.col("n") - 1) / spread)
    )


def dsr_k_sensitivity(moments: DataFrame, trials: DataFrame, k_from: int = 2) -> DataFrame:
    """The deflated ratio for each number of trials from ``k_from`` to that of the family.

    The spread is the standard deviation of the family's Sharpe ratios.
    """
    family = trials.agg(F.stddev_samp("sharpe").alias("sd"), F.count("*").alias("k"))
    sd, most = family.select("sd").scalar(), family.select("k").scalar()
    rows = moments.withColumns({"_sd": sd, "_most": most})
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(k_from).cast("bigint"), F.col("_most"))))
    rows = rows.withColumn("k", F.col("_k").cast("double")).drop("_k")
    return deflated_sharpe(rows.withColumn("sr_star", expected_max(F.col("_sd"), F.col("k"))).drop("_sd", "_most"))


def first_k_below(rows: DataFrame, level: float = 0.95) -> DataFrame:
    keys = [c for c in ("name", "spread") if c in rows.columns]
    return rows.groupBy(*keys).agg(F.min(F.when(F.col("dsr") < level, F.col("k"))).alias("first_k"))


def trial_family(ledgers: list[DataFrame]) -> DataFrame:
    """One mean Sharpe per configuration from several ledgers (family, configuration, seed, sharpe)."""
    rows = ledgers[0]
    for other in ledgers[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("family", "configuration").agg(
        F.avg("sharpe").alias("sharpe"), F.count("*").alias("n_seeds")
    )


def family_quartiles(trials: DataFrame) -> DataFrame:
    return trials.groupBy("family").agg(
        F.count("*").alias("n_trials"),
        F.percentile("sharpe", 0.25).alias("q1"),
        F.percentile("sharpe", 0.5).alias("median"),
        F.percentile("sharpe", 0.75).alias("q3"),
    )
