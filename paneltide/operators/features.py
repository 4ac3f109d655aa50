"""Lagged features per asset: the value at ``dt`` uses rows before ``dt`` only."""

from __future__ import annotations

from dataclasses import dataclass
from math import sqrt

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class FeatureParams:
    return_type: str = "log"
    volatility_window: int = 20
    volume_window: int = 20
    annualize: bool = True
    periods_per_year: int = 252
    indicators: tuple[str, ...] = ()


def by_asset():
    return Window.partitionBy("asset").orderBy("dt")


def _last_rows(n: int):
    return by_asset().rowsBetween(-(n - 1), 0)


def feature_names(params: FeatureParams, has_volume: bool = True) -> list[str]:
    base = ["return", "volatility"] + (["volume_rel"] if has_volume else [])
    return base + list(params.indicators)


def raw_return(panel: DataFrame, return_type: str = "log") -> DataFrame:
    """Adds ``_r``, the unlagged return."""
    before = F.lag("close").over(by_asset())
    if return_type == "log":
        r = F.log(F.col("close") / before)
    elif return_type == "simple":
        r = F.col("close") / before - 1
    else:
        raise ValueError(f"unknown return_type {return_type!r}")
    return panel.withColumn("_r", r)


def returns(panel: DataFrame, return_type: str = "log") -> DataFrame:
    out = raw_return(panel, return_type)
    return out.withColumn("return", F.lag("_r").over(by_asset())).drop("_r")


def _full_window(value: Column, source: str, n: int) -> Column:
    """``value`` where the last n rows of ``source`` are all present, else NULL."""
    return F.when(F.count(source).over(_last_rows(n)) == n, value)


def volatility(panel: DataFrame, params: FeatureParams = FeatureParams()) -> DataFrame:
    n = params.volatility_window
    out = raw_return(panel, params.return_type)
    sd = _full_window(F.stddev_samp("_r").over(_last_rows(n)), "_r", n)
    scale = sqrt(params.periods_per_year) if params.annualize else 1.0
    return (
        out.withColumn("_sd", sd * scale)
        .withColumn("volatility", F.lag("_sd").over(by_asset()))
        .drop("_r", "_sd")
    )


def volume_rel(panel: DataFrame, window: int = 20) -> DataFrame:
    mean = _full_window(F.avg("volume").over(_last_rows(window)), "volume", window)
    return (
        panel.withColumn("_v", F.col("volume") / F.nullif(mean, F.lit(0.0)))
        .withColumn("volume_rel", F.lag("_v").over(by_asset()))
        .drop("_v")
    )


def bb_width(panel: DataFrame, window: int = 20, n_std: float = 2.0) -> DataFrame:
    mid = _full_window(F.avg("close").over(_last_rows(window)), "close", window)
    sd = F.stddev_samp("close").over(_last_rows(window))
    return (
        panel.withColumn("_bb", 2.0 * n_std * sd / F.nullif(mid, F.lit(0.0)))
        .withColumn("bb_width", F.lag("_bb").over(by_asset()))
        .drop("_bb")
    )


def _smooth(state: Column, x: Column, alpha: float) -> Column:
    """One exponential smoothing step; the first value starts the average."""
    return F.when(state.isNull(), x).otherwise((1.0 - alpha) * state + alpha * x)


def _fold(panel: DataFrame, start: Column, step, emit: str) -> DataFrame:
    """Run a recursion over each asset's closes in date order.

    The array holds one asset's calendar, whose length is the number of dates
    and does not depend on the number of trades. Adds the lagged ``emit``.
    """
    series = panel.groupBy("asset").agg(
        F.array_sort(F.collect_list(F.struct("dt", "close"))).alias("_s")
    )
    folded = series.withColumn(
        "_o", F.aggregate("_s", start, step, lambda acc: acc["out"])
    ).select("asset", F.explode(F.arrays_zip("_s", "_o")).alias("_z"))
    values = folded.select(
        "asset", F.col("_z._s.dt").alias("dt"), F.col("_z._o").alias("_value")
    )
    return (
        panel.join(values, ["asset", "dt"])
        .withColumn(emit, F.lag("_value").over(by_asset()))
        .drop("_value")
    )


def no_double() -> Column:
    return F.lit(None).cast("double")


def no_array() -> Column:
    return F.array().cast("array<double>")


def rsi(panel: DataFrame, window: int = 14) -> DataFrame:
    """Wilder's index; NULL before ``window`` changes and where the mean loss is 0."""
    alpha = 1.0 / window
    start = F.struct(
        no_double().alias("prev"),
        no_double().alias("up"),
        no_double().alias("down"),
        F.lit(0).alias("n"),
        no_array().alias("out"),
    )

    def step(acc, row):
        change = row["close"] - acc["prev"]
        up = F.when(change.isNull(), acc["up"]).otherwise(
            _smooth(acc["up"], F.greatest(change, F.lit(0.0)), alpha)
        )
        down = F.when(change.isNull(), acc["down"]).otherwise(
            _smooth(acc["down"], F.greatest(-change, F.lit(0.0)), alpha)
        )
        n = acc["n"] + F.when(change.isNull(), 0).otherwise(1)
        value = F.when((n >= window) & (down != 0.0), 100.0 - 100.0 / (1.0 + up / down))
        return F.struct(
            F.coalesce(row["close"], acc["prev"]).alias("prev"),
            up.alias("up"),
            down.alias("down"),
            n.alias("n"),
            F.concat(acc["out"], F.array(value)).alias("out"),
        )

    return _fold(panel, start, step, "rsi")


def macd(panel: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """(fast average - slow average - its signal line) / close."""
    a_fast, a_slow, a_signal = (2.0 / (s + 1.0) for s in (fast, slow, signal))
    start = F.struct(
        no_double().alias("fast"),
        no_double().alias("slow"),
        no_double().alias("signal"),
        no_array().alias("out"),
    )

    def step(acc, row):
        f = _smooth(acc["fast"], row["close"], a_fast)
        s = _smooth(acc["slow"], row["close"], a_slow)
        g = _smooth(acc["signal"], f - s, a_signal)
        value = (f - s - g) / F.nullif(row["close"], F.lit(0.0))
        return F.struct(
            f.alias("fast"),
            s.alias("slow"),
            g.alias("signal"),
            F.concat(acc["out"], F.array(value)).alias("out"),
        )

    return _fold(panel, start, step, "macd")


def feature_panel(
    panel: DataFrame, params: FeatureParams = FeatureParams(), drop_incomplete: bool = True
) -> DataFrame:
    """All requested features; a date is kept only if complete for every asset."""
    builders = {
        "return": lambda d: returns(d, params.return_type),
        "volatility": lambda d: volatility(d, params),
        "volume_rel": lambda d: volume_rel(d, params.volume_window),
        "rsi": rsi,
        "macd": macd,
        "bb_width": bb_width,
    }
    names = feature_names(params, "volume" in panel.columns)
    unknown = [n for n in names if n not in builders]
    if unknown:
        raise ValueError(f"unknown features {unknown}")
    out = panel
    for name in names:
        out = builders[name](out)
    return complete_dates(out, names) if drop_incomplete else out


def complete_dates(panel: DataFrame, names: list[str]) -> DataFrame:
    """Warm-up drop over the whole panel: keep dates without any missing feature.

    The panel is aligned, so the rows of a date are all assets.
    """
    whole = F.lit(True)
    for n in names:
        whole = whole & F.col(n).isNotNull() & ~F.isnan(F.col(n))
    all_whole = F.bool_and(whole).over(Window.partitionBy("dt"))
    return panel.withColumn("_ok", all_whole).where("_ok").drop("_ok")


def leak_audit(full: DataFrame, truncated: DataFrame, names: list[str]) -> DataFrame:
    """Largest difference per feature between two runs on their common dates.

    ``truncated`` is computed from data that ends earlier; any difference
    means that a feature looked ahead.
    """
    right = truncated.select("asset", "dt", *[F.col(n).alias(f"_{n}") for n in names])
    both = full.join(right, ["asset", "dt"])
    pairs = ", ".join(f"'{n}', abs(`{n}` - `_{n}`)" for n in names)
    return (
        both.select(F.expr(f"stack({len(names)}, {pairs}) as (feature, diff)"))
        .groupBy("feature")
        .agg(F.count("diff").alias("n_common"), F.max("diff").alias("max_abs_diff"))
        .withColumn("clean", F.col("max_abs_diff") < 1e-9)
    )


def state_windows(features: DataFrame, names: list[str], length: int) -> DataFrame:
    """The last ``length`` dates of all features as one vector per date.

    Per date the assets are laid out in name order, then features in the given
    order. A date on which any asset of the panel has fewer than ``length`` rows
    of history has a NULL state, so all states have one width. First each
    asset's own window is packed, then the assets of a date.
    """
    frame = by_asset().rowsBetween(-(length - 1), 0)
    assets = features.agg(F.countDistinct("asset")).scalar()
    packed = features.withColumn("_w", F.collect_list(F.array(*[F.col(n).cast("float") for n in names])).over(frame))
    rows = packed.groupBy("dt").agg(
        F.array_sort(F.collect_list(F.struct("asset", "_w"))).alias("_a"),
        F.count_if(F.size("_w") == length).alias("_full"),
    )
    state = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(length - 1)),
            lambda i: F.flatten(F.transform("_a", lambda a: F.get(a["_w"], i))),
        )
    )
    return rows.select("dt", F.when(F.col("_full") == assets, state).alias("state"))


def relational_state(states: DataFrame, relational: DataFrame, names: list[str], grid: DataFrame) -> DataFrame:
    """Append per-asset graph features to each state, in asset order.

    ``grid`` has the (dt, asset) pairs of the panel. An asset without graph
    features on a date, or a date without any, gets zeros, so the width never
    changes.
    """
    filled = grid.select("dt", "asset").join(relational.select("dt", "asset", *names), ["dt", "asset"], "left")
    values = F.array(*[F.coalesce(F.col(n), F.lit(0.0)).cast("float") for n in names])
    extra = filled.groupBy("dt").agg(F.array_sort(F.collect_list(F.struct("asset", values.alias("v")))).alias("_a"))
    flat = extra.select("dt", F.flatten(F.transform("_a", lambda a: a["v"])).alias("_x"))
    return states.join(flat, "dt", "left").select("dt", F.concat("state", "_x").alias("state"))
