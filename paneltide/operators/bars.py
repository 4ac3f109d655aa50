"""OHLCV bars from trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

INTERVALS = {"1d": "day", "1wk": "week", "1mo": "month"}
STEP = {"1d": "interval 1 day", "1wk": "interval 7 days", "1mo": "interval 1 month"}


def build_bars(
    trades: DataFrame,
    interval: str = "1wk",
    tie: tuple[str, ...] = (),
    keys: tuple[str, ...] = ("asset", "sector"),
) -> DataFrame:
    """Open, high, low, close and volume per (keys, interval).

    The keys may be compact codes; names are then joined to the few bars.

    First and last are taken over the total order (ts, tie keys, price, qty).
    Everything is a partial aggregate, so an asset with a third of all trades
    is reduced where it is read.
    """
    if interval not in INTERVALS:
        raise ValueError(f"interval must be one of {sorted(INTERVALS)}, got {interval!r}")
    order = F.struct("ts", *tie, "price", "qty")
    return (
        trades.withColumn("dt", F.date_trunc(INTERVALS[interval], "ts").cast("date"))
        .groupBy(*keys, "dt")
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.sum("qty").alias("volume"),
        )
    )


def reindex_calendar(bars: DataFrame, interval: str = "1wk") -> DataFrame:
    """One row per asset and calendar date, NULL where the asset has no bar."""
    span = bars.agg(F.min("dt").alias("lo"), F.max("dt").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    grid = (
        bars.select("asset", "sector")
        .distinct()
        .withColumn("dt", F.explode(F.sequence(lo, hi, F.expr(STEP[interval]))))
    )
    return grid.join(bars, ["asset", "sector", "dt"], "left")
