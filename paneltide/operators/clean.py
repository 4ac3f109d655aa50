"""Cleaning and alignment of the long panel (asset, dt, ...)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

FIELDS = ("open", "high", "low", "close", "volume")


@dataclass(frozen=True)
class CleanParams:
    max_nan_ratio: float = 0.05
    ffill_limit: int = 0
    align: bool = True
    gapless: bool = False


def nan_ratio_filter(panel: DataFrame, max_nan_ratio: float = 0.05) -> DataFrame:
    """Keep assets whose share of missing ``close`` is at most the limit.

    The share is a window over the asset, the partitioning that the fill and
    the features need anyway; an asset's rows are bounded by the calendar.
    """
    missing = F.col("close").isNull() | F.isnan("close")
    share = F.avg(missing.cast("double")).over(Window.partitionBy("asset"))
    return panel.withColumn("_share", share).where(F.col("_share") <= max_nan_ratio).drop("_share")


def ffill_limited(panel: DataFrame, limit: int, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Carry the last value over at most ``limit`` missing rows, per asset."""
    if limit <= 0:
        return panel
    back = Window.partitionBy("asset").orderBy("dt").rowsBetween(-limit, 0)
    filled = {f: F.last(f, ignorenulls=True).over(back) for f in fields if f in panel.columns}
    return panel.withColumns(filled)


def align_calendar(panel: DataFrame, gapless: bool = False) -> DataFrame:
    """Keep the dates on which every asset has a ``close``.

    When the panel is ``gapless`` (a row per asset and date, possibly NULL)
    the rows of a date are the assets and no count over the panel is needed.
    """
    same_date = Window.partitionBy("dt")
    have = F.count("close").over(same_date)
    if gapless:
        assets = F.count("*").over(same_date)
    else:
        assets = panel.agg(F.count_distinct("asset").alias("n")).scalar()
    return panel.withColumn("_ok", have == assets).where("_ok").drop("_ok")


def clean_panel(panel: DataFrame, params: CleanParams = CleanParams()) -> DataFrame:
    """Drop sparse assets, fill short gaps, keep complete dates."""
    out = nan_ratio_filter(panel, params.max_nan_ratio)
    out = ffill_limited(out, params.ffill_limit)
    return align_calendar(out, params.gapless) if params.align else out


def with_position(panel: DataFrame) -> DataFrame:
    """Add ``t``, the 0-based calendar position, to an aligned panel.

    In an aligned panel every asset has every date, so the row number per
    asset is the calendar position and no global window is needed.
    """
    by_asset = Window.partitionBy("asset").orderBy("dt")
    return panel.withColumn("t", F.row_number().over(by_asset) - 1)


def ticker_list(panel: DataFrame) -> DataFrame:
    return panel.select("asset").distinct()


def close_matrix(panel: DataFrame, assets: list[str] | None = None) -> DataFrame:
    """Dates by assets, one column for each asset of the panel unless the caller names them."""
    if assets is None:
        assets = [r[0] for r in panel.select("asset").distinct().orderBy("asset").collect()]
    return panel.groupBy("dt").pivot("asset", assets).agg(F.first("close"))


def date_range_filter(panel: DataFrame, start: str, end: str, least: int = 2) -> DataFrame:
    """Rows with start <= dt <= end, inclusive; an error if they have under ``least`` dates."""
    rows = panel.where(F.col("dt").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    dates = rows.agg(F.countDistinct("dt")).scalar()
    found = F.when(dates >= least, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"fewer than {least} dates from {start} to {end}")).cast("boolean")
    )
    # one checked row, so that an empty range fails too
    checked = panel.sparkSession.range(1).select(found.alias("_ok"))
    return rows.join(checked, F.col("_ok")).drop("_ok")


def balanced_check(features_long: DataFrame) -> DataFrame:
    """One row: number of assets, and whether all have the same number of features."""
    per = features_long.groupBy("asset").agg(F.count_distinct("feature").alias("n"))
    return per.agg(
        F.count("*").alias("n_assets"),
        F.min("n").alias("n_features_min"),
        F.max("n").alias("n_features_max"),
        (F.min("n") == F.max("n")).alias("balanced"),
    )
