"""Queries on the panel: sources, cleaning, features, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from paneltide.functions.columns import finite, tidy
from paneltide.functions.draws import draw, draw_int, draw_sql
from paneltide.operators import bars as B
from paneltide.operators import clean as C
from paneltide.operators import features as FE
from paneltide.operators import splits as SP
from paneltide.plans import stages as st
from paneltide.plans.registry import query
from paneltide.plans.sqltext import compose, part, ffill_sql
from paneltide.session import cut
from paneltide.sources import tables as T

BAR_COLS = ("open", "high", "low", "close", "volume")
BAR_SQL = ", ".join(f"round({c}, 8) + 0.0 AS {c}" for c in BAR_COLS)


def _bars_out(df: DataFrame) -> DataFrame:
    return df.select("asset", "sector", "dt", *[tidy(c, 8).alias(c) for c in BAR_COLS])


@query("build_bars", "bars", f"SELECT asset, sector, dt, {BAR_SQL} FROM bars")
def build_bars(spark: SparkSession, folder: str) -> DataFrame:
    return _bars_out(st.weekly_bars(spark, folder))


@query("build_bars_daily", "bars_daily", f"SELECT asset, sector, dt, {BAR_SQL} FROM bars_daily")
def build_bars_daily(spark: SparkSession, folder: str) -> DataFrame:
    return _bars_out(st.bars(spark, folder, "1d"))


@query("build_bars_monthly", "bars_monthly", f"SELECT asset, sector, dt, {BAR_SQL} FROM bars_monthly")
def build_bars_monthly(spark: SparkSession, folder: str) -> DataFrame:
    return _bars_out(st.bars(spark, folder, "1mo"))


def _daily_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars on the full calendar: the panel with real gaps."""
    bars = st.bars(spark, folder, "1d")
    return B.reindex_calendar(cut(bars), "1d")


# the share of empty days differs by asset; half of the assets are below the median share
part("gap_share", "gapless_daily", """
SELECT asset, avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0.0 END) AS share FROM gapless_daily GROUP BY asset""")


@query("nan_ratio_filter", "gapless_daily gap_share", """
SELECT asset, count(*) AS n_rows, count(close) AS n_close FROM gapless_daily
WHERE asset IN (SELECT asset FROM gap_share WHERE share <= 0.37) GROUP BY asset""")
def nan_ratio_filter(spark: SparkSession, folder: str) -> DataFrame:
    kept = C.nan_ratio_filter(_daily_gaps(spark, folder), 0.37)
    return kept.groupBy("asset").agg(F.count("*").alias("n_rows"), F.count("close").alias("n_close"))


part("filled_daily", "gapless_daily", ffill_sql("gapless_daily", 2))


@query("ffill_limited", "filled_daily", f"SELECT asset, sector, dt, {BAR_SQL} FROM filled_daily")
def ffill_limited(spark: SparkSession, folder: str) -> DataFrame:
    return _bars_out(C.ffill_limited(_daily_gaps(spark, folder), 2))


@query("align_calendar", "gapless", f"""
SELECT asset, sector, dt, {BAR_SQL} FROM gapless WHERE dt IN (
  SELECT dt FROM gapless GROUP BY dt HAVING count(close) = (SELECT count(DISTINCT asset) FROM gapless))""")
def align_calendar(spark: SparkSession, folder: str) -> DataFrame:
    return _bars_out(C.align_calendar(st.gapless(spark, folder)))


@query("clean_panel", "panel", f"SELECT asset, sector, dt, {BAR_SQL} FROM panel")
def clean_panel(spark: SparkSession, folder: str) -> DataFrame:
    return _bars_out(st.panel(spark, folder))


ASSETS = sorted(f"NATION_{k}" for k in range(25))  # the names in nation, for the columns of the SQL


@query("close_matrix", "panel", "SELECT dt, " + ", ".join(f"round(max(CASE WHEN asset = '{a}' THEN close END), 8) + 0.0 AS {a}" for a in ASSETS) + " FROM panel GROUP BY dt")
def close_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """A column for each asset of ``nation``; those that cleaning drops are empty."""
    names = [r[0] for r in T.table(spark, folder, "nation").select("n_name").distinct().orderBy("n_name").collect()]
    wide = C.close_matrix(st.panel(spark, folder), names)
    return wide.select("dt", *[tidy(n, 8).alias(n) for n in names])


@query("ticker_list", "panel", "SELECT DISTINCT asset FROM panel")
def ticker_list(spark: SparkSession, folder: str) -> DataFrame:
    return C.ticker_list(st.panel(spark, folder))


@query("date_range_filter", "trades", """
SELECT asset, count(*) AS n, round(sum(qty), 6) + 0.0 AS volume FROM trades
WHERE ts >= DATE '1996-01-01' AND ts < DATE '1997-01-01' GROUP BY asset""")
def date_range_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = T.trades(spark, folder).where(
        (F.col("ts") >= F.lit("1996-01-01").cast("date")) & (F.col("ts") < F.lit("1997-01-01").cast("date"))
    )
    per = rows.groupBy("place").agg(F.count("*").alias("n"), F.sum("qty").alias("volume"))
    return T.named(per, spark, folder).select("asset", "n", tidy("volume").alias("volume"))


@query("date_range_panel", "panel", f"""
SELECT asset, sector, dt, {BAR_SQL} FROM panel WHERE dt BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'""")
def date_range_panel(spark: SparkSession, folder: str) -> DataFrame:
    return _bars_out(C.date_range_filter(st.panel(spark, folder), "1996-01-01", "1997-12-31"))


@query("finite_filter", "raw_features", """
SELECT asset, count(*) AS n, round(avg(r), 6) + 0.0 AS mean FROM raw_features WHERE r IS NOT NULL GROUP BY asset""")
def finite_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = FE.raw_return(st.panel(spark, folder))
    return rows.where(finite("_r")).groupBy("asset").agg(
        F.count("*").alias("n"), tidy(F.avg("_r")).alias("mean")
    )


@query("balanced_check", "feat", """
SELECT count(*) AS n_assets, min(n) AS n_features_min, max(n) AS n_features_max, min(n) = max(n) AS balanced FROM (
  SELECT asset, (max(CASE WHEN "return" IS NOT NULL THEN 1 ELSE 0 END) + max(CASE WHEN volatility IS NOT NULL THEN 1 ELSE 0 END)
    + max(CASE WHEN volume_rel IS NOT NULL THEN 1 ELSE 0 END)) AS n FROM feat GROUP BY asset)""")
def balanced_check(spark: SparkSession, folder: str) -> DataFrame:
    rows = FE.feature_panel(st.panel(spark, folder))
    long = rows.unpivot(["asset", "dt"], ["return", "volatility", "volume_rel"], "feature", "value")
    return C.balanced_check(long.where(F.col("value").isNotNull()))


def _feature(name: str, column: str, build):
    sql = f'SELECT asset, dt, round({column}, 6) + 0.0 AS value FROM lagged'

    @query(name, "lagged", sql)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df, col = build(st.panel(spark, folder))
        return df.select("asset", "dt", tidy(col).alias("value"))

    return run


_feature("returns", '"return"', lambda p: (FE.returns(p), "return"))
_feature("returns_simple", "return_simple", lambda p: (FE.returns(p, "simple"), "return"))
_feature("volatility", "volatility", lambda p: (FE.volatility(p), "volatility"))
_feature("volume_rel", "volume_rel", lambda p: (FE.volume_rel(p), "volume_rel"))
_feature("bb_width", "bb_width", lambda p: (FE.bb_width(p), "bb_width"))

part("numbered", "panel", "SELECT asset, dt, close, row_number() OVER (PARTITION BY asset ORDER BY dt) AS i FROM panel")
part("ema", "numbered", f"""/*REC*/
SELECT asset, i, dt, close, CAST(NULL AS DOUBLE) AS up, CAST(NULL AS DOUBLE) AS down,
       close AS fast, close AS slow, CAST(0 AS DOUBLE) AS sig FROM numbered WHERE i = 1
UNION ALL
SELECT asset, i, dt, close, up, down, fast, slow, 0.8 * sig + 0.2 * (fast - slow) FROM (
  SELECT n.asset, n.i, n.dt, n.close,
    CASE WHEN e.up IS NULL THEN greatest(n.close - e.close, 0) ELSE (1 - 1.0 / 14) * e.up + (1.0 / 14) * greatest(n.close - e.close, 0) END AS up,
    CASE WHEN e.down IS NULL THEN greatest(e.close - n.close, 0) ELSE (1 - 1.0 / 14) * e.down + (1.0 / 14) * greatest(e.close - n.close, 0) END AS down,
    (1 - 2.0 / 13) * e.fast + (2.0 / 13) * n.close AS fast, (1 - 2.0 / 27) * e.slow + (2.0 / 27) * n.close AS slow, e.sig
  FROM ema e JOIN numbered n ON n.asset = e.asset AND n.i = e.i + 1)""")
part("ema_out", "ema", """
SELECT asset, dt, lag(CASE WHEN i >= 15 AND down <> 0 THEN 100.0 - 100.0 / (1 + up / down) END) OVER (PARTITION BY asset ORDER BY i) AS rsi,
       lag((fast - slow - sig) / nullif(close, 0)) OVER (PARTITION BY asset ORDER BY i) AS macd FROM ema""")


@query("rsi", "ema_out", "SELECT asset, dt, round(rsi, 6) + 0.0 AS value FROM ema_out")
def rsi(spark: SparkSession, folder: str) -> DataFrame:
    return FE.rsi(cut(st.panel(spark, folder))).select("asset", "dt", tidy("rsi").alias("value"))


@query("macd", "ema_out", "SELECT asset, dt, round(macd, 6) + 0.0 AS value FROM ema_out")
def macd(spark: SparkSession, folder: str) -> DataFrame:
    return FE.macd(cut(st.panel(spark, folder))).select("asset", "dt", tidy("macd").alias("value"))


ALL_FEATURES = FE.FeatureParams(indicators=("rsi", "macd", "bb_width"))
NAMES = FE.feature_names(ALL_FEATURES)
FEATURE_SQL = ", ".join(f'round("{n}", 6) + 0.0 AS "{n}"' for n in NAMES)
part("all_features", "lagged ema_out", """
SELECT l.*, e.rsi, e.macd FROM lagged l JOIN ema_out e ON e.asset = l.asset AND e.dt = l.dt""")
_complete = " AND ".join(f'"{n}" IS NOT NULL' for n in NAMES)


@query("feature_panel", "all_features", f"""
SELECT asset, dt, {FEATURE_SQL} FROM all_features WHERE dt IN (
  SELECT dt FROM all_features GROUP BY dt HAVING sum(CASE WHEN {_complete} THEN 1 ELSE 0 END) = (SELECT count(DISTINCT asset) FROM all_features))""")
def feature_panel(spark: SparkSession, folder: str) -> DataFrame:
    rows = FE.feature_panel(cut(st.panel(spark, folder)), ALL_FEATURES)
    return rows.select("asset", "dt", *[tidy(n).alias(n) for n in NAMES])


LEAK_END = "1998-06-30"


@query("leak_audit", "lagged", f"""
SELECT v.feature, (SELECT count(v2) FROM (SELECT CASE v.feature WHEN 'return' THEN "return" WHEN 'volatility' THEN volatility ELSE volume_rel END AS v2
        FROM lagged WHERE dt <= DATE '{LEAK_END}')) AS n_common, CAST(0 AS DOUBLE) AS max_abs_diff, true AS clean
FROM (VALUES ('return'), ('volatility'), ('volume_rel')) v(feature)""")
def leak_audit(spark: SparkSession, folder: str) -> DataFrame:
    p = cut(st.panel(spark, folder))
    names = ["return", "volatility", "volume_rel"]
    full = FE.feature_panel(p, drop_incomplete=False)
    short = FE.feature_panel(p.where(F.col("dt") <= F.to_date(F.lit(LEAK_END))), drop_incomplete=False)
    audit = FE.leak_audit(full, short, names)
    return audit.select("feature", "n_common", tidy("max_abs_diff").alias("max_abs_diff"), "clean")


def state_summary(df: DataFrame) -> DataFrame:
    """Width, sum, and a sum weighted by position, which fixes the layout."""
    total = F.aggregate("state", F.lit(0.0), lambda s, x: s + x.cast("double"))
    placed = F.transform("state", lambda x, i: x.cast("double") * (i % 97 + 1))
    weighted = F.aggregate(placed, F.lit(0.0), lambda s, x: s + x)
    width = F.when(F.col("state").isNotNull(), F.size("state"))
    return df.select("dt", width.alias("width"), tidy(total, 3).alias("total"), tidy(weighted, 2).alias("weighted"))


part("place", "feat", "SELECT asset, row_number() OVER (ORDER BY asset) - 1 AS k, count(*) OVER () AS n_assets FROM (SELECT DISTINCT asset FROM feat)")
part("window_cell", "feat cal place", """
SELECT d.dt, d.t, ((f.t - d.t + 29) * p.n_assets + p.k) * 3 + j.j AS i, p.n_assets,
       CAST(CASE j.j WHEN 0 THEN f."return" WHEN 1 THEN f.volatility ELSE f.volume_rel END AS FLOAT)::DOUBLE AS x
FROM cal d JOIN feat f ON f.t BETWEEN d.t - 29 AND d.t JOIN place p ON p.asset = f.asset, (VALUES (0), (1), (2)) j(j)""")
part("in_window", "cal window_cell", """
SELECT d.dt, d.t, w.width, w.total, w.weighted FROM cal d LEFT JOIN (
  SELECT dt, count(*) AS width, sum(x) AS total, sum(x * (i % 97 + 1)) AS weighted FROM window_cell
  GROUP BY dt HAVING count(*) = 90 * max(n_assets)) w ON w.dt = d.dt""")


@query("state_windows", "cal in_window", "SELECT dt, CAST(width AS INTEGER) AS width, round(total, 3) + 0.0 AS total, round(weighted, 2) + 0.0 AS weighted FROM in_window")
def state_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = st.feature_rows(spark, folder)
    return state_summary(FE.state_windows(rows, ["return", "volatility", "volume_rel"], st.LOOKBACK))


# splits -------------------------------------------------------------------


@query("chronological_split", "split3", "SELECT dt, t, part FROM split3")
def chronological_split(spark: SparkSession, folder: str) -> DataFrame:
    return SP.chronological_split(SP.calendar(st.feature_rows(spark, folder)))


HOLDOUT_END = "1999-12-31"


@query("holdout_split", "cal", f"""
SELECT dt, t, CASE WHEN dt <= DATE '{HOLDOUT_END}' THEN 'tuning' ELSE 'holdout' END AS block FROM cal""")
def holdout_split(spark: SparkSession, folder: str) -> DataFrame:
    return SP.holdout_split(SP.calendar(st.feature_rows(spark, folder)), HOLDOUT_END)


FIRST_YEAR, TEST_YEARS = 1996, [1998, 1999, 2000, 2001]


@query("walk_forward_folds", "cal", f"""
SELECT test_year, dt, t, round(frac, 6) + 0.0 AS train_frac,
       CASE WHEN pos < floor(n * frac) THEN 'train' WHEN pos < floor(n * frac) + floor(n * 0.01) THEN 'val' ELSE 'test' END AS part
FROM (SELECT y AS test_year, dt, t, t - min(t) OVER (PARTITION BY y) AS pos, count(*) OVER (PARTITION BY y) AS n,
             (y - {FIRST_YEAR}) / CAST(y - {FIRST_YEAR} + 1 AS DOUBLE) AS frac
      FROM cal JOIN (SELECT unnest({TEST_YEARS}) AS y) ON year(dt) BETWEEN {FIRST_YEAR} AND y)""")
def walk_forward_folds(spark: SparkSession, folder: str) -> DataFrame:
    folds = SP.walk_forward_folds(SP.calendar(st.feature_rows(spark, folder)), FIRST_YEAR, TEST_YEARS)
    return folds.withColumn("train_frac", tidy("train_frac"))


@query("episode_starts", "cal", f"""
SELECT 0 AS seed, CAST(e AS INTEGER) AS episode,
       CAST({st.LOOKBACK - 1} + (e % (floor((n - {st.EPISODE_STEPS} - 1 - {st.LOOKBACK - 1}) / {st.EPISODE_STEPS}) + 1)) * {st.EPISODE_STEPS} AS INTEGER) AS start
FROM (SELECT count(*) AS n FROM cal), (SELECT unnest(range(0, 12)) AS e)""")
def episode_starts(spark: SparkSession, folder: str) -> DataFrame:
    cal = SP.calendar(st.feature_rows(spark, folder))
    return SP.episode_starts(cal, 12, st.LOOKBACK, st.EPISODE_STEPS, "sequential")


@query("episode_starts_random", "starts", "SELECT seed, CAST(episode AS INTEGER) AS episode, start FROM starts")
def episode_starts_random(spark: SparkSession, folder: str) -> DataFrame:
    cal = SP.calendar(st.feature_rows(spark, folder))
    return SP.episode_starts(cal, st.EPISODES, st.LOOKBACK, st.EPISODE_STEPS, "random", st.SEEDS)


@query("episode_steps", "episodes", "SELECT seed, CAST(episode AS INTEGER) AS episode, CAST(step AS INTEGER) AS step, dt, t FROM episodes")
def episode_steps(spark: SparkSession, folder: str) -> DataFrame:
    return st.episodes(st.feature_rows(spark, folder))


@query("seeded_draw", "", f"""
SELECT o_orderkey, round({draw_sql("'seeded'", '7', 'o_orderkey')}, 9) + 0.0 AS u,
       CAST(floor({draw_sql("'seeded'", '7', 'o_orderkey')} * 10) AS INTEGER) AS i FROM orders""")
def seeded_draw(spark: SparkSession, folder: str) -> DataFrame:
    return T.table(spark, folder, "orders").select(
        "o_orderkey",
        tidy(draw("seeded", 7, F.col("o_orderkey")), 9).alias("u"),
        draw_int(10, "seeded", 7, F.col("o_orderkey")).alias("i"),
    )
