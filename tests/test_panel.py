import datetime as dt

import numpy as np
import pandas as pd
import pytest

from paneltide.operators import clean as C
from paneltide.operators import features as FE
from paneltide.operators import splits as SP
from pyspark.sql import functions as F


def wide(df, value):
    return df.select("asset", "dt", value).toPandas().pivot(index="dt", columns="asset", values=value)


def test_features_match_pandas(panel, prices):
    close = prices.pivot(index="dt", columns="asset", values="close")
    delta = close.diff()
    up = delta.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    down = (-delta.clip(upper=0)).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    rsi = (100 - 100 / (1 + up / down)).shift(1)
    line = close.ewm(span=12, adjust=False).mean() - close.ewm(span=26, adjust=False).mean()
    macd = ((line - line.ewm(span=9, adjust=False).mean()) / close).shift(1)
    r = np.log(close / close.shift(1))
    vol = (r.rolling(20).std() * np.sqrt(252)).shift(1)
    for got, want in (
        (wide(FE.rsi(panel), "rsi"), rsi),
        (wide(FE.macd(panel), "macd"), macd),
        (wide(FE.volatility(panel), "volatility"), vol),
    ):
        np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(), rtol=1e-9, atol=1e-12)


def test_features_do_not_look_ahead(panel):
    names = ["return", "volatility", "volume_rel"]
    short = panel.where(F.col("dt") <= F.lit("2022-05-01").cast("date"))
    audit = FE.leak_audit(
        FE.feature_panel(panel, drop_incomplete=False), FE.feature_panel(short, drop_incomplete=False), names
    ).collect()
    assert len(audit) == 3 and all(r.clean and r.n_common > 0 for r in audit)


def test_cleaning(spark):
    d = [dt.date(2024, 1, i) for i in range(1, 7)]
    rows = [("a", "s", x, 1.0 * i) for i, x in enumerate(d)]
    rows += [("b", "s", x, None if i in (1, 2, 3) else 5.0 + i) for i, x in enumerate(d)]
    rows += [("c", "s", x, None) for x in d]
    p = spark.createDataFrame(rows, "asset string, sector string, dt date, close double")
    assert {r.asset for r in C.nan_ratio_filter(p, 0.5).collect()} == {"a", "b"}
    kept = C.clean_panel(p, C.CleanParams(max_nan_ratio=0.5, ffill_limit=2))
    b = {r.dt: r.close for r in kept.where("asset = 'b'").collect()}
    assert b == {d[0]: 5.0, d[1]: 5.0, d[2]: 5.0, d[4]: 9.0, d[5]: 10.0}


def test_splits_reject_overlap_and_cover(features):
    cal = SP.calendar(features)
    parts = {r.part: r.n for r in SP.chronological_split(cal).groupBy("part").agg(F.count("*").alias("n")).collect()}
    n = cal.count()
    assert parts["train"] == int(n * 0.6) and parts["val"] == int(n * 0.2) and sum(parts.values()) == n
    with pytest.raises(ValueError):
        SP.holdout_split(cal, "2022-03-01", "2022-02-01")
    with pytest.raises(Exception, match="too short"):
        SP.chronological_split(cal.limit(3)).collect()
    with pytest.raises(Exception, match="block is empty"):
        SP.holdout_split(cal, "2031-03-01").collect()
    with pytest.raises(Exception, match="shorter than"):
        SP.episode_starts(cal, 2, 5000, 10).collect()


def test_state_windows_layout(features):
    names = ["return", "volatility"]
    states = FE.state_windows(features, names, 4)
    row = states.where("state IS NOT NULL").orderBy("dt").first()
    assert states.where("state IS NULL").count() == 3
    pdf = features.select("asset", "dt", *names).toPandas()
    days = sorted(pdf.dt.unique())[:4]
    want = [
        np.float32(pdf[(pdf.dt == d) & (pdf.asset == a)][n].iloc[0])
        for d in days
        for a in sorted(pdf.asset.unique())
        for n in names
    ]
    assert row.dt == days[-1]
    np.testing.assert_allclose(row.state, want, rtol=1e-6)


def test_states_keep_their_width_over_gaps(features):
    names = ["return", "volatility"]
    days = [r.dt for r in features.select("dt").distinct().orderBy("dt").collect()]
    gap = features.where(~((F.col("asset") == "A2") & (F.col("dt") == F.lit(days[10]))))
    states = {r.dt: r.state for r in FE.state_windows(gap, names, 4).collect()}
    assert states[days[10]] is None and {len(s) for s in states.values() if s} == {7 * 4 * 2}
    # graph features on one date only, and there for two assets
    known = gap.where((F.col("dt") == F.lit(days[20])) & F.col("asset").isin("A1", "A4")).select(
        "dt", "asset", F.lit(2.0).alias("degree"), F.lit(0.5).alias("clustering")
    )
    grown = {r.dt: r.state for r in FE.relational_state(FE.state_windows(gap, names, 4), known, ["degree", "clustering"], features).collect()}
    assert {len(s) for s in grown.values() if s} == {7 * 4 * 2 + 7 * 2}
    want = [0.0] * 14
    want[2:4] = want[8:10] = [2.0, 0.5]
    assert grown[days[20]][56:] == want and grown[days[21]][56:] == [0.0] * 14
    assert grown[days[20]][:56] == states[days[20]] and grown[days[10]] is None
