from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from paneltide.session import build_session

    session = build_session(4, app="paneltide-tests", memory="4g", partitions=4)
    yield session
    session.stop()


def walk_panel(assets: int = 7, days: int = 110, seed: int = 3) -> pd.DataFrame:
    """Random-walk prices of a few assets on business days."""
    rng = np.random.default_rng(seed)
    dates = [d.date() for d in pd.bdate_range("2022-01-03", periods=days)]
    rows = []
    for a in range(assets):
        close = 100 * np.exp(np.cumsum(rng.normal(0.0003 * a, 0.012, days)))
        volume = rng.integers(100, 1000, days).astype(float)
        for i, d in enumerate(dates):
            rows.append((f"A{a}", f"S{a % 3}", d, close[i], close[i], close[i], close[i], volume[i]))
    return pd.DataFrame(rows, columns=["asset", "sector", "dt", "open", "high", "low", "close", "volume"])


@pytest.fixture(scope="session")
def prices() -> pd.DataFrame:
    return walk_panel()


@pytest.fixture(scope="session")
def panel(spark, prices):
    return spark.createDataFrame(prices).cache()


@pytest.fixture(scope="session")
def features(spark, panel):
    from paneltide.operators.clean import with_position
    from paneltide.operators.features import feature_panel
    from paneltide.session import cut

    return cut(with_position(feature_panel(panel)))


@pytest.fixture(scope="session")
def edges(features):
    from paneltide.operators.graph import GraphParams, build_graph
    from paneltide.session import cut

    return cut(build_graph(features, GraphParams(window=30, k=2), 7))


@pytest.fixture(scope="session")
def hoods(features, edges):
    from paneltide.operators.graph import seed_pick, seed_score
    from paneltide.operators.neighbourhood import best_first_neighbourhood, pack
    from paneltide.session import cut

    return cut(pack(edges, best_first_neighbourhood(edges, seed_pick(seed_score(features)), 5)))


@pytest.fixture(scope="session")
def packed(hoods) -> list:
    return hoods.orderBy("dt").collect()
