"""The standard chain over the driver tables, and its settings.

trades -> weekly bars -> gapless calendar -> clean panel -> features ->
graph -> neighbourhoods -> masks -> replay -> scores. Stages that feed several
branches are cut, so the raw tables are scanned once per query.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from paneltide.operators import bars as B
from paneltide.operators import clean as C
from paneltide.operators import features as FE
from paneltide.operators import graph as G
from paneltide.operators import neighbourhood as N
from paneltide.operators import replay as R
from paneltide.operators import scores as SC
from paneltide.operators import selectors as S
from paneltide.operators import splits as SP
from paneltide.operators import walks as W
from paneltide.session import cut
from paneltide.sources import tables as T

# the shortlist settings: nodes per neighbourhood, walk rounds, mask size
SIZE, STEPS, TOP = 8, 3, 3
SEEDS = [0, 1, 2, 3]
EPISODES, LOOKBACK, EPISODE_STEPS = 4, 30, 40
HORIZON = 5


@dataclass(frozen=True)
class Settings:
    interval: str = "1wk"
    clean: C.CleanParams = field(default_factory=lambda: C.CleanParams(max_nan_ratio=0.6, ffill_limit=4, gapless=True))
    features: FE.FeatureParams = field(default_factory=FE.FeatureParams)
    graph: G.GraphParams = field(default_factory=G.GraphParams)


WEEKLY = Settings()


def bars(spark: SparkSession, folder: str, interval: str) -> DataFrame:
    """Bars by integer place key, then named: names never enter the big shuffle."""
    coded = B.build_bars(T.trades(spark, folder), interval, T.TRADE_TIE, ("place",))
    return T.named(coded, spark, folder).select("asset", "sector", "dt", "open", "high", "low", "close", "volume")


def weekly_bars(spark: SparkSession, folder: str, s: Settings = WEEKLY) -> DataFrame:
    return bars(spark, folder, s.interval)


def gapless(spark: SparkSession, folder: str, s: Settings = WEEKLY) -> DataFrame:
    """Bars on the full calendar; the bars are stored, they feed three branches."""
    return B.reindex_calendar(cut(weekly_bars(spark, folder, s)), s.interval)


def panel(spark: SparkSession, folder: str, s: Settings = WEEKLY) -> DataFrame:
    return C.clean_panel(gapless(spark, folder, s), s.clean)


def feature_rows(spark: SparkSession, folder: str, s: Settings = WEEKLY) -> DataFrame:
    """The stored feature panel with its calendar position."""
    return cut(C.with_position(FE.feature_panel(panel(spark, folder, s), s.features)))


def edges(features: DataFrame, s: Settings = WEEKLY) -> DataFrame:
    return G.build_graph(features, s.graph, G.count_assets(features))


def seeds(features: DataFrame) -> DataFrame:
    return G.seed_pick(G.seed_score(features))


def neighbourhoods(features: DataFrame, s: Settings = WEEKLY) -> DataFrame:
    """One stored row per date: (dt, ids, w)."""
    e = cut(edges(features, s))
    return cut(N.pack(e, N.best_first_neighbourhood(e, seeds(features), SIZE)))


def walk_masks(hoods: DataFrame, seed_list: list[int] = SEEDS) -> DataFrame:
    """Masks of the random walk and the edge walk."""
    return S.top_m(W.random_walk_k(hoods, STEPS), TOP, "random_walk", seed_list).unionByName(
        S.top_m(W.edge_walk_k(hoods, STEPS), TOP, "edge_walk", seed_list)
    )


def standard_masks(hoods: DataFrame, seed_list: list[int] = SEEDS) -> DataFrame:
    """Random walk, edge walk, random and sticky selectors."""
    return (
        walk_masks(hoods, seed_list)
        .unionByName(S.select_random(hoods, TOP, seed_list))
        .unionByName(S.select_sticky(hoods, TOP, seed_list, STICKY))
    )


STICKY = [0.0, 0.25, 0.5, 1.0]


def episodes(features: DataFrame) -> DataFrame:
    cal = SP.calendar(features)
    starts = SP.episode_starts(cal, EPISODES, LOOKBACK, EPISODE_STEPS, "random", SEEDS)
    return SP.episode_steps(starts, cal, EPISODE_STEPS)


def labels(features: DataFrame) -> DataFrame:
    return SC.promising(features, HORIZON)


def strategy_actions(features: DataFrame) -> DataFrame:
    split = SP.chronological_split(SP.calendar(features))
    return (
        R.strategy_random(features, SEEDS)
        .unionByName(R.strategy_momentum(features, SEEDS))
        .unionByName(R.strategy_oracle(features, SEEDS))
        .unionByName(R.strategy_buy_hold_best(features, split, SEEDS))
    )


def strategy_steps(features: DataFrame, params: R.RewardParams = R.RewardParams()) -> DataFrame:
    return R.replay_policy(strategy_actions(features), episodes(features), features, params)


def selector_steps(features: DataFrame, masks: DataFrame, params: R.RewardParams = R.RewardParams()) -> DataFrame:
    return R.replay_policy(R.first_choice(masks), episodes(features), features, params)
