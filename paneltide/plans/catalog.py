"""All queries in one place, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paneltide.functions.columns import tidy
from paneltide.operators import scores as SC
from paneltide.plans import file_queries, graph_queries, ledger_queries, panel_queries, score_queries  # noqa: F401
from paneltide.plans import stages as st
from paneltide.plans.registry import ORACLE, QUERIES, query
from paneltide.session import cut

__all__ = ["ORACLE", "QUERIES", "flagship"]


def flagship(spark: SparkSession, folder: str, settings: st.Settings = st.WEEKLY) -> DataFrame:
    """Shortlist quality per selector and seed, from raw trades.

    Trades become bars, features, one graph and one neighbourhood per date;
    seven selectors choose candidates; their masks are replayed over random
    episodes and scored against what happened afterwards.
    """
    f = st.feature_rows(spark, folder, settings)
    masks = cut(st.standard_masks(st.neighbourhoods(f, settings)))
    eps = cut(st.episodes(f))
    labels = cut(st.labels(f))
    keys = ["selector", "seed"]
    return (
        SC.precision_at_m(masks, labels, eps)
        .join(SC.candidate_hit_rate(masks, labels, eps).drop("n_evaluable"), keys)
        .join(SC.turnover(masks, eps).drop("n"), keys)
        .select(
            *keys,
            "n_steps",
            *[
                tidy(c).alias(c)
                for c in ("precision_at_m", "candidate_hit_rate", "candidate_hit_evaluable", "turnover")
            ],
        )
    )


@query("flagship", "precision_rows cand rotation", """
SELECT p.selector, p.seed, p.n_steps, round(p.precision_at_m, 6) + 0.0 AS precision_at_m, round(c.candidate_hit_rate, 6) + 0.0 AS candidate_hit_rate,
       round(c.candidate_hit_evaluable, 6) + 0.0 AS candidate_hit_evaluable, round(r.rotation, 6) + 0.0 AS turnover
FROM precision_rows p JOIN cand c ON c.selector = p.selector AND c.seed = p.seed JOIN rotation r ON r.selector = p.selector AND r.seed = p.seed""")
def flagship_query(spark: SparkSession, folder: str) -> DataFrame:
    return flagship(spark, folder)
