"""Queries on policies, replay, strategies, evaluation and information."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from paneltide.functions.columns import tidy
from paneltide.functions.draws import draw_sql
from paneltide.operators import graph as G
from paneltide.operators import information as I
from paneltide.operators import policy as P
from paneltide.operators import replay as R
from paneltide.operators import resample as RS
from paneltide.operators import scores as SC
from paneltide.operators import selectors as S
from paneltide.operators import splits as SP
from paneltide.operators import walks as W
from paneltide.plans import stages as st
from paneltide.plans.graph_queries import _features_and_hoods, eligible_hoods, _features_and_edges
from paneltide.plans.registry import query
from paneltide.plans.sqltext import boot_parts, norm_cdf_sql, norm_quantile_part, part
from paneltide.session import cut
from paneltide.sources import tables as T


def out(df: DataFrame, keys: list[str], *values: str, digits: int = 6) -> DataFrame:
    return df.select(*keys, *[tidy(v, digits).alias(v) for v in values])


def rnd(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), {digits}) + 0.0 AS {n}" for n in names)


# policies ---------------------------------------------------------------------

part("logit_rows", "", """
SELECT step, action, round((m - mu) / sd, 9) AS logit, (m - mu) / sd > -1.0 AS allowed
FROM (SELECT user_id AS step, event_type AS action, avg(value) AS m FROM events GROUP BY 1, 2) c
JOIN (SELECT action, avg(m) AS mu, stddev_samp(m) AS sd FROM (SELECT user_id, event_type AS action, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY action) b USING (action)""")
part("soft", "logit_rows", """
SELECT l.step, l.action, CASE WHEN l.allowed THEN l.logit - ln(s.z) END AS log_prob,
       CASE WHEN s.z IS NULL THEN NULL WHEN l.allowed THEN exp(l.logit) / s.z ELSE 0.0 END AS prob
FROM logit_rows l LEFT JOIN (SELECT step, sum(exp(logit)) AS z FROM logit_rows WHERE allowed GROUP BY step) s ON s.step = l.step""")


@query("masked_softmax", "soft", f"SELECT step, action, {rnd('prob', 'log_prob')} FROM soft")
def masked_softmax(spark: SparkSession, folder: str) -> DataFrame:
    scored = P.masked_softmax(T.logits(spark, folder), ["step"], on_empty="null")
    return out(scored, ["step", "action"], "prob", "log_prob")


@query("masked_entropy", "soft", "SELECT step, round(-sum(prob * log_prob), 6) + 0.0 AS entropy FROM soft GROUP BY step")
def masked_entropy(spark: SparkSession, folder: str) -> DataFrame:
    scored = P.masked_softmax(T.logits(spark, folder), ["step"], on_empty="null")
    return out(P.masked_entropy(scored, ["step"]), ["step"], "entropy")


part("uniform_bias", "nodes", "SELECT dt, node, 1.0 / count(*) OVER (PARTITION BY dt) AS score FROM nodes")


def _bias_sql(source: str, mode: str) -> str:
    return f"""
SELECT '{mode}' AS mode, dt, node AS asset, 0.5 * ln(score + 1e-8) AS bias FROM {source}
UNION ALL SELECT '{mode}', dt, asset, 0.0 FROM feat WHERE dt NOT IN (SELECT dt FROM {source})"""


part("bias", "rw ewalk uniform_bias feat", " UNION ALL ".join(
    _bias_sql(s, m) for s, m in (("ewalk", "edge_walk"), ("rw", "random_walk"), ("uniform_bias", "uniform"))))


def _biases(f: DataFrame, hoods: DataFrame) -> DataFrame:
    uniform = hoods.withColumn("score", F.transform("ids", lambda i: 1.0 / F.size("ids")))
    modes = {
        "edge_walk": W.edge_walk_k(hoods, st.STEPS),
        "random_walk": W.random_walk_k(hoods, st.STEPS),
        "uniform": uniform,
    }
    rows = None
    for mode, scored in modes.items():
        one = P.walk_bias(W.score_rows(scored), SP.calendar(f), f, 0.5).withColumn("mode", F.lit(mode))
        rows = one if rows is None else rows.unionByName(one)
    return rows


# exponents below 1e-8 differ in the last digit between engines, hence five digits
@query("walk_bias", "bias", f"SELECT mode, dt, asset, {rnd('bias', digits=5)} FROM bias")
def walk_bias(spark: SparkSession, folder: str) -> DataFrame:
    return out(_biases(*_features_and_hoods(spark, folder)), ["mode", "dt", "asset"], "bias", digits=5)


@query("biased_softmax", "bias scores", """
SELECT dt, asset, round(exp(z) / sum(exp(z)) OVER (PARTITION BY dt), 6) + 0.0 AS prob FROM (
  SELECT b.dt, b.asset, s.score + b.bias AS z FROM bias b JOIN scores s ON s.dt = b.dt AND s.asset = b.asset WHERE mode = 'edge_walk')""")
def biased_softmax(spark: SparkSession, folder: str) -> DataFrame:
    f, hoods = _features_and_hoods(spark, folder)
    bias = P.walk_bias(W.score_rows(W.edge_walk_k(hoods, st.STEPS)), SP.calendar(f), f, 0.5)
    logits = G.seed_score(f).select("dt", "asset", F.col("score").alias("logit"))
    return out(P.biased_softmax(logits, bias), ["dt", "asset"], "prob")


part("traj", "", """
SELECT user_id AS traj, event_id, value AS r, CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END AS done,
       avg(value) OVER (PARTITION BY event_type) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step,
       row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events""")
part("gae", "traj", """/*REC*/
SELECT traj, back, step, event_id, v, r - v AS adv FROM traj WHERE back = 1
UNION ALL
SELECT t.traj, t.back, t.step, t.event_id, t.v, t.r + 0.99 * g.v * (1 - t.done) - t.v + 0.99 * 0.95 * (1 - t.done) * g.adv
FROM gae g JOIN traj t ON t.traj = g.traj AND t.back = g.back + 1""")


@query("trajectory_gae", "gae", "SELECT traj, step, event_id, round(adv, 6) + 0.0 AS advantage, round(adv + v, 6) + 0.0 AS ret FROM gae")
def trajectory_gae(spark: SparkSession, folder: str) -> DataFrame:
    return out(P.trajectory_gae(T.trajectories(spark, folder)), ["traj", "step", "event_id"], "advantage", "ret")


# replay -------------------------------------------------------------------------

STEP_KEYS = ["run", "seed", "episode", "step", "dt", "asset"]
STEP_SQL = "run, seed, CAST(episode AS INTEGER) AS episode, CAST(step AS INTEGER) AS step, dt, asset"


@query("realized_return", "steps", f"SELECT {STEP_SQL}, {rnd('next_return', 'vol')} FROM steps")
def realized_return(spark: SparkSession, folder: str) -> DataFrame:
    return out(st.strategy_steps(st.feature_rows(spark, folder)), STEP_KEYS, "next_return", "vol")


@query("switch_cost", "steps", f"SELECT {STEP_SQL}, {rnd('cost')} FROM steps")
def switch_cost(spark: SparkSession, folder: str) -> DataFrame:
    return out(st.strategy_steps(st.feature_rows(spark, folder)), STEP_KEYS, "cost")


@query("reward_risk", "steps", f"SELECT {STEP_SQL}, {rnd('reward')} FROM steps")
def reward_risk(spark: SparkSession, folder: str) -> DataFrame:
    return out(st.strategy_steps(st.feature_rows(spark, folder)), STEP_KEYS, "reward")


@query("reward_log_wealth", "steps_log", f"SELECT {STEP_SQL}, {rnd('reward')} FROM steps_log")
def reward_log_wealth(spark: SparkSession, folder: str) -> DataFrame:
    return out(
        st.strategy_steps(st.feature_rows(spark, folder), R.RewardParams(kind="log_wealth")), STEP_KEYS, "reward"
    )


@query("replay_policy", "mask_steps", f"SELECT {STEP_SQL}, {rnd('next_return', 'cost', 'reward')} FROM mask_steps")
def replay_policy(spark: SparkSession, folder: str) -> DataFrame:
    f, hoods = _features_and_hoods(spark, folder)
    return out(st.selector_steps(f, st.standard_masks(hoods)), STEP_KEYS, "next_return", "cost", "reward")


def _strategy(name: str, build):
    @query(f"strategy_{name}", "actions", f"SELECT run, seed, dt, asset FROM actions WHERE run = '{name}'")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(st.feature_rows(spark, folder))

    return run


_strategy("random", lambda f: R.strategy_random(f, st.SEEDS))
_strategy("momentum", lambda f: R.strategy_momentum(f, st.SEEDS))
_strategy("oracle", lambda f: R.strategy_oracle(f, st.SEEDS))
_strategy(
    "buy_hold_best",
    lambda f: R.strategy_buy_hold_best(f, SP.chronological_split(SP.calendar(f)), st.SEEDS),
)


@query("strategy_equal_weight", "feat", 'SELECT dt, round(avg("return"), 6) + 0.0 AS port_return FROM feat GROUP BY dt')
def strategy_equal_weight(spark: SparkSession, folder: str) -> DataFrame:
    return out(R.strategy_equal_weight(st.feature_rows(spark, folder)), ["dt"], "port_return")


@query("shrunk_covariance", "feat", """
SELECT x.asset AS src, y.asset AS dst, round(covar_samp(x."return", y."return") * CASE WHEN x.asset = y.asset THEN 1.0 ELSE 0.9 END, 6) + 0.0 AS cov
FROM feat x JOIN feat y ON x.dt = y.dt GROUP BY x.asset, y.asset""")
def shrunk_covariance(spark: SparkSession, folder: str) -> DataFrame:
    return out(R.shrunk_covariance(st.feature_rows(spark, folder)), ["src", "dst"], "cov")


def _tangency(f: DataFrame) -> DataFrame:
    train = SP.chronological_split(SP.calendar(f)).where(F.col("part") == "train")
    return R.strategy_tangency(f, train.select(F.lit("train").alias("fold"), "dt"))


@query("strategy_tangency")
def strategy_tangency(spark: SparkSession, folder: str) -> DataFrame:
    return out(_tangency(st.feature_rows(spark, folder)), ["fold", "asset"], "weight")


part("port", "feat names", """
SELECT 'equal' AS portfolio, dt, t, ln(1 + greatest(avg("return"), -0.999999)) AS lr FROM feat GROUP BY dt, t
UNION ALL SELECT 'first_half', dt, t, ln(1 + greatest(avg("return"), -0.999999)) FROM feat JOIN names USING (asset) WHERE i < n // 2 GROUP BY dt, t""")
part("port_curve", "port", "SELECT *, sum(lr) OVER (PARTITION BY portfolio ORDER BY t) AS cum FROM port")


@query("portfolio_metrics", "port_curve names", f"""
SELECT portfolio, round(sum(lr), 6) + 0.0 AS cumulative_return, round(avg(lr) / (stddev_samp(lr) + 1e-8), 6) + 0.0 AS sharpe,
       round(max(fall), 6) + 0.0 AS max_drawdown, round(avg(lr), 6) + 0.0 AS mean_reward_per_step, count(*) AS n_steps,
       round(CASE WHEN portfolio = 'equal' THEN 1.0 ELSE (SELECT avg(CASE WHEN i < n // 2 THEN 1.0 ELSE 0.0 END) FROM names) END, 6) + 0.0 AS asset_coverage
FROM (SELECT *, max(cum) OVER (PARTITION BY portfolio ORDER BY t) - cum AS fall FROM port_curve) GROUP BY portfolio""")
def portfolio_metrics(spark: SparkSession, folder: str) -> DataFrame:
    f = st.feature_rows(spark, folder)
    order = R.asset_order(f)
    half = F.floor(F.col("n") / 2)
    weights = order.select(F.lit("equal").alias("portfolio"), "asset", (1.0 / F.col("n")).alias("weight")).unionByName(
        order.select(
            F.lit("first_half").alias("portfolio"), "asset", F.when(F.col("i") < half, 1.0 / half).otherwise(0.0).alias("weight")
        )
    )
    m = R.portfolio_metrics(f, weights)
    return out(m, ["portfolio", "n_steps"], "cumulative_return", "sharpe", "max_drawdown", "mean_reward_per_step", "asset_coverage")


SERIES_FROM, SERIES_TO = "1997-01-01", "2000-12-31"
part("series_wide", "feat pick_mom", f"""
SELECT e.dt, m.momentum, e.equal_weight FROM (SELECT dt, avg("return") AS equal_weight FROM feat
  WHERE dt BETWEEN DATE '{SERIES_FROM}' AND DATE '{SERIES_TO}' GROUP BY dt) e
LEFT JOIN (SELECT p.dt, n.nr AS momentum FROM pick_mom p JOIN (
  SELECT dt, asset, lead("return") OVER (PARTITION BY asset ORDER BY dt) AS nr FROM feat WHERE dt BETWEEN DATE '{SERIES_FROM}' AND DATE '{SERIES_TO}') n
  ON n.dt = p.dt AND n.asset = p.asset) m ON m.dt = e.dt""")
part("series", "series_wide", """
SELECT name, row_number() OVER (PARTITION BY name ORDER BY dt) - 1 AS t, x FROM (
  SELECT 'momentum' AS name, dt, momentum AS x FROM series_wide WHERE momentum IS NOT NULL
  UNION ALL SELECT 'equal_weight', dt, equal_weight FROM series_wide)""")


def series_rows(spark: SparkSession, folder: str) -> DataFrame:
    wide = R.momentum_series(st.feature_rows(spark, folder), SERIES_FROM, SERIES_TO)
    long = wide.unpivot(["dt"], ["momentum", "equal_weight"], "name", "x").where(F.col("x").isNotNull())
    return cut(RS.indexed(long, ["name"], "dt", "x").select("name", F.col("j").alias("t"), "x"))


@query("momentum_series", "series_wide", f"SELECT dt, {rnd('momentum', 'equal_weight')} FROM series_wide")
def momentum_series(spark: SparkSession, folder: str) -> DataFrame:
    return out(
        R.momentum_series(st.feature_rows(spark, folder), SERIES_FROM, SERIES_TO), ["dt"], "momentum", "equal_weight"
    )


# evaluation ---------------------------------------------------------------------


@query("promising", "labels", "SELECT dt, t, asset, round(g, 6) + 0.0 AS g, is_promising FROM labels")
def promising(spark: SparkSession, folder: str) -> DataFrame:
    return st.labels(st.feature_rows(spark, folder)).select("dt", "t", "asset", tidy("g").alias("g"), "is_promising")


def _steps(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    f = st.feature_rows(spark, folder)
    return f, st.strategy_steps(f)


def _metric(name: str, select: str, build, *values: str):
    @query(name, "dropped names", f"SELECT run, seed, {select} FROM dropped GROUP BY run, seed")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        f, steps = _steps(spark, folder)
        return out(build(f, steps), ["run", "seed"], *values)

    return run


_metric("cumulative_return", "round(sum(reward), 6) + 0.0 AS cumulative_return", lambda f, s: SC.cumulative_return(s), "cumulative_return")
_metric("mean_reward", "round(sum(reward) / count(DISTINCT episode), 6) + 0.0 AS mean_reward", lambda f, s: SC.mean_reward(s), "mean_reward")
_metric("sharpe", "round(avg(reward) / (stddev_samp(reward) + 1e-8), 6) + 0.0 AS sharpe_ratio", lambda f, s: SC.sharpe(s), "sharpe_ratio")
_metric("max_drawdown", "round(max(fall), 6) + 0.0 AS max_drawdown", lambda f, s: SC.max_drawdown(s), "max_drawdown")
_metric("asset_coverage", "round(count(DISTINCT asset) / (SELECT max(n) FROM names), 6) + 0.0 AS asset_coverage", lambda f, s: SC.asset_coverage(s, f), "asset_coverage")
_metric("topm_hit_rate", "round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS topm_hit_rate", lambda f, s: SC.topm_hit_rate(s, st.labels(f)), "topm_hit_rate")
_metric("time_to_first", "round(CAST(min(CASE WHEN hit THEN n END) AS DOUBLE), 6) + 0.0 AS time_to_first", lambda f, s: SC.time_to_first(s, st.labels(f)), "time_to_first")


@query("mean_latency", "", "SELECT event_type, round(avg(value), 6) + 0.0 AS mean_latency_ms FROM events GROUP BY event_type")
def mean_latency(spark: SparkSession, folder: str) -> DataFrame:
    return out(SC.mean_latency(T.table(spark, folder, "events"), ["event_type"], "value"), ["event_type"], "mean_latency_ms")


RUN_VALUES = ("cumulative_return", "sharpe_ratio", "max_drawdown", "mean_reward", "asset_coverage", "topm_hit_rate", "time_to_first")


@query("run_metrics", "dropped names", """
SELECT run, seed, count(DISTINCT episode) AS n_episodes, count(*) AS n_steps, round(sum(reward), 6) + 0.0 AS cumulative_return,
       round(avg(reward) / (stddev_samp(reward) + 1e-8), 6) + 0.0 AS sharpe_ratio, round(max(fall), 6) + 0.0 AS max_drawdown,
       round(sum(reward) / count(DISTINCT episode), 6) + 0.0 AS mean_reward, round(count(DISTINCT asset) / (SELECT max(n) FROM names), 6) + 0.0 AS asset_coverage,
       round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS topm_hit_rate, round(CAST(min(CASE WHEN hit THEN n END) AS DOUBLE), 6) + 0.0 AS time_to_first
FROM dropped GROUP BY run, seed""")
def run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    f, steps = _steps(spark, folder)
    return out(SC.run_metrics(steps, st.labels(f), f), ["run", "seed", "n_episodes", "n_steps"], *RUN_VALUES)


def _mask_inputs(spark: SparkSession, folder: str):
    f, hoods = _features_and_hoods(spark, folder)
    return f, hoods, cut(st.standard_masks(hoods))


@query("candidate_hit_rate", "cand", f"SELECT selector, seed, {rnd('candidate_hit_rate', 'candidate_hit_evaluable')}, CAST(n_evaluable AS BIGINT) AS n_evaluable FROM cand")
def candidate_hit_rate(spark: SparkSession, folder: str) -> DataFrame:
    f, _, masks = _mask_inputs(spark, folder)
    rows = SC.candidate_hit_rate(masks, st.labels(f), st.episodes(f))
    return out(rows, ["selector", "seed", "n_evaluable"], "candidate_hit_rate", "candidate_hit_evaluable")


part("precision_rows", "mask_hits episodes", """
SELECT h.selector, h.seed, avg(share) AS precision_at_m, count(*) AS n_steps FROM episodes e
JOIN mask_hits h ON h.seed = e.seed AND h.dt = e.dt WHERE evaluable GROUP BY h.selector, h.seed""")


@query("precision_at_m", "precision_rows", "SELECT selector, seed, round(precision_at_m, 6) + 0.0 AS precision_at_m, n_steps FROM precision_rows")
def precision_at_m(spark: SparkSession, folder: str) -> DataFrame:
    f, _, masks = _mask_inputs(spark, folder)
    return out(SC.precision_at_m(masks, st.labels(f), st.episodes(f)), ["selector", "seed", "n_steps"], "precision_at_m")


_order = draw_sql("'order'", "seed", "dt", "node")
part("rankings", "ranked_rw ranked_ew nodes seed_list", f"""
SELECT 'random_walk' AS selector, seed, dt, asset, rank FROM ranked_rw CROSS JOIN seed_list
UNION ALL SELECT 'edge_walk', seed, dt, asset, rank FROM ranked_ew CROSS JOIN seed_list
UNION ALL SELECT 'random', seed, dt, node, row_number() OVER (PARTITION BY seed, dt ORDER BY round({_order}, 12) DESC, node) FROM nodes CROSS JOIN seed_list""")
part("ndcg_rows", "rankings labels episodes", f"""
SELECT selector, e.seed, avg(dcg / idcg) AS ndcg_at_m, count(*) AS n_steps FROM episodes e JOIN (
  SELECT selector, seed, dt, sum(CASE WHEN rank <= {st.TOP} THEN rel / log2(rank + 1) ELSE 0 END) AS dcg,
         sum(CASE WHEN best <= {st.TOP} THEN rel / log2(best + 1) ELSE 0 END) AS idcg FROM (
    SELECT r.*, greatest(l.g, 0) AS rel, row_number() OVER (PARTITION BY selector, seed, r.dt ORDER BY greatest(l.g, 0) DESC, r.asset) AS best
    FROM rankings r JOIN labels l ON l.dt = r.dt AND l.asset = r.asset WHERE l.g IS NOT NULL) GROUP BY selector, seed, dt) d
  ON d.seed = e.seed AND d.dt = e.dt WHERE idcg > 0 GROUP BY selector, e.seed""")


def _rankings(hoods: DataFrame) -> DataFrame:
    return (
        S.ranked_recorder(W.random_walk_k(hoods, st.STEPS), "random_walk", st.SEEDS)
        .unionByName(S.ranked_recorder(W.edge_walk_k(hoods, st.STEPS), "edge_walk", st.SEEDS))
        .unionByName(S.random_ranking(hoods, st.SEEDS))
    )


@query("ndcg_at_m", "ndcg_rows", "SELECT selector, seed, round(ndcg_at_m, 6) + 0.0 AS ndcg_at_m, n_steps FROM ndcg_rows")
def ndcg_at_m(spark: SparkSession, folder: str) -> DataFrame:
    f, hoods = _features_and_hoods(spark, folder)
    rows = SC.ndcg_at_m(_rankings(hoods), st.labels(f), st.episodes(f), st.TOP)
    return out(rows, ["selector", "seed", "n_steps"], "ndcg_at_m")


@query("turnover", "changes", "SELECT selector, seed, round(avg(change), 6) + 0.0 AS turnover, count(*) AS n FROM changes GROUP BY selector, seed")
def turnover(spark: SparkSession, folder: str) -> DataFrame:
    f, _, masks = _mask_inputs(spark, folder)
    return out(SC.turnover(masks, st.episodes(f)), ["selector", "seed", "n"], "turnover")


@query("turnover_evaluable", "changes_ok", "SELECT selector, seed, round(avg(change), 6) + 0.0 AS turnover, count(*) AS n FROM changes_ok GROUP BY selector, seed")
def turnover_evaluable(spark: SparkSession, folder: str) -> DataFrame:
    f, _, masks = _mask_inputs(spark, folder)
    return out(SC.turnover(masks, st.episodes(f), st.labels(f)), ["selector", "seed", "n"], "turnover")


part("tercile_rows", "changes_ok mask_hits", """
SELECT c.selector, round(c.change, 12) AS change, h.hit FROM changes_ok c JOIN mask_hits h ON h.selector = c.selector AND h.seed = c.seed AND h.dt = c.dt""")


@query("hit_by_turnover_tercile", "tercile_rows", """
SELECT r.selector, CASE WHEN change <= t1 THEN 'low' WHEN change <= t2 THEN 'mid' ELSE 'high' END AS third,
       CASE WHEN max(q.n) >= 30 THEN round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) + 0.0 END AS hit_rate, count(*) AS n
FROM tercile_rows r JOIN (SELECT selector, quantile_cont(change, 0.333) AS t1, quantile_cont(change, 0.667) AS t2, count(*) AS n
  FROM tercile_rows GROUP BY selector) q ON q.selector = r.selector GROUP BY 1, 2""")
def hit_by_turnover_tercile(spark: SparkSession, folder: str) -> DataFrame:
    f, _, masks = _mask_inputs(spark, folder)
    rows = SC.hit_by_turnover_tercile(masks, st.labels(f), st.episodes(f))
    return rows.select("selector", "third", tidy("hit_rate").alias("hit_rate"), F.col("n").cast("long").alias("n"))


part("fb_events", "episodes fb_masks labels", """
SELECT m.selector AS run, e.seed, e.episode, e.step, e.dt, m.reason IS NOT NULL AS fallback, m.hit FROM episodes e JOIN (
  SELECT f.seed, f.dt, max(f.reason) AS reason, bool_or(l.is_promising) AS hit FROM fb_masks f JOIN labels l ON l.dt = f.dt AND l.asset = f.asset
  GROUP BY f.seed, f.dt) m ON m.seed = e.seed AND m.dt = e.dt""")


def fallback_events(f: DataFrame, e: DataFrame) -> DataFrame:
    seeds, hoods = eligible_hoods(f, e)
    reasons = S.fallback_reasons(SP.calendar(f), seeds, hoods)
    masks = S.mask_fallback(S.select_random(hoods, st.TOP, st.SEEDS), reasons, f)
    marked = masks.join(st.labels(f).select("dt", "asset", "is_promising"), ["dt", "asset"]).groupBy("selector", "seed", "dt").agg(
        F.max("reason").alias("reason"), F.bool_or("is_promising").alias("hit")
    )
    return st.episodes(f).join(marked, ["seed", "dt"]).select(
        F.col("selector").alias("run"), "seed", "episode", "step", "dt", F.col("reason").isNotNull().alias("fallback"), "hit"
    )


FB_VALUES = ("share_fallback", "hit_all", "hit_valid", "hit_fallback")


@query("fallback_summary", "fb_events", """
SELECT run, seed, count(*) AS n_steps, CAST(sum(CASE WHEN fallback THEN 1 ELSE 0 END) AS BIGINT) AS n_fallback,
       round(avg(CASE WHEN fallback THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS share_fallback, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS hit_all,
       round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FILTER (NOT fallback), 6) + 0.0 AS hit_valid,
       round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FILTER (fallback), 6) + 0.0 AS hit_fallback FROM fb_events GROUP BY run, seed""")
def fallback_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = SC.fallback_summary(fallback_events(*_features_and_edges(spark, folder)))
    return out(rows, ["run", "seed", "n_steps", "n_fallback"], *FB_VALUES)


@query("fallback_identity", "fb_events", """
SELECT count(*) FILTER (a.dt IS NOT NULL AND b.dt IS NULL) AS only_left, count(*) FILTER (a.dt IS NULL AND b.dt IS NOT NULL) AS only_right,
       count(*) FILTER (a.dt IS NULL OR b.dt IS NULL) = 0 AS identical
FROM (SELECT episode, step, dt FROM fb_events WHERE seed = 0 AND fallback) a
FULL JOIN (SELECT episode, step, dt FROM fb_events WHERE seed = 1 AND fallback) b USING (episode, step, dt)""")
def fallback_identity(spark: SparkSession, folder: str) -> DataFrame:
    ev = cut(fallback_events(*_features_and_edges(spark, folder)).where("fallback"))
    keys = ["episode", "step", "dt"]
    return SC.fallback_identity(ev.where("seed = 0").select(*keys), ev.where("seed = 1").select(*keys))


part("curve", "", """
SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY d) - 1 AS i, value FROM (
  SELECT user_id, date_trunc('day', ts) AS d, avg(value) AS value FROM events GROUP BY 1, 2)""")
part("curve_w", "curve", """
SELECT *, count(*) OVER (PARTITION BY run) AS size, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, count(*) OVER w AS have
FROM curve WINDOW w AS (PARTITION BY run ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)""")


def curves(spark: SparkSession, folder: str) -> DataFrame:
    """Mean value per user and day: one learning curve per user."""
    return (
        T.table(spark, folder, "events")
        .groupBy(F.col("user_id").alias("run"), F.date_trunc("day", "ts").alias("i"))
        .agg(F.avg("value").alias("value"))
    )


@query("convergence_final", "curve_w", """
SELECT run, min(CASE WHEN abs(m - f) < abs(f) * 0.05 + 1e-3 AND i < size - 3 AND size >= 6 THEN i + 1 END) AS converged
FROM (SELECT *, avg(CASE WHEN i >= size - 3 THEN value END) OVER (PARTITION BY run) AS f FROM curve_w) GROUP BY run""")
def convergence_final(spark: SparkSession, folder: str) -> DataFrame:
    return SC.convergence_final(curves(spark, folder))


@query("convergence_stability", "curve_w", """
SELECT run, min(CASE WHEN s / greatest(abs(m), 1e-8) < 0.05 AND i < size - 3 AND size >= 4 THEN i + 1 END) AS converged FROM curve_w GROUP BY run""")
def convergence_stability(spark: SparkSession, folder: str) -> DataFrame:
    return SC.convergence_stability(curves(spark, folder))


part("moving", "curve_w", """
SELECT run, i, size, m, count(*) OVER r AS points, avg(m) OVER r AS level, row_number() OVER (PARTITION BY run ORDER BY round(m, 12) DESC, i) AS top,
       regr_slope(m, CAST(i AS DOUBLE)) OVER (PARTITION BY run ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS slope
FROM curve_w WHERE have = 3 WINDOW r AS (PARTITION BY run)""")


@query("convergence_plateau", "curve moving", """
SELECT c.run, min(CASE WHEN m.i >= p.i AND m.i < points - 3 AND abs(slope) / greatest(abs(level), 1e-8) < 0.01 AND size >= 6 THEN m.i + 1 END) AS converged
FROM (SELECT DISTINCT run FROM curve) c LEFT JOIN moving m ON m.run = c.run LEFT JOIN (SELECT run, i FROM moving WHERE top = 1) p ON p.run = c.run GROUP BY c.run""")
def convergence_plateau(spark: SparkSession, folder: str) -> DataFrame:
    return SC.convergence_plateau(curves(spark, folder))


# selectors as runs: hit rates, coverage and the trade-off
part("mask_run", "mask_steps labels cand names", """
SELECT s.run, s.seed, avg(CASE WHEN l.is_promising THEN 1.0 ELSE 0.0 END) AS topm_hit_rate,
       count(DISTINCT s.asset) / (SELECT max(n) FROM names) AS asset_coverage, max(c.candidate_hit_rate) AS candidate_hit_rate,
       avg(reward) / (stddev_samp(reward) + 1e-8) AS sharpe_ratio, sum(reward) AS cumulative_return
FROM mask_steps s LEFT JOIN labels l ON l.dt = s.dt AND l.asset = s.asset JOIN cand c ON c.selector = s.run AND c.seed = s.seed GROUP BY s.run, s.seed""")


def mask_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Stored rows (run, seed, metrics) of the selector runs."""
    f, _, masks = _mask_inputs(spark, folder)
    labels = cut(st.labels(f))
    metrics = SC.run_metrics(st.selector_steps(f, masks), labels, f)
    cand = SC.candidate_hit_rate(masks, labels, st.episodes(f)).select(
        F.col("selector").alias("run"), "seed", "candidate_hit_rate"
    )
    return cut(metrics.join(cand, ["run", "seed"]))


part("trade", "mask_run", f"""
SELECT *, topm_hit_rate / greatest(asset_coverage, 1e-8) AS precision_per_visited, least(1.0, candidate_hit_rate * ({st.TOP} / 5.0)) AS recall_proxy FROM mask_run""")
TRADE = ("asset_coverage", "topm_hit_rate", "precision_per_visited", "recall_proxy")


@query("tradeoff", "trade", "\nUNION ALL ".join(
    f"SELECT run, '{m}' AS metric, round(avg({m}), 9) + 0.0 AS mean, round(coalesce(stddev_samp({m}), 0), 9) + 0.0 AS sd, count(*) AS n FROM trade GROUP BY run"
    for m in TRADE))
def tradeoff(spark: SparkSession, folder: str) -> DataFrame:
    rows = SC.tradeoff(mask_runs(spark, folder), st.TOP, 5)
    return out(SC.tradeoff_summary(rows), ["run", "metric", "n"], "mean", "sd", digits=9)


# information ----------------------------------------------------------------------


def mi_sql(keys: str, source: str) -> str:
    cells = (("n11", "n1", "m1"), ("n1 - n11", "n1", "n - m1"), ("m1 - n11", "n - n1", "m1"), ("n - n1 - m1 + n11", "n - n1", "n - m1"))
    terms = " + ".join(f"CASE WHEN {b} > 0 THEN ({b}) / n * ln(({b}) * n / (({x}) * CAST({y} AS DOUBLE))) ELSE 0 END" for b, x, y in cells)
    filled = " + ".join(f"CASE WHEN {b} > 0 THEN 1 ELSE 0 END" for b, _, _ in cells)
    return f"""
SELECT {keys}, {terms} + greatest({filled} - 3, 0) / (2.0 * n) AS mi, CAST(n AS BIGINT) AS n_pairs FROM (
  SELECT {keys}, CAST(count(*) AS DOUBLE) AS n, sum(x) AS n1, sum(y) AS m1, sum(x * y) AS n11 FROM {source} GROUP BY {keys})"""


part("step_cells", "masks episodes labels", """
SELECT v.selector, v.seed, l.asset, v.t, CASE WHEN m.asset IS NULL THEN 0 ELSE 1 END AS x, CASE WHEN l.is_promising THEN 1 ELSE 0 END AS y
FROM (SELECT k.selector, e.seed, e.dt, e.t FROM episodes e JOIN (SELECT DISTINCT selector, seed, dt FROM masks) k ON k.seed = e.seed AND k.dt = e.dt) v
JOIN labels l ON l.dt = v.dt LEFT JOIN masks m ON m.selector = v.selector AND m.seed = v.seed AND m.dt = v.dt AND m.asset = l.asset""")
part("mi", "step_cells", mi_sql("selector", "step_cells"))
part("mi_seed", "step_cells", mi_sql("selector, seed", "step_cells"))


@query("mutual_information", "mi", "SELECT selector, round(mi, 9) + 0.0 AS mi, n_pairs FROM mi")
def mutual_information(spark: SparkSession, folder: str) -> DataFrame:
    f, _, masks = _mask_inputs(spark, folder)
    return out(I.mutual_information(masks, st.labels(f), st.episodes(f)), ["selector", "n_pairs"], "mi", digits=9)


N_PERM = 1000
_off = draw_sql("'offset'", "i")
part("off_all", "masks episodes labels cal", f"""
SELECT selector, off, {mi_sql('selector, off', '(x)').split('FROM (')[0].replace('SELECT selector, off, ', '').replace(' AS mi, CAST(n AS BIGINT) AS n_pairs ', '')} AS mi FROM (
  SELECT m1.selector, m1.off, CAST(m1.n AS DOUBLE) AS n, m1.m1, n1.n1, coalesce(n11.n11, 0) AS n11 FROM (
    SELECT v.selector, o.off, sum(v.c * p.g) AS m1, sum(v.c) * (SELECT count(DISTINCT asset) FROM labels) AS n
    FROM (SELECT k.selector, e.t, count(*) AS c FROM episodes e JOIN (SELECT DISTINCT selector, seed, dt FROM masks) k ON k.seed = e.seed AND k.dt = e.dt GROUP BY 1, 2) v
    CROSS JOIN (SELECT DISTINCT off FROM offsets) o JOIN (SELECT t, sum(CASE WHEN is_promising THEN 1 ELSE 0 END) AS g FROM labels GROUP BY t) p
      ON p.t = (v.t + o.off) % (SELECT count(*) FROM cal) GROUP BY 1, 2) m1
  JOIN (SELECT selector, sum(c) AS n1 FROM mask_cell GROUP BY selector) n1 ON n1.selector = m1.selector
  LEFT JOIN (SELECT c.selector, o.off, sum(c.c) AS n11 FROM mask_cell c CROSS JOIN (SELECT DISTINCT off FROM offsets) o
    JOIN labels l ON l.asset = c.asset AND l.t = (c.t + o.off) % (SELECT count(*) FROM cal) WHERE l.is_promising GROUP BY 1, 2) n11
    ON n11.selector = m1.selector AND n11.off = m1.off)""")
part("mask_cell", "masks episodes", """
SELECT m.selector, e.t, m.asset, count(*) AS c FROM masks m JOIN episodes e ON e.seed = m.seed AND e.dt = m.dt GROUP BY 1, 2, 3""")
part("draws_off", "cal", f"""
SELECT i, CAST({st.HORIZON + 1} + floor({_off} * ((SELECT count(*) FROM cal) - {2 * st.HORIZON + 2})) AS INTEGER) AS off FROM (SELECT unnest(range(0, {N_PERM})) AS i)""")
part("offsets", "draws_off", "SELECT off FROM draws_off UNION SELECT 0")
from paneltide.plans import sqltext as _sq  # noqa: E402

_sq.PARTS["off_all"] = (("masks", "episodes", "labels", "cal", "mask_cell", "offsets"), _sq.PARTS["off_all"][1])


@query("mi_permutation", "off_all draws_off", """
SELECT o.selector, round(max(z.mi), 9) + 0.0 AS mi, round(avg(o.mi), 9) + 0.0 AS null_mean,
       round(avg(CASE WHEN round(o.mi, 12) >= round(z.mi, 12) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS p, count(*) AS n_perm
FROM draws_off d JOIN off_all o ON o.off = d.off JOIN off_all z ON z.selector = o.selector AND z.off = 0 GROUP BY o.selector""")
def mi_permutation(spark: SparkSession, folder: str) -> DataFrame:
    f, _, masks = _mask_inputs(spark, folder)
    n = SP.calendar(f).count()
    by = cut(I.mi_by_offset(masks, st.labels(f), st.episodes(f), n))
    rows = I.mi_permutation(by, n, st.HORIZON, N_PERM)
    return rows.select("selector", tidy("mi", 9).alias("mi"), tidy("null_mean", 9).alias("null_mean"), tidy("p").alias("p"), "n_perm")


part("mi_by_seed", "mi_seed", "SELECT selector, seed, round(mi, 12) AS d FROM mi_seed")
boot_parts("mi_boot", "mi_by_seed", "selector", 5000)


@query("mi_seed_ci", "mi_boot mi_by_seed", """
SELECT selector, round(avg(d), 9) + 0.0 AS mean, max(lo) AS ci_lo, max(hi) AS ci_hi FROM mi_by_seed
JOIN (SELECT selector, round(quantile_cont(boot, 0.025), 9) + 0.0 AS lo, round(quantile_cont(boot, 0.975), 9) + 0.0 AS hi FROM mi_boot GROUP BY selector) USING (selector) GROUP BY selector""")
def mi_seed_ci(spark: SparkSession, folder: str) -> DataFrame:
    f, _, masks = _mask_inputs(spark, folder)
    per_seed = cut(
        I.mutual_information(masks, st.labels(f), st.episodes(f), ["selector", "seed"]).withColumn("d", F.round("mi", 12))
    )
    ci = RS.bootstrap_mean(per_seed, ["selector"], "seed", "d", 5000).groupBy("selector").agg(
        F.percentile("boot", 0.025).alias("ci_lo"), F.percentile("boot", 0.975).alias("ci_hi")
    )
    mean = per_seed.groupBy("selector").agg(F.avg("d").alias("mean"))
    return out(mean.join(ci, "selector"), ["selector"], "mean", "ci_lo", "ci_hi", digits=9)


# series and deflated ratios -----------------------------------------------------------

part("moments", "series", """
SELECT name, n, mean, sd, mean / (sd + 1e-12) AS sharpe, m3 / power(m2, 1.5) AS skew, m4 / (m2 * m2) AS kurt FROM (
  SELECT s.name, count(*) AS n, max(a.mean) AS mean, max(a.sd) AS sd, avg(power(x - a.mean, 2)) AS m2, avg(power(x - a.mean, 3)) AS m3, avg(power(x - a.mean, 4)) AS m4
  FROM series s JOIN (SELECT name, avg(x) AS mean, stddev_samp(x) AS sd FROM series GROUP BY name) a ON a.name = s.name GROUP BY s.name)""")


@query("series_moments", "moments", f"SELECT name, n, {rnd('mean', 'sd', 'sharpe', 'skew', 'kurt')} FROM moments")
def series_moments(spark: SparkSession, folder: str) -> DataFrame:
    return out(I.series_moments(series_rows(spark, folder)), ["name", "n"], "mean", "sd", "sharpe", "skew", "kurt")


N_SB = 5000
_re, _stt = draw_sql("'restart'", "len", "b", "t"), draw_sql("'start'", "len", "b", "t")
part("sb_path", "series", f"""
SELECT name, b, t, len, CASE WHEN t = 0 OR {_re} < 1.0 / 20 THEN CAST(floor({_stt} * len) AS INTEGER) END AS p,
       CASE WHEN t = 0 OR {_re} < 1.0 / 20 THEN t END AS s FROM (
  SELECT name, len, b, unnest(range(0, len)) AS t FROM (SELECT name, len, unnest(range(0, {N_SB})) AS b FROM (SELECT name, CAST(count(*) AS INTEGER) AS len FROM series GROUP BY name)))""")
part("sb", "sb_path series", """
SELECT m.name, m.b, avg(x) / (stddev_samp(x) + 1e-12) AS sharpe FROM (
  SELECT name, b, (last_value(p IGNORE NULLS) OVER w + t - last_value(s IGNORE NULLS) OVER w) % len AS t FROM sb_path
  WINDOW w AS (PARTITION BY name, b ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) m
JOIN series s ON s.name = m.name AND s.t = m.t GROUP BY m.name, m.b""")


@query("stationary_bootstrap", "sb", """
SELECT name, round(quantile_cont(sharpe, 0.025), 6) + 0.0 AS ci_lo, round(quantile_cont(sharpe, 0.975), 6) + 0.0 AS ci_hi, count(*) AS n_boot FROM sb GROUP BY name""")
def stationary_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    boots = RS.stationary_bootstrap(series_rows(spark, folder), N_SB)
    rows = boots.groupBy("name").agg(
        F.percentile("sharpe", 0.025).alias("ci_lo"), F.percentile("sharpe", 0.975).alias("ci_hi"), F.count("*").alias("n_boot")
    )
    return out(rows, ["name", "n_boot"], "ci_lo", "ci_hi")


part("strategy_run", "dropped", "SELECT run, seed, avg(reward) / (stddev_samp(reward) + 1e-8) AS sharpe FROM dropped GROUP BY run, seed")
part("trials", "strategy_run mask_run", """
SELECT family, configuration, avg(sharpe) AS sharpe, count(*) AS n_seeds FROM (
  SELECT 'strategy' AS family, run AS configuration, sharpe FROM strategy_run
  UNION ALL SELECT CASE WHEN run LIKE 'sticky%' THEN 'sticky' ELSE 'selector' END, run, sharpe_ratio FROM mask_run) GROUP BY 1, 2""")


def trials(spark: SparkSession, folder: str) -> DataFrame:
    f, _, masks = _mask_inputs(spark, folder)
    strategies = SC.sharpe(st.strategy_steps(f)).select(
        F.lit("strategy").alias("family"), F.col("run").alias("configuration"), "seed", F.col("sharpe_ratio").alias("sharpe")
    )
    selectors = SC.sharpe(st.selector_steps(f, masks)).select(
        F.when(F.col("run").startswith("sticky"), "sticky").otherwise("selector").alias("family"),
        F.col("run").alias("configuration"), "seed", F.col("sharpe_ratio").alias("sharpe"),
    )
    return I.trial_family([strategies, selectors])


@query("trial_family", "trials", "SELECT family, configuration, n_seeds, round(sharpe, 6) + 0.0 AS sharpe FROM trials")
def trial_family(spark: SparkSession, folder: str) -> DataFrame:
    return out(trials(spark, folder), ["family", "configuration", "n_seeds"], "sharpe")


@query("family_quartiles", "trials", """
SELECT family, count(*) AS n_trials, round(quantile_cont(sharpe, 0.25), 6) + 0.0 AS q1, round(quantile_cont(sharpe, 0.5), 6) + 0.0 AS median,
       round(quantile_cont(sharpe, 0.75), 6) + 0.0 AS q3 FROM trials GROUP BY family""")
def family_quartiles(spark: SparkSession, folder: str) -> DataFrame:
    return out(I.family_quartiles(trials(spark, folder)), ["family", "n_trials"], "q1", "median", "q3")


GAMMA, E = 0.5772156649015329, 2.718281828459045
part("spreads", "trials", """
SELECT 'candidate' AS spread, stddev_samp(sharpe) AS sd, CAST(count(*) AS DOUBLE) AS most FROM trials
UNION ALL SELECT 'original', stddev_samp(sharpe), CAST(count(*) AS DOUBLE) FROM trials WHERE family = 'strategy'""")
part("trial_counts", "spreads", "SELECT DISTINCT CAST(k AS DOUBLE) AS k FROM (SELECT unnest(range(2, CAST(most AS BIGINT) + 1)) AS k FROM spreads UNION ALL SELECT 39)")
norm_quantile_part("q_k", f"SELECT 1 - 1 / k AS p FROM trial_counts UNION SELECT 1 - 1 / (k * {E}) FROM trial_counts", "trial_counts")
part("best_of", "trial_counts q_k", f"""
SELECT k, {1 - GAMMA} * a.q + {GAMMA} * b.q AS z FROM trial_counts JOIN q_k a ON a.p = 1 - 1 / k JOIN q_k b ON b.p = 1 - 1 / (k * {E})""")
part("own_var", "moments", "SELECT name, n, sharpe, 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe AS v FROM moments")
DSR_SQL = norm_cdf_sql("least(9.0, greatest(-9.0, (sharpe - sr_star) * sqrt(n - 1) / sqrt(greatest(v, 1e-12))))")


@query("expected_max_sharpe", "own_var best_of spreads", """
SELECT name, 'sampling' AS spread, k, round(sharpe, 6) + 0.0 AS sharpe, round(sqrt(greatest(v / (n - 1), 0)) * z, 6) + 0.0 AS sr_star FROM own_var, best_of WHERE k = 39
UNION ALL SELECT name, 'trials', k, round(sharpe, 6) + 0.0, round(sd * z, 6) + 0.0 FROM own_var, spreads JOIN best_of ON k = most WHERE spread = 'candidate'""")
def expected_max_sharpe(spark: SparkSession, folder: str) -> DataFrame:
    m = I.series_moments(series_rows(spark, folder))
    own = I.expected_max_sharpe(m, 39).withColumn("spread", F.lit("sampling"))
    family = I.expected_max_sharpe(m, 0, cut(trials(spark, folder))).withColumn("spread", F.lit("trials"))
    return out(own.unionByName(family), ["name", "spread", "k"], "sharpe", "sr_star")


def trial_families(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All trials, and the family the strategies were first chosen from."""
    every = cut(trials(spark, folder))
    return {"candidate": every, "original": every.where("family = 'strategy'")}


@query("deflated_sharpe", "own_var best_of spreads", f"""
SELECT name, spread, k, round(sharpe, 6) + 0.0 AS sharpe, round(sr_star, 6) + 0.0 AS sr_star, round({DSR_SQL}, 6) + 0.0 AS dsr
FROM (SELECT name, spread, k, sharpe, n, v, sd * z AS sr_star FROM own_var, spreads JOIN best_of ON k = most)""")
def deflated_sharpe(spark: SparkSession, folder: str) -> DataFrame:
    """Deflated by the spread and the number of trials of each family."""
    m = cut(I.series_moments(series_rows(spark, folder)))
    rows = [
        I.deflated_sharpe(I.expected_max_sharpe(m, 0, family)).withColumn("spread", F.lit(name))
        for name, family in trial_families(spark, folder).items()
    ]
    return out(reduce(DataFrame.unionByName, rows), ["name", "spread", "k"], "sharpe", "sr_star", "dsr")


part("dsr_rows", "own_var best_of spreads", f"""
SELECT *, {DSR_SQL} AS dsr FROM (SELECT name, spread, k, sharpe, n, v, sd * z AS sr_star FROM own_var, spreads JOIN best_of ON k <= most)""")


@query("dsr_k_sensitivity", "dsr_rows", """
SELECT name, spread, k, round(sr_star, 6) + 0.0 AS sr_star, round(dsr, 6) + 0.0 AS dsr, min(CASE WHEN dsr < 0.95 THEN k END) OVER (PARTITION BY name, spread) AS first_k FROM dsr_rows""")
def dsr_k_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    m = cut(I.series_moments(series_rows(spark, folder)))
    parts = [
        I.dsr_k_sensitivity(m, family).withColumn("spread", F.lit(name))
        for name, family in trial_families(spark, folder).items()
    ]
    rows = cut(reduce(DataFrame.unionByName, parts))
    joined = rows.join(I.first_k_below(rows), ["name", "spread"])
    return joined.select("name", "spread", "k", tidy("sr_star").alias("sr_star"), tidy("dsr").alias("dsr"), "first_k")
