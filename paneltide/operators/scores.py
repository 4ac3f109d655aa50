"""Evaluation of replayed steps and of candidate masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paneltide.operators.graph import DIGITS
from paneltide.operators.selectors import jaccard

RUN = ["run", "seed"]


def promising(panel: DataFrame, horizon: int = 5, share: float = 0.8, eps: float = 1e-8) -> DataFrame:
    """(dt, t, asset, g, is_promising), from returns AFTER ``dt``: for evaluation only.

    g is mean over deviation of the next ``horizon`` returns (deviation 0 for a
    horizon of one); an asset is promising when g reaches the interpolated
    percentile of its date, so ties can exceed the share. The last dates have
    no full horizon: g is NULL and nothing is promising.
    """
    ahead = Window.partitionBy("asset").orderBy("t").rowsBetween(1, horizon)
    sd = F.stddev_samp("return").over(ahead) if horizon > 1 else F.lit(0.0)
    g = F.when(
        F.count("return").over(ahead) == horizon, F.round(F.avg("return").over(ahead) / (sd + eps), DIGITS)
    )
    scored = panel.select("dt", "t", "asset", g.alias("g"))
    cut = scored.groupBy("dt").agg(F.round(F.percentile("g", share), DIGITS).alias("_cut"))
    return scored.join(cut, "dt").select(
        "dt", "t", "asset", "g", F.coalesce(F.col("g") >= F.col("_cut"), F.lit(False)).alias("is_promising")
    )


def cumulative_return(steps: DataFrame) -> DataFrame:
    return steps.groupBy(*RUN).agg(F.sum("reward").alias("cumulative_return"))


def mean_reward(steps: DataFrame) -> DataFrame:
    """Mean over episodes of the summed reward."""
    return (
        steps.groupBy(*RUN, "episode")
        .agg(F.sum("reward").alias("_r"))
        .groupBy(*RUN)
        .agg(F.avg("_r").alias("mean_reward"), F.count("*").alias("n_episodes"))
    )


def sharpe_of(value: str, eps: float = 1e-8) -> Column:
    """Per-step mean over sample deviation; 0 with fewer than two steps."""
    return F.when(
        F.count(value) >= 2, F.avg(value) / (F.stddev_samp(value) + eps)
    ).otherwise(F.lit(0.0))


def sharpe(steps: DataFrame) -> DataFrame:
    return steps.groupBy(*RUN).agg(sharpe_of("reward").alias("sharpe_ratio"))


def drawdowns(steps: DataFrame) -> DataFrame:
    """Adds ``drop``: how far the summed reward is below its running maximum."""
    order = Window.partitionBy(*RUN).orderBy("episode", "step").rowsBetween(Window.unboundedPreceding, 0)
    cum = steps.withColumn("_cum", F.sum("reward").over(order))
    return cum.withColumn("drop", F.max("_cum").over(order) - F.col("_cum")).drop("_cum")


def max_drawdown(steps: DataFrame) -> DataFrame:
    return drawdowns(steps).groupBy(*RUN).agg(F.max("drop").alias("max_drawdown"))


def asset_coverage(steps: DataFrame, panel: DataFrame) -> DataFrame:
    n = panel.agg(F.count_distinct("asset")).scalar()
    return steps.groupBy(*RUN).agg((F.count_distinct("asset") / n).alias("asset_coverage"))


def mark_hits(steps: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``hit``: the chosen asset is promising."""
    good = labels.select("dt", "asset", "is_promising")
    return steps.join(good, ["dt", "asset"], "left").withColumn(
        "hit", F.coalesce("is_promising", F.lit(False))
    ).drop("is_promising")


def topm_hit_rate(steps: DataFrame, labels: DataFrame) -> DataFrame:
    return mark_hits(steps, labels).groupBy(*RUN).agg(
        F.avg(F.col("hit").cast("double")).alias("topm_hit_rate")
    )


def mask_hits(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(selector, seed, dt, hit, share, evaluable) per mask."""
    good = labels.select("dt", "asset", "is_promising", F.col("g").isNotNull().alias("_known"))
    return (
        masks.join(good, ["dt", "asset"])
        .groupBy("selector", "seed", "dt")
        .agg(
            F.bool_or("is_promising").alias("hit"),
            F.avg(F.col("is_promising").cast("double")).alias("share"),
            F.bool_and("_known").alias("evaluable"),
        )
    )


def candidate_hit_rate(masks: DataFrame, labels: DataFrame, episodes: DataFrame) -> DataFrame:
    """Share of visited dates whose mask contains a promising asset.

    ``candidate_hit_rate`` counts every step, ``candidate_hit_evaluable`` only
    the steps with a full horizon ahead.
    """
    visits = episodes.join(mask_hits(masks, labels), ["seed", "dt"])
    hit = F.col("hit").cast("double")
    return visits.groupBy("selector", "seed").agg(
        F.avg(hit).alias("candidate_hit_rate"),
        F.avg(F.when(F.col("evaluable"), hit)).alias("candidate_hit_evaluable"),
        F.sum(F.col("evaluable").cast("int")).alias("n_evaluable"),
    )


def step_number(steps: DataFrame) -> DataFrame:
    """Adds ``n``, the 1-based step number over the whole run."""
    order = Window.partitionBy(*RUN).orderBy("episode", "step")
    return steps.withColumn("n", F.row_number().over(order))


def time_to_first(steps: DataFrame, labels: DataFrame) -> DataFrame:
    """The first step with a promising asset; NULL when there is none."""
    return mark_hits(step_number(steps), labels).groupBy(*RUN).agg(
        F.min(F.when(F.col("hit"), F.col("n"))).alias("time_to_first")
    )


def mean_latency(events: DataFrame, key: list[str], value: str) -> DataFrame:
    return events.groupBy(*key).agg(F.avg(value).alias("mean_latency_ms"))


def run_metrics(steps: DataFrame, labels: DataFrame, panel: DataFrame) -> DataFrame:
    """The whole metric row per run; the deviation of rewards is taken over the steps themselves."""
    assets = panel.agg(F.count_distinct("asset")).scalar()
    whole = mark_hits(drawdowns(step_number(steps)), labels)
    per_episode = whole.groupBy(*RUN, "episode").agg(
        F.sum("reward").alias("_r"),
        F.count("*").alias("_n"),
        F.max("drop").alias("_drop"),
        F.collect_set("asset").alias("_assets"),
        F.sum(F.col("hit").cast("double")).alias("_hits"),
        F.min(F.when(F.col("hit"), F.col("n"))).alias("_first"),
    )
    n = F.sum("_n")
    mean = F.sum("_r") / n
    spread = steps.groupBy(*RUN).agg(F.stddev_samp("reward").alias("_sd"))
    sd = F.max("_sd")
    return per_episode.join(spread, RUN).groupBy(*RUN).agg(
        F.sum("_r").alias("cumulative_return"),
        F.when(n >= 2, mean / (sd + 1e-8)).otherwise(0.0).alias("sharpe_ratio"),
        F.max("_drop").alias("max_drawdown"),
        F.avg("_r").alias("mean_reward"),
        F.count("*").alias("n_episodes"),
        n.alias("n_steps"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("_assets")))) / assets).alias("asset_coverage"),
        (F.sum("_hits") / n).alias("topm_hit_rate"),
        F.min("_first").alias("time_to_first"),
    )


def precision_at_m(masks: DataFrame, labels: DataFrame, episodes: DataFrame) -> DataFrame:
    """Mean share of a mask that is promising, over evaluable steps."""
    visits = episodes.join(mask_hits(masks, labels).where("evaluable"), ["seed", "dt"])
    return visits.groupBy("selector", "seed").agg(
        F.avg("share").alias("precision_at_m"), F.count("*").alias("n_steps")
    )


def ndcg_at_m(rankings: DataFrame, labels: DataFrame, episodes: DataFrame, m: int = 3) -> DataFrame:
    """Mean discounted gain of a full ranking over the best possible one.

    Gains are max(g, 0) of the neighbourhood; dates without any gain and
    dates without a full horizon are left out.
    """
    gained = rankings.join(labels.where(F.col("g").isNotNull()).select("dt", "asset", "g"), ["dt", "asset"])
    key = ["selector", "seed", "dt"]
    ideal = Window.partitionBy(*key).orderBy(F.desc("rel"), "asset")
    rows = gained.withColumn("rel", F.greatest("g", F.lit(0.0))).withColumn(
        "_best", F.row_number().over(ideal)
    )

    def gain(pos):
        return F.sum(F.when(F.col(pos) <= m, F.col("rel") / F.log2(F.col(pos) + 1.0)).otherwise(0.0))

    per_date = (
        rows.groupBy(*key)
        .agg(gain("rank").alias("_dcg"), gain("_best").alias("_idcg"))
        .where(F.col("_idcg") > 0)
        .select(*key, (F.col("_dcg") / F.col("_idcg")).alias("ndcg"))
    )
    return (
        episodes.join(per_date, ["seed", "dt"])
        .groupBy("selector", "seed")
        .agg(F.avg("ndcg").alias("ndcg_at_m"), F.count("*").alias("n_steps"))
    )


def mask_changes(masks: DataFrame, episodes: DataFrame) -> DataFrame:
    """(selector, seed, episode, step, dt, change): distance from the mask one step before."""
    sets = masks.groupBy("selector", "seed", "dt").agg(F.collect_set("asset").alias("_m"))
    visits = episodes.join(sets, ["seed", "dt"])
    order = Window.partitionBy("selector", "seed", "episode").orderBy("step")
    before = visits.withColumn("_p", F.lag("_m").over(order)).where(F.col("_p").isNotNull())
    return before.select(
        "selector", "seed", "episode", "step", "dt", (1.0 - jaccard("_p", "_m")).alias("change")
    )


def evaluable_masks(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """The masks of steps whose outcome is known."""
    known = mask_hits(masks, labels).where("evaluable").select("selector", "seed", "dt")
    return masks.join(known, ["selector", "seed", "dt"], "left_semi")


def turnover(masks: DataFrame, episodes: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Mean mask change per selector and seed; with ``labels`` over evaluable steps only."""
    used = masks if labels is None else evaluable_masks(masks, labels)
    return mask_changes(used, episodes).groupBy("selector", "seed").agg(
        F.avg("change").alias("turnover"), F.count("*").alias("n")
    )


def hit_by_turnover_tercile(
    masks: DataFrame, labels: DataFrame, episodes: DataFrame, least: int = 30
) -> DataFrame:
    """Mean hit in the low, middle and high third of mask changes.

    Cuts are the interpolated 33.3 and 66.7 percentiles per selector. Selectors
    with fewer than ``least`` steps keep their rows, with n and a NULL rate. A
    change takes few distinct values, so the cuts are computed from value counts.
    """
    hits = mask_hits(masks, labels).where("evaluable").select("selector", "seed", "dt", "hit")
    valid = masks.join(hits.select("selector", "seed", "dt"), ["selector", "seed", "dt"], "left_semi")
    changes = mask_changes(valid, episodes).withColumn("change", F.round("change", DIGITS))
    rows = changes.join(hits, ["selector", "seed", "dt"])
    counts = rows.groupBy("selector", "change").agg(
        F.count("*").alias("_n"), F.sum(F.col("hit").cast("double")).alias("_h")
    )
    cuts = counts.groupBy("selector").agg(
        F.percentile("change", 0.333, F.col("_n")).alias("_t1"),
        F.percentile("change", 0.667, F.col("_n")).alias("_t2"),
        F.sum("_n").alias("n_steps"),
    )
    third = (
        F.when(F.col("change") <= F.col("_t1"), "low")
        .when(F.col("change") <= F.col("_t2"), "mid")
        .otherwise("high")
    )
    return (
        counts.join(cuts, "selector")
        .groupBy("selector", third.alias("third"))
        .agg(
            F.when(F.max("n_steps") >= least, F.sum("_h") / F.sum("_n")).alias("hit_rate"),
            F.sum("_n").alias("n"),
        )
    )


def fallback_summary(events: DataFrame) -> DataFrame:
    """Counts and hit rates over all, valid and fallback steps per run.

    ``events`` has (run, seed, fallback, hit). ``all = f * fb + (1 - f) * valid``.
    """
    hit = F.col("hit").cast("double")
    fb = F.col("fallback")
    return events.groupBy(*RUN).agg(
        F.count("*").alias("n_steps"),
        F.sum(fb.cast("int")).alias("n_fallback"),
        F.avg(fb.cast("double")).alias("share_fallback"),
        F.avg(hit).alias("hit_all"),
        F.avg(F.when(~fb, hit)).alias("hit_valid"),
        F.avg(F.when(fb, hit)).alias("hit_fallback"),
    )


def fallback_identity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Whether two arms fell back on exactly the same keys."""
    a = left.exceptAll(right).agg(F.count("*").alias("only_left"))
    only_right = right.exceptAll(left).agg(F.count("*")).scalar()
    return a.withColumn("only_right", only_right).withColumn(
        "identical", (F.col("only_left") == 0) & (F.col("only_right") == 0)
    )


def _curve(curves: DataFrame, window: int) -> DataFrame:
    """Adds the position, curve length and forward window statistics."""
    order = Window.partitionBy("run").orderBy("i")
    ahead = order.rowsBetween(0, window - 1)
    return curves.select(
        "run",
        (F.row_number().over(order) - 1).alias("i"),
        "value",
        F.count("*").over(Window.partitionBy("run")).alias("_size"),
        F.avg("value").over(ahead).alias("_mean"),
        F.stddev_pop("value").over(ahead).alias("_sd"),
        F.count("*").over(ahead).alias("_have"),
    )


def convergence_final(
    curves: DataFrame, window: int = 3, last: int = 3, tol_rel: float = 0.05, tol_abs: float = 1e-3
) -> DataFrame:
    """First 1-based window whose mean is close to the mean of the last values.

    The last full window is not tested; NULL when nothing qualifies or the
    curve is shorter than both windows. ``curves`` has (run, i, value).
    """
    c = _curve(curves, window)
    final = F.avg(F.when(F.col("i") >= F.col("_size") - last, F.col("value"))).over(Window.partitionBy("run"))
    ok = (
        (F.abs(F.col("_mean") - F.col("_final")) < F.abs("_final") * tol_rel + tol_abs)
        & (F.col("i") < F.col("_size") - window)
        & (F.col("_size") >= window + last)
    )
    return c.withColumn("_final", final).groupBy("run").agg(
        F.min(F.when(ok, F.col("i") + 1)).alias("converged")
    )


def convergence_stability(
    curves: DataFrame, window: int = 3, tol: float = 0.05, eps: float = 1e-8
) -> DataFrame:
    """First window whose deviation is small against its mean."""
    ratio = F.col("_sd") / F.greatest(F.abs("_mean"), F.lit(eps))
    ok = (ratio < tol) & (F.col("i") < F.col("_size") - window) & (F.col("_size") >= window + 1)
    return _curve(curves, window).groupBy("run").agg(
        F.min(F.when(ok, F.col("i") + 1)).alias("converged")
    )


def convergence_plateau(curves: DataFrame, window: int = 3, tol: float = 0.01) -> DataFrame:
    """First position from the peak of the moving mean on with a flat local slope.

    The slope is fitted over the next ``window`` moving means and taken against
    the mean of all of them.
    """
    moving = _curve(curves, window).where(F.col("_have") == window)
    order = Window.partitionBy("run").orderBy("i")
    run = Window.partitionBy("run")
    m = moving.select(
        "run",
        "i",
        "_size",
        F.col("_mean").alias("m"),
        F.count("*").over(run).alias("_points"),
        F.min_by("i", F.struct((-F.round("_mean", DIGITS)).alias("nm"), "i")).over(run).alias("_peak"),
        F.avg("_mean").over(run).alias("_level"),
        F.regr_slope("_mean", F.col("i").cast("double")).over(order.rowsBetween(0, window - 1)).alias("_slope"),
    )
    ok = (
        (F.col("i") >= F.col("_peak"))
        & (F.col("i") < F.col("_points") - window)
        & (F.abs("_slope") / F.greatest(F.abs("_level"), F.lit(1e-8)) < tol)
        & (F.col("_size") >= 2 * window)
    )
    found = m.groupBy("run").agg(F.min(F.when(ok, F.col("i") + 1)).alias("converged"))
    return curves.select("run").distinct().join(found, "run", "left")


def tradeoff(runs: DataFrame, m: int, n_promising: int) -> DataFrame:
    """Adds precision per visited asset and the recall proxy."""
    return runs.withColumn(
        "precision_per_visited", F.col("topm_hit_rate") / F.greatest("asset_coverage", F.lit(1e-8))
    ).withColumn(
        "recall_proxy",
        F.when(
            F.col("candidate_hit_rate").isNotNull(),
            F.least(F.lit(1.0), F.col("candidate_hit_rate") * (m / n_promising)),
        ),
    )


def tradeoff_summary(runs: DataFrame, by: str = "run") -> DataFrame:
    """Mean, deviation (0 for a single run) and count per model and metric."""
    names = ("asset_coverage", "topm_hit_rate", "precision_per_visited", "recall_proxy")
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    return (
        runs.select(by, F.expr(f"stack({len(names)}, {pairs}) as (metric, value)"))
        .where(F.col("value").isNotNull())
        .groupBy(by, "metric")
        .agg(
            F.avg("value").alias("mean"),
            F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"),
            F.count("*").alias("n"),
        )
    )
