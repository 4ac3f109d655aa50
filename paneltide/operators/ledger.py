"""Comparing arms of an experiment ledger: (arm, seed, metric, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paneltide.functions.dist import norm_quantile, t_cdf, t_quantile, wilcoxon_p
from paneltide.operators.graph import DIGITS
from paneltide.operators.resample import bootstrap_p, indexed, paired_bootstrap
from paneltide.functions.draws import draw, draw_int
from paneltide.session import cut

Contrast = tuple[str, str, str]  # name, left arm, right arm


def metrics_long(wide: DataFrame, metrics: tuple[str, ...], keys: tuple[str, ...] = ("arm", "seed")) -> DataFrame:
    return wide.unpivot(list(keys), list(metrics), "metric", "value")


def all_contrasts(arms: list[str]) -> list[Contrast]:
    names = sorted(arms)
    return [(f"{b}-{a}", b, a) for i, a in enumerate(names) for b in names[i + 1 :]]


def paired_diff(long: DataFrame, contrasts: list[Contrast] | None = None) -> DataFrame:
    """(contrast, metric, seed, d): left minus right on the seeds both have.

    Without a list, every arm is compared with every arm of a smaller name; a (metric, seed)
    has a row per arm, so the join makes as many rows as there are differences. It is sorted on both
    sides: a stored ledger packs so well that its size would have it broadcast, unpacked, by the driver.
    """
    right = long.select(F.col("arm").alias("_right"), "metric", "seed", F.col("value").alias("_r")).hint("merge")
    if contrasts is None:
        left = long.select("arm", "metric", "seed", F.col("value").alias("_l"))
        joined = left.join(right, ["metric", "seed"]).where(F.col("_right") < F.col("arm")).withColumn("contrast", F.concat_ws("-", "arm", "_right"))
    else:
        spec = F.array(
            *[F.struct(F.lit(c).alias("contrast"), F.lit(a).alias("left"), F.lit(b).alias("right")) for c, a, b in contrasts]
        )
        left = (
            long.withColumn("_c", F.explode(spec))
            .where(F.col("arm") == F.col("_c.left"))
            .select(
                F.col("_c.contrast").alias("contrast"), F.col("_c.right").alias("_right"), "metric", "seed", F.col("value").alias("_l")
            )
        )
        joined = left.join(right, ["_right", "metric", "seed"])
    return joined.select("contrast", "metric", "seed", F.round(F.col("_l") - F.col("_r"), DIGITS).alias("d")).where(
        F.col("d").isNotNull() & ~F.isnan("d")
    )


CM = ["contrast", "metric"]


def with_corrections(rows: DataFrame, p: str = "p", family: list[str] | None = None) -> DataFrame:
    """Adds Bonferroni, Holm and Benjamini-Hochberg values; NULL p are not counted.

    ``family`` names the columns within which the tests are counted together.
    """
    keys = family or []
    if not keys:
        rows = rows.withColumn("_family", F.lit(0))
        keys = ["_family"]
    known = F.col(p).isNotNull()
    part = Window.partitionBy(*keys, F.col("_known"))
    tie = [c for c in rows.columns if c in ("contrast", "metric")]
    up = part.orderBy(F.col(p), *tie)
    down = part.orderBy(F.desc(p), *[F.desc(c) for c in tie])
    k, i = F.count("*").over(part), F.row_number().over(up)
    df = rows.withColumn("_known", known).withColumns({"_k": k, "_i": i})
    holm = F.max(F.least((F.col("_k") - F.col("_i") + 1) * F.col(p), F.lit(1.0))).over(
        up.rowsBetween(Window.unboundedPreceding, 0)
    )
    fdr = F.min(F.least(F.col("_k") * F.col(p) / F.col("_i"), F.lit(1.0))).over(
        down.rowsBetween(Window.unboundedPreceding, 0)
    )
    return df.withColumns(
        {
            "bonferroni": F.when(known, F.least(F.col("_k") * F.col(p), F.lit(1.0))),
            "holm": F.when(known, holm),
            "fdr_bh": F.when(known, fdr),
        }
    ).drop("_known", "_k", "_i", "_family")


def multi_metric_compare(long: DataFrame, contrasts: list[Contrast] | None = None, n_boot: int = 5000) -> DataFrame:
    """Every contrast and metric with corrected p values, in one plan."""
    rows = paired_bootstrap(paired_diff(long, contrasts), CM, n_boot)
    return with_corrections(rows, "p_two")


def _moments(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy(*CM).agg(
        F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), F.count("*").alias("n")
    ).where(F.col("n") >= 2).withColumn("se", F.col("sd") / F.sqrt("n")).withColumn(
        "df", (F.col("n") - 1).cast("double")
    )


def _ratio(num: Column) -> Column:
    return num / F.nullif(F.col("se"), F.lit(0.0))


def paired_t(diffs: DataFrame) -> DataFrame:
    """t, two-sided p and 95% interval of the mean difference."""
    m = _moments(diffs).withColumn("t", _ratio(F.col("mean")))
    m = m.withColumn("p", 2.0 * (1.0 - t_cdf(F.abs("t"), F.col("df"))))
    m = m.withColumn("_q", t_quantile(F.lit(0.975), F.col("df")))
    return m.select(
        *CM, "mean", "n", "t", "p",
        (F.col("mean") - F.col("_q") * F.col("se")).alias("ci_lo"),
        (F.col("mean") + F.col("_q") * F.col("se")).alias("ci_hi"),
    )


def signed_ranks(diffs: DataFrame, keys: list[str] = CM) -> DataFrame:
    """(keys, w_plus, w, n, ties, tied): sums of the ranks of |d|; zeros are dropped, ties averaged.

    ``tied`` has (twice the mean rank, size) of each group of ties.
    """
    size = diffs.withColumn("_a", F.round(F.abs("d"), DIGITS)).where(F.col("_a") > 0)
    by_size = Window.partitionBy(*keys).orderBy("_a")
    tied = Window.partitionBy(*keys, "_a")
    ranked = size.withColumns(
        {"_r": F.rank().over(by_size) + (F.count("*").over(tied) - 1) / 2.0, "_t": F.count("*").over(tied)}
    )
    return ranked.groupBy(*keys).agg(
        F.sum(F.when(F.col("d") > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"),
        F.least(
            F.sum(F.when(F.col("d") > 0, F.col("_r")).otherwise(0.0)),
            F.sum(F.when(F.col("d") < 0, F.col("_r")).otherwise(0.0)),
        ).alias("w"),
        F.count("*").cast("double").alias("n"),
        # each group of t ties has t rows, each adding t^2 - 1
        F.sum(F.col("_t") * F.col("_t") - 1.0).alias("ties"),
        F.sort_array(F.collect_set(F.when(F.col("_t") > 1, F.struct((2 * F.col("_r")).cast("int").alias("twice"), F.col("_t").cast("int").alias("size"))))).alias("tied"),
    )


def wilcoxon_signed_rank(diffs: DataFrame, keys: list[str] = CM) -> DataFrame:
    return signed_ranks(diffs, keys).withColumn("p", wilcoxon_p("w_plus", "n", "tied.twice", "tied.size", F.lit(0.0)))


def tost(diffs: DataFrame, margin: float | Column, alpha: float = 0.05) -> DataFrame:
    """Two one-sided t tests against -margin and +margin.

    Equivalent when the larger p is below alpha; the 1 - 2 alpha interval is
    then inside the margins.
    """
    m = _moments(diffs)
    delta = F.lit(margin) if not isinstance(margin, Column) else margin
    m = m.withColumn("margin", delta).withColumns(
        {"t_lower": _ratio(F.col("mean") + F.col("margin")), "t_upper": _ratio(F.col("mean") - F.col("margin"))}
    )
    return _tost_verdict(m, alpha)


def _tost_verdict(m: DataFrame, alpha: float) -> DataFrame:
    p_lower = 1.0 - t_cdf(F.col("t_lower"), F.col("df"))
    m = m.withColumns({"p_lower": p_lower, "p_upper": t_cdf(F.col("t_upper"), F.col("df"))})
    m = m.withColumns(
        {"p_tost": F.greatest("p_lower", "p_upper"), "_q": t_quantile(F.lit(1.0 - alpha), F.col("df"))}
    )
    return m.select(
        *CM, "margin", "mean", "n", "t_lower", "t_upper", "p_tost",
        (F.col("mean") - F.col("_q") * F.col("se")).alias("ci_lo"),
        (F.col("mean") + F.col("_q") * F.col("se")).alias("ci_hi"),
        (F.col("p_tost") < alpha).alias("equivalent"),
    )


def margin_sensitivity(diffs: DataFrame, factors: list[float], scale: Column, alpha: float = 0.05) -> DataFrame:
    """The same tests over a list of margins, each a factor of ``scale``."""
    m = _moments(diffs).withColumn("_f", F.explode(F.array(*[F.lit(float(x)) for x in factors])))
    m = m.withColumn("margin", F.col("_f") * scale).withColumns(
        {"t_lower": _ratio(F.col("mean") + F.col("margin")), "t_upper": _ratio(F.col("mean") - F.col("margin"))}
    )
    return _tost_verdict(m, alpha)


def tost_wilcoxon(diffs: DataFrame, margin: float | Column) -> DataFrame:
    """Signed ranks of d + margin (greater) and d - margin (less); a column gives a margin per metric."""
    by = F.lit(margin) if not isinstance(margin, Column) else margin
    shifted = diffs.withColumn(
        "_s",
        F.explode(F.array(F.struct(F.lit("lower").alias("side"), by.alias("by")),
                          F.struct(F.lit("upper").alias("side"), (-by).alias("by")))),
    ).select(*CM, "seed", F.col("_s.side").alias("side"), F.round(F.col("d") + F.col("_s.by"), DIGITS).alias("d"))
    ranks = signed_ranks(shifted, CM + ["side"])
    p = wilcoxon_p("w_plus", "n", "tied.twice", "tied.size", F.when(F.col("side") == "lower", 1.0).otherwise(-1.0))
    return ranks.withColumn("p", p).groupBy(*CM).agg(
        F.max(F.when(F.col("side") == "lower", F.col("w_plus"))).alias("w_lower"),
        F.max(F.when(F.col("side") == "upper", F.col("w_plus"))).alias("w_upper"),
        F.max("p").alias("p_tost"),
    )


def mde(diffs: DataFrame, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """Smallest detectable mean difference for the observed deviation and n."""
    m = _moments(diffs)
    q = t_quantile(F.lit(1 - alpha / 2), F.col("df")) + t_quantile(F.lit(power), F.col("df"))
    return m.select(*CM, "n", "se", (q * F.col("se")).alias("mde"))


def tost_sample_size(
    diffs: DataFrame, margin: float | Column, expected: float = 0.0, alpha: float = 0.05, power: float = 0.8
) -> DataFrame:
    """n = (z + z)^2 sd^2 / (margin - expected)^2, rounded up; a column gives a margin per metric."""
    z = norm_quantile(F.lit(1 - alpha)) + norm_quantile(F.lit(power))
    n = F.pow(z * F.col("sd") / (margin - expected), 2)
    return _moments(diffs).select(*CM, "sd", n.alias("n_exact"), F.ceil(n).alias("n_required"))


def crosscheck(diffs: DataFrame, n_boot: int = 5000) -> DataFrame:
    """Bootstrap, t and signed-rank p side by side per contrast and metric."""
    boot = paired_bootstrap(diffs, CM, n_boot).select(*CM, "mean", "n", F.col("p_two").alias("p_bootstrap"))
    t = paired_t(diffs).select(*CM, F.col("p").alias("p_t"))
    w = wilcoxon_signed_rank(diffs).select(*CM, F.col("p").alias("p_wilcoxon"))
    return boot.join(t, CM, "left").join(w, CM, "left")


def null_samples(diffs: DataFrame, sizes: tuple[int, ...], replicates: int) -> DataFrame:
    """(contrast, metric, size, r, seed, d): samples of each size under no effect.

    Values are drawn with replacement from the centred observed differences and get a
    random sign, so any size can be had from any number of differences and the mean is
    zero. The draws of a replicate are shared by all series of as many differences.
    """
    centre = Window.partitionBy(*CM)
    observed = indexed(diffs.withColumn("x", F.col("d") - F.avg("d").over(centre)), CM, "seed", "x")
    slots = (
        observed.select("n")
        .distinct()
        .withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))
        .withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
        .repartition("n", "size", "r")
        .withColumn("seed", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    )
    key = (F.col("size"), F.col("r"), F.col("seed"))
    drawn = slots.withColumns(
        {"j": draw_int(F.col("n"), "null", *key), "sign": F.when(draw("flip", *key) < 0.5, -1.0).otherwise(1.0)}
    )
    return drawn.join(observed, ["n", "j"]).select(
        *CM, "size", "r", "seed", F.round(F.col("x") * F.col("sign"), DIGITS).alias("d")
    )


def bootstrap_calibration(
    diffs: DataFrame,
    replicates: int = 2000,
    n_boot: int = 2000,
    sizes: tuple[int, ...] = (10, 40),
    alpha: float = 0.05,
) -> DataFrame:
    """(contrast, metric, n, test, rejection_rate, replicates): how often each test rejects without an effect.

    Samples are those of ``null_samples``; all of a size share the resampling counts.
    """
    samples = cut(null_samples(diffs, sizes, replicates))
    rows = samples.groupBy(*CM, "size", "r").agg(F.sort_array(F.collect_list(F.struct("seed", "d")))["d"].alias("d"))
    boot = rows.select(*CM, "size", bootstrap_p(n_boot)("d").alias("p"), F.lit("bootstrap").alias("test"))
    named = samples.select(F.concat_ws("|", "contrast", "size", "r").alias("contrast"), "metric", "seed", "d")
    t = paired_t(named).select(*CM, "p", F.lit("t").alias("test"))
    w = wilcoxon_signed_rank(named).select(*CM, "p", F.lit("wilcoxon").alias("test"))
    others = t.unionByName(w).select(
        F.regexp_replace("contrast", r"\|\d+\|\d+$", "").alias("contrast"),
        "metric",
        F.regexp_extract("contrast", r"\|(\d+)\|\d+$", 1).cast("int").alias("size"),
        "p",
        "test",
    )
    return (
        boot.unionByName(others)
        .groupBy(*CM, F.col("size").alias("n"), "test")
        .agg(F.avg((F.col("p") < alpha).cast("double")).alias("rejection_rate"), F.count("*").alias("replicates"))
    )


def level_table(long: DataFrame, level: str, value: str = "value") -> DataFrame:
    """Mean, deviation and count per dose level and metric."""
    return long.groupBy("metric", level).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n")
    )


def seed_slopes(long: DataFrame, level: str) -> DataFrame:
    """(metric, seed, d): least-squares slope of the value on the level per seed."""
    x = F.col(level).cast("double")
    return long.groupBy("metric", "seed").agg(F.regr_slope("value", x).alias("d")).where(
        F.col("d").isNotNull()
    ).withColumn("d", F.round("d", DIGITS))


def dose_response(long: DataFrame, level: str, expected: dict[str, str], n_boot: int = 5000) -> DataFrame:
    """Bootstrap of the per-seed slopes and whether the sign is as expected."""
    slopes = paired_bootstrap(seed_slopes(long, level), ["metric"], n_boot)
    sign = F.lit("0")
    for name, s in expected.items():
        sign = F.when(F.col("metric") == name, s).otherwise(sign)
    ok = (
        F.when(F.col("expected") == "+", (F.col("mean") > 0) & (F.col("ci_lo") > 0))
        .when(F.col("expected") == "-", (F.col("mean") < 0) & (F.col("ci_hi") < 0))
        .otherwise((F.col("ci_lo") <= 0) & (F.col("ci_hi") >= 0))
    )
    return slopes.withColumn("expected", sign).withColumn("consistent", ok)


def average_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Ranks from 1, ties share their mean rank."""
    order = Window.partitionBy(*keys).orderBy(value)
    tied = Window.partitionBy(*keys, value)
    return df.withColumn(name, F.rank().over(order) + (F.count("*").over(tied) - 1) / 2.0)


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, rho, n, p): rank correlation and its two-sided p by the t distribution with n - 2 degrees."""
    ranked = average_rank(average_rank(df, keys, x, "_rx"), keys, y, "_ry")
    found = ranked.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("rho"), F.count("*").alias("n"))
    free = (F.col("n") - 2).cast("double")
    t = F.when((F.col("n") > 2) & (F.abs("rho") < 1), F.abs("rho") * F.sqrt(free / (1.0 - F.col("rho") * F.col("rho"))))
    p = F.when((F.col("n") > 2) & (F.abs("rho") >= 1), 0.0).otherwise(2.0 * (1.0 - t_cdf(t, free)))
    return found.withColumn("p", p)


def interp_curve(points: DataFrame, knots: DataFrame, x: str = "x") -> DataFrame:
    """Adds ``y``: the knots (x, y) joined by lines, flat outside their range.

    ``knots`` is a calibration curve: a handful of rows held in one array.
    """
    curve = knots.agg(F.array_sort(F.collect_list(F.struct("x", "y")))).scalar()
    at = F.col(x)
    df = points.withColumn("_k", curve)
    below = F.filter("_k", lambda k: k["x"] <= at)
    above = F.filter("_k", lambda k: k["x"] > at)
    df = df.withColumns(
        {"_lo": F.try_element_at(below, F.lit(-1)), "_hi": F.try_element_at(above, F.lit(1))}
    )
    line = F.col("_lo.y") + (at - F.col("_lo.x")) * (F.col("_hi.y") - F.col("_lo.y")) / (
        F.col("_hi.x") - F.col("_lo.x")
    )
    return df.withColumn(
        "y",
        F.when(F.col("_lo").isNull(), F.col("_hi.y")).when(F.col("_hi").isNull(), F.col("_lo.y")).otherwise(line),
    ).drop("_k", "_lo", "_hi")


def mediation_residual(observed: DataFrame, curve: DataFrame) -> DataFrame:
    """Observed minus predicted hit rate at each selector's turnover.

    ``observed`` has (selector, rotation, hit), ``curve`` (rotation, hit).
    """
    knots = curve.select(F.col("rotation").alias("x"), F.col("hit").alias("y"))
    return interp_curve(observed, knots, "rotation").select(
        "selector", "rotation", "hit", F.col("y").alias("predicted"), (F.col("hit") - F.col("y")).alias("residual")
    )


def calibrate_rotation(target: DataFrame, curve: DataFrame, limit: float = 0.05) -> DataFrame:
    """p* at which the curve reaches the mean turnover of the target's seeds.

    One global p* is enough when the seeds differ little (sd <= limit).
    ``target`` has (seed, rotation), ``curve`` (p, rotation).
    """
    goal = target.agg(F.avg("rotation").alias("rotation"), F.stddev_samp("rotation").alias("sd"))
    knots = curve.select(F.col("rotation").alias("x"), F.col("p").alias("y"))
    return interp_curve(goal, knots, "rotation").select(
        "rotation", "sd", F.col("y").alias("p_star"), (F.col("sd") <= limit).alias("global_ok")
    )


def manipulation_check(rotation: DataFrame, left: str, right: str, limit: float = 0.03) -> DataFrame:
    """Whether two selectors have the same mean turnover within the limit."""
    a = F.avg(F.when(F.col("selector") == left, F.col("rotation")))
    b = F.avg(F.when(F.col("selector") == right, F.col("rotation")))
    return rotation.agg(a.alias("left"), b.alias("right")).withColumn(
        "gap", F.abs(F.col("left") - F.col("right"))
    ).withColumn("passed", F.col("gap") < limit)


def regime_table(runs: DataFrame, benchmark: str) -> DataFrame:
    """Per fold: means per strategy, and whether the benchmark beats the best of all others."""
    means = runs.groupBy("fold", "arm").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    best = means.groupBy("fold").agg(
        F.max(F.when(F.col("arm") != benchmark, F.col("mean"))).alias("best_arm"),
        F.max(F.when(F.col("arm") == benchmark, F.col("mean"))).alias("benchmark"),
    )
    return means.join(best, "fold").withColumn("benchmark_wins", F.col("benchmark") > F.col("best_arm"))


def sign_flips(fold_diffs: DataFrame) -> DataFrame:
    """(contrast, n_folds, n_positive, n_negative, flips) of mean differences per fold."""
    return fold_diffs.groupBy("contrast").agg(
        F.count("*").alias("n_folds"),
        F.sum((F.col("mean") > 0).cast("int")).alias("n_positive"),
        F.sum((F.col("mean") < 0).cast("int")).alias("n_negative"),
    ).withColumn("flips", (F.col("n_positive") > 0) & (F.col("n_negative") > 0))


def holdout_compare(long: DataFrame) -> DataFrame:
    """Arm means of the tuning and hold-out blocks side by side."""
    v = F.col("value")
    t, h = F.when(F.col("block") == "tuning", v), F.when(F.col("block") == "holdout", v)
    return long.groupBy("arm", "metric").agg(
        F.avg(t).alias("tuning_mean"),
        F.stddev_samp(t).alias("tuning_sd"),
        F.avg(h).alias("holdout_mean"),
        F.stddev_samp(h).alias("holdout_sd"),
    ).withColumn("shift", F.col("holdout_mean") - F.col("tuning_mean"))


def ablation_curve(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind", "level").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("value").alias("n")
    )


def best_setting(rows: DataFrame) -> DataFrame:
    """The level with the best mean on the tuning block, per kind."""
    means = rows.where(F.col("block") == "tuning").groupBy("kind", "level").agg(F.avg("value").alias("mean"))
    return means.groupBy("kind").agg(
        F.min_by("level", F.struct((-F.round("mean", DIGITS)).alias("nm"), "level")).alias("best_level"),
        F.max("mean").alias("best_mean"),
    )


def param_grid(arms: DataFrame, seeds: DataFrame, overrides: dict[str, list]) -> DataFrame:
    """arms x seeds x one override at a time: (arm, seed, param, setting)."""
    cells = [
        F.struct(F.lit(k).alias("param"), F.lit(str(v)).alias("setting")) for k, vs in overrides.items() for v in vs
    ]
    seed_list = seeds.agg(F.array_sort(F.collect_set("seed"))).scalar()
    return (
        arms.select("arm").distinct()
        .withColumn("seed", F.explode(seed_list))
        .withColumn("_c", F.explode(F.array(*cells)))
        .select("arm", "seed", "_c.param", "_c.setting")
    )


def pending_runs(grid: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """The runs of a grid that the ledger does not have yet."""
    return grid.join(finished.select(*keys).distinct(), keys, "left_anti")


def topology_contrast(runs: DataFrame, left: str, right: str) -> DataFrame:
    """(topology, seed, d) per topology, and ``all``: the mean over topologies
    for the seeds that have every one of them. ``runs`` has (topology, arm, seed, value)."""
    d = (
        F.max(F.when(F.col("arm") == left, F.col("value")))
        - F.max(F.when(F.col("arm") == right, F.col("value")))
    )
    per = runs.groupBy("topology", "seed").agg(d.alias("d")).where(F.col("d").isNotNull())
    n = per.agg(F.count_distinct("topology")).scalar()
    whole = per.groupBy("seed").agg(F.avg("d").alias("d"), F.count("*").alias("_n")).where(F.col("_n") == n)
    return per.unionByName(whole.select(F.lit("all").alias("topology"), "seed", "d"))


def ladder(means: DataFrame, baseline: str, ceiling: str) -> DataFrame:
    """Arms by mean, and how far each is from the baseline to the ceiling."""
    lo = means.agg(F.max(F.when(F.col("arm") == baseline, F.col("mean")))).scalar()
    hi = means.agg(F.max(F.when(F.col("arm") == ceiling, F.col("mean")))).scalar()
    return means.withColumn("share", (F.col("mean") - lo) / F.nullif(hi - lo, F.lit(0.0))).withColumn(
        "place",
        # the ladder is one list of arms
        F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("mean"), "arm")),
    )


def cost_sensitivity(runs: DataFrame, contrasts: list[Contrast], base_level: str) -> DataFrame:
    """Contrasts per cost level, and level minus base within each arm.

    ``runs`` has (level, arm, seed, value).
    """
    per_level = paired_diff(
        runs.select(F.col("level").alias("metric"), "arm", "seed", "value"), contrasts
    ).select(F.col("metric").alias("level"), F.lit("contrast").alias("kind"), F.col("contrast").alias("name"), "seed", "d")
    base = runs.where(F.col("level") == base_level).select("arm", "seed", F.col("value").alias("_b"))
    within = (
        runs.where(F.col("level") != base_level)
        .join(base, ["arm", "seed"])
        .select(
            "level", F.lit("vs_base").alias("kind"), F.col("arm").alias("name"), "seed",
            F.round(F.col("value") - F.col("_b"), DIGITS).alias("d"),
        )
    )
    return (
        per_level.unionByName(within)
        .groupBy("kind", "name", "level")
        .agg(F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), F.count("*").alias("n"))
    )
