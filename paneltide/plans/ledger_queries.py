"""Queries that compare the arms of the experiment ledger made from ``events``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paneltide.functions.columns import finite, tidy
from paneltide.operators import ledger as L
from paneltide.operators import resample as RS
from paneltide.operators import scores as SC
from paneltide.operators import splits as SP
from paneltide.plans import stages as st
from paneltide.plans.registry import query
from paneltide.plans.score_queries import _mask_inputs, out
from paneltide.plans.sqltext import boot_parts, norm_quantile_part, paired_boot_parts, part, t_quantile_part
from paneltide.session import cut
from paneltide.sources import tables as T

CM = ["contrast", "metric"]


def rnd(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), {digits}) + 0.0 AS {n}" for n in names)


def arms_long(spark: SparkSession, folder: str) -> DataFrame:
    long = L.metrics_long(T.arms_wide(spark, folder), T.ARM_METRICS)
    return long.where(finite("value"))


def diffs(spark: SparkSession, folder: str) -> DataFrame:
    """Stored differences of every pair of arms."""
    return cut(L.paired_diff(cut(arms_long(spark, folder))))


@query("metrics_long", "long", f"SELECT arm, seed, metric, {rnd('value')} FROM long")
def metrics_long(spark: SparkSession, folder: str) -> DataFrame:
    return out(arms_long(spark, folder), ["arm", "seed", "metric"], "value")


boot_parts("arm_boot", "long", "arm, metric", 1000, value="value")


@query("arm_summary", "arm_boot long", f"""
SELECT arm, metric, round(avg(value), 9) + 0.0 AS mean, round(coalesce(stddev_samp(value), 0), 9) + 0.0 AS sd, max(lo) AS ci_lo, max(hi) AS ci_hi, count(*) AS n
FROM long JOIN (SELECT arm, metric, round(quantile_cont(boot, 0.025), 9) + 0.0 AS lo, round(quantile_cont(boot, 0.975), 9) + 0.0 AS hi
  FROM arm_boot GROUP BY arm, metric) USING (arm, metric) GROUP BY arm, metric""")
def arm_summary(spark: SparkSession, folder: str) -> DataFrame:
    return out(RS.arm_summary(cut(arms_long(spark, folder)), 1000), ["arm", "metric", "n"], "mean", "sd", "ci_lo", "ci_hi", digits=9)


@query("paired_diff", "diffs", f"SELECT contrast, metric, seed, {rnd('d')} FROM diffs")
def paired_diff(spark: SparkSession, folder: str) -> DataFrame:
    return out(L.paired_diff(cut(arms_long(spark, folder))), CM + ["seed"], "d")


boot_parts("raw_boot", "diffs", "contrast, metric", 1000)


@query("bootstrap_mean", "raw_boot", "SELECT contrast, metric, CAST(b AS INTEGER) AS b, round(boot, 9) + 0.0 AS boot FROM raw_boot")
def bootstrap_mean(spark: SparkSession, folder: str) -> DataFrame:
    return out(RS.bootstrap_mean(diffs(spark, folder), CM, "seed", "d", 1000), CM + ["b"], "boot", digits=9)


PB = ("mean", "ci_lo", "ci_hi", "p_two", "p_greater", "p_positive")


@query("paired_bootstrap", "pboot", f"SELECT contrast, metric, n, degenerate, {rnd(*PB, digits=9)} FROM pboot")
def paired_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    return out(RS.paired_bootstrap(diffs(spark, folder), CM, 5000), CM + ["n", "degenerate"], *PB, digits=9)


part("ranked_p", "pboot", """
SELECT *, count(*) OVER () AS k, row_number() OVER (ORDER BY p_two, contrast, metric) AS i FROM pboot WHERE p_two IS NOT NULL""")
part("corrected", "pboot ranked_p", """
SELECT p.contrast, p.metric, p.p_two, r.bonferroni, r.holm, r.fdr FROM pboot p LEFT JOIN (
  SELECT contrast, metric, least(k * p_two, 1) AS bonferroni, max(least((k - i + 1) * p_two, 1)) OVER (ORDER BY i) AS holm,
         min(least(k * p_two / i, 1)) OVER (ORDER BY i DESC) AS fdr FROM ranked_p) r ON r.contrast = p.contrast AND r.metric = p.metric""")


@query("multi_metric_compare", "corrected", f"SELECT contrast, metric, {rnd('p_two', 'bonferroni', 'holm')}, round(CAST(fdr AS DOUBLE), 6) + 0.0 AS fdr_bh FROM corrected")
def multi_metric_compare(spark: SparkSession, folder: str) -> DataFrame:
    rows = L.with_corrections(RS.paired_bootstrap(diffs(spark, folder), CM, 5000), "p_two")
    return out(rows, CM, "p_two", "bonferroni", "holm", "fdr_bh")


def _correction(name: str, source: str):
    @query(name, "corrected", f"SELECT contrast, metric, round(CAST({source} AS DOUBLE), 6) + 0.0 AS {name} FROM corrected")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = L.with_corrections(RS.paired_bootstrap(diffs(spark, folder), CM, 5000), "p_two")
        return out(rows, CM, name)

    return run


for _name, _source in (("bonferroni", "bonferroni"), ("holm", "holm"), ("fdr_bh", "fdr")):
    _correction(_name, _source)

# t distribution in SQL: Simpson's rule over the density, 4000 steps from 0 to |t|
STEPS = 4000
part("dm", "diffs", """
SELECT contrast, metric, avg(d) AS mean, stddev_samp(d) AS sd, CAST(count(*) AS DOUBLE) AS n, stddev_samp(d) / sqrt(count(*)) AS se FROM diffs
GROUP BY contrast, metric HAVING count(*) >= 2""")
part("simpson", "", f"SELECT i, CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS c FROM (SELECT unnest(range(0, {STEPS + 1})) AS i)")


def t_cdf_parts(name: str, source: str, t: str) -> str:
    """(contrast, metric, cdf) of the column t with n - 1 degrees of freedom."""
    part(name, f"{source} simpson", f"""
SELECT contrast, metric, 0.5 + sign({t}) * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi() * df) * sum(c * power(1 + power(abs({t}) * i / {STEPS}.0, 2) / df, -(df + 1) / 2)) * abs({t}) / {STEPS}.0 / 3 AS cdf
FROM (SELECT contrast, metric, {t}, n - 1 AS df FROM {source} WHERE {t} IS NOT NULL) CROSS JOIN simpson GROUP BY contrast, metric, {t}, df""")
    return name


part("tt", "dm", "SELECT *, mean / nullif(se, 0) AS t FROM dm")
t_cdf_parts("tt_cdf", "tt", "t")


@query("paired_t", "tt tt_cdf", """
SELECT contrast, metric, CAST(n AS BIGINT) AS n, round(mean, 6) + 0.0 AS mean, round(t, 6) + 0.0 AS t,
       round(2 * (1 - CASE WHEN cdf < 0.5 THEN 1 - cdf ELSE cdf END), 6) + 0.0 AS p FROM tt LEFT JOIN tt_cdf USING (contrast, metric)""")
def paired_t(spark: SparkSession, folder: str) -> DataFrame:
    return out(L.paired_t(diffs(spark, folder)), CM + ["n"], "mean", "t", "p")


def rank_part(name: str, source: str, keys: str) -> str:
    part(name, source, f"""
SELECT {keys}, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, CAST(count(*) AS DOUBLE) AS n,
       CAST(sum(tied * tied - 1) AS DOUBLE) AS ties FROM (
  SELECT {keys}, d, avg(rn) OVER (PARTITION BY {keys}, a) AS r, count(*) OVER (PARTITION BY {keys}, a) AS tied FROM (
    SELECT {keys}, d, round(abs(d), 12) AS a, row_number() OVER (PARTITION BY {keys} ORDER BY round(abs(d), 12)) AS rn FROM {source} WHERE round(abs(d), 12) > 0))
GROUP BY {keys}""")
    return name


rank_part("sranks", "diffs", "contrast, metric")


@query("wilcoxon_signed_rank", "sranks", f"SELECT contrast, metric, {rnd('w_plus', 'n', 'ties')}, round(least(w_plus, w_minus), 6) + 0.0 AS w FROM sranks")
def wilcoxon_signed_rank(spark: SparkSession, folder: str) -> DataFrame:
    return out(L.wilcoxon_signed_rank(diffs(spark, folder)), CM, "w_plus", "n", "ties", "w")


def rank_law_part(name: str, ranks: str, source: str) -> str:
    """Exact tails of w_plus: the law of twice the rank sum, one rank after the other, as a list of chances."""
    part(f"{name}_list", source, f"""
SELECT contrast, metric, list(twice ORDER BY twice) AS a, sum(twice) AS top FROM (
  SELECT contrast, metric, CAST(2 * avg(rn) OVER (PARTITION BY contrast, metric, s) AS BIGINT) AS twice FROM (
    SELECT contrast, metric, round(abs(d), 12) AS s, row_number() OVER (PARTITION BY contrast, metric ORDER BY round(abs(d), 12)) AS rn FROM {source} WHERE round(abs(d), 12) > 0))
GROUP BY contrast, metric""")
    part(f"{name}_law", f"{name}_list", f"""/*REC*/
SELECT contrast, metric, a, 0 AS i, [CAST(1.0 AS DOUBLE)] AS p FROM {name}_list
UNION ALL SELECT contrast, metric, a, i + 1, list_transform(range(1, len(p) + a[i + 1] + 1), lambda s: (CASE WHEN s <= len(p) THEN p[s] ELSE 0 END + CASE WHEN s > a[i + 1] THEN p[s - a[i + 1]] ELSE 0 END) / 2)
FROM {name}_law WHERE i < len(a)""")
    part(name, f"{name}_law {ranks}", f"""
SELECT contrast, metric, w_plus, n, list_sum(list_slice(p, 1, CAST(2 * w_plus AS BIGINT) + 1)) AS low, list_sum(list_slice(p, CAST(2 * w_plus AS BIGINT) + 1, len(p))) AS high
FROM {name}_law JOIN {ranks} USING (contrast, metric) WHERE i = len(a)""")
    return name


rank_law_part("w_law", "sranks", "diffs")


@query("wilcoxon_p", "w_law", """
SELECT contrast, metric, round(least(w_plus, n * (n + 1) / 2 - w_plus), 6) + 0.0 AS w, round(least(1.0, 2 * least(low, high)), 9) + 0.0 AS p FROM w_law""")
def wilcoxon_p(spark: SparkSession, folder: str) -> DataFrame:
    return out(L.wilcoxon_signed_rank(diffs(spark, folder)), CM, "w", "p", digits=9)


MARGINS = {"mean_value": 0.5, "sd_value": 0.5, "max_value": 5.0, "n_events": 1.0}


def margin() -> Column:
    """The margin of each row's metric."""
    return F.create_map(*[F.lit(x) for pair in MARGINS.items() for x in pair])[F.col("metric")]


MARGIN_SQL = "CASE metric " + " ".join(f"WHEN '{m}' THEN {x}" for m, x in MARGINS.items()) + " END"
part("tost_t", "dm", "SELECT *, (mean + margin) / nullif(se, 0) AS t_lower, (mean - margin) / nullif(se, 0) AS t_upper FROM (SELECT *, " + MARGIN_SQL + " AS margin FROM dm)")
t_cdf_parts("tost_lo", "tost_t", "t_lower")
t_cdf_parts("tost_hi", "tost_t", "t_upper")


@query("tost", "tost_t tost_lo tost_hi", """
SELECT contrast, metric, CAST(margin AS DOUBLE) AS margin, CAST(n AS BIGINT) AS n, round(mean, 6) + 0.0 AS mean, round(t_lower, 6) + 0.0 AS t_lower, round(t_upper, 6) + 0.0 AS t_upper,
       round(greatest(1 - l.cdf, h.cdf), 6) + 0.0 AS p_tost, greatest(1 - l.cdf, h.cdf) < 0.05 AS equivalent
FROM tost_t JOIN tost_lo l USING (contrast, metric) JOIN tost_hi h USING (contrast, metric)""")
def tost(spark: SparkSession, folder: str) -> DataFrame:
    return out(L.tost(diffs(spark, folder), margin()), CM + ["margin", "n", "equivalent"], "mean", "t_lower", "t_upper", "p_tost")


part("shift_lo", "diffs", f"SELECT contrast, metric, seed, round(d + {MARGIN_SQL}, 12) AS d FROM diffs")
part("shift_hi", "diffs", f"SELECT contrast, metric, seed, round(d - {MARGIN_SQL}, 12) AS d FROM diffs")
rank_part("rank_lo", "shift_lo", "contrast, metric")
rank_part("rank_hi", "shift_hi", "contrast, metric")


rank_law_part("law_lo", "rank_lo", "shift_lo")
rank_law_part("law_hi", "rank_hi", "shift_hi")


@query("tost_wilcoxon", "law_lo law_hi", """
SELECT contrast, metric, round(CAST(l.w_plus AS DOUBLE), 6) + 0.0 AS w_lower, round(CAST(h.w_plus AS DOUBLE), 6) + 0.0 AS w_upper, round(least(1.0, greatest(l.high, h.low)), 9) + 0.0 AS p_tost
FROM law_lo l JOIN law_hi h USING (contrast, metric)""")
def tost_wilcoxon(spark: SparkSession, folder: str) -> DataFrame:
    return out(L.tost_wilcoxon(diffs(spark, folder), margin()), CM, "w_lower", "w_upper", "p_tost", digits=9)


FACTORS = [0.05, 0.1, 0.2, 0.4]


@query("margin_sensitivity", "dm", f"""
SELECT contrast, metric, round(f * sd, 6) + 0.0 AS margin, round((mean + f * sd) / nullif(se, 0), 6) + 0.0 AS t_lower, round((mean - f * sd) / nullif(se, 0), 6) + 0.0 AS t_upper
FROM dm CROSS JOIN (SELECT CAST(unnest({FACTORS}) AS DOUBLE) AS f)""")
def margin_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    return out(L.margin_sensitivity(diffs(spark, folder), FACTORS, F.col("sd")), CM, "margin", "t_lower", "t_upper")


t_quantile_part("q_t", "SELECT DISTINCT p, n - 1 AS df FROM dm, (SELECT unnest([0.975, 0.8]) AS p)", "dm")
norm_quantile_part("q_z", "SELECT unnest([0.95, 0.8]) AS p", "")


@query("mde", "dm q_t", """
SELECT contrast, metric, CAST(n AS BIGINT) AS n, round(se, 6) + 0.0 AS se, round((a.q + b.q) * se, 6) + 0.0 AS mde
FROM dm JOIN q_t a ON a.df = n - 1 AND a.p = 0.975 JOIN q_t b ON b.df = n - 1 AND b.p = 0.8""")
def mde(spark: SparkSession, folder: str) -> DataFrame:
    return out(L.mde(diffs(spark, folder)), CM + ["n"], "se", "mde")


@query("tost_sample_size", "dm q_z", f"""
SELECT contrast, metric, round(sd, 6) + 0.0 AS sd, round(need, 6) + 0.0 AS n_exact, CAST(ceil(need) AS BIGINT) AS n_required
FROM (SELECT *, power((SELECT sum(q) FROM q_z) * sd / {MARGIN_SQL}, 2) AS need FROM dm)""")
def tost_sample_size(spark: SparkSession, folder: str) -> DataFrame:
    return out(L.tost_sample_size(diffs(spark, folder), margin()), CM + ["n_required"], "sd", "n_exact")


@query("crosscheck", "pboot tt tt_cdf w_law", """
SELECT b.contrast, b.metric, b.n, round(b.mean, 6) + 0.0 AS mean, round(b.p_two, 6) + 0.0 AS p_bootstrap,
       round(2 * (1 - CASE WHEN cdf < 0.5 THEN 1 - cdf ELSE cdf END), 6) + 0.0 AS p_t, round(least(1.0, 2 * least(low, high)), 6) + 0.0 AS p_wilcoxon
FROM pboot b LEFT JOIN tt_cdf t USING (contrast, metric) LEFT JOIN w_law w USING (contrast, metric)""")
def crosscheck(spark: SparkSession, folder: str) -> DataFrame:
    return out(L.crosscheck(diffs(spark, folder), 5000), CM + ["n"], "mean", "p_bootstrap", "p_t", "p_wilcoxon")


@query("bootstrap_calibration")
def bootstrap_calibration(spark: SparkSession, folder: str) -> DataFrame:
    return out(L.bootstrap_calibration(diffs(spark, folder)), CM + ["n", "test", "replicates"], "rejection_rate")


# dose-response: the level is the hour of the day in four steps, the seed as above
part("dose", "", f"""
SELECT 'mean_value' AS metric, user_id AS seed, CAST(hour(ts) // 6 AS INTEGER) AS level, avg(value) AS value FROM events GROUP BY 2, 3
UNION ALL SELECT 'sd_value', user_id, CAST(hour(ts) // 6 AS INTEGER), stddev_samp(value) FROM events GROUP BY 2, 3""")
part("slopes", "dose", "SELECT metric, seed, round(regr_slope(value, CAST(level AS DOUBLE)), 12) AS d FROM dose GROUP BY metric, seed HAVING regr_slope(value, CAST(level AS DOUBLE)) IS NOT NULL")
paired_boot_parts("slope_boot", "slopes", "metric", 5000)


def dose(spark: SparkSession, folder: str) -> DataFrame:
    wide = (
        T.table(spark, folder, "events")
        .groupBy(F.col("user_id").alias("seed"), F.floor(F.hour("ts") / 6).cast("int").alias("level"))
        .agg(F.avg("value").alias("mean_value"), F.stddev_samp("value").alias("sd_value"))
    )
    return cut(wide.unpivot(["seed", "level"], ["mean_value", "sd_value"], "metric", "value"))


@query("dose_levels", "dose", "SELECT metric, level, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS sd, count(value) AS n FROM dose GROUP BY metric, level")
def dose_levels(spark: SparkSession, folder: str) -> DataFrame:
    return out(L.level_table(dose(spark, folder), "level"), ["metric", "level", "n"], "mean", "sd")


@query("dose_response", "slope_boot", """
SELECT metric, n, CASE WHEN metric = 'mean_value' THEN '+' ELSE '0' END AS expected, round(mean, 9) + 0.0 AS mean, round(ci_lo, 9) + 0.0 AS ci_lo, round(ci_hi, 9) + 0.0 AS ci_hi, round(p_two, 9) + 0.0 AS p_two,
       CASE WHEN metric = 'mean_value' THEN mean > 0 AND ci_lo > 0 ELSE ci_lo <= 0 AND ci_hi >= 0 END AS consistent FROM slope_boot""")
def dose_response(spark: SparkSession, folder: str) -> DataFrame:
    rows = L.dose_response(dose(spark, folder), "level", {"mean_value": "+"}, 5000)
    return out(rows, ["metric", "n", "expected", "consistent"], "mean", "ci_lo", "ci_hi", "p_two", digits=9)


part("rank_both", "dose", """
SELECT metric, avg(x) OVER (PARTITION BY metric, level) AS rx, avg(y) OVER (PARTITION BY metric, value) AS ry FROM (
  SELECT *, row_number() OVER (PARTITION BY metric ORDER BY level) AS x, row_number() OVER (PARTITION BY metric ORDER BY value) AS y FROM dose WHERE value IS NOT NULL)""")


part("rank_t", "rank_both", """
SELECT 'rank' AS contrast, metric, rho, n AS size, CAST(n - 1 AS DOUBLE) AS n, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) AS t
FROM (SELECT metric, corr(rx, ry) AS rho, count(*) AS n FROM rank_both GROUP BY metric)""")
t_cdf_parts("rank_cdf", "rank_t", "t")


@query("spearman", "rank_t rank_cdf", """
SELECT metric, round(rho, 6) + 0.0 AS rho, size AS n, round(2 * (1 - cdf), 6) + 0.0 AS p FROM rank_t LEFT JOIN rank_cdf USING (contrast, metric)""")
def spearman(spark: SparkSession, folder: str) -> DataFrame:
    rows = dose(spark, folder).where(F.col("value").isNotNull())
    return out(L.spearman(rows, ["metric"], "level", "value"), ["metric", "n"], "rho", "p")


# rotation and mediation ---------------------------------------------------------

part("rot_sel", "rotation", "SELECT selector, avg(rotation) AS rotation FROM rotation GROUP BY selector")
part("hit_sel", "cand", "SELECT selector, avg(candidate_hit_evaluable) AS hit FROM cand GROUP BY selector")
part("obs", "rot_sel hit_sel", "SELECT r.selector, round(rotation, 12) AS rotation, round(hit, 12) AS hit FROM rot_sel r JOIN hit_sel h ON h.selector = r.selector")
part("segments", "obs", """
SELECT rotation AS x0, hit AS y0, lead(rotation) OVER (ORDER BY rotation, hit) AS x1, lead(hit) OVER (ORDER BY rotation, hit) AS y1 FROM obs WHERE selector LIKE 'sticky%'""")


def interp_sql(points: str, x: str, segments: str, cols: str) -> str:
    """Piecewise-linear value ``y`` at x, flat outside the knots."""
    return f"""
SELECT {cols}, CASE WHEN p.{x} < (SELECT min(x0) FROM {segments}) THEN (SELECT arg_min(y0, x0) FROM {segments})
  WHEN s.x0 IS NULL THEN (SELECT arg_max(y0, x0) FROM {segments}) ELSE s.y0 + (p.{x} - s.x0) * (s.y1 - s.y0) / (s.x1 - s.x0) END AS y
FROM {points} p LEFT JOIN {segments} s ON p.{x} >= s.x0 AND p.{x} < s.x1"""


part("mediated", "obs segments", interp_sql("obs", "rotation", "segments", "p.selector, p.rotation, p.hit"))


def observed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(selector, rotation, hit) and the per-seed rotations, both stored."""
    f, _, masks = _mask_inputs(spark, folder)
    eps = cut(st.episodes(f))
    rot = cut(SC.turnover(masks, eps).withColumnRenamed("turnover", "rotation"))
    hit = SC.candidate_hit_rate(masks, st.labels(f), eps).groupBy("selector").agg(
        F.avg("candidate_hit_evaluable").alias("hit")
    )
    rows = rot.groupBy("selector").agg(F.avg("rotation").alias("rotation")).join(hit, "selector")
    return cut(rows.select("selector", F.round("rotation", 12).alias("rotation"), F.round("hit", 12).alias("hit"))), rot


def _sticky(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("selector").startswith("sticky"))


@query("interp_curve", "mediated", f"SELECT selector, {rnd('rotation', 'y')} FROM mediated")
def interp_curve(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = observed(spark, folder)
    knots = _sticky(rows).select(F.col("rotation").alias("x"), F.col("hit").alias("y"))
    return out(L.interp_curve(rows, knots, "rotation"), ["selector"], "rotation", "y")


@query("mediation_residual", "mediated", f"""
SELECT selector, {rnd('rotation', 'hit')}, round(y, 6) + 0.0 AS predicted, round(hit - y, 6) + 0.0 AS residual FROM mediated WHERE selector NOT LIKE 'sticky%'""")
def mediation_residual(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = observed(spark, folder)
    informed = rows.where(~F.col("selector").startswith("sticky"))
    res = L.mediation_residual(informed, _sticky(rows))
    return out(res, ["selector"], "rotation", "hit", "predicted", "residual")


part("p_segments", "obs", """
SELECT rotation AS x0, p AS y0, lead(rotation) OVER (ORDER BY rotation, p) AS x1, lead(p) OVER (ORDER BY rotation, p) AS y1
FROM (SELECT rotation, CAST(split_part(selector, '_', 2) AS DOUBLE) AS p FROM obs WHERE selector LIKE 'sticky%')""")
part("goal", "rotation", "SELECT avg(rotation) AS rotation, stddev_samp(rotation) AS sd FROM rotation WHERE selector = 'edge_walk'")
part("p_star", "goal p_segments", interp_sql("goal", "rotation", "p_segments", "p.rotation, p.sd"))


@query("calibrate_rotation", "p_star", f"SELECT {rnd('rotation', 'sd')}, round(y, 6) + 0.0 AS p_star, sd <= 0.05 AS global_ok FROM p_star")
def calibrate_rotation(spark: SparkSession, folder: str) -> DataFrame:
    rows, per_seed = observed(spark, folder)
    curve = _sticky(rows).select(F.split("selector", "_")[1].cast("double").alias("p"), "rotation")
    target = per_seed.where(F.col("selector") == "edge_walk")
    return out(L.calibrate_rotation(target, curve), ["global_ok"], "rotation", "sd", "p_star")


@query("manipulation_check", "rotation", """
SELECT round(a, 6) + 0.0 AS "left", round(b, 6) + 0.0 AS "right", round(abs(a - b), 6) + 0.0 AS gap, abs(a - b) < 0.03 AS passed FROM (
  SELECT avg(CASE WHEN selector = 'edge_walk' THEN rotation END) AS a, avg(CASE WHEN selector = 'sticky_0.25' THEN rotation END) AS b FROM rotation)""")
def manipulation_check(spark: SparkSession, folder: str) -> DataFrame:
    _, per_seed = observed(spark, folder)
    return out(L.manipulation_check(per_seed, "edge_walk", "sticky_0.25"), ["passed"], "left", "right", "gap")


# folds, blocks, grids -----------------------------------------------------------

part("fold_runs", "", f"""
SELECT CAST(dayofyear(ts) // 7 AS INTEGER) AS fold, event_type AS arm, user_id AS seed, avg(value) AS value FROM events GROUP BY 1, 2, 3""")
part("fold_means", "fold_runs", "SELECT fold, arm, avg(value) AS mean, count(*) AS n FROM fold_runs GROUP BY fold, arm")


def fold_runs(spark: SparkSession, folder: str) -> DataFrame:
    """One value per (week, arm, seed): a fold is a week."""
    return (
        T.table(spark, folder, "events")
        .groupBy(
            F.floor(F.dayofyear("ts") / 7).cast("int").alias("fold"),
            F.col("event_type").alias("arm"),
            F.col("user_id").alias("seed"),
        )
        .agg(F.avg("value").alias("value"))
    )


@query("regime_table", "fold_means", """
SELECT m.fold, m.arm, round(m.mean, 9) + 0.0 AS mean, m.n, round(b.best_arm, 9) + 0.0 AS best_arm, round(b.benchmark, 9) + 0.0 AS benchmark, b.benchmark > b.best_arm AS benchmark_wins
FROM fold_means m JOIN (SELECT fold, max(CASE WHEN arm <> 'purchase' THEN mean END) AS best_arm, max(CASE WHEN arm = 'purchase' THEN mean END) AS benchmark
  FROM fold_means GROUP BY fold) b ON b.fold = m.fold""")
def regime_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = L.regime_table(fold_runs(spark, folder), "purchase")
    return out(rows, ["fold", "arm", "n", "benchmark_wins"], "mean", "best_arm", "benchmark", digits=9)


part("fold_diff", "fold_runs", """
SELECT b.arm || '-' || a.arm AS contrast, a.fold, avg(round(b.value - a.value, 12)) AS mean FROM fold_runs a JOIN fold_runs b ON a.fold = b.fold AND a.seed = b.seed AND a.arm < b.arm GROUP BY 1, 2""")


@query("sign_flips", "fold_diff", """
SELECT contrast, count(*) AS n_folds, CAST(sum(CASE WHEN mean > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive, CAST(sum(CASE WHEN mean < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_negative,
       sum(CASE WHEN mean > 0 THEN 1 ELSE 0 END) > 0 AND sum(CASE WHEN mean < 0 THEN 1 ELSE 0 END) > 0 AS flips FROM fold_diff GROUP BY contrast""")
def sign_flips(spark: SparkSession, folder: str) -> DataFrame:
    long = fold_runs(spark, folder).withColumnRenamed("fold", "metric")
    per = L.paired_diff(long).groupBy("contrast", "metric").agg(F.avg("d").alias("mean"))
    return L.sign_flips(per)


part("block_runs", "", f"""
SELECT CASE WHEN day(ts) <= 15 THEN 'tuning' ELSE 'holdout' END AS block, event_type AS arm, user_id AS seed, avg(value) AS value FROM events GROUP BY 1, 2, 3""")


def block_runs(spark: SparkSession, folder: str) -> DataFrame:
    return (
        T.table(spark, folder, "events")
        .groupBy(
            F.when(F.dayofmonth("ts") <= 15, "tuning").otherwise("holdout").alias("block"),
            F.col("event_type").alias("arm"),
            F.col("user_id").alias("seed"),
        )
        .agg(F.avg("value").alias("value"))
    )


@query("holdout_compare", "block_runs", """
SELECT arm, 'mean_value' AS metric, round(t, 6) + 0.0 AS tuning_mean, round(ts, 6) + 0.0 AS tuning_sd, round(h, 6) + 0.0 AS holdout_mean, round(hs, 6) + 0.0 AS holdout_sd, round(h - t, 6) + 0.0 AS shift FROM (
  SELECT arm, avg(value) FILTER (block = 'tuning') AS t, stddev_samp(value) FILTER (block = 'tuning') AS ts, avg(value) FILTER (block = 'holdout') AS h, stddev_samp(value) FILTER (block = 'holdout') AS hs
  FROM block_runs GROUP BY arm)""")
def holdout_compare(spark: SparkSession, folder: str) -> DataFrame:
    rows = L.holdout_compare(block_runs(spark, folder).withColumn("metric", F.lit("mean_value")))
    return out(rows, ["arm", "metric"], "tuning_mean", "tuning_sd", "holdout_mean", "holdout_sd", "shift")


@query("ablation_curve", "block_runs", """
SELECT block AS kind, arm AS level, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS sd, count(value) AS n FROM block_runs GROUP BY block, arm""")
def ablation_curve(spark: SparkSession, folder: str) -> DataFrame:
    rows = block_runs(spark, folder).select(F.col("block").alias("kind"), F.col("arm").alias("level"), "value")
    return out(L.ablation_curve(rows), ["kind", "level", "n"], "mean", "sd")


@query("best_setting", "block_runs", """
SELECT 'arm' AS kind, level AS best_level, round(mean, 6) + 0.0 AS best_mean FROM (SELECT arm AS level, avg(value) AS mean FROM block_runs WHERE block = 'tuning' GROUP BY arm) ORDER BY round(mean, 12) DESC, level LIMIT 1""")
def best_setting(spark: SparkSession, folder: str) -> DataFrame:
    rows = block_runs(spark, folder).select(F.lit("arm").alias("kind"), F.col("arm").alias("level"), "block", "value")
    return out(L.best_setting(rows), ["kind", "best_level"], "best_mean")


OVERRIDES = {"k": [1, 2, 3, 4], "m": [2, 3, 5], "risk": [0.0, 0.1]}
_cells = ", ".join(f"('{k}', '{v}')" for k, vs in OVERRIDES.items() for v in vs)
part("grid", "wide", f"SELECT a.arm, s.seed, c.param, c.setting FROM (SELECT DISTINCT arm FROM wide) a, (SELECT DISTINCT seed FROM wide) s, (VALUES {_cells}) c(param, setting)")


def grid(spark: SparkSession, folder: str) -> DataFrame:
    wide = cut(T.arms_wide(spark, folder).select("arm", "seed"))
    return L.param_grid(wide, wide, OVERRIDES)


@query("param_grid", "grid", "SELECT * FROM grid")
def param_grid(spark: SparkSession, folder: str) -> DataFrame:
    return grid(spark, folder)


part("finished", "wide", "SELECT arm, seed, 'k' AS param, '2' AS setting FROM wide WHERE n_events >= 14")


@query("pending_runs", "grid finished", "SELECT g.* FROM grid g WHERE NOT EXISTS (SELECT 1 FROM finished f WHERE f.arm = g.arm AND f.seed = g.seed AND f.param = g.param AND f.setting = g.setting)")
def pending_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs still to do when the busy (arm, seed) cells have finished one setting."""
    done = T.arms_wide(spark, folder).where(F.col("n_events") >= 14).select(
        "arm", "seed", F.lit("k").alias("param"), F.lit("2").alias("setting")
    )
    return L.pending_runs(grid(spark, folder), done, ["arm", "seed", "param", "setting"])


part("topo_diff", "fold_runs", """
SELECT CAST(fold AS VARCHAR) AS topology, seed, max(CASE WHEN arm = 'view' THEN value END) - max(CASE WHEN arm = 'click' THEN value END) AS d FROM fold_runs GROUP BY fold, seed
HAVING max(CASE WHEN arm = 'view' THEN value END) - max(CASE WHEN arm = 'click' THEN value END) IS NOT NULL""")


@query("topology_contrast", "topo_diff", """
SELECT topology, seed, round(d, 6) + 0.0 AS d FROM topo_diff
UNION ALL SELECT 'all', seed, round(avg(d), 6) + 0.0 FROM topo_diff GROUP BY seed HAVING count(*) = (SELECT count(DISTINCT topology) FROM topo_diff)""")
def topology_contrast(spark: SparkSession, folder: str) -> DataFrame:
    runs = cut(fold_runs(spark, folder).select(F.col("fold").cast("string").alias("topology"), "arm", "seed", "value"))
    return out(L.topology_contrast(runs, "view", "click"), ["topology", "seed"], "d")


@query("ladder", "block_runs", """
SELECT arm, round(mean, 6) + 0.0 AS mean, CAST(row_number() OVER (ORDER BY mean DESC, arm) AS INTEGER) AS place,
       round((mean - max(CASE WHEN arm = 'error' THEN mean END) OVER ()) / nullif(max(CASE WHEN arm = 'purchase' THEN mean END) OVER () - max(CASE WHEN arm = 'error' THEN mean END) OVER (), 0), 6) + 0.0 AS share
FROM (SELECT arm, avg(value) AS mean FROM block_runs GROUP BY arm)""")
def ladder(spark: SparkSession, folder: str) -> DataFrame:
    means = cut(block_runs(spark, folder).groupBy("arm").agg(F.avg("value").alias("mean")))
    return out(L.ladder(means, "error", "purchase"), ["arm", "place"], "mean", "share")


part("cost_runs", "dropped", """
SELECT l.level, run AS arm, seed, round(avg(next_return - 0.1 * vol - l.c * cost / 0.0005), 12) AS value FROM dropped
CROSS JOIN (VALUES ('none', 0.0), ('low', 0.001), ('high', 0.01)) l(level, c) GROUP BY 1, 2, 3""")
COST_SQL = """
SELECT kind, name, level, round(avg(d), 6) + 0.0 AS mean, round(stddev_samp(d), 6) + 0.0 AS sd, count(*) AS n FROM (
  SELECT 'contrast' AS kind, b.arm || '-' || a.arm AS name, a.level, round(b.value - a.value, 12) AS d FROM cost_runs a JOIN cost_runs b ON a.level = b.level AND a.seed = b.seed AND a.arm < b.arm
  UNION ALL SELECT 'vs_base', a.arm, a.level, round(a.value - b.value, 12) FROM cost_runs a JOIN cost_runs b ON b.level = 'none' AND a.arm = b.arm AND a.seed = b.seed WHERE a.level <> 'none') GROUP BY 1, 2, 3"""


@query("cost_sensitivity", "cost_runs", COST_SQL)
def cost_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    """Strategies replayed once, rewards recomputed at three cost levels."""
    steps = st.strategy_steps(st.feature_rows(spark, folder))
    levels = F.array(*[F.struct(F.lit(n).alias("level"), F.lit(c).alias("c")) for n, c in (("none", 0.0), ("low", 0.001), ("high", 0.01))])
    runs = (
        steps.withColumn("_l", F.explode(levels))
        .withColumn("v", F.col("next_return") - 0.1 * F.col("vol") - F.col("_l.c") * F.col("cost") / 0.0005)
        .groupBy(F.col("_l.level").alias("level"), F.col("run").alias("arm"), "seed")
        .agg(F.round(F.avg("v"), 12).alias("value"))
    )
    contrasts = L.all_contrasts(["random", "momentum", "oracle", "buy_hold_best"])
    return out(L.cost_sensitivity(cut(runs), contrasts, "none"), ["kind", "name", "level", "n"], "mean", "sd")
