"""Walks on packed neighbourhoods (dt, ids, w): k steps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paneltide.functions.columns import let


def _row_sum(row: Column) -> Column:
    return F.aggregate(row, F.lit(0.0), lambda s, x: s + x)


def _index(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 1)


def transition_rows(packed: DataFrame, eps: float = 1e-12) -> DataFrame:
    """Adds ``p``: each row of weights over its sum; an isolated node moves anywhere."""
    n = F.size("ids")

    def probs(row):
        return let(
            _row_sum(row),
            lambda total: F.transform(row, lambda x: F.when(total < eps, 1.0 / n).otherwise(x / total)),
        )

    return packed.withColumn("p", F.transform("w", probs))


def transition_probs(packed: DataFrame) -> DataFrame:
    """(dt, src, dst, p) with p > 0."""
    rows = transition_rows(packed).select("dt", "ids", F.posexplode("p").alias("_i", "_row"))
    return (
        rows.select("dt", "ids", "_i", F.posexplode("_row").alias("_j", "p"))
        .where(F.col("p") > 0)
        .select(
            "dt",
            F.element_at("ids", F.col("_i") + 1).alias("src"),
            F.element_at("ids", F.col("_j") + 1).alias("dst"),
            "p",
        )
    )


def _normalised(values: Column) -> Column:
    """Divide by the sum, unless it is zero."""

    def share(v):
        return let(
            _row_sum(v),
            lambda total: F.transform(v, lambda x: F.when(total > 0, x / total).otherwise(x)),
        )

    return let(values, share)


def random_walk_k(packed: DataFrame, k: int = 3, name: str = "score") -> DataFrame:
    """Adds the distribution after k weighted random steps from the seed."""
    if k < 0:
        raise ValueError("k must not be negative")
    n = F.size("ids")
    out = transition_rows(packed)
    start = F.transform(_index(n), lambda i: F.when(i == 0, 1.0).otherwise(0.0))

    def walk(moves):
        def step(p, _):
            return F.transform(
                _index(n),
                lambda j: F.aggregate(
                    F.zip_with(p, moves, lambda a, row: a * F.get(row, j)),
                    F.lit(0.0),
                    lambda s, x: s + x,
                ),
            )

        return F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, step)

    walked = start if k == 0 else let(F.col("p"), walk)
    return out.withColumn(name, _normalised(walked)).drop("p")


def edge_walk_k(
    packed: DataFrame, k: int = 3, mix: str = "weighted", start: str = "uniform", name: str = "score"
) -> DataFrame:
    """Adds node scores after k rounds of signed message passing on directed edges.

    A round mixes the amplitudes leaving a node (a reflection about the
    direction given by the edge weights, or about the uniform one) and then
    sends every amplitude to the other end of its edge. The sum of squares is
    conserved; the score of a node is the sum of squares it holds.
    """
    if mix not in ("weighted", "uniform"):
        raise ValueError(f"unknown mix {mix!r}")
    if start not in ("uniform", "seed"):
        raise ValueError(f"unknown start {start!r}")
    if k < 0:
        raise ValueError("k must not be negative")
    n = F.size("ids")

    def count(row):
        return F.size(F.filter(row, lambda x: x > 0)).cast("double")

    def direction(row):
        if mix == "weighted":
            return let(
                F.nullif(_row_sum(row), F.lit(0.0)),
                lambda total: F.transform(row, lambda x: F.coalesce(F.sqrt(x / total), F.lit(0.0))),
            )
        return let(
            count(row),
            lambda d: F.transform(row, lambda x: F.when(x > 0, 1.0 / F.sqrt(d)).otherwise(0.0)),
        )

    def begin(amount):
        return F.transform(
            "w",
            lambda row, i: F.transform(
                row,
                lambda x: F.when(
                    (x > 0) & (F.lit(True) if start == "uniform" else (i == 0)), 1.0 / F.sqrt(amount)
                ).otherwise(0.0),
            ),
        )

    def dot(a, psi):
        return F.aggregate(F.zip_with(a, psi, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def run(directions):
        def one_round(psi, _):
            mixed = F.zip_with(
                psi,
                directions,
                lambda row, a: let(dot(a, row), lambda s: F.zip_with(a, row, lambda x, y: 2.0 * x * s - y)),
            )
            return let(
                mixed,
                lambda m: F.transform(_index(n), lambda i: F.transform(m, lambda row: F.get(row, i))),
            )

        return F.aggregate(F.sequence(F.lit(1), F.lit(k)), let(held, begin), one_round)

    if start == "uniform":
        held = F.aggregate(F.transform("w", count), F.lit(0.0), lambda s, x: s + x)
    else:
        held = count(F.get("w", F.lit(0)))
    psi = let(held, begin) if k == 0 else let(F.transform("w", direction), run)
    scores = F.transform(psi, lambda row: F.aggregate(row, F.lit(0.0), lambda s, x: s + x * x))
    return packed.withColumn(name, _normalised(scores))


def score_rows(scored: DataFrame, name: str = "score") -> DataFrame:
    """(dt, node, rank, score): rank is the growth order."""
    return scored.select("dt", F.posexplode(F.arrays_zip("ids", name)).alias("rank", "_z")).select(
        "dt", F.col("_z.ids").alias("node"), "rank", F.col(f"_z.{name}").alias("score")
    )


def dispersion_exponent(walked: DataFrame) -> DataFrame:
    """(topology, k, rms_mean, rms_sd, n, exponent) from rows (topology, k, dt, score, dist).

    The spread of a walk is sqrt(sum p d^2); the exponent is the slope of
    ln(mean spread) on ln(k) over the k with a positive spread, NULL when
    fewer than three remain.
    """
    spread = F.sqrt(
        F.aggregate(
            F.zip_with("score", "dist", lambda p, d: p * d * d), F.lit(0.0), lambda s, x: s + x
        )
    )
    per_k = (
        walked.withColumn("_r", spread)
        .groupBy("topology", "k")
        .agg(
            F.avg("_r").alias("rms_mean"),
            F.stddev_samp("_r").alias("rms_sd"),
            F.count("*").alias("n"),
        )
    )
    use = F.col("rms_mean") > 1e-9
    slope = per_k.groupBy("topology").agg(
        F.when(
            F.sum(use.cast("int")) >= 3,
            F.regr_slope(F.when(use, F.log("rms_mean")), F.when(use, F.log("k"))),
        ).alias("exponent")
    )
    return per_k.join(slope, "topology")
