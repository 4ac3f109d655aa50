"""Scoring logged policies: softmax under masks and biases, advantages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

EPS_BIAS = 1e-8


def masked_softmax(logits: DataFrame, key: list[str], on_empty: str = "error") -> DataFrame:
    """Adds ``prob`` and ``log_prob`` over the allowed actions of each step.

    Actions that are not allowed get probability 0 and no log-probability. A
    step without any allowed action is an error, or NULL on request.
    """
    step = Window.partitionBy(*key)
    logit = F.when(F.col("allowed"), F.col("logit"))
    top = F.max(logit).over(step)
    shifted = logit - top
    if on_empty == "error":
        failed = F.raise_error(F.lit("a step has no allowed action")).cast("double")
        shifted = F.when(top.isNull(), failed).otherwise(shifted)
    df = logits.withColumn("_z", shifted)
    total = F.sum(F.exp("_z")).over(step)
    log_prob = F.col("_z") - F.log(total)
    return df.withColumn("log_prob", log_prob).withColumn(
        "prob", F.when(F.col("allowed"), F.exp("log_prob")).when(total.isNotNull(), 0.0)
    ).drop("_z")


def masked_entropy(scored: DataFrame, key: list[str]) -> DataFrame:
    """-sum p ln p per step; actions that are not allowed add nothing."""
    return scored.groupBy(*key).agg(
        (-F.sum(F.when(F.col("prob") > 0, F.col("prob") * F.col("log_prob")))).alias("entropy")
    )


def walk_bias(
    scored_rows: DataFrame, cal: DataFrame, panel: DataFrame, beta: float = 1.0
) -> DataFrame:
    """(dt, asset, bias): beta * ln(p + 1e-8) inside the neighbourhood.

    Assets outside it are left out (their bias is minus infinity); dates
    without a neighbourhood have bias 0 for every asset. ``scored_rows`` has
    (dt, node, score).
    """
    inside = scored_rows.select(
        "dt", F.col("node").alias("asset"), (beta * F.log(F.col("score") + EPS_BIAS)).alias("bias")
    )
    missing = cal.join(inside.select("dt").distinct(), "dt", "left_anti").select("dt")
    free = panel.join(missing, "dt", "left_semi").select("dt", "asset", F.lit(0.0).alias("bias"))
    return inside.unionByName(free)


def biased_softmax(logits: DataFrame, bias: DataFrame) -> DataFrame:
    """Softmax of logit + bias per date; a mask is a bias of 0 or minus infinity."""
    joined = logits.join(bias, ["dt", "asset"]).select(
        "dt", "asset", (F.col("logit") + F.col("bias")).alias("logit"), F.lit(True).alias("allowed")
    )
    return masked_softmax(joined, ["dt"]).select("dt", "asset", "prob", "log_prob")


def trajectory_gae(
    steps: DataFrame, gamma: float = 0.99, lam: float = 0.95, bucket: str = "day", chunk: int = 512
) -> DataFrame:
    """Generalised advantages over logged trajectories.

    delta = r + gamma * V' * (1 - done) - V and
    A = delta + gamma * lam * (1 - done) * A', backwards in time; the last
    step of a trajectory has no successor and V' = A' = 0.

    A trajectory may be long, so it is never laid out in one task: it is split
    into time buckets, each bucket into chunks of ``chunk`` steps, and inside
    a chunk the recursion is a running sum of discounted deltas. Between
    chunks only one row per chunk is carried back.
    """
    c = gamma * lam
    # 1. order inside (trajectory, bucket) and number the chunks
    bucketed = steps.withColumn("_b", F.date_trunc(bucket, "ts"))
    in_bucket = Window.partitionBy("traj", "_b").orderBy("ts", "event_id")
    numbered = bucketed.withColumn("_n", F.row_number().over(in_bucket) - 1).withColumn(
        "_c", F.floor(F.col("_n") / chunk)
    )
    piece = Window.partitionBy("traj", "_b", "_c")
    forward = piece.orderBy("_n")
    # 2. what a chunk must know of its successor (the first value estimate) and
    #    of its predecessors (their length); first inside a bucket, then
    #    between buckets, of which there are as many as the calendar has
    heads = numbered.groupBy("traj", "_b", "_c").agg(
        F.min_by("v", "_n").alias("_v0"), F.count("*").alias("_len")
    )
    inside = Window.partitionBy("traj", "_b").orderBy("_c")
    between = Window.partitionBy("traj").orderBy("_b")
    before = (Window.unboundedPreceding, -1)
    buckets = (
        heads.groupBy("traj", "_b")
        .agg(F.min_by("_v0", "_c").alias("_bv0"), F.sum("_len").alias("_blen"))
        .withColumn("_bv_next", F.lead("_bv0").over(between))
        .withColumn("_bfirst", F.coalesce(F.sum("_blen").over(between.rowsBetween(*before)), F.lit(0)))
    )
    heads = (
        heads.join(buckets, ["traj", "_b"])
        .withColumn("_v_next", F.coalesce(F.lead("_v0").over(inside), F.col("_bv_next")))
        .withColumn(
            "_first",
            F.col("_bfirst") + F.coalesce(F.sum("_len").over(inside.rowsBetween(*before)), F.lit(0)),
        )
        .select("traj", "_b", "_c", "_len", "_v_next", "_first")
    )
    live = 1.0 - F.col("done")
    rows = numbered.join(heads, ["traj", "_b", "_c"]).withColumn(
        "_vn", F.coalesce(F.lead("v").over(forward), F.col("_v_next"), F.lit(0.0))
    ).withColumn("_d", F.col("reward") + gamma * F.col("_vn") * live - F.col("v"))
    # 3. a finished episode cuts the recursion: segments end at done steps
    back = piece.orderBy(F.desc("_n"))
    rows = rows.withColumn(
        "_seg", F.coalesce(F.sum("done").over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + F.col("done")
    ).withColumn("_pos", F.col("_n") - F.col("_c") * chunk)
    seg_back = Window.partitionBy("traj", "_b", "_c", "_seg").orderBy(F.desc("_n"))
    discount = F.pow(F.lit(c), F.col("_pos"))
    local = F.sum(discount * F.col("_d")).over(
        seg_back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ) / discount
    rows = rows.withColumn("_a", local)
    # 4. carry the advantage of the next chunk's first step back into the open
    #    segment (the one after the chunk's last done step)
    ends = rows.groupBy("traj", "_b", "_c").agg(
        F.min_by("_a", "_n").alias("_a0"),
        F.min_by("_seg", "_n").alias("_seg0"),
        F.max("_len").alias("_len"),
    )
    carried = _carry_back(ends, c)
    gap = F.col("_len") - F.col("_pos")
    extra = F.when(F.col("_seg") == 0, F.pow(F.lit(c), gap) * F.coalesce("_next", F.lit(0.0))).otherwise(0.0)
    adv = F.col("_a") + extra
    return rows.join(carried, ["traj", "_b", "_c"]).select(
        "traj",
        (F.col("_first") + F.col("_n") - F.col("_c") * chunk).cast("long").alias("step"),
        "event_id",
        adv.alias("advantage"),
        (adv + F.col("v")).alias("ret"),
    )


def _carry_back(ends: DataFrame, c: float) -> DataFrame:
    """(traj, _b, _c, _next): the advantage at the start of the following chunk.

    One row per chunk. A(chunk) = a0 + f * A(next chunk) with f = c^length while
    the episode is open, else 0. These maps are composed per bucket, the
    buckets of a trajectory are folded, and the values go back to the chunks.
    """
    factor = F.when(F.col("_seg0") == 0, F.pow(F.lit(c), F.col("_len"))).otherwise(F.lit(0.0))
    chunks = ends.withColumn("_f", factor).groupBy("traj", "_b").agg(
        F.sort_array(F.collect_list(F.struct("_c", "_a0", "_f")), asc=False).alias("_s")
    )
    whole = F.aggregate(
        "_s",
        F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("f")),
        lambda acc, x: F.struct(
            (x["_a0"] + x["_f"] * acc["a"]).alias("a"), (x["_f"] * acc["f"]).alias("f")
        ),
    )
    summary = chunks.withColumn("_w", whole).select("traj", "_b", F.col("_w.a").alias("_a0"), F.col("_w.f").alias("_f"))
    buckets = summary.groupBy("traj").agg(
        F.sort_array(F.collect_list(F.struct("_b", "_a0", "_f")), asc=False).alias("_s")
    )
    after = (
        buckets.withColumn("_o", _values_after(F.lit(0.0)))
        .select("traj", F.explode(F.arrays_zip("_s", "_o")).alias("_z"))
        .select("traj", F.col("_z._s._b").alias("_b"), F.col("_z._o").alias("_bnext"))
    )
    return (
        chunks.join(after, ["traj", "_b"])
        .withColumn("_o", _values_after(F.col("_bnext")))
        .select("traj", "_b", F.explode(F.arrays_zip("_s", "_o")).alias("_z"))
        .select("traj", "_b", F.col("_z._s._c").alias("_c"), F.col("_z._o").alias("_next"))
    )


def _values_after(last: Column) -> Column:
    """For the pieces in ``_s``, latest first: the value just after each piece."""
    return F.aggregate(
        "_s",
        F.struct(last.alias("a"), F.array().cast("array<double>").alias("out")),
        lambda acc, x: F.struct(
            (x["_a0"] + x["_f"] * acc["a"]).alias("a"),
            F.concat(acc["out"], F.array(acc["a"])).alias("out"),
        ),
        lambda acc: acc["out"],
    )
