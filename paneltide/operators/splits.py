"""Chronological splits and episode sampling.

The inputs are aligned panels with the calendar position ``t``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paneltide.functions.draws import draw_int


def calendar(panel: DataFrame) -> DataFrame:
    """Distinct dates with their position."""
    return panel.select("dt", "t").distinct()


def chronological_split(cal: DataFrame, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """Label each date train, val or test; an error if a part would be empty."""
    if not (0 < train < 1 and 0 < val < 1 and train + val < 1):
        raise ValueError("fractions must be in (0, 1) and leave room for test")
    n = cal.agg(F.count("*").alias("n"))
    size = n.select("n").scalar()
    n_train = F.floor(size * F.lit(train))
    n_val = F.floor(size * F.lit(val))
    valid = (n_train >= 1) & (n_val >= 1) & (size - n_train - n_val >= 1)
    part = (
        F.when(~valid, F.raise_error(F.lit("the calendar is too short: a part of the split is empty")))
        .when(F.col("t") < n_train, "train")
        .when(F.col("t") < n_train + n_val, "val")
        .otherwise("test")
    )
    return cal.withColumn("part", part)


def holdout_split(cal: DataFrame, tuning_end: str, holdout_start: str | None = None) -> DataFrame:
    """Two disjoint blocks: up to ``tuning_end`` and from ``holdout_start`` on.

    Without a start the hold-out begins on the next date there is. An empty
    block is an error.
    """
    if holdout_start is not None and holdout_start <= tuning_end:
        raise ValueError("holdout_start must be after tuning_end")
    end = F.to_date(F.lit(tuning_end))
    start = (
        cal.where(F.col("dt") > end).agg(F.min("dt")).scalar()
        if holdout_start is None
        else F.to_date(F.lit(holdout_start))
    )
    ends = cal.agg(F.min("dt").alias("first"), F.max("dt").alias("last"))
    filled = (ends.select("first").scalar() <= end) & F.coalesce(ends.select("last").scalar() >= start, F.lit(False))
    block = F.when(~filled, F.raise_error(F.lit("the tuning or the hold-out block is empty"))).when(
        F.col("dt") <= end, "tuning"
    )
    return cal.withColumn("block", block.when(F.col("dt") >= start, "holdout")).where(F.col("block").isNotNull())


def walk_forward_folds(
    cal: DataFrame, first_year: int, test_years: list[int], val: float = 0.01
) -> DataFrame:
    """One fold per test year Y: train on first_year..Y-1, test on Y.

    The train share is by whole years; every date is repeated for the folds it
    belongs to and split by its position in the fold.
    """
    year = F.year("dt")
    folds = F.array(*[F.lit(y) for y in test_years])
    member = (
        cal.where(year >= first_year)
        .withColumn("test_year", F.explode(folds))
        .where(F.year("dt") <= F.col("test_year"))
    )
    bounds = member.groupBy("test_year").agg(F.min("t").alias("t0"), F.count("*").alias("n"))
    years = F.col("test_year") - first_year
    out = member.join(bounds, "test_year").withColumn("train_frac", years / (years + 1))
    n_train = F.floor(F.col("n") * F.col("train_frac"))
    n_val = F.floor(F.col("n") * F.lit(val))
    pos = F.col("t") - F.col("t0")
    return out.select(
        "test_year",
        "dt",
        "t",
        "train_frac",
        F.when(pos < n_train, "train").when(pos < n_train + n_val, "val").otherwise("test").alias("part"),
    )


def episode_starts(
    cal: DataFrame,
    n_episodes: int,
    window: int,
    max_steps: int,
    mode: str = "sequential",
    seeds: list[int] = (0,),
) -> DataFrame:
    """(seed, episode, start): where each episode begins on the calendar.

    ``sequential`` steps by max_steps from the first position with a full
    window and wraps; ``random`` draws from the valid range. A calendar
    shorter than a window and an episode is an error.
    """
    if mode not in ("sequential", "random"):
        raise ValueError(f"unknown mode {mode!r}")
    lo = window - 1
    hi = F.col("n") - max_steps - 1
    too_short = F.raise_error(F.lit(f"the calendar is shorter than a window of {window} and {max_steps} steps"))
    base = (
        cal.agg(F.count("*").alias("n"))
        .withColumn("n", F.when(F.col("n") >= window + max_steps, F.col("n")).otherwise(too_short.cast("bigint")))
        .withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
        .withColumn("episode", F.explode(F.sequence(F.lit(0), F.lit(n_episodes - 1))))
    )
    if mode == "sequential":
        turns = F.floor((hi - lo) / F.lit(max_steps)) + 1
        start = lo + (F.col("episode") % turns) * max_steps
    else:
        start = lo + draw_int(hi - lo + 1, "start", F.col("seed"), F.col("episode"))
    return base.select("seed", "episode", start.cast("int").alias("start"))


def episode_steps(starts: DataFrame, cal: DataFrame, max_steps: int) -> DataFrame:
    """(seed, episode, step, dt, t): up to max_steps, none on the last date.

    The last date has no next return, so an episode ends before it.
    """
    last = cal.agg(F.max("t")).scalar()
    walk = starts.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(max_steps - 1))))
    walk = walk.withColumn("t", F.col("start") + F.col("step")).where(F.col("t") < last)
    return walk.join(cal, "t").select("seed", "episode", "step", "dt", "t")
