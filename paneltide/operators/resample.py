"""Bootstrap resampling without a row per draw.

A replicate draws n of n values with replacement. The values are numbered and dealt into
chunks of ``CHUNK``; how many of the n draws fall into each chunk is split off by one binomial
after the other, which is exactly multinomial. So a chunk's values can be drawn on their own, by
hashes of (replicate, chunk, draw), and a task adds up the drawn values of all its chunks to one
array of sums per sample and block of replicates. Only these arrays are shuffled: their number does not
grow with n. Samples of equal size share their draws.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType, StructType

from paneltide.functions.draws import TWO_32, draw, draw_int, hashed
from paneltide.session import cut


CHUNK = 64  # values drawn from together
BLOCK = 500  # replicates of one row
AHEAD = 16  # chunks whose draws are split off by one call
WIDTH = 4096  # order numbers counted together


def indexed(values: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, j, n, x): the values of a sample numbered from 0.

    By an integer order, values are numbered within ranges of it, and only the ranges'
    counts are added up per sample, so no sample is sorted in one task.
    """
    rows = values.select(*keys, F.col(order).alias("_o"), F.col(value).alias("x"))
    if not isinstance(rows.schema["_o"].dataType, IntegralType):
        by = Window.partitionBy(*keys)
        return rows.select(*keys, (F.row_number().over(by.orderBy("_o")) - 1).alias("j"), F.count("*").over(by).cast("int").alias("n"), "x")
    rows = rows.withColumn("_g", F.floor(F.col("_o") / WIDTH))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "_g").agg(F.count("*").alias("_n")).select(
        *keys, "_g", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(whole).cast("int").alias("n")
    )
    place = F.row_number().over(Window.partitionBy(*keys, "_g").orderBy("_o")) - 1 + F.col("_before")
    return rows.join(counts, [*keys, "_g"]).select(*keys, place.cast("int").alias("j"), "n", "x")


def _binomial(u: np.ndarray, m: np.ndarray, p: float) -> np.ndarray:
    """Binomial quantiles: the least k whose distribution function reaches u."""
    k = np.zeros(len(u), np.int64)
    mass = (1.0 - p) ** m
    total, left = mass.copy(), m.astype(float)
    for step in range(int(m.max(initial=0))):
        up = total < u
        if not up.any():
            break
        k += up  # a total that has reached u does not fall below it again
        mass *= left
        mass /= step + 1
        mass *= p
        mass /= 1.0 - p
        total += mass
        left -= 1.0
    return np.minimum(k, m)


def _splitting(n: int, first: int, size: int, tag: str) -> Iterator[np.ndarray]:
    """How many of the n draws of replicates ``first`` and on fall into each chunk of n values, chunk by chunk."""
    chunks, left = -(-n // CHUNK), np.full(size, n)
    for c in range(0, chunks - 1, AHEAD):
        some = np.arange(c, min(c + AHEAD, chunks - 1))
        keys = np.tile(np.arange(first, first + size), len(some)), np.repeat(some, size)
        for at, u in zip(some, (hashed(tag, "split", n, *keys)[0] / TWO_32).reshape(len(some), size)):
            out = _binomial(u, left, CHUNK / (n - CHUNK * int(at)))
            left = left - out
            yield out
    yield left


def chunk_draws(n: int, first: int, size: int, tag: str) -> np.ndarray:
    """(chunks, size): how many of the n draws of replicates ``first`` and on fall into each chunk of n values."""
    return np.array(list(_splitting(n, first, size, tag)))


def chunk_counts(n: int, chunk: int, first: int, draws: np.ndarray, tag: str) -> np.ndarray:
    """(replicates, values): how often each value of a chunk is drawn. One hash gives four draws."""
    width, m = min(CHUNK, n - CHUNK * chunk), np.asarray(draws, np.int64)
    hashes = -(-m // 4)
    row = np.repeat(np.arange(len(m)), hashes)
    q = np.arange(len(row)) - np.repeat(np.cumsum(hashes) - hashes, hashes)
    value = (hashed(tag, n, first + row, chunk, q).astype(np.uint64) * np.uint64(width)) >> np.uint64(32)
    cell = value.astype(np.int64) + row * width
    for k in range(1, 4):  # the last hash of a replicate may have too many
        cell[k, 4 * q + k >= m[row]] = len(m) * width
    return np.bincount(cell.ravel(), minlength=len(m) * width + 1)[:-1].reshape(len(m), width).astype(float)


def _splits(tag: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n, first, size in zip(frame["n"], frame["first"], frame["size"]):
                draws = _splitting(int(n), int(first), int(size), tag)
                at = 0
                while part := [d.astype(np.int32) for d in islice(draws, 256)]:
                    yield pd.DataFrame({"n": n, "chunk": np.arange(at, at + len(part)), "first": first, "draws": part})
                    at += len(part)

    return run


def _sums(keys: list[str], tag: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last, counts = {}, None, None
        for frame in frames:
            for *key, n, chunk, first, draws, x in frame.itertuples(index=False):
                if last != (n, chunk, first):  # rows of a chunk and block follow each other
                    last, counts = (n, chunk, first), chunk_counts(n, chunk, first, draws, tag)
                sums = counts @ np.asarray(x, float)
                at = (*key, n, first)
                held[at] = held[at] + sums if at in held else sums
        if held:
            out = pd.DataFrame(list(held), columns=[*keys, "n", "first"])
            yield out.assign(sums=list(held.values()))

    return run


def bootstrap_mean(
    values: DataFrame, keys: list[str], order: str, value: str, n_boot: int, tag: str = "boot"
) -> DataFrame:
    """(keys, b, boot): ``n_boot`` means of samples drawn with replacement."""
    sample = indexed(values, keys, order, value)
    chunks = sample.groupBy(*keys, "n", F.floor(F.col("j") / CHUNK).cast("int").alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("j", "x")))["x"].alias("x")  # at most CHUNK values
    )
    chunks = cut(chunks)
    blocks = F.transform(
        F.sequence(F.lit(0), F.lit(n_boot - 1), F.lit(BLOCK)),
        lambda f: F.struct(f.alias("first"), F.least(F.lit(BLOCK), F.lit(n_boot) - f).alias("size")),
    )
    # small rows with much work each: a number of partitions that is not merged by size
    spark = values.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * max(8, spark.sparkContext.defaultParallelism))
    blocks = chunks.select("n").distinct().select("n", F.inline(blocks)).repartition(parts, "n", "first")
    splits = blocks.mapInPandas(_splits(tag), "n INT, chunk INT, first INT, draws ARRAY<INT>")
    # a chunk's few values are repeated per block, so the draws are shuffled once
    at = ["n", "chunk", "first"]
    spread = chunks.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1), F.lit(BLOCK))))
    joined = spread.join(splits.hint("merge"), at).select(*keys, *at, "draws", "x")
    dealt = joined.sortWithinPartitions(*at)
    schema = StructType([*(chunks.schema[k] for k in keys), *StructType.fromDDL("n INT, first INT, sums ARRAY<DOUBLE>")])
    sums = dealt.mapInPandas(_sums(keys, tag), schema).groupBy(*keys, "n", "first").agg(F.collect_list("sums").alias("parts"))  # one per task
    total = F.reduce(F.slice("parts", 2, F.size("parts")), F.get("parts", F.lit(0)), lambda a, p: F.zip_with(a, p, lambda x, y: x + y))
    return sums.select(*keys, "n", "first", F.posexplode(total).alias("i", "s")).select(
        *keys, (F.col("first") + F.col("i")).cast("int").alias("b"), (F.col("s") / F.col("n")).alias("boot")
    )


def paired_bootstrap(
    diffs: DataFrame, keys: list[str], n_boot: int = 5000, order: str = "seed", value: str = "d"
) -> DataFrame:
    """Mean, 95% interval and tail shares of bootstrapped means per key.

    Both tails include 0; the two-sided p is twice the smaller tail. When all
    differences are equal the interval is the mean and there are no p values.
    Groups with fewer than two values are left out.
    """
    clean = diffs.where(F.col(value).isNotNull() & ~F.isnan(value))
    base = clean.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.count("*").alias("n"), (F.min(value) == F.max(value)).alias("degenerate")
    ).where(F.col("n") >= 2)
    usable = clean.join(base.where(~F.col("degenerate")).select(*keys), keys, "left_semi")
    boots = bootstrap_mean(usable, keys, order, value, n_boot)
    # means within 1e-12 of zero count as zero: sums in another order may differ there
    m = F.when(F.abs("boot") < 1e-12, 0.0).otherwise(F.col("boot"))
    tails = boots.groupBy(*keys).agg(
        F.percentile("boot", 0.025).alias("_lo"),
        F.percentile("boot", 0.975).alias("_hi"),
        F.avg((m <= 0).cast("double")).alias("p_greater"),
        F.avg((m >= 0).cast("double")).alias("_ge"),
        F.avg((m > 0).cast("double")).alias("p_positive"),
    )
    return base.join(tails, keys, "left").select(
        *keys,
        "mean",
        F.coalesce("_lo", "mean").alias("ci_lo"),
        F.coalesce("_hi", "mean").alias("ci_hi"),
        "n",
        # least() skips NULL, so a missing p stays missing only by the guard
        F.when(F.col("p_greater").isNotNull(), F.least(F.lit(1.0), 2.0 * F.least("p_greater", "_ge"))).alias("p_two"),
        "p_greater",
        "p_positive",
        "degenerate",
    )


@lru_cache(maxsize=8)
def count_matrix(n: int, n_boot: int, tag: str = "boot") -> np.ndarray:
    """How often each of n values is drawn, (n_boot, n), for small n: the draws of ``bootstrap_mean``."""
    draws = chunk_draws(n, 0, n_boot, tag)
    return np.concatenate([chunk_counts(n, c, 0, d, tag) for c, d in enumerate(draws)], 1)


def bootstrap_p(n_boot: int):
    """A function of an array of values, in order: the two-sided p that ``paired_bootstrap`` gives.

    For very many small samples: one matrix product for the samples of a size in a batch.
    """

    @F.pandas_udf("double")
    def p_two(samples: pd.Series) -> pd.Series:
        out, size = np.full(len(samples), np.nan), samples.map(len).to_numpy()
        for n in np.unique(size[size > 1]):
            rows, counts = np.flatnonzero(size == n), count_matrix(int(n), n_boot).T
            for part in np.array_split(rows, -(-len(rows) // 500)):
                x = np.stack(samples.iloc[part].to_numpy())
                m = x @ counts / n
                m[np.abs(m) < 1e-12] = 0.0
                p = np.minimum(1.0, 2.0 * np.minimum((m <= 0).mean(1), (m >= 0).mean(1)))
                out[part] = np.where(x.min(1) < x.max(1), p, np.nan)
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    return p_two


def arm_summary(long: DataFrame, n_boot: int = 1000) -> DataFrame:
    """Mean, deviation, 95% interval of the mean and count per arm and metric."""
    clean = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    keys = ["arm", "metric"]
    ci = bootstrap_mean(clean, keys, "seed", "value", n_boot).groupBy(*keys).agg(
        F.percentile("boot", 0.025).alias("ci_lo"), F.percentile("boot", 0.975).alias("ci_hi")
    )
    base = clean.groupBy(*keys).agg(
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"),
        F.count("*").alias("n"),
    )
    return base.join(ci, keys)


def stationary_bootstrap(
    series: DataFrame, n_boot: int = 5000, mean_block: int = 20, eps: float = 1e-12
) -> DataFrame:
    """(name, b, sharpe) of series resampled in blocks of random length.

    ``series`` has (name, t, x) with t = 0..T-1. A replicate starts a block at
    a drawn position with chance 1 / mean_block and otherwise moves on by one,
    around the end. Each replicate is its own window partition.
    """
    length = series.groupBy("name").agg(F.count("*").cast("int").alias("len"))
    path = (
        length.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
        .repartition("name", "b")
        .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("len") - 1)))
    )
    key = (F.col("len"), F.col("b"), F.col("t"))
    restart = (F.col("t") == 0) | (draw("restart", *key) < 1.0 / mean_block)
    order = Window.partitionBy("name", "b").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    at = F.last(
        F.when(restart, F.struct(draw_int(F.col("len"), "start", *key).alias("p"), F.col("t").alias("t"))),
        ignorenulls=True,
    ).over(order)
    moved = path.withColumn("_s", at).select(
        "name", "b", ((F.col("_s.p") + F.col("t") - F.col("_s.t")) % F.col("len")).alias("t")
    )
    return (
        moved.join(series, ["name", "t"])
        .groupBy("name", "b")
        .agg((F.avg("x") / (F.stddev_samp("x") + eps)).alias("sharpe"))
    )
