"""The given tables, and the tables of this data model derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paneltide.session import cut


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def places(spark: SparkSession, folder: str) -> DataFrame:
    """(place, asset, sector): nation key, nation name and region name."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("place"), F.col("n_name").alias("asset"), F.col("r_name").alias("sector")
    )


def trades(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line item with the key of its place (the buyer's nation).

    Orders and customers are joined first, so the big table is shuffled once.
    Which sides are broadcast is left to the engine's size check. Names are
    not attached here: see ``named``.
    """
    owner = table(spark, folder, "orders").join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).select("o_orderkey", F.col("c_nationkey").alias("place"))
    return (
        table(spark, folder, "lineitem")
        .join(owner, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            "place",
            F.col("l_shipdate").alias("ts"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_quantity").alias("qty"),
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
        )
    )


def named(rows: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Attach asset and sector names to reduced rows, where it costs least."""
    return rows.join(places(spark, folder), "place").drop("place")


TRADE_TIE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

def arms_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Experiment ledger from ``events``: one row per (arm, seed).

    The arm is the event type, the seed the user; the events are reduced by partial
    aggregation first.
    """
    return (
        table(spark, folder, "events")
        .select(F.col("event_type").alias("arm"), F.col("user_id").alias("seed"), "value")
        .groupBy("arm", "seed")
        .agg(
            F.avg("value").alias("mean_value"),
            F.stddev_samp("value").alias("sd_value"),
            F.max("value").alias("max_value"),
            F.count("value").cast("double").alias("n_events"),
        )
    )


ARM_METRICS = ("mean_value", "sd_value", "max_value", "n_events")


def trajectories(spark: SparkSession, folder: str) -> DataFrame:
    """Logged steps per user in time order; the value estimate is the arm's mean.

    A step ends its episode when it is an ``error`` event.
    """
    ev = table(spark, folder, "events").select(
        F.col("user_id").alias("traj"), "ts", "event_id", F.col("event_type").alias("action"), "value"
    )
    # stored, so that the planner knows its size and need not shuffle the events
    base = cut(ev.groupBy("action").agg(F.avg("value").alias("v")))
    return ev.join(base, "action").select(
        "traj",
        "ts",
        "event_id",
        "action",
        F.col("value").alias("reward"),
        "v",
        (F.col("action") == "error").cast("double").alias("done"),
    )


def logits(spark: SparkSession, folder: str) -> DataFrame:
    """Scores per (step, action): standardised mean value of a user and event type.

    An action is allowed when the user's mean is not below the action's mean
    by more than one standard deviation. With a single user there is no
    deviation, and logit and allowed are NULL.
    """
    cell = cut(
        table(spark, folder, "events")
        .groupBy(F.col("user_id").alias("step"), F.col("event_type").alias("action"))
        .agg(F.avg("value").alias("m"))
    )
    base = cut(cell.groupBy("action").agg(F.avg("m").alias("mu"), F.stddev_samp("m").alias("sd")))
    return cell.join(base, "action").select(
        "step",
        "action",
        F.round((F.col("m") - F.col("mu")) / F.col("sd"), 9).alias("logit"),
        ((F.col("m") - F.col("mu")) / F.col("sd") > -1.0).alias("allowed"),
    )
