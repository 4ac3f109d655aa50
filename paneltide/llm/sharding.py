"""Consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells; a key's cell is the top bits of its hash.
Each shard owns many virtual nodes, each at the start of a cell chosen by hash,
and a key belongs to the first node at or after its cell. Shards have a capacity;
keys that a full shard cannot take continue clockwise to the next node of a shard
with room. Capacities add up to the number of keys, so every shard ends exactly
full: counts differ by at most one, and only overflowing keys leave home.

The walk runs on counts. Keys are ranked within their cell; in a round the pending
keys of all cells ask at once, each shard takes them in ring order up to its room,
and the rest move on. Each round fills a shard or ends the walk, so there are at
most as many rounds as shards. The tables of a round have one row per cell (a
parameter), never one per key.

Cases: null ids and texts are hashed as such; repeated rows share a point of the
ring and spread as they overflow; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from paneltide.session import cut

CELLS_LOG2 = 14
VIRTUAL = 64


def cell_of(*key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*key), 64 - CELLS_LOG2).cast("int")


def ring(spark: SparkSession, shards: int, virtual: int = VIRTUAL) -> DataFrame:
    """(cell, shard) of the nodes that a key can reach, one per cell; a shard's nodes do not depend on the others."""
    points = spark.range(shards * virtual, numPartitions=1).select(
        (F.col("id") % shards).cast("int").alias("shard"),
        cell_of(F.lit("node"), F.col("id") % shards, F.floor(F.col("id") / shards)).alias("cell"),
    )
    return points.groupBy("cell").agg(F.min("shard").alias("shard"))


def _grid(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """(cell, at, shard): every cell, with its node if it has one."""
    grid = spark.range(1 << CELLS_LOG2, numPartitions=1).select(F.col("id").cast("int").alias("cell"))
    return grid.join(nodes.withColumn("at", F.col("cell")), "cell", "left")


def _onward(grid: DataFrame, is_open: Column) -> DataFrame:
    """(cell, node, shard): for each cell the first node of an open shard at or after it, around the ring."""
    ahead = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    node = F.when(is_open, F.struct("at", "shard"))
    first = F.coalesce(F.last(node, ignorenulls=True).over(ahead), F.min(node).over(whole))
    return grid.select("cell", first.alias("node")).select("cell", F.col("node.at").alias("node"), "node.shard")


def walk(spark: SparkSession, counts: DataFrame, shards: int, virtual: int = VIRTUAL) -> DataFrame:
    """(cell, start, n, shard, slot): runs of ranks of each cell and where they go.

    ``counts`` has (cell, n). Slots of a shard are numbered from 0 without gaps.
    Between rounds only the load of each shard, one number, comes to the driver.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    grid = cut(_grid(spark, ring(spark, shards, virtual)))
    pending = counts.select("cell", F.col("cell").alias("at"), F.lit(0).cast("long").alias("start"), "n")
    done = []
    while True:
        is_open = F.col("shard").isin([s for s in range(shards) if used[s] < room[s]])
        free = F.get(F.array(*[F.lit(r - u).cast("long") for r, u in zip(room, used)]), F.col("shard"))
        load = F.get(F.array(*[F.lit(u).cast("long") for u in used]), F.col("shard"))
        asked = pending.join(_onward(grid, is_open).withColumnRenamed("cell", "at"), "at")
        turn = Window.partitionBy("shard").orderBy("cell", "start").rowsBetween(Window.unboundedPreceding, -1)
        took = cut(
            asked.withColumn("before", F.coalesce(F.sum("n").over(turn), F.lit(0)))
            .withColumn("taken", F.greatest(F.lit(0).cast("long"), F.least("n", free - F.col("before"))))
            .select("cell", "node", "start", "n", "taken", "shard", (load + F.col("before")).alias("slot"))
        )
        done.append(took.where("taken > 0").select("cell", "start", F.col("taken").alias("n"), "shard", "slot"))
        left = False
        for row in took.groupBy("shard").agg(F.sum("taken").alias("taken"), F.sum("n").alias("n")).collect():
            used[row["shard"]] += row["taken"]
            left = left or row["n"] > row["taken"]
        if not left:
            break
        pending = took.where("taken < n").select(
            "cell", F.col("node").alias("at"), (F.col("start") + F.col("taken")).alias("start"), (F.col("n") - F.col("taken")).alias("n")
        )
    return reduce(DataFrame.unionByName, done)


def assign(docs: DataFrame, shards: int, virtual: int = VIRTUAL) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row of ``docs`` in a shard.

    Size is the UTF-8 length of the text plus 8. Only ids, sizes and checksums are
    shuffled, once, by cell; the runs of a cell come as one array row.
    """
    spark = docs.sparkSession
    keys = cut(
        docs.select(
            "doc_id",
            (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
            cell_of(F.lit("key"), F.col("doc_id")).alias("cell"),
        )
    )
    runs = cut(walk(spark, cut(keys.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))), shards, virtual))
    packed = runs.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("start", "n", "shard", "slot"))).alias("runs"))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("doc_id", "text_crc32", "size")) - 1
    placed = keys.withColumn("rank", rank).join(packed, "cell")
    run = F.get(F.filter("runs", lambda r: (r["start"] <= F.col("rank")) & (F.col("rank") < r["start"] + r["n"])), F.lit(0))
    return placed.withColumn("run", run).select(
        "doc_id",
        "size",
        "text_crc32",
        F.col("run.shard").alias("shard"),
        (F.col("run.slot") + F.col("rank") - F.col("run.start")).cast("long").alias("slot"),
    )
