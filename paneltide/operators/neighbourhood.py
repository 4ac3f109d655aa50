"""Bounded neighbourhoods around a seed, and everything that stays inside them.

A neighbourhood has at most M nodes (8 by default), so once it is grown it is
kept as ONE row per date: ``ids`` in growth order and ``w``, its M x M weights.
All later steps (rewiring, distances, walks) are column expressions on that
row and need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paneltide.functions.columns import let
from paneltide.session import cut


def best_first_neighbourhood(edges: DataFrame, seeds: DataFrame, size: int = 8) -> DataFrame:
    """(dt, ids): grow from the seed by the strongest frontier edge.

    Ties go to the first name. Only the size - 1 strongest edges of a node can
    ever be used: when a weaker one is reached, all stronger ones have been
    taken and the neighbourhood is full. So each node keeps a short list, hubs
    included, and every round is one equi-join on (dt, node).
    """
    if size < 2:
        raise ValueError("size must be at least 2")
    strongest = Window.partitionBy("dt", "src").orderBy(F.desc("w"), "dst")
    lists = (
        edges.where((F.col("w") > 0) & (F.col("src") != F.col("dst")))
        .withColumn("_k", F.row_number().over(strongest))
        .where(F.col("_k") < size)
        .groupBy("dt", F.col("src").alias("node"))
        .agg(F.collect_list(F.struct((-F.col("w")).alias("nw"), F.col("dst").alias("node"))).alias("near"))
    )
    lists = cut(lists)  # every round joins them
    none = F.array().cast("array<struct<nw:double,node:string>>")
    state = seeds.select(
        "dt", F.col("seed").alias("node"), F.array("seed").alias("ids"), none.alias("front")
    )
    for _ in range(size - 1):
        grown = state.join(lists, ["dt", "node"], "left")
        front = F.filter(
            F.concat("front", F.coalesce("near", none)),
            lambda e: ~F.array_contains(F.col("ids"), e["node"]),
        )
        grown = grown.select("dt", "ids", front.alias("front"))
        best = F.array_min("front")["node"]
        state = grown.select(
            "dt",
            best.alias("node"),
            F.when(best.isNull(), F.col("ids")).otherwise(F.concat("ids", F.array(best))).alias("ids"),
            "front",
        )
    return state.select("dt", "ids")


def node_rows(hoods: DataFrame) -> DataFrame:
    """nodes(dt, node, rank); the seed has rank 0."""
    return hoods.select("dt", F.posexplode("ids").alias("rank", "node")).select("dt", "node", "rank")


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in the neighbourhood of their date."""
    src = nodes.select("dt", F.col("node").alias("src"))
    dst = nodes.select("dt", F.col("node").alias("dst"))
    return edges.join(src, ["dt", "src"], "left_semi").join(dst, ["dt", "dst"], "left_semi")


def pack(edges: DataFrame, hoods: DataFrame) -> DataFrame:
    """(dt, ids, w): add the induced weights as a matrix; isolated seeds are left out."""
    members = hoods.where(F.size("ids") >= 2).select("dt", "ids", F.explode("ids").alias("src"))
    inner = members.join(edges, ["dt", "src"]).where(F.array_contains("ids", F.col("dst")))
    weights = inner.groupBy("dt", "ids").agg(
        F.collect_list(F.struct(F.concat_ws("|", "src", "dst").alias("k"), "w")).alias("_l")
    )
    w = let(
        F.map_from_entries("_l"),
        lambda m: F.transform(
            "ids",
            lambda a: F.transform(
                F.col("ids"), lambda b: F.coalesce(F.element_at(m, F.concat_ws("|", a, b)), F.lit(0.0))
            ),
        ),
    )
    return weights.select("dt", "ids", w.alias("w"))


def matrix_edges(packed: DataFrame, w: Column | str = "w") -> DataFrame:
    """The non-zero entries of a packed matrix as rows (dt, src, dst, w)."""
    cols = [c for c in packed.columns if c not in ("ids", "w")]
    m = F.col(w) if isinstance(w, str) else w
    rows = packed.select(*cols, "ids", F.posexplode(m).alias("_i", "_row"))
    cells = rows.select(
        *cols, "ids", F.element_at("ids", F.col("_i") + 1).alias("src"), F.posexplode("_row").alias("_j", "w")
    )
    return cells.where(F.col("w") != 0).select(
        *cols, "src", F.element_at("ids", F.col("_j") + 1).alias("dst"), "w"
    )


def _square(n: Column, cell) -> Column:
    idx = F.sequence(F.lit(0), n - 1)
    return F.transform(idx, lambda i: F.transform(idx, lambda j: cell(i, j)))


def rewire_cycle(packed: DataFrame) -> DataFrame:
    """Visit the nearest unvisited node from the seed on, close the ring, weight 1.

    Needs at least 3 nodes; a smaller neighbourhood is an error.
    """
    n = F.size("ids")

    def visit(order, _):
        here = F.element_at(order, -1)
        left = F.filter(F.sequence(F.lit(0), n - 1), lambda j: ~F.array_contains(order, j))
        # array_min of (-weight, position): strongest first, then the earlier position
        nearest = F.array_min(
            F.transform(left, lambda j: F.struct((-F.get(F.get(F.col("w"), here), j)).alias("nw"), j.alias("j")))
        )["j"]
        return F.concat(order, F.array(nearest))

    tour = F.aggregate(F.sequence(F.lit(1), n - 1), F.array(F.lit(0)), visit)

    def ring(order):
        def cell(i, j):
            gap = F.abs(F.array_position(order, i) - F.array_position(order, j))
            return F.when((gap == 1) | (gap == n - 1), 1.0).otherwise(0.0)

        return _square(n, cell)

    small = F.raise_error(F.lit("a cycle needs at least 3 nodes")).cast(packed.schema["w"].dataType)
    return packed.withColumn("w", F.when(n >= 3, let(tour, ring)).otherwise(small))


def rewire_bipartite(packed: DataFrame, facts: DataFrame) -> DataFrame:
    """Complete bipartite graph: majority sector against the rest.

    With one sector only, nodes at or above the median score against the
    rest; if that does not split either, the first half. ``facts`` has
    (dt, asset, sector, score).
    """
    nodes = packed.select("dt", F.posexplode("ids").alias("rank", "asset"))
    known = (
        nodes.join(facts, ["dt", "asset"])
        .groupBy("dt")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "sector", "score"))).alias("_f"))
    )
    size = F.size("_f")
    sectors = F.transform("_f", lambda x: x["sector"])
    scores = F.array_sort(F.transform("_f", lambda x: x["score"]))
    counts = F.transform(
        F.array_distinct(sectors),
        lambda s: F.struct((-F.size(F.filter(F.col("_sec"), lambda x: x == s))).alias("n"), s.alias("s")),
    )
    median = (F.get("_sco", F.floor((size - 1) / 2).cast("int")) + F.get("_sco", F.floor(size / 2).cast("int"))) / 2
    half = F.floor(size / 2)
    by_sector = F.transform("_sec", lambda s: s == F.col("_major"))
    by_score = F.transform("_f", lambda x: x["score"] >= F.col("_median"))
    by_rank = F.transform("_f", lambda x: x["rank"] < half)

    def splits(flags):
        return F.array_contains(flags, True) & F.array_contains(flags, False)

    side = (
        known.withColumn("_sec", sectors)
        .withColumn("_sco", scores)
        .withColumn("_major", F.array_min(counts)["s"])
        .withColumn("_median", median)
        .select(
            "dt",
            F.when(splits(by_sector), by_sector)
            .when(splits(by_score), by_score)
            .otherwise(by_rank)
            .alias("_side"),
        )
    )

    def cell(i, j):
        return F.when(F.get("_side", i) != F.get("_side", j), 1.0).otherwise(0.0)

    return packed.join(side, "dt").withColumn("w", _square(F.size("ids"), cell)).drop("_side")


def rewire_degree_capped(packed: DataFrame, d: int = 3, uniform: bool = False) -> DataFrame:
    """Take the strongest pairs while both ends have fewer than ``d`` edges.

    ``uniform`` gives weight 1; otherwise the kept weights (at least 1e-6) are
    scaled by their maximum.
    """
    n = F.size("ids")
    idx = F.sequence(F.lit(0), n - 1)
    pairs = F.array_sort(
        F.flatten(
            F.transform(
                idx,
                lambda i: F.transform(
                    F.filter(idx, lambda j: j > i),
                    lambda j: F.struct(
                        (-F.get(F.get(F.col("w"), i), j)).alias("nw"), i.alias("i"), j.alias("j")
                    ),
                ),
            )
        )
    )
    zero = F.struct(
        F.array_repeat(F.lit(0), n).alias("deg"), F.array().cast("array<string>").alias("kept")
    )

    def take(acc, p):
        free = (F.get(acc["deg"], p["i"]) < d) & (F.get(acc["deg"], p["j"]) < d)
        deg = F.transform(
            acc["deg"],
            lambda x, at: x + F.when(free & ((at == p["i"]) | (at == p["j"])), 1).otherwise(0),
        )
        kept = F.when(free, F.concat(acc["kept"], F.array(F.concat_ws("-", p["i"], p["j"])))).otherwise(
            acc["kept"]
        )
        return F.struct(deg.alias("deg"), kept.alias("kept"))

    kept = F.aggregate(pairs, zero, take, lambda acc: acc["kept"])

    def matrix(names):
        def cell(i, j):
            name = F.concat_ws("-", F.least(i, j), F.greatest(i, j))
            weight = F.lit(1.0) if uniform else F.greatest(F.get(F.get(F.col("w"), i), j), F.lit(1e-6))
            return F.when(F.array_contains(names, name), weight).otherwise(0.0)

        return _square(n, cell)

    def scaled(m):
        return let(
            F.array_max(F.transform(m, lambda r: F.array_max(r))),
            lambda top: F.transform(
                m, lambda r: F.transform(r, lambda x: F.when(top > 0, x / (top + 1e-12)).otherwise(x))
            ),
        )

    capped = let(kept, matrix)
    return packed.withColumn("w", capped if uniform else let(capped, scaled))


def hop_distance(packed: DataFrame) -> DataFrame:
    """(dt, ids, dist): unweighted distance from the seed; unreachable counts as M."""
    n = F.size("ids")
    start = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == 0, 0).otherwise(n))

    def relax(dist, _):
        return F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda j: F.least(
                F.get(dist, j),
                F.array_min(
                    F.transform(
                        dist, lambda x, i: F.when(F.get(F.get(F.col("w"), i), j) > 0, x + 1).otherwise(n)
                    )
                ),
            ),
        )

    dist = F.aggregate(F.sequence(F.lit(1), n - 1), start, relax)
    return packed.withColumn("dist", dist)
