"""One similarity graph per date, from rolling correlations of returns.

All dates are computed in one plan. The N x N correlation matrices are never
laid out as rows for the graph itself: the panel is cut into blocks of assets
and chunks of dates, each pair of blocks is one bounded matrix product, and
only the k strongest neighbours per node leave a block pair. The k best of a
row are among the k best of its blocks, so the result is exact.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from paneltide.functions.draws import draw
from paneltide.session import cut

DIGITS = 12  # weights and scores are rounded to this before they are ranked


@dataclass(frozen=True)
class GraphParams:
    window: int = 60
    min_rows: int = 2
    alpha: float = 0.7
    beta: float = 0.3
    eps: float = 1e-8
    k: int = 5
    sym_mode: str = "avg"
    asset_block: int = 256
    date_chunk: int = 256

    def check(self) -> None:
        if abs(self.alpha + self.beta - 1.0) > 1e-6:
            raise ValueError("alpha + beta must be 1")
        if self.k < 1 or self.min_rows < 2:
            raise ValueError("k must be at least 1 and min_rows at least 2")
        if self.sym_mode not in ("avg", "mutual", "max"):
            raise ValueError(f"unknown sym_mode {self.sym_mode!r}")


def _window_corr(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Correlation of every column of ``left`` with every column of ``right``.

    Constant columns have no correlation and give 0.
    """

    def unit(x):
        c = x - x.mean(axis=0)
        flat = np.ptp(x, axis=0) == 0.0
        norm = np.sqrt((c * c).sum(axis=0))
        norm[flat | (norm == 0.0)] = np.inf
        return c / norm

    return unit(left).T @ unit(right)


def _block_kernel(params: GraphParams, keep: int | None, mode: str):
    """Rows of one (date chunk, block pair) -> correlations or affinities.

    ``keep`` limits each node to its strongest neighbours within the block
    pair and emits both directions; without it, every unordered pair.
    """
    window, chunk = params.window, params.date_chunk
    nothing = pd.DataFrame({c: pd.Series([], dtype=object) for c in ("dt", "src", "dst", "a")})

    def run(key: Any, pdf: pd.DataFrame) -> pd.DataFrame:
        chunk_id, left_block, right_block = (int(k) for k in key)
        wide = pdf.pivot(index="t", columns="asset", values="r").sort_index()
        dates = pdf.drop_duplicates("t").set_index("t")["dt"]
        facts = pdf.drop_duplicates("asset").set_index("asset")
        names = np.array(wide.columns, dtype=object)
        block = facts.loc[names, "block"].to_numpy()
        sector = facts.loc[names, "sector"].to_numpy()
        x = wide.to_numpy(dtype=float)
        ts = wide.index.to_numpy()
        li, ri = np.flatnonzero(block == left_block), np.flatnonzero(block == right_block)
        same = (sector[li][:, None] == sector[ri][None, :]).astype(float)
        same_block = left_block == right_block
        out = []
        if len(li) == 0 or len(ri) == 0:
            return nothing
        for pos in np.flatnonzero(ts // chunk == chunk_id):
            lo = int(np.searchsorted(ts, ts[pos] - window + 1))
            if pos - lo + 1 < params.min_rows:
                continue
            corr = np.clip(_window_corr(x[lo : pos + 1][:, li], x[lo : pos + 1][:, ri]), -1, 1)
            corr = np.maximum(corr, 0.0)
            if mode == "corr":
                value = np.round(corr, DIGITS)
            else:
                value = np.round(params.alpha * corr + params.beta * same, DIGITS)
            dt = dates.loc[ts[pos]]
            if keep is None:
                ok = names[li][:, None] != names[ri][None, :]
                if same_block:
                    ok &= np.arange(len(li))[:, None] < np.arange(len(ri))[None, :]
                a, b = np.nonzero(ok)
                first, second, v = names[li][a], names[ri][b], value[a, b]
                swap = first > second
                first, second = np.where(swap, second, first), np.where(swap, first, second)
                out.append(pd.DataFrame({"dt": dt, "src": first, "dst": second, "a": v}))
                continue
            for rows, cols, v in ((li, ri, value), (ri, li, value.T)):
                v = v.copy()
                v[names[rows][:, None] == names[cols][None, :]] = -np.inf
                k = min(keep, len(cols))
                # names are sorted, so a stable sort breaks ties by name
                order = np.argsort(-v, axis=1, kind="stable")[:, :k]
                best = np.take_along_axis(v, order, axis=1)
                use = np.isfinite(best)
                out.append(
                    pd.DataFrame(
                        {
                            "dt": dt,
                            "src": np.repeat(names[rows], k)[use.ravel()],
                            "dst": names[cols][order.ravel()][use.ravel()],
                            "a": best.ravel()[use.ravel()],
                        }
                    )
                )
                if same_block:
                    break
        out = [o for o in out if len(o)]
        return pd.concat(out, ignore_index=True) if out else nothing

    return run


def _blocks(panel: DataFrame, params: GraphParams, n_assets: int) -> DataFrame:
    """Send each row to the date chunks and block pairs that need it.

    A chunk needs the window - 1 rows before it; a block meets every block.
    Group size is bounded by 2 * asset_block * (date_chunk + window) rows.
    """
    n_blocks = max(1, -(-n_assets // params.asset_block))
    chunk = F.floor(F.col("t") / params.date_chunk).cast("int")
    reach = F.floor((F.col("t") + params.window - 1) / params.date_chunk).cast("int")
    block = F.pmod(F.xxhash64("asset"), F.lit(n_blocks)).cast("int")
    spread = (
        panel.select("asset", "sector", "dt", "t", F.col("return").alias("r"))
        .withColumn("block", block)
        .withColumn("chunk", F.explode(F.sequence(chunk, reach)))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    )
    return spread.withColumn("lb", F.least("block", "other")).withColumn(
        "rb", F.greatest("block", "other")
    ).drop("other")


def _run_blocks(
    panel: DataFrame, params: GraphParams, n_assets: int, keep: int | None, mode: str
) -> DataFrame:
    params.check()
    return (
        _blocks(panel, params, n_assets)
        .groupBy("chunk", "lb", "rb")
        .applyInPandas(_block_kernel(params, keep, mode), "dt date, src string, dst string, a double")
    )


def count_assets(panel: DataFrame) -> int:
    """One number to size the blocks; call on a stored panel."""
    return panel.select(F.count_distinct("asset")).first()[0]


def rolling_corr(panel: DataFrame, params: GraphParams, n_assets: int) -> DataFrame:
    """Clipped correlation of every unordered pair: the matrix is the result."""
    return _run_blocks(panel, params, n_assets, None, "corr").withColumnRenamed("a", "corr")


def affinity(panel: DataFrame, params: GraphParams, n_assets: int) -> DataFrame:
    """alpha * correlation + beta * same sector, every unordered pair."""
    return _run_blocks(panel, params, n_assets, None, "affinity")


def sector_pairs(sectors: DataFrame) -> DataFrame:
    """(src, dst, s): the pairs of one sector, s = 1; the affinity of all other pairs is 0."""
    left = sectors.select(F.col("asset").alias("src"), "sector")
    right = sectors.select(F.col("asset").alias("dst"), "sector")
    return left.join(right, "sector").where("src < dst").select("src", "dst", F.lit(1.0).alias("s"))


def sector_affinity(pairs: DataFrame, sectors: DataFrame) -> DataFrame:
    """1 where both ends have the same sector, else 0."""
    left = sectors.select(F.col("asset").alias("src"), F.col("sector").alias("_s1"))
    right = sectors.select(F.col("asset").alias("dst"), F.col("sector").alias("_s2"))
    return (
        pairs.join(left, "src")
        .join(right, "dst")
        .select("src", "dst", (F.col("_s1") == F.col("_s2")).cast("double").alias("s"))
    )


def diagonal(panel: DataFrame, params: GraphParams) -> DataFrame:
    """(dt, top): the largest diagonal affinity, 1 unless every series is constant.

    The diagonal belongs to the matrix whose maximum scales the weights.
    """
    last = Window.partitionBy("asset").orderBy("t").rowsBetween(-(params.window - 1), 0)
    own = (F.max("return").over(last) > F.min("return").over(last)).cast("double")
    return (
        panel.withColumn("_n", F.count("return").over(last))
        .withColumn("_d", params.alpha * own + params.beta)
        .where(F.col("_n") >= params.min_rows)
        .groupBy("dt")
        .agg(F.max("_d").alias("top"))
    )


def normalize_affinity(pairs: DataFrame, top: DataFrame, eps: float = 1e-8) -> DataFrame:
    """(a + eps) / max per date, diagonal included; an all-zero date gives eps."""
    best = (
        pairs.groupBy("dt").agg(F.max("a").alias("_a")).join(top, "dt", "left")
        .select("dt", F.greatest("_a", "top").alias("_max"))
    )
    scaled = F.when(F.col("_max") <= 0, F.lit(eps)).otherwise((F.col("a") + eps) / F.col("_max"))
    return pairs.join(best, "dt").withColumn("a", F.round(scaled, DIGITS)).drop("_max")


def knn_edges(
    panel: DataFrame, params: GraphParams, n_assets: int, candidates: DataFrame | None = None
) -> DataFrame:
    """(dt, src, dst, a): the k strongest neighbours per node, ties by name."""
    if params.k >= n_assets:
        raise ValueError(f"k={params.k} must be below the number of assets {n_assets}")
    pruned = (
        _run_blocks(panel, params, n_assets, params.k, "affinity")
        if candidates is None
        else candidates
    )
    scaled = normalize_affinity(pruned, diagonal(panel, params), params.eps)
    best = Window.partitionBy("dt", "src").orderBy(F.desc("a"), "dst")
    return (
        scaled.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= params.k)
        .select("dt", "src", "dst", "a", "rank")
    )


def symmetrize(directed: DataFrame, mode: str = "avg") -> DataFrame:
    """Undirected edges in both directions.

    ``mutual`` needs both directions; ``avg`` and ``max`` need one. The two
    weights of a pair are equal, so avg and max agree on symmetric input.
    """
    if mode not in ("avg", "mutual", "max"):
        raise ValueError(f"unknown sym_mode {mode!r}")
    weight = F.max("a") if mode == "max" else F.avg("a")
    pair = (
        directed.groupBy("dt", F.least("src", "dst").alias("_u"), F.greatest("src", "dst").alias("_v"))
        .agg(weight.alias("w"), F.count("*").alias("_n"))
    )
    if mode == "mutual":
        pair = pair.where(F.col("_n") == 2)
    ends = F.explode(
        F.array(
            F.struct(F.col("_u").alias("src"), F.col("_v").alias("dst")),
            F.struct(F.col("_v").alias("src"), F.col("_u").alias("dst")),
        )
    )
    return pair.select("dt", ends.alias("_e"), F.round("w", DIGITS).alias("w")).select(
        "dt", "_e.src", "_e.dst", "w"
    )


def build_graph(panel: DataFrame, params: GraphParams, n_assets: int) -> DataFrame:
    """edges(dt, src, dst, w), both directions, for every date at once."""
    return symmetrize(knn_edges(panel, params, n_assets), params.sym_mode)


def degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dt", "src").agg(
        F.sum("w").alias("degree"), F.count("*").alias("n_neighbours")
    )


def degree_stats(edges: DataFrame) -> DataFrame:
    """Unweighted degree over all (date, node): mean, median, p95, max, mean daily max."""
    deg = edges.groupBy("dt", "src").agg(F.count("*").alias("d"))
    # integer degrees: count per value first, so percentiles see few rows
    hist = deg.groupBy("d").agg(F.count("*").alias("n"))
    daily = deg.groupBy("dt").agg(F.max("d").alias("top"))
    return hist.agg(
        (F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("mean"),
        F.percentile("d", 0.5, F.col("n")).alias("median"),
        F.percentile("d", 0.95, F.col("n")).alias("p95"),
        F.max("d").alias("max"),
    ).withColumn("mean_daily_max", daily.agg(F.avg("top")).scalar())


def clustering(edges: DataFrame) -> DataFrame:
    """Weighted triangles through a node over d(d-1); 0 unless d > 1.

    Every triangle is found once, from its member of least degree: edges are
    oriented towards the larger (degree, name), so a hub starts no wedges and
    the number of wedges stays near the number of edges.
    """
    deg = degree(edges)
    rank = deg.select("dt", F.col("src").alias("_n"), F.struct("n_neighbours", "src").alias("_o"))
    oriented = (
        edges.join(rank.select("dt", F.col("_n").alias("src"), F.col("_o").alias("_os")), ["dt", "src"])
        .join(rank.select("dt", F.col("_n").alias("dst"), F.col("_o").alias("_od")), ["dt", "dst"])
        .where(F.col("_os") < F.col("_od"))
        .select("dt", "src", "dst", "w", "_od")
    )
    a = oriented.select("dt", F.col("src").alias("x"), F.col("dst").alias("y"), F.col("w").alias("wxy"), F.col("_od").alias("oy"))
    b = oriented.select("dt", F.col("src").alias("x"), F.col("dst").alias("z"), F.col("w").alias("wxz"), F.col("_od").alias("oz"))
    c = oriented.select("dt", F.col("src").alias("y"), F.col("dst").alias("z"), F.col("w").alias("wyz"))
    tri = (
        a.join(b, ["dt", "x"]).where(F.col("oy") < F.col("oz")).join(c, ["dt", "y", "z"])
        .withColumn("p", 2.0 * F.col("wxy") * F.col("wxz") * F.col("wyz"))
    )
    per_node = (
        tri.select("dt", F.explode(F.array("x", "y", "z")).alias("src"), "p")
        .groupBy("dt", "src")
        .agg(F.sum("p").alias("tri"))
    )
    d = F.col("degree")
    value = F.when(d > 1.0, F.coalesce("tri", F.lit(0.0)) / (d * (d - 1.0))).otherwise(F.lit(0.0))
    return deg.join(per_node, ["dt", "src"], "left").select("dt", "src", value.alias("clustering"))


def _products(names: list[tuple[Column, Column]]) -> Column:
    return F.array(*[F.sum(a * b) for a, b in names])


def _ritz(width: int, block: int, wanted: int, tolerance: float):
    """Small problems, one per date: best combinations of the columns [u | X R P] for the least eigenvalues.

    From the columns' products, and their products with the operator's images (u has none),
    come for each date the combinations for the next X and its step P (both orthonormal), the values,
    and the norms of R. A date whose first ``wanted`` residuals are below ``tolerance`` keeps its X.
    """
    m = 1 + width
    upper, inner = np.triu_indices(m), np.triu_indices(width)

    @F.pandas_udf("c array<double>, p array<double>, lam array<double>, left array<double>")
    def solve(gram: pd.Series, image: pd.Series) -> pd.DataFrame:
        rows = []
        for g_, h_ in zip(gram, image):
            full, h = np.zeros((m, m)), np.zeros((width, width))
            full[upper], h[inner] = g_, h_
            full, h = full + np.triu(full, 1).T, h + np.triu(h, 1).T
            along = full[0, 1:]
            g = full[1:, 1:] - np.outer(along, along)  # without the known vector
            size = np.sqrt(np.maximum(np.diag(g), 0.0))
            used, left = np.flatnonzero(size > 1e-15), size[block : 2 * block]
            c, p, lam = np.zeros((width, block)), np.zeros((width, block)), np.zeros(block)
            if (left[:wanted] <= tolerance).all():
                c[:block], lam, along = np.eye(block), np.diag(h)[:block], np.zeros(width)
            elif len(used):
                inside = g[np.ix_(used, used)]
                e, q = np.linalg.eigh(inside / np.outer(size[used], size[used]))
                basis = (q[:, e > 1e-12] / np.sqrt(e[e > 1e-12])) / size[used][:, None]
                values, turn = np.linalg.eigh(basis.T @ h[np.ix_(used, used)] @ basis)
                some = min(block, len(values))
                first = turn[:, :some]
                c[used, :some], lam[:some] = basis @ first, values[:some]
                step = np.where(used[:, None] < block, 0.0, c[used])
                y = basis.T @ inside @ step
                for _ in range(2):
                    y = y - first @ (first.T @ y)
                out, length, _ = np.linalg.svd(y, full_matrices=False)
                rank = int((length > 1e-8 * max(length.max(initial=0.0), 1e-300)).sum())
                p[np.ix_(used, range(rank))] = basis @ out[:, :rank]
            rows.append((*[np.vstack([-(along @ x), x]).ravel() for x in (c, p)], lam, left))
        return pd.DataFrame(rows, columns=["c", "p", "lam", "left"])

    return solve


def spectral_embedding(edges: DataFrame, k: int = 2, tolerance: float = 1e-11, rounds: int = 300, guard: int = 2) -> DataFrame:
    """k smallest eigenvectors of the normalised Laplacian per date.

    The first vector is the one that is known, sqrt(degree); the others are orthogonal to
    it, also when the graph has several parts. They are found for all dates at once by a block
    of vectors that is improved by its residuals and last steps (locally optimal conjugate
    gradients): products with the graph are joins on (dt, node), a date's columns meet only in sums of
    their products, and the small problem of a date has one row. It is an error if ``rounds`` do not bring
    the residuals below ``tolerance``. Of each vector the largest entry is positive.
    Where eigenvalues coincide, the vectors are any of their space.
    """
    deg = edges.groupBy("dt", "src").agg(F.sum("w").alias("d"))
    total = deg.groupBy("dt").agg(F.sum("d").alias("total"))
    nodes = deg.join(total, "dt").select("dt", "src", "d", F.when(F.col("total") > 0, F.sqrt(F.col("d") / F.col("total"))).otherwise(0.0).alias("u"))
    if k == 1:
        return nodes.select("dt", "src", F.col("u").alias("spectral_1"))
    nodes = cut(nodes)
    side = nodes.select("dt", "src", F.when(F.col("d") > 0, 1.0 / F.sqrt("d")).otherwise(1.0).alias("scale"))
    matrix = edges.join(side, ["dt", "src"]).withColumnRenamed("scale", "_s").join(
        side.select("dt", F.col("src").alias("dst"), "scale"), ["dt", "dst"]
    )
    matrix = cut(matrix.select("dt", "src", "dst", (F.col("w") * F.col("_s") * F.col("scale")).alias("v")))
    b = k - 1 + guard
    width = 3 * b
    begin, solve = _ritz(width, b, k - 1, -1.0), _ritz(width, b, k - 1, tolerance)  # at first there are no residuals

    def with_image(state: DataFrame, column: str) -> DataFrame:
        """``state`` with the images of the block ``column`` under the Laplacian, as ``y``."""
        other = state.select("dt", F.col("src").alias("dst"), F.col(column).alias("_z"))
        sums = matrix.join(other, ["dt", "dst"]).groupBy("dt", "src").agg(
            F.array(*[F.sum(F.col("v") * F.col("_z")[i]) for i in range(b)]).alias("_z")
        )
        return state.join(sums, ["dt", "src"]).withColumn("y", F.array(*[F.col(column)[i] - F.col("_z")[i] for i in range(b)])).drop("_z")

    zeros = F.array(*[F.lit(0.0)] * b)
    start = nodes.select("dt", "src", "u", F.array(*[draw("spectral", i, F.col("src")) - 0.5 for i in range(b)]).alias("x"))
    state = with_image(start, "x").select("dt", "src", "u", F.concat("x", zeros, zeros).alias("s"), F.concat("y", zeros, zeros).alias("a"))
    s, a = F.col("s"), F.col("a")
    columns = [F.col("u"), *[s[i] for i in range(width)]]
    gram = _products([(columns[i], columns[j]) for i in range(width + 1) for j in range(i, width + 1)])
    image = _products([(s[i], a[j]) for i in range(width) for j in range(i, width)])
    for at in range(rounds + 1):
        state = cut(state)
        solved = state.groupBy("dt").agg(gram.alias("gram"), image.alias("image")).select("dt", (solve if at else begin)("gram", "image").alias("z"))
        solved = cut(solved.select("dt", "z.*"))
        worst = solved.agg(F.max(F.array_max(F.slice("left", 1, k - 1)))).first()[0] if at else None
        if at and (worst is None or worst <= tolerance):
            break
        if at == rounds:
            raise ArithmeticError(f"eigenvectors left a residual of {worst} after {rounds} rounds")
        mixed = state.join(solved, "dt")

        def mix(coefficients: str, first: Column | None, rest: Column) -> Column:
            """Combinations of the columns, row by row; ``first`` stands for the known vector."""
            terms = lambda i: [F.col(coefficients)[(1 + j) * b + i] * rest[j] for j in range(width)]
            known = lambda i: [] if first is None else [F.col(coefficients)[i] * first]
            return F.array(*[reduce(lambda x, y: x + y, [*known(i), *terms(i)]) for i in range(b)])

        new = mixed.select(
            "dt", "src", "u", "lam",
            mix("c", F.col("u"), s).alias("x"), mix("p", F.col("u"), s).alias("p"),
            mix("c", None, a).alias("ax"), mix("p", None, a).alias("ap"),
        )
        new = new.withColumn("r", F.array(*[F.col("ax")[i] - F.col("lam")[i] * F.col("x")[i] for i in range(b)]))
        state = with_image(new, "r").select("dt", "src", "u", F.concat("x", "r", "p").alias("s"), F.concat("ax", "y", "ap").alias("a"))
    out = state.select("dt", "src", F.col("u").alias("spectral_1"), *[s[i].alias(f"spectral_{i + 2}") for i in range(k - 1)])
    for i in range(k - 1):
        name = f"spectral_{i + 2}"
        largest = Window.partitionBy("dt").orderBy(F.desc(F.abs(F.round(name, 9))), "src")
        sign = F.when(F.first(name).over(largest) < 0, -1.0).otherwise(1.0)
        out = out.withColumn(name, F.col(name) * sign)
    return out


def spectral_residual(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(dt, size, residual): the lengths of x and of Lx - (x.Lx / x.x) x, for vectors (dt, src, x)."""
    deg = edges.groupBy("dt", "src").agg(F.sum("w").alias("d"))
    known = vectors.join(deg, ["dt", "src"]).withColumn("z", F.when(F.col("d") > 0, F.col("x") / F.sqrt("d")).otherwise(F.col("x")))
    sums = edges.join(known.select("dt", F.col("src").alias("dst"), "z"), ["dt", "dst"]).groupBy("dt", "src").agg(F.sum(F.col("w") * F.col("z")).alias("wz"))
    image = known.join(sums, ["dt", "src"]).withColumn("y", F.col("x") - F.when(F.col("d") > 0, F.col("wz") / F.sqrt("d")).otherwise(F.col("wz")))
    value = F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))
    rows = image.join(image.groupBy("dt").agg(value.alias("lam")), "dt")
    off = F.col("y") - F.col("lam") * F.col("x")
    return rows.groupBy("dt").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"), F.sqrt(F.sum(off * off)).alias("residual"))


def relational_features(edges: DataFrame, k: int = 2) -> DataFrame:
    """degree, clustering and the spectral coordinates per (dt, asset)."""
    return (
        degree(edges).drop("n_neighbours")
        .join(clustering(edges), ["dt", "src"])
        .join(spectral_embedding(edges, k), ["dt", "src"])
        .withColumnRenamed("src", "asset")
    )


def seed_score(panel: DataFrame, window: int = 20, eps: float = 1e-8) -> DataFrame:
    """(dt, t, asset, score): mean over deviation of the last returns."""
    last = Window.partitionBy("asset").orderBy("t").rowsBetween(-(window - 1), 0)
    ratio = F.avg("return").over(last) / (F.stddev_samp("return").over(last) + eps)
    return panel.select(
        "dt", "t", "asset", F.round(ratio, DIGITS).alias("score"), F.count("return").over(last).alias("_n")
    ).where(F.col("_n") >= 2).drop("_n")


def eligible_filter(scores: DataFrame, eligible: Column) -> DataFrame:
    """Keep eligible rows; dates without any keep one row with a NULL asset."""
    return (
        scores.groupBy("dt", F.when(eligible, F.col("asset")).alias("asset"))
        .agg(F.max(F.when(eligible, F.col("score"))).alias("score"))
        .withColumn("_any", F.max(F.col("asset").isNotNull()).over(Window.partitionBy("dt")))
        .where(F.col("asset").isNotNull() | ~F.col("_any"))
        .withColumn("has_eligible", F.col("_any"))
        .drop("_any")
    )


def seed_pick(scores: DataFrame) -> DataFrame:
    """The best asset per date; ties go to the first name."""
    return scores.groupBy("dt").agg(
        F.min_by(F.struct("asset", "score"), F.struct((-F.col("score")).alias("s"), "asset")).alias("_b")
    ).select("dt", F.col("_b.asset").alias("seed"), F.col("_b.score").alias("score"))
