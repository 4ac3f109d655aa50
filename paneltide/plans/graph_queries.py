"""Queries on graphs, neighbourhoods, walks and selectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paneltide.functions.columns import tidy
from paneltide.functions.draws import draw_sql
from paneltide.operators import features as FE
from paneltide.operators import graph as G
from paneltide.operators import neighbourhood as N
from paneltide.operators import scores as SC
from paneltide.operators import selectors as S
from paneltide.operators import splits as SP
from paneltide.operators import walks as W
from paneltide.plans import stages as st
from paneltide.plans.panel_queries import state_summary
from paneltide.plans.registry import query
from paneltide.plans.sqltext import edge_walk_parts, node_scores, part
from paneltide.session import cut

P = st.WEEKLY.graph


def grid(name: str) -> Column:
    """Output of values that lie on a 12-digit grid: the shift avoids rounding ties."""
    return tidy(F.col(name) + 3e-13)


def _features_and_edges(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    f = st.feature_rows(spark, folder)
    return f, cut(st.edges(f))


def _features_and_hoods(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    f = st.feature_rows(spark, folder)
    return f, st.neighbourhoods(f)


@query("rolling_corr", "corr_pairs", "SELECT dt, src, dst, round(corr + 3e-13, 6) + 0.0 AS corr FROM corr_pairs")
def rolling_corr(spark: SparkSession, folder: str) -> DataFrame:
    f = st.feature_rows(spark, folder)
    return G.rolling_corr(f, P, G.count_assets(f)).select("dt", "src", "dst", grid("corr").alias("corr"))


@query("sector_affinity", "feat", """
SELECT DISTINCT x.asset AS src, y.asset AS dst, CAST(1 AS DOUBLE) AS s
FROM feat x JOIN feat y ON x.sector = y.sector AND x.asset < y.asset""")
def sector_affinity(spark: SparkSession, folder: str) -> DataFrame:
    f = st.feature_rows(spark, folder)
    return G.sector_pairs(f.select("asset", "sector").distinct())


@query("affinity", "corr_pairs", "SELECT dt, src, dst, round(a + 3e-13, 6) + 0.0 AS a FROM corr_pairs")
def affinity(spark: SparkSession, folder: str) -> DataFrame:
    f = st.feature_rows(spark, folder)
    return G.affinity(f, P, G.count_assets(f)).select("dt", "src", "dst", grid("a").alias("a"))


@query("normalize_affinity", "aff", "SELECT dt, src, dst, round(a + 3e-13, 6) + 0.0 AS a FROM aff WHERE src < dst")
def normalize_affinity(spark: SparkSession, folder: str) -> DataFrame:
    f = st.feature_rows(spark, folder)
    pairs = cut(G.affinity(f, P, G.count_assets(f)))
    scaled = G.normalize_affinity(pairs, G.diagonal(f, P), P.eps)
    return scaled.select("dt", "src", "dst", grid("a").alias("a"))


@query("knn_edges", "knn", "SELECT dt, src, dst, round(a + 3e-13, 6) + 0.0 AS a, rank FROM knn")
def knn_edges(spark: SparkSession, folder: str) -> DataFrame:
    f = st.feature_rows(spark, folder)
    return G.knn_edges(f, P, G.count_assets(f)).select("dt", "src", "dst", grid("a").alias("a"), "rank")


part("edges_mutual", "knn", """
SELECT x.dt, x.src, x.dst, x.a AS w FROM knn x JOIN knn y ON y.dt = x.dt AND y.src = x.dst AND y.dst = x.src""")


@query("symmetrize", "edges edges_mutual", """
SELECT 'avg' AS mode, dt, count(*) AS n, round(sum(w), 6) + 0.0 AS total FROM edges GROUP BY dt
UNION ALL SELECT 'max', dt, count(*), round(sum(w), 6) + 0.0 FROM edges GROUP BY dt
UNION ALL SELECT 'mutual', dt, count(*), round(sum(w), 6) + 0.0 FROM edges_mutual GROUP BY dt""")
def symmetrize(spark: SparkSession, folder: str) -> DataFrame:
    f = st.feature_rows(spark, folder)
    near = cut(G.knn_edges(f, P, G.count_assets(f)))
    out = None
    for mode in ("avg", "max", "mutual"):
        rows = G.symmetrize(near, mode).groupBy("dt").agg(F.count("*").alias("n"), tidy(F.sum("w")).alias("total"))
        rows = rows.withColumn("mode", F.lit(mode))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("build_graph", "edges", "SELECT dt, src, dst, round(CAST(w AS DOUBLE) + 3e-13, 6) + 0.0 AS w FROM edges")
def build_graph(spark: SparkSession, folder: str) -> DataFrame:
    return st.edges(st.feature_rows(spark, folder)).select("dt", "src", "dst", grid("w").alias("w"))


part("deg", "edges", "SELECT dt, src, sum(w) AS degree, count(*) AS n_neighbours FROM edges GROUP BY dt, src")


@query("degree", "deg", "SELECT dt, src, round(degree, 6) + 0.0 AS degree, n_neighbours FROM deg")
def degree(spark: SparkSession, folder: str) -> DataFrame:
    d = G.degree(st.edges(st.feature_rows(spark, folder)))
    return d.select("dt", "src", tidy("degree").alias("degree"), "n_neighbours")


@query("degree_stats", "deg", """
SELECT round(avg(n_neighbours), 6) AS mean, quantile_cont(n_neighbours, 0.5) AS median, quantile_cont(n_neighbours, 0.95) AS p95,
       max(n_neighbours) AS max, round((SELECT avg(m) FROM (SELECT max(n_neighbours) AS m FROM deg GROUP BY dt)), 6) AS mean_daily_max FROM deg""")
def degree_stats(spark: SparkSession, folder: str) -> DataFrame:
    _, e = _features_and_edges(spark, folder)
    s = G.degree_stats(e)
    return s.select(tidy("mean").alias("mean"), "median", "p95", "max", tidy("mean_daily_max").alias("mean_daily_max"))


part("clust", "edges deg", """
SELECT d.dt, d.src, CASE WHEN d.degree > 1 THEN coalesce(t.tri, 0) / (d.degree * (d.degree - 1)) ELSE 0.0 END AS clustering
FROM deg d LEFT JOIN (
  SELECT a.dt, a.src, sum(a.w * b.w * c.w) AS tri FROM edges a
  JOIN edges b ON b.dt = a.dt AND b.src = a.dst JOIN edges c ON c.dt = a.dt AND c.src = b.dst AND c.dst = a.src
  GROUP BY a.dt, a.src) t ON t.dt = d.dt AND t.src = d.src""")


@query("clustering", "clust", "SELECT dt, src, round(clustering, 6) + 0.0 AS clustering FROM clust")
def clustering(spark: SparkSession, folder: str) -> DataFrame:
    _, e = _features_and_edges(spark, folder)
    return G.clustering(e).select("dt", "src", tidy("clustering").alias("clustering"))


# second vector: the matrix (I + D^-1/2 W D^-1/2) / 2 without sqrt(degree), squared again and again
SQUARINGS = 22
part("spec_u", "deg", "SELECT dt, src, degree AS d, sqrt(degree / sum(degree) OVER (PARTITION BY dt)) AS u FROM deg")
part("spec_0", "spec_u edges", """
SELECT a.dt, a.src, b.src AS dst, ((CASE WHEN a.src = b.src THEN 1.0 ELSE 0.0 END) + coalesce(e.w, 0) / sqrt(a.d * b.d)) / 2 - a.u * b.u AS v
FROM spec_u a JOIN spec_u b ON a.dt = b.dt LEFT JOIN edges e ON e.dt = a.dt AND e.src = a.src AND e.dst = b.src""")
for _k in range(SQUARINGS):
    part(f"spec_{_k + 1}", f"spec_{_k}", f"""
SELECT dt, src, dst, v / max(abs(v)) OVER (PARTITION BY dt) AS v FROM (
  SELECT a.dt, a.src, b.dst, sum(a.v * b.v) AS v FROM spec_{_k} a JOIN spec_{_k} b ON a.dt = b.dt AND a.dst = b.src GROUP BY 1, 2, 3)""")
part("spec_col", f"spec_{SQUARINGS}", f"""
SELECT dt, src, v / sqrt(sum(v * v) OVER (PARTITION BY dt)) AS x FROM spec_{SQUARINGS}
WHERE (dt, dst) IN (SELECT (dt, dst) FROM (SELECT dt, dst, row_number() OVER (PARTITION BY dt ORDER BY sum(v * v) DESC) AS k FROM spec_{SQUARINGS} GROUP BY dt, dst) WHERE k = 1)""")
part("spectral", "spec_col spec_u", """
SELECT x.dt, x.src, u AS spectral_1, x * sign(first_value(x) OVER (PARTITION BY x.dt ORDER BY abs(round(x, 9)) DESC, x.src)) AS spectral_2
FROM spec_col x JOIN spec_u u ON u.dt = x.dt AND u.src = x.src""")
SPECTRAL = "round(spectral_1, 6) + 0.0 AS spectral_1, round(spectral_2, 6) + 0.0 AS spectral_2"


@query("spectral_embedding", "spectral", f"SELECT dt, src, {SPECTRAL} FROM spectral")
def spectral_embedding(spark: SparkSession, folder: str) -> DataFrame:
    e = cut(st.edges(st.feature_rows(spark, folder)))
    found = G.spectral_embedding(e, 2)
    return found.select("dt", "src", tidy("spectral_1").alias("spectral_1"), tidy("spectral_2").alias("spectral_2"))


@query("spectral_first", "edges", """
SELECT dt, src, round(sqrt(sum(w)) / sqrt(sum(sum(w)) OVER (PARTITION BY dt)), 6) + 0.0 AS spectral_1
FROM edges GROUP BY dt, src""")
def spectral_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first coordinate is known in closed form on a connected graph."""
    e = st.edges(st.feature_rows(spark, folder))
    return G.spectral_embedding(e, 1).select("dt", "src", tidy("spectral_1").alias("spectral_1"))


@query("relational_features", "deg clust spectral", f"""
SELECT dt, src AS asset, round(degree, 6) + 0.0 AS degree, round(clustering, 6) + 0.0 AS clustering, {SPECTRAL}
FROM deg JOIN clust USING (dt, src) JOIN spectral USING (dt, src)""")
def relational_features(spark: SparkSession, folder: str) -> DataFrame:
    _, e = _features_and_edges(spark, folder)
    rows = G.relational_features(cut(e))
    return rows.select("dt", "asset", *[tidy(c).alias(c) for c in ("degree", "clustering", "spectral_1", "spectral_2")])


part("dt_degree", "deg clust cal place", f"""
SELECT dt, count(*) AS extra, sum(x) AS total, sum(x * (i % 97 + 1)) AS weighted FROM (
  SELECT a.dt, p.n_assets * {3 * st.LOOKBACK} + p.k * 2 + j.j AS i,
         CASE WHEN a.t < {st.WEEKLY.graph.window - 1} THEN 0.0
              ELSE coalesce(CAST(CASE j.j WHEN 0 THEN d.degree ELSE c.clustering END AS FLOAT)::DOUBLE, 0.0) END AS x
  FROM cal a JOIN place p ON true JOIN (VALUES (0), (1)) j(j) ON true
  LEFT JOIN deg d ON d.dt = a.dt AND d.src = p.asset LEFT JOIN clust c ON c.dt = a.dt AND c.src = p.asset) GROUP BY dt""")


@query("relational_state", "in_window dt_degree", """
SELECT w.dt, CAST(w.width + r.extra AS INTEGER) AS width, round(w.total + r.total, 3) + 0.0 AS total, round(w.weighted + r.weighted, 2) + 0.0 AS weighted
FROM in_window w JOIN dt_degree r ON r.dt = w.dt""")
def relational_state(spark: SparkSession, folder: str) -> DataFrame:
    f, e = _features_and_edges(spark, folder)
    states = FE.state_windows(f, ["return", "volatility", "volume_rel"], st.LOOKBACK)
    rel = G.degree(e).join(G.clustering(e), ["dt", "src"]).withColumnRenamed("src", "asset")
    # graph features count from the first date with a whole correlation window
    known = rel.join(SP.calendar(f).where(F.col("t") >= st.WEEKLY.graph.window - 1), "dt")
    return state_summary(FE.relational_state(states, known, ["degree", "clustering"], f))


@query("seed_score", "scores", "SELECT dt, t, asset, round(score, 6) + 0.0 AS score FROM scores")
def seed_score(spark: SparkSession, folder: str) -> DataFrame:
    s = G.seed_score(st.feature_rows(spark, folder))
    return s.select("dt", "t", "asset", tidy("score").alias("score"))


@query("seed_pick", "picked", "SELECT dt, seed, round(score, 6) + 0.0 AS score FROM picked")
def seed_pick(spark: SparkSession, folder: str) -> DataFrame:
    return st.seeds(st.feature_rows(spark, folder)).select("dt", "seed", tidy("score").alias("score"))


# an asset is eligible while it trades above its usual volume
@query("eligible_filter", "scores feat", """
SELECT dt, asset, round(score, 6) + 0.0 AS score, true AS has_eligible FROM (
  SELECT s.dt, s.asset, s.score FROM scores s JOIN feat f ON f.dt = s.dt AND f.asset = s.asset WHERE f.volume_rel > 1.5)
UNION ALL
SELECT DISTINCT dt, CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), false FROM scores WHERE dt NOT IN (
  SELECT s.dt FROM scores s JOIN feat f ON f.dt = s.dt AND f.asset = s.asset WHERE f.volume_rel > 1.5)""")
def eligible_filter(spark: SparkSession, folder: str) -> DataFrame:
    f = st.feature_rows(spark, folder)
    s = G.seed_score(f).join(f.select("dt", "asset", "volume_rel"), ["dt", "asset"])
    out = G.eligible_filter(s, F.col("volume_rel") > 1.5)
    return out.select("dt", "asset", tidy("score").alias("score"), "has_eligible")


@query("best_first_neighbourhood", "nodes", "SELECT dt, node, CAST(rank AS INTEGER) AS rank FROM nodes")
def best_first_neighbourhood(spark: SparkSession, folder: str) -> DataFrame:
    f, e = _features_and_edges(spark, folder)
    return N.node_rows(N.best_first_neighbourhood(e, st.seeds(f), st.SIZE))


@query("induced_edges", "inner_edges", "SELECT dt, src, dst, round(CAST(w AS DOUBLE) + 3e-13, 6) + 0.0 AS w FROM inner_edges")
def induced_edges(spark: SparkSession, folder: str) -> DataFrame:
    f, e = _features_and_edges(spark, folder)
    inner = N.induced_edges(e, N.node_rows(N.best_first_neighbourhood(e, st.seeds(f), st.SIZE)))
    return inner.select("dt", "src", "dst", grid("w").alias("w"))


# rewirings ------------------------------------------------------------------

part("pair_w", "nodes inner_edges", """
SELECT a.dt, a.rank AS i, b.rank AS j, a.node AS src, b.node AS dst, coalesce(e.w, 0) AS w
FROM nodes a JOIN nodes b ON b.dt = a.dt AND b.rank <> a.rank
LEFT JOIN inner_edges e ON e.dt = a.dt AND e.src = a.node AND e.dst = b.node""")
part("tour0", "nodes", "SELECT dt, 0 AS node, 0 AS pos FROM nodes WHERE rank = 0")
for _i in range(1, st.SIZE):
    part(f"tour{_i}", f"tour{_i - 1} pair_w", f"""
SELECT * FROM tour{_i - 1} UNION ALL
SELECT dt, j, {_i} FROM (
  SELECT p.dt, p.j, row_number() OVER (PARTITION BY p.dt ORDER BY p.w DESC, p.j) AS k
  FROM pair_w p JOIN tour{_i - 1} h ON h.dt = p.dt AND h.node = p.i AND h.pos = {_i - 1}
  LEFT JOIN tour{_i - 1} v ON v.dt = p.dt AND v.node = p.j WHERE v.node IS NULL) WHERE k = 1""")
_tour = f"tour{st.SIZE - 1}"
part("ring", f"{_tour} nodes", f"""
SELECT a.dt, x.node AS src, y.node AS dst, 1.0 AS w
FROM (SELECT *, count(*) OVER (PARTITION BY dt) AS n FROM {_tour}) a JOIN {_tour} b ON b.dt = a.dt AND b.node <> a.node
JOIN nodes x ON x.dt = a.dt AND x.rank = a.node JOIN nodes y ON y.dt = b.dt AND y.rank = b.node
WHERE a.n >= 3 AND (abs(a.pos - b.pos) = 1 OR abs(a.pos - b.pos) = a.n - 1)""")
part("cycle_edges", "ring inner_edges", """
SELECT * FROM ring UNION ALL SELECT dt, src, dst, w FROM inner_edges WHERE dt NOT IN (SELECT dt FROM ring)""")


@query("rewire_cycle", "cycle_edges", "SELECT dt, src, dst, round(CAST(w AS DOUBLE) + 3e-13, 6) + 0.0 AS w FROM cycle_edges")
def rewire_cycle(spark: SparkSession, folder: str) -> DataFrame:
    _, hoods = _features_and_hoods(spark, folder)
    e = N.matrix_edges(N.rewire_cycle(hoods).select("dt", "ids", "w"))
    return e.select("dt", "src", "dst", grid("w").alias("w"))


def _facts(f: DataFrame) -> DataFrame:
    return G.seed_score(f).join(f.select("dt", "asset", "sector"), ["dt", "asset"]).select("dt", "asset", "sector", "score")


part("sides", "nodes scores feat", """
SELECT dt, node, CASE WHEN s1 THEN by_sector WHEN s2 THEN by_score ELSE by_rank END AS side FROM (
  SELECT *, bool_or(by_sector) OVER (PARTITION BY dt) AND NOT bool_and(by_sector) OVER (PARTITION BY dt) AS s1,
         bool_or(by_score) OVER (PARTITION BY dt) AND NOT bool_and(by_score) OVER (PARTITION BY dt) AS s2 FROM (
    SELECT n.dt, n.node, f.sector = m.sector AS by_sector, s.score >= median(s.score) OVER (PARTITION BY n.dt) AS by_score,
           n.rank < floor(count(*) OVER (PARTITION BY n.dt) / 2) AS by_rank
    FROM nodes n JOIN feat f ON f.dt = n.dt AND f.asset = n.node JOIN scores s ON s.dt = n.dt AND s.asset = n.node
    JOIN (SELECT dt, sector FROM (SELECT n2.dt, f2.sector, row_number() OVER (PARTITION BY n2.dt ORDER BY count(*) DESC, f2.sector) AS k
          FROM nodes n2 JOIN feat f2 ON f2.dt = n2.dt AND f2.asset = n2.node GROUP BY n2.dt, f2.sector) WHERE k = 1) m ON m.dt = n.dt))""")
part("bip_edges", "sides", """
SELECT a.dt, a.node AS src, b.node AS dst, 1.0 AS w FROM sides a JOIN sides b ON b.dt = a.dt AND b.side <> a.side""")


@query("rewire_bipartite", "bip_edges", "SELECT dt, src, dst, CAST(w AS DOUBLE) AS w FROM bip_edges")
def rewire_bipartite(spark: SparkSession, folder: str) -> DataFrame:
    f, hoods = _features_and_hoods(spark, folder)
    e = N.matrix_edges(N.rewire_bipartite(hoods, _facts(f)).select("dt", "ids", "w"))
    return e.select("dt", "src", "dst", "w")


# greedy degree cap: recursion over the ordered pairs of a date, degrees in a list
part("cap_pairs", "pair_w", """
SELECT dt, i, j, src, dst, w, row_number() OVER (PARTITION BY dt ORDER BY w DESC, i, j) AS k FROM pair_w WHERE i < j""")
_bump = "list_transform(c.deg, lambda d, pos: d + CASE WHEN {free} AND (pos = p.i + 1 OR pos = p.j + 1) THEN 1 ELSE 0 END)"
_free = "(c.deg[p.i + 1] < 3 AND c.deg[p.j + 1] < 3)"
part("cap_state", "cap_pairs", f"""/*REC*/
SELECT dt, CAST(0 AS BIGINT) AS k, false AS taken, CAST([{', '.join(['0'] * st.SIZE)}] AS INTEGER[]) AS deg FROM cap_pairs WHERE k = 1
UNION ALL
SELECT c.dt, p.k, {_free}, CAST({_bump.format(free=_free)} AS INTEGER[])
FROM cap_state c JOIN cap_pairs p ON p.dt = c.dt AND p.k = c.k + 1""")
part("cap_edges", "cap_state cap_pairs", """
SELECT dt, src, dst, w / (max(w) OVER (PARTITION BY dt) + 1e-12) AS w FROM (
  SELECT p.dt, p.src, p.dst, greatest(p.w, 1e-6) AS w FROM cap_state c JOIN cap_pairs p ON p.dt = c.dt AND p.k = c.k WHERE c.taken
  UNION ALL
  SELECT p.dt, p.dst, p.src, greatest(p.w, 1e-6) FROM cap_state c JOIN cap_pairs p ON p.dt = c.dt AND p.k = c.k WHERE c.taken)""")


@query("rewire_degree_capped", "cap_edges", "SELECT dt, src, dst, round(CAST(w AS DOUBLE) + 3e-13, 6) + 0.0 AS w FROM cap_edges")
def rewire_degree_capped(spark: SparkSession, folder: str) -> DataFrame:
    _, hoods = _features_and_hoods(spark, folder)
    e = N.matrix_edges(N.rewire_degree_capped(hoods, 3).select("dt", "ids", "w"))
    return e.select("dt", "src", "dst", grid("w").alias("w"))


@query("rewire_degree_capped_uniform", "cap_edges", "SELECT dt, src, dst, CAST(1 AS DOUBLE) AS w FROM cap_edges")
def rewire_degree_capped_uniform(spark: SparkSession, folder: str) -> DataFrame:
    _, hoods = _features_and_hoods(spark, folder)
    e = N.matrix_edges(N.rewire_degree_capped(hoods, 3, uniform=True).select("dt", "ids", "w"))
    return e.select("dt", "src", "dst", "w")


def hop_parts(prefix: str, edges: str, grp: str) -> str:
    """Distances from the seed over edges(grp, src, dst) and nodes(grp, node, rank, n)."""
    part(f"{prefix}_paths", f"{edges}", f"""/*REC*/
SELECT DISTINCT {grp}, seed AS node, 0 AS d FROM {edges}
UNION
SELECT p.{grp}, e.dst, p.d + 1 FROM {prefix}_paths p JOIN {edges} e ON e.{grp} = p.{grp} AND e.src = p.node WHERE p.d < {st.SIZE - 1}""")
    part(f"{prefix}_dist", f"{prefix}_paths", f"SELECT {grp}, node, min(d) AS d FROM {prefix}_paths GROUP BY {grp}, node")
    return f"{prefix}_dist"


_hop = hop_parts("hop", "walk_edges", "grp")


@query("hop_distance", f"{_hop} nodes", f"""
SELECT n.dt, n.node, CAST(coalesce(h.d, count(*) OVER (PARTITION BY n.dt)) AS INTEGER) AS dist
FROM nodes n LEFT JOIN {_hop} h ON h.grp = n.dt AND h.node = n.node""")
def hop_distance(spark: SparkSession, folder: str) -> DataFrame:
    _, hoods = _features_and_hoods(spark, folder)
    d = N.hop_distance(hoods)
    return d.select("dt", F.explode(F.arrays_zip("ids", "dist")).alias("z")).select(
        "dt", F.col("z.ids").alias("node"), F.col("z.dist").alias("dist")
    )


# dispersion of the edge walk by topology -----------------------------------

KS = list(range(1, 7))
part("topo_edges", "walk_edges cycle_edges bip_edges cap_edges picked", """
SELECT 'grown|' || CAST(grp AS VARCHAR) AS grp, src, dst, w, seed FROM walk_edges
UNION ALL SELECT 'cycle|' || CAST(e.dt AS VARCHAR), src, dst, w, p.seed FROM cycle_edges e JOIN picked p ON p.dt = e.dt
UNION ALL SELECT 'bipartite|' || CAST(e.dt AS VARCHAR), src, dst, w, p.seed FROM bip_edges e JOIN picked p ON p.dt = e.dt
UNION ALL SELECT 'capped|' || CAST(e.dt AS VARCHAR), src, dst, w, p.seed FROM cap_edges e JOIN picked p ON p.dt = e.dt""")
edge_walk_parts("tw", "topo_edges", KS[-1], start="seed")
_topo_hop = hop_parts("thop", "topo_edges", "grp")
part("topo_spread", f"{' '.join(f'tw{k}' for k in KS)} {_topo_hop} hoods", "\nUNION ALL ".join(
    f"""SELECT {k} AS k, q.grp, sqrt(sum(q.q * d.d * d.d) / sum(q.q)) AS rms FROM (
  SELECT grp, src, sum(psi * psi) AS q FROM tw{k} GROUP BY grp, src) q
  JOIN thop_dist d ON d.grp = q.grp AND d.node = q.src GROUP BY q.grp""" for k in KS))
part("topo_k", "topo_spread", """
SELECT split_part(grp, '|', 1) AS topology, k, avg(rms) AS rms_mean, stddev_samp(rms) AS rms_sd, count(*) AS n FROM topo_spread GROUP BY 1, 2""")


@query("dispersion_exponent", "topo_k", """
SELECT topology, k, round(rms_mean, 6) + 0.0 AS rms_mean, round(rms_sd, 6) + 0.0 AS rms_sd, n,
       round(CASE WHEN count(CASE WHEN rms_mean > 1e-9 THEN 1 END) OVER w >= 3
         THEN regr_slope(CASE WHEN rms_mean > 1e-9 THEN ln(rms_mean) END, CASE WHEN rms_mean > 1e-9 THEN ln(k) END) OVER w END, 6) + 0.0 AS exponent
FROM topo_k WINDOW w AS (PARTITION BY topology)""")
def dispersion_exponent(spark: SparkSession, folder: str) -> DataFrame:
    f, hoods = _features_and_hoods(spark, folder)
    shapes = {
        "grown": hoods,
        "cycle": N.rewire_cycle(hoods),
        "bipartite": N.rewire_bipartite(hoods, _facts(f)),
        "capped": N.rewire_degree_capped(hoods, 3),
    }
    packed = None
    for name, df in shapes.items():
        one = df.select("dt", "ids", "w").withColumn("topology", F.lit(name))
        packed = one if packed is None else packed.unionByName(one)
    stored = cut(N.hop_distance(packed))
    walked = None
    for k in KS:
        one = W.edge_walk_k(stored, k, start="seed").select("topology", F.lit(k).alias("k"), "dt", "score", "dist")
        walked = one if walked is None else walked.unionByName(one)
    out = W.dispersion_exponent(walked)
    return out.select("topology", "k", tidy("rms_mean").alias("rms_mean"), tidy("rms_sd").alias("rms_sd"), "n", tidy("exponent").alias("exponent"))


# walks ----------------------------------------------------------------------


@query("transition_probs", "trans", "SELECT dt, src, dst, round(p, 6) + 0.0 AS p FROM trans")
def transition_probs(spark: SparkSession, folder: str) -> DataFrame:
    _, hoods = _features_and_hoods(spark, folder)
    return W.transition_probs(hoods).select("dt", "src", "dst", tidy("p").alias("p"))


@query("random_walk_k", "rw", "SELECT dt, node, CAST(rank AS INTEGER) AS rank, round(score, 6) + 0.0 AS score FROM rw")
def random_walk_k(spark: SparkSession, folder: str) -> DataFrame:
    _, hoods = _features_and_hoods(spark, folder)
    rows = W.score_rows(W.random_walk_k(hoods, st.STEPS))
    return rows.select("dt", "node", "rank", tidy("score").alias("score"))


def _edge_walk_query(name: str, mix: str, start: str, score_part: str):
    @query(name, score_part, f"SELECT dt, node, CAST(rank AS INTEGER) AS rank, round(score, 6) + 0.0 AS score FROM {score_part}")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        _, hoods = _features_and_hoods(spark, folder)
        rows = W.score_rows(W.edge_walk_k(hoods, st.STEPS, mix, start))
        return rows.select("dt", "node", "rank", tidy("score").alias("score"))


_edge_walk_query("edge_walk_k", "weighted", "uniform", "ewalk")
for _name, _mix, _start in (("edge_walk_seed", "weighted", "seed"), ("edge_walk_uniform_mix", "uniform", "uniform")):
    _l = edge_walk_parts(f"{_name}_p", "walk_edges", st.STEPS, _mix, _start)
    part(f"{_name}_scores", f"{_l} nodes", node_scores(_l))
    _edge_walk_query(_name, _mix, _start, f"{_name}_scores")


# selectors --------------------------------------------------------------------

MASK_SQL = "selector, seed, dt, asset, CAST(rank AS INTEGER) AS rank"


@query("top_m", "walk_masks", f"SELECT {MASK_SQL} FROM walk_masks")
def top_m(spark: SparkSession, folder: str) -> DataFrame:
    _, hoods = _features_and_hoods(spark, folder)
    return st.walk_masks(hoods)


@query("top_m_exclude", "rw nodes", f"""
SELECT 'random_walk' AS selector, 0 AS seed, dt, node AS asset, CAST(k AS INTEGER) AS rank FROM (
  SELECT dt, node, row_number() OVER (PARTITION BY dt ORDER BY round(score, 12) DESC, node) AS k FROM rw WHERE rank <> 0) WHERE k <= {st.TOP}""")
def top_m_exclude(spark: SparkSession, folder: str) -> DataFrame:
    """The seed itself may not be chosen."""
    _, hoods = _features_and_hoods(spark, folder)
    return S.top_m(W.random_walk_k(hoods, st.STEPS), st.TOP, "random_walk", [0], F.slice("ids", 1, 1))


@query("select_random", "rank_random", f"SELECT 'random' AS selector, seed, dt, asset, CAST(rank AS INTEGER) AS rank FROM rank_random WHERE rank <= {st.TOP}")
def select_random(spark: SparkSession, folder: str) -> DataFrame:
    _, hoods = _features_and_hoods(spark, folder)
    return S.select_random(hoods, st.TOP, st.SEEDS)


@query("select_sticky", "sticky_masks", f"SELECT {MASK_SQL} FROM sticky_masks")
def select_sticky(spark: SparkSession, folder: str) -> DataFrame:
    _, hoods = _features_and_hoods(spark, folder)
    return S.select_sticky(hoods, st.TOP, st.SEEDS, st.STICKY)


_soft = draw_sql("'softmax'", "seed", "dt", "node")


@query("select_softmax", "rw seed_list", f"""
SELECT 'softmax' AS selector, seed, dt, node AS asset, CAST(k AS INTEGER) AS rank FROM (
  SELECT seed, dt, node, row_number() OVER (PARTITION BY seed, dt ORDER BY round(score / 1.0 - ln(-ln(greatest({_soft}, 1e-12))), 12) DESC, node) AS k
  FROM rw CROSS JOIN seed_list) WHERE k <= {st.TOP}""")
def select_softmax(spark: SparkSession, folder: str) -> DataFrame:
    _, hoods = _features_and_hoods(spark, folder)
    return S.select_softmax(hoods, st.TOP, st.SEEDS, st.STEPS)


@query("select_momentum", "nodes mom", f"""
SELECT 'momentum' AS selector, 0 AS seed, dt, asset, CAST(k AS INTEGER) AS rank FROM (
  SELECT n.dt, m.asset, row_number() OVER (PARTITION BY n.dt ORDER BY m.momentum DESC, m.asset) AS k
  FROM nodes n JOIN mom m ON m.dt = n.dt AND m.asset = n.node) WHERE k <= {st.TOP}""")
def select_momentum(spark: SparkSession, folder: str) -> DataFrame:
    f, hoods = _features_and_hoods(spark, folder)
    return S.select_momentum(hoods, f, st.TOP)


part("posterior", "labels", f"""
SELECT dt, t, asset, coalesce(sum(CASE WHEN is_promising THEN 1 ELSE 0 END) OVER w, 0) + 1 AS a,
       coalesce(sum(CASE WHEN is_promising THEN 0 ELSE 1 END) OVER w, 0) + 1 AS b
FROM labels WINDOW w AS (PARTITION BY asset ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND {st.HORIZON} PRECEDING)""")


@query("thompson_posterior", "posterior", "SELECT dt, t, asset, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM posterior")
def thompson_posterior(spark: SparkSession, folder: str) -> DataFrame:
    return S.thompson_posterior(st.labels(st.feature_rows(spark, folder)), st.HORIZON)


part("gamma_in", "hoods posterior", f"""
SELECT s.seed, h.dt, p.asset, g.side, CASE WHEN g.side = 'a' THEN p.a ELSE p.b END - 1.0 / 3.0 AS d
FROM (SELECT dt, unnest(ids) AS asset FROM hoods) h JOIN posterior p ON p.dt = h.dt AND p.asset = h.asset
JOIN (SELECT unnest({st.SEEDS}) AS seed) s ON true JOIN (SELECT unnest(['a', 'b']) AS side) g ON true""")
_r, _t, _u = (draw_sql("'thompson'", "seed", "dt", "asset", "side", "i", f"'{x}'") for x in "rtu")
part("gamma_try", "gamma_in", f"""
SELECT *, pow(1 + z / sqrt(9 * d), 3) AS v FROM (
  SELECT *, sqrt(-2 * ln(1 - {_r})) * cos(2 * pi() * {_t}) AS z, 1 - {_u} AS u FROM (SELECT *, unnest(range(1, {S.ATTEMPTS + 1})) AS i FROM gamma_in))""")
part("gamma_got", "gamma_try", """
SELECT seed, dt, asset, side, arg_min(d * v, i) AS g FROM gamma_try WHERE v > 0 AND ln(u) < z * z / 2 + d - d * v + d * ln(greatest(v, 1e-300)) GROUP BY 1, 2, 3, 4""")
part("thompson_rows", "gamma_got", """
SELECT x.seed, x.dt, x.asset, round(x.g / (x.g + y.g), 12) AS theta FROM gamma_got x JOIN gamma_got y USING (seed, dt, asset) WHERE x.side = 'a' AND y.side = 'b'""")


@query("select_thompson", "thompson_rows", f"""
SELECT 'thompson' AS selector, seed, dt, asset, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY seed, dt ORDER BY theta DESC, asset) AS rank FROM thompson_rows) WHERE rank <= {st.TOP}""")
def select_thompson(spark: SparkSession, folder: str) -> DataFrame:
    f, hoods = _features_and_hoods(spark, folder)
    posterior = S.thompson_posterior(st.labels(f), st.HORIZON)
    return S.select_thompson(hoods, posterior, st.TOP, st.SEEDS)


part("own", "pair_w nodes", """
SELECT n.dt, n.rank AS i, n.node, CASE WHEN n.rank = 0 THEN (SELECT max(p.w) FROM pair_w p WHERE p.dt = n.dt AND p.i = 0)
  ELSE (SELECT p.w FROM pair_w p WHERE p.dt = n.dt AND p.i = 0 AND p.j = n.rank) END AS b,
  CASE WHEN n.rank = 0 THEN 0.0 ELSE (SELECT p.w FROM pair_w p WHERE p.dt = n.dt AND p.i = 0 AND p.j = n.rank) END AS direct FROM nodes n""")
part("triples", "own pair_w hoods", """
SELECT x.dt, x.i AS i, y.i AS j, z.i AS k, x.b + y.b + z.b AS lin, pxy.w + pxz.w + pyz.w AS inside, (1 << x.i) + (1 << y.i) + (1 << z.i) AS bits
FROM own x JOIN own y ON y.dt = x.dt AND y.i > x.i JOIN own z ON z.dt = x.dt AND z.i > y.i
JOIN pair_w pxy ON pxy.dt = x.dt AND pxy.i = x.i AND pxy.j = y.i JOIN pair_w pxz ON pxz.dt = x.dt AND pxz.i = x.i AND pxz.j = z.i
JOIN pair_w pyz ON pyz.dt = x.dt AND pyz.i = y.i AND pyz.j = z.i""")


@query("select_best_subset", "triples own hoods", """
SELECT 'best_subset' AS selector, 0 AS seed, o.dt, o.node AS asset, CAST(row_number() OVER (PARTITION BY o.dt ORDER BY o.direct DESC, o.i) AS INTEGER) AS rank
FROM own o LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY round(-inside - 2 * lin, 12), bits) AS best FROM triples) WHERE best = 1) t
  ON t.dt = o.dt WHERE o.i IN (t.i, t.j, t.k) OR t.dt IS NULL""")
def select_best_subset(spark: SparkSession, folder: str) -> DataFrame:
    _, hoods = _features_and_hoods(spark, folder)
    return S.select_best_subset(hoods, st.TOP)


@query("select_oracle", "outcome", f"""
SELECT 'oracle' AS selector, 0 AS seed, dt, asset, CAST(k AS INTEGER) AS rank FROM (
  SELECT dt, asset, row_number() OVER (PARTITION BY dt ORDER BY round(next_return, 12) DESC NULLS LAST, asset) AS k FROM outcome) WHERE k <= {st.TOP}""")
def select_oracle(spark: SparkSession, folder: str) -> DataFrame:
    return S.select_oracle(st.feature_rows(spark, folder), st.TOP)


# dates on which no asset is eligible, or the graph has no history, fall back
part("ok_seed", "scores feat", """
SELECT s.dt, arg_min(s.asset, struct_pack(a := -s.score, b := s.asset)) FILTER (f.volume_rel > 1.5) AS seed
FROM scores s JOIN feat f ON f.dt = s.dt AND f.asset = s.asset GROUP BY s.dt""")
part("fb_reason", "cal ok_seed", """
SELECT c.dt, c.t, CASE WHEN k.dt IS NULL THEN 'insufficient_history' WHEN k.seed IS NULL THEN 'no_eligible' END AS reason
FROM cal c LEFT JOIN ok_seed k ON k.dt = c.dt""")
part("fb_full", "fb_reason feat", "SELECT r.dt, r.reason, f.asset FROM fb_reason r JOIN feat f ON f.dt = r.dt WHERE r.reason IS NOT NULL")
part("fb0", "ok_seed", "SELECT dt, seed AS node, 0 AS rank FROM ok_seed WHERE seed IS NOT NULL")


def eligible_seeds(f: DataFrame) -> DataFrame:
    s = G.seed_score(f).join(f.select("dt", "asset", "volume_rel"), ["dt", "asset"])
    return G.seed_pick(G.eligible_filter(s, F.col("volume_rel") > 1.5))


def eligible_hoods(f: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    seeds = cut(eligible_seeds(f))
    grown = N.best_first_neighbourhood(e, seeds.where(F.col("seed").isNotNull()), st.SIZE)
    return seeds, cut(N.pack(e, grown))


for _i in range(1, st.SIZE):
    part(f"fb{_i}", f"fb{_i - 1} edges", f"""
SELECT dt, node, rank FROM fb{_i - 1} UNION ALL
SELECT dt, dst, {_i} FROM (SELECT e.dt, e.dst, row_number() OVER (PARTITION BY e.dt ORDER BY e.w DESC, e.dst) AS k
  FROM edges e JOIN fb{_i - 1} g ON g.dt = e.dt AND g.node = e.src LEFT JOIN fb{_i - 1} v ON v.dt = e.dt AND v.node = e.dst
  WHERE v.node IS NULL AND e.w > 0) WHERE k = 1""")
_fbr = draw_sql("'random'", "seed", "dt", "node")
part("fb_masks", f"fb{st.SIZE - 1} fb_full seed_list", f"""
SELECT 'random' AS selector, seed, dt, node AS asset, k AS rank, CAST(NULL AS VARCHAR) AS reason FROM (
  SELECT seed, dt, node, row_number() OVER (PARTITION BY seed, dt ORDER BY round({_fbr}, 12) DESC, node) AS k
  FROM fb{st.SIZE - 1} CROSS JOIN seed_list) WHERE k <= {st.TOP}
UNION ALL SELECT 'random', seed, dt, asset, NULL, reason FROM fb_full CROSS JOIN seed_list""")


@query("mask_fallback", "fb_masks", "SELECT selector, seed, dt, asset, CAST(rank AS INTEGER) AS rank, reason FROM fb_masks")
def mask_fallback(spark: SparkSession, folder: str) -> DataFrame:
    f, e = _features_and_edges(spark, folder)
    seeds, hoods = eligible_hoods(f, e)
    reasons = S.fallback_reasons(SP.calendar(f), seeds, hoods)
    return S.mask_fallback(S.select_random(hoods, st.TOP, st.SEEDS), reasons, f)


@query("mask_refresh", "walk_masks cal", """
SELECT m.selector, m.seed, c.dt, c.t, m.asset, CAST(m.rank AS INTEGER) AS rank FROM cal c
JOIN cal s ON s.t = c.t - c.t % 4 JOIN walk_masks m ON m.dt = s.dt""")
def mask_refresh(spark: SparkSession, folder: str) -> DataFrame:
    f, hoods = _features_and_hoods(spark, folder)
    return S.mask_refresh(st.walk_masks(hoods), SP.calendar(f), 4)


_rec = draw_sql("'order'", "seed", "dt", "node")


@query("ranked_recorder", "ranked_rw ranked_ew nodes seed_list", f"""
SELECT 'random_walk' AS selector, 0 AS seed, dt, asset, CAST(rank AS INTEGER) AS rank FROM ranked_rw
UNION ALL SELECT 'edge_walk', 0, dt, asset, CAST(rank AS INTEGER) FROM ranked_ew
UNION ALL SELECT 'random', seed, dt, node, CAST(row_number() OVER (PARTITION BY seed, dt ORDER BY round({_rec}, 12) DESC, node) AS INTEGER)
FROM nodes CROSS JOIN seed_list""")
def ranked_recorder(spark: SparkSession, folder: str) -> DataFrame:
    _, hoods = _features_and_hoods(spark, folder)
    return (
        S.ranked_recorder(W.random_walk_k(hoods, st.STEPS), "random_walk")
        .unionByName(S.ranked_recorder(W.edge_walk_k(hoods, st.STEPS), "edge_walk"))
        .unionByName(S.random_ranking(hoods, st.SEEDS))
    )


@query("selector_overlap", "walk_masks", """
SELECT count(*) AS n, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS identical, round(avg(jac), 6) + 0.0 AS mean_jaccard, round(min(jac), 6) + 0.0 AS min_jaccard
FROM (SELECT x.m AS a, y.m AS b, len(list_intersect(x.m, y.m)) / CAST(len(list_distinct(list_concat(x.m, y.m))) AS DOUBLE) AS jac
  FROM (SELECT seed, dt, list(asset ORDER BY asset) AS m FROM walk_masks WHERE selector = 'random_walk' GROUP BY seed, dt) x
  JOIN (SELECT seed, dt, list(asset ORDER BY asset) AS m FROM walk_masks WHERE selector = 'edge_walk' GROUP BY seed, dt) y USING (seed, dt))""")
def selector_overlap(spark: SparkSession, folder: str) -> DataFrame:
    _, hoods = _features_and_hoods(spark, folder)
    o = S.selector_overlap(st.walk_masks(hoods), "random_walk", "edge_walk")
    return o.select("n", *[tidy(c).alias(c) for c in ("identical", "mean_jaccard", "min_jaccard")])
