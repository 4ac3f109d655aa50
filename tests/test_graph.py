import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneltide.operators import graph as G
from paneltide.operators import neighbourhood as N
from paneltide.operators import walks as W


def matrices(edges):
    out = {}
    for r in edges.collect():
        out.setdefault(r.dt, {})[(r.src, r.dst)] = r.w
    return out


def test_blocks_do_not_change_the_graph(features, edges):
    small = G.GraphParams(window=30, k=2, asset_block=2, date_chunk=16)
    assert matrices(G.build_graph(features, small, 7)) == matrices(edges)


def test_graph_matches_numpy(features, edges):
    pdf = features.select("asset", "sector", "dt", "return").toPandas()
    r = pdf.pivot(index="dt", columns="asset", values="return").sort_index()
    sector = pdf.drop_duplicates("asset").set_index("asset")["sector"]
    names = list(r.columns)
    got = matrices(edges)
    for pos in (5, 40, len(r) - 1):
        x = r.to_numpy()[max(0, pos - 29) : pos + 1]
        same = np.array([[sector[a] == sector[b] for b in names] for a in names])
        a = 0.7 * np.maximum(np.corrcoef(x, rowvar=False), 0) + 0.3 * same
        a = np.round((np.round(a, 12) + 1e-8) / a.max(), 12)
        np.fill_diagonal(a, -1)
        near = np.zeros_like(a, bool)
        for i in range(len(names)):
            near[i, sorted(range(len(names)), key=lambda j: (-a[i, j], j))[:2]] = True
        keep = near | near.T
        want = {(names[i], names[j]): a[i, j] for i, j in zip(*np.nonzero(keep))}
        assert got[r.index[pos]].keys() == want.keys()
        for k, v in want.items():
            assert got[r.index[pos]][k] == pytest.approx(v, abs=2e-11)


def test_mutual_is_a_subset(features):
    near = G.knn_edges(features, G.GraphParams(window=30, k=2), 7).cache()
    avg = {(r.dt, r.src, r.dst) for r in G.symmetrize(near, "avg").collect()}
    mutual = {(r.dt, r.src, r.dst) for r in G.symmetrize(near, "mutual").collect()}
    assert mutual < avg and all((d, b, a) in avg for d, a, b in avg)


def test_growth_matches_a_heap(features, edges):
    seeds = {r.dt: r.seed for r in G.seed_pick(G.seed_score(features)).collect()}
    graphs = matrices(edges)
    grown = N.best_first_neighbourhood(edges, G.seed_pick(G.seed_score(features)), 5).collect()
    assert grown
    for row in grown:
        w = graphs.get(row.dt, {})
        order, heap = [seeds[row.dt]], []
        last = order[0]
        while len(order) < 5:
            for (s, t), v in w.items():
                if s == last and t not in order:
                    heapq.heappush(heap, (-v, t))
            while heap and heap[0][1] in order:
                heapq.heappop(heap)
            if not heap:
                break
            last = heapq.heappop(heap)[1]
            order.append(last)
        assert list(row.ids) == order


def test_clustering_and_spectral_match_dense(edges):
    graphs = matrices(edges)
    cl = {}
    for r in G.clustering(edges).collect():
        cl.setdefault(r.dt, {})[r.src] = r.clustering
    for dt in list(graphs)[:5]:
        names = sorted({a for a, _ in graphs[dt]})
        m = np.array([[graphs[dt].get((a, b), 0.0) for b in names] for a in names])
        d = m.sum(1)
        want = np.where(d > 1, np.diag(m @ m @ m) / np.where(d > 1, d * (d - 1), 1), 0)
        np.testing.assert_allclose([cl[dt][n] for n in names], want, atol=1e-9)


def dense_laplacian(rows):
    names = sorted({a for a, _ in rows})
    m = np.array([[rows.get((a, b), 0.0) for b in names] for a in names])
    d = m.sum(1)
    return names, np.eye(len(names)) - m / np.sqrt(np.outer(d, d))


def test_eigenvectors_agree_with_dense(edges):
    few = edges.where("dt <= date'2022-03-10'")
    got = {}
    for r in G.spectral_embedding(few, 2).collect():
        got.setdefault(r.dt, {})[r.src] = (r.spectral_1, r.spectral_2)
    graphs = matrices(few)
    assert got.keys() == graphs.keys()
    for dt, rows in graphs.items():
        names, lap = dense_laplacian(rows)
        values, vectors = np.linalg.eigh(lap)
        x = np.array([got[dt][n] for n in names])
        np.testing.assert_allclose(x.T @ x, np.eye(2), atol=1e-9)
        np.testing.assert_allclose(lap @ x, x * values[:2], atol=1e-9)
        if len(names) > 2 and min(np.diff(values[:3])) > 1e-3:
            np.testing.assert_allclose(np.abs(x[:, 1]), np.abs(vectors[:, 1]), atol=1e-6)
        assert x[np.abs(np.round(x[:, 1], 9)).argmax(), 1] > 0


def test_eigenvectors_of_a_large_graph(spark):
    rng = np.random.default_rng(5)
    n, w = 700, {}
    for i in range(n):  # two parts of 350 nodes, tied by few edges, so that one vector stands apart
        half = range(350) if i < 350 else range(350, n)
        for j in (*rng.choice(half, 12, replace=False), *([n - 1 - i] if i < 10 else [])):
            if i != j:
                w[(f"n{i:03d}", f"n{j:03d}")] = w[(f"n{j:03d}", f"n{i:03d}")] = float(rng.random()) + 0.5
    rows = spark.createDataFrame([("2024-01-01", a, b, v) for (a, b), v in w.items()], "dt string, src string, dst string, w double")
    edges = rows.withColumn("dt", F.to_date("dt"))
    got = G.spectral_embedding(edges, 2, tolerance=1e-10).orderBy("src").toPandas()
    _, lap = dense_laplacian(w)
    x = got["spectral_2"].to_numpy()
    assert x @ lap @ x == pytest.approx(np.linalg.eigvalsh(lap)[1], abs=1e-9)
    assert np.linalg.norm(lap @ x - (x @ lap @ x) * x) < 1e-9
    residual = G.spectral_residual(edges, G.spectral_embedding(edges, 1).select("dt", "src", F.col("spectral_1").alias("x"))).first()
    assert residual.residual < 1e-12 and residual["size"] == pytest.approx(1.0)


def test_eigenvectors_fail_without_convergence(edges):
    with pytest.raises(ArithmeticError):
        G.spectral_embedding(edges.where("dt <= date'2022-03-01'"), 2, rounds=1)


def dense_edge_walk(w, k, start):
    n = len(w)
    a = np.sqrt(w / w.sum(1, keepdims=True))
    psi = (w > 0) / np.sqrt((w > 0).sum())
    if start == "seed":
        psi = np.zeros((n, n))
        psi[0] = (w[0] > 0) / np.sqrt((w[0] > 0).sum())
    for _ in range(k):
        psi = (2 * a * (a * psi).sum(1, keepdims=True) - psi).T
    return (psi**2).sum(1)


def test_walks_match_dense_forms(hoods, packed):
    rw = {r.dt: r.score for r in W.random_walk_k(hoods, 3).collect()}
    ew = {r.dt: r.score for r in W.edge_walk_k(hoods, 4).collect()}
    es = {r.dt: r.score for r in W.edge_walk_k(hoods, 3, start="seed").collect()}
    for row in packed:
        w = np.array(row.w)
        p = np.eye(len(w))[0] @ np.linalg.matrix_power(w / w.sum(1, keepdims=True), 3)
        np.testing.assert_allclose(rw[row.dt], p, atol=1e-12)
        np.testing.assert_allclose(ew[row.dt], dense_edge_walk(w, 4, "uniform"), atol=1e-12)
        np.testing.assert_allclose(es[row.dt], dense_edge_walk(w, 3, "seed"), atol=1e-12)
        assert sum(ew[row.dt]) == pytest.approx(1.0)


def test_two_nodes_swap(spark):
    two = spark.createDataFrame([("d", ["a", "b"], [[0.0, 0.5], [0.5, 0.0]])], "dt string, ids array<string>, w array<array<double>>")
    at = [list(W.edge_walk_k(two, k, start="seed").first().score) for k in range(3)]
    assert at == [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0]]


def test_rewirings(hoods, packed):
    for df, degree in ((N.rewire_cycle(hoods), 2), (N.rewire_degree_capped(hoods, 2, uniform=True), None)):
        for row in df.collect():
            w = np.array(row.w)
            assert (w == w.T).all() and (np.diag(w) == 0).all()
            d = (w > 0).sum(1)
            assert (d == degree).all() if degree and len(w) >= 4 else (d <= 2).all()
    for row in N.hop_distance(N.rewire_cycle(hoods)).collect():
        n = len(row.ids)
        assert max(row.dist) == n // 2 and row.dist[0] == 0
