import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneltide.functions import dist
from paneltide.functions.draws import draw
from paneltide.operators import information as I
from paneltide.operators import ledger as L
from paneltide.operators import resample as RS


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_distribution_functions_against_tables(spark):
    assert value(spark, dist.t_cdf(2.262157, 9)) == pytest.approx(0.975, abs=1e-6)
    assert value(spark, dist.t_cdf(-1.833113, 9)) == pytest.approx(0.05, abs=1e-6)
    assert value(spark, dist.t_quantile(0.975, 39)) == pytest.approx(2.022691, abs=1e-6)
    assert value(spark, dist.t_quantile(0.975, 1)) == pytest.approx(12.7062047, abs=1e-6)
    assert value(spark, dist.t_quantile(0.025, 2)) == pytest.approx(-4.30265273, abs=1e-6)
    assert value(spark, dist.t_cdf(float("inf"), 4)) == 1.0
    normal = statistics.NormalDist()
    for x in (-8.0, -3.3, -0.5, 0.0, 0.1, 2.0, 6.5, 30.0):
        assert value(spark, dist.norm_cdf(x)) == pytest.approx(normal.cdf(x), abs=1e-14)
    for p in (1e-9, 0.001, 0.3, 0.5, 0.8, 0.975, 1 - 1e-7):
        assert value(spark, dist.norm_quantile(p)) == pytest.approx(normal.inv_cdf(p), abs=1e-6 if p < 1e-6 else 1e-9)
        # many degrees of freedom come near the normal distribution
        assert value(spark, dist.t_quantile(p, 20001)) == pytest.approx(normal.inv_cdf(p), rel=1e-2, abs=1e-6)
    for bad in (dist.norm_quantile(0.0), dist.norm_quantile(1.5), dist.t_cdf(1.0, 0), dist.t_cdf(float("nan"), 3), dist.norm_cdf(float("nan"))):
        assert value(spark, bad) is None


def test_student_functions_are_inverse(spark):
    rows = spark.createDataFrame([(p, n) for p in (0.01, 0.2, 0.5, 0.9, 0.999) for n in (1, 2, 3, 7, 40, 1499)], "p double, n int")
    for r in rows.withColumn("back", dist.t_cdf(dist.t_quantile("p", "n"), "n")).collect():
        assert r.back == pytest.approx(r.p, abs=1e-12)


def test_signed_ranks_are_exact():
    from itertools import product
    from time import perf_counter

    # n = 5: P(W >= 15) = 1/32
    assert dist.signed_rank_tail(15, 5)[1] == pytest.approx(1 / 32)
    assert dist.signed_rank_p(15, 5, (), 0) == pytest.approx(2 / 32)
    for sizes in ([1, 1, 1, 1], [2, 1, 3], [4, 2], [1, 2, 2, 1, 3, 1], [12]):
        ranks, tied, at = [], [], 1
        for t in sizes:
            ranks += [at + (t - 1) / 2] * t
            tied += [(2 * at + t - 1, t)] if t > 1 else []
            at += t
        sums = [sum(r for r, s in zip(ranks, signs) if s) for signs in product((0, 1), repeat=len(ranks))]
        for w in {sums[0], sums[-1], sums[len(sums) // 3], sums[len(sums) // 2]}:
            low, high = dist.signed_rank_tail(w, len(ranks), tuple(tied))
            assert low == pytest.approx(np.mean([s <= w for s in sums])) and high == pytest.approx(np.mean([s >= w for s in sums]))
    for tied in ((), ((401, 2), (900, 3))):
        start = perf_counter()
        low, high = dist.signed_rank_tail(500_000.0, 1500, tied)
        assert perf_counter() - start < 5
        z = (500_000.5 - 1500 * 1501 / 4) / (1500 * 1501 * 3001 / 24) ** 0.5
        assert low == pytest.approx(statistics.NormalDist().cdf(z), abs=1e-4) and low + high > 1


def test_bootstrap_draws_are_multinomial_and_match_the_rows(spark):
    for n in (1, 5, 64, 65, 200, 333):
        counts = RS.count_matrix(n, 400)
        assert counts.shape == (400, n) and (counts.sum(1) == n).all()
        if n > 4:
            assert counts.mean() == pytest.approx(1.0) and counts.var() == pytest.approx(1 - 1 / n, abs=0.08)
    x = np.random.default_rng(3).normal(size=333)
    rows = spark.createDataFrame([("k", i * 37, float(v)) for i, v in enumerate(x)], "k string, seed int, d double").repartition(7)
    got = {r.b: r.boot for r in RS.bootstrap_mean(rows, ["k"], "seed", "d", 600).collect()}
    np.testing.assert_allclose([got[b] for b in range(600)], RS.count_matrix(333, 600) @ x / 333)


def test_hashes_by_vector_operations_are_md5():
    from hashlib import md5

    from paneltide.functions.draws import hashed

    b, c = np.array([0, 9, 10, 499, 4999, 12345678901]), np.array([1005, 0, 9, 10, 64, 5])
    for parts in (("boot", "split", 90000, b, c), ("boot", 7, b, 3, c), ("t" * 50, 3, b)):  # the last over one block
        keys = ["|".join(str(p[i] if isinstance(p, np.ndarray) else p) for p in parts) for i in range(len(b))]
        want = np.frombuffer(b"".join(md5(k.encode()).digest() for k in keys), ">u4").reshape(-1, 4).T
        assert (hashed(*parts) == want).all()
    m = np.array([0, 5, 64, 130])
    counts = RS.chunk_counts(70, 1, 30, m, "boot")  # a last chunk of six values
    for row, times in enumerate(m):
        text = b"".join(md5(f"boot|70|{30 + row}|1|{q}".encode()).digest() for q in range(-(-int(times) // 4)))
        u = np.frombuffer(text, ">u4")[:times] / 2.0**32
        assert (counts[row] == np.bincount((u * 6).astype(int), minlength=6)).all()


def test_draws_are_split_by_many_tasks_in_bounded_frames(spark):
    import pandas as pd

    n = 64 * 600 - 3
    frames = list(RS._splits("boot")(iter([pd.DataFrame({"n": [n], "first": [0], "size": [20]})])))
    assert len(frames) > 1 and max(map(len, frames)) <= 256
    draws = np.array([d for f in frames for d in f["draws"]])
    assert (draws == RS.chunk_draws(n, 0, 20, "boot")).all() and (draws.sum(0) == n).all()
    plan = RS.bootstrap_mean(diffs(spark, range(200)), ["contrast"], "seed", "d", 1000)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan  # numbers of partitions by size would make it one task


def test_pairs_of_arms_are_not_met_by_a_broadcast_of_the_ledger(spark):
    from paneltide.session import cut

    rows = [(arm, seed, "m", float(seed % 3 + k)) for k, arm in enumerate("abc") for seed in range(500)]
    long = cut(spark.createDataFrame(rows, "arm string, seed int, metric string, value double"))
    for contrasts, pairs in ((None, 3), ([("x", "b", "a")], 1)):
        got = L.paired_diff(long, contrasts)
        assert got.count() == 500 * pairs and got.where("d <= 0").count() == 0
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_draws_are_uniform_and_repeatable(spark):
    df = spark.range(20000).select(draw("x", 1, F.col("id")).alias("u"))
    mean, sd = df.agg(F.avg("u"), F.stddev("u")).first()
    assert mean == pytest.approx(0.5, abs=0.01) and sd == pytest.approx(12**-0.5, abs=0.01)
    assert df.exceptAll(spark.range(20000).repartition(7).select(draw("x", 1, F.col("id")).alias("u"))).count() == 0


def diffs(spark, values, contrast="b-a", metric="m"):
    rows = [(contrast, metric, i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "contrast string, metric string, seed int, d double")


def test_bootstrap_degenerate_and_tails(spark):
    flat = RS.paired_bootstrap(diffs(spark, [0.5] * 6), ["contrast"], 200).first()
    assert flat.degenerate and flat.p_two is None and flat.ci_lo == flat.mean == 0.5
    rng = np.random.default_rng(1)
    pos = RS.paired_bootstrap(diffs(spark, rng.normal(2, 1, 12)), ["contrast"], 500).first()
    assert pos.p_greater < 0.01 and pos.ci_lo > 0 and pos.ci_lo < pos.mean < pos.ci_hi
    zero = RS.paired_bootstrap(diffs(spark, [-1.0, 1.0, 0.0, 0.0]), ["contrast"], 500).first()
    assert zero.p_two == 1.0


def test_corrections_are_ordered(spark):
    ps = [0.001, 0.04, 0.03, 0.2, None]
    rows = spark.createDataFrame([(f"c{i}", p) for i, p in enumerate(ps)], "contrast string, p double")
    got = {r.contrast: r for r in L.with_corrections(rows).collect()}
    assert got["c0"].holm == pytest.approx(0.004) and got["c2"].holm == pytest.approx(0.09)
    assert got["c1"].holm == pytest.approx(0.09) and got["c1"].fdr_bh == pytest.approx(0.04 * 4 / 3)
    assert got["c4"].holm is None
    for r in got.values():
        if r.p is not None:
            assert r.p <= r.fdr_bh <= r.holm <= r.bonferroni


def test_t_and_equivalence(spark):
    d = np.array([0.1, -0.2, 0.05, 0.12, -0.03, 0.2, -0.1, 0.02])
    t = L.paired_t(diffs(spark, d)).first()
    want = d.mean() / (d.std(ddof=1) / np.sqrt(len(d)))
    assert t.t == pytest.approx(want) and t.p == pytest.approx(2 * (1 - value(spark, dist.t_cdf(abs(want), 7))))
    assert L.tost(diffs(spark, d), 0.5).first().equivalent and not L.tost(diffs(spark, d), 0.05).first().equivalent


def test_wilcoxon_ranks_with_ties_and_zeros(spark):
    row = L.wilcoxon_signed_rank(diffs(spark, [0.0, 1.0, -1.0, 2.0, 3.0, -4.0])).first()
    assert row.n == 5 and row.w_plus == pytest.approx(1.5 + 3 + 4) and row.ties == 6


def test_interpolation_matches_numpy(spark):
    knots = spark.createDataFrame([(0.1, 1.0), (0.4, 3.0), (0.9, 2.0)], "x double, y double")
    xs = [0.0, 0.1, 0.25, 0.4, 0.6, 0.9, 1.5]
    got = L.interp_curve(spark.createDataFrame([(x,) for x in xs], "x double"), knots).orderBy("x").collect()
    np.testing.assert_allclose([r.y for r in got], np.interp(xs, [0.1, 0.4, 0.9], [1, 3, 2]))


def plain_mi(x, y):
    n, total, cells = len(x), 0.0, 0
    for a in (0, 1):
        for b in (0, 1):
            p = np.mean((x == a) & (y == b))
            if p > 0:
                total += p * np.log(p / (np.mean(x == a) * np.mean(y == b)))
                cells += 1
    return total + max(cells - 3, 0) / (2 * n)


def test_information_of_every_offset(spark):
    rng = np.random.default_rng(2)
    T, N = 20, 6
    y = rng.random((T, N)) < 0.3
    x = rng.random((T, N)) < 0.4
    x[:, 0] = True  # every date has a mask
    labels = spark.createDataFrame([(t, f"a{i}", bool(y[t, i])) for t in range(T) for i in range(N)], "t int, asset string, is_promising boolean")
    masks = spark.createDataFrame([("s", 0, t, f"a{i}") for t in range(T) for i in range(N) if x[t, i]], "selector string, seed int, dt int, asset string")
    eps = spark.createDataFrame([(0, t, t) for t in range(0, 15)] + [(0, t, t) for t in range(5, 12)], "seed int, dt int, t int")
    visits = list(range(0, 15)) + list(range(5, 12))
    got = {r.off: r.mi for r in I.mi_by_offset(masks, labels, eps, T).collect()}
    for off in range(T):
        xs = np.concatenate([x[t] for t in visits])
        ys = np.concatenate([y[(t + off) % T] for t in visits])
        assert got[off] == pytest.approx(plain_mi(xs, ys), abs=1e-10)
    assert I.mutual_information(masks, labels, eps).first().mi == pytest.approx(got[0], abs=1e-10)


def test_deflated_ratio_falls_with_trials(spark):
    rng = np.random.default_rng(4)
    series = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(rng.normal(0.1, 1, 300))], "name string, t int, x double")
    ratios = [0.02 * k for k in range(11)]
    trials = spark.createDataFrame([(v,) for v in ratios], "sharpe double")
    rows = I.dsr_k_sensitivity(I.series_moments(series), trials).orderBy("k").collect()
    assert [r.k for r in rows] == list(range(2, 12))
    for r in rows:
        z = [statistics.NormalDist().inv_cdf(p) for p in (1 - 1 / r.k, 1 - 1 / (r.k * np.e))]
        assert r.sr_star == pytest.approx(np.std(ratios, ddof=1) * (0.42278433509846714 * z[0] + 0.5772156649015329 * z[1]))
    dsr = [r.dsr for r in rows]
    assert dsr == sorted(dsr, reverse=True) and 0 < dsr[-1] < dsr[0] < 1


def test_stationary_bootstrap_covers_the_ratio(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0.2, 1, 120)
    series = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "name string, t int, x double")
    lo, hi = RS.stationary_bootstrap(series, 200, 10).agg(F.percentile("sharpe", 0.025), F.percentile("sharpe", 0.975)).first()
    assert lo < x.mean() / x.std(ddof=1) < hi


def test_bootstrap_calibration_is_the_tests_on_null_samples(spark):
    from paneltide.operators import ledger as L
    from paneltide.operators.resample import paired_bootstrap
    from paneltide.plans import catalog

    rng = np.random.default_rng(8)
    rows = [(f"c{c}", m, s, float(x)) for c in range(2) for m in ("x", "y") for s, x in enumerate(rng.normal(1, 2, 13 + c))]
    diffs = spark.createDataFrame(rows, "contrast string, metric string, seed int, d double")
    samples = L.null_samples(diffs, (10, 40), 6)
    keys = ["contrast", "metric", "size", "r"]
    want = {}
    for r in paired_bootstrap(samples, keys, 50).collect():
        want.setdefault((r["contrast"], r["metric"], r["size"]), []).append(r["p_two"] < 0.3)
    got = L.bootstrap_calibration(diffs, 6, 50, alpha=0.3).collect()
    assert {(r["contrast"], r["metric"], r["n"]): r["rejection_rate"] for r in got if r["test"] == "bootstrap"} == pytest.approx(
        {k: sum(v) / 6 for k, v in want.items()}
    )
    assert len(got) == 4 * 2 * 3 and {r["replicates"] for r in got} == {6}
    whole = catalog.QUERIES["bootstrap_calibration"](spark, "/root/testdata/sf0.001").collect()
    assert len({(r["contrast"], r["metric"]) for r in whole}) == 40 and len(whole) == 40 * 2 * 3
    assert {r["n"] for r in whole} == {10, 40} and {r["replicates"] for r in whole} == {2000}
    assert all(0.01 < r["rejection_rate"] < 0.2 for r in whole if r["test"] == "bootstrap")


def test_circular_counts_equal_the_plain_sum(spark):
    rng = np.random.default_rng(2)
    n = 37
    c, g = rng.integers(0, 4, n), rng.integers(0, 2, n)
    at = [int(t) for t in np.flatnonzero(c)], [int(t) for t in np.flatnonzero(g)]
    rows = spark.createDataFrame([(at[0], [int(c[t]) for t in at[0]], at[1], [1] * len(at[1]))], "t array<int>, c array<int>, at array<int>, g array<int>")
    got = rows.select(I.circular_counts(n)("t", "c", "at", "g").alias("x")).first().x
    assert got == [int(sum(c[t] * g[(t + off) % n] for t in range(n))) for off in range(n)]
