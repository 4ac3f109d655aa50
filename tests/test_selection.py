import datetime as dt
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneltide.operators import policy as P
from paneltide.operators import scores as SC
from paneltide.operators import selectors as S
from paneltide.operators import splits as SP


def chosen(masks):
    out = {}
    for r in masks.orderBy("rank").collect():
        out.setdefault((r.selector, r.seed, r.dt), []).append(r.asset)
    return out


def test_best_subset_is_the_best(hoods, packed):
    got = chosen(S.select_best_subset(hoods, 3))
    for row in packed:
        w = np.array(row.w)
        b = w[0].copy()
        b[0] = w[0].max()

        def energy(s):
            return -sum(w[i, j] for i, j in combinations(s, 2)) - 2 * sum(b[i] for i in s)

        best = min(combinations(range(len(w)), min(3, len(w))), key=energy)
        mine = [row.ids.index(a) for a in got[("best_subset", 0, row.dt)]]
        assert energy(sorted(mine)) == pytest.approx(energy(best), abs=1e-10)


def test_sticky_extremes_and_monotone(hoods, packed):
    got = chosen(S.select_sticky(hoods, 2, [0, 1, 2], [0.0, 0.5, 1.0]))
    ids = {r.dt: list(r.ids) for r in packed}
    days = sorted(ids)
    change = {}
    for (name, seed, d), m in got.items():
        assert len(m) == min(2, len(ids[d])) and set(m) <= set(ids[d])
        i = days.index(d)
        if i:
            before = got[(name, seed, days[i - 1])]
            if name == "sticky_0.00":
                assert {x for x in before if x in ids[d]} <= set(m)
            change.setdefault(name, []).append(len(set(m) - set(before)))
    means = [np.mean(change[n]) for n in ("sticky_0.00", "sticky_0.50", "sticky_1.00")]
    assert means[0] < means[1] < means[2]


def test_random_choice_is_uniform(hoods):
    rows = S.select_random(hoods, 2, list(range(40))).join(
        hoods.select("dt", F.size("ids").alias("n"), F.array_position("ids", F.lit("A1")).alias("has")), "dt"
    ).where("has > 0 and n = 5")
    hit, total = rows.agg(F.sum((F.col("asset") == "A1").cast("int")), F.count("*") / 2).first()
    assert hit / total == pytest.approx(2 / 5, abs=0.05)


def test_thompson_counts_only_resolved_labels(features):
    labels = SC.promising(features, 5).cache()
    post = {(r.t, r.asset): (r.a, r.b) for r in S.thompson_posterior(labels, 5).collect()}
    seen = {(r.t, r.asset): r.is_promising for r in labels.collect()}
    for (t, a), (x, y) in post.items():
        past = [seen[(u, a)] for u in range(0, t - 4)]
        assert (x, y) == (1 + sum(past), 1 + len(past) - sum(past))


def test_oracle_mask_takes_the_best_next_return(features):
    got = chosen(S.select_oracle(features, 2))
    pdf = features.select("asset", "dt", "return").toPandas().pivot(index="dt", columns="asset", values="return")
    nxt = pdf.shift(-1)
    for (_, _, d), m in list(got.items())[:30]:
        row = nxt.loc[d]
        if row.notna().all():
            assert set(m) == set(row.sort_values(ascending=False).index[:2])


def test_softmax_needs_an_allowed_action(spark):
    rows = [(1, "a", 0.0, True), (1, "b", 1.0, True), (1, "c", 9.0, False), (2, "a", 0.0, False)]
    df = spark.createDataFrame(rows, "step int, action string, logit double, allowed boolean")
    got = {r.action: r.prob for r in P.masked_softmax(df.where("step = 1"), ["step"]).collect()}
    assert got["c"] == 0.0 and got["b"] == pytest.approx(np.e / (1 + np.e))
    with pytest.raises(Exception, match="no allowed action"):
        P.masked_softmax(df, ["step"]).collect()


@pytest.fixture(scope="module")
def low_user(spark, tmp_path_factory):
    """A folder of events where one user is far below the others and one has no values at all."""
    folder = str(tmp_path_factory.mktemp("low"))
    rows = [(u, a, 10.0 + (u * 7 + i) % 5 - (50.0 if u == 3 else 0.0)) for u in range(20) for i, a in enumerate("xyz")]
    rows += [(20, "x", None), (20, "y", None)]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    return folder


def _equals_sql(spark, folder, name):
    import duckdb

    from paneltide.plans import catalog

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    got = catalog.QUERIES[name](spark, folder)
    want = con.execute(catalog.ORACLE[name]).fetchall()
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    return rows


def test_entropy_query_of_steps_without_an_allowed_action(spark, low_user):
    got = dict(_equals_sql(spark, low_user, "masked_entropy"))
    assert len(got) == 21 and got[3] is None and got[20] is None and got[0] > 0


def test_softmax_query_of_steps_without_an_allowed_action(spark, low_user):
    got = _equals_sql(spark, low_user, "masked_softmax")
    assert len(got) == 62 and {r[2:] for r in got if r[0] in (3, 20)} == {(None, None)}


def test_advantages_match_the_backward_loop(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for traj in range(3):
        n = 60 if traj else 200  # one long trajectory over several buckets and chunks
        start = dt.datetime(2024, 1, 1)
        part = [
            (traj, start + dt.timedelta(minutes=37 * i), i, float(rng.normal()), float(rng.normal()), float(rng.random() < 0.06))
            for i in range(n)
        ]
        rows += part
        nxt_v = nxt_a = 0.0
        for i in reversed(range(n)):
            _, _, _, r, v, done = part[i]
            d = r + 0.99 * nxt_v * (1 - done) - v
            nxt_a = d + 0.99 * 0.95 * (1 - done) * nxt_a
            nxt_v = v
            want[(traj, i)] = nxt_a
    df = spark.createDataFrame(rows, "traj long, ts timestamp, event_id long, reward double, v double, done double")
    got = {(r.traj, r.step): r.advantage for r in P.trajectory_gae(df, chunk=8).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def test_promising_includes_ties_and_not_the_end(features):
    rows = SC.promising(features, 5).collect()
    last = max(r.t for r in rows)
    assert all(r.g is None and not r.is_promising for r in rows if r.t > last - 5)
    per_day = {}
    for r in rows:
        per_day.setdefault(r.t, []).append(r)
    for t in (0, 10, last - 5):
        g = np.array([r.g for r in per_day[t]])
        cut = np.percentile(g, 80)
        assert [r.is_promising for r in per_day[t]] == list(g >= cut - 1e-12)


def test_episodes_stop_before_the_last_date(features):
    cal = SP.calendar(features)
    starts = SP.episode_starts(cal, 6, 10, 15)
    steps = SP.episode_steps(starts, cal, 15)
    n = cal.count()
    assert steps.agg(F.max("t")).first()[0] < n - 1
    assert [r.start for r in starts.orderBy("episode").collect()][:2] == [9, 24]


def test_beta_draws_have_the_moments_of_their_law(spark):
    for a, b in ((1, 1), (2, 5), (300, 700), (4, 1)):
        draws = spark.range(6000).select(S.beta_draw(F.lit(a), F.lit(b), "x", F.col("id")).alias("x"))
        mean, var, least, most = draws.agg(F.avg("x"), F.var_samp("x"), F.min("x"), F.max("x")).first()
        want = a * b / ((a + b) ** 2 * (a + b + 1))
        assert mean == pytest.approx(a / (a + b), abs=5 * (want / 6000) ** 0.5)
        assert var == pytest.approx(want, rel=0.1) and 0 <= least < most <= 1
