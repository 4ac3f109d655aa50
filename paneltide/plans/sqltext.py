"""The same chain as DuckDB SQL: common table expressions, put together by name.

Used only to check results. Bodies are written independently of the Spark
plans: where Spark folds arrays, these use joins and recursion.
"""

from __future__ import annotations

from paneltide.functions.draws import draw_sql
from paneltide.operators.graph import GraphParams
from paneltide.operators.resample import CHUNK
from paneltide.plans import stages as st
from paneltide.sources import tables as T

PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, deps: str, body: str) -> None:
    PARTS[name] = (tuple(deps.split()), body)


def compose(deps: str, select: str) -> str:
    """WITH the named parts and everything they need, then the select."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for d in PARTS[name][0]:
            visit(d)
        order.append(name)

    for d in deps.split():
        visit(d)
    if not order:
        return select
    # a recursive part names itself; those cannot be MATERIALIZED by keyword
    texts = []
    for n in order:
        body = PARTS[n][1].strip()
        recursive = body.upper().startswith("/*REC*/")
        cols = ""
        texts.append(f"{n}{cols} AS {'' if recursive else 'MATERIALIZED '}(\n{body}\n)")
    return "WITH RECURSIVE " + ",\n".join(texts) + "\n" + select


G = GraphParams()
MAX_NAN, FFILL = st.WEEKLY.clean.max_nan_ratio, st.WEEKLY.clean.ffill_limit
SEED_LIST = "(" + " UNION ALL ".join(f"SELECT {s} AS seed" for s in st.SEEDS) + ")"

part("trades", "", """
SELECT n_name AS asset, r_name AS sector, l_shipdate AS ts, l_extendedprice / l_quantity AS price,
       l_quantity AS qty, l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")


def bars_sql(unit: str) -> str:
    key = "ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, price, qty"
    return f"""
SELECT asset, sector, dt,
       max(CASE WHEN up = 1 THEN price END) AS open, max(price) AS high, min(price) AS low,
       max(CASE WHEN down = 1 THEN price END) AS close, sum(qty) AS volume
FROM (SELECT *, row_number() OVER (PARTITION BY asset, dt ORDER BY {key}) AS up,
             row_number() OVER (PARTITION BY asset, dt ORDER BY {', '.join(k.strip() + ' DESC' for k in key.split(','))}) AS down
      FROM (SELECT *, CAST(date_trunc('{unit}', ts) AS DATE) AS dt FROM trades))
GROUP BY asset, sector, dt"""


part("bars", "trades", bars_sql("week"))
part("bars_daily", "trades", bars_sql("day"))
part("bars_monthly", "trades", bars_sql("month"))


def gapless_sql(bars: str, step: str) -> str:
    return f"""
SELECT a.asset, a.sector, d.dt, b.open, b.high, b.low, b.close, b.volume
FROM (SELECT DISTINCT asset, sector FROM {bars}) a
CROSS JOIN (SELECT CAST(unnest(generate_series((SELECT min(dt) FROM {bars}), (SELECT max(dt) FROM {bars}), INTERVAL {step})) AS DATE) AS dt) d
LEFT JOIN {bars} b ON b.asset = a.asset AND b.sector = a.sector AND b.dt = d.dt"""


part("gapless", "bars", gapless_sql("bars", "7 DAY"))
part("gapless_daily", "bars_daily", gapless_sql("bars_daily", "1 DAY"))


def ffill_sql(source: str, limit: int, keep: str = "") -> str:
    cols = ", ".join(
        f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in ("open", "high", "low", "close", "volume")
    )
    return f"""
SELECT asset, sector, dt, {cols} FROM {source} {keep}
WINDOW w AS (PARTITION BY asset ORDER BY dt ROWS BETWEEN {limit} PRECEDING AND CURRENT ROW)"""


part("filled", "gapless", ffill_sql(
    "gapless", FFILL,
    f"WHERE asset IN (SELECT asset FROM gapless GROUP BY asset HAVING avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0.0 END) <= {MAX_NAN})"))
part("panel", "filled", """
SELECT * FROM filled WHERE dt IN (SELECT dt FROM filled GROUP BY dt
  HAVING count(close) = (SELECT count(DISTINCT asset) FROM filled))""")
part("ret", "panel", """
SELECT *, ln(close / lag(close) OVER (PARTITION BY asset ORDER BY dt)) AS r,
       close / lag(close) OVER (PARTITION BY asset ORDER BY dt) - 1 AS rs FROM panel""")
part("raw_features", "ret", """
SELECT asset, sector, dt, close, volume, r, rs,
       CASE WHEN count(r) OVER w = 20 THEN stddev_samp(r) OVER w * sqrt(252) END AS vol,
       CASE WHEN count(volume) OVER w = 20 THEN volume / nullif(avg(volume) OVER w, 0) END AS vr,
       CASE WHEN count(close) OVER w = 20 THEN 4.0 * stddev_samp(close) OVER w / nullif(avg(close) OVER w, 0) END AS bb
FROM ret WINDOW w AS (PARTITION BY asset ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
part("lagged", "raw_features", """
SELECT asset, sector, dt, close, volume, lag(r) OVER w AS "return", lag(rs) OVER w AS return_simple,
       lag(vol) OVER w AS volatility, lag(vr) OVER w AS volume_rel, lag(bb) OVER w AS bb_width
FROM raw_features WINDOW w AS (PARTITION BY asset ORDER BY dt)""")
part("feat", "lagged", """
SELECT *, row_number() OVER (PARTITION BY asset ORDER BY dt) - 1 AS t FROM lagged WHERE dt IN (
  SELECT dt FROM lagged GROUP BY dt
  HAVING sum(CASE WHEN "return" IS NOT NULL AND volatility IS NOT NULL AND volume_rel IS NOT NULL THEN 1 ELSE 0 END)
         = (SELECT count(DISTINCT asset) FROM lagged))""")
part("cal", "feat", "SELECT DISTINCT dt, t FROM feat")
part("corr_pairs", "feat", f"""
SELECT dt, t, src, dst, s, round(c, 12) AS corr, round({G.alpha} * c + {G.beta} * s, 12) AS a
FROM (SELECT * REPLACE (CASE WHEN c IS NULL OR NOT isfinite(c) OR c < 0 THEN 0 WHEN c > 1 THEN 1 ELSE c END AS c) FROM (SELECT x.dt, x.t, x.asset AS src, y.asset AS dst, CASE WHEN x.sector = y.sector THEN 1.0 ELSE 0.0 END AS s,
             corr(x."return", y."return") OVER w AS c, count(*) OVER w AS n
      FROM feat x JOIN feat y ON x.dt = y.dt AND x.asset < y.asset
      WINDOW w AS (PARTITION BY x.asset, y.asset ORDER BY x.dt ROWS BETWEEN {G.window - 1} PRECEDING AND CURRENT ROW)))
WHERE n >= {G.min_rows}""")
part("aff", "corr_pairs", f"""
SELECT dt, t, src, dst, round((a + {G.eps}) / greatest(max(a) OVER (PARTITION BY dt), 1.0), 12) AS a
FROM (SELECT dt, t, src, dst, a FROM corr_pairs UNION ALL SELECT dt, t, dst, src, a FROM corr_pairs)""")
part("knn", "aff", f"""
SELECT dt, src, dst, a, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY dt, src ORDER BY a DESC, dst) AS rank FROM aff) WHERE rank <= {G.k}""")
part("edges", "knn", """
SELECT DISTINCT dt, src, dst, a AS w FROM (
  SELECT dt, src, dst, a FROM knn UNION ALL SELECT dt, dst, src, a FROM knn)""")
part("scores", "feat", """
SELECT dt, t, asset, round(avg("return") OVER w / (stddev_samp("return") OVER w + 1e-8), 12) AS score
FROM feat WINDOW w AS (PARTITION BY asset ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
QUALIFY count("return") OVER w >= 2""")
part("picked", "scores", """
SELECT dt, asset AS seed, score FROM (
  SELECT *, row_number() OVER (PARTITION BY dt ORDER BY score DESC, asset) AS k FROM scores) WHERE k = 1""")

# growth: one round per part, joins over the whole frontier
part("grow0", "picked", "SELECT dt, seed AS node, 0 AS rank FROM picked")
for _i in range(1, st.SIZE):
    part(f"grow{_i}", f"grow{_i - 1} edges", f"""
SELECT dt, node, rank FROM grow{_i - 1} UNION ALL
SELECT dt, dst, {_i} FROM (
  SELECT e.dt, e.dst, row_number() OVER (PARTITION BY e.dt ORDER BY e.w DESC, e.dst) AS k
  FROM edges e JOIN grow{_i - 1} g ON g.dt = e.dt AND g.node = e.src
  LEFT JOIN grow{_i - 1} v ON v.dt = e.dt AND v.node = e.dst
  WHERE v.node IS NULL AND e.w > 0) WHERE k = 1""")
part("nodes", f"grow{st.SIZE - 1}", f"""
SELECT dt, node, rank FROM grow{st.SIZE - 1}
WHERE dt IN (SELECT dt FROM grow{st.SIZE - 1} GROUP BY dt HAVING count(*) >= 2)""")
part("inner_edges", "nodes edges", """
SELECT e.dt, e.src, e.dst, e.w, a.rank AS i, b.rank AS j FROM edges e
JOIN nodes a ON a.dt = e.dt AND a.node = e.src JOIN nodes b ON b.dt = e.dt AND b.node = e.dst""")


# walks
part("trans", "inner_edges nodes", """
SELECT dt, src, dst, w / sum(w) OVER (PARTITION BY dt, src) AS p FROM inner_edges
UNION ALL
SELECT n.dt, n.node, m.node, 1.0 / count(*) OVER (PARTITION BY n.dt, n.node)
FROM nodes n JOIN nodes m ON m.dt = n.dt
WHERE NOT EXISTS (SELECT 1 FROM inner_edges e WHERE e.dt = n.dt AND e.src = n.node)""")
part("rw0", "nodes", "SELECT dt, node, CASE WHEN rank = 0 THEN 1.0 ELSE 0.0 END AS p FROM nodes")
for _i in range(1, 7):
    part(f"rw{_i}", f"rw{_i - 1} trans", f"""
SELECT t.dt, t.dst AS node, sum(r.p * t.p) AS p FROM rw{_i - 1} r JOIN trans t ON t.dt = r.dt AND t.src = r.node
GROUP BY t.dt, t.dst""")
part("rw", f"rw{st.STEPS} nodes", f"""
SELECT n.dt, n.node, n.rank, coalesce(r.p, 0) / sum(coalesce(r.p, 0)) OVER (PARTITION BY n.dt) AS score
FROM nodes n LEFT JOIN rw{st.STEPS} r ON r.dt = n.dt AND r.node = n.node""")


def edge_walk_parts(prefix: str, source: str, k: int, mix: str = "weighted", start: str = "uniform") -> str:
    """Parts prefix0..prefixk over edges (grp, src, dst, w, seed) and the final score name."""
    amp = "sqrt(w / sum(w) OVER (PARTITION BY grp, src))" if mix == "weighted" else "1.0 / sqrt(count(*) OVER (PARTITION BY grp, src))"
    begin = (
        "1.0 / sqrt(count(*) OVER (PARTITION BY grp))" if start == "uniform"
        else "CASE WHEN src = seed THEN 1.0 / sqrt(count(*) OVER (PARTITION BY grp, src)) ELSE 0.0 END"
    )
    part(f"{prefix}0", source, f"SELECT grp, src, dst, {amp} AS a, {begin} AS psi FROM {source}")
    for i in range(1, k + 1):
        part(f"{prefix}{i}", f"{prefix}{i - 1}", f"""
SELECT x.grp, x.src, x.dst, x.a, m.psi FROM {prefix}{i - 1} x
JOIN (SELECT grp, dst AS src, src AS dst, 2 * a * sum(a * psi) OVER (PARTITION BY grp, src) - psi AS psi FROM {prefix}{i - 1}) m
  ON m.grp = x.grp AND m.src = x.src AND m.dst = x.dst""")
    return f"{prefix}{k}"


part("walk_edges", "inner_edges picked", """
SELECT e.dt AS grp, e.src, e.dst, e.w, p.seed FROM inner_edges e JOIN picked p ON p.dt = e.dt""")
_last = edge_walk_parts("ew", "walk_edges", st.STEPS)


def node_scores(last: str) -> str:
    return f"""
SELECT n.dt, n.node, n.rank, coalesce(s.q, 0) / sum(coalesce(s.q, 0)) OVER (PARTITION BY n.dt) AS score
FROM nodes n LEFT JOIN (SELECT grp, src, sum(psi * psi) AS q FROM {last} GROUP BY grp, src) s
  ON s.grp = n.dt AND s.src = n.node"""


part("ewalk", f"{_last} nodes", node_scores(_last))
part("ranked_rw", "rw", "SELECT dt, node AS asset, row_number() OVER (PARTITION BY dt ORDER BY round(score, 12) DESC, node) AS rank FROM rw")
part("ranked_ew", "ewalk", "SELECT dt, node AS asset, row_number() OVER (PARTITION BY dt ORDER BY round(score, 12) DESC, node) AS rank FROM ewalk")
part("seed_list", "", SEED_LIST[1:-1])
part("rank_random", "nodes seed_list", f"""
SELECT seed, dt, node AS asset, row_number() OVER (PARTITION BY seed, dt ORDER BY round({draw_sql("'random'", 'seed', 'dt', 'node')}, 12) DESC, node) AS rank
FROM nodes CROSS JOIN seed_list""")
part("walk_masks", "ranked_rw ranked_ew seed_list", f"""
SELECT 'random_walk' AS selector, seed, dt, asset, rank FROM ranked_rw CROSS JOIN seed_list WHERE rank <= {st.TOP}
UNION ALL SELECT 'edge_walk', seed, dt, asset, rank FROM ranked_ew CROSS JOIN seed_list WHERE rank <= {st.TOP}""")

# sticky selection: recursion over dates, the held set as a list
part("hoods", "nodes", """
SELECT dt, list(node ORDER BY rank) AS ids, row_number() OVER (ORDER BY dt) AS pos FROM nodes GROUP BY dt""")
_keep = draw_sql("'keep'", "s.seed", "h.dt", "x")
_fill = draw_sql("'fill'", "s.seed", "h.dt", "x")


def _sticky_choice(held: str) -> str:
    kept = f"list_filter({held}, lambda x: list_contains(h.ids, x) AND {_keep} >= s.p)[1:{st.TOP}]"
    rest = (
        f"list_transform(list_sort(list_transform(list_filter(h.ids, lambda x: NOT list_contains({kept}, x)), "
        f"lambda x: {{'u': {_fill}, 'x': x}})), lambda z: z.x)"
    )
    return f"list_concat({kept}, {rest})[1:least({st.TOP}, len(h.ids))]"


_grid = " UNION ALL ".join(f"SELECT CAST({p} AS DOUBLE) AS p" for p in st.STICKY)
part("sticky_state", "hoods seed_list", f"""/*REC*/
SELECT s.seed, s.p, h.dt, h.pos, {_sticky_choice("CAST([] AS VARCHAR[])")} AS held
FROM (SELECT seed, p FROM seed_list CROSS JOIN ({_grid})) s JOIN hoods h ON h.pos = 1
UNION ALL
SELECT s.seed, s.p, h.dt, h.pos, {_sticky_choice("s.held")}
FROM sticky_state s JOIN hoods h ON h.pos = s.pos + 1""")
part("sticky_masks", "sticky_state", """
SELECT 'sticky_' || format('{:.2f}', p) AS selector, seed, dt, held[i] AS asset, i AS rank
FROM (SELECT *, unnest(range(1, len(held) + 1)) AS i FROM sticky_state)""")
part("masks", "walk_masks rank_random sticky_masks", f"""
SELECT * FROM walk_masks UNION ALL
SELECT 'random', seed, dt, asset, rank FROM rank_random WHERE rank <= {st.TOP}
UNION ALL SELECT * FROM sticky_masks""")

# episodes
_start = draw_sql("'start'", "seed", "episode")
part("starts", "cal seed_list", f"""
SELECT seed, episode, CAST({st.LOOKBACK - 1} + floor({_start} * (n - {st.EPISODE_STEPS} - 1 - {st.LOOKBACK - 1} + 1)) AS INTEGER) AS start
FROM (SELECT count(*) AS n FROM cal), seed_list, (SELECT unnest(range(0, {st.EPISODES})) AS episode)
WHERE n >= {st.LOOKBACK + st.EPISODE_STEPS}""")
part("episodes", "starts cal", f"""
SELECT s.seed, s.episode, k.step, c.dt, c.t FROM starts s
CROSS JOIN (SELECT unnest(range(0, {st.EPISODE_STEPS})) AS step) k
JOIN cal c ON c.t = s.start + k.step WHERE c.t < (SELECT max(t) FROM cal)""")

# labels
part("gscore", "feat", f"""
SELECT dt, t, asset, CASE WHEN count("return") OVER w = {st.HORIZON}
  THEN round(avg("return") OVER w / (stddev_samp("return") OVER w + 1e-8), 12) END AS g
FROM feat WINDOW w AS (PARTITION BY asset ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND {st.HORIZON} FOLLOWING)""")
part("labels", "gscore", """
SELECT s.dt, t, asset, g, coalesce(g >= cut, false) AS is_promising FROM gscore s
JOIN (SELECT dt, round(quantile_cont(g, 0.8), 12) AS cut FROM gscore GROUP BY dt) c ON c.dt = s.dt""")

# outcomes, strategies, replay
part("outcome", "feat", """
SELECT dt, t, asset, lead("return") OVER (PARTITION BY asset ORDER BY dt) AS next_return, volatility AS vol FROM feat""")
part("mom", "feat", """
SELECT dt, t, asset, round(avg("return") OVER (PARTITION BY asset ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 12) AS momentum FROM feat""")
part("pick_mom", "mom", "SELECT dt, asset FROM (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY momentum DESC, asset) AS k FROM mom) WHERE k = 1")
part("pick_oracle", "outcome", """SELECT dt, asset FROM (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY round(next_return, 12) DESC, asset) AS k
  FROM outcome WHERE next_return IS NOT NULL) WHERE k = 1""")
part("split3", "cal", """
SELECT dt, t, CASE WHEN t < floor(n * 0.6) THEN 'train' WHEN t < floor(n * 0.6) + floor(n * 0.2) THEN 'val' ELSE 'test' END AS part
FROM cal, (SELECT count(*) AS n FROM cal)""")
part("pick_hold", "feat split3", """
SELECT asset FROM (SELECT asset, round(avg("return") / (stddev_samp("return") + 1e-8), 12) AS v FROM feat
  WHERE dt IN (SELECT dt FROM split3 WHERE part = 'train') GROUP BY asset) ORDER BY v DESC, asset LIMIT 1""")
part("names", "feat", "SELECT asset, row_number() OVER (ORDER BY asset) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT asset FROM feat)")
_sd = draw_sql("'strategy'", "seed", "c.dt")
part("pick_random", "cal names seed_list", f"""
SELECT s.seed, c.dt, m.asset FROM cal c CROSS JOIN seed_list s JOIN names m ON m.i = CAST(floor({_sd} * m.n) AS INTEGER)""")
part("actions", "pick_mom pick_oracle pick_hold pick_random cal seed_list", """
SELECT 'random' AS run, seed, dt, asset FROM pick_random UNION ALL
SELECT 'momentum', seed, dt, asset FROM pick_mom CROSS JOIN seed_list UNION ALL
SELECT 'oracle', seed, dt, asset FROM pick_oracle CROSS JOIN seed_list UNION ALL
SELECT 'buy_hold_best', seed, dt, (SELECT asset FROM pick_hold) FROM cal CROSS JOIN seed_list""")


def steps_sql(actions: str, reward: str = "next_return - 0.1 * vol - 0.001 * cost") -> str:
    return f"""
SELECT run, seed, episode, step, dt, t, asset, next_return, vol, cost, {reward} AS reward FROM (
  SELECT *, CASE WHEN before IS NOT NULL AND before <> asset THEN CAST(0.0005 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS cost FROM (
    SELECT a.run, e.seed, e.episode, e.step, e.dt, e.t, a.asset, o.next_return, coalesce(o.vol, 0) AS vol,
           lag(a.asset) OVER (PARTITION BY a.run, e.seed, e.episode ORDER BY e.step) AS before
    FROM episodes e JOIN {actions} a ON a.seed = e.seed AND a.dt = e.dt
    LEFT JOIN outcome o ON o.dt = e.dt AND o.asset = a.asset)) WHERE next_return IS NOT NULL"""


LOG_WEALTH = "CASE WHEN 1 + next_return <= 0 THEN -1000.0 ELSE ln(1 + next_return) END - 0.1 * vol - 0.001 * cost"
part("steps", "episodes actions outcome", steps_sql("actions"))
part("steps_log", "episodes actions outcome", steps_sql("actions", LOG_WEALTH))
part("mask_actions", "masks", "SELECT selector AS run, seed, dt, asset FROM masks WHERE rank = 1")
part("mask_steps", "episodes mask_actions outcome", steps_sql("mask_actions"))
part("hits", "steps labels", """
SELECT s.*, coalesce(l.is_promising, false) AS hit, row_number() OVER (PARTITION BY run, seed ORDER BY episode, step) AS n,
       sum(reward) OVER (PARTITION BY run, seed ORDER BY episode, step) AS cum
FROM steps s LEFT JOIN labels l ON l.dt = s.dt AND l.asset = s.asset""")
part("dropped", "hits", "SELECT *, max(cum) OVER (PARTITION BY run, seed ORDER BY episode, step) - cum AS fall FROM hits")
part("mask_hits", "masks labels", """
SELECT selector, seed, m.dt, bool_or(is_promising) AS hit, avg(CASE WHEN is_promising THEN 1.0 ELSE 0.0 END) AS share,
       bool_and(g IS NOT NULL) AS evaluable
FROM masks m JOIN labels l ON l.dt = m.dt AND l.asset = m.asset GROUP BY selector, seed, m.dt""")
part("sets", "masks", "SELECT selector, seed, dt, list(asset ORDER BY asset) AS members FROM masks GROUP BY selector, seed, dt")


def changes_sql(sets: str) -> str:
    return f"""
SELECT *, 1.0 - len(list_intersect(before, members)) / CAST(len(list_distinct(list_concat(before, members))) AS DOUBLE) AS change FROM (
  SELECT s.selector, e.seed, e.episode, e.step, e.dt, s.members,
         lag(s.members) OVER (PARTITION BY s.selector, e.seed, e.episode ORDER BY e.step) AS before
  FROM episodes e JOIN {sets} s ON s.seed = e.seed AND s.dt = e.dt) WHERE before IS NOT NULL"""


part("changes", "sets episodes", changes_sql("sets"))
part("sets_ok", "sets mask_hits", "SELECT s.* FROM sets s JOIN mask_hits h ON h.selector = s.selector AND h.seed = s.seed AND h.dt = s.dt WHERE h.evaluable")
part("changes_ok", "sets_ok episodes", changes_sql("sets_ok"))
part("rotation", "changes", "SELECT selector, seed, avg(change) AS rotation FROM changes GROUP BY selector, seed")
part("cand", "mask_hits episodes", """
SELECT h.selector, h.seed, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS candidate_hit_rate,
       avg(CASE WHEN evaluable THEN CASE WHEN hit THEN 1.0 ELSE 0.0 END END) AS candidate_hit_evaluable,
       sum(CASE WHEN evaluable THEN 1 ELSE 0 END) AS n_evaluable
FROM episodes e JOIN mask_hits h ON h.seed = e.seed AND h.dt = e.dt GROUP BY h.selector, h.seed""")

# experiment ledger
part("wide", "", """
SELECT event_type AS arm, user_id AS seed, avg(value) AS mean_value,
       stddev_samp(value) AS sd_value, max(value) AS max_value, CAST(count(value) AS DOUBLE) AS n_events
FROM events GROUP BY 1, 2""")
part("long", "wide", "\nUNION ALL ".join(
    f"SELECT arm, seed, '{m}' AS metric, {m} AS value FROM wide WHERE {m} IS NOT NULL" for m in T.ARM_METRICS))
part("diffs", "long", """
SELECT b.arm || '-' || a.arm AS contrast, a.metric, a.seed, round(b.value - a.value, 12) AS d
FROM long a JOIN long b ON a.seed = b.seed AND a.metric = b.metric AND a.arm < b.arm""")


def boot_parts(name: str, source: str, keys: str, n_boot: int, order: str = "seed", value: str = "d", tag: str = "boot") -> str:
    """Bootstrapped means of ``value`` per key as part ``name``."""
    part(f"{name}_ix", source, f"""
SELECT {keys}, {value} AS x, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS j, CAST(count(*) OVER (PARTITION BY {keys}) AS INTEGER) AS n
FROM {source} WHERE {value} IS NOT NULL""")
    # draws per chunk of CHUNK values: one binomial after the other, by its quantiles for every number of draws left
    part(f"{name}_bin", f"{name}_ix", f"""
SELECT n, c, h, list(cdf ORDER BY k) AS cdfs FROM (
  SELECT n, c, h, k, sum(exp(lgamma(h + 1) - lgamma(k + 1) - lgamma(h - k + 1) + k * ln(p) + (h - k) * ln(1 - p))) OVER (PARTITION BY n, c, h ORDER BY k) AS cdf FROM (
    SELECT n, c, h, unnest(range(0, h + 1)) AS k, {CHUNK}.0 / (n - {CHUNK} * c) AS p FROM (
      SELECT n, c, unnest(range(0, n + 1)) AS h FROM (SELECT n, unnest(range(0, CAST(ceil(n / {CHUNK}.0) AS INTEGER) - 1)) AS c FROM (SELECT DISTINCT n FROM {name}_ix)))
    WHERE c > 0 OR h = n))
GROUP BY n, c, h""")
    m = f"CASE WHEN {CHUNK} * (c + 1) >= n THEN h ELSE len(list_filter(cdfs, lambda x: x < u)) END"
    u = draw_sql(f"'{tag}'", "'split'", "s.n", "s.b", "s.c")
    part(f"{name}_left", f"{name}_ix {name}_bin", f"""/*REC*/
SELECT n, b, c, h, {m} AS m FROM (SELECT s.n, s.b, s.c, s.h, cdfs, {u} AS u FROM (
  SELECT n, unnest(range(0, {n_boot})) AS b, 0 AS c, n AS h FROM (SELECT DISTINCT n FROM {name}_ix)) s LEFT JOIN {name}_bin q ON q.n = s.n AND q.c = s.c AND q.h = s.h)
UNION ALL
SELECT n, b, c, h, {m} AS m FROM (SELECT s.n, s.b, s.c, s.h, cdfs, {u} AS u FROM (
  SELECT n, b, c + 1 AS c, h - m AS h FROM {name}_left WHERE {CHUNK} * (c + 1) < n) s LEFT JOIN {name}_bin q ON q.n = s.n AND q.c = s.c AND q.h = s.h)""")
    part(f"{name}_draw", f"{name}_left", f"""
SELECT n, b, {CHUNK} * c + CAST(floor(CAST('0x' || substr(hash, 8 * (slot % 4) + 1, 8) AS BIGINT) / 4294967296.0 * least({CHUNK}, n - {CHUNK} * c)) AS INTEGER) AS j, count(*) AS times FROM (
  SELECT n, b, c, slot, md5(concat_ws('|', '{tag}', n, b, c, slot // 4)) AS hash FROM (SELECT n, b, c, unnest(range(0, m)) AS slot FROM {name}_left))
GROUP BY 1, 2, 3""")
    part(name, f"{name}_ix {name}_draw", f"""
SELECT {keys}, b, sum(times * x) / max(n) AS boot FROM {name}_ix JOIN {name}_draw USING (n, j) GROUP BY {keys}, b""")
    return name


def paired_boot_parts(name: str, source: str, keys: str, n_boot: int) -> str:
    boot_parts(f"{name}_b", source, keys, n_boot)
    first = keys.split(",")[0].strip()
    part(name, f"{source} {name}_b", f"""
SELECT {keys}, mean, coalesce(lo, mean) AS ci_lo, coalesce(hi, mean) AS ci_hi, n,
       CASE WHEN NOT degenerate THEN least(1.0, 2 * least(pg, pe)) END AS p_two,
       CASE WHEN NOT degenerate THEN pg END AS p_greater, CASE WHEN NOT degenerate THEN pp END AS p_positive, degenerate
FROM (SELECT {keys}, avg(d) AS mean, count(*) AS n, min(d) = max(d) AS degenerate FROM {source} GROUP BY {keys} HAVING count(*) >= 2)
LEFT JOIN (SELECT {keys}, quantile_cont(boot, 0.025) AS lo, quantile_cont(boot, 0.975) AS hi,
  avg(CASE WHEN boot < 1e-12 THEN 1.0 ELSE 0.0 END) AS pg, avg(CASE WHEN boot > -1e-12 THEN 1.0 ELSE 0.0 END) AS pe,
  avg(CASE WHEN boot >= 1e-12 THEN 1.0 ELSE 0.0 END) AS pp FROM {name}_b GROUP BY {keys}) USING ({keys})""")
    return name


paired_boot_parts("pboot", "diffs", "contrast, metric", 5000)


def _simpson(density: str, x: str, steps: int = 4000) -> str:
    """0.5 + the integral of a density of x from 0 to x; ``density`` has {v} for its argument."""
    at = density.replace("{v}", f"(abs({x}) * i / {steps}.0)")
    weight = f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return f"(0.5 + sign({x}) * list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * {at})) * abs({x}) / {steps}.0 / 3)"


def norm_cdf_sql(x: str) -> str:
    return _simpson("exp(-{v} * {v} / 2) / sqrt(2 * pi())", x)


def _quantile_part(name: str, source: str, deps: str, keys: str, cdf: str, top: float) -> str:
    """({keys}, q): the root of the distribution function in (-top, top) for each row (p, ...) of ``source``, by halving."""
    part(f"{name}_steps", deps, f"""/*REC*/
SELECT {keys}, CAST({-top} AS DOUBLE) AS lo, CAST({top} AS DOUBLE) AS hi, 0 AS i FROM ({source})
UNION ALL SELECT {keys}, CASE WHEN cdf < p THEN mid ELSE lo END, CASE WHEN cdf < p THEN hi ELSE mid END, i + 1
FROM (SELECT *, {cdf} AS cdf FROM (SELECT *, (lo + hi) / 2 AS mid FROM {name}_steps WHERE i < 48))""")
    part(name, f"{name}_steps", f"SELECT {keys}, (lo + hi) / 2 AS q FROM {name}_steps WHERE i = 48")
    return name


def norm_quantile_part(name: str, source: str, deps: str) -> str:
    return _quantile_part(name, source, deps, "p", norm_cdf_sql("mid"), 8.0)


def t_quantile_part(name: str, source: str, deps: str) -> str:
    density = "exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi() * df) * power(1 + {v} * {v} / df, -(df + 1) / 2)"
    return _quantile_part(name, source, deps, "p, df", _simpson(density, "mid"), 20.0)
