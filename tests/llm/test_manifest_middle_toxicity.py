"""Merkle manifest, fill-in-the-middle and toxicity against plain Python versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneltide.llm import merkle, middle, toxicity
from tests.llm.test_operators import awkward, docs, empty, prose  # noqa: F401

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, row string, kids string, path string"


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, n_chars):
    values = [r["doc_id"], r["source"], r["lang"], n_chars, r["text"]]
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(level, arity):
    """Root of some digests, and for each leaf the runs it passes: (run, its place in it)."""
    ways, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for k, i in enumerate(at):
            ways[k].append((level[i // arity * arity : i // arity * arity + arity], i % arity))
        level = [H(*level[i : i + arity]) for i in range(0, len(level), arity)]
        at = [i // arity for i in at]
    return level[0], ways


def plain_manifest(rows, arity):
    """(doc_id, leaf) -> (leaf, subroot, root, proof, folded, verified), as a list."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["n_chars"]))
    own = {g: sorted(groups[g], key=key) for g in order}
    trees = {g: climb([plain_leaf(r, r["n_chars"]) for r in own[g]], arity) for g in order}
    root, tops = climb([trees[g][0] for g in order], arity)
    out = []
    for g, top in zip(order, tops):
        for r, way in zip(own[g], trees[g][1]):
            n = r["n_chars"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and n is not None:
                n += 1
            now, siblings = plain_leaf(r, n), []
            for run, slot in [*way, *top]:
                siblings += run[:slot] + run[slot + 1 :]
                now = H(*run[:slot], now, *run[slot + 1 :])
            out.append((r["doc_id"], plain_leaf(r, r["n_chars"]), trees[g][0], root, H(*siblings), now, now == root))
    return sorted(out, key=str)


def proved(table, **options):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = merkle.manifest(table, carry=["doc_id"], changed={"n_chars": tampered}, **options).prove()
    rows = found.select("row.doc_id", "leaf", "subroot", "root", "siblings", "folded").collect()
    out = [(r[0], *(bytes(x).hex() for x in r[1:4]), H(bytes(r[4]).hex()), bytes(r[5]).hex(), r[5] == r[3]) for r in rows]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(3)
    texts = ["", None, "a", "é\n漢字", prose(1, 3000)]
    rows = [(k, r.choice(["s", None]), r.choice(["de", "en", "", None]), r.choice([3, None, 1234]), texts[k % 5], "a", "b", "c") for k in range(90)]
    rows += [(None, "s", "en", 1, "x", "a", "b", "c")] * 3 + rows[:4] + [(5, "s", "fr", 1, "alone", "a", "b", "c")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("arity,depth", [(2, 8), (2, 2), (3, 1), (5, 2)])
def test_manifest(table, arity, depth):
    want = plain_manifest([r.asDict() for r in table.collect()], arity)
    assert proved(table, arity=arity, depth=depth) == want
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)


def test_manifest_of_one_row_and_of_none(table):
    one = table.where("lang = 'fr'")
    got = proved(one)
    assert got == plain_manifest([one.first().asDict()], 2) and got[0][1] == got[0][2] == got[0][3]
    assert merkle.manifest(table.where("false")).prove().count() == 0
    assert merkle.manifest(table.where("false")).root().count() == 0


def test_hash_states_can_be_resumed():
    r = random.Random(1)
    digests = np.frombuffer(r.randbytes(32 * 9000), np.uint8).reshape(-1, 32)
    got, before = merkle.parents(digests, np.arange(9000), 3)
    for k in (0, 7, 2999):
        run = [bytes(x).hex() for x in digests[3 * k : 3 * k + 3]]
        assert got[k].tobytes().hex() == H(*run)
        state = merkle.absorb(merkle.to_state(before[k : k + 1, 2]), merkle.hex_block(digests[3 * k + 2 : 3 * k + 3]))
        assert merkle.finish(state, np.array([3]))[0].tobytes() == got[k].tobytes()


def plain_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middle(spark, awkward, empty):  # noqa: F811
    odd = ["\n", "\n\n\n", "a\n", "\na", "🙂\r\n漢\x0b字\né", "x <P> y", "<S", "<S\nS>\n<M\nM>", "<M>", "a" * 100_000 + "\nb", "ab\n" * 30_000]
    rows = [(k, odd[k % len(odd)], *"abcdef") for k in range(100, 100 + 4 * len(odd))]
    table = awkward.unionByName(spark.createDataFrame(rows, awkward.schema))
    found = middle.transform(table).withColumn("again", middle.restore(F.col("output"), F.col("form")))
    got = found.select("row.*", "n", "form", "prefix_chars", "middle_chars", "output", "again").collect()
    assert len(got) == table.count()
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_middle(r["doc_id"], r["text"])
        assert r["again"] == (r["text"] or "")
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert {r["form"] for r in middle.transform(table, fim_percent=0).collect()} == {"plain"}
    assert middle.transform(empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 17, 5000])
def test_skip_list_offsets(n):
    sizes = np.random.default_rng(n).integers(1, 90, n)
    units = middle.SkipList(sizes)
    assert [units.offset(k) for k in range(n + 1)] == [0, *np.cumsum(sizes).tolist()]
    assert len(units.lanes) <= 12
    for units_of, chars_of, _ in units.lanes:
        assert units_of.sum() == n and chars_of.sum() == sizes.sum()
    with pytest.raises(IndexError):
        units.offset(n + 1)


def noise(r, n):
    return [r.choice("kamirosunolabetipewu") + r.choice("aeiou") + r.choice("xyzvbn") for _ in range(n)]


def toxic_pairs(seed, n):
    """Toxic if an insult of one kind meets a group of the same kind; each word alone says nothing."""
    r, out = random.Random(seed), []
    for _ in range(n):
        a, b = r.randrange(2), r.randrange(2)
        words = noise(r, 40)
        at = r.randrange(0, 30)
        words[at : at + 2] = [("qqrrst", "wwttuv")[a], ("hhgrou", "jjclan")[b]]
        out.append((" ".join(words), int(a == b)))
    return out


def train(docs_, steps):
    model = toxicity.Model(0.0, np.zeros(0, np.int64), np.zeros((0, 1 + toxicity.FACTORS)))
    for k, e in enumerate(steps):
        model = toxicity.merged([toxicity.fit_part(model, docs_[p::2], 10 * k + p, e) for p in range(2)])
    return model


def test_factors_learn_pairs_that_weights_cannot():
    held = toxic_pairs(2, 400)
    model = train(toxic_pairs(1, 1600), (80, 80))
    right = lambda m: np.mean([(s >= 0.5) == y for s, (_, y) in zip(toxicity.Scorer(m).score([t for t, _ in held]), held)])
    assert right(model) > 0.9
    weights_only = toxicity.Model(model.bias, model.rows, model.table * np.eye(1 + toxicity.FACTORS)[0])
    assert right(weights_only) < 0.65


def test_scores_equal_the_plain_sum_over_pairs():
    r = random.Random(6)
    rng = np.random.default_rng(6)
    words = noise(r, 150)
    hashed = np.unique(toxicity.terms(words)[0])
    model = toxicity.Model(-1.0, hashed, rng.normal(0, 0.1, (len(hashed), 1 + toxicity.FACTORS)))
    value = dict(zip(hashed.tolist(), model.table))

    def window(some):
        held = [value[int(t)] for block in some for t in toxicity.terms(sorted(set(block)))[0]] if some else []
        total = -1.0 + sum(x[0] for x in held)
        return total + sum(float(held[i][1:] @ held[j][1:]) for i in range(len(held)) for j in range(i))

    for n in (0, 1, 31, 32, 33, 64, 65, 150):
        blocks = [words[k : min(n, k + toxicity.BLOCK)] for k in range(0, n, toxicity.BLOCK)]
        want = max([window(blocks[k : k + 2]) for k in range(max(1, len(blocks) - 1))])
        got = toxicity.Scorer(model).score([" ".join(words[:n])])[0]
        assert got == pytest.approx(1 / (1 + np.exp(-want)))


def test_toxicity_of_held_out_texts(spark, awkward, empty):  # noqa: F811
    r = random.Random(9)

    def text(toxic):
        words = noise(r, r.choice([3, 60, 400]))
        for _ in range(toxic):
            words.insert(r.randrange(len(words)), r.choice(["gruntid", "flobbel", "snarkoo"]) + r.choice(["", "en", "ers"]))
        return " ".join(words)

    rows = [(k, text(k % 3 == 0)) for k in range(500)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(400)] + [(None, 1), (450, None)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.labelled(table.where("doc_id < 400"), labels))
    got = {x["row"]["doc_id"]: x["score"] for x in toxicity.score(table, model).collect()}
    assert len(got) == 500 and sum((got[k] >= 0.5) == (k % 3 == 0) for k in range(400, 500)) >= 95
    scored = toxicity.score(awkward, model)
    assert scored.count() == awkward.count()
    for x in scored.collect():
        assert 0 <= x["score"] < 0.5
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit(toxicity.labelled(table, labels.where("toxic = 1"))) is None
    assert {x["score"] for x in toxicity.score(awkward, None).collect()} == {0.0}
