"""Each text operator against a plain Python version, with the awkward cases of a table."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paneltide.llm import decontaminate, language, license, mixing, paragraphs, quality, sharding, simhash, substrings, token_orc
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, row string, words string, own string, marks string"
SYLLABLES = "ka to mi re su no la be".split()


def prose(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return "".join(w + (".\n" if r.random() < 0.06 else " ") for w in words).strip()


LONG = prose(99, 6000)
BASE = prose(1, 120)
PASSAGE = prose(7, 60).replace("\n", " ")


def texts():
    edited = BASE.split(" ")
    edited[30] = "changed"
    return [
        None,
        "",
        " \n\t ",
        "one two",
        BASE,
        BASE,
        " ".join(edited),
        prose(2, 80) + " " + PASSAGE + " " + prose(3, 80),
        prose(4, 90) + " " + PASSAGE.upper() + " " + prose(5, 20),
        LONG,
        "ÀÉß " * 60 + "MIT License and the GNU General Public License; mit\nlicense",
        "# * $ " * 40,
        "a b c " * 40,
        "same line here\n" * 20,
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        *[prose(s, 70) for s in range(20, 40)],
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "xy"[k % 2], (None, "s1", "s2", "s3")[k % 4], "a", "b", "c", "d") for k, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def awkward(docs):
    """With a row repeated and an id missing."""
    more = docs.where("doc_id = 4").unionByName(docs.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))
    return docs.unionByName(more)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, PASSAGE), (2, "never here at all"), (3, None), (4, "..."), (None, "one two"), (1, PASSAGE)]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_quality_measures_and_policies(awkward, empty):
    got = quality.ledger(awkward).select("row.text", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", quality.passes().alias("kept")).collect()
    assert len(got) == len(texts()) + 2
    for r in got:
        if r["text"] != LONG:  # the plain version is quadratic
            assert {k: r[k] for k in brute.quality("x")} == brute.quality(r["text"]), r["text"]
            assert r["kept"] == brute.keeps(r["text"])
    kept = quality.keep(awkward)
    assert kept.columns == awkward.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality.keep(empty).count() == 0


def test_quality_ablation_counts_lone_rules(docs):
    book = quality.ledger(docs).select("fail_bits")
    bits = [r[0] for r in book.collect()]
    got = {r["rule"]: (r["n_failed"], r["n_only"]) for r in quality.ablation(book, "v2").collect()}
    for k, rule in enumerate(quality.rules()):
        assert got[rule.name] == (sum(b >> k & 1 for b in bits), sum(b == 1 << k for b in bits))


@pytest.mark.parametrize("bucket", [1024, 3])
def test_simhash_classes(spark, bucket):
    r = random.Random(2)
    words = [0, (1 << 64) - 1]
    for _ in range(2):
        base = r.getrandbits(64)
        for _ in range(40):
            x = base
            for b in r.sample(range(64), r.randint(0, 7)):
                x ^= 1 << b
            words.append(x)
    words += [r.getrandbits(64) for _ in range(30)]
    table = spark.createDataFrame([(k, simhash._signed(x)) for k, x in enumerate(words)], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in table.join(simhash.classes(table, 4, bucket), "fp").collect()}
    own = brute.hamming_classes(words)
    least = {c: min(k for k, d in enumerate(own) if d == c) for c in set(own)}
    assert [got[k] for k in range(len(words))] == [least[c] for c in own]


def test_simhash_of_texts_and_one_of_each(awkward, empty):
    rows = awkward.select("doc_id", "text").collect()
    got = Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(awkward).collect())
    words = [brute.simhash(r["text"]) for r in rows]
    own = brute.hamming_classes(words)
    least = {c: min(r["doc_id"] for r, d in zip(rows, own) if d == c and r["doc_id"] is not None) for c in set(own)}
    assert got == Counter((r["doc_id"], w, least[c]) for r, w, c in zip(rows, words, own))
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("limit", [1 << 20, 10])
def test_decontamination(awkward, items, limit, monkeypatch):
    monkeypatch.setattr(decontaminate, "item_groups", lambda x, f=decontaminate.item_groups: f(x, limit))
    pairs = [tuple(r) for r in items.collect()]
    got = decontaminate.scan(awkward, items).select("row.text", "n_words", decontaminate.n_hit().alias("h"), "items", decontaminate.contaminated().alias("c"))
    for r in got.collect():
        want = brute.contamination(r["text"], pairs)
        assert (r["n_words"], r["h"], r["items"] or [], r["c"]) == want, r["text"]


def test_decontamination_of_empty_tables(docs, empty, items):
    assert decontaminate.scan(empty, items).count() == 0
    assert decontaminate.clean(docs, items.where("false")).count() == docs.count()


def test_wu_manber_equals_plain_search():
    r = random.Random(4)
    words = ["a", "bb", "ccc", "dd", "abcdefgh"]
    listing = [(str(k), " ".join(r.choice(words) for _ in range(r.randint(1, 20))).encode()) for k in range(30)]
    m = decontaminate.Matcher(listing, window=5)
    text = decontaminate.joined([r.choice(words).encode() for _ in range(3000)])
    want = sorted((i, p) for p in m.items for i in range(len(text)) if text.startswith(p, i))
    assert sorted(m.find(text)) == want


def test_mix_reaches_targets(spark, docs, empty):
    weights = {4: 2.0, 9: 0.5}
    labels = spark.createDataFrame(list(weights.items()), "doc_id long, weight double")
    rows = [(r["doc_id"], r["source"], len(brute.blank_words(r["text"]))) for r in docs.collect()]
    want, goal = brute.mix(rows, weights)
    got = mixing.mix(docs, labels).collect()
    assert {r["doc_id"]: r["copies"] for r in got} == want
    for r in got:
        assert r["target"] == pytest.approx(goal[r["source"]])
        assert r["copies"] <= 3
    mixed = mixing.apply(docs, labels)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({d: n for d, n in want.items() if n})
    assert mixing.apply(empty, labels).count() == 0


def test_mix_in_many_bins_and_with_repeated_rows(awkward):
    got = mixing.mix(awkward, None, bin_rows=2).collect()
    by_source = {}
    for r in got:
        by_source.setdefault(r["source"], []).append(r)
    for rows in by_source.values():
        gap = rows[0]["target"] - sum(r["copies"] * r["size"] for r in rows)
        assert 0 <= gap + 1e-6 <= max(r["size"] for r in rows) + 1
    assert mixing.apply(awkward).count() == sum(r["copies"] for r in mixing.mix(awkward).collect())


def test_ring_is_balanced_and_moves_little(spark, awkward, empty):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = sharding.assign(rows, 7).toPandas()
    sizes = got.groupby("shard").size()
    assert len(sizes) == 7 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    more = sharding.assign(rows, 8).toPandas()
    both = got.merge(more, on="doc_id")
    assert (both["shard_x"] != both["shard_y"]).mean() < 0.45  # hashing anew would move 7 of 8
    few = sharding.assign(awkward, 24).toPandas()
    assert len(few) == awkward.count() and few.groupby("shard").size().max() <= 2
    assert sharding.assign(empty, 3).count() == 0


def test_license_labels(awkward, empty):
    for r in license.scan(awkward).collect():
        words = brute.alnum_words(r["row"]["text"])
        places = sorted(
            (i, label) for p, label in license.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()
        )
        assert sorted((x["place"], x["label"]) for x in r["base"]) == places
        assert r["n_words"] == len(words)
        if (r["row"]["text"] or "").startswith("Permission is"):
            assert [(x["label"], x["place"], round(x["share"], 6)) for x in r["templates"]] == [("mit", 0, 1.0)]
        elif not places:
            assert not r["templates"]
    assert license.scan(empty).count() == 0


def test_token_files(spark, awkward, empty, tmp_path):
    from tokenizers import Tokenizer

    path = str(tmp_path / "ids")
    token_orc.write(awkward, path)
    got = token_orc.digest(token_orc.read(spark, path)).orderBy("start").collect()
    rows = sorted(awkward.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    want = brute.token_digest([r["text"] for r in rows], Tokenizer.from_file(token_orc.default_vocabulary()))
    assert [(r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == want
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]
    assert "EqualTo(doc_id,9)" in token_orc.read(spark, path).where("doc_id = 9")._jdf.queryExecution().toString()
    assert token_orc.round_trip(empty).count() == 0


def test_encoder_equals_the_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    r = random.Random(3)
    signs = "abzAZ éÉßÇØøÿ×÷ªº012'sStT.,!<|>endoftext_-\n\t\x1c\x85\xa0 ΣσςİK漢字🙂́½²"
    odd = ["".join(r.choice(signs) for _ in range(r.randrange(60))) for _ in range(1500)]
    odd += ["<|endoftext|> a<|startoftext|>b", "don't I'LL it's", "", "x" * 5000]
    plain = Tokenizer.from_file(token_orc.default_vocabulary())
    import numpy as np

    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(odd, add_special_tokens=False)]
    encoder = token_orc.Encoder(token_orc.default_vocabulary())
    assert encoder.encode(odd) == want and encoder.encode(odd[::-1]) == want[::-1]
    # few pieces are kept, and pieces that share their first hash are told apart
    monkeypatch.setattr(token_orc, "CACHE", 50)
    plain_hashes = encoder._hashes
    encoder._hashes = lambda *x: [plain_hashes(*x)[0] & np.uint64(1023), plain_hashes(*x)[1]]
    encoder._forget()
    for at in range(0, 300, 20):
        assert encoder.encode(odd[at : at + 20]) == want[at : at + 20]


def test_files_have_stripes_indexes_and_bloom_filters(spark, tmp_path, monkeypatch):
    import pyarrow.orc as orc

    monkeypatch.setattr(token_orc, "STRIPE_BYTES", 1 << 16)
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.md5(F.concat("id", F.lit(k))) for k in range(12)]).alias("text"))
    path = str(tmp_path / "ids")
    token_orc.write(rows, path)
    files = [orc.ORCFile(str(f)) for f in sorted((tmp_path / "ids").glob("*.orc"))]
    assert len(files) > 1 and sum(f.nrows for f in files) == 6000
    assert max(f.nstripes for f in files) > 1  # the unit of parallel reads
    assert all(f.row_index_stride == token_orc.STRIDE and f.file_footer_length > 0 for f in files)
    firsts = [f.read(columns=["doc_id"]).column(0) for f in files if f.nrows]
    spans = sorted((c[0].as_py(), c[len(c) - 1].as_py()) for c in firsts)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))  # a document is in one file only
    found = token_orc.read(spark, path).where("doc_id = 4321").collect()
    assert [r["doc_id"] for r in found] == [4321]


def test_language_of_held_out_and_mixed_texts(spark, docs, empty):
    r = random.Random(8)
    kinds = {"aa": ["la", "mo", "ti", "ra"], "bb": ["sch", "ung", "ach", "er"]}

    def text(kind, n):
        return " ".join("".join(r.choice(kinds[kind]) for _ in range(r.randint(1, 3))) for _ in range(n))

    rows = [(k, ("aa", "bb")[k % 2], text(("aa", "bb")[k % 2], 60)) for k in range(80)]
    model = language.fit(spark.createDataFrame(rows[:40], "doc_id long, lang string, text string"))
    asked = rows[40:] + [(900, None, None), (901, None, "12 -- 34"), (902, None, text("aa", 30) + " " + text("bb", 20))]
    got = {x["row"]["doc_id"]: x for x in language.label(spark.createDataFrame(asked, "doc_id long, lang string, text string"), model).collect()}
    assert all(got[d]["lang_pred"] == lang and got[d]["score"] > 0.9 for d, lang, _ in rows[40:])
    assert [(got[d]["lang_pred"], got[d]["score"]) for d in (900, 901)] == [("und", 0.0)] * 2
    assert [(s["lang"], s["start"], s["n"]) for s in got[902]["spans"]] == [("aa", 0, 30), ("bb", 30, 20)]
    assert language.fit(empty) is None
    assert {x["lang_pred"] for x in language.label(docs, None).collect()} == {"und"}


def test_forward_backward_equals_enumeration():
    from itertools import product

    import numpy as np

    rng = np.random.default_rng(1)
    e, moves = rng.random((4, 1, 3)), rng.random((3, 3))
    post, pairs = language.forward_backward(e, moves)
    want, both, total = np.zeros((4, 3)), np.zeros((3, 3)), 0.0
    for path in product(range(3), repeat=4):
        p = np.prod([e[t, 0, y] for t, y in enumerate(path)]) * np.prod([moves[a, b] for a, b in zip(path, path[1:])])
        total += p
        for t, y in enumerate(path):
            want[t, y] += p
        for a, b in zip(path, path[1:]):
            both[a, b] += p
    assert np.allclose(post[:, 0], want / total) and np.allclose(pairs, both / total)


def test_repeated_bytes(docs, awkward, empty, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 2000)
    want = brute.repeated_bytes([(r["doc_id"], r["text"]) for r in docs.collect()])
    columns = ["row.doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), "kept_sha256"]
    got = {r[0]: tuple(r)[1:] for r in substrings.repeated(docs).select(*columns).collect()}
    assert got == want
    more = substrings.repeated(awkward, ["doc_id"]).select(*columns).collect()
    assert [tuple(r)[1:] for r in more if r[0] == 4] == [want[4]] * 2
    last = next(r for r in more if r[0] is None)
    assert last["n_removed"] == last["n_bytes"] and last["n"] == 1
    assert substrings.repeated(empty).count() == 0


def test_windows_that_share_a_hash_are_told_apart(docs, monkeypatch):
    monkeypatch.setattr(substrings, "window_hashes", lambda d, f=substrings.window_hashes: f(d) & substrings._A.dtype.type(255))
    few = docs.where("doc_id IN (4, 5, 6, 7)")
    want = brute.repeated_bytes([(r["doc_id"], r["text"]) for r in few.collect()])
    got = {r["row"]["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in substrings.repeated(few).collect()}
    assert got == want


def test_paragraphs(awkward, docs, empty):
    got = paragraphs.duplicates(docs).collect()
    lines = [
        (r["doc_id"], w, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)))
        for r in docs.collect()
        for w in (brute.blank_words(x) for x in brute.lower(r["text"]).split("\n"))
        if len(w) >= 10
    ]
    linked = [
        (i, j) for i in range(len(lines)) for j in range(i) if len(lines[i][2] & lines[j][2]) >= 0.8 * len(lines[i][2] | lines[j][2])
    ]
    own = brute.classes(len(lines), linked)
    least = {c: min(x[0] for x, d in zip(lines, own) if d == c) for c in set(own)}
    want = Counter(x[0] for x, c in zip(lines, own) if x[0] > least[c])
    assert Counter(r["doc_id"] for r in got if r["kind"] == "paragraph") == want
    assert {r["kept_doc_id"] for r in got if r["doc_id"] == 8} == {7}  # the passage inside other text
    assert not {r["doc_id"] for r in got} & set(range(20, 35))
    assert {r["doc_id"] for r in paragraphs.duplicates(awkward).collect()} == {r["doc_id"] for r in got} | {None}
    assert paragraphs.duplicates(empty).count() == 0


def test_short_lines_are_units(spark):
    words = prose(61, 200).replace("\n", " ").split()
    wrapped = lambda w, n: "\n".join(" ".join(w[k : k + n]) for k in range(0, len(w), n))
    nine = "one two three four five six seven eight nine"
    rows = [
        (1, wrapped(words, 8)),
        (2, wrapped(words, 8)),
        (3, wrapped([*words[:100], "changed", *words[101:]], 7)),
        (4, "Hello there"),
        (5, "hello  THERE\n"),
        (6, "hello here"),
        (7, nine),
        (8, nine + " ten"),
        (9, nine.replace("nine", "").strip()),
        (10, "x"),
    ]
    got = paragraphs.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r["doc_id"], r["kind"], r["first_word"], r["n_words"], r["kept_doc_id"]) for r in got}
    assert {x for x in found if x[0] == 2 and x[1] != "passage"} == {(2, "joined", 0, 200, 1), *((2, "short", k, 8, 1) for k in range(0, 200, 8))}
    assert (3, "joined", 0, 200, 1) in found
    assert {x for x in found if x[0] > 3} == {(5, "short", 0, 2, 4), (8, "paragraph", 0, 10, 7), (9, "short", 0, 8, 7)}


def test_passages_of_51_words_at_any_place(spark):
    rows, want = [], set()
    for k in range(120):
        passage, before = prose(5000 + k, 51 + k % 3).replace("\n", " "), 3 * k % 71
        rows.append((k, f"{prose(6000 + k, 40 + k)} here{k} {passage} ends{k} {prose(7000 + k, 60)}".replace("\n", " ")))
        head, tail = prose(8000 + k, before).replace("\n", " ") + " start", prose(9000 + k, 30).replace("\n", " ")
        broken = passage if k % 2 else "\n".join(passage.rsplit(" ", 20))
        rows.append((1000 + k, f"{head} {broken} end {tail}"))
        want.add((1000 + k, before + 1, 51 + k % 3, k))
    rows += [(5000, prose(6, 50)), (5001, prose(6, 50) + " end")]  # 50 words are no passage
    got = paragraphs.removals(spark.createDataFrame(rows, "doc_id long, text string")).where("kind = 'passage'").collect()
    assert {(r["doc_id"], r["first_word"], r["n_words"], r["kept_doc_id"]) for r in got} == want


def test_a_band_of_near_copies_gives_no_row_per_pair(spark, monkeypatch):
    r = random.Random(11)
    words = prose(71, 40).replace("\n", " ").split()
    lines = []
    for k in range(90):  # unlike each other more often than alike
        w = list(words)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(2, 38)] = f"own{k}x{r.random()}"
        lines.append(" ".join(w))
    table = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    units = paragraphs.parts(table).where("kind >= 0").cache()
    name = {(x["n0"], x["n1"]): x["id"] for x in units.orderBy(units.id.desc()).collect()}
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, lines)]
    keys = {x["id"]: set(x["bands"]) for x in units.collect()}
    like = [(i, j) for i in range(90) for j in range(i) if keys[i] & keys[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    own = brute.classes(90, like)
    want = {frozenset(lines[i] for i in range(90) if own[i] == c) for c in set(own)} - {frozenset([x]) for x in lines}
    rows = []
    plain = paragraphs.linked
    monkeypatch.setattr(paragraphs, "linked", lambda cells, *more: (rows.append((cells.count(), (found := plain(cells, *more)).count())), found)[1])
    for size in (2048, 8):  # whole bands, then cells of a few units
        monkeypatch.setattr(paragraphs, "CELL_UNITS", size)
        tied, _ = paragraphs.links(table, units, paragraphs.distinct_units(units))
        found = {}
        for x in tied.collect():
            found.setdefault(x["root"], set()).add(lines[name[tuple(map(int, x["node"].split(":")))]])
        assert {frozenset(x) for x in found.values()} == want
    assert len(rows) == 3 and all(n_links < n_units for n_units, n_links in rows)
    assert rows[0][0] <= 10 * 90


def test_words_met_before_are_not_encoded_again(monkeypatch):
    encoder, calls = token_orc.Encoder(token_orc.default_vocabulary()), []
    plain = encoder._words
    monkeypatch.setattr(encoder, "_words", lambda words: (calls.append(sorted(words)), plain(words))[1])
    texts = ["walking home", "Walking, HOME! walking home", "home again"]
    got = [encoder.encode([x])[0] for x in texts]
    assert calls == [["home", "walking"], ["!", ","], ["again"]]
    assert got == [token_orc.Encoder(token_orc.default_vocabulary()).encode([x])[0] for x in texts]
