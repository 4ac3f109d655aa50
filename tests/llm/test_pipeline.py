"""The corpus pipeline against its plain Python version, and its shape."""

from collections import Counter

import pytest

import corpus_pipeline
from paneltide.llm import token_orc
from paneltide.llm.queries import ORACLE, QUERIES
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(ORACLE) <= set(QUERIES)


def test_run_equals_plain_version(spark):
    from tokenizers import Tokenizer

    try:
        rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    except Exception:
        pytest.skip("no test data")
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [r for r in rows if brute.keeps(r["text"])]
    own = brute.hamming_classes([brute.simhash(r["text"]) for r in rows])
    least = {c: min(r["doc_id"] for r, d in zip(rows, own) if d == c) for c in set(own)}
    rows = [r for r, c in zip(rows, own) if r["doc_id"] == least[c]]
    rows = [r for r in rows if not brute.contamination(r["text"], items)[3]]
    labels = {r["doc_id"]: {1: 2.0, 0: 0.5}.get(r["quality"], 1.0) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    copies, _ = brute.mix([(r["doc_id"], r["source"], len(brute.blank_words(r["text"]))) for r in rows], labels)
    mixed = [r for r in sorted(rows, key=lambda r: r["doc_id"]) for _ in range(copies[r["doc_id"]])]
    want = brute.token_digest([r["text"] for r in mixed], Tokenizer.from_file(token_orc.default_vocabulary()))
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert Counter((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter(
        (r["doc_id"], *w) for r, w in zip(mixed, want)
    )
