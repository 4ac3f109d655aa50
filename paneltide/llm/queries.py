"""The registered query of each operator, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paneltide.llm import (
    decontaminate,
    language,
    license,
    merkle,
    middle,
    mixing,
    paragraphs,
    quality,
    sharding,
    simhash,
    substrings,
    token_orc,
    toxicity,
)
from paneltide.llm.common import read

SHARDS = 24

_BLANK_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_ALNUM_WORDS = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)


def op1_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = language.held_out(F.col("doc_id"))
    model = language.fit(docs.where(~held_out).select("doc_id", "lang", "text"))
    found = language.label(docs.select("doc_id", "text"), model, ["doc_id"], with_spans=False)
    return found.select(
        "row.doc_id", language.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op2_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, read(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "row.doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op3_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.removals(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_byte_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeated(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return found.select(
        "row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )


def op7_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(read(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base_failed = F.col("fail_bits").bitwiseAND(F.lit(quality.mask(quality.BASE)).cast("long")) != 0
    return book.select(
        "row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & quality.passes()).alias("kept"),
        "fail_bits",
    )


def op9_exponential_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"), quality_weights(spark, sf_dir))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source"
    )


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, weight): labelled good documents weigh 2, bad ones 1/2; all others count as 1."""
    labels = read(spark, sf_dir, "labels").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return labels.select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0).alias("weight"))


def op10_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base, all_ = F.col("base.label"), F.concat("base.label", "templates.label")
    return found.select(
        "row.doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.place").cast("long").alias("first_word"),
        F.array_max("base.place").cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(all_).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max("templates.share"), F.lit(0.0))).alias("score"),
    )


def op11_midstate_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    proofs = merkle.manifest(docs, carry=["doc_id"], changed={"n_chars": tampered}).prove()
    text = lambda c: F.lower(F.hex(c))
    return proofs.select(
        "row.doc_id",
        text("leaf").alias("leaf"),
        text("subroot").alias("subroot"),
        text("root").alias("root"),
        F.sha2(text("siblings"), 256).alias("proof_sha256"),
        text("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def op12_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    known = toxicity.labelled(docs.where(~toxicity.held_out(F.col("doc_id"))), read(spark, sf_dir, "labels"))
    found = toxicity.score(docs, toxicity.fit(known), ["doc_id"])
    return found.select(
        "row.doc_id",
        toxicity.held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op13_skip_list_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    formed = middle.transform(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return formed.select(
        "row.doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES = {
    "op1_crf_language": op1_crf_language,
    "op2_wu_manber": op2_wu_manber,
    "op3_simhash_pivots": op3_simhash_pivots,
    "op4_token_orc": op4_token_orc,
    "op5_paragraph_minhash": op5_paragraph_minhash,
    "op6_byte_windows": op6_byte_windows,
    "op7_ring_shards": op7_ring_shards,
    "op8_quality_ledger": op8_quality_ledger,
    "op9_exponential_mix": op9_exponential_mix,
    "op10_license_index": op10_license_index,
    "op11_midstate_manifest": op11_midstate_manifest,
    "op12_factorization_toxicity": op12_factorization_toxicity,
    "op13_skip_list_middle": op13_skip_list_middle,
}

ORACLE: dict[str, str] = {
    "op8_quality_ledger": rf"""
WITH w AS (SELECT rowid_ AS k, doc_id, coalesce(text, '') AS text, {_BLANK_WORDS} AS ws
           FROM (SELECT row_number() OVER () AS rowid_, * FROM documents)),
p AS (SELECT k, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, list_slice(ws, i, i + 2)) AS n FROM p),
c AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY k),
l AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM w),
d AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(d.n, 0)::BIGINT AS n_dup_lines,
             coalesce(d.n_lines, 0) AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN d USING (k) LEFT JOIN c USING (k)),
b AS (SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (5 * n_symbols > n_words)::INT
                 + 8 * (word_chars < 2 * n_words)::INT + 16 * (word_chars > 20 * n_words)::INT
                 + 32 * (n_dup_lines >= 5 AND 2 * n_dup_lines > n_lines)::INT)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits FROM b""",
    "op2_wu_manber": rf"""
WITH w AS (SELECT row_number() OVER () AS k, doc_id, {_ALNUM_WORDS} AS ws FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_ALNUM_WORDS} AS ws FROM benchmark),
g AS (SELECT item, least(13, len(ws)) AS n, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS pos FROM i WHERE len(ws) > 0),
pat AS (SELECT DISTINCT item, n, array_to_string(list_slice(ws, pos, pos + n - 1), ' ') AS words FROM g),
size AS (SELECT DISTINCT n FROM pat),
d AS (SELECT k, s.n, unnest(range(1, len(ws) - s.n + 2)) AS pos, ws FROM w JOIN size s ON len(ws) >= s.n),
hit AS (SELECT d.k, d.n, d.pos, pat.item FROM d JOIN pat ON pat.n = d.n AND pat.words = array_to_string(list_slice(d.ws, d.pos, d.pos + d.n - 1), ' ')),
spot AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(pos, pos + n)) AS p FROM hit) GROUP BY k),
item AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM hit) GROUP BY k)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN spot USING (k) LEFT JOIN item USING (k)""",
}
