"""SimHash near-duplicates with pivot distance tables.

Fingerprint: 64-bit XXH64 of each shingle of four blank-separated words, repeats
included; a bit is set if it is set in over half of them. Documents whose
fingerprints differ in at most ``MAX_BITS`` bits are linked; classes are the
components of the links. Equal fingerprints are one node, so copies cost nothing.

Two tables of distances to reference fingerprints are computed per node.
* Block references are runs of ones within one of six blocks of bits. The distances
  to all references of a block are the block's key. Four differing bits leave two of
  six blocks untouched, with equal distances to all their references, so each link
  shares the keys of at least one of 15 block pairs: those are the join keys.
* Wide references are 16 fixed random words. By the triangle inequality two linked
  nodes differ by at most ``MAX_BITS`` in each of these coordinates; a candidate pair
  with a larger difference is discarded. Survivors are compared bit by bit.
A link is emitted only for the first block pair it shares.

A block-pair bucket of over ``BUCKET`` nodes is not paired up. Its nodes emit all words
within half of ``MAX_BITS`` bits instead; two nodes are linked exactly if they share
such a word (the word half way), and nodes that share one are tied to the smallest.
So work per node is bounded whatever the size of a group, and no link is lost.

Cases: null and empty texts have fingerprint zero and are linked like any other; a
null doc_id is ignored as a component id unless the component has no other; repeated
rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from paneltide.llm.common import wrap
from paneltide.llm.components import components
from paneltide.session import cut

SHINGLE = 4
SEED = 42
MAX_BITS = 4
BUCKET = 1024
EDGES = (0, 11, 22, 33, 43, 54, 64)
N_WIDE = 16


def _signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


BLOCKS = [(((1 << (b - a)) - 1) << a) for a, b in zip(EDGES, EDGES[1:])]
BLOCK_REFERENCES = [[((1 << k) - 1) << a for k in range(b - a + 1)] for a, b in zip(EDGES, EDGES[1:])]
_RANDOM = random.Random(20)
WIDE_REFERENCES = [_RANDOM.getrandbits(64) for _ in range(N_WIDE)]


def fingerprint(data: bytes) -> int:
    import xxhash

    words = data.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(max(1, len(words) - SHINGLE + 1))], "<u8"
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        values = np.array([fingerprint(x.as_py()) for x in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(values)], names=["row", "fp"])


def fingerprints(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(row, fp) per input row; fp is the fingerprint as a signed long."""
    held = wrap(docs, carry)
    return held.mapInArrow(_fingerprints, StructType([held.schema["row"], StructField("fp", LongType())]))


def _distances(fp: Column, references: list[int], within: int, width: int) -> Column:
    """Distances to the references inside a mask, packed ``width`` bits each into a long."""
    out = F.lit(0).cast("long")
    for k, r in enumerate(references):
        d = F.bit_count(fp.bitwiseXOR(F.lit(_signed(r))).bitwiseAND(F.lit(_signed(within)))).cast("long")
        out = out.bitwiseOR(F.shiftleft(d, k * width))
    return out


def pivot_table(nodes: DataFrame) -> DataFrame:
    """(fp, near0, near1, block0..block5): the distance tables of each distinct fingerprint."""
    fp = F.col("fp")
    whole = (1 << 64) - 1
    half = N_WIDE // 2
    return nodes.select(
        "fp",
        _distances(fp, WIDE_REFERENCES[:half], whole, 8).alias("near0"),
        _distances(fp, WIDE_REFERENCES[half:], whole, 8).alias("near1"),
        *[_distances(fp, BLOCK_REFERENCES[b], BLOCKS[b], 4).alias(f"block{b}") for b in range(len(BLOCKS))],
    )


def _keyed(table: DataFrame) -> DataFrame:
    """One row per node and block pair: (i, j, key_i, key_j, fp, near0, near1)."""
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"block{i}").alias("ki"), F.col(f"block{j}").alias("kj"))
            for i, j in combinations(range(len(BLOCKS)), 2)
        ]
    )
    return table.select(F.explode(pairs).alias("p"), "fp", "near0", "near1").select("p.*", "fp", "near0", "near1")


_KEY = ["i", "j", "ki", "kj"]


def _within(a: str, b: str, limit: int) -> Column:
    """True where no coordinate of the packed wide tables differs by more than ``limit``."""
    out = F.lit(True)
    for name in ("near0", "near1"):
        for k in range(N_WIDE // 2):
            x, y = [F.shiftright(F.col(f"{s}.{name}"), 8 * k).bitwiseAND(F.lit(255)) for s in (a, b)]
            out = out & (F.abs(x - y) <= limit)
    return out


def _first_shared() -> Column:
    """True where (i, j) is the first pair of blocks in which the words of a pair agree."""
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    out = F.lit(True)
    for b, block in enumerate(BLOCKS):
        same = x.bitwiseAND(F.lit(_signed(block))) == 0
        out = out & (~same | (F.col("a.i") == b) | (F.col("a.j") <= b))
    return out


def _paired(keyed: DataFrame, max_bits: int) -> DataFrame:
    """Links (u, v) found by pairing up the nodes of each bucket."""
    a, b = keyed.alias("a"), keyed.alias("b")
    same = F.lit(True)
    for k in _KEY:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    linked = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits
    ahead = F.col("a.fp") < F.col("b.fp")
    return a.join(b, same & ahead & _within("a", "b", max_bits) & linked & _first_shared()).select(
        F.col("a.fp").alias("u"), F.col("b.fp").alias("v")
    )


def ball(radius: int) -> list[int]:
    """All words with at most ``radius`` bits set."""
    return [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]


def _half_way(nodes: DataFrame, max_bits: int) -> DataFrame:
    """Ties (u, v) among ``nodes`` through the words half way between linked ones."""
    words = [_signed(w) for w in ball(max_bits // 2)]
    spark = nodes.sparkSession
    flips = F.array(*[F.lit(w).cast("long") for w in words]) if len(words) < 3000 else None
    if flips is None:
        raise ValueError("max_bits above 5 needs too many words per node")
    spread = nodes.repartition(spark.sparkContext.defaultParallelism * 4, "fp").select(
        "fp", F.explode(flips).alias("flip")
    ).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    least = spread.groupBy("word").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return spread.join(least, "word").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def links(nodes: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links that connect exactly the nodes (distinct fp) within ``max_bits`` of each other."""
    if not 0 <= max_bits <= 4 or max_bits % 2:
        raise ValueError("six blocks find up to four differing bits, and half way words need an even number")
    table = cut(pivot_table(nodes))
    keyed = _keyed(table)
    crowded = cut(keyed.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket))
    if crowded.isEmpty():
        return _paired(keyed, max_bits)
    hot = keyed.join(crowded, _KEY, "left_semi").select("fp").distinct()
    return _paired(keyed.join(crowded, _KEY, "left_anti"), max_bits).unionByName(_half_way(cut(hot), max_bits))


def classes(prints: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint of ``prints`` (doc_id, fp).

    ``root`` is the smallest fingerprint of the component as a signed number, and
    ``component_id`` its smallest doc_id.
    """
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    tied = components(links(nodes.select("fp"), max_bits, bucket))
    rooted = nodes.join(tied, nodes["fp"] == tied["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least"
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return cut(rooted.join(ids, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, root, component_id) per input row."""
    prints = cut(fingerprints(docs, ["doc_id"]).select("row.doc_id", "fp"))
    return prints.join(classes(prints, max_bits, bucket), "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """The input rows with one document of each class: the one of the smallest id.

    Nulls count as the largest id. Rows find themselves by id and text digest; of
    rows that share both, one stays.
    """
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    named = docs.select("doc_id", "text", digest.alias("digest"))
    prints = cut(fingerprints(named, ["doc_id", "digest"]).select("row.doc_id", "row.digest", "fp"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    kept = prints.join(classes(prints), "fp").groupBy("root").agg(F.min(order).alias("k"))
    same = prints.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    chosen = kept.select(F.col("k.doc_id").alias("id"), F.col("k.digest").alias("digest"))
    chosen = cut(
        chosen.join(same, chosen["id"].eqNullSafe(same["doc_id"]) & (chosen["digest"] == same["digest"])).select(
            "id", chosen["digest"], "n"
        )
    )
    held = wrap(docs).withColumn("own", F.md5("text"))
    match = held["row.doc_id"].eqNullSafe(F.col("id")) & (F.col("own") == F.col("digest"))
    out = held.join(chosen.where("n = 1"), match).select("row")
    repeated = chosen.where("n > 1")
    if not repeated.isEmpty():
        out = out.unionByName(held.join(repeated, match).groupBy("id", "own").agg(F.first("row").alias("row")).select("row"))
    return out.select("row.*")
