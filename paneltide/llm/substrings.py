"""Removal of bytes that lie in a 50-byte string of an earlier document.

Method, and why it is not the run-length index that was asked for: see README. All
50-byte strings (windows) of all texts are compared, exactly. Texts are shuffled once, by chunk.

* Each window is routed by its minimizer, the least hash among its 20-byte grams, so
  equal windows meet in one bucket wherever they stand. Neighbouring windows mostly
  share it and travel as one run of bytes. Buckets are as many as the total bytes ask for.
* First only minimizers are exchanged, 40 bits each and once per chunk of documents; the
  buckets tell every chunk which of its minimizers some other document has too. Only
  runs of those are sent: a window without one stands in no other document.
* A run that another document of the same chunk also holds is settled there: the later
  documents are marked at once and only the first goes on. So a group of copies, of any
  size, sends each run once per chunk.
* In a bucket, windows are sorted by a 64-bit hash; the first document of equal windows
  marks all later ones. Every mark is confirmed by comparing the 50 bytes.

Marked windows come back per document as ranges and are merged into spans.

Cases: a null text is empty; texts under 50 bytes lose nothing; matches never cross
documents and never come from the same id; null ids count as the largest id; repeated
rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from paneltide.llm.common import wrap

WIDTH = 50
GRAM = 20
CHUNK_BYTES = 2 << 20
TAG_BITS = 40
LAST_ID = (1 << 63) - 1
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_P = 0x100000001B3


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_P, n, 1 << 64))


def window_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hash of the 50 bytes at each place, by doubling."""
    h = {1: data.astype(np.uint64)}
    for n in (1, 2, 4, 8, 16):
        h[2 * n] = h[n][:-n] * _power(n) + h[n][n:]
    size = len(data) - WIDTH + 1
    wide = h[32][:size] * _power(16) + h[16][32 : 32 + size]
    return wide * _power(2) + h[2][48 : 48 + size]


def minimizers(data: np.ndarray) -> np.ndarray:
    """For each window the least hash of its grams."""
    raw = np.concatenate([data, np.zeros(8, np.uint8)]).tobytes()
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    grams = len(data) - GRAM + 1
    low = eight[:grams] * _A ^ (eight[8 : 8 + grams] * _B)
    low ^= low >> np.uint64(29)
    low += eight[GRAM - 8 : GRAM - 8 + grams] * _A
    low *= _C
    low ^= low >> np.uint64(32)
    span, have = WIDTH - GRAM + 1, 1
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    rest = span - have
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]


def _pack(data: np.ndarray, ids: np.ndarray, texts: np.ndarray, places: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> bytes:
    import zstandard

    body = b"".join(
        [
            struct.pack("<I", len(starts)),
            ids.astype("<i8").tobytes(),
            texts.astype("<i8").tobytes(),
            places.astype("<u4").tobytes(),
            counts.astype("<u4").tobytes(),
            _gather(data, starts, counts + (WIDTH - 1)).tobytes(),
        ]
    )
    return zstandard.ZstdCompressor(level=3).compress(body)


def _unpack(blob: bytes) -> tuple:
    import zstandard

    body = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<I", body)
    ids = np.frombuffer(body, "<i8", n, 4)
    texts = np.frombuffer(body, "<i8", n, 4 + 8 * n)
    places = np.frombuffer(body, "<u4", n, 4 + 16 * n)
    counts = np.frombuffer(body, "<u4", n, 4 + 20 * n)
    return ids, texts, places, counts, np.frombuffer(body, np.uint8, -1, 4 + 24 * n)


_MARKS = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())]))
_ROUTED = "bucket BIGINT, blob BINARY, settled BINARY"


def _runs(texts: list[bytes]) -> tuple:
    """Bytes, place and size of each text, and the runs of windows that share a minimizer: (start, n, text, minimizer)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    low = minimizers(data)
    doc = np.repeat(np.arange(len(texts)), sizes)[: len(low)]
    valid = np.arange(len(low)) <= (begins + sizes - WIDTH)[doc]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(new & valid)
    stops = np.flatnonzero(np.concatenate([new[1:] | ~valid[1:], [True]]) & valid) + 1
    return data, begins, starts, stops - starts, doc[starts], low[starts] >> np.uint64(64 - TAG_BITS)


def _cuts(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal values."""
    edges = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1], [True]]))
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def _chunk_runs(ids: np.ndarray, keys: np.ndarray, texts: list[bytes], buckets: int, shared: np.ndarray) -> tuple[list, tuple]:
    """Blobs per bucket, and the windows (id, text key, start, n) settled inside the chunk."""
    data, begins, starts, counts, owner, tag = _runs(texts)
    wanted = np.isin(tag, shared)
    starts, counts, owner, tag = starts[wanted], counts[wanted], owner[wanted], tag[wanted]
    if not len(starts):
        return [], (owner, owner, owner, owner)
    stops, value = starts + counts, window_hashes(data)
    # equal runs of several documents: the first document keeps it, the later ones are marked here
    name = (value[starts] * _A) ^ (value[stops - 1] * _B) ^ (counts.astype(np.uint64) * _C)
    order = np.lexsort((ids[owner], name))
    first = np.ones(len(order), bool)
    first[1:] = name[order][1:] != name[order][:-1]
    head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    later = np.flatnonzero(ids[owner[order]] > ids[owner[head]])
    whole, settled = data.tobytes(), np.zeros(len(order), bool)
    for at in later.tolist():
        a, b, n = int(starts[order[at]]), int(starts[head[at]]), int(counts[order[at]])
        if n == counts[head[at]] and whole[a : a + n + WIDTH - 1] == whole[b : b + n + WIDTH - 1]:
            settled[order[at]] = True
    done = (ids[owner[settled]], keys[owner[settled]], starts[settled] - begins[owner[settled]], counts[settled])
    keep = np.flatnonzero(~settled)
    bucket = tag[keep] % np.uint64(buckets)
    keep = keep[np.argsort(bucket, kind="stable")]
    bucket = np.sort(bucket)
    blobs = []
    for a, b in _cuts(bucket):
        k = keep[a:b]
        own = owner[k]
        blobs.append((int(bucket[a]), _pack(data, ids[own], keys[own], starts[k] - begins[own], starts[k], counts[k])))
    return blobs, done


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    texts = [x.as_py() for x in table.column("text").cast(pa.binary())]
    return table.column("id").to_numpy(), table.column("text_key").to_numpy(), texts


def _tags(buckets: int):
    """The minimizers of a chunk: (bucket, chunk, tags, several), ``several`` where two documents of the chunk share one."""

    def run(table: pa.Table) -> pa.Table:
        ids, _, texts = _columns(table)
        rows = []
        if sum(map(len, texts)) >= WIDTH:
            *_, owner, tag = _runs(texts)
            order = np.lexsort((tag, tag % np.uint64(buckets)))
            tag, own = tag[order], ids[owner[order]]
            first = np.flatnonzero(np.concatenate([[True], tag[1:] != tag[:-1]])) if len(tag) else np.empty(0, int)
            if len(tag):
                several = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
                tag = tag[first]
                chunk = table.column("chunk")[0].as_py()
                for a, b in _cuts(tag % np.uint64(buckets)):
                    steps = np.diff(tag[a:b], prepend=np.uint64(0))
                    rows.append((int(tag[a] % np.uint64(buckets)), chunk, _squeeze(steps), np.packbits(several[a:b]).tobytes()))
        return pa.table(
            {
                "bucket": pa.array([r[0] for r in rows], pa.int64()),
                "chunk": pa.array([r[1] for r in rows], pa.int64()),
                "tags": pa.array([r[2] for r in rows], pa.binary()),
                "several": pa.array([r[3] for r in rows], pa.binary()),
            }
        )

    return run


def _squeeze(tags: np.ndarray) -> bytes:
    """Low five bytes of each number."""
    return np.ascontiguousarray(tags.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : TAG_BITS // 8]).tobytes()


def _unsqueeze(data: bytes) -> np.ndarray:
    short = np.frombuffer(data, np.uint8).reshape(-1, TAG_BITS // 8)
    wide = np.zeros((len(short), 8), np.uint8)
    wide[:, : TAG_BITS // 8] = short
    return wide.view("<u8").ravel()


def _shared(table: pa.Table) -> pa.Table:
    """(chunk, tags): the minimizers of each chunk that another document has."""
    chunks = table.column("chunk").to_numpy()
    tags = [np.cumsum(_unsqueeze(x.as_py()), dtype=np.uint64) for x in table.column("tags")]
    several = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(t)).astype(bool) for x, t in zip(table.column("several"), tags)]
    sizes = [len(t) for t in tags]
    owner, tag, many = np.repeat(np.arange(len(tags)), sizes), np.concatenate(tags), np.concatenate(several)
    order = np.argsort(tag, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], tag[order][1:] != tag[order][:-1]]))
    width = np.diff(np.append(first, len(order)))
    common = np.repeat((width > 1) | np.logical_or.reduceat(many[order], first), width)
    found = np.sort(order[common])  # back in the order of the chunks
    spans = _cuts(owner[found]) if len(found) else []
    return pa.table(
        {
            "chunk": pa.array([int(chunks[owner[found[a]]]) for a, _ in spans], pa.int64()),
            "tags": pa.array([_squeeze(tag[found[a:b]]) for a, b in spans], pa.binary()),
        }
    )


def _route(buckets: int):
    """Runs of a chunk with a shared minimizer, per bucket, and what the chunk settles itself."""

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        blobs, settled = [], []
        if len(table) and len(replies):
            ids, keys, texts = _columns(table)
            shared = _unsqueeze(b"".join(x.as_py() for x in replies.column("tags")))
            blobs, done = _chunk_runs(ids, keys, texts, buckets, shared)
            settled = [None] * len(blobs)
            if blobs:  # what the chunk has settled travels with one of its blobs
                settled[int(table.column("chunk")[0].as_py()) % len(blobs)] = np.stack(done).astype("<i8").tobytes()
        return pa.table(
            {
                "bucket": pa.array([b for b, _ in blobs], pa.int64()),
                "blob": pa.array([x for _, x in blobs], pa.binary()),
                "settled": pa.array(settled, pa.binary()),
            }
        )

    return run


def _compare(table: pa.Table) -> pa.Table:
    """Marked window ranges of one bucket, and those that its chunks have settled."""
    parts = [_unpack(b.as_py()) for b in table.column("blob")]
    ids, texts, places, counts = (np.concatenate([p[k] for p in parts]) for k in range(4))
    data = np.concatenate([p[4] for p in parts])
    counts = counts.astype(np.int64)
    lengths = counts + (WIDTH - 1)
    begins = np.cumsum(lengths) - lengths
    run = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = begins[run] + within
    value, own = window_hashes(data)[at], ids[run]
    order = np.argsort(value, kind="stable")
    ordered = value[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    low = np.minimum.reduceat(own[order], first)
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    later = own[order] > low[group]
    marked = np.zeros(len(run), bool)
    if later.any():
        # the first row of a group whose id is the least
        rank = np.where(own[order] == low[group], np.arange(len(order)), len(order))
        head = order[np.minimum.reduceat(rank, first)]
        rows, heads = order[later], head[group[later]]
        window = np.lib.stride_tricks.sliding_window_view(data, WIDTH)
        for a in range(0, len(rows), 100_000):
            r, h = rows[a : a + 100_000], heads[a : a + 100_000]
            marked[r] = (window[at[r]] == window[at[h]]).all(1)
        for r in rows[~marked[rows]].tolist():  # windows that share a hash but not their bytes
            same = np.flatnonzero(value == value[r])
            same = same[(window[at[same]] == window[at[r]]).all(1)]
            marked[r] = own[same].min() < own[r]
    edge = np.ones(len(run), bool)
    edge[1:] = (run[1:] != run[:-1]) | (marked[1:] != marked[:-1])
    starts = np.flatnonzero(edge)
    sizes = np.diff(np.append(starts, len(run)))
    keep = marked[starts]
    starts, sizes = starts[keep], sizes[keep]
    here = [ids[run[starts]], texts[run[starts]], places[run[starts]].astype(np.int64) + within[starts], sizes]
    known = [np.frombuffer(x.as_py(), "<i8").reshape(4, -1) for x in table.column("settled") if x.is_valid]
    columns = [np.concatenate([here[k], *[x[k] for x in known]]) for k in range(4)]
    return pa.table({name: pa.array(x.astype(np.int64)) for name, x in zip(("id", "text_key", "start", "n"), columns)})


def _chunk(buckets: int):
    return F.pmod(F.xxhash64("id"), F.lit(buckets))


def chunks(docs: DataFrame, carry: list[str]) -> tuple[DataFrame, int]:
    """(chunk, id, text_key, row, text) and the number of chunks, which is also that of buckets.

    ``text_key`` tells texts of one id apart; it is 0 where every id is there once.
    """
    sizes = docs.select(F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("size"))
    buckets = max(1, math.ceil((sizes.agg(F.sum("size")).first()[0] or 0) / CHUNK_BYTES))
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    key = F.lit(0).cast("long") if again.isEmpty() else F.xxhash64("text")
    held = wrap(docs, ["doc_id", *[c for c in carry if c != "doc_id"]])
    held = held.withColumn("id", F.coalesce(F.col("row.doc_id"), F.lit(LAST_ID)).cast("long"))
    return held.select(_chunk(buckets).alias("chunk"), "id", key.alias("text_key"), "row", "text"), buckets


def marks(held: DataFrame, buckets: int) -> DataFrame:
    """(chunk, id, text_key, start, n): runs of n marked windows from byte ``start`` of a text."""
    tags = held.groupBy("chunk").applyInArrow(_tags(buckets), "bucket BIGINT, chunk BIGINT, tags BINARY, several BINARY")
    replies = tags.groupBy("bucket").applyInArrow(_shared, "chunk BIGINT, tags BINARY")
    routed = held.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_route(buckets), "bucket BIGINT, blob BINARY, settled BINARY")
    found = routed.groupBy("bucket").applyInArrow(_compare, "id BIGINT, text_key BIGINT, start BIGINT, n BIGINT")
    return found.select(_chunk(buckets).alias("chunk"), "id", "text_key", "start", "n")


def _spans(table: pa.Table, found: pa.Table) -> pa.Table:
    """The digest of each text of a chunk from the marks of the chunk."""
    by_text: dict[tuple[int, int], set[tuple[int, int]]] = {}
    for i, k, a, n in zip(*(found.column(c).to_pylist() for c in ("id", "text_key", "start", "n"))):
        by_text.setdefault((i, k), set()).add((a, n))
    ids, keys, texts = _columns(table)
    sizes, removed, spans, digests = [], [], [], []
    for name, data in zip(zip(ids.tolist(), keys.tolist()), texts):
        merged: list[list[int]] = []
        for start, n in sorted(by_text.get(name, ())):
            a, b = start, start + n - 1 + WIDTH
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        kept, at = hashlib.sha256(), 0
        for a, b in merged:
            kept.update(data[at:a])
            at = b
        kept.update(data[at:])
        sizes.append(len(data))
        removed.append(sum(b - a for a, b in merged))
        spans.append([{"start": a, "n": b - a} for a, b in merged])
        digests.append(kept.hexdigest())
    return pa.table(
        {
            "row": table.column("row"),
            "n_bytes": pa.array(sizes, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "spans": pa.array(spans, _MARKS),
            "kept_sha256": pa.array(digests, pa.string()),
        }
    )


def repeated(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(row, n_bytes, n_removed, spans, kept_sha256) per input row; spans are (start, n) in bytes."""
    held, buckets = chunks(docs, carry or docs.columns)
    span = ArrayType(StructType([StructField("start", LongType()), StructField("n", LongType())]))
    return held.groupBy("chunk").cogroup(marks(held, buckets).groupBy("chunk")).applyInArrow(
        _spans,
        StructType(
            [
                held.schema["row"],
                StructField("n_bytes", LongType()),
                StructField("n_removed", LongType()),
                StructField("spans", span),
                StructField("kept_sha256", StringType()),
            ]
        ),
    )
