"""Token ids in ORC files: encode, write, read back.

Documents are range-partitioned by id, so file k holds smaller ids than file k + 1
and rows ascend within a file. ORC stores the ids as integer run-length encoded
lists; every file has stripes of a set size (the unit of parallel reads), row indexes
(minimum and maximum per ``STRIDE`` rows) and Bloom filters on the document id, so a
lookup by id skips files, stripes and row groups from metadata alone.

A row stores its part and the number of ids before it in its part. The number of ids
before a part is a running sum over one row per part, so no task sees more than its
own part and the order needs no window over all documents.

Encoding: the vocabulary's pre-tokenizer never joins across blanks and drops them, so
a text's ids are those of its blank-separated pieces in order; each worker keeps the
pieces it has met lately, up to twice ``CACHE`` of them, and looks them up by hash.

Cases: a null text is empty and has the end id only; rows are ordered by id, nulls
first, then text, so repeated ids have defined places; an empty table writes no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from paneltide.session import cut, shared_folder

END_ID = 1
CACHE = 250_000
NEW_PIECES = 8192
STRIPE_BYTES = 16 << 20
STRIDE = 1000
SIZE_CHECK = 100  # rows after which a stripe's size is looked at
BATCH_CHARS = 1 << 20

FILE_SCHEMA = "doc_id BIGINT, part INT, before BIGINT, n_tokens BIGINT, ids ARRAY<INT>"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("part", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))]
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Pieces of these signs only (no apostrophe) fall apart into runs of letters, single digits and runs of signs
_LETTERS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF"
_PLAIN = re.compile(f"[!-&(-~{_LETTERS}]+")
_WORD = re.compile(f"[{_LETTERS}]+")
_RUNS = re.compile(f"[{_LETTERS}]+|[0-9]|[^0-9{_LETTERS}]+")
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def pieces_of(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs without blanks in some texts, byte strings one after the other; ``edges`` has their borders."""
    inside = ~_BLANK[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(edges))
    first[edges[full]] = inside[edges[full]]
    last[edges[full + 1] - 1] = inside[edges[full + 1] - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class _Powers:
    """Powers of a base and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self, base: int):
        self.base, self.back = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 2 * n
            for name, base in (("up", self.base), ("down", self.back)):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


class Encoder:
    """Ids of texts, piece by piece, remembering pieces.

    Pieces are cut, hashed (two 64-bit hashes of their bytes) and looked up for a whole batch by
    vector operations; their ids are gathered from one array. New runs of plain pieces are
    encoded together, as one text; the vocabulary marks the ids that end a word, which is
    where their ids are cut apart.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        ends = [i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.is_end[ends] = True
        self.powers = [_Powers(b) for b in _BASES]
        # known pieces in the order of their first hash: second hash, place in ``ids``, number of ids, batch they were last met in
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.places, self.counts, self.met = (np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, "<u4")
        self.batch = 0
        self.words: dict[str, bytes] = {}  # ids of the parts of plain pieces met lately, up to ``CACHE`` and those of one call

    def _each(self, pieces: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return {p: np.array(e.ids, "<u4").tobytes() for p, e in zip(pieces, found)}

    def _words(self, words: list[str]) -> dict[str, bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.is_end[ids]) + 1).tolist()
        if len(ends) != len(words):
            return self._each(words)
        data = ids.tobytes()
        return {w: data[4 * a : 4 * b] for w, a, b in zip(words, [0, *ends], ends)}

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        words, runs, odd = {}, {}, []
        for p in new:
            core = p.rstrip(".,;:!?")
            if core.isascii() and core.isalpha() or _WORD.fullmatch(core):
                words[p] = core.lower(), p[len(core) :]
            elif _PLAIN.fullmatch(p) and "<|" not in p:
                runs[p] = _RUNS.findall(p.lower())
            else:
                odd.append(p)
        every = {w for w, _ in words.values()} | {q for _, q in words.values() if q} | {r for x in runs.values() for r in x}
        if len(self.words) > CACHE:
            self.words = {}
        known = self.words
        unmet = [w for w in every if w not in known]
        if unmet:
            known.update(self._words(unmet))
        known[""] = b""
        out = {p: known[w] + known[q] for p, (w, q) in words.items()}
        out.update({p: b"".join([known[r] for r in x]) for p, x in runs.items()})
        return out | (self._each(odd) if odd else {})

    def _hashes(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
        out = []
        for k, powers in enumerate(self.powers):
            up, down = powers.of(len(data) + 1)
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(k + 1)) * up[:-1], out=total[1:])
            h = (total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64)
            out.append((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))
        return out

    def _find(self, keys: np.ndarray, checks: np.ndarray, each: np.ndarray, same: np.ndarray) -> np.ndarray:
        """Place of each piece among the known ones, -1 for new ones; ``each[same]`` is ``keys``, ``each`` ascends."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, each), len(self.keys) - 1)[same]
        return np.where((self.keys[at] == keys) & (self.checks[at] == checks), at, -1)

    def _add(self, keys: np.ndarray, checks: np.ndarray, found: list[bytes]) -> None:
        counts = np.array([len(x) // 4 for x in found], np.int64)
        places = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), "<u4")])
        order = np.argsort(keys)
        where = np.searchsorted(self.keys, keys[order])
        for name, values in (("keys", keys), ("checks", checks), ("places", places), ("counts", counts), ("met", np.full(len(keys), self.batch))):
            setattr(self, name, np.insert(getattr(self, name), where, values[order]))

    def _forget(self) -> None:
        """Keep the ``CACHE`` pieces met last."""
        keep = np.sort(np.argsort(-self.met, kind="stable")[:CACHE])
        for name in ("keys", "checks", "places", "counts", "met"):
            setattr(self, name, getattr(self, name)[keep])
        self.ids = self._gather(np.arange(len(keep)))
        self.places = np.cumsum(self.counts) - self.counts

    def _gather(self, at: np.ndarray) -> np.ndarray:
        counts = self.counts[at]
        shift = self.places[at] - (np.cumsum(counts) - counts)
        return self.ids[np.repeat(shift, counts) + np.arange(counts.sum())]

    def encode_bytes(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of UTF-8 texts, one after the other, and the number of ids of each."""
        self.batch += 1
        if len(self.keys) > 2 * CACHE:
            self._forget()
        start, stop = pieces_of(data, edges)
        keys, checks = self._hashes(data, start, stop)
        each, same = np.unique(keys, return_inverse=True)  # sorted keys are looked up much faster
        at = self._find(keys, checks, each, same)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            _, first = np.unique(keys[missing], return_index=True)
            new, raw = missing[first], data.tobytes()
            pieces = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[new].tolist(), stop[new].tolist())]
            known: dict[str, bytes] = {}
            for k in range(0, len(pieces), NEW_PIECES):
                known.update(self._learn(pieces[k : k + NEW_PIECES]))
            self._add(keys[new], checks[new], [known[p] for p in pieces])
            at = self._find(keys, checks, each, same)
        owner = np.searchsorted(edges, start, "right") - 1
        twins = np.flatnonzero(at < 0)  # pieces whose first hash is also another piece's: encoded on their own
        self.met[at[at >= 0]] = self.batch
        counts = self.counts[at] if len(at) else np.zeros(0, np.int64)
        if not len(twins):
            return self._gather(at), np.bincount(owner, counts, len(edges) - 1).astype(np.int64)
        parts = [self.ids[p : p + c] for p, c in zip(self.places[at], counts)]
        for k in twins:
            piece = data[start[k] : stop[k]].tobytes().decode("utf-8", "replace")
            parts[k] = np.frombuffer(self._each([piece])[piece], "<u4")
        return np.concatenate(parts), np.bincount(owner, [len(x) for x in parts], len(edges) - 1).astype(np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        raw = [t.encode() for t in texts]
        edges = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        ids, sizes = self.encode_bytes(np.frombuffer(b"".join(raw), np.uint8), edges)
        ends = np.cumsum(sizes)
        return [ids[a:b].tobytes() for a, b in zip(ends - sizes, ends)]


@lru_cache(maxsize=2)
def encoder_of(vocabulary: str) -> Encoder:
    """One encoder per worker process, so that tasks that follow each other share its pieces."""
    return Encoder(vocabulary)


def _encode(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_of(vocabulary)
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            column = batch.column("text").cast(pa.large_binary())
            if not len(column):
                continue
            edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
            at = 0
            while at < len(column):
                to = max(at + 1, int(np.searchsorted(edges, edges[at] + BATCH_CHARS, "right")) - 1)
                ids, sizes = encoder.encode_bytes(data[edges[at] : edges[to]], edges[at : to + 1] - edges[at])
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                sizes = sizes + 1
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[at:to],
                        pa.array(np.full(to - at, part, np.int32)),
                        pa.array(before + offsets[:-1]),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32))),
                    ],
                    schema=_ARROW,
                )
                before += int(offsets[-1])
                at = to

    return run


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Encode ``docs`` and write them to ``path`` in ascending order of doc_id."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(_encode(vocabulary or default_vocabulary(), end_id), FILE_SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(STRIDE))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.rows.between.memory.checks", str(SIZE_CHECK))
        .option("compression", "zstd")
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files; filters on doc_id reach the scan."""
    files = spark.read.schema(FILE_SCHEMA).orc(path)
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per part, stored so that the planner sees how small it is
    bases = (
        files.groupBy("part")
        .agg(F.sum("n_tokens").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    )
    return files.join(cut(bases), "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids"
    )


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        values = ids.values.to_numpy().view("<u4")
        offsets = ids.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def digest(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what ``read`` returns."""
    return tokens.mapInArrow(_checksums, "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write ``docs`` to the shared folder and return their digest from the files."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/tokens/{uuid4().hex}"
    write(docs, path, vocabulary)
    return digest(read(spark, path))
