"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and benchmark items are lower-cased (A-Z) and cut into words of ASCII letters,
digits and all that is not ASCII; both are then one string of words with a blank
before, between and after, so an occurrence of a pattern is an occurrence of its
words. Patterns are all runs of ``window`` words of an item, or the whole item if it
is shorter. They are grouped into length classes, so one short item does not
shorten the shifts of all. Each class has a shift table over hashed blocks of up to
8 bytes, built from the first m bytes of its patterns (m the shortest); positions
that no pattern can end at are skipped, a zero shift leads to the bucket of patterns
with that block at their m-th byte, and a direct comparison confirms.

Many places of the text advance through the shift table at once, each in its own
stretch. Items are read in groups of at most ``GROUP_BYTES``; each group is broadcast
and costs one pass in the same stage, so what is broadcast never grows. Nothing is
shuffled, and copies or very common words cannot make a hot task.

Cases: null texts have no words and no hits; null or wordless items have no
patterns; an item whose id is null counts under the empty id; repeated items count
once; repeated rows give repeated results; empty tables give no hits or no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from paneltide.llm.common import wrap

WINDOW = 13
GROUP_BYTES = 2 << 20
CHUNK_BYTES = 4 << 20  # text scanned at once in a task
STRETCH = 4096
LENGTH_CLASSES = (16, 32, 64)  # patterns below each, and the rest
SHIFT_BITS = 18
_MIX = np.uint64(0x9E3779B97F4A7C15)

_KEPT = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c in _KEPT else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


def joined(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" "


class Matcher:
    """Shift tables and buckets for the patterns of some items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.items: dict[bytes, set[str]] = defaultdict(set)
        for item_id, data in items:
            words = words_of(data)
            for i in range(max(1, len(words) - window + 1)) if words else ():
                self.items[joined(words[i : i + window])].add(item_id)
        classes = defaultdict(list)
        for p in self.items:
            classes[sum(len(p) >= c for c in LENGTH_CLASSES)].append(p)
        self.tables = [self._table(patterns) for patterns in classes.values()]

    @staticmethod
    def _table(patterns: list[bytes]) -> dict:
        m = min(map(len, patterns))
        block = min(8, m)
        prefixes = np.array(sorted({np.frombuffer(p[:m], np.uint8).tobytes() for p in patterns}))
        heads = np.frombuffer(b"".join(p.ljust(m, b"\0") for p in prefixes.tolist()), np.uint8).reshape(-1, m)
        shift = np.full(1 << SHIFT_BITS, m - block + 1, np.int32)
        for end in range(block, m + 1):  # later blocks leave smaller shifts
            value = np.zeros(len(heads), np.uint64)
            for k in range(block):
                value |= heads[:, end - block + k].astype(np.uint64) << np.uint64(8 * k)
            shift[Matcher._slot(value)] = m - end
        by_prefix = defaultdict(list)
        for p in patterns:
            by_prefix[p[:m]].append(p)
        keep = np.uint64((1 << (8 * block)) - 1)
        return {"m": m, "block": block, "shift": shift, "suffixes": np.unique(value), "buckets": dict(by_prefix), "keep": keep}

    @staticmethod
    def _slot(value: np.ndarray) -> np.ndarray:
        return (value * _MIX) >> np.uint64(64 - SHIFT_BITS)

    def find(self, text: bytes) -> list[tuple[int, bytes]]:
        """(start, pattern) of every occurrence in ``text``."""
        out = []
        longest = max((t["m"] for t in self.tables), default=0)
        padded = text + bytes(longest + 8)
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        for t in self.tables:
            m, ahead = t["m"], t["m"] - t["block"]
            last = len(text) - m + 1
            at = np.arange(0, max(0, last), STRETCH)
            end = np.minimum(at + STRETCH, last)
            found = []
            while len(at):
                value = eight[at + ahead] & t["keep"]
                step = t["shift"][self._slot(value)]
                stop = step == 0
                if stop.any():
                    hit = stop & np.isin(value, t["suffixes"])
                    found.append(at[hit])
                    step = step + stop
                at = at + step
                going = at < end
                if not going.all():
                    at, end = at[going], end[going]
            for start in np.concatenate(found).tolist() if found else ():
                for p in t["buckets"].get(text[start : start + m], ()):
                    if text.startswith(p, start):
                        out.append((start, p))
        return out


def _scan_chunk(matcher: Matcher, words: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
    """Per text: hit word spans (start, end) as found, and the items found."""
    texts = [joined(w) for w in words]
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    out: list[tuple[list, set]] = [([], set()) for _ in words]
    blanks: dict[int, np.ndarray] = {}
    for start, pattern in matcher.find(b"\0".join(texts)):
        k = int(np.searchsorted(starts, start, "right")) - 1
        if k not in blanks:
            blanks[k] = np.flatnonzero(np.frombuffer(texts[k], np.uint8) == 32)
        first = int(np.searchsorted(blanks[k], start - starts[k]))
        out[k][0].append((first, first + pattern.count(b" ") - 1))
        out[k][1].update(matcher.items[pattern])
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RESULT = [
    StructField("n_words", LongType()),
    StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))),
    StructField("items", ArrayType(StringType())),
]


def _pass(group, keep_text: bool):
    """A pass over the texts with the items of one broadcast group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(group.value)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            lengths = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1])
            chunk = (np.cumsum(lengths) // CHUNK_BYTES).tolist() if len(texts) else []
            n_words, spans, items = [], [], []
            at = 0
            while at < len(texts):
                to = at + 1
                while to < len(texts) and chunk[to] == chunk[at]:
                    to += 1
                words = [words_of(x.as_py() or b"") for x in texts[at:to]]
                n_words += map(len, words)
                for k, (found, names) in enumerate(_scan_chunk(matcher, words), at):
                    if found or not batch.column("spans")[k].is_valid:
                        before = [(s["start"], s["end"]) for s in batch.column("spans")[k].as_py() or ()]
                        named = names | set(batch.column("items")[k].as_py() or ())
                        spans.append([{"start": a, "end": b} for a, b in merged(before + found)])
                        items.append(sorted(named))
                    else:
                        spans.append(batch.column("spans")[k].as_py())
                        items.append(batch.column("items")[k].as_py())
                at = to
            columns = {"row": batch.column("row")}
            if keep_text:
                columns["text"] = batch.column("text")
            yield pa.RecordBatch.from_pydict(
                columns
                | {
                    "n_words": pa.array(n_words, pa.int64()),
                    "spans": pa.array(spans, _SPANS),
                    "items": pa.array(items, pa.list_(pa.string())),
                }
            )

    return run


def item_groups(items: DataFrame, limit: int = GROUP_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """(item_id, text) pairs in groups of about ``limit`` bytes, read one partition at a time."""
    rows = items.where("text IS NOT NULL").select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")
    )
    group, held = [], 0
    for row in rows.toLocalIterator():
        data = row["text"].encode()
        if group and held + len(data) > limit:
            yield group
            group, held = [], 0
        group.append((row["item_id"], data))
        held += len(data)
    yield group


def scan(docs: DataFrame, items: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(row, n_words, spans, items) per input row.

    ``spans`` are the merged [start, end) word ranges inside occurrences, ``items`` the
    sorted ids of the items that occur. ``row`` holds the input columns in ``carry``.
    """
    sc = docs.sparkSession.sparkContext
    held = wrap(docs, carry).select(
        "row",
        "text",
        F.lit(0).cast("long").alias("n_words"),
        F.lit(None).cast(_RESULT[1].dataType).alias("spans"),
        F.lit(None).cast(_RESULT[2].dataType).alias("items"),
    )
    groups = [sc.broadcast(g) for g in item_groups(items)]
    row, text = held.schema["row"], held.schema["text"]
    for k, group in enumerate(groups):
        more = k + 1 < len(groups)
        held = held.mapInArrow(_pass(group, more), StructType([row, *([text] if more else []), *_RESULT]))
    return held


def n_hit():
    """Number of hit words of a scanned row."""
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return F.coalesce(total, F.lit(0).cast("long"))


def contaminated():
    """True where at least one word in twenty is hit."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The input rows that are not contaminated, unchanged."""
    return scan(docs, items).where(~contaminated()).select("row.*")
