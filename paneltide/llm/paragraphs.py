"""Paragraph near-duplicates by MinHash banding, exact Jaccard and components.

Units of a text, in lower-cased (A-Z) words between blanks:
* paragraphs: lines of at least ``MIN_WORDS`` words;
* short lines: all other lines with a word;
* joined lines: two or more short lines in a row, without the empty ones between them, so
  that texts wrapped at another width and lists are compared as a whole;
* passages: the longest runs of words of at least ``WINDOW`` words that stand in a document
  of smaller id too, wherever they lie and however their lines are broken.

Units of equal words are one node (copies cost one row), whatever their length. Distinct
lines and joined lines get MinHash values over their shingles of five words (under five
words the whole unit is the one shingle, so only equal ones match); ``BANDS`` bands of ``ROWS`` values give a pair of
Jaccard 0.8 a chance of 99.5 % to collide. All pairs that share a band are compared by exact
Jaccard of their shingle sets, linked from ``THRESHOLD`` on, and linked pairs form components; a
unit is a removal if its component also has a unit in a document of smaller id.

No row stands for a pair. A band's units travel with their shingle sets, bands of the same units
once, and a task compares them and returns the links of a forest, fewer than units. A band of over
``CELL_UNITS`` units is dealt into cells of that size that share four of its units; then
only units outside its largest component meet the units of the other cells, again cell by cell.
So memory is bounded and rows grow with the units; only if a constant part of such a band stays
unlinked does each unit travel once per cell, and comparisons grow with the square of the band.

Passages are exact. Of each window of ``WINDOW`` words the least hash of its ``GRAM``-word
pieces is its anchor, so equal windows have equal anchors, and neighbours mostly share one:
windows in a row with one anchor are a run, named by all its words. Only runs are stored and
exchanged, no windows. Where all runs of an anchor are equal, each is settled as a whole.
Otherwise the windows of the distinct runs, once each, are compared, and the outcome is
handed to all runs of that name as segments. A window goes to the first place of the
smallest document that holds it. Pieces that follow each other in both documents are one
passage.

Cases: null and empty texts and texts without a word give no rows; null ids count as the
largest id; units repeated within one document only are kept; repeated rows give repeated
results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from paneltide.llm.components import components
from paneltide.session import cut

MIN_WORDS = 10  # of a line to be called a paragraph
KINDS = ("paragraph", "passage", "short", "joined")
RUN = -1  # kind of the rows of parts() that are runs of windows
WINDOW = 51
GRAM = 12
SHINGLE = 5
BANDS, ROWS = 10, 4
THRESHOLD = 0.8
CELL_UNITS, CELL_WORDS = 2048, 1 << 20  # of a band, compared by one task at a time
CHUNK_BYTES = 1 << 20
LAST_ID = (1 << 63) - 1

_RNG = np.random.default_rng(5)
_ODD = _RNG.integers(1 << 62, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64)
_BYTES = _RNG.integers(1 << 63, size=256, dtype=np.uint64)
_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    low = np.full(4096, base, np.uint64)
    low[0] = 1
    low = np.multiply.accumulate(low)
    high = np.full(n // 4096 + 1, pow(base, 4096, 1 << 64), np.uint64)
    high[0] = 1
    return (np.multiply.accumulate(high)[:, None] * low).ravel()[:n]


class Sums:
    """Hashes of any stretches of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, base: int):
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _powers(base, len(values)), out=self.total[1:])
        self.back = _powers(pow(base, -1, 1 << 64), len(values) + 1)

    def names(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.total[end] - self.total[start]) * self.back[start] + (end - start).astype(np.uint64))


class Chunk:
    """Word hashes, units and unit names of some texts, by vector operations."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
        edges = np.flatnonzero(np.diff(_BLANK[raw], prepend=True))
        starts, ends = edges[::2], edges[1::2]
        self.h = Sums(_BYTES[raw], _BASES[2]).names(starts, ends)
        self.sums: dict[int, Sums] = {}
        line = np.searchsorted(np.flatnonzero(raw == 10), starts)
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        self.text_of = np.searchsorted(np.cumsum(lengths), starts, side="right")
        starts = np.flatnonzero(np.diff(line, prepend=-1))  # first word of each line that has one
        ends = np.append(starts[1:], len(line)) if len(starts) else starts
        owner = self.text_of[starts]
        words_in = np.bincount(self.text_of, minlength=len(texts))
        self.base = np.cumsum(words_in) - words_in  # first word of each text
        self.left = np.repeat(np.cumsum(words_in), words_in) - np.arange(len(self.h))  # words from each word to its text's end
        units = [(starts, ends, owner, np.where(ends - starts < MIN_WORDS, 2, 0)), self._joined(starts, ends, owner)]
        self.start, self.end, self.owner, self.kind = (np.concatenate([u[k] for u in units]) for k in range(4))
        self.first_word = self.start - self.base[self.owner]

    def _joined(self, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple:
        short = np.concatenate([[False], ends - starts < MIN_WORDS, [False]])
        same = np.concatenate([[False], owner[1:] == owner[:-1], [False]])[: len(owner) + 1]
        tied = short[:-1] & short[1:] & same  # line k with the one before it
        first = np.flatnonzero(~tied[:-1] & tied[1:])
        last = np.flatnonzero(tied[:-1] & ~tied[1:])
        return starts[first], ends[last], owner[first], np.full(len(first), 3)

    def unit_names(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each unit's words and their number."""
        return self._named(self.start, self.end, 0), self._named(self.start, self.end, 1)

    def _named(self, start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
        if k not in self.sums:
            self.sums[k] = Sums(_mixed(self.h + np.uint64(k + 1)), _BASES[k])
        return self.sums[k].names(start, end).view(np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows within one text, and the anchor of each."""
        n = max(0, len(self.h) - WINDOW + 1)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(len(self.h) - GRAM + 1)
        least, span, have = self._named(at, at + GRAM, 0), WINDOW - GRAM + 1, 1
        while have * 2 <= span:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        rest = span - have
        least = np.minimum(least[: len(least) - rest], least[rest:])
        inside = np.flatnonzero(self.left[:n] >= WINDOW)
        return inside, least[inside]

    def runs(self) -> tuple[np.ndarray, ...]:
        """First window, number of windows, anchor and name of the runs of windows with one anchor."""
        at, key = self.anchors()
        own = self.text_of[at]
        first = np.ones(len(at), bool)
        first[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
        places = np.flatnonzero(first)
        start, windows = at[places], np.diff(np.append(places, len(at)))
        return start, windows, key[places], self._named(start, start + windows + WINDOW - 1, 0)

    def shingles(self) -> np.ndarray:
        """Hash of the five words from each place on."""
        n = max(0, len(self.h) - SHINGLE + 1)
        out = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            out = out * _C + self.h[k : k + n]
        return _mixed(out)

    def bands(self, which: np.ndarray) -> np.ndarray:
        """(units, BANDS) band keys of some units of SHINGLE words or more."""
        sh, units = self.shingles(), len(which)
        edges = np.stack([self.start[which], self.end[which] - SHINGLE + 1], 1).ravel()
        pad = np.append(sh, ~np.uint64(0))
        keys = np.zeros((units, BANDS), np.uint64)
        for m in range(BANDS * ROWS):
            least = np.minimum.reduceat(pad * _ODD[m] + _ADD[m], edges)[::2]
            keys[:, m // ROWS] = _mixed(keys[:, m // ROWS] * _C + least + np.uint64(m))
        return keys.view(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], pa.RecordBatch, Chunk]]:
    for batch in batches:
        column, at = batch.column("text").cast(pa.binary()), 0
        while at < len(column):
            texts, held, begin = [], 0, at
            while at < len(column) and (not texts or held <= CHUNK_BYTES):
                texts.append(column[at].as_py())
                held += len(texts[-1])
                at += 1
            chunk = Chunk(texts)
            if len(chunk.start):
                yield list(range(begin, at)), batch, chunk


PART = (
    "row BIGINT, id BIGINT, mark BIGINT, first_word BIGINT, n_words BIGINT, kind BIGINT, n0 BIGINT, n1 BIGINT, "
    "bands ARRAY<BIGINT>"
)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in PART.split(", ")]
    row = TaskContext.get().partitionId() << 40
    for rows, batch, c in _chunks(batches):
        ids, marks = (batch.column(x).to_numpy()[rows] for x in ("id", "mark"))
        wide = c.end - c.start >= SHINGLE
        n0, n1 = c.unit_names()
        _, one, same = np.unique(n0[wide], return_index=True, return_inverse=True)  # copies in a chunk are hashed once
        order = np.argsort(one)  # in order of place, so that stretches between units are short
        same = np.argsort(order)[same]
        keys = c.bands(np.flatnonzero(wide)[one[order]])[same]
        ends = np.append(0, np.cumsum(wide * BANDS)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
        own = c.owner
        columns = (row + own, ids[own], marks[own], c.first_word, c.end - c.start, c.kind, n0, n1)
        yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in columns), lists], names=names)
        start, windows, key, name = c.runs()
        own = c.text_of[start]
        kind = np.full(len(start), RUN)
        columns = (row + own, ids[own], marks[own], start - c.base[own], windows, kind, key, name)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(x.astype(np.int64)) for x in columns), pa.nulls(len(start), pa.list_(pa.int64()))], names=names
        )
        row += len(rows)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of the windows of the wanted runs."""
    for rows, batch, c in _chunks(batches):
        wanted = batch.column("wanted").slice(rows[0], len(rows))
        own = np.repeat(np.arange(len(rows)), wanted.value_lengths().to_numpy())
        flat = wanted.flatten()
        at, windows, key, name = (flat.field(k).to_numpy() for k in range(4))
        run = np.repeat(np.arange(len(at)), windows)
        step = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
        place = (c.base[own] + at)[run] + step
        ids = batch.column("id").to_numpy()[rows]
        columns = (ids[own][run], at[run] + step, key[run], name[run], step, c._named(place, place + WINDOW, 1))
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=["id", "at", "key", "name", "step", "w"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, batch, c in _chunks(batches):
        wanted = [{(x["n0"], x["n1"]) for x in batch.column("wanted")[r].as_py()} for r in rows]
        n0, n1 = c.unit_names()
        sh = c.shingles().view(np.int64)
        take = [k for k in range(len(n0)) if (int(n0[k]), int(n1[k])) in wanted[c.owner[k]]]
        sets = [np.unique(sh[c.start[k] : c.end[k] - SHINGLE + 1]) for k in take]
        yield pa.RecordBatch.from_arrays([pa.array(n0[take]), pa.array(n1[take]), pa.array(sets, pa.list_(pa.int64()))], names=["n0", "n1", "shingles"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id"), F.lit(LAST_ID)).cast("long").alias("id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("mark", F.xxhash64("text"))


def parts(docs: DataFrame) -> DataFrame:
    """Units and runs, in one pass over the texts.

    Units: kind is the place in KINDS, n0 and n1 name the words,
    ``bands`` are the band keys (a band's number is part of its key; none under five words).
    Runs: kind ``RUN``, n_words the number of windows, n0 the anchor, n1 the name.
    ``row`` is one per input row, ``mark`` a hash of its text, which tells texts of one id apart.
    """
    return _texts(docs).mapInArrow(_parts, PART)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Names, sides, shingles and their borders of each cell; a cell's rows follow each other, also over batches."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pa.concat_batches([rest, batch])
        key, cell = (batch.column(c).to_numpy() for c in ("key", "cell"))
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]) if len(key) else np.zeros(1, np.int64)
        yield from _cut_up(batch, starts)
        rest = batch.slice(int(starts[-1]))
    if rest is not None and rest.num_rows:
        yield from _cut_up(rest, np.array([0, rest.num_rows]))


def _cut_up(batch: pa.RecordBatch, edges: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    names = np.stack([batch.column(c).to_numpy() for c in ("n0", "n1")], 1)
    side, sets = batch.column("side").to_numpy(), batch.column("shingles")
    flat = sets.flatten().to_numpy()
    ends = np.append(0, np.cumsum(sets.value_lengths().to_numpy().astype(np.int64)))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield names[a:b], side[a:b], flat[ends[a] : ends[b]], ends[a : b + 1] - ends[a]


def _forest(side: np.ndarray, flat: np.ndarray, ends: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links that tie together all sets of a cell that similar pairs tie together; if there are two sides, pairs across them."""
    sizes, root, out = np.diff(ends), np.arange(len(side)), []
    ids = np.unique(flat, return_inverse=True)[1]
    mark, crossed = np.zeros(len(ids), np.int32), side.any()
    for k in range(1, len(side)):
        open_to = root[:k] != root[k]
        if crossed:
            open_to &= side[:k] != side[k]
        if not open_to.any():
            continue
        own = ids[ends[k] : ends[k + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[ids[: ends[k]]], ends[:k])
        mark[own] = 0
        like = np.flatnonzero(open_to & (both >= threshold * (sizes[:k] + sizes[k] - both)))
        if len(like):
            roots, first = np.unique(root[like], return_index=True)
            out += [(int(j), k) for j in like[first]]
            root[np.isin(root, roots)] = root[k]
    return out


def _linked(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(held).T], names=["a0", "a1", "b0", "b1"])

        for names, side, flat, ends in _cells(batches):
            found = np.array(_forest(side, flat, ends, threshold), np.int64).reshape(-1, 2)
            if len(found):
                held.append(np.concatenate([names[found[:, 0]], names[found[:, 1]]], 1))
            if len(held) >= 4096:
                yield out()
                held.clear()
        if held:
            yield out()

    return run


def linked(cells: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links (u, v) of the units (key, cell, side, n0) of each cell, at least this Jaccard similarity, by a forest per cell."""
    placed = cells.join(sets, "n0").select("key", "cell", "side", "n0", "n1", "shingles")
    placed = placed.repartition("key", "cell").sortWithinPartitions("key", "cell")
    found = placed.mapInArrow(_linked(threshold), "a0 BIGINT, a1 BIGINT, b0 BIGINT, b1 BIGINT")
    return found.select(_node("a0", "a1").alias("u"), _node("b0", "b1").alias("v"))


def distinct_units(units: DataFrame) -> DataFrame:
    """(n0, n1, id, mark, last, n_words): each unit once, with its smallest and its largest document."""
    each = units.groupBy("n0", "n1").agg(F.min(F.struct("id", "mark")).alias("d"), F.max("id").alias("last"), F.max("n_words").alias("n_words"))
    return each.select("n0", "n1", "d.id", "d.mark", "last", "n_words")


def shared_bands(units: DataFrame, distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, n0) of the units that share a band with another, bands of the same units once, and those units as (n0, n1, id, mark, n_words).

    Only (band key, name) pairs are shuffled, once: counting the names of a key and
    finding the keys with several of them use the same partitioning.
    """
    spread = units.select(F.explode("bands").alias("key"), "n0").repartition("key")
    names = spread.groupBy("key", "n0").agg(F.count(F.lit(1)).alias("n"))
    of_units = [F.bit_xor(F.xxhash64("n0")).alias("x"), F.min("n0").alias("low"), F.max("n0").alias("high")]
    several = names.groupBy("key").agg(F.count(F.lit(1)).alias("names"), *of_units).where("names > 1")
    met = cut(names.join(several, "key").select("key", "n0", "names", "x", "low", "high"))
    once = met.groupBy("names", "x", "low", "high").agg(F.min("key").alias("key"))
    few = cut(met.select("key", "n0").join(once.select("key"), "key", "left_semi"))
    return few, cut(distinct.drop("last").join(few.select("n0").distinct(), "n0", "left_semi"))


def shingle_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(n0, n1, shingles) of units (n0, n1, id, mark), from one document that holds each; only those are read again."""
    wanted = members.groupBy("id", "mark").agg(F.collect_list(F.struct("n0", "n1")).alias("wanted"))
    read = _texts(docs).join(cut(wanted), ["id", "mark"]).select("text", "wanted")
    return read.mapInArrow(_sets, "n0 BIGINT, n1 BIGINT, shingles ARRAY<BIGINT>").dropDuplicates(["n0", "n1"])


def _block(blocks: str):
    return F.pmod(F.xxhash64("n0", "key"), F.col(blocks))


def _times(n: str):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))


def first_cells(few: DataFrame, large: DataFrame) -> DataFrame:
    """Each band in one cell; a large one in ``cells`` of them, with its ``four`` in each."""
    own = few.join(large, "key", "left").select("key", F.coalesce(_block("cells"), F.lit(0)).alias("cell"), "n0")
    four = large.select("key", "cells", F.explode(F.array_distinct("four")).alias("n0")).select("key", _times("cells").alias("cell"), "n0")
    return own.unionByName(four).distinct().withColumn("side", F.lit(0))


def other_cells(few: DataFrame, members: DataFrame, large: DataFrame, tied: DataFrame) -> DataFrame:
    """Cells in which the units outside a large band's largest component meet all others of that band."""
    node = members.select("n0", _node("n0", "n1").alias("node")).join(tied, "node", "left")
    placed = cut(few.join(large.select("key", "cells"), "key").join(node.select("n0", F.coalesce("root", "node").alias("root")), "n0"))
    sizes = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("key").agg(
        F.max_by("root", F.struct("n", "root")).alias("largest"), F.max("n").alias("most"), F.sum("n").alias("n")
    ).where("n > most")
    mixed = placed.join(largest, "key").withColumn("outer", F.ceil(F.col("cells") * (F.col("n") - F.col("most")) / F.col("n")))
    here = F.col("i") * F.col("cells") + F.col("j")
    outside = mixed.where("root != largest").select("key", "n0", "cells", _block("outer").alias("i")).select("*", _times("cells").alias("j"))
    every = mixed.select("key", "n0", "cells", "outer", _block("cells").alias("j")).select("*", _times("outer").alias("i"))
    sides = [x.select("key", here.alias("cell"), F.lit(s).alias("side"), "n0") for s, x in enumerate((outside, every))]
    return sides[0].unionByName(sides[1])


def links(docs: DataFrame, units: DataFrame, distinct: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Components (node, root) of units by links, and the units that share a band."""
    few, members = shared_bands(units, distinct)
    sets = cut(shingle_sets(docs, members))
    order = F.xxhash64("n0")
    four = F.array(F.min("n0"), F.max("n0"), F.min_by("n0", order), F.max_by("n0", order))
    cells = F.ceil(F.greatest(F.count(F.lit(1)) / CELL_UNITS, F.sum("n_words") / CELL_WORDS))
    sized = few.join(members.select("n0", "n_words"), "n0").groupBy("key").agg(cells.alias("cells"), four.alias("four"))
    large = cut(sized.where("cells > 1"))
    found = cut(linked(first_cells(few, large), sets, threshold))
    tied = components(found)
    if not large.isEmpty():
        tied = components(found.unionByName(cut(linked(other_cells(few, members, large, tied), sets, threshold))))
    return tied, members


def passages(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, first_word, n_words, class_id, kept) of every passage; ``runs`` has (row, id, mark, at, windows, key, name)."""
    keys = runs.groupBy("key").agg(
        F.min(F.struct("id", "at")).alias("f"), F.max("id").alias("last"), F.min("name").alias("low"), F.max("name").alias("high")
    )
    shared = cut(keys.where("last > f.id").select("key", F.col("f.id").alias("kept"), F.col("f.at").alias("kept_at"), (F.col("low") != F.col("high")).alias("mixed")))
    met = cut(runs.join(shared, "key"))
    settled = met.where("NOT mixed AND id > kept").select("row", "id", "at", "windows", "key", "kept", "kept_at")
    mixed = met.where("mixed").drop("kept", "kept_at")
    distinct = mixed.groupBy("key", "name").agg(F.min(F.struct("id", "at", "mark")).alias("d"), F.first("windows").alias("windows"))
    distinct = distinct.select("d.id", "d.mark", F.struct("d.at", "windows", "key", "name").alias("run"))
    wanted = distinct.groupBy("id", "mark").agg(F.collect_list("run").alias("wanted"))
    read = _texts(docs).join(cut(wanted), ["id", "mark"]).dropDuplicates(["id", "mark"]).select("id", "text", "wanted")
    windows = cut(read.mapInArrow(_windows, "id BIGINT, at BIGINT, key BIGINT, name BIGINT, step BIGINT, w BIGINT"))
    first = windows.groupBy("key", "w").agg(F.min(F.struct("id", "at")).alias("f"))
    placed = windows.join(first.select("key", "w", F.col("f.id").alias("kept"), F.col("f.at").alias("kept_at")), ["key", "w"])
    order = Window.partitionBy("key", "name").orderBy("step")
    follows = (F.lag("kept").over(order) == F.col("kept")) & (F.lag("kept_at").over(order) == F.col("kept_at") - 1)
    marked = placed.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("segment", F.sum("new").over(order))
    segments = marked.groupBy("key", "name", "segment").agg(
        F.min("step").alias("step"), F.count(F.lit(1)).alias("n"), F.min("kept").alias("kept"), F.min("kept_at").alias("kept_at")
    )
    handed = mixed.join(segments, ["key", "name"]).where("id > kept")
    handed = handed.select("row", "id", (F.col("at") + F.col("step")).alias("at"), F.col("n").alias("windows"), "key", "kept", "kept_at")
    order = Window.partitionBy("row").orderBy("at")
    before = F.lag(F.struct(F.col("at") + F.col("windows"), "kept", F.col("kept_at") + F.col("windows"))).over(order)
    pieces = settled.unionByName(handed).withColumn("new", F.when(before == F.struct("at", "kept", "kept_at"), 0).otherwise(1))
    grown = pieces.withColumn("passage", F.sum("new").over(order)).groupBy("row", "passage").agg(
        F.min("id").alias("id"), F.min("at").alias("first_word"), (F.sum("windows") + WINDOW - 1).alias("n_words"),
        F.min("kept").alias("kept"), F.min("kept_at").alias("kept_at"), F.min_by("key", "at").alias("words"),
    )
    name = F.md5(F.concat_ws(":", "kept", "kept_at", "n_words", "words"))
    return grown.select("id", "first_word", "n_words", name.alias("class_id"), "kept")


def _node(first: str, second: str):
    return F.concat_ws(":", F.col(first), F.col(second))


def duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The paragraphs and passages among ``removals``, for callers that leave short lines alone."""
    return removals(docs, threshold).where("kind IN ('paragraph', 'passage')")


def removals(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, first_word, n_words, kind, class_id, kept_doc_id) of every unit to remove.

    ``class_id`` names the component; ``kept_doc_id`` is its smallest document, which keeps
    its unit. Of a passage they name its words and the smallest document that has them.
    """
    stored = cut(parts(docs))
    all_units = stored.where(F.col("kind") != RUN)
    distinct = cut(distinct_units(all_units))
    tied, members = links(docs, all_units, distinct, threshold)
    copies = distinct.where("last > id").select("n0", "n1", "id")
    # units that are linked or copied; all others are alone
    nodes = members.select("n0", "n1", "id").unionByName(copies).groupBy("n0", "n1").agg(F.min("id").alias("id")).withColumn("node", _node("n0", "n1"))
    rooted = nodes.join(tied, "node", "left").select("n0", "n1", "id", F.coalesce("root", "node").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("id").alias("kept"), F.count(F.lit(1)).alias("n"))
    classes = cut(rooted.join(kept, "root").join(copies.select("n0", "n1", F.lit(True).alias("copied")), ["n0", "n1"], "left"))
    classes = classes.where("n > 1 OR copied").select("n0", "n1", "root", "kept")
    found = all_units.join(classes, ["n0", "n1"]).where("id > kept")
    found = found.select("id", "first_word", "n_words", "kind", F.md5("root").alias("class_id"), "kept")
    named = [F.col(c).alias(n) for c, n in (("first_word", "at"), ("n_words", "windows"), ("n0", "key"), ("n1", "name"))]
    copied = passages(docs, stored.where(F.col("kind") == RUN).select("row", "id", "mark", *named))
    copied = copied.withColumn("kind", F.lit(KINDS.index("passage")).cast("long"))
    return found.unionByName(copied).select(
        F.when(F.col("id") < LAST_ID, F.col("id")).alias("doc_id"),
        "first_word",
        "n_words",
        F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("kind").cast("int")).alias("kind"),
        "class_id",
        F.col("kept").alias("kept_doc_id"),
    )
