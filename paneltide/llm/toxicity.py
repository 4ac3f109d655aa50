"""Toxicity by a factorization machine over hashed terms.

Terms of a lower-cased word are the word and its beginnings of four to six letters, hashed to
``BITS`` bits. A window's score is bias + sum of the terms' weights + sum over pairs of terms
of the product of their factors, so it learns that two harmless terms are an insult together,
which additive weights cannot. The pairs are never listed: with S the sum of the factors they
come to (S.S - sum of squares) / 2. A window is two neighbouring blocks of ``BLOCK`` words, each
word counted once a block, so pairs are words near each other; windows overlap by a block and
cover the whole text. A text is as toxic as its worst window; training takes the same window of
each text, so one insult in a long text counts as much as in a short one.

Training uses a bounded sample of labelled rows: ``DOCS`` per label, chosen by a hash of the id.
``PARTS`` partitions train on their own rows, weights by follow-the-regularized-leader (most stay
exactly 0) and factors by Adagrad. Weights start from the terms' odds in toxic texts where these
differ clearly. After each round a term's parameters are averaged over the partitions that
train it, and terms without a weight or grown factors are dropped; later rounds refine the rest. Dropped and unseen terms weigh
nothing, so the model is small and ordinary words add no noise, however long a text is.

Cases: null texts and texts without a word have the score of the bias alone; rows with a null
label or id are not trained on; an id labelled twice counts as toxic if one label says so;
without a labelled row of each kind all scores are 0; repeated rows give repeated results; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from paneltide.llm.common import wrap
from paneltide.session import cut

BITS = 24
FACTORS = 8
BLOCK = 32
STARTS = (4, 5, 6)
DOCS = 2000
SLICES = 20
PARTS = 4
STEPS = (40, 40)  # batches of each round
BATCH = 128
RATE = 0.5
FACTOR_RATE = 0.05
SPARSE = 30.0  # summed gradients that a weight must exceed to leave 0
DECAY = 1e-3
CLEAR = 5.0  # standard errors between the two labels
PRIOR = 5.0  # texts of either label added to a term's counts
COMMON = (0.01, 0.5)
SPREAD = 0.02  # of the first factors
GROWN = 0.01  # squared length of factors from which a term is kept without a weight
CACHE = 200_000
CHUNK_WORDS = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)


def terms(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed term, number of its word) of all terms of some words, in word order, by vector operations."""
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) for w in words])
    start = np.cumsum(sizes) - sizes
    power = np.full(int(sizes.max(initial=1)), 0x100000001B3, np.uint64)
    power[0] = 1
    place = np.arange(len(code)) - np.repeat(start, sizes)
    hashes, owners = [np.add.reduceat(code * np.multiply.accumulate(power)[place], start)], [np.arange(len(words))]
    for k in STARTS:
        long_enough = np.flatnonzero(sizes >= k)
        h = np.full(len(long_enough), k, np.uint64)
        for j in range(k):
            h = _mixed(h + code[start[long_enough] + j])
        hashes.append(h)
        owners.append(long_enough)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (_mixed(np.concatenate(hashes)) >> np.uint64(64 - BITS)).astype(np.int64)[order], owner[order]


def _first(rows: np.ndarray) -> np.ndarray:
    """Start values of some terms' parameters (weight, factors), the same in every partition."""
    x = rows.astype(np.uint64)[:, None] * np.uint64(FACTORS) + np.arange(FACTORS, dtype=np.uint64)
    x = _mixed((x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    out = np.zeros((len(rows), 1 + FACTORS))
    out[:, 1:] = ((x >> np.uint64(11)).astype(np.float64) / 2**53 * 2 - 1) * SPREAD
    return out


@dataclass
class Model:
    bias: float
    rows: np.ndarray  # hashed terms that were met, ascending
    table: np.ndarray  # (terms, 1 + FACTORS): weight and factors

    def params(self, rows: np.ndarray) -> np.ndarray:
        """Parameters of some terms; those never met are zero."""
        out = np.zeros((len(rows), 1 + FACTORS))
        if len(self.rows):
            at = np.minimum(np.searchsorted(self.rows, rows), len(self.rows) - 1)
            known = self.rows[at] == rows
            out[known] = self.table[at[known]]
        return out


@dataclass
class Text:
    """Numbers of the words that matter, their places, and the number of all words."""

    words: np.ndarray
    places: np.ndarray
    size: int


def _blocks(texts: list[Text]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of some texts as (block, word) pairs, each once, and the first block of each text."""
    blocks = np.array([-(-t.size // BLOCK) for t in texts], np.int64)
    first = np.cumsum(blocks) - blocks
    here = np.concatenate([f + t.places // BLOCK for f, t in zip(first, texts)]) if texts else np.zeros(0, np.int64)
    flat = np.concatenate([t.words for t in texts]) if texts else np.zeros(0, np.int64)
    pair = np.unique(here << 40 | flat)
    return pair >> 40, pair & ((1 << 40) - 1), np.append(first, blocks.sum())


def _windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per window its two blocks (the same one if a text has one), and the first window of each text with a block."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(1, n - 1), 0)
    owner = np.repeat(np.arange(len(n)), count)
    start = np.cumsum(count) - count
    a = first[owner] + np.arange(count.sum()) - start[owner]
    return a, np.where(n[owner] > 1, a + 1, a), start


def _scores(bias: float, words: np.ndarray, block: np.ndarray, word: np.ndarray, first: np.ndarray) -> tuple:
    """Score of every window. ``words``: per word the sums of its terms' weights, factors and squared factors."""
    sums = np.zeros((int(first[-1]), words.shape[1]))
    if len(block):
        begin = np.flatnonzero(np.diff(block, prepend=-1))
        sums[block[begin]] = np.add.reduceat(words[word], begin)
    a, b, start = _windows(first)
    both = sums[a] + np.where((a != b)[:, None], sums[b], 0.0)
    factors = both[:, 1:-1]
    return bias + both[:, 0] + 0.5 * ((factors**2).sum(1) - both[:, -1]), factors, a, b, start


def _summed(params: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Per word: weight, factors, squared factors of its terms."""
    square = (params[:, 1:] ** 2).sum(1)
    return np.stack([np.bincount(owner, c, n) for c in (*params.T, square)], 1)


class Vocabulary:
    """Numbers the words that have a term in ``rows`` (ascending), or all words if it is None."""

    def __init__(self, rows: np.ndarray | None):
        self.rows = rows
        self.number: dict[str, int] = {}  # -1 for words without such a term
        self.size = 0

    def read(self, texts: list[str]) -> tuple[list[Text], np.ndarray, np.ndarray]:
        """The texts, and the terms of the words that were new: (hashed term, number of its word)."""
        lists = [_WORD.findall(t.lower()) for t in texts]
        number = self.number
        new = list(dict.fromkeys(w for words in lists for w in words if w not in number))
        term, owner = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if new:
            term, owner = terms(new)
            if self.rows is not None:
                known = np.isin(term, self.rows)
                term, owner = term[known], owner[known]
            with_terms, owner = np.unique(owner, return_inverse=True)
            numbers = np.full(len(new), -1)
            numbers[with_terms] = self.size + np.arange(len(with_terms))
            number.update(zip(new, numbers.tolist()))
            owner = owner + self.size
            self.size += len(with_terms)
        out = []
        for words in lists:
            found = np.array([number[w] for w in words], np.int64)
            places = np.flatnonzero(found >= 0)
            out.append(Text(found[places], places, len(found)))
        return out, term, owner


def _odds(texts: list[Text], label: np.ndarray, term: np.ndarray, spans: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First weight of each term, and which terms to train.

    A term that is clearly commoner in texts of one label starts from the logarithm of its
    odds; others start from 0 and are trained if they are neither rare nor everywhere.
    """
    held = np.zeros((2, n))
    for t, y in zip(texts, label):
        used = [term[spans[w] : spans[w + 1]] for w in np.unique(t.words)]
        held[y, np.unique(np.concatenate(used)) if used else []] += 1
    total = np.maximum(np.bincount(label, minlength=2), 1)[:, None]
    share, all_of = held / total, held.sum(0) / total.sum()
    error = np.sqrt(np.maximum(all_of * (1 - all_of) * (1 / total).sum(), 1e-12))
    clear = np.abs(share[1] - share[0]) > CLEAR * error
    odds = np.diff(np.log((held + PRIOR) / (total + 2 * PRIOR)), axis=0)[0]
    return np.where(clear, odds, 0.0), clear | ((all_of >= COMMON[0]) & (all_of <= COMMON[1]))


def fit_part(model: Model, docs: list[tuple[str, int]], seed: int, steps: int) -> Model:
    """So many batches of some texts and labels; both labels weigh the same. An empty model meets all terms, any other refines its own."""
    rng = np.random.default_rng(seed)
    vocabulary = Vocabulary(model.rows if len(model.rows) else None)
    texts, hashed, owner = vocabulary.read([t for t, _ in docs])
    label = np.array([y for _, y in docs], float)
    weight = np.where(label == 1, 0.5 / max(label.mean(), 1e-9), 0.5 / max(1 - label.mean(), 1e-9))
    rows, term = np.unique(hashed, return_inverse=True)
    table = model.params(rows)
    if not len(model.rows):
        table = _first(rows)
        table[:, 0], keep = _odds(texts, label.astype(int), term, np.searchsorted(owner, np.arange(vocabulary.size + 1)), len(rows))
        rows, table = rows[keep], table[keep]
        term, owner = (np.cumsum(keep) - 1)[term[keep[term]]], owner[keep[term]]
    spans = np.searchsorted(owner, np.arange(vocabulary.size + 1))
    bias, seen_bias, seen = model.bias, 1.0, np.full_like(table, 1.0)
    # of the weights, the sum of gradients that gives the weights at hand
    pulled = table[:, 0] / RATE + np.sign(table[:, 0]) * SPARSE
    full = [k for k in range(len(texts)) if texts[k].size]
    while steps > 0 and full:
        order = rng.permutation(full)
        for at in range(0, len(order), BATCH)[:steps]:
            steps -= 1
            some = order[at : at + BATCH]
            block, word, first = _blocks([texts[k] for k in some])
            used, word = np.unique(word, return_inverse=True)
            which = np.concatenate([term[spans[w] : spans[w + 1]] for w in used] or [term[:0]])
            of = np.repeat(np.arange(len(used)), spans[used + 1] - spans[used])
            score, factors, a, b, start = _scores(bias, _summed(table[which], of, len(used)), block, word, first)
            worst = np.array([s + np.argmax(score[s:e]) for s, e in zip(start, np.append(start[1:], len(score)))])
            slope = weight[some] * (label[some] - 1.0 / (1.0 + np.exp(-np.clip(score[worst], -30, 30))))
            # gradient of a term in a window: 1 for its weight, S - v for its factors, for each word that has it
            edges = np.searchsorted(block, np.arange(int(first[-1]) + 1))
            words_in = [np.concatenate([word[edges[x] : edges[x + 1]] for x in {int(a[w]), int(b[w])}]) for w in worst]
            doc = np.repeat(np.arange(len(worst)), [len(x) for x in words_in])
            hit = np.concatenate(words_in)
            low, high = np.searchsorted(of, hit), np.searchsorted(of, hit, "right")
            doc = np.repeat(doc, high - low)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
            touched, inverse = np.unique(which[place], return_inverse=True)
            up = slope[doc]
            grad = np.empty((len(touched), 1 + FACTORS))
            grad[:, 0] = np.bincount(inverse, up, len(touched))
            pull = up[:, None] * (factors[worst[doc]] - table[which[place], 1:])
            for f in range(FACTORS):
                grad[:, 1 + f] = np.bincount(inverse, pull[:, f], len(touched))
            grad[:, 1:] -= DECAY * len(some) * table[touched, 1:]
            old = np.sqrt(seen[touched])
            seen[touched] += grad**2
            root = np.sqrt(seen[touched])
            table[touched, 1:] += FACTOR_RATE * grad[:, 1:] / root[:, 1:]
            pulled[touched] += grad[:, 0] + (root[:, 0] - old[:, 0]) / RATE * table[touched, 0]
            z = pulled[touched]
            table[touched, 0] = RATE * np.sign(z) * np.maximum(np.abs(z) - SPARSE, 0.0) / root[:, 0]
            seen_bias += slope.sum() ** 2
            bias += RATE * slope.sum() / np.sqrt(seen_bias)
    return Model(bias, rows, table)


def merged(parts: list[Model]) -> Model:
    """Each term's parameters averaged over the parts that met it; terms that stayed near 0 are dropped."""
    rows, inverse = np.unique(np.concatenate([p.rows for p in parts]), return_inverse=True)
    table = np.concatenate([p.table for p in parts])
    met = np.bincount(inverse, minlength=len(rows))
    mean = np.stack([np.bincount(inverse, c, len(rows)) for c in table.T], 1) / met[:, None]
    keep = (mean[:, 0] != 0) | ((mean[:, 1:] ** 2).sum(1) > GROWN)
    return Model(float(np.mean([p.bias for p in parts])), rows[keep], mean[keep])


def sample(rows: DataFrame, docs: int = DOCS) -> DataFrame:
    """(text, toxic, part) of at most ``docs`` rows per label, chosen by a hash of the id.

    Rows are chosen within ``SLICES`` slices of the ids, so no task sees all rows of a label;
    ids are chosen first, and only their texts are fetched.
    """
    dealt = Window.partitionBy("toxic", "slice").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = lambda df: df.withColumn("slice", F.pmod(F.xxhash64(F.lit("slice"), "doc_id"), F.lit(SLICES))).withColumn(
        "k", F.row_number().over(dealt)
    ).where(F.col("k") <= docs // SLICES)
    ids = cut(chosen(rows.select("doc_id", "toxic")).select("doc_id").distinct())
    held = chosen(rows.join(ids, "doc_id", "left_semi"))  # again, for repeated ids
    return cut(held.select("text", "toxic", F.pmod("k", F.lit(PARTS)).cast("int").alias("part")))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the rows with a label; ids are narrowed before texts are read."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    return docs.select("doc_id", "text").where("text IS NOT NULL").join(known, "doc_id")


def fit(rows: DataFrame) -> Model | None:
    """Train on rows (doc_id, text, toxic); None unless both labels occur."""
    taken = sample(rows)
    if taken.select("toxic").distinct().count() < 2:
        return None
    model = Model(0.0, np.zeros(0, np.int64), np.zeros((0, 1 + FACTORS)))
    for k, steps in enumerate(STEPS):
        held = rows.sparkSession.sparkContext.broadcast(model)

        def train(part: pd.DataFrame) -> pd.DataFrame:
            docs = sorted(zip(part["text"], part["toxic"]))
            out = fit_part(held.value, docs, 100 * k + int(part["part"].iloc[0]), steps)
            return pd.DataFrame({"bias": [out.bias], "rows": [out.rows.tobytes()], "params": [out.table.astype(np.float32).tobytes()]})

        parts = taken.groupBy("part").applyInPandas(train, "bias DOUBLE, rows BINARY, params BINARY").collect()
        model = merged(
            [Model(p["bias"], np.frombuffer(p["rows"], np.int64), np.frombuffer(p["params"], np.float32).reshape(-1, 1 + FACTORS).astype(float)) for p in parts]
        )
    return model


class Scorer:
    """Scores of whole texts; remembers the words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.vocabulary = Vocabulary(model.rows)
        self.sums = np.zeros((0, FACTORS + 2))

    def score(self, texts: list[str]) -> np.ndarray:
        """Chance of label 1 per text."""
        if len(self.vocabulary.number) > CACHE:
            self.vocabulary, self.sums = Vocabulary(self.model.rows), self.sums[:0]
        read, term, owner = self.vocabulary.read(texts)
        if len(term):
            before = len(self.sums)
            self.sums = np.concatenate([self.sums, _summed(self.model.params(term), owner - before, self.vocabulary.size - before)])
        block, word, first = _blocks(read)
        score, _, _, _, start = _scores(self.model.bias, self.sums, block, word, first)
        out = np.full(len(texts), self.model.bias)
        has = np.flatnonzero(np.diff(first) > 0)
        if len(has):
            out[has] = np.maximum.reduceat(score, start[has])
        return 1.0 / (1.0 + np.exp(-np.clip(out, -500, 500)))


def _predict(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value) if held.value else None
        for batch in batches:
            score = np.zeros(batch.num_rows)
            group, size, begin = [], 0, 0
            for k, text in enumerate(batch.column("text") if scorer else ()):
                group.append(text.as_py())
                size += len(group[-1])
                if size >= 6 * CHUNK_WORDS or k == batch.num_rows - 1:
                    score[begin : k + 1] = scorer.score(group)
                    group, size, begin = [], 0, k + 1
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score)], names=["row", "score"])

    return run


def score(docs: DataFrame, model: Model | None, carry: list[str] | None = None) -> DataFrame:
    """(row, score) per input row."""
    held = wrap(docs, carry)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return held.mapInArrow(_predict(shared), StructType([held.schema["row"], StructField("score", DoubleType())]))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of ids that is never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
