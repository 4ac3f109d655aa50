"""Language identification by a linear-chain conditional random field over words.

Each word gets a label; the label sequence is scored by word features and by learned
transitions, and labels are weighed by forward-backward, so a text that switches
languages is labelled span by span. Features of a lower-cased word: the word itself,
affixes of one to three letters, n-grams of two and three letters with word ends,
and membership in a lexicon of each language; all hashed into ``2 ** BITS`` rows of
weights, so the model has a fixed size.

Training uses a bounded sample of labelled rows: ``DOCS`` documents per language,
chosen by a hash of the id, and ``PIECES`` pieces of ``LENGTH`` words spread over each
whole document. Pieces of several languages are joined into sequences, from which the
transitions are learned. Each of ``PARTS`` partitions trains on its own sequences with
Adagrad; after each round the partitions' weights are averaged (iterative parameter
mixing). Prediction covers every word of every text.

Cases: null texts and texts without a letter are ``und`` with score 0, and so is every
text if no labelled row has a letter; rows without a language or id are not trained
on; repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from paneltide.llm.common import wrap
from paneltide.session import cut

UNKNOWN = "und"
BITS = 16
DOCS = 150
PIECES = 24
LENGTH = 32
PARTS = 4
ROUNDS = 2
EPOCHS = 2
BATCH = 64
RATE = 0.3
LEXICON = 2000
CHUNK_WORDS = 300_000
CACHE = 200_000
NEW_WORDS = 20_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def has_letter(words: list[str]) -> bool:
    return any(c.isalpha() for w in words for c in w)


_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _row(kind: int, *codes: np.ndarray) -> np.ndarray:
    """Weight rows of features of one kind, each given by up to three letters."""
    h = np.full(len(codes[0]), kind, np.uint64) * _D
    for c in codes:
        h = (h ^ c) * _A
        h ^= h >> np.uint64(29)
    return (h * _B) >> np.uint64(64 - BITS)


def features(words: list[str], lexicon: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(weight row, number of the word) of all features of some words, by vector operations."""
    ends = "".join([f"^{w}$" for w in words])
    code = np.frombuffer(ends.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    stop = np.cumsum(sizes)
    start = stop - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(code)) - start[owner]
    last = sizes[owner] - 1 - place  # letters after this one, the end sign included
    rows, owners = [], []

    def add(kind: int, where: np.ndarray, *codes: np.ndarray) -> None:
        rows.append(_row(kind, *codes))
        owners.append(where)

    two, three = np.flatnonzero(last >= 1), np.flatnonzero(last >= 2)
    add(2, owner[two], code[two], code[two + 1])
    add(3, owner[three], code[three], code[three + 1], code[three + 2])
    for k in (1, 2, 3):
        long_enough = np.flatnonzero(sizes >= k + 2)
        add(3 + k, long_enough, *[code[start[long_enough] + 1 + j] for j in range(k)])
        add(6 + k, long_enough, *[code[stop[long_enough] - 1 - k + j] for j in range(k)])
    power = np.full(int(sizes.max(initial=1)), 0x100000001B3, np.uint64)
    power[0] = 1
    whole = np.add.reduceat(code * np.multiply.accumulate(power)[place], start)
    add(1, np.arange(len(words)), whole)
    listed = [(i, k) for i, w in enumerate(words) for k in lexicon.get(w, ())]
    if listed:
        add(10, np.array([i for i, _ in listed]), np.array([k for _, k in listed], np.uint64))
    return np.concatenate(rows).astype(np.int64), np.concatenate(owners)


def _sums(weights: np.ndarray, rows: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """Per word the sum of its features' weights."""
    return np.stack([np.bincount(owners, weights[rows, k], n) for k in range(weights.shape[1])], 1)


@dataclass
class Model:
    labels: list[str]
    lexicon: dict[str, tuple[int, ...]]
    weights: np.ndarray  # (2 ** BITS, labels)
    moves: np.ndarray  # (labels, labels), from row to column

    @staticmethod
    def empty(labels: list[str], lexicon: dict) -> "Model":
        n = len(labels)
        return Model(labels, lexicon, np.zeros((1 << BITS, n), np.float32), np.zeros((n, n)))


def _scaled(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - scores.max(-1, keepdims=True))


def forward_backward(emission: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (steps, chains, labels) and summed transition posteriors of equally long chains."""
    steps = len(emission)
    alpha, beta = np.empty_like(emission), np.empty_like(emission)
    alpha[0] = emission[0] / emission[0].sum(-1, keepdims=True)
    for t in range(1, steps):
        a = (alpha[t - 1] @ moves) * emission[t]
        alpha[t] = a / a.sum(-1, keepdims=True)
    beta[-1] = 1.0
    pairs = np.zeros_like(moves)
    for t in range(steps - 2, -1, -1):
        b = emission[t + 1] * beta[t + 1]
        joint = alpha[t][:, :, None] * moves * b[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        b = b @ moves.T
        beta[t] = b / b.sum(-1, keepdims=True)
    post = alpha * beta
    return post / post.sum(-1, keepdims=True), pairs


def _pieces(words: list[str]) -> list[list[str]]:
    """At most ``PIECES`` runs of at most ``LENGTH`` words, spread evenly over all of ``words``."""
    starts = list(range(0, len(words), LENGTH))
    step = max(1, -(-len(starts) // PIECES))
    return [words[s : s + LENGTH] for s in starts[::step]]


def _sequences(docs: list[tuple[str, str]], labels: list[str], rng: np.random.Generator) -> list[tuple[list[str], list[int]]]:
    """Sequences of ``LENGTH`` words: half from one document, half switching between languages."""
    pieces = [(labels.index(lang), p) for lang, text in docs for p in _pieces(words_of(text))]
    out = []
    order = rng.permutation(len(pieces))
    for k, at in enumerate(order):
        y, p = pieces[at]
        words, tags = list(p), [y] * len(p)
        if k % 2:
            words, tags = words[: int(rng.integers(4, 13))], []
            tags = [y] * len(words)
        while len(words) < LENGTH:
            z, q = pieces[int(rng.integers(len(pieces)))]
            start = int(rng.integers(max(1, len(q) - 4)))
            q = q[start : start + int(rng.integers(4, 13))] or q
            words += q
            tags += [z] * len(q)
        out.append((words[:LENGTH], tags[:LENGTH]))
    return out


def fit_part(model: Model, docs: list[tuple[str, str]], seed: int) -> Model:
    """``EPOCHS`` passes of Adagrad over the sequences of some documents."""
    rng = np.random.default_rng(seed)
    weights, moves = model.weights.astype(np.float64), model.moves.copy()
    seen_w, seen_m = np.full_like(weights, 1e-2), np.full_like(moves, 1e-2)
    n = len(model.labels)
    for _ in range(EPOCHS):
        sequences = _sequences(docs, model.labels, rng)
        for at in range(0, len(sequences), BATCH):
            batch = sequences[at : at + BATCH]
            flat = [w for t in range(LENGTH) for w in (s[0][t] for s in batch)]
            rows, owners = features(flat, model.lexicon)
            scores = _sums(weights, rows, owners, len(flat))
            tags = np.array([[s[1][t] for s in batch] for t in range(LENGTH)])
            post, pairs = forward_backward(_scaled(scores).reshape(LENGTH, len(batch), n), np.exp(moves - moves.max()))
            truth = np.eye(n)[tags]
            up = (truth - post).reshape(-1, n)[owners] / len(batch)
            touched, where = np.unique(rows, return_inverse=True)
            grad = np.stack([np.bincount(where, up[:, k], len(touched)) for k in range(n)], 1)
            seen_w[touched] += grad**2
            weights[touched] += RATE * grad / np.sqrt(seen_w[touched])
            observed = np.zeros_like(moves)
            np.add.at(observed, (tags[:-1].ravel(), tags[1:].ravel()), 1.0)
            grad = (observed - pairs) / len(batch)
            seen_m += grad**2
            moves += RATE * grad / np.sqrt(seen_m)
    return Model(model.labels, model.lexicon, weights.astype(np.float32), moves)


def sample(rows: DataFrame, docs: int = DOCS) -> DataFrame:
    """(lang, text, part) of at most ``docs`` rows per language, chosen by a hash of the id."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = rows.select("doc_id", "lang").withColumn("k", F.row_number().over(order)).where(F.col("k") <= docs)
    ids = cut(ids.select("doc_id").distinct())
    held = rows.join(ids, "doc_id", "left_semi").select("doc_id", "lang", "text")
    again = held.withColumn("k", F.row_number().over(order)).where(F.col("k") <= docs)  # repeated ids
    return cut(again.select("lang", "text", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(PARTS)).cast("int").alias("part")))


def _lexicon(rows: DataFrame, labels: list[str]) -> dict[str, tuple[int, ...]]:
    """Frequent words of the sample that belong to one language: at most ``LEXICON`` per language."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    counts = rows.select("lang", word.alias("word")).groupBy("word", "lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("word"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    kept = counts.withColumn("share", share).where("n >= 3 AND share >= 0.9").withColumn("k", F.row_number().over(best))
    found = kept.where(F.col("k") <= LEXICON).select("word", "lang").collect()
    return {r["word"]: (labels.index(r["lang"]),) for r in found if r["lang"] in labels}


def fit(rows: DataFrame) -> Model | None:
    """Train on rows (doc_id, lang, text); None if they hold no label with words."""
    spark = rows.sparkSession
    known = rows.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    taken = sample(known.where(F.col("text").rlike(r"\p{L}")))
    labels = sorted(r["lang"] for r in taken.select("lang").distinct().collect())
    if not labels:
        return None
    model = Model.empty(labels, _lexicon(taken, labels))
    for k in range(ROUNDS if len(labels) > 1 else 0):
        held = spark.sparkContext.broadcast(model)

        def train(part: pd.DataFrame) -> pd.DataFrame:
            docs = sorted(zip(part["lang"], part["text"]))
            out = fit_part(held.value, docs, 100 * k + int(part["part"].iloc[0]))
            return pd.DataFrame({"weights": [out.weights.tobytes()], "moves": [out.moves.tobytes()]})

        parts = taken.groupBy("part").applyInPandas(train, "weights BINARY, moves BINARY").collect()
        n = len(labels)
        model = Model(
            labels,
            model.lexicon,
            np.mean([np.frombuffer(p["weights"], np.float32).reshape(-1, n) for p in parts], 0),
            np.mean([np.frombuffer(p["moves"], np.float64).reshape(n, n) for p in parts], 0),
        )
    return model


class Labeller:
    """Posteriors of whole texts; remembers the scores of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.rows: dict[str, int] = {}
        self.table = np.empty((1024, len(model.labels)))
        self.weights = model.weights.astype(np.float64)
        self.moves = np.exp(model.moves - model.moves.max())

    def _emissions(self, words: list[str]) -> np.ndarray:
        rows = self.rows
        if len(rows) > CACHE:
            rows.clear()
        new = [w for w in dict.fromkeys(words) if w not in rows]
        if len(rows) + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.empty((len(new) + len(self.table), self.table.shape[1]))])
        for at in range(0, len(new), NEW_WORDS):
            some = new[at : at + NEW_WORDS]
            self.table[len(rows) : len(rows) + len(some)] = _sums(self.weights, *features(some, self.model.lexicon), len(some))
            rows.update(zip(some, range(len(rows), len(rows) + len(some))))
        return _scaled(self.table[[rows[w] for w in words]])

    def label(self, texts: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text (not empty): mean posterior per label, and the best label of each word."""
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        lengths = np.array([len(texts[k]) for k in order])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        e = self._emissions([w for k in order for w in texts[k]])
        steps = int(lengths[0])
        active = np.searchsorted(-lengths, -np.arange(steps), "left")  # texts longer than t
        alpha = np.empty_like(e)
        a = e[starts] / e[starts].sum(1, keepdims=True)
        alpha[starts] = a
        for t in range(1, steps):
            n = active[t]
            at = starts[:n] + t
            a = (a[:n] @ self.moves) * e[at]
            a /= a.sum(1, keepdims=True)
            alpha[at] = a
        back, b = self.moves.T.copy(), np.ones((0, e.shape[1]))
        for t in range(steps - 1, -1, -1):
            n = active[t]
            at = starts[:n] + t
            if len(b) < n:
                b = np.concatenate([b, np.ones((n - len(b), e.shape[1]))])
            here = e[at]
            post = alpha[at] * b
            alpha[at] = post / post.sum(1, keepdims=True)
            b = (here * b) @ back
            b /= b.sum(1, keepdims=True)
        means = np.add.reduceat(alpha, starts) / lengths[:, None]
        best = alpha.argmax(1)
        out: list = [None] * len(texts)
        for place, k in enumerate(order):
            out[k] = (means[place], best[starts[place] : starts[place] + lengths[place]])
        return out


def _runs(best: np.ndarray, labels: list[str]) -> list[dict]:
    ends = np.flatnonzero(np.diff(best, append=-1)) + 1
    starts = np.concatenate([[0], ends[:-1]])
    return [{"lang": labels[best[s]], "start": int(s), "n": int(e - s)} for s, e in zip(starts, ends)]


_SPANS = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("n", pa.int64())]))
_FIELDS = [
    StructField("lang_pred", StringType()),
    StructField("score", DoubleType()),
    StructField("spans", ArrayType(StructType([StructField("lang", StringType()), StructField("start", LongType()), StructField("n", LongType())]))),
]


def _predict(held, with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        labeller = Labeller(model) if model else None
        for batch in batches:
            texts = batch.column("text")
            size = len(texts)
            lang, score, spans = [UNKNOWN] * size, [0.0] * size, [[] for _ in range(size)]
            order = np.argsort(-np.array([len(x) for x in texts.cast(pa.binary()).to_pylist()]), kind="stable").tolist() if model else []
            group, names, held_words = [], [], 0
            for place, k in enumerate(order):
                words = words_of(texts[k].as_py())
                if has_letter(words):
                    group.append(words)
                    names.append(k)
                    held_words += len(words)
                if group and (held_words >= CHUNK_WORDS or place == len(order) - 1):
                    for k2, (mean, best) in zip(names, labeller.label(group)):
                        top = int(mean.argmax())
                        lang[k2], score[k2] = model.labels[top], float(min(1.0, mean[top]))
                        if with_spans:
                            spans[k2] = _runs(best, model.labels)
                    group, names, held_words = [], [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, _SPANS)],
                names=["row", "lang_pred", "score", "spans"],
            )

    return run


def label(docs: DataFrame, model: Model | None, carry: list[str] | None = None, with_spans: bool = True) -> DataFrame:
    """(row, lang_pred, score, spans) per input row.

    ``spans`` are the runs of words of one language: (lang, start word, n words). The
    score is the mean posterior of the predicted language over the words.
    """
    held = wrap(docs, carry)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return held.mapInArrow(_predict(shared, with_spans), StructType([held.schema["row"], *_FIELDS]))


def held_out(doc_id: Column) -> Column:
    """True for the quarter of ids that is never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
