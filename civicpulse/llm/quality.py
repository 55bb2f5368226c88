"""Document quality by a generalised additive model with pairwise interactions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicpulse.llm.common import Texts, chunks, text_rows

#: Labelled rows to learn from at most: those with the smallest hashes of doc_id and text.
TRAINING_ROWS = 20_000
BINS = 32
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 8
RATE = 0.1
#: A document is kept from this score on.
ACCEPT = 0.7

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "symbol", "punctuation", "bar",
    "space", "beyond_ascii", "log_lines", "line_length", "distinct_words", "repeated_lines",
    "short_words", "long_words", "capital_words", "symbol_ends", "stop_ends", "top_word",
)

_CLASSES = np.zeros((256, 8), bool)
for _index, _bytes in enumerate((
    range(0x41, 0x5B), range(0x30, 0x3A), b"$%&*#@^~<>{}[]\\=_+", b".,;:!?\"'()-", b"|",
    b" \t\n\r\x0b\x0c", range(0x80, 0x100), b"\n",
)):
    _CLASSES[list(_bytes), _index] = True


def features(texts: Texts) -> np.ndarray:
    """A row of numbers for each text of a chunk, from the whole text; all 0 for an empty one."""
    words, n = texts.words(), len(texts)
    size = np.diff(texts.bounds).astype(float)
    shares = np.zeros((n, 8))
    for c in range(8):
        total = np.concatenate([[0], np.cumsum(_CLASSES[texts.data, c], dtype=np.int64)])
        shares[:, c] = total[texts.bounds[1:]] - total[texts.bounds[:-1]]
    lines = shares[:, 7].copy() + (size > 0)
    shares /= np.maximum(size, 1)[:, None]
    count = np.diff(words.first).astype(float)
    length = (words.end - words.begin).astype(float)
    of_text = lambda x: np.bincount(words.text, weights=x, minlength=n) / np.maximum(count, 1)
    order = np.lexsort((words.hash, words.text))
    owner, hashes = words.text[order], words.hash[order]
    new = np.ones(len(order), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    starts = np.flatnonzero(new)
    runs = np.diff(np.append(starts, len(order)))
    distinct = np.bincount(owner[starts], minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, owner[starts], runs)
    repeated = _repeated_lines(texts, n)
    head = texts.data[words.begin] if len(words.begin) else np.zeros(0, np.uint8)
    tail = texts.data[words.end - 1] if len(words.end) else np.zeros(0, np.uint8)
    capital = (head >= 0x41) & (head <= 0x5A)
    return np.column_stack([
        np.log1p(size), np.log1p(count), of_text(length), shares[:, :7],
        np.log1p(lines), size / np.maximum(lines, 1), distinct / np.maximum(count, 1), repeated,
        of_text(length <= 3), of_text(length >= 12), of_text(capital),
        of_text(_CLASSES[tail, 2]), of_text((tail == 0x2E) | (tail == 0x21) | (tail == 0x3F)),
        most / np.maximum(count, 1),
    ])


def _repeated_lines(texts: Texts, n: int) -> np.ndarray:
    """Share of each text's lines that an earlier line of the text equals; empty lines don't count."""
    share = np.zeros(n)
    raw, bounds = texts.data.tobytes(), texts.bounds
    for i in np.flatnonzero(np.diff(bounds) > 0):
        lines = [x for x in raw[bounds[i] : bounds[i + 1]].split(b"\n") if x]
        share[i] = 1 - len(set(lines)) / len(lines) if lines else 0
    return share


class Model:
    """Bin edges and a table of log-odds per feature and per pair of features."""

    def __init__(self, edges, singles, pairs, base):
        self.edges, self.singles, self.pairs, self.base = edges, singles, pairs, base

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: a sum of table entries, looked up for all rows at once."""
        bins = _binned(x, self.edges)
        total = np.full(len(x), self.base)
        for f, values in enumerate(self.singles):
            total += values[bins[:, f]]
        for (a, b), values in self.pairs:
            total += values[bins[:, a], bins[:, b]]
        return 1 / (1 + np.exp(-total))

    def dumps(self) -> str:
        """The model as text, the same on every run."""
        return json.dumps({
            "edges": [e.tolist() for e in self.edges], "singles": [s.tolist() for s in self.singles],
            "pairs": [[list(p), v.tolist()] for p, v in self.pairs], "base": self.base,
        })

    @classmethod
    def loads(cls, text: str) -> "Model":
        raw = json.loads(text)
        return cls(
            [np.array(e) for e in raw["edges"]], [np.array(s) for s in raw["singles"]],
            [(tuple(p), np.array(v)) for p, v in raw["pairs"]], raw["base"],
        )


def _binned(x: np.ndarray, edges) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)])


def _cuts(gain: np.ndarray, weight: np.ndarray, depth: int = 2) -> np.ndarray:
    """A shallow tree over one feature's bins: per bin the mean residual of its leaf.

    Each split is the one that lowers the squared error most; a leaf has a weight (of the Hessian) of 5 or more.
    """
    out = np.zeros(len(gain))
    parts = [(0, len(gain), depth)]
    while parts:
        low, high, left = parts.pop()
        g, w = np.cumsum(gain[low:high]), np.cumsum(weight[low:high])
        if left and high - low > 1:
            room = (w[:-1] >= 5) & (w[-1] - w[:-1] >= 5)
            better = g[:-1] ** 2 / (w[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (w[-1] - w[:-1] + 1)
            better = np.where(room, better, -1)
            best = int(np.argmax(better))
            if better[best] > g[-1] ** 2 / (w[-1] + 1) + 1e-9:
                parts += [(low, low + best + 1, left - 1), (low + best + 1, high, left - 1)]
                continue
        out[low:high] = g[-1] / (w[-1] + 1)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Learn the tables by cyclic boosting.

    Each round visits all features in turn; a shallow tree over the feature's bins is fitted to
    the gradient and added to the feature's table. The pairs whose joint bins explain most of what
    is then left get tables in the same way, each a tree over one feature within halves of the other.
    With one class only, or no rows, the score is the smoothed share of label 1 everywhere.
    """
    count = len(y)
    share = (y.sum() + 1) / (count + 2)
    base = float(np.log(share / (1 - share)))
    width = len(FEATURES)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if count else np.zeros(0) for f in range(width)]
    singles = [np.zeros(len(e) + 1) for e in edges]
    if count == 0 or y.min() == y.max():
        return Model(edges, singles, [], base)
    bins = _binned(x, edges)
    total = np.full(count, base)

    def step(index: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return (
            np.bincount(index, weights=y - p, minlength=size),
            np.bincount(index, weights=p * (1 - p), minlength=size),
        )

    for _ in range(ROUNDS):
        for f in range(width):
            update = RATE * _cuts(*step(bins[:, f], len(singles[f])))
            singles[f] += update
            total += update[bins[:, f]]

    strength = []
    for a, b in combinations(range(width), 2):
        joint = bins[:, a] // 4 * BINS + bins[:, b] // 4
        gain, weight = step(joint, BINS * BINS)
        strength.append(((gain**2 / (weight + 5)).sum(), -a, -b))
    chosen = [(-a, -b) for _, a, b in sorted(strength, reverse=True)[:PAIRS]]
    pairs = [((a, b), np.zeros((len(singles[a]), len(singles[b])))) for a, b in chosen]
    for _ in range(PAIR_ROUNDS):
        for (a, b), values in pairs:
            gain, weight = step(bins[:, a] * values.shape[1] + bins[:, b], values.size)
            gain, weight = gain.reshape(values.shape), weight.reshape(values.shape)
            half = int(np.searchsorted(np.cumsum(weight.sum(1)), weight.sum() / 2)) + 1
            update = np.zeros_like(values)
            for rows in (slice(0, half), slice(half, None)):
                if weight[rows].size:
                    update[rows] = RATE * _cuts(gain[rows].sum(0), weight[rows].sum(0))
            values += update
            total += update[bins[:, a], bins[:, b]]
    for _, values in pairs:
        np.round(values, 9, out=values)
    return Model(edges, [np.round(s, 9) for s in singles], pairs, base)


_FEATURE_FIELDS = ", ".join(f"{n} double" for n in FEATURES)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAINING_ROWS) -> Model:
    """Fit the model on a bounded sample of labelled documents.

    Rows without a doc_id or with a label that is neither 0 nor 1 are no examples. Where a doc_id
    has several labels, the largest counts. The sample is the ``rows`` labelled documents with the
    smallest hashes; only their numbers, not their texts, reach the driver.
    """
    wanted = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")
    ).agg(F.max(label).cast("int").alias("y"))
    order = F.xxhash64("doc_id")
    picked = wanted.orderBy(order, "doc_id").limit(rows)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in chunks(batches):
            x = features(texts)
            yield pa.RecordBatch.from_arrays(
                [texts.columns["doc_id"], texts.columns["y"], *(pa.array(x[:, f]) for f in range(x.shape[1]))],
                ["doc_id", "y", *FEATURES],
            )

    # At most ``rows`` rows of two numbers, so the texts stay where they are.
    found = text_rows(docs).join(F.broadcast(picked), "doc_id").mapInArrow(numbers, f"doc_id long, y int, {_FEATURE_FIELDS}")
    got = found.toArrow()
    x = np.column_stack([np.asarray(got[n]) for n in FEATURES]) if got.num_rows else np.zeros((0, len(FEATURES)))
    y = np.asarray(got["y"]).astype(float)
    by_row = np.lexsort((*x.T, np.asarray(got["doc_id"]))) if len(y) else np.zeros(0, int)
    return fit(x[by_row], y[by_row])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, score (of its whole text) and predicted (1 from ``ACCEPT`` on).

    A null text is empty and gets a score; equal texts get equal scores; repeated rows stay.
    Only the text is an input.
    """
    packed = model.dumps()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.loads(packed)
        for texts in chunks(batches):
            s = own.score(features(texts))
            yield pa.RecordBatch.from_arrays(
                [texts.columns["doc_id"], pa.array(s), pa.array((s >= ACCEPT).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    return text_rows(docs).mapInArrow(scored, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the model accepts."""
    schema = docs.schema
    packed = model.dumps()

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.loads(packed)
        for batch in batches:
            good = [own.score(features(t)) >= ACCEPT for t in chunks(iter([batch]))]
            yield batch.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))

    return docs.mapInArrow(kept, schema)
