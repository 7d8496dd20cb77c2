"""Quality classifier: a generalised additive model with pairwise interactions.

Every text is reduced to a few dozen counts and shares (``FEATURES``). Each feature is
cut into bins at the quantiles of the training rows; cyclic boosting visits the
features in turn and adds a shallow tree's leaf values, shrunk, to that feature's
lookup table; then the pairs of features with the largest gain on the residuals get
tables of their own in the same way. A text's score is the logistic of the intercept and
the table entries of its bins, added up for a whole batch at once.

The model is fitted on at most about ``TRAIN_ROWS`` labelled rows (a hash sample with
that expectation), which is the only thing that goes to the driver; features and
scores are made where the documents are. Rows whose ``held_out`` remainder is 0 are never
trained on; labels, lang, source and doc_id are no inputs.

Edge cases: null and empty texts have features of their own and a score; a null doc_id is
scored (held_out null) and never trained on; a doc_id with several labels counts once, as
the mean label rounded; repeated rows are scored each; without labels every score is 0.5;
extra columns of any name are left alone.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, stored

TRAIN_ROWS = 20_000
THRESHOLD = 0.3
FOLDS = 5
BINS = 32
ROUNDS = 120             # visits of each feature
PAIR_ROUNDS = 60
PAIRS = 6
LEAVES = 4
RATE = 0.15
LEAST = 20.0             # training rows in a leaf at least
SHRINK = 1.0             # added to a leaf's curvature
_BREAK = re.compile(r"[.!?]+(?:\s|$)")

# character classes of the first 256 code points; all others count as lower-case letters
_LETTER, _UPPER, _DIGIT, _SPACE, _STOP, _MARK = 1, 2, 4, 8, 16, 32
_CLASS = np.zeros(257, np.uint8)
for _k in range(256):
    _c = chr(_k)
    _CLASS[_k] = (_UPPER | _LETTER if _c.isupper() else _LETTER if _c.isalpha() else _DIGIT if _c.isdigit()
                  else _SPACE if _c.isspace() else _STOP if _c in ".,;:'\"-()" else _MARK)
_CLASS[256] = _LETTER
FEATURES = ("words", "word_length", "longest_word", "upper", "digits", "marks", "stops", "bars", "exclaims", "distinct",
            "repeats", "marked_words", "upper_words", "lines", "line_copies", "short_lines", "squeezed", "sentence_words",
            "first_letters")


def features(text: str | None) -> list[float]:
    text = text or ""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kinds = np.bincount(_CLASS[np.minimum(points, 256)], minlength=64)
    letters = max(1, int(kinds[_LETTER] + kinds[_LETTER | _UPPER]))
    lines = [x for x in text.split("\n") if x.strip()]
    raw = text.encode("utf-8", "replace")
    some = max(1, n)
    return [
        np.log1p(n), sum(map(len, words)) / some, float(max(map(len, words), default=0)),
        kinds[_LETTER | _UPPER] / letters, kinds[_DIGIT] / chars, kinds[_MARK] / chars, kinds[_STOP] / chars,
        text.count("|") / chars, text.count("!") / chars, len(set(words)) / some,
        sum(map(str.__eq__, words, words[1:])) / some, sum(not w[-1].isalnum() for w in words) / some,
        sum(map(str.isupper, words)) / some, len(lines) / some, 1 - len(set(lines)) / max(1, len(lines)),
        sum(len(x) < 30 for x in lines) / max(1, len(lines)), len(zlib.compress(raw, 1)) / max(1, len(raw)),
        n / (1 + len(_BREAK.findall(text))), sum(map(str.istitle, words)) / some,
    ]


def _bins(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, values[:, k], side="right") for k, e in enumerate(edges)], axis=1)


@dataclass
class Model:
    intercept: float = 0.0
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)               # one per feature
    pairs: list = field(default_factory=list)                # (i, j, table)

    def score(self, values: np.ndarray) -> np.ndarray:
        total = np.full(len(values), self.intercept)
        if self.edges:
            at = _bins(values, self.edges)
            for k, table in enumerate(self.tables):
                total += table[at[:, k]]
            for i, j, table in self.pairs:
                total += table[at[:, i], at[:, j]]
        return 1 / (1 + np.exp(-total))


def _tree(gradient: np.ndarray, curvature: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Leaf values per bin of a tree of at most LEAVES leaves, grown best split first; and its gain."""
    g, h, n = (np.concatenate([[0.0], np.cumsum(x)]) for x in (gradient, curvature, counts))

    def best(lo: int, hi: int) -> tuple[float, int]:
        cut = np.arange(lo + 1, hi)
        worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + SHRINK)
        if not len(cut):
            return 0.0, lo
        gain = worth(lo, cut) + worth(cut, hi) - worth(lo, hi)
        gain[(n[cut] - n[lo] < LEAST) | (n[hi] - n[cut] < LEAST)] = 0
        k = int(gain.argmax())
        return float(gain[k]), int(cut[k])

    leaves, total = [(0, len(gradient))], 0.0
    while len(leaves) < LEAVES:
        gain, cut, leaf = max((*best(*x), x) for x in leaves)
        if gain <= 1e-9:
            break
        leaves.remove(leaf)
        leaves += [(leaf[0], cut), (cut, leaf[1])]
        total += gain
    out = np.zeros(len(gradient))
    for lo, hi in leaves:
        out[lo:hi] = (g[hi] - g[lo]) / (h[hi] - h[lo] + SHRINK)
    return out, total


def _cross(gradient: np.ndarray, curvature: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Values per cell of a tree that cuts both features once (four leaves), and its gain."""
    def corner(x):
        return np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1)

    g, h, n = corner(gradient), corner(curvature), corner(counts)
    quarters = []
    for c in (g, h, n):
        a = c[1:-1, 1:-1]
        quarters.append((a, c[1:-1, -1:] - a, c[-1:, 1:-1] - a, c[-1, -1] - c[1:-1, -1:] - c[-1:, 1:-1] + a))
    if not quarters[0][0].size:
        return np.zeros_like(gradient), 0.0
    gain = sum(q ** 2 / (r + SHRINK) for q, r in zip(quarters[0], quarters[1]))
    gain = np.where(np.minimum.reduce([*quarters[2]]) < LEAST, -1.0, gain)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[i, j] <= 0:
        return np.zeros_like(gradient), 0.0
    value = [q[i, j] / (r[i, j] + SHRINK) for q, r in zip(quarters[0], quarters[1])]
    out = np.empty_like(gradient)
    out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = value
    return out, float(gain[i, j] - g[-1, -1] ** 2 / (h[-1, -1] + SHRINK))


def fit(values: np.ndarray, labels: np.ndarray) -> Model:
    """Values in any order of rows give the same model."""
    if not len(labels):
        return Model()
    order = np.lexsort((*values.T, labels))
    values, labels = values[order], labels[order].astype(float)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    model = Model(float(np.log(share / (1 - share))))
    model.edges = [np.unique(np.quantile(values[:, k], np.arange(1, BINS) / BINS)) for k in range(values.shape[1])]
    at = _bins(values, model.edges)
    widths = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(w) for w in widths]
    counts = [np.bincount(at[:, k], minlength=w).astype(float) for k, w in enumerate(widths)]
    raw = np.full(len(labels), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-raw))
        return labels - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, w in enumerate(widths):
            g, h = slopes()
            step, _ = _tree(np.bincount(at[:, k], g, w), np.bincount(at[:, k], h, w), counts[k])
            model.tables[k] += RATE * step
            raw += RATE * step[at[:, k]]
    cells = {}
    for i, j in combinations(range(len(widths)), 2):
        cells[i, j] = at[:, i] * widths[j] + at[:, j]

    def square(i, j, x=None):
        return np.bincount(cells[i, j], x, widths[i] * widths[j]).astype(float).reshape(widths[i], widths[j])

    g, h = slopes()
    gains = sorted(((_cross(square(i, j, g), square(i, j, h), square(i, j))[1], i, j) for i, j in cells), reverse=True)
    model.pairs = [(i, j, np.zeros((widths[i], widths[j]))) for gain, i, j in gains[:PAIRS] if gain > 0]
    held = [square(i, j) for i, j, _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j, table), n in zip(model.pairs, held):
            g, h = slopes()
            step, _ = _cross(square(i, j, g), square(i, j, h), n)
            table += RATE * step
            raw += RATE * step[at[:, i], at[:, j]]
    return model


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from at most about ``rows`` labelled documents that are not held out."""
    marked = (labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("double").alias("q"))
              .where(F.col("q").isNotNull() & (remainder(F.col("id")) != 0))
              .groupBy("id").agg(F.round(F.avg("q")).cast("int").alias("label")))
    marked = stored(marked, "quality-labels")
    share = min(1.0, rows / max(1, marked.count()))
    draw = F.xxhash64(F.lit("train"), "id").bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    chosen = F.broadcast(marked.where(draw < share))         # about `rows` ids
    texts = (docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
             .join(chosen, "id").select("label", "text"))

    def run(batches):
        for batch in batches:
            values = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64()))],
                                             ["label", "values"])

    found = arrow_map(texts, run, "label int, values array<double>").collect()
    values = np.array([r["values"] for r in found]).reshape(len(found), len(FEATURES))
    return fit(values, np.array([r["label"] for r in found]))


def _scores(texts: list, model: Model) -> np.ndarray:
    return model.score(np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1).to_pylist(), model))],
                                             ["doc_id", "score"])

    scored = arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run,
                       "doc_id long, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model does not reject."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at).to_pylist(), model) >= threshold))

    return arrow_map(docs, run, docs.schema)
