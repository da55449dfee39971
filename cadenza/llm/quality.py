"""Quality classifier: a generalised additive model with pairwise interactions.

Each text is described by a few numbers (`FEATURES`), cut into bins at quantiles of the
training rows. Boosting goes round the features: a shallow tree on the bins of one
feature at a time takes a small step on the logistic loss, and its leaves are added to the feature's lookup table. Then the
pairs of features whose best four-way cut gains most on what is left get a table each, boosted
the same way with trees of two cuts. A score is the sum of table entries at the text's bins: one
vectorised lookup and addition per table.

The fit takes at most `SAMPLE` labelled rows (those with the smallest hash of their id); scoring is a narrow stage over whole texts.

Defined cases: null and empty texts have all features 0 and score like any other text; rows with a null label or id don't
train; without rows to train on every score is 0.5; repeated rows each get a score. Other columns
are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import NONSPACE, slices, strings, text_bytes, tidy, words
from .toxicity import in_fold, labelled_rows

#: Labelled rows that training takes at most.
SAMPLE = 20000
BINS = 32
COARSE = 12
ROUNDS, PAIR_ROUNDS, PAIRS = 200, 100, 8
RATE = 0.1
FEATURES = (
    "words", "word length", "upper case", "symbols", "digits", "stops", "line length", "distinct words", "distinct lines",
    "one-byte words", "non-ASCII", "words with symbols", "longest word", "word repeats previous",
)

_UPPER, _SYMBOL, _DIGIT, _STOP, _LINE, _HIGH = (np.zeros(256, bool) for _ in range(6))
_UPPER[65:91] = True
_SYMBOL[[ord(c) for c in "#$%&*|!~^@<>{}[]=+\\_"]] = True
_DIGIT[48:58] = True
_STOP[[ord(c) for c in ".,;:?"]] = True
_LINE[10] = True
_HIGH[128:] = True


def describe(column: pa.Array) -> np.ndarray:
    """A row of features for each text."""
    out = [np.zeros((0, len(FEATURES)))]
    for lo, hi in slices(column):
        part = column.slice(lo, hi - lo)
        raw, at = text_bytes(part)
        w = words(part, NONSPACE)
        n = np.maximum(np.diff(at), 1)
        many = np.diff(w.at)
        some = np.maximum(many, 1)

        def share(mark: np.ndarray, raw=raw, at=at) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(mark[raw])])
            return sums[at[1:]] - sums[at[:-1]]

        def of_words(x: np.ndarray, w=w) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(x)])
            return sums[w.at[1:]] - sums[w.at[:-1]]

        size = w.end - w.start
        marks = np.concatenate([[0], np.cumsum(_SYMBOL[raw])])
        again = np.zeros(len(w.hash), bool)
        again[1:] = w.hash[1:] == w.hash[:-1]
        longest = np.zeros(len(many))
        full = many > 0
        if full.any():
            longest[full] = np.maximum.reduceat(size, w.at[:-1][full])
        distinct = np.array([len(np.unique(w.hash[a:b])) for a, b in zip(w.at[:-1], w.at[1:], strict=True)])
        lines = [t.split("\n") for t in part.to_pylist()]
        out.append(
            np.column_stack(
                [
                    np.log1p(many),
                    of_words(size) / some,
                    share(_UPPER) / n,
                    share(_SYMBOL) / n,
                    share(_DIGIT) / n,
                    share(_STOP) / n,
                    np.log1p(n / (share(_LINE) + 1)),
                    distinct / some,
                    [len(set(x)) / len(x) for x in lines],
                    of_words(size == 1) / some,
                    share(_HIGH) / n,
                    of_words(marks[w.end] > marks[w.start]) / some,
                    np.log1p(longest),
                    of_words(again) / some,
                ]
            )
        )
    return np.concatenate(out)


def _leaves(g: np.ndarray, h: np.ndarray, cuts: int = 2) -> np.ndarray:
    """The values of a tree with up to `cuts` cuts over ordered bins with gradients g and weights h."""
    begin, end = [0], [len(g)]
    for _ in range(cuts):
        best, at = 1e-9, None
        for a, b in zip(begin, end, strict=True):
            left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            all_g, all_h = g[a:b].sum(), h[a:b].sum()
            gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
            if len(gain) and gain.max() > best:
                best, at = gain.max(), a + 1 + int(gain.argmax())
        if at is None:
            break
        begin, end = sorted([*begin, at]), sorted([*end, at])
    value = np.zeros(len(g))
    for a, b in zip(begin, end, strict=True):
        value[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return value


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a table into four by a row and a column: its gain and values."""

    def corner(x: np.ndarray) -> list[np.ndarray]:
        c = x.cumsum(0).cumsum(1)
        a, top, left = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
        return [a, top - a, left - a, c[-1, -1] - top - left + a]

    parts = list(zip(corner(g), corner(h), strict=True))
    gain = sum(x * x / (y + 1) for x, y in parts)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    value = np.empty_like(g)
    for (x, y), rows, cols in zip(parts, (slice(i + 1), slice(i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(j + 1), slice(j + 1, None)) * 2, strict=True):
        value[rows, cols] = x[i, j] / (y[i, j] + 1)
    return float(gain.max() - g.sum() ** 2 / (h.sum() + 1)), value


class Model:
    def __init__(self, bias: float, edges: list[np.ndarray], tables: list[np.ndarray], coarse: list[np.ndarray], pairs: dict):
        self.bias, self.edges, self.tables, self.coarse, self.pairs = bias, edges, tables, coarse, pairs

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)]
        logit = np.full(len(x), self.bias)
        for b, t in zip(bins, self.tables, strict=True):
            logit += t[b]
        for (i, j), t in self.pairs.items():
            logit += t[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    width = len(FEATURES)
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) if len(x) else np.zeros(0) for f in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    coarse = [(np.arange(len(e) + 1) * COARSE) // (len(e) + 1) for e in edges]
    if not len(y):
        return Model(0.0, edges, tables, coarse, {})
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(rate / (1 - rate)))
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    logit = np.full(len(y), bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(width):
            g, h = slopes()
            step = RATE * _leaves(np.bincount(bins[f], g, len(tables[f])), np.bincount(bins[f], h, len(tables[f])))
            tables[f] += step
            logit += step[bins[f]]
    low = [c[b] for c, b in zip(coarse, bins, strict=True)]

    def grid(i: int, j: int, z: np.ndarray) -> np.ndarray:
        return np.bincount(low[i] * COARSE + low[j], z, COARSE * COARSE).reshape(COARSE, COARSE)

    g, h = slopes()
    ranked = sorted(combinations(range(width), 2), key=lambda p: (-_quarters(grid(*p, g), grid(*p, h))[0], p))
    pairs = {p: np.zeros((COARSE, COARSE)) for p in ranked[:PAIRS]}
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in pairs.items():
            g, h = slopes()
            step = RATE * _quarters(grid(i, j, g), grid(i, j, h))[1]
            t += step
            logit += step[low[i], low[j]]
    return Model(bias, edges, tables, coarse, pairs)


def train(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, most: int = SAMPLE) -> Model:
    """A model of labels.quality, fitted without the rows whose id's crc32 leaves `held`."""
    width = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = describe(strings(batch.column(2)))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), flat], ["h", "id", "label", "x"])

    # Only features come to the driver, `most` rows of them.
    rows = labelled_rows(docs, labels, "quality", ~in_fold("_id", parts, held), most)
    found = rows.mapInArrow(tidy(run), "h long, id long, label int, x array<double>").orderBy("h", "id", "x").limit(most).toArrow()
    x = found["x"].combine_chunks().values.to_numpy().reshape(-1, width) if len(found) else np.zeros((0, width))
    return fit(x, found["label"].to_numpy().astype(np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows doc_id, score: the probability of label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.predict(describe(strings(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, score double")
