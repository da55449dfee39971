"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is spelled with its boundaries and cut into character n-grams; the n-grams of `NGRAMS` bytes and the word itself each hash
to one of `BUCKETS` embeddings. A text is the mean of its words' mean embeddings; a linear softmax
over it gives the classes. Embeddings and softmax learn together by Adagrad. A misspelled word
shares most n-grams, and so its vector, with the words seen in training.

The fit takes at most `SAMPLE` labelled rows (those with the smallest hash of their id, so any
row has the same chance); of a text it takes every word. Scoring visits every text
once, in a narrow stage.

Defined cases: a null or empty text, or one without words, scores as the bias alone says; rows
with a null label or id don't train; without any rows to train on all scores are 0; repeated rows each get a score. Other columns are carried
or ignored, never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import Words, mix, release, short_powers, slices, strings, tidy, words

#: Labelled rows that training takes at most.
SAMPLE = 5000
BUCKETS = 1 << 16
DIM = 8
NGRAMS = (3, 4)
EPOCHS = 12
#: Bytes of text that are cut into subwords at once.
FIT_BYTES = 1 << 18
RATE = 0.5
#: Texts that a bucket must be in to count.
LEAST_TEXTS = 3
#: What squared slopes start from: keeps rare buckets from leaping.
DAMP = 1e-2
SEED = 17
#: Score from which a text counts as toxic.
THRESHOLD = 0.3


def in_fold(doc_id: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves `part` when divided by `parts`."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part


def subwords(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's n-grams and of the word itself, and the word of each."""
    up, down = short_powers(len(w.data) + 1)
    sums = np.zeros(len(w.data) + 1, np.uint64)
    np.cumsum((w.data.astype(np.uint64) + np.uint64(1)) * up[: len(w.data)], out=sums[1:])
    buckets, owner = [w.hash % np.uint64(BUCKETS)], [np.arange(len(w.hash))]
    size = w.end - w.start
    for n in NGRAMS:
        many = np.maximum(size - n + 1, 0)
        own = np.repeat(np.arange(len(size)), many)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
        at = w.start[own] + nth
        edge = (nth == 0).astype(np.uint64) + np.uint64(2) * (nth == many[own] - 1).astype(np.uint64)
        gram = mix((sums[at + n] - sums[at]) * down[at] + np.uint64(n * 8) + edge)
        buckets.append(gram % np.uint64(BUCKETS))
        owner.append(own)
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owner)


class Model:
    """logit(text) = bias + mean over words of the mean over subwords of a score by bucket."""

    def __init__(self, score: np.ndarray, bias: float):
        self.score, self.bias = score.astype(np.float32), float(bias)

    def predict(self, column: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for lo, hi in slices(column, FIT_BYTES):
            w = words(column.slice(lo, hi - lo))
            bucket, owner = subwords(w)
            each = np.bincount(owner, self.score[bucket], len(w.hash)) / np.maximum(np.bincount(owner, minlength=len(w.hash)), 1)
            sums = np.concatenate([[0], np.cumsum(each)])
            many = np.diff(w.at)
            logit = self.bias + (sums[w.at[1:]] - sums[w.at[:-1]]) / np.maximum(many, 1)
            out.append(1 / (1 + np.exp(-np.clip(logit, -500, 500))))
        return np.concatenate(out)


def _sums(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that start at `begin`; an empty run sums to 0."""
    total = np.zeros((len(begin), x.shape[1]), x.dtype)
    full = np.flatnonzero(np.diff(np.append(begin, len(x))) > 0)
    if len(full):
        total[full] = np.add.reduceat(x, begin[full])
    return total


@dataclass
class _Batch:
    """Some texts' sparse rows, and the same entries by bucket."""

    own: slice
    col: np.ndarray
    val: np.ndarray
    many: np.ndarray
    used: np.ndarray
    order: np.ndarray
    bound: np.ndarray

    @staticmethod
    def of(a: int, b: int, at: np.ndarray, col: np.ndarray, val: np.ndarray) -> _Batch:
        c = col[at[a] : at[b]]
        order = np.argsort(c, kind="stable").astype(np.int32)
        used, bound = np.unique(c[order], return_index=True)
        return _Batch(slice(a, b), c, val[at[a] : at[b]], np.diff(at[a : b + 1]), used, order, bound.astype(np.int32))


def fit(texts: pa.Array, labels: np.ndarray, dim: int = DIM, epochs: int = EPOCHS) -> Model:
    """Joint training; each text is a sparse row of bucket weights that sum to 1."""
    if not len(labels):
        return Model(np.zeros(BUCKETS), -1e3)
    rng = np.random.default_rng(SEED)
    column = strings(texts)
    many, cols, vals = [], [], []
    small = np.min_scalar_type(BUCKETS - 1)
    held = np.zeros(BUCKETS, np.int64)
    for lo, hi in slices(column, FIT_BYTES):
        w = words(column.slice(lo, hi - lo))
        bucket, owner = subwords(w)
        doc = w.text_of()[owner]
        weight = 10 / np.bincount(owner, minlength=len(w.hash))[owner] / np.diff(w.at)[doc]
        key, at = np.unique(doc * BUCKETS + bucket, return_inverse=True)
        many.append(np.bincount(key // BUCKETS, minlength=hi - lo))
        cols.append((key % BUCKETS).astype(small))
        vals.append(np.bincount(at, weight).astype(np.float32))
        held += np.bincount(cols[-1], minlength=BUCKETS)
    known = held >= LEAST_TEXTS  # what few texts have tells little about others
    for k in range(len(cols)):
        own = known[cols[k]]
        many[k] = np.bincount(np.repeat(np.arange(len(many[k])), many[k])[own], minlength=len(many[k]))
        cols[k], vals[k] = cols[k][own], vals[k][own]
    many = np.concatenate(many)
    col, cols = np.concatenate(cols), None
    val, vals = np.concatenate(vals), None
    del column, w, bucket, owner, doc, weight, key
    release()
    at = np.concatenate([[0], np.cumsum(many)])
    # The texts come in the order of a hash, so runs of them are random batches.
    bounds = [*range(0, len(texts), 64), len(texts)]
    batches = [_Batch.of(a, b, at, col, val) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    emb = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    soft = rng.normal(0, 0.3, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_e, seen_s, seen_b = (np.full(x.shape, DAMP, np.float32) for x in (emb, soft, bias))
    for epoch in range(epochs):
        rate = np.float32(RATE * (1 - epoch / epochs))
        for k in rng.permutation(len(batches)):
            x = batches[k]
            mean = _sums(emb[x.col] * x.val[:, None], np.cumsum(x.many) - x.many)
            logit = mean @ soft + bias
            logit -= logit.max(1, keepdims=True)
            prob = np.exp(logit)
            prob /= prob.sum(1, keepdims=True)
            prob[np.arange(len(prob)), labels[x.own]] -= 1
            back = prob @ soft.T
            g_emb = _sums((np.repeat(back, x.many, 0) * x.val[:, None])[x.order], x.bound)
            g_soft, g_bias = mean.T @ prob, prob.sum(0)
            seen_e[x.used] += g_emb * g_emb
            seen_s += g_soft * g_soft
            seen_b += g_bias * g_bias
            emb[x.used] -= rate * g_emb / np.sqrt(seen_e[x.used])
            soft -= rate * g_soft / np.sqrt(seen_s)
            bias -= rate * g_bias / np.sqrt(seen_b)
    emb[~known] = 0
    score = emb @ (soft[:, 1] - soft[:, 0]) * 10
    del batches, col, val, x
    release()
    return Model(score, bias[1] - bias[0])


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, use: Column, most: int) -> DataFrame:
    """Rows _h, _id, _text, _label of the labelled documents that `use` admits, the `most` ids of the smallest hash."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_label")).where(use & F.col("_label").isin(0, 1))
    known = known.groupBy("_id").agg(F.min("_label").alias("_label")).withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id").limit(most)
    own = docs.select(F.col("doc_id").alias("_doc"), F.col("text").cast("string").alias("_text"))
    joined = own.join(F.broadcast(known), F.col("_doc") == F.col("_id"))  # at most `most` ids
    return joined.select("_h", "_id", "_text", "_label")


def labelled(docs: DataFrame, labels: DataFrame, label: str, use: Column, most: int) -> tuple[pa.Array, np.ndarray]:
    """Texts and labels of at most `most` rows, in the order of the hash."""
    rows = labelled_rows(docs, labels, label, use, most).orderBy("_h", "_id", "_text").limit(most).toArrow()
    return strings(rows["_text"]), rows["_label"].to_numpy().astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, most: int = SAMPLE) -> Model:
    """A model of labels.toxic, fitted without the rows whose id's crc32 leaves `held`."""
    return fit(*labelled(docs, labels, "toxic", ~in_fold("_id", parts, held), most))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows doc_id, score: the probability of label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.predict(strings(batch.column(1))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The documents, with all their columns, that score below the threshold."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.predict(strings(batch.column(at))) < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
