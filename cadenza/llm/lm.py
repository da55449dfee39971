"""LM scoring: stupid backoff over count tables that are partitioned by hash.

Counts cover all documents, all words and all pairs, whatever their number. The table of pairs is partitioned by the hash of the pair,
that of words by the hash of the word. The documents scored are in the counts, so a document is no evidence for itself: a pair that occurs
elsewhere too (count(pair) above the document's own) scores count(pair) / count(first word), any other backs off to `BACKOFF` *
count(second word) / tokens. Each document's pairs, exploded and counted, go to the pairs' partitions and are joined to the
counts there; the word whose count a pair asks for goes on to the words' partitions and is joined there; both are summed by
document. A document's score is the mean log10 over its words (its first word counts as a back-off from nothing: count / tokens).

Words that make up at least one of 2**20 tokens (so there are at most 2**20 of them, whatever the corpus) have short ids and
their counts go to the tasks, which only saves shuffling: a pair of two such words takes 6 bytes and asks for no word count.
All other words go by their 64-bit hash.

A task packs its documents' pairs by partition into arrays, so the shuffle moves about 10 bytes
for each distinct pair of a document. There is a partition for each `PART_TOKENS` tokens. Pairs of two common words, which
would come from nearly all documents to one partition, are counted beforehand (`CommonPairs`) and scored where they are.

Defined cases: null and empty texts have no words and a null score; repeated rows are counted and scored each; a null doc_id is carried as it is; an empty
table gives no rows. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import keep
from ._text import ALNUM, Words, mix, slices, strings, tidy, words

VOCABULARY = 1 << 20
BACKOFF = 0.4
#: Words with at least this share of all tokens (1 / COMMON) are common.
COMMON = 1024
#: Tokens that a partition of the pair table is made for.
PART_TOKENS = 1 << 20
#: Tokens that a partition of the table of rare words is made for.
WORD_TOKENS = 4 << 20
#: Bytes of text whose pairs are packed together.
PACK_BYTES = 8 << 20


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows word (hash), n: how often each word occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = strings(batch.column(0))
            for lo, hi in slices(column, PACK_BYTES):
                found = [np.zeros(0, np.uint64)]
                part = column.slice(lo, hi - lo)
                found += [words(part.slice(a, b - a), ALNUM).hash for a, b in slices(part)]
                word, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(tidy(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Sorted hashes of frequent words with counts; the id of a word is its place plus 1, 0 for a word that goes by its hash."""

    def __init__(self, word: np.ndarray, n: np.ndarray, tokens: int):
        order = np.argsort(word, kind="stable")
        self.word, self.tokens = word[order], tokens
        self.count = np.concatenate([[0], n[order]]).astype(np.float64)

    def ids(self, word: np.ndarray) -> np.ndarray:
        if not len(self.word):
            return np.zeros(len(word), np.int64)
        at = np.minimum(np.searchsorted(self.word, word), len(self.word) - 1)
        return np.where(self.word[at] == word, at + 1, 0)


def vocabulary(docs: DataFrame, most: int = VOCABULARY) -> tuple[Vocabulary, DataFrame]:
    """The frequent words, and rows word, n of all others."""
    counts = keep(word_counts(docs), "words")
    tokens = int(counts.agg(F.sum("n")).first()[0] or 0)
    # Words with a share of 1 / most or more: at most `most` of them.
    frequent = F.col("n") * F.lit(most) >= F.lit(tokens)
    often = counts.where(frequent).toArrow()
    return Vocabulary(often["word"].to_numpy().view(np.uint64), often["n"].to_numpy(), tokens), counts.where(~frequent)


#: Kinds of rows: a pack's ids and lengths, pairs of ids, pairs of hashes, words whose counts are asked for, counts of words, sums.
HEAD, IDS, HASHES, ASKED, COUNTS, SUMS = range(6)
_PACK = "kind int, part int, pack long, doc binary, key binary, n binary"
_KINDS = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3)
_NAMES = ["kind", "part", "pack", "doc", "key", "n"]


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)]


def _dealt(where: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """The partitions that occur, each with the places of its entries."""
    order = np.argsort(where, kind="stable")
    cut = np.searchsorted(where[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut)):
        yield int(p), order[cut[p] : cut[p + 1]]


def _asked(pack: np.ndarray, doc: np.ndarray, word: np.ndarray, n: np.ndarray, parts: int) -> list[tuple]:
    """Rows for the words' partitions: the log10 count of `word`, n times, belongs to document `doc` of `pack`."""
    return [
        (ASKED, p, -1, doc[own].astype(np.uint32).tobytes(), word[own].tobytes() + pack[own].astype(np.int64).tobytes(), n[own].astype(np.int64).tobytes())
        for p, own in _dealt((mix(word) % np.uint64(parts)).astype(np.int64), parts)
    ]


def _counted(pairs: tuple[np.ndarray, ...], docs: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """Distinct pairs of each document (a pair is one or more numbers), the documents, and how often each occurs there."""
    order = np.lexsort((docs, *pairs[::-1]))
    columns = [x[order] for x in (*pairs, docs)]
    first = np.ones(len(docs), bool)
    first[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    begin = np.flatnonzero(first)
    return tuple(x[begin] for x in columns[:-1]), columns[-1][begin], np.diff(np.append(begin, len(docs)))


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first) + second)


def _pair_keys(w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair of neighbouring words: the place of its first word, both ids as one number, and the text it is in."""
    if len(at) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = w.text_of()
    place = np.flatnonzero(text[1:] == text[:-1])
    return place, (at[place] << 21) | at[place + 1], text[place]


class Scorer:
    """Scores of pairs of frequent words whose counts are known; `own` is how often the pair occurs in the document."""

    def __init__(self, known: Vocabulary):
        self.count, self.tokens = known.count, known.tokens

    def __call__(self, pairs: np.ndarray, counts: np.ndarray, own: np.ndarray) -> np.ndarray:
        first, second = self.count[pairs >> 21], self.count[pairs & ((1 << 21) - 1)]
        return np.log10(np.where(counts > own, counts / first, BACKOFF * second / self.tokens))


class CommonPairs:
    """Counts of the pairs of two common words (each a share of 1 / COMMON of all tokens or more; COMMON ** 2 pairs at most).

    Their entries would fill partitions as one document after the other has them, so they are counted where
    they are and their counts go to the tasks.
    """

    def __init__(self, docs: DataFrame, known: Vocabulary):
        hot = known.count * COMMON >= max(known.tokens, 1)
        hot[0] = False

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for batch in batches:
                column = strings(batch.column(0))
                for lo, hi in slices(column, PACK_BYTES):
                    part = column.slice(lo, hi - lo)
                    keys = [found]
                    for a, b in slices(part):
                        w = words(part.slice(a, b - a), ALNUM)
                        _, pairs, _ = _pair_keys(w, known.ids(w.hash))
                        keys.append(pairs[hot[pairs >> 21] & hot[pairs & ((1 << 21) - 1)]])
                    more = np.concatenate(keys)
                    weight = np.concatenate([n, np.ones(len(more) - len(n), np.int64)])
                    found, at = np.unique(more, return_inverse=True)
                    n = np.bincount(at, weight, len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["pair", "n"])

        rows = docs.select(F.col("text").cast("string")).mapInArrow(tidy(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        got = rows.toArrow()
        pair, n = got["pair"].to_numpy(), got["n"].to_numpy()
        order = np.argsort(pair)
        self.hot, self.pair, self.n = hot, pair[order], n[order]


def _packs(docs: DataFrame, known: Vocabulary, common: CommonPairs, parts: int, word_parts: int) -> DataFrame:
    """For each pack of documents a row with ids, lengths and what is scored already, and rows for the partitions its pairs and first words go to."""
    score = Scorer(known)

    def pack(ids: pa.Array, texts: pa.Array, number: int) -> pa.RecordBatch:
        done = np.zeros(len(texts))
        none, many = (np.zeros(0, np.int64), np.zeros(0, np.uint64)), []
        pair, doc = [none[0]], [none[0]]
        first, second, rare_doc = [none[1]], [none[1]], [none[0]]
        begins, begins_doc = [none[1]], [none[0]]
        for a, b in slices(texts):
            w = words(texts.slice(a, b - a), ALNUM)
            at = known.ids(w.hash)
            own = np.diff(w.at)
            many.append(own)
            full = np.flatnonzero(own)
            start = w.at[:-1][full]
            rare = at[start] == 0
            done[a + full] = np.log10(np.where(rare, 1, known.count[at[start]]) / known.tokens)
            begins.append(w.hash[start[rare]])
            begins_doc.append(full[rare] + a)
            place, keys, text = _pair_keys(w, at)
            hot = common.hot[keys >> 21] & common.hot[keys & ((1 << 21) - 1)]
            (often,), own_doc, n = _counted((keys[hot],), text[hot])
            done[a:b] += np.bincount(own_doc, score(often, common.n[np.searchsorted(common.pair, often)], n) * n, b - a)
            rare = (at[place] == 0) | (at[place + 1] == 0)
            pair.append(keys[~hot & ~rare])
            doc.append(text[~hot & ~rare] + a)
            first.append(w.hash[place[rare]])
            second.append(w.hash[place[rare] + 1])
            rare_doc.append(text[rare] + a)
        length = np.concatenate(many) if many else np.zeros(0, np.int64)
        known_ids = np.array(ids.is_valid())
        raw = ids.fill_null(0).to_numpy(zero_copy_only=False)
        # The pack's own row goes to a partition beside those of the pairs.
        rows = [(HEAD, parts + number % parts, number, raw.tobytes() + known_ids.tobytes(), done.tobytes(), length.astype(np.int64).tobytes())]
        (pairs,), docs_, n = _counted((np.concatenate(pair),), np.concatenate(doc))
        for p, own in _dealt((mix(pairs.view(np.uint64)) % np.uint64(parts)).astype(np.int64), parts):
            low, high = (pairs[own] & 0xFFFFFFFF).astype(np.uint32), (pairs[own] >> 32).astype(np.uint16)
            rows.append((IDS, p, number, docs_[own].astype(np.uint32).tobytes(), low.tobytes() + high.tobytes(), n[own].astype(np.uint32).tobytes()))
        (one, two), docs_, n = _counted((np.concatenate(first), np.concatenate(second)), np.concatenate(rare_doc))
        for p, own in _dealt((_pair_hash(one, two) % np.uint64(parts)).astype(np.int64), parts):
            rows.append((HASHES, p, number, docs_[own].astype(np.uint32).tobytes(), one[own].tobytes() + two[own].tobytes(), n[own].astype(np.uint32).tobytes()))
        word, docs_ = np.concatenate(begins), np.concatenate(begins_doc)
        for kind, p, *rest in _asked(np.full(len(word), number), docs_, word, np.ones(len(word), np.int64), word_parts):
            rows.append((kind, parts + p, *rest))
        return pa.RecordBatch.from_arrays(_columns(rows), _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32  # the same when the task runs again
        for batch in batches:
            texts = strings(batch.column(1))
            for lo, hi in slices(texts, PACK_BYTES):
                yield pack(batch.column(0).slice(lo, hi - lo), texts.slice(lo, hi - lo), number)
                number += 1

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), _PACK)


def _summed(part: int, pack: int, doc: np.ndarray, value: np.ndarray) -> tuple:
    own, where = np.unique(doc, return_inverse=True)
    return (SUMS, part, pack, own.astype(np.uint32).tobytes(), np.bincount(where, value, len(own)).tobytes(), b"")


def _join_pairs(known: Vocabulary, parts: int, word_parts: int) -> Callable[[pa.Table], pa.Table]:
    """One partition of pairs: its count table, joined to the documents' pairs; gives sums by pack and document, and words whose counts are still asked for."""
    scorer = Scorer(known)

    def ids(rows: list[dict], part: int) -> list[tuple]:
        keys, docs, n = [], [], []
        for r in rows:
            m = len(r["doc"]) // 4
            low = np.frombuffer(r["key"], np.uint32, m).astype(np.int64)
            keys.append(low | np.frombuffer(r["key"], np.uint16, m, 4 * m).astype(np.int64) << 32)
            docs.append(np.frombuffer(r["doc"], np.uint32))
            n.append(np.frombuffer(r["n"], np.uint32))
        pair, at = np.unique(np.concatenate(keys), return_inverse=True)
        weight = np.concatenate(n).astype(np.float64)
        count = np.bincount(at, weight, len(pair))[at]
        value = scorer(pair[at], count, weight) * weight
        cuts = np.split(value, np.cumsum([len(d) for d in docs])[:-1])
        return [_summed(part, r["pack"], d, v) for r, d, v in zip(rows, docs, cuts, strict=True)]

    def hashes(rows: list[dict], part: int) -> list[tuple]:
        docs = [np.frombuffer(r["doc"], np.uint32) for r in rows]
        first = np.concatenate([np.frombuffer(r["key"], np.uint64, len(d)) for r, d in zip(rows, docs, strict=True)])
        second = np.concatenate([np.frombuffer(r["key"], np.uint64, len(d), 8 * len(d)) for r, d in zip(rows, docs, strict=True)])
        weight = np.concatenate([np.frombuffer(r["n"], np.uint32) for r in rows]).astype(np.int64)
        pair, at = np.unique(_pair_hash(first, second), return_inverse=True)
        count = np.bincount(at, weight, len(pair))[at]
        seen = count > weight
        # What a pair scores besides the count of one of its words.
        value = np.log10(np.where(seen, count, BACKOFF / known.tokens))
        word, sign = np.where(seen, first, second), np.where(seen, -1, 1)
        number = known.ids(word)
        here = number > 0
        value[here] += sign[here] * np.log10(known.count[number[here]])
        pack = np.repeat([r["pack"] for r in rows], [len(d) for d in docs])
        cuts = np.split(value * weight, np.cumsum([len(d) for d in docs])[:-1])
        out = [_summed(part, r["pack"], d, v) for r, d, v in zip(rows, docs, cuts, strict=True)]
        return out + _asked(pack[~here], np.concatenate(docs)[~here], word[~here], (sign * weight)[~here], word_parts)

    def join(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        if part >= parts:
            asked = table["kind"].to_numpy() == ASKED
            own = np.where(asked, part - parts, part)
            return table.set_column(1, "part", pa.array(own, pa.int32()))
        rows, out = table.to_pylist(), []
        for kind, run in ((IDS, ids), (HASHES, hashes)):
            if own := [r for r in rows if r["kind"] == kind]:
                out += run(own, part)
        return pa.Table.from_arrays(_columns(out), names=_NAMES)

    return join


def _count_rows(rare: DataFrame, parts: int) -> DataFrame:
    """The table of rare words, packed for its partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            where = (mix(word) % np.uint64(parts)).astype(np.int64)
            rows = [(COUNTS, p, -1, b"", word[own].tobytes(), n[own].tobytes()) for p, own in _dealt(where, parts)]
            yield pa.RecordBatch.from_arrays(_columns(rows), _NAMES)

    return rare.select("word", "n").mapInArrow(tidy(run), _PACK)


def _join_words(table: pa.Table) -> pa.Table:
    """One partition of rare words: its counts, joined to those asked for and summed by pack and document."""
    part, rows = table["part"][0].as_py(), table.to_pylist()
    asked = [r for r in rows if r["kind"] == ASKED]
    if not asked:
        return pa.Table.from_arrays(_columns([]), names=_NAMES)
    word, count = (np.concatenate([np.frombuffer(r[c], kind) for r in rows if r["kind"] == COUNTS]) for c, kind in (("key", np.uint64), ("n", np.int64)))
    order = np.argsort(word)
    word, count = word[order], count[order]
    size = [len(r["doc"]) // 4 for r in asked]
    doc = np.concatenate([np.frombuffer(r["doc"], np.uint32) for r in asked])
    want = np.concatenate([np.frombuffer(r["key"], np.uint64, m) for r, m in zip(asked, size, strict=True)])
    pack = np.concatenate([np.frombuffer(r["key"], np.int64, m, 8 * m) for r, m in zip(asked, size, strict=True)])
    n = np.concatenate([np.frombuffer(r["n"], np.int64) for r in asked])
    # The same order, and so the same sum to the last bit, however the rows came.
    order = np.lexsort((n, want, doc, pack))
    doc, want, pack, n = doc[order], want[order], pack[order], n[order]
    value = n * np.log10(count[np.searchsorted(word, want)])
    begin = np.flatnonzero(np.append(True, pack[1:] != pack[:-1]))
    out = [_summed(part, int(pack[a]), doc[a:b], value[a:b]) for a, b in zip(begin, np.append(begin[1:], len(pack)), strict=True)]
    return pa.Table.from_arrays(_columns(out), names=_NAMES)


def score_documents(docs: DataFrame, most: int = VOCABULARY) -> DataFrame:
    """Rows doc_id, n_words, log10_sum, score (the mean log10; null without words). `most` bounds the words that go by short ids."""
    known, rare = vocabulary(docs, most)
    parts = max(16, -(-known.tokens // PART_TOKENS))
    word_parts = min(parts, max(16, -(-known.tokens // WORD_TOKENS)))

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["kind"] == HEAD)
        total, length = np.frombuffer(head["key"]).copy(), np.frombuffer(head["n"], np.int64)
        ids = np.frombuffer(head["doc"], np.int64, len(length))
        valid = np.frombuffer(head["doc"], bool, len(length), 8 * len(length))
        for r in sorted((r for r in rows if r["kind"] == SUMS), key=lambda r: (r["part"], len(r["doc"]), r["doc"], r["key"])):
            np.add.at(total, np.frombuffer(r["doc"], np.uint32), np.frombuffer(r["key"]))
        empty = length == 0
        return pa.table(
            {
                "doc_id": pa.array(ids, mask=~valid),
                "n_words": pa.array(length),
                "log10_sum": pa.array(total, mask=empty),
                "score": pa.array(total / np.maximum(length, 1), mask=empty),
            }
        )

    packed = _packs(docs, known, CommonPairs(docs, known), parts, word_parts)
    joined = keep(packed.groupBy("part").applyInArrow(_join_pairs(known, parts, word_parts), _PACK), "pairs")
    asked = joined.where(F.col("kind") == ASKED).unionByName(_count_rows(rare, word_parts))
    summed = joined.where(F.col("kind") != ASKED).unionByName(asked.groupBy("part").applyInArrow(_join_words, _PACK))
    return summed.groupBy("pack").applyInArrow(add, "doc_id long, n_words long, log10_sum double, score double")
