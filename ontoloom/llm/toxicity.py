"""Toxicity scores from the nearest labelled examples (operator 10).

A text is the TF-IDF vector, of length one, of all its words that some labelled example has: other
words can't add to a cosine. Document frequencies are counted over all documents. What a word weighs
beside them is learnt from the examples: its weight is multiplied by one more than the amount by
which its likelihood ratio of the two labels, either way, exceeds what chance gives one word in a
thousand (CHANCE), so that languages and topics count less than what the labels are about. No word
weighs nothing, and none is left out.

The score comes from the ``k`` examples with the largest exact cosine: each votes with the square of
its cosine, and votes become probabilities by isotonic regression over the examples, each of them
left out of its own vote. An example whose text is the row's own is never its neighbour.

The examples are searched with an inverted index whose postings are cut into blocks of examples, with
the largest weight of each word in each block. Blocks are visited in the order of their bounds until
no bound reaches the k-th best cosine; so the k best are exact.

Labels are learnt from a bounded sample: of the labelled documents those of ``max_examples`` whose
hashed doc_id is least; equal texts are one example, toxic if at least half of their labels are. All
else covers all rows. Texts without a known word (empty and null ones too) get the share of toxic ones
among such examples, drawn to that of all examples. Ties go to the earlier example of the index.
Repeated rows give repeated rows; an empty table gives an empty one; extra columns are ignored;
without any labelled example the score is 0.5. doc_id, lang and source are not inputs of a score.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import sliced, stored, text_key, text_or_empty, without_texts

_WORD = re.compile(r"[^\W\d_]+")
#: The value that a likelihood ratio with one degree of freedom passes by chance once in a thousand.
CHANCE = 10.83
#: Examples in a block of the index, queries in a batch, and the share of the examples above which a
#: word is a row of the matrix (so there are at most 16 times as many rows as an example has words).
_BLOCK, _BATCH, _SHARE = 64, 64, 1 / 16
_EVIDENCE = "array<struct<doc_id long, label int, cosine double>>"


def words_of(text: str) -> Counter:
    """The runs of letters of a text in lower case, and how often each occurs."""
    return Counter(_WORD.findall(text.lower()))


def likelihood_ratio(with_word: np.ndarray, sizes: tuple[int, int]) -> np.ndarray:
    """G² of words and labels: ``with_word`` has, for each label, how many examples have the word."""
    total, all_ = float(sum(sizes)), with_word.sum(0)
    out = np.zeros(with_word.shape[1])
    for own, size in zip(with_word, sizes):
        for seen, among in ((own, all_), (size - own, total - all_)):
            expected = among * size / total
            out += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-300)), 0)
    return out


class Numbers:
    """The known words of texts, as their places in ``words``."""

    def __init__(self, words: pa.Array):
        self.words = words

    def of(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(words, times) of each whole text; texts are looked up together."""
        parts = [_WORD.findall(t.lower()) for t in texts]
        place = pc.index_in(pa.array(list(chain.from_iterable(parts)), pa.string()), value_set=self.words).fill_null(-1).to_numpy()
        text = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        n, known = max(1, len(self.words)), place >= 0
        both, times = np.unique(text[known] * n + place[known].astype(np.int64), return_counts=True)
        text, word = np.divmod(both, n)
        edges = np.searchsorted(text, np.arange(1, len(texts)))
        return list(zip(np.split(word, edges), np.split(times, edges)))


def _runs(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """All numbers of the half-open ranges, one range after another."""
    n = stops - starts
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())


class Index:
    """Block-max inverted index over vectors given as (words, weights), words as numbers.

    Words that many examples have are kept as rows of a matrix, one weight for each example, and a
    batch of queries is multiplied with it; the others as postings, cut into blocks of examples, with
    the largest weight of each block. After the first step the k-th best sum so far bounds the k-th
    best cosine from below, and the largest sum in a block with the largest weights there of a
    query's other words bounds its cosines from above: only blocks that reach the former are visited.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_words: int, k: int, block: int = _BLOCK, share: float = _SHARE):
        self.k, self.block, self.size = k, block, len(vectors)
        word = np.concatenate([w for w, _ in vectors] or [np.zeros(0, np.int64)]).astype(np.int64)
        example = np.repeat(np.arange(len(vectors)), [len(w) for w, _ in vectors])
        weight = np.concatenate([x for _, x in vectors] or [np.zeros(0)])
        self.blocks = max(1, -(-len(vectors) // block))
        frequent = np.flatnonzero(np.bincount(word, minlength=n_words) > share * len(vectors))
        self.row = np.full(n_words, -1)
        self.row[frequent] = np.arange(len(frequent))
        self.matrix = np.zeros((len(frequent), self.blocks * block))
        dense = self.row[word] >= 0
        self.matrix[self.row[word[dense]], example[dense]] = weight[dense]
        word, example, weight = word[~dense], example[~dense], weight[~dense]
        order = np.lexsort((example, word))
        word, example, self.weight = word[order], example[order], weight[order]
        self.place = (example % block).astype(np.int32)
        # A cell: the postings of one word in one block.
        cell = word * self.blocks + example // block
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.start = np.append(first, len(cell))
        self.cell_block = (cell[first] % self.blocks).astype(np.int64)
        self.cell_max = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.cells = np.searchsorted(cell[first] // self.blocks, np.arange(n_words + 1))

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], without: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query (examples, cosines) of the k best with a cosine above zero, best first, as
        the examples' order has equal ones; the example in ``without`` is left out."""
        for low in range(0, len(queries), _BATCH):
            batch = queries[low : low + _BATCH]
            asked = np.zeros((len(batch), len(self.matrix)))
            for q, (words, weights) in enumerate(batch):
                row = self.row[words]
                asked[q, row[row >= 0]] = weights[row >= 0]
            for (words, weights), sums, own in zip(batch, asked @ self.matrix, without[low:]):
                rare = self.row[words] < 0
                yield self._nearest(words[rare], weights[rare], sums, own)

    def _nearest(self, words: np.ndarray, weights: np.ndarray, sums: np.ndarray, without: int) -> tuple[np.ndarray, np.ndarray]:
        if without >= 0:
            sums[without] = -np.inf
        kth = np.partition(sums, -self.k)[-self.k] if self.k < len(sums) else 0.0
        low, high = self.cells[words], self.cells[words + 1]
        cell, asked = _runs(low, high), np.repeat(weights, high - low)
        block = self.cell_block[cell]
        bound = sums.reshape(self.blocks, self.block).max(1) + np.bincount(block, asked * self.cell_max[cell], self.blocks)
        visit = bound >= max(kth - 1e-9, 0.0)
        wanted = visit[block]
        cell, asked = cell[wanted], asked[wanted]
        start, stop = self.start[cell], self.start[cell + 1]
        at, n = _runs(start, stop), stop - start
        slot = np.repeat(block[wanted] * self.block, n) + self.place[at]
        score = np.round(sums + np.bincount(slot, np.repeat(asked, n) * self.weight[at], len(sums)), 12)
        found = np.flatnonzero((score > 0) & (score >= kth - 1e-9) & np.repeat(visit, self.block))
        if len(found) > self.k:
            found = found[np.lexsort((found, -score[found]))[: self.k]]
        order = np.lexsort((found, -score[found]))
        return found[order], score[found[order]]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares non-decreasing fit (pool adjacent violators), drawn towards the
    middle by half an observation of each kind so that no value is 0 or 1."""
    pools: list[list[float]] = []  # sum of y, count, sum of x
    for a, b in sorted(zip(x.tolist(), y.tolist())):
        pools.append([b, 1.0, a])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, t = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2] + t]
    at = np.array([t / n for _, n, t in pools])
    return at, np.maximum.accumulate([(s + 0.5) / (n + 1) for s, n, _ in pools])


class Model:
    """What is learnt: of each example its text_key, doc_id, label, words and how often they occur; the
    words of all in order, and how many of ``n_docs`` documents have each."""

    def __init__(self, keys: list[bytes], doc_ids: list, toxic: np.ndarray, seen: list[np.ndarray], times: list[np.ndarray], words: pa.Array, df: np.ndarray, n_docs: int, k: int):
        self.words, n = words, len(words)
        self.prior = (toxic.sum() + 0.5) / (len(toxic) + 1)
        sizes = (int((~toxic).sum()), int(toxic.sum()))
        with_word = np.zeros((2, n))
        for own, bad in zip(seen, toxic):
            with_word[int(bad), own] += 1
        telling = likelihood_ratio(with_word, sizes) if min(sizes) else np.zeros(n)
        self.factor = (np.log((1 + n_docs) / (1 + df)) + 1) * (1 + np.maximum(0, telling - CHANCE))
        # Examples with the same most frequent word (so, mostly, language) and label lie together, which
        # makes the blocks' bounds tight. The order decides nothing else but ties.
        lead = [max(zip(t.tolist(), own.tolist()), default=(0, -1))[1] for own, t in zip(seen, times)]
        order = sorted(range(len(keys)), key=lambda i: (lead[i], bool(toxic[i]), keys[i]))
        self.label, self.doc_id = toxic[order].astype(float), [doc_ids[i] for i in order]
        self.own = {keys[i]: place for place, i in enumerate(order)}
        vectors = [self._weighted(seen[i], times[i]) for i in order]
        self.index = Index(vectors, n, k)
        bare = np.array([not len(w) for w, _ in vectors], bool)
        self.bare = (self.label[bare].sum() + self.prior) / (bare.sum() + 1)
        self.knots: tuple[np.ndarray, np.ndarray] | None = None
        told = [i for i in range(len(vectors)) if len(vectors[i][0])]
        if len(told) >= 50 and min(sizes):
            votes = np.array([self._vote(*near) for near in self.index.nearest([vectors[i] for i in told], told)])
            self.knots = isotonic(votes, self.label[told])

    def _weighted(self, words: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = (1 + np.log(times)) * self.factor[words]
        return words, weight / np.sqrt((weight * weight).sum()) if len(words) else weight

    def _vote(self, examples: np.ndarray, cosines: np.ndarray) -> float:
        power = cosines * cosines
        return float((power * self.label[examples]).sum() / power.sum()) if len(examples) else float(self.prior)

    def scores(self, texts: list[str], numbers: Numbers) -> Iterator[tuple[float, list[dict]]]:
        """Of each text the score and the three nearest examples."""
        if not self.own:
            yield from ((0.5, []) for _ in texts)
            return
        found = numbers.of(texts)
        queries = [self._weighted(words, times) for words, times in found]
        own = [self.own.get(hashlib.sha256(t.encode("utf-8", "replace")).digest(), -1) for t in texts]
        for (words, _), (near, cosines) in zip(found, self.index.nearest(queries, own)):
            if not len(words):
                yield float(self.bare), []
                continue
            vote = self._vote(near, cosines)
            if self.knots is not None:
                vote = float(np.interp(vote, *self.knots))
            yield vote, [{"doc_id": self.doc_id[e], "label": int(self.label[e]), "cosine": float(c)} for e, c in zip(near[:3], cosines[:3])]


def _examples(docs: DataFrame, labels: DataFrame, max_examples: int) -> tuple[list, list, np.ndarray, list, list, pa.Array]:
    """The sample, as ``Model`` takes it, and its words: at most ``max_examples`` texts'
    words go to the driver."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), text_key().alias("key"))
    # At most max_examples rows of two numbers are broadcast. An id may stand for many rows.
    rows = rows.join(F.broadcast(known), "doc_id")
    texts = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.avg("toxic").alias("toxic"), F.min("text").alias("text"))
    texts = stored(texts.orderBy("key").limit(max_examples), "examples")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            seen = [words_of(t) for t in batch.column(3).to_pylist()]
            words, times = pa.array([list(c) for c in seen], pa.list_(pa.string())), pa.array([list(c.values()) for c in seen], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], words, times], names=["key", "doc_id", "toxic", "words", "times"])

    table = texts.mapInArrow(count, "key binary, doc_id long, toxic double, words array<string>, times array<long>").toArrow().combine_chunks()
    keys, doc_ids, toxic, words, times = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns)
    coded = words.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    number = np.empty(len(names), np.int64)
    number[order] = np.arange(len(names))
    edges = np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))[:-1] if len(words) else []
    seen, often = np.split(number[coded.indices.to_numpy(zero_copy_only=False)], edges), np.split(times.flatten().to_numpy(), edges)
    seen, often = (seen, often) if len(words) else ([], [])
    return keys.to_pylist(), doc_ids.to_pylist(), toxic.to_numpy(zero_copy_only=False) >= 0.5, seen, often, pa.array([names[i] for i in order], pa.string())


def _document_frequencies(docs: DataFrame, words: pa.Array) -> tuple[np.ndarray, int]:
    """How many documents have each of ``words``, and how many documents there are."""
    spark, n = docs.sparkSession, len(words)
    shared = spark.sparkContext.broadcast(words)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, seen, rows = Numbers(shared.value), np.zeros(n + 1, np.int64), 0
        for batch in sliced(batches):
            rows += batch.num_rows
            found = [w for w, _ in numbers.of([t for t in batch.column(0).to_pylist() if t])]
            seen += np.bincount(np.concatenate(found), minlength=n + 1)
        seen[n] = rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["word", "n"])

    # Every task sends one row for each word it has met.
    counts = docs.select(F.col("text").cast("string")).mapInArrow(tally, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stored(counts, "document-frequencies").toArrow()
    shared.destroy()
    out = np.zeros(n + 1, np.int64)
    out[counts.column("word").to_numpy()] = counts.column("n").to_numpy()
    return out[:n], int(out[n])


def _scored(docs: DataFrame, labels: DataFrame, row: Column, kind: str, max_examples: int, k: int) -> DataFrame:
    """``row`` (of type ``kind``), score and evidence of every row."""
    *examples, words = _examples(docs, labels, max_examples)
    df, n_docs = _document_frequencies(docs, words) if len(words) else (np.zeros(0, np.int64), 0)
    shared = docs.sparkSession.sparkContext.broadcast(Model(*examples, words, df, n_docs, k))
    del examples, words
    told = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        numbers = Numbers(model.words)
        for batch in sliced(batches):
            out = list(model.scores([t or "" for t in batch.column(1).to_pylist()], numbers))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], told)], names=["row", "score", "evidence"])

    rows = docs.select(row.cast(kind).alias("row"), F.col("text").cast("string"))
    out = stored(rows.mapInArrow(score, f"row {kind}, score double, evidence {_EVIDENCE}"), "scores")
    shared.destroy()
    return out


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_examples: int = 4_000, k: int = 30) -> DataFrame:
    """doc_id, score and evidence (array of the three nearest examples' doc_id, label, cosine).

    ``labels`` (doc_id, toxic) are all learnt from: leave out what is held out before. What goes to
    the driver and to the workers grows with ``max_examples`` alone.
    """
    return _scored(docs, labels, F.col("doc_id"), "long", max_examples, k).withColumnRenamed("row", "doc_id")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_examples: int = 4_000, k: int = 30) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns.

    Scores depend on the text alone, so texts are rejected, not ids: rows without doc_id, and rows
    that repeat one, are told apart.
    """
    scores = _scored(docs, labels.where(~held_out()), text_key(), "binary", max_examples, k)
    return without_texts(docs, scores.where(F.col("score") >= threshold).select("row"), "toxic")
