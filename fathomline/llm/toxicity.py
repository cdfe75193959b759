"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine.

Terms are all words of the examples, none left out. A term weighs its inverse document
frequency, counted over all documents, times a relevance: one for words that tell toxic
from other examples best, down to a floor for words that tell nothing. Examples lie in
blocks of an inverted index whose entries are (term, block) with the block's largest
weight. A query bounds every block from above, scores the most promising ones, and then
all that may still hold one of its k best: the neighbours found are exact. Neighbours
vote with inverse-distance weights; an isotonic curve makes a probability of the vote.
It is fitted on votes of examples whose own labels had no part in the relevances nor,
the example being left out, in the vote.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import by_name, count_matches, fields_of, fresh, held_out, labelled_sample, places, small_batches, word_hashes

WORD = re.compile(r"\w+")
Vector = tuple[np.ndarray, np.ndarray]


def words_of(text: str) -> Counter[str]:
    return count_matches(WORD, text.lower())


def relevance(present: list[np.ndarray], labels: np.ndarray, terms: int, floor: float = 0.02, sure: float = 3.84) -> np.ndarray:
    """A weight for every term: the association of its presence with label 1 (phi, from chi-squared beyond ``sure``, p = 0.05), and ``floor`` for all."""
    n, pos = len(labels), labels.sum()
    found = np.bincount(np.concatenate([np.zeros(0, np.int64), *present]), minlength=terms).astype(float)
    a = np.bincount(np.concatenate([np.zeros(0, np.int64), *[p for p, y in zip(present, labels, strict=True) if y]]), minlength=terms).astype(float)
    b, c = found - a, pos - a
    e = n - a - b - c
    chi = n * (a * e - b * c) ** 2 / np.maximum(1, (a + b) * (c + e) * (a + c) * (b + e))
    return floor + np.where(a * n > found * pos, np.sqrt(np.maximum(0, chi - sure) / max(n, 1)), 0)


class BlockMaxIndex:
    """Exact cosine neighbours among examples of sparse unit vectors: (term numbers, weights), each term once.

    Examples lie in blocks, ones with the same weightiest term side by side. Every term
    has its largest weight in each block. Terms of many examples ("wide" ones) are kept
    as rows of matrices, over blocks and over examples, so that a batch of queries is
    bounded and scored by products; the others as lists.
    """

    def __init__(self, vectors: list[Vector], terms: int, block: int = 32, wide_share: float = 1 / 16):
        none = np.zeros(0, np.int64)
        lead = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in vectors]
        self.order = np.array(sorted((i for i in range(len(vectors)) if lead[i] >= 0), key=lambda i: (lead[i], i)), np.int64)
        n = len(self.order)
        term = np.concatenate([none, *[vectors[i][0] for i in self.order]])
        place = np.repeat(np.arange(n), [len(vectors[i][0]) for i in self.order])
        weight = np.concatenate([np.zeros(0), *[vectors[i][1] for i in self.order]])
        by_term = np.lexsort((place, term))
        term, place, weight = term[by_term], place[by_term], weight[by_term]
        self.edges = np.append(np.arange(0, n, block), n)
        size = np.bincount(term, minlength=terms)
        #: The row of each wide term; -1 for the others.
        self.row = np.where(size > wide_share * n, np.cumsum(size > wide_share * n) - 1, -1).astype(np.int32)
        wide = self.row[term] >= 0
        self.by_place = np.zeros((int(self.row.max(initial=-1)) + 1, n))
        self.by_place[self.row[term[wide]], place[wide]] = weight[wide]
        self.by_block = np.maximum.reduceat(self.by_place, self.edges[:-1], axis=1) if n else np.zeros((0, 0))
        term, self.place, self.weight = term[~wide], place[~wide].astype(np.int32), weight[~wide]
        of = self.place // block
        start = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (of[1:] != of[:-1]))) if len(term) else none
        #: Of the other terms: where their postings begin, and their (block, largest weight) entries.
        self.first = np.searchsorted(term, np.arange(terms + 1)).astype(np.int32)
        self.block = of[start].astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0)
        self.first_entry = np.searchsorted(term[start], np.arange(terms + 1)).astype(np.int32)

    @staticmethod
    def _spread(first: np.ndarray, query: np.ndarray, terms: np.ndarray, weights: np.ndarray, to: np.ndarray, values: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        """Sums of weight times value by (query, ``to``) over the lists of the queries' terms."""
        n = (first[terms + 1] - first[terms]).astype(np.int64)
        at = np.repeat(first[terms] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(np.repeat(query, n) * shape[1] + to[at], np.repeat(weights, n) * values[at], shape[0] * shape[1]).reshape(shape)

    def nearest_many(self, queries: list[Vector], k: int, few: int = 4) -> list[Vector]:
        """For each query (examples, cosines) of the k nearest with a cosine above 0, nearest first, ties to the smaller example."""
        m, n, blocks = len(queries), len(self.order), len(self.edges) - 1
        none = np.zeros(0, np.int64), np.zeros(0)
        if not n or not m:
            return [none] * m
        query = np.repeat(np.arange(m), [len(t) for t, _ in queries])
        terms, weights = np.concatenate([t for t, _ in queries]), np.concatenate([w for _, w in queries])
        row = self.row[terms]
        wide = np.zeros((m, len(self.by_place)))
        wide[query[row >= 0], row[row >= 0]] = weights[row >= 0]
        rest = (query[row < 0], terms[row < 0], weights[row < 0])
        bounds = wide @ self.by_block + self._spread(self.first_entry, *rest, self.block, self.most, (m, blocks))
        listed = self._spread(self.first, *rest, self.place, self.weight, (m, n))
        cos = np.full((m, n), -1.0)

        def score(visit: np.ndarray) -> None:
            for b in np.flatnonzero(visit.any(0)).tolist():
                q, to = np.flatnonzero(visit[:, b]), slice(self.edges[b], self.edges[b + 1])
                cos[q, to] = wide[q] @ self.by_place[:, to] + listed[q, to]

        def kth() -> np.ndarray:
            return np.partition(cos, n - k, axis=1)[:, n - k] if n > k else np.zeros(m)

        ahead = bounds >= np.partition(bounds, max(blocks - few, 0), axis=1)[:, [max(blocks - few, 0)]]
        score(ahead & (bounds > 0))
        score(~ahead & (bounds > 0) & (bounds >= kth()[:, None] - 1e-9))
        least, out = kth(), []
        for i in range(m):
            some = np.flatnonzero((cos[i] > 0) & (cos[i] >= least[i]))
            ids = self.order[some]
            best = np.lexsort((ids, -cos[i, some]))[:k]
            out.append((ids[best], cos[i, some][best]))
        return out

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> Vector:
        return self.nearest_many([(terms, weights)], k)[0]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising fit of y on x by pooling adjacent violators: (knots, values)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for xi, yi in zip(x[order], y[order], strict=True):
        if pools and pools[-1][3] == xi:
            pools[-1][0] += yi
            pools[-1][1] += 1
        else:
            pools.append([yi, 1, xi, xi])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, _, hi = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = hi
    knots = [(q[i], q[0] / q[1]) for q in pools for i in (2, 3)]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


@dataclass
class ToxicityModel:
    """``terms`` are the words' sorted hashes."""

    terms: np.ndarray
    idf: np.ndarray
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    examples: list[int] = field(default_factory=list)
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    index: BlockMaxIndex | None = None
    prior: float = 0.0
    k: int = 15
    curve: tuple[np.ndarray, np.ndarray] | None = None

    def counts(self, text: str) -> Vector:
        """The numbers of the text's known words and how often each occurs."""
        found = words_of(text)
        at = places(self.terms, word_hashes(found))
        n = np.fromiter(found.values(), float, len(found))
        return at[at >= 0], n[at >= 0]

    def vector(self, counts: Vector, weight: np.ndarray) -> Vector:
        t, n = counts
        w = (1 + np.log(n)) * weight[t]
        return t, w / np.sqrt((w * w).sum()) if len(t) else w

    def vote(self, ids: np.ndarray, cos: np.ndarray, prior_weight: float = 0.5) -> float:
        if not len(ids):
            return self.prior
        w = 1 / (0.1 + np.sqrt(np.maximum(0, 2 - 2 * cos)))
        return float((w @ self.labels[ids] + prior_weight * self.prior) / (w.sum() + prior_weight))

    def scores(self, texts: list[str], batch: int = 128) -> tuple[np.ndarray, list[Vector]]:
        """The texts' scores and nearest examples."""
        near: list[Vector] = []
        for at in range(0, len(texts), batch):
            part = [self.vector(self.counts(t), self.weight) for t in texts[at:at + batch]]
            near += self.index.nearest_many(part, self.k) if self.index else [(np.zeros(0, np.int64), np.zeros(0))] * len(part)
        votes = np.array([self.vote(*x) for x in near])
        return np.interp(votes, *self.curve) if self.curve else votes, near

    def finish(self, rows: list, folds: int = 2) -> None:
        """Weighs the terms, indexes the examples and fits the curve on each fold's votes under relevances of the other folds."""
        self.examples, self.labels = [r[0] for r in rows], np.array([r[2] for r in rows], float)
        self.prior = float(self.labels.mean()) if rows else 0.0
        counts = [self.counts(text) for _, text, _ in rows]
        fold = np.arange(len(rows)) % folds
        votes = np.zeros(len(rows))

        def weigh(of: np.ndarray) -> tuple[np.ndarray, list[Vector]]:
            weight = self.idf * relevance([counts[i][0] for i in of], self.labels[of], len(self.idf))
            return weight, [self.vector(c, weight) for c in counts]

        for f in range(folds if len(rows) else 0):
            _, vectors = weigh(np.flatnonzero(fold != f))
            index = BlockMaxIndex(vectors, len(self.idf))
            for at in range(f, len(rows), 128 * folds):
                own = range(at, min(at + 128 * folds, len(rows)), folds)
                for i, (ids, cos) in zip(own, index.nearest_many([vectors[i] for i in own], self.k + 1), strict=True):
                    other = ids != i
                    votes[i] = self.vote(ids[other][:self.k], cos[other][:self.k])
        self.weight, vectors = weigh(np.arange(len(rows)))
        self.index = BlockMaxIndex(vectors, len(self.idf))
        if rows:
            self.curve = isotonic(votes, self.labels)


def document_counts(docs: DataFrame, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of documents, and in how many of them each term (sorted hashes) occurs: whole texts, all rows.

    Each task sends one count a term, so what is shuffled and what reaches the driver
    are bounded by the examples' words.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        terms, rows = shared.value, 0
        counts = np.zeros(len(terms), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                rows += 1
                at = places(terms, word_hashes(words_of(text)))
                counts[at[at >= 0]] += 1  # a document's terms differ
        some = np.flatnonzero(counts)
        yield pa.record_batch({"term": pa.array(np.append(some, -1).astype("i4")), "n": pa.array(np.append(counts[some], rows))})

    found = (
        docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "term int, n long")
        .groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # at most terms + 1 rows
    )
    out = np.zeros(len(terms) + 1)
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    return int(out[-1]), out[:-1]


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, k: int = 15) -> ToxicityModel:
    """Learns from at most ``max_rows`` labelled documents, none of them held out; document counts come from all of ``docs``.

    Without a labelled row every score is 0; where no example is toxic it is 0 too.
    """
    rows = labelled_sample(docs, labels, "toxic", held_out(F.col("doc_id"), 4, 2), max_rows)
    terms = np.sort(word_hashes({w for _, text, _ in rows for w in words_of(text)}))
    n, found = document_counts(docs, terms) if len(terms) else (0, np.zeros(0))
    model = ToxicityModel(terms, np.log((1 + n) / (1 + found)) + 1, k=k)
    model.finish(rows)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None, threshold: float = 0.3, evidence: int = 3, names: tuple[str, str, str] = ("score", "predicted", "evidence")) -> DataFrame:
    """The columns ``keep`` (default doc_id) with score, predicted and evidence (called ``names``), from the whole ``text``.

    ``evidence`` lists the nearest examples (doc_id, cosine, toxic), nearest first. A
    null text counts as empty and, like any text without a known word, has no
    neighbour: its vote is the prior. Equal cosines go to the smaller example's id.
    Repeated rows give repeated rows; columns of other names are ignored; an empty table
    gives no rows. The model travels as one broadcast, bounded by the sample.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    columns = keep or ["doc_id"]
    at = len(columns)
    source = docs.select(*by_name(columns), F.coalesce("text", F.lit("")).alias(*fresh(columns, "body")))
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches):
        m = shared.value
        for batch in batches:
            s, near = m.scores(batch.column(at).to_pylist())
            said = [[{"doc_id": m.examples[i], "cosine": float(c), "toxic": int(m.labels[i])} for i, c in zip(ids[:evidence], cos, strict=False)] for ids, cos in near]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array(s, pa.float64()), pa.array((s >= threshold).astype("i4"), pa.int32()), pa.array(said, kind)], [*columns, *names])

    return source.mapInArrow(
        run, f"{fields_of(source, columns)}, `{names[0]}` double, `{names[1]}` int, `{names[2]}` array<struct<doc_id: bigint, cosine: double, toxic: int>>")
