"""Quality classifier: random-indexing word vectors, pooled, then a two-layer network.

Every word has a sparse ternary index vector, drawn from a hash of the word: no word
needs to be known beforehand. Words that the training sample holds more than once also
have a context vector, the sum of their neighbours' index vectors over the sample. A
document is the mean of its words' vectors with a few pooled figures; a tanh layer and a
logistic output score it. A temperature, fitted on a part of the sample the network
didn't see, calibrates the probability.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import by_name, count_matches, fields_of, fresh, held_out, labelled_sample, places, small_batches, word_hashes

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Words by what they are made of; a document's shares of them are among its figures.
KINDS = ("letters 1-3", "letters 4-8", "letters 9-15", "letters 16+", "digits", "mixed", "marks 1", "marks 2+")
FIGURES = 5 + len(KINDS)


def kind(word: str) -> int:
    if word[0].isalnum() or word[0] == "_":
        if word.isdigit():
            return 4
        if not word.isalpha():
            return 5
        return 0 if len(word) < 4 else 1 if len(word) < 9 else 2 if len(word) < 16 else 3
    return 6 if len(word) == 1 else 7


def index_vectors(hashes: np.ndarray, dims: int, nonzero: int = 6) -> np.ndarray:
    """A row for each word's hash with ``nonzero`` entries of +1 or -1 (fewer where two fall together) at places drawn from it."""
    z = hashes.copy()
    out = np.zeros((len(z), dims), np.float32)
    rows = np.arange(len(z))
    for _ in range(nonzero):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x9E3779B97F4A7C15)
        out[rows, ((z >> np.uint64(33)) % np.uint64(dims)).astype(np.int64)] += np.where(z >> np.uint64(20) & np.uint64(1), 1, -1)
    return out


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


@dataclass
class WordVectors:
    """Context words by their sorted hashes, with a vector each."""

    known: np.ndarray
    matrix: np.ndarray

    @classmethod
    def fit(cls, texts: list[str], dims: int, window: int = 2) -> WordVectors:
        number: dict[str, int] = {}
        ids = array("i")
        for t in texts:
            ids.extend(number.setdefault(w, len(number)) for w in TOKEN.findall(t))
            ids.extend([-1] * window)  # texts are no neighbours
        ids = np.array(ids, np.int32)
        real = ids >= 0
        hashes = word_hashes(number)
        index = index_vectors(hashes, dims)
        kept = np.flatnonzero(np.bincount(ids[real], minlength=len(number)) > 1)  # one occurrence says little of a word's neighbours
        context = np.zeros((len(kept), dims), np.float32)
        for j in range(dims):
            x = np.where(real, index[ids, j], 0).astype(np.float32)
            near = np.zeros(len(x), np.float32)
            for k in range(1, window + 1):
                near[k:] += x[:-k]
                near[:-k] += x[k:]
            context[:, j] = np.bincount(ids[real], near[real], len(index))[kept]
        order = np.argsort(hashes[kept])
        return cls(hashes[kept][order], unit(unit(index[kept]) + unit(context))[order].astype(np.float32))

    def pooled(self, text: str) -> np.ndarray:
        """The mean word vector, then its length, log(1 + words), the shares of distinct words and of marks, the largest word's share and each kind's share."""
        counts = count_matches(TOKEN, text)
        dims = self.matrix.shape[1]
        out = np.zeros(dims + FIGURES, np.float32)
        if not counts:
            return out
        hashes = word_hashes(counts)
        ids = places(self.known, hashes)
        n = np.fromiter(counts.values(), np.float32, len(counts))
        total, known = n.sum(), ids >= 0
        mean = n[known] @ self.matrix[ids[known]]
        new, times = hashes[~known], n[~known]
        for at in range(0, len(new), 8192):  # a long text may hold any number of words
            mean = mean + times[at:at + 8192] @ unit(index_vectors(new[at:at + 8192], dims))
        mean = mean / total
        kinds = np.bincount([kind(w) for w in counts], n, len(KINDS)) / total
        out[:dims] = mean
        out[dims:] = np.linalg.norm(mean), np.log1p(total), len(counts) / total, kinds[6] + kinds[7], n.max() / total, *kinds
        return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 300, rate: float = 0.01, decay: float = 1e-3, seed: int = 1) -> Network:
        """Full-batch Adam on log-loss; every fifth row is kept for the temperature."""
        rng = np.random.default_rng(seed)
        x, y = x.astype(np.float64), y.astype(np.float64)
        apart = np.arange(len(y)) % 5 == 4
        xs, ys = x[~apart], y[~apart]
        mean, scale = xs.mean(0), xs.std(0) + 1e-6
        z = (xs - mean) / scale
        p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.array(np.log((ys.mean() + 1e-3) / (1.001 - ys.mean())))]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for t in range(1, epochs + 1):
            h = np.tanh(z @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - ys) / len(ys)
            dh = np.outer(d, p[2]) * (1 - h * h)
            for i, g in enumerate((z.T @ dh + decay * p[0], dh.sum(0), h.T @ d + decay * p[2], d.sum())):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        net = cls(mean, scale, *p)
        if apart.any():
            logits, ya = net.logits(x[apart]), y[apart]
            loss = lambda t: np.logaddexp(0, np.where(ya > 0.5, -logits, logits) / t).mean()
            net.temperature = float(min(np.geomspace(0.5, 8, 60), key=loss))
        return net


@dataclass
class QualityModel:
    vectors: WordVectors | None
    network: Network | None
    constant: float = 0.5

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.constant)
        return self.network.scores(np.stack([self.vectors.pooled(t) for t in texts]))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, dims: int = 64) -> QualityModel:
    """Trains on at most ``max_rows`` labelled documents, none of them held out.

    Where the sample has one class only (or no row), every score is that class's share (or 0.5).
    """
    rows = labelled_sample(docs, labels, "quality", held_out(F.col("doc_id"), 5, 0), max_rows)
    y = np.array([r[2] for r in rows], float)
    if len(set(y)) < 2:
        return QualityModel(None, None, float(y.mean()) if len(y) else 0.5)
    texts = [r[1] for r in rows]
    order = np.random.default_rng(3).permutation(len(texts))
    vectors = WordVectors.fit(texts, dims)
    return QualityModel(vectors, Network.fit(np.stack([vectors.pooled(t) for t in texts])[order], y[order]))


def score_quality(docs: DataFrame, model: QualityModel, keep: list[str] | None = None, threshold: float = 0.3, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns ``keep`` (default doc_id) with score and predicted (called ``names``), from the whole ``text``.

    A null text counts as empty, which has a score like any other; repeated rows give
    repeated rows; columns of other names are ignored; an empty table gives no rows. The
    model travels as one broadcast, bounded by the sample.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    columns = keep or ["doc_id"]
    at = len(columns)
    source = docs.select(*by_name(columns), F.coalesce("text", F.lit("")).alias(*fresh(columns, "body")))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s = shared.value.scores(batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:at], pa.array(s, pa.float64()), pa.array((s >= threshold).astype("i4"))], [*columns, *names])

    return source.mapInArrow(run, f"{fields_of(source, columns)}, `{names[0]}` double, `{names[1]}` int")
