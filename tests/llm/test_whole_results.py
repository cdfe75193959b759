"""Scores of the two classifiers and suppressed detections, whole, against versions written as loops."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from fathomline.llm import licenses, quality_model, toxicity
from fathomline.llm.common import word_hashes
from fathomline.llm.license_rules import CONFIDENCE
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    odd = [(900_001, ""), (900_002, None), (900_003, "zzzqqq unknownword"), (900_004, "The the THE. " * 40)]
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def test_toxicity_scores_are_the_votes_of_all_examples(docs, labels):
    model = toxicity.fit_toxicity(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    number = {int(h): i for i, h in enumerate(model.terms)}

    def vector(text):
        counts = Counter(toxicity.WORD.findall(text.lower()))
        at = {w: number.get(int(h)) for w, h in zip(counts, word_hashes(counts), strict=True)}
        raw = {at[w]: (1 + math.log(n)) * model.weight[at[w]] for w, n in counts.items() if at[w] is not None}
        size = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / size for t, x in raw.items()}

    examples = [vector(texts[i]) for i in model.examples]
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model, evidence=5).collect()}
    assert set(got) == set(texts)
    for doc, text in texts.items():
        own = vector(text)
        cos = [sum(x * e.get(t, 0.0) for t, x in own.items()) for e in examples]
        near = sorted(((-c, i) for i, c in enumerate(cos) if c > 1e-12))[:model.k]
        weight = [1 / (0.1 + math.sqrt(max(0.0, 2 + 2 * c))) for c, _ in near]
        vote = (sum(w * model.labels[i] for w, (_, i) in zip(weight, near, strict=True)) + 0.5 * model.prior) / (sum(weight) + 0.5) if near else model.prior
        assert got[doc].score == pytest.approx(np.interp(vote, *model.curve), abs=1e-6), doc
        assert got[doc].predicted == int(got[doc].score >= 0.3)
        assert [e.cosine for e in got[doc].evidence] == pytest.approx([-c for c, _ in near[:5]], abs=1e-9)
        assert all(e.toxic == model.labels[model.examples.index(e.doc_id)] for e in got[doc].evidence)


def test_quality_scores_are_the_networks_of_pooled_vectors(docs, labels):
    model = quality_model.fit_quality(docs, labels)
    known, dims = {int(h): i for i, h in enumerate(model.vectors.known)}, model.vectors.matrix.shape[1]
    made = {}

    def of(word):
        h = word_hashes([word])
        if int(h[0]) in known:
            return model.vectors.matrix[known[int(h[0])]].astype(float)
        if word not in made:
            v = quality_model.index_vectors(h, dims)[0].astype(float)
            made[word] = v / max(np.linalg.norm(v), 1e-9)
        return made[word]

    got = {r.doc_id: r.score for r in quality_model.score_quality(docs, model).collect()}
    net = model.network
    for r in docs.collect():
        words = quality_model.TOKEN.findall(r.text or "")
        x = np.zeros(dims + quality_model.FIGURES)
        if words:
            mean = sum(of(w) for w in words) / len(words)
            counts, kinds = Counter(words), Counter(quality_model.kind(w) for w in words)
            share = [kinds[k] / len(words) for k in range(len(quality_model.KINDS))]
            x = np.array([*mean, np.linalg.norm(mean), math.log1p(len(words)), len(counts) / len(words), share[6] + share[7], max(counts.values()) / len(words), *share])
        hidden = [math.tanh(sum((x - net.mean) / net.scale * net.w1[:, k]) + net.b1[k]) for k in range(len(net.b1))]
        logit = sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + net.b2
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, logit / net.temperature)))), abs=2e-4), r.doc_id


def test_detections_inside_others_are_suppressed(spark):
    rng, rows = random.Random(12), []
    for k in range(300):
        found = []
        for _ in range(rng.randrange(0, 9)):
            a = rng.randrange(0, 12)
            found.append((a, -(a + rng.randrange(1, 8)), rng.choice(sorted(CONFIDENCE)), rng.choice("abc")))
        rows.append((k, sorted(found)))
    df = spark.createDataFrame(rows, "k int, found array<struct<start: int, neg_end: int, priority: int, label: string>>")
    for r in df.select("k", "found", licenses.surviving(F.col("found")).alias("s")).collect():
        alive = []
        for i, d in enumerate(r.found):
            over = [e for j, e in enumerate(r.found) if j != i and e.start <= d.start and e.neg_end <= d.neg_end and e.priority <= d.priority
                    and ((e.start, e.neg_end, e.priority) != (d.start, d.neg_end, d.priority) or j < i)]
            if not over:
                alive.append(d)
        assert set(r.s.labels) == {d.label for d in alive} and r.s.best == min((d.priority for d in alive), default=None), r.k
