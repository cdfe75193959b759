"""The corpus operators against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
import xxhash

import public_tokenizers
from fathomline.llm import ann, graph, licenses, neardup, packing, pieces, pii, quality_model, quality_rules, sharding, toxicity
from pyspark.sql import functions as F

ODD = [
    (1, "Plain words of a text, all rights reserved. Licensed under CC BY-NC 4.0."), (2, ""), (3, None), (None, "no id here"), (4, "same same same"), (4, "same same same"),
    (5, "x " * 3000), (6, "a  b\n\n\tc   d"), (7, "mail a.b@c.example.com or +1 (555) 555-1234, 4111 1111 1111 1111, 10.0.0.1"), (8, "Ünï ▁ 日本 🎉"), (9, "#### $$$$ ||||\n####\n####"),
]
SCHEMA = "doc_id long, text string, fp long, shard int, score double"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def odd(spark):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 0, 0, 0.0) for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """{row: least id} by brute force over all pairs."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, f"{p:016x}", least.get(root(i))) for i, (d, p) in enumerate(prints) if d is not None)


def test_near_duplicates_match_brute_force(spark, docs, odd):
    for df in (docs.select("doc_id", "text"), odd):
        rows = [(r.doc_id, slow_print(r.text)) for r in df.collect()]
        got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in neardup.near_duplicates(df).collect() if r.doc_id is not None)
        assert got == slow_components(rows)


def test_links_of_long_lists_lose_nothing(spark):
    rng = random.Random(1)
    prints = {0, (1 << 64) - 1}
    for _ in range(5):  # crowds around a centre, so that lists grow long
        centre = rng.getrandbits(64)
        for _ in range(120):
            prints.add(centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(20)))
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = slow_components([(p, p & (1 << 64) - 1) for p in signed])
    found = {(r.u, r.v) for r in neardup.links(df).collect()}
    assert found == {(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    of = {r.node: r.component for r in graph.components(neardup.links(df)).collect()}
    assert [of.get(p, p) for p, _, _ in want] == [c for _, _, c in want]


def test_one_document_of_each_group_stays(spark, odd):
    kept = neardup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 4, 5, 6, 7, 8, 9]


def test_packing(spark, docs, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    for df in (docs, odd):
        want = []
        for r in df.collect():
            ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
            want += [(r.doc_id, k, s, n, zlib.crc32(ids[s:s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 1024))]
        got = packing.pack_documents(df, BPE).collect()
        key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
        assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
        held = {}
        for r in got:
            held.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for places in held.values():
            at = 0
            for offset, n in sorted(places):
                assert offset == at
                at += n
            assert at <= 1024
    assert packing.pack_documents(none, BPE).count() == 0


def best_bins(lengths, capacity):
    """Fewest sequences, by search."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1:]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


def test_dominance_keeps_the_optimum():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.randint(6, 30)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = np.bincount(lengths, minlength=capacity + 1)
        left = counts.copy()
        fixed = packing.reduce_by_dominance(left, capacity)
        rest = [n for n, c in enumerate(left) for _ in range(c)]
        assert sum(n for n, _ in fixed) + (best_bins(rest, capacity) if rest else 0) == best_bins(lengths, capacity)


def test_pii(spark, odd, none):
    found = {r.doc_id: r for r in pii.find_pii(odd).collect()}
    assert (found[7].n_email, found[7].n_ip, found[7].n_card, found[7].n_phone) == (1, 1, 1, 1)
    assert found[7].spans.startswith("email:5:22,phone:26:43")
    assert found[3].spans == "" and found[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r.text for r in pii.redact_pii(odd).collect()}
    assert clean[7] == "mail <EMAIL> or <PHONE>, <CARD>, <IP>" and clean[3] is None and clean[1] == ODD[0][1]
    assert pii.find_pii(none).count() == 0 and pii.redact_pii(none).columns == none.columns


def test_tagger_on_unseen_lines():
    rows = pii.labelled_rows(3, seed=77)
    right = sum(sorted((a, k, b) for k, a, b in spans) == found for (_, spans), found in zip(rows, pii.tag([t for t, _ in rows], pii.default_crf()), strict=True))
    assert right >= 0.9 * len(rows)


def test_viterbi_matches_enumeration():
    rng = np.random.default_rng(0)
    crf = pii.Crf({}, rng.normal(size=(5, 4, len(pii.LABELS))), rng.normal(size=(len(pii.LABELS),) * 2))
    ids = rng.integers(0, 4, (3, 4))
    scores, found = crf.scores(ids), crf.viterbi(ids, np.array([4, 2, 4]))
    import itertools

    for r, n in enumerate((4, 2, 4)):
        value = lambda y: sum(scores[r, t, y[t]] for t in range(n)) + sum(crf.trans[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, B905, E731
        if n == 4:
            assert tuple(found[r, :n]) == max(itertools.product(range(len(pii.LABELS)), repeat=n), key=value)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16)).astype("f4")
    x[300:500] = x[0]  # a hot leaf of equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (700, [0.0] * 16), (800, [float("nan")] * 16), (900, [1.0]), (None, x[5].tolist()), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0, leaf=32, cell_vectors=64, cell_queries=2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == [0, 100, 200, 300, 400, 500]
    hits = total = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        best = sorted((d[i], i) for i in range(600) if i != q)[:10]
        assert len(found) == 10 and all(abs(s - d[i]) < 1e-12 for i, s in found)
        hits += len({i for i, _ in found} & {i for _, i in best}) if q not in (0, 300, 400) else sum(s <= best[-1][0] + 1e-12 for _, s in found)
        total += 10
    assert hits >= 0.9 * total
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r)[:4] for r in ann.search(few, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 1.0)]
    assert ann.search(few.limit(0), F.lit(True)).count() == 0


def test_licences(spark, odd, none):
    found = {r.doc_id: r for r in licenses.scan_licenses(odd).collect()}
    assert (found[1].base_labels, found[1].labels, found[1].n_base, found[1].first_word, found[1].last_word) == ("cc-by,reserved", "cc-by,cc-by-nc-4.0,reserved", 2, 5, 10)
    assert (found[3].n_words, found[3].labels, found[3].score) == (0, "", 0.0)
    texts = ["cc by cc by", "GNU General Public License, version 3 or later", "under the MIT License", "SPDX-License-Identifier: Apache-2.0", "no licence at all", "Kelvin K cc by"]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_base for r in rows] == [2, 1, 0, 0, 0, 1]
    assert [r.labels for r in rows] == ["cc-by", "gpl,gpl-3.0", "mit", "apache-2.0", "", "cc-by"]
    assert (rows[0].first_word, rows[0].last_word) == (0, 2) and rows[3].score == 1.0
    assert licenses.scan_licenses(none).count() == 0


def test_sharding(spark, odd, none):
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == len(ODD)
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    many = sharding.shard_documents(spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")))
    n = [r.n for r in many.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(n) == 8 and max(n) < 1.1 * min(n)
    assert sharding.shard_documents(none).count() == 0


def test_sentencepiece(spark, docs, odd, none):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for df in (docs, odd):
        want = sorted((r.doc_id or -1, hashlib.sha256(np.array(ids := model.encode(r.text or "", add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest(),
                       hashlib.sha256(model.decode(ids).encode()).hexdigest()) for r in df.collect())
        assert sorted((r.doc_id or -1, r.ids_sha256, r.decoded_sha256) for r in pieces.round_trip(df, PIECES).collect()) == want
    encoded = pieces.encode_documents(odd, PIECES)
    assert {r.text for r in pieces.decode_documents(encoded, PIECES).collect() if r.doc_id == 8} == {model.decode(model.encode(ODD[9][1]))}
    assert pieces.round_trip(none, PIECES).count() == 0


def slow_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 400 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in twice for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_match_sql(spark):
    import duckdb

    from fathomline.llm import queries

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    df = queries.QUERIES["op10_quality_rules"](spark, folder)
    cursor = db.execute(queries.ORACLE_SQL["op10_quality_rules"])
    assert [c[0] for c in cursor.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(cursor.fetchall())


def test_quality_rules(spark, docs, odd, none):
    for df in (docs, odd):
        texts = {(r.doc_id, r.text): slow_measures(r.text or "") for r in df.collect()}
        got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.text_measures(df).collect())
        want = sorted((d or -1, *texts[d, t]) for d, t in [(r.doc_id, r.text) for r in df.collect()])
        assert got == want
    rows = quality_rules.quality_filter(odd).collect()
    assert all(not (r.base_failed and r.kept) for r in rows) and len(rows) == len(ODD)
    assert quality_rules.quality_filter(none).count() == 0


def test_classifiers(spark, docs, labels, odd, none):
    tox = toxicity.fit_toxicity(docs, labels)
    qual = quality_model.fit_quality(docs, labels)
    for frame in (toxicity.score_toxicity(odd, tox, odd.columns, names=("_score", "_predicted", "_evidence")), quality_model.score_quality(odd, qual, odd.columns, names=("_score", "_predicted"))):
        assert frame.select(*odd.columns).count() == len(ODD)
    for score in (lambda df: toxicity.score_toxicity(df, tox), lambda df: quality_model.score_quality(df, qual)):
        rows = score(odd).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
        assert score(none).count() == 0
    assert toxicity.fit_toxicity(docs, labels.limit(0)).scores(["any text", ""])[0].tolist() == [0.0, 0.0]
    assert quality_model.fit_quality(docs, labels.limit(0)).scores(["a", ""]).tolist() == [0.5, 0.5]


def test_neighbours_of_toxicity_are_exact():
    rng = np.random.default_rng(4)
    vectors = []
    for _ in range(300):
        t = np.sort(rng.choice(40, rng.integers(1, 8), replace=False))
        w = rng.random(len(t))
        vectors.append((t, w / np.sqrt((w * w).sum())))
    index = toxicity.BlockMaxIndex(vectors, 40)
    dense = np.zeros((300, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for t, w in vectors[:60]:
        q = np.zeros(40)
        q[t] = w
        cos = dense @ q
        ids, got = index.nearest(t, w, 9)
        want = sorted(-cos)[:9]
        assert np.allclose(-got, [c for c in want if c < 0])
