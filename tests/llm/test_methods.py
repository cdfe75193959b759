"""The operators' methods: what is tallied, ordered, skipped, grown and merged, and how well models do on rows they didn't see."""

import random
from itertools import combinations
import re
import struct
import time
import zlib

import duckdb
import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from fathomline.llm import ann, licenses, neardup, packing, pieces, pii, quality_model, quality_rules, sharding, toxicity
from fathomline.llm.license_rules import signature_rules
from pyspark.sql import functions as F

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SLOW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_spans(text):
    out = []
    for kind, pattern in SLOW.items():
        for m in re.finditer(pattern, text):
            digits = "".join(c for c in m[0] if c in "0123456789")
            bad = kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15
            out += [] if bad else [(m.start(), kind, m.end())]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[1])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.b1_20+ -()\n", max_size=60))
def test_patterns_match_slow_ones(text):
    assert pii.find_spans([text], pii.default_crf())[0][0] == slow_spans(text)


def test_patterns_on_documents():
    texts = [t or "" for (t,) in duckdb.execute(f"SELECT text FROM '{MIDDLE}/documents.parquet'").fetchall()]
    for text, (base, every) in zip(texts, pii.find_spans(texts, pii.default_crf()), strict=True):
        assert base == slow_spans(text)
        assert set(base) <= set(every) and all(a[2] <= b[0] or b[2] <= a[0] for a in set(every) - set(base) for b in base)


@pytest.mark.parametrize("text", ["1" * 10**6, "a" * 10**6, "a1" * 500_000, "a@" * 300_000, "1." * 300_000, "+1" * 300_000, "1 " * 300_000, "x@y.zz" * 100_000, "0" * 5000 + ".1.1.1"], ids=range(9))
def test_personal_data_in_long_odd_texts(text):
    began = time.perf_counter()
    pii.find_spans([text], pii.default_crf())
    assert time.perf_counter() - began < 20


def test_field_on_other_sentences():
    """Sentences that share no template with the training table."""
    good = {
        "Please forward everything to lena.fischer@post.example.net before noon.": ["email"], "our fax line is (212) 555-0187 since May": ["phone"],
        "Bearer x9Fq2LmZ81ttRrPq0aWc77eKd3 expired": ["secret"], "The visa 4111-1111-1111-1111 got declined twice.": ["card"], "gateway at 172.16.254.3 answers slowly": ["ip"]}
    for text, kinds in good.items():
        assert [k for _, k, _ in pii.find_spans([text], pii.default_crf())[0][1]] == kinds, text
    for text in ("In 1998 they sold 1,250 copies for 12.50 each.", "see chapters 3.2.1 and 4.5", "the score was 21-17 at 19:45", "Version 2.0.1 came out on 2021-03-04."):
        assert pii.find_spans([text], pii.default_crf())[0][1] == [], text


def test_matches_are_tallied(spark):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(40)]
    prints += [p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in prints]  # within two bits
    prints += [p ^ rng.getrandbits(16) << 8 * rng.randrange(7) for p in prints[:20]]  # six bytes alike, many bits not
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    octets = {p: (p & (1 << 64) - 1).to_bytes(8, "little") for p in prints}
    index = neardup.postings(spark.createDataFrame([(p,) for p in prints], "fp long"))
    pairs = list(combinations(range(8), 2))
    want = {(s, bytes(0 if i in (j, k) else x for i, x in enumerate(o)), o[j] + 256 * o[k], p) for p, o in octets.items() for s, (j, k) in enumerate(pairs)}
    assert {(r.slot, (r.bytes & (1 << 64) - 1).to_bytes(8, "little"), r.rest, r.fp) for r in index.collect()} == want
    shared = {(a, b): sum(x == y for x, y in zip(octets[a], octets[b], strict=True)) for a in prints for b in prints if a < b}
    every = spark.createDataFrame(list(shared), "u long, v long")
    for least in (1, 6):
        assert {(r.u, r.v): r.matches for r in neardup.tallied(every, least).collect()} == {p: n for p, n in shared.items() if n >= least}
    near = {p for p in shared if ((p[0] ^ p[1]) & (1 << 64) - 1).bit_count() <= 2}
    assert near and all(shared[p] >= neardup.GUARANTEED for p in near) and any(shared[p] >= neardup.GUARANTEED for p in set(shared) - near)
    assert {(r.u, r.v) for r in neardup.met(index).collect()} >= near
    assert {(r.u, r.v) for r in neardup.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()} == near


def test_a_full_list_stays_linear(spark):
    """All values of two bytes beside six equal ones: 16 * n pairs by one bit and 120 * n by two, of n * n / 2."""
    prints = spark.range(1 << 12).select((F.col("id") % 64 + F.shiftleft(F.floor(F.col("id") / 64), 32)).alias("fp"))
    assert neardup.links(prints).count() == (1 << 12) * (12 + 66) // 2


def test_plan_does_not_grow_with_counts():
    sizes = []
    for m in (2000, 8000):
        counts = np.zeros(1025, np.int64)
        counts[[1000, 20, 15]] = 3 * m, m, m
        plan = packing.pack_lengths(counts)
        assert sum(t * len(x) for t, x in plan) == counts.sum() and all(sum(x) <= 1024 for _, x in plan)
        sizes.append((len(plan), sum(t for t, _ in plan)))
    assert sizes[0][0] == sizes[1][0] < 20 and sizes[0][1] * 4 == sizes[1][1]


def test_cascade_skips_what_is_rejected(spark):
    """A rule that fails on any text it sees, behind one that rejects all the texts it would fail on."""
    docs = spark.createDataFrame([(1, "too short"), (2, "these are more than ten words of a text that is long enough")], "doc_id long, text string")
    trap = quality_rules.Rule("trap", F.when(F.col("n_words") < 10, F.raise_error(F.lit("looked at a rejected text")).cast("boolean")).otherwise(F.lit(False)))
    few = quality_rules.base_rules()[0]
    measures = quality_rules.text_measures(docs, ["doc_id", "text"])
    ahead = [quality_rules.Step(few, 1, 1), quality_rules.Step(trap, 1, 1)]
    assert {r.doc_id: r.kept for r in quality_rules.apply_cascade(measures, ahead).collect()} == {1: False, 2: True}
    with pytest.raises(Exception, match="looked at a rejected text"):
        quality_rules.apply_cascade(measures, ahead[::-1]).collect()


def test_order_changes_no_verdict(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rules = quality_rules.default_rules()
    measures = quality_rules.text_measures(docs, ["doc_id", "text"])
    found = []
    for order in (rules, rules[::-1]):
        found.append({r.doc_id: r.kept for r in quality_rules.apply_cascade(measures, [quality_rules.Step(r, 1, 1) for r in order]).collect()})
    steps = quality_rules.plan_cascade(docs, rules)
    found.append({r.doc_id: r.kept for r in quality_rules.apply_cascade(measures, steps).collect()})
    assert found[0] == found[1] == found[2] and {s.rule.name for s in steps} == {r.name for r in rules}
    assert [s.worth for s in steps] == sorted((s.worth for s in steps), reverse=True)


def spliced(model, charsmap, squeeze):
    """The model file with another character map and rule for white space."""
    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(k, v):
        return number(k << 3 | 2) + number(len(v)) + v if isinstance(v, bytes) else number(k << 3) + number(v)

    out, at = b"", 0
    for k, v in pieces._fields(model):
        if k == 3:
            v = b"".join(field(n, x) for n, x in sorted((dict(pieces._fields(v)) | {2: charsmap, 3: 1, 4: squeeze, 5: 1}).items()))
        out += field(k, v)
    return out


@pytest.mark.parametrize("squeeze", [None, 0, 1])
def test_encoding_matches_library(squeeze):
    with open(PIECES, "rb") as f:
        model = f.read()
    if squeeze is not None:  # a full map of compatibility forms and letter case
        made = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf").serialized_model_proto()
        charsmap = next(dict(pieces._fields(v))[2] for k, v in pieces._fields(made) if k == 3)
        assert struct.unpack_from("<I", charsmap)[0] > 1000
        model = spliced(model, charsmap, squeeze)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Codec(model)
    rng = random.Random(2)
    parts = ["a b", "A \ufb01\u2460\u2167 \u00bd ", "\u00e9e\u0301 \uff71\uff72\uff73 \uff9e", "\u65e5\u672c \u8a9e\u3000 \U0001f389", "\n\t x ", "\u2581 _ \u2581\u2581", "  the and  ", "\u200b\u00ad\ufeff\ud55c\uae00"]
    texts = ["", " ", "  ", "x" * 3000] + ["".join(rng.choice(rng.choice(parts)) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    for text in texts:
        ids, begin, end = own.encode(text)
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)
        assert own.decode(ids) == library.decode(ids.tolist())
        source = text.encode()
        assert len(begin) == len(ids) and (begin <= end).all() and (np.diff(begin) >= 0).all() and end.max() <= len(source)
        said = library.encode(text, return_type="proto").pieces
        for p, a, b, i in zip(said, begin[1:-1], end[1:-1], ids[1:-1], strict=True):
            if own.kinds[i] != pieces.BYTE:  # the library gives all bytes of a character but the last an empty span
                assert (p.begin, p.end) == (a, b), text


def test_decoding_any_ids_matches_library():
    library, own, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.codec(PIECES), random.Random(4)
    for _ in range(1500):
        ids = [rng.randrange(len(own.surface)) if rng.random() < 0.5 else rng.choice(list(own.bytes.values())) for _ in range(rng.randint(0, 12))]
        assert own.decode(np.array(ids, "i8")) == library.decode(ids)


def area(y, s):
    _, at, n = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[at]
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize(("kind", "buckets", "rest", "floor"), [("toxic", 4, 2, 0.95), ("quality", 5, 0, 0.97)])
def test_accuracy_on_held_out_rows(spark, kind, buckets, rest, floor):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    if kind == "toxic":
        scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    else:
        scored = quality_model.score_quality(docs, quality_model.fit_quality(docs, labels))
    rows = scored.join(labels, "doc_id").select("doc_id", "score", kind).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % buckets == rest]
    assert len(held) > 50 and area(np.array([r[kind] for r in held]), np.array([r.score for r in held])) >= floor


def test_toxicity_keeps_every_word():
    texts = ["one two three", "two three four", "rare words only here", "one four"]
    terms = np.sort(toxicity.word_hashes({w for t in texts for w in toxicity.words_of(t)}))
    model = toxicity.ToxicityModel(terms, np.ones(len(terms)))
    model.finish([(i, t, i % 2) for i, t in enumerate(texts)])
    assert len(model.index.order) == 4 and all(len(model.vector(model.counts(t), model.weight)[0]) == len(t.split()) for t in texts)
    dense = np.zeros((4, len(terms)))
    for i, t in enumerate(texts):
        at, w = model.vector(model.counts(t), model.weight)
        dense[i, at] = w
    for i, (_, (ids, cos)) in enumerate(zip(texts, zip(*[[x[k] for x in model.scores(texts)[1]] for k in (0, 1)], strict=True), strict=True)):
        want = dense @ dense[i]
        assert np.allclose(sorted(want[want > 0], reverse=True), cos) and np.allclose(want[ids], cos)


def test_tree_grows_and_prunes(spark):
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(40, 32))[rng.integers(0, 40, 6000)] * 4 + rng.normal(size=(6000, 32))).astype("f4")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").withColumn("leaf", F.lit(1)).withColumn("score", F.lit(1.0))
    for settings_ in ({}, {"sample_rows": 500, "leaf_rows": 100}):
        rows = ann.search(df, F.col("vec_id") % 100 == 0, **settings_).collect()
        hits = 0
        for q in range(0, 6000, 100):
            d = ((x.astype(float) - x[q]) ** 2).sum(1)
            d[q] = np.inf
            hits += len({r.vec_id for r in rows if r.query_id == q} & set(np.argsort(d)[:10].tolist()))
        assert hits >= 0.9 * 600 and all(r.visited_share < 0.3 and r.expected_recall >= 0.9 for r in rows)


def test_licence_counts_match_slow_ones(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for d, text in docs.select("doc_id", "text").collect():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = sorted((i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split())
        r = got[d]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_signature_rules_are_many_and_compile():
    rules = signature_rules()
    assert len({r.pattern for r in rules}) > 700 and all(re.compile(r.pattern) for r in rules)


def test_shards_match_slow_ones(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r for r in sharding.shard_documents(docs).collect()}
    for d, text in docs.select("doc_id", "text").collect():
        raw = (text or "").encode()
        assert (rows[d].size, rows[d].text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    heavier = tuple(sharding.Shard(s.shard, s.region, s.rack, 2.0 if s.shard == 5 else 1.0) for s in sharding.even_topology())
    moved = {r.doc_id: r.shard for r in sharding.shard_documents(docs, heavier).collect()}
    for d, r in rows.items():  # a heavier shard pulls keys into its own rack and region only
        assert moved[d] == r.shard or moved[d] // 4 == 1 and (r.shard // 4 == 0 or moved[d] // 2 == 2)


def test_slots_of_repeated_rows(spark):
    rows = sharding.shard_documents(spark.createDataFrame([(7, "same")] * 500 + [(8, None)], "doc_id long, text string")).collect()
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_clashing_names_and_text_ids(spark):
    names = ["_fp", "_row", "_same", "fp", "node", "component", "_bucket", "_rank", "body", "_counts", "rank", "row", "leaf", "c0", "score", "predicted", "evidence", "_score"]
    docs = spark.createDataFrame([(i, f"some words of text number {i} and more") for i in range(6)] + [(3, None), (None, "")], "doc_id long, text string")
    wide = docs.select("*", *[F.lit(1).alias(n) for n in names])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(6)], "doc_id long, quality int, toxic int")
    assert neardup.near_duplicates(wide).count() == 8
    kept = neardup.drop_near_duplicates(wide)
    assert kept.columns == wide.columns and kept.count() == 7  # the two without words are alike
    assert pii.redact_pii(wide).columns == wide.columns and sharding.shard_documents(wide).count() == 8
    assert packing.pack_documents(wide, public_tokenizers.path("byte_bpe_50k.json")).count() == 8
    assert licenses.scan_licenses(wide).count() == 8 and pieces.round_trip(wide, PIECES).count() == 8
    assert toxicity.score_toxicity(wide, toxicity.fit_toxicity(wide, labels), ["doc_id", "score"], names=("a", "b", "c")).count() == 8
    assert quality_model.score_quality(wide, quality_model.fit_quality(wide, labels), ["doc_id", "score"], names=("a", "b")).count() == 8
    texts = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert quality_rules.quality_filter(texts).count() == 8
