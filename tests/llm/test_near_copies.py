"""The pipeline's near-dedup stage against brute force over all pairs."""

import random
import re

import corpus_pipeline
import numpy as np
import pytest
from fathomline.llm import graph, neardup
from pyspark.sql import functions as F


def slow_kept(rows, size, p, q):
    """The rows' numbers that stay: the least (doc_id, row) of each group linked by a similarity of p / q or more."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i:i + size]) for i in range(len(words) - size + 1)} or {tuple(words)})
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if q * len(a & b) >= p * len(a | b) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for i, g in enumerate(group):
        d = rows[i][0]
        best[g] = min(best.get(g, (True, 0, "")), (d is None, d or 0, rows[i][1] or "")) if g in best else (d is None, d or 0, rows[i][1] or "")
    return sorted(best.values())


def near_texts():
    """Texts with copies of which ever more words are changed, boilerplate, short and empty ones."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    plate = [rng.choice(vocabulary) for _ in range(30)]
    texts = [None, "", " \n", "one", "One", "one two", "a b c d e", "A b  c d e", "a b c d e f"]
    for n in (6, 12, 30, 60, 200, 700):
        for _ in range(3):
            words = [rng.choice(vocabulary) for _ in range(n)]
            texts += [" ".join(words), " ".join(words), " ".join(plate + words), " ".join(words + words[: n // 9])]
            for changes in (1, 2, 4, 8):
                other = list(words)
                for _ in range(changes):
                    other[rng.randrange(n)] = rng.choice(vocabulary)
                texts.append(" ".join(other))
    rng.shuffle(texts)
    return [(None if i % 17 == 3 else i // 2, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("size", "similarity", "p", "q"), [(5, 0.8, 4, 5), (3, 0.55, 11, 20), (1, 1.0, 1, 1)])
@pytest.mark.parametrize("batch", [10_000, 7])
def test_groups_match_brute_force(spark, size, similarity, p, q, batch):
    rows = near_texts()
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        kept = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size, similarity).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept)
    want = slow_kept(rows, size, p, q)
    assert [g[:2] for g in got] == [w[:2] for w in want]


def test_stage_drops_copies_ten_bits_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300)
    rng, rows = random.Random(6), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    words = [f"v{rng.randrange(10**6)}" for _ in range(120)]
    other = [*words[:57], "changed", "here", *words[59:]]
    rows += [(10**6, " ".join(words)), (10**6 + 1, " ".join(other))]
    assert (neardup.fingerprint(rows[-1][1]) ^ neardup.fingerprint(rows[-2][1])).bit_count() > neardup.BITS
    kept = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [w[:2] for w in slow_kept(rows, 5, 4, 5)]
    assert 10**6 + 1 not in {r.doc_id for r in kept}


def test_pairs_of_a_group_are_not_made(spark):
    """A text with many near copies: one pair a copy joins them, and no pair among them is made after that."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    base = [rng.choice(words) for _ in range(400)]
    texts = [" ".join(base)]
    for _ in range(80):
        other = list(base)
        for _ in range(6):
            other[rng.randrange(400)] = "changed" + str(rng.random())
        texts.append(" ".join(other))
    hashes, bound = neardup._WordHashes(), neardup.Bound.of(0.8)
    sets = [neardup.shingle_set(t, 5, hashes) for t in texts]
    alike = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    assert all(alike(s.tolist(), sets[0].tolist()) >= 0.8 for s in sets) and alike(sets[1].tolist(), sets[2].tolist()) < 0.8
    found = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "_same long, _row long, text string")
    common = neardup.common_shingles(found, 5, 20_000, 100_000)
    lists = neardup.durable(neardup.shared_lists(neardup.prefix_index(found, 5, bound, common)), "test")
    stars = neardup.star_pairs(lists, bound).collect()
    assert len(stars) <= 80 and {r.v for r in stars} == {0}
    joined = lists.withColumn("component", F.lit(0).cast("long"))
    assert neardup.meetings(neardup.with_past(joined), bound).count() == 0
    apart = lists.withColumn("component", F.col("same"))
    made = neardup.meetings(neardup.with_past(apart), bound)
    assert made.distinct().count() <= made.count() < 0.2 * lists.agg(F.sum((F.col("size") - 1) / 2)).first()[0]
    maps = neardup.bit_maps(found, found.select("_same"), 5)
    left = {(r.u, r.v) for r in neardup.meetings(neardup.with_past(apart).join(maps, "same"), bound).collect()}
    similar = {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if alike(a.tolist(), b.tolist()) >= 0.8}
    assert similar <= left <= {(r.u, r.v) for r in made.collect()} and len(left) < made.distinct().count()


def test_fingerprints_within_two_bits_are_the_first_pairs(spark):
    rows = sorted({(int.from_bytes(t.encode()[:5], "big") % 1000 + 1000 * i, neardup.signed(neardup.fingerprint(t, 5))) for i, (_, t) in enumerate(near_texts()) if t})
    rows += [(rows[0][0], rows[1][1]), (9_000_000, rows[2][1]), (9_000_001, rows[3][1] ^ 5), (9_000_002, rows[4][1] ^ 1)]  # a set with two prints, a shared print, two bits, one bit
    got = {(r.u, r.v) for r in neardup.print_pairs(spark.createDataFrame(rows, "_same long, _fp long")).collect()}
    lead = {}
    for same, fp in rows:
        lead[fp] = min(lead.get(fp, same), same)
    want = {(same, lead[fp]) for same, fp in rows if same != lead[fp]}
    near = {(lead[a], lead[b]) for a in lead for b in lead if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2 and lead[a] != lead[b]}
    assert {tuple(sorted(p)) for p in got} == {tuple(sorted(p)) for p in want | near} and len(near) >= 2


def test_small_components_are_not_broadcast(spark, monkeypatch):
    """The rounds' joins are shuffled at any size, as broadcasts would be built in the driver."""
    plans, written = [], graph.durable
    monkeypatch.setattr(graph, "durable", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or written(df, name))
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 5), (5, 9), (4, 4), (None, 1)], "u long, v long")
    assert {tuple(r) for r in graph.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (7, 5), (9, 5)}
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_edges_that_are_stars_need_no_round(spark, monkeypatch):
    """The driver keeps something of every task: rounds end when stars are left, not when one more round has changed nothing."""
    names, written = [], graph.durable
    monkeypatch.setattr(graph, "durable", lambda df, name: names.append(name) or written(df, name))
    rng, of = random.Random(9), lambda rows: {tuple(r) for r in graph.components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert of([(1, 2), (3, 1), (1, 3), (5, 6)]) == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)} and names == ["edges"]
    names.clear()
    assert of([(k, 100) for k in range(9)]) == {(k, 0) for k in (*range(9), 100)} and names == ["edges", "large-star", "small-star"]
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(k, k + 1) for k in range(500, 560)]
    group = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in group:
        for u, v in edges:
            if u != v:
                group[u] = group[v] = min(group[u], group[v])
    assert of(edges) == set(group.items())


def test_sets_are_looked_up_once(spark, monkeypatch):
    """Comparing pairs doesn't group all rows by set again."""
    plans, written = {}, neardup.durable
    monkeypatch.setattr(neardup, "durable", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().toString()) and written(df, name))
    neardup.drop_near_duplicates(spark.createDataFrame(near_texts(), "doc_id long, text string"), 5, 0.8).count()
    assert "set-rows" in plans["asked-texts"] and "shingled" not in plans["asked-texts"]


def test_parity_maps_never_rule_out_alike_sets():
    rng = random.Random(11)
    for n in (1, 2, 9, 300, 1100, 5000):
        a = [rng.getrandbits(64) for _ in range(n)]
        for changed in (0, 1, n // 12, n // 3, n):
            b = [*a[changed:], *[rng.getrandbits(64) for _ in range(changed + n // 20)]] or [1]
            x, y = (np.array(sorted(set(s)), np.uint64) for s in (a, b))
            differ = len(set(a) ^ set(b))
            assert neardup.odd_bits(neardup.parity_map(x), neardup.parity_map(y)) == neardup.odd_bits(neardup.parity_map(y), neardup.parity_map(x)) <= differ
            if n >= 300 and changed == n:
                assert neardup.odd_bits(neardup.parity_map(x), neardup.parity_map(y)) > 0.25 * (len(x) + len(y)) / 2


def test_texts_move_only_for_pairs_that_are_nearly_alike(spark, monkeypatch):
    """Texts of which two share a passage are compared by their maps; only the copy's text is brought to its source."""
    rng, moved, whole = random.Random(3), [], neardup.durable
    monkeypatch.setattr(neardup, "durable", lambda df, name: moved.append((name, whole(df, name))) or moved[-1][1])
    plate = lambda i: " ".join(f"p{i // 2}x{k}" for k in range(20))
    texts = [f"{plate(i)} " + " ".join(f"w{rng.randrange(10_000)}" for _ in range(120)) for i in range(40)]
    texts.append(texts[0] + " end")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in neardup.drop_near_duplicates(docs).collect()) == list(range(40))
    rows = [df.count() for name, df in moved if name == "asked-texts"]
    assert sum(rows) <= 4 and max(df.count() for name, df in moved if name == "asked-maps") > 10


def test_pipeline_removes_what_a_stage_was_given(spark, monkeypatch):
    gone = []
    monkeypatch.setattr(corpus_pipeline, "discard", lambda df: gone.append(df.durable_path))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(k), lambda s, docs, d: docs) for k in range(4)])
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert [re.search(r"stage-\d", p)[0] for p in gone] == ["stage-0", "stage-1"]
