"""The prefix trie, the filter audit and the removal of repeats against brute force, SQL and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import audit, queries, repeats, trie

DATA = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, depth long, digest string, family int"
DOCS = "doc_id long, text string, lang string, digest int, n int, part string"


def by_row(rows):
    return sorted(map(tuple, rows), key=lambda r: [(v is not None, v) if not isinstance(v, bytes) else (True, v.hex()) for v in r])


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_filter_audit"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = queries.QUERIES[name](spark, DATA)
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert by_row(df.select(*columns).collect()) == by_row(found.fetchall())


def rebuilt_turns(df):
    conv = F.col("conv_id").cast("long")
    return trie.turn_rows(df, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9)


def slow_trie(rows, rebuild=True):
    turns = defaultdict(list)
    for r in rows:
        if r.conv_id is not None:
            role, text = r.role or "", r.text or ""
            said = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[r.conv_id].append(((r.turn is not None, r.turn or 0), role, said, text))
    turns = {c: [(x[1], x[3]) for x in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        paths[c] = turns.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + own[h:]
    members, ends, kids = defaultdict(list), defaultdict(list), Counter()
    for c, path in paths.items():
        for k in range(len(path) + 1):
            members[tuple(path[:k])].append(c)
        ends[tuple(path)].append(c)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        own = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for k in range(len(p) + 1):
            saved[p[:k]] += own
            leaves[p[:k]] += not kids[p]
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
             hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()]


def odd_conversations():
    """Shared openings of any depth, copies, conversations inside others, long ones, repeated and null turns."""
    rng, rows = random.Random(3), []
    for c in range(-6, 90):
        base = rng.choice([0, 0, 1, 2])
        for k in range(rng.choice([0, 1, 2, 3, 9, 30])):
            rows.append((c, k, "user" if k % 2 == 0 else None, f"{base} says {k if k < 12 else k * c}" if k != 3 else None))
    rows += [(c, k, "user", f"same {k}") for c in range(100, 130) for k in range(20)]  # copies
    rows += [(c, k, "user", f"same {k}") for c in range(200, 220) for k in range(c - 199)]  # each ends inside the next
    rows += [(300, k, "user", str(k)) for k in range(400)] + [(301, 1, "a", "x")] * 3 + [(302, None, "a", "late"), (302, 0, "a", "later"), (302, 0, "a", "Later"), (None, 0, "a", "x"), (303, 0, "", ""), (304, 0, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rebuild", [True, False])
def test_trie_matches_brute_force(spark, rebuild):
    df = spark.createDataFrame([(*r, 1, "x", 1) for r in odd_conversations()], TURNS).repartition(3)
    got = trie.prefix_trie(rebuilt_turns(df) if rebuild else trie.turn_rows(df)).drop("digest")
    assert by_row(got.collect()) == by_row(slow_trie(df.collect(), rebuild))


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert trie.prefix_trie(trie.turn_rows(none)).collect() == []
    alone = trie.prefix_trie(rebuilt_turns(spark.createDataFrame([(7, 0, "a", "x", 1, "", 1)], TURNS))).collect()  # loses its only turn
    assert zlib.crc32(b"7") % 9 and [(r.conv_id, r.depth, r.n_convs, r.n_leaves) for r in alone] == [(7, 0, 1, 1)]


def test_links_are_exploded_and_not_single_nodes(spark):
    """A conversation of n turns gives a few rows and not n * n / 2."""
    df = spark.createDataFrame([(c, k, "a", f"{k if k < 300 else k * c}", 1, "", 1) for c in range(4) for k in range(600)], TURNS)
    rows = trie.prefix_trie(trie.turn_rows(df))
    assert {(r.depth, r.n_leaves) for r in rows.collect()} == {(d, 4 if d <= 300 else 1) for d in range(601)}


def test_end_hashes_over_many_runs(spark, monkeypatch):
    ends = [(bytes([n]), c) for n in range(3) for c in random.Random(n).sample(range(-9000, 9000), 9000 * (n == 1) + 5)]
    got = {r.digest: r.ends_sha256 for r in trie.end_hashes(spark.createDataFrame(ends, "digest binary, conv_id long").repartition(7)).collect()}
    want = {n: hashlib.sha256(",".join(map(str, sorted(c for m, c in ends if m == n))).encode()).hexdigest() for n, _ in ends}
    assert {bytes(k): v for k, v in got.items()} == want


def slow_audit(rows, labels):
    marks, least, parts = defaultdict(set), {}, defaultdict(list)
    for r in labels:
        marks[r.doc_id] |= {k for k in ("quality", "toxic") if r[k] == 1}
    for r in rows:
        if r.doc_id is not None:
            least[r.text or ""] = min(least.get(r.text or "", r.doc_id), r.doc_id)
    for r in rows:
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": r.doc_id is not None and r.doc_id > least[t]}
        parts[r.lang or ""].append(({k for k, v in fails.items() if v}, marks[r.doc_id] if r.doc_id is not None else set()))
    for part, docs in parts.items():
        out, total = [], Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                total[f] += len(removed)
                out.append((f, part, "".join(order), step, len(left), len(removed), sum(f in d[0] for d in docs) - len(removed), sum(d[0] == {f} for d in docs),
                            sum("quality" in d[1] for d in removed), sum("toxic" in d[1] for d in removed)))
        yield from ((*r[1:], total[r[0]]) for r in out)


def test_audit_matches_brute_force_on_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(300))
    rows = [(1, "short", "en"), (2, "short", "de"), (None, "short", "en"), (3, "", None), (4, None, ""), (5, long, "en"), (5, long, "en"), (5, "ABC " * 300, "en"), (6, long + " #", "de"), (7, long, "xx"),
            (8, " é " * 250, "xx"), (9, "A\x0b\x0cb c" * 900, "en"), (10, "x " * 200_000, "en"), (-1, long, "xx")]
    docs = spark.createDataFrame([(*r, 1, 1, "part") for r in rows], DOCS).repartition(3)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (5, 1, None), (7, None, 1), (None, 1, 1), (99, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    got = audit.filter_audit(docs, labels)
    assert by_row(got.collect()) == by_row(slow_audit(docs.collect(), labels.collect()))
    assert audit.filter_audit(docs.limit(0), labels).count() == 0


def slow_repeats(rows, width=400):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i:i + width] for i in range(len(b) - width + 1))
    for doc, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - width + 1):
            if seen[b[i:i + width]] > 1:
                gone[i] += 1
                gone[i + width] -= 1
        gone = np.cumsum(gone)[:len(b)] > 0
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])[:len(b)]).sum())
        yield doc, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()


def odd_texts():
    """Copies, passages at lengths around 400 and at all residues, near copies with one edit, overlaps with themselves."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    base = [word(rng.choice([0, 100, 399, 400, 401, 900, 3000])) for _ in range(40)]
    passage = {n: word(n) for n in (398, 399, 400, 401, 420, 532, 533, 700)}
    texts = base + [word(rng.randrange(300)) + p + word(rng.randrange(300)) for p in passage.values() for _ in range(3)]
    texts += [base[-1], base[-1], base[0], None, "", "a" * 399, "a" * 400, "b" * 401, "ab" * 700, word(150) * 5]
    whole = word(4000)
    for _ in range(12):  # near copies, some edits close to others and to the ends
        at = rng.choice([0, 1, 399, 400, 800, 3600, 3999, rng.randrange(4000)])
        texts.append(whole[:at] + rng.choice(["", "XY", "é"]) + whole[at + rng.choice([0, 1]):])
    texts += [whole[k:k + rng.randrange(380, 900)] for k in rng.sample(range(3000), 10)]
    return texts


def test_repeats_match_brute_force(spark):
    texts = odd_texts()
    rows = [(k % 50 if k % 17 else None, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "en", 1, 1, "x") for r in rows], DOCS).repartition(5)
    assert by_row(repeats.drop_repeats(df).drop("spans").collect()) == by_row(slow_repeats(rows))


def test_repeats_in_small_batches_and_by_shuffles(spark, monkeypatch):
    """Batches that end inside texts, many buckets, stretches longer than a sum, and ids too many to broadcast."""
    for name, value in (("BATCH_NAMES", 500), ("STRETCH", 700), ("FEW", 0), ("BUCKET_NAMES", 64)):
        monkeypatch.setattr(repeats, name, value)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    rows = list(enumerate(odd_texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    try:
        assert by_row(repeats.drop_repeats(df).drop("spans").collect()) == by_row(slow_repeats(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_repeats_of_the_documents(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    assert by_row(repeats.drop_repeats(df).drop("spans").collect()) == by_row(slow_repeats([tuple(r) for r in df.collect()]))


def test_repeats_of_nothing_and_of_one_long_text(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.drop_repeats(none).collect() == []
    rng = random.Random(9)
    text = "".join(map(chr, rng.choices(range(97, 123), k=3_000_000)))
    long = [(1, text), (2, text[1_000_000:1_000_600]), (3, "x" * 2_000_000)]
    got = {r.doc_id: (r.n_removed, r.n_spans, [tuple(s) for s in r.spans]) for r in repeats.drop_repeats(spark.createDataFrame(long, "doc_id long, text string")).collect()}
    assert got == {1: (600, 1, [(1_000_000, 1_000_600)]), 2: (600, 1, [(0, 600)]), 3: (2_000_000, 1, [(0, 2_000_000)])}


def test_the_cover_has_a_pair_for_every_difference():
    for q in (2, 3, 5, 7, 11, 13):
        cover = repeats.difference_cover.__wrapped__(q)
        assert {(a - b) % (q * q + q + 1) for a in cover.tolist() for b in cover.tolist()} == set(range(q * q + q + 1))
