"""Removal of repeated byte strings: a difference-cover sample names long strings, and suffixes are sorted bucket by bucket.

Which 400-byte strings start at more than one place of the corpus is asked of its
suffixes, in the manner of blockwise suffix sorting with a difference cover D modulo v:

1. The cover sample, positions p of a text with ``p mod v`` in D, gets ranks: the names
   of the ``400 - v + 1`` bytes from there. For any two residues D holds a pair with
   their difference, so two suffixes that agree in 400 bytes have, less than v bytes
   on, sampled positions at one distance, whose ranks tie. Suffixes without a tied
   sample in reach have no partner; that leaves about a tenth of all.
2. Long ties are resolved by ranks as well: tied samples that agree in all bytes any
   suffix in reach of them needs settle these suffixes without looking at them. Only
   the least occurrence of such a stretch stands for it in the next step.
3. The suffixes left are sorted by their first 400 bytes, as their name.

Each step deals its names to buckets and sorts one bucket at a time, in numpy; the
number of buckets follows the bytes of text, so a bucket's memory doesn't. Suffixes
are sorted by names (64-bit polynomial hashes over randomly drawn byte codes, dealt by
a second hash) and not by letters, as only ties matter here.

A map task sorts the names of its own texts first and sends each but once, with the
place of one occurrence; further occurrences are known to be repeated and needn't
travel. So a passage that a third of all documents share gives a bucket one row entry
a task batch. Texts that occur more than once are settled by their digests: such a text
goes in whole, and only one copy of it takes part above.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import durable, only, small_batches

WIDTH = 400
#: The cover's modulus is q * q + q + 1 for a prime q; q + 1 of its residues are sampled.
Q = 11
V = Q * Q + Q + 1
#: Names of a bucket, and names of a map task's batch.
BUCKET_NAMES, BATCH_NAMES = 1 << 20, 3 << 19
#: Digests that are broadcast at most (about 100 bytes each).
FEW = 200_000
#: Bytes whose prefix sums are held at once.
STRETCH = 1 << 18

_ENTRY = ("bucket int, batch long, kind int, names binary, places binary, again binary, digests array<binary>, starts array<long>")
_FOUND = "batch long, kind int, places binary, first binary, digests array<binary>, starts array<long>"


@lru_cache(1)
def difference_cover(q: int = Q) -> np.ndarray:
    """q + 1 residues whose differences give each residue modulo ``q * q + q + 1``: the zeros of a linear recurrence of degree 3 modulo the prime q."""
    v = q * q + q + 1
    for a, b, c in product(range(q), range(q), range(1, q)):
        s = [0, 0, 1]
        while len(s) < v:
            s.append((a * s[-1] + b * s[-2] + c * s[-3]) % q)
        zeros = [i for i, x in enumerate(s) if x == 0]
        if len(zeros) == q + 1 and len({(x - y) % v for x in zeros for y in zeros}) == v:
            return np.array(zeros)
    raise ValueError(f"{q} isn't prime")


class Names:
    """Names of byte windows: a polynomial over random byte codes, modulo 2**64, by prefix sums."""

    def __init__(self, seed: int, reach: int, stretch: int) -> None:
        self.stretch = stretch
        rng = np.random.default_rng(seed)
        self.codes = rng.integers(0, 2**64, 256, dtype=np.uint64)
        base = int(rng.integers(0, 2**63, dtype=np.uint64)) * 2 + 1
        n = stretch + reach + 1
        self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b % 2**64, np.uint64)])) for b in (base, pow(base, -1, 2**64)))

    def of(self, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The names of ``data[first:end]``, ``first`` ascending; windows are at most ``reach`` long."""
        out, i = np.empty(len(first), np.uint64), 0
        while i < len(first):
            a = int(first[i])
            j = int(np.searchsorted(first, a + self.stretch))
            z = int(end[i:j].max())
            sums = np.zeros(z - a + 1, np.uint64)
            np.cumsum(self.codes[data[a:z]] * self.down[:z - a], out=sums[1:])
            at = first[i:j] - a
            out[i:j] = (sums[end[i:j] - a] - sums[at]) * self.up[at]
            i = j
        return mixed(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over the word; one to one."""
    for shift, odd in ((32, 0xD6E8FEB86659FD93), (29, 0xFF51AFD7ED558CCD), (32, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(odd)
    return h


@lru_cache(3)
def namer(seed: int, stretch: int) -> Names:
    return Names(seed, WIDTH + 2 * V, stretch)


class Batches:
    """Collects names with their places and gives them out by bucket, each name once.

    A place is a number within the batch; the batch's own row tells which text starts
    where. Batches are numbered by partition and turn, so a task that runs again over
    the same rows gives the same numbers.
    """

    def __init__(self, buckets: int, short: bool, most: int) -> None:
        self.buckets, self.short, self.most, self.turn = buckets, short, most, 0
        self._begin()

    def _begin(self) -> None:
        self.names, self.deals, self.places, self.digests, self.starts, self.size, self.held = [], [], [], [], [], 0, 0

    def add(self, digests: list, starts: np.ndarray, size: int, places: np.ndarray, names: np.ndarray, deals: np.ndarray) -> None:
        """``deals`` choose the bucket; ``starts`` and ``places`` count from 0 over ``size`` bytes of these texts."""
        self.digests += digests
        self.starts.append(starts + self.size)
        self.places.append((places + self.size).astype(np.uint32))
        self.names.append(names)
        self.deals.append(deals)
        self.size += size
        self.held += len(names)

    def full(self) -> bool:
        return self.held >= self.most or self.size >= 1 << 31

    def flush(self):
        if not self.held:
            self._begin()
            return
        batch, self.turn = (TaskContext.get().partitionId() << 32) + self.turn, self.turn + 1
        names, deals, places = map(np.concatenate, (self.names, self.deals, self.places))
        order = np.argsort(names)
        names, places = names[order], places[order]
        new = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        count = np.diff(np.append(new, len(names)))
        least = np.minimum.reduceat(places, new)
        rest = places != np.repeat(least, count)
        bucket = (deals[order][new] >> np.uint64(32)).astype(np.uint64) % np.uint64(self.buckets)
        inside = np.argsort(bucket.astype(np.uint16) if self.buckets <= 1 << 16 else bucket, kind="stable")  # names stay in order
        bucket, names, least, again = bucket[inside], names[new][inside], least[inside], count[inside] > 1
        if self.short:
            names = (names >> np.uint64(32)).astype(np.uint32)
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() + [len(bucket)]
        rows = [(int(bucket[a]), batch, 0, names[a:b].tobytes(), least[a:b].tobytes(), np.packbits(again[a:b]).tobytes(), None, None) for a, b in zip(cuts, cuts[1:], strict=False)]
        own = batch % self.buckets
        rows.append((own, batch, 1, None, None, None, self.digests, np.concatenate(self.starts)))
        if rest.any():
            rows.append((own, batch, 2, None, places[rest].tobytes(), None, None, None))
        self._begin()
        types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [f.split()[0] for f in _ENTRY.split(", ")])


def _laid_out(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts, and where each starts; the last number is the end."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if large else np.int32
    at = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
    return data, at - at[0]


def cover_names(buckets: int):
    """Step 1: ranks of the cover sample of (digest, text)."""
    width, residues, most, stretch = WIDTH - V + 1, difference_cover(), BATCH_NAMES, STRETCH

    def run(batches):
        out, name, sample = Batches(buckets, True, most), namer(1, stretch), np.zeros(0, np.int64)
        for batch in batches:
            data, at = _laid_out(batch.column(1))
            longest = int(np.diff(at).max(initial=0))
            if not len(sample) or sample[-1] < longest:
                sample = (np.arange(longest // V + 2)[:, None] * V + residues).ravel()
            reach = np.searchsorted(sample, np.diff(at) - width, side="right")
            if places := [sample[:n] + a for n, a in zip(reach.tolist(), at[:-1].tolist(), strict=True) if n]:
                first = np.concatenate(places)
                names = name.of(data, first, first + width)
                out.add(batch.column(0).to_pylist(), at[:-1], len(data), first, names, names << np.uint64(32))
            if out.full():
                yield from out.flush()
        yield from out.flush()

    return run


def around(sample: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end of all bytes that suffixes in reach of sampled positions need, in a text of n bytes."""
    return np.maximum(sample - (V - 1), 0), np.minimum(sample + WIDTH + V - 1, n)


def stretch_names(buckets: int):
    """Step 2: names of the stretches around the tied samples of (digest, text, tied)."""
    most, stretch = BATCH_NAMES, STRETCH

    def run(batches):
        out, name, deal = Batches(buckets, False, most), namer(2, stretch), namer(3, stretch)
        for batch in batches:
            data, at = _laid_out(batch.column(1))
            for k, (digest, tied) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                own, sample = data[at[k]:at[k + 1]], np.frombuffer(tied, np.uint32).astype(np.int64)
                first, end = around(sample, len(own))
                shape = ((sample - first) * 2048 + end - first).astype(np.uint64)
                names, deals = (mixed(n.of(own, first, end) ^ mixed(shape + np.uint64(1))) for n in (name, deal))
                out.add([digest], np.zeros(1, np.int64), len(own), sample, names, deals)
                if out.full():
                    yield from out.flush()
        yield from out.flush()

    return run


def joined(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals whose ``first`` ascends; touching ones become one."""
    if not len(first):
        return first, end
    top = np.maximum.accumulate(end)
    new = np.flatnonzero(np.concatenate([[True], first[1:] > top[:-1]]))
    return first[new], np.maximum.reduceat(end, new)


def without(first: np.ndarray, end: np.ndarray, gone_first: np.ndarray, gone_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint ascending intervals less others."""
    marks = np.concatenate([first, end, gone_first, gone_end])
    step = np.concatenate([np.ones(len(first), int), -np.ones(len(end), int), -np.full(len(gone_first), 2), np.full(len(gone_end), 2)])
    order = np.argsort(marks, kind="stable")
    marks, level = marks[order], np.cumsum(step[order])
    keep = (level[:-1] == 1) & (marks[1:] > marks[:-1])
    return marks[:-1][keep], marks[1:][keep]


def open_suffixes(n: int, tied: np.ndarray, settled: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of suffixes in reach of a tied sample, but for those that another occurrence of a repeated stretch stands for."""
    first, end = joined(np.maximum(tied - (V - 1), 0), np.minimum(tied, n - WIDTH) + 1)
    other = settled[~least]
    a, z = around(other, n)
    return without(first, end, *joined(a, z - WIDTH + 1))


def suffix_names(buckets: int, piece: int = 1 << 19):
    """Step 3: names of the suffixes of (digest, text, tied, settled, least) that the steps before leave open."""
    most, stretch = BATCH_NAMES, STRETCH

    def run(batches):
        out, name, deal = Batches(buckets, False, most), namer(2, stretch), namer(3, stretch)
        for batch in batches:
            data, at = _laid_out(batch.column(1))
            rows = zip(*[batch.column(k).to_pylist() for k in (0, 2, 3, 4)], strict=True)
            for k, (digest, tied, settled, least) in enumerate(rows):
                own = data[at[k]:at[k + 1]]
                places = np.frombuffer(settled or b"", np.uint32).astype(np.int64)
                first, end = open_suffixes(len(own), np.frombuffer(tied, np.uint32).astype(np.int64), places, np.unpackbits(np.frombuffer(least or b"", np.uint8), count=len(places)).astype(bool))
                for a, z in zip(first.tolist(), end.tolist(), strict=True):
                    for b in range(a, z, piece):
                        suffix = np.arange(b, min(b + piece, z))
                        out.add([digest], np.zeros(1, np.int64), len(own), suffix, *(n.of(own, suffix, suffix + WIDTH) for n in (name, deal)))
                        if out.full():
                            yield from out.flush()
        yield from out.flush()

    return run


def _sorted_bucket(short: bool):
    """Sorts one bucket's names; gives the places of those that come up again, with a bit for a name's least place."""
    kind = np.uint32 if short else np.uint64

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["batch", "kind", "names", "places", "again", "digests", "starts"]).to_pylist()
        found = [(r["batch"], r["kind"], r["places"], None, r["digests"], r["starts"]) for r in rows if r["kind"]]
        if own := sorted((r for r in rows if not r["kind"]), key=lambda r: r["batch"]):
            parts = [np.frombuffer(r["names"], kind) for r in own]
            names = np.concatenate(parts)
            again = np.concatenate([np.unpackbits(np.frombuffer(r["again"], np.uint8), count=len(p)) for r, p in zip(own, parts, strict=True)]).astype(bool)
            order = np.argsort(names, kind="stable")  # a name's entries stay in the order of batches
            ranked = names[order]
            new = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            count = np.diff(np.append(new, len(ranked)))
            tied = np.zeros(len(names), bool)
            tied[order] = np.repeat((count > 1) | np.logical_or.reduceat(again[order], new), count)
            first = np.zeros(len(names), bool)
            first[order[new]] = True
            at = 0
            for r, p in zip(own, parts, strict=True):
                mine = tied[at:at + len(p)]
                if mine.any():
                    found.append((r["batch"], 0, np.frombuffer(r["places"], np.uint32)[mine].tobytes(), np.packbits(first[at:at + len(p)][mine]).tobytes(), None, None))
                at += len(p)
        types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()))
        columns = list(zip(*found, strict=True)) or [()] * len(types)
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in _FOUND.split(", ")])

    return run


def _placed(table: pa.Table) -> pa.Table:
    """One batch's places as positions in its texts: (digest, at, least)."""
    rows = table.to_pylist()
    texts = [r for r in rows if r["kind"] == 1]
    found = [r for r in rows if r["kind"] != 1]
    if found and len(texts) != 1:
        raise RuntimeError("a batch came without its texts: the input changed between two runs of a task")
    out = []
    if found:
        places = np.concatenate([np.frombuffer(r["places"], np.uint32) for r in found]).astype(np.int64)
        least = np.concatenate([np.unpackbits(np.frombuffer(r["first"], np.uint8), count=len(r["places"]) // 4).astype(bool) if r["kind"] == 0 else np.zeros(len(r["places"]) // 4, bool) for r in found])
        order = np.argsort(places)
        places, least = places[order], least[order]
        starts = np.array(texts[0]["starts"], np.int64)
        of = np.searchsorted(starts, places, side="right") - 1
        cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])).tolist() + [len(of)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            out.append((texts[0]["digests"][of[a]], (places[a:b] - starts[of[a]]).astype(np.uint32).tobytes(), np.packbits(least[a:b]).tobytes()))
    columns = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.Table.from_arrays([pa.array(list(c), pa.binary()) for c in columns], ["digest", "at", "least"])


def repeated_places(named: DataFrame, short: bool) -> DataFrame:
    """(digest, at, least) of what a step's map gives: positions of names that come up again, ascending unsigned 32-bit, and a bit each for the least one of all."""
    found = named.groupBy("bucket").applyInArrow(_sorted_bucket(short), _FOUND)
    return found.groupBy("batch").applyInArrow(_placed, "digest binary, at binary, least binary")


def _cut(batches):
    """(digest, text, settled, suffixes) to spans and what they leave."""
    fields = [("digest", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    for batch in batches:
        data, at = _laid_out(batch.column(1))
        out = []
        for k, (digest, settled, suffixes) in enumerate(zip(*[batch.column(c).to_pylist() for c in (0, 2, 3)], strict=True)):
            own = data[at[k]:at[k + 1]]
            a, z = around(np.sort(np.frombuffer(settled, np.uint32).astype(np.int64)), len(own))
            s = np.sort(np.frombuffer(suffixes, np.uint32).astype(np.int64))
            first, end = np.concatenate([a, s]), np.concatenate([z, s + WIDTH])
            order = np.argsort(first, kind="stable")
            first, end = joined(first[order], end[order])
            kept, before = hashlib.sha256(), 0
            for x, y in zip(first.tolist(), end.tolist(), strict=True):
                kept.update(own[before:x])
                before = y
            kept.update(own[before:])
            out.append((digest, int((end - first).sum()), len(first), kept.hexdigest(), [{"start": x, "end": y} for x, y in zip(first.tolist(), end.tolist(), strict=True)]))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(list(zip(*out, strict=True)) or [()] * 5, fields, strict=True)], [n for n, _ in fields])


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def repeated_spans(texts: DataFrame, size: int) -> DataFrame:
    """(digest, n_removed, n_spans, kept_sha256, spans) of distinct ``texts`` (digest, text) of at least 400 bytes, ``size`` bytes in all, that hold a repeated string."""
    least = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ways = lambda names: max(least, -(-names // BUCKET_NAMES))
    found = durable(repeated_places(texts.mapInArrow(cover_names(ways(size * (Q + 1) // V)), _ENTRY), True).select("digest", F.col("at").alias("tied")), "cover-ties")
    found = found.where(F.col("digest").isNotNull())
    near = durable(only(texts, found.select("digest"), "digest", True, FEW).join(found, "digest").select("digest", "text", "tied"), "tied-texts")
    left = near.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    settled = durable(repeated_places(near.mapInArrow(stretch_names(ways(left * (Q + 1) // V)), _ENTRY), False), "settled-stretches")
    opened = near.join(settled.withColumnRenamed("at", "settled"), "digest", "left").select("digest", "text", "tied", "settled", "least")
    suffixes = repeated_places(opened.mapInArrow(suffix_names(ways(left)), _ENTRY), False)
    none = F.lit(b"")
    both = settled.select("digest", F.col("at").alias("settled"), none.alias("suffixes")).union(suffixes.select("digest", none, "at"))
    both = both.groupBy("digest").agg(*[F.unhex(F.array_join(F.collect_list(F.hex(c)), "")).alias(c) for c in ("settled", "suffixes")])  # a text's own places
    return near.join(both, "digest").select("digest", "text", "settled", "suffixes").mapInArrow(
        _cut, "digest binary, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (byte ranges that are removed) of every document.

    Null texts are empty ones. Texts below 400 bytes keep everything, however often
    they come up; of longer texts that come up more than once nothing is left.
    Repeated rows are such texts. A null doc_id is given back as it is and has no part
    in the work, nor have other columns. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    body = F.coalesce("text", F.lit(""))
    rows = durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(body).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes")), "digests")
    counts = rows.groupBy("digest", "n_bytes").agg(F.count(F.lit(1)).alias("n"))
    counts = durable(counts, "copies")
    long = docs.select(body.alias("text")).where(F.octet_length("text") >= WIDTH).select(text_digest(F.col("text")).alias("digest"), "text")
    copied = counts.where((F.col("n") > 1) & (F.col("n_bytes") >= WIDTH)).select("digest")
    once = durable(only(long, copied, "digest", True, FEW).groupBy("digest").agg(F.first("text").alias("text")), "copied-texts")
    texts = only(long, copied, "digest", False, FEW).union(once)
    size = counts.where(F.col("n_bytes") >= WIDTH).agg(F.sum("n_bytes")).first()[0] or 0
    spans = repeated_spans(texts, size)
    whole = F.col("n") > 1
    none = F.array().cast("array<struct<start: long, end: long>>")
    long_enough = F.col("n_bytes") >= WIDTH
    each = counts.join(spans, "digest", "left").select(
        "digest", F.when(whole & long_enough, F.col("n_bytes")).when(whole, 0).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole & long_enough, 1).when(whole, 0).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole & long_enough, F.lit(hashlib.sha256(b"").hexdigest())).when(whole, F.lower(F.hex("digest"))).otherwise(
            F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        F.when(whole & long_enough, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).when(whole, none).otherwise(F.coalesce("spans", none)).alias("spans"))
    return rows.join(each, "digest").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
