"""SimHash near-duplicates by an inverted index over byte positions with count filtering.

A fingerprint has eight positional bytes. Two that differ in at most two bits differ in
at most two bytes and share six at least. The index lists each fingerprint under all 28
choices of six positional bytes, so such a pair meets in one list or more. The
positional bytes that a pair shares are tallied, pairs that reach the guaranteed six
are kept, and a bit count verifies them.

Members of a list differ in two bytes alone. A list is never paired up: its members
meet at the values of these two bytes that are at most one bit from their own, 17 each,
and two of them are within two bits exactly if they meet so. At most 17 can meet at one
value, and a fingerprint has 2,080 neighbours at most, so the work grows with the
fingerprints at any size.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomline.llm.common import by_name, discard, durable, fields_of, fresh, only, shuffled, small_batches
from fathomline.llm.graph import components

BITS = 2
#: Positional bytes that a list's members share, and so what a pair must reach.
GUARANTEED = 6
#: Set bits of every byte value, by bit.
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str, size: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of the ``size``-word shingles of a text, A-Z lower-cased, words parted by ASCII white space."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(len(words) - size + 1, 1)
    first = [0, *(ends[:n - 1] + 1).tolist()]
    last = ends[size - 1:].tolist() if len(words) >= size else [len(joined)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(first, last, strict=True)], [seed] * n), np.uint64, n)
    columns = hashes.astype(">u8").view(np.uint8).reshape(n, 8)
    counts = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], out: str = "fp") -> DataFrame:
    """The columns ``keep`` with ``out``, the fingerprint as a signed long; ``text`` may be kept."""
    spark = docs.sparkSession
    small_batches(spark)
    at = len(keep)
    source = docs.select(*by_name(keep), F.coalesce("text", F.lit("")).alias(*fresh(keep, "body")))

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(found)], [*keep, out])

    return source.mapInArrow(run, f"{fields_of(source, keep)}, `{out}` long")


def postings(prints: DataFrame) -> DataFrame:
    """(slot, bytes, rest, fp): every distinct fingerprint of ``prints`` (fp) under each six of its positional bytes; ``rest`` holds the other two."""
    fp = F.col("fp")
    rows = []
    for slot, (j, k) in enumerate(combinations(range(8), 2)):
        mask = (255 << 8 * j) | (255 << 8 * k)
        rest = F.shiftrightunsigned(fp, 8 * j).bitwiseAND(F.lit(255)) + 256 * F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(255))
        rows.append(F.struct(F.lit(slot).cast("byte").alias("slot"), fp.bitwiseAND(F.lit(signed(~mask))).alias("bytes"), rest.cast("int").alias("rest")))
    return prints.select("fp", F.inline(F.array(*rows)))


def signed(x: int) -> int:
    return (x & (1 << 64) - 1) - (1 << 64) * ((x >> 63) & 1)


def met(index: DataFrame) -> DataFrame:
    """(u, v): pairs of fingerprints that share a list of ``index`` and lie within two bits of each other there."""
    whole = W.partitionBy("slot", "bytes")  # at most 65,536 rows
    shared = durable(index.withColumns({"a": F.min("fp").over(whole), "b": F.max("fp").over(whole)}).where("a < b").drop("a", "b"), "byte-lists")
    near = shared.select("slot", "bytes", "fp", F.explode(F.array(F.col("rest"), *[F.col("rest").bitwiseXOR(F.lit(1 << k)) for k in range(16)])).alias("at"))
    x, y = near.alias("x"), near.alias("y")
    same = reduce(lambda p, q: p & q, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("slot", "bytes", "at")])
    return x.join(y, same & (F.col("x.fp") < F.col("y.fp"))).select(F.col("x.fp").alias("u"), F.col("y.fp").alias("v")).distinct()


def tallied(pairs: DataFrame, least: int = GUARANTEED) -> DataFrame:
    """(u, v, matches): the pairs that share at least ``least`` positional bytes."""
    differing = F.col("u").bitwiseXOR(F.col("v"))
    matches = sum((F.when(F.shiftrightunsigned(differing, 8 * k).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for k in range(8)), F.lit(0))
    return pairs.withColumn("matches", matches).where(F.col("matches") >= least)


def verified(pairs: DataFrame) -> DataFrame:
    """(u, v) of the pairs that differ in at most two bits."""
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= BITS).select("u", "v")


def links(prints: DataFrame) -> DataFrame:
    """(u, v): all pairs of the distinct fingerprints of ``prints`` (fp) that differ in at most two bits."""
    return verified(tallied(met(postings(prints))))


def group_prints(found: DataFrame) -> DataFrame:
    """(fp, component_id) of ``found`` (doc_id, fp): the smallest doc_id reachable over links, its own included."""
    each = durable(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    of = components(links(each.select("fp"))).withColumnRenamed("node", "fp")
    named = each.join(of, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    joint = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return durable(named.join(joint, "component").select("fp", "component", "component_id"), "groups")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Null and empty texts, and texts of white space, have the fingerprint zero and link
    like any other. Repeated rows give repeated rows in one component; a null doc_id
    gets its component's id and is none itself unless no member has one (then null).
    Extra columns are ignored; an empty table gives no rows. Ties cannot arise.
    """
    found = durable(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"]), "fingerprints")
    return found.join(group_prints(found), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


class _WordHashes(dict):
    """Hashes of words, each counted once; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def shingle_set(text: str, size: int, hashes: _WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the ``size``-word shingles, words as in ``fingerprint``; a shorter text is one shingle."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    of = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(len(of) - size + 1, 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(of))):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + of[k:k + n]
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


@dataclass(frozen=True)
class Bound:
    """A similarity p / q over sets of shingles (shared ones by all of both), in whole numbers."""

    p: int
    q: int

    @classmethod
    def of(cls, similarity: float) -> Bound:
        exact = Fraction(str(similarity))
        if not 0 < exact <= 1:
            raise ValueError("the similarity lies above 0 and reaches at most 1")
        return cls(exact.numerator, exact.denominator)

    def prefix(self, n):
        """Two similar sets share one of the first so many members of each, in any common order."""
        return n + (-self.p * n) // self.q + 1

    def shared(self, both):
        """The least number of shared members of similar sets with ``both`` members in all."""
        return -((-self.p * both) // (self.p + self.q))


def common_shingles(found: DataFrame, size: int, sample_rows: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of shingles frequent in a sample of ``found`` (text), sorted by hash.

    They only order the shingles, rare ones first: any order gives the same pairs.
    """
    rows = found.count()
    part = found.select("text") if rows <= sample_rows else found.select("text").sample(fraction=sample_rows / rows, seed=1)

    def run(batches):
        hashes = _WordHashes()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.record_batch({"h": pa.array(shingle_set(text or "", size, hashes).view(np.int64))})

    top = part.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(most).toArrow()
    h, n = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix_index(found: DataFrame, size: int, bound: Bound, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(h, same, n, pos): the first members, rare ones first, of every shingle set of ``found`` (_same, text); n members in all."""
    shared = found.sparkSession.sparkContext.broadcast(common)  # at most ``most`` hashes

    def run(batches):
        hashes, seen = _WordHashes(), set()
        known, counts = shared.value
        for batch in batches:
            out = []
            for same, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if same in seen:  # a copy's set was indexed already
                    continue
                seen.add(same)
                h = shingle_set(text or "", size, hashes)
                n, often = len(h), np.zeros(len(h), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    often = np.where(known[at] == h, counts[at], 0)
                first = h[np.argsort(often, kind="stable")[:bound.prefix(n)]]
                out.append((first, same, n))
            if out:
                sizes = [len(f) for f, _, _ in out]
                yield pa.record_batch({
                    "h": pa.array(np.concatenate([f for f, _, _ in out]).view(np.int64)),
                    "same": pa.array(np.repeat(np.array([s for _, s, _ in out], np.int64), sizes)),
                    "n": pa.array(np.repeat(np.array([n for _, _, n in out], np.int32), sizes)),
                    "pos": pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in sizes]))})

    return found.select("_same", "text").mapInArrow(run, "h long, same long, n int, pos int")


def by_list(index: DataFrame, work, schema: str) -> DataFrame:
    """``work`` over whole lists of ``index`` (h, same, n, ...), each sorted by n, then same: gets a batch's columns as arrays, yields record batches."""

    def run(batches):
        held = []  # the parts of the last list, which may go on in the next batch; put together once, when it ends

        def whole():
            return [np.concatenate(x) for x in zip(*held, strict=True)]

        for batch in batches:
            now = [c.to_numpy() for c in batch.columns]
            if not len(now[0]):
                continue
            if held and now[0][0] != held[-1][0][0]:
                yield from work(*whole())
                held = []
            cut = int(np.searchsorted(now[0], now[0][-1]))
            if cut and held:
                first = int(np.searchsorted(now[0], now[0][0], side="right"))
                held.append([c[:first] for c in now])
                yield from work(*whole())
                held = []
                if cut > first:
                    yield from work(*[c[first:cut] for c in now])
            elif cut:
                yield from work(*[c[:cut] for c in now])
            held.append([c[cut:] for c in now])
        if held:
            yield from work(*whole())

    return index.repartition("h").sortWithinPartitions("h", "n", "same").mapInArrow(run, schema)


def shared_lists(index: DataFrame) -> DataFrame:
    """(h, same, n, pos, size): the lists that two sets share at least, with their size."""

    def work(h, same, n, pos):
        keep = np.append(True, (h[1:] != h[:-1]) | (same[1:] != same[:-1]))
        h, same, n, pos = h[keep], same[keep], n[keep], pos[keep]
        size = np.diff(np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h)))
        size = np.repeat(size, size)
        some = size > 1
        yield pa.record_batch({"h": h[some], "same": same[some], "n": n[some], "pos": pos[some], "size": size[some]})

    return by_list(index, work, "h long, same long, n int, pos int, size long")


def star_pairs(lists: DataFrame, bound: Bound) -> DataFrame:
    """(u, v): every set u with the lead of its lists that it meets most.

    A list's lead is the set whose rare shingles are shared most often altogether: the
    text that a group of near copies comes from, if it is there, for a copy's changes
    are its own.
    """
    weight = lists.groupBy("same").agg(F.sum("size").alias("weight"))
    lead = lists.join(weight, "same").groupBy("h").agg(F.max(F.struct("weight", "same", "n")).alias("l")).select("h", F.col("l.same").alias("lead"), F.col("l.n").alias("lead_n"))
    p, q = bound.p, bound.q
    near = lists.join(lead, "h").where((F.col("same") != F.col("lead")) & (q * F.col("lead_n") >= p * F.col("n")) & (q * F.col("n") >= p * F.col("lead_n")))
    met = near.groupBy("same", "lead").agg(F.count(F.lit(1)).alias("c"))
    return met.groupBy("same").agg(F.max_by("lead", F.struct("c", "lead")).alias("lead")).select(F.col("same").alias("u"), F.col("lead").alias("v"))


def bit_maps(found: DataFrame, sets: DataFrame, size: int, longs: int = 16) -> DataFrame:
    """(same, m0, m1, ...): for every one of the ``sets`` (_same) a map of 64 x ``longs`` bits, one set for each shingle, by its hash."""
    names = [f"m{k}" for k in range(longs)]
    rows = found.select("_same", "_row").join(shuffled(sets), "_same", "left_semi").groupBy("_same").agg(F.min("_row").alias("_row")).select("_row")
    texts = only(found.select("_row", "_same", "text"), durable(rows, "mapped-rows"), "_row", keep=True).select("_same", "text")

    def run(batches):
        hashes = _WordHashes()
        for batch in batches:
            maps = np.zeros((batch.num_rows, 64 * longs), np.uint8)
            for i, text in enumerate(batch.column(1).to_pylist()):
                maps[i, (shingle_set(text or "", size, hashes) >> np.uint64(20)) % np.uint64(64 * longs)] = 1
            packed = np.packbits(maps, axis=1).view(np.int64)
            yield pa.record_batch({"same": batch.column(0)} | {n: pa.array(packed[:, k]) for k, n in enumerate(names)})

    return texts.mapInArrow(run, "same long, " + ", ".join(f"{n} long" for n in names))


def meetings(lists: DataFrame, bound: Bound, rows_out: int = 100_000, back: int = 4) -> DataFrame:
    """(u, v): the pairs of sets of different components that meet in some list of ``lists`` (h, same, n, pos, component) and whose sizes and places there don't rule the similarity out.

    A set's rows carry its ``back`` shared shingles before (b1, b2, ...); where two sets
    have one of those in common they met there already, and the pair isn't made again. The
    first shingle they share always makes it. Rows may also carry their set's bit map (m0,
    m1, ...): every bit that differs is a shingle that only one of the two has, which
    rules out pairs with more of them than similar sets can have.
    """
    maps = [c for c in lists.columns if c[0] == "m" and c[1:].isdigit()]

    def work(h, same, n, pos, component, *rest):
        past, bits = rest[:back], rest[back:]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(start, len(h)))
        mixed = np.repeat(np.minimum.reduceat(component, start) != np.maximum.reduceat(component, start), size)
        h, same, n, pos, component = h[mixed], same[mixed], n[mixed].astype(np.int64), pos[mixed].astype(np.int64), component[mixed]
        past, bits = [x[mixed] for x in past], [x[mixed] for x in bits]
        i, d = np.arange(len(h) - 1), 1
        while len(i):
            i = i[i + d < len(h)]
            j = i + d
            on = (h[i] == h[j]) & (bound.q * n[i] >= bound.p * n[j])  # sorted by size within a list: nothing further on passes either
            i, j = i[on], j[on]
            most = np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j])
            ok = (component[i] != component[j]) & (most >= bound.shared(n[i] + n[j]))
            x, y = i[ok], j[ok]
            for a in past:
                for b in past:
                    new = a[x] != b[y]
                    x, y = x[new], y[new]
            if bits and len(x):
                differ = sum(np.bitwise_count((m[x] ^ m[y]).view(np.uint64)).astype(np.int64) for m in bits)
                near = differ <= n[x] + n[y] - 2 * bound.shared(n[x] + n[y])
                x, y = x[near], y[near]
            for k in range(0, len(x), rows_out):
                a, b = same[x[k:k + rows_out]], same[y[k:k + rows_out]]
                yield pa.record_batch({"u": np.minimum(a, b), "v": np.maximum(a, b)})
            d += 1

    return by_list(lists.select("h", "same", "n", "pos", "component", *[f"b{k}" for k in range(1, back + 1)], *maps), work, "u long, v long")


def with_past(lists: DataFrame, back: int = 4) -> DataFrame:
    """Adds b1, b2, ...: the set's shared shingles before, its own number where there is none."""
    before = W.partitionBy("same").orderBy("pos")
    return lists.withColumns({f"b{k}": F.coalesce(F.lag("h", k).over(before), "same") for k in range(1, back + 1)})


def set_rows(found: DataFrame) -> DataFrame:
    """(_same, _row): each set of ``found`` with the first row that has it."""
    return durable(found.groupBy("_same").agg(F.min("_row").alias("_row")), "set-rows")


def parity_map(shingles: np.ndarray, least: int = 1024) -> np.ndarray:
    """Whether an odd number of the hashes falls on each bit, as bytes; no fewer bits than hashes, a power of two, so that a longer map folds to a shorter one."""
    bits = max(least, 1 << (len(shingles) - 1).bit_length())
    return np.packbits((np.bincount((shingles >> np.uint64(20)).astype(np.int64) & bits - 1, minlength=bits) & 1).astype(np.uint8))


def odd_bits(a: np.ndarray, b: np.ndarray) -> int:
    """The bits of two parity maps that differ: each stands for a shingle that only one set has, at least."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    return int(np.bitwise_count(short ^ np.bitwise_xor.reduce(long.reshape(-1, len(short)), axis=0)).sum())


def brought(found: DataFrame, column: str, sets: DataFrame, pairs: DataFrame, name: str, group: int, few: int) -> DataFrame:
    """(v, part, turn, _same, ``column`` ...): each v's row of ``found``, then those of its partners u, once for each ``group`` of them, so that a set with very many partners is shared by several tasks.

    What goes where is broadcast where it is at most ``few`` rows (about 100 bytes each);
    then only rows that are compared move, and once.
    """
    parts = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("parts"))
    asked = pairs.join(shuffled(parts), "v").select(F.col("u").alias("_same"), "v", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("turn"))
    leads = parts.select(F.col("v").alias("_same"), "v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("turn"))
    asked = durable(asked.union(leads).join(shuffled(sets), "_same"), name)
    sent = found.select("_row", column).join(F.broadcast(asked) if asked.count() <= few else asked, "_row")
    return sent.repartition("v", "part").sortWithinPartitions("v", "part", "turn").select("v", "part", "turn", "_same", column)


def held_against(batches, read, passes):
    """The pairs (u, v) of ``brought`` rows that pass; ``read`` makes of a value what is compared."""
    now, lead = None, None
    for batch in batches:
        out = []
        for v, part, turn, u, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            own = read(value)
            if turn == 0:
                now, lead = (v, part), own
                continue
            if now != (v, part):
                raise RuntimeError("a set came without the one it is compared with")
            if passes(lead, own):
                out.append((u, v))
        yield pa.record_batch({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})


def likely(found: DataFrame, sets: DataFrame, pairs: DataFrame, bound: Bound, group: int = 256, few: int = 400_000) -> DataFrame:
    """The pairs (u, v) whose parity maps (_map, of ``_n`` shingles) don't rule the similarity out: sets that are alike differ in few shingles, others meet by a rare one."""
    both = found.select("_row", F.struct("_map", "_n").alias("_of"))

    def run(batches):
        read = lambda x: (np.frombuffer(x["_map"], np.uint8), x["_n"])
        yield from held_against(batches, read, lambda a, b: odd_bits(a[0], b[0]) <= a[1] + b[1] - 2 * bound.shared(a[1] + b[1]))

    return brought(both, "_of", sets, pairs, "asked-maps", group, few).mapInArrow(run, "u long, v long")


def alike(found: DataFrame, sets: DataFrame, pairs: DataFrame, size: int, bound: Bound, group: int = 256, few: int = 400_000) -> DataFrame:
    """The pairs (u, v) of ``sets`` (_same, _row) whose similarity reaches the bound: the sets of their rows' texts in ``found`` (_row, text) are compared in full.

    Where rows have parity maps (_map, _n), pairs that these rule out are dropped first
    (``likely``), so texts move only for pairs that are alike, or nearly.
    """
    p, q = bound.p, bound.q
    if "_map" in found.columns:
        pairs = durable(likely(found, sets, pairs, bound, group, few), "likely")

    def run(batches):
        hashes = _WordHashes()

        def passes(lead, own):
            both = len(np.intersect1d(lead, own, assume_unique=True))
            return q * both >= p * (len(lead) + len(own) - both)

        yield from held_against(batches, lambda text: shingle_set(text or "", size, hashes), passes)

    return brought(found, "text", sets, pairs, "asked-texts", group, few).mapInArrow(run, "u long, v long")


def print_pairs(found: DataFrame) -> DataFrame:
    """(u, v): the sets of ``found`` (_same, _fp) by the index of fingerprints: each with the one that stands for its fingerprint, and those of fingerprints within two bits."""
    each = durable(found.select("_same", "_fp").distinct(), "set-prints")
    one = durable(each.groupBy(F.col("_fp").alias("fp")).agg(F.min("_same").alias("lead")), "print-leads")
    members = each.join(shuffled(one), F.col("_fp") == F.col("fp")).where("_same <> lead").select(F.col("_same").alias("u"), F.col("lead").alias("v"))
    of = lambda c: one.select(F.col("fp").alias(c), F.col("lead").alias(f"_{c}"))
    return members.union(shuffled(links(one.select("fp"))).join(of("u"), "u").join(shuffled(of("v")), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v")).where("u <> v"))


def similar_sets(found: DataFrame, size: int, similarity: float, sample_rows: int = 20_000, most: int = 100_000, crowd: int = 64) -> DataFrame:
    """(u, v): links that connect exactly the shingle sets of ``found`` (_same, _row, text, _fp) which pairs of ``similarity`` or more connect.

    Fingerprints (_fp, over shingles of the same size) within two bits give the first
    pairs, by the index over byte positions with its tally; they are compared in full. As
    alike sets may have fingerprints further apart, an exact way finds the rest: similar
    sets meet in an index of each one's rarest shingles (a prefix filter loses none).
    Every set is compared with one set it meets often there too, the likeliest source
    of its group of near copies, which takes one pair a set and joins most groups. Then
    all pairs that meet and aren't joined yet are compared in full, but for those of lists
    of ``crowd`` sets or more whose bit maps differ too much. Pairs within what is joined
    would add nothing, so a group's pairs aren't made. Texts move only for pairs that their
    parity maps (_map and _n, where ``found`` has them) let pass.
    """
    bound = Bound.of(similarity)
    lists = durable(shared_lists(prefix_index(found, size, bound, common_shingles(found, size, sample_rows, most))), "shared-lists")
    sets = set_rows(found)
    first = durable(alike(found, sets, durable(print_pairs(found).union(star_pairs(lists, bound)).distinct(), "stars"), size, bound), "star-links")
    joined = components(first).select(F.col("node").alias("same"), "component")
    marked = durable(with_past(lists.join(shuffled(joined), "same", "left").withColumn("component", F.coalesce("component", "same"))), "marked-lists")
    discard(lists)
    long = marked.where(F.col("size") >= crowd)
    maps = bit_maps(found, durable(long.select(F.col("same").alias("_same")).distinct(), "crowded"), size)
    met = meetings(marked.where(F.col("size") < crowd), bound).union(meetings(long.join(maps, "same"), bound))
    near = durable(met.distinct(), "meetings")
    discard(marked)
    return first.union(alike(found, sets, near, size, bound))


def drop_near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group, with all its columns: the smallest doc_id (a null one only where there is no other).

    Fingerprints within two bits, by their index, are the first links to be tried, and
    an exact way finds the others.
    Documents are linked whose sets of ``size``-word shingles have a similarity (shared
    ones by all of both) of ``similarity`` or more; groups are what links connect. Null
    and empty texts, and others without words, are alike. Equal ids and repeated rows
    are told apart by a row number given before anything else is done; of equal ids the
    first row stays. Columns may have any names; an empty table gives no rows. Texts are
    shuffled only where more rows are dropped than may be broadcast.
    """
    spark, columns = docs.sparkSession, docs.columns
    small_batches(spark)
    at = columns.index("text")
    source = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(by_name(columns))], F.monotonically_increasing_id().alias("_row"))

    def run(batches):
        hashes = _WordHashes()
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            same, maps, sizes = [], [], []
            for t in texts:
                own = shingle_set(t, size, hashes)
                same.append(xxhash.xxh64_intdigest(own.tobytes()))
                maps.append(parity_map(own).tobytes())
                sizes.append(len(own))
            prints = [fingerprint(t, size) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (same, prints)], pa.array(maps, pa.binary()), pa.array(sizes, pa.int32())], [*batch.schema.names, "_same", "_fp", "_map", "_n"])

    found = durable(source.mapInArrow(run, f"{fields_of(source, source.columns)}, _same long, _fp long, _map binary, _n int"), "shingled")
    joined = durable(similar_sets(found.select("_row", "_same", "_fp", "_map", "_n", F.col(f"c{at}").alias("text")), size, similarity), "similar")
    narrow = found.select(F.col(f"c{columns.index('doc_id')}").cast("long").alias("doc_id"), F.col("_same").alias("node"), "_row")
    named = narrow.join(shuffled(components(joined)), "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = named.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("best")).select(F.col("best._row").alias("_row"))
    dropped = durable(narrow.select("_row").join(first, "_row", "left_anti"), "dropped-rows")
    return only(found, dropped, "_row", keep=False).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
