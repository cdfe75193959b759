"""Packing of tokenised documents into sequences: dominance reduction, then best fit.

Tasks tokenise; what the driver sees is one count for each piece length, and the plan
holds every set of lengths once with how often it occurs, so its size and the driver's
work are bounded by the sequence length and not by the corpus. The plan fixes sets of
lengths that provably dominate every other way to place their longest member
(Martello and Toth), shrinks the instance by them, and gives the rest to best-fit
decreasing. Pieces of one length are interchangeable: each takes its place by its rank
among the pieces of that length.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomline.llm.common import durable, small_batches
from fathomline.llm.units import encode_units

# The published pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space between white space doesn't begin a token of its own; any other space does.
INSIDE_RUN = re.compile(r"\s \s")
#: The pattern steps back over a run of white space, one level of a stack for each character; longer runs don't go through it.
RUN, LONG_RUN = re.compile(r"\s\s+"), 10_000


class ByteBpe:
    """Byte-level BPE ids of whole texts, as the ``tokenizers`` library gives them for the vocabulary file.

    A space that isn't inside a run of white space always begins a token, so a text
    falls into units there, and a batch's distinct units are encoded once. Texts with
    such runs go through the encoder whole; those that hold a special token's string or a
    run of 10,000 or more go to the library itself, which takes any length.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.path, self._library = path, None
        self.special = [t["content"] for t in said.get("added_tokens", [])]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        rest = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in said["model"]["vocab"].items() if t not in self.special}
        encoder = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = lambda text: np.array(encoder.encode_ordinary(text), "<u4")
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            self.width[i] = len(t)

    def library(self, text: str) -> np.ndarray:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4")

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        out, at = [b""] * len(texts), []
        for i, text in enumerate(texts):
            if any(s in text for s in self.special) or len(text) >= LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in RUN.finditer(text)):
                out[i] = self.library(text).tobytes()
            elif INSIDE_RUN.search(text):
                out[i] = self.encode(text).tobytes()
            else:
                at.append(i)
        ids, ends = encode_units(pa.array([texts[i] for i in at], pa.string()), self.encode, self.width, self.encode, self.encode)
        blob = ids.tobytes()
        for i, a, b in zip(at, (4 * ends[:-1]).tolist(), (4 * ends[1:]).tolist(), strict=True):
            out[i] = blob[a:b]
        return out


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all full but the first, which holds the rest."""
    first = n % length or min(n, length)
    return [(0, first)] + [(s, length) for s in range(first, n, length)] if n else []


def tokenise(docs: DataFrame, path: str, length: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document.

    A null text counts as empty and still has its end id; repeated rows give repeated
    pieces; extra columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        bpe = byte_bpe(path)
        for batch in batches:
            at, rows = [], []
            for i, ids in enumerate(bpe.ids(batch.column(1).to_pylist())):
                ids += end
                for k, (s, n) in enumerate(cut(len(ids) // 4, length)):
                    at.append(i)
                    rows.append((k, s, n, zlib.crc32(ids[4 * s:4 * (s + n)])))
            t = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(t[:, 0].astype("i4")), *[pa.array(t[:, c]) for c in (1, 2, 3)]],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Fixes dominating sets and takes them out of ``counts`` (by length); returns (how often, lengths).

    For a longest member j, with k the longest that fits beside it:

    * nothing fits: {j};
    * j + k fills the sequence, or no two others fit: {j, k};
    * two others fit but no three, and no pair is longer than k: {j, k};
    * two others fit but no three, and beside k fits an a no shorter than the shorter one of any pair: {j, a, k}.

    Taking pieces out makes nothing fit that didn't, so the set stays dominant while all
    its lengths are there: it is fixed as often as they last, and the entries are bounded
    by the number of lengths, not of pieces.
    """
    fixed = []

    def present(without: list[int]) -> np.ndarray:
        left = counts.copy()
        for s in without:
            left[s] -= 1
        return left

    def shortest(left: np.ndarray, room: int, n: int) -> bool:
        """Whether the ``n`` shortest together fit into ``room``."""
        total = 0
        for s in np.flatnonzero(left > 0):
            take = min(n, int(left[s]))
            total, n = total + take * int(s), n - take
            if total > room:
                return False
            if not n:
                return True
        return False

    def longest(left: np.ndarray, room: int) -> int:
        some = np.flatnonzero(left[:max(room, 0) + 1] > 0)
        return int(some[-1]) if len(some) else 0

    def decide(j: int) -> list[int] | None:
        left, room = present([j]), capacity - j
        k = longest(left, room)
        if not k:
            return [j]
        if k == room or not shortest(left, room, 2):
            return [j, k]
        if shortest(left, room, 3):
            return None
        pairs = [(int(x), longest(present([j, int(x)]), room - int(x))) for x in np.flatnonzero(left[:room + 1] > 0)]
        pairs = [(x, y) for x, y in pairs if y >= x]
        if k >= max(x + y for x, y in pairs):
            return [j, k]
        a = longest(present([j, k]), room - k)
        return [j, a, k] if a and a >= max(x for x, _ in pairs) else None

    changed = True
    while changed:
        changed = False
        for j in np.flatnonzero(counts > 0)[::-1]:
            while counts[j] > 0 and (chosen := decide(int(j))):
                need = {s: chosen.count(s) for s in chosen}
                times = min(int(counts[s]) // n for s, n in need.items())
                for s, n in need.items():
                    counts[s] -= times * n
                fixed.append((times, chosen))
                changed = True
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing over counts by length: (how often, lengths)."""
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    done: list[tuple[int, list[int]]] = []

    def put(n: int, room: int, what: tuple[int, ...]) -> None:
        if n:
            open_.setdefault(room, []).append((n, what))

    for s in np.flatnonzero(counts > 0)[::-1]:
        s, left = int(s), int(counts[s])
        while left:
            room = min((r for r in open_ if r >= s), default=None)
            if room is None:
                groups, room = [(left, ())], capacity
            else:
                groups = open_.pop(room)
            each = room // s
            for i, (n, what) in enumerate(groups):
                full = min(n, left // each)
                put(full, room - each * s, what + (s,) * each)
                left -= full * each
                if full < n and left:
                    put(1, room - left * s, what + (s,) * left)
                    full, left = full + 1, 0
                if what:  # empty sequences are opened as needed
                    put(n - full, room, what)
                if not left:
                    for g in groups[i + 1:]:
                        put(g[0], room, g[1])
                    break
        counts[s] = 0
    for groups in open_.values():
        done += [(n, list(what)) for n, what in groups]
    return done


def pack_lengths(counts: np.ndarray, capacity: int = 1024) -> list[tuple[int, list[int]]]:
    """(how often, lengths) of all sequences; ``counts[n]`` pieces have length n."""
    counts = np.array(counts, np.int64)
    return reduce_by_dominance(counts, capacity) + best_fit(counts, capacity)


def places(plan: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: where the pieces of a length go by their rank."""
    rows, taken, sequence = [], {}, 0
    for times, lengths in plan:
        offset = 0
        for n in lengths:
            rows.append((n, taken.get(n, 0), sequence, offset))
            taken[n] = taken.get(n, 0) + times
            offset += n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def rank_in(df: DataFrame, by: str, order: list[str], rows: int, per_bucket: int = 1 << 18) -> DataFrame:
    """Adds ``rank``: 0, 1, ... among the rows of equal ``by``, of which any share may be equal.

    Rows are ranked inside hash buckets of about ``per_bucket`` rows, whose first ranks
    are running sums of their counts. ``order`` tells all rows apart, so equal texts and
    repeated rows spread over the buckets like any others.
    """
    buckets = 16 + rows // per_bucket
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = df.groupBy(by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    first = counts.select(by, "_bucket", (F.sum("_n").over(W.partitionBy(by).orderBy("_bucket")) - F.col("_n")).alias("_first"))
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(by, "_bucket").orderBy(*order)) - 1)
    return ranked.join(first, [by, "_bucket"]).withColumn("rank", F.col("_first") + F.col("_rank")).drop("_bucket", "_rank", "_first")


def pack_documents(docs: DataFrame, path: str, length: int = 1024, end_id: int = 2) -> DataFrame:
    """The pieces of ``tokenise`` with ``sequence_id`` and ``offset``: as few sequences as the method finds.

    Cases as in ``tokenise``. Sequences are filled from offset 0 without gaps. Every
    piece gets a row number when it is written, which later tells repeated rows apart.
    """
    spark = docs.sparkSession
    pieces = durable(tokenise(docs, path, length, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = np.zeros(length + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``length`` rows
        counts[r.length] = r.n
    table = places(pack_lengths(counts, length))
    shared = spark.sparkContext.broadcast(table)
    ranked = rank_in(pieces, "length", ["doc_id", "piece", "row"], int(counts.sum()))

    def run(batches):
        t = shared.value
        starts = t[:, 0] * (1 << 44) + t[:, 1]
        for batch in batches:
            n, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(starts, n * (1 << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(t[at, 2] + rank - t[at, 1]), pa.array(t[at, 3])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
