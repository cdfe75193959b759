"""SentencePiece encoding with source offsets, and decoding.

A model's normaliser rewrites the text before its pieces are found, so a piece's
place in the normalised text isn't its place in the source. ``Normaliser`` does the
rewriting by longest-prefix matches in the model's compiled character map (a
double-array trie) and records, for every normalised byte, the source byte it stems
from. ``Codec`` then merges the normalised characters to pieces, best score first, and
projects every piece over the recorded alignment to a span of source bytes. Everything
is read from the model file and done here; the tests hold ids, texts and spans against
the reference library, with the model's own map and with a full one put into it.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import small_batches

SPACE_MARK = "▁".encode()


def _fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message's fields."""
    def varint(at):
        out = shift = 0
        while True:
            b = blob[at]
            out |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return out, at

    at = 0
    while at < len(blob):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        elif key & 7 == 2:
            n, at = varint(at)
            value, at = blob[at:at + n], at + n
        else:
            n = {1: 8, 5: 4}[key & 7]
            value, at = blob[at:at + n], at + n
        yield key >> 3, value


class Normaliser:
    """``normalise(text)`` gives the normalised bytes and ``origin``: for each of them, and for the end, its source byte offset."""

    def __init__(self, charsmap: bytes = b"", dummy_prefix: bool = True, squeeze: bool = True, mark_spaces: bool = True, space_last: bool = False, kept: tuple[str, ...] = ()):
        self.dummy_prefix, self.squeeze, self.space_last = dummy_prefix, squeeze, space_last
        #: Strings that pass through unchanged, longest first.
        self.kept = sorted((k.encode() for k in kept), key=len, reverse=True)
        self.space = SPACE_MARK if mark_spaces else b" "
        self.units, self.texts = np.zeros(0, np.uint32), b""
        if charsmap:
            (n,) = struct.unpack_from("<I", charsmap)
            self.units, self.texts = np.frombuffer(charsmap, "<u4", n // 4, 4), charsmap[4 + n:]
        self._trie = self.units.tolist()

    def longest(self, data: bytes, at: int) -> tuple[bytes, int]:
        """The replacement of the longest rule that matches at ``at``, else the character there; and the source bytes taken."""
        for k in self.kept:
            if data.startswith(k, at):
                return k, len(k)
        trie, found, taken = self._trie, -1, 0
        if trie:
            unit = trie[0]
            node = (unit >> 10) << ((unit & 512) >> 6)
            for i in range(at, len(data)):
                node ^= data[i]
                unit = trie[node] if node < len(trie) else 0
                if unit & 0x800000FF != data[i]:
                    break
                node ^= (unit >> 10) << ((unit & 512) >> 6)
                if unit & 256:
                    found, taken = trie[node] & 0x7FFFFFFF, i + 1 - at
        if found >= 0:
            return self.texts[found:self.texts.index(0, found)], taken
        lead = data[at]
        taken = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at:at + taken], taken

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        data = text.encode()
        if not data:
            return b"", np.zeros(1, np.int64)
        if not self._trie and not self.squeeze and not self.kept:
            return self._plain(data)
        out, origin, at = bytearray(), [], 0
        while self.squeeze and at < len(data):  # white space that leads
            piece, taken = self.longest(data, at)
            if piece != b" ":
                break
            at += taken
        if at == len(data):
            return b"", np.array([at], np.int64)
        if self.dummy_prefix and not self.space_last:
            out += self.space
            origin += [at] * len(self.space)
        after_space = self.squeeze
        while at < len(data):
            piece, taken = self.longest(data, at)
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                new = piece.replace(b" ", self.space)
                out += new
                origin += [at] * len(new)
                after_space = piece.endswith(b" ")
            at += taken
            after_space = after_space and self.squeeze
        end = len(data)
        while self.squeeze and out.endswith(self.space):
            del out[-len(self.space):]
            end = origin[len(out)]
            del origin[len(out):]
        if self.space_last and self.dummy_prefix:
            out += self.space
            origin += [end] * len(self.space)
        return bytes(out), np.array([*origin, end], np.int64)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """No rules and every space kept: only spaces change."""
        width = np.ones(len(data), np.int64)
        width[np.frombuffer(data, np.uint8) == 32] = len(self.space)
        out, origin = data.replace(b" ", self.space), np.repeat(np.arange(len(data)), width)
        if self.dummy_prefix:
            pad = np.full(len(self.space), len(data) if self.space_last else 0)
            out = out + self.space if self.space_last else self.space + out
            origin = np.concatenate([origin, pad] if self.space_last else [pad, origin])
        return out, np.append(origin, len(data))


# What the model file calls its kinds of pieces.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _each_byte(error: UnicodeDecodeError):
    return "\ufffd" * (error.end - error.start), error.end


codecs.register_error("each-byte", _each_byte)


class Codec:
    """Encodes and decodes with one model file (byte-pair merges)."""

    def __init__(self, model: bytes, cache: int = 400_000):
        pieces, trainer, normal = [], {}, {2: b"", 3: 1, 4: 1, 5: 1}
        for number, value in _fields(model):
            if number == 1:
                said = dict(_fields(value))
                pieces.append((said[1].decode(), struct.unpack("<f", said[2])[0] if 2 in said else 0.0, said.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal |= dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("only models of byte-pair merges are read")
        kinds = [k for *_, k in pieces]
        self.unknown, self.begin, self.end = (trainer.get(n, d) for n, d in ((40, 0), (41, 1), (42, 2)))
        self.unknown = kinds.index(UNKNOWN) if UNKNOWN in kinds else self.unknown
        user = [p for p, _, k in pieces if k == USER]
        self.normaliser = Normaliser(normal[2], bool(normal[3]), bool(normal[4]), bool(normal[5]), bool(trainer.get(24, 0)), tuple(user))
        self.score = {p: s for p, s, k in pieces if k in (NORMAL, USER, UNUSED)}
        self.number = {p: i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER, UNUSED)}
        self.unused = {p for p, _, k in pieces if k == UNUSED}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE} if trainer.get(35, 0) else {}
        self.width = np.array([0 if k == CONTROL else 1 if k == BYTE else len(p.encode()) for p, _, k in pieces], np.int64)
        strip = normal[3] or normal[4]
        self.strips, self.strips_all = bool(strip), bool(normal[4])
        blank = trainer[44] if 44 in trainer else " \u2047 ".encode()
        self.surface = [
            b"" if k == CONTROL else blank if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace("▁", " ").encode() for p, _, k in pieces]
        self.kinds = kinds
        mark = SPACE_MARK.decode()
        #: Where no piece holds a mark behind another character, a mark always begins a unit, and units can be merged apart.
        self.by_units = not any(mark in p.lstrip(mark) for p in self.score) and not user
        self.unit = re.compile(f"{mark}+[^{mark}]*|[^{mark}]+") if self.by_units else None
        self.user = re.compile("|".join(map(re.escape, sorted(user, key=len, reverse=True)))) if user else None
        self.cache, self.seen = cache, {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a stretch of normalised text: adjacent pairs become one, the best score first, of equal scores the leftmost."""
        if self.user:
            parts, frozen, at = [], set(), 0
            for m in self.user.finditer(text):
                parts += text[at:m.start()]
                frozen.add(len(parts))
                parts.append(m[0])
                at = m.end()
            parts += text[at:]
        else:
            parts, frozen = list(text), ()
        get = self.score.get
        if len(parts) <= 100 and not frozen and not self.unused:
            none = -float("inf")
            scores = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
            while scores and (best := max(scores)) > none:
                i = scores.index(best)
                both = parts[i] + parts[i + 1]
                parts[i:i + 2] = [both]
                del scores[i]
                if i:
                    scores[i - 1] = get(parts[i - 1] + both, none)
                if i < len(scores):
                    scores[i] = get(both + parts[i + 1], none)
            return parts
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        queue, made_of = [], {}

        def offer(i: int, j: int) -> None:
            if i < 0 or j < 0 or i in frozen or j in frozen:
                return
            both = parts[i] + parts[j]
            s = get(both)
            if s is not None:
                heapq.heappush(queue, (-s, i, j, len(both)))
                if both in self.unused:
                    made_of[both] = parts[i], parts[j]

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, size = heapq.heappop(queue)
            if not parts[i] or not parts[j] or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i], parts[j] = parts[i] + parts[j], ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        out, open_ = [], [p for p in reversed(parts) if p]
        while open_:  # a merge may end in a piece that is out of use: then it counts as what it was made of
            p = open_.pop()
            if p in self.unused and p in made_of:
                open_ += reversed(made_of[p])
            else:
                out.append(p)
        return out

    def _coded(self, text: str) -> tuple[bytes, bytes]:
        """Ids and, where a model has no bytes to fall back on, how many normalised bytes each stands for, as unsigned 32-bit integers."""
        get = self.number.get
        if self.bytes:
            parts = self.merged(text)
            found = [get(p) for p in parts]
            if None in found:
                found = [j for p, i in zip(parts, found, strict=True) for j in ([self.bytes[b] for b in p.encode()] if i is None else (i,))]
            return array("I", found).tobytes(), b""
        ids, widths = [], []
        for p in self.merged(text):
            i = get(p)
            if i is not None:
                ids.append(i)
                widths.append(len(p.encode()))
            elif ids and ids[-1] == self.unknown:  # unknown characters in a row are one
                widths[-1] += len(p.encode())
            else:
                ids.append(self.unknown)
                widths.append(len(p.encode()))
        return array("I", ids).tobytes(), array("I", widths).tobytes()

    def _kept(self, unit: str) -> tuple[bytes, bytes]:
        found = self._coded(unit)
        if len(unit) <= 64:
            self.seen[unit] = found
        return found

    def _ids(self, norm: bytes) -> tuple[np.ndarray, np.ndarray]:
        text = norm.decode()
        if not self.by_units:
            ids, widths = self._coded(text)
        else:
            seen = self.seen
            if len(seen) > self.cache:
                seen.clear()
            units = self.unit.findall(text)
            blobs = [found if (found := seen.get(u)) is not None else self._kept(u) for u in units]
            ids = b"".join([b[0] for b in blobs])
            widths = b"" if self.bytes else b"".join([b[1] for b in blobs])
        ids = np.frombuffer(ids, "=u4").astype("<u4", copy=False)
        widths = self.width[ids] if self.bytes else np.frombuffer(widths, "=u4").astype(np.int64)
        if not self.bytes and self.by_units and len(ids):  # unknown ones may meet between units too
            new = np.append(True, (ids[1:] != self.unknown) | (ids[:-1] != self.unknown))
            ids, widths = ids[new], np.add.reduceat(widths, np.flatnonzero(new))
        return ids, widths

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids with begin and end ids, first source bytes, end source bytes); begin and end ids have empty spans.

        Pieces of one source character (bytes of it, or a rule's replacement) share its bytes.
        """
        norm, origin = self.normaliser.normalise(text)
        ids, widths = self._ids(norm)
        ends = np.cumsum(np.concatenate([[0], widths, [0]]))
        if ends[-1] != len(norm):
            raise ValueError("the pieces don't add up to the normalised text")
        ids = np.concatenate([[self.begin], ids, [self.end]]).astype("<u4")
        widths = np.concatenate([[0], widths, [0]])
        begin, end = origin[ends - widths], origin[ends]
        return ids, begin, np.where(widths > 0, np.maximum(end, begin), begin)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: marks become spaces, the one put before the text goes, bytes that make no character become U+FFFD."""
        surface, ids = self.surface, ids.tolist()
        parts = [surface[i] for i in ids]
        if self.strips:
            for k, i in enumerate(ids):
                if self.kinds[i] in (BYTE, UNKNOWN):
                    break
                if parts[k]:
                    if parts[k].startswith(b" "):
                        parts[k] = parts[k][1:]
                        if not self.strips_all:
                            break
                    if parts[k]:
                        break
        return b"".join(parts).decode(errors="each-byte")

    def round_trip(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, str]]:
        """(ids with begin and end ids, first source bytes, end source bytes, decoded text) of every text."""
        out = []
        for text in texts:
            ids, begin, end = self.encode(text)
            out.append((ids, begin, end, self.decode(ids)))
        return out


@lru_cache(maxsize=2)
def codec(model_path: str) -> Codec:
    with open(model_path, "rb") as f:
        return Codec(f.read())


def chunks(texts: list[str], chars: int = 500_000) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) of runs of about ``chars`` characters: bounds what a task holds at once."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def _texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, begins, ends (array<int>; source bytes) of every whole text, with begin and end ids.

    A null text counts as empty and has the two ids alone; repeated rows give
    repeated rows; extra columns are ignored; an empty table gives no rows.
    """
    def run(batches):
        c = codec(model_path)
        for batch in batches:
            keys = batch.column(0)
            for first, texts in chunks(batch.column(1).to_pylist()):
                found = c.round_trip(texts)
                ints = pa.list_(pa.int32())
                yield pa.record_batch({"doc_id": keys.slice(first, len(texts))} | {
                    name: pa.array([x[k].astype("i4") for x in found], ints) for k, name in enumerate(("ids", "begins", "ends"))})

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of ``encoded`` (doc_id, ids); a null id list gives an empty text."""
    small_batches(encoded.sparkSession)

    def run(batches):
        c = codec(model_path)
        for batch in batches:
            ids = [np.array(x or [], "i8") for x in batch.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": batch.column(0), "text": pa.array([c.decode(x) for x in ids], pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """Encodes, projects and decodes every whole text in one pass; returns digests instead of lists.

    doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 (begins, then ends, as
    little-endian 32-bit integers). Cases as in ``encode_documents``.
    """
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches):
        c = codec(model_path)
        for batch in batches:
            keys = batch.column(0)
            for first, texts in chunks(batch.column(1).to_pylist(), 4_000_000):
                found = c.round_trip(texts)
                yield pa.record_batch({
                    "doc_id": keys.slice(first, len(texts)), "n_tokens": pa.array([len(x[0]) for x in found], pa.int64()),
                    "ids_sha256": pa.array([sha(x[0].tobytes()) for x in found], pa.string()),
                    "decoded_sha256": pa.array([sha(x[3].encode()) for x in found], pa.string()),
                    "spans_sha256": pa.array([sha(x[1].astype("<u4").tobytes() + x[2].astype("<u4").tobytes()) for x in found], pa.string()),
                })

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
