"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The field's features are the shapes of a token and of two tokens to either side, and
the label before. It is trained by gradient ascent on a small labelled table and decoded
by Viterbi over padded numpy batches, line by line and each line whole; long lines are
decoded in parts that hand on their state. Every kind's spans hold a digit or an ``@``
(``holds``), so a line without either is passed over and loses nothing. The field only
adds spans to those of the patterns. All scans are linear in a line, whatever it holds.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import small_batches
from fathomline.llm.pii_examples import Row, labelled_rows, luhn

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("", *KINDS)
# The contract's patterns; a match may begin where the last one ended or where a run of its first class begins, so that no run is scanned from each of its characters.
_LOCAL, _HOST = r"[A-Za-z0-9._%+-]++@", r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])" + _LOCAL + _HOST)
EMAIL_ON = re.compile(_LOCAL + _HOST)
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
CUES = frozenset("card key token secret password phone tel call mail email contact host ip version order".split())
Span = tuple[int, str, int]


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def _emails(line: str) -> list[tuple[int, int]]:
    out, at = [], 0
    while m := EMAIL_ON.match(line, at) or EMAIL.search(line, at):
        out.append(m.span())
        at = m.end()
    return out


def _at_most_255(part: str) -> bool:
    """Of digits of any number: leading zeros don't count."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(line: str, at: int = 0) -> list[Span]:
    """(start, kind, end) of the patterns' matches, leftmost and non-overlapping for each kind; none spans a line break."""
    out = []
    if "@" in line:
        out += [(at + a, "email", at + b) for a, b in _emails(line)]
    if "." in line:
        out += [(at + m.start(), "ip", at + m.end()) for m in IP.finditer(line) if all(map(_at_most_255, m[0].split(".")))]
    for m in CARD.finditer(line):
        if 12 <= m.end() - m.start() <= 2 * 19 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((at + m.start(), "card", at + m.end()))
    if "+" in line:
        out += [(at + m.start(), "phone", at + m.end()) for m in PHONE.finditer(line) if 9 <= len(_digits(m[0])) <= 15]
    return out


def shape(token: str) -> str:
    """A word's shape: cue words as they are; else classes of characters and a length."""
    n = len(token)
    if n == 1 and not token.isalnum():
        return token if token < "\x7f" else "mark"
    low = token.lower()
    if low in CUES:
        return low
    if token.isdigit():
        if n >= 12:
            return "digits long luhn" if n <= 19 and token.isascii() and luhn(token) else "digits long"
        if n <= 3:
            return f"digits {n}" + (" over" if n == 3 and token > "255" else "")
        return f"digits {n}" if n <= 4 else "digits 5+"
    if token.isalpha():
        return ("upper" if token.isupper() else "lower" if token.islower() else "title" if token.istitle() else "mixed") + (" long" if n > 20 else "")
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False))
    return "letters digits " + ("long" if n >= 20 and changes >= 3 else "middling" if n >= 12 else "short")


@dataclass
class Crf:
    """Weights by (offset, shape, label) and (label before, label); shape 0 is any not in ``shapes``, shape 1 the outside."""

    shapes: dict[str, int]
    w: np.ndarray
    trans: np.ndarray
    offsets: tuple[int, ...] = (-2, -1, 0, 1, 2)

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """(rows, length, labels) of padded shape ids (rows, length)."""
        pad = np.pad(ids, ((0, 0), (2, 2)), constant_values=1)
        n = ids.shape[1]
        return sum(self.w[k][pad[:, 2 + o:2 + o + n]] for k, o in enumerate(self.offsets))

    def viterbi(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The best labels of every row; past a row's ``size`` they mean nothing."""
        s = self.scores(ids)
        rows, n, _ = s.shape
        best, back = s[:, 0], np.zeros(s.shape, np.int8)
        for t in range(1, n):
            each = best[:, :, None] + self.trans
            back[:, t] = each.argmax(1)
            best = np.where((t < size)[:, None], each.max(1) + s[:, t], best)
        out = np.zeros((rows, n), np.int8)
        now = best.argmax(1)
        for t in range(n - 1, -1, -1):
            inside = t < size
            out[inside, t] = now[inside]
            if t:
                now = np.where(inside, back[np.arange(rows), t, now], now)
        return out

    def viterbi_long(self, ids: np.ndarray) -> np.ndarray:
        """The best labels of one long row, as ``viterbi`` gives them: its parts are decoded side by side.

        Each part is decoded for every label that may stand before it; a pass over the
        parts then carries the state from one to the next.
        """
        n, k = len(ids), len(self.trans)
        part = int(np.ceil(np.sqrt(n)))
        rows = -(-n // part)
        s = np.zeros((rows * part, k))
        s[:n] = self.scores(ids[None])[0]
        s = s.reshape(rows, part, k)
        size = np.minimum(part, n - part * np.arange(rows))
        best = self.trans[None] + s[:, None, 0]  # (part, label before it, label now)
        best[0] = s[0, 0]
        back = np.zeros((part, rows, k, k), np.int8)
        for t in range(1, part):
            each = best[:, :, :, None] + self.trans
            back[t] = each.argmax(2)
            best = np.where((t < size)[:, None, None], each.max(2) + s[:, None, t], best)
        total, enter = best[0, 0], np.zeros((rows, k), np.int8)
        for r in range(1, rows):
            each = total[:, None] + best[r]
            enter[r], total = each.argmax(0), each.max(0)
        last = np.zeros(rows, np.int64)
        last[-1] = total.argmax()
        for r in range(rows - 1, 0, -1):
            last[r - 1] = enter[r, last[r]]
        before, now, each = np.concatenate([[0], last[:-1]]), last, np.arange(rows)
        out = np.zeros((rows, part), np.int8)
        for t in range(part - 1, -1, -1):
            inside = t < size
            out[inside, t] = now[inside]
            if t:
                now = np.where(inside, back[t, each, before, now], now)
        return out.reshape(-1)[:n]

    def ids(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        get = self.shapes.get
        found = [(get(shape(m[0]), 0), m.span()) for m in TOKEN.finditer(text)]
        return [i for i, _ in found], [s for _, s in found]


def _gradient(crf: Crf, ids: np.ndarray, gold: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Observed minus expected counts, by forward and backward sums over padded rows."""
    s = crf.scores(ids)
    rows, n, k = s.shape
    lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    fwd, bwd = np.zeros_like(s), np.zeros_like(s)
    fwd[:, 0] = s[:, 0]
    for t in range(1, n):
        fwd[:, t] = np.where(mask[:, t, None], lse(fwd[:, t - 1, :, None] + crf.trans, 1) + s[:, t], fwd[:, t - 1])
    for t in range(n - 2, -1, -1):
        bwd[:, t] = np.where(mask[:, t + 1, None], lse(crf.trans + (s[:, t + 1] + bwd[:, t + 1])[:, None, :], 2), bwd[:, t + 1])
    z = lse(fwd[:, -1], 1)
    one = np.eye(k)[gold] * mask[:, :, None]
    diff = one - np.exp(fwd + bwd - z[:, None, None]) * mask[:, :, None]
    both = mask[:, 1:] & mask[:, :-1]
    pair = np.exp(fwd[:, :-1, :, None] + crf.trans + (s[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[:, :, None, None]
    gt = np.einsum("rti,rtj->ij", one[:, :-1] * both[:, :, None], one[:, 1:]) - pair.sum((0, 1))
    pad = np.pad(ids, ((0, 0), (2, 2)), constant_values=1)
    gw = np.zeros_like(crf.w)
    for j, o in enumerate(crf.offsets):
        np.add.at(gw[j], pad[:, 2 + o:2 + o + n].ravel(), diff.reshape(-1, k))
    return gw, gt


def fit_crf(rows: list[Row], steps: int = 150, rate: float = 0.15, decay: float = 0.02) -> Crf:
    """Trains on labelled lines (text, [(kind, start, end)]) by Adam on the regularised log-likelihood."""
    tokens = [[(shape(m[0]), m.span()) for m in TOKEN.finditer(t)] for t, _ in rows]
    shapes = {s: i + 2 for i, s in enumerate(sorted({s for line in tokens for s, _ in line}))}
    longest = max(map(len, tokens))
    ids, gold = np.ones((len(rows), longest), np.int64), np.zeros((len(rows), longest), np.int64)
    mask = np.zeros((len(rows), longest), bool)
    for r, (line, (_, spans)) in enumerate(zip(tokens, rows, strict=True)):
        mask[r, :len(line)] = True
        for t, (s, (a, b)) in enumerate(line):
            ids[r, t] = shapes[s]
            gold[r, t] = next((LABELS.index(k) for k, x, y in spans if x <= a and b <= y), 0)
    p = [np.zeros((5, len(shapes) + 2, len(LABELS))), np.zeros((len(LABELS), len(LABELS)))]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, steps + 1):
        for i, g in enumerate(_gradient(Crf(shapes, *p), ids, gold, mask)):
            g = g - decay * p[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            p[i] = p[i] + rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    return Crf(shapes, *p)


@lru_cache(maxsize=1)
def default_crf() -> Crf:
    return fit_crf(labelled_rows())


def holds(kind: str, s: str) -> bool:
    """Whether a stretch that the field labels can be of its kind: a check of what the kind must hold, a digit or an ``@`` in any case."""
    n = sum(c in "0123456789" for c in s)
    if kind == "email":
        return "." in s[s.find("@"):] if "@" in s else False
    if kind == "ip":
        return re.fullmatch(r"[0-9]++(?:\.[0-9]++){3}", s) is not None
    if kind == "secret":
        return len(s) >= 20 and 0 < n < len(s) and re.fullmatch(r"[0-9A-Za-z_]++", s) is not None
    return 12 <= n <= 19 if kind == "card" else 9 <= n <= 15


def tag(texts: list[str], crf: Crf, batch: int = 256, long: int = 512) -> list[list[Span]]:
    """The field's spans (start, kind, end) of every text."""
    out: list[list[Span]] = [[] for _ in texts]

    def add(i: int, at: int, spans: list[tuple[int, int]], row: list[int]) -> None:
        t = 0
        while t < len(row):
            e = t + 1
            while e < len(row) and row[e] == row[t]:
                e += 1
            if row[t]:
                a, b = at + spans[t][0], at + spans[e - 1][1]
                if holds(LABELS[row[t]], texts[i][a:b]):
                    out[i].append((a, LABELS[row[t]], b))
            t = e

    jobs = []  # (text, offset of the line, offsets of its tokens, ids)
    for i, text in enumerate(texts):
        at = 0
        while m := TRIGGER.search(text, at):
            a, b = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.start())
            b = len(text) if b < 0 else b
            ids, spans = crf.ids(text[a:b])
            if len(ids) > long:
                add(i, a, spans, crf.viterbi_long(np.array(ids)).tolist())
            else:
                jobs.append((i, a, spans, ids))
            at = b + 1
    jobs.sort(key=lambda j: len(j[3]))
    for first in range(0, len(jobs), batch):
        part = [j for j in jobs[first:first + batch] if j[3]]
        if not part:
            continue
        size = np.array([len(j[3]) for j in part])
        ids = np.ones((len(part), size.max()), np.int64)
        for r, j in enumerate(part):
            ids[r, :size[r]] = j[3]
        labels = crf.viterbi(ids, size)
        for r in np.flatnonzero(labels.any(1)).tolist():
            i, at, spans, _ = part[r]
            add(i, at, spans, labels[r, :size[r]].tolist())
    return out


def apart(more: list[Span], base: list[Span]) -> list[Span]:
    """The spans of ``more`` that no span of ``base`` (sorted by start) touches; the ones of ``base`` may overlap."""
    starts = [s[0] for s in base]
    reach = np.maximum.accumulate([s[2] for s in base]).tolist()
    out = []
    for s in more:
        before = bisect_left(starts, s[2])  # those that begin before its end
        if not before or reach[before - 1] <= s[0]:
            out.append(s)
    return out


def find_spans(texts: list[str], crf: Crf) -> list[tuple[list[Span], list[Span]]]:
    """(the patterns' spans, all spans) of every text, by start and kind; the field adds where no pattern's span is touched."""
    order = lambda s: (s[0], KINDS.index(s[1]), s[2])
    out = []
    for text, more in zip(texts, tag(texts, crf), strict=True):
        base, at = [], 0
        while m := TRIGGER.search(text, at):
            a, b = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.start())
            b = len(text) if b < 0 else b
            base += base_spans(text[a:b], a)
            at = b + 1
        base.sort(key=order)
        more = apart(more, base) if more and base else more
        out.append((base, sorted(base + more, key=order) if more else base))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def find_pii(docs: DataFrame, crf: Crf | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (the patterns' spans), base_sha256 and spans of every whole text.

    A null text counts as empty and has no span; repeated rows give repeated rows;
    extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(crf or default_crf())  # a few thousand weights

    def run(batches):
        for batch in batches:
            found = find_spans(batch.column(1).to_pylist(), shared.value)
            n = {f"n_{k}": pa.array([sum(s[1] == k for s in b) for b, _ in found], pa.int64()) for k in KINDS[:4]}
            yield pa.record_batch({"doc_id": batch.column(0)} | n | {
                "base_sha256": pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in found], pa.string()),
                "spans": pa.array([written(a) for _, a in found], pa.string())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans: list[Span]) -> str:
    """Every span gives way to its kind in angle brackets; spans that overlap give way together, to the first one's kind."""
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_pii(docs: DataFrame, crf: Crf | None = None) -> DataFrame:
    """All columns of ``docs`` with ``text`` redacted, and ``n_chars`` (where there is one) counted anew.

    Null texts stay null, empty ones empty; every row comes back, repeated ones as often
    as they were; other columns pass through; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(crf or default_crf())
    columns, at = docs.columns, docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            new = [redact(t, s) if s else t for t, (_, s) in zip(texts, find_spans(texts, shared.value), strict=True)]
            cells = batch.columns
            gone = batch.column(at).is_null().to_pylist()
            cells[at] = pa.array([None if g else t for g, t in zip(gone, new, strict=True)], batch.column(at).type)
            yield pa.RecordBatch.from_arrays(cells, columns)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
