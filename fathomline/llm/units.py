"""Token ids by way of distinct words: a word that repeats within a batch is encoded once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE_OR_EMPTY = r"^(?:$|[\s\x0B\x1C-\x1F\x{85}\p{Z}])"
Encode = Callable[[str], np.ndarray]


def encode_units(texts: pa.Array, encode: Encode, width: np.ndarray, alone: Encode, first: Encode | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of ``texts``: the ids of text i lie at ``offsets[i]:offsets[i + 1]``.

    For encoders whose ids never span a space that begins a unit: a space and what
    follows up to the next one. ``encode`` gives the ids of a text that begins with a
    space, ``width`` the bytes of the text each id stands for. The distinct units are
    joined and encoded at once; the widths tell where each one's ids end. A unit that
    begins with white space would run together with the one before: ``alone`` encodes
    it by itself. ``first`` encodes what precedes a text's first space (by default it
    counts as a unit, as if a space stood before the text).
    """
    parts = pc.split_pattern(texts, " ")
    of_text = parts.offsets.to_numpy()
    of_text = of_text - of_text[0]
    coded = parts.flatten().dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    units = coded.dictionary
    blocks, starts, sizes, held = [], np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), 0

    def add(where, ids: np.ndarray) -> None:
        nonlocal held
        starts[where], sizes[where] = held, len(ids)
        blocks.append(ids)
        held += len(ids)

    odd = pc.match_substring_regex(units, WHITE_OR_EMPTY).to_numpy(zero_copy_only=False)
    plain = np.flatnonzero(~odd)
    if len(plain):
        words = units.filter(pa.array(~odd))
        text = " " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        ids = encode(text)
        ends = np.cumsum(width[ids])
        data = np.frombuffer(text.encode(), np.uint8)
        stops = np.append(np.flatnonzero(data == 32)[1:], len(data))  # units hold no space
        cuts = np.searchsorted(ends, stops)
        if not (ends[cuts] == stops).all():
            raise ValueError("an id spans two units")
        cuts = np.concatenate([[0], cuts + 1])
        starts[plain], sizes[plain] = cuts[:-1], np.diff(cuts)
        blocks.append(ids)
        held = len(ids)
    for i in np.flatnonzero(odd).tolist():
        add(i, alone(" " + units[i].as_py()))
    if first is not None:
        n = len(units)
        starts, sizes = np.append(starts, np.zeros(len(texts), np.int64)), np.append(sizes, np.zeros(len(texts), np.int64))
        for i, k in enumerate(of_text[:-1].tolist()):
            word = units[at[k]].as_py()
            at[k] = n + i
            if word:
                add(n + i, first(word))
    count = sizes[at]
    ends = np.concatenate([[0], np.cumsum(count)])
    pool = np.concatenate([np.zeros(0, np.uint32), *blocks]).astype("<u4")
    ids = pool[np.repeat(starts[at] - ends[:-1], count) + np.arange(ends[-1])]
    return ids, ends[of_text]
