"""Chunks of texts whose token ids can be computed once and looked up afterwards.

A byte-level pre-tokenizer always starts a new piece at a blank that is followed by a character other
than white space, between an ASCII letter or digit and an ASCII mark, and on both sides of a single line
end within text. Texts are cut there, every distinct chunk is encoded once per task, and the ids of a
text are gathered with numpy. Cutting less is always right, so a blank before a byte that might begin
white space beyond ASCII is no cut.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fieldcheck.llm.common import ragged, through

#: Distinct chunks that an encoder remembers; beyond it the memory starts anew, which only costs time.
MEMORY = 500_000

_NOT_OPEN = {*range(33), 127, 0xC2, 0xE1, 0xE2, 0xE3}
_ALNUM = {*range(48, 58), *range(65, 91), *range(97, 123)}
_VISIBLE = {*range(33, 127)}
#: For bytes.translate: 1 may follow a cut blank, 2 letter or digit, 4 mark, 8 visible ASCII, 16 blank, 32 line end.
_KIND = bytes((i not in _NOT_OPEN) + 2 * (i in _ALNUM) + 4 * (i in _VISIBLE - _ALNUM) + 8 * (i in _VISIBLE)
              + 16 * (i == 32) + 32 * (i == 10) for i in range(256))


def chunks(text: pa.Array, special: tuple[str, ...] = ()) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts, and the number of chunks before each text (and in all).

    A special token is never cut.
    """
    text = pc.fill_null(text.cast(pa.large_string()), "")
    if not len(text):
        return pa.array([], pa.large_string()), np.zeros(1, np.int64)
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    starts = at - at[0]
    cut = np.zeros(len(raw) + 1, bool)
    kind = through(raw, _KIND)
    if len(raw) > 2:
        here, after = kind[:-1], kind[1:]
        cut[:len(raw) - 1] = (here & 16 != 0) & (after & 1 != 0)
        cut[1:len(raw)] |= (here & 2 != 0) & (after & 4 != 0)
        line = (kind[1:-1] & 32 != 0) & (kind[:-2] & 8 != 0) & (kind[2:] & 1 != 0)
        cut[1:len(raw) - 1] |= line
        cut[2:len(raw)] |= line
    for token in special:
        for m in re.finditer(re.escape(token.encode()), raw.tobytes()):
            cut[m.start() + 1:m.end()] = False
    cut[starts] = True
    cut[-1] = True
    edges = np.flatnonzero(cut).astype(np.int64)
    out = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(raw)))
    return out, np.searchsorted(edges, starts)


class Encoder:
    """Ids of texts, remembered by chunk.

    ``encode(new chunks)`` returns the chunks in an order of its own, all their ids, and their sizes.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[list[str], np.ndarray, np.ndarray]],
                 special: tuple[str, ...] = ()):
        self.encode, self.special = encode, special
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.zeros(0, np.uint32)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids before each text (and in all)."""
        if len(self.known) > MEMORY:
            self.clear()
        own, docs = chunks(text, self.special)
        coded = own.dictionary_encode()
        values = coded.dictionary.to_pylist()
        new = [v for v in values if v not in self.known]
        if new:
            new, ids, sizes = self.encode(new)
            for v in new:
                self.known[v] = len(self.known)
            self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.pool = np.concatenate([self.pool, ids])
        which = np.fromiter((self.known[v] for v in values), np.int64, len(values))
        which = which[np.asarray(coded.indices)] if len(values) else which
        sizes = self.size[which]
        return self.pool[ragged(self.first[which], sizes)], np.concatenate([[0], np.cumsum(sizes)])[docs]


def plain(chunk: str, special: tuple[str, ...]) -> bool:
    """Whether the chunk has no special token and no white space but one leading blank, so that line ends
    may separate such chunks."""
    core = chunk[1:] if chunk[0] == " " else chunk
    return core.split() == [core] and not any(s in core for s in special)
