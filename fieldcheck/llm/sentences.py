"""SentencePiece (byte-pair) encoding and decoding by a table of distinct chunks.

No piece of such a model holds a white-space marker after another character, so no merge crosses the
place before a marker, and a character that no piece holds never merges at all. Texts are cut before each
marker that follows another character and around line ends where no piece holds one; every distinct
chunk of a task is segmented once, and the ids of a text are gathered from the table by the positions of
its chunks. Segmenting merges, within a chunk, the neighbours whose joined piece has the best score, the
leftmost of equals, until none is left; characters without a piece become their bytes.

A model whose pieces do cross markers is served too: its texts are chunks as they are.

Defined results: a null text is empty and has no ids; a marker character in a text is white space, as in
the library; rows are never combined, so repeated rows give repeated results. Extra columns are ignored.
Models other than byte pairs, with a normalizer or with own symbols, are refused.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from fieldcheck.llm.bpe import Pool, blocks
from fieldcheck.llm.common import ragged, slices

MARK = "▁"
#: Distinct chunks that a task remembers; beyond it the table starts anew, which only costs time.
MEMORY = 500_000
#: Values of the model file: kinds of models and of pieces.
BPE_MODEL, NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 2, 1, 2, 3, 4, 5, 6


class Model:
    """Pieces by text, with the marker written as a blank, and their ranks (equal scores share one)."""

    def __init__(self, path: str):
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, kinds = spec.normalizer_spec, {p.type for p in spec.pieces}
        if (spec.trainer_spec.model_type != BPE_MODEL or norm.precompiled_charsmap or norm.remove_extra_whitespaces
                or not norm.add_dummy_prefix or not norm.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix
                or kinds & {USER, UNUSED}):
            raise ValueError("only plain byte-pair models without a normalizer are served")
        scores = sorted({p.score for p in spec.pieces if p.type == NORMAL}, reverse=True)
        rank = {s: i for i, s in enumerate(scores)}
        self.id, self.rank, self.bytes_of = {}, {}, []
        self.byte = [-1] * 256
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == UNKNOWN)
        for i, p in enumerate(spec.pieces):
            shown = b""
            if p.type == NORMAL:
                text = p.piece.replace(MARK, " ")
                self.id[text], self.rank[text] = i, rank[p.score]
                shown = text.encode()
            elif p.type == BYTE:
                self.byte[int(p.piece[3:5], 16)] = i
                shown = bytes([int(p.piece[3:5], 16)])
            elif p.type == UNKNOWN:
                shown = spec.trainer_spec.unk_surface.encode()
            self.bytes_of.append(shown)
        if self.byte.count(-1):
            raise ValueError("the model has no piece for some bytes")
        self.crossed = any(" " in t.lstrip(" ") for t in self.id)
        self.lines = any("\n" in t for t in self.id)

    def segment(self, chunk: str) -> list[int]:
        """Ids of a chunk."""
        rank, sym, n = self.rank, list(chunk), len(chunk)
        heap = []
        for i in range(n - 1):
            r = rank.get(sym[i] + sym[i + 1])
            if r is not None:
                heap.append((r, i, 2))
        if heap:
            heapq.heapify(heap)
            nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
            while heap:
                _, i, size = heapq.heappop(heap)
                left = sym[i]
                j = nxt[i]
                # What was merged since then has another length.
                if not left or j >= n or len(left) + len(sym[j]) != size:
                    continue
                joined = sym[i] = left + sym[j]
                sym[j] = ""
                k = nxt[i] = nxt[j]
                if k < n:
                    prv[k] = i
                    r = rank.get(joined + sym[k])
                    if r is not None:
                        heapq.heappush(heap, (r, i, size + len(sym[k])))
                h = prv[i]
                if h >= 0:
                    r = rank.get(sym[h] + joined)
                    if r is not None:
                        heapq.heappush(heap, (r, h, size + len(sym[h])))
        out = []
        for s in sym:
            if s:
                own = self.id.get(s)
                if own is not None:
                    out.append(own)
                else:
                    out += [self.byte[b] for b in s.encode()]
        return out


def marked_chunks(text: pa.Array, whole: bool, lines: bool) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts, a blank before each text that has characters, and the chunks before each text."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    text = pc.replace_substring(text, MARK, " ")
    lead = pc.if_else(pc.equal(pc.binary_length(text), 0), "", " ").cast(pa.large_string())
    text = pc.binary_join_element_wise(lead, text, pa.scalar("", pa.large_string()))
    if not len(text):
        return pa.array([], pa.large_string()), np.zeros(1, np.int64)
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    starts = at - at[0]
    raw = np.frombuffer(text.buffers()[2], np.uint8)[at[0]:at[-1]] if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    cut = np.zeros(len(raw) + 1, bool)
    if not whole and len(raw):
        blank = raw == 32
        cut[1:-1] = blank[1:] & ~blank[:-1]
        if not lines:
            line = raw == 10
            cut[:-1] |= line
            cut[1:] |= line
    cut[starts] = True
    edges = np.flatnonzero(cut).astype(np.int64)
    edges = edges if len(edges) else np.zeros(1, np.int64)
    out = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(raw)))
    return out, np.searchsorted(edges, starts)


class ChunkTable:
    """Ids of texts from the ids of their distinct chunks."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.zeros(0, np.int32)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids before each text (and in all)."""
        if len(self.known) > MEMORY:
            self.clear()
        own, docs = marked_chunks(text, self.model.crossed, self.model.lines)
        coded = own.dictionary_encode()
        values = coded.dictionary.to_pylist()
        which = np.fromiter((self.known.get(v, -1) for v in values), np.int64, len(values))
        new = np.flatnonzero(which < 0)
        if len(new):
            found = [self.model.segment(values[i]) for i in new.tolist()]
            which[new] = len(self.known) + np.arange(len(new))
            self.known.update(zip((values[i] for i in new.tolist()), which[new].tolist()))
            size = np.fromiter(map(len, found), np.int64, len(found))
            self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.pool = np.concatenate([self.pool, np.fromiter((x for f in found for x in f), np.int32, int(size.sum()))])
        which = which[coded.indices.to_numpy()] if len(values) else which
        size = self.size[which]
        return self.pool[ragged(self.first[which], size)], np.concatenate([[0], np.cumsum(size)])[docs]


def decoded(shown: Pool, ids: np.ndarray, at: np.ndarray) -> Iterator[bytes]:
    """The texts of ids: pieces joined, without the blank in front that encoding adds."""
    for x in shown.join(ids, at):
        yield (x[1:] if x[:1] == b" " else x).decode("utf-8", "replace").encode()


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(model)
        table, shown, numbers = ChunkTable(own), Pool(own.bytes_of), Pool([b"%d," % i for i in range(len(own.bytes_of))])
        for b in slices(batches):
            ids, at = table(b.column("text"))
            by_ids, texts = [], []
            for d, e in blocks(at):
                part, cuts = ids[at[d]:at[e]], at[d:e + 1] - at[d]
                by_ids += [hashlib.sha256(x[:-1]).hexdigest() for x in numbers.join(part, cuts)]
                texts += [hashlib.sha256(x).hexdigest() for x in decoded(shown, part, cuts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at)), pa.array(by_ids, pa.string()), pa.array(texts, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_column(docs: DataFrame, model: str, name: str = "piece_ids") -> DataFrame:
    """``docs`` with the ids of every text as an array column (a column of that name is replaced)."""
    kept = [f.name for f in docs.schema if f.name != name]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != name) + f", `{name}` array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(Model(model))
        for b in slices(batches):
            ids, at = table(b.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), lists], [*kept, name])

    return docs.select(*(f"`{c}`" for c in kept)).mapInArrow(run, schema)
