"""Byte-level BPE encoding by a pair occurrence index, and decoding.

A task cuts its texts into chunks, splits every distinct chunk into pre-tokens, and encodes all distinct
pre-tokens of a slice together: an index maps each pair of symbols to all its positions in the slice,
the active ranks are taken in ascending order from a heap, all occurrences of a rank are merged at once,
and the lists of the pairs next to the merged places are updated. A merge can only create pairs of a
higher rank, so ascending order gives the same ids as merging word by word.

Defined results: a null text is empty and has no ids; the file's special tokens in a text become their
own ids, as the tokenizers library does; rows are never combined, so repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcheck.llm.common import ragged, slices
from fieldcheck.llm.pieces import Encoder, plain

#: Fixed value: the pre-token pattern that byte-level tokenizer files of this kind imply.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Larger slices than elsewhere, since one pass over the ranks then serves more pre-tokens.
ENCODE_BYTES = 16 << 20


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the file, and its byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    """The merges, symbols and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = max([*vocab.values(), *self.special.values()]) + 1
        table = [b""] * ids
        for token, i in vocab.items():
            table[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in self.special.items():
            table[i] = token.encode()
        self.bytes_of = table
        self.symbol = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.symbol[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.base = ids
        key = self.left * ids + self.right
        order = np.argsort(key, kind="stable")
        first = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        self.keys, self.ranks = key[order][first], order[first]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of every pair, -1 where the pair never merges."""
        key = a * self.base + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens one after another, and how many each has."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        sym, n = self.symbol[data], len(data)
        end = np.cumsum(length)
        # Links within a pre-token; position n stands for "none" and holds a symbol that never pairs.
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[end[length > 0] - 1] = n
        prv[(end - length)[length > 0]] = n
        nxt, prv = np.append(nxt, n), np.append(prv, n)
        sym = np.append(sym, -self.base * self.base)
        rank = self.rank(sym[:-1], sym[nxt[:-1]])
        order = np.argsort(rank, kind="stable")
        order = order[np.searchsorted(rank[order], 0):]
        cuts = np.flatnonzero(np.diff(rank[order])) + 1
        index: dict[int, list] = {int(rank[p[0]]): [p] for p in np.split(order, cuts) if len(p)}
        few: dict[int, list[int]] = {}
        heap = sorted(index)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r, [])
            if r in few:
                lists.append(np.array(few.pop(r), np.int64))
            pos = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b, made = self.left[r], self.right[r], self.made[r]
            pos = pos[(sym[pos] == a) & (sym[nxt[pos]] == b)]
            if not len(pos):
                continue
            if len(lists) > 1 or len(pos) > 1:
                pos = np.sort(pos)
                pos = pos[np.concatenate([[True], pos[1:] != pos[:-1]])]
            if a == b and len(pos) > 1:
                # Of a run of overlapping occurrences every second one merges, from the left.
                starts = np.concatenate([[True], nxt[pos[:-1]] != pos[1:]])
                since = np.arange(len(pos)) - np.maximum.accumulate(np.where(starts, np.arange(len(pos)), 0))
                pos = pos[since % 2 == 0]
            gone = nxt[pos]
            after, before = nxt[gone], prv[pos]
            sym[pos], sym[gone] = made, -1
            nxt[pos], prv[after] = after, pos
            prv[n] = n
            at = np.concatenate([before, pos])
            at = at[at < n]
            new = self.rank(sym[at], sym[nxt[at]])
            at, new = at[new > r], new[new > r]
            if len(at) <= 32:
                for q, k in zip(at.tolist(), new.tolist()):
                    if k in few:
                        few[k].append(q)
                    else:
                        few[k] = [q]
                        if k not in index:
                            heapq.heappush(heap, k)
                continue
            order = np.argsort(new, kind="stable")
            at, new = at[order], new[order]
            cuts = np.flatnonzero(np.diff(new)) + 1
            for k, p in zip(new[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
                if k not in index:
                    index[k] = []
                    if k not in few:
                        heapq.heappush(heap, k)
                index[k].append(p)
        alive = sym[:n] >= 0
        left = np.concatenate([[0], np.cumsum(alive)])
        return sym[:n][alive].astype(np.uint32), left[end] - left[end - length]


def chunk_encoder(pairs: BytePairs):
    """Encodes chunks: pre-tokens by the pattern, ids by the pair index; special tokens stand apart."""
    piece = regex.compile(PATTERN)
    apart = regex.compile("|".join(map(regex.escape, sorted(pairs.special, key=len, reverse=True)))) if pairs.special else None
    special = tuple(pairs.special)

    def encode(new: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        flags = [plain(c, special) for c in new]
        run = [c for c, f in zip(new, flags) if f]
        known: dict[str, int] = {}
        which: list[int] = []
        sizes: list[int] = []
        for at in range(0, len(run), 4096):
            # Line ends stand between chunks and are pre-tokens of their own.
            n = 0
            for p in piece.findall("\n".join(run[at:at + 4096])):
                if p == "\n":
                    sizes.append(n)
                    n = 0
                else:
                    which.append(known.setdefault(p, len(known)))
                    n += 1
            sizes.append(n)
        rest = [c for c, f in zip(new, flags) if not f]
        for c in rest:
            n, at = 0, 0
            for m in [*(apart.finditer(c) if apart else ()), None]:
                for p in piece.findall(c[at:m.start() if m else len(c)]):
                    which.append(known.setdefault(p, len(known)))
                    n += 1
                if m:
                    which.append(-1 - pairs.special[m.group()])
                    at, n = m.end(), n + 1
            sizes.append(n)
        ids, length = pairs.encode([p.encode() for p in known])
        # Special ids follow the pool of encoded pre-tokens, one each.
        pool = np.concatenate([ids, np.arange(pairs.base, dtype=np.uint32)]) if rest else ids
        first = np.cumsum(length) - length
        use = np.array(which, np.int64)
        own = use >= 0
        start, size = np.empty(len(use), np.int64), np.ones(len(use), np.int64)
        start[own], size[own] = first[use[own]], length[use[own]]
        start[~own] = len(ids) - 1 - use[~own]
        ends = np.concatenate([[0], np.cumsum(size)])
        per = np.cumsum(np.array(sizes, np.int64))
        return run + rest, pool[ragged(start, size)], np.diff(ends[per], prepend=0)

    return encode


class Pool:
    """Byte strings by id, joined for whole arrays of ids."""

    def __init__(self, items: list[bytes]):
        self.data = np.frombuffer(b"".join(items), np.uint8)
        self.size = np.fromiter(map(len, items), np.int64, len(items))
        self.first = np.cumsum(self.size) - self.size

    def join(self, ids: np.ndarray, at: np.ndarray) -> Iterator[bytes]:
        """The joined bytes of ids ``at[d]:at[d+1]`` for every d."""
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])[at]
        data = self.data[ragged(self.first[ids], size)].tobytes()
        return (data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()))


def blocks(at: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Documents in blocks of about ``size`` ids."""
    d = 0
    while d < len(at) - 1:
        e = max(d + 1, int(np.searchsorted(at, at[d] + size, "right")) - 1)
        yield d, e
        d = e


def _utf8(data: bytes) -> bytes:
    return data.decode("utf-8", "replace").encode()


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = BytePairs(tokenizer)
        enc, texts = Encoder(chunk_encoder(pairs), tuple(pairs.special)), Pool(pairs.bytes_of)
        numbers = Pool([b"%d," % i for i in range(pairs.base)])
        for b in slices(batches, size=ENCODE_BYTES):
            ids, at = enc(b.column("text"))
            by_ids, decoded = [], []
            for d, e in blocks(at):
                own, cuts = ids[at[d]:at[e]], at[d:e + 1] - at[d]
                by_ids += [hashlib.sha256(x[:-1]).hexdigest() for x in numbers.join(own, cuts)]
                decoded += [hashlib.sha256(_utf8(x)).hexdigest() for x in texts.join(own, cuts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at)), pa.array(by_ids, pa.string()),
                                              pa.array(decoded, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_column(docs: DataFrame, tokenizer: str, name: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of every text as an array column, and the texts as decoded from those ids."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != name) + f", `{name}` array<int>"
    kept = [f.name for f in docs.schema if f.name != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = BytePairs(tokenizer)
        enc, texts = Encoder(chunk_encoder(pairs), tuple(pairs.special)), Pool(pairs.bytes_of)
        for b in slices(batches):
            ids, at = enc(b.column("text"))
            back = [x.decode("utf-8", "replace") for d, e in blocks(at) for x in texts.join(ids[at[d]:at[e]], at[d:e + 1] - at[d])]
            null = b.column("text").is_null().to_numpy(zero_copy_only=False)
            cols = [b.column(c) if c != "text" else pa.array(back, b.schema.field("text").type, mask=null) for c in kept]
            cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(cols, [*kept, name])

    return docs.select(*kept).mapInArrow(run, schema)
