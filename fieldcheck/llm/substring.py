"""Substring de-duplication by hashes of word windows, dealt by prefixes.

Which word windows occur earlier is read off the suffix tree of all documents: a window of ``WINDOW``
words repeats exactly if it ends below an internal node of at least that depth. The tree is never built
as a whole. Of the suffixes of a document only those matter that begin a window, and every window is
filed under one prefix that depends on its words alone: the rarest-looking run of ``PREFIX`` words inside
it (its minimum hash). Windows in a row share this run, so one entry holds many of them.

Prefixes have variable length. A run that is frequent across the corpus (a fixed-size table of counts
over all documents tells) is extended to the whole window, which splits its suffixes over many groups;
the others stay at ``PREFIX`` words. Groups are packed into partitions that fit in memory. A task builds
no tree and sorts no suffixes: it groups the windows of its prefixes by hash, which says what a node of
the window's depth would. The first window of a group is the earliest occurrence; all others are to be removed. Neighbouring windows join into maximal repeats.

A task keeps only the earliest of equal windows of a slice before anything is sent, so a passage that a
third of all documents share arrives once from each slice. Suffixes are never shipped word by word: one
entry takes 21 bytes and 8 for each of its windows. Windows are told apart by 128 bits: the 64 of the
prefix and 64 of the window from word hashes of another seed (within a task's slice: 64 of the window from
each seed). Only the 64 of the window can fail between windows of one prefix. Their words are not compared.

Defined results: null texts have no words; documents of fewer words than a window lose nothing; "earlier"
is by doc_id (null first), then by the hash of the text, then by position; rows with equal doc_id and
equal text are one document, so neither makes the other a repeat. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcheck.llm.common import (
    NULL_ID, SPACED, U64, Words, gram_hashes, mix, parts, ragged, slices, windows, words,
)

WINDOW = 20
PREFIX = 8
#: Slots of the table of counts: 4 MB, whatever the corpus.
SLOTS = 1 << 20
PIECES = 16
#: Of the second hash of a window.
SEED = 0x5EED
#: A prefix whose slot holds more entries than this many times the mean, and more than ``MANY``, is extended.
TIMES = 16
MANY = 4096

#: Bytes of text whose windows are worked on at once.
SLICE = 4 << 20

RUN = np.dtype([("prefix", "<u8"), ("doc", "<i8"), ("tie", "<i4"), ("pos", "<u4"), ("n", "u1")])


def slot(prefix: np.ndarray) -> np.ndarray:
    return (mix(prefix) & U64(SLOTS - 1)).astype(np.int64)


def suffixes(w: Words, window: int, prefix: int, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of every window, its hash, and the place of its minimum run of ``prefix`` words."""
    h = w.hashes() if h is None else h
    at = windows(w, window)
    if not len(at):
        return at, np.zeros(0, U64), at
    whole = gram_hashes(h, at, window)
    grams = np.full(len(h), np.iinfo(np.uint64).max, U64)
    inner = windows(w, prefix)
    grams[inner] = gram_hashes(h, inner, prefix)
    low, place = grams[at], at.copy()
    for i in range(1, window - prefix + 1):
        g = grams[at + i]
        less = g < low
        low = np.where(less, g, low)
        place[less] = at[less] + i
    return at, whole, place


def first_of(key: np.ndarray, other: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows whose key occurs more than once: their indices, and for each the index of the first equal row.

    Rows are equal if both ``key`` and ``other`` are; one that shares its key alone is its own first.
    """
    o = np.argsort(key)
    k = key[o]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    many = o[same[1:] | same[:-1]]
    if not len(many):
        return many, many
    many = many[np.lexsort((*(x[many] for x in reversed(order)), other[many], key[many]))]
    k, o = key[many], other[many]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])])
    return many, many[np.maximum.accumulate(np.where(new, np.arange(len(many)), 0))]


def _doc_columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return b.column("dk").to_numpy(), b.column("tie").to_numpy()


def repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """(dk, tie, found): documents with words to remove, as (begin, end) pairs of little-endian 32-bit numbers."""
    spark = docs.sparkSession
    n_parts = parts(docs, 4.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for b in slices(batches):
            w = words(b.column("text"), SPACED)
            h = w.hashes()
            at, _, place = suffixes(w, window, prefix, h)
            if len(at):
                new = np.concatenate([[True], place[1:] != place[:-1]])
                total += np.bincount(slot(gram_hashes(h, place[new], prefix)), minlength=SLOTS)
        if total.any():
            blobs = [zlib.compress(c.astype("<u4").tobytes(), 1) for c in np.split(total, PIECES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array(blobs, pa.binary())], ["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for p, c in zip(b.column("piece").to_pylist(), b.column("counts")):
                x = np.frombuffer(zlib.decompress(c.as_py()), "<u4").astype(np.int64)
                total[p] = total[p] + x if p in total else x
        out = [np.packbits(_frequent(x)).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(out, pa.binary())], ["piece", "flags"])

    def _frequent(x: np.ndarray) -> np.ndarray:
        return x > max(MANY, TIMES * x.mean())

    text = keyed(docs)
    got = (text.select("text").mapInArrow(count, "piece int, counts binary").repartition(PIECES, "piece")
           .mapInArrow(add, "piece int, flags binary").collect())
    hot = np.zeros(SLOTS, bool)
    for r in got:
        hot.reshape(PIECES, -1)[r.piece] = np.unpackbits(np.frombuffer(bytes(r.flags), np.uint8)).astype(bool)
    frequent = spark.sparkContext.broadcast(hot)  # one megabyte

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "runs", "leaves", "bucket", "spans"]
        for b in slices(batches, size=SLICE):
            w = words(b.column("text"), SPACED)
            h = w.hashes()
            at, whole, place = suffixes(w, window, prefix, h)
            if not len(at):
                continue
            node = gram_hashes(w.hashes(SEED), at, window)
            dk, tie = _doc_columns(b)
            doc = w.doc()[at]
            pos = at - w.first[doc]
            many, first = first_of(whole, node, dk[doc], tie[doc], pos)
            later = ~((dk[doc[many]] == dk[doc[first]]) & (tie[doc[many]] == tie[doc[first]]) & (pos[many] == pos[first]))
            gone = many[later]
            if len(gone):
                found = list(_packed(dk, tie, doc[gone], pos[gone], window, n_parts))
                bucket, none = pa.array([x for x, _ in found], pa.int32()), pa.nulls(len(found), pa.binary())
                yield pa.RecordBatch.from_arrays([bucket, none, none, bucket, pa.array([x for _, x in found], pa.binary())], names)
            keep = np.ones(len(at), bool)
            keep[many[many != first]] = False
            i = np.flatnonzero(keep)
            run = gram_hashes(h, place[i], prefix)
            long = frequent.value[slot(run)]
            # An extended prefix is the window itself, so its windows never share an entry.
            run[long] = whole[i][long]
            new = np.ones(len(i), bool)
            new[1:] = (place[i][1:] != place[i][:-1]) | (i[1:] != i[:-1] + 1) | long[1:] | long[:-1]
            head = np.flatnonzero(new)
            r = np.empty(len(head), RUN)
            r["prefix"], r["doc"], r["tie"] = run[head], dk[doc[i[head]]], tie[doc[i[head]]]
            r["pos"], r["n"] = pos[i[head]], np.diff(head, append=len(i))
            leaf = node[i]
            part = mix(r["prefix"]) % U64(n_parts)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(n_parts + 1, dtype=U64))
            size = r["n"].astype(np.int64)[order]
            leaf = leaf[ragged(head[order], size)]
            ends = np.concatenate([[0], np.cumsum(size)])
            r = r[order]
            some = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays([
                pa.array(some, pa.int32()),
                pa.array([b"".join(np.ascontiguousarray(r[cuts[p]:cuts[p + 1]][f]).tobytes() for f in RUN.names) for p in some], pa.binary()),
                pa.array([leaf[ends[cuts[p]]:ends[cuts[p + 1]]].tobytes() for p in some], pa.binary()),
                pa.nulls(len(some), pa.int32()), pa.nulls(len(some), pa.binary())], names)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, leaves = [], []
        for b in batches:
            ready = b.column("spans").is_valid()
            yield b.select(["bucket", "spans"]).filter(ready)
            b = b.filter(b.column("runs").is_valid())
            for x, y in zip(b.column("runs"), b.column("leaves")):
                runs.append(_columns(x.as_py()))
                leaves.append(np.frombuffer(y.as_py(), "<u8"))
        if not runs:
            return
        r, leaf = np.concatenate(runs), np.concatenate(leaves)
        n = r["n"].astype(np.int64)
        owner = np.repeat(np.arange(len(r)), n)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        pos = r["pos"].astype(np.int64)[owner] + step
        node = mix(r["prefix"][owner] ^ mix(leaf + U64(1)))
        many, first = first_of(node, leaf, r["doc"][owner], r["tie"][owner], pos)
        x, y = owner[many], owner[first]
        later = ~((r["doc"][x] == r["doc"][y]) & (r["tie"][x] == r["tie"][y]) & (pos[many] == pos[first]))
        gone = many[later]
        if len(gone):
            order = np.lexsort((pos[gone], r["tie"][owner[gone]], r["doc"][owner[gone]]))
            gone = gone[order]
            d, t = r["doc"][owner[gone]], r["tie"][owner[gone]]
            new = np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])])
            head = np.flatnonzero(new)
            found = list(_packed(d[head], t[head], np.cumsum(new) - 1, pos[gone], window, n_parts))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["bucket", "spans"])

    sent = text.select("dk", "tie", "text").mapInArrow(emit, "part int, runs binary, leaves binary, bucket int, spans binary")
    grown = sent.repartition(n_parts, "part").mapInArrow(grow, "bucket int, spans binary")
    return grown.repartition(n_parts, "bucket").mapInArrow(_gather, "dk long, tie int, found binary")


def substring_dedup(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, removed (spans of words)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = words(b.column("text"), SPACED)
            edge = np.zeros(len(w) + 1, np.int64)
            for base, found in zip(w.first.tolist(), b.column("found")):
                if found.is_valid:
                    span = np.frombuffer(found.as_py(), "<u4").reshape(-1, 2).astype(np.int64) + base
                    np.add.at(edge, span[:, 0], 1)
                    np.add.at(edge, span[:, 1], -1)
            gone = np.cumsum(edge[:-1]) > 0
            before = np.concatenate([[0], np.cumsum(gone)])[w.first]
            kept, ends = joined(w, ~gone)
            removed = ["" if x == y else spans_text(gone[a:e]) for a, e, x, y in zip(w.first[:-1], w.first[1:], before[:-1], before[1:])]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array(w.counts.astype(np.int64)), pa.array(np.diff(before).astype(np.int64)),
                pa.array([hashlib.sha256(kept[a:max(a, e - 1)]).hexdigest() for a, e in zip(ends[:-1], ends[1:])], pa.string()),
                pa.array(removed, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])

    found = repeats(docs, window, prefix)
    return (keyed(docs).hint("merge").join(found, ["dk", "tie"], "left").select("doc_id", "text", "found")
            .mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept_sha256 string, removed string"))


def joined(w: Words, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The kept words of all documents, one blank after each, and where each document begins (and the end)."""
    size = (w.end - w.begin + 1)[keep]
    begin = w.begin[keep]
    ends = np.cumsum(size)
    data = w.data[ragged(begin, size)]
    data[ends - 1] = 32
    at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(keep)])[w.first]]
    return data.tobytes(), at


def spans_text(gone: np.ndarray) -> str:
    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    return ",".join(f"{a}:{b}" for a, b in zip(edge[::2], edge[1::2]))


def _columns(data: bytes) -> np.ndarray:
    """Entries from their columns, one after another."""
    n = len(data) // RUN.itemsize
    out, at = np.empty(n, RUN), 0
    for f in RUN.names:
        kind = RUN[f]
        out[f] = np.frombuffer(data, kind, n, at)
        at += n * kind.itemsize
    return out


def _packed(dk, tie, doc, pos, window: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """The words that windows cover, as spans of documents, packed by buckets of documents."""
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + window)
    head = np.flatnonzero(new)
    last = np.concatenate([head[1:], [len(doc)]]) - 1
    span = np.stack([pos[head], pos[last] + window], 1).astype("<u4")
    d = doc[head]
    first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
    n = np.diff(first, append=len(d))
    ids, ties = dk[d[first]].astype("<i8"), tie[d[first]].astype("<i4")
    bucket = (mix(ids.view(U64) ^ ties.astype(np.int64).view(U64)) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        spans = span[ragged(first[part], n[part])]
        yield int(bucket[part[0]]), b"".join(x.tobytes() for x in (np.array([len(part)], "<i8"), ids[part], ties[part], n[part].astype("<u4"), spans))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document of the buckets of this task, with all its spans."""
    got = []
    for b in batches:
        for x in b.column("spans"):
            x = x.as_py()
            n = int(np.frombuffer(x, "<i8", 1)[0])
            got.append((np.frombuffer(x, "<i8", n, 8), np.frombuffer(x, "<i4", n, 8 + 8 * n), np.frombuffer(x, "<u4", n, 8 + 12 * n),
                        np.frombuffer(x, "<u4", -1, 8 + 16 * n).reshape(-1, 2)))
    if not got:
        return
    dk, tie, n, span = (np.concatenate(x) for x in zip(*got))
    n = n.astype(np.int64)
    first = np.cumsum(n) - n
    order = np.lexsort((tie, dk))
    dk, tie, n, span = dk[order], tie[order], n[order], span[ragged(first[order], n[order])]
    ends = np.cumsum(n)
    docs = np.flatnonzero(np.concatenate([[True], (dk[1:] != dk[:-1]) | (tie[1:] != tie[:-1])]))
    stop = ends[np.concatenate([docs[1:], [len(dk)]]) - 1]
    start = np.concatenate([[0], stop[:-1]])
    yield pa.RecordBatch.from_arrays([pa.array(dk[docs]), pa.array(tie[docs]), pa.array([span[a:b].tobytes() for a, b in zip(start, stop)], pa.binary())],
                                     ["dk", "tie", "found"])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the document's key: (dk, tie), the id (null first) and a hash of the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(NULL_ID)).alias("dk"), F.hash("text", "doc_id").alias("tie"))
