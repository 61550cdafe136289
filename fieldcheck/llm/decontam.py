"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned over all windows.

Words are runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. A test item
gives every run of ten consecutive words, or all its words where it has fewer. The hashes of these
windows are broadcast while the test set is at most ``BROADCAST_BYTES`` of text; a larger one is joined
with the windows of the documents by a shuffle instead. Every hit found by hash is verified on the words.

Defined results: null texts and texts without words have no windows and are never contaminated; test
items without words match nothing; a null item_id is listed as the empty string; an item_id that occurs
in several rows is one item. Extra columns are ignored, and ``decontaminate`` returns them untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcheck.llm.common import ALNUM, Words, chain, gram_hashes, slices, stored, windows, words

NGRAM = 10
#: Text of the test set that may be broadcast (its index takes a few times as much).
BROADCAST_BYTES = 32 << 20

_RESULT = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, "
           "contaminated boolean, hit_spans string")


def item_windows(rows: list[tuple[str | None, str | None]], n: int) -> dict[int, dict[str, list[str]]]:
    """For every window length the windows (words joined by a blank) with the items that hold them."""
    out: dict[int, dict[str, list[str]]] = {}
    w = words(pa.array([t for _, t in rows], pa.large_string()), ALNUM, lower=True)
    for (item, _), a, b in zip(rows, w.first[:-1], w.first[1:]):
        own = [w.text(i) for i in range(a, b)]
        size = min(n, len(own))
        for i in range(len(own) - size + 1) if size else ():
            holders = out.setdefault(size, {}).setdefault(" ".join(own[i:i + size]), [])
            if not holders or holders[-1] != (item or ""):
                holders.append(item or "")
    return out


class NgramIndex:
    """Windows of a test set by length: sorted hashes to probe, words to verify, items to report."""

    def __init__(self, rows: list[tuple[str | None, str | None]], n: int = NGRAM):
        self.by_size = {}
        for size, found in item_windows(rows, n).items():
            texts = list(found)
            w = words(pa.array(texts, pa.large_string()), ALNUM)
            h = chain([w.hashes()[np.arange(len(texts)) * size + i] for i in range(size)])
            order = np.argsort(h)
            self.by_size[size] = (h[order], [texts[i] for i in order], [found[texts[i]] for i in order])

    def hits(self, w: Words) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, words, items) of every window of ``w`` that a test item holds."""
        h = w.hashes()
        for size, (known, texts, items) in self.by_size.items():
            at = windows(w, size)
            if not len(at):
                continue
            got = gram_hashes(h, at, size)
            low = np.searchsorted(known, got)
            low[low == len(known)] = 0
            for i in np.flatnonzero(known[low] == got):
                first, k = int(at[i]), int(low[i])
                text = " ".join(w.text(first + j) for j in range(size))
                while k < len(known) and known[k] == got[i]:
                    if texts[k] == text:
                        yield first, size, items[k]
                    k += 1


def _covered(w: Words, hits) -> tuple[np.ndarray, list[set[str]]]:
    """Which words are hit, and the items met in every document."""
    edge, items = np.zeros(len(w) + 1, np.int64), [set() for _ in w.counts]
    for first, size, names in hits:
        edge[first] += 1
        edge[first + size] -= 1
        items[int(np.searchsorted(w.first, first, "right")) - 1].update(names)
    return np.cumsum(edge[:-1]) > 0, items


def _report(b: pa.RecordBatch, w: Words, hit: np.ndarray, items: list[set[str]]) -> pa.RecordBatch:
    total = np.concatenate([[0], np.cumsum(hit)])[w.first]
    n_hit = np.diff(total)
    spans = ["" if not n else ",".join(f"{i}:{j}" for i, j in _runs(hit[a:e]))
             for n, a, e in zip(n_hit, w.first[:-1], w.first[1:])]
    return pa.RecordBatch.from_arrays([
        b.column("doc_id").cast(pa.int64()), pa.array(w.counts.astype(np.int64)), pa.array(n_hit.astype(np.int64)),
        pa.array([len(x) for x in items], pa.int64()),
        pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]),
        pa.array(n_hit > 0), pa.array(spans, pa.string()),
    ], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])]


def _index(benchmark: DataFrame, n: int) -> NgramIndex | None:
    """The broadcast index, or None where the test set is beyond the bound."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > BROADCAST_BYTES:
        return None
    return NgramIndex([tuple(r) for r in items.dropDuplicates().sort("item_id", "text").collect()], n)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """One row per row of ``docs``: hit words, items and hit spans (word numbers, end exclusive)."""
    index = _index(benchmark, n)
    if index is None:
        return _joined(docs, benchmark, n)
    known = docs.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = words(b.column("text"), ALNUM, lower=True)
            yield _report(b, w, *_covered(w, known.value.hits(w)))

    return _plain(docs).mapInArrow(scan, _RESULT)


def _met(rows: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """(rid, first, size, item): windows of the test set in ``rows`` (rid, text), by a shuffle join on the windows."""
    tests = stored(benchmark.select(F.col("item_id").cast("string").alias("item_id"),
                                    F.col("text").cast("string").alias("text")), "tests")

    def of_items(batches):
        for b in slices(batches):
            found = item_windows(list(zip(b.column("item_id").to_pylist(), b.column("text").to_pylist())), n)
            out = [(s, t, i) for s, x in found.items() for t, names in x.items() for i in names]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in
                                              enumerate((pa.int32(), pa.string(), pa.string()))], ["size", "gram", "item"])

    grams = stored(tests.mapInArrow(of_items, "size int, gram string, item string").distinct(), "grams")
    sizes = [r[0] for r in grams.select("size").distinct().collect()]  # at most n values

    def of_docs(batches):
        for b in slices(batches, size=1 << 20):
            w = words(b.column("text"), ALNUM, lower=True)
            rid, doc = np.asarray(b.column("rid")), w.doc()
            texts = [w.text(i) for i in range(len(w))]
            for s in sizes:
                at = windows(w, s)
                yield pa.RecordBatch.from_arrays([
                    pa.array(rid[doc[at]]), pa.array((at - w.first[doc[at]]).astype(np.int32)),
                    pa.array(np.full(len(at), s, np.int32)), pa.array([" ".join(texts[i:i + s]) for i in at], pa.string()),
                ], ["rid", "first", "size", "gram"])

    return rows.select("rid", "text").mapInArrow(of_docs, "rid long, first int, size int, gram string").join(grams, ["size", "gram"])


def _places():
    """Bounded by the words of a document and the items whose windows it holds."""
    return F.collect_set(F.struct("first", "size")).alias("at")


def _hit_at(w: Words, places: pa.Array) -> np.ndarray:
    """Which words are within the (first, size) of their document."""
    edge = np.zeros(len(w) + 1, np.int64)
    for base, at in zip(w.first, places.to_pylist()):
        for x in at or ():
            edge[base + x["first"]] += 1
            edge[base + x["first"] + x["size"]] -= 1
    return np.cumsum(edge[:-1]) > 0


def _joined(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """The same by a shuffle join on the windows themselves, for test sets of any size."""
    rows = stored(_plain(docs).withColumn("rid", F.monotonically_increasing_id()), "docs")
    per_doc = _met(rows, benchmark, n).groupBy("rid").agg(_places(), F.collect_set("item").alias("items"))

    def report(batches):
        for b in slices(batches):
            w = words(b.column("text"), ALNUM, lower=True)
            items = [set(names or ()) for names in b.column("items").to_pylist()]
            yield _report(b, w, _hit_at(w, b.column("at")), items)

    return rows.join(per_doc, "rid", "left").mapInArrow(report, _RESULT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, remove: str = "documents") -> DataFrame:
    """``docs`` with its own columns, without contaminated documents or without the words that were hit.

    With ``remove="spans"`` the hit words of a text go, together with what stands between them.
    """
    index = _index(benchmark, n)
    if index is None:
        return _joined_clean(docs, benchmark, n, remove)
    known = docs.sparkSession.sparkContext.broadcast(index)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = words(b.column("text"), ALNUM, lower=True)
            hit, _ = _covered(w, known.value.hits(w))
            if remove == "documents":
                bad = np.diff(np.concatenate([[0], np.cumsum(hit)])[w.first]) > 0
                yield b.filter(pa.array(~bad))
                continue
            yield _without(b, w, hit)

    return docs.mapInArrow(clean, docs.schema)


def _without(b: pa.RecordBatch, w: Words, hit: np.ndarray) -> pa.RecordBatch:
    """The rows with their texts less the runs of hit words."""
    texts = b.column("text").to_pylist()
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(b.column("text").cast(pa.large_string())), 0).to_numpy(zero_copy_only=False) + 1)])
    for d, (a, e) in enumerate(zip(w.first[:-1], w.first[1:])):
        if hit[a:e].any():
            raw = texts[d].encode()
            for i, j in reversed(_runs(hit[a:e])):
                raw = raw[:w.begin[a + i] - ends[d]] + raw[w.end[a + j - 1] - ends[d]:]
            texts[d] = raw.decode()
    at = b.schema.get_field_index("text")
    return b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))


def _joined_clean(docs: DataFrame, benchmark: DataFrame, n: int, remove: str) -> DataFrame:
    """``decontaminate`` by a shuffle join, for test sets of any size; rows are told apart by a number of their own."""
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = stored(docs.select(own.alias("own"), F.col("text").cast("string").alias("text"),
                              F.monotonically_increasing_id().alias("rid")), "docs")
    met = _met(rows, benchmark, n)
    if remove == "documents":
        return rows.select("own", "rid").join(met.select("rid"), "rid", "left_anti").select("own.*")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = words(b.column("text"), ALNUM, lower=True)
            inner = b.column("own")
            yield _without(pa.RecordBatch.from_arrays(inner.flatten(), [f.name for f in inner.type]), w, _hit_at(w, b.column("at")))

    per_doc = met.groupBy("rid").agg(_places())
    return rows.join(per_doc, "rid", "left").select("own", "text", "at").mapInArrow(clean, docs.schema)


__all__ = ["NGRAM", "NgramIndex", "contamination", "decontaminate", "item_windows"]
