"""Ranked lexical search by NRA: impact-sorted lists read in sequence, score intervals per document.

The queries are a stated set of items. Their terms come in blocks of at most ``BLOCK_BYTES``, each of
which is sent to all tasks and answered by a scan of its own, so neither the driver nor a task ever holds
more than one block.

A first scan counts documents, terms and the document frequencies of the block's terms. In the second
scan a task inverts the texts of a slice for the block's terms: a list holds a term's documents by
descending impact. For each item its lists are then read in sequence, a run of each list at a time. What
was read is a document's lower bound; its upper bound adds, for each list it was not met in, the impact
that the list was last read at. Reading goes on until every document whose upper bound reaches the k-th
best lower bound is resolved (both bounds equal), so membership, ties and scores are final. The best k of
a task's earlier slices bound the later ones from below. A task returns at most k documents an item; these
are ranked by parts first, then by item.

Defined results: null texts have no terms; documents without terms are not counted. Rows are documents, so
repeated rows and doc_ids each rank by themselves; equal scores go by ascending doc_id, null first. Rows
that repeat an item_id are one item with all their terms; items without terms, and items that nothing
matches, return no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldcheck.llm.common import ALNUM, ragged, slices, stored, word_strings, words

#: Documents returned for an item.
BEST = 50
#: Query terms that travel to the tasks at once, in bytes.
BLOCK_BYTES = 16 << 20
#: Documents times lists that one item's search holds at once.
CELLS = 1 << 26
#: Entries of a list that are read first; each round reads twice as many as the last.
RUN = 256


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term)."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = words(b.column("text"), ALNUM, lower=True)
            yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(w.doc())), word_strings(w, ALNUM).cast(pa.string())], ["item_id", "term"])

    return items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"item_id {kind}, term string").distinct()


class Lists:
    """The postings of a slice for the terms of a block: document, occurrences, and each term's bounds."""

    def __init__(self, text: pa.Array, terms: pa.Array):
        w = words(text, ALNUM, lower=True)
        self.n_terms = w.counts.astype(np.int64)
        coded = word_strings(w, ALNUM).dictionary_encode()
        known = pc.fill_null(pc.index_in(coded.dictionary, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        of_word = known[coded.indices.to_numpy()] if len(known) else known
        own = of_word >= 0
        n_docs = max(len(text), 1)
        key = of_word[own] * n_docs + w.doc()[own]
        key.sort()
        head = np.flatnonzero(np.diff(key, prepend=-1))
        self.term, self.doc = np.divmod(key[head], n_docs)
        self.tf = np.diff(head, append=len(key))
        self.first = np.searchsorted(self.term, np.arange(len(terms) + 1))

    def by_impact(self, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts, each list by descending impact."""
        order = np.lexsort((-impact, self.term))
        return self.doc[order], impact[order]


def length_factor(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """50 + (50 * n * n_docs) div n_terms, whole numbers also where the product needs more than 64 bits."""
    if 50 * int(n.max(initial=0)) * n_docs < 1 << 63:
        return 50 + 50 * n * n_docs // n_terms
    return np.array([50 + 50 * int(x) * n_docs // n_terms for x in n], np.int64)


def nra(doc: np.ndarray, impact: np.ndarray, first: np.ndarray, last: np.ndarray, n_docs: int, k: int,
        floor: int = 0, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores that may be among the best ``k``, with all ties, and score ``floor`` at least.

    List i is ``first[i]:last[i]`` of ``doc`` and ``impact``, by descending impact.
    """
    lower = np.zeros(n_docs, np.int64)
    met = np.zeros((len(first), n_docs), bool)
    at = first.copy()
    while True:
        for i, (a, b) in enumerate(zip(at.tolist(), np.minimum(at + run, last).tolist())):
            if a < b:
                d = doc[a:b]
                lower[d] += impact[a:b]
                met[i, d] = True
                at[i] = b
        # A list that is read to its end gives nothing more.
        left = np.where(at < last, impact[np.maximum(at - 1, 0)], 0)
        going = np.flatnonzero(left)
        upper = lower + left.sum()
        for i in going:
            upper[met[i]] -= left[i]
        least = max(floor, 1)
        if n_docs > k:
            least = max(least, int(np.partition(lower, n_docs - k)[n_docs - k]))
        may = upper >= least
        if (upper[may] == lower[may]).all():
            found = np.flatnonzero(may)
            return found, lower[found]
        run *= 2


class Best:
    """The best ``k`` documents of every item so far."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        none = np.zeros(0, np.int64)
        self.held = [(none, none, none)] * n_items

    def floor(self, item: int) -> int:
        score = self.held[item][0]
        return int(score[-1]) if len(score) == self.k else 0

    def add(self, item: int, score: np.ndarray, valid: np.ndarray, doc_id: np.ndarray) -> None:
        s, v, d = (np.concatenate(x) for x in zip(self.held[item], (score, valid, doc_id)))
        order = np.lexsort((d, v, -s))[:self.k]
        self.held[item] = s[order], v[order], d[order]


def _statistics(docs: DataFrame, terms: pa.Array) -> tuple[int, int, np.ndarray]:
    """Documents with terms, terms of all documents, and the document frequency of each of ``terms``."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # a block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(shared.value) + 2, np.int64)
        for b in slices(batches):
            lists = Lists(b.column("text"), shared.value)
            count[:-2] += np.diff(lists.first)
            count[-2:] += [(lists.n_terms > 0).sum(), lists.n_terms.sum()]
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["at", "n"])

    out = np.zeros(len(terms) + 2, np.int64)
    for at, n in docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n")).toLocalIterator():
        out[at] = n
    return int(out[-2]), int(out[-1]), out[:-2]


def _block(docs: DataFrame, pairs: list, kind: str, k: int) -> DataFrame | None:
    """The best documents of the items of a block, by task."""
    terms = pa.array(sorted({r.term for r in pairs}), pa.large_string())
    n_docs, n_terms, df = _statistics(docs, terms)
    if not n_terms:
        return None
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    number = {t: i for i, t in enumerate(terms.to_pylist())}
    own: dict = {}
    for r in pairs:
        own.setdefault(r.item_id, []).append(number[r.term])
    items = [np.array(sorted(x), np.int64) for x in own.values()]
    shared = docs.sparkSession.sparkContext.broadcast((terms, weight, list(own), items))  # a block
    widest = max(map(len, items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight, item_ids, items = shared.value
        best = Best(len(items), k)
        step = max(1, CELLS // widest)
        for whole in slices(batches):
            for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                lists = Lists(b.column("text"), terms)
                m = length_factor(lists.n_terms, n_docs, n_terms)
                tf = lists.tf.astype(np.int64)
                doc, impact = lists.by_impact(weight[lists.term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[lists.doc])))
                valid = b.column("doc_id").is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
                ids = pc.fill_null(b.column("doc_id"), 0).to_numpy()
                for i, t in enumerate(items):
                    t = t[(lists.first[t] < lists.first[t + 1]) & (weight[t] > 0)]
                    if len(t):
                        d, score = nra(doc, impact, lists.first[t], lists.first[t + 1], b.num_rows, k, best.floor(i))
                        best.add(i, score, valid[d], ids[d])
        size = np.array([len(x[0]) for x in best.held])
        score, valid, doc_id = (np.concatenate([x[i] for x in best.held]) for i in range(3))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(len(items)), size).astype(np.int32)), pa.array(doc_id, mask=valid == 0), pa.array(score)], ["item", "doc_id", "score"])

    found = docs.select("doc_id", "text").mapInArrow(run, "item int, doc_id long, score long")
    session = docs.sparkSession
    named = session.createDataFrame(list(enumerate(own)), f"item int, item_id {kind}")
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    part = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return found.join(named, "item").select("item_id", "rank", "doc_id", "score")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the best ``k`` documents with a score above 0 of every item."""
    kind = items.schema["item_id"].dataType.simpleString()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    terms = stored(item_terms(items), "terms")
    size = terms.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    n_blocks = -(-size // BLOCK_BYTES)
    out = docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for i in range(n_blocks):
        pairs = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == i).collect()
        found = _block(docs, pairs, kind, k) if pairs else None
        out = out if found is None else found if n_blocks == 1 else out.union(found)
    return out
