"""Exact n-gram Jaccard join with set-relation skipping, and the groups of linked documents.

Every document is the set of its word n-grams (64-bit hashes). Grams are put into one global order, rare
before frequent: a fixed-size table of counts over all documents (``SLOTS`` slots, its size independent of
the data) says how frequent a gram is about. The order decides only how much work there is. Two sets that
link share a gram among the first few of each (prefix filter), so those alone are sent to inverted lists.

Lists are blocks of sets of equal size, sorted by position. For a set and a block the positions that can
still reach the needed overlap are one contiguous run; the rest of the block is skipped unseen.

Answers are derived in steps. First each list compares its sets with one pivot and with their
neighbours in size only; verified links give preliminary groups. A set inherits the answers of the group
it is already in: a pair within one group needs no comparison, and a list whose sets are all in one
group is skipped as a whole. While that joins groups, a task looks at the pairs of different groups in
its long lists and keeps the likeliest of them that connect its groups, a forest with fewer edges than
the task has groups; a verified edge settles all other pairs of the two groups. Then all remaining likely
pairs of all lists are taken. No link between different groups can be missed, because every pair that
passes the filters and lies in different groups is compared in the end.

A pair is first compared on 16-bit marks of its first grams: linked sets must share a number of them
that follows from their sizes, and marks can only overstate what is shared. The marks of a set travel
once to each task that has it in a list, so unlikely pairs never leave the task that met them. What is
left is verified on the full sets, which are made anew from the texts of the sets concerned; a bit table
of fixed size keeps the other texts out of that shuffle.

Hot grams are split over several tasks in the first step, by the counts of the table. What is alone in
its task may have company in another one, so entries of split grams are all kept. In the last step lists of more than ``LONG`` sets are joined by Spark itself, which splits them over tasks.

Defined results: null or blank texts have no grams and link with nothing; texts with fewer words than a
gram are one gram as a whole; equal sets always link (they become one node before the join, so copies are
never compared); rows that repeat a doc_id share a group when their texts link; a null doc_id counts as
the smallest. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcheck.llm.common import (
    SPACED, U64, Words, chain, components, forget, gram_hashes, mix, only, parts, ragged, slices, stored, windows, words,
)

#: Slots of the table of counts, whatever the corpus: 32 MB in a task, never whole at the driver.
SLOTS = 1 << 22
#: The table travels in so many pieces.
PIECES = 16
#: Bits of the table that tells which texts are needed again: 2 MB, whatever the corpus. A full table
#: would let more texts through than needed, never fewer.
BITS = 1 << 24
#: Entries of a hot gram that one task takes in the first step.
SHARE = 20_000
#: Set in the position of an entry whose gram is dealt to several tasks, on its way there.
SHARED = np.uint32(1 << 31)
#: Lists of at most so many sets go straight to the last step.
SHORT = 16
#: Longer lists are left to a Spark join in the last step.
LONG = 20_000


def gram_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct gram hashes of every document, and where each document's begin (and end)."""
    h, n = w.hashes(), w.counts
    size = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(at[-1], U64)
    long = n >= k
    out[ragged(at[:-1][long], size[long])] = gram_hashes(h, windows(w, k), k)
    for d in np.flatnonzero((n > 0) & ~long):
        out[at[d]] = chain([h[i:i + 1] for i in range(w.first[d], w.first[d + 1])])[0]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[at[:-1][size > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[at]


def signature(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """An order-free 64-bit hash of each set."""
    ends = np.concatenate([np.zeros(1, U64), np.cumsum(mix(values + U64(1)), dtype=U64)])
    return mix((ends[at[1:]] - ends[at[:-1]]) ^ (at[1:] - at[:-1]).astype(U64) * U64(0x9E3779B97F4A7C15))


def order_keys(values: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Keys of the global order: the level of frequency first, then the hash."""
    return (level[slot(values)].astype(U64) << U64(59)) | (values >> U64(5))


def slot(values: np.ndarray) -> np.ndarray:
    return (values & U64(SLOTS - 1)).astype(np.int64)


def levels(counts: np.ndarray, mean: float) -> np.ndarray:
    """0 for ordinary slots, then one more with each doubling of what a slot has beyond the usual ``mean``.

    Rare grams fill the slots evenly, up to chance; what exceeds three deviations is a frequent gram.
    """
    mean = max(1.0, mean)
    return np.clip(np.floor(np.log2(np.maximum(counts - mean, 1) / (3 * np.sqrt(mean)))) + 1, 0, 31).astype(np.uint8)


def unpacked(steer: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The level of every slot, and over how many tasks its list is spread, from the packed pieces."""
    level, split = np.zeros(SLOTS, np.uint8), np.ones(SLOTS, np.uint16)
    for p, a, b in steer:
        level.reshape(PIECES, -1)[p] = np.frombuffer(zlib.decompress(a), np.uint8)
        split.reshape(PIECES, -1)[p] = np.frombuffer(zlib.decompress(b), "<u2")
    return level, split


class Threshold:
    """Jaccard similarity of at least ``num / den``, in whole numbers."""

    def __init__(self, num: int, den: int = 100):
        self.num, self.den = num, den

    def links(self, both, union):
        return self.den * both >= self.num * union

    def prefix(self, n):
        """Grams of a set of ``n`` that may meet a smaller set."""
        return n - -(-self.num * n // self.den) + 1

    def index_prefix(self, n):
        """Grams of a set of ``n`` that may meet a set at least as large."""
        return n - -(-2 * self.num * n // (self.num + self.den)) + 1

    def shared(self, n, m):
        """Grams that linked sets of these sizes share among the first ``prefix`` of both."""
        need = self.overlap(n, m)
        return need - np.maximum(n - self.prefix(n), m - self.prefix(m))

    def overlap(self, n, m):
        """Least overlap of linked sets of these sizes."""
        return -(-self.num * (n + m) // (self.num + self.den))


ENTRY = np.dtype([("gram", "<u8"), ("sid", "<u8"), ("n", "<u4"), ("pos", "<u4")])


#: Bits of a set's mark table in a task; marks, or pairs of a list, that are looked at together.
FOLD, AT_ONCE = 1 << 13, 1 << 19


class Marks:
    """The marks of the sets of a task: how many of its first grams a set may share with another."""

    def __init__(self, sids: np.ndarray, blobs: pa.ChunkedArray):
        order = np.argsort(sids)
        self.sids = sids[order]
        self.marks, at = [], 0
        blobs = blobs.combine_chunks()
        self.bits = np.zeros((len(order), FOLD // 8), np.uint8)
        for i, o in enumerate(order.tolist()):
            m = np.sort(np.frombuffer(blobs[o].as_buffer(), "<u2"))
            self.marks.append(m)
            flags = np.zeros(FOLD, bool)
            flags[m & (FOLD - 1)] = True
            self.bits[i] = np.packbits(flags, bitorder="little")
        self.size = np.fromiter(map(len, self.marks), np.int64, len(self.marks))

    def shared(self, x: np.ndarray, y: np.ndarray, need: np.ndarray) -> np.ndarray:
        """At least what sets ``x`` share with sets ``y`` (numbers of sets); closely where ``need`` is met.

        Bit tables come first; what they let through is compared mark by mark.
        """
        x, y = np.where(self.size[x] <= self.size[y], x, y), np.where(self.size[x] <= self.size[y], y, x)
        out = np.zeros(len(x), np.int64)
        order = np.argsort(x, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(x[order])) + 1) if len(x) else ():
            own = self.marks[x[part[0]]]
            f = (own & (FOLD - 1)).astype(np.int64)
            step = max(1, AT_ONCE // max(len(own), 1))
            for at in range(0, len(part), step):
                some = part[at:at + step]
                met = self.bits[y[some][:, None], f >> 3] >> (f & 7).astype(np.uint8) & 1
                out[some] = met.sum(1, dtype=np.int64)
            for i in part[out[part] >= need[part]].tolist():
                other = self.marks[y[i]]
                spot = np.minimum(np.searchsorted(other, own), len(other) - 1)
                out[i] = np.count_nonzero(other[spot] == own) if len(other) else 0
        return out


def first_met(gram: np.ndarray, x: np.ndarray, y: np.ndarray, own: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sets share no gram of lower order than the one at which they were met.

    ``own``: the sorted grams of every set by which it may be met.
    """
    out = np.empty(len(x), bool)
    for k, (g, a, b) in enumerate(zip(gram, x.tolist(), y.tolist())):
        a, b = own[a], own[b]
        a, b = a[:np.searchsorted(a, g)], b[:np.searchsorted(b, g)]
        out[k] = not len(a) or not len(b) or not (b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).any()
    return out


def forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Edges of a heaviest forest over the nodes ``a``, ``b``: every node's best edge, then every tree's, and so on."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    # Distinct ranks, so that no cycle can be chosen.
    rank = np.empty(len(a), np.int64)
    rank[np.lexsort((b, a, weight))] = np.arange(len(a))
    tree, chosen = np.arange(len(nodes)), np.zeros(len(a), bool)
    while True:
        tx, ty = tree[x], tree[y]
        open_ = np.flatnonzero(tx != ty)
        if not len(open_):
            return np.flatnonzero(chosen)
        best = np.full(len(nodes), -1)
        np.maximum.at(best, tx[open_], rank[open_])
        np.maximum.at(best, ty[open_], rank[open_])
        pick = open_[(best[tx[open_]] == rank[open_]) | (best[ty[open_]] == rank[open_])]
        chosen[pick] = True
        while True:
            low = np.minimum(tree[x[pick]], tree[y[pick]])
            new = tree.copy()
            np.minimum.at(new, tree[x[pick]], low)
            np.minimum.at(new, tree[y[pick]], low)
            new = new[new[new]]
            if (new[tree] == tree).all():
                break
            tree = new[tree]


def pairs_of(e: np.ndarray, label: np.ndarray | None, t: Threshold, every: bool) -> np.ndarray:
    """Candidate pairs (smaller set id first) of lists sorted by gram, size and position.

    ``every``: all pairs of different labels; otherwise each set with its list's pivot and its neighbour.
    """
    new = np.concatenate([[True], e["gram"][1:] != e["gram"][:-1]]) if len(e) else np.zeros(0, bool)
    if not len(e):
        return np.zeros((0, 2), U64)
    lists = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    n, pos = e["n"].astype(np.int64), e["pos"].astype(np.int64)
    if not every:
        pivot = np.flatnonzero(e["sid"] == np.minimum.reduceat(e["sid"], begin)[lists])
        pivot = pivot[np.concatenate([[True], lists[pivot][1:] != lists[pivot][:-1]])][lists]
        i = np.concatenate([np.arange(len(e)), np.arange(len(e) - 1)])
        j = np.concatenate([pivot, np.arange(1, len(e))])
        ok = (lists[i] == lists[j]) & (i != j)
        i, j = np.minimum(i, j)[ok], np.maximum(i, j)[ok]
        return _filtered(e, n, pos, i, j, t)
    out = [np.stack(_sids(e, i, j), 1) for i, j in list_pairs(e, label, t)]
    return _unique(np.concatenate(out)) if out else np.zeros((0, 2), U64)


def list_pairs(e: np.ndarray, label: np.ndarray, t: Threshold) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of entries of a list with different labels that the filters allow, in portions."""
    if not len(e):
        return
    new = np.concatenate([[True], e["gram"][1:] != e["gram"][:-1]])
    lists, begin = np.cumsum(new) - 1, np.flatnonzero(new)
    n, pos = e["n"].astype(np.int64), e["pos"].astype(np.int64)
    # Blocks of equal size within a list; a set meets the blocks of its own size and of larger ones.
    head = new | np.concatenate([[True], n[1:] != n[:-1]])
    block = np.cumsum(head) - 1
    first = np.flatnonzero(head)
    size = n[first]
    last_of_list = np.concatenate([block[begin[1:]] - 1, [len(first) - 1]])[lists]
    # The largest size within reach, found by bisection on (list, size).
    wide = int(n.max()) + 2
    reach = np.minimum(n * t.den // t.num, wide - 1)
    stop = np.searchsorted(lists[first] * wide + size, lists * wide + reach, "right") - 1
    stop = np.minimum(stop, last_of_list)
    key = block * (int(pos.max()) + 2) + pos
    step = AT_ONCE
    index_ok = np.flatnonzero(pos < t.index_prefix(n))
    work = np.cumsum(stop[index_ok] - block[index_ok] + 1)
    cuts = np.searchsorted(work, np.arange(0, work[-1] + step, step)) if len(work) else []
    for a, b in zip(cuts[:-1], [*cuts[1:-1], len(index_ok)]):
        i = index_ok[a:b]
        m = stop[i] - block[i] + 1
        bl = ragged(block[i], m)
        i = np.repeat(i, m)
        need = t.overlap(n[i], size[bl])
        low = np.maximum(pos[i] - (n[i] - need), 0)
        high = np.minimum(pos[i] + (size[bl] - need), int(pos.max()))
        base = bl * (int(pos.max()) + 2)
        lo = np.searchsorted(key, base + low)
        hi = np.searchsorted(key, base + high, "right")
        lo = np.where(bl == block[i], np.maximum(lo, i + 1), lo)
        m = np.maximum(hi - lo, 0)
        done = np.concatenate([[0], np.cumsum(m)])
        at = 0
        while at < len(m):
            to = max(at + 1, int(np.searchsorted(done, done[at] + AT_ONCE, "right")) - 1)
            x, y = np.repeat(i[at:to], m[at:to]), ragged(lo[at:to], m[at:to])
            differ = label[x] != label[y]
            yield _allowed(e, n, pos, x[differ], y[differ], t)
            at = to


def _allowed(e, n, pos, i, j, t: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that sizes, index prefix and positions allow."""
    i, j = np.where(n[i] <= n[j], i, j), np.where(n[i] <= n[j], j, i)
    need = t.overlap(n[i], n[j])
    same = n[i] == n[j]
    inside = (pos[i] < t.index_prefix(n[i])) | same & (pos[j] < t.index_prefix(n[j]))
    most = np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j])
    ok = inside & (n[i] * t.den >= t.num * n[j]) & (most >= need) & (e["sid"][i] != e["sid"][j])
    return i[ok], j[ok]


def _sids(e, i, j) -> tuple[np.ndarray, np.ndarray]:
    a, b = e["sid"][i], e["sid"][j]
    return np.minimum(a, b), np.maximum(a, b)


def _filtered(e, n, pos, i, j, t: Threshold) -> np.ndarray:
    return _unique(np.stack(_sids(e, *_allowed(e, n, pos, i, j, t)), 1))


def _unique(p: np.ndarray) -> np.ndarray:
    if len(p) < 2:
        return p
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    return p[np.concatenate([[True], (p[1:] != p[:-1]).any(1)])]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


class NearJoin:
    """The steps of the join over stored rows (rid, doc_id, text)."""

    def __init__(self, docs: DataFrame, k: int, t: Threshold):
        self.spark, self.k, self.t = docs.sparkSession, k, t
        self.partitions = parts(docs)
        plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                            F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("th"))
        self.rows = stored(plain.withColumn("rid", F.monotonically_increasing_id()), "docs")
        both = stored(self.rows.mapInArrow(self._describe(), "rid long, doc_id long, th long, n long, sid long, piece int, counts binary"), "sets")
        self.scratch = [self.rows, both]
        self.sets = both.where("counts IS NULL").drop("piece", "counts")
        self.steer = self._table(both.where("counts IS NOT NULL").select("piece", "counts"))

    def _describe(self):
        k = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(SLOTS, np.int64)
            names = ["rid", "doc_id", "th", "n", "sid", "piece", "counts"]
            for b in slices(batches):
                values, at = gram_sets(words(b.column("text"), SPACED, lower=True), k)
                counts += np.bincount(slot(values), minlength=SLOTS)
                none = pa.nulls(b.num_rows, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    b.column("rid"), b.column("doc_id"), b.column("th"), pa.array(np.diff(at)), signed(signature(values, at)), none, pa.nulls(b.num_rows, pa.binary())], names)
            if counts.any():
                blobs = [zlib.compress(c.astype("<u4").tobytes(), 1) for c in np.split(counts, PIECES)]
                none = pa.nulls(PIECES, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array(range(PIECES), pa.int32()),
                                                  pa.array(blobs, pa.binary())], names)

        return run

    def _table(self, rows: DataFrame) -> list[tuple[int, bytes, bytes]]:
        """Levels and splits from the sum of all tasks' tables, made by the tasks that hold the sums.

        ``PIECES`` rows come to the driver, packed: 12 MB at most and far less where most slots are ordinary.
        """

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for p, c in zip(b.column("piece").to_pylist(), b.column("counts")):
                    x = np.frombuffer(zlib.decompress(c.as_py()), "<u4").astype(np.int64)
                    total[p] = total[p] + x if p in total else x
            for p, x in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([int(x.sum())], pa.int64()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())],
                                                 ["piece", "n", "counts"])

        sums = stored(rows.repartition(PIECES, "piece").mapInArrow(add, "piece int, n long, counts binary"), "sums")
        self.scratch.append(sums)
        mean = (sums.agg(F.sum("n")).first()[0] or 0) / SLOTS

        def steer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for p, c in zip(b.column("piece").to_pylist(), b.column("counts")):
                    x = np.frombuffer(zlib.decompress(c.as_py()), np.int64)
                    packed = (zlib.compress(y.tobytes()) for y in (levels(x, mean), np.minimum(x // SHARE + 1, 65_535).astype("<u2")))
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([y], pa.binary()) for y in packed)], ["piece", "level", "split"])

        return [(r.piece, bytes(r.level), bytes(r.split)) for r in sums.mapInArrow(steer, "piece int, level binary, split binary").collect()]

    def _lists(self) -> DataFrame:
        """Step one: (gram, sid, n, pos) of lists with several sets, and first candidates (gram null)."""
        steer = self.spark.sparkContext.broadcast(self.steer)
        k, t, share = self.k, self.t, self.partitions

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (level, split_of), names = unpacked(steer.value), ["part", "entries", "sid", "n", "marks"]
            for b in slices(batches):
                values, at = gram_sets(words(b.column("text"), SPACED, lower=True), k)
                sid, n = signature(values, at), np.diff(at)
                _, one = np.unique(sid, return_index=True)  # copies within the slice count once
                one = one[n[one] > 0]
                keys = order_keys(values, level)
                take = t.prefix(n[one])
                e = np.empty(int(take.sum()), ENTRY)
                src = np.empty(len(e), np.int64)
                done = 0
                for d, m in zip(one.tolist(), take.tolist()):
                    own = keys[at[d]:at[d + 1]]
                    o = np.argpartition(own, m - 1)[:m] if m < len(own) else np.arange(len(own))
                    src[done:done + m] = at[d] + o[np.argsort(own[o])]
                    done += m
                e["gram"] = keys[src]
                marks, ends = (mix(e["gram"]) >> U64(48)).astype("<u2"), np.concatenate([[0], np.cumsum(take)])
                yield pa.RecordBatch.from_arrays([
                    pa.array((sid[one] % U64(share)).astype(np.int32)), pa.nulls(len(one), pa.binary()), signed(sid[one]), pa.array(n[one]),
                    pa.array([marks[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:])], pa.binary())], names)
                e["sid"], e["n"] = np.repeat(sid[one], take), np.repeat(n[one], take)
                e["pos"] = ragged(np.zeros(len(one), np.int64), take)
                # The counts of a hot gram say over how many tasks its list is spread.
                split = split_of[slot(values[src])].astype(U64)
                e["pos"][split > 1] |= SHARED
                part = mix(e["gram"] + U64(7) * (e["sid"] % split)) % U64(share)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(share + 1, dtype=U64))
                e = e[order]
                some = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([e[cuts[p]:cuts[p + 1]].tobytes() for p in some], pa.binary()),
                                                  pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.binary())], names)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, blobs = ["gram", "sid", "n", "pos", "a", "b", "marks"], []
            for b in batches:
                blobs += [x.as_py() for x in b.column("entries") if x.is_valid]
                b = b.filter(b.column("marks").is_valid())
                none = pa.nulls(b.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([none, b.column("sid"), b.column("n"), none, none, none, b.column("marks")], names)
            e = np.frombuffer(b"".join(blobs), ENTRY)
            del blobs
            order = np.argsort(e["gram"])
            g = e["gram"][order]
            twice = np.zeros(len(g) + 1, bool)
            twice[1:-1] = g[1:] == g[:-1]
            e = e[order[twice[1:] | twice[:-1] | (e["pos"][order] >= SHARED)]]
            e["pos"] &= ~SHARED
            e = e[np.lexsort((e["pos"], e["sid"], e["n"], e["gram"]))]
            if len(e):
                e = e[np.concatenate([[True], (e["gram"][1:] != e["gram"][:-1]) | (e["sid"][1:] != e["sid"][:-1])])]
                e = e[np.lexsort((e["pos"], e["n"], e["gram"]))]
            p = pairs_of(e, None, t, False)
            for at in range(0, len(e), 100_000):
                x = e[at:at + 100_000]
                none = pa.nulls(len(x), pa.int64())
                yield pa.RecordBatch.from_arrays([signed(x["gram"]), signed(x["sid"]), pa.array(x["n"].astype(np.int64)), pa.array(x["pos"].astype(np.int64)), none, none, pa.nulls(len(x), pa.binary())], names)
            none = pa.nulls(len(p), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, signed(p[:, 0]), signed(p[:, 1]), pa.nulls(len(p), pa.binary())], names)

        blobs = self.rows.select("text").mapInArrow(emit, "part int, entries binary, sid long, n long, marks binary")
        return stored(blobs.repartition(self.partitions, "part").mapInArrow(merge, "gram long, sid long, n long, pos long, a long, b long, marks binary"), "lists")

    def _likely(self, pairs: DataFrame, marks: DataFrame) -> DataFrame:
        """The pairs that share enough of their first grams, by their marks."""
        t = self.t
        x = marks.select(F.col("sid").alias("a"), F.col("n").alias("nx"), F.col("marks").alias("x"))
        y = marks.select(F.col("sid").alias("b"), F.col("n").alias("ny"), F.col("marks").alias("y"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                need = t.shared(b.column("nx").to_numpy(), b.column("ny").to_numpy())
                keep = np.zeros(b.num_rows, bool)
                for i, (x, y) in enumerate(zip(b.column("x"), b.column("y"))):
                    x, y = np.sort(np.frombuffer(x.as_buffer(), "<u2")), np.sort(np.frombuffer(y.as_buffer(), "<u2"))
                    keep[i] = (np.searchsorted(y, x, "right") > np.searchsorted(y, x)).sum() >= need[i]
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep))

        met = pairs.distinct().hint("merge").join(x, "a").hint("merge").join(y, "b").select("a", "b", "nx", "ny", "x", "y")
        self.scratch.append(out := stored(met.mapInArrow(run, "a long, b long"), "pairs"))
        return out

    def _needed(self, rids: DataFrame) -> np.ndarray:
        """The bit table of row ids: ``PIECES`` rows come to the driver, 2 MB in all."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for p, at in zip(b.column("piece").to_pylist(), b.column("at").to_pylist()):
                    total.setdefault(p, np.zeros(BITS // PIECES, bool))[at] = True
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.packbits(x).tobytes() for x in total.values()], pa.binary())], ["piece", "bits"])

        spot = F.pmod(F.xxhash64("rid"), F.lit(BITS)).cast("int")
        spots = rids.select((spot % PIECES).alias("piece"), F.floor(spot / PIECES).cast("int").alias("at")).distinct()
        out = np.zeros((PIECES, BITS // PIECES // 8), np.uint8)
        for r in spots.repartition(PIECES, "piece").mapInArrow(add, "piece int, bits binary").collect():
            out[r.piece] = np.frombuffer(bytes(r.bits), np.uint8)
        return out.ravel()

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """The (stored, likely) pairs that link, compared on their full sets."""
        k, t = self.k, self.t
        nodes = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
        first = stored(self.sets.select("sid", "rid").hint("merge").join(nodes, "sid").groupBy("sid").agg(F.min("rid").alias("rid")), "nodes")
        self.scratch.append(first)
        needed = self.spark.sparkContext.broadcast(self._needed(first))

        def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = b.column("at").to_numpy()
                at = at % PIECES * (BITS // PIECES) + at // PIECES  # piece by piece
                bits = needed.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
                for x in slices([b.filter(pa.array(bits.astype(bool)))]):
                    values, ends = gram_sets(words(x.column("text"), SPACED, lower=True), k)
                    data = [values[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:])]
                    yield pa.RecordBatch.from_arrays([x.column("rid"), pa.array(data, pa.binary())], ["rid", "grams"])

        texts = self.rows.select("rid", "text", F.pmod(F.xxhash64("rid"), F.lit(BITS)).cast("int").alias("at"))
        full = stored(texts.mapInArrow(grams, "rid long, grams binary").hint("merge").join(first, "rid").select("sid", "grams"), "grams")
        self.scratch.append(full)

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.zeros(b.num_rows, bool)
                for i, (x, y) in enumerate(zip(b.column("x"), b.column("y"))):
                    x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                    m = np.sort(np.concatenate([x, y]), kind="stable")
                    both = int((m[1:] == m[:-1]).sum())
                    keep[i] = t.links(both, len(m) - both)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep))

        met = (pairs.hint("merge").join(full.select(F.col("sid").alias("a"), F.col("grams").alias("x")), "a")
               .hint("merge").join(full.select(F.col("sid").alias("b"), F.col("grams").alias("y")), "b"))
        return stored(met.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "links")

    def _rest(self, lists: DataFrame, labels: DataFrame, every: bool, marks: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Likely pairs of long lists whose sets are in different groups so far, a forest of them or all.

        With ``every`` also the pairs of short and of very long lists, which are not compared on marks yet; and a
        pair leaves only the list of its first common gram. Sets that link pass all filters there, and sets of
        different groups have every common gram of theirs in a mixed list.
        """
        t = self.t
        e = (lists.where("gram IS NOT NULL").select("gram", "sid", "n", "pos").hint("merge")
             .join(labels.select(F.col("node").alias("sid"), "label"), "sid", "left")
             .withColumn("label", F.coalesce("label", "sid")))
        self.scratch.append(e := stored(e, "labelled"))
        mixed = e.groupBy("gram").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
        self.scratch.append(e := stored(e.hint("merge").join(mixed.select("gram", "m"), "gram"), "mixed"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            if not held:
                return
            got = pa.Table.from_batches(held)
            of_set = got["marks"].is_valid()
            sets, got = got.filter(of_set), got.filter(pc.invert(of_set))
            own = Marks(sets["sid"].to_numpy().view(U64), sets["marks"])
            if every:
                grams = sets["grams"].combine_chunks()
                ends, flat = grams.offsets.to_numpy(), grams.values.to_numpy().view(U64)
                met = [np.sort(flat[ends[o]:ends[o + 1]]) for o in np.argsort(sets["sid"].to_numpy().view(U64)).tolist()]
            held = sets = None
            x = np.empty(got.num_rows, ENTRY)
            x["gram"], x["sid"] = got["gram"].to_numpy().view(U64), got["sid"].to_numpy().view(U64)
            x["n"], x["pos"] = got["n"].to_numpy(), got["pos"].to_numpy()
            order = np.lexsort((x["pos"], x["n"], x["gram"]))
            x, label = x[order], got["label"].to_numpy()[order]
            got = None
            number, n = np.searchsorted(own.sids, x["sid"]), x["n"].astype(np.int64)
            best = np.zeros((0, 5), np.int64)
            for i, j in list_pairs(x, label, t):
                # A pair that meets in several lists is looked at once.
                _, one = np.unique(number[i] * len(own.sids) + number[j], return_index=True)
                i, j = i[one], j[one]
                need = t.shared(n[i], n[j])
                more = own.shared(number[i], number[j], need) - need
                i, j, more = i[more >= 0], j[more >= 0], more[more >= 0]
                a, b = (s.view(np.int64) for s in _sids(x, i, j))
                if every:
                    one = first_met(x["gram"][i], number[i], number[j], met)
                    a, b = a[one], b[one]
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    continue
                best = np.concatenate([best, np.stack([label[i], label[j], more * 1000 // np.maximum(n[i], 1), a, b], 1)])
                best = best[forest(*best.T[:3])]
            yield pa.RecordBatch.from_arrays([pa.array(best[:, 3]), pa.array(best[:, 4])], ["a", "b"])

        part = F.pmod(F.xxhash64("gram"), F.lit(self.partitions)).cast("int").alias("part")
        usual = e.where((F.col("m") > SHORT) & ((F.col("m") <= LONG) | F.lit(not every))).select(part, "gram", "sid", "n", "pos", "label")
        of_sets = usual.select("part", "sid").distinct().hint("merge").join(marks.select("sid", "marks"), "sid")
        no_grams = F.lit(None).cast("array<long>").alias("grams")
        if every:
            of_sets = of_sets.hint("merge").join(e.groupBy("sid").agg(F.collect_list("gram").alias("grams")), "sid")
        else:
            of_sets = of_sets.withColumn("grams", no_grams)
        none = [F.lit(None).cast("long").alias(c) for c in ("n", "pos", "label")]
        both = usual.withColumn("marks", F.lit(None).cast("binary")).withColumn("grams", no_grams).unionByName(
            of_sets.select("part", F.lit(None).cast("long").alias("gram"), "sid", *none, "marks", "grams"))
        usual = both.repartition(self.partitions, "part").select("gram", "sid", "n", "pos", "label", "marks", "grams").mapInArrow(run, "a long, b long").distinct()
        self.scratch.append(usual := stored(usual, "likely"))
        if not every:
            return usual, None

        def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [(b["gram"].to_numpy(), b["sid"].to_numpy(), b["n"].to_numpy(), b["pos"].to_numpy(), b["label"].to_numpy()) for b in batches]
            if not held:
                return
            gram, sid, n, pos, label = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((pos, n, gram))
            x = np.empty(len(order), ENTRY)
            x["gram"], x["sid"], x["n"], x["pos"] = gram.view(U64)[order], sid.view(U64)[order], n[order], pos[order]
            p = pairs_of(x, label[order], t, True)
            yield pa.RecordBatch.from_arrays([signed(p[:, 0]), signed(p[:, 1])], ["a", "b"])

        # Short lists have few pairs for each set: these meet the marks once, instead of the marks every list.
        short = e.where(F.col("m") <= SHORT).select("gram", "sid", "n", "pos", "label").repartition(self.partitions, "gram").mapInArrow(few, "a long, b long")
        x, y = (e.where(F.col("m") > LONG).select("gram", *(F.col(c).alias(c + s) for c in ("sid", "n", "pos", "label"))) for s in "xy")
        need = F.ceil(F.lit(t.num) * (F.col("nx") + F.col("ny")) / F.lit(t.num + t.den))
        most = F.least("posx", "posy") + F.least(F.col("nx") - F.col("posx"), F.col("ny") - F.col("posy"))
        far = (x.join(y, "gram").where((F.col("labelx") != F.col("labely")) & ((F.col("nx") < F.col("ny")) | (F.col("nx") == F.col("ny")) & (F.col("sidx") < F.col("sidy")))
                                      & (F.col("nx") * t.den >= F.col("ny") * t.num) & (most >= need))
               .select(F.least("sidx", "sidy").alias("a"), F.greatest("sidx", "sidy").alias("b")))
        return usual, short.union(far)

    def groups(self) -> DataFrame:
        """(rid, doc_id, th, n_shingles, component_id, component_rid)."""
        lists = self._lists()
        self.scratch.append(lists)
        marks = stored(lists.where("marks IS NOT NULL").select("sid", "n", "marks").dropDuplicates(["sid"]), "marks")
        self.scratch.append(marks)
        links = self._verify(self._likely(lists.where("a IS NOT NULL").select("a", "b"), marks))
        self.scratch.append(links)
        entries = lists.where("gram IS NOT NULL").select("gram", "sid", "n", "pos")
        long = entries.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > SHORT).select("gram")
        self.scratch.append(long := stored(entries.hint("merge").join(long, "gram"), "long"))
        labels, every = components(links), long.isEmpty()
        while True:
            likely, far = self._rest(lists if every else long, labels, every, marks)
            more = self._verify(likely if far is None else likely.union(self._likely(far, marks)).distinct())
            self.scratch.append(more)
            found, known = more.count(), links.count()
            if found:
                links = links.union(more)
                labels = components(links)
            if every:
                break
            # Once fewer groups are joined this way, all likely pairs that are left are compared.
            every = 2 * found <= known
        own = (self.sets.hint("merge").join(labels.select(F.col("node").alias("sid"), "label"), "sid", "left")
               .withColumn("label", F.coalesce("label", "sid")))
        own = stored(own.select("rid", "doc_id", "th", "n", "label"), "own")
        forget(*self.scratch)
        least = own.where("n > 0").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("q"), F.col("doc_id").alias("d"), F.col("rid").alias("r"))).alias("k"))
        return own.hint("merge").join(least, "label", "left").select(
            "rid", "doc_id", "th", F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("k.d")).otherwise(F.col("doc_id")).alias("component_id"),
            F.when(F.col("n") > 0, F.col("k.r")).otherwise(F.col("rid")).alias("component_rid"))


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    return NearJoin(docs, k, Threshold(percent)).groups().select("doc_id", "n_shingles", "component_id")


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with its own columns, the row with the smallest doc_id of every group."""
    return only(docs, NearJoin(docs, k, Threshold(percent)).groups().where("rid = component_rid"))
