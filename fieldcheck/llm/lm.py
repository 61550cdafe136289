"""Language-model scores from a hierarchical Pitman-Yor model with Chinese-restaurant seating.

Every word of the training texts is a context with a restaurant of its own, whose customers are the words that
follow it; the end of a text is a word too, and as a context it stands before the first word. All context restaurants
share one parent restaurant over the words, whose own parent is uniform over the words and one unknown word. Pairs
(context, word) are counted over all batches; nothing of the model is of fixed size or ever in one place.

Seating: both discounts are 1/2, where the number of ways to seat c customers of a dish at k tables is known in closed
form. A sweep draws from exact conditionals, none of which waits for another pair or word:

* a context's scale x from Gamma(strength / discount + its tables), which frees its dishes of one another;
* the tables of a pair, k with weight S(c, k) * (discount * x * P_parent(word)) ** k (``tables``). All c customers of the dish
  are seated anew at once; a pair that occurs once has one table. So a context may be split by dish among tasks;
* the parent's tables in the same way, and from them its word probabilities: at discount 1/2 the parent is a normalised
  inverse Gaussian process of random time ``zeta``, so a word's mass is Gamma(customers - tables / 2) plus inverse Gaussian
  (``masses``). ``zeta`` and one rate ``u`` are drawn by the driver from sums.

The predictive probability (customers - d * tables + (strength + d * all tables) * P_parent) / (strength + all customers) is
averaged over the sweeps after the first ones.

Moves: batches of documents send their distinct words to the owner of the hash range, and their distinct pairs to the
owner of the context (a frequent context is split by word). Owners of pairs and of words exchange sums and masses in
each sweep, by position in lists agreed once; in the end all replies come back to the batches. Both large moves, of the
pairs and of the replies, go in ``TURNS`` over shares of the pieces and of the batches, so the disk holds one share of them.

Defined results: a null text is empty and has the end token alone; without any training document all
words are unknown; rows are independent, repeated rows count repeatedly. Extra columns are ignored. Words are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcheck.llm.common import SPACED, U64, chain, crc32_mod, distinct, forget, input_mb, mix, slices, stored, stored_together, words

#: A context is split by word if it has more than ``HOT`` training tokens and more than one ``CLASSES``-th of them all
#: (in large inputs, a quarter of a task's share).
CLASSES, HOT = 1024, 1 << 14
#: MB of input whose words and pairs one task owns.
PART_MB = 8.0
#: Pairs are counted, and batches scored, in so many turns; only what one turn moves is on disk at a time.
TURNS = 4
#: Every step is stored, so nothing reads the shuffle files of the steps before; this setting deletes them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The end of a text as a word of its own, and as the context of the first word.
END = U64(0xFFFFFFFFFFFFFFFF)
BURN_IN, SAMPLES = 2, 3
#: Up to this many customers the whole law of their tables is written out, beyond them 12 deviations about its mode.
ONE_BY_ONE = 64
DISCOUNT = 0.5
STRENGTH = (20.0, 5.0)  # of the parent and of the contexts


def _log_ways(most: int, d: float) -> np.ndarray:
    """log S(c, k), the weights of c customers at k tables, by S(c + 1, k) = S(c, k - 1) + (c - d k) S(c, k)."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0
    k = np.arange(1, most + 1)
    for c in range(1, most):
        with np.errstate(divide="ignore"):
            stay = np.log(np.maximum(c - d * k, 0)) + out[c, 1:]
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], np.where(k <= c, stay, -np.inf))
    return out


def _pick(logs: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One column of every row, drawn by its weights."""
    p = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), 1)
    return np.minimum((p < rng.random(len(p))[:, None] * p[:, -1:]).sum(1), logs.shape[1] - 1)


def tables(c: np.ndarray, y: np.ndarray, rng: np.random.Generator, d: float = DISCOUNT) -> np.ndarray:
    """Numbers of tables k of ``c`` customers each, drawn with weights S(c, k) y ** k.

    The law is that of a sum of independent trials, so its deviation is at most the root of its mean, and what lies
    beyond the window of large counts has no weight in double precision.
    """
    out = np.minimum(c, 1).astype(np.int64)
    whole = ONE_BY_ONE if d == DISCOUNT else int(c.max(initial=1))
    order = np.argsort(c, kind="stable")
    sizes, first = np.unique(c[order], return_index=True)
    small = int(sizes[(sizes <= whole)].max(initial=1))
    ways = _log_ways(small, d)
    last = np.append(first[1:], len(c))
    logy = np.log(np.maximum(y, 1e-300))
    for n, a, b in zip(sizes.tolist(), first.tolist(), last.tolist()):
        if 1 < n <= whole:
            step = max(1, (1 << 20) // n)
            for at in range(a, b, step):
                i = order[at:min(at + step, b)]
                out[i] = 1 + _pick(ways[n, 1:n + 1] + logy[i, None] * np.arange(1, n + 1), rng)
    big = np.flatnonzero(c > max(whole, 1))
    if len(big):
        n, v = c[big].astype(float), y[big]
        # S(c, k + 1) / S(c, k) = 4 (c - k) / (k (2 c - k - 1)) at d = 1/2: the mode is where y times this passes 1.
        full = 2 * n - 1 + 4 * v
        mode = np.clip(8 * v * n / (full + np.sqrt(np.maximum(full * full - 16 * v * n, 0))), 1, n)
        wide = 12 * np.sqrt(mode) + 40
        low, high = np.maximum(np.floor(mode - wide), 1), np.minimum(np.ceil(mode + wide), n)
        by = np.argsort(high - low)
        at = 0
        while at < len(by):
            to = at + 1
            while to < len(by) and (to + 1 - at) * (high - low)[by[to]] < 1 << 20:
                to += 1
            i = by[at:to]
            k = low[i, None] + np.arange(int((high - low)[i].max()) + 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.log(4 * (n[i, None] - k)) - np.log(k * (2 * n[i, None] - k - 1)) + logy[big[i], None]
            logs = np.zeros(k.shape)
            logs[:, 1:] = np.cumsum(np.where(k < high[i, None], ratio, 0), 1)[:, :-1]
            out[big[i]] = low[i].astype(np.int64) + _pick(np.where(k <= high[i, None], logs, -np.inf), rng)
            at = to
    return out


def seat(c: np.ndarray, parent: np.ndarray, t: np.ndarray, d: float, theta: float,
         rng: np.random.Generator) -> np.ndarray:
    """New table counts of every dish (columns) of every restaurant (rows) with ``c`` customers, ``t`` tables so far."""
    x = rng.gamma(theta / d + t.sum(1))
    row, col = np.nonzero(c)
    out = np.zeros(c.shape)
    out[row, col] = tables(c[row, col], d * x[row] * parent[col], rng, d)
    return out


def predictive(c: np.ndarray, t: np.ndarray, parent: np.ndarray, d: float, theta: float) -> np.ndarray:
    total, all_tables = c.sum(1, keepdims=True), t.sum(1, keepdims=True)
    return (np.maximum(c - d * t, 0) + (theta + d * all_tables) * parent) / (theta + total)


def masses(c: np.ndarray, s: float, u: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Tables and unnormalised masses of the parent's words with ``c`` customers, given its time a word ``s`` and rate ``u``."""
    t = tables(c, np.full(len(c), s * np.sqrt(1 + u) / 2), rng)
    rest = np.maximum(rng.wald(s / (2 * np.sqrt(1 + u)), s * s / 2, len(c)), s * s / 400)
    return t, rest + np.where(c > 0, rng.gamma(np.maximum(c - DISCOUNT * t, 0.5)), 0) / (1 + u)


def process_time(v: int, inverse: float, rng: np.random.Generator) -> float:
    """``zeta`` given the sum of 1 / mass over ``v`` words and the unknown one."""
    return float(np.sqrt(rng.gamma((v + 1) / 2 + STRENGTH[0]) / (inverse / (4 * (v + 1) ** 2))))


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def _open(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind)


def _pack_sorted(h: np.ndarray) -> bytes:
    """Ascending hashes as their differences, byte by byte: the upper bytes are mostly zero."""
    return _pack(np.diff(h, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T)


def _open_sorted(x: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(_open(x, "u1").reshape(8, -1).T).view(U64).ravel(), dtype=U64)


def _by_count(counts: np.ndarray) -> np.ndarray:
    return np.argsort(-counts.astype(np.int64), kind="stable")


def _pack_codes(code: np.ndarray, counts: np.ndarray) -> bytes:
    """Codes as ranks by falling ``counts``, lower and upper halves apart: what is frequent is small, upper halves are mostly zero."""
    rank = np.empty(len(counts), "<u4")
    rank[_by_count(counts)] = np.arange(len(counts))
    return pa.compress(np.ascontiguousarray(rank[code].view("<u2").reshape(-1, 2).T).tobytes(), "zstd", asbytes=True)


def _open_codes(x: bytes, n: int, counts: np.ndarray) -> np.ndarray:
    """The ``n`` codes again."""
    halves = np.frombuffer(pa.decompress(x, 4 * n, "zstd", asbytes=True), "<u2").reshape(2, -1)
    return _by_count(counts)[np.ascontiguousarray(halves.T).view("<u4").ravel()]


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}


def _map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], names: dict[str, str]) -> DataFrame:
    """``run`` over the batches of every task; its rows are sent on together, absent columns are null."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for r in run(batches):
            rows.append(r)
            size += 64 + sum(len(x) for x in r.values() if isinstance(x, bytes))
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array([x.get(c) for x in rows], _ARROW[k]) for c, k in names.items()], list(names))
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([x.get(c) for x in rows], _ARROW[k]) for c, k in names.items()], list(names))

    return df.mapInArrow(packed, ", ".join(f"{x} {k}" for x, k in names.items()))


def _kind(n: int) -> str:
    """The type of places in a list of ``n``."""
    return "<u2" if n <= 1 << 16 else "<u4"


def _small(x: np.ndarray, n: int) -> np.ndarray:
    return x.astype(_kind(n))


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(x).to_pylist() for x in names))


def _fill(df: DataFrame, names: dict[str, str], *own: str) -> DataFrame:
    """The columns ``own`` of ``df``, the others of ``names`` null."""
    return df.selectExpr(*(x if x in own else f"CAST(NULL AS {k}) AS {x}" for x, k in names.items()))


def _share(h: np.ndarray, n: int) -> np.ndarray:
    """The owner, of ``n``, of every hash."""
    return ((h >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def _cuts(h: np.ndarray, n: int) -> np.ndarray:
    """Where each owner's part of sorted hashes begins, and the end."""
    return np.searchsorted(_share(h, n), np.arange(n + 1))


def _runs(x: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin, and the end."""
    return np.append(np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])), len(x)) if len(x) else np.zeros(1, np.int64)


_BATCH = {"batch": "long", "docs": "binary", "held": "binary", "sizes": "binary", "codes": "binary", "hashes": "binary", "counts": "binary"}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Batches as numbers: tokens by code, the hashes of the codes in order, their training counts."""
    number = TaskContext.get().partitionId() << 32
    for b in slices(batches):
        w = words(b.column("text"), SPACED, lower=True)
        n = w.counts
        held = b.column("held").to_numpy(zero_copy_only=False)
        # An end token after the words of every document.
        h = np.full(len(w) + len(n), END, U64)
        place = np.ones(len(h), bool)
        place[w.first[1:] + np.arange(len(n))] = False
        h[place] = w.hashes()
        order = np.argsort(h)
        new = np.ones(len(h), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        code = np.empty(len(h), np.uint32)
        code[order] = np.cumsum(new) - 1
        hashes = h[order][new]
        counts = np.bincount(code[np.repeat(~held, n + 1)], minlength=len(hashes)).astype("<u4")
        valid = b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        ids = b.column("doc_id").fill_null(0).to_numpy()
        yield dict(batch=number, docs=valid.tobytes() + ids.astype("<i8").tobytes(), held=held.tobytes(), sizes=(n + 1).astype("<i8").tobytes(),
                   codes=_pack_codes(code, counts), hashes=_pack_sorted(hashes), counts=_pack(counts))
        number += 1


def _contexts(code: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The code before every token."""
    before = np.empty(len(code), np.int64)
    before[1:] = code[:-1]
    before[np.cumsum(size) - size] = len(hashes) - 1  # the end token has the highest hash
    return before


def _owner(u: np.ndarray, w: np.ndarray, hashes: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    """The piece, of ``n``, of every pair of codes."""
    owner = _share(mix(hashes), n)[u]
    split = np.isin(hashes, hot)[u]
    owner[split] = _share(chain([hashes[u[split]], hashes[w[split]]]), n)
    return owner


def _pairs(before: np.ndarray, code: np.ndarray, hashes: np.ndarray, hot: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Distinct (context, word) codes of a batch by owner, where each owner's begin, and the pair of every token."""
    key = before * len(hashes) + code
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    u, w = np.divmod(key[order][new], len(hashes))
    owner = _owner(u, w, hashes, hot, n)
    by = np.argsort(owner, kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    of = np.empty(len(key), np.int64)
    of[order] = place[np.cumsum(new) - 1]
    return u[by], w[by], np.searchsorted(owner[by], np.arange(n + 1)), of


_WORDS = {"batch": "long", "part": "int", "places": "binary", "words": "binary", "counts": "binary", "n": "long", "v": "long"}


def _lexicon(rows: DataFrame, n_parts: int) -> DataFrame:
    """For every batch and part where its words stand among the part's training words; with batch null, those words and counts."""
    kinds = {"batch": "long", "part": "int", "hashes": "binary", "counts": "binary"}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for number, h, c in _rows(batches, "batch", "hashes", "counts"):
            h, c = _open_sorted(h), _open(c, "<u4")
            cut = np.searchsorted(_share(h, n_parts), np.arange(n_parts + 1))
            for p in np.flatnonzero(np.diff(cut)).tolist():
                yield dict(batch=number, part=p, hashes=h[cut[p]:cut[p + 1]].tobytes(), counts=_pack(c[cut[p]:cut[p + 1]]))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        asked: dict[int, list] = {}
        for number, part, h, c in _rows(batches, *kinds):
            asked.setdefault(part, []).append((number, np.frombuffer(h, U64), _open(c, "<u4")))
        for part, got in asked.items():
            h, c = np.concatenate([x[1] for x in got]), np.concatenate([x[2] for x in got]).astype(np.int64)
            order = np.argsort(h)
            at = _runs(h[order])[:-1]
            total, h = np.add.reduceat(c[order], at), h[order][at]
            known, total = h[total > 0], total[total > 0]
            for number, x, _ in got:
                i = np.searchsorted(known, x)
                seen = np.append(known, END)[i] == x
                seen &= i < len(known)
                yield dict(batch=number, part=part, places=_pack(np.where(seen, i + 1, 0).astype("<u4")))
            yield dict(part=part, words=known.tobytes(), counts=total.tobytes(), n=int(total.sum()), v=len(known))

    return stored(_map(_map(rows, ask, kinds).repartition(n_parts, "part"), answer, _WORDS), "lexicon")


#: kind 0: what a batch asked of a piece; 1: the pairs of a piece that occur repeatedly; 2: a piece's words at a part.
_PIECE = {"kind": "int", "batch": "long", "piece": "int", "part": "int", "a": "binary", "b": "binary", "c": "binary", "d": "binary", "e": "binary",
          "singles": "long", "repeated": "long"}


def _pieces(rows: DataFrame, hot: np.ndarray, n_parts: int) -> DataFrame:
    """Pairs counted over all batches by their owners, the pieces, every ``TURNS``-th of them at a time."""
    kinds = {"batch": "long", "piece": "int", "contexts": "binary", "runs": "binary", "words": "binary", "places": "binary", "counts": "binary"}

    def ask(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[dict]:
        for number, held, size, code, h, c in _rows(batches, "batch", "held", "sizes", "codes", "hashes", "counts"):
            size, h = np.frombuffer(size, "<i8"), _open_sorted(h)
            code = _open_codes(code, int(size.sum()), _open(c, "<u4"))
            before = _contexts(code, size, h)
            now = np.flatnonzero(_owner(before, code, h, hot, n_parts) % TURNS == turn)
            u, w, cut, of = _pairs(before[now], code[now], h, hot, n_parts)
            c = np.bincount(of[np.repeat(~np.frombuffer(held, bool), size)[now]], minlength=len(u)).astype("<u4")
            for p in np.flatnonzero(np.diff(cut)).tolist():
                i = slice(cut[p], cut[p + 1])
                at, some = _runs(u[i]), distinct(w[i])
                yield dict(batch=number, piece=p, contexts=h[u[i][at[:-1]]].tobytes(), runs=_pack(np.diff(at).astype("<u4")),
                           words=h[some].tobytes(), places=_pack(_small(np.searchsorted(some, w[i]), len(some))), counts=_pack(c[i]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        asked: dict[int, list] = {}
        for number, piece, *x in _rows(batches, *kinds):
            asked.setdefault(piece, []).append((number, *x))
        for piece in list(asked):
            got = asked.pop(piece)
            lengths = [(x[0], int(_open(x[2], "<u4").sum())) for x in got]
            u = np.concatenate([np.repeat(np.frombuffer(x[1], U64), _open(x[2], "<u4")) for x in got])
            w = np.concatenate([np.frombuffer(x[3], U64)[_open(x[4], _kind(len(x[3]) // 8))] for x in got])
            c = np.concatenate([_open(x[5], "<u4") for x in got])
            del got
            key = chain([u, w])
            order = np.argsort(key)
            at = _runs(key[order])
            total = np.add.reduceat(c[order], at[:-1], dtype=np.int64)
            first, n_asked = order[at[:-1]], len(key)
            del key, c
            u, w = u[first], w[first]
            by = np.argsort(u, kind="stable")  # repeated pairs stand in the order of their contexts
            u, w, total = u[by], w[by], total[by]
            many = total > 1
            slot = np.where(many, np.cumsum(many) + 1, total).astype("<u4")
            reply = np.empty(n_asked, "<u4")
            back = np.empty(len(by), np.int64)
            back[by] = np.arange(len(by))
            reply[order] = np.repeat(slot[back], np.diff(at))
            end = 0
            for number, n in lengths:
                yield dict(kind=0, batch=number, piece=piece, a=_pack(reply[end:end + n]))
                end += n
            learnt = total > 0
            if not learnt.any():
                continue
            # The piece's words, by part: those of repeated pairs take part in the sweeps, single pairs are one table for good.
            # The lists of contexts and of words are told to their parts, which keep them by place.
            mu, mw, single = distinct(u[many]), distinct(w[many]), distinct(np.concatenate([u[total == 1], w[total == 1]]))
            iu, iw = np.searchsorted(mu, u[many]), np.searchsorted(mw, w[many])
            yield dict(kind=1, piece=piece, a=_pack(_small(iu, len(mu))), b=_pack(_small(iw, len(mw))), c=_pack(total[many].astype("<i8")),
                       d=np.stack([_cuts(mu, n_parts), _cuts(mw, n_parts)]).astype("<i8").tobytes(), singles=int((total == 1).sum()), repeated=int(many.sum()))
            su, sw = (np.bincount(np.searchsorted(single, x[total == 1]), minlength=len(single)).astype("<u4") for x in (u, w))
            bu, bw = (np.bincount(i, minlength=len(x)).astype("<u4") for i, x in ((iu, mu), (iw, mw)))
            cu, cw, cs = _cuts(mu, n_parts), _cuts(mw, n_parts), _cuts(single, n_parts)
            for p in np.flatnonzero(np.diff(cu) + np.diff(cw) + np.diff(cs)).tolist():
                i, j, k = (slice(x[p], x[p + 1]) for x in (cu, cw, cs))
                yield dict(kind=2, piece=piece, part=p, a=mu[i].tobytes(), b=mw[j].tobytes(), c=single[k].tobytes(),
                           d=_pack(np.concatenate([su[k], sw[k]])), e=_pack(np.concatenate([bu[i], bw[j]])))

    return stored_together("pieces", *(_map(_map(rows, partial(ask, turn=i), kinds).repartition(n_parts, "piece"), count, _PIECE) for i in range(TURNS)))


#: A part's words: their counts, tables of single pairs in both roles; what each piece asks for by place.
_PART = {"part": "int", "piece": "int", "contexts": "binary", "words": "binary", "begin": "binary", "counts": "binary", "single": "binary"}


def _owners(lexicon: DataFrame, pieces: DataFrame, n_parts: int) -> DataFrame:
    kinds = {"part": "int", "piece": "int", "words": "binary", "counts": "binary", "a": "binary", "b": "binary", "c": "binary", "d": "binary", "e": "binary"}
    own = _fill(lexicon.where("batch IS NULL"), kinds, "part", "words", "counts")
    asked = _fill(pieces.where("kind = 2"), kinds, "part", "piece", *"abcde")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[int, list] = {}
        for x in _rows(batches, *kinds):
            held.setdefault(x[0], []).append(x[1:])
        for part, got in held.items():
            own = next(x for x in got if x[0] is None)
            h = np.frombuffer(own[1], U64)
            single = np.zeros((2, len(h)), np.int64)
            for x in got:
                if x[0] is not None:
                    i = np.searchsorted(h, np.frombuffer(x[5], U64))
                    single[:, i] += _open(x[6], "<u4").reshape(2, -1)
                    at = [np.searchsorted(h, np.frombuffer(x[k], U64)) for k in (3, 4)]
                    yield dict(part=part, piece=x[0], contexts=_pack(np.diff(at[0], prepend=0).astype("<u4")), words=_pack(np.diff(at[1], prepend=0).astype("<u4")), begin=x[7])
            yield dict(part=part, counts=_pack(np.frombuffer(own[2], "<i8")), single=_pack(single))

    return stored(_map(own.unionByName(asked).repartition(n_parts, "part"), meet, _PART), "owners")


#: What owners of words yield in a sweep: masses for a piece, or with piece null their state and sums.
_SENT = {"part": "int", "piece": "int", "x": "binary", "g": "binary", "known": "binary", "tables": "long", "total": "double", "inverse": "double"}
#: What pieces yield: table sums for a part, or with part null the tables of the samples so far.
_BACK = {"part": "int", "piece": "int", "sums": "binary", "drawn": "binary", "customers": "long"}


def _deal(owners: DataFrame, back: DataFrame | None, sent: DataFrame | None, n_parts: int, sweep: int, s: float, u: float) -> DataFrame:
    """A part's share of a sweep: scales of its contexts and masses of its words, drawn anew.

    ``known`` gathers for the samples, word by word, what the parent's seating gives it and the weight of the parent after it.
    """
    kinds = _PART | {"sums": "binary", "known": "binary"}
    rows = _fill(owners, kinds, *(x for x in _PART if x != "begin" or back is None))
    if back is not None:
        rows = rows.unionByName(_fill(back.where("part IS NOT NULL"), kinds, "part", "piece", "sums"))
        rows = rows.unionByName(_fill(sent.where("piece IS NULL"), kinds, "part", "known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[int, list] = {}
        for x in _rows(batches, *kinds):
            held.setdefault(x[0], []).append(x[1:])
        for part, got in held.items():
            rng = np.random.default_rng([11, sweep, part])
            asked = [(x[0], *(np.cumsum(_open(x[i], "<u4"), dtype=np.int64) for i in (1, 2)), x[3]) for x in got if x[1] is not None]
            sums = {x[0]: x[6] for x in got if x[6] is not None}
            n, t, c = next((_open(x[4], "<i8"), *_open(x[5], "<i8").reshape(2, -1).copy()) for x in got if x[4] is not None)
            for piece, contexts, heard, begin in asked:
                drawn = _open(begin, "<u4") if begin is not None else _open(sums[piece], "<i8") if piece in sums else np.zeros(len(contexts) + len(heard), np.int64)
                t[contexts] += drawn[:len(contexts)]
                c[heard] += drawn[len(contexts):]
            x, (seats, g) = rng.gamma(STRENGTH[1] / DISCOUNT + t), masses(c, s, u, rng)
            known = next((zlib.decompress(x[7]) for x in got if x[7] is not None), b"")
            if sweep > BURN_IN:  # the tables that came back and those of the parent are a sample
                known += (c - DISCOUNT * seats).astype("<f4").tobytes() + ((STRENGTH[1] + DISCOUNT * t) / (STRENGTH[1] + n)).astype("<f4").tobytes()
            if sweep < BURN_IN + SAMPLES:
                for piece, contexts, heard, _ in asked:
                    yield dict(part=part, piece=piece, x=x[contexts].astype("<f4").tobytes(), g=g[heard].astype("<f4").tobytes())
            yield dict(part=part, known=zlib.compress(known, 1), tables=int(seats.sum()), total=float(g.sum()), inverse=float((1 / g).sum()))

    return stored(_map(rows.repartition(n_parts, "part"), run, _SENT), f"sent{sweep}")


def _seats(pieces: DataFrame, sent: DataFrame, back: DataFrame | None, n_parts: int, sweep: int, scale: float) -> DataFrame:
    """A piece's share of a sweep: the tables of its pairs, drawn anew."""
    kinds = {"piece": "int", "part": "int", "a": "binary", "b": "binary", "c": "binary", "d": "binary", "x": "binary", "g": "binary", "drawn": "binary"}
    rows = _fill(pieces.where("kind = 1"), kinds, "piece", "a", "b", "c", "d").unionByName(_fill(sent.where("piece IS NOT NULL"), kinds, "piece", "part", "x", "g"))
    if back is not None:
        rows = rows.unionByName(_fill(back.where("part IS NULL"), kinds, "piece", "drawn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[int, list] = {}
        for x in _rows(batches, *kinds):
            held.setdefault(x[0], []).append(x[1:])
        for piece, got in held.items():
            a, b, c, cuts = next((x[1], x[2], _open(x[3], "<i8"), np.frombuffer(x[4], "<i8").reshape(2, -1)) for x in got if x[1] is not None)
            told = sorted((x[0], x[5], x[6]) for x in got if x[0] is not None)
            scales, g = (np.concatenate([np.frombuffer(x[i], "<f4") for x in told] or [np.zeros(0)]).astype(float) for i in (1, 2))
            iu, iw = _open(a, _kind(len(scales))), _open(b, _kind(len(g)))
            t = tables(c, DISCOUNT * scales[iu] * g[iw] / scale, np.random.default_rng([13, sweep, piece]))
            drawn = next((_open(x[7], "<i8") for x in got if x[7] is not None), np.zeros(len(t), np.int64))
            of_u, of_w = np.zeros(len(scales), np.int64), np.zeros(len(g), np.int64)
            np.add.at(of_u, iu, t)
            np.add.at(of_w, iw, t)
            for p in np.flatnonzero(np.diff(cuts).sum(0)).tolist():
                yield dict(part=p, piece=piece, sums=_pack(np.concatenate([x[k[p]:k[p + 1]] for x, k in ((of_u, cuts[0]), (of_w, cuts[1]))])))
            yield dict(piece=piece, drawn=_pack(drawn + t * (sweep >= BURN_IN)), customers=int(t.sum()))

    return stored(_map(rows.repartition(n_parts, "piece"), run, _BACK), f"back{sweep}")


def gibbs(lexicon: DataFrame, pieces: DataFrame, n_parts: int, v: int) -> tuple[DataFrame, DataFrame, list[tuple[int, int]]]:
    """Sweeps over all restaurants: the owners' samples, the pieces' tables, and the parent's customers and tables in each sample.

    The driver sees sums alone: the parent's customers, its mass, and the sum of the inverse masses.
    """
    rng = np.random.default_rng(7)
    owners = _owners(lexicon, pieces, n_parts)
    of = pieces.agg(F.sum("singles").alias("singles"), F.sum("repeated").alias("repeated")).first()
    singles = of.singles or 0
    customers = singles + (of.repeated or 0)  # every pair at one table
    scale, parent, back, sent = STRENGTH[0], [], None, None
    zeta = (v + 1) * np.sqrt(scale / max(customers, 1))
    for sweep in range(BURN_IN + SAMPLES + 1):
        u = rng.gamma(customers) / scale if customers else 0.0
        was, sent = sent, _deal(owners, back, sent, n_parts, sweep, zeta / (v + 1), u)
        if was is not None:
            forget(was)
        of = sent.where("piece IS NULL").agg(*(F.sum(x).alias(x) for x in ("tables", "total", "inverse"))).first()
        if sweep > BURN_IN:
            parent.append((customers, of.tables or 0))
        if sweep == BURN_IN + SAMPLES:
            break
        other = masses(np.zeros(1, np.int64), zeta / (v + 1), u, rng)[1][0]
        scale = (of.total or 0.0) + other
        zeta = process_time(v, (of.inverse or 0.0) + 1 / other, rng)
        was, back = back, _seats(pieces, sent, back, n_parts, sweep, scale)
        if was is not None:
            forget(was)
        customers = singles + (back.agg(F.sum("customers").alias("n")).first().n or 0)
    forget(owners)
    return sent, back, parent


def _answers(lexicon: DataFrame, pieces: DataFrame, sent: DataFrame, back: DataFrame, n_parts: int, now: Column) -> DataFrame:
    """To every batch of ``now``: with part, what is known of its words; with piece, the customers of its pairs less their tables' discounts."""
    names = {"batch": "long", "part": "int", "piece": "int", "values": "binary"}
    kinds = {"part": "int", "batch": "long", "places": "binary", "counts": "binary", "known": "binary"}
    rows = _fill(lexicon.where(F.col("batch").isNull() | now), kinds, "part", "batch", "places", "counts").unionByName(_fill(sent.where("piece IS NULL"), kinds, "part", "known"))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[int, list] = {}
        for x in _rows(batches, *kinds):
            held.setdefault(x[0], []).append(x[1:])
        for part, got in held.items():
            c = next(np.frombuffer(x[2], "<i8") for x in got if x[2] is not None)
            known = next(_open(x[3], "<f4") for x in got if x[3] is not None).reshape(SAMPLES, 2, len(c))
            # Place 0 is the unknown word, and a context without customers.
            c = np.append(0, c)
            known = np.concatenate([np.tile(np.float32([[0], [1]]), (SAMPLES, 1, 1)), known], 2)
            for batch, places, *_ in got:
                if batch is not None:
                    i = _open(places, "<u4")
                    yield dict(batch=batch, part=part, values=zlib.compress(c[i].tobytes() + known[:, :, i].tobytes(), 1))

    kinds2 = {"piece": "int", "kind": "int", "batch": "long", "a": "binary", "c": "binary", "drawn": "binary"}
    asked = _fill(pieces.where((F.col("kind") == 1) | (F.col("kind") == 0) & now), kinds2, "piece", "kind", "batch", "a", "c").unionByName(_fill(back.where("part IS NULL"), kinds2, "piece", "drawn"))

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[int, list] = {}
        for x in _rows(batches, *kinds2):
            held.setdefault(x[0], []).append(x[1:])
        for piece, got in held.items():
            c = next((_open(x[3], "<i8") for x in got if x[3] is not None), np.zeros(0))
            t = next((_open(x[4], "<i8") for x in got if x[4] is not None), np.zeros(0))
            left = np.concatenate([[0, 1 - DISCOUNT], c - DISCOUNT * t / SAMPLES]).astype("<f4")
            for _, batch, a, *_ in got:
                if batch is not None:
                    yield dict(batch=batch, piece=piece, values=_pack(left[_open(a, "<u4")]))

    return _map(rows.repartition(n_parts, "part"), tell, names).unionByName(_map(asked.repartition(n_parts, "piece"), show, names))


_SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
           "score double, perplexity double")


def scores(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts, the base score, the model's log10 probability and the perplexity."""
    conf = docs.sparkSession.conf
    was = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        return _scores(docs)
    finally:
        conf.set(CLEANUP, was)


def _scores(docs: DataFrame) -> DataFrame:
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        (crc32_mod(F.col("doc_id"), 5) == 1).alias("held"))
    mb = input_mb(docs)
    n_parts = max(min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16), min(100_000, int(mb / PART_MB) + 1) if mb < 1e9 else 1)
    rows = stored(_map(plain, _read, _BATCH), "batches")
    lexicon = _lexicon(rows, n_parts)
    of = lexicon.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = of.n or 0, of.v or 0
    hot = _hot(lexicon, n // max(CLASSES, 4 * n_parts))
    pieces = _pieces(rows, hot, n_parts)
    sent, back, parent = gibbs(lexicon, pieces, n_parts, v)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*_BATCH, "part", "piece", "values"]
        for _, got in groupby(_rows(batches, *names), lambda x: x[0]):
            own, words_known, pairs_known = None, [], []
            for x in got:
                if x[1] is not None:
                    own = x
                elif x[7] is not None:
                    words_known.append((x[7], zlib.decompress(x[9])))
                else:
                    pairs_known.append((x[8], _open(x[9], "<f4")))
            size = np.frombuffer(own[3], "<i8")
            valid, ids = np.frombuffer(own[1], bool, len(size)), np.frombuffer(own[1], "<i8", len(size), len(size))
            code, h = _open_codes(own[4], int(size.sum()), _open(own[6], "<u4")), _open_sorted(own[5])
            each = [(len(x) // (8 + 8 * SAMPLES), x) for _, x in sorted(words_known)]
            c = np.concatenate([np.frombuffer(x, "<i8", k) for k, x in each]).astype(float)
            known = np.concatenate([np.frombuffer(x, "<f4", offset=8 * k).reshape(SAMPLES, 2, k) for k, x in each], 2)
            left = np.concatenate([x for _, x in sorted(pairs_known, key=lambda x: x[0])])
            u, w, _, of = _pairs(_contexts(code, size, h), code, h, hot, n_parts)
            p = left / (STRENGTH[1] + c[u])
            for (seated, weight), (customers, all_tables) in zip(known.astype(float), parent):
                g = (seated + (STRENGTH[0] + DISCOUNT * all_tables) / (v + 1)) / (STRENGTH[0] + customers)
                p += weight[u] * g[w] / SAMPLES
            logs = np.log10(p)[of]
            base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))[code]
            per = lambda x, at=np.cumsum(size) - size: np.add.reduceat(x, at)  # noqa: E731  every document has its end token
            total = per(logs)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, mask=~valid), pa.array(np.frombuffer(own[2], bool)), pa.array(size), pa.array(per((c > 0)[code].astype(np.int64))),
                pa.array(np.full(len(size), n)), pa.array(per(base)), pa.array(total), pa.array(10.0 ** (-total / size))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    def scored(turn: int) -> DataFrame:
        # Not the hash that deals batches to tasks, which would leave most tasks of a turn empty.
        now = F.pmod(F.xxhash64("batch"), F.lit(TURNS)) == turn
        answers = _answers(lexicon, pieces, sent, back, n_parts, now)
        every = rows.where(now).unionByName(answers, allowMissingColumns=True)
        return every.repartition(n_parts, "batch").sortWithinPartitions("batch").mapInArrow(score, _SCORES)

    out = stored_together("scores", *(scored(i) for i in range(TURNS)))
    forget(rows, lexicon, pieces, sent, back)
    return out


def _hot(lexicon: DataFrame, most: int) -> np.ndarray:
    """Hashes of the contexts with more than ``most`` training tokens, which are few by the choice of ``most``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for h, c in _rows(batches, "words", "counts"):
            h = np.frombuffer(h, U64)[np.frombuffer(c, "<i8") > max(most, HOT)]
            if len(h):
                yield dict(words=h.tobytes())

    found = _map(lexicon.where("batch IS NULL").select("words", "counts"), find, {"words": "binary"}).collect()
    return distinct(np.concatenate([np.zeros(0, U64), *(np.frombuffer(bytes(r.words), U64) for r in found)]))
