"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network reads a word's bytes in both directions, labels every position with language probabilities,
and a document pools the log-probabilities of all its positions. White space ends a sequence, so equal
words give equal outputs: every distinct word of a slice is read once and weighted by its occurrences,
and all words of the whole text count. Training is backpropagation through time with Adam, in one task,
on a sample of at most ``SAMPLE`` distinct labelled texts of each language (those with the lowest hashes).

Defined results: texts that are null or have no letter are ``und`` with score 0; without any labelled
document everything is ``und``; rows with null lang are not learned from; equal texts always get the same
prediction. A language's column name, source or id is never an input. Extra columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcheck.llm.common import SPACED, Words, crc32_mod, forget, slices, stored, words

#: Distinct labelled texts of each language that the classifier is fitted on.
SAMPLE = 400
#: Hashes are counted in so many (2 to this power) ranges before the lowest ones are ordered.
RANGE_BITS = 12
#: Distinct words of the sample, the most frequent ones, that training sees.
TRAIN_WORDS = 40_000
#: Longer words are read in pieces of so many bytes.
LONGEST = 24
HIDDEN = 8
EMBED = 8
EPOCHS = 6
#: Small samples are gone through more often, until so many steps are made.
LEAST_STEPS = 240
BATCH = 512
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


#: Distinct words whose sums a task remembers; beyond it the memory starts anew, which only costs time.
MEMORY = 1_000_000
#: Word pieces that run through the network together.
ROWS = 4096


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Direction:
    """One gated recurrent layer: reset, update and candidate gates, in this order."""

    names = ("w", "u", "b")

    def __init__(self, rng: np.random.Generator | None, weights: dict | None = None):
        if weights is not None:
            self.__dict__.update(weights)
            return
        self.w = (rng.standard_normal((EMBED, 3 * HIDDEN)) / np.sqrt(EMBED)).astype(np.float32)
        self.u = (rng.standard_normal((HIDDEN, 3 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
        self.b = np.zeros(3 * HIDDEN, np.float32)

    def forward(self, xw: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States (time, rows, hidden) from the projected inputs; padding keeps the state."""
        h = np.zeros((xw.shape[1], HIDDEN), np.float32)
        out = np.empty((*xw.shape[:2], HIDDEN), np.float32)
        for t in range(len(xw)):
            hu = h @ self.u
            gates = sigmoid(xw[t, :, :2 * HIDDEN] + hu[:, :2 * HIDDEN])
            r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(xw[t, :, 2 * HIDDEN:] + r * hu[:, 2 * HIDDEN:])
            m = mask[t][:, None]
            new = np.where(m, z * h + (1 - z) * c, h)
            if keep is not None:
                keep.append((h, hu[:, 2 * HIDDEN:], r, z, c, m))
            h = out[t] = new
        return out

    def backward(self, dout: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the projected inputs and of the recurrent weights."""
        dxw = np.zeros((*dout.shape[:2], 3 * HIDDEN), np.float32)
        du, dh = np.zeros_like(self.u), np.zeros(dout.shape[1:], np.float32)
        for t in reversed(range(len(dout))):
            h, huc, r, z, c, m = keep[t]
            dh = dh + dout[t]
            dn = dh * m
            dz, dc, dprev = dn * (h - c), dn * (1 - z), dn * z + dh * ~m
            dc = dc * (1 - c * c)
            dr = dc * huc * r * (1 - r)
            dz = dz * z * (1 - z)
            dhu = np.concatenate([dr, dz, dc * r], 1)
            dxw[t] = np.concatenate([dr, dz, dc], 1)
            du += h.T @ dhu
            dh = dprev + dhu @ self.u.T
        return dxw, du


class ByteGRU:
    """Byte embeddings, two directions, and a softmax at every position."""

    def __init__(self, langs: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.embed = (rng.standard_normal((256, EMBED)) * 0.3).astype(np.float32)
        self.ways = [Direction(rng), Direction(rng)]
        self.out = (rng.standard_normal((2 * HIDDEN, len(langs))) / np.sqrt(2 * HIDDEN)).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def _states(self, x: np.ndarray, mask: np.ndarray, keeps=(None, None)) -> np.ndarray:
        both = []
        for way, keep, step in zip(self.ways, keeps, (1, -1)):
            xw = (self.embed @ way.w + way.b)[x[::step]]
            both.append(way.forward(xw, mask[::step], keep)[::step])
        return np.concatenate(both, 2)

    def position_logs(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Log-probabilities of the languages at every position (time, rows, languages)."""
        return _log_softmax(self._states(x, mask) @ self.out + self.bias)

    def fit(self, x: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray, seed: int = 2) -> None:
        rng, slot = np.random.default_rng(seed), {}
        steps = 0
        length = mask.sum(0)
        epochs = max(EPOCHS, -(-LEAST_STEPS // -(-len(length) // BATCH)))
        for epoch in range(epochs):
            order = np.argsort(length + rng.random(len(length)) * 4, kind="stable")
            batches = np.array_split(order, max(1, -(-len(order) // BATCH)))
            for k in rng.permutation(len(batches)):
                rows = batches[k]
                steps += 1
                top = max(1, int(length[rows].max()))
                rate = 6e-3 * (1 - epoch / epochs) + 5e-4
                for p, g in self._gradients(x[:top, rows], mask[:top, rows], target[rows], weight[rows]):
                    m, v = slot.setdefault(id(p), (np.zeros_like(p), np.zeros_like(p)))
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9 ** steps)) / (np.sqrt(v / (1 - 0.999 ** steps)) + 1e-8)

    def _gradients(self, x, mask, target, weight):
        keeps: tuple[list, list] = ([], [])
        states = self._states(x, mask, keeps)
        logs = _log_softmax(states @ self.out + self.bias)
        share = (mask * weight).astype(np.float32)
        share /= share.sum() + 1e-9
        d = (np.exp(logs) - target) * share[:, :, None]
        flat = d.reshape(-1, d.shape[2])
        yield self.out, states.reshape(-1, 2 * HIDDEN).T @ flat
        yield self.bias, flat.sum(0)
        dstates = d @ self.out.T
        dembed = np.zeros_like(self.embed)
        for i, (way, keep, step) in enumerate(zip(self.ways, keeps, (1, -1))):
            dxw, du = way.backward(dstates[::step, :, i * HIDDEN:(i + 1) * HIDDEN], keep)
            by_byte = np.zeros((256, 3 * HIDDEN), np.float32)
            np.add.at(by_byte, x[::step].ravel(), dxw.reshape(-1, 3 * HIDDEN))
            dembed += by_byte @ way.w.T
            yield way.w, self.embed.T @ by_byte
            yield way.u, du
            yield way.b, by_byte.sum(0)
        yield self.embed, dembed

    def dump(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, langs=np.array(self.langs), embed=self.embed, out=self.out, bias=self.bias,
                 **{f"{n}{i}": getattr(w, n) for i, w in enumerate(self.ways) for n in w.names})
        return f.getvalue()

    @classmethod
    def load(cls, data: bytes) -> ByteGRU:
        z, self = np.load(io.BytesIO(data)), cls.__new__(cls)
        self.langs = [str(x) for x in z["langs"]]
        self.embed, self.out, self.bias = z["embed"], z["out"], z["bias"]
        self.ways = [Direction(None, {n: z[f"{n}{i}"] for n in Direction.names}) for i in (0, 1)]
        return self


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def padded(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the sequences as (time, rows), zero beyond their ends, and which are theirs."""
    t = np.arange(max(1, int(length.max(initial=1))))[:, None]
    mask = t < length
    return np.where(mask, data[np.minimum(begin + t, len(data) - 1)], 0), mask


def pieces_of(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length and word of the pieces (at most ``LONGEST`` bytes) of all words."""
    n = -(-(w.end - w.begin) // LONGEST)
    word = np.repeat(np.arange(len(w)), n)
    k = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    begin = w.begin[word] + k * LONGEST
    return begin, np.minimum(LONGEST, w.end[word] - begin), word


class Pooler:
    """Sums of log-probabilities by distinct word, remembered by the word's hash."""

    def __init__(self, model: ByteGRU):
        self.model = model
        self.known, self.sums = np.zeros(0, np.uint64), np.zeros((0, len(model.langs)))

    def _read(self, w: Words, rep: np.ndarray) -> np.ndarray:
        own = Words(w.data, w.begin[rep], w.end[rep], np.array([0, len(rep)]))
        begin, length, word = pieces_of(own)
        sums = np.zeros((len(rep), len(self.model.langs)))
        by_length = np.argsort(length, kind="stable")
        for at in range(0, len(by_length), ROWS):
            k = by_length[at:at + ROWS]
            x, mask = padded(w.data, begin[k], length[k])
            logs = np.maximum(self.model.position_logs(x, mask), np.float32(-9)) * mask[:, :, None]
            np.add.at(sums, word[k], logs.sum(0))
        return sums

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-probabilities over all positions of each text, and the number of positions."""
        w = words(text, SPACED)
        total = np.zeros((len(text), len(self.model.langs)))
        if not len(w):
            return total, np.zeros(len(text))
        h = w.hashes()
        order = np.argsort(h)
        new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(new) - 1
        rep = order[new]
        if len(self.known) > MEMORY:
            self.known, self.sums = self.known[:0], self.sums[:0]
        at = np.searchsorted(self.known, h[rep])
        seen = np.zeros(len(rep), bool)
        inside = at < len(self.known)
        seen[inside] = self.known[at[inside]] == h[rep][inside]
        sums = np.empty((len(rep), total.shape[1]))
        sums[seen] = self.sums[at[seen]]
        sums[~seen] = self._read(w, rep[~seen])
        known, all_sums = np.concatenate([self.known, h[rep][~seen]]), np.concatenate([self.sums, sums[~seen]])
        order = np.argsort(known)
        self.known, self.sums = known[order], all_sums[order]
        for j in range(total.shape[1]):
            total[:, j] = np.diff(np.concatenate([[0], np.cumsum(sums[which, j])])[w.first])
        positions = np.diff(np.concatenate([[0], np.cumsum(w.end - w.begin)])[w.first])
        return total / np.maximum(positions, 1)[:, None], positions


def predict(pooled: Pooler | None, text: pa.Array) -> tuple[list[str], list[float]]:
    langs, scores = [UNKNOWN] * len(text), [0.0] * len(text)
    if pooled is None:
        return langs, scores
    mean, positions = pooled(text)
    share = np.exp(_log_softmax(mean))
    best = share.argmax(1)
    for i, t in enumerate(text.to_pylist()):
        if positions[i] and _LETTER.search(t):
            langs[i], scores[i] = pooled.model.langs[best[i]], float(share[i, best[i]])
    return langs, scores


def train(texts: list[str], labels: list[str]) -> ByteGRU | None:
    """Fits the network on whole texts: every distinct word with its share in each language."""
    langs = sorted(set(labels))
    if not langs:
        return None
    order = sorted(range(len(texts)), key=lambda i: (labels[i], texts[i]))
    w = words(pa.array([texts[i] for i in order], pa.large_string()), SPACED)
    if not len(w):
        return None
    code = np.array([langs.index(labels[i]) for i in order])[w.doc()]
    h = w.hashes()
    values, first, which = np.unique(h, return_index=True, return_inverse=True)
    count = np.zeros((len(values), len(langs)))
    np.add.at(count, (which, code), 1)
    # Languages count alike, however many words their sample has.
    share = count / np.maximum(count.sum(0), 1)
    use = np.argsort(-count.sum(1), kind="stable")[:TRAIN_WORDS]
    own = Words(w.data, w.begin[first[use]], w.end[first[use]], np.array([0, len(use)]))
    begin, length, word = pieces_of(own)
    target = ((share + 1e-9) / (share + 1e-9).sum(1, keepdims=True))[use][word].astype(np.float32)
    weight = np.sqrt(count.sum(1))[use][word].astype(np.float32)
    model = ByteGRU(langs)
    x, mask = padded(w.data, begin, length)
    model.fit(x, mask, target, weight)
    return model


def sample(docs: DataFrame, per_lang: int = SAMPLE) -> DataFrame:
    """(lang, text): the ``per_lang`` labelled texts of each language with the lowest hashes, copies once."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("text").alias("h"))
    hashes = stored(known.select("lang", "h").distinct().withColumn("range", F.shiftright("h", 64 - RANGE_BITS).cast("int")), "hashes")
    # Counts of ranges of hashes tell up to which range a language's sample reaches; only these are ordered.
    upto = Window.partitionBy("lang").orderBy("range")
    sums = hashes.groupBy("lang", "range").count().withColumn("before", F.sum("count").over(upto) - F.col("count"))
    reach = _by_lang(sums.where(F.col("before") < per_lang).groupBy("lang").agg(F.max("range").alias("x")))
    if reach is None:
        forget(hashes)
        return known.select("lang", "text")
    low = Window.partitionBy("lang").orderBy("h")
    lowest = hashes.where(F.col("range") <= reach).withColumn("k", F.row_number().over(low)).where(F.col("k") <= per_lang)
    bound = _by_lang(lowest.groupBy("lang").agg(F.max("h").alias("x")))
    forget(hashes)
    return known.where(F.col("h") <= bound).select("lang", "text").distinct()


def _by_lang(rows: DataFrame) -> Column | None:
    """``x`` of a row's language; one row for each language comes to the driver, so that rows are picked where they are read."""
    got = sorted((r.lang, r.x) for r in rows.collect())
    return F.create_map(*[F.lit(v) for r in got for v in r])[F.col("lang")] if got else None


def fitted(docs: DataFrame, per_lang: int = SAMPLE) -> bytes | None:
    """The trained network; one task fits it on the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for b in batches:
            texts += b.column("text").to_pylist()
            labels += b.column("lang").to_pylist()
        model = train(texts, labels)
        yield pa.RecordBatch.from_arrays([pa.array([model.dump()] if model else [], pa.binary())], ["model"])

    got = sample(docs, per_lang).coalesce(1).mapInArrow(run, "model binary").collect()
    return bytes(got[0].model) if got else None


def labelled(docs: DataFrame) -> DataFrame:
    """What the network learns from: documents whose crc32 is not 2 modulo 4."""
    return docs.where(crc32_mod(F.col("doc_id"), 4) != 2).select("lang", "text")


def languages(docs: DataFrame, model: bytes | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Pooler(ByteGRU.load(model)) if model else None
        for b in slices(batches):
            langs, scores = predict(net, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc32_mod(F.col("doc_id"), 4) == 2).alias("held_out"),
                        F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double"))


def keep_known(docs: DataFrame, model: bytes | None, least: float = 0.3) -> DataFrame:
    """``docs`` with its own columns, without texts that have no letters or no likely language.

    Where no language was learned none can be unlikely, so only texts without letters go; nor can a text be
    unlikely among three languages or fewer, of which one always has a third.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Pooler(ByteGRU.load(model)) if model else None
        for b in slices(batches):
            if net is None:
                yield b.filter(pa.array([t is not None and _LETTER.search(t) is not None for t in b.column("text").to_pylist()], pa.bool_()))
                continue
            langs, scores = predict(net, b.column("text"))
            yield b.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
