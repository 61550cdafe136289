"""Helpers of the training-data operators: shared folder, batches, words and their hashes.

Words are found on the UTF-8 bytes of a whole Arrow slice with numpy tables, so no text is ever
split into Python strings. Every document is followed by one blank in the byte buffer, hence a word
never runs into the next document.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: Bytes of text that a task works on at once; longer documents form a slice of their own.
SLICE_BYTES = 8 << 20
NULL_ID = -(1 << 63)
#: Edges of a graph that one task takes at once, 4 MB.
EDGES = 1 << 18

U64 = np.uint64
_C1, _C2, _C3 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53), U64(0x9E3779B97F4A7C15)


#: The folder of a local session that names none.
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session may go without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="fieldcheck-"))
        root = _OWN[0]
    return root if ":/" in root else "file://" + root


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: a cut of its lineage."""
    return stored_together(name, df)


def stored_together(name: str, *tables: DataFrame) -> DataFrame:
    """All rows of ``tables`` of one schema, written one table after the other, read back as one."""
    df = tables[0]
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}/{name}"
    for t in tables:
        t.write.mode("append").option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_path = path
    return back


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing lazy reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.stored_path).getParent()
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, xxhash64 of the text) is in ``kept``, once each, with their own columns.

    Of rows that repeat both, the one whose other columns have the lowest hash stays (maps and variants cannot
    be hashed and do not count).
    """
    others = [f"`{f.name}`" for f in docs.schema if f.name.lower() not in ("doc_id", "text") and not _unhashable(f.dataType)]
    own = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("own"), F.col("doc_id").cast("long").alias("id"),
                      F.xxhash64("text").alias("th"), (F.xxhash64(*others) if others else F.lit(0)).alias("rest"))
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("th").alias("kept_th"))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("th") == F.col("kept_th"))
    one = Window.partitionBy("id", "th").orderBy("rest")
    return (own.hint("merge").join(kept, same, "left_semi").withColumn("k", F.row_number().over(one)).where("k = 1").select("own.*"))


def _unhashable(kind: DataType) -> bool:
    return any(x in kind.simpleString() for x in ("map<", "variant"))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text",
           size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again in order, cut so that a slice holds about ``size`` bytes of ``column``."""
    for b in batches:
        n = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(n, dtype=np.int64)
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield b.slice(at, to - at)
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> U64(33))
    x = x * _C1
    x ^= x >> U64(33)
    x = x * _C2
    x ^= x >> U64(33)
    return x


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of the sequence of hashes, position by position."""
    h = np.zeros_like(parts[0]) + _C3
    for p in parts:
        h = mix(h * _C3 + p)
    return h


def byte_table(letters: bytes | None = None, blanks: bytes | None = None) -> bytes:
    """A 256-entry table for bytes.translate: 1 for bytes that belong to words, else 0."""
    if letters is None:
        letters = bytes(set(range(256)) - set(blanks))
    return bytes(int(i in letters) for i in range(256))


#: Words are whatever lies between ASCII white space.
SPACED = byte_table(blanks=b" \t\n\v\f\r")
#: Words are ASCII letters, digits and all other characters beyond ASCII.
ALNUM = byte_table(letters=bytes([*range(48, 58), *range(97, 123), *range(128, 256)]))
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def through(data: np.ndarray, table: bytes) -> np.ndarray:
    """Every byte replaced by its entry of the table."""
    return np.frombuffer(data.tobytes().translate(table), np.uint8)


@dataclass
class Words:
    """Words of a slice: ``begin[i]:end[i]`` in ``data``; document d has words ``first[d]:first[d+1]``."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.begin)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of every word, from eight bytes at a time; seeds give independent ones."""
        return span_hashes(self.data, self.begin, self.end, seed)

    def text(self, i: int) -> str:
        return self.data[self.begin[i]:self.end[i]].tobytes().decode()


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """``data`` must have eight spare bytes at its end."""
    length = end - begin
    lanes = np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))
    h = (length.astype(U64) + U64(seed)) * _C3
    todo, at = np.arange(len(begin)), begin
    left = length
    while len(todo):
        lane = lanes[at].astype(U64)
        short = left < 8
        lane[short] &= (U64(1) << (left[short].astype(U64) * U64(8))) - U64(1)
        h[todo] = mix((h[todo] ^ lane) * _C3 + U64(1))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return h


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one blank after each and eight spare ones, and where each text begins."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    joined = pc.binary_join_element_wise(text, pa.scalar("", pa.large_string()),
                                         pa.scalar(" ", pa.large_string()))
    if not len(joined):
        return np.full(8, 32, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset:joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8)[at[0]:at[-1]]
    return np.concatenate([data, np.full(8, 32, np.uint8)]), at - at[0]


def words(text: pa.Array, table: bytes = SPACED, lower: bool = False) -> Words:
    """The words of every text; a null text has none."""
    data, at = text_bytes(text)
    if lower:
        data = through(data, LOWER)
    inside = through(data, table)  # the blank at the end is no word, and neither are the spare ones
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[::2], edge[1::2]
    return Words(data, begin, end, np.searchsorted(begin, at))


def word_strings(w: Words, table: bytes) -> pa.LargeStringArray:
    """The words as one string array; ``table`` is the one they were found with."""
    ends = np.concatenate([[0], np.cumsum(w.end - w.begin)]).astype(np.int64)
    inside = w.data[through(w.data, table).view(bool)]
    return pa.LargeStringArray.from_buffers(len(w), pa.py_buffer(ends), pa.py_buffer(inside))


def windows(w: Words, k: int) -> np.ndarray:
    """First words of all runs of ``k`` words of one document."""
    ok = np.ones(max(len(w) - k + 1, 0), bool)
    last = w.first[1:-1]
    for back in range(1, k):
        x = last - back
        ok[x[(x >= 0) & (x < len(ok))]] = False
    return np.flatnonzero(ok)


def gram_hashes(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` words from each of ``at``: ``chain`` without holding all words at once."""
    out = np.full(len(at), _C3)
    for i in range(k):
        out *= _C3
        out += h[at + i]
        out = mix(out)
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (np.unique is several times slower on 64-bit hashes)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def ragged(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All indices of the runs ``first[i] .. first[i] + length[i] - 1``, one after another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(length) - length
    return np.arange(total) + np.repeat(first - begin, length)


def crc32_mod(column, n: int):
    """crc32 of an id's decimal text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def input_mb(df: DataFrame) -> float:
    """Catalyst's estimate of the input in MB; only used to size partitions."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) / 1e6


def parts(df: DataFrame, mb_each: float = 8.0) -> int:
    """Partitions for a shuffle that moves about as much as the input."""
    mb = input_mb(df)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(100_000, int(mb / mb_each) + 1)) if mb < 1e9 else least


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars around the smallest node of each of its components."""
    got = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if not got:
        return
    nodes, ends = np.unique(np.concatenate([x for pair in got for x in pair]), return_inverse=True)
    cuts = np.cumsum([len(x) for pair in got for x in pair])[:-1]
    parts_of = np.split(ends, cuts)
    a, b = np.concatenate(parts_of[::2]), np.concatenate(parts_of[1::2])
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        if (label[a] == label[b]).all():
            break
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the stored ``edges`` (a, b): label is the smallest node reachable.

    Every task first replaces about ``EDGES`` edges by stars, so few and flat edges are left; where that is
    one task, they are the answer. Otherwise every round moves a node to the smallest label among its
    neighbours and to that label's own label, so a path of n nodes ends after about log n rounds. Counts
    alone come to the driver.
    """
    tasks = edges.count() // EDGES + 1
    stars = edges.select("a", "b").coalesce(tasks).mapInArrow(_forest, "a long, b long")
    if tasks == 1:
        return stored(stars.toDF("node", "label"), "labels")
    stars = stored(stars, "stars")
    both = stored(stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    done = [stars, both]
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
                    .select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        near = (both.hint("merge").join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low")))
        step = stored(labels.hint("merge").join(near, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", "low").alias("label")), "step")
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        done += [labels, step]
        labels = stored(step.hint("merge").join(jump, "label", "left").select(
            "node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "jump")
        if labels.where("old <> label").isEmpty():
            forget(*done)
            return labels
