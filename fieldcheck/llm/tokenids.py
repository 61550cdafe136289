"""Token ids in files of fixed-width bit packing, with block offsets for random access.

Texts are ordered by doc_id across the cluster, then encoded with the tokenizers library and written by
one task per key range. Every id takes ``bits`` bits, the fewest that hold the vocabulary. A file holds the
packed blocks (``BLOCK`` ids each), then doc_ids, token counts, block offsets and a fixed-size trailer.
Blocks start at whole bytes; unpacking reads one unaligned 64-bit word per id, so any id is found from
its number alone. Only files named by successful tasks are read, so retries and lost executors are safe.

Defined results: a null text is empty and holds the end id alone; rows with the same doc_id keep separate
entries, ordered by the hash of their text; null doc_ids come first and stay null. Extra columns are
ignored. An empty table writes no file and gives no rows.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcheck.llm.common import NULL_ID, parts, shared_dir, slices
from fieldcheck.llm.pieces import Encoder, plain

BLOCK = 4096
MAGIC = b"FCIDS001"
_TRAILER = "<QQIQQ8s"  # documents, ids, bits, blocks, byte where the tables begin, magic
END_ID = 0


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    shift = np.arange(bits, dtype=np.uint32)
    return np.packbits(((ids[:, None] >> shift) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: np.ndarray, bits: int, index: np.ndarray) -> np.ndarray:
    """The ids number ``index`` of a packed block; ``data`` has eight spare bytes at its end."""
    at = index * bits
    lanes = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    word = lanes[at >> 3] >> (at & 7).astype(np.uint64)
    return (word & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Writer:
    """Appends documents to a stream, block by block."""

    def __init__(self, out, bits: int):
        self.out, self.bits, self.at = out, bits, 0
        self.rest, self.blocks, self.docs, self.sizes = np.zeros(0, np.uint32), [], [], []

    def add(self, doc_ids: list[int], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(np.asarray(doc_ids, np.int64))
        self.sizes.append(np.asarray(sizes, np.int64))
        self.rest = np.concatenate([self.rest, ids])
        full = len(self.rest) // BLOCK * BLOCK
        for i in range(0, full, BLOCK):
            self._block(self.rest[i:i + BLOCK])
        self.rest = self.rest[full:]

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.blocks.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> tuple[int, int]:
        if len(self.rest):
            self._block(self.rest)
        docs = np.concatenate(self.docs) if self.docs else np.zeros(0, np.int64)
        sizes = np.concatenate(self.sizes) if self.sizes else np.zeros(0, np.int64)
        self.out.write(docs.astype("<i8").tobytes() + sizes.astype("<i8").tobytes()
                       + np.asarray(self.blocks, "<i8").tobytes())
        self.out.write(struct.pack(_TRAILER, len(docs), int(sizes.sum()), self.bits, len(self.blocks), self.at, MAGIC))
        return len(docs), int(sizes.sum())


class Reader:
    """Random access to the ids of a file's bytes."""

    def __init__(self, content: bytes):
        n, self.total, self.bits, blocks, tables, magic = struct.unpack(_TRAILER, content[-struct.calcsize(_TRAILER):])
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        self.data = np.frombuffer(content, np.uint8)
        self.doc_id = np.frombuffer(content, "<i8", n, tables)
        self.size = np.frombuffer(content, "<i8", n, tables + 8 * n)
        self.block = np.frombuffer(content, "<i8", blocks, tables + 16 * n)
        self.first = np.cumsum(self.size) - self.size

    def ids(self, first: int, n: int) -> np.ndarray:
        """``n`` ids from number ``first`` of the file; only their blocks are touched."""
        out = []
        while n:
            k, i = divmod(first, BLOCK)
            take = min(n, BLOCK - i)
            bytes_of = -(-BLOCK * self.bits // 8)
            block = self.data[self.block[k]:self.block[k] + bytes_of + 8]
            if len(block) < bytes_of + 8:
                block = np.concatenate([block, np.zeros(8, np.uint8)])
            out.append(unpack(block, self.bits, np.arange(i, i + take)))
            first, n = first + take, n - take
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def document(self, d: int) -> np.ndarray:
        return self.ids(int(self.first[d]), int(self.size[d]))


def library_encoder(path: str) -> Encoder:
    """Encodes texts by chunks with the tokenizers library; plain ones in long runs between line ends."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    special = tuple(t.content for t in tok.get_added_tokens_decoder().values())
    line = tok.encode("a\nb", add_special_tokens=False).ids[1]

    def encode(new: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        flags = [plain(c, special) for c in new]
        run = [c for c, f in zip(new, flags) if f]
        rest = [c for c, f in zip(new, flags) if not f]
        done, ids, sizes = [], [], []
        groups = [run[at:at + 256] for at in range(0, len(run), 256)]
        for group, e in zip(groups, tok.encode_batch_fast(["\n".join(g) for g in groups], add_special_tokens=False)):
            got = np.asarray(e.ids, np.uint32)
            cut = np.flatnonzero(got == line)
            if len(cut) == len(group) - 1:
                done += group
                ids.append(np.delete(got, cut))
                sizes.append(np.diff(cut, prepend=-1, append=len(got)) - 1)
            else:
                rest += group
        for e in tok.encode_batch_fast(rest, add_special_tokens=False):
            ids.append(np.asarray(e.ids, np.uint32))
            sizes.append(np.array([len(e.ids)]))
        return done + rest, np.concatenate(ids), np.concatenate(sizes)

    return Encoder(encode, special)


_ENCODERS: dict[str, Encoder] = {}


def shared_encoder(path: str) -> Encoder:
    """The encoder of this worker process, with the chunks it remembers from earlier tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = library_encoder(path)
    return _ENCODERS[path]


def vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each document, and the new bounds."""
    bounds = ends + np.arange(len(ends))
    out = np.full(bounds[-1], end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[bounds[1:] - 1] = False
    out[keep] = ids
    return out, bounds


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID,
              partitions: int | None = None) -> list[tuple[int, str, int, int]]:
    """Writes the files of a corpus; returns (number, path, documents, ids) of each, in doc_id order.

    One row per file comes to the driver, and files grow with the partition size, not with the corpus.
    """
    bits, fs_folder = bits_for(vocabulary(tokenizer)), f"{folder}/ids-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(fs_folder)
        path, out, w = f"{root}/{ctx.partitionId():06d}-{ctx.taskAttemptId()}.ids", None, None
        enc = shared_encoder(tokenizer)
        for b in slices(batches):
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(path)
                w = Writer(out, bits)
            ids, at = with_end(*enc(b.column("text")), end_id)
            w.add(b.column("doc_id").fill_null(NULL_ID).to_numpy(), np.diff(at), ids)
        if out is not None:
            n, total = w.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([ctx.partitionId()], pa.int32()), pa.array([path.rsplit("/", 1)[1]]),
                                              pa.array([n], pa.int64()), pa.array([total], pa.int64())],
                                             ["shard", "file", "docs", "ids"])

    # The ranges are found by a look at the ids; texts are encoded once, where they are written.
    keyed = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
             .withColumn("tie", F.xxhash64("text")))
    files = (keyed.repartitionByRange(partitions or parts(docs), F.asc_nulls_first("doc_id"), "tie")
             .sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie")
             .mapInArrow(write, "shard int, file string, docs long, ids long").collect())
    return [(r.shard, f"{fs_folder}/{r.file}", r.docs, r.ids) for r in sorted(files)]


def read_ids(spark: SparkSession, files: list[tuple[int, str, int, int]]) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    total, starts = 0, {}
    for _, path, _, n in files:
        starts[path.rsplit("/", 1)[1]] = total
        total += n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                r = Reader(content.as_py())
                ids = r.ids(0, r.total)
                crc = [zlib.crc32(ids[a:a + n].astype("<u4").tobytes()) for a, n in zip(r.first, r.size)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(r.doc_id, pa.int64(), mask=r.doc_id == NULL_ID), pa.array(starts[path.rsplit("/", 1)[1]] + r.first),
                    pa.array(r.size), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    folder = files[0][1].rsplit("/", 1)[0]
    names = {p.rsplit("/", 1)[1] for _, p, _, _ in files}
    found = spark.read.format("binaryFile").load(folder).select("path", "content")
    keep = F.element_at(F.split("path", "/"), -1).isin(sorted(names))
    return found.where(keep).mapInArrow(read, schema)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Encodes ``docs`` into files of the shared folder and describes every document read back."""
    return read_ids(docs.sparkSession, write_ids(docs, tokenizer, shared_dir(docs.sparkSession), end_id))
