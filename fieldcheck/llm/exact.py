"""Exact de-duplication by distributed MSD radix partitioning.

Texts are compared after all ASCII white space is deleted. A task first splits the rows it holds by
successive runs of bytes and keeps one representative of every group of equal texts, so a group that
holds a third of the corpus leaves each slice as a single row. The representatives are then split
across the cluster: round by round the next bytes of every text refine the groups, a group of one row
is done, and a group whose texts end is a group of copies. Runs of bytes grow from round to round
(``FIRST`` bytes, then ``GROWTH`` times as many), so long texts need few rounds. Equality never relies
on a digest; the digest of the result is output only.

Defined results: a null text is an empty text; empty texts (and texts of white space only) are equal
to each other; rows that repeat a doc_id are separate rows; a null doc_id sorts before all others.
Columns other than doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcheck.llm.common import SPACED, forget, only, slices, stored, text_bytes, through

FIRST = 64
GROWTH = 8

_LOCAL = ("rid long, doc_id long, th long, n_points long, text_sha256 string, rep long, copies long, "
          "head binary, body binary")


def split(texts: list[bytes], rows: list[int], at: int = 0, run: int = FIRST) -> Iterator[list[int]]:
    """Groups of rows with equal texts: split by the next run of bytes until single or ended."""
    todo = [(rows, at, run)]
    while todo:
        rows, at, run = todo.pop()
        groups: dict[bytes, list[int]] = {}
        for r in rows:
            groups.setdefault(texts[r][at:at + run], []).append(r)
        for piece, same in groups.items():
            if len(same) == 1 or len(piece) < run:
                yield same
            else:
                todo.append((same, at + run, run * GROWTH))


def without_blanks(text: pa.Array) -> list[bytes]:
    data, at = text_bytes(text)
    keep = through(data, SPACED).view(bool)
    ends = np.concatenate([[0], np.cumsum(keep)])[at]
    packed = data[keep].tobytes()
    return [packed[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rid = TaskContext.get().partitionId() << 33
    for b in slices(batches):
        ids, text = b.column("doc_id"), b.column("text")
        points = pc.fill_null(pc.utf8_length(text), 0).to_pylist()
        texts, doc = without_blanks(text), ids.to_pylist()
        rep, copies = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for same in split(texts, list(range(len(texts)))):
            best = min(same, key=lambda r: (-points[r], doc[r] is not None, doc[r] or 0, r))
            rep[same], copies[best] = rid + best, len(same)
        head = [t[:FIRST] if c else None for t, c in zip(texts, copies)]
        body = [t[FIRST:] if c else None for t, c in zip(texts, copies)]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(rid, rid + len(texts))), ids, b.column("th"), pa.array(points, pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(rep), pa.array(copies),
            pa.array(head, pa.binary()), pa.array(body, pa.binary()),
        ], names=["rid", "doc_id", "th", "n_points", "text_sha256", "rep", "copies", "head", "body"])
        rid += len(texts)


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    return _groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with its own columns, one row of every group of equal texts."""
    return only(docs, _groups(docs).where("kept"))


def _groups(docs: DataFrame) -> DataFrame:
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("th"))
                  .mapInArrow(_local, _LOCAL), "rows")
    reps = rows.where("copies > 0")
    # The first run of bytes needs no text; the rows that go on then carry theirs, ever shorter.
    active = reps.select("rid", F.lit(-1).cast("long").alias("gid"), F.col("head").alias("run"), F.lit(None).cast("binary").alias("body"))
    length, ended, done = FIRST, [], []
    while True:
        heads = active.groupBy("gid", "run").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("next")).where("n > 1")
        kept = active.hint("merge").join(heads, ["gid", "run"]).select(
            "rid", F.col("next").alias("gid"), (F.octet_length("run") < length).alias("over"), "body")
        kept = stored(kept, "split")
        done.append(kept)
        ended.append(kept.where("over").select("rid", "gid"))
        going = kept.where("NOT over").select("rid", "gid", "body")
        if going.isEmpty():
            break
        if length == FIRST:
            going = stored(going.drop("body").hint("merge").join(reps.select("rid", "body"), "rid"), "rest")
            done.append(going)
        length *= GROWTH
        active = going.select("rid", "gid", F.substring("body", 1, length).alias("run"),
                              F.expr(f"substring(body, {length + 1})").alias("body"))
    groups = ended[0]
    for e in ended[1:]:
        groups = groups.union(e)
    best = F.struct((-F.col("n_points")).alias("p"),
                    F.col("doc_id").isNotNull().alias("q"), F.col("doc_id").alias("d"), F.col("rid").alias("r"))
    members = groups.join(reps.select("rid", "doc_id", "n_points", "copies"), "rid")
    chosen = members.groupBy("gid").agg(F.min(best).alias("k"), F.sum("copies").alias("group_size"))
    by_rep = (groups.join(chosen, "gid").select(F.col("rid").alias("rep"), F.col("k.d").alias("g_id"),
                                                F.col("k.r").alias("g_rid"), "group_size"))
    alone = reps.select(F.col("rid").alias("rep"), F.col("doc_id").alias("rep_id"), "copies")
    reply = alone.join(by_rep, "rep", "left").select(
        "rep", F.when(F.col("g_rid").isNull(), F.col("rep_id")).otherwise(F.col("g_id")).alias("keep_id"),
        F.coalesce("g_rid", "rep").alias("keep_rid"), F.coalesce("group_size", "copies").alias("group_size"))
    out = stored(rows.select("rid", "doc_id", "th", "text_sha256", "rep").hint("merge").join(reply, "rep")
                 .select("doc_id", "th", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256"), "groups")
    forget(rows, *done)
    return out
