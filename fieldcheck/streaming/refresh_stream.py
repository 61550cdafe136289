"""Refresh of the anonymized cache from a folder that uploads keep arriving in."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from fieldcheck.constants import SOURCE_ZONE
from fieldcheck.plans.facility import with_times
from fieldcheck.plans.privacy import Salts, anonymize
from fieldcheck.plans.refresh import add_visits, fingerprint, unseen_rows
from fieldcheck.sources.versions import VISITS, Conflict, VersionedTables

Summaries = Mapping[str, Callable[[DataFrame], DataFrame]]


def upload_stream(
    spark: SparkSession, folder: str, schema: T.StructType, file_format: str = "parquet",
    max_files: int = 1000,
) -> DataFrame:
    """New upload files of a folder, ``max_files`` per micro-batch."""
    reader = spark.readStream.format(file_format).schema(schema)
    return reader.option("maxFilesPerTrigger", max_files).load(folder)


def store_batch(
    batch: DataFrame, path: str, stream: str, number: int, keys: Sequence[str] | None = None,
    compare: bool = True, summaries: Summaries | None = None, attempts: int = 10,
) -> None:
    """Publish the anonymized visits of a micro-batch, as one version of the cache.

    The version records the batch's number, so a batch that is replayed after a failure finds itself
    published and does nothing. With ``compare`` the rows that the cache holds already are left out; only
    the batch's own days are read back. The batch is computed once and kept for its two uses; a lost
    executor's part of it is computed again.
    """
    store = VersionedTables(batch.sparkSession, path)
    if compare:
        batch.persist()
    try:
        # One row per day of a micro-batch.
        days = {r["day"] for r in batch.select("day").distinct().collect()} if compare else set()
        for _ in range(attempts):
            base = store.version()
            if base.batches.get(stream, -1) >= number:
                return
            held = days & set(base.days(VISITS))
            seen = store.read(VISITS, held, base) if held else None
            try:
                add_visits(store, base, unseen_rows(batch, seen, keys) if compare else batch, summaries or {}, batches={stream: number})
                return
            except Conflict:
                continue
        raise Conflict(path)
    finally:
        if compare:
            batch.unpersist()


def without_copies(fresh: DataFrame, horizon: str, keys: Sequence[str] | None = None) -> DataFrame:
    """Streaming rows, each once, remembered in the state store for ``horizon``.

    Time is that of the visit, but never later than now: a junk date far ahead must not make every other
    row late. A row's key (its ``keys``, or a digest of all of it) leaves the state once the watermark,
    the latest visit less ``horizon``, has passed it; the state is bounded by the rows of that span.
    """
    seen = F.coalesce("tanggal_ts", F.col("day").cast("timestamp"))
    timed = fresh.withColumn("_seen_at", F.least(seen, F.current_timestamp()))
    if not keys:
        timed = timed.withColumn("_row", fingerprint(fresh.columns))
    kept = timed.withWatermark("_seen_at", horizon).dropDuplicatesWithinWatermark(list(keys or ["_row"]))
    return kept.drop("_seen_at", "_row")


def refresh_stream(
    stream: DataFrame, path: str, checkpoint: str, salts: Salts,
    keys: Sequence[str] | None = None, zone: str = SOURCE_ZONE, horizon: str | None = None,
    summaries: Summaries | None = None,
) -> DataStreamWriter:
    """Writer that anonymizes every micro-batch into the cache and stops when caught up.

    Without ``horizon`` rows are compared with the stored day they belong to: late days need no watermark
    and no state grows with the stream, but stored days are read for every micro-batch.

    With ``horizon`` (such as ``"7 days"``) copies are told by keyed state and no stored row is read. A row
    whose visit is older than the watermark is late: it is not stored by the stream, as its key may have
    been forgotten, and ``late_rows`` counts it. The daily ``incremental_refresh`` with as many
    ``reload_days`` admits it. Copies of one row further apart than ``horizon`` are late as well, so no
    row is ever stored twice. Use this mode for a cache that the stream alone, or the stream and such
    a refresh, writes to.
    """
    # A micro-batch is a few files and so a few tasks; its raw rows are dealt to all cores before they are cleaned.
    dealt = stream.repartition(stream.sparkSession.sparkContext.defaultParallelism)
    fresh = anonymize(with_times(dealt, zone), salts).filter("day IS NOT NULL")
    fresh = without_copies(fresh, horizon, keys) if horizon else fresh

    def store(batch: DataFrame, number: int) -> None:
        store_batch(batch, path, checkpoint, number, keys, not horizon, summaries)

    return (
        fresh.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query's recent batches found older than the watermark."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def state_rows(query: StreamingQuery) -> int:
    """Keys in the state after the last batch."""
    last = query.lastProgress
    return sum(s["numRowsTotal"] for s in last["stateOperators"]) if last else 0
