"""Incremental refresh of the anonymized cache."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldcheck.constants import SOURCE_ZONE, WANTED_COLUMNS
from fieldcheck.operators.filters import filter_days
from fieldcheck.operators.reshape import distinct_rows
from fieldcheck.operators.schema import quoted
from fieldcheck.plans.facility import with_times
from fieldcheck.plans.privacy import Audited, Leak, Salts, anonymize
from fieldcheck.sources.readers import scan_minimal
from fieldcheck.sources.versions import VISITS, Conflict, Fetched, Version, VersionedTables, new_run

FIRST_DAY = dt.date(2025, 9, 1)


def read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """The published visits, or None before the first refresh. Any other failure is raised."""
    return VersionedTables(spark, path).read(VISITS)


def cached_days(spark: SparkSession, path: str) -> list[dt.date]:
    """The days that hold visits, ascending, from the manifest: no folder is listed, no file opened."""
    return VersionedTables(spark, path).version().days(VISITS)


def source_version(source: DataFrame) -> str:
    """A text that changes with the source: its plan and the names of its files.

    Only the plan is looked at, no row is read. Files that are rewritten under their old names are not
    noticed, and sources without files differ from session to session; a warehouse's own snapshot id is
    better where there is one.
    """
    files = sorted(source.inputFiles())
    own = "" if files else source.sparkSession.sparkContext.applicationId
    return hashlib.sha256("\n".join([own, str(source.semanticHash()), *files]).encode()).hexdigest()


def days_to_fetch(
    cached: Iterable[dt.date], start: dt.date, today: dt.date, reload_days: int = 1,
    seen: Iterable[dt.date] = (),
) -> list[dt.date]:
    """Every day that the cache lacks, and the last ``reload_days`` calendar days up to its last one.

    A facility that uploads a late day early does not lock the others out: days without
    visits are fetched whatever the last cached day is. ``seen`` are the days that were already fetched
    from this very version of the source, with or without visits: they cannot hold anything new.
    """
    held, seen = {d for d in cached if start <= d <= today}, set(seen)
    days = [start + dt.timedelta(days=i) for i in range((today - start).days + 1)]
    again = max(held) - dt.timedelta(days=reload_days) if held else None
    return [d for d in days if d not in seen and (d not in held or (d > again and d <= max(held)))]


def fetch(
    source: DataFrame, days: Sequence[dt.date], salts: Salts, zone: str = SOURCE_ZONE
) -> DataFrame:
    """Anonymized visits of the days."""
    visits = with_times(scan_minimal(source, WANTED_COLUMNS, ()), zone)
    visits = filter_days(visits, min(days), max(days)).filter(F.col("day").isin(list(days)))
    return anonymize(visits, salts)


def fingerprint(columns: Sequence[str]) -> Column:
    """A digest of a whole row; NULL and text are told apart."""
    return F.sha2(F.concat_ws("\u001f", *[
        F.coalesce(F.concat(F.lit("v"), quoted(c).cast("string")), F.lit("n")) for c in columns]), 256)


def unseen_rows(
    fresh: DataFrame, cache: DataFrame | None, keys: Sequence[str] | None = None
) -> DataFrame:
    """Distinct fresh rows that the cache does not hold, compared whole or by ``keys``.

    Whole rows are compared by day and fingerprint. Copies are removed first, task by task, so
    that many copies of one row never meet in the join, which reuses their partitioning and order; of
    the stored rows only day and fingerprint are shuffled. Both joins are merges: the files of a cache
    are far smaller than the fingerprints of its rows, so that Spark would send all of them to every task.
    """
    if keys:
        distinct = distinct_rows(fresh, keys)
        return distinct if cache is None else distinct.join(cache.select(*keys).hint("merge"), list(keys), "left_anti")
    same = fingerprint(fresh.columns).alias("_row")
    distinct = fresh.select("*", same).dropDuplicates(["day", "_row"])
    if cache is not None:
        distinct = distinct.join(cache.select("day", same).hint("merge"), ["day", "_row"], "left_anti")
    return distinct.drop("_row")


def add_visits(
    store: VersionedTables, base: Version, fresh: DataFrame, summaries: Mapping[str, Callable[[DataFrame], DataFrame]],
    fetched: Sequence[dt.date] = (), source: str = "", batches: Mapping[str, int] | None = None,
) -> Version:
    """Stages visits and the summaries of what was added, and publishes both with the ledger.

    The audit is counted while the visits are written; on a violation they are deleted and ``Leak`` is raised.
    Readers see all of the new version or the old one.
    """
    run, at = new_run(), dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    audited = Audited(fresh)
    try:
        added = store.stage(audited.df, run)
        # Where no row is left Spark may drop the node that counts: then there is nothing to audit either.
        if added:
            audited.require_clean()
        schemas, parts = {VISITS: fresh.schema}, list(added)
        for table, part_of in summaries.items():
            part = part_of(store.rows_of(added, VISITS, fresh.schema))
            schemas[table] = part.schema
            parts += store.stage(part, run, table) if added else []
        rows: dict[dt.date, int] = {}
        for p in [*base.of(VISITS, fetched), *added]:
            rows[p.day] = rows.get(p.day, 0) + p.rows
        entries = {d: Fetched(at, rows.get(d, 0), source) for d in fetched}
        return store.publish(base, parts, schemas, entries, batches)
    except (Leak, Conflict):
        store.discard(run)
        raise


def incremental_refresh(
    spark: SparkSession, source: DataFrame, path: str, salts: Salts, today: dt.date,
    start: dt.date = FIRST_DAY, reload_days: int = 1, keys: Sequence[str] | None = None,
    zone: str = SOURCE_ZONE, version: str | None = None,
    summaries: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None, attempts: int = 10,
) -> DataFrame:
    """Fetch the days the cache lacks, anonymize, publish what is new; returns the cache.

    Days without visits are fetched whatever the last cached day is; ``reload_days`` says
    how many days up to the last cached one are looked at again, to admit rows that came late
    (1: the last day itself). Only these are compared with the cache, whose other days are not
    listed. Rows already stored are never stored again, so a rerun changes nothing.

    The ledger says which days were fetched from which ``version`` of the source (by default
    ``source_version``). A day is not asked for twice of one version, so a second run over an unchanged
    source reads no row of it, whether its days are empty or not.

    ``summaries`` (such as ``summaries.SUMMARIES``) are kept next to the visits; a cache that starts with
    them must be refreshed with them.

    If another refresh publishes in between, this one starts again from what that one stored: two
    refreshes at once leave one copy of each row.
    """
    store, version = VersionedTables(spark, path), version or source_version(source)
    for _ in range(attempts):
        base = store.version()
        seen = [d for d, f in base.fetched.items() if f.source == version]
        days = days_to_fetch(base.days(VISITS), start, today, reload_days, seen)
        if not days:
            return store.read(VISITS, version=base)
        again = sorted(set(days) & set(base.days(VISITS)))
        held = store.read(VISITS, again, base) if again else None
        try:
            new = add_visits(store, base, unseen_rows(fetch(source, days, salts, zone), held, keys), summaries or {}, days, version)
            return store.read(VISITS, version=new)
        except Conflict:
            continue
    raise Conflict(path)
