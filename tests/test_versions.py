"""All-or-nothing publication, the ledger, the audit gate and the kept summaries."""

import datetime as dt
import os
import threading

import pytest
from pyspark.sql import functions as F

from fieldcheck.constants import CLINICAL_VARS, WANTED_COLUMNS
from fieldcheck.operators.ranking import latest_file_per_day
from fieldcheck.operators.schema import apply_schema
from fieldcheck.operators.aggregates import max_day
from fieldcheck.operators.filters import latest_date_only
from fieldcheck.operators.scope import Scope, available_days, resolve_day, scope_frame
from fieldcheck.functions.times import usable_file_time
from fieldcheck.plans import heaping as H, refresh as RF
from fieldcheck.plans.privacy import Audited, Leak, Salts, pii_audit
from fieldcheck.plans.refresh import cached_days, incremental_refresh, read_cache
from fieldcheck.plans.summaries import SUMMARIES, Summaries
from fieldcheck.sources import versions as V
from tests.conftest import rows

SALTS = Salts("a", "b", "c", "d")
START = dt.date(2025, 9, 1)


def day(n):
    return dt.date(2025, 9, n)


def uploads(spark, visits):
    """Visits as (day of September, file, weight, name)."""
    df = spark.createDataFrame([(f"2025-09-{d:02d} 08:00:00", f, w, n) for d, f, w, n in visits],
                               "tanggal string, file_name string, berat_badan string, diagnosa_1 string")
    rest = [c for c in WANTED_COLUMNS if c not in df.columns]
    return df.withColumns({c: F.lit("P" if c == "puskesmas_name" else None).cast("string") for c in rest}).select(*WANTED_COLUMNS)


def simple(spark, days, tag="x"):
    return uploads(spark, [(d, "f.xlsx", "70", f"{tag}{d}") for d in days])


def names(spark, path):
    return sorted(r["diagnosa_1"] for r in read_cache(spark, path).collect())


class Counted:
    """A source that counts the records that are read from it."""

    def __init__(self, spark, df):
        self.read = spark.sparkContext.accumulator(0)
        count = self.read

        def seen(row):
            count.add(1)
            return row

        self.df = spark.createDataFrame(df.rdd.map(seen), df.schema)


def test_unchanged_source_is_not_read_again(spark, tmp_path):
    path = str(tmp_path / "cache")
    source = Counted(spark, simple(spark, [1, 3]))
    incremental_refresh(spark, source.df, path, SALTS, day(6), START)
    assert source.read.value == 2
    for _ in range(2):  # days 2, 4, 5 and 6 are empty and stay so
        assert incremental_refresh(spark, source.df, path, SALTS, day(6), START, reload_days=4).count() == 2
    assert source.read.value == 2
    incremental_refresh(spark, source.df, path, SALTS, day(7), START)  # only the new day is asked for
    got = {r["day"]: (r["rows"], r["source"]) for r in V.ledger(spark, path).collect()}
    assert {d.day: n for d, (n, _) in got.items()} == {1: 1, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0, 7: 0}
    assert len({s for _, s in got.values()}) == 1


def test_changed_source_is_asked_for_empty_days(spark, tmp_path):
    path = str(tmp_path / "cache")
    incremental_refresh(spark, simple(spark, [1, 3]), path, SALTS, day(5), START, version="v1")
    late = simple(spark, [1, 3]).union(simple(spark, [1, 2, 4], "late"))
    incremental_refresh(spark, late, path, SALTS, day(5), START, version="v2")
    assert names(spark, path) == ["late2", "late4", "x1", "x3"]
    assert [d.day for d in cached_days(spark, path)] == [1, 2, 3, 4]
    count = {r["day"].day: (r["rows"], r["source"]) for r in V.ledger(spark, path).collect()}
    assert count == {1: (1, "v1"), 2: (1, "v2"), 3: (1, "v2"), 4: (1, "v2"), 5: (0, "v2")}


def test_source_version_follows_files_and_plan(spark, tmp_path):
    path = str(tmp_path / "src")
    spark.range(5).write.parquet(path)
    first = RF.source_version(spark.read.parquet(path))
    assert first == RF.source_version(spark.read.parquet(path))
    assert first != RF.source_version(spark.read.parquet(path).filter("id > 1"))
    spark.range(5).write.mode("append").parquet(path)
    assert first != RF.source_version(spark.read.parquet(path))


@pytest.mark.parametrize("at", ["stage", "publish", "_create"])
def test_a_killed_refresh_leaves_the_old_cache(spark, tmp_path, monkeypatch, at):
    path = str(tmp_path / "cache")
    incremental_refresh(spark, simple(spark, [1]), path, SALTS, day(1), START, summaries=SUMMARIES)
    real = getattr(V.VersionedTables, at)

    def dies(self, *args, **kw):
        if at == "stage":
            real(self, *args, **kw)
        raise KeyboardInterrupt

    monkeypatch.setattr(V.VersionedTables, at, dies)
    with pytest.raises(KeyboardInterrupt):
        incremental_refresh(spark, simple(spark, [1, 2]), path, SALTS, day(2), START, summaries=SUMMARIES)
    monkeypatch.setattr(V.VersionedTables, at, real)
    assert names(spark, path) == ["x1"] and [d.day for d in cached_days(spark, path)] == [1]
    assert Summaries(V.VersionedTables(spark, path)).files().count() == 1
    incremental_refresh(spark, simple(spark, [1, 2]), path, SALTS, day(2), START)
    assert names(spark, path) == ["x1", "x2"]


def test_two_refreshes_at_once_store_one_copy(spark, tmp_path, monkeypatch):
    path, source = str(tmp_path / "cache"), simple(spark, [1, 2, 3])
    both, waited = threading.Barrier(2), threading.local()
    real, failed = V.VersionedTables.publish, []

    def together(self, *args, **kw):
        if not getattr(waited, "done", False):
            waited.done = True
            both.wait(60)
        return real(self, *args, **kw)

    monkeypatch.setattr(V.VersionedTables, "publish", together)

    def go():
        try:
            incremental_refresh(spark, source, path, SALTS, day(3), START)
        except Exception as e:  # noqa: BLE001 - shown below
            failed.append(e)

    threads = [threading.Thread(target=go) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and names(spark, path) == ["x1", "x2", "x3"]
    # The loser's files are gone.
    runs = {p.run for p in V.VersionedTables(spark, path).version().parts}
    assert {n for n in os.listdir(f"{path}/visits") if n.startswith("run=")} == {f"run={r}" for r in runs}


def test_a_version_number_is_taken_once(spark, tmp_path):
    store = V.VersionedTables(spark, str(tmp_path / "t"))
    base = store.version()
    store.publish(base, [], {}, batches={"a": 1})
    with pytest.raises(V.Conflict):
        store.publish(base, [], {}, batches={"b": 1})
    assert store.version().batches == {"a": 1} and store.numbers() == [1]
    assert [n for n in os.listdir(tmp_path / "t/_versions") if n.endswith(".tmp")] == []


def test_old_versions_stay_readable_until_vacuumed(spark, tmp_path):
    path = str(tmp_path / "t")
    store = V.VersionedTables(spark, path)
    for x in (1, 2, 3):
        V.replace_days(spark.createDataFrame([(day(1), x), (None, x)], "day date, x int"), path)
    assert rows(store.read(version=store.version(1))) == [(None, 1), (day(1), 1)]
    assert rows(store.read()) == [(None, 3), (day(1), 3)]
    assert store.read(days=[day(2)]).count() == 0 and store.version().days() == [day(1)]
    assert store.vacuum(keep=2) == []  # too young to be touched
    assert len(store.vacuum(keep=2, older_than=dt.timedelta(seconds=-5))) == 1
    assert store.numbers() == [2, 3] and rows(store.read()) == [(None, 3), (day(1), 3)]
    assert store.read("none") is None


def test_a_leak_is_never_published(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    incremental_refresh(spark, simple(spark, [1]), path, SALTS, day(1), START)
    bad = simple(spark, [2]).union(uploads(spark, [(3, "f.xlsx", "70", "NIK 4785380592391139")]))
    with pytest.raises(Leak) as e:
        incremental_refresh(spark, bad, path, SALTS, day(3), START)
    assert e.value.violations == [("digit_run", "diagnosa_1", 1)]
    assert names(spark, path) == ["x1"]
    assert len([n for n in os.listdir(f"{path}/visits") if n.startswith("run=")]) == 1  # the leak is not left on disk


def test_observed_audit_equals_the_scan(spark):
    df = spark.createDataFrame([("••••1234", "4785380592391139", "x" * 64), ("12", None, "0" * 64)], "nik_masked string, a string, nik_hash string")
    audited = Audited(df)
    audited.df.write.format("noop").mode("overwrite").save()
    assert audited.counts() == [(r["check"], r["column"], r["violations"]) for r in pii_audit(df).collect()]
    empty = Audited(df.limit(0), (), ())
    empty.df.write.format("noop").mode("overwrite").save()
    empty.require_clean()


MANY = [(d, f"report 2025-09-{d:02d} {h:02d}_00_00.000.xlsx", w, f"n{w}")
        for d in (1, 2, 3) for h in (9, 10) for w in ("70", "75", "60,5", "61", "junk", "80")]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """A cache after inserts, a reload of late rows and a rerun."""
    path = str(tmp_path_factory.mktemp("kept") / "cache")
    early = [x for i, x in enumerate(MANY) if i % 3]
    incremental_refresh(spark, uploads(spark, early), path, SALTS, day(2), START, summaries=SUMMARIES)
    for _ in range(2):
        incremental_refresh(spark, uploads(spark, [*MANY, *MANY]), path, SALTS, day(3), START, reload_days=9, summaries=SUMMARIES)
    return path


@pytest.fixture
def no_visits(monkeypatch):
    """Fails when visits are read."""
    real = V.VersionedTables.rows_of

    def guarded(self, parts, table, schema):
        assert table != V.VISITS, "visits were read"
        return real(self, parts, table, schema)

    monkeypatch.setattr(V.VersionedTables, "rows_of", guarded)


def test_heaping_from_counts(spark, kept, no_visits, monkeypatch):
    kept_tables = Summaries(V.VersionedTables(spark, kept))
    daily, window = rows(kept_tables.heaping_daily()), rows(kept_tables.heaping_window())
    chosen = rows(kept_tables.heaping_daily(files=kept_tables.latest_files(day(1), day(3))))
    one = rows(kept_tables.heaping_daily(days=[day(2)], facility="p"))
    monkeypatch.undo()
    visits = read_cache(spark, kept)
    assert visits.count() == len(MANY)
    long = H.heaping_long(apply_schema(visits).withColumn("Tanggal", F.col("day")), CLINICAL_VARS)
    assert daily == rows(H.heaping_daily(long)) and window == rows(H.heaping_window(long))
    assert one == rows(H.heaping_daily(long.filter("Tanggal = '2025-09-02'"))) and len(one) == 1
    last = apply_schema(visits.filter("file_name LIKE '% 10_00_00%'")).withColumn("Tanggal", F.col("day"))
    assert chosen == rows(H.heaping_daily(H.heaping_long(last, CLINICAL_VARS)))


def test_files_from_the_index(spark, kept, no_visits, monkeypatch):
    tables = Summaries(V.VersionedTables(spark, kept))
    found = rows(tables.latest_files(day(1), day(3)))
    monkeypatch.undo()
    visits = read_cache(spark, kept).withColumn("file_ts_fallback", usable_file_time("file_ts", "tanggal_ts"))
    assert found == rows(latest_file_per_day(visits, day(1), day(3))) and len(found) == 3
    assert rows(tables.files().select("day", "file_name", "visits")) == rows(
        visits.groupBy("day", "file_name").agg(F.count(F.lit(1)).alias("visits")))
    for scope in (Scope("week", day(2)), Scope("day", day(9)), Scope("range_pair", day(2), day(2), day(3))):
        assert rows(scope_frame(visits, scope, index=tables.files())) == rows(scope_frame(visits, scope))


def test_distinct_from_sketches(spark, kept, no_visits, monkeypatch):
    tables = Summaries(V.VersionedTables(spark, kept))
    got = dict(rows(tables.distinct()))
    day_two = dict(rows(tables.distinct(days=[day(2)])))
    assert got["diagnosa_1"] == 6 and got["file_name"] == 6 and day_two["file_name"] == 2
    assert "nik_hash" not in got  # no visit has one


def test_summaries_are_optional(spark, tmp_path):
    path = str(tmp_path / "cache")
    incremental_refresh(spark, simple(spark, [1]), path, SALTS, day(1), START)
    assert names(spark, path) == ["x1"]
    with pytest.raises(ValueError):
        Summaries(V.VersionedTables(spark, path)).files()


def _no_file(df):
    """Whether a plan opens no file at all."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return "FileScan" not in text and not df.inputFiles()


def test_known_days_open_no_file(spark, tmp_path):
    path = str(tmp_path / "known")
    df = spark.createDataFrame([(d, f"v{i}") for i, d in enumerate([day(1), day(1), day(4), day(9), None])], "day date, v string")
    V.replace_days(df, path)
    V.replace_days(spark.createDataFrame([(day(4), "a"), (day(4), "b"), (day(4), "c")], df.schema), path)
    cache, days = read_cache(spark, path), V.VersionedTables(spark, path).day_rows()
    assert rows(days.orderBy("day")) == [(day(1), 2), (day(4), 3), (day(9), 1)]
    for got, same in [(max_day(cache, known=days), max_day(cache)), (available_days(cache, known=days), available_days(cache)),
                      *((resolve_day(cache, x, days), resolve_day(cache, x)) for x in (day(2), day(4), day(7), dt.date(2031, 1, 1)))]:
        assert _no_file(got) and not _no_file(same)
        assert rows(got) == rows(same)


def test_last_known_day_prunes_the_others(spark, tmp_path):
    path = str(tmp_path / "last")
    df = spark.createDataFrame([(day(d), f"{d}-{i}") for d in (1, 2, 3) for i in range(d)], "day date, v string")
    V.replace_days(df, path)
    cache, days = read_cache(spark, path), V.VersionedTables(spark, path).day_rows()
    for d in (1, 2):  # any use of another day's file would fail
        for root, _, files in os.walk(path):
            if root.endswith(f"day={day(d)}"):
                for f in files:
                    open(os.path.join(root, f), "wb").close()
    last = latest_date_only(cache, "day", known=days)
    assert sorted(r["v"] for r in last.collect()) == ["3-0", "3-1", "3-2"]
    assert "day#" in last._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:60]


def test_known_days_of_empty_tables(spark, tmp_path):
    store = V.VersionedTables(spark, str(tmp_path / "none"))
    days = store.day_rows()
    assert rows(days) == []
    df = spark.createDataFrame([], "day date, file_name string, file_ts_fallback timestamp")
    assert rows(max_day(df, known=days)) == [(None,)]
    assert rows(available_days(df, days)) == [] and rows(resolve_day(df, day(1), days)) == [(None,)]
    assert rows(latest_date_only(df, "day", days)) == []
    assert rows(scope_frame(df, Scope("week", day(1)), known=days)) == []
