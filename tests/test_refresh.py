import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldcheck.constants import WANTED_COLUMNS
from fieldcheck.plans.facility import with_times
from fieldcheck.plans.privacy import Salts, anonymize
from fieldcheck.plans.refresh import cached_days, days_to_fetch, incremental_refresh, read_cache
from fieldcheck.streaming.refresh_stream import late_rows, refresh_stream, state_rows, store_batch, upload_stream

SALTS = Salts("a", "b", "c", "d")
START, TODAY = dt.date(2025, 9, 1), dt.date(2025, 9, 5)


def uploads(spark, days, tag="x"):
    df = spark.createDataFrame([(f"2025-09-{d:02d} 08:00:00", f"{tag}{d}") for d in days], "tanggal string, diagnosa_1 string")
    rest = [c for c in WANTED_COLUMNS if c not in df.columns]
    return df.withColumns({c: F.lit("P" if c == "puskesmas_name" else None).cast("string") for c in rest}).select(*WANTED_COLUMNS)


def stored(spark, path):
    return sorted(r["diagnosa_1"] for r in read_cache(spark, path).collect())


def test_refresh_adds_new_days_once(spark, tmp_path):
    path = str(tmp_path / "cache")
    incremental_refresh(spark, uploads(spark, [1, 2, 3]), path, SALTS, dt.date(2025, 9, 3), START)
    source = uploads(spark, [1, 2, 3, 4, 5]).union(uploads(spark, [2], "late")).union(uploads(spark, [5]))
    for _ in range(2):
        incremental_refresh(spark, source, path, SALTS, TODAY, START)
        assert stored(spark, path) == ["x1", "x2", "x3", "x4", "x5"]
    for _ in range(2):
        incremental_refresh(spark, source, path, SALTS, TODAY, START, reload_days=4)
        assert stored(spark, path) == ["late2", "x1", "x2", "x3", "x4", "x5"]


def test_days_after_today_wait(spark, tmp_path):
    path = str(tmp_path / "cache")
    out = incremental_refresh(spark, uploads(spark, [1, 9]), path, SALTS, TODAY, START)
    assert out.count() == 1


def test_keys_keep_equal_visits_apart(spark, tmp_path):
    path = str(tmp_path / "cache")
    source = uploads(spark, [1]).union(uploads(spark, [1], "y"))
    incremental_refresh(spark, source, path, SALTS, TODAY, START, keys=["tanggal"])
    assert read_cache(spark, path).count() == 1


def test_days_to_fetch():
    def days(cached, **more):
        return [d.day for d in days_to_fetch([dt.date(2025, 9, d) for d in cached], START, TODAY, **more)]

    assert days([]) == [1, 2, 3, 4, 5]
    assert days([1, 2, 3]) == [3, 4, 5] and days([1, 2, 3], reload_days=0) == [4, 5]
    assert days([1, 2, 3], reload_days=2) == [2, 3, 4, 5] and days([1, 2, 3], reload_days=30) == [1, 2, 3, 4, 5]
    assert days([1, 2, 3], seen=[dt.date(2025, 9, 4)]) == [3, 5]
    assert days([1, 5]) == [2, 3, 4, 5] and days([1, 5], reload_days=0) == [2, 3, 4]


def test_an_early_day_locks_nothing_out(spark, tmp_path):
    path = str(tmp_path / "cache")
    source = uploads(spark, [1, 2, 3, 4, 5]).union(uploads(spark, [5], "more"))
    incremental_refresh(spark, uploads(spark, [1]), path, SALTS, dt.date(2025, 9, 1), START)
    incremental_refresh(spark, uploads(spark, [5]), path, SALTS, TODAY, START)
    incremental_refresh(spark, source, path, SALTS, TODAY, START)
    assert stored(spark, path) == ["more5", "x1", "x2", "x3", "x4", "x5"]
    assert [d.day for d in cached_days(spark, path)] == [1, 2, 3, 4, 5]


def test_only_an_absent_cache_is_no_cache(spark, tmp_path):
    assert read_cache(spark, str(tmp_path / "none")) is None and cached_days(spark, str(tmp_path / "none")) == []
    with pytest.raises(Exception):
        read_cache(spark, "nosuchscheme://x/y")


def test_refresh_shuffles_wide_rows_once(spark, tmp_path):
    from fieldcheck.plans.refresh import unseen_rows

    df = spark.range(10).selectExpr("date'2025-09-01' AS day", "id AS a", "id AS b")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = unseen_rows(df, df.limit(5))
        out.collect()
        text = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out.count() == 5 and text.count("Exchange hashpartitioning(day") <= 2


def test_stream_stores_each_row_once(spark, tmp_path):
    inbox, path = str(tmp_path / "inbox"), str(tmp_path / "cache")
    for batch in (uploads(spark, [1, 2]), uploads(spark, [2, 3]), uploads(spark, [1], "late")):
        batch.coalesce(1).write.mode("append").parquet(inbox)
        stream = upload_stream(spark, inbox, batch.schema)
        refresh_stream(stream, path, str(tmp_path / "ck"), SALTS).start().awaitTermination()
    assert stored(spark, path) == ["late1", "x1", "x2", "x3"]
    with pytest.raises(Exception):
        Salts("", "", "", "")


def stream_once(spark, inbox, path, checkpoint, batch, **more):
    batch.coalesce(1).write.mode("append").parquet(inbox)
    query = refresh_stream(upload_stream(spark, inbox, batch.schema), path, checkpoint, SALTS, **more).start()
    query.awaitTermination()
    return query


def test_stream_with_state_survives_restarts(spark, tmp_path, monkeypatch):
    """Copies in one batch, in later batches and after a restart are told without reading the cache."""
    from fieldcheck.sources.versions import VersionedTables

    inbox, path, ck = (str(tmp_path / n) for n in ("inbox", "cache", "ck"))
    with monkeypatch.context() as m:
        m.setattr(VersionedTables, "read", lambda *_: pytest.fail("stored visits were read"))
        for batch in (uploads(spark, [1, 2, 2]), uploads(spark, [2, 3]), uploads(spark, [1], "other")):
            query = stream_once(spark, inbox, path, ck, batch, horizon="10 days")
    assert stored(spark, path) == ["other1", "x1", "x2", "x3"] and state_rows(query) == 4
    assert late_rows(query) == 0


def test_stream_state_expires_and_late_rows_wait_for_the_reload(spark, tmp_path):
    inbox, path, ck = (str(tmp_path / n) for n in ("inbox", "cache", "ck"))
    days = {"horizon": "3 days"}
    stream_once(spark, inbox, path, ck, uploads(spark, [1, 2]), **days)
    query = stream_once(spark, inbox, path, ck, uploads(spark, [20, 21]), **days)
    assert state_rows(query) == 2  # days 1 and 2 are behind the watermark (18) and forgotten
    query = stream_once(spark, inbox, path, ck, uploads(spark, [1, 19, 20]).union(uploads(spark, [2], "late")), **days)
    assert late_rows(query) == 2  # a forgotten copy and a new row: neither is stored by the stream
    assert stored(spark, path) == ["x1", "x19", "x2", "x20", "x21"]
    source = spark.read.parquet(inbox)
    incremental_refresh(spark, source, path, SALTS, dt.date(2025, 9, 21), START, reload_days=30)
    assert stored(spark, path) == ["late2", "x1", "x19", "x2", "x20", "x21"]


def test_a_day_far_ahead_makes_no_row_late(spark, tmp_path):
    inbox, path, ck = (str(tmp_path / n) for n in ("inbox", "cache", "ck"))
    now = dt.datetime.now(dt.timezone.utc)
    ahead = uploads(spark, [1]).withColumn("tanggal", F.lit("2999-01-01 08:00:00"))
    stream_once(spark, inbox, path, ck, ahead, horizon=f"{(now.date() - START).days + 5} days")
    query = stream_once(spark, inbox, path, ck, uploads(spark, [2]), horizon=f"{(now.date() - START).days + 5} days")
    assert late_rows(query) == 0 and stored(spark, path) == ["x1", "x2"]


def test_a_replayed_batch_is_not_stored_again(spark, tmp_path):
    path = str(tmp_path / "cache")
    fresh = anonymize(with_times(uploads(spark, [1, 2])), SALTS)
    for _ in range(2):
        for number in (0, 1):
            store_batch(fresh.filter(F.dayofmonth("day") == number + 1), path, "s", number, compare=False)
    assert stored(spark, path) == ["x1", "x2"]
    store_batch(fresh, path, "other stream", 0)
    assert stored(spark, path) == ["x1", "x2"]


def test_a_batch_of_copies_alone_stores_nothing(spark, tmp_path):
    """As with a cache too large to be sent to every task: the join is a merge and leaves no row."""
    inbox, path, ck = (str(tmp_path / n) for n in ("inbox", "cache", "ck"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for _ in range(2):
            stream_once(spark, inbox, path, ck, uploads(spark, [1, 2]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert stored(spark, path) == ["x1", "x2"]


def test_stored_rows_are_not_sent_to_every_task(spark):
    from fieldcheck.plans.refresh import unseen_rows

    df = spark.range(10).selectExpr("date'2025-09-01' AS day", "id AS a")
    for keys in (None, ["a"]):
        out = unseen_rows(df, df.limit(5), keys)
        assert out.count() == 5
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_stream_with_state_writes_few_files_a_day(spark, tmp_path):
    inbox, path, ck = (str(tmp_path / n) for n in ("inbox", "cache", "ck"))
    many = uploads(spark, [1]).drop("diagnosa_1").crossJoin(spark.range(400).selectExpr("concat('x', id) AS diagnosa_1"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        stream_once(spark, inbox, path, ck, many, horizon="10 days")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert read_cache(spark, path).count() == 400
    assert len(list((tmp_path / "cache" / "visits").rglob("*.parquet"))) <= 8
