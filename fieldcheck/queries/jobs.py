"""Queries that write and read back: sources, caches, exports, refresh and stream."""

from __future__ import annotations

import datetime as dt
import re
import tempfile
from functools import reduce

from pyspark.sql import functions as F

from fieldcheck.constants import CLINICAL_VARS, SAFE_COLUMNS
from fieldcheck.functions.times import usable_file_time
from fieldcheck.operators import aggregates as A, joins as E, scope as K
from fieldcheck.operators.filters import latest_date_only
from fieldcheck.plans import heaping as H, privacy as PV
from fieldcheck.plans.refresh import incremental_refresh, read_cache
from fieldcheck.plans.summaries import SKETCHED, SUMMARIES, Summaries
from fieldcheck.queries.base import (
    CORE_SQL, SALTS, core, events, events_long, filled_sql, query, strip_sql, table, visits,
)
from fieldcheck.queries.reports import (
    AUDIT_SQL, BY_DAY, FRIENDLY, SAFE_SQL, audited_rows, heaping_sql, pivot_sql, unpivot_sql,
)
from fieldcheck.sources import readers as R, sinks as S
from fieldcheck.sources.versions import VersionedTables, ledger
from fieldcheck.streaming.refresh_stream import refresh_stream, upload_stream


def new_folder(spark, name):
    """A new folder below the shared one; a session on one machine that names none gets its own."""
    if spark.conf.get("spark.checkpoint.dir", None) or not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return S.run_folder(spark, name)
    return f"{tempfile.mkdtemp(prefix='fieldcheck-')}/{name}"


@query("a1_load_parquet", "SELECT * FROM customer")
def _(spark, sf):
    return R.load_dataset(spark, f"{sf}/customer.parquet")


@query("a1_load_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    customer = table(spark, sf, "customer")
    path = f"{new_folder(spark, 'csv')}/customer.csv"
    S.export_csv(customer, path)
    return R.load_dataset(spark, path, schema=customer.schema)


@query("a3_load_rules", """WITH r AS (SELECT event_type AS v, min(value) + 10 AS lo, max(value) - 100 AS hi FROM events GROUP BY 1)
SELECT v AS "Variable", lo AS min_ok, hi AS max_ok, count(*) FILTER (value < lo OR value > hi) AS n_out
FROM events JOIN r ON v = event_type GROUP BY ALL""")
def _(spark, sf):
    df = table(spark, sf, "events")
    made = df.groupBy(F.col("event_type").alias("Variable")).agg(
        (F.min("value") + 10).alias("min_ok"), (F.max("value") - 100).alias("max_ok"))
    rules = R.load_rules(spark, S.export_csv(made, f"{new_folder(spark, 'rules')}/rules.csv"))
    out = (F.col("value") < F.col("min_ok")) | (F.col("value") > F.col("max_ok"))
    return E.with_rules(df.withColumnRenamed("event_type", "Variable"), rules).groupBy(
        "Variable", "min_ok", "max_ok").agg(F.count_if(out).alias("n_out"))


@query("a4_write_cache", """SELECT event_id, user_id, event_type, value, CAST(ts AS DATE) AS day FROM events""")
def _(spark, sf):
    """Written twice with every row repeated: one copy of each row remains."""
    df = events(spark, sf).select("event_id", "user_id", "event_type", "value", "day")
    path = new_folder(spark, "cache")
    S.write_cache(df.unionByName(df), path)
    S.write_cache(df, path)
    return read_cache(spark, path)


@query("a5_export_csv", pivot_sql("ratio", "-"))
def _(spark, sf):
    labels = H.heaping_labels(H.heaping_daily(events_long(spark, sf)))
    path = f"{new_folder(spark, 'export')}/{S.export_name('heaping_step6', '20240131')}"
    return R.load_dataset(spark, S.export_csv(H.heaping_pivot(labels), path))


_vars = {f: strip_sql(c) for f, c in FRIENDLY.items()}
_kept = {f: e for f, e in _vars.items() if f not in ("Nafas", "Suhu")}
_written = " UNION ALL ".join(
    f"SELECT day, '{f}' AS v, {c} AS x FROM core WHERE {c} <> '' AND {strip_sql(c)} IS NULL"
    for f, c in FRIENDLY.items())


@query("a6_export_steps", f"""WITH {CORE_SQL},
long AS (SELECT * FROM ({unpivot_sql('core', ['day AS "Tanggal"'], _kept)}) WHERE "Value" IS NOT NULL AND "Tanggal" IS NOT NULL),
{heaping_sql('long', BY_DAY)}
SELECT 'Step1_NA_Summary' AS step, count(DISTINCT "Variabel") AS n FROM ({unpivot_sql('core', [], _vars)})
UNION ALL SELECT 'Step1_Audit', count(*) FROM (SELECT DISTINCT * FROM ({_written}))
UNION ALL SELECT 'Step2_df_long', count(*) FROM long UNION ALL SELECT 'Step3_int_counts', count(*) FROM ic
UNION ALL SELECT 'Step3_int_full', count(*) FROM inf UNION ALL SELECT 'Step4_dec_counts', count(*) FROM dc
UNION ALL SELECT 'Step5_Combined', count(*) FROM heap UNION ALL SELECT 'Step6_preferred_raw', count(*) FROM heap
UNION ALL SELECT 'Step6_pivot_with_avg', count(DISTINCT "Variabel") + 1 FROM heap""")
def _(spark, sf):
    folder = new_folder(spark, "steps")
    steps = H.heaping_steps(core(spark, sf, deal=True), CLINICAL_VARS, keep=lambda slots: S.kept(slots, f"{folder}/slots"))
    counts = None
    for path in S.export_steps(steps, f"{folder}/tables"):
        step = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))
        step = step.select(F.lit(path.rsplit("/", 1)[-1]).alias("step"), "n")
        counts = step if counts is None else counts.unionByName(step)
    return counts


_stored = [c for c in SAFE_COLUMNS if c not in ("file_ts", "tanggal_ts")]
_STORED_SQL = ", ".join(f'"{c}"' for c in _stored)


def _refreshed(cache):
    """Stored rows with their number of copies."""
    return A.count_by(cache, _stored, "copies")


@query("l23_incremental_refresh", f"""WITH {SAFE_SQL}
SELECT {_STORED_SQL}, count(*) AS copies FROM (
  SELECT DISTINCT {_STORED_SQL}, file_ts, tanggal_ts FROM safe WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-31') GROUP BY ALL""")
def _(spark, sf):
    """First the days to the 20th, then to the 31st with repeated uploads, then once more."""
    source, path = visits(spark, sf, deal=True), new_folder(spark, "refresh")
    start = dt.date(2024, 1, 1)
    incremental_refresh(spark, source, path, SALTS, dt.date(2024, 1, 20), start)
    twice = source.unionByName(source)
    incremental_refresh(spark, twice, path, SALTS, dt.date(2024, 1, 31), start)
    return _refreshed(incremental_refresh(spark, twice, path, SALTS, dt.date(2024, 1, 31), start))


@query("m2_refresh_reload_days", f"""WITH {SAFE_SQL}
SELECT {_STORED_SQL}, count(*) AS copies FROM (
  SELECT DISTINCT {_STORED_SQL}, file_ts, tanggal_ts FROM safe
  WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' AND NOT (poliruangan = 'view' AND day < DATE '2024-01-16'
    AND day IN (SELECT day FROM safe WHERE poliruangan <> 'view'))) GROUP BY ALL""")
def _(spark, sf):
    """Uploads of one unit arrive late: five reloaded days admit theirs, older ones stay out."""
    source, path = visits(spark, sf, deal=True), new_folder(spark, "reload")
    start = dt.date(2024, 1, 1)
    early = source.filter("poliruangan <> 'view'")
    incremental_refresh(spark, early, path, SALTS, dt.date(2024, 1, 20), start)
    return _refreshed(incremental_refresh(
        spark, source, path, SALTS, dt.date(2024, 1, 31), start, reload_days=5))


@query("l23_refresh_gap", f"""WITH {SAFE_SQL}
SELECT {_STORED_SQL}, count(*) AS copies FROM (
  SELECT DISTINCT {_STORED_SQL}, file_ts, tanggal_ts FROM safe WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-31') GROUP BY ALL""")
def _(spark, sf):
    """One visit of the newest day is cached early: the days between and the rest of that day still follow."""
    source, path = visits(spark, sf, deal=True), new_folder(spark, "gap")
    start, end = dt.date(2024, 1, 1), dt.date(2024, 1, 31)
    incremental_refresh(spark, source, path, SALTS, dt.date(2024, 1, 4), start)
    newest = source.filter("tanggal LIKE '2024-01-31%' OR tanggal LIKE '31-01-2024%'").orderBy("id_kunjungan").limit(1)
    incremental_refresh(spark, newest, path, SALTS, end, start)
    return _refreshed(incremental_refresh(spark, source, path, SALTS, end, start))


@query("m1_refresh_stream", f"""WITH {SAFE_SQL}
SELECT {_STORED_SQL}, count(*) AS copies FROM (
  SELECT DISTINCT {_STORED_SQL}, file_ts, tanggal_ts FROM safe WHERE day IS NOT NULL) GROUP BY ALL""")
def _(spark, sf):
    """Uploads arrive as files, every one twice; the stream runs after each arrival."""
    source, folder = visits(spark, sf), new_folder(spark, "stream")
    inbox, cache = f"{folder}/inbox", f"{folder}/cache"
    for _ in range(2):
        source.write.mode("append").parquet(inbox)
        stream = upload_stream(spark, inbox, source.schema, max_files=4)
        refresh_stream(stream, cache, f"{folder}/checkpoint", SALTS).start().awaitTermination()
    return _refreshed(read_cache(spark, cache))


@query("m1_refresh_stream_state", f"""WITH {SAFE_SQL}
SELECT {_STORED_SQL}, count(*) AS copies FROM (
  SELECT DISTINCT {_STORED_SQL}, file_ts, tanggal_ts FROM safe WHERE day IS NOT NULL) GROUP BY ALL""")
def _(spark, sf):
    """The same arrivals; copies are told by keyed state, and no stored visit is read."""
    source, folder = visits(spark, sf), new_folder(spark, "stream")
    inbox, cache = f"{folder}/inbox", f"{folder}/cache"
    for _ in range(2):
        source.write.mode("append").parquet(inbox)
        stream = upload_stream(spark, inbox, source.schema, max_files=4)
        refresh_stream(stream, cache, f"{folder}/checkpoint", SALTS, horizon="60 days").start().awaitTermination()
    return _refreshed(read_cache(spark, cache))


@query("l23_refresh_ledger", f"""WITH {SAFE_SQL},
d AS (SELECT CAST(unnest(generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS day),
n AS (SELECT day, count(*) AS n FROM (SELECT DISTINCT {_STORED_SQL}, file_ts, tanggal_ts FROM safe) GROUP BY day)
SELECT d.day, coalesce(n, 0) AS rows FROM d LEFT JOIN n USING (day)""")
def _(spark, sf):
    """Every day that was asked for, with its visits; days before and after the uploads stay empty."""
    source, path = visits(spark, sf, deal=True), new_folder(spark, "ledger")
    for today in (dt.date(2024, 1, 20), dt.date(2024, 2, 5)):
        incremental_refresh(spark, source, path, SALTS, today, dt.date(2023, 12, 25))
    return ledger(spark, path).select("day", "rows")


def _summaries(spark, sf):
    """A cache and its summaries after an insert, a reload that admits late rows, and a rerun."""
    source, path = visits(spark, sf, deal=True), new_folder(spark, "kept")
    start = dt.date(2024, 1, 1)
    incremental_refresh(spark, source.filter("poliruangan <> 'view'"), path, SALTS, dt.date(2024, 1, 20), start, summaries=SUMMARIES)
    for _ in range(2):
        incremental_refresh(spark, source, path, SALTS, dt.date(2024, 1, 31), start, reload_days=31, summaries=SUMMARIES)
    return read_cache(spark, path), Summaries(VersionedTables(spark, path))


_KEPT_SQL = f"""{SAFE_SQL},
cache AS (SELECT DISTINCT {_STORED_SQL}, file_ts, tanggal_ts FROM safe WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'),
long AS (SELECT * FROM ({unpivot_sql('cache', ['day AS "Tanggal"', 'file_name'], _kept)}) WHERE "Value" IS NOT NULL)"""


@query("l10_heaping_from_counts", f"""WITH {_KEPT_SQL}, {heaping_sql('long', BY_DAY)} SELECT * FROM heap""")
def _(spark, sf):
    return _summaries(spark, sf)[1].heaping_daily()


@query("l9_heaping_from_counts", f"""WITH {_KEPT_SQL}, {heaping_sql('long', '"Variabel"')} SELECT * FROM heap""")
def _(spark, sf):
    return _summaries(spark, sf)[1].heaping_window()


def _files_sql(keys: str) -> str:
    return f"""files AS (SELECT {keys}, file_name, visits FROM (
  SELECT {keys}, file_name, count(*) AS visits, row_number() OVER (
    PARTITION BY {keys} ORDER BY max(coalesce(file_ts, tanggal_ts)) DESC NULLS LAST, file_name) AS r FROM cache GROUP BY {keys}, file_name) WHERE r = 1)"""


@query("g1_latest_from_index", f"""WITH {_KEPT_SQL}, {_files_sql('"PKM_norm", day')} SELECT "PKM_norm", day, file_name FROM files""")
def _(spark, sf):
    """The latest file of every site and day, from the kept index alone."""
    _, tables = _summaries(spark, sf)
    return tables.latest_files(dt.date(2024, 1, 1), dt.date(2024, 1, 31), ["PKM_norm"]).select("PKM_norm", "day", "file_name")


@query("k7_scope_from_index", f"""WITH {_KEPT_SQL}, {_files_sql('day')} SELECT day, file_name, visits FROM files""")
def _(spark, sf):
    """Days and files of a month are chosen from the index; visits are read once, for these files."""
    cache, tables = _summaries(spark, sf)
    cache = cache.withColumn("file_ts_fallback", usable_file_time("file_ts", "tanggal_ts"))
    frame = K.scope_frame(cache, K.Scope("month", dt.date(2024, 1, 9)), index=tables.files())
    return A.count_by(frame, ["day", "file_name"], "visits")


def _by_day(spark, sf):
    """Visits by day as a published cache that was written twice; the second time January's late days only."""
    path = new_folder(spark, "days")
    df = core(spark, sf).select("id_kunjungan", "file_name", "file_ts_fallback", "day")
    S.write_cache(df, path)
    S.write_cache(df.filter("day >= DATE '2024-01-20'"), path)
    return read_cache(spark, path), VersionedTables(spark, path).day_rows()


_DAYS_SQL = f"{CORE_SQL}, held AS (SELECT DISTINCT id_kunjungan, file_name, file_ts_fallback, day FROM core)"


@query("f13_max_day_known", f"WITH {CORE_SQL} SELECT max(day) AS max_day FROM core")
def _(spark, sf):
    cache, days = _by_day(spark, sf)
    return A.max_day(cache, known=days)


@query("k1_available_days_known", f"""WITH {_DAYS_SQL}
SELECT day, count(*) AS rows FROM held WHERE day IS NOT NULL GROUP BY day""")
def _(spark, sf):
    """Days and their rows, from the manifest alone."""
    cache, days = _by_day(spark, sf)
    return K.available_days(cache, known=days).join(days, "day")


_near = [dt.date(2023, 11, 5), dt.date(2024, 1, 10), dt.date(2024, 1, 28), dt.date(2030, 6, 1)]


@query("k2_resolve_day_known", f"""WITH {CORE_SQL}, pick AS (SELECT * FROM (VALUES {', '.join(f"(DATE '{p}')" for p in _near)}) t(sel))
SELECT sel, day AS resolved_day FROM (SELECT sel, day, row_number() OVER (PARTITION BY sel ORDER BY abs(day - sel), day) AS r
  FROM pick, (SELECT DISTINCT day FROM core WHERE day IS NOT NULL)) WHERE r = 1""")
def _(spark, sf):
    cache, days = _by_day(spark, sf)
    found = [K.resolve_day(cache, p, known=days).select(F.lit(p).alias("sel"), "resolved_day") for p in _near]
    return reduce(lambda a, b: a.unionByName(b), found)


@query("d8_latest_date_known", f"""WITH {_DAYS_SQL}
SELECT id_kunjungan, file_name, day FROM held WHERE day = (SELECT max(day) FROM held)""")
def _(spark, sf):
    """The last day comes from the manifest, so the files of other days are not opened."""
    cache, days = _by_day(spark, sf)
    return latest_date_only(cache, "day", known=days).select("id_kunjungan", "file_name", "day")


@query("k7_scope_known", f"""WITH {_DAYS_SQL}, near AS (SELECT day FROM held WHERE day IS NOT NULL ORDER BY abs(day - DATE '2031-05-05'), day LIMIT 1),
file AS (SELECT file_name FROM held WHERE day = (SELECT day FROM near) AND file_name IS NOT NULL
  GROUP BY 1 ORDER BY max(file_ts_fallback) DESC NULLS LAST, file_name LIMIT 1)
SELECT day, file_name, count(*) AS visits FROM held WHERE day = (SELECT day FROM near) AND file_name = (SELECT file_name FROM file) GROUP BY ALL""")
def _(spark, sf):
    """The nearest day to one long after the uploads, found in the manifest, and the visits of its latest file."""
    cache, days = _by_day(spark, sf)
    frame = K.scope_frame(cache, K.Scope("day", dt.date(2031, 5, 5)), known=days)
    return A.count_by(frame, ["day", "file_name"], "visits")


@query("f6_distinct_from_sketches", f"WITH {_KEPT_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"Variable\", count(DISTINCT {filled_sql(c)}) AS distinct_n, true AS near FROM cache" for c in SKETCHED))
def _(spark, sf):
    """Exact numbers of different texts, and whether the union of the daily sketches is within 6 % (about 4 errors)."""
    cache, tables = _summaries(spark, sf)
    both = A.distinct_nonmissing(cache, SKETCHED).join(tables.distinct().withColumnRenamed("distinct_n", "about"), "Variable")
    near = F.abs(F.col("about") - F.col("distinct_n")) <= F.lit(0.06) * F.col("distinct_n")
    return both.select("Variable", "distinct_n", near.alias("near"))


@query("l22_observed_audit", AUDIT_SQL)
def _(spark, sf):
    """The audit as counted while the table is written."""
    audited = PV.Audited(PV.anonymize(core(spark, sf), SALTS))
    audited.df.write.parquet(new_folder(spark, "audited"))
    found = spark.createDataFrame(audited.counts(), "check string, column string, violations bigint")
    return audited_rows(found.withColumn("ok", F.col("violations") == 0))
