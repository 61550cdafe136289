"""Registry, input bindings and SQL building blocks of the queries."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldcheck.constants import BLANKS
from fieldcheck.functions.times import usable_file_time
from fieldcheck.plans.facility import with_times
from fieldcheck.plans.privacy import Salts
from fieldcheck.session import tuned
from fieldcheck.sources.readers import load_dataset

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(30)]
SALTS = Salts(nik="salt-a", phone="salt-b", doctor="salt-c", staff="salt-d")
LINEITEM_VARS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_RULES = [
    ("l_quantity", 5.0, 45.0), ("l_extendedprice", 2000.0, 90000.0),
    ("l_discount", 0.01, 0.09), ("l_tax", 0.0, 0.07),
]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# --- inputs ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load_dataset(spark, f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in visit terms: day, file (the event type), file time and facility (the user)."""
    return table(spark, sf_dir, "events").withColumns({
        "day": F.col("ts").cast("date"), "file_name": F.col("event_type"),
        "file_ts_fallback": F.col("ts"), "facility": F.col("user_id"),
    })


EVENTS_SQL = """events_v AS (
  SELECT *, CAST(ts AS DATE) AS day, event_type AS file_name, ts AS file_ts_fallback,
         user_id AS facility
  FROM events)"""


def events_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as long measurements: date, variable (the event type) and value."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("date").alias("Tanggal"), F.col("event_type").alias("Variabel"),
        F.col("value").alias("Value"),
    )


LONG_SQL = """long AS (
  SELECT CAST(ts AS DATE) AS "Tanggal", event_type AS "Variabel", value AS "Value"
  FROM events)"""

# Visit records derived from every event: the raw upload columns, with the dirt that uploads
# have. The expressions mean the same in Spark SQL and in the oracle's SQL.
_PARTS = [
    ("*", None),
    ("cast(floor(value * 100 + 0.5) as bigint)", "h"),
    ("cast(cast(ts as date) as string)", "d"),
    ("lpad(cast(hour(ts) as string), 2, '0')", "hh"),
    ("lpad(cast(minute(ts) as string), 2, '0')", "mi"),
    ("lpad(cast(second(ts) as string), 2, '0')", "ss"),
    ("lpad(cast((day(ts) * 5 + length(event_type) * 7) % 24 as string), 2, '0')", "up"),
]
_VISIT = [
    ("event_id", "id_kunjungan"),
    ("event_type", "poliruangan"),
    ("case user_id % 5 when 0 then 'Taman Asri' when 1 then '  Táman Asrí ' "
     "when 2 then 'Mekar' when 3 then 'SENTOSA' else 'Bahagia ' end", "puskesmas_name"),
    ("concat('P', user_id % 5)", "puskesmas_id"),
    ("case when event_id % 97 = 0 then 'junk' "
     "when event_id % 4 = 0 then concat(d, ' ', hh, ':', mi, ':', ss) "
     "when event_id % 4 = 1 then concat(d, ' ', hh, ':', mi) "
     "when event_id % 4 = 2 then d else concat(d, 'junk') end", "tanggal"),
    ("case when event_type = 'view' then concat('laporan view ', d, '.xlsx') "
     "else concat('laporan ', event_type, ' ', d, ' ', up, '_05_09.', "
     "lpad(cast(length(event_type) * 37 as string), 3, '0'), '.xlsx') end", "file_name"),
    ("case when event_id % 7 = 0 then (case when event_id % 3 = 0 then null else '' end) "
     "when event_id % 7 = 1 then concat(40 + h % 60, ' kg') "
     "when event_id % 7 = 2 then concat(40 + h % 60, ',', h % 10) "
     "when event_id % 7 = 3 then concat(40 + h % 60, '.', h % 10, ' kg') "
     "when event_id % 7 = 4 then '120/80' "
     "when event_id % 7 = 5 then concat(40 + h % 60 - h % 5, '') "
     "when event_id % 5 = 0 then 'abc' else concat(40 + h % 60, '') end", "berat_badan"),
    ("case when event_id % 3 = 0 then concat(100 + 10 * (h % 8), '') "
     "else concat(100 + h % 80, '.', h % 10) end", "tinggi"),
    ("case when event_id % 11 = 0 then ' ' else concat(50 + h % 60, ',', h % 10) end",
     "lingkar_perut"),
    ("case when event_id % 53 = 0 then '300' when event_id % 2 = 0 "
     "then concat(10 * (9 + h % 9), '') else concat(90 + h % 90, '') end", "sistole"),
    ("case when event_id % 59 = 0 then '12-5' when event_id % 2 = 0 "
     "then concat(10 * (6 + h % 5), '') else concat(60 + h % 50, '') end", "diastole"),
    ("concat(60 + h % 60, ' x/m')", "detak_nadi"),
    ("concat(12 + h % 20, '')", "nafas"),
    ("case when event_id % 41 = 0 then '29,9' when event_id % 43 = 0 then '43,1' "
     "else concat(35 + h % 5, ',', h % 10) end", "suhu"),
    ("case when event_id % 13 = 0 then null when event_id % 17 = 0 then '123' "
     "when event_id % 19 = 0 then 'n/a' "
     "else concat('5201 0000 ', lpad(cast(user_id as string), 8, '0')) end", "nik"),
    ("case when user_id % 9 = 0 then '  ' else concat('Pasien ', user_id) end", "nama_pasien"),
    ("case event_id % 4 when 0 then concat('0812-', lpad(cast(user_id as string), 4, '0'), '-7890') "
     "when 1 then concat('+62 812 ', lpad(cast(user_id as string), 4, '0'), ' 7890') "
     "when 2 then 'n/a' else concat('(0370) ', lpad(cast(user_id as string), 6, '0')) end",
     "no_telp"),
    ("case event_id % 5 when 0 then concat(1950 + user_id % 60, '-', 1 + user_id % 12, '-', 1 + user_id % 28) "
     "when 1 then concat(13 + user_id % 15, '/', 1 + user_id % 12, '/', 1950 + user_id % 60) "
     "when 2 then concat(2020 + user_id % 10, '-01-15 10:00:00') "
     "when 3 then concat('12-', 13 + user_id % 15, '-', 1950 + user_id % 60) else 'tidak tahu' end",
     "tgllahir"),
    ("concat('Jl. Raya No. ', user_id)", "alamat"),
    ("case when event_id % 19 = 0 then null when user_id % 3 = 0 then ' Dr.  José  A ' "
     "when user_id % 3 = 1 then 'dr. jose a' else concat('Dr. B', user_id % 7) end",
     "dokter_tenaga_medis"),
    ("case when event_id % 23 = 0 then '' else upper(event_type) end", "diagnosa_1"),
    ("case when event_id % 29 = 0 then null else concat('Bidan ', user_id % 6) end",
     "perawat_bidan_nutrisionist_sanitarian"),
    ("case when event_id % 2 = 0 then concat(user_id % 80, ' th') else concat(user_id % 80, '') end",
     "umur_tahun"),
]


def _exprs(parts) -> list[str]:
    return [e if a is None else f"{e} as {a}" for e, a in parts]


def visits(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    """The uploads, in a tuned session: their projections are too wide for one compiled method.

    ``deal`` deals the narrow events to all cores before; a file of few row groups is read by as few tasks.
    """
    df = table(tuned(spark), sf_dir, "events")
    df = df.repartition(4 * spark.sparkContext.defaultParallelism) if deal else df
    return df.selectExpr(*_exprs(_PARTS)).selectExpr(*_exprs(_VISIT))


def core(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    """Visits of all facilities with times, days and file order."""
    return with_times(visits(spark, sf_dir, deal)).withColumn(
        "file_ts_fallback", usable_file_time("file_ts", "tanggal_ts"))


# --- SQL building blocks -----------------------------------------------------------------


def rr(x: str, digits: int) -> str:
    """Rounding to the nearer neighbour, ties to even, as the library does it."""
    p = f"{10**digits}.0::DOUBLE"
    lo, hi = f"(floor(({x}) * {p}) / {p})", f"(ceil(({x}) * {p}) / {p})"
    return (
        f"(CASE WHEN abs(({x}) * {p}) >= 1e15 THEN ({x}) "
        f"WHEN (({x}) - {lo}) < ({hi} - ({x})) OR ((({x}) - {lo}) = ({hi} - ({x})) "
        f"AND floor(({x}) * {p}) % 2 = 0) THEN {lo} ELSE {hi} END)"
    )


def rr2(x: str) -> str:
    return rr(rr(x, 6), 2)


def pct_sql(x: str) -> str:
    """Share to ``12.3%``."""
    return f"printf('%.1f%%', {rr(f'({x}) * 100.0', 1)})"


def strip_sql(x: str) -> str:
    return (f"TRY_CAST(replace(regexp_replace({x}, '[^0-9,.\\-]', '', 'g'), ',', '.') AS DOUBLE)")


def first_number_sql(x: str, comma_decimal: bool = True) -> str:
    text = x
    if comma_decimal:
        text = f"(CASE WHEN contains({x}, '.') THEN {x} ELSE replace({x}, ',', '.') END)"
    hit = rf"regexp_extract({text}, '-?(\d[\d,]*\.?\d*|\.\d+)')"
    return f"TRY_CAST(nullif(replace({hit}, ',', ''), '') AS DOUBLE)"


# Lower-case letters that the database's own accent folding leaves as they are.
_UNFOLDED = {
    "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ĳ": "ij", "ø": "o", "đ": "d", "ð": "d", "ħ": "h",
    "ı": "i", "ł": "l", "ŧ": "t", "ŋ": "n",
}


def fold_sql(x: str) -> str:
    for letter, plain in _UNFOLDED.items():
        x = f"replace({x}, '{letter}', '{plain}')"
    return f"regexp_replace(strip_accents({x}), '[\\x{{0300}}-\\x{{036f}}]', '', 'g')"


def norm_sql(x: str) -> str:
    return f"regexp_replace({fold_sql(f'lower({x})')}, '[^a-z0-9]', '', 'g')"


_BLANKS_SQL = "concat(' ', chr(9), chr(13), chr(10))"
assert sorted(BLANKS) == sorted(" \t\r\n")


def trim_sql(x: str) -> str:
    return f"trim({x}, {_BLANKS_SQL})"


def filled_sql(x: str) -> str:
    return f"nullif({trim_sql(x)}, '')"


def person_sql(x: str) -> str:
    return fold_sql(f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))")


def digits_sql(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def phone_sql(x: str) -> str:
    return digits_sql(f"regexp_replace(regexp_replace({x}, '[\\s()\\-]', '', 'g'), '^\\+62', '0')")


def pretty_sql(x: str) -> str:
    t = f"regexp_replace({x}, '[._]+', ' ', 'g')"
    t = f"regexp_replace({t}, '\\bTgl\\.?\\b', 'Tanggal', 'gi')"
    t = f"regexp_replace({t}, '\\bNo\\b', 'No.', 'gi')"
    t = f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"
    title = (f"(SELECT string_agg(upper(w[1]) || lower(w[2:]), ' ' ORDER BY i) FROM "
             f"(SELECT unnest(string_split({t}, ' ')) AS w, "
             f"generate_subscripts(string_split({t}, ' '), 1) AS i))")
    names = "'NIK','BPJS','ID','UGD','IGD','KIA','ANC','MTBS','BMI','SPO2'"
    return f"CASE WHEN upper({t}) IN ({names}) THEN upper({t}) ELSE {title} END"


def file_time_sql(x: str) -> str:
    """Local (zone-less) upload time."""
    hit = (f"regexp_extract({x}, "
           r"'\d{4}-\d{2}-\d{2} \d{2}_\d{2}_\d{2}\.\d{3}')")
    return f"try_strptime(nullif({hit}, ''), '%Y-%m-%d %H_%M_%S.%g')"


def visit_time_sql(x: str) -> str:
    return (f"coalesce(try_strptime({x}, '%Y-%m-%d %H:%M:%S'), "
            f"try_strptime({x}, '%Y-%m-%d %H:%M'), TRY_CAST({x} AS TIMESTAMP))")


def day_sql(x: str) -> str:
    return rf"TRY_CAST(nullif(regexp_extract({x}, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}'), '') AS DATE)"


def utc_ms_sql(local: str) -> str:
    """Epoch milliseconds of a local time of the source zone (UTC+8, no summer time)."""
    return f"CAST(epoch_ms(({local}) - INTERVAL 8 HOUR) AS BIGINT)"


def sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


VISITS_SQL = (
    f"visits AS (SELECT {', '.join(_exprs(_VISIT))} FROM "
    f"(SELECT {', '.join(_exprs(_PARTS))} FROM events))"
)
CORE_SQL = f"""{VISITS_SQL},
core AS (
  SELECT *, coalesce(file_ts, tanggal_ts) AS file_ts_fallback FROM (
    SELECT *, {trim_sql('puskesmas_name')} AS "PKM",
           {norm_sql(trim_sql('puskesmas_name'))} AS "PKM_norm",
           {visit_time_sql('tanggal')} AS tanggal_ts, {day_sql('tanggal')} AS day,
           {file_time_sql('file_name')} AS file_ts
    FROM visits))"""
