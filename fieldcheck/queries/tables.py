"""Queries of sources, projections, filters, joins, aggregates, rankings, sets, reshapes, scopes."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import functions as F

from fieldcheck.constants import (
    ADMIN_MAP, CLINICAL_MAP, CLINICAL_VARS, LIVE_COLUMNS,
)
from fieldcheck.functions.numbers import (
    parse_first_number, parse_strip, r_round, round2,
)
from fieldcheck.functions.text import blank_to_null
from fieldcheck.operators import (
    aggregates as A, filters as D, joins as E, ranking as G, reshape as J, schema as B, scope as K,
)
from fieldcheck.plans.heaping import bucket_counts, choose_variables, heaping_long, slot_counts
from fieldcheck.plans.histogram import histogram
from fieldcheck.plans.outliers import outlier_log
from fieldcheck.plans.profile import profile
from fieldcheck.queries.base import (
    CORE_SQL, DAYS, EVENTS_SQL, LINEITEM_RULES, LINEITEM_VARS, LONG_SQL, VISITS_SQL, core,
    day_sql, events, events_long, filled_sql, first_number_sql, norm_sql, query, rr, rr2,
    sql_list, strip_sql, table, visits,
)
from fieldcheck.sources.readers import RULES_SCHEMA, scan_minimal

FRIENDLY = {f: c[0] for f, c in CLINICAL_MAP.items()}


def line_rules(spark):
    return spark.createDataFrame(LINEITEM_RULES, RULES_SCHEMA)


RULES_SQL = "rules(\"Variable\", min_ok, max_ok) AS (VALUES {})".format(
    ", ".join(f"('{v}', {a}::DOUBLE, {b}::DOUBLE)" for v, a, b in LINEITEM_RULES))


def unpivot_sql(source: str, ids: list[str], variables: dict[str, str], name="Variabel", value="Value") -> str:
    """Long form as a union, one part per variable: independent of the engine's UNPIVOT."""
    keep = "".join(f"{i}, " for i in ids)
    return " UNION ALL ".join(
        f"SELECT {keep}'{v}' AS \"{name}\", {e} AS \"{value}\" FROM {source}" for v, e in variables.items())


LINE_LONG_SQL = f"line_long AS ({unpivot_sql('lineitem', [], {v: v for v in LINEITEM_VARS})})"

# --- B: schema and projection -------------------------------------------------------------


@query("a2_scan_minimal", f"""WITH {VISITS_SQL}
SELECT {', '.join(c for c in LIVE_COLUMNS if c != 'posyandu')} FROM visits""")
def _(spark, sf):
    return scan_minimal(visits(spark, sf))


@query("b2_add_alias_cols", f"""WITH {VISITS_SQL}
SELECT id_kunjungan, berat_badan, diagnosa_1, berat_badan AS "Berat Badan", suhu AS "Suhu",
       diagnosa_1 AS "Diagnosa 1" FROM visits""")
def _(spark, sf):
    df = visits(spark, sf).select("id_kunjungan", "berat_badan", "suhu", "diagnosa_1")
    df = B.add_alias_cols(df, B.resolve_columns(df.columns, CLINICAL_MAP))
    return B.add_alias_cols(df, B.resolve_columns(df.columns, ADMIN_MAP))


@query("b3_apply_schema", f"""WITH {CORE_SQL}
SELECT id_kunjungan, day AS "Tanggal", {', '.join(f'{strip_sql(c)} AS "{f}"' for f, c in FRIENDLY.items())},
       {strip_sql('umur_tahun')} AS "Umur Tahun", diagnosa_1 AS "Diagnosa 1" FROM core""")
def _(spark, sf):
    return B.apply_schema(core(spark, sf)).select(
        "id_kunjungan", "Tanggal", *CLINICAL_VARS, "Umur Tahun", "Diagnosa 1")


@query("b4_ensure_columns", f"""WITH {VISITS_SQL}
SELECT id_kunjungan, nik, NULL::VARCHAR AS no_telp, NULL::VARCHAR AS nama_pasien, alamat,
       NULL::VARCHAR AS tgllahir, dokter_tenaga_medis,
       NULL::VARCHAR AS perawat_bidan_nutrisionist_sanitarian FROM visits""")
def _(spark, sf):
    return B.ensure_columns(
        visits(spark, sf).select("id_kunjungan", "nik", "alamat", "dokter_tenaga_medis"))


_liked = ["puskesmas_name", "poliruangan", *FRIENDLY.values(), "nama_pasien", "diagnosa_1", "umur_tahun"]


@query("b7_numeric_like_columns", f"WITH {VISITS_SQL} SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({strip_sql(c)}) AS n_parsed FROM visits" for c in _liked)
    + ") WHERE n_parsed > 0")
def _(spark, sf):
    return B.numeric_like_columns(visits(spark, sf), _liked)


@query("b7_has_digit_columns", f"WITH {VISITS_SQL} SELECT \"column\" FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", bool_or(regexp_matches({c}, '\\d')) AS hit FROM visits" for c in _liked)
    + ") WHERE hit")
def _(spark, sf):
    return B.has_digit_columns(visits(spark, sf), _liked)


_scanned = ["l_orderkey", "l_quantity", "l_returnflag", "l_tax", "l_linestatus"]


@query("b7_heaping_fallback", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"Variabel\", count(try_cast({c} AS DOUBLE)) AS n FROM lineitem" for c in _scanned) + ") WHERE n > 0")
def _(spark, sf):
    """Heaping of a table without any wanted variable takes its numeric-like columns."""
    df = table(spark, sf, "lineitem").select(*_scanned)
    used = choose_variables(df, ["Suhu", "Sistole"])
    return A.count_by(heaping_long(df, used, day=None), ["Variabel"])


_described = [("event_id", "Event Id", "numeric"), ("ts", "Ts", "datetime"),
              ("user_id", "User Id", "numeric"), ("event_type", "Event Type", "character"),
              ("value", "Value", "numeric"), ("props", "Props", "character")]


@query("b8_describe_columns", " UNION ALL ".join(
    f"SELECT {i}::BIGINT AS \"index\", '{c}' AS \"column\", '{n}' AS name, '{t}' AS type, "
    f"count({c}) AS non_null, count(DISTINCT {c}) AS distinct_n, "
    f"abs(approx_count_distinct({c}) - count(DISTINCT {c})) <= 0.3 * count(DISTINCT {c}) + 5 AS distinct_close FROM events"
    for i, (c, n, t) in enumerate(_described, 1)))
def _(spark, sf):
    df = table(spark, sf, "events")
    exact = A.distinct_nonmissing(df, df.columns, "column")
    close = F.abs(F.col("approx_distinct") - F.col("distinct_n")) <= 0.3 * F.col("distinct_n") + 5
    return B.describe_columns(df).join(exact, "column").select(
        "index", "column", "name", "type", "non_null", "distinct_n", close.alias("distinct_close"))


# --- D: filters ------------------------------------------------------------------------------


@query("d1_filter_facility", f"""WITH {VISITS_SQL}
SELECT id_kunjungan, puskesmas_name FROM visits WHERE {norm_sql('puskesmas_name')} = 'tamanasri'""")
def _(spark, sf):
    return D.filter_facility(visits(spark, sf), "TÁMAN-asri", "puskesmas_name").select(
        "id_kunjungan", "puskesmas_name")


@query("d2_filter_days", """SELECT event_id, CAST(ts AS DATE) AS day FROM events
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""")
def _(spark, sf):
    return D.filter_days(events(spark, sf), "2024-01-05", "2024-01-20").select("event_id", "day")


@query("d3_filter_day_file", f"""WITH {EVENTS_SQL}
SELECT event_id, day, file_name FROM events_v WHERE day = DATE '2024-01-09' AND file_name = (
  SELECT file_name FROM events_v WHERE day = DATE '2024-01-09'
  GROUP BY file_name ORDER BY max(ts) DESC, file_name LIMIT 1)""")
def _(spark, sf):
    df = events(spark, sf)
    file = G.latest_file_for_day(df, "2024-01-09").first()
    return D.filter_day_file(df, "2024-01-09", file["file_name"]).select("event_id", "day", "file_name")


@query("d4_drop_sundays", f"""WITH {LONG_SQL} SELECT "Tanggal", count(*) AS n FROM long
WHERE isodow("Tanggal") <> 7 GROUP BY 1""")
def _(spark, sf):
    return A.count_by(D.drop_sundays(events_long(spark, sf)), ["Tanggal"])


@query("d5_exclude_dates", f"""WITH {LONG_SQL} SELECT "Tanggal", count(*) AS n FROM long
WHERE "Tanggal" NOT IN (DATE '2024-01-03', DATE '2024-01-10', DATE '2024-01-21') GROUP BY 1""")
def _(spark, sf):
    kept = D.exclude_dates(events_long(spark, sf), "2024-01-03, 2024-01-10;2024-01-21 bad")
    return A.count_by(kept, ["Tanggal"])


@query("d6_focus_variable", f"""WITH {LONG_SQL} SELECT "Variabel", count(*) AS n,
  (SELECT count(*) FROM long) AS n_all FROM long WHERE "Variabel" = 'purchase' GROUP BY 1""")
def _(spark, sf):
    long = events_long(spark, sf)
    everything = D.focus_variable(long).agg(F.count(F.lit(1))).scalar()
    one = A.count_by(D.focus_variable(long, "purchase"), ["Variabel"])
    return one.withColumn("n_all", everything)


@query("d7_focus_date", f"""WITH {LONG_SQL}, one AS (SELECT * FROM long WHERE "Tanggal" = DATE '2024-01-11')
SELECT 'present' AS focus, "Variabel", count(*) AS n FROM one GROUP BY ALL
UNION ALL SELECT 'absent', "Variabel", count(*) FROM long GROUP BY ALL""")
def _(spark, sf):
    long = events_long(spark, sf)
    present = D.focus_date(long, dt.date(2024, 1, 11)).withColumn("focus", F.lit("present"))
    absent = D.focus_date(long, dt.date(2030, 1, 1)).withColumn("focus", F.lit("absent"))
    return A.count_by(present.unionByName(absent), ["focus", "Variabel"])


@query("d8_latest_date_only", f"""WITH {LONG_SQL} SELECT "Tanggal", "Variabel", "Value" FROM long
WHERE "Tanggal" = (SELECT max("Tanggal") FROM long)""")
def _(spark, sf):
    return D.latest_date_only(events_long(spark, sf))


@query("d9_drop_null_or_nonfinite", f"""WITH {CORE_SQL}
SELECT id_kunjungan, day, {strip_sql('berat_badan')} AS w FROM core
WHERE day IS NOT NULL AND file_ts IS NOT NULL AND {strip_sql('berat_badan')} IS NOT NULL""")
def _(spark, sf):
    df = core(spark, sf).withColumn("w", parse_strip("berat_badan"))
    return D.drop_null_or_nonfinite(df, "day", "file_ts", finite="w").select("id_kunjungan", "day", "w")


@query("d10_clamp_window", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity
FROM lineitem WHERE l_quantity BETWEEN 10.5 AND 40""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return D.clamp_window(df, "l_quantity", 10.5, 40.0)


@query("d11_outside_rule", f"""WITH {LINE_LONG_SQL}, {RULES_SQL}
SELECT "Variabel", count(*) AS n FROM line_long JOIN rules ON "Variable" = "Variabel"
WHERE "Value" < min_ok OR "Value" > max_ok GROUP BY 1""")
def _(spark, sf):
    long = J.to_long(table(spark, sf, "lineitem"), [], LINEITEM_VARS)
    ruled = E.with_rules(long, line_rules(spark), "Variabel", LINEITEM_VARS)
    return A.count_by(D.outside_rule(ruled, "Value"), ["Variabel"])


@query("d12_any_present", f"""WITH {VISITS_SQL} SELECT id_kunjungan, nik, dokter_tenaga_medis FROM visits
WHERE nik IS NOT NULL OR dokter_tenaga_medis IS NOT NULL""")
def _(spark, sf):
    df = visits(spark, sf).select("id_kunjungan", "nik", "dokter_tenaga_medis")
    return D.any_present(df, ["nik", "dokter_tenaga_medis"])


_long_tenth = rr('"Value" - floor("Value")', 1)
SLOTS_SQL = f"""{LONG_SQL}, digits AS (
  SELECT *, abs("Value" - round("Value")) < 1e-8 AS is_int,
         CAST(floor(abs("Value")) % 10 AS BIGINT) AS d, {_long_tenth} AS t FROM long)"""


@query("d13_nonzero_tenth", f"""WITH {SLOTS_SQL}
SELECT "Variabel", t AS tenth, count(*) AS n FROM digits WHERE NOT is_int AND t <> 0 GROUP BY ALL""")
def _(spark, sf):
    buckets = bucket_counts(events_long(spark, sf), ["Variabel"]).filter("kind = 'dec'")
    return D.nonzero_tenth(buckets).select("Variabel", "tenth", "n")


@query("d14_parse_failures", f"""WITH {VISITS_SQL} SELECT id_kunjungan, berat_badan AS "Original" FROM visits
WHERE {strip_sql('berat_badan')} IS NULL AND berat_badan <> ''""")
def _(spark, sf):
    df = visits(spark, sf).select(
        "id_kunjungan", F.col("berat_badan").alias("Original"), parse_strip("berat_badan").alias("Parsed"))
    return D.parse_failures(df).drop("Parsed")


# --- E: joins -----------------------------------------------------------------------------------

LATEST_SQL = """latest AS (
  SELECT day, file_name, order_ts FROM (
    SELECT *, row_number() OVER (PARTITION BY day ORDER BY order_ts DESC NULLS LAST, file_name) AS r
    FROM (SELECT day, file_name, max(file_ts_fallback) AS order_ts FROM {src}
          WHERE day BETWEEN DATE '{a}' AND DATE '{b}' GROUP BY day, file_name)) WHERE r = 1)"""


def latest_sql(src: str, a: str, b: str) -> str:
    return LATEST_SQL.format(src=src, a=a, b=b)


@query("e1_semi_latest_files", f"""WITH {CORE_SQL}, {latest_sql('core', '2024-01-01', '2024-01-31')}
SELECT id_kunjungan, core.day, core.file_name FROM core
WHERE EXISTS (SELECT 1 FROM latest l WHERE l.day = core.day AND l.file_name IS NOT DISTINCT FROM core.file_name)""")
def _(spark, sf):
    df = core(spark, sf)
    latest = G.latest_file_per_day(df, "2024-01-01", "2024-01-31")
    return E.semi_latest_files(df, latest, max_rows=31).select("id_kunjungan", "day", "file_name")


@query("e2_semi_latest_file", f"""WITH {CORE_SQL}, {latest_sql('core', '2024-01-12', '2024-01-12')}
SELECT id_kunjungan, core.day, core.file_name FROM core JOIN latest USING (day, file_name)""")
def _(spark, sf):
    df = core(spark, sf)
    latest = G.latest_file_for_day(df, "2024-01-12").withColumn("day", F.lit(dt.date(2024, 1, 12)))
    return E.semi_latest_files(df, latest, max_rows=1).select("id_kunjungan", "day", "file_name")


@query("e3_with_denominator", f"""WITH {LONG_SQL}, c AS (
  SELECT "Tanggal", "Variabel", CAST(floor("Value") % 10 AS BIGINT) AS digit, count(*) AS n FROM long GROUP BY ALL),
t AS (SELECT "Tanggal", "Variabel", count(*) AS "Total_n" FROM long GROUP BY ALL)
SELECT c.*, "Total_n", n / "Total_n" AS prop FROM c LEFT JOIN t USING ("Tanggal", "Variabel")""")
def _(spark, sf):
    digit = (F.floor("Value") % 10).cast("bigint").alias("digit")
    counts = A.count_by(events_long(spark, sf).select("Tanggal", "Variabel", digit),
                        ["Tanggal", "Variabel", "digit"])
    return E.with_denominator(counts, ["Tanggal", "Variabel"])


@query("e4_combine_int_dec", f"""WITH {SLOTS_SQL},
den AS (SELECT "Tanggal", "Variabel", count(*) AS "Total_n" FROM long GROUP BY ALL),
i AS (SELECT "Tanggal", "Variabel", d, count(*) AS n FROM digits WHERE is_int GROUP BY ALL),
f AS (SELECT "Tanggal", "Variabel", t, count(*) AS n FROM digits WHERE NOT is_int AND t <> 0 GROUP BY ALL),
ip AS (SELECT "Tanggal", "Variabel", CAST(sum(CASE WHEN n / "Total_n" >= 0.15 THEN n ELSE 0 END) AS BIGINT) AS p
       FROM i JOIN den USING ("Tanggal", "Variabel") GROUP BY ALL),
fp AS (SELECT "Tanggal", "Variabel", CAST(sum(CASE WHEN n / "Total_n" >= 0.15 THEN n ELSE 0 END) AS BIGINT) AS p
       FROM f JOIN den USING ("Tanggal", "Variabel") GROUP BY ALL)
SELECT den.*, coalesce(ip.p, 0) AS "Int_pref_n", coalesce(fp.p, 0) AS "Dec_pref_n"
FROM den LEFT JOIN ip USING ("Tanggal", "Variabel") LEFT JOIN fp USING ("Tanggal", "Variabel")""")
def _(spark, sf):
    keys = ["Tanggal", "Variabel"]
    long = events_long(spark, sf)
    buckets = bucket_counts(long, keys)
    ints = buckets.filter("kind = 'int'").groupBy(*keys).agg(A.preferred_n().alias("Int_pref_n"))
    decs = D.nonzero_tenth(buckets.filter("kind = 'dec'")).groupBy(*keys).agg(
        A.preferred_n().alias("Dec_pref_n"))
    return E.combine_int_dec(A.count_by(long, keys, "Total_n"), ints, decs, keys)


@query("e5_with_rules", f"""WITH {LINE_LONG_SQL}, {RULES_SQL}
SELECT "Variabel", min_ok, max_ok, count(*) AS n FROM line_long
LEFT JOIN (SELECT * FROM rules WHERE "Variable" <> 'l_tax') r ON "Variable" = "Variabel" GROUP BY ALL""")
def _(spark, sf):
    long = J.to_long(table(spark, sf, "lineitem"), [], LINEITEM_VARS)
    rules = line_rules(spark).filter("Variable <> 'l_tax'")
    joined = E.with_rules(long, rules, "Variabel", LINEITEM_VARS)
    return A.count_by(joined, ["Variabel", "min_ok", "max_ok"])


ORDER_RULES = [("o_totalprice", 50000.0, 400000.0), ("o_custkey", 10.0, 1.0e9)]


def order_rules(spark):
    return spark.createDataFrame(ORDER_RULES, RULES_SCHEMA)


@query("e6_flags_with_log", """WITH f AS (
  SELECT o_orderkey AS row_id, 'o_totalprice' AS "Variable", o_totalprice < 50000 OR o_totalprice > 400000 AS is_out, o_totalprice AS v FROM orders
  UNION ALL SELECT o_orderkey, 'o_custkey', o_custkey < 10, o_custkey FROM orders)
SELECT row_id, "Variable", is_out, is_out AS logged FROM f""")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    rules = order_rules(spark)
    log = outlier_log(orders, rules, [v for v, _, _ in ORDER_RULES], "o_orderkey")
    flags = J.to_long(orders, ["o_orderkey"], ["o_totalprice", "o_custkey"], "Variable", "value")
    flags = E.with_rules(flags, rules, "Variable", ["o_totalprice", "o_custkey"]).select(
        F.col("o_orderkey").alias("row_id"), "Variable",
        (~F.col("value").between(F.col("min_ok"), F.col("max_ok"))).alias("is_out"))
    joined = E.flags_with_log(flags, log)
    return joined.select("row_id", "Variable", "is_out", F.col("raw_value").isNotNull().alias("logged"))


@query("e7_rule_for", f"""WITH {EVENTS_SQL}, ranked AS (
  SELECT event_type AS "Variable", value AS min_ok, value + user_id AS max_ok,
         row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events_v)
SELECT "Variable", min_ok, max_ok FROM ranked WHERE r = 1""")
def _(spark, sf):
    from fieldcheck.sources.readers import first_rule

    rules = table(spark, sf, "events").select(
        F.col("event_type").alias("Variable"), F.col("value").alias("min_ok"),
        (F.col("value") + F.col("user_id")).alias("max_ok"), "event_id")
    return first_rule(rules, "event_id")


# --- F: aggregates -----------------------------------------------------------------------------


@query("f1_count_by", f"""WITH {LONG_SQL} SELECT "Tanggal", "Variabel", count(*) AS n FROM long GROUP BY ALL""")
def _(spark, sf):
    return A.count_by(events_long(spark, sf), ["Tanggal", "Variabel"])


@query("f2_bucket_counts", f"""WITH {SLOTS_SQL}, b AS (
  SELECT "Tanggal", "Variabel", CASE WHEN is_int THEN 'int' ELSE 'dec' END AS kind,
         CASE WHEN is_int THEN d END AS digit, CASE WHEN NOT is_int THEN t END AS tenth, count(*) AS n
  FROM digits GROUP BY ALL)
SELECT b.*, CAST(sum(n) OVER (PARTITION BY "Tanggal", "Variabel") AS BIGINT) AS "Total_n",
       n / sum(n) OVER (PARTITION BY "Tanggal", "Variabel") AS prop,
       {rr('n / sum(n) OVER (PARTITION BY "Tanggal", "Variabel") * 100.0', 1)} AS prop_pct FROM b""")
def _(spark, sf):
    return bucket_counts(events_long(spark, sf))


BUCKETS_SQL = f"""{SLOTS_SQL}, counted AS (
  SELECT "Tanggal", "Variabel", is_int, CASE WHEN is_int THEN d END AS digit,
         CASE WHEN NOT is_int THEN t END AS tenth, count(*) AS n FROM digits GROUP BY ALL),
buckets AS (SELECT *, n / sum(n) OVER (PARTITION BY "Tanggal", "Variabel") AS prop FROM counted)"""


@query("f3_preferred_n", f"""WITH {BUCKETS_SQL}
SELECT "Tanggal", "Variabel", CAST(sum(CASE WHEN prop >= 0.15 THEN n ELSE 0 END) AS BIGINT) AS pref_n
FROM buckets WHERE is_int OR tenth <> 0 GROUP BY ALL""")
def _(spark, sf):
    buckets = bucket_counts(events_long(spark, sf)).filter("kind = 'int' OR tenth <> 0")
    return buckets.groupBy("Tanggal", "Variabel").agg(A.preferred_n().alias("pref_n"))


@query("f4_preferred_list", f"""WITH {BUCKETS_SQL}
SELECT "Tanggal", "Variabel",
  coalesce(string_agg(printf('%.1f', tenth), ', ' ORDER BY tenth) FILTER (prop >= 0.15), '-') AS "Preferred",
  coalesce(string_agg(printf('%.1f%%', {rr('prop * 100.0', 1)}), ', ' ORDER BY tenth) FILTER (prop >= 0.15), '-') AS "Preferred_Prop"
FROM buckets WHERE NOT is_int AND tenth <> 0 GROUP BY ALL""")
def _(spark, sf):
    decs = D.nonzero_tenth(bucket_counts(events_long(spark, sf)).filter("kind = 'dec'"))
    return A.preferred_list(decs, ["Tanggal", "Variabel"], "tenth", F.format_string("%.1f", F.col("tenth")))


@query("f5_max_prop", f"""WITH {BUCKETS_SQL}
SELECT "Tanggal", "Variabel", max(prop) * 100.0 AS max_pct FROM buckets
WHERE is_int OR tenth <> 0 GROUP BY ALL""")
def _(spark, sf):
    buckets = bucket_counts(events_long(spark, sf)).filter("kind = 'int' OR tenth <> 0")
    return buckets.groupBy("Tanggal", "Variabel").agg(A.max_prop().alias("max_pct"))


_texts = ["nama_pasien", "nik", "no_telp", "diagnosa_1", "lingkar_perut", "file_name"]


@query("f6_distinct_nonmissing", f"WITH {VISITS_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"Variable\", count(DISTINCT {filled_sql(c)}) AS distinct_n FROM visits" for c in _texts))
def _(spark, sf):
    return A.distinct_nonmissing(visits(spark, sf), _texts)


def _quantile_cols(v: str) -> str:
    names = {"q_min": 0, "q1": 0.25, "median": 0.5, "q3": 0.75, "q_max": 1}
    return ", ".join(f"{rr2(f'q_{i}')} AS {n}" for i, n in enumerate(names))


def quantile_sql(source: str, keys: str, value: str) -> str:
    inner = ", ".join(f"quantile_cont({value}, {p}) AS q_{i}" for i, p in enumerate((0, 0.25, 0.5, 0.75, 1)))
    return f"SELECT {keys}, {_quantile_cols(value)} FROM (SELECT {keys}, {inner} FROM {source} GROUP BY ALL)"


@query("f7_quantiles", f"""WITH {LINE_LONG_SQL} {quantile_sql('line_long', '"Variabel"', '"Value"')}""")
def _(spark, sf):
    long = J.to_long(table(spark, sf, "lineitem"), [], LINEITEM_VARS)
    found = A.quantiles(A.value_counts(long, ["Variabel"], "Value"), ["Variabel"])
    return found.select("Variabel", *[round2(c).alias(c) for c in ("q_min", "q1", "median", "q3", "q_max")])


@query("f7_quantiles_daily", f"""WITH {LONG_SQL} {quantile_sql('long', '"Tanggal", "Variabel"', '"Value"')}""")
def _(spark, sf):
    keys = ["Tanggal", "Variabel"]
    found = A.quantiles(A.value_counts(events_long(spark, sf), keys, "Value"), keys)
    return found.select(*keys, *[round2(c).alias(c) for c in ("q_min", "q1", "median", "q3", "q_max")])


_EPOCH_MS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts) div 1000"


@query("f7_quantiles_narrow", """SELECT event_type AS "Variabel", """ + ", ".join(
    f"quantile_cont((epoch_us(ts) // 1000)::DOUBLE, {p}) AS {n}" for n, p in (("q_min", 0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("q_max", 1)))
    + " FROM events GROUP BY 1")
def _(spark, sf):
    """Times lie so close to each other that a few order bins hold them all."""
    long = table(spark, sf, "events").select(F.col("event_type").alias("Variabel"), F.expr(_EPOCH_MS).cast("double").alias("value"))
    return A.quantiles(A.value_counts(long, ["Variabel"]), ["Variabel"])


@query("g3_row_number_epoch", """SELECT event_id, event_type,
  row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000 * 1000000 + event_id) AS row_id FROM events""")
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type", (F.expr(_EPOCH_MS) * 1000000 + F.col("event_id")).alias("t"))
    return G.with_row_number(df, ["event_type"], "t").select("event_id", "event_type", "row_id")


@query("f7_quantiles_approx", f"""WITH {LINE_LONG_SQL}
SELECT "Variabel", {rr2('lo')} AS lo, {rr2('hi')} AS hi, med BETWEEN lo AND hi AS rank_close FROM (
  SELECT "Variabel", quantile_cont("Value", 0.49) AS lo, quantile_cont("Value", 0.51) AS hi,
         quantile_disc("Value", 0.5) AS med FROM line_long GROUP BY 1)""")
def _(spark, sf):
    """The sketch's median must lie between the exact 0.49 and 0.51 quantiles."""
    long = J.to_long(table(spark, sf, "lineitem"), [], LINEITEM_VARS)
    approx = A.quantiles_approx(long, ["Variabel"], "Value", (0.5,), ("median",))
    exact = A.quantiles(A.value_counts(long, ["Variabel"], "Value"), ["Variabel"], (0.49, 0.51), ("lo", "hi"))
    return approx.join(exact, "Variabel").select(
        "Variabel", round2("lo").alias("lo"), round2("hi").alias("hi"),
        F.col("median").between(F.col("lo"), F.col("hi")).alias("rank_close"))


@query("f8_basic_stats", f"""WITH {LINE_LONG_SQL}
SELECT "Variabel", count(*) AS n, {rr('avg("Value")', 4)} AS mean, {rr2('quantile_cont("Value", 0.5)')} AS median,
  min("Value") AS min, max("Value") AS max, max("Value") - min("Value") AS range FROM line_long GROUP BY 1""")
def _(spark, sf):
    long = J.to_long(table(spark, sf, "lineitem"), [], LINEITEM_VARS)
    stats = A.basic_stats(A.value_counts(long, ["Variabel"], "Value"), ["Variabel"])
    return stats.withColumns({"mean": r_round("mean", 4), "median": round2("median")})


def null_counts_sql(source: str, cols: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{v}' AS "Variabel", count(*) AS n, count(x) AS "n_nonNA", count(*) - count(x) AS "n_NA",
        {rr('(count(*) - count(x)) / count(*) * 100.0', 2)} AS "prop_NA", min(x) AS min, max(x) AS max
        FROM (SELECT {e} AS x FROM {source})""" for v, e in cols.items())


@query("f9_null_counts", f"WITH {VISITS_SQL} " + null_counts_sql(
    "visits", {c: strip_sql(c) for c in FRIENDLY.values()}))
def _(spark, sf):
    df = visits(spark, sf).select(*[parse_strip(c).alias(c) for c in FRIENDLY.values()])
    return A.null_counts(df, df.columns)


@query("f10_ratio_total", f"""WITH {LONG_SQL}, g AS (
  SELECT "Tanggal", "Variabel", count(*) AS den, count(*) FILTER ("Value" > 50) AS num FROM long GROUP BY ALL)
SELECT "Tanggal", CAST(sum(num) AS BIGINT) AS num, CAST(sum(den) AS BIGINT) AS den,
       {rr('100.0 * sum(num)::DOUBLE / sum(den)::DOUBLE', 2)} AS pct
FROM g GROUP BY 1""")
def _(spark, sf):
    groups = events_long(spark, sf).groupBy("Tanggal", "Variabel").agg(
        F.count(F.lit(1)).alias("den"), F.count_if(F.col("Value") > 50).alias("num"))
    return A.ratio_total(groups)


@query("f11_mean_pct", f"""WITH {LONG_SQL}, g AS (
  SELECT "Tanggal", "Variabel", 100.0 * count(*) FILTER ("Value" > 50) / count(*) AS pct FROM long GROUP BY ALL)
SELECT "Tanggal", {rr('avg(pct)', 6)} AS "Average_Prop" FROM g GROUP BY 1""")
def _(spark, sf):
    pct = 100.0 * F.count_if(F.col("Value") > 50) / F.count(F.lit(1))
    daily = events_long(spark, sf).groupBy("Tanggal", "Variabel").agg(pct.alias("pct"))
    return A.mean_pct(daily, pct="pct").withColumn("Average_Prop", r_round("Average_Prop", 6))


@query("f12_any_flag", """SELECT o_orderkey,
  coalesce(o_totalprice < 50000 OR o_totalprice > 400000, false) OR coalesce(o_custkey < 10, false) AS any_outlier
FROM orders""")
def _(spark, sf):
    flagged = B.clip_to_null(table(spark, sf, "orders"), {v: (a, b) for v, a, b in ORDER_RULES})
    return flagged.select("o_orderkey", A.any_flag(["out_o_totalprice", "out_o_custkey"]).alias("any_outlier"))


@query("f13_max_day", f"WITH {CORE_SQL} SELECT max(day) AS max_day FROM core")
def _(spark, sf):
    return A.max_day(core(spark, sf))


@query("f14_max_file_time", f"""WITH {CORE_SQL}
SELECT day, file_name, CAST(epoch_ms(max(file_ts_fallback) - INTERVAL 8 HOUR) AS BIGINT) AS order_ms
FROM core GROUP BY ALL""")
def _(spark, sf):
    latest = A.max_file_time(core(spark, sf))
    return latest.select("day", "file_name", F.unix_millis("file_ts_fallback").alias("order_ms"))


# --- G, H: rankings and sorts ------------------------------------------------------------------


@query("g1_latest_file_per_day", f"""WITH {CORE_SQL}, {latest_sql('core', '2024-01-01', '2024-01-31')}
SELECT day, file_name FROM latest""")
def _(spark, sf):
    return G.latest_file_per_day(core(spark, sf), "2024-01-01", "2024-01-31").select("day", "file_name")


@query("g1_latest_file_per_site_day", f"""WITH {CORE_SQL}
SELECT "PKM_norm", day, file_name FROM (
  SELECT *, row_number() OVER (PARTITION BY "PKM_norm", day ORDER BY order_ts DESC NULLS LAST, file_name) AS r
  FROM (SELECT "PKM_norm", day, file_name, max(file_ts_fallback) AS order_ts FROM core
        WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY ALL)) WHERE r = 1""")
def _(spark, sf):
    latest = G.latest_file_per_day(core(spark, sf), "2024-01-01", "2024-01-31", group=["PKM_norm"])
    return latest.select("PKM_norm", "day", "file_name")


@query("g2_latest_file_for_day", f"""WITH {CORE_SQL}, {latest_sql('core', '2024-01-12', '2024-01-12')}
SELECT file_name FROM latest""")
def _(spark, sf):
    return G.latest_file_for_day(core(spark, sf), "2024-01-12").select("file_name")


@query("g3_with_row_id", """SELECT l_orderkey, l_partkey, l_linenumber,
  sha256(concat_ws(chr(31), l_orderkey, l_partkey, l_linenumber)) AS row_id FROM lineitem""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return G.with_row_id(df, ["l_orderkey", "l_partkey", "l_linenumber"])


@query("g3_with_row_number", """SELECT event_id, user_id,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS row_id FROM events""")
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id")
    return G.with_row_number(df, ["user_id"], "event_id")


@query("g4_top_bins", """WITH b AS (
  SELECT floor(l_quantity / 5 + 1e-7) * 5 AS "left", count(*) AS n FROM lineitem GROUP BY 1)
SELECT 'l_quantity' AS "Variable", r AS rank, "left", n AS count FROM (
  SELECT *, row_number() OVER (ORDER BY n DESC, "left") AS r FROM b) WHERE r <= 5""")
def _(spark, sf):
    hist = histogram(table(spark, sf, "lineitem"), ["l_quantity"], 5.0)
    return G.top_bins(hist, 5).select("Variable", "rank", "left", "count")


@query("g5_preview", "SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 100")
def _(spark, sf):
    return G.preview(table(spark, sf, "events").select("event_id", "event_type", "value"), 100, ["event_id"])


@query("g6_shared_max", f"""WITH {LONG_SQL}, c AS (
  SELECT CASE WHEN "Tanggal" >= DATE '2024-01-16' THEN 'Current' ELSE 'Previous' END AS period, "Variabel",
         count(*) AS count FROM long GROUP BY ALL)
SELECT *, max(count) OVER (PARTITION BY "Variabel") AS shared_max FROM c""")
def _(spark, sf):
    period = F.when(F.col("Tanggal") >= "2024-01-16", "Current").otherwise("Previous")
    counts = A.count_by(events_long(spark, sf).withColumn("period", period), ["period", "Variabel"], "count")
    return G.shared_max(counts, ["Variabel"])


@query("h1_order_desc", f"""WITH {LONG_SQL} SELECT "Variabel", "Tanggal", count(*) AS n FROM long GROUP BY ALL
ORDER BY n DESC, "Variabel", "Tanggal\"""")
def _(spark, sf):
    counts = A.count_by(events_long(spark, sf), ["Variabel", "Tanggal"])
    return G.order_desc(counts, "n", "Variabel", "Tanggal")


@query("h2_order_by", f"""WITH {LONG_SQL} SELECT "Tanggal", "Variabel", count(*) AS n FROM long GROUP BY ALL
ORDER BY "Tanggal", "Variabel\"""")
def _(spark, sf):
    return G.order_by(A.count_by(events_long(spark, sf), ["Tanggal", "Variabel"]), "Tanggal", "Variabel")


@query("h3_order_by_rate", f"""WITH {VISITS_SQL}
SELECT poliruangan, count({filled_sql('nik')}) / count(*) AS rate FROM visits GROUP BY 1 ORDER BY rate, poliruangan""")
def _(spark, sf):
    rates = visits(spark, sf).groupBy("poliruangan").agg(
        (F.count(blank_to_null("nik")) / F.count(F.lit(1))).alias("rate"))
    return G.order_by_rate(rates, "rate", "poliruangan")


# --- I: sets -----------------------------------------------------------------------------------


@query("i1_union_frames", """SELECT event_id, value, NULL::VARCHAR AS event_type, user_id FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-20'
UNION ALL SELECT event_id, value, event_type, NULL::BIGINT FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-20'""")
def _(spark, sf):
    df = events(spark, sf)
    old = df.filter("day <= DATE '2024-01-20'").select("event_id", "value", "user_id")
    new = df.filter("day > DATE '2024-01-20'").select("event_type", "event_id", "value")
    return J.union_frames(old, new)


@query("i2_distinct_rows", "SELECT event_id, user_id, value FROM events")
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id", "value")
    return J.distinct_rows(df.unionByName(df))


@query("i3_distinct_values", f"""WITH {CORE_SQL} SELECT DISTINCT file_name FROM core ORDER BY 1""")
def _(spark, sf):
    return J.distinct_values(core(spark, sf), "file_name")


# --- J: reshape ---------------------------------------------------------------------------------


@query("j1_to_long", f"""SELECT l_returnflag, "Variabel", "Value" FROM (
  {unpivot_sql('lineitem', ['l_returnflag'], {v: v for v in LINEITEM_VARS})})""")
def _(spark, sf):
    return J.to_long(table(spark, sf, "lineitem"), ["l_returnflag"], LINEITEM_VARS)


@query("j2_to_wide", f"WITH {LONG_SQL} SELECT \"Variabel\", " + ", ".join(
    f"coalesce(CAST(nullif(count(*) FILTER (\"Tanggal\" = DATE '{d}' AND \"Value\" > 100), 0) AS VARCHAR), '-') AS \"{d}\""
    for d in DAYS) + " FROM long GROUP BY 1")
def _(spark, sf):
    labels = A.count_by(events_long(spark, sf).filter("Value > 100"), ["Tanggal", "Variabel"])
    return J.to_wide(labels.withColumn("label", F.col("n").cast("string")), DAYS)


@query("j3_status_long", f"""WITH {VISITS_SQL}, p AS (
  SELECT count(*) AS n, count({filled_sql('berat_badan')}) AS filled,
    count(*) FILTER ({filled_sql('berat_badan')} IS NOT NULL AND NOT coalesce({first_number_sql('berat_badan', False)} BETWEEN 1 AND 95, false)) AS bad FROM visits)
SELECT 'Berat Badan' AS "Variable_lbl", s AS "Status", o::BIGINT AS "Status_order",
  {rr('''CASE s WHEN 'Missing' THEN (n - filled) / n WHEN 'Invalid' THEN bad / n
       ELSE greatest(0.0, 1.0 - (n - filled) / n - bad / n) END''', 6)} AS "Rate"
FROM p, (VALUES ('Valid', 1), ('Invalid', 2), ('Missing', 3)) t(s, o)""")
def _(spark, sf):
    from fieldcheck.plans.profile import status_composition

    rules = spark.createDataFrame([("berat_badan", 1.0, 95.0)], RULES_SCHEMA)
    table_ = profile(visits(spark, sf), ["berat_badan"], rules, kinds={"berat_badan": "numeric"})
    return status_composition(table_).withColumn("Rate", r_round("Rate", 6))


# --- K: scopes ----------------------------------------------------------------------------------


@query("k1_available_days", f"WITH {CORE_SQL} SELECT DISTINCT day FROM core WHERE day IS NOT NULL ORDER BY 1")
def _(spark, sf):
    return K.available_days(core(spark, sf))


_picks = [dt.date(1996, 3, 1), dt.date(1996, 2, 15), dt.date(1996, 5, 16), dt.date(1997, 8, 29),
          dt.date(2035, 1, 1), dt.date(1970, 1, 1)]


# Order months as days: gaps of a month, with a tie in the middle of April to May.
@query("k2_resolve_day", f"""WITH d AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS day FROM orders),
pick AS (SELECT * FROM (VALUES {', '.join(f"(DATE '{p}')" for p in _picks)}) t(sel))
SELECT sel, day AS resolved_day FROM (
  SELECT sel, day, row_number() OVER (PARTITION BY sel ORDER BY abs(day - sel), day) AS r FROM pick, d) WHERE r = 1""")
def _(spark, sf):
    df = table(spark, sf, "orders").select(F.trunc("o_orderdate", "month").alias("day"))
    rows = [K.resolve_day(df, p).select(F.lit(p).alias("sel"), "resolved_day") for p in _picks]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query("k3_range_window", """SELECT event_id, least(d, e) AS range_start, greatest(d, e) AS range_end FROM (
  SELECT event_id, CAST(ts AS DATE) AS d, DATE '2024-01-15' AS e FROM events)""")
def _(spark, sf):
    d, e = F.col("day"), F.lit(dt.date(2024, 1, 15))
    start, end = K.range_of(d, e)
    return events(spark, sf).select("event_id", start.alias("range_start"), end.alias("range_end"))


@query("k4_previous_window", """SELECT event_id, s - CAST(e - s AS INTEGER) - 1 AS prev_start, s - 1 AS prev_end FROM (
  SELECT event_id, least(CAST(ts AS DATE), DATE '2024-01-15') AS s, greatest(CAST(ts AS DATE), DATE '2024-01-15') AS e FROM events)""")
def _(spark, sf):
    start, end = K.previous_of(*K.range_of(F.col("day"), F.lit(dt.date(2024, 1, 15))))
    return events(spark, sf).select("event_id", start.alias("prev_start"), end.alias("prev_end"))


@query("k5_week_window", """SELECT event_id, CAST(date_trunc('week', ts) AS DATE) AS week_start,
  CAST(date_trunc('week', ts) AS DATE) + 6 AS week_end FROM events""")
def _(spark, sf):
    start, end = K.week_of("day")
    return events(spark, sf).select("event_id", start.alias("week_start"), end.alias("week_end"))


@query("k6_month_window", """SELECT event_id, CAST(date_trunc('month', ts) AS DATE) AS month_start,
  last_day(CAST(ts AS DATE)) AS month_end FROM events""")
def _(spark, sf):
    start, end = K.month_of("day")
    return events(spark, sf).select("event_id", start.alias("month_start"), end.alias("month_end"))


def _scope_sql(a: str, b: str, period: str = "") -> str:
    mark = f", '{period}' AS period" if period else ""
    return f"""SELECT id_kunjungan, day, file_name{mark} FROM core WHERE (day, file_name) IN (
      SELECT (day, file_name) FROM (SELECT day, file_name, row_number() OVER (
        PARTITION BY day ORDER BY max(file_ts_fallback) DESC NULLS LAST, file_name) AS r
        FROM core WHERE day BETWEEN DATE '{a}' AND DATE '{b}' GROUP BY day, file_name) WHERE r = 1)"""


def _scoped(spark, sf, *scope):
    frame = K.scope_frame(core(spark, sf), K.Scope(*scope))
    return frame.select("id_kunjungan", "day", "file_name", *[c for c in ("period",) if c in frame.columns])


@query("k7_scope_day", f"WITH {CORE_SQL} {_scope_sql('2024-01-09', '2024-01-09')}")
def _(spark, sf):
    return _scoped(spark, sf, "day", dt.date(2024, 1, 9))


@query("k7_scope_week", f"WITH {CORE_SQL} {_scope_sql('2024-01-08', '2024-01-14')}")
def _(spark, sf):
    return _scoped(spark, sf, "week", dt.date(2024, 1, 9))


@query("k7_scope_month", f"WITH {CORE_SQL} {_scope_sql('2024-01-01', '2024-01-31')}")
def _(spark, sf):
    return _scoped(spark, sf, "month", dt.date(2024, 1, 9))


@query("k7_scope_range", f"WITH {CORE_SQL} {_scope_sql('2024-01-05', '2024-01-19')}")
def _(spark, sf):
    return _scoped(spark, sf, "range", dt.date(2024, 1, 9), dt.date(2024, 1, 19), dt.date(2024, 1, 5))


@query("k7_scope_range_pair", f"""WITH {CORE_SQL} {_scope_sql('2024-01-16', '2024-01-30', 'Current')}
UNION ALL {_scope_sql('2024-01-01', '2024-01-15', 'Previous')}""")
def _(spark, sf):
    return _scoped(spark, sf, "range_pair", dt.date(2024, 1, 16), dt.date(2024, 1, 16), dt.date(2024, 1, 30))
