"""Queries of the reports: outliers, profile, heaping, histograms, privacy, facilities."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from fieldcheck.constants import (
    CLINICAL_MAP, CLINICAL_VARS, DEFAULT_RULES, PRINT_LABELS, SAFE_COLUMNS, SAFE_REQUIRED,
)
from fieldcheck.functions.numbers import r_round
from fieldcheck.operators import aggregates as A, ranking as G, reshape as J, schema as B, scope as K
from fieldcheck.plans import (
    facility as FC, heaping as H, histogram as HI, outliers as O, privacy as PV, profile as PR,
)
from fieldcheck.queries.base import (
    CORE_SQL, DAYS, LINEITEM_VARS, LONG_SQL, SALTS, VISITS_SQL, core, digits_sql, events_long,
    filled_sql, first_number_sql, norm_sql, pct_sql, person_sql, query, rr, rr2, strip_sql, table,
    trim_sql, utc_ms_sql, visits,
)
from fieldcheck.queries.tables import (
    BUCKETS_SQL, ORDER_RULES, RULES_SQL, SLOTS_SQL, latest_sql, line_rules, null_counts_sql,
    order_rules, unpivot_sql,
)
from fieldcheck.sources.readers import default_rules

FRIENDLY = {f: c[0] for f, c in CLINICAL_MAP.items()}
RULE_OF = {v: (a, b) for v, a, b in DEFAULT_RULES}
REF_DATE = dt.date(2024, 1, 31)

# Friendly numeric columns of all visits, as the schema step leaves them.
CLEAN_SQL = f"""{CORE_SQL},
num AS (SELECT id_kunjungan, poliruangan, day, {', '.join(f'{strip_sql(c)} AS "{f}"' for f, c in FRIENDLY.items())} FROM core)"""


def applied(spark, sf):
    return B.apply_schema(core(spark, sf))


# --- outliers ---------------------------------------------------------------------------


def guardrail_sql(source: str, variables: dict[str, str], rules: dict) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{v}' AS "Variable", {rules[v][0]}::DOUBLE AS "Valid min", {rules[v][1]}::DOUBLE AS "Valid max",
        count(*) AS "Rows", count(x) AS "Non_missing", count(*) FILTER (x < {rules[v][0]} OR x > {rules[v][1]}) AS "Outliers",
        {pct_sql(f'count(*) FILTER (x < {rules[v][0]} OR x > {rules[v][1]}) / nullif(count(x), 0)')} AS "Outlier %"
        FROM (SELECT {e} AS x FROM {source})""" for v, e in variables.items())


@query("l1_guardrail_summary", f"WITH {CLEAN_SQL} " + guardrail_sql(
    "num", {f: f'"{f}"' for f in FRIENDLY}, RULE_OF))
def _(spark, sf):
    return O.guardrail_summary(applied(spark, sf), default_rules(spark), CLINICAL_VARS)


@query("l1_guardrail_lineitem", guardrail_sql(
    "lineitem", {v: v for v in LINEITEM_VARS},
    {"l_quantity": (5, 45), "l_extendedprice": (2000, 90000), "l_discount": (0.01, 0.09), "l_tax": (0, 0.07)}))
def _(spark, sf):
    return O.guardrail_summary(table(spark, sf, "lineitem"), line_rules(spark), LINEITEM_VARS)


_LOG_SQL = " UNION ALL ".join(
    f"""SELECT id_kunjungan AS row_id, poliruangan, '{f}' AS "Variable", {c} AS raw_value
    FROM visits WHERE {first_number_sql(c)} < {RULE_OF[f][0]} OR {first_number_sql(c)} > {RULE_OF[f][1]}"""
    for f, c in FRIENDLY.items())


def raw_named(spark, sf):
    """Visits with the clinical columns as written under their friendly names."""
    v = visits(spark, sf)
    return v.select("id_kunjungan", "poliruangan", *[F.col(c).alias(f) for f, c in FRIENDLY.items()])


@query("l2_outlier_log", f"WITH {VISITS_SQL} {_LOG_SQL}")
def _(spark, sf):
    return O.outlier_log(raw_named(spark, sf), default_rules(spark), CLINICAL_VARS,
                         "id_kunjungan", ["poliruangan"])


@query("l3_outlier_counts", f"""WITH {VISITS_SQL}, log AS ({_LOG_SQL})
SELECT "Variable", poliruangan, count(*) AS n FROM log GROUP BY ALL""")
def _(spark, sf):
    log = O.outlier_log(raw_named(spark, sf), default_rules(spark), CLINICAL_VARS,
                        "id_kunjungan", ["poliruangan"])
    return O.outlier_counts(log)


@query("l4_strict_drop_log", """SELECT o_orderkey AS row_id, o_orderstatus, 'o_totalprice' AS "Variable",
  CAST(o_totalprice AS VARCHAR) AS raw_value FROM orders WHERE o_totalprice < 50000 OR o_totalprice > 400000
UNION ALL SELECT o_orderkey, o_orderstatus, 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_custkey < 10""")
def _(spark, sf):
    return O.strict_drop_log(table(spark, sf, "orders"), order_rules(spark),
                             [v for v, _, _ in ORDER_RULES], "o_orderkey", ["o_orderstatus"])


# --- profile ---------------------------------------------------------------------------------


def profile_sql(source: str, variable: str, *, text: str, missing: str | None = None, distinct: str | None = None,
                invalid: str = "false", label: str = "Invalid (non-missing)", number: str | None = None) -> str:
    """Profile of one variable written per column, as one aggregate over the source."""
    missing = missing or f"{text} IS NULL"
    numbers = ", ".join(
        f"{rr2(f'quantile_cont(x, {p})')} AS \"{n}\"" if number else f'NULL::DOUBLE AS "{n}"'
        for n, p in (("Min", 0), ("Q1", 0.25), ("Median", 0.5), ("Q3", 0.75), ("Max", 1)))
    miss = "count(*) FILTER (m)"
    return f"""SELECT '{variable}' AS "Variable", count(*) AS "Rows", {miss} AS "Missing",
      {pct_sql(f'{miss} / count(*)')} AS "Missing %", count(*) - {miss} AS "Non_missing",
      {pct_sql(f'(count(*) - {miss}) / count(*)')} AS "Non_missing %",
      count(DISTINCT t) FILTER (NOT m) AS "Distinct (non-missing)",
      count(*) FILTER (NOT m AND bad) AS "Invalid (non-missing)", '{label}' AS "Rule", {numbers}
      FROM (SELECT {missing} AS m, {distinct or text} AS t, {invalid} AS bad, {number or 'NULL::DOUBLE'} AS x FROM {source})"""


def _numeric_profile_sql(source: str, v: str, low, high) -> str:
    return profile_sql(source, v, text=f'CAST("{v}" AS VARCHAR)', invalid=f'NOT ("{v}" BETWEEN {low} AND {high})',
                       label="Non-numeric / out-of-range", number=f'"{v}"')


@query("l5_profile_clinical", f"WITH {CLEAN_SQL} " + " UNION ALL ".join(
    _numeric_profile_sql("num", f, *RULE_OF[f]) for f in FRIENDLY))
def _(spark, sf):
    return PR.profile(applied(spark, sf), CLINICAL_VARS, default_rules(spark), REF_DATE)


_CLIPPED_SQL = f"""{CLEAN_SQL}, clipped AS (SELECT {', '.join(
    f'CASE WHEN "{f}" BETWEEN {RULE_OF[f][0]} AND {RULE_OF[f][1]} THEN "{f}" END AS "{f}"' for f in FRIENDLY)} FROM num)"""


@query("l5_profile_clipped", f"WITH {_CLIPPED_SQL} " + " UNION ALL ".join(
    _numeric_profile_sql("clipped", f, *RULE_OF[f]) for f in FRIENDLY))
def _(spark, sf):
    return PR.profile(applied(spark, sf), CLINICAL_VARS, default_rules(spark), REF_DATE, stage="clipped")


@query("l5_profile_lineitem", f"WITH {RULES_SQL} " + " UNION ALL ".join(
    _numeric_profile_sql("lineitem", v, a, b) for v, a, b in
    (("l_quantity", 5, 45), ("l_extendedprice", 2000, 90000), ("l_discount", 0.01, 0.09), ("l_tax", 0, 0.07))))
def _(spark, sf):
    return PR.profile(table(spark, sf, "lineitem"), LINEITEM_VARS, line_rules(spark), REF_DATE,
                      kinds={v: "numeric" for v in LINEITEM_VARS})


# Raw columns: identifiers by their digits, dates, names and numbers as written.
_born = """coalesce(CASE WHEN regexp_matches(tgllahir, '^\\d{4}-') THEN try_strptime(split_part(tgllahir, ' ', 1), '%Y-%m-%d') END,
  try_strptime(replace(tgllahir, '/', '-'), '%d-%m-%Y'), try_strptime(replace(tgllahir, '/', '-'), '%m-%d-%Y'))"""


def _compact_phone(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({c}, '[\\s()\\-]', '', 'g'), '^\\+62', '0'), '[^0-9]', '', 'g')"


RAW_PROFILE_SQL = f"WITH {VISITS_SQL} " + " UNION ALL ".join([
    profile_sql("visits", "nik", text=filled_sql("nik"), label="Invalid length (≠16)",
                invalid=f"length({digits_sql('nik')}) <> 16"),
    profile_sql("visits", "no_telp", text=filled_sql("no_telp"), label="Invalid length (10–12)",
                invalid=f"NOT (length({_compact_phone('no_telp')}) BETWEEN 10 AND 12)"),
    profile_sql("visits", "tgllahir", text=filled_sql("tgllahir"), label="Invalid date",
                invalid=f"NOT coalesce(CAST({_born} AS DATE) BETWEEN DATE '1900-01-01' AND DATE '2024-01-31', false)"),
    profile_sql("visits", "nama_pasien", text=filled_sql("nama_pasien")),
    profile_sql("visits", "berat_badan", text=filled_sql("berat_badan"), label="Non-numeric / out-of-range",
                invalid=f"NOT coalesce({first_number_sql(filled_sql('berat_badan'), False)} BETWEEN 1 AND 95, false)",
                number=first_number_sql(filled_sql("berat_badan"), False)),
])
RAW_KINDS = {"berat_badan": "numeric", "tgllahir": "date"}


def raw_profile(spark, sf):
    rules = spark.createDataFrame([("berat_badan", 1.0, 95.0)], "Variable string, min_ok double, max_ok double")
    return PR.profile(visits(spark, sf), ["nik", "no_telp", "tgllahir", "nama_pasien", "berat_badan"],
                      rules, REF_DATE, kinds=RAW_KINDS)


@query("l5_profile_raw", RAW_PROFILE_SQL)
def _(spark, sf):
    return raw_profile(spark, sf)


@query("b10_rename_for_print", 'SELECT row_number() OVER (ORDER BY "Variable") AS "No.", ' + ", ".join(
    f'"{k}" AS "{v}"' for k, v in PRINT_LABELS.items() if k != "No.") + f" FROM ({RAW_PROFILE_SQL})")
def _(spark, sf):
    return B.rename_for_print(PR.numbered(raw_profile(spark, sf)))


# Anonymized identifiers, from the raw visit columns.
SAFE_SQL = f"""{CORE_SQL}, ids AS (
  SELECT *, nullif({digits_sql('nik')}, '') AS nik_d, nullif({digits_sql('no_telp')}, '') AS tel_d,
         nullif({person_sql('dokter_tenaga_medis')}, '') AS doc,
         nullif({person_sql('perawat_bidan_nutrisionist_sanitarian')}, '') AS staff FROM core),
safe AS (SELECT *,
  CAST(length(nik_d) AS INTEGER) AS nik_len, coalesce(length(nik_d) = 16, false) AS nik_len_ok,
  CAST(length(tel_d) AS INTEGER) AS phone_len, coalesce(length(tel_d) BETWEEN 10 AND 12, false) AS phone_len_ok,
  CASE WHEN length(nik_d) > 4 THEN repeat('•', length(nik_d) - 4) || right(nik_d, 4) ELSE repeat('•', length(nik_d)) END AS nik_masked,
  CASE WHEN length(tel_d) > 3 THEN repeat('•', length(tel_d) - 3) || right(tel_d, 3) ELSE repeat('•', length(tel_d)) END AS phone_masked,
  sha256('salt-a' || nik_d) AS nik_hash, sha256('salt-b' || tel_d) AS phone_hash,
  {filled_sql('nama_pasien')} IS NOT NULL AS name_present,
  'D-' || substr(sha256('salt-c' || doc), 1, 8) AS dokter_pseudo, doc IS NOT NULL AS doctor_present,
  'S-' || substr(sha256('salt-d' || staff), 1, 8) AS staff_pseudo, staff IS NOT NULL AS staff_present FROM ids)"""
_ADMIN = ["NIK", "No Telp", "Nama Pasien", "Dokter / Tenaga Medis", "Diagnosa 1"]
ADMIN_PARTS = [
    profile_sql("safe", "NIK", text="nik_masked", missing="nik_len IS NULL", distinct="nik_hash",
                invalid="NOT nik_len_ok", label="Invalid length (≠16)"),
    profile_sql("safe", "No Telp", text="phone_masked", missing="phone_len IS NULL", distinct="phone_hash",
                invalid="NOT phone_len_ok", label="Invalid length (10–12)"),
    profile_sql("safe", "Nama Pasien", text="CASE WHEN name_present THEN 'present' END"),
    profile_sql("safe", "Dokter / Tenaga Medis", text="dokter_pseudo"),
    profile_sql("safe", "Diagnosa 1", text=filled_sql("diagnosa_1")),
]
ADMIN_SQL = f"""{SAFE_SQL}, admin AS (SELECT "Variable", "Rows", "Missing", "Missing %", "Non_missing", "Non_missing %",
  "Distinct (non-missing)", "Invalid (non-missing)", "Rule" FROM ({' UNION ALL '.join(ADMIN_PARTS)}))"""


def admin_profile(spark, sf):
    safe = PR.admin_aliases(PV.anonymize(core(spark, sf), SALTS))
    return PR.profile_tables(safe, default_rules(spark), _ADMIN, CLINICAL_VARS, REF_DATE)[0]


@query("l5_profile_admin", f"WITH {ADMIN_SQL} SELECT * FROM admin")
def _(spark, sf):
    return admin_profile(spark, sf)


_pretty_admin = """CASE "Variable" WHEN 'No Telp' THEN 'No. Telp' WHEN 'NIK' THEN 'NIK' ELSE "Variable" END"""


@query("l6_admin_completeness", f"""WITH {ADMIN_SQL} SELECT {_pretty_admin} AS "Variable_lbl",
  "Non_missing" / "Rows" AS non_missing_rate, {pct_sql('"Non_missing" / "Rows"')} AS label FROM admin""")
def _(spark, sf):
    return PR.admin_completeness(admin_profile(spark, sf))


@query("l7_status_composition", f"""WITH {ADMIN_SQL}, r AS (SELECT {_pretty_admin} AS "Variable_lbl", "Missing" / "Rows" AS m,
  "Invalid (non-missing)" / "Rows" AS i FROM admin)
SELECT "Variable_lbl", 'Valid' AS "Status", greatest(0.0::DOUBLE, 1.0::DOUBLE - m - i) AS "Rate", 1::BIGINT AS "Status_order" FROM r
UNION ALL SELECT "Variable_lbl", 'Invalid', i, 2 FROM r UNION ALL SELECT "Variable_lbl", 'Missing', m, 3 FROM r""")
def _(spark, sf):
    return PR.status_composition(admin_profile(spark, sf))


@query("l8_numeric_card", f"""WITH {CLEAN_SQL}, p AS ({_numeric_profile_sql('num', 'Sistole', *RULE_OF['Sistole'])})
SELECT "Variable", "Min", "Q1", "Median", "Q3", "Max", "Non_missing" AS "N",
  {pct_sql('"Missing" / "Rows"')} AS missing_pct,
  {pct_sql('"Invalid (non-missing)" / nullif("Non_missing", 0)')} AS invalid_pct,
  50.0::DOUBLE AS min_ok, 260.0::DOUBLE AS max_ok FROM p""")
def _(spark, sf):
    rules = default_rules(spark)
    return PR.numeric_card(PR.profile(applied(spark, sf), CLINICAL_VARS, rules, REF_DATE), rules, "Sistole")


# --- heaping --------------------------------------------------------------------------------------


def heaping_sql(source: str, keys: str) -> str:
    """Heaping by separate passes for totals, digits and tenths, joined: the written-out definition."""
    on = f"USING ({keys})"
    return f"""digits AS (
  SELECT *, abs("Value" - round("Value")) < 1e-8 AS is_int, CAST(floor(abs("Value")) % 10 AS BIGINT) AS d,
         {rr('"Value" - floor("Value")', 1)} AS t FROM {source}),
den AS (SELECT {keys}, count(*) AS "Total_n" FROM {source} GROUP BY ALL),
ic AS (SELECT {keys}, d, n, n / "Total_n" AS prop FROM (SELECT {keys}, d, count(*) AS n FROM digits WHERE is_int GROUP BY ALL) JOIN den {on}),
dc AS (SELECT {keys}, t, n, n / "Total_n" AS prop FROM (SELECT {keys}, t, count(*) AS n FROM digits WHERE NOT is_int AND t <> 0 GROUP BY ALL) JOIN den {on}),
inf AS (SELECT {keys}, coalesce(string_agg(CAST(d AS VARCHAR), ', ' ORDER BY d) FILTER (prop >= 0.15), '-') AS "Int_Preferred_Digits",
  coalesce(string_agg({pct_sql('prop')}, ', ' ORDER BY d) FILTER (prop >= 0.15), '-') AS "Int_Preferred_Digits_Prop",
  CAST(coalesce(sum(n) FILTER (prop >= 0.15), 0) AS BIGINT) AS ip, max(prop * 100.0) AS "Int_Max_Last_Digit_Prop" FROM ic GROUP BY ALL),
def AS (SELECT {keys}, coalesce(string_agg(printf('%.1f', t), ', ' ORDER BY t) FILTER (prop >= 0.15), '-') AS "Dec_Preferred_Tenths",
  coalesce(string_agg({pct_sql('prop')}, ', ' ORDER BY t) FILTER (prop >= 0.15), '-') AS "Dec_Preferred_Tenths_Prop",
  CAST(coalesce(sum(n) FILTER (prop >= 0.15), 0) AS BIGINT) AS dp, max(prop * 100.0) AS "Dec_Max_Tenth_Prop" FROM dc GROUP BY ALL),
heap AS (SELECT {keys}, "Total_n", coalesce(ip, 0) + coalesce(dp, 0) AS "Total_pref_n",
  "Int_Preferred_Digits", "Int_Preferred_Digits_Prop", "Int_Max_Last_Digit_Prop",
  "Dec_Preferred_Tenths", "Dec_Preferred_Tenths_Prop", "Dec_Max_Tenth_Prop",
  {rr('100.0 * (coalesce(ip, 0) + coalesce(dp, 0)) / "Total_n"', 2)} AS "Total_Preferred_Prop"
  FROM den LEFT JOIN inf {on} LEFT JOIN def {on})"""


BY_DAY = '"Tanggal", "Variabel"'
DAILY_SQL = f"{LONG_SQL}, {heaping_sql('long', BY_DAY)}"
_line_long = unpivot_sql("lineitem", [], {v: v for v in LINEITEM_VARS})
_heap_vars = {f: strip_sql(c) for f, c in FRIENDLY.items() if f not in ("Nafas", "Suhu")}
VISIT_LONG_SQL = f"""{CORE_SQL}, long AS (SELECT * FROM ({unpivot_sql('core', ['day AS "Tanggal"'], _heap_vars)})
  WHERE "Value" IS NOT NULL AND "Tanggal" IS NOT NULL)"""


@query("l9_heaping_window", f"""WITH long AS ({_line_long}), {heaping_sql('long', '"Variabel"')} SELECT * FROM heap""")
def _(spark, sf):
    return H.heaping_window(H.heaping_long(table(spark, sf, "lineitem"), LINEITEM_VARS, day=None))


@query("l10_heaping_daily", f"WITH {DAILY_SQL} SELECT * FROM heap")
def _(spark, sf):
    return H.heaping_daily(events_long(spark, sf))


@query("l10_heaping_visits", f"WITH {VISIT_LONG_SQL}, {heaping_sql('long', BY_DAY)} SELECT * FROM heap")
def _(spark, sf):
    return H.heaping_daily(H.heaping_long(applied(spark, sf), CLINICAL_VARS))


@query("l11_heaping_int_counts", f"""WITH {DAILY_SQL}
SELECT {BY_DAY}, d AS int_last_digit, n, "Total_n", prop, {rr('prop * 100.0', 1)} AS prop_pct FROM ic JOIN den USING ({BY_DAY})""")
def _(spark, sf):
    return H.heaping_counts(events_long(spark, sf))[0]


@query("l11_heaping_dec_counts", f"""WITH {DAILY_SQL}
SELECT {BY_DAY}, t AS frac_last_tenth, n, "Total_n", prop, {rr('prop * 100.0', 1)} AS prop_pct FROM dc JOIN den USING ({BY_DAY})""")
def _(spark, sf):
    return H.heaping_counts(events_long(spark, sf))[1]


LABELS_SQL = f"""{DAILY_SQL}, labels AS (SELECT {BY_DAY},
  printf('%.2f%% (%d/%d)', "Total_Preferred_Prop", "Total_pref_n", "Total_n") AS label,
  "Total_Preferred_Prop" AS pct, "Total_pref_n" AS num, "Total_n" AS den FROM heap)"""


def _labels(spark, sf, latest_only=False):
    return H.heaping_labels(H.heaping_daily(events_long(spark, sf)), latest_only)


@query("l12_heaping_labels", f"WITH {LABELS_SQL} SELECT * FROM labels")
def _(spark, sf):
    return _labels(spark, sf)


@query("l12_heaping_labels_latest", f"""WITH {LABELS_SQL} SELECT * FROM labels
WHERE "Tanggal" = (SELECT max("Tanggal") FROM labels)""")
def _(spark, sf):
    return _labels(spark, sf, latest_only=True)


def pivot_sql(average: str, fill: str | None) -> str:
    having = "WHERE num > 0 AND den > 0" if average == "ratio_nonzero" else ""
    avg = "printf('%.2f%% (%d/%d)', {}, CAST(sum(num) AS BIGINT), CAST(sum(den) AS BIGINT))".format(
        rr("100.0 * sum(num)::DOUBLE / sum(den)::DOUBLE", 2))
    if average == "mean":
        avg = f"printf('%.2f%%', {rr('avg(pct)', 2)})"
    cell = "max(label) FILTER (\"Tanggal\" = DATE '{d}')"
    cells = ", ".join((f"coalesce({cell.format(d=d)}, '{fill}')" if fill else cell.format(d=d)) + f' AS "{d}"' for d in DAYS)
    return f"""WITH {LABELS_SQL}, marked AS (SELECT {BY_DAY}, label FROM labels
      UNION ALL SELECT "Tanggal", 'Average', {avg} FROM labels {having} GROUP BY "Tanggal")
      SELECT "Variabel", {cells} FROM marked GROUP BY 1"""


for _average in ("ratio", "ratio_nonzero", "mean"):
    _fill = None if _average == "ratio_nonzero" else "-"

    @query(f"l13_heaping_pivot_{_average}", pivot_sql(_average, _fill))
    def _(spark, sf, average=_average, fill=_fill):
        return H.heaping_pivot(_labels(spark, sf), average, fill, DAYS if average == "mean" else None)


@query("l14_heaping_trend", f"""WITH {DAILY_SQL}, kept AS (SELECT * FROM heap WHERE "Variabel" = 'purchase'
  AND "Tanggal" NOT IN (DATE '2024-01-03', DATE '2024-01-17') AND isodow("Tanggal") <> 7)
SELECT "Tanggal", "Variabel", "Total_Preferred_Prop", "Total_Preferred_Prop" AS "Average_Prop" FROM kept""")
def _(spark, sf):
    daily = H.heaping_daily(events_long(spark, sf))
    return H.heaping_trend(daily, "purchase", "2024-01-03 2024-01-17", without_sundays=True)


@query("l14_heaping_trend_all", f"""WITH {DAILY_SQL}, a AS (
  SELECT "Tanggal", {rr('100.0 * sum("Total_pref_n")::DOUBLE / sum("Total_n")::DOUBLE', 6)} AS "Average_Prop"
  FROM heap WHERE "Total_pref_n" > 0 GROUP BY 1)
SELECT "Tanggal", "Variabel", "Total_Preferred_Prop", "Average_Prop" FROM heap LEFT JOIN a USING ("Tanggal")""")
def _(spark, sf):
    trend = H.heaping_trend(H.heaping_daily(events_long(spark, sf)), average="ratio_nonzero")
    return trend.withColumn("Average_Prop", r_round("Average_Prop", 6))


# --- histograms ----------------------------------------------------------------------------------


def histogram_sql(source: str, width: float, lo: str = "min(x)", hi: str = "max(x)", period: str = "") -> str:
    """Bins of the column ``x`` of ``source`` (which has ``"Variable"``), per period if named."""
    p = f"{period}, " if period else ""
    return f"""lim AS (SELECT lo - (hi - lo) * 0.03 AS lo, hi + (hi - lo) * 0.03 AS hi FROM (SELECT {lo} AS lo, {hi} AS hi FROM {source})),
grid AS (SELECT lo, hi, CAST(floor(lo / {width}) AS BIGINT) AS f, CAST(ceil(hi / {width}) AS BIGINT) - CAST(floor(lo / {width}) AS BIGINT) + 1 AS m FROM lim),
shown AS (SELECT {p}"Variable", x, least(greatest(CAST(floor((x - f * {width}::DOUBLE) / {width} + 1e-7) AS BIGINT), 0), m - 1) AS bin
  FROM {source}, grid WHERE x BETWEEN lo AND hi),
per AS (SELECT {p}"Variable", count(*) AS n_all, {rr2('quantile_cont(x, 0.5)')} AS med, {rr2('avg(x)')} AS mea FROM shown GROUP BY ALL),
cnt AS (SELECT {p}"Variable", bin, count(*) AS c FROM shown GROUP BY ALL),
hist AS (SELECT {p}"Variable", b.bin, (f + b.bin) * {width}::DOUBLE AS "left", (f + b.bin) * {width}::DOUBLE + {width} AS "right",
  coalesce(c, 0) AS count, 100.0 * coalesce(c, 0) / n_all AS percent, n_all AS "N", med AS median, mea AS mean, {width}::DOUBLE AS binwidth
  FROM per CROSS JOIN grid CROSS JOIN LATERAL (SELECT unnest(range(m)) AS bin) b LEFT JOIN cnt USING ({p}"Variable", bin))"""


_price = "src AS (SELECT 'l_extendedprice' AS \"Variable\", l_extendedprice AS x FROM lineitem)"


@query("l15_histogram", f"WITH {_price}, {histogram_sql('src', 2500.0)} SELECT * FROM hist")
def _(spark, sf):
    return HI.histogram(table(spark, sf, "lineitem"), ["l_extendedprice"], 2500.0)


@query("l15_histogram_quantile", f"""WITH {_price}, {histogram_sql(
    'src', 2500.0, 'quantile_cont(x, 0.05)', 'quantile_cont(x, 0.9)')}
SELECT "Variable", bin, "left", "right", count, "N" FROM hist""")
def _(spark, sf):
    hist = HI.histogram(table(spark, sf, "lineitem"), ["l_extendedprice"], 2500.0, "quantile", (0.9, 0.05))
    return hist.select("Variable", "bin", "left", "right", "count", "N")


_weight = f"""{CORE_SQL}, src AS (SELECT 'Sistole' AS "Variable", x FROM (SELECT {strip_sql('sistole')} AS x FROM core) WHERE x IS NOT NULL)"""


@query("l15_histogram_rules", f"WITH {_weight}, {histogram_sql('src', 10.0, 'min(50.0::DOUBLE)', 'max(260.0::DOUBLE)')} SELECT * FROM hist")
def _(spark, sf):
    return HI.histogram(applied(spark, sf), ["Sistole"], 10.0, "rules", rules=default_rules(spark))


@query("l16_auto_binwidth", f"""WITH line_long AS ({_line_long})
SELECT "Variabel" AS "Variable", {rr('2.0 * (q3 - q1) / pow(n, 1.0 / 3.0)', 6)} AS binwidth FROM (
  SELECT "Variabel", count(*)::DOUBLE AS n, quantile_cont("Value", 0.25) AS q1, quantile_cont("Value", 0.75) AS q3
  FROM line_long GROUP BY 1)""")
def _(spark, sf):
    counts = A.value_counts(HI.numbers_long(table(spark, sf, "lineitem"), LINEITEM_VARS), ["Variable"])
    return HI.auto_binwidth(counts).withColumn("binwidth", r_round("binwidth", 6))


_TOP_TEXT = f"""printf('%.0f–%.0f: %d (%.1f%%)', {rr('"left"', 0)}, {rr('"right"', 0)}, count, {rr('percent', 1)})"""


@query("l17_top_bins_report", f"""WITH {_price}, {histogram_sql('src', 2500.0)}
SELECT "Variable", rank, "left", "right", count, percent, {_TOP_TEXT} AS text FROM (
  SELECT *, row_number() OVER (ORDER BY count DESC, "left") AS rank FROM hist WHERE count > 0) WHERE rank <= 7""")
def _(spark, sf):
    hist = HI.histogram(table(spark, sf, "lineitem"), ["l_extendedprice"], 2500.0)
    return HI.top_bins_report(hist, 7)


_windows = """src AS (SELECT 'value' AS "Variable", value AS x,
  CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN 'Current' ELSE 'Previous' END AS period FROM events)"""


@query("l18_histogram_compare", f"""WITH {_windows}, {histogram_sql('src', 20.0, period='period')}
SELECT *, max(count) OVER () AS shared_max FROM hist""")
def _(spark, sf):
    now = (dt.date(2024, 1, 16), dt.date(2024, 1, 30))
    df = table(spark, sf, "events").withColumn("day", F.col("ts").cast("date"))
    df = df.filter(F.col("day").between(K.previous_window(*now)[0], now[1]))
    period = F.when(F.col("day") >= now[0], "Current").otherwise("Previous")
    return HI.histogram_periods(df.withColumn("period", period), "value", 20.0)


# Rules that repeat, and rules with one end: the first rule of a variable counts everywhere.
MIXED_RULES = [("l_quantity", 5.0, None), ("l_quantity", 40.0, 45.0), ("l_tax", None, 0.06), ("l_tax", 0.0, 0.01),
               ("l_discount", 0.01, 0.09), ("l_extendedprice", None, None)]
_MIXED_OUT = {"l_quantity": "l_quantity < 5", "l_tax": "l_tax > 0.06", "l_discount": "l_discount < 0.01 OR l_discount > 0.09"}


@query("e5_first_rule_everywhere", " UNION ALL ".join(
    f"SELECT '{v}' AS \"Variable\", count(*) FILTER ({out}) AS summary, count(*) FILTER ({out}) AS logged, "
    f"count(*) FILTER ({out}) AS dropped, count(*) FILTER ({out}) AS clipped FROM lineitem" for v, out in _MIXED_OUT.items()))
def _(spark, sf):
    """Summary, log, strict drops and clipping agree on repeated and one-sided rules."""
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    df = G.with_row_id(table(spark, sf, "lineitem"), keys)
    rules = spark.createDataFrame(MIXED_RULES, "Variable string, min_ok double, max_ok double").coalesce(1)
    summary = O.guardrail_summary(df, rules, LINEITEM_VARS).select("Variable", F.col("Outliers").alias("summary"))
    logged, dropped = (A.count_by(f(df, rules, LINEITEM_VARS, "row_id", []), ["Variable"], n) for f, n in
                       ((O.outlier_log, "logged"), (O.strict_drop_log, "dropped")))
    clipped = B.clip_to_null(df, B.rules_by_variable(rules, LINEITEM_VARS)).agg(*[
        F.count_if(f"out_{v}").alias(v) for v in _MIXED_OUT]).unpivot([], list(_MIXED_OUT), "Variable", "clipped")
    return summary.join(logged, "Variable").join(dropped, "Variable").join(clipped, "Variable")


_far = "src AS (SELECT 'price' AS \"Variable\", CASE WHEN l_orderkey = 1 AND l_linenumber = 1 THEN 8e10 ELSE l_extendedprice END AS x FROM lineitem)"


@query("l15_histogram_far_value", f"""WITH {_far}, lim AS (
  SELECT min(x) - (max(x) - min(x)) * 0.03 AS lo, max(x) + (max(x) - min(x)) * 0.03 AS hi, count(*) AS n FROM src)
SELECT CAST(ceil(hi / 8000) - floor(lo / 8000) + 1 AS BIGINT) AS bins, n AS total, floor(lo / 8000) * 8000.0 AS first_edge,
  ceil(hi / 8000) * 8000.0 + 8000.0 AS last_edge, (SELECT count(DISTINCT floor(x / 8000.0 + 1e-7)) FROM src) AS filled FROM lim""")
def _(spark, sf):
    """One far value stretches the histogram over more than ten million bins."""
    price = F.when((F.col("l_orderkey") == 1) & (F.col("l_linenumber") == 1), F.lit(8e10)).otherwise(F.col("l_extendedprice"))
    hist = HI.histogram(table(spark, sf, "lineitem").select(price.alias("price")), ["price"], 8000.0)
    return hist.agg(F.count(F.lit(1)).alias("bins"), F.sum("count").alias("total"), F.min("left").alias("first_edge"),
                    F.max("right").alias("last_edge"), F.count_if(F.col("count") > 0).alias("filled"))


@query("l15_histogram_runs", f"""WITH {_far}, lim AS (
  SELECT floor(min(x) - (max(x) - min(x)) * 0.03) AS lo, ceil(max(x) + (max(x) - min(x)) * 0.03) AS hi FROM src),
b AS (SELECT CAST(floor(x + 1e-7) - lo AS BIGINT) AS b, count(*) AS n FROM src, lim GROUP BY ALL),
g AS (SELECT b, n, coalesce(lead(b) OVER (ORDER BY b), CAST(hi - lo + 1 AS BIGINT)) AS nx, row_number() OVER (ORDER BY b) AS k FROM b, lim)
SELECT b AS bin, b AS last_bin, CAST(n AS BIGINT) AS "count" FROM g UNION ALL SELECT b + 1, nx - 1, 0 FROM g WHERE nx > b + 1
UNION ALL SELECT 0, b - 1, 0 FROM g WHERE k = 1 AND b > 0""")
def _(spark, sf):
    """One far value and bins of width 1: more than eighty thousand million bins in few rows."""
    price = F.when((F.col("l_orderkey") == 1) & (F.col("l_linenumber") == 1), F.lit(8e10)).otherwise(F.col("l_extendedprice"))
    return HI.histogram_runs(table(spark, sf, "lineitem").select(price.alias("price")), ["price"], 1.0).select("bin", "last_bin", "count")


@query("l15_histogram_clipped", f"""WITH {CORE_SQL}, src AS (SELECT 'Sistole' AS "Variable", x FROM (SELECT {strip_sql('sistole')} AS x FROM core)
  WHERE x BETWEEN 50 AND 260), {histogram_sql('src', 10.0)} SELECT * FROM hist""")
def _(spark, sf):
    return HI.histogram(applied(spark, sf), ["Sistole"], 10.0, rules=default_rules(spark), stage="clipped")


def _heaping_clipped(keys: str, id_col: str) -> str:
    parts = " UNION ALL ".join(f"""SELECT {id_col}'{f}' AS "Variabel", "{f}" AS "Value" FROM num
      WHERE "{f}" BETWEEN {RULE_OF[f][0]} AND {RULE_OF[f][1]}""" for f in FRIENDLY if f not in ("Nafas", "Suhu"))
    return f"WITH {CLEAN_SQL}, long AS ({parts}), {heaping_sql('long', keys)} SELECT * FROM heap"


@query("l9_heaping_clipped", _heaping_clipped('"Variabel"', ""))
def _(spark, sf):
    long = H.heaping_long(applied(spark, sf), CLINICAL_VARS, day=None, stage="clipped", rules=default_rules(spark))
    return H.heaping_window(long)


@query("l10_heaping_clipped", _heaping_clipped(BY_DAY, 'day AS "Tanggal", ').replace("long AS (", 'long AS (SELECT * FROM (', 1).replace(
    f"), {heaping_sql('long', BY_DAY)}", f') WHERE "Tanggal" IS NOT NULL), {heaping_sql("long", BY_DAY)}', 1))
def _(spark, sf):
    """The date column is guessed from its name."""
    df = applied(spark, sf).drop("Tanggal")
    return H.heaping_daily(H.heaping_long(df, CLINICAL_VARS, stage="clipped", rules=default_rules(spark)))


# --- scans and audits --------------------------------------------------------------------------


@query("l19_na_scan", f"WITH {VISITS_SQL} " + null_counts_sql(
    "visits", {c: strip_sql(c) for c in FRIENDLY.values()}))
def _(spark, sf):
    return H.na_scan(visits(spark, sf), list(FRIENDLY.values()))


@query("l20_parse_audit", f"""WITH {CORE_SQL} SELECT DISTINCT * FROM (""" + " UNION ALL ".join(
    f"""SELECT day AS "Tanggal", '{c}' AS "Variabel", {c} AS "Original" FROM core
    WHERE {c} <> '' AND {strip_sql(c)} IS NULL""" for c in FRIENDLY.values()) + ")")
def _(spark, sf):
    df = core(spark, sf).withColumn("Tanggal", F.col("day"))
    return H.parse_audit(df, list(FRIENDLY.values()))


_SHOWN = ["nik_len", "nik_len_ok", "phone_len", "phone_len_ok", "nik_masked", "phone_masked", "nik_hash",
          "phone_hash", "name_present", "dokter_pseudo", "doctor_present", "staff_pseudo", "staff_present"]


@query("l21_anonymize", f"""WITH {SAFE_SQL} SELECT id_kunjungan, puskesmas_name, day, "PKM", "PKM_norm", suhu,
  {utc_ms_sql('file_ts')} AS file_ms, {utc_ms_sql('tanggal_ts')} AS visit_ms, {', '.join(_SHOWN)} FROM safe""")
def _(spark, sf):
    safe = PV.anonymize(core(spark, sf), SALTS, keep=["id_kunjungan"])
    return safe.select(
        "id_kunjungan", "puskesmas_name", "day", "PKM", "PKM_norm", "suhu",
        F.unix_millis("file_ts").alias("file_ms"), F.unix_millis("tanggal_ts").alias("visit_ms"), *_SHOWN)


_PERSON = """regexp_extract(c_name, '[0-9]+')"""


@query("l22_pii_audit_customer", f"""WITH c AS (SELECT {_PERSON} AS nik, c_name,
  CASE WHEN c_custkey % 3 = 0 THEN repeat('•', 5) || right({_PERSON}, 4) ELSE {_PERSON} END AS nik_masked,
  CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE sha256(c_name) END AS nik_hash,
  '0812' || {_PERSON} AS note FROM customer)
SELECT "check", "column", violations::BIGINT AS violations, violations = 0 AS ok FROM (
  SELECT 'forbidden_absent' AS "check", u AS "column", CASE u WHEN 'nik' THEN 1 ELSE 0 END AS violations
  FROM (SELECT unnest(['nik','no_telp','nama_pasien','alamat','tgllahir','dokter_tenaga_medis','perawat_bidan_nutrisionist_sanitarian']) AS u)
  UNION ALL SELECT 'required_present', u, CASE WHEN u IN ('nik_masked', 'nik_hash') THEN 0 ELSE 1 END
  FROM (SELECT unnest([{', '.join(f"'{c}'" for c in SAFE_REQUIRED)}]) AS u)
  UNION ALL SELECT 'format', 'nik_masked', count(*) FILTER (NOT regexp_matches(nik_masked, '^•+\\d{{4}}$')) FROM c
  UNION ALL SELECT 'format', 'nik_hash', count(*) FILTER (NOT regexp_matches(nik_hash, '^[0-9a-f]{{64}}$')) FROM c
  UNION ALL SELECT 'digit_run', 'nik', count(*) FILTER (regexp_matches(nik, '\\d{{10,}}')) FROM c
  UNION ALL SELECT 'digit_run', 'c_name', count(*) FILTER (regexp_matches(c_name, '\\d{{10,}}')) FROM c
  UNION ALL SELECT 'digit_run', 'nik_masked', count(*) FILTER (regexp_matches(nik_masked, '\\d{{10,}}')) FROM c
  UNION ALL SELECT 'digit_run', 'nik_hash', count(*) FILTER (regexp_matches(nik_hash, '\\d{{10,}}') AND NOT regexp_matches(nik_hash, '^[0-9a-f]{{64}}$')) FROM c
  UNION ALL SELECT 'digit_run', 'note', count(*) FILTER (regexp_matches(note, '\\d{{10,}}')) FROM c)""")
def _(spark, sf):
    digits = F.regexp_extract("c_name", "[0-9]+", 0)
    df = table(spark, sf, "customer").select(
        digits.alias("nik"), "c_name",
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.repeat(F.lit("•"), F.lit(5)), F.right(digits, F.lit(4))))
        .otherwise(digits).alias("nik_masked"),
        F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).otherwise(F.sha2("c_name", 256)).alias("nik_hash"),
        F.concat(F.lit("0812"), digits).alias("note"))
    return PV.pii_audit(df)


_FORMAT_SQL = {"nik_masked": "^(•+\\d{4}|•+)$", "phone_masked": "^(•+\\d{3}|•+)$", "nik_hash": "^[0-9a-f]{64}$",
               "phone_hash": "^[0-9a-f]{64}$", "dokter_pseudo": "^[DS]-[0-9a-f]{8}$", "staff_pseudo": "^[DS]-[0-9a-f]{8}$"}


AUDIT_SQL = f"WITH {SAFE_SQL}, a AS (" + " UNION ALL ".join(
    f"SELECT 'format' AS \"check\", '{c}' AS \"column\", count(*) FILTER (NOT regexp_matches({c}, '{p}')) AS violations FROM safe"
    for c, p in _FORMAT_SQL.items()) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT 'digit_run', '{c}', count(*) FILTER (regexp_matches({c}, '\\d{{10,}}')) FROM safe"
    for c in ("puskesmas_name", "diagnosa_1", "file_name", "nik_masked")) + ') SELECT *, violations = 0 AS ok FROM a'


def audited_rows(audit):
    runs = F.col("column").isin("puskesmas_name", "diagnosa_1", "file_name", "nik_masked") & (F.col("check") == "digit_run")
    return audit.filter((F.col("check") == "format") | runs)


@query("l22_pii_audit_safe", AUDIT_SQL)
def _(spark, sf):
    return audited_rows(PV.pii_audit(PV.anonymize(core(spark, sf), SALTS)))


@query("l22_forbidden_names", """SELECT f AS "column", CASE f WHEN 'nama_pasien' THEN 1 WHEN 'alamat' THEN 1
  WHEN 'nik' THEN (SELECT count(*) FROM customer WHERE c_custkey % 4 <> 0) ELSE 0 END::BIGINT AS violations FROM (SELECT unnest(
  ['nik','no_telp','nama_pasien','alamat','tgllahir','dokter_tenaga_medis','perawat_bidan_nutrisionist_sanitarian']) AS f)""")
def _(spark, sf):
    """Forbidden names in other spellings; a printed ``NIK`` is allowed where it is masked."""
    masked = F.when(F.col("c_custkey") % 4 == 0, F.lit("••••1234")).otherwise(F.col("c_name"))
    df = table(spark, sf, "customer").select(
        F.col("c_name").alias("Nama_Pasien"), F.col("c_name").alias("ALAMAT"), masked.alias("NIK"))
    audit = PV.pii_audit(df, required=[])
    return audit.filter("check = 'forbidden_absent'").select("column", "violations")


@query("b9_project_safe", f"WITH {SAFE_SQL} SELECT " + ", ".join(
    f"{utc_ms_sql(c)} AS {c}" if c in ("file_ts", "tanggal_ts") else f'"{c}"' for c in SAFE_COLUMNS) + " FROM safe")
def _(spark, sf):
    """All columns that may be stored."""
    safe = PV.anonymize(core(spark, sf), SALTS)
    return safe.withColumns({c: F.unix_millis(c) for c in ("file_ts", "tanggal_ts")})


@query("l22_digit_runs_documents", r"""SELECT 'digit_run' AS "check", 'text' AS "column",
  count(*) FILTER (regexp_matches(text, '\d{10,}')) AS violations,
  count(*) FILTER (regexp_matches(text, '\d{10,}')) = 0 AS ok FROM documents""")
def _(spark, sf):
    return PV.pii_audit(table(spark, sf, "documents").select("text"), forbidden=[], required=[])


@query("l22_audit_preview", f"""WITH {SAFE_SQL}
SELECT nik_masked, phone_masked, nik_hash, phone_hash, dokter_pseudo, staff_pseudo FROM safe
WHERE nik_masked IS NOT NULL OR phone_masked IS NOT NULL OR dokter_pseudo IS NOT NULL OR staff_pseudo IS NOT NULL
ORDER BY id_kunjungan LIMIT 20""")
def _(spark, sf):
    return PV.audit_preview(PV.anonymize(core(spark, sf), SALTS, keep=["id_kunjungan"]), ["id_kunjungan"])


# --- facilities ------------------------------------------------------------------------------------


@query("l24_facility_core", f"""WITH {CORE_SQL}
SELECT id_kunjungan, "PKM", "PKM_norm", day, {utc_ms_sql('file_ts')} AS file_ms, {utc_ms_sql('tanggal_ts')} AS visit_ms,
       {utc_ms_sql('file_ts_fallback')} AS order_ms FROM core WHERE "PKM_norm" = 'tamanasri'""")
def _(spark, sf):
    df = FC.facility_core(visits(spark, sf), "Taman Asri")
    return df.select("id_kunjungan", "PKM", "PKM_norm", "day", *[
        F.unix_millis(c).alias(n) for c, n in
        (("file_ts", "file_ms"), ("tanggal_ts", "visit_ms"), ("file_ts_fallback", "order_ms"))])


@query("l25_clean", f"""WITH {CLEAN_SQL} SELECT id_kunjungan, """ + ", ".join(
    f"""CASE WHEN "{f}" BETWEEN {RULE_OF[f][0]} AND {RULE_OF[f][1]} THEN "{f}" END AS "{f}",
    coalesce("{f}" < {RULE_OF[f][0]} OR "{f}" > {RULE_OF[f][1]}, false) AS "out_{f}" """ for f in FRIENDLY) + " FROM num")
def _(spark, sf):
    return B.clean(core(spark, sf), default_rules(spark)).select(
        "id_kunjungan", *CLINICAL_VARS, *[f"out_{v}" for v in CLINICAL_VARS])


@query("l26_facility_list", f"""WITH {VISITS_SQL}
SELECT DISTINCT {filled_sql('puskesmas_name')} AS facility FROM visits WHERE {filled_sql('puskesmas_name')} IS NOT NULL""")
def _(spark, sf):
    return FC.facility_list(visits(spark, sf))


# The flagship: one facility group's latest uploads of the month, cleaned, to daily labels.


@query("flagship_month_labels", f"""WITH {CORE_SQL}, {latest_sql('core', '2024-01-01', '2024-01-31')},
chosen AS (SELECT core.* FROM core JOIN latest l ON l.day = core.day AND l.file_name = core.file_name),
long AS (SELECT * FROM ({unpivot_sql('chosen', ['day AS "Tanggal"'], _heap_vars)}) WHERE "Value" IS NOT NULL),
{heaping_sql('long', BY_DAY)}
SELECT {BY_DAY}, printf('%.2f%% (%d/%d)', "Total_Preferred_Prop", "Total_pref_n", "Total_n") AS label,
  "Total_Preferred_Prop" AS pct, "Total_pref_n" AS num, "Total_n" AS den FROM heap""")
def month_labels(spark, sf):
    scope = K.scope_frame(core(spark, sf), K.Scope("month", dt.date(2024, 1, 15)))
    long = H.heaping_long(B.apply_schema(scope), CLINICAL_VARS)
    return H.heaping_labels(H.heaping_daily(long))
