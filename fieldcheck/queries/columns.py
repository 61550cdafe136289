"""Queries of the scalar column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldcheck.functions import numbers as N, text as X, times as D
from fieldcheck.operators.schema import clip_to_null
from fieldcheck.plans.histogram import facility_label, period_label
from fieldcheck.plans.privacy import FORMATS, anonymize, format_ok
from fieldcheck.queries.base import (
    CORE_SQL, SALTS, VISITS_SQL, core, day_sql, digits_sql, file_time_sql, filled_sql,
    first_number_sql, norm_sql, pct_sql, person_sql, phone_sql, pretty_sql, query, rr,
    strip_sql, table, utc_ms_sql, visit_time_sql, visits,
)

CLINICAL = ["berat_badan", "tinggi", "lingkar_perut", "sistole", "diastole", "detak_nadi",
            "nafas", "suhu"]


def _visit_sql(*columns: str) -> str:
    return f"WITH {VISITS_SQL} SELECT id_kunjungan, {', '.join(columns)} FROM visits"


@query("c1_norm_key", f"SELECT doc_id, {norm_sql('text')} AS key FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.norm_key("text").alias("key"))


@query("c2_parse_strip", _visit_sql(*[f"{strip_sql(c)} AS {c}" for c in CLINICAL]))
def _(spark, sf):
    return visits(spark, sf).select(
        "id_kunjungan", *[N.parse_strip(c).alias(c) for c in CLINICAL])


@query("c3_parse_first_number", _visit_sql(
    *[f"{first_number_sql(c)} AS {c}" for c in CLINICAL],
    *[f"{first_number_sql(c, False)} AS {c}_plain" for c in CLINICAL]))
def _(spark, sf):
    return visits(spark, sf).select(
        "id_kunjungan", *[N.parse_first_number(c).alias(c) for c in CLINICAL],
        *[N.parse_first_number(c, comma_decimal=False).alias(f"{c}_plain") for c in CLINICAL])


@query("c4_digits_only", _visit_sql(f"{digits_sql('nik')} AS nik", f"{digits_sql('no_telp')} AS phone"))
def _(spark, sf):
    return visits(spark, sf).select(
        "id_kunjungan", X.digits_only("nik").alias("nik"), X.digits_only("no_telp").alias("phone"))


@query("c5_normalize_phone", _visit_sql(f"{phone_sql('no_telp')} AS phone"))
def _(spark, sf):
    return visits(spark, sf).select("id_kunjungan", X.normalize_phone("no_telp").alias("phone"))


@query("c6_normalize_person", f"SELECT doc_id, {person_sql('text')} AS person FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.normalize_person("text").alias("person"))


@query("c7_salted_hash", "SELECT c_custkey, sha256(concat('pepper', c_name)) AS hash FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", X.salted_hash("c_name", "pepper").alias("hash"))


def _mask_sql(x: str, keep: int) -> str:
    return (f"CASE WHEN {x} = '' THEN NULL WHEN length({x}) > {keep} "
            f"THEN concat(repeat('•', length({x}) - {keep}), right({x}, {keep})) "
            f"WHEN {x} IS NOT NULL THEN repeat('•', length({x})) END")


@query("c8_mask_tail", f"""WITH {VISITS_SQL}, d AS (
  SELECT id_kunjungan, {digits_sql('nik')} AS nik, {digits_sql('no_telp')} AS phone FROM visits)
SELECT id_kunjungan, {_mask_sql('nik', 4)} AS nik, {_mask_sql('phone', 3)} AS phone FROM d""")
def _(spark, sf):
    return visits(spark, sf).select(
        "id_kunjungan", X.mask_tail(X.digits_only("nik"), 4).alias("nik"),
        X.mask_tail(X.digits_only("no_telp"), 3).alias("phone"))


@query("c9_pseudonym", f"""WITH {VISITS_SQL}, d AS (
  SELECT id_kunjungan, nullif({person_sql('dokter_tenaga_medis')}, '') AS doctor FROM visits)
SELECT id_kunjungan, CASE WHEN doctor IS NOT NULL
  THEN 'D-' || substr(sha256(concat('pepper', doctor)), 1, 8) END AS pseudo FROM d""")
def _(spark, sf):
    hashed = X.salted_hash(X.normalize_person("dokter_tenaga_medis"), "pepper")
    return visits(spark, sf).select("id_kunjungan", X.pseudonym(hashed, "D").alias("pseudo"))


@query("c10_parse_file_ts", _visit_sql(f"{utc_ms_sql(file_time_sql('file_name'))} AS file_ms"))
def _(spark, sf):
    return visits(spark, sf).select(
        "id_kunjungan", F.unix_millis(D.parse_file_time("file_name")).alias("file_ms"))


@query("c11_parse_visit_ts", _visit_sql(f"{utc_ms_sql(visit_time_sql('tanggal'))} AS visit_ms"))
def _(spark, sf):
    return visits(spark, sf).select(
        "id_kunjungan", F.unix_millis(D.parse_visit_time("tanggal")).alias("visit_ms"))


@query("c12_day_of", _visit_sql(f"{day_sql('tanggal')} AS day"))
def _(spark, sf):
    return visits(spark, sf).select("id_kunjungan", D.parse_day("tanggal").alias("day"))


@query("c13_file_ts_fallback", f"""WITH {CORE_SQL}
SELECT id_kunjungan, {utc_ms_sql('file_ts_fallback')} AS order_ms FROM core""")
def _(spark, sf):
    return core(spark, sf).select("id_kunjungan", F.unix_millis("file_ts_fallback").alias("order_ms"))


@query("c14_parse_date_multi", _visit_sql(r"""CAST(coalesce(
  CASE WHEN regexp_matches(tgllahir, '^\d{4}-') THEN try_strptime(split_part(tgllahir, ' ', 1), '%Y-%m-%d') END,
  try_strptime(replace(tgllahir, '/', '-'), '%d-%m-%Y'),
  try_strptime(replace(tgllahir, '/', '-'), '%m-%d-%Y')) AS DATE) AS born"""))
def _(spark, sf):
    return visits(spark, sf).select("id_kunjungan", D.parse_date_multi("tgllahir").alias("born"))


@query("c16_length_ok", _visit_sql(
    f"coalesce(length(nullif({digits_sql('nik')}, '')) = 16, false) AS nik_ok",
    f"coalesce(length(nullif({digits_sql('no_telp')}, '')) BETWEEN 10 AND 12, false) AS phone_ok"))
def _(spark, sf):
    return visits(spark, sf).select(
        "id_kunjungan", X.id_length_ok(F.length(X.digits_only("nik"))).alias("nik_ok"),
        X.phone_length_ok(F.length(X.digits_only("no_telp"))).alias("phone_ok"))


@query("c17_is_present", _visit_sql(
    *[f"({filled_sql(c)} IS NOT NULL) AS {c}" for c in
      ("nama_pasien", "nik", "berat_badan", "lingkar_perut", "diagnosa_1")]))
def _(spark, sf):
    return visits(spark, sf).select("id_kunjungan", *[
        X.is_present(c).alias(c)
        for c in ("nama_pasien", "nik", "berat_badan", "lingkar_perut", "diagnosa_1")])


@query("c18_is_integerish", """SELECT event_id,
  abs(value - round(value)) < 1e-8 AS value_int, abs(value * 10 - round(value * 10)) < 1e-8 AS tenth_int
FROM events""")
def _(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", N.is_integerish("value").alias("value_int"),
        N.is_integerish(F.col("value") * 10).alias("tenth_int"))


@query("c19_last_digit", """SELECT event_id,
  CASE WHEN abs(value - round(value)) < 1e-8 THEN CAST(floor(abs(value)) % 10 AS BIGINT) END AS digit,
  CAST(floor(abs(round(-value))) % 10 AS BIGINT) AS rounded_digit
FROM events""")
def _(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", N.last_digit("value").alias("digit"),
        N.last_digit(F.round(-F.col("value"))).alias("rounded_digit"))


_tenth = rr("value - floor(value)", 1)
_neg_tenth = rr("(-value) - floor(-value)", 1)


@query("c20_last_tenth", f"""SELECT event_id,
  CASE WHEN abs(value - round(value)) >= 1e-8 THEN {_tenth} END AS tenth,
  CASE WHEN abs(value - round(value)) >= 1e-8 THEN {_neg_tenth} END AS negative_tenth
FROM events""")
def _(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", N.last_tenth("value").alias("tenth"),
        N.last_tenth(-F.col("value")).alias("negative_tenth"))


@query("c21_formats", f"""SELECT o_orderkey, {pct_sql('o_totalprice / 600000.0')} AS pct,
  printf('%.2f%% (%d/%d)', {rr('100.0 * (o_custkey % 97) / 97', 2)}, o_custkey % 97, 97) AS label,
  strftime(o_orderdate, '%Y-%m-%d') AS date
FROM orders""")
def _(spark, sf):
    part = F.col("o_custkey") % 97
    return table(spark, sf, "orders").select(
        "o_orderkey", N.fmt_pct(F.col("o_totalprice") / 600000.0).alias("pct"),
        N.fmt_share_label(N.r_round(100.0 * part / 97, 2), part, F.lit(97)).alias("label"),
        D.fmt_date("o_orderdate").alias("date"))


_name = "concat(event_type, CASE event_id % 4 WHEN 0 THEN '_tgl.lahir' WHEN 1 THEN '.no telp' " \
        "WHEN 2 THEN '  a.b__c' ELSE '' END)"


@query("c22_pretty_var", f"""SELECT event_id, {pretty_sql('name')} AS pretty, {pretty_sql('code')} AS code
FROM (SELECT event_id, {_name} AS name,
             CASE event_id % 2 WHEN 0 THEN 'nik' ELSE 'bmi' END AS code FROM events)""")
def _(spark, sf):
    names = table(spark, sf, "events").selectExpr(
        "event_id", f"{_name} as name", "case event_id % 2 when 0 then 'nik' else 'bmi' end as code")
    return names.select("event_id", X.pretty_var("name").alias("pretty"), X.pretty_var("code").alias("code"))


@query("c23_labels", f"""WITH {CORE_SQL}
SELECT strftime(min(day), '%Y-%m-%d') || ' – ' || strftime(max(day), '%Y-%m-%d') AS period_label,
       CASE WHEN count(DISTINCT "PKM") > 1 THEN 'Multiple' ELSE min("PKM") END AS facility_label
FROM core""")
def _(spark, sf):
    return core(spark, sf).agg(
        period_label("day").alias("period_label"), facility_label("PKM").alias("facility_label"))


@query("c24_digits_run", r"SELECT doc_id, regexp_matches(text, '\d{10,}') AS digit_run FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.has_digit_run("text").alias("digit_run"))


_shapes = {"nik_masked": "nik", "phone_masked": "no_telp", "nik_hash": "nama_pasien", "phone_hash": "file_name",
           "dokter_pseudo": "dokter_tenaga_medis", "staff_pseudo": "diagnosa_1"}
_shape_sql = {"nik_masked": "^(•+\\d{4}|•+)$", "phone_masked": "^(•+\\d{3}|•+)$", "nik_hash": "^[0-9a-f]{64}$",
              "phone_hash": "^[0-9a-f]{64}$", "dokter_pseudo": "^[DS]-[0-9a-f]{8}$", "staff_pseudo": "^[DS]-[0-9a-f]{8}$"}
_made = {"nik_masked": "CASE WHEN {g} THEN '••••' || right({c}, 4) ELSE {c} END", "phone_masked": "CASE WHEN {g} THEN '•••••' || right({c}, 3) ELSE {c} END",
         "nik_hash": "CASE WHEN {g} THEN sha256({c}) ELSE upper(sha256({c})) END", "phone_hash": "CASE WHEN {g} THEN sha256({c}) ELSE {c} END",
         "dokter_pseudo": "CASE WHEN {g} THEN 'D-' || left(sha256({c}), 8) ELSE {c} END", "staff_pseudo": "CASE WHEN {g} THEN 'S-' || left(sha256({c}), 8) ELSE 'S-' || left(sha256({c}), 9) END"}


@query("c25_format_tests", f"WITH {VISITS_SQL}, d AS (SELECT id_kunjungan, " + ", ".join(
    f"{_made[s].format(c=c, g='id_kunjungan % 3 = 0')} AS {s}" for s, c in _shapes.items())
    + " FROM visits) SELECT id_kunjungan, " + ", ".join(
    f"({s} IS NULL OR regexp_matches({s}, '{_shape_sql[s]}')) AS {s}" for s in _shapes) + " FROM d")
def _(spark, sf):
    """A third of the values is in the stored form, the others are not."""
    spell = lambda s, c: F.expr(_made[s].format(c=c, g="id_kunjungan % 3 = 0").replace("sha256(" + c + ")", f"sha2({c}, 256)"))
    made = visits(spark, sf).select("id_kunjungan", *[spell(s, c).alias(s) for s, c in _shapes.items()])
    return made.select("id_kunjungan", *[format_ok(c).alias(c) for c in FORMATS])


@query("c26_clip_to_null", f"""WITH {VISITS_SQL}, p AS (
  SELECT id_kunjungan, {first_number_sql('suhu')} AS suhu, {first_number_sql('sistole')} AS sistole,
         {first_number_sql('berat_badan')} AS berat_badan FROM visits)
SELECT id_kunjungan,
  CASE WHEN suhu BETWEEN 30 AND 43 THEN suhu END AS suhu,
  coalesce(suhu < 30 OR suhu > 43, false) AS out_suhu,
  CASE WHEN sistole BETWEEN 50 AND 260 THEN sistole END AS sistole,
  coalesce(sistole < 50 OR sistole > 260, false) AS out_sistole,
  CASE WHEN berat_badan BETWEEN 1 AND 95 THEN berat_badan END AS berat_badan,
  coalesce(berat_badan < 1 OR berat_badan > 95, false) AS out_berat_badan
FROM p""")
def _(spark, sf):
    rules = {"suhu": (30.0, 43.0), "sistole": (50.0, 260.0), "berat_badan": (1.0, 95.0)}
    wide = visits(spark, sf).select("id_kunjungan", "suhu", "sistole", "berat_badan")
    return clip_to_null(wide, rules)


@query("c27_hash_preview", """SELECT c_custkey,
  coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, substr(sha256(concat('pepper', c_name)), 1, 8)) AS shown
FROM customer""")
def _(spark, sf):
    masked = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))
    return table(spark, sf, "customer").select(
        "c_custkey", F.coalesce(masked, X.hash_preview(X.salted_hash("c_name", "pepper"))).alias("shown"))
