import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldcheck.constants import SAFE_REQUIRED
from fieldcheck.plans import heaping as H, histogram as HI, outliers as O, privacy as PV, profile as PR
from fieldcheck.sources.readers import default_rules
from tests.conftest import rows

DAY = dt.date(2025, 9, 1)
RULES = "Variable string, min_ok double, max_ok double"
VALUES = {
    "A": [60, 60, 60, 70, 75, 65, 61, 62, 70.5, 70.5, 70.5, 71.5, 72.2, 72.96, 73.04],
    "B": [11, 22, 33, 44, 56],
    "C": list(range(10)),
}


@pytest.fixture(scope="module")
def long(spark):
    data = [(DAY, v, float(x)) for v, xs in VALUES.items() for x in xs]
    return spark.createDataFrame(data, "Tanggal date, Variabel string, Value double")


@pytest.fixture(scope="module")
def daily(long):
    return H.heaping_daily(long)


def test_heaping_buckets(long):
    ints, decs = H.heaping_counts(long)
    assert rows(ints.filter("Variabel = 'A'").select("int_last_digit", "n", "Total_n")) == [
        (0, 4, 15), (1, 1, 15), (2, 1, 15), (5, 2, 15)]
    assert rows(decs.select("frac_last_tenth", "n")) == [(0.2, 1), (0.5, 4), (1.0, 1)]


def test_heaping_table(daily):
    got = {r["Variabel"]: r for r in daily.collect()}
    a = got["A"]
    assert (a["Total_n"], a["Total_pref_n"], a["Total_Preferred_Prop"]) == (15, 8, 53.33)
    assert (a["Int_Preferred_Digits"], a["Int_Preferred_Digits_Prop"]) == ("0", "26.7%")
    assert (a["Dec_Preferred_Tenths"], a["Dec_Preferred_Tenths_Prop"]) == ("0.5", "26.7%")
    assert a["Int_Max_Last_Digit_Prop"] == a["Dec_Max_Tenth_Prop"] == 4 / 15 * 100
    b = got["B"]
    assert (b["Int_Preferred_Digits"], b["Dec_Preferred_Tenths"], b["Dec_Max_Tenth_Prop"]) == ("1, 2, 3, 4, 6", None, None)
    assert (got["C"]["Int_Preferred_Digits"], got["C"]["Total_pref_n"]) == ("-", 0)


def test_heaping_labels_and_averages(daily):
    labels = H.heaping_labels(daily)
    assert [r["label"] for r in labels.orderBy("Variabel").collect()] == [
        "53.33% (8/15)", "100.00% (5/5)", "0.00% (0/10)"]

    def average(kind, of=labels):
        return H.average_labels(of, kind).first()["label"]

    two = labels.filter("Variabel <> 'C'")
    assert average("ratio", two) == "65.00% (13/20)"
    assert average("mean", two) in ("76.66%", "76.67%")
    assert average("ratio") == "43.33% (13/30)"
    assert average("ratio_nonzero") == "65.00% (13/20)"


def test_heaping_pivot_ends_with_the_average(daily):
    labels = H.heaping_labels(daily)
    for days in (None, [DAY]):
        pivot = H.heaping_pivot(labels, days=days)
        assert pivot.columns == ["Variabel", "2025-09-01"]
        assert [r[0] for r in pivot.collect()] == ["A", "B", "C", "Average"]


def test_heaping_trend(daily):
    trend = H.heaping_trend(daily, average="ratio")
    assert {round(r["Average_Prop"], 2) for r in trend.collect()} == {43.33}
    assert H.heaping_trend(daily, "A", [DAY]).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_heaping_does_not_depend_on_partitions(long, parts):
    assert rows(H.heaping_daily(long.repartition(parts))) == rows(H.heaping_daily(long))


def test_infinite_values_count_without_a_bucket(spark):
    df = spark.createDataFrame([(DAY, "A", float("inf")), (DAY, "A", 10.0), (DAY, "A", float("nan"))],
                               "Tanggal date, Variabel string, Value double")
    r = H.heaping_daily(df).first()
    assert (r["Total_n"], r["Total_pref_n"], r["Dec_Preferred_Tenths"]) == (2, 1, None)


def test_heaping_from_dirty_records(spark):
    df = spark.createDataFrame(
        [("2025-09-01", "60 kg", "20"), ("2025-09-01", "abc", "20"), (None, "70", "20")],
        "Tanggal string, `Berat Badan` string, Nafas string")
    long = H.heaping_long(df, ["Berat Badan", "Nafas", "Suhu"])
    assert rows(long) == [(DAY, "Berat Badan", 60.0)]
    assert rows(H.parse_audit(df, ["Berat Badan"])) == [("2025-09-01", "Berat Badan", "abc")]


@pytest.fixture(scope="module")
def temperatures(spark):
    data = [(i, x) for i, x in enumerate([29.9, 30.0, 43.0, 43.1, 36.5, None])]
    return spark.createDataFrame(data, "id int, Suhu double")


def test_guardrail_and_logs(spark, temperatures):
    rules = default_rules(spark)
    assert rows(O.guardrail_summary(temperatures, rules, ["Suhu"])) == [
        ("Suhu", 30.0, 43.0, 6, 5, 2, "40.0%")]
    log = O.outlier_log(temperatures, rules, ["Suhu"], "id", [])
    assert rows(log) == [(0, "Suhu", "29.9"), (3, "Suhu", "43.1")]
    assert rows(O.strict_drop_log(temperatures, rules, ["Suhu"], "id", [])) == rows(log)
    assert rows(O.outlier_counts(log)) == [("Suhu", 2)]


def test_tables_without_known_variables_give_empty_reports(spark, temperatures):
    rules, df = default_rules(spark), temperatures
    full = PR.profile(df, ["Suhu"], rules, DAY)
    none = PR.profile(df, ["Tinggi"], rules, DAY)
    assert none.count() == 0 and none.dtypes == full.dtypes
    none = O.guardrail_summary(df, rules, ["Tinggi"])
    assert none.count() == 0 and none.dtypes == O.guardrail_summary(df, rules, ["Suhu"]).dtypes
    for log in (O.outlier_log, O.strict_drop_log):
        assert log(df, rules, ["Tinggi"], "id", []).count() == 0
        assert log(df, rules, ["Tinggi"], "id", []).dtypes == log(df, rules, ["Suhu"], "id", []).dtypes


@pytest.mark.parametrize("stage,expected", [
    ("raw", (1, 2, 29.9, 30.0, 36.5, 43.0, 43.1)), ("clipped", (3, 0, 30.0, 33.25, 36.5, 39.75, 43.0))])
def test_profile_of_numbers(spark, temperatures, stage, expected):
    r = PR.profile(temperatures, ["Suhu"], default_rules(spark), DAY, stage).first()
    assert (r["Missing"], r["Invalid (non-missing)"], *[r[n] for n in PR.NUMBERS]) == expected
    assert r["Missing"] + r["Non_missing"] == r["Rows"] == 6


def test_profile_of_identifiers_uses_flags(spark):
    df = spark.createDataFrame(
        [(16, True, "h1", "•1"), (16, True, "h2", "•1"), (3, False, "h3", "•2"), (0, False, None, ""), (None, None, None, None)],
        "nik_len int, nik_len_ok boolean, nik_hash string, NIK string")
    r = PR.profile(df, ["NIK"], default_rules(spark), DAY).first()
    assert (r["Missing"], r["Distinct (non-missing)"], r["Invalid (non-missing)"]) == (2, 3, 1)
    assert r["Rule"] == "Invalid length (≠16)" and r["Median"] is None


def test_false_presence_is_missing(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "name_present boolean")
    r = PR.profile(PR.admin_aliases(df), ["Nama Pasien"], default_rules(spark), DAY).first()
    assert (r["Missing"], r["Distinct (non-missing)"]) == (2, 1)


def test_status_shares_add_up(spark, temperatures):
    table = PR.profile(temperatures, ["Suhu"], default_rules(spark), DAY)
    shares = PR.status_composition(table).collect()
    assert [r["Status"] for r in sorted(shares, key=lambda r: r["Status_order"])] == ["Valid", "Invalid", "Missing"]
    assert abs(sum(r["Rate"] for r in shares) - 1) < 1e-12
    card = PR.numeric_card(table, default_rules(spark), "Suhu").first()
    assert (card["N"], card["missing_pct"], card["invalid_pct"], card["max_ok"]) == (5, "16.7%", "40.0%", 43.0)


def test_histogram(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 1.0, 2.0, 2.0, 2.0, 5.0)], "v double")
    hist = HI.histogram(df, ["v"], 1.0)
    assert [(r["left"], r["count"]) for r in hist.orderBy("bin").collect()] == [
        (0.0, 0), (1.0, 2), (2.0, 3), (3.0, 0), (4.0, 0), (5.0, 1), (6.0, 0)]
    r = hist.first()
    assert (r["N"], r["median"], r["mean"]) == (6, 2.0, 2.17)
    assert [r["text"] for r in HI.top_bins_report(hist, 2).orderBy("rank").collect()] == ["2: 3 (50.0%)", "1: 2 (33.3%)"]
    assert HI.top_bins_report(hist, 5).count() == 3


def test_value_just_below_a_break_belongs_above_it(spark):
    df = spark.createDataFrame([(0.0,), (9.99999999,), (20.0,)], "v double")
    filled = HI.histogram(df, ["v"], 10.0).filter("count > 0")
    assert [r["left"] for r in filled.orderBy("bin").collect()] == [0.0, 10.0, 20.0]


def test_histogram_of_one_value_and_automatic_width(spark):
    df = spark.createDataFrame([(3.0,)] * 4, "v double")
    assert rows(HI.histogram(df, ["v"]).filter("count > 0").select("left", "count", "binwidth")) == [(3.0, 4, 1.0)]
    spread = spark.range(31).selectExpr("CAST(CASE WHEN id = 0 THEN 30 ELSE 0 END AS double) AS v")
    assert HI.histogram(spread, ["v"]).first()["binwidth"] == 1.0


def test_histograms_share_bins(spark):
    now = spark.createDataFrame([(1.0,), (9.0,)], "v double")
    before = spark.createDataFrame([(3.0,), (3.0,), (3.0,)], "v double")
    both = HI.histogram_compare(now, before, "v", 2.0)
    bins = {p: [r["left"] for r in both.filter(F.col("period") == p).orderBy("bin").collect()]
            for p in ("Current", "Previous")}
    assert bins["Current"] == bins["Previous"]
    assert {r["shared_max"] for r in both.collect()} == {3}


SALTS = PV.Salts("a", "b", "c", "d")


@pytest.fixture(scope="module")
def safe(spark):
    from fieldcheck.constants import WANTED_COLUMNS
    from fieldcheck.plans.facility import with_times

    base = {c: None for c in WANTED_COLUMNS}
    people = [
        dict(nik="5201 0000 0000 1234", no_telp="0812-3456-7890", nama_pasien="A", dokter_tenaga_medis=" Dr.  José  A "),
        dict(nik="123", no_telp="+62 812 3456 7890", nama_pasien=" ", dokter_tenaga_medis="dr. jose a"),
        dict(nik="n/a", no_telp=None, nama_pasien=None, dokter_tenaga_medis=None),
    ]
    data = [tuple({**base, "puskesmas_name": "P", "tanggal": "2025-09-01", "file_name": "f", **p}.values()) for p in people]
    df = spark.createDataFrame(data, ", ".join(f"{c} string" for c in base))
    return PV.anonymize(with_times(df), SALTS)


def test_anonymized_identifiers(safe):
    a, b, c = safe.orderBy(F.desc("phone_masked"), F.desc("nik_len")).collect()
    a, b = sorted((a, b), key=lambda r: -r["nik_len"])
    assert (a["nik_masked"], a["nik_len_ok"], a["phone_masked"], a["phone_len_ok"]) == ("•" * 12 + "1234", True, "•" * 9 + "890", True)
    assert (b["nik_masked"], b["nik_len_ok"], b["phone_masked"], b["phone_len_ok"]) == ("•••", False, "•" * 10 + "890", False)
    assert (c["nik_masked"], c["nik_len"], c["nik_hash"], c["doctor_present"], c["dokter_pseudo"]) == (None, None, None, False, None)
    assert a["dokter_pseudo"] == b["dokter_pseudo"]
    assert [r["name_present"] for r in (a, b, c)] == [True, False, False]


def test_country_code_can_be_mapped(spark):
    df = spark.createDataFrame([("+62 812 3456 7890",)], "no_telp string")
    phone = PV.cleaned_identifiers(map_country_code=True)["_phone"]
    assert df.select(phone).first()[0] == "081234567890"


def test_salts_have_no_default():
    with pytest.raises(ValueError):
        PV.Salts("a", "b", "c", "")


def test_audit_passes_on_anonymized_rows(safe):
    assert PV.pii_audit(safe).filter("NOT ok").count() == 0
    assert len(safe.columns) == 32 and set(SAFE_REQUIRED) <= set(safe.columns)


def test_audit_finds_leaks(safe):
    bad = (safe.withColumn("nik", F.lit("x")).drop("staff_present")
           .withColumn("nik_masked", F.lit("•12")).withColumn("nik_hash", F.lit("a" * 63))
           .withColumn("note", F.lit("id 4785380592391139")))
    found = {(r["check"], r["column"]) for r in PV.pii_audit(bad).filter("NOT ok").collect()}
    assert found == {("forbidden_absent", "nik"), ("required_present", "staff_present"),
                     ("format", "nik_masked"), ("format", "nik_hash"), ("digit_run", "note")}


def test_raw_identifiers_cannot_be_kept(safe, spark):
    with pytest.raises(ValueError):
        PV.anonymize(safe.withColumn("nik", F.lit("1")), SALTS, keep=["nik"])
