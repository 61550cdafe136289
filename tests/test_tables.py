import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldcheck.constants import ADMIN_MAP, CLINICAL_MAP
from fieldcheck.operators import filters as D, joins as E, ranking as G, reshape as J, schema as B, scope as K
from fieldcheck.plans.facility import facility_core, facility_list
from fieldcheck.plans.profile import infer_type
from fieldcheck.sources import readers as R, sinks as S
from tests.conftest import rows

DAY = dt.date


def test_names_resolve_exactly_then_by_look(spark):
    assert B.resolve_columns(["Berat.Badan", "tinggi"], CLINICAL_MAP) == {
        "Berat Badan": "Berat.Badan", "Tinggi": "tinggi"}
    assert B.resolve_columns(["nik_hash", "nik_masked"], ADMIN_MAP)["NIK"] == "nik_masked"
    assert "Alamat" not in B.resolve_columns(["alamat"], ADMIN_MAP)


def test_candidate_columns():
    assert B.find_facility_col(["x", "Faskes", "PKM"]) == "Faskes"
    assert B.guess_date_col(["Day", "TANGGAL"]) == "TANGGAL"
    assert B.guess_date_col(["x"]) is None


def test_types_by_name():
    assert [infer_type(v) for v in ("NIK", "No Telp", "Tgl.Lahir", "Suhu", "Diagnosa 1")] == [
        "nik", "phone", "date", "numeric", "text"]


def test_schema_and_clipping(spark):
    df = spark.createDataFrame(
        [("29,9", "70 kg", DAY(2025, 9, 1)), ("36.5", "abc", None)], "suhu string, berat_badan string, day date")
    out = B.clean(df, R.default_rules(spark))
    assert rows(out.select("Suhu", "out_Suhu", "Berat Badan", "Tanggal")) == [
        (36.5, False, None, None), (None, True, 70.0, DAY(2025, 9, 1))]


def test_columns_with_dots_are_usable(spark):
    df = spark.createDataFrame([("x1", 2.0)], "`a.b` string, `c.d` double")
    assert rows(B.numeric_like_columns(df)) == [("a.b", 1), ("c.d", 1)]
    assert B.describe_columns(df).count() == 2
    assert rows(J.to_long(df, ["a.b"], ["c.d"])) == [("x1", "c.d", 2.0)]


def test_rules_from_file(spark, tmp_path):
    assert R.load_rules(spark).count() == 8
    assert R.load_rules(spark, str(tmp_path / "none.csv")).count() == 8
    (tmp_path / "r.csv").write_text("Variable,min_ok,max_ok\nSuhu,31,42\nSuhu,1,2\nTinggi,x,250\n")
    assert rows(R.load_rules(spark, str(tmp_path / "r.csv"))) == [
        ("Suhu", 31.0, 42.0), ("Tinggi", None, 250.0)]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    assert R.load_rules(spark, str(tmp_path / "bad.csv")).count() == 8


def test_sources_by_ending(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "a", b')], "k int, t string")
    for ending in ("parquet", "orc"):
        getattr(df.write, ending)(str(tmp_path / f"x.{ending}"))
        assert rows(R.load_dataset(spark, str(tmp_path / f"x.{ending}"))) == [(1, 'say "a", b')]
    path = S.export_csv(df, str(tmp_path / "x.csv"))
    assert R.load_dataset(spark, path).count() == 1
    df.write.option("header", True).option("compression", "gzip").csv(str(tmp_path / "z.csv.gz"))
    assert R.load_dataset(spark, str(tmp_path / "z.csv.gz"), infer=True).dtypes[0] == ("k", "int")
    with pytest.raises(ValueError):
        R.load_dataset(spark, "x.xlsx")
    assert S.export_name("h", "1", True) == "h_1_latest.csv"


def test_cache_replaces_only_its_days(spark, tmp_path):
    from fieldcheck.plans.refresh import read_cache

    path = str(tmp_path / "cache")
    df = spark.createDataFrame([(DAY(2025, 9, 1), 1), (DAY(2025, 9, 2), 2)], "day date, x int")
    S.write_cache(df.union(df), path)
    S.write_cache(df.filter("x = 2").withColumn("x", F.lit(3)), path)
    assert rows(read_cache(spark, path).select("day", "x")) == [(DAY(2025, 9, 1), 1), (DAY(2025, 9, 2), 3)]


def test_work_folder_must_be_shared_on_a_cluster(spark):
    assert S.work_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


FILES = [
    ("2025-09-01", "a.xlsx", "09:00", "08:00"), ("2025-09-01", "b.xlsx", "10:00", "08:00"),
    ("2025-09-02", "c.xlsx", None, "12:00"), ("2025-09-02", "d.xlsx", "11:00", "08:00"),
    ("2025-09-03", "f.xlsx", "07:00", "07:00"), ("2025-09-03", "e.xlsx", "07:00", "07:00"),
    ("2025-09-04", "g.xlsx", None, None),
]


@pytest.fixture()
def files(spark):
    df = spark.createDataFrame(FILES, "day string, file_name string, f string, t string")
    return df.select(
        F.col("day").cast("date").alias("day"), "file_name",
        F.coalesce("f", "t").alias("file_ts_fallback"))


def test_latest_file_per_day(files):
    latest = G.latest_file_per_day(files, "2025-09-01", "2025-09-30")
    assert [r[1] for r in rows(latest.select("day", "file_name"), "day")] == ["b.xlsx", "c.xlsx", "e.xlsx", "g.xlsx"]
    assert [G.latest_file_for_day(files, f"2025-09-0{d}").first()["file_name"] for d in (1, 2, 3, 4)] == [
        "b.xlsx", "c.xlsx", "e.xlsx", "g.xlsx"]


@pytest.mark.parametrize("parts", [1, 8])
def test_scopes_do_not_depend_on_partitions(files, parts):
    df = files.repartition(parts)
    frame = K.scope_frame(df, K.Scope("week", DAY(2025, 9, 3)))
    assert [r[0] for r in rows(frame.select("file_name"))] == ["b.xlsx", "c.xlsx", "e.xlsx", "g.xlsx"]
    pair = K.scope_frame(df, K.Scope("range_pair", DAY(2025, 9, 4), DAY(2025, 9, 4), DAY(2025, 9, 3)))
    assert rows(pair.select("file_name", "period")) == [
        ("b.xlsx", "Previous"), ("c.xlsx", "Previous"), ("e.xlsx", "Current"), ("g.xlsx", "Current")]


def test_day_without_file_gives_no_rows(files):
    assert K.day_frame(files, DAY(2030, 1, 1)).count() == 0
    assert K.scope_frame(files.filter("1 = 0"), K.Scope("day", DAY(2025, 9, 1))).count() == 0
    assert K.scope_frame(files.filter("1 = 0"), K.Scope("month", DAY(2025, 9, 1))).count() == 0


def test_null_file_names_match_themselves(spark):
    df = spark.createDataFrame([(DAY(2025, 9, 1), None), (DAY(2025, 9, 1), "a")], "day date, file_name string")
    for bound in (None, 1):
        kept = E.semi_latest_files(df, df.filter("file_name IS NULL"), max_rows=bound)
        assert rows(kept) == [(DAY(2025, 9, 1), None)]


@pytest.mark.parametrize("sel,expected", [
    (DAY(2025, 9, 7), DAY(2025, 9, 5)), (DAY(2025, 9, 8), DAY(2025, 9, 9)), (DAY(2025, 9, 9), DAY(2025, 9, 9)),
    (DAY(2025, 1, 1), DAY(2025, 9, 5)), (DAY(2026, 1, 1), DAY(2025, 9, 9))])
def test_resolved_day(spark, sel, expected):
    df = spark.createDataFrame([(DAY(2025, 9, 5),), (DAY(2025, 9, 9),), (None,)], "day date")
    assert K.resolved_date(df, sel) == expected


def test_windows():
    a, b = K.range_window(DAY(2025, 9, 10), DAY(2025, 9, 4))
    assert (a, b) == (DAY(2025, 9, 4), DAY(2025, 9, 10))
    assert K.previous_window(a, b) == (DAY(2025, 8, 28), DAY(2025, 9, 3))
    assert K.week_window(DAY(2025, 9, 7)) == (DAY(2025, 9, 1), DAY(2025, 9, 7))
    assert K.month_window(DAY(2025, 12, 31)) == (DAY(2025, 12, 1), DAY(2025, 12, 31))
    assert K.scope_label(K.Scope("week", DAY(2025, 9, 7))) == "Week: 2025-09-01 → 2025-09-07"
    pair = K.Scope("range_pair", DAY(2025, 9, 4), DAY(2025, 9, 10), DAY(2025, 9, 4))
    assert K.scope_label(pair) == (
        "Current: 2025-09-04 → 2025-09-10 | Previous: 2025-08-28 → 2025-09-03")


def test_filters(spark):
    df = spark.createDataFrame([(DAY(2025, 9, d),) for d in range(1, 8)], "Tanggal date")
    assert D.drop_sundays(df).count() == 6
    assert D.exclude_dates(df, "2025-09-01;2025-09-02, x 2025-09-03").count() == 4 + df.filter("Tanggal IS NULL").count()
    assert D.latest_date_only(df).first()[0] == DAY(2025, 9, 7)
    assert D.focus_date(df, DAY(2025, 9, 2)).count() == 1
    assert D.focus_date(df, DAY(2030, 9, 2)).count() == 7


def test_facilities(spark):
    df = spark.createDataFrame(
        [(" Taman Asri ", "2025-09-01", "f 2025-09-01 10_00_00.000.xlsx"), ("Táman Asri", "2025-09-02 08:00", "g"),
         ("", "x", "h"), ("Mekar", "2025-09-02", "i")], "puskesmas_name string, tanggal string, file_name string")
    assert [r[0] for r in facility_list(df).collect()] == ["Mekar", "Taman Asri", "Táman Asri"]
    core = facility_core(df, "taman asri").orderBy("day")
    assert [r["day"] for r in core.collect()] == [DAY(2025, 9, 1), DAY(2025, 9, 2)]
    ms = [r[0] for r in core.select(F.unix_millis("file_ts_fallback")).collect()]
    assert ms == [1756692000000, 1756771200000]


def test_row_ids_do_not_depend_on_partitions(spark):
    df = spark.range(100).selectExpr("id % 10 AS a", "id AS b")
    one = {tuple(r) for r in G.with_row_id(df.repartition(1), ["a", "b"]).collect()}
    assert one == {tuple(r) for r in G.with_row_id(df.repartition(7), ["a", "b"]).collect()}
    assert len({r[-1] for r in one}) == 100


def test_wide_days_in_order(spark):
    df = spark.createDataFrame([("v", DAY(2025, 9, 2), "b"), ("v", DAY(2025, 9, 1), "a"), ("w", DAY(2025, 9, 1), "c")],
                               "Variabel string, Tanggal date, label string")
    wide = J.to_wide(df)
    assert wide.columns == ["Variabel", "2025-09-01", "2025-09-02"]
    assert rows(wide) == [("v", "a", "b"), ("w", "c", "-")]
    assert rows(J.to_wide(df, fill=None)) == [("v", "a", "b"), ("w", "c", None)]
