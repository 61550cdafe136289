import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldcheck.functions import numbers as N, text as X, times as D
from tests.conftest import rows


def apply(spark, values, fn, schema="x string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(fn("x")).collect()]


def test_number_parsers(spark):
    texts = ["70", "70,5", "70.5 kg", "1,234.5", "120/80", "12-5", "-5", "abc", "-", "", None]
    assert apply(spark, texts, N.parse_strip) == [
        70.0, 70.5, 70.5, None, 12080.0, None, -5.0, None, None, None, None]
    assert apply(spark, texts, N.parse_first_number) == [
        70.0, 70.5, 70.5, 1234.5, 120.0, 12.0, -5.0, None, None, None, None]


def test_first_number_without_comma_rule(spark):
    plain = lambda x: N.parse_first_number(x, comma_decimal=False)
    assert apply(spark, ["36,5", "1,234.5"], plain) == [365.0, 1234.5]


def test_rounding_takes_the_nearer_neighbour(spark):
    values = [0.05, 0.15, 0.25, 0.35, 2.675, -1.25, 12.25, 1e300, None]
    got = apply(spark, values, lambda x: N.r_round(x, 1), "x double")
    assert got == [0.0, 0.1, 0.2, 0.3, 2.7, -1.2, 12.2, 1e300, None]


def test_digits_and_tenths(spark):
    values = [60.0, -75.0, 70.5, 72.96, 73.04, -1.3, 9.999999999, float("nan"), float("inf"), None]
    assert apply(spark, values, N.last_digit, "x double") == [
        0, 5, None, None, None, None, 9, None, None, None]
    assert apply(spark, values, N.last_tenth, "x double") == [
        None, None, 0.5, 1.0, 0.0, 0.7, None, None, None, None]


def test_order_bin_never_decreases(spark):
    values = sorted([-1e300, -5.0, -4.9999, -1e-300, 0.0, 1e-320, 0.1, 0.1000001, 3.0, 3.0001, 1e300])
    bins = apply(spark, values, N.order_bin, "x double")
    assert bins == sorted(bins) and bins[4] == 0


def test_keys_fold_accents_on_both_sides(spark):
    names = ["Táman Asrí", "TAMAN-ASRI", "Straße Œuvre", "Đà Nẵng", None]
    got = apply(spark, names, X.norm_key)
    assert got == ["tamanasri", "tamanasri", "strasseoeuvre", "danang", None]
    assert [X.norm_key_text(n) for n in names[:4]] == got[:4]


def test_persons_have_one_spelling(spark):
    got = apply(spark, [" Dr.  José  A ", "dr. jose a", "dr. josé a"], X.normalize_person)
    assert len(set(got)) == 1 and got[0] == "dr. jose a"


def test_identifiers(spark):
    assert apply(spark, ["5201 0000 0000 1234", "n/a", None], X.digits_only) == [
        "5201000000001234", "", None]
    assert apply(spark, ["+62 812 3456 7890", "(0370) 123-456"], X.normalize_phone) == [
        "081234567890", "0370123456"]
    assert apply(spark, ["5201000000001234", "123", "", None], lambda x: X.mask_tail(x, 4)) == [
        "•" * 12 + "1234", "•••", None, None]
    assert apply(spark, ["a", "", None], lambda x: F.length(X.salted_hash(x, "s"))) == [64, None, None]


def test_presence_ignores_all_blanks(spark):
    assert apply(spark, ["a", " \t\r\n", "", None], X.is_present) == [True, False, False, False]


def test_pretty_names(spark):
    got = apply(spark, ["berat_badan", "Tgl.Lahir", "No Telp", "nik", "a..b"], X.pretty_var)
    assert got == ["Berat Badan", "Tanggal Lahir", "No. Telp", "NIK", "A B"]


def test_days(spark):
    texts = ["2025-09-01 10:20:30", "2025-09-01 10:20", "2025-09-01", "2025-09-01junk", "2025-13-01", "junk", None]
    day = dt.date(2025, 9, 1)
    assert apply(spark, texts, D.parse_day) == [day, day, day, day, None, None, None]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        names = ["report 2025-09-01 10_20_30.123.xlsx", "report.xlsx", None]
        ms = apply(spark, names, lambda x: F.unix_millis(D.parse_file_time(x)))
        assert ms == [1756693230123, None, None]
        texts = ["2025-09-01 10:20:30", "2025/09/01 10:20", "2025-09-01", "2025-09-01T02:20:30Z",
                 "2025-9-1 9:05", "10:20:30", "2025", "junk"]
        ms = apply(spark, texts, lambda x: F.unix_millis(D.parse_visit_time(x)))
        assert ms == [1756693230000, 1756693200000, 1756656000000, 1756693230000, 1756688700000,
                      None, None, None]
        df = spark.sql("SELECT timestamp '2025-09-01 20:00:00 UTC' AS t")
        assert df.select(D.parse_day("t", df.schema["t"].dataType)).first()[0] == dt.date(2025, 9, 2)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_dates_in_several_orders(spark):
    texts = ["2000-01-31", "31/01/2000", "01-31-2000", "20000131", "31-01-68", "31-01-69",
             "2000-01-31 10:00:00", "tidak tahu", "2000", None]
    expected = [dt.date(2000, 1, 31)] * 4 + [dt.date(2068, 1, 31), dt.date(1969, 1, 31),
                                              dt.date(2000, 1, 31), None, None, None]
    assert apply(spark, texts, D.parse_date_multi) == expected


def test_labels(spark):
    df = spark.createDataFrame([(53.33, 8, 15), (None, 0, 0)], "p double, a int, b int")
    assert rows(df.select(N.fmt_share_label("p", "a", "b"))) == [("-",), ("53.33% (8/15)",)]
    assert apply(spark, [0.1225, 0.5], N.fmt_pct, "x double") == ["12.2%", "50.0%"]
