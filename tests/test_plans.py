"""Shape of the physical plans: what is read, shuffled and broadcast."""

import re

import pytest

from fieldcheck.operators.joins import BROADCAST_ROWS, small_side
from fieldcheck.queries import QUERIES

SF = "/root/testdata/sf0.001"
WRITING = {
    "a1_load_csv", "a3_load_rules", "a4_write_cache", "a5_export_csv", "a6_export_steps", "l23_incremental_refresh",
    "l23_refresh_gap", "m1_refresh_stream", "m2_refresh_reload_days", "m1_refresh_stream_state", "l23_refresh_ledger",
    "l9_heaping_from_counts", "l10_heaping_from_counts", "g1_latest_from_index", "k7_scope_from_index",
    "f6_distinct_from_sketches", "l22_observed_audit",
}


def plan(spark, name, run=True):
    df = QUERIES[name](spark, SF)
    if run:
        df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def scans(node, found=None):
    """Rows read by each file scan of a plan that has run, each scan once however often its shuffle is reused."""
    found = {} if found is None else found
    kind = node.getClass().getSimpleName()
    if kind == "FileSourceScanExec":
        found[node.id()] = node.metrics().apply("numOutputRows").value()
    elif kind == "AdaptiveSparkPlanExec":
        scans(node.executedPlan(), found)
    elif kind.endswith("QueryStageExec"):
        scans(node.plan(), found)
    elif kind == "ReusedExchangeExec":
        scans(node.child(), found)
    children = node.children()
    for i in range(children.size()):
        scans(children.apply(i), found)
    return found


@pytest.mark.parametrize("name", [
    "f7_quantiles", "f8_basic_stats", "l5_profile_clinical", "l5_profile_raw", "l9_heaping_window",
    "l10_heaping_daily", "l14_heaping_trend_all", "l12_heaping_labels_latest", "l18_histogram_compare", "l15_histogram", "l1_guardrail_lineitem", "l16_auto_binwidth"])
def test_source_is_scanned_once(spark, name):
    df = QUERIES[name](spark, SF)
    df.collect()
    found = scans(df._jdf.queryExecution().executedPlan())
    assert [rows for rows in found.values() if rows] and len(found) == 1


@pytest.mark.parametrize("name", ["l2_outlier_log", "l4_strict_drop_log", "l21_anonymize", "c26_clip_to_null"])
def test_row_wise_reports_do_not_shuffle_rows(spark, name):
    text = plan(spark, name)
    exchanges = re.findall(r"(?<!Broadcast)Exchange hashpartitioning\((\w+)", text)
    assert set(exchanges) <= {"Variable"}  # the rules table only


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_workers_and_no_cross_joins(spark, name):
    if name in WRITING:
        pytest.skip("writes tables; its plans are looked at below")
    text = plan(spark, name, run=False)
    for operator in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroups", "CartesianProduct",
                     "BroadcastNestedLoopJoin"):
        assert operator not in text


def test_scan_reads_only_needed_columns(spark):
    text = plan(spark, "l15_histogram")
    assert "ReadSchema: struct<l_extendedprice:double>" in text


def test_day_filter_reaches_the_scan(spark):
    text = plan(spark, "d2_filter_days")
    assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(ts", text)


def test_broadcast_needs_a_proven_bound(spark):
    df = spark.range(1)

    def hinted(bound):
        return "ResolvedHint" in small_side(df, bound)._jdf.queryExecution().analyzed().toString()

    assert hinted(BROADCAST_ROWS) and not hinted(BROADCAST_ROWS + 1) and not hinted(None)


def test_cached_days_are_pruned(spark, tmp_path):
    import datetime as dt

    from fieldcheck.operators.filters import filter_days
    from fieldcheck.plans.refresh import read_cache
    from fieldcheck.sources.sinks import write_cache

    days = spark.sql("SELECT explode(sequence(date'2025-09-01', date'2025-09-09')) AS day, 1 AS x")
    write_cache(days, str(tmp_path / "c"))
    df = filter_days(read_cache(spark, str(tmp_path / "c")), dt.date(2025, 9, 2), dt.date(2025, 9, 3))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*day", text) and df.count() == 2


def test_scopes_look_at_the_selected_day_first(spark, monkeypatch):
    """A week or a month reads no history when the selected day has visits."""
    import datetime as dt

    from fieldcheck.operators import scope as K

    monkeypatch.setattr(K, "resolve_day", lambda *_: pytest.fail("all days were read"))
    df = spark.sql("SELECT explode(sequence(date'2025-09-01', date'2025-09-09')) AS day").selectExpr(
        "day", "'f' AS file_name", "CAST(day AS timestamp) AS file_ts_fallback")
    for kind, n in (("day", 1), ("week", 7), ("month", 9)):
        assert K.scope_frame(df, K.Scope(kind, dt.date(2025, 9, 3))).count() == n
    with pytest.raises(ValueError):
        K.scope_frame(df, K.Scope("year", dt.date(2025, 9, 3)))


def test_nothing_is_written_before_an_action(spark, monkeypatch):
    """The steps of the heaping report are lazy and need no shared folder."""
    from fieldcheck.plans import heaping as H

    monkeypatch.setattr("fieldcheck.sources.sinks.work_folder", lambda *_: pytest.fail("the shared folder was asked for"))
    df = spark.createDataFrame([("2025-09-01", "36,5"), ("2025-09-01", "x")], "tanggal_kunjungan string, suhu string")
    steps = H.heaping_steps(df, ["Suhu"])
    assert [tuple(r)[-1] for r in steps["Step1_Audit"].collect()] == ["x"]


def test_reports_on_absent_columns_are_empty(spark):
    from fieldcheck.plans import heaping as H, histogram as HI

    df = spark.createDataFrame([("2025-09-01", 1.0)], "tgl string, a double")
    assert HI.histogram(df, ["zz"]).count() == 0 and HI.histogram_compare(df, df, "zz").count() == 0
    assert H.na_scan(df, ["zz"]).count() == 0 and H.parse_audit(df, ["zz"]).count() == 0
    assert H.heaping_daily(H.heaping_long(df, ["zz"])).count() == 0
    assert H.choose_variables(df, ["zz"]) == ["a"]
    assert H.heaping_daily(H.heaping_long(df, ["a"])).first()["Total_n"] == 1


def test_histogram_beyond_the_array_limit(spark):
    from fieldcheck.plans import histogram as HI

    df = spark.createDataFrame([(60.0,), (70.0,), (81234567890.0,)], "a double")
    hist = HI.histogram(df, ["a"], 1.0)
    assert hist.limit(5).count() == 5
    runs = sorted(tuple(r) for r in HI.histogram_runs(df, ["a"], 1.0).select("bin", "last_bin", "count").collect())
    assert len(runs) == 7 and runs[0][0] == 0 and all(x[1] + 1 == y[0] for x, y in zip(runs, runs[1:])) and sum(r[2] for r in runs) == 3
    assert HI.histogram_runs(df, ["zz"]).columns == HI.histogram_runs(df, ["a"]).columns
    wide = HI.histogram(df, ["a"], 40000.0).agg({"count": "sum", "bin": "count"}).first()
    assert set(wide) == {3, 2152718}


def test_no_identifier_is_kept(spark):
    from fieldcheck.constants import WANTED_COLUMNS
    from fieldcheck.plans.privacy import Salts, anonymize

    df = spark.createDataFrame([tuple("1" for _ in WANTED_COLUMNS)], ", ".join(f"{c} string" for c in WANTED_COLUMNS))
    for bad in (["NIK"], ["_phone"], ["nama_PASIEN"], ["No Telp"], ["suhu"], ["x", "X"]):
        with pytest.raises(ValueError):
            anonymize(df.selectExpr("*", "1 AS x", "current_date() AS day", "'p' AS PKM", "'p' AS PKM_norm",
                                    "current_timestamp() AS file_ts", "current_timestamp() AS tanggal_ts"), Salts("a", "b", "c", "d"), keep=bad)
