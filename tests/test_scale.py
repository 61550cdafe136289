"""Uploads are dealt to all cores in a tuned session, and the heaping steps read them once for six tables."""

import datetime as dt

from fieldcheck.constants import CLINICAL_VARS
from fieldcheck.plans.heaping import heaping_steps
from fieldcheck.queries.base import core, visits
from fieldcheck.sources.sinks import kept
from tests.conftest import rows


def event_table(spark, folder):
    data = [(i, dt.datetime(2024, 1, 1 + i % 4, 8, 5), i % 7, "view" if i % 3 else "click", i / 7.0, "{}") for i in range(60)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_events_of_one_row_group_are_cleaned_by_all_cores(spark, tmp_path):
    sf = event_table(spark, tmp_path)
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    dealt = visits(spark, sf, deal=True)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
    assert dealt.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert rows(dealt) == rows(visits(spark, sf))


def test_steps_from_kept_counts_do_not_read_the_uploads(spark, tmp_path):
    df = core(spark, event_table(spark, tmp_path))
    plain = heaping_steps(df, CLINICAL_VARS)
    steps = heaping_steps(df, CLINICAL_VARS, keep=lambda slots: kept(slots, str(tmp_path / "slots")))
    for name, step in steps.items():
        assert rows(step) == rows(plain[name])
        if name not in ("Step1_NA_Summary", "Step1_Audit", "Step2_df_long"):
            assert all("/slots/" in f for f in step.inputFiles())
