"""Facility list and the visits of one facility with derived times."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldcheck.constants import SOURCE_ZONE
from fieldcheck.functions.text import blank_to_null, norm_key, trimmed
from fieldcheck.functions.times import (
    parse_day, parse_file_time, parse_visit_time, usable_file_time,
)
from fieldcheck.operators.filters import filter_facility
from fieldcheck.operators.schema import dtypes_of, find_facility_col, quoted


def facility_list(df: DataFrame, column: str | None = None) -> DataFrame:
    """Trimmed, non-empty facility names, each once, sorted."""
    column = column or find_facility_col(df.columns)
    if column is None:
        return df.select(F.lit(None).cast("string").alias("facility")).filter(F.lit(False))
    names = df.select(blank_to_null(quoted(column)).alias("facility"))
    return names.filter("facility IS NOT NULL").distinct().orderBy("facility")


def with_times(df: DataFrame, zone: str = SOURCE_ZONE) -> DataFrame:
    """Adds ``PKM``, ``PKM_norm`` and, where absent, ``tanggal_ts``, ``day`` and ``file_ts``."""
    types = dtypes_of(df)
    facility = find_facility_col(df.columns)
    if facility is None:
        raise ValueError("no facility column")
    df = df.withColumn("PKM", trimmed(quoted(facility)))
    new = {"PKM_norm": norm_key("PKM")}
    if "tanggal_ts" not in types:
        new["tanggal_ts"] = parse_visit_time("tanggal", types["tanggal"], zone)
    if "day" in types:
        new["day"] = F.col("day").cast("date")
    else:
        new["day"] = parse_day("tanggal", types["tanggal"], zone)
    if "file_ts" not in types:
        new["file_ts"] = parse_file_time("file_name", zone)
    return df.withColumns(new)


def facility_core(df: DataFrame, facility: str, zone: str = SOURCE_ZONE) -> DataFrame:
    """Visits of one facility with names, times, day and the time its files are ordered by."""
    core = filter_facility(with_times(df, zone), facility)
    return core.withColumn("file_ts_fallback", usable_file_time("file_ts", "tanggal_ts"))
