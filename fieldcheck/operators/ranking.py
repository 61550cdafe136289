"""Latest files, row ids, top bins, previews and sort orders."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from fieldcheck.functions.numbers import order_bin
from fieldcheck.operators.aggregates import bin_ranges, cut_of, join_bins, max_file_time
from fieldcheck.operators.filters import filter_days


def latest_file_per_day(
    df: DataFrame, start: dt.date | str, end: dt.date | str,
    group: Sequence[str] = (), time: str = "file_ts_fallback",
) -> DataFrame:
    """The file with the last time for each day (and ``group``) of the window.

    Files without a time come last, equal times go to the lowest name. Visits are reduced
    to one row per day and file before anything is ranked.
    """
    keys = [*group, "day"]
    files = max_file_time(filter_days(df, start, end), [*keys, "file_name"], time)
    order = Window.partitionBy(*keys).orderBy(
        F.col(time).desc_nulls_last(), F.col("file_name").asc_nulls_last()
    )
    first = files.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1")
    return first.drop("_rank")


def latest_file_for_day(
    df: DataFrame, day: dt.date | str, time: str = "file_ts_fallback"
) -> DataFrame:
    """The last file of one day: a single row, or none."""
    files = max_file_time(filter_days(df, day, day), ["file_name"], time)
    return files.orderBy(F.col(time).desc_nulls_last(), F.col("file_name")).limit(1)


def with_row_id(df: DataFrame, keys: Sequence[str], name: str = "row_id") -> DataFrame:
    """A row id that does not depend on partitioning.

    A single unique key is the id itself; several keys are hashed to one text. Neither
    needs the whole table in one place, as a running number would.
    """
    if len(keys) == 1:
        return df.withColumn(name, F.col(keys[0]))
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("\\N")) for k in keys]
    return df.withColumn(name, F.sha2(F.concat_ws("\u001f", *parts), 256))


def with_row_number(
    df: DataFrame, group: Sequence[str], order: str, name: str = "row_id"
) -> DataFrame:
    """Running number inside each ``group`` in the order of a unique numeric column.

    Rows are numbered within parts of order bins and moved up by the rows before, so a group that
    holds a third of the table is numbered by many tasks, also where its values are close to
    each other: every bin is cut evenly between its own extremes.
    """
    group = list(group)
    value = F.col(order).cast("double")
    binned = df.withColumn("_bin", F.coalesce(order_bin(value), F.lit(0)))
    spans = binned.groupBy(*group, "_bin").agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    binned = join_bins(binned, spans, group, take=("_low", "_high"))
    binned = binned.withColumn("_cut", cut_of(value, F.col("_low"), F.col("_high")))
    sizes = binned.groupBy(*group, "_bin", "_cut").agg(F.count(F.lit(1)).alias("_bin_n"))
    placed = join_bins(binned, bin_ranges(sizes, group, ("_bin", "_cut")), group, by=("_bin", "_cut"))
    inside = F.row_number().over(Window.partitionBy(*group, "_bin", "_cut").orderBy(order))
    return placed.select(*df.columns, (F.col("_from") + inside).alias(name))


def top_bins(hist: DataFrame, n: int, keys: Sequence[str] = ("Variable",)) -> DataFrame:
    """The ``n`` fullest bins of each histogram, equal counts by the lower bin, none empty."""
    order = Window.partitionBy(*keys).orderBy(F.desc("count"), "left")
    filled = hist.filter(F.col("count") > 0)
    return (
        filled.withColumn("rank", F.row_number().over(order).cast("bigint"))
        .filter(F.col("rank") <= n)
    )


def preview(df: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """First ``n`` rows in the order of ``keys``."""
    return df.orderBy(*keys).limit(n)


def shared_max(
    hist: DataFrame, keys: Sequence[str] = ("Variable",), count: str = "count"
) -> DataFrame:
    """The fullest bin over all periods next to every bin. ``hist`` holds bins, not rows."""
    return hist.withColumn("shared_max", F.max(count).over(Window.partitionBy(*keys)))


def order_desc(df: DataFrame, column: str, *keys: str) -> DataFrame:
    return df.orderBy(F.desc(column), *keys)


def order_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys)


def order_by_rate(df: DataFrame, rate: str, *keys: str) -> DataFrame:
    return df.orderBy(F.asc(rate), *keys)
