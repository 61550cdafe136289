"""Unions, distinct rows and values, wide-to-long and long-to-wide."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fieldcheck.functions.numbers import number_of, parse_strip
from fieldcheck.operators.schema import Parser, dtypes_of, quoted


def union_frames(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both, columns by name, absent columns NULL."""
    return a.unionByName(b, allowMissingColumns=True)


def distinct_rows(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Without repeated rows; with ``keys`` one row per key (two visits may look alike)."""
    return df.dropDuplicates(list(keys)) if keys else df.dropDuplicates()


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Different filled values of a column, ascending."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def to_long(
    df: DataFrame, ids: Sequence[str], variables: Sequence[str],
    variable: str = "Variabel", value: str = "Value", parser: Parser | None = parse_strip,
) -> DataFrame:
    """One row per record and variable. Values are parsed; as text with ``parser=None``.

    Without variables there are no rows.
    """
    types = dtypes_of(df)
    ids = list(ids)
    if not variables:
        kind = "string" if parser is None else "double"
        return df.select(
            *[quoted(i) for i in ids], F.lit(None).cast("string").alias(variable),
            F.lit(None).cast(kind).alias(value),
        ).filter(F.lit(False))
    if parser is None:
        cells = [quoted(v).cast("string").alias(v) for v in variables]
    else:
        cells = [number_of(quoted(v), types[v], parser).alias(v) for v in variables]
    wide = df.select(*[quoted(i) for i in ids], *cells)
    return wide.unpivot(
        [quoted(i) for i in ids], [quoted(v) for v in variables], variable, value
    )


def to_wide(
    labels: DataFrame, days: Sequence[dt.date] | None = None, fill: str | None = "-",
    row: str = "Variabel", day: str = "Tanggal", label: str = "label",
) -> DataFrame:
    """Rows by variable, one text column per day in date order.

    Days not given are read from ``labels`` (a report table of days by variables); Spark
    refuses more than ``spark.sql.pivotMaxValues`` of them rather than dropping any.
    """
    names = None
    text = labels.withColumn("_day", F.date_format(F.col(day), "yyyy-MM-dd"))
    if days is not None:
        names = [d.isoformat() for d in sorted(set(days))]
    wide = text.groupBy(row).pivot("_day", names).agg(F.first(label))
    if fill is not None:
        wide = wide.fillna(fill, [c for c in wide.columns if c != row])
    return wide
