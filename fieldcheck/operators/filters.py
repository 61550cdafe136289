"""Row filters of reports and scopes."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from fieldcheck.functions.numbers import is_finite
from fieldcheck.functions.text import norm_key, norm_key_text
from fieldcheck.operators.schema import quoted


def filter_facility(df: DataFrame, facility: str, column: str = "PKM") -> DataFrame:
    """Rows whose facility has the same matching key as ``facility``."""
    return df.filter(norm_key(quoted(column)) == norm_key_text(facility))


def filter_days(
    df: DataFrame, start: dt.date | str, end: dt.date | str, day: str = "day"
) -> DataFrame:
    """Days from start to end, both included; prunes the partitions of a day-wise cache."""
    return df.filter(F.col(day).between(_date(start), _date(end)))


def filter_day_file(
    df: DataFrame, day: dt.date | str, file_name: str | None, day_col: str = "day",
    file_col: str = "file_name",
) -> DataFrame:
    """Rows of one file on one day; no rows when there is no file."""
    if file_name is None:
        return df.filter(F.lit(False))
    return df.filter((F.col(day_col) == _date(day)) & (F.col(file_col) == file_name))


def drop_sundays(df: DataFrame, day: str = "Tanggal") -> DataFrame:
    return df.filter(F.weekday(F.col(day)) != 6)


def parse_date_list(text: str | None) -> list[dt.date]:
    """Dates in a text, separated by commas, semicolons or blanks; others are skipped."""
    dates = []
    for part in re.split(r"[,;\s]+", text or ""):
        try:
            dates.append(dt.date.fromisoformat(part))
        except ValueError:
            continue
    return dates


def exclude_dates(
    df: DataFrame, dates: str | Iterable[dt.date], day: str = "Tanggal"
) -> DataFrame:
    """Rows of all days but the listed ones; rows without a day stay."""
    listed = parse_date_list(dates) if isinstance(dates, str) else list(dates)
    return df.filter(F.col(day).isNull() | ~F.col(day).isin(listed)) if listed else df


def focus_variable(
    df: DataFrame, variable: str | None = None, column: str = "Variabel"
) -> DataFrame:
    """One variable, or all of them without a choice."""
    return df.filter(F.col(column) == variable) if variable else df


def focus_date(df: DataFrame, day: dt.date | str | None, column: str = "Tanggal") -> DataFrame:
    """Rows of one day when the data has that day, else all rows.

    One look at that day alone decides, so that the day stays a plain filter which prunes.
    """
    if day is None:
        return df
    one = df.filter(F.col(column) == _date(day))
    return df if one.isEmpty() else one


def latest_date_only(df: DataFrame, day: str = "Tanggal", known: DataFrame | None = None) -> DataFrame:
    """Rows of the last day, found by a scalar subquery.

    With the ``known`` days (``day``) of ``df`` the last one is looked up while the plan is built, so a
    table that is partitioned by day is read for that day alone.
    """
    if known is None:
        return df.filter(F.col(day) == df.agg(F.max(day)).scalar())
    return df.filter(F.col(day) == F.lit(known.agg(F.max("day")).first()[0]).cast("date"))


def drop_null_or_nonfinite(df: DataFrame, *columns: str, finite: str | None = None) -> DataFrame:
    """Rows with all ``columns`` filled and, if named, a finite number in ``finite``."""
    tests = [quoted(c).isNotNull() for c in columns]
    if finite:
        tests.append(is_finite(quoted(finite)))
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def clamp_window(df: DataFrame, column: str, low, high) -> DataFrame:
    """Values inside the window, ends included; ends are numbers or columns of ``df``."""
    return df.filter(quoted(column).between(low, high))


def outside_rule(
    df: DataFrame, value: str = "value", low: str = "min_ok", high: str = "max_ok"
) -> DataFrame:
    v = F.col(value)
    return df.filter((v < F.col(low)) | (v > F.col(high)))


def any_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with at least one of the columns filled."""
    return df.filter(reduce(lambda a, b: a | b, [quoted(c).isNotNull() for c in columns]))


def nonzero_tenth(df: DataFrame, tenth: str = "tenth") -> DataFrame:
    return df.filter(F.col(tenth) != 0)


def parse_failures(
    df: DataFrame, original: str = "Original", parsed: str = "Parsed"
) -> DataFrame:
    """Texts that are not empty and yet gave no number."""
    text = F.col(original)
    return df.filter(F.col(parsed).isNull() & text.isNotNull() & (text != ""))


def _date(x: dt.date | str) -> dt.date:
    return dt.date.fromisoformat(x) if isinstance(x, str) else x
