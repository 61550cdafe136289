"""Available days, day and window choice, and the visit frames of a scope."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from fieldcheck.operators.filters import filter_day_file, filter_days
from fieldcheck.operators.joins import semi_latest_files
from fieldcheck.operators.ranking import latest_file_for_day, latest_file_per_day
from fieldcheck.operators.reshape import distinct_values

Window = tuple[dt.date, dt.date]
ONE_DAY = dt.timedelta(days=1)


def available_days(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Days with visits, ascending; from the ``known`` days (``day``) of ``df`` no row is read."""
    return distinct_values(df if known is None else known, "day")


def resolve_day(df: DataFrame, selected: dt.date, known: DataFrame | None = None) -> DataFrame:
    """One row: the selected day if present, else the nearest one, the earlier at a tie.

    Two extremes in one aggregate; days are neither listed nor sorted. From the ``known`` days (``day``)
    of ``df`` no row is read.
    """
    df = df if known is None else known
    day, sel = F.col("day"), F.lit(selected)
    ends = df.agg(
        F.max(F.when(day <= sel, day)).alias("before"),
        F.min(F.when(day >= sel, day)).alias("after"),
    )
    earlier = F.datediff(sel, F.col("before")) <= F.datediff(F.col("after"), sel)
    resolved = (
        F.when(F.col("after").isNull() | earlier, F.col("before")).otherwise(F.col("after"))
    )
    return ends.select(resolved.alias("resolved_day"))


def resolved_date(df: DataFrame, selected: dt.date, known: DataFrame | None = None) -> dt.date | None:
    """``resolve_day`` as a value, so that later scans can prune partitions by it.

    Of ``known`` days the nearest is looked up at once. Otherwise the selected day is looked at first, then a month to both sides, and all days only when
    those hold nothing: the nearest day of a window that reaches as far on both sides is the
    nearest of all.
    """
    if known is not None:
        return resolve_day(df, selected, known).first()["resolved_day"]
    if not filter_days(df, selected, selected).isEmpty():
        return selected
    near = filter_days(df, selected - 31 * ONE_DAY, selected + 31 * ONE_DAY)
    found = resolve_day(near, selected).first()["resolved_day"]
    return found or resolve_day(df, selected).first()["resolved_day"]


def range_window(a: dt.date, b: dt.date) -> Window:
    return min(a, b), max(a, b)


def previous_window(start: dt.date, end: dt.date) -> Window:
    """Window of the same length that ends the day before ``start``."""
    return start - (end - start) - ONE_DAY, start - ONE_DAY


def week_window(day: dt.date) -> Window:
    """Monday to Sunday around a day."""
    monday = day - dt.timedelta(days=day.weekday())
    return monday, monday + 6 * ONE_DAY


def month_window(day: dt.date) -> Window:
    first = day.replace(day=1)
    return first, (first + dt.timedelta(days=31)).replace(day=1) - ONE_DAY


def range_of(a, b):
    """Column forms of ``range_window``: the ends in order."""
    return F.least(a, b), F.greatest(a, b)


def previous_of(start, end):
    """Column forms of ``previous_window``."""
    days = F.datediff(end, start)
    return F.date_sub(start, days + 1), F.date_sub(start, 1)


def week_of(day):
    """Column forms of ``week_window``: Monday and Sunday."""
    monday = F.trunc(day, "week")
    return monday, F.date_add(monday, 6)


def month_of(day):
    """Column forms of ``month_window``: first and last day."""
    return F.trunc(day, "month"), F.last_day(day)


def window_frame(df: DataFrame, window: Window, index: DataFrame | None = None) -> DataFrame:
    """Visits of the latest file of every day in the window.

    At most one file per day: the chosen files are as many as the window has days.
    """
    start, end = window
    latest = latest_file_per_day(df if index is None else index, start, end)
    days = (end - start).days + 1
    return semi_latest_files(filter_days(df, start, end), latest, max_rows=days)


def day_frame(df: DataFrame, day: dt.date | None, index: DataFrame | None = None) -> DataFrame:
    """Visits of the latest file of one day; none when the day or its file is missing."""
    if day is None:
        return df.filter(F.lit(False))
    file = latest_file_for_day(df if index is None else index, day).first()
    return filter_day_file(df, day, file["file_name"] if file else None)


@dataclass(frozen=True)
class Scope:
    """A chosen part of the visits: ``kind`` is day, week, month, range or range_pair."""

    kind: str
    selected: dt.date
    start: dt.date | None = None
    end: dt.date | None = None

    def range(self) -> Window:
        return range_window(self.start or self.selected, self.end or self.selected)


def scope_frame(df: DataFrame, scope: Scope, index: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """The visits of a scope; only this scope is built, the others are never computed.

    ``index`` is a kept table of the same visits' files (``day, file_name, file_ts_fallback``). Days and
    files are then chosen from it, and visits are read once, for the chosen files. ``known`` are the days
    (``day``) of the visits, as the manifest of a cache has them; the nearest day is then found without a scan.
    """
    if scope.kind not in ("day", "week", "month", "range", "range_pair"):
        raise ValueError(f"unknown scope {scope.kind}")
    if scope.kind == "range":
        return window_frame(df, scope.range(), index)
    if scope.kind == "range_pair":
        # The windows adjoin and every day has its own latest file, so both are one window.
        start, end = scope.range()
        both = window_frame(df, (previous_window(start, end)[0], end), index)
        period = F.when(F.col("day") >= F.lit(start), "Current").otherwise("Previous")
        return both.withColumn("period", period)
    day = resolved_date(df if index is None else index, scope.selected, known)
    if day is None or scope.kind == "day":
        return day_frame(df, day, index)
    if scope.kind == "week":
        return window_frame(df, week_window(day), index)
    return window_frame(df, month_window(day), index)


def scope_label(scope: Scope, resolved: dt.date | None = None) -> str:
    """Text that names the scope and its dates."""
    day = resolved or scope.selected
    if scope.kind == "range":
        return f"Current window: {_span(scope.range())}"
    if scope.kind == "range_pair":
        current = scope.range()
        return f"Current: {_span(current)} | Previous: {_span(previous_window(*current))}"
    if scope.kind == "week":
        return f"Week: {_span(week_window(day))}"
    if scope.kind == "month":
        return f"Month: {_span(month_window(day))}"
    return f"Selected day: {day.isoformat()}"


def _span(window: Window) -> str:
    return f"{window[0].isoformat()} → {window[1].isoformat()}"
