"""Upload times, visit times and days.

Zones are written into the parsed text, so results do not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from fieldcheck.constants import FILE_TIME_PATTERN, SOURCE_ZONE
from fieldcheck.functions.numbers import as_col

_ISO_DAY = r"^\s*\d{4}-\d{1,2}-\d{1,2}"

# Accepted orders of day, month and year, tried from first to last, and the
# ISO date each one stands for. Two-digit years up to 68 belong to this century.
_SEP, _REST = r"[-/.]", r"(?:[ T].*)?$"
_D, _Y20, _Y19 = r"(\d{1,2})", r"([0-5]\d|6[0-8])", r"(69|[7-9]\d)"
DATE_ORDERS = [
    (rf"^(\d{{4}}){_SEP}{_D}{_SEP}{_D}{_REST}", "$1-$2-$3"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}}){_REST}", "$1-$2-$3"),
    (rf"^{_D}{_SEP}{_D}{_SEP}(\d{{4}}){_REST}", "$3-$2-$1"),
    (rf"^{_D}{_SEP}{_D}{_SEP}(\d{{4}}){_REST}", "$3-$1-$2"),
    (rf"^{_Y20}{_SEP}{_D}{_SEP}{_D}{_REST}", "20$1-$2-$3"),
    (rf"^{_Y19}{_SEP}{_D}{_SEP}{_D}{_REST}", "19$1-$2-$3"),
    (rf"^{_D}{_SEP}{_D}{_SEP}{_Y20}{_REST}", "20$3-$2-$1"),
    (rf"^{_D}{_SEP}{_D}{_SEP}{_Y19}{_REST}", "19$3-$2-$1"),
    (rf"^{_D}{_SEP}{_D}{_SEP}{_Y20}{_REST}", "20$3-$1-$2"),
    (rf"^{_D}{_SEP}{_D}{_SEP}{_Y19}{_REST}", "19$3-$1-$2"),
]


def parse_file_time(file_name: Column | str, zone: str = SOURCE_ZONE) -> Column:
    """Time stamped into an upload's name (``YYYY-MM-DD HH_MM_SS.mmm``), NULL without one."""
    stamp = F.regexp_substr(as_col(file_name), F.lit(FILE_TIME_PATTERN))
    return F.try_to_timestamp(
        F.concat(stamp, F.lit(f" {zone}")), F.lit("yyyy-MM-dd HH_mm_ss.SSS VV")
    )


def parse_visit_time(
    x: Column | str, dtype: T.DataType | None = None, zone: str = SOURCE_ZONE
) -> Column:
    """Visit time as an instant. Text is read as local time of ``zone`` unless it names its own.

    Text is completed to one full form and cast once: ``YYYY-MM-DD`` gets midnight and
    ``YYYY-MM-DD HH:MM`` gets seconds; dates may be written with slashes or dots.
    """
    x = as_col(x)
    if isinstance(dtype, T.TimestampType):
        return x
    if isinstance(dtype, (T.DateType, T.TimestampNTZType)):
        x = F.date_format(x, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    text = F.btrim(x)
    day, clock = F.translate(F.substring(text, 1, 10), "/.", "--"), F.substring(text, 11, 99)
    own_zone = F.length(F.translate(clock, "Z+-", "")) < F.length(clock)
    colons = F.length(clock) - F.length(F.translate(clock, ":", ""))
    rest = F.when(own_zone, F.lit("")).when(colons >= 2, F.lit(f" {zone}")).when(
        colons == 1, F.lit(f":00 {zone}")).otherwise(F.lit(f" 00:00:00 {zone}"))
    # Without this test a bare clock time would be read as a time of today.
    is_day = F.substring(text, 5, 1).isin("-", "/", ".")
    return F.when(is_day, F.concat(day, clock, rest).try_cast("timestamp"))


def parse_day(
    x: Column | str, dtype: T.DataType | None = None, zone: str = SOURCE_ZONE
) -> Column:
    """Calendar day: the leading date of a text, or the local day of a timestamp."""
    x = as_col(x)
    if isinstance(dtype, T.DateType):
        return x
    if isinstance(dtype, T.TimestampNTZType):
        return x.cast("date")
    if isinstance(dtype, T.TimestampType):
        local = F.convert_timezone(F.current_timezone(), F.lit(zone), x.cast("timestamp_ntz"))
        return local.cast("date")
    return F.btrim(F.regexp_substr(x.cast("string"), F.lit(_ISO_DAY))).try_cast("date")


def usable_file_time(file_ts: Column | str, visit_ts: Column | str) -> Column:
    """Upload time, or the visit time where the name holds none."""
    return F.coalesce(as_col(file_ts), as_col(visit_ts))


def parse_date_multi(x: Column | str, dtype: T.DataType | None = None) -> Column:
    """Date from text in one of several orders, with or without a time behind it.

    The first order of ``DATE_ORDERS`` that gives a valid date wins, row by row.
    """
    x = as_col(x)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return x.cast("date")
    text = F.btrim(x.cast("string"))
    return F.coalesce(*[
        F.when(text.rlike(order), F.regexp_replace(text, order, iso)).try_cast("date")
        for order, iso in DATE_ORDERS
    ])


def fmt_date(d: Column | str) -> Column:
    """``YYYY-MM-DD``, or a dash for NULL."""
    return F.coalesce(F.date_format(as_col(d), "yyyy-MM-dd"), F.lit("—"))
