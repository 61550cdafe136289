"""Digit heaping: preferred last digits and tenths per variable, and per day."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldcheck.constants import HEAPING_EXCLUDED, PREFERRED_SHARE
from fieldcheck.functions.numbers import (
    bind, fmt_pct, fmt_share_label, is_integerish, last_digit, last_tenth, number_of, parse_strip,
    r_round,
)
from fieldcheck.operators.aggregates import null_counts, ratio_total
from fieldcheck.operators.filters import (
    drop_sundays, exclude_dates, focus_date, focus_variable, latest_date_only, nonzero_tenth,
    parse_failures,
)
from fieldcheck.operators.joins import with_denominator
from fieldcheck.operators.reshape import distinct_rows, to_long, to_wide, union_frames
from fieldcheck.operators.schema import (
    Parser, Rule, apply_schema, at_stage, dtypes_of, friendly_columns, guess_date_col,
    numeric_like_columns, quoted,
)

BY_DAY = ("Tanggal", "Variabel")
BY_VARIABLE = ("Variabel",)
AVERAGE_ROW = "Average"

# A slot numbers the buckets of a group: 0-9 last digits, 10-20 tenths 0.0 to 1.0.
# Tenth 0.0 (and an infinite value) counts in the total but is no bucket.
_FIRST_TENTH = 10


def choose_variables(
    df: DataFrame, variables: Sequence[str], exclude: Sequence[str] = HEAPING_EXCLUDED,
    parser: Parser = parse_strip,
) -> list[str]:
    """The wanted variables that exist; when there are none, the numeric-like columns.

    Only the fallback looks at the data, in one aggregate over all rows.
    """
    present = [v for v in variables if v in df.columns and v not in exclude]
    if present:
        return present
    found = {r["column"] for r in numeric_like_columns(df, df.columns, parser).collect()}
    return [c for c in df.columns if c in found and c not in exclude]


def dated(df: DataFrame, day: str = "Tanggal") -> DataFrame:
    """The table with its date column as ``day``, guessed from the names where it is absent."""
    if day in df.columns:
        return df.withColumn(day, F.col(day).cast("date"))
    guess = guess_date_col(df.columns)
    return df.withColumn(day, quoted(guess).cast("date") if guess else F.lit(None).cast("date"))


def heaping_long(
    df: DataFrame, variables: Sequence[str], day: str | None = "Tanggal",
    exclude: Sequence[str] = HEAPING_EXCLUDED, parser: Parser = parse_strip,
    ids: Sequence[str] = (), stage: str = "raw",
    rules: DataFrame | Mapping[str, Rule] | None = None,
) -> DataFrame:
    """Parsed values in long form without empty ones and without the excluded variables.

    ``stage="clipped"`` leaves out values outside ``rules``. Absent variables give no rows.
    """
    df = at_stage(df, stage, rules)
    used = [v for v in variables if v in df.columns and v not in exclude]
    keys = [*([day] if day else []), *[i for i in ids if i in df.columns]]
    if day:
        df = dated(df, day).filter(F.col(day).isNotNull())
    long = to_long(df, keys, used, parser=parser)
    return long.filter(F.col("Value").isNotNull() & ~F.isnan("Value"))


def with_digits(long: DataFrame) -> DataFrame:
    """Adds ``is_int``, ``int_last_digit`` and ``frac_last_tenth`` to long values."""
    return long.withColumns({
        "is_int": is_integerish("Value"),
        "int_last_digit": last_digit("Value"),
        "frac_last_tenth": last_tenth("Value"),
    })


def slot_counts(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per group and slot: the only shuffle that sees values, at most 21 rows a group."""
    tenth = F.rint(last_tenth("Value") * 10).cast("int")
    slot = F.coalesce(last_digit("Value").cast("int"), tenth + _FIRST_TENTH, F.lit(_FIRST_TENTH))
    values = long.filter(F.col("Value").isNotNull() & ~F.isnan("Value"))
    return values.groupBy(*keys, slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))


def bucket_counts(long: DataFrame, keys: Sequence[str] = BY_DAY) -> DataFrame:
    """Digit and tenth buckets with count, total of the group, share and percent."""
    return buckets_of(slot_counts(long, keys), keys)


def buckets_of(slots: DataFrame, keys: Sequence[str] = BY_DAY) -> DataFrame:
    """``bucket_counts`` from slot counts."""
    slots = with_denominator(slots, keys)
    is_digit = F.col("slot") < _FIRST_TENTH
    return slots.select(
        *keys, F.when(is_digit, "int").otherwise("dec").alias("kind"),
        F.when(is_digit, F.col("slot").cast("bigint")).alias("digit"),
        F.when(~is_digit, (F.col("slot") - _FIRST_TENTH) / 10.0).alias("tenth"),
        "n", "Total_n", "prop", r_round(F.col("prop") * 100.0, 1).alias("prop_pct"),
    )


def heaping_counts(long: DataFrame, keys: Sequence[str] = BY_DAY) -> tuple[DataFrame, DataFrame]:
    """The integer and the decimal bucket table."""
    return split_buckets(bucket_counts(long, keys), keys)


def split_buckets(
    buckets: DataFrame, keys: Sequence[str] = BY_DAY
) -> tuple[DataFrame, DataFrame]:
    """``heaping_counts`` from the buckets."""
    ints = buckets.filter("kind = 'int'").select(
        *keys, F.col("digit").alias("int_last_digit"), "n", "Total_n", "prop", "prop_pct")
    decs = nonzero_tenth(buckets.filter("kind = 'dec'")).select(
        *keys, F.col("tenth").alias("frac_last_tenth"), "n", "Total_n", "prop", "prop_pct")
    return ints, decs


def _summary(prefix: str, names: tuple[str, str, str]) -> dict[str, Column]:
    """Preferred list, percents, count and largest share over one kind of buckets.

    Reads the arrays ``_<prefix>`` (the buckets) and ``_<prefix>_chosen`` (preferred ones),
    whose elements are ``slot, n, share``.
    """
    slots, chosen = F.col(f"_{prefix}"), F.col(f"_{prefix}_chosen")

    def label(s: Column) -> Column:
        if prefix == "Int":
            return s["slot"].cast("string")
        return F.format_string("%.1f", (s["slot"] - _FIRST_TENTH) / 10.0)

    def listed(text) -> Column:
        joined = F.array_join(F.transform(chosen, text), ", ")
        return F.when(F.size(slots) > 0, F.when(F.size(chosen) > 0, joined).otherwise("-"))

    digits, percents, largest = names
    return {
        digits: listed(label),
        percents: listed(lambda s: fmt_pct(s["share"])),
        f"{prefix}_pref_n": F.aggregate(
            chosen, F.lit(0).cast("bigint"), lambda total, s: total + s["n"]),
        largest: F.array_max(F.transform(slots, lambda s: s["share"] * 100.0)),
    }


def heaping(long: DataFrame, keys: Sequence[str] = BY_DAY) -> DataFrame:
    """Preferred digits and tenths of every group of long values.

    Values are counted per slot, then a group is the list of its (at most 21) slots; totals,
    integer and decimal summaries come from that list without joins.
    """
    return heaping_of(slot_counts(long, keys), keys)


def heaping_of(slots: DataFrame, keys: Sequence[str] = BY_DAY) -> DataFrame:
    """``heaping`` from slot counts."""
    keys = list(keys)
    groups = slots.groupBy(*keys).agg(
        F.sum("n").alias("Total_n"),
        F.array_sort(F.collect_list(F.struct("slot", "n"))).alias("_slots"),
    )
    shared = groups.withColumn("_slots", F.transform("_slots", lambda s: F.struct(
        s["slot"].alias("slot"), s["n"].alias("n"), (s["n"] / F.col("Total_n")).alias("share"))))
    split = shared.withColumns({
        "_Int": F.filter("_slots", lambda s: s["slot"] < _FIRST_TENTH),
        "_Dec": F.filter("_slots", lambda s: s["slot"] > _FIRST_TENTH),
    })
    chosen = split.withColumns({
        f"_{p}_chosen": F.filter(f"_{p}", lambda s: s["share"] >= PREFERRED_SHARE)
        for p in ("Int", "Dec")
    })
    full = chosen.withColumns(
        _summary("Int", (
            "Int_Preferred_Digits", "Int_Preferred_Digits_Prop", "Int_Max_Last_Digit_Prop"))
        | _summary("Dec", (
            "Dec_Preferred_Tenths", "Dec_Preferred_Tenths_Prop", "Dec_Max_Tenth_Prop"))
    )
    preferred = F.col("Int_pref_n") + F.col("Dec_pref_n")
    share = bind(F.lit(100.0) * preferred / F.col("Total_n"), lambda v: r_round(v, 2))
    return full.select(
        *keys, "Total_n", preferred.alias("Total_pref_n"),
        "Int_Preferred_Digits", "Int_Preferred_Digits_Prop", "Int_Max_Last_Digit_Prop",
        "Dec_Preferred_Tenths", "Dec_Preferred_Tenths_Prop", "Dec_Max_Tenth_Prop",
        share.alias("Total_Preferred_Prop"), F.col("Int_pref_n"),
    )


def heaping_window(long: DataFrame) -> DataFrame:
    """Heaping per variable over all days."""
    return heaping(long, BY_VARIABLE).drop("Int_pref_n")


def heaping_daily(long: DataFrame) -> DataFrame:
    """Heaping per day and variable."""
    return heaping(long, BY_DAY).drop("Int_pref_n")


def int_summary(table: DataFrame, keys: Sequence[str] = BY_DAY) -> DataFrame:
    """Integer part of a ``heaping`` table: groups that hold integer values."""
    return table.filter("Int_Preferred_Digits IS NOT NULL").select(
        *keys, "Int_Preferred_Digits", "Int_Preferred_Digits_Prop", "Int_pref_n",
        "Int_Max_Last_Digit_Prop")


def heaping_labels(daily: DataFrame, latest_only: bool = False) -> DataFrame:
    """``53.33% (8/15)`` per day and variable with percent, numerator and denominator."""
    labels = daily.select(
        "Tanggal", "Variabel",
        fmt_share_label("Total_Preferred_Prop", "Total_pref_n", "Total_n").alias("label"),
        F.col("Total_Preferred_Prop").alias("pct"),
        F.col("Total_pref_n").alias("num"), F.col("Total_n").alias("den"),
    )
    if not latest_only:
        return labels
    # Labels are days by variables: a short table, of which the last day is kept in one pass.
    last = F.max("Tanggal").over(Window.partitionBy(F.lit(1)))
    return labels.withColumn("_last", last).filter("Tanggal = _last").drop("_last")


def average_labels(labels: DataFrame, average: str = "ratio") -> DataFrame:
    """One label per day over all variables.

    ``ratio`` is the ratio of sums, ``ratio_nonzero`` leaves out variables without any
    preferred value, ``mean`` is the mean of the percentages.
    """
    if average == "mean":
        rows = labels.groupBy("Tanggal").agg(r_round(F.avg("pct"), 2).alias("pct"))
        label = F.coalesce(F.format_string("%.2f%%", F.col("pct")), F.lit("-"))
    elif average in ("ratio", "ratio_nonzero"):
        rows = ratio_total(labels, skip_zero=average == "ratio_nonzero")
        label = fmt_share_label("pct", "num", "den")
    else:
        raise ValueError(f"unknown average {average}")
    return rows.select("Tanggal", F.lit(AVERAGE_ROW).alias("Variabel"), label.alias("label"))


def with_average(labels: DataFrame, average: str = "ratio") -> DataFrame:
    """Labels and ``average_labels`` as one table, from windows over the short label table."""
    day = Window.partitionBy("Tanggal")
    if average == "mean":
        pct = r_round(F.avg("pct").over(day), 2)
        label = F.coalesce(F.format_string("%.2f%%", pct), F.lit("-"))
    elif average in ("ratio", "ratio_nonzero"):
        skip = average == "ratio_nonzero"
        counted = (F.col("num") > 0) & (F.col("den") > 0) if skip else F.lit(True)
        num, den = (F.sum(F.when(counted, F.col(c))).over(day) for c in ("num", "den"))
        share = F.when(den > 0, r_round(F.lit(100.0) * num / den, 2))
        label = F.when(F.count_if(counted).over(day) > 0, fmt_share_label(share, num, den))
    else:
        raise ValueError(f"unknown average {average}")
    first = F.row_number().over(day.orderBy("Variabel")) == 1
    rows = labels.withColumns({"_average": label, "_first": first})
    own = F.struct(F.col("Variabel"), F.col("label"))
    mean = F.struct(F.lit(AVERAGE_ROW).alias("Variabel"), F.col("_average").alias("label"))
    both = F.when(F.col("_first") & F.col("_average").isNotNull(), F.array(own, mean))
    return rows.select("Tanggal", F.inline(F.coalesce(both, F.array(own))))


def heaping_pivot(
    labels: DataFrame, average: str = "ratio", fill: str | None = "-",
    days: Sequence[dt.date] | None = None,
) -> DataFrame:
    """Variables by dates, and an average row: both pivoted from one pass over the labels.

    Give the ``days`` of the scope's window where they are known; without them Spark lists the
    days first, which reads the labels' source once more.
    """
    wide = to_wide(with_average(labels, average), days, fill)
    return wide.orderBy((F.col("Variabel") == AVERAGE_ROW), "Variabel")


def heaping_trend(
    daily: DataFrame, variable: str | None = None, exclude: str | Iterable[dt.date] = (),
    without_sundays: bool = False, average: str = "mean",
) -> DataFrame:
    """Daily percent of a variable (or all) and the average of the remaining days."""
    kept = focus_variable(daily, variable).filter("Total_Preferred_Prop IS NOT NULL")
    kept = exclude_dates(kept, exclude)
    if without_sundays:
        kept = drop_sundays(kept)
    # A day holds one row per variable, so averages are windows over the short table.
    day = Window.partitionBy("Tanggal")
    if average == "mean":
        value = F.avg("Total_Preferred_Prop").over(day)
    elif average in ("ratio", "ratio_nonzero"):
        counted = F.col("Total_pref_n") > (0 if average == "ratio_nonzero" else -1)
        num, den = (F.sum(F.when(counted, F.col(c))).over(day) for c in ("Total_pref_n", "Total_n"))
        value = F.lit(100.0) * num / den
    else:
        raise ValueError(f"unknown average {average}")
    return kept.select("Tanggal", "Variabel", "Total_Preferred_Prop", value.alias("Average_Prop"))


NA_SCHEMA = (
    "Variabel string, n bigint, n_nonNA bigint, n_NA bigint, prop_NA double, min double, max double"
)


def na_scan(df: DataFrame, variables: Sequence[str], parser: Parser = parse_strip) -> DataFrame:
    """Rows, filled, empty, percent empty and extremes of the parsed variables."""
    types = dtypes_of(df)
    present = [v for v in variables if v in types]
    if not present:
        return df.sparkSession.createDataFrame([], NA_SCHEMA)
    parsed = df.select(*[number_of(quoted(v), types[v], parser).alias(v) for v in present])
    return null_counts(parsed, parsed.columns)


def parse_audit(
    df: DataFrame, variables: Sequence[str], ids: Sequence[str] = ("Tanggal",),
    parser: Parser = parse_strip,
) -> DataFrame:
    """Different written values that are no number, with the identifiers they occur under."""
    ids = [i for i in ids if i in df.columns]
    present = [v for v in variables if v in df.columns]
    long = to_long(df, ids, present, value="Original", parser=None)
    failed = parse_failures(long.withColumn("Parsed", parser("Original")))
    return distinct_rows(failed.select(*ids, "Variabel", "Original"))


def heaping_steps(
    df: DataFrame, variables: Sequence[str], average: str = "ratio", fill: str | None = "-",
    variable: str | None = None, day: dt.date | None = None, latest_only: bool = False,
    staff: str = "Perawat / Bidan / Nutrisionist / Sanitarian",
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """All step tables of the heaping report by name, from a table as it was read.

    Friendly columns are resolved here: the audit sees what was written, the other steps what
    was parsed. Without any of the variables the numeric-like columns are used. Six of the nine
    tables come from slot counts (at most 21 rows per day and variable). Nothing is written, unless
    ``keep`` (such as ``sinks.kept`` in a folder) stores these counts: then the table is read for them
    once, not six times.
    """
    written, parsed = dated(friendly_columns(df)), dated(apply_schema(df))
    variables = choose_variables(parsed, variables, ())
    ids = ["Tanggal", *[c for c in (staff,) if c in parsed.columns]]
    long = focus_variable(heaping_long(parsed, variables, ids=ids[1:]), variable)
    long = focus_date(long, day)
    slots = slot_counts(long, BY_DAY)
    slots = keep(slots) if keep else slots
    ints, decs = split_buckets(buckets_of(slots))
    daily = heaping_of(slots)
    labels = heaping_labels(daily, latest_only)
    return {
        "Step1_NA_Summary": na_scan(parsed, variables),
        "Step1_Audit": parse_audit(written, variables, ids),
        "Step2_df_long": with_digits(long),
        "Step3_int_counts": ints,
        "Step3_int_full": int_summary(daily),
        "Step4_dec_counts": decs,
        "Step5_Combined": daily.drop("Int_pref_n"),
        "Step6_preferred_raw": labels,
        "Step6_pivot_with_avg": heaping_pivot(labels, average, fill),
    }
