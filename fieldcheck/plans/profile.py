"""Completeness and validity profile of columns, and the tables behind its charts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from fieldcheck.constants import (
    CLINICAL_VARS, OLDEST_DATE, RULE_LABELS, STATUS_ORDER,
)
from fieldcheck.functions.numbers import (
    fmt_pct, fmt_pct_value, is_finite, is_numeric_type, parse_first_number, round2,
)
from fieldcheck.functions.text import (
    blank_to_null, digits_only, hash_preview, id_length_ok, is_present, normalize_phone,
    phone_length_ok, pretty_var,
)
from fieldcheck.functions.times import parse_date_multi
from fieldcheck.operators.aggregates import quantiles
from fieldcheck.operators.joins import small_side, with_rules
from fieldcheck.operators.schema import apply_schema, clip_to_null, dtypes_of, quoted, \
    rules_by_variable

NUMBERS = ("Min", "Q1", "Median", "Q3", "Max")
SCHEMA = T.StructType(
    [T.StructField(n, T.LongType() if n in (
        "Rows", "Missing", "Non_missing", "Distinct (non-missing)", "Invalid (non-missing)",
    ) else T.StringType()) for n in (
        "Variable", "Rows", "Missing", "Missing %", "Non_missing", "Non_missing %",
        "Distinct (non-missing)", "Invalid (non-missing)", "Rule")]
    + [T.StructField(n, T.DoubleType()) for n in NUMBERS]
)
_STATS = ("q_min", "q1", "median", "q3", "q_max")


def infer_type(variable: str, numeric: Sequence[str] = CLINICAL_VARS) -> str:
    """nik, phone, date, numeric or text, by the variable's name."""
    name = variable.lower()
    if name == "nik":
        return "nik"
    if any(part in name for part in ("telp", "telepon", "hp", "phone")):
        return "phone"
    squeezed = name.replace(" ", "")
    if any(p in squeezed for p in ("tgllahir", "tgl.lahir", "tanggallahir", "dob", "birth")):
        return "date"
    return "numeric" if variable in numeric else "text"


def admin_aliases(df: DataFrame) -> DataFrame:
    """Friendly admin columns, with fallbacks where the maps found nothing.

    A presence flag becomes ``present`` or NULL, so that false counts as missing.
    """
    df = apply_schema(df)
    present = F.lit("present")
    new: dict[str, Column] = {}
    for friendly, masked, hashed in (
        ("NIK", "nik_masked", "nik_hash"), ("No Telp", "phone_masked", "phone_hash"),
    ):
        shown = [quoted(masked)] if masked in df.columns else []
        shown += [hash_preview(quoted(hashed))] if hashed in df.columns else []
        if friendly not in df.columns and shown:
            new[friendly] = shown[0]
    if "name_present" in df.columns:
        new["Nama Pasien"] = F.when(F.col("name_present"), present)
    elif "nama_pasien" in df.columns and "Nama Pasien" not in df.columns:
        new["Nama Pasien"] = F.when(is_present("nama_pasien"), present)
    return df.withColumns(new) if new else df


def _cells(df: DataFrame, variables: Sequence[str], kinds: dict[str, str]) -> DataFrame:
    """Long form: variable, missing flag, distinct key, number, and a precomputed bad flag."""
    types = dtypes_of(df)
    structs = []
    for v in variables:
        kind, dtype = kinds[v], types[v]
        prefix = {"nik": "nik", "phone": "phone"}.get(kind)
        flagged = prefix and {f"{prefix}_len", f"{prefix}_len_ok"} <= set(types)
        number = F.lit(None).cast("double")
        key = blank_to_null(quoted(v))
        missing, bad = key.isNull(), F.lit(False)
        if flagged:
            length = F.col(f"{prefix}_len")
            missing = length.isNull() | (length == 0)
            bad = ~missing & ~F.coalesce(F.col(f"{prefix}_len_ok"), F.lit(True))
            if f"{prefix}_hash" in types:
                key = F.col(f"{prefix}_hash")
        elif is_numeric_type(dtype):
            number, key = quoted(v).cast("double"), F.lit(None).cast("string")
            missing = number.isNull() | F.isnan(number)
            number = F.when(~missing, number)
        elif kind == "date" and not isinstance(dtype, T.StringType):
            key = F.date_format(quoted(v), "yyyy-MM-dd")
        structs.append(F.struct(
            F.lit(v).alias("Variable"), missing.alias("missing"), key.alias("key"),
            number.alias("number"), bad.alias("bad"),
        ))
    return df.select(F.inline(F.array(*structs)))


def profile(
    df: DataFrame, variables: Sequence[str], rules: DataFrame,
    ref_date: dt.date | None = None, stage: str = "raw",
    kinds: dict[str, str] | None = None,
) -> DataFrame:
    """One row per variable: filled, distinct and invalid counts, and five numbers.

    ``stage="clipped"`` first turns values outside the rules into NULL. All cells are counted
    by (variable, text) once; every count, the distinct count and the exact quantiles are
    taken from that table, so texts are parsed once per different text, not per row.
    """
    variables = [v for v in variables if v in df.columns]
    if not variables:
        return df.sparkSession.createDataFrame([], SCHEMA)
    types = dtypes_of(df)
    kinds = {v: (kinds or {}).get(v, infer_type(v)) for v in variables}
    if stage == "clipped":
        ruled = [v for v in variables if kinds[v] == "numeric"]
        df = clip_to_null(df, rules_by_variable(rules, ruled))
        types = dtypes_of(df)
    elif stage != "raw":
        raise ValueError(f"unknown stage {stage}")
    ref_date = ref_date or dt.date.today()

    def of_kind(kind: str, text_only: bool = False) -> Column:
        names = [v for v in variables if kinds[v] == kind]
        if text_only:
            names = [v for v in names if not is_numeric_type(types[v])]
        return F.col("Variable").isin(names) if names else F.lit(False)

    texts = (
        _cells(df, variables, kinds)
        .groupBy("Variable", "missing", "key", "number")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad_n"))
    )
    number = F.when(of_kind("numeric", text_only=True) & ~F.col("missing"),
                    parse_first_number("key", comma_decimal=False)).otherwise(F.col("number"))
    texts = texts.withColumn("number", number)
    ruled = with_rules(texts, rules, "Variable", variables)

    x, key = F.col("number"), F.col("key")
    born = F.when(of_kind("date"), parse_date_multi(key))
    flags_known = {p: {f"{p}_len", f"{p}_len_ok"} <= set(types) for p in ("nik", "phone")}
    wrong = F.lit(False)
    wrong |= of_kind("numeric") & (
        x.isNull() | F.coalesce((x < F.col("min_ok")) | (x > F.col("max_ok")), F.lit(False)))
    wrong |= of_kind("date") & ~F.coalesce(born.between(OLDEST_DATE, ref_date), F.lit(False))
    if not flags_known["nik"]:
        wrong |= of_kind("nik") & ~id_length_ok(F.length(digits_only(key)))
    if not flags_known["phone"]:
        wrong |= of_kind("phone") & ~phone_length_ok(F.length(normalize_phone(key)))
    is_key = ~F.col("missing") & (key.isNotNull() | F.col("number").isNotNull())
    counts = ruled.groupBy("Variable").agg(
        F.sum("n").alias("Rows"),
        F.sum(F.when(F.col("missing"), F.col("n")).otherwise(0)).alias("Missing"),
        F.count_if(is_key).alias("distinct_n"),
        F.sum(F.when(F.col("missing"), 0).when(wrong, F.col("n")).otherwise(F.col("bad_n")))
        .alias("invalid_n"),
    )
    result = counts
    if any(k == "numeric" for k in kinds.values()):
        # bad_n never exceeds n. Naming both keeps this filter above the counting, so that
        # counts and quantiles read one and the same shuffle.
        is_number = of_kind("numeric") & is_finite(x) & ~F.col("missing")
        numbers = texts.filter(is_number | (F.col("n") < F.col("bad_n"))).select(
            "Variable", x.alias("value"), "n")
        stats = quantiles(numbers, ["Variable"], names=_STATS, max_groups=len(variables))
        # One row per variable.
        result = counts.join(small_side(stats, len(variables)), "Variable", "left")
    else:
        result = counts.withColumns({s: F.lit(None).cast("double") for s in _STATS})

    rows = F.greatest(F.col("Rows"), F.lit(1))
    label = F.lit(RULE_LABELS["text"])
    for kind in ("nik", "phone", "date", "numeric"):
        label = F.when(of_kind(kind), F.lit(RULE_LABELS[kind])).otherwise(label)
    filled = F.col("Rows") - F.col("Missing")
    return result.select(
        "Variable", "Rows", "Missing", fmt_pct(F.col("Missing") / rows).alias("Missing %"),
        filled.alias("Non_missing"), fmt_pct(filled / rows).alias("Non_missing %"),
        F.col("distinct_n").alias("Distinct (non-missing)"),
        F.col("invalid_n").alias("Invalid (non-missing)"), label.alias("Rule"),
        *[round2(s).alias(n) for s, n in zip(_STATS, NUMBERS, strict=True)],
    )


def numbered(table: DataFrame, order: str = "Variable") -> DataFrame:
    """Adds the running ``No.`` of a printed table (one row per variable)."""
    no = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)).cast("bigint")
    return table.select(no.alias("No."), "*")


def profile_tables(
    df: DataFrame, rules: DataFrame, admin: Sequence[str], clinical: Sequence[str],
    ref_date: dt.date | None = None, stage: str = "raw",
) -> tuple[DataFrame, DataFrame]:
    """The admin table (without numbers) and the clinical table."""
    admin_table = profile(df, admin, rules, ref_date, stage).drop(*NUMBERS)
    return admin_table, profile(df, clinical, rules, ref_date, stage)


def admin_completeness(table: DataFrame) -> DataFrame:
    """Filled share per variable, lowest first."""
    rate = F.col("Non_missing") / F.greatest(F.col("Rows"), F.lit(1))
    return table.select(
        pretty_var("Variable").alias("Variable_lbl"), rate.alias("non_missing_rate"),
        fmt_pct(rate).alias("label"),
    ).orderBy("non_missing_rate", "Variable_lbl")


def status_composition(table: DataFrame) -> DataFrame:
    """Valid, invalid and missing share of the rows of each variable."""
    rows = F.greatest(F.col("Rows"), F.lit(1))
    missing, invalid = F.col("Missing") / rows, F.col("Invalid (non-missing)") / rows
    shares = table.select(
        pretty_var("Variable").alias("Variable_lbl"), missing.alias("Missing"),
        invalid.alias("Invalid"),
        F.greatest(F.lit(0.0), F.lit(1.0) - missing - invalid).alias("Valid"),
    )
    return status_long(shares)


def status_long(shares: DataFrame) -> DataFrame:
    """Long form of the status shares with the order of the statuses."""
    long = shares.unpivot(["Variable_lbl"], STATUS_ORDER, "Status", "Rate")
    order = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("Status"))
    return long.withColumn("Status_order", order.cast("bigint"))


def numeric_card(table: DataFrame, rules: DataFrame, variable: str) -> DataFrame:
    """Five numbers, filled count, missing and invalid percent and rule band of a variable."""
    one = with_rules(table.filter(F.col("Variable") == variable), rules, "Variable", [variable])

    def percent(part: str, whole: str) -> Column:
        return fmt_pct_value(F.col(part) / F.nullif(F.col(whole), F.lit(0)) * 100.0)

    return one.select(
        "Variable", *NUMBERS, F.col("Non_missing").alias("N"),
        percent("Missing", "Rows").alias("missing_pct"),
        percent("Invalid (non-missing)", "Non_missing").alias("invalid_pct"),
        "min_ok", "max_ok",
    )
