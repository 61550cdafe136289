"""Column resolution, friendly names, projections and rules applied to columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from fieldcheck.constants import (
    ADMIN_MAP, CLINICAL_MAP, DATE_CANDIDATES, FACILITY_CANDIDATES, NUMERIC_VARS,
    PII_COLUMNS, PRINT_LABELS, SAFE_COLUMNS,
)
from fieldcheck.functions.numbers import (
    is_numeric_type, number_of, parse_first_number, parse_strip,
)
from fieldcheck.functions.text import norm_name, pretty_var

Parser = Callable[[Column | str], Column]


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def dtypes_of(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def resolve_columns(
    names: Sequence[str], friendly_map: Mapping[str, Sequence[str]]
) -> dict[str, str]:
    """Source column of each friendly name: an exact candidate, else a look-alike."""
    exact = set(names)
    by_norm: dict[str, str] = {}
    for name in names:
        by_norm.setdefault(norm_name(name), name)
    found = {}
    for friendly, candidates in friendly_map.items():
        hits = [c for c in candidates if c in exact]
        hits = hits or [by_norm[norm_name(c)] for c in candidates if norm_name(c) in by_norm]
        if hits:
            found[friendly] = hits[0]
    return found


def add_alias_cols(df: DataFrame, resolved: Mapping[str, str]) -> DataFrame:
    """Copy each resolved column under its friendly name unless that name is taken.

    Spark's names ignore case, so a friendly name that differs from its source only in case
    (``Suhu`` for ``suhu``) takes the source's place instead of standing next to it.
    """
    fresh = {
        friendly: quoted(real) for friendly, real in resolved.items()
        if friendly not in df.columns and real in df.columns
    }
    return df.withColumns(fresh) if fresh else df


def friendly_columns(df: DataFrame) -> DataFrame:
    """Friendly columns as they were written: ``Tanggal`` from ``day``, and both maps."""
    if "day" in df.columns and "Tanggal" not in df.columns:
        df = df.withColumn("Tanggal", F.col("day").cast("date"))
    df = add_alias_cols(df, resolve_columns(df.columns, CLINICAL_MAP))
    return add_alias_cols(df, resolve_columns(df.columns, ADMIN_MAP))


def apply_schema(df: DataFrame, parser: Parser = parse_strip) -> DataFrame:
    """Friendly columns with numbers parsed."""
    df = friendly_columns(df)
    types = dtypes_of(df)
    numbers = {v: number_of(quoted(v), types[v], parser) for v in NUMERIC_VARS if v in types}
    return df.withColumns(numbers) if numbers else df


def ensure_columns(df: DataFrame, names: Iterable[str] = PII_COLUMNS) -> DataFrame:
    """Add absent columns as NULL strings."""
    missing = {n: F.lit(None).cast("string") for n in names if n not in df.columns}
    return df.withColumns(missing) if missing else df


def find_column(names: Sequence[str], candidates: Sequence[str]) -> str | None:
    """First column, in table order, that is a candidate whatever its case."""
    wanted = {c.lower() for c in candidates}
    return next((n for n in names if n.lower() in wanted), None)


def find_facility_col(names: Sequence[str]) -> str | None:
    return find_column(names, FACILITY_CANDIDATES)


def guess_date_col(names: Sequence[str]) -> str | None:
    """Date column by the priority of the candidates, whatever its case."""
    by_lower = {}
    for n in names:
        by_lower.setdefault(n.lower(), n)
    return next((by_lower[c] for c in DATE_CANDIDATES if c in by_lower), None)


def numeric_like_columns(
    df: DataFrame, columns: Sequence[str] | None = None, parser: Parser = parse_strip
) -> DataFrame:
    """``column, n_parsed`` of the columns with at least one parseable value, one pass."""
    types = dtypes_of(df)
    columns = list(columns or df.columns)
    counts = df.agg(*[
        F.count(number_of(quoted(c), types[c], parser)).alias(f"_{i}")
        for i, c in enumerate(columns)
    ])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("n_parsed"))
        for i, c in enumerate(columns)
    ])
    return counts.select(F.inline(rows)).filter("n_parsed > 0")


def has_digit_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Variant of ``numeric_like_columns``: columns with a digit in any row, one pass."""
    types = dtypes_of(df)
    columns = list(columns or df.columns)
    hits = df.agg(*[
        (F.lit(True) if is_numeric_type(types[c])
         else F.coalesce(F.bool_or(quoted(c).cast("string").rlike(r"\d")), F.lit(False)))
        .alias(f"_{i}")
        for i, c in enumerate(columns)
    ])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("numeric_like"))
        for i, c in enumerate(columns)
    ])
    return hits.select(F.inline(rows)).filter("numeric_like").select("column")


def coarse_type(dtype: T.DataType) -> str:
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if is_numeric_type(dtype):
        return "numeric"
    if isinstance(dtype, T.BooleanType):
        return "logical"
    if isinstance(dtype, T.StringType):
        return "character"
    return dtype.simpleString()


def describe_columns(df: DataFrame, rsd: float = 0.05) -> DataFrame:
    """Index, display name and coarse type of each column, with filled and distinct counts."""
    aggs = []
    for i, c in enumerate(df.columns):
        aggs.append(F.count(quoted(c)).alias(f"n_{i}"))
        aggs.append(F.approx_count_distinct(quoted(c), rsd).alias(f"d_{i}"))
    rows = F.array(*[
        F.struct(
            F.lit(i + 1).cast("bigint").alias("index"), F.lit(f.name).alias("column"),
            F.lit(coarse_type(f.dataType)).alias("type"),
            F.col(f"n_{i}").alias("non_null"), F.col(f"d_{i}").alias("approx_distinct"),
        )
        for i, f in enumerate(df.schema.fields)
    ])
    table = df.agg(*aggs).select(F.inline(rows))
    return table.select(
        "index", "column", pretty_var("column").alias("name"), "type",
        "non_null", "approx_distinct",
    )


def project_safe(
    df: DataFrame, keep: Sequence[str] = (), refused: Iterable[str] = ()
) -> DataFrame:
    """Only the columns that may be stored, and the caller's ``keep``.

    Spark ignores the case of names, and friendly names spell the same column in another way, so
    raw identifiers and ``refused`` are recognized by their normalized names.
    """
    raw = {norm_name(c) for c in (*PII_COLUMNS, *refused)}
    safe = {c.lower() for c in SAFE_COLUMNS}
    for c in keep:
        if norm_name(c) in raw:
            raise ValueError(f"raw identifiers cannot be kept: {c}")
        if c.lower() in safe or sum(c.lower() == k.lower() for k in keep) > 1:
            raise ValueError(f"column is kept already: {c}")
    return df.select(*SAFE_COLUMNS, *[quoted(c) for c in keep])


def rename_for_print(df: DataFrame, labels: Mapping[str, str] = PRINT_LABELS) -> DataFrame:
    """Printed headers for known columns."""
    return df.withColumnsRenamed({c: labels[c] for c in df.columns if c in labels})


Rule = tuple[float | None, float | None]


def clip_value(x: Column, low: float | None, high: float | None) -> tuple[Column, Column]:
    """The value inside the rule or NULL, and the flag that it was outside; an end may be open."""
    out = F.coalesce((x < F.lit(low)) | (x > F.lit(high)), F.lit(False))
    return F.when(~out, x), out


def clip_to_null(
    df: DataFrame, rules: Mapping[str, Rule],
    parser: Parser = parse_first_number, flag_prefix: str = "out_",
) -> DataFrame:
    """Numbers outside their rule become NULL and set ``out_<variable>``; non-numbers too."""
    types = dtypes_of(df)
    new = {}
    for var, (low, high) in rules.items():
        if var in types:
            x = number_of(quoted(var), types[var], parser)
            new[var], new[f"{flag_prefix}{var}"] = clip_value(x, low, high)
    return df.withColumns(new) if new else df


def unique_rules(rules: DataFrame, order_col: str | None = None) -> DataFrame:
    """One rule per variable: the first by ``order_col``, else the first in the table's order."""
    if order_col is None:
        rules, order_col = rules.withColumn("_order", F.monotonically_increasing_id()), "_order"
    best = F.min_by(F.struct("min_ok", "max_ok"), F.col(order_col))
    return (
        rules.filter(F.col("Variable").isNotNull())
        .groupBy("Variable").agg(best.alias("_rule"))
        .select("Variable", "_rule.min_ok", "_rule.max_ok")
    )


def rules_by_variable(rules: DataFrame, variables: Sequence[str]) -> dict[str, Rule]:
    """Rules of the given variables on the driver: at most one row for each of them.

    The first rule of a variable counts, with one end open if it has only the other.
    """
    rows = (
        unique_rules(rules).filter(F.col("Variable").isin(list(variables)))
        .filter("min_ok IS NOT NULL OR max_ok IS NOT NULL").collect()
    )
    found = {r["Variable"]: (r["min_ok"], r["max_ok"]) for r in rows}
    return {v: found[v] for v in variables if v in found}


def at_stage(
    df: DataFrame, stage: str, rules: DataFrame | Mapping[str, Rule] | None
) -> DataFrame:
    """The table as it is (``raw``), or with values outside the rules removed (``clipped``)."""
    if stage == "raw":
        return df
    if stage != "clipped" or rules is None:
        raise ValueError(f"stage must be raw, or clipped with rules: {stage}")
    if isinstance(rules, DataFrame):
        rules = rules_by_variable(rules, df.columns)
    return clip_to_null(df, rules)


def clean(df: DataFrame, rules: DataFrame | Mapping[str, Rule]) -> DataFrame:
    """Friendly columns with values outside the rules removed and flagged."""
    df = apply_schema(df)
    if isinstance(rules, DataFrame):
        rules = rules_by_variable(rules, df.columns)
    return clip_to_null(df, rules)
