"""Values outside the range rules: summary, value log, counts and strict drops."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from fieldcheck.constants import LOG_ID_CANDIDATES
from fieldcheck.functions.numbers import fmt_pct, number_of, parse_first_number
from fieldcheck.operators.aggregates import any_flag, count_by
from fieldcheck.operators.filters import outside_rule
from fieldcheck.operators.joins import with_rules
from fieldcheck.operators.ranking import order_desc
from fieldcheck.operators.reshape import to_long
from fieldcheck.operators.schema import (
    Parser, Rule, clip_to_null, dtypes_of, quoted, rules_by_variable,
)


SUMMARY_SCHEMA = (
    "Variable string, `Valid min` double, `Valid max` double, Rows bigint, Non_missing bigint, "
    "Outliers bigint, `Outlier %` string"
)


def guardrail_summary(
    df: DataFrame, rules: DataFrame, variables: Sequence[str],
    parser: Parser = parse_first_number,
) -> DataFrame:
    """Per variable: rule, rows, filled values, outliers and their percent; most outliers first.

    Rules are broadcast (at most one per variable) and rows are counted before the shuffle,
    which therefore carries one row per variable and task.
    """
    present = [v for v in variables if v in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([], SUMMARY_SCHEMA)
    long = to_long(df, [], present, "Variable", "value", parser)
    v = F.col("value")
    low, high = F.col("min_ok"), F.col("max_ok")
    counted = (
        with_rules(long, rules, "Variable", present)
        .groupBy("Variable", "min_ok", "max_ok")
        .agg(
            F.count(F.lit(1)).alias("Rows"), F.count(v).alias("Non_missing"),
            F.count_if((v < low) | (v > high)).alias("Outliers"),
        )
        .filter("min_ok IS NOT NULL OR max_ok IS NOT NULL")
    )
    share = F.col("Outliers") / F.nullif(F.col("Non_missing"), F.lit(0))
    summary = counted.select(
        "Variable", F.col("min_ok").alias("Valid min"), F.col("max_ok").alias("Valid max"),
        "Rows", "Non_missing", "Outliers", fmt_pct(share).alias("Outlier %"),
    )
    return order_desc(summary, "Outliers", "Variable")


def log_ids(df: DataFrame, ids: Sequence[str] | None = None) -> list[str]:
    """Identifier columns of the logs: the given ones, or the known ones that exist."""
    return [c for c in (LOG_ID_CANDIDATES if ids is None else ids) if c in df.columns]


def _empty_log(df: DataFrame, row_id: str, ids: Sequence[str]) -> DataFrame:
    """The log of a table without any variable to check."""
    text = F.lit(None).cast("string")
    return df.select(
        quoted(row_id).alias("row_id"), *[quoted(i) for i in ids], text.alias("Variable"),
        text.alias("raw_value"),
    ).filter(F.lit(False))


def outlier_log(
    df: DataFrame, rules: DataFrame, variables: Sequence[str], row_id: str,
    ids: Sequence[str] | None = None, parser: Parser = parse_first_number,
) -> DataFrame:
    """Every value outside its rule as it was written, with row id and identifiers.

    A narrow plan: cells are unpivoted, parsed and filtered where they are read.
    """
    ids = log_ids(df, ids)
    present = [v for v in variables if v in df.columns]
    if not present:
        return _empty_log(df, row_id, ids)
    types = dtypes_of(df)
    cells = F.array(*[
        F.struct(F.lit(v).alias("Variable"), quoted(v).cast("string").alias("raw_value"),
                 number_of(quoted(v), types[v], parser).alias("value"))
        for v in present
    ])
    long = df.select(quoted(row_id).alias("row_id"), *[quoted(i) for i in ids], F.inline(cells))
    bad = outside_rule(with_rules(long, rules, "Variable", present))
    return bad.select("row_id", *[quoted(i) for i in ids], "Variable", "raw_value")


def outlier_counts(log: DataFrame, unit: str = "poliruangan") -> DataFrame:
    """Logged values per variable and, if the log has it, service unit; most first."""
    keys = ["Variable", *([unit] if unit in log.columns else [])]
    return order_desc(count_by(log, keys), "n", *keys)


def strict_drop_log(
    df: DataFrame, rules: DataFrame | Mapping[str, Rule],
    variables: Sequence[str], row_id: str, ids: Sequence[str] | None = None,
    parser: Parser = parse_first_number,
) -> DataFrame:
    """Rows that a strict filter would drop, one line per variable that causes it.

    The written value sits in the same row as its flag, so flags and log need no join.
    """
    ids = log_ids(df, ids)
    present = [v for v in variables if v in df.columns]
    if isinstance(rules, DataFrame):
        rules = rules_by_variable(rules, present)
    ruled = [v for v in present if v in rules]
    if not ruled:
        return _empty_log(df, row_id, ids)
    raw = df.withColumns({f"raw_{v}": quoted(v).cast("string") for v in ruled})
    flagged = clip_to_null(raw, {v: rules[v] for v in ruled}, parser)
    dropped = flagged.filter(any_flag([f"out_{v}" for v in ruled]))
    causes = F.array(*[
        F.struct(F.lit(v).alias("Variable"), quoted(f"raw_{v}").alias("raw_value"),
                 quoted(f"out_{v}").alias("is_out"))
        for v in ruled
    ])
    lines = dropped.select(
        quoted(row_id).alias("row_id"), *[quoted(i) for i in ids], F.inline(causes)
    )
    return lines.filter("is_out").drop("is_out")
