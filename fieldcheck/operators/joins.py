"""Joins of visits with chosen files, counts with denominators, values with rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from fieldcheck.operators.schema import unique_rules

# A side is broadcast only when its row count is proven not to exceed this.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, max_rows: int | None) -> DataFrame:
    """``df`` marked for broadcast if its proven row bound allows it.

    Without a bound, or beyond it, the plan stays a shuffle join that AQE may still turn
    into a broadcast once the real size is known.
    """
    fits = max_rows is not None and max_rows <= BROADCAST_ROWS
    return F.broadcast(df) if fits else df


def semi_latest_files(
    df: DataFrame, latest: DataFrame, keys: Sequence[str] = ("day", "file_name"),
    max_rows: int | None = None,
) -> DataFrame:
    """Rows whose keys are among the chosen files, NULL names matching NULL names.

    ``latest`` has one row per day: pass the number of days as ``max_rows``.
    """
    chosen = small_side(latest.select(*[F.col(k).alias(f"_l_{k}") for k in keys]), max_rows)
    on = [F.col(k).eqNullSafe(F.col(f"_l_{k}")) for k in keys]
    return df.join(chosen, on, "left_semi")


def with_denominator(
    counts: DataFrame, keys: Sequence[str], n: str = "n", total: str = "Total_n"
) -> DataFrame:
    """Counts with the total of their group and the share, without joining totals back.

    ``counts`` holds a handful of buckets per group, not rows.
    """
    whole = F.sum(n).over(Window.partitionBy(*keys))
    return counts.withColumn(total, whole).withColumn("prop", F.col(n) / F.col(total))


def combine_int_dec(
    denoms: DataFrame, ints: DataFrame, decs: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Denominators with integer and decimal summaries; absent counts are 0."""
    joined = denoms.join(ints, list(keys), "left").join(decs, list(keys), "left")
    return joined.fillna(0, ["Int_pref_n", "Dec_pref_n"])


def with_rules(
    long: DataFrame, rules: DataFrame, variable: str = "Variable",
    variables: Sequence[str] | None = None,
) -> DataFrame:
    """Long values with the rule of their variable.

    Given the list of variables, at most that many rules are left and broadcast; for an
    open set of variables the join is left to AQE. The first rule of a variable counts.
    """
    rules = unique_rules(rules)
    if variables is not None:
        rules = rules.filter(F.col("Variable").isin(list(variables)))
    rules = rules.withColumnRenamed("Variable", variable)
    rules = small_side(rules, len(variables) if variables is not None else None)
    return long.join(rules, variable, "left")


def flags_with_log(
    flags: DataFrame, log: DataFrame, keys: Sequence[str] = ("row_id", "Variable")
) -> DataFrame:
    """Flags with the log line of the same row and variable; shared columns are kept once."""
    extra = [c for c in log.columns if c in keys or c not in flags.columns]
    return flags.join(log.select(*extra), list(keys), "left")
