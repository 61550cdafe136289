"""File sources and column-pruned table scans."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fieldcheck.constants import (
    ADMIN_MAP, CLINICAL_MAP, DEFAULT_RULES, LIVE_COLUMNS,
)
from fieldcheck.operators.schema import unique_rules

RULES_SCHEMA = T.StructType([
    T.StructField("Variable", T.StringType()),
    T.StructField("min_ok", T.DoubleType()),
    T.StructField("max_ok", T.DoubleType()),
])


def load_dataset(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None,
    infer: bool = False,
) -> DataFrame:
    """A table from files, by the path's ending: Parquet, ORC, CSV or gzipped CSV.

    CSV columns are read as text, which every operator here accepts; pass ``schema``, or
    ``infer=True`` for one more pass over the files. A path without ending is a Parquet folder.
    """
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    ending = name.rsplit(".", 1)[-1] if "." in name else ""
    if ending in ("", "parquet"):
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(path)
    if ending == "orc":
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.orc(path)
    if ending in ("csv", "gz"):
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema else reader.option("inferSchema", infer)
        return reader.csv(path)
    raise ValueError(f"unsupported file ending .{ending}: {path}")


def scan_minimal(
    df: DataFrame,
    wanted: Iterable[str] = LIVE_COLUMNS,
    maps: Iterable[Mapping[str, list[str]]] = (CLINICAL_MAP, ADMIN_MAP),
) -> DataFrame:
    """Only the wanted columns and map candidates that the table has, in wanted order."""
    asked = list(wanted) + [c for m in maps for candidates in m.values() for c in candidates]
    return df.select([F.col(f"`{c}`") for c in dict.fromkeys(asked) if c in df.columns])


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_RULES, RULES_SCHEMA)


def load_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Range rules ``Variable, min_ok, max_ok``, the first row of a variable winning.

    Without a path, or when the file cannot be read as rules, the default table.
    """
    if path is None:
        return default_rules(spark)
    try:
        # multiLine keeps a file in one piece, so the running id follows its lines.
        raw = spark.read.option("header", True).option("multiLine", True).csv(path)
        rules = raw.select(
            F.col("Variable").cast("string").alias("Variable"),
            F.col("min_ok").try_cast("double").alias("min_ok"),
            F.col("max_ok").try_cast("double").alias("max_ok"),
            F.monotonically_increasing_id().alias("_line"),
        )
    except AnalysisException:
        return default_rules(spark)
    return first_rule(rules, "_line")


def first_rule(rules: DataFrame, order_col: str) -> DataFrame:
    """One rule per variable, the lowest ``order_col`` first."""
    return unique_rules(rules, order_col)
