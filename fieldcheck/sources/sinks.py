"""Cache by day, CSV export and step exports."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from fieldcheck.sources.versions import replace_days


def work_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, which must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder of its own below the work folder."""
    return f"{work_folder(spark)}/fieldcheck-{name}-{uuid.uuid4().hex[:12]}"


def write_cache(df: DataFrame, path: str) -> None:
    """Save distinct rows by day; days in ``df`` replace the same days of the cache, all at once."""
    replace_days(df, path)


def export_name(base: str, stamp: str, latest_only: bool = False) -> str:
    """Folder name of an export; ``_latest`` marks a result reduced to the last date."""
    return f"{base}_{stamp}{'_latest' if latest_only else ''}.csv"


def export_csv(df: DataFrame, path: str) -> str:
    """Save a result as CSV with a header line; fields that hold a quote double it."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def kept(df: DataFrame, path: str) -> DataFrame:
    """A table that several results are made from, written once to a new folder and read back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def export_steps(steps: Mapping[str, DataFrame], folder: str) -> list[str]:
    """Save every step table under its name; returns the written paths."""
    paths = []
    for name, table in steps.items():
        path = f"{folder.rstrip('/')}/{name}"
        table.write.mode("overwrite").parquet(path)
        paths.append(path)
    return paths
