"""Session settings that the jobs of this package profit from."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Re-plan joins, merge small partitions and split skewed ones at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Wide cleaning projections become methods that the JVM would refuse to compile; beyond
    # this many bytes Spark generates several smaller ones instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tuned(spark: SparkSession) -> SparkSession:
    """The session with these settings, all of which may be changed at run time."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
