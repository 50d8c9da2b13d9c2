"""Session settings the joins rely on under skew."""

from __future__ import annotations

from pyspark.sql import SparkSession

SKEW_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot partition even where that costs one more shuffle after the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def use_skew_settings(spark: SparkSession) -> SparkSession:
    """Turns on adaptive splitting of skewed join partitions for this session."""
    for key, value in SKEW_SETTINGS.items():
        spark.conf.set(key, value)
    return spark
