"""Session settings the operators are written for."""

from pyspark.sql import SparkSession

# Settings that may be changed on a running session.
RUNTIME = {
    # Timestamps are stored and compared in UTC.
    "spark.sql.session.timeZone": "UTC",
    # Split or merge shuffle partitions by what was measured, and split skewed join sides.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Generated methods over 8000 bytes are never compiled to machine code; use smaller ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session; sizes and cluster settings stay as they are."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark
