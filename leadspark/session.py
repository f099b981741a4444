"""Session settings that the library's plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Runtime settings.  The JVM never compiles methods beyond 8000 bytes of bytecode, so a stage
#: whose fused code grows larger runs faster unfused, with its expressions split over methods.
SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
