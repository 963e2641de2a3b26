"""Session settings the library is written for.

Everything also runs in a plain session; these settings only make the results
time-zone free, keep decimal products exact, and let Spark split hot keys.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # A product of decimals keeps its scale, so round(a * b, 2) rounds only once.
    "spark.sql.decimalOperations.allowPrecisionLoss": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128m",
    # A task holds what it sorts and counts several times over as large as it is shuffled.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # Dimensions are broadcast only while their size stays below this bound.
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    # Feeds with many rules give long generated methods, which the JVM only interprets.
    # Beyond this size Spark uses its shorter per-operator code instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Needed to read GBK files; UTF-8 files do not depend on it.
    "spark.sql.legacy.javaCharsets": "true",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "reportloom", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
