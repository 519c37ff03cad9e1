"""A session with the settings the engine relies on."""

from pyspark.sql import SparkSession


def build(app: str = "loadweave", **conf: str) -> SparkSession:
    """UTC session time zone, ANSI arithmetic, adaptive execution with skew joins split."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.unionOutputPartitioning": "false",  # adaptive execution may change the partitioning of one side alone
        "spark.sql.python.filterPushdown.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
