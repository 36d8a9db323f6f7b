"""Session settings that the plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "terrachron", **conf: str) -> SparkSession:
    """A session with adaptive execution (coalescing, skew joins) and UTC. Further settings win."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.appName(app)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
