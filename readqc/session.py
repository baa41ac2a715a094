"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "readqc", **conf: str) -> SparkSession:
    """A session with adaptive plans and UTC; the cluster's own settings come first."""
    builder = SparkSession.builder.appName(app)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    for key, value in {**defaults, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
