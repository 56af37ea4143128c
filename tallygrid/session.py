"""Sessions with the settings the library is meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tallygrid", master: str | None = None, **settings) -> SparkSession:
    """A session with adaptive execution, skew splitting and run-time filters; settings override them."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        # Joins that are not broadcast have a side above the broadcast threshold, which is this one's default as well.
        "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "256MB",
        "spark.sql.session.timeZone": "UTC",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
