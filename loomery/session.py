"""One place for the session settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

from loomery.shipping import ship


def build_session(app: str = "loomery", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and quiet logs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark
