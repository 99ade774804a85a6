"""SparkSession with the settings that the library's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tessera", **conf: str) -> SparkSession:
    """A session in UTC and ANSI mode with adaptive execution; `conf` adds or overrides (dots as __)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()
