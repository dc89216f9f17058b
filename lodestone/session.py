"""Session factory used by the tests, the bench and local runs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, app: str = "lodestone", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session; on a cluster the caller's own session is used instead. ``a__b`` sets ``a.b``."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(map={k.replace("__", "."): v for k, v in conf.items()})
        .getOrCreate()
    )
