"""Growing folders of log readings as streams, with the same bins as the batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_growing(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def binned(readings: DataFrame, time: str, key: list[str], value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling windows with a watermark: n, sum, extremes per key and window."""
    w = F.window(time, width)
    return readings.withWatermark(time, late).groupBy(w, *key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most")).select(F.col("window.start").alias("start"), *key, "n", "total", "least", "most")


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Everything that is there now, as complete results in a Parquet table; then stop."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def typed_readings(rows: DataFrame, hole: str, channels: list[str], depth: str | None = None, interval: tuple[str, str] | None = None) -> DataFrame:
    """Log rows, streamed or not, as ``hole, depth`` and the channels as numbers; ``usable`` where a reading has both.

    The depth is that column, or the middle of an interval's two. Cells that aren't numbers are null; a
    decimal comma counts.
    """
    if (depth is None) == (interval is None):
        raise ValueError("a log has a depth column or an interval, not both")

    def cell(name: str) -> Column:
        kind = dict(rows.dtypes)[name]
        v = F.replace(F.trim(name), F.lit(","), F.lit(".")).try_cast("double") if kind == "string" else F.col(name).cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)

    at = cell(depth) if depth else (cell(interval[0]) + cell(interval[1])) / 2
    named = F.nullif(F.trim(F.col(hole).cast("string")), F.lit(""))
    out = rows.select(named.alias("hole"), at.alias("depth"), *(cell(c).alias(c) for c in channels))
    return out.withColumn("usable", F.col("hole").isNotNull() & F.col("depth").isNotNull())
