"""Streaming extensions: running accuracy, windowed event counts, log lines from a growing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaesta.operators.logs import typed_header, with_header


def running_accuracy(stream: DataFrame, by: list[str], ok: str) -> DataFrame:
    """W1 on a stream: accuracy so far per key, to be written in update or complete mode."""
    return stream.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(ok).cast("double")), 6).alias("accuracy"))


def windowed_counts(stream: DataFrame, ts: str, by: list[str], window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts per event-time window; rows later than `late` are dropped by the watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), *by).agg(F.count(F.lit(1)).alias("n"))


def header_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header lines of a growing folder of log lines, parsed as they arrive (entries need the file's order)."""
    lines = spark.readStream.schema(schema).parquet(path)
    h = with_header(lines).filter("f is not null").withColumn("h", typed_header(F.col("f"), F.col("log_file")))
    return h.filter("h is not null").select("log_file", "line_no", "h.level", "h.component")
