"""Sinks (S8-S13): JSON lines, dual outputs, status files, truncated CSV, resumable partitions, indexes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaesta.common import exists, write_text


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_dual(df: DataFrame, path: str, stamp: str, latest: bool) -> None:
    """A stamped output, and the 'latest' one only for a full default run. The plan runs once."""
    df.write.mode("overwrite").json(f"{path}_{stamp}")
    if latest:
        df.sparkSession.read.schema(df.schema).json(f"{path}_{stamp}").write.mode("overwrite").json(f"{path}_latest")


def write_status(spark: SparkSession, status: dict, path: str) -> None:
    """Written beside the target and renamed, so that a reader never sees half a file."""
    write_text(spark, json.dumps(status, ensure_ascii=False, indent=2), path)


def write_sheet(df: DataFrame, path: str, limits: dict[str, int]) -> None:
    """CSV with the named columns cut to their limits; blanks at the ends of texts stay."""
    cut = df.select(*[F.substring(c, 1, limits[c]).alias(c) if c in limits else F.col(c) for c in df.columns])
    cut.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_units(df: DataFrame, path: str, unit: str) -> None:
    """Each unit of work is a partition of its own; writing one again replaces only that one."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(unit).parquet(path)


def write_index(postings: DataFrame, path: str, version: int) -> None:
    """An index as a versioned table; a reader of another version finds none."""
    postings.write.mode("overwrite").parquet(f"{path}/v{version}")


def read_index(spark: SparkSession, path: str, version: int) -> DataFrame | None:
    return spark.read.parquet(f"{path}/v{version}") if exists(spark, f"{path}/v{version}") else None
