"""Queries of the general data operators (log lines, quantities, drifting schemas), over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaesta.common import table
from quaesta.operators import drift, logs, quantities


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return logs.log_entries(table(spark, d, "run_logs"))


def p2_lines(spark: SparkSession, d: str) -> DataFrame:
    return logs.log_lines(table(spark, d, "run_logs"))


def p2_messages(spark: SparkSession, d: str) -> DataFrame:
    return logs.log_entries(table(spark, d, "run_logs"), message=True)


def p2_levels(spark: SparkSession, d: str) -> DataFrame:
    return logs.level_counts(p2_found(spark, d))


def _quantities(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    p = table(spark, d, "physics_raw").filter("id is not null")
    a = p.select(F.lit("physics_raw").alias("src_table"), F.col("id").alias("row_id"), F.lit("answer").alias("field"), F.col("answer").alias("value"), "unit", "question", none.alias("other_value"))
    m = table(spark, d, "manual_error_template").filter("idx is not null")
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value"), F.col(o).alias("other")) for c, o in (("prediction", "ground_truth"), ("ground_truth", "prediction"))]))
    b = m.select(F.lit("manual_error_template").alias("src_table"), F.col("idx").cast("string").alias("row_id"), "question", both.alias("x")).select(
        "src_table", "row_id", "x.field", "x.value", none.alias("unit"), "question", F.col("x.other").alias("other_value")
    )
    return quantities.to_si(a.unionByName(b))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return quantities.changed(_quantities(spark, d))


def p3_values(spark: SparkSession, d: str) -> DataFrame:
    return _quantities(spark, d)


def p3_units(spark: SparkSession, d: str) -> DataFrame:
    return quantities.unit_counts(_quantities(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "ablation_records")).select("file_name", "change", "field", "new_field")


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified_records(table(spark, d, "ablation_records"), fieldless=True)


def p5_changes(spark: SparkSession, d: str) -> DataFrame:
    return drift.change_counts(drift.schema_changes(table(spark, d, "ablation_records")))


QUERIES = {f.__name__: f for f in (p2_found, p2_lines, p2_messages, p2_levels, p3_found, p3_values, p3_units, p5_found, p5_records, p5_changes)}
SQL: dict[str, str] = {}
