"""Scans (S1-S7): nested JSON, CSV, JSONL, JSON documents, multiple-choice and entailment sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaesta import schemas
from quaesta.common import exists
from quaesta.functions.text import format_prompt, strip

# Spellings of "no unit", and entailment labels.
NO_UNIT = ["-", "--", "n/a", "N/A", "none", "None", ""]
ENTAILMENT = {"true": "yes", "false": "no", "uncertain": "unknown", "unknown": "unknown", "yes": "yes", "no": "no"}


def flatten_logic(raw: DataFrame) -> DataFrame:
    """One row per question of a nested record; the shortest of the parallel arrays decides.

    A missing explanation array counts as one '' per question; other missing arrays give no row.
    """
    n = F.size("questions")
    expl = F.coalesce("explanation", F.array_repeat(F.lit(""), n))
    k = F.least(n, F.size("answers"), F.size(expl))
    rows = raw.filter(F.col("questions").isNotNull() & F.col("answers").isNotNull()).select("*", expl.alias("__e"), F.posexplode("questions").alias("pos", "question")).filter(F.col("pos") < k)
    premises = F.coalesce("`premises-NL`", F.array().cast("array<string>"))
    return rows.select(
        F.lit("logic").alias("type"), premises.alias("premises_nl"), F.coalesce("`premises-FOL`", F.array().cast("array<string>")).alias("premises_fol"), "question",
        F.get("answers", F.col("pos")).alias("answer"), F.get("__e", F.col("pos")).alias("explanation"), F.get("idx", F.col("pos")).alias("idx"), F.lit("").alias("cot"),
    )


def clean_physics(raw: DataFrame) -> DataFrame:
    """Rows with a blank answer dropped, unit spellings of nothing as '', answer and unit joined."""
    unit = strip(F.coalesce("unit", F.lit("")))
    unit = F.when(unit.isin(NO_UNIT), "").otherwise(unit)
    ans = strip(F.coalesce("answer", F.lit("")))
    return raw.filter(ans != "").select(F.lit("physics").alias("type"), "id", "question", F.when(unit == "", ans).otherwise(F.concat_ws(" ", ans, unit)).alias("answer"), F.coalesce("cot", F.lit("")).alias("cot"))


def read_logic(spark: SparkSession, path: str) -> DataFrame:
    return flatten_logic(spark.read.schema(schemas.LOGIC_RAW).json(path, multiLine=True))


def read_physics(spark: SparkSession, path: str) -> DataFrame:
    return clean_physics(spark.read.schema(schemas.PHYSICS_RAW).csv(path, header=True, multiLine=True, escape='"'))


def all_samples(logic: DataFrame, physics: DataFrame) -> DataFrame:
    """O5, 1.1: both subjects in one table, with the user prompt of each."""
    s = logic.unionByName(physics, allowMissingColumns=True)
    return s.withColumn("user_prompt", format_prompt(F.coalesce("premises_nl", F.array().cast("array<string>")), F.col("question")))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line; blank and unreadable lines are skipped."""
    t = spark.read.text(path).filter(strip(F.col("value")) != "")
    return t.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).filter("r is not null").select("r.*")


def read_document(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The objects of an array field of a JSON document."""
    return spark.read.schema(f"`{field}` array<struct<{_struct(schema)}>>").json(path, multiLine=True).select(F.explode(field).alias("r")).select("r.*")


def _struct(schema: str) -> str:
    import re

    return re.sub(r"(^|, )(`[^`]+`|\w+) ", r"\1\2:", schema)


def multiple_choice(df: DataFrame) -> DataFrame:
    """Question with lettered choices, and the letter of the answer index."""
    letters = F.array(*map(F.lit, "ABCDE"))
    listed = F.array_join(F.transform("choices", lambda c, i: F.concat(F.get(letters, i), F.lit(". "), c)), "\n")
    return df.select(F.concat("question", F.lit("\n"), listed).alias("question"), F.get(letters, F.col("answer")).alias("answer"))


def entailment(df: DataFrame) -> DataFrame:
    """Premises, conclusion and label as yes, no or unknown; rows with any other label are dropped."""
    m = F.create_map(*[F.lit(x) for kv in ENTAILMENT.items() for x in kv])
    return df.withColumn("answer", F.try_element_at(m, F.lower(strip(F.col("label"))))).filter("answer is not null").drop("label")


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that exists, in whatever file system; an error names them all if none does."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))
