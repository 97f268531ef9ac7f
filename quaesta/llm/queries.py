"""Queries of the llm operators over the driver's tables: each is applied to its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaesta.common import join_small, table
from quaesta.llm import encode, languages, lookalike, packing, pairs, refusals, truncation


def _texts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    m = table(spark, d, "manual_error_template").select(F.col("idx").alias("row_id"), F.col("sheet").alias("source"), F.col("raw_snippet").alias("text"))
    f = table(spark, d, "fair_baselines").select(F.col("sample_id").alias("row_id"), F.concat_ws("/", "bid", "strategy").alias("source"), F.col("prediction_raw").alias("text"))
    return {"manual_error_template": m, "fair_baselines": f}


def _scored(spark: SparkSession, d: str) -> DataFrame:
    t = _texts(spark, d)
    weights = truncation.fit(t["manual_error_template"].unionByName(t["fair_baselines"]))
    out = None
    for name, df in t.items():
        s = truncation.score(df, weights).withColumn("src_table", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).filter("truncated").select("src_table", "row_id").distinct()


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    return truncation.truncation_rates(s.withColumn("source", F.concat_ws(":", "src_table", "source")))


def _models(spark: SparkSession, d: str, pairs_: DataFrame) -> pairs.Models:
    """Fitted on whole tables: truncation on the responses, languages on labelled documents and the
    responses (in the language of their question, but for the defective ones), refusals on the solution texts."""
    spoken = pairs_.select(F.col("response").alias("text"), "lang")
    return pairs.Models(truncation.fit(pairs_, "response"), refusals.fit(table(spark, d, "val_samples"), "cot", "explanation"), languages.fit(table(spark, d, "documents"), spoken))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    fair, ext = table(spark, d, "fair_baselines"), table(spark, d, "external_benchmark")
    q = pairs.questions(table(spark, d, "val_samples"))
    f = join_small(
        fair.select("sample_id", "question_id", F.concat_ws("/", "bid", "strategy").alias("source"), F.col("prediction_raw").alias("response"), F.col("prediction_extracted").alias("extracted")), q, {"question_id": "question_id"}
    ).select("sample_id", "source", "response", "extracted", "question", "lang")
    e = ext.select("sample_id", F.col("config").alias("source"), F.col("raw_end").alias("response"), F.lit(None).cast("string").alias("extracted"), "question", F.lit(None).cast("string").alias("lang"))
    models = _models(spark, d, f)
    out = [("fair_baselines", pairs.broken_pairs(f, models)), ("external_benchmark", pairs.broken_pairs(e, models, tail=True))]
    a, b = [df.select(F.lit(n).alias("src_table"), "sample_id", "defect") for n, df in out]
    return a.unionByName(b)


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return p4_found(spark, d).groupBy("src_table", "defect").agg(F.count(F.lit(1)).alias("n_pairs"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose decoded ids differ from their text: no row if the round trip is exact."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = encode.decode(encode.encode(table(spark, d, "documents"))).withColumnRenamed("text", "back")
    return docs.join(back, "doc_id", "left").filter(~F.col("text").eqNullSafe(F.col("back"))).select("doc_id")


def p6_languages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return encode.size_report(encode.encode(docs), docs)


def p7_windows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return packing.pack_documents(docs, table(spark, d, "context_windows"), encode.token_counts(docs))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_windows(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, d, "documents"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_classes(table(spark, d, "documents"))


def p8_text(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent_text(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_rates, p4_found, p4_rates, p6_ids, p6_round_trip, p6_languages, p7_windows, p7_fill, p8_found, p8_classes, p8_text)}
