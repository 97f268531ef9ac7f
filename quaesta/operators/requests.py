"""Request tables: field fallbacks, subjects, quality rules, best attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaesta.functions import score as S
from quaesta.functions.text import collapse, strip, user_content


def first_filled(*cols: Column) -> Column:
    """The first column that is neither null nor '' (an empty value falls through, as `or` does)."""
    return F.coalesce(*[F.when(strip(c) != "", c) for c in cols], F.lit(""))


def normalise(df: DataFrame) -> DataFrame:
    """query_id, subject, query, premises, options, content of raw requests.

    Missing columns are allowed; fallbacks are id, question and premises_nl. The subject is the type
    code's; if there is none, logic for requests with premises. Null elements of options are dropped.
    """
    text, arr = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    c = lambda n, default: F.col(n) if n in df.columns else default
    none = F.array().cast("array<string>")
    filled = lambda a: F.when(F.size(a) > 0, a)
    q = df.select(
        first_filled(c("query_id", text), c("id", text)).alias("query_id"), S.request_subject(c("type", text)).alias("__s"), strip(first_filled(c("query", text), c("question", text))).alias("query"),
        F.coalesce(filled(c("premises", arr)), filled(c("premises_nl", arr)), none).alias("premises"), F.filter(F.coalesce(c("options", arr), none), lambda o: o.isNotNull()).alias("options"),
    )
    q = q.withColumn("subject", F.when(F.col("__s") != "", F.col("__s")).when(F.size("premises") > 0, "logic").otherwise("")).drop("__s")
    return q.withColumn("content", user_content(F.col("subject"), F.col("query"), F.col("premises")))


def allow(df: DataFrame, key: str, ids: list | None) -> DataFrame:
    """Only the listed ids; all rows if no list is given."""
    return df if ids is None else df.filter(F.col(key).isin(ids))


def rule_counts(df: DataFrame, defects: str = "defects") -> DataFrame:
    """Q3: rows per broken rule (see score.response_defects)."""
    return df.select(F.explode(defects).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n_broken"))


def best_of(df: DataFrame, key: list[str], raw: str, attempt: str) -> DataFrame:
    """The attempt of greatest format score per key, the first on ties."""
    s = df.withColumn("__f", S.format_score(F.coalesce(F.col(raw), F.lit(""))))
    best = F.struct(F.col("__f"), -F.col(attempt))
    return s.groupBy(*key).agg(F.max_by(raw, best).alias("best_raw"), F.max_by(attempt, best).alias("best_attempt"), F.max("__f").alias("format_score"))


def exemplar_leakage(hits: DataFrame, queries: DataFrame, docs: DataFrame, q_id: str, d_id: str, text: str) -> DataFrame:
    """Per query its first hit's score, and whether it is the query itself word for word at 0.95 or more."""
    top = hits.filter("rank = 1").select("query_id", "doc_id", "score")
    q = queries.select(F.col(q_id).cast("string").alias("query_id"), collapse(F.col(text)).alias("__q"))
    d = docs.select(F.col(d_id).cast("string").alias("doc_id"), collapse(F.col(text)).alias("__d"))
    j = top.join(q, "query_id").join(d, "doc_id")
    return j.select("query_id", "doc_id", "score", ((F.round("score", 9) >= 0.95) & (F.col("__q") == F.col("__d"))).alias("verbatim"))
