"""Train/evaluation contamination and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaesta.functions.text import bind, collapse


def word_shingles(c: Column, n: int = 3) -> Column:
    """Distinct runs of n words, joined by a blank; none if the text has fewer words."""
    def of(w: Column) -> Column:
        k = F.size(w) - n + 1
        return F.when(k > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " ")))).otherwise(F.array().cast("array<string>"))

    return bind(F.regexp_extract_all(collapse(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), of)


def char_shingles(c: Column, n: int = 8) -> Column:
    """Distinct runs of n characters of the collapsed text; none if it is shorter."""
    def of(t: Column) -> Column:
        k = F.size(t) - n + 1
        return F.when(k > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), "")))).otherwise(F.array().cast("array<string>"))

    # characters as an array: a substring would be counted from the beginning each time
    return bind(F.split(collapse(c), "(?!^)(?!$)"), of)


def jaccard(a: Column, b: Column) -> Column:
    """T10 of two sets (no repeated elements): 0.0 if both are empty."""
    u = F.size(a) + F.size(b)
    return bind(F.size(F.array_intersect(a, b)), lambda k: F.when(u > 0, k / (u - k)).otherwise(0.0))


def exact_duplicates(left: DataFrame, right: DataFrame, text: str, answer: str) -> DataFrame:
    """Rows of `left` whose collapsed text occurs in `right`, with n_copies there and
    whether any copy has the same answer. Copies are counted before the join, so a text that fills a
    third of `right` joins as one row. Null texts have no copy; null answers equal none."""
    r = right.filter(F.col(text).isNotNull()).groupBy(F.md5(collapse(F.col(text))).alias("__h"), F.coalesce(F.col(answer), F.lit("\u0000")).alias("__a")).agg(F.count(F.lit(1)).alias("__n"))
    per_text = r.groupBy("__h").agg(F.sum("__n").alias("n_copies"))
    l = left.filter(F.col(text).isNotNull()).withColumn("__h", F.md5(collapse(F.col(text))))
    same = l.join(r.select("__h", F.col("__a").alias(answer), F.lit(True).alias("same_answer")), ["__h", answer], "left").withColumn("same_answer", F.coalesce("same_answer", F.lit(False)))
    return same.join(per_text, "__h").select(*left.columns, "n_copies", "same_answer")


def pair_class(cosine: Column, char: Column, same_answer: Column) -> dict[str, Column]:
    """Flags of a query and its nearest row."""
    hi, near = F.round(cosine, 9) >= 0.95, char >= 0.95
    return {"hi": hi, "true_near_identical": near, "template_collision": hi & ~near, "real_leakage": near & same_answer, "nd_same_answer": hi & same_answer}


def contamination(hits: DataFrame, queries: DataFrame, docs: DataFrame, q_id: str, d_id: str, text: str, answer: str) -> DataFrame:
    """Per query the best candidate by word-3 Jaccard among its cosine hits (the first on ties), with
    char-8 Jaccard of the nearest, same_answer and the flags of `pair_class`. Texts are shingled only for
    candidate pairs, at most k per query."""
    q = queries.select(F.col(q_id).cast("string").alias("query_id"), F.col(text).alias("__q"), F.col(answer).alias("__qa"))
    d = docs.select(F.col(d_id).cast("string").alias("doc_id"), F.col(text).alias("__d"), F.col(answer).alias("__da"))
    p = hits.join(q, "query_id").join(d, "doc_id").withColumn("__w", jaccard(word_shingles(F.col("__q")), word_shingles(F.col("__d"))))
    p = p.withColumn("__c", F.when(F.col("rank") == 1, jaccard(char_shingles(F.col("__q")), char_shingles(F.col("__d")))))
    best = F.struct(F.col("__w"), -F.col("rank"))
    g = p.groupBy("query_id").agg(
        F.max_by("doc_id", -F.col("rank")).alias("nearest"), F.max("score").alias("cosine"), F.max_by("doc_id", best).alias("jaccard_doc"), F.round(F.max("__w"), 6).alias("word_jaccard"),
        F.round(F.max("__c"), 6).alias("char_jaccard"), F.coalesce(F.max_by(F.col("__qa") == F.col("__da"), -F.col("rank")), F.lit(False)).alias("same_answer"),
    )
    return g.withColumns(pair_class(F.col("cosine"), F.col("char_jaccard"), F.col("same_answer")))
