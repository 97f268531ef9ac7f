"""TF-IDF and vector retrieval (T5-T7, T14, J10): a query set against all rows, in blocks.

The vocabulary has at most `max_features` terms, so it is small at any corpus size. Queries are taken
in blocks of at most `block` rows; each block travels to the documents, which are scored where they
are read, and only the k best of each task are shuffled. No postings of the corpus are joined, so
frequent terms make no hot keys and no pairs are emitted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaesta.functions.text import bind

HITS = "query_id string, doc_id string, score double"


def terms(c: Column) -> Column:
    """Words of two characters or more, lower case, and their neighbouring pairs."""
    w = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    return bind(w, lambda w: F.concat(w, F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda b, i: F.concat_ws(" ", F.get(w, i), b))))


def vocabulary(docs: DataFrame, text: str, max_features: int = 8000, min_df: int = 2) -> tuple[dict[str, tuple[int, float]], int]:
    """term -> (number, idf) of the most frequent terms (ties by term) found in `min_df` documents or more; and n."""
    t = docs.select(terms(F.col(text)).alias("t"))
    all_, once = t.select(F.explode("t").alias("term"), F.lit(0).alias("d")), t.select(F.explode(F.array_distinct("t")).alias("term"), F.lit(1).alias("d"))
    c = all_.unionByName(once).groupBy("term").agg(F.sum(1 - F.col("d")).alias("cf"), F.sum("d").alias("df"))
    top = c.filter(F.col("df") >= min_df).orderBy(F.desc("cf"), "term").limit(max_features).collect()
    n = docs.count()
    return {r["term"]: (i, float(np.log((1 + n) / (1 + r["df"])) + 1)) for i, r in enumerate(top)}, n


def vector(text: str, vocab: dict[str, tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and L2-normalised weights (1 + ln tf) * idf."""
    w = re.findall(r"[^\W]{2,}", text.lower())
    c = Counter(x for x in [*w, *[f"{a} {b}" for a, b in zip(w, w[1:])]] if x in vocab)
    if not c:
        return np.zeros(0, np.int64), np.zeros(0)
    ids = np.array([vocab[t][0] for t in c], np.int64)
    x = np.array([(1 + np.log(n)) * vocab[t][1] for t, n in c.items()])
    return ids, x / np.sqrt((x * x).sum())


def _best(scores: np.ndarray, ids: list, k: int, positive: bool) -> list[tuple]:
    """k best (score, id) of each column, ties by id."""
    out = []
    for j in range(scores.shape[1]):
        s = np.round(scores[:, j], 9)
        idx = np.flatnonzero(s > 0) if positive else np.arange(len(s))
        if len(idx) > k:
            cut = np.partition(s[idx], -k)[-k]
            idx = idx[s[idx] >= cut]
        best = sorted(((-s[i], ids[i]) for i in idx))[:k]
        out += [(j, d, -v) for v, d in best]
    return out


def _merge(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _blocks(queries: DataFrame, cols: list[str], block: int) -> Iterator[list]:
    """Queries as lists of at most `block` rows, read one block at a time."""
    rows: list = []
    for r in queries.select(*cols).toLocalIterator():
        rows.append(r)
        if len(rows) == block:
            yield rows
            rows = []
    if rows:
        yield rows


def _scored(queries: DataFrame, q_id: str, q_text: str, docs: DataFrame, d_id: str, d_text: str, block: int, max_features: int, min_df: int, use, schema: str) -> list[DataFrame]:
    """Per block of queries the rows that `use` makes of (scores of documents and queries, document ids, query
    names, state); the state is one dictionary per task, and `use` is called with scores None at the end of the task."""
    vocab, _ = vocabulary(docs, d_text, max_features, min_df)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocab)
    columns = [c.split()[0] for c in schema.split(", ")]
    parts = []
    for rows in _blocks(queries.filter(F.col(q_id).isNotNull()), [q_id, q_text], block):
        names, postings = [], {}
        for j, r in enumerate(rows):
            names.append(str(r[0]))
            for t, x in zip(*vector(r[1] or "", vocab)):
                postings.setdefault(int(t), []).append((j, x))
        inverted = spark.sparkContext.broadcast({t: (np.array([p[0] for p in v]), np.array([p[1] for p in v])) for t, v in postings.items()})

        def run(batches: Iterator[pd.DataFrame], names=names, inverted=inverted) -> Iterator[pd.DataFrame]:
            state: dict = {}
            for pdf in batches:
                ids = [str(x) for x in pdf["i"]]
                for a in range(0, len(ids), 500):
                    s = np.zeros((min(500, len(ids) - a), len(names)))
                    for i, t in enumerate(pdf["t"].iloc[a : a + 500]):
                        for term, x in zip(*vector(t or "", shared.value)):
                            hit = inverted.value.get(int(term))
                            if hit is not None:
                                s[i, hit[0]] += hit[1] * x
                    yield pd.DataFrame(use(s, ids[a : a + 500], names, state), columns=columns)
            yield pd.DataFrame(use(None, [], names, state), columns=columns)

        parts.append(docs.filter(F.col(d_id).isNotNull()).select(F.col(d_id).alias("i"), F.col(d_text).alias("t")).mapInPandas(run, schema))
    return parts


def search(
    queries: DataFrame, q_id: str, q_text: str, docs: DataFrame, d_id: str, d_text: str, k: int = 3, block: int = 5000, max_features: int = 8000, min_df: int = 2, positive: bool = True, mask: tuple[str, str] | None = None
) -> DataFrame:
    """query_id, doc_id, score, rank: the k documents of greatest cosine per query (ties: least id, as text).

    Results stop at score 0 unless `positive` is False. Null or empty texts match nothing. An empty
    query or document table gives an empty result. mask names a column of the queries and one of the
    documents that must agree; a query whose value no document has is searched without it.
    """
    if mask:
        q, d = mask
        there = [r[0] for r in docs.select(d).distinct().limit(1001).collect() if r[0] is not None]
        if len(there) > 1000:
            raise ValueError("a mask column has at most 1000 values")
        plain = {"k": k, "block": block, "max_features": max_features, "min_df": min_df, "positive": positive}
        parts = [search(queries.filter(F.col(q) == v), q_id, q_text, docs.filter(F.col(d) == v), d_id, d_text, **plain) for v in sorted(there)]
        rest = queries.filter(F.col(q).isNull() | ~F.col(q).isin(there)) if there else queries
        return reduce(DataFrame.unionByName, parts + [search(rest, q_id, q_text, docs, d_id, d_text, **plain)])

    def best(s, ids, names, state):
        return [] if s is None else [(names[j], d, v) for j, d, v in _best(s, ids, k, positive)]

    parts = _scored(queries, q_id, q_text, docs, d_id, d_text, block, max_features, min_df, best, HITS)
    return _merge(reduce(DataFrame.unionByName, parts), k) if parts else _merge(docs.sparkSession.createDataFrame([], HITS), k)


def closest(queries: DataFrame, q_id: str, q_text: str, docs: DataFrame, d_id: str, d_text: str, close: float = 0.5, block: int = 5000, max_features: int = 8000, min_df: int = 2) -> DataFrame:
    """query_id, best_score, n_close: the greatest cosine of each query over all documents (0.0 without
    overlap), and the number of documents at `close` or more. Maxima and counts are kept in the tasks,
    so one row per query and task moves, and no pairs."""

    def keep(s, ids, names, state):
        if s is None:
            return [(n, float(m), int(c)) for n, m, c in zip(names, state["max"], state["n"])] if state else []
        s = np.round(s, 9)
        state["max"] = np.maximum(state.get("max", 0.0), s.max(0)) if len(s) else state.get("max", np.zeros(len(names)))
        state["n"] = state.get("n", 0) + (s >= close).sum(0)
        return []

    schema = "query_id string, best_score double, n_close bigint"
    parts = _scored(queries, q_id, q_text, docs, d_id, d_text, block, max_features, min_df, keep, schema)
    all_ = reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)
    return all_.groupBy("query_id").agg(F.max("best_score").alias("best_score"), F.sum("n_close").alias("n_close"))


def search_vectors(queries: DataFrame, docs: DataFrame, key: str, vec: str, k: int = 5, block: int = 5000) -> DataFrame:
    """T6 on dense vectors: the k nearest rows by cosine per query, itself excluded.

    Null vectors and vectors of another length than the query's match nothing; a zero vector has cosine 0.
    """
    spark = docs.sparkSession
    parts = []
    for rows in _blocks(queries.filter(F.col(key).isNotNull() & F.col(vec).isNotNull() & (F.size(vec) > 0)), [key, vec], block):
        dim = len(rows[0][1])
        names = [str(r[0]) for r in rows]
        m = np.array([[float(x or 0) for x in r[1]] if len(r[1]) == dim else [0.0] * dim for r in rows])
        unit = m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-30)
        shared = spark.sparkContext.broadcast(unit)

        def run(batches: Iterator[pd.DataFrame], names=names, shared=shared, dim=dim) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                ids = [str(x) for x in pdf["i"]]
                x = np.array([np.asarray(v, float) for v in pdf["v"]]).reshape(len(ids), dim)
                x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-30)
                for a in range(0, len(ids), 2000):
                    s = x[a : a + 2000] @ shared.value.T
                    got = _best(s, ids[a : a + 2000], k + 1, False)
                    yield pd.DataFrame([(names[j], d, v) for j, d, v in got if names[j] != d], columns=["query_id", "doc_id", "score"])

        parts.append(docs.filter(F.col(key).isNotNull() & (F.size(vec) == dim)).select(F.col(key).alias("i"), F.col(vec).alias("v")).mapInPandas(run, HITS))
    return _merge(reduce(DataFrame.unionByName, parts), k) if parts else _merge(spark.createDataFrame([], HITS), k)
