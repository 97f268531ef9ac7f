"""Trained subject router (T2): TF-IDF features and logistic regression from pyspark.ml."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, StringIndexer
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaesta.operators.retrieve import vector, vocabulary


class Router:
    """Vocabulary of at most `max_features` terms (broadcast: its size is bounded) and a fitted model."""

    def __init__(self, vocab: dict, model: PipelineModel, labels: list[str]) -> None:
        self.vocab, self.model, self.labels = vocab, model, labels

    def features(self, df: DataFrame, text: str) -> DataFrame:
        vocab, n = self.vocab, max(1, len(self.vocab))
        shared = df.sparkSession.sparkContext.broadcast(vocab)

        @F.udf(VectorUDT())
        def vec(t):
            ids, x = vector(t or "", shared.value)
            order = ids.argsort()
            return SparseVector(n, ids[order], x[order])

        return df.withColumn("features", vec(F.col(text)))

    def predict(self, df: DataFrame, text: str) -> DataFrame:
        """Adds model_label and model_conf; a text without known terms gets the prior. Scored in Arrow batches."""
        lr = self.model.stages[1]
        w, b = lr.coefficientMatrix.toArray(), lr.interceptVector.toArray()
        if len(w) == 1:  # two classes: the second one's margin
            w, b = np.vstack([np.zeros_like(w[0]), w[0]]), np.array([0.0, b[0]])
        shared = df.sparkSession.sparkContext.broadcast((self.vocab, np.ascontiguousarray(w.T), b, self.labels))

        @F.pandas_udf("label string, conf double")
        def route(t: pd.Series) -> pd.DataFrame:
            vocab, weights, bias, labels = shared.value
            out = []
            for x in t:
                ids, v = vector(x or "", vocab)
                z = bias + (v @ weights[ids] if len(ids) else 0.0)
                p = np.exp(z - z.max())
                out.append((labels[int(p.argmax())], float(p.max() / p.sum())))
            return pd.DataFrame(out, columns=["label", "conf"])

        d = df.withColumn("__r", route(F.col(text)))
        return d.withColumn("model_label", F.col("__r.label")).withColumn("model_conf", F.round("__r.conf", 6)).drop("__r")

    def save(self, path: str) -> None:
        """The model's weights and the vocabulary as tables, in any file system Spark can write to."""
        spark = SparkSession.getActiveSession()
        self.model.write().overwrite().save(f"{path}/model")
        spark.createDataFrame([(t, i, x) for t, (i, x) in self.vocab.items()], "term string, number int, idf double").coalesce(1).write.mode("overwrite").parquet(f"{path}/vocabulary")
        spark.createDataFrame([(i, x) for i, x in enumerate(self.labels)], "number int, label string").coalesce(1).write.mode("overwrite").parquet(f"{path}/labels")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Router:
        vocab = {r["term"]: (r["number"], r["idf"]) for r in spark.read.parquet(f"{path}/vocabulary").collect()}
        labels = [r["label"] for r in spark.read.parquet(f"{path}/labels").orderBy("number").collect()]
        return Router(vocab, PipelineModel.load(f"{path}/model"), labels)


def fit_router(df: DataFrame, text: str, label: str, max_features: int = 5000, c: float = 1.0) -> Router:
    """Balanced class weights; regParam is 1/(C n), which makes the objective that of C-regularised regression."""
    vocab, n = vocabulary(df, text, max_features)
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    labels = sorted(counts)
    weight = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, n / (len(counts) * v))])
    r = Router(vocab, None, labels)
    train = r.features(df, text).withColumn("__w", weight[F.col(label)])
    stages = [StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc"), LogisticRegression(featuresCol="features", labelCol="__y", weightCol="__w", regParam=1.0 / (c * n), standardization=False, maxIter=200)]
    model = Pipeline(stages=stages).fit(train)
    r.model = PipelineModel([SQLTransformer(statement="SELECT * FROM __THIS__"), model.stages[1]])
    return r
