"""Paired statistics as Columns over counts: McNemar, Wilson, kappa, spread, bootstrap."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959964
# Coefficients of the rational approximation 7.1.26 of erfc in Abramowitz and Stegun.
_ERFC = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429, 0.3275911)


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, absolute error below 1.5e-7."""
    a1, a2, a3, a4, a5, p = _ERFC
    t = 1.0 / (1.0 + p * x)
    return t * (a1 + t * (a2 + t * (a3 + t * (a4 + t * a5)))) * F.exp(-x * x)


def chi2_p(chi2: Column) -> Column:
    """p-value of chi-square with one degree of freedom."""
    return erfc(F.sqrt(chi2 / 2))


def mcnemar(b: Column, c: Column) -> tuple[Column, Column]:
    """Continuity-corrected chi-square and p; 0 and 1 without discordant pairs (b = c > 0 gives 1/(b+c))."""
    n = b + c
    chi = F.when(n == 0, 0.0).otherwise(F.pow(F.abs(b - c) - 1.0, 2) / n)
    return chi, F.when(n == 0, 1.0).otherwise(chi2_p(chi))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """95 % interval in percent, within 0..100; 0, 0 for n = 0."""
    p, z = k / n, Z95
    d = 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z / d * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, F.greatest(F.lit(0.0), 100 * (mid - half))).otherwise(0.0), F.when(n > 0, F.least(F.lit(100.0), 100 * (mid + half))).otherwise(0.0)


def significance(p: Column) -> Column:
    """Label of a p-value."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def kappa(df: DataFrame, a: str, b: str, labels: list[str]) -> DataFrame:
    """Rows with both labels valid, agreement in percent, Cohen's kappa (1 if chance agreement is total).

    One pass: the label counts are conditional sums, so nothing is shuffled but one row per task.
    """
    d = df.filter(F.col(a).isin(labels) & F.col(b).isin(labels))
    n = F.count(F.lit(1))
    pe = sum((F.count_if(F.col(a) == x) * F.count_if(F.col(b) == x) for x in labels), F.lit(0)) / (n * n)
    s = d.agg(n.alias("n"), (F.count_if(F.col(a) == F.col(b)) / n).alias("po"), pe.alias("pe"))
    k = F.when(F.col("pe") >= 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return s.select("n", F.round(100 * F.col("po"), 2).alias("agreement"), F.round(k, 4).alias("kappa"))


def spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """A10: mean and population deviation, two digits."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 2).alias("mean"), F.round(F.stddev_pop(value), 2).alias("std"))


def percentiles(df: DataFrame, value: str, by: list[str], ps: tuple = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Exact percentiles with linear interpolation (0.0 when empty) from a table of distinct values.

    Values are counted first; what is gathered per group is (value, count), not the rows.
    """
    c = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    return c.groupBy(*by).agg(*[F.round(F.coalesce(F.percentile(value, F.lit(p), F.col("__n")), F.lit(0.0)), 4).alias(f"p{round(p * 100)}") for p in ps])


def resampled_interval(n: int, k: int, resamples: int = 1000) -> tuple[float, float]:
    """Percentiles 2.5 and 97.5 of the share of successes over resamples of n rows with k successes.

    Successes are exact quantiles of the binomial distribution at evenly spaced numbers. Its
    probabilities are formed within 12 deviations and 60 rows of the mean; outside is under 1e-20.
    """
    if k in (0, n):
        return k / n, k / n
    p = k / n
    reach = 12 * math.sqrt(n * p * (1 - p)) + 60
    i = np.arange(max(0, math.floor(k - reach)), min(n, math.ceil(k + reach)) + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log((n - i[:-1]) / (i[:-1] + 1)) + math.log(p / (1 - p)))])
    cdf = np.cumsum(np.exp(logs - logs.max()))
    at = np.searchsorted(cdf / cdf[-1], (np.arange(resamples) + 0.5) / resamples)
    lo, hi = np.percentile(i[at] / n, [2.5, 97.5])
    return float(lo), float(hi)


def bootstrap(df: DataFrame, by: list[str], ok: str, resamples: int = 1000) -> DataFrame:
    """95 % percentile interval of accuracy by a deterministic bootstrap.

    A resample of n zero-one rows has a binomial number of successes, so only (n, k) is needed: see
    `resampled_interval`. Exact counts are formed in one aggregation, whatever the size of the data.
    """

    @F.pandas_udf("lo double, hi double")
    def interval(n: pd.Series, k: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([resampled_interval(int(a), int(b), resamples) for a, b in zip(n, k)], columns=["lo", "hi"])

    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(ok)).alias("k"))
    q = g.withColumn("__i", interval("n", "k"))
    return q.select(*by, "n", F.round(100 * F.col("k") / F.col("n"), 2).alias("accuracy"), F.round(100 * F.col("__i.lo"), 2).alias("ci_low"), F.round(100 * F.col("__i.hi"), 2).alias("ci_high"))


def exact_p(chi2: float) -> float:
    """p-value of one chi-square, by math.erfc."""
    return math.erfc(math.sqrt(chi2 / 2))


def report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """T4: precision, recall, F1 and support per class, with the overall accuracy beside each."""
    c = df.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))
    both = c.select(F.col(truth).alias("label"), F.col("n").alias("s"), F.lit(0).alias("p"), F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0).alias("tp")).unionByName(
        c.select(F.col(pred).alias("label"), F.lit(0).alias("s"), F.col("n").alias("p"), F.lit(0).alias("tp"))
    )
    g = both.groupBy("label").agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("tp").alias("hits"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    pr, rc = div(F.col("hits"), F.col("predicted")), div(F.col("hits"), F.col("support"))
    every = Window.partitionBy()  # one row per class
    g = g.withColumn("accuracy", F.round(div(F.sum("hits").over(every), F.sum("support").over(every)), 4))
    return g.select("label", "support", "accuracy", F.round(pr, 4).alias("precision"), F.round(rc, 4).alias("recall"), F.round(div(2 * pr * rc, pr + rc), 4).alias("f1"))
