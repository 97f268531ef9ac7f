"""Evaluation aggregates, voting, retries, windows (A, W, O, J, Q operators). All are DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaesta.common import durable


def pct(num: Column, den: Column, digits: int = 2) -> Column:
    return F.when(den > 0, F.round(100.0 * num / den, digits)).otherwise(0.0)


def accuracy(df: DataFrame, by: list[str], ok: str = "ok", subject: str = "subject") -> DataFrame:
    """A1: n and accuracy overall and by true subject; 0.0 where the denominator is 0. Null verdicts are wrong."""
    n = lambda s: F.count_if(F.col(subject) == s)
    k = lambda s: F.count_if((F.col(subject) == s) & F.col(ok))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_total"), n("physics").alias("n_physics"), n("logic").alias("n_logic"), F.count_if(F.col(ok)).alias("n_correct"),
        pct(F.count_if(F.col(ok)), F.count(F.lit(1))).alias("accuracy_overall"), pct(k("physics"), n("physics")).alias("accuracy_physics"), pct(k("logic"), n("logic")).alias("accuracy_logic"),
    )


def dense_counts(df: DataFrame, column: str, categories: list, name: str = "n") -> DataFrame:
    """A3, A5: a count for every category, zeros kept, and its share of all rows in percent (one digit)."""
    dim = df.sparkSession.createDataFrame([(c,) for c in categories], f"{column} {'string' if isinstance(categories[0], str) else 'int'}")
    c = dim.join(df.groupBy(column).agg(F.count(F.lit(1)).alias("__n")), column, "left").withColumn(name, F.coalesce("__n", F.lit(0))).drop("__n")
    return c.withColumn("pct", pct(F.col(name), F.sum(name).over(Window.partitionBy()), 1))


def retry_histogram(df: DataFrame, retry: str = "retry_count") -> DataFrame:
    """A4: rows by min(retry, 2), keys 0, 1, 2."""
    return dense_counts(df.select(F.least(F.col(retry), F.lit(2)).cast("int").alias("retry")), "retry", [0, 1, 2])


def vote(df: DataFrame, key: list[str], answer: str, pos: str, raw: str | None = None) -> DataFrame:
    """Most frequent answer per key (first seen on ties), its share, and the first raw text that has it.

    Counts per (key, answer) are formed first, so a hot key is reduced before its winner is chosen.
    """
    c = df.groupBy(*key, answer).agg(F.count(F.lit(1)).alias("__n"), F.min(pos).alias("__p"), *([F.min_by(raw, pos).alias("__r")] if raw else []))
    best = F.struct(F.col("__n"), -F.col("__p"))
    return c.groupBy(*key).agg(
        F.max_by(answer, best).alias("winner"), F.max("__n").alias("n_votes"), F.round(F.max("__n") / F.sum("__n"), 6).alias("share"), *([F.max_by("__r", best).alias("winner_raw")] if raw else [])
    )


def resolve_retries(df: DataFrame, key: list[str], attempt: str, ok: str) -> DataFrame:
    """Per key the first correct attempt, else the last; whether it is correct, and attempt 0's verdict beside it."""
    first = F.min(F.when(F.col(ok), F.col(attempt)))
    return df.groupBy(*key).agg(
        F.coalesce(first, F.max(attempt)).alias("retry_count"), first.isNotNull().alias("resolved"), F.coalesce(F.max_by(ok, -F.col(attempt)), F.lit(False)).alias("first_ok"), F.count(F.lit(1)).alias("n_attempts")
    )


def running_accuracy(df: DataFrame, key: list[str], order: list[str], ok: str) -> DataFrame:
    """Accuracy so far per key in the given order, rounded to six digits; null verdicts count as rows but not in the mean.

    Rows are dealt by ranges of (key, order), so a key that holds a third of all rows lies in many
    tasks; each range starts from the sums of the ranges before it, of which there is one row each.
    """
    v = F.col(ok).cast("double")
    d = durable(df.repartitionByRange(*key, *order).withColumn("__part", F.spark_partition_id()))
    sums = d.groupBy(*key, "__part").agg(F.count(F.lit(1)).alias("__n"), F.sum(v).alias("__s"), F.count(v).alias("__m"))
    before = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select(*[F.col(k).alias(f"__k_{k}") for k in key], F.col("__part").alias("__p"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("__n", "__s", "__m")])
    cond = F.col("__part") == F.col("__p")
    for k in key:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    w = Window.partitionBy(*key, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    j = d.join(start, cond, "left")
    j = j.withColumn("n_so_far", F.count(F.lit(1)).over(w) + F.col("__n0"))
    j = j.withColumn("accuracy_so_far", F.round((F.coalesce(F.sum(v).over(w), F.lit(0.0)) + F.col("__s0")) / F.nullif(F.count(v).over(w) + F.col("__m0"), F.lit(0)), 6))
    return j.select(*df.columns, "n_so_far", "accuracy_so_far")


def stage_delta(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Change against the stage before, null for the first."""
    return df.withColumn("delta", F.round(F.col(value) - F.lag(value).over(Window.partitionBy(*key).orderBy(order)), 4))


def rank_groups(df: DataFrame, value: str, tie: str) -> DataFrame:
    """Rank of groups by value, then by name; over aggregated rows only."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy().orderBy(F.desc(value), tie)))


def best_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """Group of the greatest value, the least group on ties."""
    return df.agg(F.min_by(group, F.struct(-F.col(value), F.col(group))).alias("best"), F.max(value).alias("best_value"))


def top_k(df: DataFrame, key: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k best rows per key, in a total order."""
    w = Window.partitionBy(*key).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def collect_ordered(df: DataFrame, key: list[str], pos: str, value: str, name: str) -> DataFrame:
    """Values of each key as an array in the order of `pos`. Only for keys of bounded size."""
    return df.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, value))), lambda x: x[value]).alias(name))


def transitions(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Both right, both wrong, regressions, improvements and net of two verdicts on the same rows."""
    x, y = F.coalesce(F.col(a), F.lit(False)), F.coalesce(F.col(b), F.lit(False))
    n = lambda c: F.count_if(c)
    return df.groupBy(*by).agg(
        n(x & y).alias("both_right"), n(~x & ~y).alias("both_wrong"), n(x & ~y).alias("regressions"), n(~x & y).alias("improvements"), (n(~x & y) - n(x & ~y)).alias("net")
    )


def last_write(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """One row per key, the last by `order`."""
    cols = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*cols), order).alias("__r")).select(*key, "__r.*")


def pending(todo: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `todo` whose key is not done yet."""
    return todo.join(done.select(*key).distinct(), key, "left_anti")


def compare_aggregates(new: DataFrame, old: DataFrame, key: str, value: str, limit: float = 1.0) -> DataFrame:
    """Both values per key, their difference, and whether it reaches the limit."""
    j = new.select(key, F.col(value).alias("new_value")).join(old.select(key, F.col(value).alias("old_value")), key, "left")
    return j.withColumn("diff", F.round(F.abs(F.col("new_value") - F.col("old_value")), 4)).withColumn("flagged", F.coalesce(F.col("diff") >= limit, F.lit(False)))


def enrich(df: DataFrame, dim: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of a dictionary table joined on, '' where it has no entry."""
    d = dim.dropDuplicates([key]).select(key, *columns)
    return df.join(d, key, "left").select(*df.columns, *[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def cross_settings(settings_a: DataFrame, settings_b: DataFrame) -> DataFrame:
    """All combinations of two small tables of settings (at most 1,000 rows each, checked)."""
    for s in (settings_a, settings_b):
        if s.limit(1001).count() > 1000:
            raise ValueError("cross_settings takes tables of settings, at most 1000 rows each")
    rows = settings_b.collect()
    return settings_a.withColumn("__b", F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.asDict().items()]) for r in rows]))).select(*settings_a.columns, "__b.*")


def first_crossover(df: DataFrame, step: str, a: str, b: str, by: list[str]) -> DataFrame:
    """First step of each series at which b reaches a."""
    return df.groupBy(*by).agg(F.min(F.when(F.col(b) >= F.col(a), F.col(step))).alias("crossover_step"))


def hash_split(df: DataFrame, key: str, parts: int = 10, held: int = 0) -> DataFrame:
    """Deterministic split by key: column `split` is val for one part in `parts`, train for the others."""
    h = F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(parts))
    return df.withColumn("split", F.when(h == held, "val").otherwise("train"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Q2, Q3: number of rows breaking each rule, in one pass: rule, n_rows, n_broken."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"__{k}") for k, c in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col("n").alias("n_rows"), F.col(f"__{k}").alias("n_broken")) for k in rules])).alias("r")).select("r.*")


def latency(df: DataFrame, seconds: str, by: list[str], slow: float = 60.0) -> DataFrame:
    """Least, mean and greatest latency, rows over the limit, and rows per second."""
    s = F.col(seconds)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min(s), 4).alias("min_s"), F.round(F.avg(s), 4).alias("mean_s"), F.round(F.max(s), 4).alias("max_s"), F.count_if(s > slow).alias("n_slow"),
        F.round(F.when(F.sum(s) > 0, F.count(F.lit(1)) / F.sum(s)), 6).alias("per_second"),
    )


def cost(df: DataFrame, minutes: str, rate: float, by: list[str]) -> DataFrame:
    """Hours and cost at an hourly rate."""
    return df.groupBy(*by).agg(F.round(F.sum(minutes) / 60, 4).alias("hours"), F.round(F.sum(minutes) / 60 * rate, 2).alias("cost"))


def pick_first(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows in an explicit order."""
    return df.orderBy(*order).limit(n)


def wrong_only(df: DataFrame, group: str, ok: str) -> DataFrame:
    """The wrong rows of the group of greatest accuracy (the least group on ties); null verdicts are wrong."""
    acc = df.groupBy(group).agg(F.avg(F.coalesce(F.col(ok), F.lit(False)).cast("double")).alias("__acc"))
    best = best_group(acc, group, "__acc").select(F.col("best").alias(group))
    return df.join(F.broadcast(best), group, "left_semi").filter(~F.coalesce(F.col(ok), F.lit(False)))  # best is one row


def run_summary(df: DataFrame, by: list[str], ok: str, verified: str, well_formed: str, retries: str, confidence: str, seconds: str, explanation: str) -> DataFrame:
    """Per run the rates (four digits), mean retries (three), confidence (four) and time (two), and the
    share of explanations of 20 characters or more. Null flags count as not so; other nulls are left out of means."""
    rate = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 4)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), rate(F.col(ok)).alias("accuracy"), rate(F.col(verified)).alias("verified_rate"), rate(F.col(well_formed)).alias("format_ok_rate"),
        F.round(F.avg(retries), 3).alias("avg_retries"), F.round(F.avg(confidence), 4).alias("avg_confidence"), F.round(F.sum(seconds) / 60, 2).alias("total_min"), F.round(F.avg(seconds), 2).alias("avg_seconds"),
        rate(F.length(F.trim(explanation)) >= 20).alias("explained_rate"),
    )
