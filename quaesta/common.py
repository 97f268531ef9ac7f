"""Helpers shared by all operators: session, durable lineage cuts, reading, blocked windows."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def session(app: str = "quaesta", master: str | None = None) -> SparkSession:
    """A session with the settings the engine expects (AQE on, UTC, Arrow on)."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )
    return (b.master(master) if master else b).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one the session names in spark.checkpoint.dir.

    Where that is unset, a temporary folder serves a local master (tests, a laptop); on a cluster it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not (master.startswith("local[") or master == "local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "quaesta-checkpoint")


def durable(df: DataFrame) -> DataFrame:
    """Materialise `df` in the cluster's shared checkpoint folder and cut its lineage."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def previous_in_order(df: DataFrame, key: list[str], order: str, block: Column, value: str, out: str) -> DataFrame:
    """lag(value) over (key order by order) without one task per key.

    `block` must be monotone in `order`; rows are windowed within (key, block), and the first row
    of each block takes the last value of the nearest earlier block from a one-row-per-block table.
    Rows with equal `order` are ordered by `value`.
    """
    df = df.withColumn("__b", block)
    inner = Window.partitionBy(*key, "__b").orderBy(order, value)
    ends = df.groupBy(*key, "__b").agg(F.max_by(value, F.struct(F.col(order), F.col(value))).alias("__last"))
    ends = ends.withColumn("__before", F.lag("__last").over(Window.partitionBy(*key).orderBy("__b"))).drop("__last")
    rows = df.withColumn("__prev", F.lag(value).over(inner))
    on = [rows[k].eqNullSafe(ends[k]) for k in [*key, "__b"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = rows.join(ends, cond, "left")
    return joined.select(*[rows[c] for c in df.columns if c != "__b"], F.coalesce("__prev", "__before").alias(out))


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values, those of texts, arrays and the like by their JSON form."""
    size = {"string": lambda c: F.octet_length(c), "binary": lambda c: F.octet_length(c)}
    plain = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")
    total = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        n = F.lit(8) if kind in plain or kind.startswith("decimal") else size[kind](c) if kind in size else F.octet_length(F.to_json(F.struct(c)))
        total = total + F.coalesce(n, F.lit(0))
    return total


def join_small(big: DataFrame, small: DataFrame, on: dict[str, str], max_rows: int = 200_000, max_bytes: int = 64 << 20) -> DataFrame:
    """Left join of `small` (one row per key) on null-safe equality of big[k] and small[v].

    `small` is written once, counted and measured: up to `max_rows` rows and `max_bytes` bytes it is
    broadcast, beyond that it is joined by shuffle, where adaptive execution splits hot keys. Its key
    columns are dropped.
    """
    small = durable(small)
    size = small.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row_bytes(small)), F.lit(0)).alias("b")).collect()[0]
    few = size["n"] <= max_rows and size["b"] <= max_bytes
    renamed = small.withColumnsRenamed({v: f"__k_{v}" for v in on.values()})
    cond = None
    for k, v in on.items():
        c = big[k].eqNullSafe(renamed[f"__k_{v}"])
        cond = c if cond is None else cond & c
    return big.join(F.broadcast(renamed) if few else renamed, cond, "left").drop(*[f"__k_{v}" for v in on.values()])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text written beside the target and renamed over it, in whatever file system the path names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, tmp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    out = target.getFileSystem(conf).create(tmp, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    rename = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    rename[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(tmp, target, rename)
