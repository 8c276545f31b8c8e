"""Ranks and running counts without a task that sees all rows: range-sorted parts, shifted by what is before them."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import shared_folder


_open: ContextVar[list[str] | None] = ContextVar("cuts", default=None)
_of_process: dict[str, list[str]] = {}


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths if spark.sparkContext._jsc else []:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    paths.clear()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is cut inside is deleted at the end: for runs that return numbers, or rows of which they have cut none."""
    paths: list[str] = []
    token = _open.set(paths)
    try:
        yield
    finally:
        _open.reset(token)
        _delete(spark, paths)


@contextmanager
def once(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files behind: else they stay until the driver happens to collect its garbage. Its results must not be asked for again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)  # None where it isn't set
    spark.conf.set(key, "true")  # heeded from Spark 4.1 on
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet to the folder that the session names: its lineage ends there. It goes with the passing() around it, else with the process."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _of_process:
        _of_process[app] = []
        atexit.register(_delete, spark, _of_process[app])
    kept = _open.get()
    (_of_process[app] if kept is None else kept).append(path)
    with once(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def handed_on(spark: SparkSession, make: Callable[[], DataFrame | None]) -> DataFrame | None:
    """What make returns, cut for the passing() around; what it has cut itself is deleted."""
    around = _open.get()
    with passing(spark):
        made = make()
        if made is None:
            return None
        token = _open.set(around)
        try:
            return cut(made)
        finally:
            _open.reset(token)


def _parted(df: DataFrame, order: list) -> DataFrame:
    return cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def ranked(df: DataFrame, cell: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """df with the rank from 1 of each row in its cell, in an order that has no ties."""
    parts = _parted(df, [*cell, *order])
    counts = parts.groupBy(*cell, "_part").agg(F.count("*").alias("_k"))  # one row for each cell of each part
    before = counts.withColumn("_before", F.sum("_k").over(W.partitionBy(*cell).orderBy("_part")) - F.col("_k")).drop("_k")
    placed = parts.withColumn("_r", F.row_number().over(W.partitionBy("_part", *cell).orderBy(*order)))
    return placed.join(before, [*cell, "_part"]).withColumn(name, (F.col("_before") + F.col("_r")).cast("bigint")).drop("_before", "_r", "_part")


def running_counts(df: DataFrame, value: str, cell: list[str]) -> DataFrame:
    """cell, v, c, upto, n: distinct values that aren't null, their counts, the count up to each, and of all of the cell."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*cell, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    parts = _parted(counts, [*cell, "v"])
    sums = parts.groupBy(*cell, "_part").agg(F.sum("c").alias("_k"))
    by = W.partitionBy(*cell)
    before = sums.withColumn("_before", F.sum("_k").over(by.orderBy("_part")) - F.col("_k")).withColumn("n", F.sum("_k").over(by)).drop("_k")
    upto = parts.withColumn("_u", F.sum("c").over(W.partitionBy("_part", *cell).orderBy("v")))
    return upto.join(before, [*cell, "_part"]).withColumn("upto", F.col("_before") + F.col("_u")).select(*cell, "v", "c", "upto", "n")


def at_rank(rank) -> F.Column:
    """Over running counts, the value at a rank from 0."""
    return F.min(F.when(F.col("upto") > rank, F.col("v")))


def quantiles(df: DataFrame, columns: list[str], q: float) -> dict[str, float]:
    """The q-quantile of each column, linear between neighbouring values."""
    out = {}
    for c in columns:
        at = F.lit(q) * (F.col("n") - 1)
        r = running_counts(df.withColumn("_all", F.lit(1)), c, ["_all"]).agg(at_rank(F.floor(at)).alias("lo"), at_rank(F.least(F.floor(at) + 1, F.col("n") - 1)).alias("hi"), F.max(at - F.floor(at)).alias("part")).first()
        out[c] = None if r["lo"] is None else float(r["lo"]) + (float(r["hi"]) - float(r["lo"])) * r["part"]
    return out
