"""Incremental ingestion: files of references are taken in as they come, and counted as they are taken in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.leases import Folder

_REFERENCES = "citing bigint, cited bigint, year int"
_COUNTS = "work_id bigint, year int, cite_counts bigint"


def _new_files(spark: SparkSession, source: str, files: int) -> DataFrame:
    return spark.readStream.schema(_REFERENCES).option("maxFilesPerTrigger", files).parquet(source)


def ingest_references(spark: SparkSession, source: str, target: str, state: str) -> None:
    """Append what is new below source (Parquet: citing, cited, year) to target; a file is taken once, whatever breaks off in between."""
    q = _new_files(spark, source, 64).writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()


def counted(spark: SparkSession, target: str) -> DataFrame:
    """work_id, year, cite_counts of all that has been taken in."""
    return spark.read.parquet(target).groupBy(F.col("cited").alias("work_id"), "year").agg(F.count("*").alias("cite_counts"))


def add_counts(target: str) -> Callable[[DataFrame, int], None]:
    """A sink of micro-batches of references: each leaves its own counts in target/batch=<id>, in place of what a broken-off try has left there."""

    def add(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy(F.col("cited").alias("work_id"), "year").agg(F.count("*").alias("cite_counts"))
        counts.write.mode("overwrite").parquet(f"{target}/batch={number:012d}")

    return add


def count_references(spark: SparkSession, source: str, target: str, state: str, files: int = 64) -> None:
    """Count what is new below source, once: a batch reads only its own files. state and target belong together: batches are numbered by state."""
    q = _new_files(spark, source, files).writeStream.foreachBatch(add_counts(target)).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()


def _parts(spark: SparkSession, target: str) -> tuple[int, list[str]]:
    """The last batch in the newest whole base (-1: none), and the folders that make up all counts: the base and later batches."""
    root = Folder(spark, target)
    whole = [n for n in root.names() if "=" in n and root.exists(f"{n}/_SUCCESS")]
    base = max((int(n[5:]) for n in whole if n.startswith("base=")), default=-1)
    batches = [n for n in whole if n.startswith("batch=") and int(n[6:]) > base]
    return base, [*([f"base={base:012d}"] if base >= 0 else []), *batches]


def running_counts(spark: SparkSession, target: str) -> DataFrame:
    """work_id, year, cite_counts of all batches: partial counts are merged as they are read."""
    _, parts = _parts(spark, target)
    if not parts:
        return spark.createDataFrame([], _COUNTS)
    rows = spark.read.schema(_COUNTS).parquet(*(f"{target}/{p}" for p in parts))
    return rows.groupBy("work_id", "year").agg(F.sum("cite_counts").alias("cite_counts"))


def compact_counts(spark: SparkSession, target: str) -> int:
    """Merge the base and all batches after it into a new base, then delete them; the folders that were merged.

    A base counts once it is written whole, and covers the batches up to its
    number: whatever breaks off, none is counted twice or lost. The last batch
    stays where it is, since its try may be repeated.
    """
    base, parts = _parts(spark, target)
    batches = [p for p in parts if p.startswith("batch=")][:-1]
    if not batches:
        return 0
    merged = [*(p for p in parts if p.startswith("base=")), *batches]
    rows = spark.read.schema(_COUNTS).parquet(*(f"{target}/{p}" for p in merged))
    last = int(batches[-1][6:])
    rows.groupBy("work_id", "year").agg(F.sum("cite_counts").alias("cite_counts")).write.mode("overwrite").parquet(f"{target}/base={last:012d}")
    root = Folder(spark, target)
    for name in root.names():  # of earlier compactions that broke off too
        if name.startswith("base=") and int(name[5:]) < last or name.startswith("batch=") and int(name[6:]) <= last:
            root.delete(name)
    return len(merged)
