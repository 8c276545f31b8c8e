"""Tables that are dealt out by a key once, so that joins by it move nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 64


def write_bucketed(df: DataFrame, name: str, key: str, path: str, buckets: int = BUCKETS) -> None:
    """A table of the catalog, bucketed and sorted by key, in place of one of that name; its files are below path."""
    df.repartition(buckets, key).write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def bucketed(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
