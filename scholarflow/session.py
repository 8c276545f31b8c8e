"""A session set up for this engine."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_own: list[str] = []


def get_spark(app: str = "scholarflow", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI, adaptive execution; everything else as the cluster has it."""
    made = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        made = made.master(master)
    for k, v in conf.items():
        made = made.config(k, v)
    return made.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share; one of our own only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-"))
    return _own[0]


#: Bytes of a shuffle's part after adaptive execution has joined small ones, and of the input for each part before. Rows
#: that are few bytes in a shuffle are many in a sort, and a task holds several sorts: 64 MB, the default, became gigabytes.
PART, INPUT = 8 << 20, 2 << 20
#: Bytes of a file that one task reads: a shuffle holds what a task writes as rows, several times as large as columns.
SPLIT = 8 << 20


def spread(spark: SparkSession, folder: str) -> None:
    """Have scans and shuffles make more and smaller parts for a larger folder of tables; never fewer or larger ones than the session has."""
    read, size, joined, parts = "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.shuffle.partitions"
    for key, most in ((read, SPLIT), (size, PART)):
        if bytes_of(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    needed = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength() // INPUT
    # where parts aren't joined afterwards, Spark heeds the plain number only
    joins = all(spark.conf.get(k).lower() == "true" for k in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.enabled"))
    if needed > int((joins and spark.conf.get(joined, None)) or spark.conf.get(parts)):
        spark.conf.set(joined if joins else parts, str(needed))


def bytes_of(text: str) -> int:
    """A size as Spark writes it, as 64MB, 8m or 1024."""
    text = text.strip().lower().removesuffix("b")
    units = {"k": 10, "m": 20, "g": 30, "t": 40, "p": 50}
    return int(text[:-1]) << units[text[-1]] if text[-1] in units else int(text)
