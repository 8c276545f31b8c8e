"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Words of a text: maximal runs of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch that are worked on at once (Spark bounds a batch's bytes).
ROWS = 256

class Scope:
    """The tables of one run below the shared folder. They go with it, but for what it hands on to the scope around it."""

    def __init__(self, spark: SparkSession, around: Scope | None = None) -> None:
        self.spark, self.around, self.paths = spark, around, []

    def folder(self) -> str:
        """A new folder that goes with this scope."""
        self.paths.append(f"{shared_folder(self.spark)}/llm-{uuid.uuid4().hex}")
        return self.paths[-1]

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder()}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def hand_on(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table of the scope around this one; of the process, where none is."""
        return (self.around or _process(self.spark)).save(df, name)

    def adopt(self, other: Scope) -> None:
        """What the other has saved goes with this scope from now on."""
        self.paths, other.paths = self.paths + other.paths, []

    def delete(self) -> None:
        for path in self.paths:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.paths = []


_open: ContextVar[Scope | None] = ContextVar("scope", default=None)
_of_process: dict[str, Scope] = {}


def _process(spark: SparkSession) -> Scope:
    """The scope of what no run has taken charge of: it ends with the process, if Spark is still up then."""
    app = spark.sparkContext.applicationId
    if app not in _of_process:
        _of_process[app] = Scope(spark)
        atexit.register(lambda: spark.sparkContext._jsc and _of_process[app].delete())
    return _of_process[app]


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Tables that are saved inside are deleted at its end, whether it ends well or not; other runs' tables stay.

    What is returned from inside must be handed on, or not read any of them.
    """
    run = Scope(spark, _open.get())
    token = _open.set(run)
    try:
        yield run
    finally:
        _open.reset(token)
        run.delete()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current(spark: SparkSession) -> Scope:
    """The innermost scope of this thread."""
    return _open.get() or _process(spark)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors. It goes with the innermost scope."""
    return current(df.sparkSession).save(df, name)


def small_batches(spark: SparkSession, rows: int = ROWS) -> None:
    """Have Spark make Arrow batches of at most so many rows (of 64 MB at most it makes them anyway).

    This is set for the session, and stays: Spark looks at it when a result is asked for, which is after an operator has returned.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that what is made of texts doesn't pile up in a Python worker."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def free(df: DataFrame, name: str) -> str:
    """name, or with underscores after it if df has such a column (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named by their places, for functions over Arrow batches that pass on columns of any name."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def text_key(text: Column, names: tuple[str, str] = ("t0", "t1")) -> list[Column]:
    """128 bits that stand for a text: rows with equal texts share every verdict, whatever their ids.

    The second hash begins with a constant: with the constant after the text it would be a function of the first.
    """
    return [F.xxhash64(text).alias(names[0]), F.xxhash64(F.lit(7), text).alias(names[1])]


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, as every contract on words here asks for."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
