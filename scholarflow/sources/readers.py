"""Sources: nested works as JSON lines, typed CSV tables, id lists, file inventories."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers are read as strings: as numbers, '13' and 12.7 would be lost.
WORK_SCHEMA = (
    "id string, display_name string, title string, publication_year string, type string, cited_by_count string, fwci string, "
    "primary_topic struct<id: string, display_name: string, field: struct<id: string, display_name: string>, subfield: struct<id: string, display_name: string>>, "
    "authorships array<struct<author_position: string, author: struct<id: string, display_name: string>>>, "
    "counts_by_year array<struct<year: string, cited_by_count: string>>, referenced_works array<string>"
)

TABLES = {
    "works": "work_id string, title string, publication_year int, type string, cited_by_count bigint, fwci double, field_id string, field_name string, subfield_id string, subfield_name string, topic_id string, topic_name string, referenced_works_count bigint",
    "work_authors": "work_id string, author_id string, author_name string, author_position string, author_sequence int",
    "work_cites_by_year": "work_id string, year int, cite_counts bigint",
    "work_references": "work_id string, referenced_work_id string",
}


def files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, sorted; the listing is Spark's, so any store will do."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in (found or []))


def read_works(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Raw works from JSON lines (plain or gzip) at any depth below path, with the updated_date of their folder; blank lines are skipped. max_files: the first ones only, in order of their paths."""
    reader = spark.read.schema(WORK_SCHEMA).option("recursiveFileLookup", "true")
    rows = reader.json(path if max_files is None else below(spark, path)[:max_files])
    day = F.nullif(F.regexp_extract("_metadata.file_path", "updated_date=([^/]+)/", 1), F.lit(""))
    return rows.select("*", day.alias("updated_date"))


def below(spark: SparkSession, root: str) -> list[str]:
    """Paths of all files below root, sorted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found, out = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while found.hasNext():
        at = found.next().getPath()
        if not at.getName().startswith(("_", ".")):
            out.append(at.toString())
    return sorted(out)


def parse_works(lines: DataFrame, column: str = "value", only: tuple[str, ...] = ()) -> DataFrame:
    """Raw works from a column of JSON documents; only some of their fields, if these are named."""
    schema = T.StructType([f for f in T.StructType.fromDDL(WORK_SCHEMA) if not only or f.name in only])
    return lines.select(F.from_json(column, schema).alias("w")).select("w.*")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table as CSV: name.csv.gz, else part_*_name.csv.gz. Unreadable values become null."""
    found = files(spark, f"{root}/{name}.csv.gz") or files(spark, f"{root}/part_*_{name}.csv.gz")
    if not found:
        raise FileNotFoundError(f"{root} has neither {name}.csv.gz nor parts of it")
    schema = T.StructType.fromDDL(TABLES[name])
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    rows = spark.read.schema(text).option("header", "true").option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(found)
    return rows.select(*(F.col(f.name) if isinstance(f.dataType, T.StringType) else F.nullif(F.trim(f.name), F.lit("")).try_cast(f.dataType).alias(f.name) for f in schema.fields))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """id: the lines of a text file (plain or gzip), trimmed, without empty ones."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")


def references_of(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """id, referenced_work_id of wanted ids: a line's own id is read first, and only matching lines are parsed in full."""
    lines = spark.read.text(path).select("value", F.from_json("value", "id string")["id"].alias("id"))
    return parse_works(lines.join(wanted.select("id"), "id", "left_semi")).select("id", F.explode("referenced_works").alias("referenced_work_id"))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), bytes, uri of every file, empty ones too, which Spark's own file source leaves out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found, rows = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    whole = _whole(spark, root)
    while found.hasNext():
        f = found.next()
        uri = f.getPath().toString()
        if not f.getPath().getName().startswith(("_", ".")):  # marks, and checksums of a local file system
            rows.append((uri[len(whole) :], f.getLen(), uri))
    return spark.createDataFrame(rows, "path string, bytes long, uri string")


def inventory(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """path, length, expected, complete for each file of the manifest (path below root, expected)."""
    there = listing(spark, root).select("path", F.col("bytes").alias("length"))
    return manifest.join(there, "path", "left").select("path", "length", "expected", (F.coalesce("length", F.lit(-1)) == F.col("expected")).alias("complete"))


def _files_below(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return rows.withColumn("path", F.expr(f"substring(path, {len(_whole(spark, root)) + 1})"))


def _whole(spark: SparkSession, root: str) -> str:
    """root in full, with a slash at its end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/") + "/"


#: Schemes of stores that tasks open themselves, to read a file as a stream; hdfs needs its native library on executors.
STREAMED = ("file", "s3", "s3a", "gs", "abfs", "abfss")
#: Bytes of a file that are in memory at once.
PIECE = 1 << 22


def _stream(uri: str):
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri.replace("s3a:", "s3:", 1))
    return store.open_input_stream(path, compression=None)


def digests(spark: SparkSession, root: str, streamed: bool | None = None) -> DataFrame:
    """path (below root), bytes, sha256 of every file.

    Files are dealt out to tasks, which read them as streams, a piece at a time,
    so files of any size are. Stores that tasks can't open (streamed: False, and
    by default those that aren't STREAMED) are read by Spark, a file as one row:
    none may be larger than 2 GB there.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    scheme = path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
    if not (scheme in STREAMED if streamed is None else streamed):
        read = _files_below(spark, root).select("path", F.sha2("content", 256).alias("sha256"))
        return listing(spark, root).drop("uri").join(read, "path", "left").withColumn("sha256", F.coalesce("sha256", F.sha2(F.lit(""), 256)))

    def digest(batches):
        for b in batches:
            sums = []
            for uri in b.column(2).to_pylist():
                total = hashlib.sha256()
                with _stream(uri) as f:
                    while piece := f.read(PIECE):
                        total.update(piece)
                sums.append(total.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sums, pa.string())], ["path", "bytes", "sha256"])

    # in order of size, so that large files are spread over the tasks
    named = listing(spark, root).repartitionByRange("bytes", "path")
    return named.select("path", "bytes", "uri").mapInArrow(digest, "path string, bytes long, sha256 string")


def checked(spark: SparkSession, root: str, manifest: DataFrame, streamed: bool | None = None) -> DataFrame:
    """path, problem (null: none) for each file of the manifest (path below root, bytes, sha256): missing, size or checksum."""
    there = digests(spark, root, streamed).toDF("path", "length", "own")
    both = manifest.join(there, "path", "left")
    problem = F.when(F.col("length").isNull(), "missing").when(F.col("length") != F.col("bytes"), "size").when(F.col("own") != F.col("sha256"), "checksum")
    return both.select("path", problem.alias("problem"))


def manifest_of(spark: SparkSession, root: str, streamed: bool | None = None) -> DataFrame:
    """path (below root), bytes, sha256 of every file."""
    return digests(spark, root, streamed)
