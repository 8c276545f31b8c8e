"""Sinks and the warehouse: partitioned tables, manifest, idempotent import, chunked backfill, exports."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .leases import Folder, Lease
from .readers import below, manifest_of


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", "true").option("compression", "gzip").mode("overwrite").csv(path)


def write_jsonl(df: DataFrame, path: str, records_per_file: int = 100_000, by: list[str] | None = None) -> None:
    """JSON lines; in a folder for each value of the columns by, all in one pass."""
    df.write.option("maxRecordsPerFile", records_per_file).option("compression", "gzip").mode("overwrite").partitionBy(*(by or [])).json(path)


def write_subjects(tables: dict[str, DataFrame], root: str) -> None:
    """Each table, partitioned by subject. Only the subjects at hand are replaced."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("subject").parquet(f"{root}/{name}")


def write_ids(df: DataFrame, column: str, path: str) -> None:
    """Distinct sorted ids, one a line."""
    df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct().orderBy("value").write.mode("overwrite").text(path)


def write_json_file(value, path: str) -> None:
    """A small driver-side file, complete or not there at all."""
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(value, f, indent=1, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{path}.tmp", path)


def write_counted(df: DataFrame, path: str, parameters: dict, **metrics) -> dict:
    """Write df and say in one pass how many rows it had, beside all parameters."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in metrics.items())).write.mode("overwrite").parquet(path)
    return {**parameters, **seen.get}


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and new with one row for each key: new rows win, of equals the least in order of the other columns."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_new"), *(c for c in old.columns if c not in keys)))).where("_r = 1").drop("_r", "_new")


class Warehouse:
    """Tables as Parquet folders below root. A load is in a table once its manifest entry is there, and not before.

    Each load has a folder of its own; the entry of its subject and table, which
    only one of several loaders can make, names it. A loader that broke off or came
    second leaves a folder that no entry names: nobody reads it, vacuum() deletes it.
    """

    _ENTRY = "subject string, table_name string, rows bigint, folder string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.entries = spark, root, Folder(spark, f"{root}/manifest")

    def _entry(self, subject: str, name: str) -> str:
        return hashlib.sha256(json.dumps([subject, name]).encode()).hexdigest() + ".json"

    def manifest(self) -> DataFrame:
        """subject, table_name, rows, folder of all loads that count."""
        if not self.entries.exists():
            return self.spark.createDataFrame([], self._ENTRY)
        return self.spark.read.schema(self._ENTRY).json(f"{self.root}/manifest").where("folder is not null")

    def load(self, subject: str, name: str, df: DataFrame) -> int:
        """Import df once and return its rows; 0 if there is an import of this subject and table, from before or made meanwhile."""
        entry = self._entry(subject, name)
        if self.entries.exists(entry):
            return 0
        seen, folder = Observation(), f"{name}/load={uuid.uuid4().hex}"
        df.observe(seen, F.count(F.lit(1)).alias("rows")).withColumn("subject", F.lit(subject)).write.parquet(f"{self.root}/{folder}")
        if self.entries.create(entry, {"subject": subject, "table_name": name, "rows": seen.get["rows"], "folder": folder}):
            return seen.get["rows"]
        Folder(self.spark, self.root).delete(folder)
        return 0

    def unload(self, subject: str, name: str) -> bool:
        """Take the import of a subject and table out, so that it can be loaded anew; False if there is none."""
        entry = self._entry(subject, name)
        known = self.entries.read(entry)
        if known is None or not self.entries.delete(entry):
            return False
        return Folder(self.spark, self.root).delete(known["folder"])

    def table(self, name: str) -> DataFrame:
        """All loads of a table that count."""
        folders = [r.folder for r in self.manifest().where(F.col("table_name") == name).select("folder").orderBy("folder").collect()]  # one for each subject
        if not folders:
            raise ValueError(f"nothing is loaded into {name}")
        return self.spark.read.parquet(*(f"{self.root}/{f}" for f in folders))

    def vacuum(self) -> list[str]:
        """Delete load folders that no entry names; for when no loader is at work."""
        kept = {r.folder for r in self.manifest().select("folder").collect()}
        gone = []
        for name in Folder(self.spark, self.root).names():
            table = Folder(self.spark, f"{self.root}/{name}")
            gone += [f"{name}/{x}" for x in table.names() if x.startswith("load=") and f"{name}/{x}" not in kept and table.delete(x)]
        return gone

    def views(self) -> None:
        """Cites with their works, authors' works and yearly sums, as views."""
        for name in ("works", "work_authors", "work_cites_by_year"):
            self.table(name).createOrReplaceTempView(name)
        self.spark.sql("create or replace temp view cite_panel as select c.subject, c.work_id, c.year, c.cite_counts, w.publication_year, c.year - w.publication_year as paper_age, w.type from work_cites_by_year c join works w using (subject, work_id)")
        self.spark.sql("create or replace temp view author_works as select subject, author_id, min(author_name) as author_name, count(distinct work_id) as works from work_authors group by subject, author_id")
        self.spark.sql("create or replace temp view year_summary as select subject, year, count(*) as rows, sum(cite_counts) as cite_counts from work_cites_by_year group by subject, year")


def plan_chunks(names: Iterable[str], size: int) -> list[list[str]]:
    ordered = sorted(names)
    return [ordered[i : i + size] for i in range(0, len(ordered), size)]


def tidy(df: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """One row for each key and measure: record_type, keys, metric, value."""
    measures = [c for c in df.columns if c not in keys]
    return df.select(*keys, *(F.col(c).cast("double").alias(c) for c in measures)).unpivot(keys, measures, "metric", "value").withColumn("record_type", F.lit(kind))


def sha256_file(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            digest.update(part)
    return digest.hexdigest()


def validate_table(df: DataFrame, columns: list[str], rows: int | None = None) -> list[str]:
    """What is wrong with a table: its header or its number of rows."""
    wrong = [] if df.columns == columns else [f"columns are {df.columns}"]
    if rows is not None and (n := df.count()) != rows:
        wrong.append(f"{n} rows, {rows} expected")
    return wrong


def dictionary(rows: DataFrame) -> DataFrame:
    """record_type, metric, n, missing, least, greatest of tidy rows: what an export holds."""
    return rows.groupBy("record_type", "metric").agg(F.count("*").alias("n"), F.sum(F.col("value").isNull().cast("bigint")).alias("missing"), F.min("value").alias("least"), F.max("value").alias("greatest"))


def export(tables: dict[str, tuple[DataFrame, list[str]]], path: str) -> DataFrame:
    """Tidy rows of all tables (kind: rows and keys; keys as one string) as CSV, their dictionary, and a manifest of bytes and checksums of all files."""
    made = [tidy(df.withColumn("key", F.concat_ws("|", *keys)).drop(*keys), ["key"], kind).select("record_type", "key", "metric", "value") for kind, (df, keys) in tables.items()]
    rows = reduce(DataFrame.unionByName, made)
    write_csv(rows, f"{path}/rows")
    write_csv(dictionary(rows), f"{path}/dictionary")
    manifest = manifest_of(rows.sparkSession, path)
    write_jsonl(manifest.where("path not like 'manifest/%'"), f"{path}/manifest")
    return manifest


def publish(df: DataFrame, root: str, version: str) -> str:
    """df below root/version=..., and then the pointer root/current moved there: readers see the old or the new, never half."""
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(f"{root}/version={version}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(path(f"{root}/_current.tmp"), True)
    out.write(bytearray(version.encode()))
    out.close()
    fs.delete(path(f"{root}/_current"), False)
    fs.rename(path(f"{root}/_current.tmp"), path(f"{root}/_current"))
    return version


def published(spark: SparkSession, root: str) -> DataFrame:
    """What the pointer names; while it is being moved, the version it is moved to."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    name = next(n for n in ("_current", "_current.tmp") if fs.exists(path(f"{root}/{n}")))
    version = spark._jvm.org.apache.commons.io.IOUtils.toString(fs.open(path(f"{root}/{name}")), "UTF-8")
    return spark.read.parquet(f"{root}/version={version}")


def backfill(spark: SparkSession, source: str, target: str, work: Callable[[list[str]], DataFrame], files_per_chunk: int = 8, reset: bool = False, lease_seconds: float = 60.0) -> list[int]:
    """Write work(files) below target for each chunk of the files below source that isn't there whole; the numbers of those done now.

    The plan's hash covers the files' paths, sizes and times, so a source that
    has changed is refused unless reset, which deletes the chunks and their
    manifests and nothing else. A chunk is taken as done if its manifest is of
    this plan and its files have the sizes, checksums and rows it says; else it
    is made again. A lease keeps a second run out as long as the first one lives;
    when it has died, the next run goes on after lease_seconds. Chunks are made
    aside and moved into place after a look at the lease, so a run that was
    overtaken commits nothing. All state goes through the file system of target.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    there = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    status = [there.getFileStatus(path(f)) for f in below(spark, source)]
    listed = [[s.getPath().toString(), s.getLen(), s.getModificationTime()] for s in status]
    chunks = plan_chunks([f for f, _, _ in listed], files_per_chunk)
    digest = hashlib.sha256(json.dumps([listed, files_per_chunk]).encode()).hexdigest()
    state = Folder(spark, target)

    def files_of(name: str) -> list[list]:
        return sorted([r.path, r.bytes, r.sha256] for r in manifest_of(spark, f"{target}/{name}").collect()) if state.exists(name) else []  # a few files

    def whole(i: int) -> bool:
        known, name = state.read(f"_chunk_{i:06d}.json"), f"chunk={i:06d}"
        return bool(known) and known.get("plan") == digest and known.get("sources") == chunks[i] and known.get("files") == files_of(name) and known.get("rows") == spark.read.parquet(f"{target}/{name}").count()

    with Lease(spark, f"{target}/_lease", lease_seconds) as lease:
        plan = state.read("_plan.json")
        if plan and plan["sha256"] != digest:
            if not reset:
                raise ValueError("the source isn't the one this target was planned for")
            for i in range(plan["chunks"]):
                state.delete(f"chunk={i:06d}")
                state.delete(f"_chunk_{i:06d}.json")
        for name in state.names():  # of runs that died
            if name.startswith("_made_"):
                state.delete(name)
        state.write("_plan.json", {"sha256": digest, "chunks": len(chunks), "files": listed})
        done = []
        for i, names in enumerate(chunks):
            if not reset and whole(i):
                continue
            made, name = f"_made_{lease.token}_{i:06d}", f"chunk={i:06d}"
            work(names).write.mode("overwrite").parquet(f"{target}/{made}")
            rows = spark.read.parquet(f"{target}/{made}").count()
            lease.check()
            state.delete(f"_chunk_{i:06d}.json")
            state.delete(name)
            state.fs.rename(state.path(made), state.path(name))
            state.write(f"_chunk_{i:06d}.json", {"plan": digest, "sources": names, "files": files_of(name), "rows": rows})
            done.append(i)
        return done
