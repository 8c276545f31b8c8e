"""Nested works to flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C


def in_field(field_ids: list[str], names: list[str]) -> Column:
    """The primary topic's field has one of these ids (last segment) or names (in any case)."""
    field = F.col("primary_topic.field")
    return F.coalesce(C.last_segment(field["id"]).isin(field_ids) | F.lower(field["display_name"]).isin([n.lower() for n in names]), F.lit(False))


def of_type(types: list[str]) -> Column:
    """An empty list allows every type."""
    return F.col("type").isin(types) if types else F.lit(True)


def _work() -> Column:
    topic = F.col("primary_topic")
    named = ((topic["field"]["id"], "field_id"), (topic["field"]["display_name"], "field_name"), (topic["subfield"]["id"], "subfield_id"), (topic["subfield"]["display_name"], "subfield_name"), (topic["id"], "topic_id"), (topic["display_name"], "topic_name"))
    return F.struct(
        F.coalesce("id", F.lit("")).alias("work_id"),
        C.first_filled(F.col("display_name"), F.col("title")).alias("title"),
        C.int_or_zero_json(F.col("publication_year")).cast("int").alias("publication_year"),
        C.first_filled(F.col("type")).alias("type"),
        C.int_or_zero_json(F.col("cited_by_count")).alias("cited_by_count"),
        F.nullif(F.col("fwci"), F.lit("")).try_cast("double").alias("fwci"),
        *(C.first_filled(c).alias(n) for c, n in named),
        F.greatest(F.coalesce(F.size("referenced_works"), F.lit(0)), F.lit(0)).cast("bigint").alias("referenced_works_count"),
    )


def _authors() -> Column:
    """Authors are numbered from 1 before those without an id go."""
    every = F.transform("authorships", lambda a, i: F.struct(F.col("id").alias("work_id"), a["author"]["id"].alias("author_id"), C.first_filled(a["author"]["display_name"]).alias("author_name"), C.first_filled(a["author_position"]).alias("author_position"), (i + 1).alias("author_sequence")))
    return F.filter(every, lambda x: F.coalesce(x["author_id"], F.lit("")) != "")


def _cites() -> Column:
    known = F.filter("counts_by_year", lambda c: c["year"].isNotNull())
    return F.transform(known, lambda c: F.struct(F.col("id").alias("work_id"), C.int_or_zero_json(c["year"]).cast("int").alias("year"), C.int_or_zero_json(c["cited_by_count"]).alias("cite_counts")))


def _references(dedupe: bool) -> Column:
    """Citing to cited; each once for a work if dedupe."""
    listed = F.array_distinct("referenced_works") if dedupe else F.col("referenced_works")
    return F.transform(F.filter(listed, lambda r: F.coalesce(r, F.lit("")) != ""), lambda r: F.struct(F.col("id").alias("work_id"), r.alias("referenced_work_id")))


#: The fields of a document that works() looks at.
OF_WORKS = ("id", "display_name", "title", "publication_year", "type", "cited_by_count", "fwci", "primary_topic", "referenced_works")


def works(raw: DataFrame) -> DataFrame:
    """One row per work with an id and a year."""
    return raw.select(_work().alias("x")).select("x.*").where("work_id <> '' and publication_year <> 0")


def work_authors(raw: DataFrame) -> DataFrame:
    return raw.select(F.explode(_authors()).alias("x")).select("x.*")


def work_cites_by_year(raw: DataFrame) -> DataFrame:
    return raw.select(F.explode(_cites()).alias("x")).select("x.*")


def work_references(raw: DataFrame, dedupe: bool = True) -> DataFrame:
    return raw.select(F.explode(_references(dedupe)).alias("x")).select("x.*")


TABLES = ("works", "work_authors", "work_cites_by_year", "work_references")


def normalize(raw: DataFrame, dedupe: bool = True) -> dict[str, DataFrame]:
    """The four tables; each parses raw when it is read."""
    return dict(zip(TABLES, (works(raw), work_authors(raw), work_cites_by_year(raw), work_references(raw, dedupe)), strict=True))


def tagged(raw: DataFrame, dedupe: bool = True) -> DataFrame:
    """table_name, subject (slug of the work's field), and a struct for each table, null in rows of the others: all rows of all tables from one pass over raw."""
    own = _work()
    some = F.filter(F.array(own), lambda w: (w["work_id"] != "") & (w["publication_year"] != 0))
    parts = dict(zip(TABLES, (some, _authors(), _cites(), _references(dedupe)), strict=True))
    kinds = {k: raw.select(c.alias("x")).schema["x"].dataType.elementType for k, c in parts.items()}

    def rows(name: str, column: Column) -> Column:
        made = F.transform(column, lambda x: F.struct(F.lit(name).alias("table_name"), *((x if k == name else F.lit(None).cast(t)).alias(k) for k, t in kinds.items())))
        return F.coalesce(made, F.array().cast(raw.select(made.alias("x")).schema["x"].dataType))

    subject = C.slugify(F.col("primary_topic.field.display_name")).alias("subject")
    return raw.select(subject, F.explode(F.concat(*(rows(k, c) for k, c in parts.items()))).alias("x")).select("x.table_name", "subject", *(f"x.{k}" for k in TABLES))


def write_normalized(raw: DataFrame, path: str, dedupe: bool = True) -> dict[str, int]:
    """Write the four tables below path, by subject, in one pass over raw; the rows of each."""
    seen = Observation()
    counts = (F.count(F.when(F.col("table_name") == k, 1)).alias(k) for k in TABLES)
    tagged(raw, dedupe).observe(seen, *counts).write.mode("overwrite").partitionBy("table_name", "subject").parquet(path)
    return seen.get


def read_normalized(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table that write_normalized has written, with its subject; other tables' files aren't looked at."""
    rows = spark.read.parquet(path).where(F.col("table_name") == name)
    return rows.select(f"{name}.*", F.col("subject").cast("string").alias("subject"))
