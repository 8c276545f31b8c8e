"""Series of cite counts and their windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def calculated_cite_counts(edges: DataFrame, years: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """work_id, year, cite_counts: edges (citing, cited) counted by the cited work and the citing work's year.

    targets (work_id) keeps their cite_counts only. Counts are taken before the
    shuffle as well, so a work cited by a third of all works is no burden.
    """
    if targets is not None:
        edges = edges.join(targets.select(F.col("work_id").alias("cited")), "cited", "left_semi")
    dated = edges.join(years.select(F.col("work_id").alias("citing"), "year"), "citing")
    return dated.groupBy(F.col("cited").alias("work_id"), "year").agg(F.count("*").alias("cite_counts"))


def running(cby: DataFrame) -> DataFrame:
    """cby with cumulative: all cites up to and in that year."""
    return cby.withColumn("cumulative", F.sum("cite_counts").over(W.partitionBy("work_id").orderBy("year").rowsBetween(W.unboundedPreceding, 0)))


def crossings(cby: DataFrame, threshold: int) -> DataFrame:
    """work_id, crossing_year: the first year in which the running sum reaches the threshold."""
    return running(cby).where(F.col("cumulative") >= threshold).groupBy("work_id").agg(F.min("year").alias("crossing_year"))


def lagged_stock(dense: DataFrame) -> DataFrame:
    """dense (a row for each year) with stock: cites of all earlier years."""
    return dense.withColumn("stock", F.coalesce(F.sum("cite_counts").over(W.partitionBy("work_id").orderBy("year").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def related_pairs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """focal, other: itself, what it cites and what cites it."""
    same = nodes.select(F.col("work_id").alias("focal"), F.col("work_id").alias("other"))
    return same.union(edges.select(F.col("citing").alias("focal"), F.col("cited").alias("other"))).union(edges.select(F.col("cited").alias("focal"), F.col("citing").alias("other"))).distinct()


def coverage(focal: DataFrame, calculated: DataFrame, recorded: DataFrame) -> DataFrame:
    """One row of how calculated totals agree with recorded ones over the focal works."""
    sums = calculated.groupBy("work_id").agg(F.sum("cite_counts").alias("total"))
    both = focal.select("work_id").distinct().join(recorded.select("work_id", "cites"), "work_id", "left").join(sums, "work_id", "left")
    diff = F.coalesce("total", F.lit(0)) - F.coalesce("cites", F.lit(0))
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).cast("bigint")
    return both.agg(
        F.count("*").alias("focal"),
        n(diff == 0).alias("exact"),
        n(F.col("total").isNull() & (F.coalesce("cites", F.lit(0)) > 0)).alias("missing"),
        n(F.col("total").isNotNull() & (diff > 0)).alias("higher"),
        n(F.col("total").isNotNull() & (diff < 0)).alias("lower"),
        F.coalesce(F.sum(F.when(F.col("total").isNotNull(), F.abs(diff))), F.lit(0)).cast("bigint").alias("abs_diff"),
    )


def repeated_references(edges: DataFrame) -> DataFrame:
    """matches, citers, repeats of an edge list that isn't distinct."""
    pairs = edges.groupBy("citing", "cited").agg(F.count("*").alias("n"))
    return pairs.agg(F.sum("n").cast("bigint").alias("matches"), F.count("*").alias("unique_pairs"), F.sum(F.col("n") - 1).cast("bigint").alias("repeats"))


def verdict(row: DataFrame, max_difference: int = 0, max_missing: int = 0) -> DataFrame:
    """coverage() with valid: no more missing, and no greater difference, than allowed."""
    return row.withColumn("valid", (F.col("abs_diff") <= max_difference) & (F.col("missing") <= max_missing))


def mismatches(focal: DataFrame, calculated: DataFrame, recorded: DataFrame) -> DataFrame:
    """work_id, total, cites of the focal works whose calculated total isn't the recorded one."""
    sums = calculated.groupBy("work_id").agg(F.sum("cite_counts").alias("total"))
    both = focal.select("work_id").distinct().join(recorded.select("work_id", F.coalesce("cites", F.lit(0)).alias("cites")), "work_id").join(sums, "work_id", "left")
    return both.withColumn("total", F.coalesce("total", F.lit(0))).where("total <> cites")


def repeats_by_target(edges: DataFrame) -> DataFrame:
    """cited, entries, citers, repeats: of an edge list that isn't distinct, by the cited work."""
    pairs = edges.groupBy("citing", "cited").agg(F.count("*").alias("n"))
    return pairs.groupBy("cited").agg(F.sum("n").cast("bigint").alias("entries"), F.count("*").alias("citers"), F.sum(F.col("n") - 1).cast("bigint").alias("repeats"))


def repeat_examples(edges: DataFrame, most: int = 50) -> DataFrame:
    """citing, cited, repetitions: the most repeated pairs, for a report."""
    pairs = edges.groupBy("citing", "cited").agg(F.count("*").alias("repetitions")).where("repetitions > 1")
    return pairs.orderBy(F.desc("repetitions"), "citing", "cited").limit(most)


def related_counts(edges: DataFrame, works: DataFrame) -> DataFrame:
    """work_id, related, unrelated: works of the same author that are (itself, cited or citing) or aren't related; histories are counted, not paired."""
    own = works.select(F.col("work_id").alias("other"), F.col("author_id").alias("its"))
    near = related_pairs(edges, works).withColumnRenamed("focal", "work_id").join(works.select("work_id", "author_id"), "work_id").join(own, "other").where("author_id = its")
    near = near.groupBy("work_id").agg(F.count("*").alias("related"))
    every = works.select("work_id", "author_id").join(works.groupBy("author_id").agg(F.count("*").alias("n")), "author_id")
    return every.join(near, "work_id").select("work_id", "related", (F.col("n") - F.col("related")).alias("unrelated"))
