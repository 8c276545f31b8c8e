"""Event-time statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranks import at_rank, running_counts


def clustered_means(panel: DataFrame, value: str, cluster: str, key: str = "event_time") -> DataFrame:
    """key, n, clusters, mean, se (cluster-robust), low, high (95 %).

    se = sqrt(G / (G - 1) * sum over clusters of (S - m n)^2 / N^2). The sum is
    taken apart into moments, so one pass over the cluster sums will do.
    """
    sums = panel.groupBy(key, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    out = sums.groupBy(key).agg(F.sum("c").alias("n"), F.count("*").alias("clusters"), (F.sum("s") / F.sum("c")).alias("mean"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("s") * F.col("c")).alias("sc"), F.sum(F.col("c") * F.col("c")).alias("cc"))
    g, m = F.col("clusters"), F.col("mean")
    var = F.when(g > 1, g / (g - 1) * F.greatest(F.col("ss") - 2 * m * F.col("sc") + m * m * F.col("cc"), F.lit(0.0)) / (F.col("n") * F.col("n")))
    out = out.withColumn("se", F.sqrt(var))
    return out.select(key, "n", "clusters", "mean", "se", (m - 1.96 * F.col("se")).alias("low"), (m + 1.96 * F.col("se")).alias("high"))


def from_baseline(panel: DataFrame, unit: list[str], value: str, at: int = -1) -> DataFrame:
    """panel with baseline (the unit's value at that event time) and delta."""
    base = F.max(F.when(F.col("event_time") == at, F.col(value))).over(W.partitionBy(*unit))
    return panel.withColumn("baseline", base).withColumn("delta", F.col(value) - F.col("baseline"))


def cells(panel: DataFrame, keys: list[str]) -> DataFrame:
    """One pass over event_time alone and with each other key: rows, observed, missing, mean of all as 0, mean of observed."""
    base = panel.withColumn("z", F.coalesce("cite_counts", F.lit(0)))
    sets = [["event_time"], *([k, "event_time"] for k in keys)]
    out = base.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in ["event_time", *keys])).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("rows"), F.sum("observed").cast("bigint").alias("observed"), F.avg("z").alias("mean_zero"), F.avg(F.when(F.col("observed") == 1, F.col("cite_counts"))).alias("mean_observed")
    )
    # the bit of a key is 0 in the rows that are grouped by it, whatever its value
    dimension, level = F.lit("event_time"), F.lit("")
    for i, k in enumerate(reversed(keys)):
        by = F.col("gid").bitwiseAND(1 << i) == 0
        dimension, level = F.when(by, k).otherwise(dimension), F.when(by, F.coalesce(F.col(k).cast("string"), F.lit("unknown"))).otherwise(level)
    return out.select(dimension.alias("dimension"), level.alias("level"), "event_time", "rows", "observed", (F.col("rows") - F.col("observed")).alias("missing"), "mean_zero", "mean_observed")


def pair_deltas(panel: DataFrame, unit: list[str]) -> DataFrame:
    """unit, pre and post means with nulls as 0, delta, and the same over observed years (null if a side has none)."""
    z, pre, post = F.coalesce("cite_counts", F.lit(0)), F.col("event_time") < 0, F.col("event_time") >= 0
    seen = F.col("observed") == 1
    out = panel.groupBy(*unit).agg(F.avg(F.when(pre, z)).alias("pre"), F.avg(F.when(post, z)).alias("post"), F.avg(F.when(pre & seen, F.col("cite_counts"))).alias("pre_observed"), F.avg(F.when(post & seen, F.col("cite_counts"))).alias("post_observed"))
    return out.withColumn("delta", F.col("post") - F.col("pre")).withColumn("delta_observed", F.col("post_observed") - F.col("pre_observed"))


def order_statistics(df: DataFrame, value: str, points: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """n, sum, mean, min, p50..., max, zero_share: quantiles are the values at floor(q (n - 1)).

    Values are counted first, so ranks come from distinct values: no task sees all rows.
    """
    counts = running_counts(df.withColumn("_all", F.lit(1)), value, ["_all"])
    picks = [at_rank(F.floor(q * (F.col("n") - 1))).alias(f"p{round(100 * q)}") for q in points]
    got = counts.groupBy("_all").agg(F.sum("c").alias("n"), F.sum(F.col("v") * F.col("c")).alias("sum"), F.min("v").alias("min"), *picks, F.max("v").alias("max"), (F.sum(F.when(F.col("v") == 0, F.col("c")).otherwise(0)) / F.sum("c")).alias("zero_share"))
    return got.select("n", "sum", (F.col("sum") / F.col("n")).alias("mean"), "min", *(f"p{round(100 * q)}" for q in points), "max", "zero_share")


def year_series(dense: DataFrame) -> DataFrame:
    """year, at_risk, total, mean, upper_median (the value at n // 2), zero_share."""
    counts = running_counts(dense, "cite_counts", ["year"])
    total, n = F.sum(F.col("v") * F.col("c")), F.sum("c")
    return counts.groupBy("year").agg(
        n.alias("at_risk"), total.cast("bigint").alias("total"), (total / n).alias("mean"), at_rank(F.floor(F.col("n") / 2)).alias("upper_median"), (F.sum(F.when(F.col("v") == 0, F.col("c")).otherwise(0)) / n).alias("zero_share")
    )


def standardized(cells_: DataFrame, weights: DataFrame) -> DataFrame:
    """event_time, standardized: cell means (event_time, bin, rows, mean) weighted by the bins' shares (bin, weight), over the bins at hand."""
    both = cells_.join(weights, "bin")
    return both.groupBy("event_time").agg((F.sum(F.col("weight") * F.col("mean")) / F.sum("weight")).alias("standardized"))


def lifecycle_benchmark(panel: DataFrame, min_rows: int = 1) -> DataFrame:
    """year, paper_age, type, expected, positive_share over works' years, each once."""
    once = panel.groupBy("work_id", "year").agg(F.max("cite_counts").alias("c"), F.min("paper_age").alias("paper_age"), F.min("type").alias("type"))
    return once.groupBy("year", "paper_age", "type").agg(F.avg("c").alias("expected"), F.avg((F.col("c") > 0).cast("double")).alias("positive_share"), F.count("*").alias("k")).where(F.col("k") >= min_rows).drop("k")


def two_samples(panel: DataFrame, unit: list[str], window: int) -> DataFrame:
    """panel (event_time, c, expected, smoothed) once as at_risk, and units seen in the whole window again as balanced."""
    w = W.partitionBy(*unit)
    whole = (F.count("*").over(w) == 2 * window + 1) & (F.min("event_time").over(w) == -window) & (F.max("event_time").over(w) == window)
    samples = F.filter(F.array(F.lit("at_risk"), F.when(F.col("_whole"), F.lit("balanced"))), lambda x: x.isNotNull())
    return panel.withColumn("_whole", whole).withColumn("sample", F.explode(samples)).drop("_whole")


def sample_means(samples: DataFrame, unit: list[str]) -> DataFrame:
    """sample, event_time, observations, authors, units, means, and the error of the mean of authors' mean excess."""
    per = samples.groupBy("sample", "event_time", "author_id").agg(F.avg("excess").alias("m"))
    error = per.groupBy("sample", "event_time").agg((F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("se"))
    means = samples.groupBy("sample", "event_time").agg(F.count("*").alias("observations"), F.count_distinct("author_id").alias("authors"), F.count_distinct(*unit).alias("units"), F.avg("excess").alias("excess"), (F.sum("c") / F.nullif(F.sum("expected"), F.lit(0))).alias("observed_expected"), F.avg("smoothed").alias("smoothed"))
    return means.join(error, ["sample", "event_time"])
