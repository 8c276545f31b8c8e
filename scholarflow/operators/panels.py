"""Hit events and panels. Units are crossed with years by exploding a sequence, never by a cross join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import columns as C
from .ranks import cut


def author_stats(totals: DataFrame) -> DataFrame:
    """totals with author_works, author_cites and share (of the author's cites; null without any)."""
    w = W.partitionBy("author_id")
    out = totals.withColumn("author_works", F.count("*").over(w)).withColumn("author_cites", F.sum("cites").over(w))
    return out.withColumn("share", F.col("cites") / F.nullif(F.col("author_cites"), F.lit(0)))


def hit_pairs(totals: DataFrame, edges: DataFrame, min_cites: int = 101, min_share: float = 0.5, min_works: int = 3, min_priors: int = 3, min_age: int = 1, first_year: int = 1990) -> DataFrame:
    """author_id, hit, hit_year, hit_cites, share, focal, focal_year: hits and the author's earlier works that they don't cite."""
    stats = author_stats(totals)
    hits = stats.where((F.col("cites") >= min_cites) & (F.col("pub_year") >= first_year) & (F.col("author_works") >= min_works) & (F.col("share") >= min_share)).select("author_id", F.col("work_id").alias("hit"), F.col("pub_year").alias("hit_year"), F.col("cites").alias("hit_cites"), "share")
    focal = totals.select("author_id", F.col("work_id").alias("focal"), F.col("pub_year").alias("focal_year"))
    pairs = hits.join(focal, "author_id").where((F.col("hit") != F.col("focal")) & (F.col("focal_year") <= F.col("hit_year") - min_age))
    pairs = pairs.join(edges.select(F.col("citing").alias("hit"), F.col("cited").alias("focal")), ["hit", "focal"], "left_anti")
    return pairs.withColumn("priors", F.count("*").over(W.partitionBy("author_id", "hit"))).where(F.col("priors") >= min_priors)


def hit_events(pairs: DataFrame) -> DataFrame:
    """author_id, hit, hit_year, hit_cites, share, priors."""
    return pairs.groupBy("author_id", "hit", "hit_year", "hit_cites", "share").agg(F.count("*").alias("priors"))


def balanced(pairs: DataFrame, cby: DataFrame, window: int, zero_fill: bool = False) -> DataFrame:
    """pairs with event_time, year, cite_counts and observed for each year around the hit.

    Before publication there are 0 cite_counts, observed; later years without a
    record are null and not observed, or 0 and observed if zero_fill.
    """
    grid = pairs.withColumn("event_time", F.explode(F.sequence(F.lit(-window), F.lit(window)))).withColumn("year", F.col("hit_year") + F.col("event_time"))
    joined = grid.join(cby.select(F.col("work_id").alias("focal"), "year", F.col("cite_counts").alias("c")), ["focal", "year"], "left")
    early = F.col("year") < F.col("focal_year")
    filled = F.coalesce("c", F.lit(0)) if zero_fill else F.col("c")
    return joined.withColumn("cite_counts", F.when(early, F.lit(0).cast("bigint")).otherwise(filled)).withColumn("observed", F.when(early | F.col("cite_counts").isNotNull(), 1).otherwise(0)).drop("c")


def lifetime(authored: DataFrame, cby: DataFrame, end: int) -> DataFrame:
    """work_id, author_id, year, paper_age, cite_counts: every year from publication to end (or publication, if later)."""
    grid = authored.select("work_id", "author_id", "pub_year", F.explode(F.sequence("pub_year", F.greatest(F.lit(end), "pub_year"))).alias("year"))
    return grid.join(cby, ["work_id", "year"], "left").select("work_id", "author_id", "year", (F.col("year") - F.col("pub_year")).alias("paper_age"), F.coalesce("cite_counts", F.lit(0)).cast("bigint").alias("cite_counts"))


def yearly(cby: DataFrame) -> DataFrame:
    """work_id, cites (map of year to cite_counts): a work's years, which are few, in one row."""
    return cby.groupBy("work_id").agg(F.map_from_entries(F.collect_list(F.struct("year", "cite_counts"))).alias("cites"))


def lifetime_by_work(authored: DataFrame, years: DataFrame, end: int) -> DataFrame:
    """The rows of lifetime, from authored works and yearly() tables: one join by work alone, so tables bucketed by it meet without a shuffle."""
    rows = authored.select("work_id", "author_id", "pub_year").join(years, "work_id", "left")
    grid = rows.select("work_id", "author_id", "pub_year", "cites", F.explode(F.sequence("pub_year", F.greatest(F.lit(end), "pub_year"))).alias("year"))
    return grid.select("work_id", "author_id", "year", (F.col("year") - F.col("pub_year")).alias("paper_age"), F.coalesce(F.try_element_at("cites", "year"), F.lit(0)).cast("bigint").alias("cite_counts"))


def sampled_authorships(authorships: DataFrame, works: DataFrame, first_year: int, last_year: int, types: list[str], min_works: int = 1, max_authors: int | None = None, sample: tuple[int, int] = (1, 1)) -> DataFrame:
    """author_id, work_id: distinct authorships of works of these years and types by a hash sample of authors (kept, of buckets) with enough such works.

    Of these the first max_authors by id, if that is given. Authorships without
    an author or a work aren't any.
    """
    kept, buckets = sample
    own = authorships.where("author_id is not null and cast(author_id as string) <> '' and work_id is not null").select("author_id", "work_id")
    own = own.where(C.md5_bucket(F.col("author_id"), buckets) < kept) if kept < buckets else own
    fit = works.where(F.col("pub_year").between(first_year, last_year) & F.col("type").isin(types)).select("work_id")
    rows = own.join(fit, "work_id", "left_semi").distinct()
    authors = rows.groupBy("author_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_works).select("author_id")
    if max_authors is not None:
        authors = authors.orderBy("author_id").limit(max_authors)
    return rows.join(authors, "author_id", "left_semi").select("author_id", "work_id")


def exposure(totals: DataFrame, cby: DataFrame, edges: DataFrame, start: int, end: int, min_age: int = 0, min_priors: int = 0, include_self: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """author_id, work_id, year, cite_counts, unrelated, related, author_works, and columns of totals to keep.

    The stock at t of an author is the sum of cite_counts of all their works in
    years before t (from start and publication on). Only related works (the
    paper itself, those it cites or that cite it) are paired with a paper; the
    unrelated stock is the author's whole stock without theirs, so an author's
    history is never squared. A work's years are an array until the end: what is
    joined and summed is a row for each work, not for each of its years.
    """
    years = range(start, end + 1)
    zero = F.lit(0).cast("bigint")
    works = totals.select("author_id", "work_id", "pub_year", *(c for c in keep if c != "pub_year"))
    by_year = (F.coalesce(F.sum(F.when(F.col("year") == t, F.col("cite_counts"))), zero) for t in years)
    counted = cby.where(F.col("year").between(start, end)).groupBy("work_id").agg(F.array(*by_year).alias("own"))
    nodes = cut(works.join(counted, "work_id", "left").withColumn("own", F.coalesce("own", F.array(*(zero for _ in years)))))
    # most works that cite each other have different authors: those go before anything is doubled
    its = lambda work, author: nodes.select(F.col("work_id").alias(work), F.col("author_id").alias(author))
    same = edges.select("citing", "cited").join(its("citing", "a"), "citing").join(its("cited", "b"), "cited").where("a = b")
    if include_self:
        same = same.where("citing <> cited")
    pairs = same.select(F.col("citing").alias("work_id"), F.col("cited").alias("other")).union(same.select(F.col("cited").alias("work_id"), F.col("citing").alias("other"))).distinct()
    rows = stocks(nodes, pairs, start, end, min_age, min_priors, include_self)
    grid = rows.withColumn("year", F.explode(F.sequence(F.greatest(F.lit(start), F.col("pub_year") + min_age), F.lit(end))))
    at = lambda c: F.col(c)[F.col("year") - start].cast("bigint")
    return grid.select("author_id", "work_id", "year", at("own").alias("cite_counts"), F.greatest(at("whole") - at("related"), zero).alias("unrelated"), at("related").alias("related"), "author_works", *keep)


def stocks(nodes: DataFrame, pairs: DataFrame, start: int, end: int, min_age: int = 0, min_priors: int = 0, include_self: bool = True) -> DataFrame:
    """nodes with related, whole (arrays: before each year from start to end, of the related works and of all of the author) and author_works.

    nodes: author_id, work_id, pub_year, own (array: cites by year). pairs: work_id, other, distinct related works of one author.
    """
    years = range(start, end + 1)
    zero = F.lit(0).cast("bigint")
    begun = F.coalesce("pub_year", F.lit(start))
    dated = [F.when(begun <= t, F.col("own")[i]).otherwise(zero) for i, t in enumerate(years)]
    before = lambda c: F.array(*(reduce(lambda a, b: a + b, c[:i], zero) for i in range(len(years))))
    whole = nodes.groupBy("author_id").agg(F.count("*").alias("author_works"), *(F.sum(c).alias(f"_s{i}") for i, c in enumerate(dated)))
    whole = whole.select("author_id", "author_works", before([F.col(f"_s{i}") for i in range(len(years))]).alias("whole"))
    focal = nodes
    if min_priors:
        w = W.partitionBy("author_id").orderBy("pub_year").rangeBetween(W.unboundedPreceding, -1)
        focal = nodes.withColumn("p", F.count("*").over(w)).where(F.col("p") >= min_priors).drop("p")
    others = nodes.select(F.col("work_id").alias("other"), *(c.alias(f"_s{i}") for i, c in enumerate(dated)))
    near = pairs.join(others, "other").groupBy("work_id").agg(F.array(*(F.sum(f"_s{i}") for i in range(len(years)))).alias("near"))
    rows = focal.where(F.coalesce(F.col("pub_year") + min_age, F.lit(start)) <= end).join(near, "work_id", "left").join(whole, "author_id")
    related = before([F.coalesce(F.col("near")[i], zero) + (c if include_self else zero) for i, c in enumerate(dated)])
    return rows.withColumn("related", related).drop("near")


def screen(totals: DataFrame) -> DataFrame:
    """author_id, hit (the most cited work), top (its cites), total, priors, cited_priors, prior_cites: the author's works and those before the hit."""
    w = W.partitionBy("author_id")
    rows = totals.withColumn("r", F.row_number().over(w.orderBy(F.desc("cites"), "pub_year", "work_id"))).withColumn("hy", F.max(F.when(F.col("r") == 1, F.col("pub_year"))).over(w))
    prior = (F.col("r") > 1) & (F.col("pub_year") < F.col("hy"))
    first = lambda c: F.min(F.when(F.col("r") == 1, F.col(c)))
    return rows.groupBy("author_id").agg(first("work_id").alias("hit"), first("cites").alias("top"), F.sum("cites").alias("total"), F.count(F.when(prior, 1)).alias("priors"), F.count(F.when(prior & (F.col("cites") > 0), 1)).alias("cited_priors"), F.coalesce(F.sum(F.when(prior, F.col("cites"))), F.lit(0)).alias("prior_cites"))
