"""Matched controls and clusters of versions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import normalized_title, similar
from .ranks import cut, ranked


_ONE, _TWO = ["work_id", "author_id"], ["control", "control_author"]


def _hash(seed: int, column: str) -> Column:
    return F.md5(F.concat_ws("-", F.lit(seed), F.col(column).cast("string")))


def _own() -> Column:
    """If a pair is of one author; works without one are nobody's own."""
    return F.coalesce(F.col("author_id") == F.col("control_author"), F.lit(False))


def _assigned(left: DataFrame, free: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """work_id, author_id, control, control_author: as many pairs within keys as there can be.

    1. The n-th work of a cell meets the n-th candidate, both in the order of a hash.
    2. Works that met their own author meet each other's candidates: works in
       the order of authors, candidates in the opposite order. Of two authors that
       met themselves there, each would be before the other, so one author at most
       still does, and all that do in a cell are this author's.
    3. Each of these trades with another pair, or with a work or candidate without
       one, that isn't this author's on either side. Where there are none left, no
       other assignment makes more pairs.
    """
    cells = left.select(*keys).distinct()
    one = ranked(left.select(*keys, *_ONE).withColumn("_h", _hash(seed, "work_id")), keys, ["_h", "work_id"]).drop("_h")
    two = ranked(free.join(cells, keys, "left_semi").withColumn("_h", _hash(seed, "control")), keys, ["_h", "control"]).drop("_h")
    met = cut(one.join(two, [*keys, "rank"], "full").select(*keys, *_ONE, *_TWO))
    paired = F.col("work_id").isNotNull() & F.col("control").isNotNull()
    good, alone, bad = met.where(paired & ~_own()), met.where(~paired), met.where(paired & _own())
    if bad.isEmpty():
        return good.select(*_ONE, *_TWO)
    one = ranked(bad.select(*keys, *_ONE), keys, ["author_id", "work_id"])
    two = ranked(bad.select(*keys, *_TWO), keys, [F.desc("control_author"), "control"])
    again = cut(one.join(two, [*keys, "rank"]).select(*keys, *_ONE, *_TWO))
    good, bad = good.union(again.where(~_own())), again.where(_own())
    if bad.isEmpty():
        return good.select(*_ONE, *_TWO)
    whose = bad.select(*keys, F.col("author_id").alias("_a")).distinct()
    others = good.union(alone).join(whose, keys).where("coalesce(author_id <> _a, true) and coalesce(control_author <> _a, true)").drop("_a")
    others = others.withColumn("_p", paired.cast("int")).withColumn("_h", F.md5(F.concat_ws("-", F.lit(seed), F.col("work_id").cast("string"), F.col("control").cast("string"))))
    others = ranked(others, keys, ["_p", "_h", "work_id", "control"]).drop("_p", "_h")
    trades = ranked(bad, keys, ["work_id"]).select(*keys, "rank", F.struct(*_ONE, *_TWO).alias("x")).join(others.select(*keys, "rank", F.struct(*_ONE, *_TWO).alias("y")), [*keys, "rank"])
    trades = cut(trades.select("x", "y"))
    pair = lambda a, b: F.struct(*(F.col(f"{a}.{c}").alias(c) for c in _ONE), *(F.col(f"{b}.{c}").alias(c) for c in _TWO))
    made = trades.select(F.explode(F.array(pair("x", "y"), pair("y", "x"))).alias("z")).select("z.*").where("work_id is not null and control is not null")
    kept = good.join(trades.where("y.work_id is not null and y.control is not null").select("y.work_id"), "work_id", "left_anti")
    return kept.select(*_ONE, *_TWO).union(made)


def matched_controls(treated: DataFrame, pool: DataFrame, cell: list[str], topic: str | None = None, seed: int = 0) -> DataFrame:
    """treated with control and control_author: one for one, none twice, until no treated work has an eligible candidate left.

    A control has the treated work's cell (year, type), isn't treated itself and
    isn't by its author. It is sought within the topic first; then, for works
    without one, in the whole cell. Each time as many are matched as can be.
    Ranks come from range-sorted parts, so no cell is one task. Works and
    candidates with a null in their cell find nothing, with a null topic nothing
    within a topic; without an author they suit everyone. Ids are unique.
    """
    names = [*cell, *([topic] if topic else [])]
    free = pool.join(treated.select("work_id"), "work_id", "left_anti").select(F.col("work_id").alias("control"), F.col("author_id").alias("control_author"), *names)
    left, done = treated.select(*_ONE, *names), None
    for k, keys in enumerate(([names] if topic else []) + [cell]):
        found = cut(_assigned(left, free, keys, seed + k))
        done = found if done is None else done.union(found)
        left, free = (df.join(found.select(c), c, "left_anti") for df, c in ((left, "work_id"), (free, "control")))
    return treated.join(done.select("work_id", *_TWO), "work_id", "left").select(*treated.columns, *_TWO)


#: Characters of a gram. Titles this similar have an insertion or deletion for each tenth of their characters at most,
#: and each of these changes GRAM grams at most.
GRAM = 3
#: Titles of an author who has few: these meet pair by pair, which is less than the grams of each. Those of others meet by rare grams.
MANY_TITLES = 100


def _met_by_grams(titles: DataFrame, ratio: float, years: int) -> DataFrame:
    """a, b: what may be alike of the titles (tid, author_id, norm, years) of authors with many.

    With lengths n and m a ratio r needs r (n + m) / 2 characters in common, in
    order. So lengths differ by (2 - r) / r at most, and of a title's grams all
    but n - GRAM + 1 - c are in the other, c being what _shared says. Of each title,
    grams rare in its author's titles first, only a prefix is posted that such
    a pair can't miss; posts meet by author, gram and year.
    """
    grams = titles.where(f"length(norm) >= {GRAM}").select("tid", "author_id", F.length("norm").alias("n"), F.explode(F.expr(f"transform(sequence(1, length(norm) - {GRAM - 1}), i -> substring(norm, i, {GRAM}))")).alias("g"))
    tokens = grams.groupBy("tid", "author_id", "n", "g").agg(F.count("*").alias("k")).withColumn("k", F.explode(F.expr("sequence(1, k)")))
    often = tokens.groupBy("author_id", "g", "k").agg(F.count("*").alias("often")).where("often > 1")
    # how many grams two titles share at least, whatever the other's length
    least = F.greatest(F.lit(1), F.ceil(_shared(ratio) * F.col("n") - (GRAM - 1)))
    place = F.row_number().over(W.partitionBy("tid").orderBy(F.coalesce("often", F.lit(1)), "g", "k"))
    posts = tokens.join(often, ["author_id", "g", "k"], "left").withColumn("r", place).where(F.col("r") <= F.col("n") - (GRAM - 1) - least + 1).where("often > 1")
    posts = posts.join(titles.select("tid", "years"), "tid").select("author_id", "g", "k", "tid", "n", "years")
    one = posts.select("author_id", "g", "k", F.col("tid").alias("a"), "n", F.explode("years").alias("year"))
    near = F.array_distinct(F.flatten(F.expr(f"transform(years, y -> sequence(y - {years}, y + {years}))")))
    two = posts.select("author_id", "g", "k", F.col("tid").alias("b"), F.col("n").alias("m"), F.explode(near).alias("year"))
    return one.join(two, ["author_id", "g", "k", "year"]).where(f"a <> b and 2 * least(n, m) >= {ratio} * (n + m)").select("a", "b").distinct()


def _met_by_author(titles: DataFrame, ratio: float, years: int) -> DataFrame:
    """a, b: the same of the titles of authors with few. Each meets its author's others; of a title's grams no more may be missing in the other than _shared leaves."""
    spelt = titles.where("author_id is not null").withColumn("g", F.expr(f"if(length(norm) < {GRAM}, array(), array_distinct(transform(sequence(1, greatest(length(norm) - {GRAM - 1}, 1)), i -> substring(norm, i, {GRAM}))))"))
    one = spelt.select("author_id", F.col("tid").alias("a"), F.length("norm").alias("n"), F.col("years").alias("at"), F.col("g").alias("ga"))
    two = spelt.select("author_id", F.col("tid").alias("b"), F.length("norm").alias("m"), F.col("years").alias("bt"), F.col("g").alias("gb"))
    met = one.join(two, "author_id").where(f"a <> b and 2 * least(n, m) >= {ratio} * (n + m)").where(f"exists(at, y -> exists(bt, z -> abs(y - z) <= {years}))")
    missing = F.greatest(F.col("n") - (GRAM - 1), F.lit(0)) - F.greatest(F.ceil(_shared(ratio) * F.col("n") - (GRAM - 1)), F.lit(0))
    return met.where(F.size(F.array_except("ga", "gb")) <= missing).select("a", "b")


def _title_pairs(titles: DataFrame, ratio: float, years: int) -> DataFrame:
    """a, b: ids of different titles (tid, author_id, norm, years) of an author, of works not further apart than years, with a ratio of a to b."""
    many = cut(titles.groupBy("author_id").agg(F.count("*").alias("_k")).where(F.col("_k") > MANY_TITLES).select("author_id"))
    met = _met_by_author(titles.join(many, "author_id", "left_anti"), ratio, years)
    if not many.isEmpty():
        met = met.union(_met_by_grams(titles.join(many, "author_id", "left_semi"), ratio, years))
    own = titles.select("tid", "norm")
    pairs = met.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b")

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similar(u, v, ratio) for u, v in zip(x, y, strict=True)], dtype=bool)

    return pairs.where(alike("x", "y")).select("a", "b")


def version_clusters(works: DataFrame, ratio: float = 0.9, years: int = 1) -> DataFrame:
    """works (author_id, work_id, title, year, cites, doi) with leader: the first version of each.

    Works of an author go from the most cited on (nulls last, then by id); each
    joins the first cluster whose leader has its DOI, or a similar title and a year
    close by. So a leader is a work without an earlier leader beside it: in
    rounds, works that are the first of all that may still lead beside them
    become leaders, and those behind a leader join the first one. Works meet as
    classes of title and year and by DOI, never pair by pair, so an author with very
    many works is spread over tasks like any other.

    Works without an author are nobody's versions: each leads itself. A null year is
    close to none; null and empty DOIs are none; empty titles are alike. Ids are unique.
    """
    order = F.struct(F.col("cites").isNull().alias("none"), (-F.col("cites")).alias("less"), F.col("work_id").alias("id")).alias("ord")
    known = F.expr("author_id is not null and cast(author_id as string) <> ''")
    rows = cut(works.select("author_id", "work_id", "title", "year", "cites", "doi"))
    named = rows.where(known).select("author_id", "work_id", "year", F.when(F.col("doi") != "", F.col("doi")).alias("doi"), order, normalized_title(F.coalesce("title", F.lit(""))).alias("norm"))
    titles = cut(named.groupBy("author_id", "norm").agg(F.array_compact(F.collect_set("year")).alias("years")).withColumn("tid", F.monotonically_increasing_id()))
    nodes = cut(named.join(titles.select("author_id", "norm", "tid"), ["author_id", "norm"]).select("author_id", "work_id", F.when(F.col("year").isNotNull(), F.col("tid")).alias("tid"), "year", "doi", "ord"))
    same = titles.select(F.col("tid").alias("a"), F.col("tid").alias("b"))
    beside = same.union(_title_pairs(titles, ratio, years))
    classes = titles.select("tid", F.explode("years").alias("year"))
    near = beside.join(classes.toDF("a", "year"), "a").select("a", "year", "b", F.explode(F.expr(f"sequence(year - {years}, year + {years})")).alias("other"))
    near = cut(near.join(classes.toDF("b", "other"), ["b", "other"]))

    def first(some: DataFrame, of: DataFrame) -> DataFrame:
        """of with low: the first of some beside each work."""
        by_class = near.join(some.where("tid is not null").groupBy(F.col("tid").alias("b"), F.col("year").alias("other")).agg(F.min("ord").alias("o")), ["b", "other"]).groupBy(F.col("a").alias("tid"), "year").agg(F.min("o").alias("c"))
        by_doi = some.where("doi is not null").groupBy("author_id", "doi").agg(F.min("ord").alias("d"))
        return of.join(by_class, ["tid", "year"], "left").join(by_doi, ["author_id", "doi"], "left").withColumn("low", F.least("c", "d")).select(*of.columns, "low")

    open_, leaders = nodes, nodes.where("false")
    while True:
        begun = cut(first(open_.unionByName(leaders), open_).where("low is null or low >= ord").drop("low"))
        leaders = cut(leaders.unionByName(begun))
        rest = open_.join(begun.select("work_id"), "work_id", "left_anti").select(*open_.columns)
        open_ = cut(first(leaders, rest).where("low is null or low > ord").drop("low"))
        if open_.isEmpty():
            break
    led = first(leaders, nodes).select("work_id", F.coalesce(F.least("low", "ord"), "ord")["id"].alias("leader"))
    return rows.join(led, "work_id", "left").withColumn("leader", F.coalesce("leader", "work_id")).select(*rows.columns, "leader")


def _shared(ratio: float) -> float:
    """Grams, by the length of a title, that a title with the ratio shares with it, but for the GRAM - 1 that no title of its length has.

    Of n and m characters c = ratio (n + m) / 2 are common, n - c and m - c aren't. The former change
    GRAM grams each, the latter GRAM - 1, and m is ratio / (2 - ratio) of n at least:
    n - GRAM (n - c) - (GRAM - 1) (m - c) = (2 GRAM - 1) c - (GRAM - 1) (n + m) is what is left.
    """
    return ((2 * GRAM - 1) * ratio / 2 - (GRAM - 1)) * (1 + ratio / (2 - ratio))


def pre_trend(panel: DataFrame, unit: list[str]) -> DataFrame:
    """unit, slope of cites before the event."""
    return panel.where("event_time < 0").groupBy(*unit).agg(F.regr_slope(F.col("cite_counts").cast("double"), F.col("event_time").cast("double")).alias("slope"))
