"""Every query of the scholarly engine over the star schema, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import columns as C
from ..operators import cite_counts as O
from ..operators import events as E
from ..operators import matching as M
from ..operators import normalize as N
from ..operators import panels as P
from ..operators import regression as R
from ..operators.ranks import cut, handed_on, passing
from ..session import shared_folder
from ..sources import bucketed, readers, sinks
from ..streaming import incremental
from . import bridge as B

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Hits of the synthetic data are small.
HIT = {"min_cites": 10, "min_share": 0.15, "min_works": 4, "min_priors": 1, "min_age": 1, "first_year": 1990}
WINDOW = 2
START, END = 1995, 2001
#: Micro-batches in which a5 takes in its references.
BATCHES = 8


def query(sql: str | None = None, bridge: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (B.SQL + sql) if bridge else sql
        return f

    return add


def r6(c) -> F.Column:
    return F.round(c, 6)


def long(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# --- sources and normalisation ------------------------------------------------


def json_works(spark: SparkSession, d: str) -> DataFrame:
    """value: orders as nested JSON documents."""
    w = B.t(spark, d, "orders").join(B.t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    # by order at once: a task that collects what it reads sorts all of it, and hardly any two of its lines share an order
    line = B.t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").repartition("l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey"))).alias("lines"))
    return w.join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.to_json(
            F.struct(
                F.concat(F.lit("https://x.example/W"), "o_orderkey").alias("id"),
                F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("Order "), "o_orderkey")).alias("display_name"),
                F.concat(F.lit("Title "), "o_orderkey").alias("title"),
                F.year("o_orderdate").alias("publication_year"),
                F.col("o_orderpriority").alias("type"),
                F.col("o_totalprice").alias("cited_by_count"),
                F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderkey").cast("string")).alias("fwci"),
                F.struct(F.col("o_orderstatus").alias("id"), F.struct(F.concat(F.lit("fields/"), "c_nationkey").alias("id"), F.col("c_mktsegment").alias("display_name")).alias("field")).alias("primary_topic"),
                F.expr("transform(lines, x -> named_struct('author_position', 'any', 'author', named_struct('id', if(x.l_linenumber = 2, null, concat('A', x.l_suppkey)), 'display_name', concat('Supplier ', x.l_suppkey))))").alias("authorships"),
                F.expr("transform(lines, x -> concat('P', x.l_partkey))").alias("referenced_works"),
            )
        ).alias("value")
    )


def raw_works(spark: SparkSession, d: str, only: tuple[str, ...] = ()) -> DataFrame:
    """These documents, read again with the declared schema."""
    return readers.parse_works(json_works(spark, d), only=only)


def kept_works(raw: DataFrame) -> DataFrame:
    return N.works(raw).where(N.of_type(["1-URGENT", "2-HIGH", "5-LOW"])).select("work_id", "title", "publication_year", "type", "cited_by_count", "fwci", "field_id", "field_name", "referenced_works_count")


@query(
    """select 'https://x.example/W' || o_orderkey as work_id, case when o_orderkey % 3 = 0 then 'Title ' else 'Order ' end || o_orderkey as title, cast(year(o_orderdate) as int) as publication_year, o_orderpriority as type, cast(trunc(o_totalprice) as bigint) as cited_by_count, case when o_orderkey % 5 = 0 then null else cast(o_orderkey as double) end as fwci, 'fields/' || c_nationkey as field_id, c_mktsegment as field_name, cast(coalesce(n, 0) as bigint) as referenced_works_count from orders join customer on c_custkey = o_custkey left join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey where o_orderpriority in ('1-URGENT', '2-HIGH', '5-LOW')""",
    bridge=False,
)
def q1_normalize_works(spark, d):
    return kept_works(raw_works(spark, d, N.OF_WORKS))


@query(
    """select work_id, author_id, author_name, cast(s as int) as author_sequence from (select 'https://x.example/W' || l_orderkey as work_id, 'A' || l_suppkey as author_id, 'Supplier ' || l_suppkey as author_name, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey) as s from lineitem join orders on o_orderkey = l_orderkey) where l_linenumber <> 2""",
    bridge=False,
)
def p2_authorship_unnest(spark, d):
    return N.work_authors(raw_works(spark, d)).select("work_id", "author_id", "author_name", "author_sequence")


@query("""select table_name, subject, cast(count(*) as bigint) as n from (select 'works' as table_name, o_orderkey as k from orders join customer on c_custkey = o_custkey union all select 'work_authors', l_orderkey from lineitem join orders on o_orderkey = l_orderkey where l_linenumber <> 2
union all select 'work_references', k from (select distinct l_orderkey as k, l_partkey from lineitem join orders on o_orderkey = l_orderkey)) join orders on o_orderkey = k join (select c_custkey, regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', '_', 'g') as subject from customer) on c_custkey = o_custkey group by all""", bridge=False)
def q1_one_pass(spark, d):
    """All tables by subject from one pass over the nested works, read again from where they were written."""
    path = f"{shared_folder(spark)}/normalized-{uuid.uuid4().hex}"
    N.write_normalized(raw_works(spark, d), path)
    return reduce(DataFrame.unionByName, (N.read_normalized(spark, path, k).groupBy("subject").agg(F.count("*").alias("n")).withColumn("table_name", F.lit(k)) for k in N.TABLES))


@query("""select 'https://x.example/W' || l_orderkey as work_id, count(*) as listed, count(distinct l_partkey) as distinct_refs from lineitem join orders on o_orderkey = l_orderkey group by 1""", bridge=False)
def p4_p5_reference_unnest(spark, d):
    raw = raw_works(spark, d)
    every = N.work_references(raw, dedupe=False).groupBy("work_id").agg(F.count("*").alias("listed"))
    once = N.work_references(raw).groupBy("work_id").agg(F.count("*").alias("distinct_refs"))
    return every.join(once, "work_id")


@query("""select regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', '_', 'g') as subject, cast(count(*) as bigint) as works from orders join customer on c_custkey = o_custkey where c_nationkey in (1, 2, 3) or lower(c_mktsegment) = 'building' group by 1""", bridge=False)
def q2_subject_slugs(spark, d):
    raw = raw_works(spark, d).where(N.in_field(["1", "2", "3"], ["Building"]))
    return raw.groupBy(C.slugify(F.col("primary_topic.field.display_name")).alias("subject")).agg(F.count("*").alias("works"))


@query("select page_id, list_last(string_split(url, '/')) as segment, doc_title from (select page_id, url, array_to_string(regexp_extract_all(lower(url), '[a-z0-9]+'), ' ') as doc_title from pages)", bridge=False)
def f_strings(spark, d):
    return B.t(spark, d, "pages").select("page_id", C.last_segment(F.col("url")).alias("segment"), C.normalized_title(F.col("url")).alias("doc_title"))


@query("select event_id, cast(json_extract_string(props, '$.k') as varchar) as k, coalesce(json_extract_string(props, '$.none'), 'unknown') as other from events", bridge=False)
def f_json_default(spark, d):
    get = lambda path: F.get_json_object("props", path)
    return B.t(spark, d, "events").select("event_id", get("$.k").alias("k"), F.coalesce(get("$.none"), F.lit("unknown")).alias("other"))


@query("select l_orderkey, cast(coalesce(sum(v), 0) as bigint) as v from (select l_orderkey, case when l_quantity > 25 then cast(trunc(l_quantity) as bigint) else 0 end as v from lineitem) group by 1", bridge=False)
def f_int_or_zero(spark, d):
    text = F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("string")).otherwise(F.lit("n/a"))
    return B.t(spark, d, "lineitem").select("l_orderkey", C.int_or_zero_json(text).alias("v")).groupBy("l_orderkey").agg(F.sum("v").alias("v"))


# --- cites, sets, joins ---------------------------------------------------


@query("select work_id, year, cite_counts from cby")
def q3_calculated_cite_counts(spark, d):
    return B.cite_counts(spark, d)


@query("select work_id, year, cite_counts from cby where work_id in (select work_id from works where subject = 'BUILDING')")
def j4_j5_target_cite_counts(spark, d):
    w = B.works(spark, d)
    return O.calculated_cite_counts(B.edges(spark, d), w.select("work_id", F.col("pub_year").alias("year")), w.where("subject = 'BUILDING'"))


def _dated_edges(spark, d, root: str) -> None:
    dated = B.edges(spark, d).join(B.works(spark, d).select(F.col("work_id").alias("citing"), F.col("pub_year").alias("year")), "citing")
    dated.select("citing", "cited", "year").write.parquet(f"{root}/in")


@query("select work_id, year, cite_counts from cby")
def k14_streamed_cite_counts(spark, d):
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    _dated_edges(spark, d, root)
    incremental.ingest_references(spark, f"{root}/in", f"{root}/out", f"{root}/state")
    return incremental.counted(spark, f"{root}/out")


@query("select work_id, year, cite_counts from cby")
def a5_running_cite_counts(spark, d):
    """Counts kept batch by batch, compacted halfway; a larger input has more files to a batch, not more batches."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    _dated_edges(spark, d, root)
    files = len(readers.files(spark, f"{root}/in/*.parquet"))
    incremental.count_references(spark, f"{root}/in", f"{root}/out", f"{root}/state", max(1, -(-files // BATCHES)))
    incremental.compact_counts(spark, f"{root}/out")
    return incremental.running_counts(spark, f"{root}/out")


@query("select author_id, work_id from (select distinct a.author_id, a.work_id from authorships a join works w using (work_id) where pub_year between 1995 and 1997 and type in ('1-URGENT', '3-MEDIUM') and cast(concat('0x', substr(md5(cast(a.author_id as varchar)), 1, 8)) as bigint) % 10 < 6) where author_id in (select a.author_id from authorships a join works w using (work_id) where pub_year between 1995 and 1997 and type in ('1-URGENT', '3-MEDIUM') and cast(concat('0x', substr(md5(cast(a.author_id as varchar)), 1, 8)) as bigint) % 10 < 6 group by 1 having count(distinct a.work_id) >= 3 order by 1 limit 40)")
def j2_sampled_authorships(spark, d):
    return P.sampled_authorships(B.authorships(spark, d), B.works(spark, d), 1995, 1997, ["1-URGENT", "3-MEDIUM"], 3, 40, (6, 10))


@query("select subject, w.pub_year as publication_year, cast(c.year - w.pub_year as int) as paper_age, cast(sum(cite_counts) as bigint) as cite_counts, count(*) as n from cby c join works w using (work_id) where w.pub_year between 1996 and 1999 group by all")
def j1_cite_panel(spark, d):
    w = B.works(spark, d).where(F.col("pub_year").between(1996, 1999))
    return B.cite_counts(spark, d).join(w, "work_id").groupBy("subject", F.col("pub_year").alias("publication_year"), (F.col("year") - F.col("pub_year")).alias("paper_age")).agg(F.sum("cite_counts").alias("cite_counts"), F.count("*").alias("n"))


@query("select focal, cast(count(*) as bigint) as related from (select work_id as focal, work_id as other from works union select citing, cited from edges union select cited, citing from edges) group by 1")
def u1_related_pairs(spark, d):
    return O.related_pairs(B.edges(spark, d), B.works(spark, d)).groupBy("focal").agg(F.count("*").alias("related"))


@query("select a.work_id as focal, b.work_id as prior from works a join works b on a.author_id = b.author_id and b.pub_year < a.pub_year where not exists (select 1 from edges e where e.citing = a.work_id and e.cited = b.work_id) and a.subject = 'BUILDING'")
def j9_j11_unrelated_priors(spark, d):
    w = B.works(spark, d)
    a = w.where("subject = 'BUILDING'").select("author_id", F.col("work_id").alias("focal"), F.col("pub_year").alias("fy"))
    b = w.select("author_id", F.col("work_id").alias("prior"), F.col("pub_year").alias("py"))
    e = B.edges(spark, d).select(F.col("citing").alias("focal"), F.col("cited").alias("prior"))
    return a.join(b, "author_id").where("py < fy").join(e, ["focal", "prior"], "left_anti").select("focal", "prior")


@query("select work_id from works w where (select count(distinct p.work_id) from works p where p.author_id = w.author_id and p.pub_year < w.pub_year) >= 3")
def j24_three_priors(spark, d):
    w = W.partitionBy("author_id").orderBy("pub_year").rangeBetween(W.unboundedPreceding, -1)
    return B.works(spark, d).withColumn("p", F.count("*").over(w)).where("p >= 3").select("work_id")


@query("select work_id, cast(coalesce(sum(cite_counts), 0) as bigint) as cites from works left join cby using (work_id) group by 1")
def j16_dense_totals(spark, d):
    return B.totals(spark, d).select("work_id", "cites")


@query("select author_id from works where subject = 'BUILDING' and pub_year = 1995 intersect select author_id from works where pub_year = 2000 order by 1")
def u4_intersection(spark, d):
    w = B.works(spark, d)
    return w.where("subject = 'BUILDING' and pub_year = 1995").select("author_id").intersect(w.where("pub_year = 2000").select("author_id"))


@query("select work_id from works where work_id not in (select cited from edges)")
def u5_difference(spark, d):
    return B.works(spark, d).join(B.edges(spark, d).select(F.col("cited").alias("work_id")), "work_id", "left_anti").select("work_id")


@query("select sample, cast(count(*) as bigint) as n, cast(sum(cites) as bigint) as cites from (select 'all' as sample, cites from totals union all select 'cited', cites from totals where cites > 0 union all select 'hit', cites from totals where cites >= 10) group by 1")
def u2_overlapping_samples(spark, d):
    labels = F.explode(F.filter(F.array(F.lit("all"), F.when(F.col("cites") > 0, F.lit("cited")), F.when(F.col("cites") >= 10, F.lit("hit"))), lambda x: x.isNotNull()))
    return B.totals(spark, d).withColumn("sample", labels).groupBy("sample").agg(F.count("*").alias("n"), F.sum("cites").alias("cites"))


# --- aggregates and windows ---------------------------------------------------


@query("select author_id, cast(count(*) as bigint) as works, cast(sum(cites) as bigint) as cites, max(cites) / nullif(sum(cites), 0) as top_share from totals group by 1")
def a1_author_totals(spark, d):
    return B.totals(spark, d).groupBy("author_id").agg(F.count("*").alias("works"), F.sum("cites").alias("cites"), C.split_share(F.max("cites"), F.sum("cites")).alias("top_share"))


@query("select author_id, count(distinct work_id) as works, cast(count(*) filter (where author_position = 'first') as bigint) as first_author, cast(sum(case when author_position = 'sole' then 1 else 0 end) as bigint) as sole from authorships group by 1")
def a2_a7_author_positions(spark, d):
    return B.authorships(spark, d).groupBy("author_id").agg(F.count_distinct("work_id").alias("works"), F.count(F.when(F.col("author_position") == "first", 1)).alias("first_author"), F.sum(F.when(F.col("author_position") == "sole", 1).otherwise(0)).alias("sole"))


@query("select subject, year, cast(count(*) as bigint) as n, cast(sum(cite_counts) as bigint) as cite_counts from cby join works using (work_id) group by 1, 2")
def a3_year_summary(spark, d):
    return B.cite_counts(spark, d).join(B.works(spark, d).select("work_id", "subject"), "work_id").groupBy("subject", "year").agg(F.count("*").alias("n"), F.sum("cite_counts").alias("cite_counts"))


@query("select author_id, cast(count(distinct work_id) as bigint) as works from works where type in ('1-URGENT', '5-LOW') group by 1 having count(distinct work_id) >= 3 order by author_id limit 50")
def a6_o2_author_cap(spark, d):
    return B.works(spark, d).where(F.col("type").isin("1-URGENT", "5-LOW")).groupBy("author_id").agg(F.count_distinct("work_id").alias("works")).where("works >= 3").orderBy("author_id").limit(50)


@query("select work_id, author_id, bucket from (select work_id, author_id, cast(concat('0x', substr(md5(cast(author_id as varchar)), 1, 8)) as bigint) % 10 as bucket from works) where bucket < 4")
def p16_hash_sample(spark, d):
    return B.works(spark, d).select("work_id", "author_id", C.md5_bucket(F.col("author_id"), 10).alias("bucket")).where("bucket < 4")


@query("select paper_bin, cast(count(*) as bigint) as n from (select case when year - pub_year < 0 then 'pre_publication' when year - pub_year <= 2 then '0-2' when year - pub_year <= 5 then '3-5' when year - pub_year <= 10 then '6-10' when year - pub_year <= 20 then '11-20' else '21+' end as paper_bin from cby join works using (work_id)) group by 1")
def p12_age_bins(spark, d):
    return B.cite_counts(spark, d).join(B.works(spark, d), "work_id").groupBy(C.age_bin(F.col("year") - F.col("pub_year")).alias("paper_bin")).agg(F.count("*").alias("n"))


@query("select dimension, level, cast(count(*) as bigint) as n from (select 'age' as dimension, case when year - pub_year between 1 and 2 then '1-2' when year - pub_year >= 3 then '3+' else '0' end as level from cby join works using (work_id) union all select 'cohort', case when pub_year < 1998 then 'early' else 'late' end from cby join works using (work_id)) group by 1, 2")
def p13_group_masks(spark, d):
    age = F.col("year") - F.col("pub_year")
    labels = F.array(F.struct(F.lit("age").alias("dimension"), F.when(age.between(1, 2), "1-2").when(age >= 3, "3+").otherwise("0").alias("level")), F.struct(F.lit("cohort").alias("dimension"), F.when(F.col("pub_year") < 1998, "early").otherwise("late").alias("level")))
    return B.cite_counts(spark, d).join(B.works(spark, d), "work_id").select(F.inline(labels)).groupBy("dimension", "level").agg(F.count("*").alias("n"))


@query("select round(sum(y), 4) as total, round(max(y), 6) as top, round(sum(ln(1 + y)), 4) as logged from (select least(cast(cites as double), q) as y from totals, (select quantile_cont(cites, 0.99) as q from totals))")
def p18_p19_winsorized(spark, d):
    y = F.col("cites")
    return R.winsorize(B.totals(spark, d), ["cites"]).agg(F.round(F.sum(y), 4).alias("total"), r6(F.max(y)).alias("top"), F.round(F.sum(F.log1p(y)), 4).alias("logged"))


@query("select work_id, year, cite_counts, cast(sum(cite_counts) over (partition by work_id order by year rows between unbounded preceding and current row) as bigint) as cumulative from cby")
def w2_running_cite_counts(spark, d):
    return O.running(B.cite_counts(spark, d))


@query("select work_id, min(year) as crossing_year from (select work_id, year, sum(cite_counts) over (partition by work_id order by year rows between unbounded preceding and current row) as s from cby) where s >= 10 group by 1")
def w3_crossings(spark, d):
    return O.crossings(B.cite_counts(spark, d), 10)


@query("select author_id, work_id, cites, cast(r as int) as r from (select author_id, work_id, cites, row_number() over (partition by author_id order by cites desc, pub_year, work_id) as r from totals) where r <= 3")
def w6_top_works(spark, d):
    w = W.partitionBy("author_id").orderBy(F.desc("cites"), "pub_year", "work_id")
    return B.totals(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 3").select("author_id", "work_id", "cites", "r")


@query("select work_id, min(author_sequence) as author_sequence, min(author_id) as author_id from (select *, row_number() over (partition by work_id order by author_position = 'last' desc, author_sequence) as r from authorships) where r = 1 group by 1")
def w5_first_row(spark, d):
    w = W.partitionBy("work_id").orderBy(F.desc(F.col("author_position") == "last"), "author_sequence")
    return B.authorships(spark, d).withColumn("r", F.row_number().over(w)).where("r = 1").select("work_id", "author_sequence", "author_id")


@query("select b as bin, cast(count(*) as bigint) as n, round(avg(cites), 6) as x, round(avg(pub_year), 6) as y from (select cites, pub_year, cast(ntile(20) over (order by cites, work_id) as int) as b from totals) group by 1")
def w8_binned_means(spark, d):
    out = R.binned_means(B.totals(spark, d).select("work_id", "cites", "pub_year"), "cites", "pub_year", ["work_id"])
    return out.select("bin", "n", r6("x").alias("x"), r6("y").alias("y"))


@query("select work_id, year, change from (select work_id, year, cast(cite_counts - lag(cite_counts) over w as bigint) as change, year - lag(year) over w as gap from cby window w as (partition by work_id order by year)) where gap = 1")
def w9_first_differences(spark, d):
    out = R.first_differences(B.cite_counts(spark, d), ["work_id"], "year", ["cite_counts"])
    return out.select("work_id", "year", F.col("cite_counts").alias("change"))


@query("select work_id, cast(sum(cite_counts) as bigint) as cite_counts from (select c.*, c.year - w.pub_year as age from cby c join works w using (work_id)) where age in (1, 2, 3) group by 1 having count(distinct age) = 3")
def w10_complete_ages(spark, d):
    aged = B.cite_counts(spark, d).join(B.works(spark, d).select("work_id", "pub_year"), "work_id").withColumn("age", F.col("year") - F.col("pub_year"))
    return R.complete_ages(aged, ["work_id"], "age", [1, 2, 3]).groupBy("work_id").agg(F.sum("cite_counts").alias("cite_counts"))


@query("select work_id, round(cites - avg(cites) over (partition by author_id), 6) as demeaned from totals")
def w11_demeaned(spark, d):
    out = R.demean(B.totals(spark, d).select("work_id", "author_id", F.col("cites").cast("double").alias("cites")), ["cites"], "author_id")
    return out.select("work_id", r6("cites").alias("demeaned"))


@query("select cast(pub_year as varchar) as level, cast(count(*) as bigint) as n from works group by 1 order by 1")
def o5_string_order(spark, d):
    return B.works(spark, d).groupBy(F.col("pub_year").cast("string").alias("level")).agg(F.count("*").alias("n")).orderBy("level")


@query("select work_id, cast(change as bigint) as change from (select work_id, max(case when year = 1999 then cite_counts end) - max(case when year = 1998 then cite_counts end) as change from cby group by 1) where change is not null order by abs(change) desc, work_id limit 15")
def o7_largest_changes(spark, d):
    at = lambda y: F.max(F.when(F.col("year") == y, F.col("cite_counts")))
    return B.cite_counts(spark, d).groupBy("work_id").agg((at(1999) - at(1998)).alias("change")).where("change is not null").orderBy(F.desc(F.abs("change")), "work_id").limit(15)


@query("select author_id, share_at, min_total, cast(n as bigint) as n from (select author_id, cast(s.v as double) as share_at, t.v as min_total, count(*) as n from (select author_id, work_id, cites / nullif(sum(cites) over (partition by author_id), 0) as share, sum(cites) over (partition by author_id) as total from totals) x, (values (0.2), (0.3), (0.5)) s(v), (values (50), (100)) t(v) where share >= cast(s.v as double) and total >= t.v group by all)")
def a32_parameter_grid(spark, d):
    grid = F.explode(F.array(*(F.struct(F.lit(s).alias("share_at"), F.lit(m).alias("min_total")) for s in (0.2, 0.3, 0.5) for m in (50, 100))))
    s = P.author_stats(B.totals(spark, d)).withColumn("g", grid).where("share >= g.share_at and author_cites >= g.min_total")
    return s.groupBy("author_id", F.col("g.share_at"), F.col("g.min_total")).agg(F.count("*").alias("n"))


# --- hits, panels, event studies ----------------------------------------------

_PAIRS = f"""stats as (select *, count(*) over (partition by author_id) as author_works, cites / nullif(sum(cites) over (partition by author_id), 0) as share from totals),
pairs0 as (select h.author_id, h.work_id as hit, h.pub_year as hit_year, h.cites as hit_cites, h.share, f.work_id as focal, f.pub_year as focal_year from stats h join totals f on f.author_id = h.author_id and f.work_id <> h.work_id and f.pub_year <= h.pub_year - {HIT["min_age"]} where h.cites >= {HIT["min_cites"]} and h.share >= {HIT["min_share"]} and h.author_works >= {HIT["min_works"]} and not exists (select 1 from edges e where e.citing = h.work_id and e.cited = f.work_id)),
pairs as (select * from (select *, count(*) over (partition by author_id, hit) as priors from pairs0) where priors >= {HIT["min_priors"]}),
panel as (select p.*, p.hit_year + e as year, e as event_time, case when p.hit_year + e < focal_year then 0 else c.cite_counts end as cite_counts, case when p.hit_year + e < focal_year or c.cite_counts is not null then 1 else 0 end as observed from pairs p cross join (select unnest(range(-{WINDOW}, {WINDOW} + 1)) as e) left join cby c on c.work_id = p.focal and c.year = p.hit_year + e)
"""


def pairs(spark, d):
    totals, _, edges = B.model(spark, d)
    return P.hit_pairs(totals, edges, **HIT)


def hit_panel(spark, d, zero_fill=False, model=None):
    totals, counts, edges = model or B.model(spark, d)
    return P.balanced(P.hit_pairs(totals, edges, **HIT), counts, WINDOW, zero_fill)


@query("," + _PAIRS + "select author_id, hit, hit_year, hit_cites, round(share, 8) as share, cast(count(*) as bigint) as priors from pairs group by all")
def q4_hit_events(spark, d):
    return P.hit_events(pairs(spark, d)).withColumn("share", F.round("share", 8))


@query("," + _PAIRS + "select author_id, hit, printf('%.8f', share) as share, cast(count(*) as bigint) as priors from pairs group by author_id, hit, pairs.share order by round(pairs.share, 8) desc, max(hit_cites) desc, hit limit 100")
def q5_hit_listing(spark, d):
    out = P.hit_events(pairs(spark, d)).orderBy(F.desc(F.round("share", 8)), F.desc("hit_cites"), "hit").limit(100)
    return out.select("author_id", "hit", F.format_string("%.8f", "share").alias("share"), "priors")


@query("," + _PAIRS + "select author_id, hit, focal, cast(event_time as int) as event_time, cast(year as int) as year, cite_counts, cast(observed as int) as observed, cast(case when event_time >= 0 then 1 else 0 end as int) as post_hit from panel")
def q6_hit_panel(spark, d):
    return hit_panel(spark, d).select("author_id", "hit", "focal", "event_time", "year", "cite_counts", "observed", (F.col("event_time") >= 0).cast("int").alias("post_hit"))


@query(f"select w.work_id, w.author_id, cast(y as int) as year, cast(y - pub_year as int) as paper_age, cast(coalesce(cite_counts, 0) as bigint) as cite_counts from (select *, unnest(range(pub_year, greatest({END}, pub_year) + 1)) as y from works) w left join cby c on c.work_id = w.work_id and c.year = y")
def q7_lifetime_panel(spark, d):
    return P.lifetime(B.works(spark, d), B.cite_counts(spark, d), END)


@query(f"select w.work_id, w.author_id, cast(y as int) as year, cast(y - pub_year as int) as paper_age, cast(coalesce(cite_counts, 0) as bigint) as cite_counts from (select *, unnest(range(pub_year, greatest({END}, pub_year) + 1)) as y from works) w left join cby c on c.work_id = w.work_id and c.year = y")
def j7_bucketed_panel(spark, d):
    """The lifetime panel from tables bucketed by work: their join moves no rows."""
    name = f"t{uuid.uuid4().hex}"
    for part, df in (("works", B.works(spark, d).select("work_id", "author_id", "pub_year")), ("years", P.yearly(B.cite_counts(spark, d)))):
        bucketed.write_bucketed(df, f"{name}_{part}", "work_id", f"{shared_folder(spark)}/{name}/{part}", 16)
    return P.lifetime_by_work(*(bucketed.bucketed(spark, f"{name}_{part}") for part in ("works", "years")), END)


_EXPOSURE = f"""grid as (select author_id, work_id, pub_year, unnest(range(greatest({START}, pub_year), {END} + 1)) as t from works),
hist as (select w.author_id, c.work_id, c.year, c.cite_counts from cby c join works w using (work_id) where c.year >= greatest({START}, w.pub_year)),
rel as (select work_id as focal, work_id as other from works union select citing, cited from edges union select cited, citing from edges),
relh as (select g.work_id, g.t, sum(h.cite_counts) as s from grid g join rel r on r.focal = g.work_id join hist h on h.work_id = r.other and h.author_id = g.author_id and h.year < g.t group by 1, 2),
allh as (select g.author_id, g.t, sum(h.cite_counts) as s from (select distinct author_id, t from grid) g join hist h on h.author_id = g.author_id and h.year < g.t group by 1, 2),
exposure as (select g.author_id, g.work_id, cast(g.t as int) as year, cast(coalesce(c.cite_counts, 0) as bigint) as cite_counts, cast(greatest(coalesce(a.s, 0) - coalesce(r.s, 0), 0) as bigint) as unrelated, cast(coalesce(r.s, 0) as bigint) as related, count(*) over (partition by g.author_id, g.t) as k from grid g left join cby c on c.work_id = g.work_id and c.year = g.t left join allh a on a.author_id = g.author_id and a.t = g.t left join relh r on r.work_id = g.work_id and r.t = g.t)
"""


def exposures(spark, d, *keep):
    return P.exposure(*B.model(spark, d), START, END, keep=keep)


def _aged(spark, d, *keep):
    """What the fits read of the exposures, written once, with the paper's age."""
    rows = exposures(spark, d, *dict.fromkeys(("pub_year", *keep)))
    return cut(rows.select("work_id", "year", "cite_counts", "unrelated", "related", (F.col("year") - F.col("pub_year")).alias("age"), *keep))


def _histories(spark, d, *columns):
    """The same as a row for each work, with arrays by year: these of work_id, pub_year, cite_counts, unrelated, related. None where works have no keys of their own."""
    linked = B.histories(spark, d, START, END)
    if linked is None:
        return None
    rows = P.stocks(*linked, START, END).where("work_id is not null")
    unrelated = F.array(*(F.greatest(F.col("whole")[i] - F.col("related")[i], F.lit(0).cast("bigint")) for i in range(END - START + 1)))
    return rows.withColumns({"cite_counts": F.col("own"), "unrelated": unrelated}).select(*columns)


def _cells(t, ages=False):
    """Of a task's histories: matrices by work and year, and which years a work has (and an age, if ages count)."""
    years = np.arange(START, END + 1)
    born = np.asarray(t["pub_year"], float)[:, None]  # NaN where it's not known
    out = {c: t[c].astype(float) for c in ("cite_counts", "unrelated", "related") if c in t}
    counts = (years >= born) | (np.isnan(born) & (not ages))
    age = np.where(np.isnan(born), 0, years - np.nan_to_num(born)).astype(int)
    return {**out, "year": np.broadcast_to(years, counts.shape), "age": age}, counts


def _aged_cells(t):
    return _cells(t, ages=True)


def _logged_cells(t):
    made, counts = _aged_cells(t)
    return {**made, **{c: np.log1p(made[c]) for c in ("cite_counts", "unrelated")}}, counts


def _moved_cells(t):
    """Changes from one year to the next."""
    made, counts = _aged_cells(t)
    return {**{c: np.diff(made[c]) for c in ("cite_counts", "unrelated")}, **{c: made[c][:, 1:] for c in ("year", "age")}}, counts[:, 1:] & counts[:, :-1]


@query("," + _EXPOSURE + "select author_id, work_id, year, cite_counts, unrelated, related, aw as author_works from exposure join (select author_id, count(*) as aw from works group by 1) using (author_id)")
def q8_exposure_panel(spark, d):
    return exposures(spark, d)


@query(
    "," + _EXPOSURE + ", priors as (select work_id, count(*) over (partition by author_id order by pub_year range between unbounded preceding and 1 preceding) as p from works) "
    "select e.author_id, e.work_id, e.year, cite_counts, unrelated, related, aw as author_works from exposure e join (select author_id, count(*) as aw from works group by 1) using (author_id) join works w using (work_id) join priors using (work_id) where p >= 2 and e.year >= w.pub_year + 1 and cast(concat('0x', substr(md5(cast(e.author_id as varchar)), 1, 8)) as bigint) % 250 < 40"
)
def q8_exposure_sample(spark, d):
    """The exposure panel of a hash sample of authors, for papers with two earlier ones of their author, from the year after publication on."""
    totals, counts, edges = B.model(spark, d)
    return P.exposure(totals.where(C.md5_bucket(F.col("author_id"), 250) < 40), counts, edges, START, END, min_age=1, min_priors=2)


@query("," + _EXPOSURE + ", m as (select year, cite_counts - avg(cite_counts) over (partition by work_id) as y, unrelated - avg(unrelated) over (partition by work_id) as x from exposure) select cast(count(*) as bigint) as n, round(sum(x * y) / sum(x * x), 6) as beta from m")
def r1_one_way_effects(spark, d):
    with passing(spark):
        fit = R.fixed_effects(_aged(spark, d), "cite_counts", ["unrelated"], ["work_id"], "work_id")
    return spark.createDataFrame([(fit.n, round(fit.beta[0], 6))], "n bigint, beta double")


def _swept(kept: str, dummies: list[str], columns: tuple[str, ...], name: str) -> str:
    """Tables up to <name>: of <name>_0, by v, the columns without one dummy after the other (Gram-Schmidt)."""
    out = []
    for k, d in enumerate(dummies):
        rest = [*columns, *dummies[k + 1 :]]
        share = ", ".join(f"case when sum({d} * {d}) > 1e-6 then sum({d} * {c}) / sum({d} * {d}) else 0 end as p_{c}" for c in rest)
        less = ", ".join(f"{c} - {d} * p_{c} as {c}" for c in rest)
        out.append(f"{name}_{k + 1} as materialized (select {kept}, {less} from {name}_{k} join (select v, {share} from {name}_{k} group by v) using (v))")
    return ", ".join([*out, f"{name} as (select * from {name}_{len(dummies)})"])


def _freed(source: str, dummies: list[str], columns: tuple[str, ...] = ("y", "x"), name: str = "t") -> str:
    """Tables up to <name>: of source (v, work_id, year, columns, dummies), all columns within v and work, then without the dummies."""
    within = ", ".join(f"{c} - avg({c}) over (partition by v, work_id) as {c}" for c in [*columns, *dummies])
    return f"{name}_0 as materialized (select v, work_id, year, {within} from {source}), " + _swept("v, work_id, year", dummies, columns, name)


_YEARS = [f"d{t}" for t in range(START + 1, END + 1)]
_YEAR = ", ".join(f"cast(year = {d[1:]} as int)::double as {d}" for d in _YEARS)
_SLOPES = "select v as variant, cast(count(*) as bigint) as n, round(sum(x * y) / sum(x * x), 6) as beta from {} group by v"


@query(
    "," + _EXPOSURE + f", full_ as (select 'all' as v, work_id, year, cite_counts::double as y, unrelated::double as u, related::double as r, {_YEAR} from exposure), "
    + _freed("full_", _YEARS, ("y", "u", "r"))
    + f""", m as (select count(*) as n, count(distinct work_id) as g, sum(y * y) as yy, sum(u * u) as uu, sum(r * r) as rr, sum(u * r) as ur, sum(u * y) as uy, sum(r * y) as ry, sum(u * u) * sum(r * r) - sum(u * r) ** 2 as det from t),
b as (select *, uy / uu as b1, (rr * uy - ur * ry) / det as b2, (uu * ry - ur * uy) / det as c2, n - g - (select count(distinct year) from full_) + 1 as free from m),
s as (select work_id, sum(u * (y - b1 * u)) as s1, sum(u * (y - b2 * u - c2 * r)) as su, sum(r * (y - b2 * u - c2 * r)) as sr, sum((y - b1 * u) ** 2) as e1, sum((y - b2 * u - c2 * r) ** 2) as e2 from t, b group by work_id),
q as (select sum(s1 * s1) as q1, sum(su * su) as quu, sum(sr * sr) as qrr, sum(su * sr) as qur, sum(e1) as e1, sum(e2) as e2 from s),
f as (select *, g / (g - 1) * (n - 1) / (free - 1) as f1, g / (g - 1) * (n - 1) / (free - 2) as f2 from b, q)
select 1::int as model, 'unrelated' as term, round(b1, 6) as beta, round(sqrt(f1 * q1) / uu, 6) as se, round(1 - e1 / yy, 6) as within_r2, n::bigint as n, g::bigint as clusters, true as converged from f
union all select 2, 'unrelated', round(b2, 6), round(sqrt(f2 * (rr * rr * quu - 2 * rr * ur * qur + ur * ur * qrr)) / det, 6), round(1 - e2 / yy, 6), n::bigint, g::bigint, true from f
union all select 2, 'related', round(c2, 6), round(sqrt(f2 * (ur * ur * quu - 2 * uu * ur * qur + uu * uu * qrr)) / det, 6), round(1 - e2 / yy, 6), n::bigint, g::bigint, true from f"""
)
def q9_two_way_effects(spark, d):
    """Models 1 (unrelated) and 2 (unrelated and related) with paper and year effects, errors by paper."""
    sets = [["unrelated"], ["unrelated", "related"]]
    fits = _unit_fits(spark, d, {"all": R.Design("cite_counts", sets, ["year"], _cells)}, "related")
    if fits is None:
        with passing(spark):
            fits = {"all": R.models(_aged(spark, d), "cite_counts", sets, ["work_id", "year"], "work_id")}
    rows = [(k, n, round(b, 6), round(s, 6), round(fit.within_r2, 6), fit.n, fit.groups, fit.converged) for k, fit in enumerate(fits["all"], 1) for n, b, s in zip(fit.names, fit.beta, fit.se, strict=True)]
    return spark.createDataFrame(rows, "model int, term string, beta double, se double, within_r2 double, n bigint, clusters bigint, converged boolean")


def _unit_fits(spark, d, designs, *more):
    """Fits over histories as rows, which are written once; None where works have no keys of their own, or levels are too many."""
    with passing(spark):
        rows = handed_on(spark, lambda: _histories(spark, d, "pub_year", "cite_counts", "unrelated", *more))
        return None if rows is None else R.unit_fits(rows, designs)


def _slopes(spark, fits):
    return spark.createDataFrame([(name, fit.n, round(fit.beta[0], 6)) for name, fit in fits], "variant string, n bigint, beta double")


@query(
    "," + _EXPOSURE + f""", base_ as (select e.work_id, e.year, cast(cite_counts as double) as y, cast(unrelated as double) as x, e.year - pub_year as age from exposure e join works using (work_id)), q as (select quantile_cont(y, 0.99) as qy, quantile_cont(x, 0.99) as qx from base_),
full_ as (select v, work_id, year, y, x, {_YEAR} from (select 'full' as v, work_id, year, y, x from base_
union all select 'balanced', work_id, year, y, x from base_ where age in (1, 2) and work_id in (select work_id from base_ where age in (1, 2) group by 1 having count(distinct age) = 2)
union all select 'outcome_winsorized', work_id, year, least(y, qy), x from base_, q union all select 'exposure_winsorized', work_id, year, y, least(x, qx) from base_, q
union all select 'all_winsorized', work_id, year, least(y, qy), least(x, qx) from base_, q)), """
    + _freed("full_", _YEARS) + _SLOPES.format("t")
)
def r7_variants(spark, d):
    """Paper and year effects in each variant, all absorbed together."""
    with passing(spark):
        data = _aged(spark, d)
        made = [df.select("work_id", "year", *(F.col(c).cast("double").alias(c) for c in ("cite_counts", "unrelated"))).withColumn("variant", F.lit(v)) for v, df in R.variants(data, "cite_counts", ["unrelated"], ["work_id"], "age", [1, 2]).items()]
        fits = R.split_models(reduce(DataFrame.unionByName, made), "cite_counts", [["unrelated"]], ["work_id", "year"], "work_id", "variant")
    return _slopes(spark, [(v, fit) for v, (fit,) in fits.items()])


@query(
    "," + _EXPOSURE + f", base_ as (select e.work_id, e.year, e.cite_counts::double as y, e.unrelated::double as x, subject, case when pub_year < 1998 then 'early' else 'late' end as cohort from exposure e join works using (work_id)), full_ as (select dimension || '|' || level as v, work_id, year, y, x, {_YEAR} from (select 'subject' as dimension, subject as level, * from base_ union all select 'cohort', cohort, * from base_)), "
    + _freed("full_", _YEARS) + "select split_part(v, '|', 1) as dimension, split_part(v, '|', 2) as level, cast(count(*) as bigint) as n, round(sum(x * y) / sum(x * x), 6) as beta from t group by v"
)
def r8_subgroups(spark, d):
    """Paper and year effects within each subject and cohort, absorbed anew for each, in one pass."""
    with passing(spark):
        data = _aged(spark, d, "subject", "pub_year")
        fits = R.by_group(data, {"subject": F.col("subject"), "cohort": F.when(F.col("pub_year") < 1998, "early").otherwise("late")}, "cite_counts", [["unrelated"]], ["work_id", "year"], "work_id")
    return spark.createDataFrame([(k, g, fit.n, round(fit.beta[0], 6)) for k, g, (fit,) in fits], "dimension string, level string, n bigint, beta double")


_AGES = [f"a{t}" for t in range(1, END - 1991)]
_AGE = ", ".join(f"cast(age = {a[1:]} as int)::double as {a}" for a in _AGES)


@query(
    "," + _EXPOSURE + f""", base_ as (select e.work_id, e.year, cite_counts::double as y, unrelated::double as x, e.year - pub_year as age from exposure e join works using (work_id)),
moved as (select work_id, year, age, y - lag(y) over w as y, x - lag(x) over w as x, year - lag(year) over w as gap from base_ window w as (partition by work_id order by year)),
one as (select 'levels' as v, work_id, year, y, x, {_YEAR} from base_), two as (select v, work_id, year, y, x, {_YEAR}, {_AGE} from (select 'levels_age' as v, * from base_ union all select 'log_age', work_id, year, ln(1 + y), ln(1 + x), age from base_)),
three as (select 'differences_age' as v, 0 as work_id, year, y, x, {_YEAR}, {_AGE} from moved where gap = 1), """
    + ", ".join((_freed("one", _YEARS, name="t1"), _freed("two", [*_YEARS, *_AGES], name="t2"), _freed("three", [*_YEARS, *_AGES], name="t3")))
    + " union all ".join(_SLOPES.format(t) for t in ("t1", "t2", "t3"))
)
def r9_effect_variants(spark, d):
    """Levels with paper and year effects; levels and logs with age effects too; differences with year and age effects."""
    own, x = ["cite_counts", "unrelated"], [["unrelated"]]
    kinds = {"levels": (["year"], _cells, True), "levels_age": (["year", "age"], _aged_cells, True), "log_age": (["year", "age"], _logged_cells, True), "differences_age": (["year", "age"], _moved_cells, False)}
    fits = _unit_fits(spark, d, {v: R.Design("cite_counts", x, *kind) for v, kind in kinds.items()})
    if fits is not None:
        return _slopes(spark, [(v, fit) for v, (fit,) in fits.items()])
    with passing(spark):
        data = _aged(spark, d)
        logged = data.withColumns({c: F.log1p(c) for c in own})
        aged = data.withColumn("v", F.lit("levels_age")).unionByName(logged.withColumn("v", F.lit("log_age")), allowMissingColumns=True)
        fits = R.split_models(aged, "cite_counts", x, ["work_id", "year", "age"], "work_id", "v")
        moved = cut(R.first_differences(data, ["work_id"], "year", own))
        made = [("levels", R.fixed_effects(data, "cite_counts", x[0], ["work_id", "year"], "work_id")), *((v, fit) for v, (fit,) in fits.items()), ("differences_age", R.fixed_effects(moved, "cite_counts", x[0], ["year", "age"], "work_id"))]
    return _slopes(spark, made)


@query("select round(regr_slope(cites, pub_year), 6) as slope, round(corr(cites, pub_year), 6) as correlation, round(power(corr(cites, pub_year), 2), 6) as r2, cast(count(*) as bigint) as n from totals")
def r3_cross_products(spark, d):
    with passing(spark):
        rows = cut(B.totals(spark, d).select(F.lit(1).alias("one"), F.col("cites").cast("double").alias("y"), F.col("pub_year").cast("double").alias("x")))
        data = R.demean(rows, ["y", "x"], "one")
        fit = R.ols(data, "y", ["x"])
        c = data.agg(F.corr("x", "y").alias("c")).first()["c"]
    return spark.createDataFrame([(round(fit.beta[0], 6), round(c, 6), round(fit.within_r2, 6), fit.n)], "slope double, correlation double, r2 double, n bigint")


_CROSSING = f"""cross_ as (select work_id as hit, min(year) as cy from (select work_id, year, sum(cite_counts) over (partition by work_id order by year rows between unbounded preceding and current row) as s from cby) where s >= 10 group by 1),
cpairs as (select w.author_id, x.hit, x.cy, f.work_id as focal, f.pub_year from cross_ x join works w on w.work_id = x.hit join works f on f.author_id = w.author_id and f.work_id <> x.hit and f.pub_year < w.pub_year where x.cy - {WINDOW} >= {START} and x.cy + {WINDOW} <= {END}),
cpanel as (select p.*, e as event_time, coalesce(c.cite_counts, 0) as cite_counts from cpairs p cross join (select unnest(range(-{WINDOW}, {WINDOW} + 1)) as e) left join cby c on c.work_id = p.focal and c.year = p.cy + e),
cdelta as (select *, cite_counts - max(case when event_time = -1 then cite_counts end) over (partition by hit, focal) as delta from cpanel)
"""


def crossing_panel(spark, d):
    w, cby = B.works(spark, d), cut(B.cite_counts(spark, d))
    x = O.crossings(cby, 10).where(F.col("crossing_year").between(START + WINDOW, END - WINDOW)).select(F.col("work_id").alias("hit"), F.col("crossing_year").alias("hit_year"))
    h = x.join(w.select(F.col("work_id").alias("hit"), "author_id", F.col("pub_year").alias("hy")), "hit")
    p = h.join(w.select("author_id", F.col("work_id").alias("focal"), F.col("pub_year").alias("fy")), "author_id").where("focal <> hit and fy < hy")
    grid = p.withColumn("event_time", F.explode(F.sequence(F.lit(-WINDOW), F.lit(WINDOW)))).withColumn("year", F.col("hit_year") + F.col("event_time"))
    out = grid.join(cby.withColumnRenamed("work_id", "focal"), ["focal", "year"], "left").withColumn("cite_counts", F.coalesce("cite_counts", F.lit(0)))
    return E.from_baseline(out, ["hit", "focal"], "cite_counts")


@query(
    "," + _CROSSING + ", g as (select event_time, author_id, sum(delta) as s, count(*) as c from cdelta group by 1, 2), m as (select event_time, sum(s) / sum(c) as mean, sum(c) as n, count(*) as g from g group by 1), v as (select g.event_time, sum(power(s - mean * c, 2)) as q from g join m using (event_time) group by 1) select cast(event_time as int) as event_time, cast(n as bigint) as n, cast(g as bigint) as clusters, round(mean, 6) as mean, round(sqrt(g / (g - 1) * q / (n * n)), 6) as se from m join v using (event_time)"
)
def q10_threshold_event_study(spark, d):
    return E.clustered_means(crossing_panel(spark, d), "delta", "author_id").select("event_time", "n", "clusters", r6("mean").alias("mean"), r6("se").alias("se"))


@query("," + _CROSSING + "select cast(event_time as int) as event_time, cast(count(distinct hit) as bigint) as hits, cast(count(distinct concat(hit, '|', focal)) as bigint) as pairs, round(avg(cite_counts), 6) as mean, round(avg(delta), 6) as delta from cdelta group by 1")
def q14_event_summary(spark, d):
    return crossing_panel(spark, d).groupBy("event_time").agg(F.count_distinct("hit").alias("hits"), F.count_distinct("hit", "focal").alias("pairs"), r6(F.avg("cite_counts")).alias("mean"), r6(F.avg("delta")).alias("delta"))


@query("," + _PAIRS + f", unit as (select p.focal, p.focal_year, p.hit_year, p.hit from pairs p) select {', '.join(f'cast(sum(case when c.year - u.hit_year = {k} then cite_counts else 0 end) as bigint) as t_{k + WINDOW}' for k in range(-WINDOW, WINDOW + 1))} from unit u join cby c on c.work_id = u.focal and c.year between u.hit_year - {WINDOW} and u.hit_year + {WINDOW}")
def q11_event_sums(spark, d):
    c = B.cite_counts(spark, d).withColumnRenamed("work_id", "focal")
    both = pairs(spark, d).join(c, "focal").where(F.col("year").between(F.col("hit_year") - WINDOW, F.col("hit_year") + WINDOW))
    return both.agg(*(F.sum(F.when(F.col("year") - F.col("hit_year") == k, F.col("cite_counts")).otherwise(0)).alias(f"t_{k + WINDOW}") for k in range(-WINDOW, WINDOW + 1)))


@query(
    "," + _PAIRS + f", life as (select w.work_id, y as year, y - pub_year as paper_age, type, coalesce(cite_counts, 0) as c from (select *, unnest(range(pub_year, {END} + 1)) as y from works) w left join cby c on c.work_id = w.work_id and c.year = y), bench as (select year, paper_age, type, avg(c) as expected from life group by 1, 2, 3), norm as (select p.author_id, p.event_time, coalesce(p.cite_counts, 0) as c, expected from panel p join works w on w.work_id = p.focal join bench b on b.year = p.year and b.paper_age = p.year - w.pub_year and b.type = w.type) select cast(event_time as int) as event_time, cast(count(*) as bigint) as n, round(avg(c - expected), 6) as excess, round(avg((c + 0.1) / (expected + 0.1)), 6) as smoothed, round(sum(c) / nullif(sum(expected), 0), 6) as observed_expected from norm group by 1"
)
def q12_normalized_excess(spark, d):
    w, model = B.works(spark, d), B.model(spark, d)
    c = model[1]
    life = P.lifetime(w, c, END).join(w.select("work_id", "type"), "work_id")
    bench = E.lifecycle_benchmark(life)
    p = hit_panel(spark, d, model=model).join(w.select(F.col("work_id").alias("focal"), "type"), "focal").withColumn("paper_age", F.col("year") - F.col("focal_year")).withColumn("c", F.coalesce("cite_counts", F.lit(0)))
    n = p.join(bench, ["year", "paper_age", "type"])
    return n.groupBy("event_time").agg(F.count("*").alias("n"), r6(F.avg(F.col("c") - F.col("expected"))).alias("excess"), r6(F.avg(C.smoothed_ratio(F.col("c"), F.col("expected")))).alias("smoothed"), r6(C.split_share(F.sum("c"), F.sum("expected"))).alias("observed_expected"))


@query("," + _PAIRS + ", a as (select event_time, author_id, avg(coalesce(cite_counts, 0)) as m from panel group by 1, 2) select cast(event_time as int) as event_time, cast(count(*) as bigint) as authors, round(avg(m), 6) as mean, round(stddev_samp(m) / sqrt(count(*)), 6) as se from a group by 1")
def a14_mean_of_author_means(spark, d):
    a = hit_panel(spark, d).groupBy("event_time", "author_id").agg(F.avg(F.coalesce("cite_counts", F.lit(0))).alias("m"))
    return a.groupBy("event_time").agg(F.count("*").alias("authors"), r6(F.avg("m")).alias("mean"), r6(F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("se"))


@query(
    "select author_id, cast(n as bigint) as works, cast(total as bigint) as total, top_work, cast(top as bigint) as top, cast(priors as bigint) as priors, cast(prior_cites as bigint) as prior_cites from (select author_id, count(*) as n, sum(cites) as total, min(work_id) filter (where r = 1) as top_work, max(cites) as top, count(*) filter (where r > 1 and pub_year < ty) as priors, coalesce(sum(cites) filter (where r > 1 and pub_year < ty), 0) as prior_cites from (select *, max(case when r = 1 then pub_year end) over (partition by author_id) as ty from (select *, row_number() over (partition by author_id order by cites desc, pub_year, work_id) as r from totals)) group by 1) where top > 0.15 * total and total >= 50 and priors >= 3"
)
def q13_big_hit_screen(spark, d):
    w = W.partitionBy("author_id")
    ranked = B.totals(spark, d).withColumn("r", F.row_number().over(w.orderBy(F.desc("cites"), "pub_year", "work_id"))).withColumn("ty", F.max(F.when(F.col("r") == 1, F.col("pub_year"))).over(w))
    prior = (F.col("r") > 1) & (F.col("pub_year") < F.col("ty"))
    out = ranked.groupBy("author_id").agg(F.count("*").alias("works"), F.sum("cites").alias("total"), F.min(F.when(F.col("r") == 1, F.col("work_id"))).alias("top_work"), F.max("cites").alias("top"), F.count(F.when(prior, 1)).alias("priors"), F.coalesce(F.sum(F.when(prior, F.col("cites"))), F.lit(0)).alias("prior_cites"))
    return out.where("top > 0.15 * total and total >= 50 and priors >= 3")


@query("select author_id, arg_max(work_id, (cites, work_id)) as best from totals group by 1")
def a9_best_work(spark, d):
    return B.totals(spark, d).groupBy("author_id").agg(F.max_by("work_id", F.struct("cites", "work_id")).alias("best"))


@query(
    "," + _PAIRS + ", lab as (select event_time, cite_counts, observed, cast(hit_year as varchar) as cohort, case when hit_year - focal_year <= 2 then '0-2' when hit_year - focal_year <= 5 then '3-5' else '6-10' end as bin, w.type as type from panel join works w on w.work_id = panel.focal) select dimension, level, cast(event_time as int) as event_time, cast(count(*) as bigint) as rows, cast(sum(observed) as bigint) as observed, cast(count(*) - sum(observed) as bigint) as missing, round(avg(coalesce(cite_counts, 0)), 6) as mean_zero, round(avg(case when observed = 1 then cite_counts end), 6) as mean_observed from (select 'event_time' as dimension, '' as level, * from lab union all select 'cohort', cohort, * from lab union all select 'bin', bin, * from lab union all select 'type', type, * from lab) group by 1, 2, 3"
)
def q15_event_cells(spark, d):
    p = hit_panel(spark, d).withColumn("cohort", F.col("hit_year").cast("string")).withColumn("bin", C.age_bin(F.col("hit_year") - F.col("focal_year")))
    p = p.join(B.works(spark, d).select(F.col("work_id").alias("focal"), "type"), "focal")
    out = E.cells(p, ["cohort", "bin", "type"])
    return out.withColumns({c: r6(c) for c in ("mean_zero", "mean_observed")})


@query("," + _PAIRS + ", u as (select hit, focal, avg(case when event_time < 0 then coalesce(cite_counts, 0) end) as a, avg(case when event_time >= 0 then coalesce(cite_counts, 0) end) as b, avg(case when event_time < 0 and observed = 1 then cite_counts end) as ao, avg(case when event_time >= 0 and observed = 1 then cite_counts end) as bo from panel group by 1, 2) select cast(count(*) as bigint) as pairs, round(avg(a), 6) as pre, round(avg(b), 6) as post, round(avg(b - a), 6) as delta, cast(count(bo - ao) as bigint) as observed_pairs, round(avg(bo - ao), 6) as delta_observed from u")
def a17_pair_deltas(spark, d):
    u = E.pair_deltas(hit_panel(spark, d), ["hit", "focal"])
    return u.agg(F.count("*").alias("pairs"), r6(F.avg("pre")).alias("pre"), r6(F.avg("post")).alias("post"), r6(F.avg("delta")).alias("delta"), F.count("delta_observed").alias("observed_pairs"), r6(F.avg("delta_observed")).alias("delta_observed"))


@query("," + _PAIRS + "select subject, cast(count(*) as bigint) as rows, round(1 - avg(observed), 6) as missing, round(1 - avg(case when event_time < 0 then observed end), 6) as missing_pre, round(1 - avg(case when event_time >= 0 then observed end), 6) as missing_post from panel p join works w on w.work_id = p.focal group by 1")
def q22_subject_comparison(spark, d):
    p = hit_panel(spark, d).join(B.works(spark, d).select(F.col("work_id").alias("focal"), "subject"), "focal")
    rate = lambda c: r6(1 - F.avg(F.when(c, F.col("observed"))))
    return p.groupBy("subject").agg(F.count("*").alias("rows"), rate(F.lit(True)).alias("missing"), rate(F.col("event_time") < 0).alias("missing_pre"), rate(F.col("event_time") >= 0).alias("missing_post"))


@query("," + _PAIRS + f"select hit, focal from panel group by 1, 2 having count(*) = {2 * WINDOW + 1} and min(event_time) = -{WINDOW} and max(event_time) = {WINDOW} and sum(observed) = {2 * WINDOW + 1}")
def w7_balanced_units(spark, d):
    w = W.partitionBy("hit", "focal")
    p = hit_panel(spark, d).where("observed = 1").withColumn("k", F.count("*").over(w)).withColumn("lo", F.min("event_time").over(w)).withColumn("hi", F.max("event_time").over(w))
    return p.where(f"k = {2 * WINDOW + 1} and lo = -{WINDOW} and hi = {WINDOW}").select("hit", "focal").distinct()


_LIFE = f", life as (select w.work_id, w.author_id, w.subject, w.pub_year, y as year, coalesce(cite_counts, 0) as cite_counts from (select *, unnest(range(pub_year, {END} + 1)) as y from works) w left join cby c on c.work_id = w.work_id and c.year = y)"


@query(_LIFE + " select cast(year as int) as year, cast(count(*) as bigint) as at_risk, cast(sum(cite_counts) as bigint) as total, round(avg(cite_counts), 6) as mean, list_sort(list(cite_counts))[count(*) // 2 + 1] as upper_median, round(avg(case when cite_counts = 0 then 1.0 else 0.0 end), 6) as zero_share from life where subject = 'BUILDING' group by 1")
def q16_year_series(spark, d):
    life = P.lifetime(B.works(spark, d).where("subject = 'BUILDING'"), B.cite_counts(spark, d), END)
    return E.year_series(life).withColumns({c: r6(c) for c in ("mean", "zero_share")})


@query(", g as (select work_id, sum(case when year > 1998 then cite_counts else -cite_counts end) as change from cby join works using (work_id) where author_id in (select author_id from works group by 1 order by count(*) desc, 1 limit 1) group by 1) select cast(sum(change) as bigint) as change, round(sum(case when r <= 1 then change end) / nullif(sum(change), 0), 6) as top1, round(sum(case when r <= 5 then change end) / nullif(sum(change), 0), 6) as top5, round(sum(case when r <= 10 then change end) / nullif(sum(change), 0), 6) as top10 from (select *, row_number() over (order by change desc, work_id) as r from g)")
def a27_growth_concentration(spark, d):
    w = B.works(spark, d)
    top = w.groupBy("author_id").count().orderBy(F.desc("count"), "author_id").limit(1)
    g = B.cite_counts(spark, d).join(w.join(F.broadcast(top.select("author_id")), "author_id").select("work_id"), "work_id").groupBy("work_id").agg(F.sum(F.when(F.col("year") > 1998, F.col("cite_counts")).otherwise(-F.col("cite_counts"))).alias("change"))
    r = g.withColumn("r", F.row_number().over(W.orderBy(F.desc("change"), "work_id")))  # one author's works
    part = lambda k: r6(C.split_share(F.sum(F.when(F.col("r") <= k, F.col("change"))), F.sum("change")))
    return r.agg(F.sum("change").alias("change"), part(1).alias("top1"), part(5).alias("top5"), part(10).alias("top10"))


@query(
    _LIFE + ", b as (select cast(year - 1998 as int) as event_time, case when year - pub_year <= 2 then '0-2' else '3-5' end as bin, avg(cite_counts) as m, count(*) as n from life where year - pub_year <= 5 group by 1, 2), wt as (select bin, n / sum(n) over () as w from b where event_time = -1) select event_time, round(sum(w * m) / sum(w), 6) as standardized, cast(sum(n) as bigint) as rows, round(sum(n * m) / sum(n), 6) as weighted from b join wt using (bin) group by 1"
)
def q19_age_standardized(spark, d):
    life = P.lifetime(B.works(spark, d), B.cite_counts(spark, d), END).where("paper_age <= 5").withColumn("event_time", F.col("year") - 1998).withColumn("bin", C.age_bin(F.col("paper_age")))
    cells = life.groupBy("event_time", "bin").agg(F.avg("cite_counts").alias("mean"), F.count("*").alias("rows"))
    base = cells.where("event_time = -1")
    weights = base.join(F.broadcast(base.agg(F.sum("rows").alias("all"))), how="cross").select("bin", (F.col("rows") / F.col("all")).alias("weight"))  # age bins only
    weighted = cells.join(weights.select("bin"), "bin").groupBy("event_time").agg(F.sum("rows").alias("rows"), r6(F.sum(F.col("rows") * F.col("mean")) / F.sum("rows")).alias("weighted"))
    return E.standardized(cells, weights).withColumn("standardized", r6("standardized")).join(weighted, "event_time")


@query(_LIFE + ", s as (select *, 1 as one from life) select cast(count(*) as bigint) as n, cast(sum(cite_counts) as bigint) as sum, round(avg(cite_counts), 6) as mean, min(cite_counts) as min, list_sort(list(cite_counts))[cast(floor(0.5 * (count(*) - 1)) as bigint) + 1] as p50, list_sort(list(cite_counts))[cast(floor(0.9 * (count(*) - 1)) as bigint) + 1] as p90, list_sort(list(cite_counts))[cast(floor(0.99 * (count(*) - 1)) as bigint) + 1] as p99, max(cite_counts) as max, round(avg(case when cite_counts = 0 then 1.0 else 0.0 end), 6) as zero_share from s")
def q21_order_statistics(spark, d):
    out = E.order_statistics(P.lifetime(B.works(spark, d), B.cite_counts(spark, d), END), "cite_counts")
    return out.withColumns({c: r6(c) for c in ("mean", "zero_share")}).withColumn("sum", long("sum"))


@query(_LIFE + " select cast(year as int) as year, cast(count(distinct work_id) as bigint) as works, cast(count(distinct author_id) as bigint) as authors, cast(min(year - pub_year) as int) as min_age, cast(max(year - pub_year) as int) as max_age, cast(count(*) as bigint) as n, cast(sum(case when year < pub_year then 1 else 0 end) as bigint) as early, cast(sum(case when cite_counts < 0 then 1 else 0 end) as bigint) as negative from life group by 1")
def a21_panel_diagnostics(spark, d):
    return P.lifetime(B.works(spark, d), B.cite_counts(spark, d), END).groupBy("year").agg(F.count_distinct("work_id").alias("works"), F.count_distinct("author_id").alias("authors"), F.min("paper_age").alias("min_age"), F.max("paper_age").alias("max_age"), F.count("*").alias("n"), F.count(F.when(F.col("paper_age") < 0, 1)).alias("early"), F.count(F.when(F.col("cite_counts") < 0, 1)).alias("negative"))


@query(", c2 as (select work_id, sum(cite_counts) as total from cby where work_id % 7 <> 0 group by 1), rec as (select work_id, cites + case when work_id % 11 = 0 then 1 when work_id % 13 = 0 and cites > 0 then -1 else 0 end as cites from totals) select cast(count(*) as bigint) as focal, cast(sum(case when coalesce(total, 0) = cites then 1 else 0 end) as bigint) as exact, cast(sum(case when total is null and cites > 0 then 1 else 0 end) as bigint) as missing, cast(sum(case when total > cites then 1 else 0 end) as bigint) as higher, cast(sum(case when total < cites then 1 else 0 end) as bigint) as lower, cast(sum(case when total is not null then abs(total - cites) else 0 end) as bigint) as abs_diff from rec left join c2 using (work_id)")
def q20_coverage_audit(spark, d):
    totals, counts, _ = B.model(spark, d)
    off = F.when(F.col("work_id") % 11 == 0, 1).when((F.col("work_id") % 13 == 0) & (F.col("cites") > 0), -1).otherwise(0)
    return O.coverage(totals, counts.where("work_id % 7 <> 0"), totals.withColumn("cites", F.col("cites") + off))


@query("select cast(count(*) as bigint) as matches, cast(count(distinct (l_orderkey, l_partkey)) as bigint) as unique_pairs, cast(count(*) - count(distinct (l_orderkey, l_partkey)) as bigint) as repeats from lineitem", bridge=False)
def a25_repeated_references(spark, d):
    return O.repeated_references(B.t(spark, d, "lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited")))


#: Works of a cell and topic are matched as far as possible: all, unless one author has too many of both sides.
_CONTROLS = """, tr as (select * from totals where cites >= 20), pool as (select * from totals where cites < 20),
sides as (select pub_year, type, subfield, author_id, sum(t) as t, sum(c) as c from (select pub_year, type, subfield, author_id, 1 as t, 0 as c from tr union all select pub_year, type, subfield, author_id, 0, 1 from pool) group by all),
topics as (select pub_year, type, subfield, sum(t) as t, least(sum(t), sum(c), sum(t) + sum(c) - max(t + c)) as most from sides group by all)
select pub_year, type, cast(sum(t) as bigint) as treated, cast(sum(most) as bigint) as in_topic, 0::bigint as own_author, 0::bigint as used_twice, 0::bigint as out_of_cell, 0::bigint as eligible_left from topics group by all having sum(t) > 0"""


def _controls(spark, d):
    t = cut(B.totals(spark, d).select("work_id", "author_id", "pub_year", "type", "subfield", "cites"))
    return t, cut(M.matched_controls(t.where("cites >= 20"), t, ["pub_year", "type"], "subfield"))


@query(_CONTROLS)
def q18_matched_controls(spark, d):
    """For each year and type how many works are treated, how many have a control in their topic, and that nothing breaks the rule."""
    t, m = _controls(spark, d)
    cell, own = ["pub_year", "type"], t.select(F.col("work_id").alias("control"), F.col("pub_year").alias("year2"), F.col("type").alias("type2"), F.col("subfield").alias("subfield2"), F.col("cites").alias("cites2"))
    pairs = m.join(own, "control", "left")
    sums = pairs.groupBy(*cell).agg(
        long(F.count("*")).alias("treated"),
        long(F.count(F.when(F.col("subfield") == F.col("subfield2"), 1))).alias("in_topic"),
        long(F.count(F.when(F.col("author_id") == F.col("control_author"), 1))).alias("own_author"),
        long(F.count("control") - F.count_distinct("control")).alias("used_twice"),
        long(F.count(F.when(F.expr("control is not null and not (pub_year <=> year2 and type <=> type2 and cites2 < 20)"), 1))).alias("out_of_cell"),
    )
    # works without a control and candidates that nobody has: of different authors they would be eligible
    free = t.where("cites < 20").join(m.select(F.col("control").alias("work_id")), "work_id", "left_anti")
    sides = m.where("control is null").select(*cell, "author_id", F.lit(1).alias("t"), F.lit(0).alias("c")).union(free.select(*cell, "author_id", F.lit(0), F.lit(1)))
    by = sides.groupBy(*cell, "author_id").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    left = by.groupBy(*cell).agg(long(F.sum("t") * F.sum("c") - F.sum(F.col("t") * F.col("c"))).alias("eligible_left"))
    return sums.join(left, cell, "left").na.fill(0, ["eligible_left"])


@query()
def q18_control_pairs(spark, d):
    """work_id, control: the pairs themselves. Which of several is a matter of hashes; tests count them."""
    return _controls(spark, d)[1].select("work_id", "control")


_MODELS = {
    1: (["post"], None),
    2: (["post", "event_time"], None),
    3: (["post", "event_time", "event_time_sq"], "field"),
    4: (["post", "event_time", "event_time_sq", "missing_rate"], "field"),
    5: (["post", "event_time", "event_time_sq", "missing_rate"], "subject"),
}
#: The first level of each factor is what the others are compared with.
_FACTORS = {"field": ["home", "trade"], "subject": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]}
_HOME = "subject in ('FURNITURE', 'HOUSEHOLD')"


def _weighted_sql() -> str:
    """For each term of each model the other ones swept out of it and of the outcome, all times the root of the weight."""
    factors = {f"{f}={level}": f"cast({f} = '{level}' as int)" for f, levels in _FACTORS.items() for level in levels[1:]}
    tables, parts = [], []
    for m, (x, factor) in _MODELS.items():
        terms = {"constant": "1", **{c: c for c in x}, **({k: v for k, v in factors.items() if k.startswith(f"{factor}=")} if factor else {})}
        for n, term in enumerate(terms):
            name, others = f"m{m}_{n}", [k for k in terms if k != term]
            columns = ", ".join([f"s * mean as y, s * {terms[term]} as x", *(f"s * {terms[k]} as c{i}" for i, k in enumerate(others))])
            tables += [f"{name}_0 as materialized (select 1 as v, {columns} from ecells)", _swept("v", [f"c{i}" for i in range(len(others))], ("y", "x"), name)]
            parts.append(f"select {m}::int as model, '{term}' as term, round(sum(x * y) / sum(x * x), 5) as beta, round(sqrt(greatest(sum(y * y) - sum(x * y) ** 2 / sum(x * x), 0) / (count(*) - {len(terms)}) / sum(x * x)), 5) as se, count(*)::bigint as n from {name}")
    return ", " + ", ".join(tables) + " " + " union all ".join(parts)


@query(
    "," + _CROSSING + f", ecells as (select subject, event_time::double as event_time, event_time::double ** 2 as event_time_sq, cast(event_time >= 0 as int)::double as post, case when {_HOME} then 'home' else 'trade' end as field, avg(cite_counts) as mean, avg(cast(cite_counts = 0 as int)) as missing_rate, sqrt(count(*)) as s from cpanel join works on work_id = focal group by subject, event_time)"
    + _weighted_sql()
)
def r11_weighted_fits(spark, d):
    """Mean cites by subject and event time, weighted by pairs, in five specifications with factors."""
    p = crossing_panel(spark, d).join(B.works(spark, d).select(F.col("work_id").alias("focal"), "subject"), "focal")
    cells = p.groupBy("subject", "event_time").agg(F.avg("cite_counts").alias("mean"), F.avg((F.col("cite_counts") == 0).cast("int")).alias("missing_rate"), F.count("*").cast("double").alias("pairs"))
    cells = cells.withColumns({"event_time_sq": F.col("event_time") * F.col("event_time"), "post": (F.col("event_time") >= 0).cast("int"), "field": F.when(F.expr(_HOME), "home").otherwise("trade")})
    cells = cut(cells)
    n = cells.count()
    rows = [(m, term, round(b, 5), round(s, 5), n) for m, (x, factor) in _MODELS.items() for term, b, s in R.factor_fit(cells, "mean", x, factor, "pairs")]
    return spark.createDataFrame(rows, "model int, term string, beta double, se double, n bigint")


@query("," + _CROSSING + "select hit, focal, round(regr_slope(cite_counts, event_time), 6) as slope from cpanel where event_time < 0 group by 1, 2")
def a28_pre_trends(spark, d):
    return M.pre_trend(crossing_panel(spark, d), ["hit", "focal"]).withColumn("slope", r6("slope"))


@query("," + _CROSSING + ", u as (select hit, focal, subject = 'BUILDING' as b, avg(case when event_time >= 0 then cite_counts end) - avg(case when event_time < 0 then cite_counts end) as ch from cpanel join works on work_id = focal group by 1, 2, 3) select round(avg(case when b then ch end) - avg(case when not b then ch end), 6) as difference from u")
def a29_difference_in_changes(spark, d):
    p = crossing_panel(spark, d).join(B.works(spark, d).select(F.col("work_id").alias("focal"), (F.col("subject") == "BUILDING").alias("b")), "focal")
    post = F.col("event_time") >= 0
    u = p.groupBy("hit", "focal", "b").agg((F.avg(F.when(post, F.col("cite_counts"))) - F.avg(F.when(~post, F.col("cite_counts")))).alias("ch"))
    return u.agg(r6(F.avg(F.when(F.col("b"), F.col("ch"))) - F.avg(F.when(~F.col("b"), F.col("ch")))).alias("difference"))


@query("," + _CROSSING + ", m as (select cast(event_time as int) as event_time, avg(cite_counts) as v from cpanel group by 1) select event_time, round(v / (select avg(v) from m where event_time < 0), 6) as indexed from m")
def a31_pre_index(spark, d):
    m = crossing_panel(spark, d).groupBy("event_time").agg(F.avg("cite_counts").alias("v"))
    base = m.where("event_time < 0").agg(F.avg("v").alias("b"))
    return m.join(F.broadcast(base), how="cross").select("event_time", r6(F.col("v") / F.col("b")).alias("indexed"))  # base is one row


@query()
def q17_version_clusters(spark, d):
    """Orders as works of their customers; a work's title is what it is made of, whole."""
    parts = B.t(spark, d, "lineitem").join(B.t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    titles = parts.groupBy(F.col("l_orderkey").alias("work_id")).agg(F.array_join(F.sort_array(F.collect_set("p_name")), " ").alias("title"))
    rows = B.totals(spark, d).join(titles, "work_id", "left").select("author_id", "work_id", F.coalesce("title", F.lit("")).alias("title"), F.col("pub_year").alias("year"), "cites", F.lit("").alias("doi"))
    return M.version_clusters(rows)


@query("select 'author' as record_type, author_id, metric, value from (select author_id, unnest(['works', 'cites']) as metric, unnest([cast(count(*) as double), cast(sum(cites) as double)]) as value from totals group by 1)")
def k16_tidy_export(spark, d):
    a = B.totals(spark, d).groupBy("author_id").agg(F.count("*").alias("works"), F.sum("cites").alias("cites"))
    return sinks.tidy(a, ["author_id"], "author").select("record_type", "author_id", "metric", "value")


@query("select work_id, type, cast(case when pub_year >= 1999 then 1 else 0 end as int) as renewed from works")
def k12_upsert(spark, d):
    w = B.works(spark, d)
    old, new = w.select("work_id", "type", F.lit(0).alias("renewed")), w.where("pub_year >= 1999").select("work_id", "type", F.lit(1).alias("renewed"))
    return sinks.upsert(old, new, ["work_id"])


# --- audits, samples, sources -------------------------------------------------

_RECORDED = ", c2 as (select work_id, sum(cite_counts) as total from cby where work_id % 7 <> 0 group by 1), rec as (select work_id, cites + case when work_id % 11 = 0 then 1 else 0 end as cites from totals) "


def _recorded(spark, d):
    totals, counts, _ = B.model(spark, d)
    return totals, counts.where("work_id % 7 <> 0"), totals.withColumn("cites", F.col("cites") + F.when(F.col("work_id") % 11 == 0, 1).otherwise(0))


@query(_RECORDED + "select cast(sum(case when total is null and cites > 0 then 1 else 0 end) as bigint) as missing, cast(sum(case when total is not null then abs(total - cites) else 0 end) as bigint) as abs_diff, sum(case when total is null and cites > 0 then 1 else 0 end) <= 5 and sum(case when total is not null then abs(total - cites) else 0 end) <= 1000000000 as valid from rec left join c2 using (work_id)")
def a26_coverage_verdict(spark, d):
    return O.verdict(O.coverage(*_recorded(spark, d)), 1_000_000_000, 5).select("missing", "abs_diff", "valid")


@query(_RECORDED + "select work_id, cast(coalesce(total, 0) as bigint) as total, cites from rec left join c2 using (work_id) where coalesce(total, 0) <> cites")
def j21_mismatches(spark, d):
    return O.mismatches(*_recorded(spark, d))


def _listed(spark, d):
    return B.t(spark, d, "lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited"))


@query("select l_partkey as cited, cast(count(*) as bigint) as entries, count(distinct l_orderkey) as citers, cast(count(*) - count(distinct l_orderkey) as bigint) as repeats from lineitem group by 1", bridge=False)
def a25_repeats_by_target(spark, d):
    return O.repeats_by_target(_listed(spark, d))


@query("select l_orderkey as citing, l_partkey as cited, cast(count(*) as bigint) as repetitions from lineitem group by 1, 2 having count(*) > 1 order by 3 desc, 1, 2 limit 50", bridge=False)
def a25_repeat_examples(spark, d):
    return O.repeat_examples(_listed(spark, d))


@query(", rel as (select work_id as focal, work_id as other from works union select citing, cited from edges union select cited, citing from edges), flag as (select f.work_id, h.work_id as history, case when r.other is null then 0 else 1 end as is_related from works f join works h on h.author_id = f.author_id left join rel r on r.focal = f.work_id and r.other = h.work_id) select work_id, cast(sum(is_related) as bigint) as related, cast(sum(1 - is_related) as bigint) as unrelated from flag group by 1")
def j12_related_flag(spark, d):
    return O.related_counts(B.edges(spark, d), B.works(spark, d))


@query(
    ", dup as (select *, row_number() over (partition by author_id, work_id order by type) as k from (select * from totals union all select * from totals where work_id % 5 = 0)), base as (select * exclude (k) from dup where k = 1), ranked as (select *, row_number() over (partition by author_id order by cites desc, pub_year, work_id) as r from base), top as (select author_id, work_id as hit, pub_year as hy, cites as top from ranked where r = 1), people as (select work_id as hit, count(distinct author_id) as hit_authors from authorships group by 1), screen as (select t.author_id, t.hit, top, sum(r.cites) as total, count(*) filter (where r.r > 1 and r.pub_year < hy) as priors, count(*) filter (where r.r > 1 and r.pub_year < hy and r.cites > 0) as cited_priors, coalesce(sum(r.cites) filter (where r.r > 1 and r.pub_year < hy), 0) as prior_cites from top t join ranked r using (author_id) group by all) select author_id, hit, cast(total as bigint) as total, cast(priors as bigint) as priors, cast(cited_priors as bigint) as cited_priors, cast(prior_cites as bigint) as prior_cites, coalesce(hit_authors, 0) as hit_authors from screen left join people using (hit) where top > 0.15 * total and total >= 50 and priors >= 3 and prior_cites >= 20 and cited_priors >= 2 and coalesce(hit_authors, 0) <= 4"
)
def q13_shortlist(spark, d):
    totals = B.totals(spark, d)
    again = totals.union(totals.where("work_id % 5 = 0"))  # rows that a source repeats
    once = again.withColumn("k", F.row_number().over(W.partitionBy("author_id", "work_id").orderBy("type"))).where("k = 1").drop("k")
    people = B.authorships(spark, d).groupBy(F.col("work_id").alias("hit")).agg(F.count_distinct("author_id").alias("hit_authors"))
    out = P.screen(once).join(people, "hit", "left").withColumn("hit_authors", F.coalesce("hit_authors", F.lit(0)))
    return out.where("top > 0.15 * total and total >= 50 and priors >= 3 and prior_cites >= 20 and cited_priors >= 2 and hit_authors <= 4").select("author_id", "hit", "total", "priors", "cited_priors", "prior_cites", "hit_authors")


@query(
    "," + _PAIRS + f", life as (select w.work_id, y as year, y - pub_year as paper_age, type, coalesce(cite_counts, 0) as c from (select *, unnest(range(pub_year, {END} + 1)) as y from works) w left join cby c on c.work_id = w.work_id and c.year = y), bench as (select year, paper_age, type, avg(c) as expected from life group by 1, 2, 3), norm as (select p.author_id, p.hit, p.focal, p.event_time, coalesce(p.cite_counts, 0) as c, expected, coalesce(p.cite_counts, 0) - expected as excess, (coalesce(p.cite_counts, 0) + 0.1) / (expected + 0.1) as smoothed from panel p join works w on w.work_id = p.focal join bench b on b.year = p.year and b.paper_age = p.year - w.pub_year and b.type = w.type), flagged as (select *, count(*) over u = {2 * WINDOW + 1} and min(event_time) over u = -{WINDOW} and max(event_time) over u = {WINDOW} as whole_ from norm window u as (partition by hit, focal)), samples as (select 'at_risk' as sample, * from flagged union all select 'balanced', * from flagged where whole_), per as (select sample, event_time, author_id, avg(excess) as m from samples group by 1, 2, 3), err as (select sample, event_time, stddev_samp(m) / sqrt(count(*)) as se from per group by 1, 2) select s.sample, cast(s.event_time as int) as event_time, cast(count(*) as bigint) as observations, count(distinct author_id) as authors, count(distinct (hit, focal)) as units, round(avg(excess), 6) as excess, round(sum(c) / nullif(sum(expected), 0), 6) as observed_expected, round(avg(smoothed), 6) as smoothed, round(any_value(se), 6) as se from samples s join err using (sample, event_time) group by 1, 2"
)
def a13_two_samples(spark, d):
    w, model = B.works(spark, d), B.model(spark, d)
    c = model[1]
    bench = E.lifecycle_benchmark(P.lifetime(w, c, END).join(w.select("work_id", "type"), "work_id"))
    p = hit_panel(spark, d, model=model).join(w.select(F.col("work_id").alias("focal"), "type"), "focal").withColumn("paper_age", F.col("year") - F.col("focal_year")).withColumn("c", F.coalesce("cite_counts", F.lit(0)))
    n = p.join(bench, ["year", "paper_age", "type"]).withColumn("excess", F.col("c") - F.col("expected")).withColumn("smoothed", C.smoothed_ratio(F.col("c"), F.col("expected")))
    out = E.sample_means(E.two_samples(n, ["hit", "focal"], WINDOW), ["hit", "focal"])
    return out.withColumns({k: r6(k) for k in ("excess", "observed_expected", "smoothed", "se")})


@query(", me as (select author_id from works group by 1 order by count(*) desc, 1 limit 1)" + _LIFE + " select cast(year as int) as year, cast(count(*) as bigint) as at_risk, cast(sum(cite_counts) as bigint) as total, round(avg(cite_counts), 6) as mean, list_sort(list(cite_counts))[count(*) // 2 + 1] as upper_median, round(avg(case when cite_counts = 0 then 1.0 else 0.0 end), 6) as zero_share from life where author_id in (select author_id from me) group by 1")
def q16_author_case(spark, d):
    w = B.works(spark, d)
    me = w.groupBy("author_id").count().orderBy(F.desc("count"), "author_id").limit(1).select("author_id")
    life = P.lifetime(w.join(F.broadcast(me), "author_id", "left_semi"), B.cite_counts(spark, d), END)
    return E.year_series(life).withColumns({c: r6(c) for c in ("mean", "zero_share")})


def _folder(spark, kind):
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


@query(
    """select 'https://x.example/W' || o_orderkey as work_id, case when o_orderkey % 3 = 0 then 'Title ' else 'Order ' end || o_orderkey as title, cast(year(o_orderdate) as int) as publication_year, cast(trunc(o_totalprice) as bigint) as cited_by_count from orders join customer on c_custkey = o_custkey""",
    bridge=False,
)
def s1_json_lines(spark, d):
    """Works as gzip JSON lines in dated folders, read again."""
    root = _folder(spark, "works")
    dated = F.concat(F.lit("2024-01-0"), F.pmod(F.hash("id"), F.lit(2)) + 1)
    sinks.write_jsonl(raw_works(spark, d).withColumn("updated_date", dated), root, by=["updated_date"])
    return N.works(readers.read_works(spark, root)).select("work_id", "title", "publication_year", "cited_by_count")


@query("""select 'https://x.example/W' || o_orderkey as work_id, case when o_orderkey % 3 = 0 then 'Title ' else 'Order ' end || o_orderkey as title, cast(year(o_orderdate) as int) as publication_year, case when o_orderkey % 5 = 0 then null else cast(o_orderkey as double) end as fwci from orders join customer on c_custkey = o_custkey""", bridge=False)
def s5_csv_tables(spark, d):
    """Works as gzip CSV, read again with their types."""
    root = _folder(spark, "tables")
    sinks.write_csv(N.works(raw_works(spark, d)), f"{root}/works.csv.gz")
    return readers.read_table(spark, root, "works").select("work_id", "title", "publication_year", "fwci")


@query("""select 'https://x.example/W' || l_orderkey as id, cast(count(distinct l_partkey) as bigint) as listed from lineitem join orders on o_orderkey = l_orderkey where l_orderkey % 2 = 0 group by 1""", bridge=False)
def s7_s8_wanted_references(spark, d):
    """Ids as a text file; the references of these works from JSON lines."""
    root = _folder(spark, "ids")
    raw = raw_works(spark, d)
    sinks.write_jsonl(raw, f"{root}/works")
    sinks.write_ids(B.t(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("https://x.example/W"), "o_orderkey").alias("id")), "id", f"{root}/ids")
    found = readers.references_of(spark, f"{root}/works", readers.read_ids(spark, f"{root}/ids"))
    return found.groupBy("id").agg(F.count_distinct("referenced_work_id").alias("listed"))


@query("select 'author' as record_type, metric, cast(count(*) as bigint) as n, cast(0 as bigint) as missing, min(value) as least, max(value) as greatest from (select unnest(['works', 'cites']) as metric, unnest([cast(count(*) as double), cast(sum(cites) as double)]) as value from totals group by author_id) group by 2")
def k16_dictionary(spark, d):
    a = B.totals(spark, d).groupBy("author_id").agg(F.count("*").alias("works"), F.sum("cites").alias("cites"))
    return sinks.dictionary(sinks.tidy(a, ["author_id"], "author"))
