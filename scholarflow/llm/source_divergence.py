"""How the words of each source differ from those of the other sources of its language, in whole numbers throughout.

1. Python tasks count terms over Arrow batches and hand on partial counts, so what
   Spark shuffles is no larger than the tasks' vocabularies.
2. The terms of a language that are in MIN_DOCS of its documents or more are kept.
3. For each pair of sources a joint histogram tallies how many kept terms occur c
   times in the one and d times in the other. Terms are dealt to blocks of about
   BLOCK rows; a block tallies the combinations with both counts above 0, by NumPy
   and in bounded steps, and returns one row for each combination. The cells
   with a 0 are implied: a source's own histogram less what the pair's joint one
   has of it, and all kept terms less the rest for the cell (0, 0).
4. f is evaluated once for each combination of counts, times its multiplicity.

Terms are maximal runs of A-Z, a-z and everything beyond ASCII, A-Z lower-cased.
With V kept terms in the language and N occurrences of them in a group, a term
with `count` of them has p = 1 + floor(10**9 * (count + 1) / (N + V)); for p against
another group's q, f = floor((p - q)**2 / q). p is worked out in decimals of 38
digits; f fits 64 bits since p is at most 10**9 + 1.

Null text, lang and source are ''. A group (lang, source) without terms, or in a
language that keeps none, still is an item with a value (0 without kept terms).
Rows that repeat are documents of their own; doc_id isn't read, nor are extra
columns. Ties of a value are ranked by the item's UTF-8 bytes. No documents: no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import _spark as S

MIN_DOCS = 3
TOP_TERMS = 200
UNIT = 1_000_000_000
#: Entries of a task's counts at which they are handed on, and bytes of a text that are split at once.
HELD, SLICE = 500_000, 1 << 20
#: Rows (term, source) of a block, about; pairs of them that are tallied at once.
BLOCK, STEP = 500_000, 1 << 21
#: Sources of a language that meet its others in one task.
SALTS = 32

#: Bytes of terms as they are, lower-cased; a space for the others. Bytes beyond ASCII belong to characters beyond it.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of some SLICE bytes of text each."""
    folded = text.encode("utf-8", "surrogatepass").translate(_FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + SLICE) if at + SLICE < len(folded) else -1
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def _partial(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs: several rows for one term."""

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def handed():
            for (lang, source), (counts, holders) in held.items():
                n = len(counts)
                columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array([t.decode("utf-8", "surrogatepass") for t in counts], pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([holders[t] for t in counts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "count", "docs"])
            held.clear()

        size = 0
        for b in S.slices(batches):
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                counts, holders = held.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(counts), set()
                for some in terms(text):
                    counts.update(some)
                    own.update(some)
                holders.update(own)
                size += len(counts) - before
                if size > HELD:
                    yield from handed()
                    size = 0
        yield from handed()

    S.small_batches(docs.sparkSession)
    named = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return named.mapInArrow(run, "lang string, source string, term string, count long, docs long")


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, count, total (of the language): the kept terms of each group that has them."""
    counts = S.save(_partial(docs).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    return counts.drop("docs").join(kept, ["lang", "term"]).select("lang", "source", "term", "count", "total")


def _p(count: str, n: str, v: str) -> Column:
    return F.expr(f"1L + (cast({UNIT} as decimal(38,0)) * (cast({count} as decimal(19,0)) + 1) div (cast({n} as decimal(19,0)) + {v}))")


def _f(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def tally(term: np.ndarray, label: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows (term, label of source and count): labels x and y of two sources of one term, x's source first, and how many terms have both."""
    order = np.lexsort((source, term))
    term, label = term[order], label[order]
    ends = np.searchsorted(term, term, "right")
    later = ends - np.arange(1, len(term) + 1)  # rows of the same term that follow
    upto = np.cumsum(later)
    wide = int(label.max()) + 1 if len(label) else 1
    codes, many, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while at < len(term):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP, "right")))
        first = np.repeat(np.arange(at, to), later[at:to])
        begins = np.repeat(np.cumsum(later[at:to]) - later[at:to], later[at:to])
        other = first + 1 + np.arange(len(first)) - begins
        new, n = np.unique(label[first] * wide + label[other], return_counts=True)
        codes, back = np.unique(np.concatenate([codes, new]), return_inverse=True)
        many = np.bincount(back, np.concatenate([many, n]), len(codes)).astype(np.int64)
        at = to
    return codes // wide, codes % wide, many


def _joint(held: DataFrame) -> DataFrame:
    """lang, one, two, c, d, n: kept terms that occur c > 0 times in source one and d > 0 times in source two, one < two."""
    blocks = max(1, -(-held.count() // BLOCK))

    def run(table):
        rows = table.combine_chunks()
        term, count = (rows.column(c).to_numpy() for c in ("term", "count"))
        coded = rows.column("source").combine_chunks().dictionary_encode()
        names, place = np.unique(np.array(coded.dictionary.to_pylist(), object), return_inverse=True)
        source = place[coded.indices.to_numpy()]
        pairs, label = np.unique(np.stack([source, count]), axis=1, return_inverse=True)
        x, y, n = tally(np.unique(term, return_inverse=True)[1], label.reshape(-1), source)
        lang = rows.column("lang")[0].as_py() if len(term) else ""
        columns = [pa.array([lang] * len(n), pa.string()), pa.array(names[pairs[0, x]], pa.string()), pa.array(names[pairs[0, y]], pa.string()), pa.array(pairs[1, x], pa.int64()), pa.array(pairs[1, y], pa.int64()), pa.array(n, pa.int64())]
        return pa.Table.from_arrays(columns, ["lang", "one", "two", "c", "d", "n"])

    dealt = held.select("lang", "source", "count", "term", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"))
    dealt = dealt.withColumn("term", F.dense_rank().over(W.partitionBy("lang", "block").orderBy("term")).cast("long"))
    parts = dealt.groupBy("lang", "block").applyInArrow(run, "lang string, one string, two string, c long, d long, n long")
    return parts.groupBy("lang", "one", "two", "c", "d").agg(F.sum("n").alias("n"))


def _pairs(groups: DataFrame) -> DataFrame:
    """lang, one, two, n1, n2, v: pairs of sources of a language, one < two; rows of one language are dealt to many tasks."""
    ones = groups.select("lang", F.col("source").alias("one"), F.col("n").alias("n1"), "v", F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int").alias("salt"))
    twos = groups.select("lang", F.col("source").alias("two"), F.col("n").alias("n2"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return ones.join(twos, ["lang", "salt"]).where("one < two").select("lang", "one", "two", "n1", "n2", "v")


def _cells(rows: DataFrame, *cells: str) -> DataFrame:
    """lang, one, two, c, d, n: for each row the cells whose SQL is given as 'c, d, n'."""
    made = ", ".join("named_struct('c', {}, 'd', {}, 'n', {})".format(*c.split(", ")) for c in cells)
    return rows.select("lang", "one", "two", F.explode(F.expr(f"array({made})")).alias("x")).select("lang", "one", "two", "x.*")


def pair_values(held: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source), value: for each ordered pair of sources of a language."""
    key = ["lang", "one", "two"]
    pairs = S.save(_pairs(groups), "pairs")
    joint = S.save(_joint(held), "joint")
    own = held.groupBy("lang", "source", "count").agg(F.count("*").alias("n"))
    ones, twos = (pairs.select(*key).join(own.withColumnsRenamed({"source": side, "count": "k"}), ["lang", side]) for side in ("one", "two"))
    # a term of both sources is in none of the cells with a 0; (0, 0) is all kept terms, less those of each, and those of both once more
    cells = _cells(joint, "c, d, n", "c, 0L, -n", "0L, d, -n", "0L, 0L, n")
    cells = cells.union(_cells(ones, "k, 0L, n", "0L, 0L, -n")).union(_cells(twos, "0L, k, n", "0L, 0L, -n")).union(_cells(pairs, "0L, 0L, v"))
    tallied = cells.groupBy(*key, "c", "d").agg(F.sum("n").alias("many")).where("many > 0")
    valued = tallied.join(pairs, key).select(*key, "many", _p("c", "n1", "v").alias("p"), _p("d", "n2", "v").alias("q"))
    sums = valued.groupBy(*key).agg(*(F.sum(F.col("many") * _f(*side)).alias(name) for name, side in (("there", ("p", "q")), ("back", ("q", "p")))))
    both = pairs.select(*key).join(sums, key, "left").na.fill(0)
    return both.select("lang", F.expr("explode(array(named_struct('source', one, 'item', two, 'value', there), named_struct('source', two, 'item', one, 'value', back)))").alias("x")).select("lang", "x.*")


def term_values(held: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, source, item (a term), value: kept terms that a group has and has more of than its language."""
    rows = held.join(groups, ["lang", "source"]).join(langs.select("lang", F.col("n").alias("all")), "lang")
    valued = rows.select("lang", "source", F.col("term").alias("item"), _p("count", "n", "v").alias("p"), _p("total", "all", "v").alias("q"))
    return valued.where("p > q").select("lang", "source", "item", _f("p", "q").alias("value"))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    with S.scope(docs.sparkSession) as run:
        held = S.save(kept_counts(docs, min_docs), "held")
        langs = held.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.sum("total").alias("n"), F.count("*").alias("v"))
        langs = S.save(langs, "langs")
        sums = held.groupBy("lang", "source").agg(F.sum("count").alias("n"))
        occur = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
        groups = occur.join(sums, ["lang", "source"], "left").join(langs.select("lang", "v"), "lang", "left")
        groups = S.save(groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "v"))), "groups")
        by = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        pairs = pair_values(held, groups).withColumn("rank", F.row_number().over(by))
        top = term_values(held, groups, langs).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_terms)
        out = pairs.withColumn("part", F.lit("pair")).unionByName(top.withColumn("part", F.lit("term")))
        return run.hand_on(out.select("lang", "source", "part", "item", "value", "rank"), "divergence")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(S.table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
w as (select r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*) as total from w group by lang, term having count(distinct r) >= {MIN_DOCS}),
langs as (select lang, sum(total) as n, count(*) as v from kept group by lang),
own as (select lang, source, term, count(*) as c from w join kept using (lang, term) group by all),
sums as (select lang, source, sum(c) as n from own group by all),
groups as (select lang, source, coalesce(sums.n, 0) as n, coalesce(v, 0) as v from (select distinct lang, source from d) left join sums using (lang, source) left join langs using (lang)),
every as (select g.lang, g.source, k.term, coalesce(c, 0) as c, 1 + (cast({UNIT} as hugeint) * (coalesce(c, 0) + 1)) // cast(g.n + g.v as hugeint) as p
  from groups g join kept k using (lang) left join own o on o.lang = g.lang and o.source = g.source and o.term = k.term),
pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from every a join every b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pair as (select g.lang, g.source, h.source as item, coalesce(value, 0) as value from groups g join groups h on g.lang = h.lang and g.source <> h.source
  left join pairs p on p.lang = g.lang and p.source = g.source and p.item = h.source),
whole as (select lang, term, 1 + (cast({UNIT} as hugeint) * (total + 1)) // cast(n + v as hugeint) as q from kept join langs using (lang)),
term as (select e.lang, e.source, e.term as item, (p - q) * (p - q) // q as value from every e join whole using (lang, term) where c > 0 and p > q),
both_parts as (select lang, source, 'pair' as part, item, value from pair union all select lang, source, 'term', item, value from term),
ranked as (select lang, source, part, item, cast(value as bigint) as value, cast(row_number() over (partition by lang, source, part order by value desc, encode(item)) as integer) as rank from both_parts)
select * from ranked where part = 'pair' or rank <= {TOP_TERMS}
"""
