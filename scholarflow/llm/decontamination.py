"""Benchmark decontamination with SimHash item-sized windows. DataFrame and SQL functions only.

An item leaks into a text if some window of the text, as many words long as the
item (the whole text if that is shorter), has a weighted similarity of 0.75 or
more with it: over lower-case five-word shingles, the sum of the lesser
multiplicities by the sum of the greater ones. Items of fewer than five words
count as one shingle of their whole length.

1. Shingles of the texts meet those of the items. A window as long as the item
   is similar enough only if 6/7 of its places or more hit the item (a shorter
   text: 0.75 of the item's), wherever they stand in it: all windows with so many
   hits are made, whatever the order of the passages in them.
2. Each of these windows and each item gets a 64-bit SimHash. Fingerprints are
   cut into RADIUS + 1 blocks; two within RADIUS bits agree in one block at
   least, so an equi-join on blocks meets all of them.
3. The exact weighted similarity decides.

Verdicts hang on the text, so null and repeated ids and copies are judged alike;
null and empty texts are clean; null and empty items match nothing. Extra
columns are kept by clean(), not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark as S

SHINGLE = 5
PERCENT = 75
BITS = 64
#: At a similarity of 0.75, of 64 bits 11 differ on average, with a deviation of 3.
RADIUS = 24
#: Rows up to which a small side may be broadcast (24 bytes each); beyond that both sides are shuffled.
BROADCAST_ROWS = 1_000_000


#: A window of m shingles is similar enough if it shares NEED of an item's m or more, which is no more than its places that hit.
NEED = f"cast((2 * {PERCENT} * m + {99 + PERCENT}) div {100 + PERCENT} as int)"
#: Starts of all windows with NEED hits or more, by the first hit in them; a text shorter than the item is one window.
STARTS = f"""case when n < size then array(0) when size(ps) < {NEED} then cast(array() as array<int>) else flatten(transform(sequence(0, size(ps) - {NEED}),
    j -> case when greatest(ps[j + {NEED} - 1] - m + 1, if(j = 0, 0, ps[greatest(j - 1, 0)] + 1)) <= least(ps[j], n - size)
    then sequence(greatest(ps[j + {NEED} - 1] - m + 1, if(j = 0, 0, ps[greatest(j - 1, 0)] + 1)), least(ps[j], n - size)) else cast(array() as array<int>) end)) end"""


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _shingled(words: str, k: int) -> str:
    parts = ", ".join(f"{words}[i + {j}]" for j in range(k))
    return f"case when size({words}) >= {k} then transform(sequence(0, size({words}) - {k}), i -> xxhash64({parts})) else cast(array() as array<bigint>) end"


def _items(benchmark: DataFrame, k: int) -> DataFrame:
    """item_id, size (words), m (shingles), sh: the items that are compared by k-word shingles."""
    out = benchmark.where("item_id is not null and text is not null").select("item_id", S.words(S.ascii_lower(F.col("text"))).alias("w"))
    out = out.where(F.size("w") >= SHINGLE) if k == SHINGLE else out.where(F.size("w") == k)
    return out.select("item_id", F.size("w").alias("size"), F.expr(_shingled("w", k)).alias("sh")).withColumn("m", F.size("sh")).distinct()


def _texts(docs: DataFrame, k: int) -> DataFrame:
    """t0, t1, n (words), sh, for each text with a word. Shorter texts than k have no shingle."""
    lowered = docs.select(*S.text_key(F.col("text")), S.ascii_lower(F.col("text")).alias("text"))
    worded = lowered.where(F.col("text").isNotNull()).select("t0", "t1", S.words(F.col("text")).alias("w"))
    return worded.select("t0", "t1", F.size("w").alias("n"), F.expr(_shingled("w", k)).alias("sh"))


def _fingerprint(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, print: the SimHash of the rows' shingles h, one vote for each row."""
    votes = [F.sum(F.expr(f"case when h & shiftleft(1L, {b}) = 0 then -1 else 1 end")).alias(f"v{b}") for b in range(BITS)]
    whole = reduce(lambda x, y: x.bitwiseOR(y), [F.when(F.col(f"v{b}") > 0, F.expr(f"shiftleft(1L, {b})")).otherwise(F.lit(0).cast("long")) for b in range(BITS)])
    return rows.groupBy(*keys).agg(*votes).select(*keys, whole.alias("print"))


def _blocks() -> list[tuple[int, int]]:
    """First bit and width of each of RADIUS + 1 blocks."""
    cuts = [round(i * BITS / (RADIUS + 1)) for i in range(RADIUS + 2)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _blocked(df: DataFrame) -> DataFrame:
    parts = ", ".join(f"named_struct('block', {i}, 'part', shiftrightunsigned(print, {a}) & {(1 << w) - 1}L)" for i, (a, w) in enumerate(_blocks()))
    return df.withColumn("x", F.explode(F.expr(f"array({parts})"))).select("*", "x.block", "x.part").drop("x")


def text_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """t0, t1, item_id, start, size, both, all: the best window of each distinct text for each item that leaks into it."""
    sizes = [r[0] for r in benchmark.select(F.least(F.size(S.words(F.col("text"))), F.lit(SHINGLE)).alias("k")).where("k > 0").distinct().collect()]  # SHINGLE values at most
    found = [_leaks(docs, benchmark, k) for k in sorted(sizes)]
    if not found:
        return docs.select(*S.text_key(F.col("text"))).where("false").selectExpr("t0", "t1", "0L as item_id", "0 as start", "0 as size", "0L as both", "1L as all")
    return reduce(DataFrame.union, found)


def _leaks(docs: DataFrame, benchmark: DataFrame, k: int) -> DataFrame:
    items = S.save(_items(benchmark, k), "items")
    shingle = items.select("item_id", "size", "m", F.posexplode("sh").alias("o", "h"))
    texts = _texts(docs, k)
    # outer: else Spark infers a filter on the array's size, and works the array out a second time, for each of its elements
    hits = texts.select("t0", "t1", "n", F.posexplode_outer("sh").alias("p", "h")).join(_small(shingle.select("item_id", "size", "m", "h").distinct()), "h")
    # equal texts hit at the same places
    at = hits.groupBy("t0", "t1", "n", "item_id", "size", "m").agg(F.sort_array(F.collect_set("p")).alias("ps"))
    at = S.save(at.where(f"100 * size(ps) >= {PERCENT} * m"), "hits")
    windows = at.select("t0", "t1", "item_id", "size", "m", F.explode(F.expr(STARTS)).alias("start"))
    windows = S.save(windows, "windows")
    some = docs.select(*S.text_key(F.col("text")), "text").join(_small(windows.select("t0", "t1").distinct()), ["t0", "t1"], "left_semi").dropDuplicates(["t0", "t1"])
    shown = windows.join(_texts(some, k).select("t0", "t1", "sh"), ["t0", "t1"]).withColumn("h", F.explode_outer(F.expr(f"slice(sh, start + 1, size - {k} + 1)"))).drop("sh").where("h is not null")
    shown = S.save(shown, "shown")
    prints = _blocked(_fingerprint(shown, ["t0", "t1", "item_id", "size", "m", "start"]))
    own = _blocked(_fingerprint(shingle, ["item_id"])).withColumnRenamed("print", "own")
    pairs = prints.join(own, ["item_id", "block", "part"]).where(f"bit_count(print ^ own) <= {RADIUS}").select("t0", "t1", "item_id", "size", "m", "start").distinct()
    mine = shown.groupBy("t0", "t1", "item_id", "start", "h").agg(F.count("*").alias("a"))
    count = mine.join(pairs, ["t0", "t1", "item_id", "start"]).join(shingle.groupBy("item_id", "h").agg(F.count("*").alias("b")), ["item_id", "h"], "left")
    exact = count.groupBy("t0", "t1", "item_id", "size", "m", "start").agg(F.sum("a").alias("words"), F.sum(F.least("a", F.coalesce("b", F.lit(0)))).alias("both")).withColumn("all", F.expr("words + m - both"))
    best = exact.where(f"100 * both >= {PERCENT} * all").groupBy("t0", "t1", "item_id", "size").agg(F.min_by(F.struct("start", "both", "all"), F.struct(F.expr("- both / all"), "start")).alias("x"))
    return best.select("t0", "t1", "item_id", "x.start", "size", "x.both", "x.all")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_leaks, leaked_items (ids, comma-joined), best_similarity, kept: one row per row of docs."""
    with S.scope(docs.sparkSession) as run:
        found = text_leaks(docs, benchmark).groupBy("t0", "t1").agg(F.sort_array(F.collect_set("item_id")).alias("ids"), F.max(F.expr("both / all")).alias("best_similarity"))
        found = run.hand_on(found, "found")
    out = docs.select("doc_id", *S.text_key(F.col("text"))).join(_small(found), ["t0", "t1"], "left")
    return out.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_leaks"), F.coalesce(F.array_join(F.expr("transform(ids, x -> string(x))"), ","), F.lit("")).alias("leaked_items"), F.coalesce("best_similarity", F.lit(0.0)).alias("best_similarity"), F.col("ids").isNull().alias("kept"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs into which no item leaks, with their columns."""
    names = S.free(docs, "t0"), S.free(docs, "t1")
    with S.scope(docs.sparkSession) as run:
        found = run.hand_on(text_leaks(docs, benchmark).select("t0", "t1").distinct().toDF(*names), "found")
    return docs.select("*", *S.text_key(F.col("text"), names)).join(_small(found), list(names), "left_anti").select(*(f"`{c}`" for c in docs.columns))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(S.table(spark, sf_dir, "documents"), S.table(spark, sf_dir, "benchmark"))


OP5_SQL = rf"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
iw as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from benchmark),
ds as (select doc_id, i - 1 as p, array_to_string(w[i : i + 4], ' ') as h, len(w) as n from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from dw)),
sh as (select item_id, i - 1 as o, array_to_string(w[i : i + 4], ' ') as h, len(w) as size from (select item_id, w, unnest(range(1, len(w) - 3)) as i from iw)),
im as (select item_id, any_value(size) as size, count(*) as m from sh group by 1),
likely as (select doc_id, item_id, any_value(n) as n, any_value(im.size) as size, any_value(m) as m from ds join sh using (h) join im using (item_id) group by 1, 2 having 100 * count(*) >= {PERCENT} * any_value(m)),
win as (select doc_id, item_id, size, m, unnest(range(0, greatest(0, n - size) + 1)) as s from likely),
ws as (select w.doc_id, w.item_id, m, s, h, count(*) as a from win w join ds on ds.doc_id = w.doc_id and p >= s and p <= s + size - 5 group by 1, 2, 3, 4, 5),
ic as (select item_id, h, count(*) as b from sh group by 1, 2),
sim as (select doc_id, item_id, s, sum(least(a, coalesce(b, 0))) as both_, sum(a) + any_value(m) - sum(least(a, coalesce(b, 0))) as all_ from ws left join ic using (item_id, h) group by 1, 2, 3),
best as (select doc_id, item_id, max(both_ / all_) as v from sim where 100 * both_ >= {PERCENT} * all_ group by 1, 2),
agg as (select doc_id, count(*) as n, string_agg(cast(item_id as varchar), ',' order by item_id) as ids, max(v) as v from best group by 1)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_leaks, coalesce(ids, '') as leaked_items, cast(coalesce(v, 0) as double) as best_similarity, n is null as kept from documents d left join agg using (doc_id)
"""
