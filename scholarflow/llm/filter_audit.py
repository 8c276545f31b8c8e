"""How five filters of documents interact, in every order of them, for each source.

DataFrame and SQL functions only. Words are exploded, counted by (document, word)
and then by document: totals and distinct words. Rows are dealt to tasks by their
text and a salt once, before words are made, so both counts need no shuffle of
words. Flags of the characters, of copies and of labels are joined to them, and 32
conditional counts for each source (one for each set of failed filters), again for
good and for toxic documents, hold all that any order can ask for.

The filters, and when a document fails them (words: maximal runs of anything but
space and U+0009 to U+000D, as they are written):
  A  fewer than 200 words
  B  100 * distinct words < 50 * words
  C  100 * [A-Z] characters > 2 * code points
  D  any of # $ % & * |
  E  equal to the text of a smaller doc_id of the table, removed or not

A null text is ''; it fails A, and E like any other text. A null source is ''.
Null ids come after all others: such a row fails E if an id that isn't null has its
text. Rows with one id are documents of their own; equal ids don't fail E for each
other. A label that a document has in any row of `labels` holds; one that is null,
or of a null id, says nothing. No documents: no rows. Extra columns aren't read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark as S

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 2
SIGNS = "#$%&*|"
#: Rows of one text are dealt to as many tasks.
SALTS = 64
SETS = 1 << len(FILTERS)


def word_counts(docs: DataFrame) -> DataFrame:
    """t0, t1 (hash of the text), rows, words, distinct: one row for each text with a word, words being those of one row.

    A word begins a new document's count wherever it stands, so rows of one text and salt are counted together:
    their words are a multiple of one row's.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*S.text_key(text), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"), text.alias("text"))
    # a run of separators leaves '' between them; a single character is split on without a pattern
    spaced = rows.repartition("t0", "t1", "salt").select("t0", "t1", "salt", F.explode(F.split(F.regexp_replace("text", r"[\x09-\x0D]", " "), " ")).alias("word")).where("word <> ''")
    by_word = spaced.groupBy("t0", "t1", "salt", "word").agg(F.count("*").alias("n"))
    by_part = by_word.groupBy("t0", "t1", "salt").agg(F.sum("n").alias("all"), F.count("*").alias("distinct"))
    return by_part.groupBy("t0", "t1").agg(F.sum("all").alias("all"), F.max("distinct").alias("distinct"))


def _flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """t0, t1, part, c, d, good, toxic, n (rows), first (the least id), at_first (rows with it)."""
    text = F.coalesce("text", F.lit(""))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), *S.text_key(text), (100 * capitals > MAX_CAPITALS_PERCENT * F.length(text)).alias("c"), text.rlike(f"[{SIGNS}]").alias("d"))
    rows = rows.groupBy("doc_id", "part", "t0", "t1", "c", "d").agg(F.count("*").alias("n"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("coalesce(quality = 1, false)")).alias("good"), F.max(F.expr("coalesce(toxic = 1, false)")).alias("toxic"))
    rows = rows.join(known, "doc_id", "left").withColumns({k: F.coalesce(k, F.lit(False)) for k in ("good", "toxic")})
    return rows.groupBy("t0", "t1", "part", "c", "d", "good", "toxic").agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("at_first"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, failed (bits of FILTERS, A lowest), n: counts of documents, not yet one for each set of failed filters."""
    groups = _flagged(docs, labels)
    texts = groups.groupBy("t0", "t1").agg(F.sum("n").alias("rows"), F.min("first").alias("oldest"))
    both = groups.join(texts, ["t0", "t1"]).join(word_counts(docs), ["t0", "t1"], "left")
    words, distinct = F.coalesce(F.expr("`all` div rows"), F.lit(0)), F.coalesce("distinct", F.lit(0))
    flags = [words < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * words, F.col("c"), F.col("d")]
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(flags)), F.lit(0))
    # the rows of a text's least id pass E, and all rows where no row has an id
    oldest = F.expr("case when oldest is null then n when first = oldest then at_first else 0 end")
    parted = both.select("part", "good", "toxic", bits.alias("bits"), "n", oldest.alias("pass"))
    return parted.select("part", "good", "toxic", F.expr(f"explode(array(named_struct('failed', bits, 'n', pass), named_struct('failed', bits | {SETS // 2}, 'n', n - pass)))").alias("x")).select("part", "good", "toxic", "x.failed", "x.n")


def set_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, n0 to n31, good0 to good31, toxic0 to toxic31: documents for each set of failed filters."""
    kinds = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counts = [F.sum(F.when(which & (F.col("failed") == m), F.col("n")).otherwise(0)).alias(f"{k}{m}") for k, which in kinds.items() for m in range(SETS)]
    return failures(docs, labels).groupBy("part").agg(*counts)


def _orders() -> str:
    """SQL of an array of (filter_order, step, bit of the step's filter, bits of those before it)."""
    steps = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for k, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            steps.append(f"named_struct('filter_order', '{''.join(order)}', 'step', {k + 1}, 'bit', {bit}, 'before', {before})")
            before |= bit
    return f"array({', '.join(steps)})"


def _total(array: str, where: str) -> str:
    return f"aggregate(sequence(0, {SETS - 1}), 0L, (a, m) -> a + case when {where} then {array}[m] else 0L end)"


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each source, order and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    counts = set_counts(docs, labels)
    lists = counts.select("part", *(F.array(*(f"{k}{m}" for m in range(SETS))).alias(k) for k in ("n", "good", "toxic")))
    # a set of k failed filters begins with each of them in 120 / k orders
    rows = lists.select("*", F.expr(f"explode({_orders()})").alias("x")).select("part", "n", "good", "toxic", "x.*")
    here, late = "m & bit <> 0 and m & before = 0", "m & bit <> 0 and m & before <> 0"
    columns = {
        "kept": _total("n", "m & (bit | before) = 0"),
        "removed": _total("n", here),
        "redundant": _total("n", late),
        "unique_fails": "n[bit]",
        "good_lost": _total("good", here),
        "toxic_lost": _total("toxic", here),
        "shapley": _total("n", "m & bit <> 0").replace("n[m]", "n[m] * (120 div bit_count(m))"),
    }
    return rows.select("part", "filter_order", "step", *(F.expr(e).cast("long").alias(k) for k, e in columns.items()))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(S.table(spark, sf_dir, "documents"), S.table(spark, sf_dir, "labels"))


OP11_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t, coalesce(source, '') as part from documents),
w as (select doc_id, t, part, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d),
oldest as (select t, min(doc_id) as first from d group by t),
known as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels where doc_id is not null group by doc_id),
f as (select w.part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    [len(ws) < {MIN_WORDS}, 100 * len(list_distinct(ws)) < {MIN_DISTINCT_PERCENT} * len(ws),
     100 * (length(w.t) - length(regexp_replace(w.t, '[A-Z]', '', 'g'))) > {MAX_CAPITALS_PERCENT} * length(w.t),
     regexp_matches(w.t, '[#$%&*|]'), coalesce(first < w.doc_id or first is not null and w.doc_id is null, false)] as fails
  from w join oldest using (t) left join known using (doc_id)),
sets as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, fails),
letter as (select unnest(['A', 'B', 'C', 'D', 'E']) as l),
orders as (select a.l || b.l || c.l || d.l || e.l as filter_order from letter a, letter b, letter c, letter d, letter e
  where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
places as (select filter_order, step, instr('ABCDE', filter_order[step]) as i, list_transform(range(1, step), lambda k: instr('ABCDE', filter_order[k])) as before from orders, (select unnest(range(1, 6)) as step)),
said as (select part, filter_order, step, fails[i] as hit, len(list_filter(before, lambda k: fails[k])) > 0 as gone, len(list_filter(fails, lambda x: x)) as many, n, good, toxic from sets, places)
select part, filter_order, cast(step as integer) as step, cast(sum(case when not hit and not gone then n else 0 end) as bigint) as kept, cast(sum(case when hit and not gone then n else 0 end) as bigint) as removed,
  cast(sum(case when hit and gone then n else 0 end) as bigint) as redundant, cast(sum(case when hit and many = 1 then n else 0 end) as bigint) as unique_fails,
  cast(sum(case when hit and not gone then good else 0 end) as bigint) as good_lost, cast(sum(case when hit and not gone then toxic else 0 end) as bigint) as toxic_lost,
  cast(sum(case when hit then n * (120 // many) else 0 end) as bigint) as shapley
from said group by part, filter_order, step
"""
