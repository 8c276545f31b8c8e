"""Quality rules: base counts of each text, and lines that many documents of a host share.

DataFrame and SQL functions only. A line is normalised (lower case, one space
between words) and hashed; per host, the distinct documents that hold it are
counted, equal texts being one document. Lines in more than `max_docs` of them
are boilerplate; a document of which too few words are left without these is
rejected.

Rows with a null or empty text have counts of 0 and fail; a null source is the
host ''. Verdicts hang on the text and the host, so repeated rows and null ids
are judged like any other row. Nothing but doc_id, text and source is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark as S

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line in more distinct documents of a host than this is boilerplate.
MAX_DOCS = 20
#: A document with a smaller share of its words left is depleted.
MIN_LEFT = 0.3
#: A frequent line's rows are dealt to as many tasks.
SALTS = 16
#: Texts of as many words have 51 bits or fewer left beside a place: a false repeat has a chance of 4e-9 at most in shorter ones.
PACKED = 1 << 12

_HAS_WORD = "[^\\\\x20\\\\x09-\\\\x0D]"
_WORD = _HAS_WORD + "+"


def base_counts(docs: DataFrame, packed: int = PACKED) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    A 3-word window's hash is shifted to make room for its place, so that one
    sort of longs brings equal windows together; the places of those found twice
    or more then tell how many words they cover. In texts of PACKED words or
    more a shifted hash would have too few bits left: there pairs of the whole
    hash and the place are sorted.
    """
    out = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    out = out.withColumn("_words", F.expr(f"regexp_extract_all(_text, '{_WORD}', 0)"))
    out = out.withColumn("_n", F.size("_words")).withColumn("_bits", F.expr("length(bin(_n))"))
    out = out.withColumn("_packed", F.expr(f"case when _n >= 4 and _n < {packed} then sort_array(transform(sequence(1, _n - 2), i -> shiftleft(xxhash64(_words[i - 1], _words[i], _words[i + 1]), _bits) | i)) else array() end"))
    out = out.withColumn("_m", F.size("_packed"))
    out = out.withColumn(
        "_twice",
        F.expr("""case when _m > 0 then array_sort(filter(transform(sequence(0, _m - 1), k -> case
            when k > 0 and shiftrightunsigned(_packed[k], _bits) = shiftrightunsigned(_packed[greatest(k - 1, 0)], _bits)
              or k < _m - 1 and shiftrightunsigned(_packed[k], _bits) = shiftrightunsigned(_packed[least(k + 1, _m - 1)], _bits)
            then _packed[k] & (shiftleft(1L, _bits) - 1) else 0L end), p -> p > 0)) else array() end"""),
    )
    out = out.withColumn("_pairs", F.expr(f"case when _n >= {packed} then sort_array(transform(sequence(1, _n - 2), i -> struct(xxhash64(_words[i - 1], _words[i], _words[i + 1]) as h, cast(i as bigint) as i))) else array() end"))
    out = out.withColumn("_m", F.size("_pairs"))
    out = out.withColumn(
        "_twice",
        F.expr("""case when _m > 0 then array_sort(filter(transform(sequence(0, _m - 1), k -> case
            when k > 0 and _pairs[k].h = _pairs[greatest(k - 1, 0)].h or k < _m - 1 and _pairs[k].h = _pairs[least(k + 1, _m - 1)].h
            then _pairs[k].i else 0L end), p -> p > 0)) else _twice end"""),
    )
    out = out.withColumn("_lines", F.expr(f"filter(split(_text, '\\n', -1), l -> l rlike '{_HAS_WORD}')"))
    out = out.withColumns(
        {
            "n_words": F.col("_n").cast("long"),
            "word_chars": F.expr("cast(length(array_join(_words, '')) as bigint)"),
            "n_symbols": F.expr("cast(length(_text) - length(regexp_replace(_text, '[#*$%&|<>]', '')) as bigint)"),
            "n_dup_lines": F.expr("cast(size(_lines) - size(array_distinct(_lines)) as bigint)"),
            "n_repeat_words": F.expr("aggregate(_twice, named_struct('covered', 0L, 'last', -9L), (a, p) -> named_struct('covered', a.covered + least(3L, p - a.last), 'last', p), a -> a.covered)"),
        }
    )
    out = out.drop("_text", "_words", "_n", "_bits", "_packed", "_pairs", "_m", "_twice", "_lines")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each line with a word of each distinct text of a host: host, t0, t1, line (hash), words."""
    lined = docs.select(F.coalesce("source", F.lit("")).alias("host"), *S.text_key(F.col("text")), F.expr(f"filter(split(coalesce(text, ''), '\\n', -1), l -> l rlike '{_HAS_WORD}')").alias("l"))
    normal = lined.withColumn("w", F.expr(f"transform(l, x -> regexp_extract_all(lower(x), '{_WORD}', 0))")).drop("l")
    hashed = normal.withColumn("lines", F.expr("transform(w, x -> named_struct('line', xxhash64(array_join(x, ' ')), 'words', size(x)))")).drop("w")
    once = hashed.dropDuplicates(["host", "t0", "t1"])
    return once.select("host", "t0", "t1", F.explode("lines").alias("x")).select("host", "t0", "t1", "x.line", "x.words")


def frequent_lines(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """host, line (hash of the normalised line), n_docs: lines in more than max_docs distinct documents of a host."""
    return _frequent(_lines(docs), max_docs)


def _frequent(lines: DataFrame, max_docs: int) -> DataFrame:
    once = lines.groupBy("host", "line", "t0", "t1").agg(F.lit(1).alias("one"))
    return once.groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs)


def removed_words(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """host, t0, t1, n_removed, lines: for each distinct text with frequent lines, their words and hashes."""
    lines = _lines(docs)
    frequent = _frequent(lines, max_docs).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lines.withColumn("salt", F.expr(f"cast(pmod(t0, {SALTS}) as int)"))
    return salted.join(frequent, ["host", "line", "salt"]).groupBy("host", "t0", "t1").agg(F.sum("words").alias("n_removed"), F.collect_set("line").alias("lines"))


def quality_rules(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """One row per document: doc_id, the base counts, n_removed_words and kept."""
    counted = base_counts(docs.select("doc_id", "text", "source"))
    keyed = counted.withColumn("host", F.coalesce("source", F.lit(""))).select("*", *S.text_key(F.col("text"))).drop("text", "source")
    # equal texts have equal keys, null among them: xxhash64 of a null is its seed
    # copies of one text are dealt to several tasks
    removed = removed_words(docs, max_docs).drop("lines").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = keyed.withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
    out = salted.join(removed, ["host", "t0", "t1", "salt"], "left").withColumn("n_removed_words", F.coalesce("n_removed", F.lit(0)).cast("long"))
    depleted = F.col("n_words") - F.col("n_removed_words") < F.lit(min_left) * F.col("n_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"), "n_removed_words")


def clean_texts(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """docs with clean_text: the text without its frequent lines (null stays null). A column of docs of that name is replaced."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != "clean_text")).alias("row"))
    keyed = whole.select("row", F.coalesce("row.source", F.lit("")).alias("host"), *S.text_key(F.col("row.text")))
    out = keyed.join(removed_words(docs, max_docs).drop("n_removed"), ["host", "t0", "t1"], "left").withColumn("lines", F.coalesce("lines", F.expr("cast(array() as array<bigint>)")))
    return out.select("row.*", F.expr(f"array_join(filter(split(row.text, '\\n', -1), l -> not array_contains(lines, xxhash64(array_join(regexp_extract_all(lower(l), '{_WORD}', 0), ' ')))), '\\n')").alias("clean_text"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(S.table(spark, sf_dir, "documents"))


OP1_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t, coalesce(source, '') as host from documents),
w as (select doc_id, t, host, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, string_split(t, chr(10)) as ls from d),
ln as (select doc_id, t, host, unnest(ls) as l, generate_subscripts(ls, 1) as i from w),
solid as (select doc_id, t, host, l, i, regexp_extract_all(lower(l), '[^\x20\x09-\x0D]+') as lw from ln where regexp_matches(l, '[^\x20\x09-\x0D]')),
dup as (select doc_id, count(*) - count(distinct l) as n_dup_lines from solid group by doc_id),
freq as (select host, array_to_string(lw, ' ') as line from solid group by 1, 2 having count(distinct t) > {MAX_DOCS}),
gone as (select s.doc_id, sum(len(lw)) as n_removed from solid s join freq f on s.host = f.host and array_to_string(s.lw, ' ') = f.line group by 1),
win as (select doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] as g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c >= 2),
cov as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from rep) group by 1),
base as (select w.doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, cast(coalesce(n_removed, 0) as bigint) as n_removed_words
  from w left join dup using (doc_id) left join cov using (doc_id) left join gone using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
  not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) and not (n_words - n_removed_words < {MIN_LEFT} * n_words) as kept, n_removed_words from base
"""
