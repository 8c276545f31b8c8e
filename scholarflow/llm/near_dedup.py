"""MinHash near-dedup by a signature-coordinate inverted join.

Each distinct shingle set has a signature of COORDINATES minima. Every
coordinate-value pair is a posting list. Two sets with a similarity of 0.75
agree in at least MATCHES coordinates but for a chance below 1e-6, so
  * lists of one set, and sets with fewer than MATCHES other lists, are skipped;
  * of a set's lists, put in order of their length, only a prefix is kept: two
    sets that agree in MATCHES lists share one of any (lists - MATCHES + 1).
A list's sets aren't paired with each other. Rounds link each to one leader of
its list, confirm the link on the full sets, and take whole components together:
a list of which all sets are in one component is done and skipped from then on.
Sets of lists that are left after some rounds are compared across components
only, by a second inverted join: of a set's shingles, rare ones first, a prefix
is posted that a linked set can't miss, so sets that differ from their leader in
ways of their own meet nothing.

Sets are of 64-bit shingle hashes, spread over Spark as rows; components are
found by Spark joins as well.

A null or empty text has an empty set and links with nothing, whatever its id.
A null doc_id links with nothing, its component_id is null and it is kept. Rows
with the same doc_id are one document: their sets are linked, and each keeps its
own n_shingles. Ids may be of any type that has an order. Extra columns aren't
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _spark as S
from . import _text as X

SHINGLE = 5
PERCENT = 75
COORDINATES = 32
#: A pair at 0.75 agrees in 9 coordinates or fewer with a chance of 2e-7.
MATCHES = 10
ROUNDS = 3
#: Sets that post one shingle and meet in one task, about, on each side.
CELL = 2048

_FACTORS = X.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * X.MULT) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of COORDINATES minima for each set that isn't empty; zeros for the others."""
    out = np.zeros((len(sets), COORDINATES), np.int64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        begins = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        for k in range(COORDINATES):
            out[full, k] = np.minimum.reduceat((flat * _FACTORS[k]) >> np.uint64(32), begins)
    return out


def _blocks(sets, most: int = 1 << 17):
    """Lists of sets with about `most` shingles in all."""
    block, size = [], 0
    for s in sets:
        block.append(s)
        size += len(s)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, t0 (hash of the text), n (shingles), k0 and k1 (128 bits that stand for the set), sig; one row per row of docs."""

    def run(batches):
        for b in S.slices(batches):
            n, k0, k1, sig = [], [], [], []
            for sets in _blocks(X.shingle_sets([t or "" for t in b.column(2).to_pylist()], SHINGLE)):
                n += [len(s) for s in sets]
                k0 += [_key(s, 3, np.bitwise_xor) for s in sets]
                k1 += [_key(s, 5, np.add) for s in sets]
                sig.append(signatures(sets))
            flat = np.concatenate(sig).ravel() if sig else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * COORDINATES, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(k0, pa.int64()), pa.array(k1, pa.int64()), lists], ["doc_id", "t0", "n", "k0", "k1", "sig"])

    S.small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64("text").alias("t0"), "text")
    return rows.mapInArrow(run, _schema(rows.schema["doc_id"], t0=T.LongType(), n=T.LongType(), k0=T.LongType(), k1=T.LongType(), sig=T.ArrayType(T.LongType())))


def _key(s: np.ndarray, salt: int, operation: np.ufunc) -> int:
    """64 bits that stand for a set: its mixed shingles under an operation in any order."""
    return int(operation.reduce(X.mix(s + np.uint64(salt)), dtype=np.uint64).view(np.int64)) if len(s) else 0


def _schema(first: T.StructField, **others: T.DataType) -> T.StructType:
    return T.StructType([first, *(T.StructField(k, t) for k, t in others.items())])


def full_sets(docs: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """rep, set (array of shingle hashes) of the wanted (rep, doc_id, t0): rows of docs are found by id and text."""

    def run(batches):
        for b in S.slices(batches):
            sets = list(X.shingle_sets([t or "" for t in b.column(1).to_pylist()], SHINGLE))
            bounds = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int64()))], ["rep", "set"])

    rows = docs.withColumn("t0", F.xxhash64("text")).join(wanted, ["doc_id", "t0"]).select("rep", "text")
    if repeated:
        rows = rows.dropDuplicates(["rep"])  # rows with one id and one text
    return rows.mapInArrow(run, "rep long, set array<long>")


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, comp (the smallest node it is linked with) for each node of edges (a, b)."""
    with S.scope(edges.sparkSession) as run:
        return run.hand_on(_components(edges, name), name)


def _components(edges: DataFrame, name: str) -> DataFrame:
    both = S.save(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges")
    labels = S.save(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "node"), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("near")).withColumnRenamed("a", "node")
        lower = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("low"))
        # and from there on to what that node itself has reached
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("far"))
        new = S.save(lower.join(jump, "low", "left").select("node", "comp", F.least("low", F.coalesce("far", "low")).alias("new")), f"{name}-{turn}")
        labels = new.select("node", F.col("new").alias("comp"))
        if new.where("new <> comp").isEmpty():
            return labels


def _agree(a: str, b: str):
    return F.expr(f"size(filter(zip_with({a}, {b}, (x, y) -> x = y), z -> z))")


def near_duplicates(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs."""
    with S.scope(docs.sparkSession) as run:
        return run.hand_on(_near_duplicates(docs.select("doc_id", "text"), rounds), "near-duplicates")


def _near_duplicates(docs: DataFrame, rounds: int) -> DataFrame:
    sketch = S.save(sketches(docs), "sketches")
    known = sketch.where("n > 0 and doc_id is not null")
    # a class is a set: its number stands for it, whatever ids have it. Numbers follow the ids, so that
    # the first leader of a list is its oldest document: copies are made from what was there before
    found = known.groupBy("k0", "k1", "n").agg(F.min(F.struct("doc_id", "t0")).alias("x"), F.first("sig").alias("sig"))
    classes = S.save(found.select("k0", "k1", "n", "x.doc_id", "x.t0", "sig").orderBy("doc_id", "t0").withColumn("rep", F.monotonically_increasing_id()), "classes")
    repeated = not known.groupBy("doc_id").count().where("count > 1").isEmpty()
    links = _links(docs, classes, rounds, repeated)
    if repeated:
        member = S.save(known.join(classes.select("k0", "k1", "n", "rep"), ["k0", "k1", "n"]).select("doc_id", "rep").distinct(), "members")
        several = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).where("a <> hi").drop("hi")
        links = links.union(member.join(several, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b")))
    comp = components(links, "all")
    first = comp.join(classes.select(F.col("rep").alias("node"), "doc_id"), "node").groupBy("comp").agg(F.min("doc_id").alias("first"))
    named = comp.join(first, "comp").select(F.col("node").alias("rep"), "first")
    ids = classes.select("rep", "k0", "k1", "n", "doc_id").join(named, "rep", "left").select("k0", "k1", "n", F.coalesce("first", "doc_id").alias("component_id"))
    linked = known.select("doc_id", "k0", "k1", "n").join(ids, ["k0", "k1", "n"]).select("doc_id", "n", "component_id")
    alone = sketch.where("not (n > 0 and doc_id is not null)").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = linked.union(alone).withColumnRenamed("n", "n_shingles")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _links(docs: DataFrame, classes: DataFrame, rounds: int, repeated: bool) -> DataFrame:
    """a, b: confirmed links between classes that span the components of all links."""
    with S.scope(docs.sparkSession) as run:
        return run.hand_on(_all_links(docs, classes, rounds, repeated), "links")


def _all_links(docs: DataFrame, classes: DataFrame, rounds: int, repeated: bool) -> DataFrame:
    spark = docs.sparkSession
    posts = classes.select("rep", F.posexplode("sig").alias("at", "value")).select("rep", F.expr("shiftleft(cast(at as bigint), 32) | value").alias("list"))
    lists = posts.groupBy("list").agg(F.count("*").alias("size")).where("size > 1")
    held = posts.join(lists, "list").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("size", "list"))).alias("l"))  # COORDINATES at most
    held = held.where(F.size("l") >= MATCHES).select("rep", F.explode(F.expr(f"slice(l, 1, size(l) - {MATCHES} + 1)")).alias("x")).select("rep", "x.list")
    held = S.save(held, "postings")
    reps = held.select("rep").distinct()
    sigs = S.save(classes.join(reps, "rep", "left_semi").select("rep", "sig", "n", "doc_id", "t0"), "signatures")
    sets = S.save(full_sets(docs, sigs.select("rep", "doc_id", "t0"), repeated), "sets")
    links = spark.createDataFrame([], "a bigint, b bigint")
    comp = None
    for k in range(rounds):
        live = _live(held, comp)
        lead = live.groupBy("list").agg(F.min(F.struct((F.xxhash64(F.lit(k), "rep") if k else F.col("rep")).alias("rank"), "rep", "comp")).alias("x"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        pairs = live.join(lead.select("list", F.col("x.rep").alias("lead"), F.col("x.comp").alias("its")), "list").where("comp <> its").select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()
        links = S.save(links.union(_confirmed(pairs, sigs, sets)), f"links-{k}")
        comp = components(links, f"round-{k}")
    live = _live(held, comp)
    open_ = live.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("list")
    pairs = _across(live.join(open_, "list").select("rep", "comp").distinct(), sets)
    return links.union(_confirmed(pairs, sigs, sets))


def _needed(n: str, m: str) -> str:
    """SQL of the least number of common shingles that links sets of n and m."""
    return f"({PERCENT} * ({n} + {m}) + {99 + PERCENT}) div {100 + PERCENT}"


def _across(reps: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: all pairs of reps (rep, comp) of different components that may be linked.

    Shingles are put in one order for all sets, rare ones first. Linked sets of
    n and m shingles have `_needed` in common, so they share one of the first
    n - needed + 1 of one set and the first m - needed + 1 of the other. What all
    copies of a text have stands last and is seldom reached.
    """
    mine = reps.join(sets, "rep").select("rep", "comp", F.size("set").cast("long").alias("n"), F.explode("set").alias("s"))
    seen = mine.groupBy("s").agg(F.count("*").alias("c"))
    order = mine.join(seen, "s").groupBy("rep", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("l"))  # one set at most
    first = order.select("rep", "comp", "n", F.posexplode(F.expr(f"slice(l, 1, cast(n - ({PERCENT} * n + 99) div 100 + 1 as int))")).alias("at", "x"))
    first = S.save(first.where("x.c > 1").select("rep", "comp", "n", F.col("x.s").alias("s"), (F.col("at") + 1).alias("at")), "prefixes")
    ends = first.groupBy("s").agg(F.min("n").alias("least"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.count("*") / CELL).cast("int").alias("cells")).where("lo <> hi").select("s", "least", "cells")
    # sizes of a link differ by a third at most: those of neighbouring steps meet (a little wider, for rounding)
    live = first.join(ends, "s").withColumn("step", F.expr("cast(floor(ln(n) / ln(1.334)) as int)"))
    small = live.where(f"at <= n - {_needed('n', 'n')} + 1").select("s", F.explode(F.expr("flatten(transform(array(step, step + 1), t -> transform(sequence(0, cells - 1), c -> named_struct('step', t, 'x', cast(pmod(xxhash64(rep), cells) as int), 'y', c))))")).alias("k"), F.col("rep").alias("a"), "comp", "n", "at").select("s", "k.*", "a", "comp", "n", "at")
    large = live.where(f"at <= n - {_needed('least', 'n')} + 1").select("s", "step", F.explode(F.expr("sequence(0, cells - 1)")).alias("x"), F.expr("cast(pmod(xxhash64(rep), cells) as int)").alias("y"), F.col("rep").alias("b"), F.col("comp").alias("other"), F.col("n").alias("m"), F.col("at").alias("place"))
    both = f"at <= n - {_needed('n', 'm')} + 1 and place <= m - {_needed('n', 'm')} + 1 and 100 * n >= {PERCENT} * m"
    # the sets of a frequent shingle meet in cells: parts of the one side by parts of the other
    pairs = small.join(large, ["s", "step", "x", "y"]).where(f"(n < m or n = m and a < b) and comp <> other and {both}")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _live(held: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return held.withColumn("comp", F.col("rep"))
    return held.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "list", F.coalesce("comp", "rep").alias("comp"))


def _confirmed(pairs: DataFrame, sigs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose signatures match often enough and whose full sets are similar enough."""
    one, two = sigs.select(F.col("rep").alias("a"), F.col("sig").alias("x"), F.col("n").alias("n")), sigs.select(F.col("rep").alias("b"), F.col("sig").alias("y"), F.col("n").alias("m"))
    near = pairs.join(one, "a").join(two, "b").where((_agree("x", "y") >= MATCHES) & (100 * F.least("n", "m") >= PERCENT * F.greatest("n", "m"))).select("a", "b")
    near = S.save(near, "near")
    full = near.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("set").alias("y")), "b")
    both = full.withColumn("both", F.size(F.array_intersect("x", "y"))).withColumn("all", F.size("x") + F.size("y") - F.col("both"))
    return both.where(f"100 * both >= {PERCENT} * all").select("a", "b")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(S.table(spark, sf_dir, "documents"))
