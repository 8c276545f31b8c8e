"""Sharding by a minimax contiguous partition.

Texts are ordered by a hash, of which the first UNIT_BITS bits make atomic
groups: equal texts are in one group, and groups are as many at every size of
input, so their sizes (at most 2**UNIT_BITS numbers) fit the driver. The
smallest capacity for which a greedy pass fills no more than the wanted shards
is found by binary search. Greedy passes from both ends under that capacity say how
early and how late each shard can begin; each is cut there where it comes next
to its equal share, so the last shards aren't left with a remainder.

A null text has a size of 16 bytes like an empty one. Rows are dealt by their
text, so null and repeated ids are dealt like others; slots follow the order in
which rows are read. Extra columns aren't read.
"""

from __future__ import annotations

import bisect
import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import _spark as S

SHARDS = 40
UNIT_BITS = 16
#: Rows' own bytes beside the text.
OVERHEAD = 16
#: Parts of a shard that are numbered by themselves.
CELLS = 512


def fill(sizes: list[int], capacity: int, shards: int) -> list[int] | None:
    """Where shards begin if each takes groups while they fit; None: they need more shards."""
    begins, left = [], -1
    for i, size in enumerate(sizes):
        if size > capacity:
            return None
        if left < size:
            if len(begins) == shards:
                return None
            begins.append(i)
            left = capacity
        left -= size
    return begins


def minimax(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and where its shards begin."""
    lo, hi = max([0, *sizes]), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        if fill(sizes, mid, shards) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo, even(sizes, lo, shards)


def even(sizes: list[int], capacity: int, shards: int) -> list[int]:
    """Where shards of at most this capacity begin, each next to its equal share; sizes are above 0."""
    n, sums = len(sizes), [0, *itertools.accumulate(sizes)]
    shards = min(shards, n)
    early = [n]  # the first places from which the shards that follow can hold the rest
    for _ in range(shards):
        early.insert(0, bisect.bisect_left(sums, sums[early[0]] - capacity))
    begins = [0] * bool(n)
    for k in range(1, shards):
        lo = max(early[k], begins[-1] + 1)
        hi = min(bisect.bisect_right(sums, sums[begins[-1]] + capacity) - 1, n - shards + k)
        share = sums[n] * k / shards
        at = bisect.bisect_left(sums, share)
        begins.append(min(max(at - (at > 0 and share - sums[at - 1] < sums[at] - share), lo), hi))
    return begins


def shard(docs: DataFrame, shards: int = SHARDS, unit_bits: int = UNIT_BITS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: one row per row of docs."""
    text = F.coalesce("text", F.lit(""))
    # rows are dealt to cells in turn, so that rows alike in everything aren't one cell's
    rows = S.save(docs.select("doc_id", (F.monotonically_increasing_id() % CELLS).cast("int").alias("cell"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(text), 64 - unit_bits).cast("int").alias("unit")), "sizes")
    units = sorted((r.unit, r.size) for r in rows.groupBy("unit").agg(F.sum("size").alias("size")).collect())  # 2**unit_bits at most
    _, begins = minimax([size for _, size in units], shards)
    firsts = [units[i][0] for i in begins[1:]]
    number = sum((F.when(F.col("unit") >= u, 1).otherwise(0) for u in firsts), F.lit(0)).cast("int")
    dealt = rows.select("doc_id", "size", "text_crc32", number.alias("shard"), "cell")
    # shards * CELLS counts at most, so that no task numbers a whole shard
    counts = dealt.groupBy("shard", "cell").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(W.partitionBy("shard").orderBy("cell")) - F.col("n")).drop("n")
    placed = dealt.withColumn("rank", F.row_number().over(W.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size"))).join(counts, ["shard", "cell"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(S.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
