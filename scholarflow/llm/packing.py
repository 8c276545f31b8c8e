"""Best-fit packing of documents into sequences, by several capacities at once.

Pieces are at most `length` tokens long, so the number of pieces of each length
(at most `length` numbers) is all that packing has to know. On the driver,
lengths go from the longest down; each goes to the open sequences that fit it
under every capacity (tokens, documents, attention cost: the sum of squared
lengths) and are left with the smallest residual norm (or have the greatest
weighted dot-product with it). Sequences alike are one entry with a count, so
work depends on the lengths, not on the pieces. The plan says for ranks of each
length where they go; Spark numbers the pieces of a length and looks it up.

With the default capacities for documents and attention cost only tokens bind.
A null or empty text is the end id alone. Rows with equal or null ids are
packed each by itself; pieces alike in everything take places in any order.
Extra columns aren't read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import _spark as S
from .token_output import END, TOKENIZER, _ids

LENGTH = 2048
#: Pieces of one length that a task numbers, about.
CELL = 100_000


def plan(counts: dict[int, int], length: int = LENGTH, max_docs: int | None = None, max_cost: int | None = None, policy: str = "norm") -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, pieces, first sequence, pieces for each sequence, offset).

    Piece number r of a row goes to sequence first + r // per, at offset + (r % per) * length.
    """
    caps = np.array([length, max_docs or length, max_cost or length * length], float)
    state = np.zeros((0, 3))  # residual capacities of each entry
    first, count, out, made = [], [], [], 0
    for size in sorted(counts, reverse=True):
        demand = np.array([size, 1, size * size], float)
        if (demand > caps).any():
            raise ValueError(f"a piece of {size} tokens fits no sequence")
        rank, left = 0, counts[size]
        while left:
            fits = np.flatnonzero((state >= demand).all(1))
            if len(fits):
                rest = (state[fits] - demand) / caps
                best = int(fits[np.argmin((rest**2).sum(1)) if policy == "norm" else np.argmax((state[fits] / caps) @ (demand / caps))])
            else:
                per = int((caps // demand).min())
                state = np.vstack([state, caps])
                first.append(made)
                count.append(max(1, left // per))
                made += count[-1]
                best = len(state) - 1
            per = min(left, int((state[best] // demand).min()))
            many = min(count[best], left // per)
            out.append((size, rank, many * per, first[best], per, int(length - state[best][0])))
            rank, left = rank + many * per, left - many * per
            if many < count[best]:  # the others stay as they are
                state = np.vstack([state, state[best]])
                first.append(first[best] + many)
                count.append(count[best] - many)
                count[best] = many
            state[best] = state[best] - per * demand
            if state[best].min() < 1:
                state = np.delete(state, best, 0)
                del first[best], count[best]
    return out


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the first piece takes what whole ones leave."""

    def run(batches):
        for b in S.slices(batches):
            rows, which = [], []
            for i, ids in enumerate(_ids(b.column(1).to_pylist(), tokenizer, end)):
                cuts = [0, *range((len(ids) - 1) % length + 1, len(ids) + 1, length)]
                for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    rows.append((k, s, e - s, zlib.crc32(ids[s:e].astype("<u4").tobytes())))
                    which.append(i)
            k, s, n, c = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which, pa.int64())), pa.array(k, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    S.small_batches(docs.sparkSession)
    kinds = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *(T.StructField(n, k) for n, k in kinds)]))


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, max_docs: int | None = None, max_cost: int | None = None, policy: str = "norm") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    # numbered when they are saved, so that pieces alike in everything can be told apart
    cut = S.save(pieces(docs, tokenizer, length).withColumn("number", F.monotonically_increasing_id()), "pieces")
    counts = {int(r["length"]): int(r["count"]) for r in cut.groupBy("length").count().collect()}  # `length` rows at most
    steps = plan(counts, length, max_docs, max_cost, policy)
    table: dict[int, np.ndarray] = {}
    for size in counts:
        table[size] = np.array([s[1:] for s in steps if s[0] == size], np.int64)
    cells = max(16, -(-max([0, *counts.values()]) // CELL))
    dealt = cut.withColumn("cell", F.expr(f"cast(pmod(xxhash64(number), {cells}) as int)"))
    before = dealt.groupBy("length", "cell").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("cell")) - F.col("n")).drop("n")
    ranked = dealt.withColumn("r", F.row_number().over(W.partitionBy("length", "cell").orderBy("number"))).join(before, ["length", "cell"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("r") - 1).alias("rank"))
    shared = docs.sparkSession.sparkContext.broadcast(table)  # bounded by the lengths

    def place(batches):
        for b in batches:
            size, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                rows = np.flatnonzero(size == s)
                t = shared.value[int(s)]
                at = t[np.searchsorted(t[:, 0], rank[rows], "right") - 1]
                r = rank[rows] - at[:, 0]
                sequence[rows] = at[:, 2] + r // at[:, 3]
                offset[rows] = at[:, 4] + r % at[:, 3] * s
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    schema = T.StructType([*ranked.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(S.table(spark, sf_dir, "documents"))
