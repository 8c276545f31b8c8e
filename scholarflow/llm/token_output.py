"""Token ids as files: each document a zstandard frame of its own, with one dictionary for all.

A dataset is three tables that Spark writes, so that any store and any lost
executor will do:
  dictionary: dict_hash (sha256), dictionary, width (bytes of an id)
  blocks: shard, block, lo and hi (the block's least and greatest doc_id),
    dict_hash, payload (frames end to end) and the offset index: arrays
    doc_ids, offsets, lengths (of frames), n_tokens
The dictionary is trained on the serialised ids of at most MAX_TRAIN documents
of at most SAMPLE_BYTES each (those with the smallest hashes of their ids, one
for each id; it is for short documents, and changes the files' size only).
Shards are ranges of doc_id, blocks follow each other in them, documents in
blocks: ascending doc_id, null first; rows with one id in order of what they
hold. A null or empty text is the end id alone. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import _spark as S
from . import _tokens as K

TOKENIZER = "byte_bpe_50k.json"
END = 0
MAX_TRAIN = 1000
SAMPLE_BYTES = 1 << 14
DICTIONARY_BYTES = 1 << 16
#: A block is full when its frames have as many bytes.
BLOCK_BYTES = 1 << 20
#: Bytes of frames of a shard at most, about, where the session has fewer shuffle tasks.
SHARD_BYTES = 1 << 28
LEVEL = 3


def _ids(texts: list, tokenizer: str, end: int | None):
    enc = K.encoder(tokenizer)
    for ids in enc.encode([t or "" for t in texts]):
        yield ids if end is None else np.append(ids, np.uint32(end))


def width_of(tokenizer: str) -> int:
    import tokenizers

    return 2 if tokenizers.Tokenizer.from_file(K.tokenizer_path(tokenizer)).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def train_dictionary(docs: DataFrame, tokenizer: str, width: int, end: int = END, max_train: int = MAX_TRAIN, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """b'' if there is too little to learn from."""
    import zstandard

    short = docs.where(f"doc_id is not null and octet_length(text) <= {sample_bytes}").select("doc_id", "text")
    wanted = short.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)  # a bounded number of ids
    once = short.join(F.broadcast(wanted), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))

    def run(batches):
        for b in S.slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([i.astype(f"<u{width}").tobytes() for i in _ids(b.column(0).to_pylist(), tokenizer, end)], pa.binary())], ["ids"])

    samples = sorted(bytes(r.ids) for r in once.select("text").mapInArrow(run, "ids binary").collect())  # max_train of sample_bytes tokens at most
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end: int = END, shards: int | None = None) -> None:
    """Encode every row of docs and write the dataset to path: `shards` of them, or as many as the session's shuffles have tasks, and enough for SHARD_BYTES each."""
    with S.scope(docs.sparkSession):
        _write_tokens(docs, path, tokenizer, end, shards)


def _write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int, shards: int | None) -> None:
    spark = docs.sparkSession
    S.small_batches(spark)
    docs = docs.select("doc_id", "text")
    kind, width = docs.schema["doc_id"].dataType, width_of(tokenizer)
    dictionary = train_dictionary(docs, tokenizer, width, end)
    digest = hashlib.sha256(dictionary).hexdigest()

    def frames(batches):
        import zstandard

        made = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for b in S.slices(batches):
            n, out = [], []
            for ids in _ids(b.column(1).to_pylist(), tokenizer, end):
                n.append(len(ids))
                out.append(made.compress(ids.astype(f"<u{width}").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n", "frame"])

    one = T.StructType([T.StructField("doc_id", kind), T.StructField("n", T.LongType()), T.StructField("frame", T.BinaryType())])
    # saved first: dealing rows out by range looks at them twice
    saved = S.save(docs.mapInArrow(frames, one), "frames")
    size = saved.agg(F.sum(F.length("frame"))).first()[0] or 0
    count = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    ordered = saved.withColumn("tie", F.xxhash64("frame")).repartitionByRange(count, "doc_id", "n", "tie").sortWithinPartitions("doc_id", "n", "tie").drop("tie")

    def blocks(batches):
        from pyspark import TaskContext

        shard, number, ids, n, held, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def full():
            ends = np.cumsum([len(f) for f in held])
            offsets = (ends - [len(f) for f in held]).tolist()
            # ids are in order, nulls first; a block of null ids has no range
            least = next((i for i in ids if i is not None), None)
            one_id = b.schema.field(0).type
            arrow = [pa.int32(), pa.int32(), one_id, one_id, pa.string(), pa.binary(), pa.list_(one_id), long_list, long_list, long_list]
            arrays = [[shard], [number], [least], [ids[-1]], [digest], [b"".join(held)], [ids], [offsets], [[len(f) for f in held]], [n]]
            return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, arrow, strict=True)], names)

        for b in batches:
            for i, k, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ids.append(i)
                n.append(k)
                held.append(f)
                size += len(f)
                if size >= BLOCK_BYTES:
                    yield full()
                    number, ids, n, held, size = number + 1, [], [], [], 0
        if held:
            yield full()

    names = ["shard", "block", "lo", "hi", "dict_hash", "payload", "doc_ids", "offsets", "lengths", "n_tokens"]
    schema = T.StructType(
        [T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("lo", kind), T.StructField("hi", kind), T.StructField("dict_hash", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("doc_ids", T.ArrayType(kind))]
        + [T.StructField(x, T.ArrayType(T.LongType())) for x in ("offsets", "lengths", "n_tokens")]
    )
    long_list = pa.list_(pa.int64())
    ordered.mapInArrow(blocks, schema).write.parquet(f"{path}/blocks")
    spark.createDataFrame([(digest, bytearray(dictionary), width)], "dict_hash string, dictionary binary, width int").coalesce(1).write.parquet(f"{path}/dictionary")


def _dictionary(spark: SparkSession, path: str):
    return spark.read.parquet(f"{path}/dictionary").first()


def _decoder(row):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(row.dictionary)) if row.dictionary else None)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document, from the files."""
    row = _dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType

    def run(batches):
        decode = _decoder(row)
        for b in S.slices(batches, 1):
            for r in b.to_pylist():
                if r["dict_hash"] != row.dict_hash:
                    raise ValueError("the block was written with another dictionary")
                before, columns = 0, [[] for _ in range(6)]
                for i, o, k, n in zip(r["doc_ids"], r["offsets"], r["lengths"], r["n_tokens"], strict=True):
                    ids = np.frombuffer(decode.decompress(r["payload"][o : o + k]), f"<u{row.width}").astype("<u4")
                    if len(ids) != n:
                        raise ValueError("a frame doesn't hold as many ids as the index says")
                    for c, x in zip(columns, (r["shard"], r["block"], i, before, n, zlib.crc32(ids.tobytes())), strict=True):
                        c.append(x)
                    if with_ids:
                        lists.append(ids.astype(np.int64)) if len(columns[0]) > 1 else (lists := [ids.astype(np.int64)])
                    before += n
                arrays = [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], b.schema.field("doc_ids").type.value_type), *(pa.array(c, pa.int64()) for c in columns[3:])]
                if with_ids:
                    arrays.append(pa.array(lists, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["shard", "block", "doc_id", "before", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("doc_id", kind), *(T.StructField(x, T.LongType()) for x in names[3:6]), *[T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids])
    per_block = blocks.select("shard", "block", F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)").alias("t"))
    # one row for each shard: their number is a setting
    per_shard = per_block.groupBy("shard").agg(F.sum("t").alias("all")).withColumn("first", F.sum("all").over(W.orderBy("shard")) - F.col("all")).drop("all")
    begins = per_block.withColumn("b", F.sum("t").over(W.partitionBy("shard").orderBy("block")) - F.col("t")).join(per_shard, "shard").select("shard", "block", (F.col("b") + F.col("first")).alias("begin"))
    out = blocks.mapInArrow(run, schema).join(begins, ["shard", "block"])
    return out.select("doc_id", (F.col("begin") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def lookup(spark: SparkSession, path: str, doc_ids: list) -> dict:
    """The ids of a few documents, by the index alone: only blocks whose range holds one are read, only their frames decompressed. A null id finds nothing."""
    row = _dictionary(spark, path)
    doc_ids = [i for i in doc_ids if i is not None]
    ranges = reduce(Column.__or__, [F.lit(i).between(F.col("lo"), F.col("hi")) for i in sorted(set(doc_ids))], F.lit(False))
    at = F.filter(F.arrays_zip("doc_ids", "offsets", "lengths"), lambda x: x.doc_ids.isin(doc_ids))
    found = spark.read.parquet(f"{path}/blocks").where(ranges).select("payload", F.explode(at).alias("x")).select(F.col("x.doc_ids").alias("doc_id"), F.expr("substring(payload, cast(x.offsets as int) + 1, cast(x.lengths as int))").alias("frame"))
    decode = _decoder(row)
    return {r.doc_id: np.frombuffer(decode.decompress(bytes(r.frame)), f"<u{row.width}").tolist() for r in found.collect()}


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{S.current(spark).folder()}/tokens"
    write_tokens(S.table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path, with_ids=False)
