"""Token counts by the whole-token shortcut.

Which strings of the vocabulary the library encodes, given them alone, as that
one token is proved once on the driver. A pre-token that is one of them counts
1 without a merge; the library merges the rest, each distinct one once a batch,
and remembers a bounded number of them.

A null or empty text has no bytes and no tokens; every row is counted by
itself, so null or repeated ids, ties and extra columns change nothing.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark as S
from . import _tokens as K

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens), one row per row of docs."""
    spark = docs.sparkSession
    S.small_batches(docs.sparkSession)
    # at most the vocabulary's size: some 0.8 MB
    proven = spark.sparkContext.broadcast(K.text_hashes(K.whole_tokens(tokenizer)))

    def count(batches):
        enc = K.encoder(tokenizer, counts=True, whole=proven.value)
        for b in S.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(enc.count(b.column(1).to_pylist())), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    out = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    return out.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(S.table(spark, sf_dir, "documents"))
