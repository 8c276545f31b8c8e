"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, a temperature.

Fitting looks at no more than MAX_TRAIN labelled documents (a documented bound;
of more, those with the smallest hashes of their ids; of rows with one id, the
one with the smallest hash of its text), whole, in tasks: counts of their words,
sums of index vectors for each word and pooled features come to the driver, all
of them bounded by MAX_TRAIN and MAX_VOCABULARY. A word's index vector is a
sparse ternary vector drawn from its hash; its word vector is the sum of the
index vectors of its neighbours in these documents, scaled to length 1. Words
seen fewer than MIN_COUNT times in them, and all beyond the MAX_VOCABULARY most
frequent ones, share one vector. A text is pooled over its tokens and over its
distinct tokens; with a few shares (capitals, signs, seldom words, distinct
tokens) and its length this feeds the network, of which the logits are divided
by a temperature fitted on rows that it wasn't trained on.

Scoring covers every whole text, each by itself. A null text is scored as an
empty one. Columns of docs that are named as the results are left out of them:
ask for other names to keep them. A null doc_id is never held out and never labelled; of repeated
labels of an id the lowest counts, null labels don't. Without labels of both
kinds every score is the labels' smoothed share of ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _spark as S
from . import _text as X
from . import _tokens as K

MAX_TRAIN = 4000
DIMENSIONS = 48
NONZERO = 4
WINDOW = 2
MIN_COUNT = 5
MAX_VOCABULARY = 20_000
HIDDEN = 32
EPOCHS = 80
THRESHOLD = 0.3

#: Stand for any capitalised run and any number.
_CAPITALS, _NUMBER = np.uint64(11), np.uint64(13)
_kinds: list[np.ndarray] = []


def tokens(texts: list[str]) -> Iterator[np.ndarray]:
    """Per text the hashes of its tokens: runs of letters (lower case), of digits (all alike), of other signs; a mark follows letters all in capitals."""
    if not _kinds:
        _kinds.append(K.classes())
    for lo, hi in X.chunks(texts):
        codes, offsets = X.code_points(texts[lo:hi])
        if not len(codes):
            yield from (np.zeros(0, np.uint64) for _ in range(lo, hi))
            continue
        kind = _kinds[0][codes]
        first = np.ones(len(codes), bool)
        first[1:] = kind[1:] != kind[:-1]
        first[offsets[:-1][offsets[:-1] < len(codes)]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(codes))
        capital = np.append(0, np.cumsum((codes >= 65) & (codes <= 90)))
        what = kind[starts]
        hashes = X.span_hashes(X.fold(codes), starts, ends)
        hashes[what == K.NUMBER] = _NUMBER
        loud = (what == K.LETTER) & (ends - starts > 1) & (2 * (capital[ends] - capital[starts]) > ends - starts)
        keep = what != K.SPACE
        repeat = keep.astype(np.int64) + loud
        out = np.repeat(hashes, repeat)
        out[np.cumsum(repeat)[loud] - 1] = _CAPITALS
        cuts = np.append(0, np.cumsum(repeat))[np.searchsorted(starts, offsets)].tolist()
        yield from (out[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def index_vectors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places and signs of each index vector's nonzero entries."""
    slots = X.mix(hashes[:, None] + np.arange(1, NONZERO + 1, dtype=np.uint64) * X.MULT)
    return (slots % np.uint64(DIMENSIONS)).astype(np.int64), np.where(slots >> np.uint64(63), 1.0, -1.0)


def word_counts(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of these documents and how often they come."""
    return np.unique(np.concatenate([*docs, np.zeros(0, np.uint64)]), return_counts=True)


def contexts(docs: list[np.ndarray], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words (the vocabulary's length: all others) and for each the sum of its neighbours' index vectors."""
    flat = np.concatenate([*docs, np.zeros(0, np.uint64)])
    words, ids = np.unique(lookup(flat, vocabulary), return_inverse=True)
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    places, signs = index_vectors(np.append(vocabulary, np.uint64(17))[words])
    context = np.zeros(len(words) * DIMENSIONS)
    for gap in range(1, WINDOW + 1):
        same = doc[gap:] == doc[:-gap]
        left, right = ids[:-gap][same], ids[gap:][same]
        for here, there in ((left, right), (right, left)):
            for j in range(NONZERO):
                context += np.bincount(here * DIMENSIONS + places[there, j], signs[there, j], len(context))
    return words, context.reshape(-1, DIMENSIONS)


def lookup(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Numbers in the vocabulary; its length for words out of it."""
    if not len(vocabulary):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, len(vocabulary))


def features(doc: np.ndarray, vocabulary: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    n = len(doc)
    if not n:
        return np.zeros(2 * DIMENSIONS + 4, np.float32)
    distinct, counts = np.unique(doc, return_counts=True)
    ids = lookup(distinct, vocabulary)
    pool = vectors[ids]
    seldom = counts[ids == len(vocabulary)].sum() / n
    loud = counts[distinct == _CAPITALS].sum() / n
    return np.concatenate([counts.astype(np.float32) @ pool / n, pool.mean(0), [np.log1p(n), len(distinct) / n, seldom, loud]]).astype(np.float32)


def constant(quality: np.ndarray) -> dict | None:
    """The model where there are no labels of both kinds, or too few."""
    return {"constant": float((quality.sum() + 1) / (len(quality) + 2))} if len(set(quality.tolist())) < 2 or len(quality) < 10 else None


def fit(x: np.ndarray, quality: np.ndarray, vocabulary: np.ndarray, vectors: np.ndarray, seed: int = 7) -> dict:
    """The model of these features and their labels (0 or 1)."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x, y = (x - mean) / scale, quality.astype(np.float64)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    aside, train = order[: len(x) // 5], order[len(x) // 5 :]
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            h = np.tanh(x[rows] @ w[0] + w[1])
            g = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(g, w[2]) * (1 - h * h)
            grads = [x[rows].T @ back + 1e-3 * w[0], back.sum(0), h.T @ g + 1e-3 * w[2], np.array([g.sum()])]
            step += 1
            for i, d in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                w[i] -= 3e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    model = {"vocabulary": vocabulary, "vectors": vectors, "mean": mean, "scale": scale, "w": w, "temperature": 1.0}
    z = logits(model, x[aside])
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    model["temperature"] = float(min(grid, key=lambda t: np.logaddexp(0, np.where(y[aside] > 0, -z, z) / t).mean()))
    return model


def logits(model: dict, x: np.ndarray) -> np.ndarray:
    w = model["w"]
    return np.tanh(x @ w[0] + w[1]) @ w[2] + w[3]


def score(model: dict, texts: list[str]) -> np.ndarray:
    """The calibrated probability of label 1 for each whole text."""
    if "constant" in model or not texts:
        return np.full(len(texts), model.get("constant", 0.5))
    x = np.stack([features(d, model["vocabulary"], model["vectors"]) for d in tokens(texts)])
    z = logits(model, (x - model["mean"]) / model["scale"]) / model["temperature"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """id (string), quality, text of at most max_train labelled documents that aren't held out: one row for each id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    # at most max_train rows of two numbers, so they may be broadcast
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy(F.col("doc_id").cast("string").alias("id"), "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> dict:
    """A model fitted on at most max_train labelled documents that aren't held out."""
    S.small_batches(docs.sparkSession)
    with S.scope(docs.sparkSession):
        return _train(S.save(sample(docs, labels, max_train), "sample"))


def _train(rows: DataFrame) -> dict:
    quality = np.array([r.quality for r in rows.select("id", "quality").orderBy("id").collect()], np.int64)  # max_train at most
    if (plain := constant(quality)) is not None:
        return plain
    texts = rows.select("id", "text")

    def count(batches):
        for b in S.slices(batches):
            words, n = word_counts(list(tokens(b.column(1).to_pylist())))
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n, pa.int64())], ["word", "n"])

    often = texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(f"n >= {MIN_COUNT}").orderBy(F.desc("n"), "word").limit(MAX_VOCABULARY)
    vocabulary = np.sort(np.array([r.word for r in often.collect()], np.int64).view(np.uint64))
    sums = [f"c{i}" for i in range(DIMENSIONS)]

    def gather(batches):
        for b in S.slices(batches):
            words, context = contexts(list(tokens(b.column(1).to_pylist())), vocabulary)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), *(pa.array(c) for c in np.ascontiguousarray(context.T))], ["word", *sums])

    # whole numbers, so their sums don't hang on an order
    summed = texts.mapInArrow(gather, "word long, " + ", ".join(f"{c} double" for c in sums)).groupBy("word").agg(*(F.sum(c).alias(c) for c in sums))
    vectors = np.zeros((len(vocabulary) + 1, DIMENSIONS))
    for r in summed.collect():  # MAX_VOCABULARY + 1 at most
        vectors[r.word] = r[1:]
    vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    shared = rows.sparkSession.sparkContext.broadcast((vocabulary, vectors))

    def pooled(batches):
        for b in S.slices(batches):
            x = [features(d, *shared.value) for d in tokens(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tolist() for v in x], pa.list_(pa.float32()))], ["id", "x"])

    x = np.array([r.x for r in texts.mapInArrow(pooled, "id string, x array<float>").orderBy("id").collect()])  # max_train at most
    return fit(x.astype(np.float64), quality, vocabulary, vectors)


def classify(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with a score (0 to 1) and predicted (1 if score >= threshold), one row per row of docs."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels, max_train))

    def run(batches):
        for b in S.slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score(model.value, [t or "" for t in b.column(at).to_pylist()]), pa.float64())], [*b.schema.names, "score"])

    bare = docs.drop(*names)
    at = bare.columns.index("text")
    numbered = S.numbered(bare)
    scored = numbered.mapInArrow(run, T.StructType([*numbered.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).toDF(*bare.columns, *names)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(docs, S.table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
