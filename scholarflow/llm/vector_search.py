"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, shard results merged.

1. Equal vectors are one node that knows its least ids: as many as a query can
   ask for, and one more for the query's own. So thousands of copies are one node,
   and no id that belongs to an answer is lost.
2. Nodes are dealt to shards of about SHARD by their hash, each with the graph
   that one task builds. A node's links are one flat array: GROUND slots (and one
   that joins all nodes of the shard to a ring) for the lowest layer, UPPER more
   for each layer above it that has the node; -1 is empty. The index is a table.
3. Queries meet every shard in blocks of about BLOCK, so a task holds one shard and
   one block. It walks down the layers, widens its search to `width` nodes in the
   lowest one, and measures these again in double precision on the original vectors.
4. The nearest of all shards are the answer.

Nodes enter a graph by layers, highest first, and in batches that a NumPy search
takes through the graph in step; batch members also meet each other.

Null vectors and ids, empty and zero vectors, and vectors with components that are
null or not finite take no part. Vectors meet those of their own length only. Rows
that repeat count once; an id with several vectors is as near as its nearest, as a
query too, and never answers itself. Ties go to smaller ids. Where there are fewer
candidates than asked for, all are found: a search wider than a shard sees all of
its ring. No vectors: no rows. Extra columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import _spark as S

K = 10
#: Nodes of a shard, and queries of a block, about.
SHARD, BLOCK = 1 << 14, 1 << 12
#: Links of a node in the lowest layer and in each other; nodes that a search keeps, as it builds and as it answers.
GROUND, UPPER = 32, 16
BUILD_WIDTH, WIDTH = 96, 192
#: Nodes that enter at once at most, nodes of a batch that meet, and nodes of a layer whose links are found by comparing all.
BATCH, MET, FIRST = 512, 16, 256
#: Nodes that a search step opens for each query.
OPENED = 4
#: Scaled components of queries far from all of a shard are cut to this, so that squares stay finite.
FAR = 1e16
#: One node in so many is in the layer above too.
THINNING = 16


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances between all rows of x and y."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def _nearest(x: np.ndarray, rows: np.ndarray, among: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Of `among`, the nodes nearest to each of `rows` (itself left out), nearest first, and their squared distances."""
    d = _squares(x[rows], x[among])
    d[rows[:, None] == among[None]] = np.inf
    many = min(many, len(among))
    at = np.argpartition(d, many - 1, 1)[:, :many] if many < len(among) else np.tile(np.arange(many), (len(rows), 1))
    return _sorted(among[at], np.take_along_axis(d, at, 1))


def _sorted(ids: np.ndarray, d: np.ndarray, many: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nodes by distance; those at no distance (inf) become -1 and stand last."""
    at = np.argsort(d, 1, kind="stable")[:, :many]
    ids, d = np.take_along_axis(ids, at, 1), np.take_along_axis(d, at, 1)
    return np.where(np.isinf(d), -1, ids), d


def _once(ids: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d with inf for an id that stands before in its row, and for -1."""
    order = np.argsort(ids, 1, kind="stable")
    lined = np.take_along_axis(ids, order, 1)
    again = np.zeros(ids.shape, bool)
    np.put_along_axis(again, order[:, 1:], lined[:, 1:] == lined[:, :-1], 1)
    return np.where(again | (ids < 0), np.inf, d)


def _spread(x: np.ndarray, ids: np.ndarray, d: np.ndarray, many: int) -> np.ndarray:
    """Of candidates by distance, those nearer to the node than to any chosen before them; then the nearest of the others."""
    near = x[ids]  # -1 reads some node; its distance is inf
    norms = (near * near).sum(2)
    between = norms[:, :, None] + norms[:, None] - 2 * near @ near.transpose(0, 2, 1)
    kept, count = np.zeros(ids.shape, bool), np.zeros(len(ids), np.int64)
    for j in range(ids.shape[1]):
        kept[:, j] = (count < many) & ~np.isinf(d[:, j]) & ~(kept[:, :j] & (between[:, j, :j] < d[:, j, None])).any(1)
        count += kept[:, j]
    rank = np.argsort(np.where(np.isinf(d), 2, np.where(kept, 0, 1)), 1, kind="stable")[:, :many]
    out = np.where(np.isinf(np.take_along_axis(d, rank, 1)), -1, np.take_along_axis(ids, rank, 1))
    return np.pad(out, ((0, 0), (0, many - out.shape[1])), constant_values=-1)


def _join(x: np.ndarray, links: np.ndarray, rows: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
    """Give rows their links among candidates by distance, and what they link to a link back."""
    many = links.shape[1]
    links[rows] = _spread(x, ids, d, many)
    tail, head = np.repeat(rows, many), links[rows].ravel()
    tail, head = tail[head >= 0], head[head >= 0]
    back = ((x[tail] - x[head]) ** 2).sum(1)
    order = np.lexsort((back, head))
    tail, head, back = tail[order], head[order], back[order]
    heads, begin = np.unique(head, return_index=True)
    place = np.arange(len(head)) - np.repeat(begin, np.diff([*begin, len(head)]))
    fits = place < many
    for lo in range(0, len(heads), 2048):  # so that what is between candidates stays small
        own = heads[lo : lo + 2048]
        mine = fits & (head >= own[0]) & (head <= own[-1]) if len(own) else fits
        ids = np.full((len(own), 2 * many), -1, np.int64)
        ids[:, :many] = links[own]
        ids[np.searchsorted(own, head[mine]), many + place[mine]] = tail[mine]
        d = _once(ids, ((x[ids] - x[own][:, None]) ** 2).sum(2))
        ids, d = _sorted(ids, d)
        wide = int((~np.isinf(d)).sum(1).max())
        links[own] = _spread(x, ids[:, :wide], d[:, :wide], many)


def search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The `width` nodes nearest to each query that a walk from its start finds, by distance (-1: no more), and squared distances."""
    seen = np.zeros((len(queries), len(links)), bool)
    ids, d = np.full((len(queries), width), -1, np.int64), np.full((len(queries), width), np.inf, np.float32)
    ids[:, 0], d[:, 0] = start, ((x[start] - queries) ** 2).sum(1)
    seen[np.arange(len(queries)), start] = True
    shut = np.zeros(ids.shape, bool)
    live = np.arange(len(queries))
    while len(live):
        unopened = ~shut[live] & ~np.isinf(d[live])
        chosen = unopened & (np.cumsum(unopened, 1) <= OPENED)
        some = chosen.any(1)
        live, chosen = live[some], chosen[some]
        if not len(live):
            break
        shut[live] |= chosen
        row, column = np.nonzero(chosen)
        near = links[ids[live[row], column]]
        row, node = np.repeat(row, near.shape[1]), near.ravel()
        new = (node >= 0) & ~seen[live[row], node]
        codes = np.unique(row[new] * len(links) + node[new])
        row, node = codes // len(links), codes % len(links)
        seen[live[row], node] = True
        far = ((x[node] - queries[live[row]]) ** 2).sum(1)
        place = np.arange(len(row)) - np.searchsorted(row, row)
        extra = int(place.max()) + 1 if len(place) else 0
        both, dist = np.full((len(live), width + extra), -1, np.int64), np.full((len(live), width + extra), np.inf, np.float32)
        done = np.zeros(both.shape, bool)
        both[:, :width], dist[:, :width], done[:, :width] = ids[live], d[live], shut[live]
        both[row, width + place], dist[row, width + place] = node, far
        at = np.argsort(dist, 1, kind="stable")[:, :width]
        ids[live], d[live], shut[live] = (np.take_along_axis(a, at, 1) for a in (both, dist, done))
    return ids, d


def distances(vectors: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; squares that would overflow or vanish are scaled first."""
    d = vectors - v
    largest = np.abs(d).max(1, initial=0)
    odd = (largest > 1e150) | (largest < 1e-150) & (largest > 0)
    scale = np.where(odd, largest, 1.0)
    return np.sqrt(((d / scale[:, None]) ** 2).sum(1)) * scale


def _descend(x: np.ndarray, layers: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """Where a search of the lowest layer begins, after a walk through the layers above it, highest first."""
    start = np.zeros(len(queries), np.int64)
    for links in layers:
        start = search(x, links, queries, start, 1)[0][:, 0]
    return start


def build(x: np.ndarray, level: np.ndarray) -> list[np.ndarray]:
    """The links of each layer, highest first, of nodes in falling order of level; a layer's nodes come first in x."""
    layers: list[np.ndarray] = []
    above = 0
    for layer in range(int(level.max(initial=0)), -1, -1):
        size = int((level >= layer).sum())
        links = np.full((size, UPPER if layer else GROUND), -1, np.int64)
        first = min(size, max(above, FIRST))
        for lo in range(0, first, BATCH):
            rows = np.arange(lo, min(lo + BATCH, first))
            _join(x, links, rows, *_nearest(x, rows, np.arange(first), BUILD_WIDTH))
        at = first
        while at < size:
            rows = np.arange(at, min(size, at + min(BATCH, at)))
            ids, d = search(x, links[:at], x[rows], _descend(x, layers, x[rows]), BUILD_WIDTH)
            met, far = _nearest(x, rows, rows, MET)
            ids, d = _sorted(np.hstack([ids, met]), np.hstack([d, far]))
            _join(x, links, rows, ids, d)
            at += len(rows)
        layers.append(links)
        above = size
    return layers


def _scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Single-precision vectors about their mean, within -1 and 1 so that no square overflows; the mean and the divisor."""
    largest = max(float(np.abs(vectors).max(initial=0)), 1e-300)
    mean = (vectors / largest).mean(0) * largest
    spread = max(float(np.abs(vectors / largest - mean / largest).max(initial=0)), 1e-30) * largest
    return ((vectors / spread) - mean / spread).astype(np.float32), mean, spread


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    values = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
    return values.reshape(len(column), -1)


def index(nodes: DataFrame, shards: int) -> DataFrame:
    """size, shard, node, level, ids, vector, links: the graph of each shard of nodes (k0, k1, size, vector, ids)."""

    def run(table):
        level = table.column("level").to_numpy()
        order = np.lexsort((table.column("k1").to_numpy(), table.column("k0").to_numpy(), -level))
        table, level = table.take(pa.array(order)).combine_chunks(), level[order]
        layers = build(_scaled(_matrix(table.column("vector"), np.float64))[0], level)[::-1]  # lowest first
        ring = np.roll(np.arange(table.num_rows), -1)
        links = [np.concatenate([layers[0][i], ring[i : i + 1], *(layers[k][i] for k in range(1, level[i] + 1))]) for i in range(table.num_rows)]
        bounds = np.cumsum([0, *map(len, links)])
        flat = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(links), pa.int32()))
        columns = [table.column("size"), table.column("shard"), pa.array(np.arange(len(links)), pa.int32()), table.column("level"), table.column("ids"), table.column("vector"), flat]
        return pa.Table.from_arrays(columns, ["size", "shard", "node", "level", "ids", "vector", "links"])

    # a hash, uniform from 0 to 1, says how high a node stands
    level = F.expr(f"cast(floor(log({THINNING}D, {2.0**53}D / (shiftrightunsigned(xxhash64(11, k0, k1), 11) + 1))) as int)")
    dealt = nodes.withColumn("shard", F.pmod("k0", F.lit(shards)).cast("int")).withColumn("level", level)
    return dealt.groupBy("size", "shard").applyInArrow(run, f"size int, shard int, node int, level int, ids array<{nodes.schema['ids'].dataType.elementType.simpleString()}>, vector array<double>, links array<int>")


def _layers(table: pa.Table) -> list[np.ndarray]:
    """The layers of an index of one shard, in order of its nodes, highest first."""
    level, links = table.column("level").to_numpy(), table.column("links").combine_chunks()
    flat, begin = links.flatten().to_numpy().astype(np.int64), np.cumsum([0, *(GROUND + 1 + UPPER * level)])[:-1]
    upper = [flat[(begin[level >= k] + GROUND + 1 + UPPER * (k - 1))[:, None] + np.arange(UPPER)] for k in range(int(level.max()), 0, -1)]
    return [*upper, flat[begin[:, None] + np.arange(GROUND + 1)]]


def _answers(table: pa.Table, queries: pa.Table, k: int, width: int) -> pa.Table:
    """query_id, vec_id, score: the k nearest of a shard for each query."""
    table = table.take(pa.array(np.argsort(table.column("node").to_numpy()))).combine_chunks()
    vectors, ids = _matrix(table.column("vector"), np.float64), table.column("ids").to_pylist()
    x, mean, spread = _scaled(vectors)
    layers = _layers(table)
    asked, own = _matrix(queries.column("vector"), np.float64), queries.column("query_id").to_pylist()
    found: list[tuple] = []
    for lo in range(0, len(asked), BATCH):
        some = asked[lo : lo + BATCH]
        near = np.clip(some / spread - mean / spread, -FAR, FAR).astype(np.float32)
        nodes, _ = search(x, layers[-1], near, _descend(x, layers[:-1], near), width)
        for i, (v, row) in enumerate(zip(some, nodes, strict=True)):
            row = row[row >= 0]
            score = distances(vectors[row], v)
            least: dict = {}
            for s, n in sorted(zip(score.tolist(), row.tolist(), strict=True)):
                if len(least) >= k and s > last:
                    break
                last = s
                for other in ids[n]:
                    if other != own[lo + i]:
                        least.setdefault(other, s)
            found += ((own[lo + i], s, other) for s, other in sorted((s, other) for other, s in least.items())[:k])
    q, s, v = zip(*found, strict=True) if found else ([], [], [])
    return pa.Table.from_arrays([pa.array(q, queries.schema.field("query_id").type), pa.array(v, queries.schema.field("query_id").type), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, size, vector (double), k0, k1 (128 bits that stand for it) of the rows that take part."""
    rows = vectors.select("vec_id", F.col(column).cast("array<double>").alias("vector")).where("vec_id is not null and vector is not null")
    fine = rows.where("forall(vector, x -> x is not null and not isnan(x) and abs(x) <> double('infinity')) and exists(vector, x -> x <> 0)")
    return fine.select("vec_id", F.size("vector").alias("size"), "vector", *S.text_key(F.col("vector"), ("k0", "k1")))


def nodes_of(rows: DataFrame, k: int = K) -> DataFrame:
    """k0, k1, size, vector, ids: a row for each distinct vector, with its k + 1 least ids."""
    by = W.partitionBy("k0", "k1").orderBy("vec_id")
    ids = rows.select("k0", "k1", "vec_id").distinct().withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1)
    ids = ids.groupBy("k0", "k1").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return rows.groupBy("k0", "k1").agg(F.first("size").alias("size"), F.first("vector").alias("vector")).join(ids, ["k0", "k1"])


def nearest(vectors: DataFrame, asked: str, k: int = K, width: int = WIDTH, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: of the ids for which the condition `asked` holds, the k nearest others that are found."""
    with S.scope(vectors.sparkSession) as run:
        rows = usable(vectors)
        nodes = S.save(nodes_of(rows, k), "nodes")
        shards = max(1, -(-nodes.count() // shard))
        graph = S.save(index(nodes, shards), "index")
        queries = S.save(rows.where(asked).select(F.col("vec_id").alias("query_id"), "size", "vector", "k0", "k1").dropDuplicates(["query_id", "k0", "k1"]).drop("k0", "k1"), "queries")
        blocks = max(1, -(-queries.count() // block))
        queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        held = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        kind = rows.schema["vec_id"].dataType.simpleString()

        def answer(table, some):
            if not table.num_rows or not some.num_rows:
                return pa.schema([("query_id", some.schema.field("query_id").type), ("vec_id", some.schema.field("query_id").type), ("score", pa.float64())]).empty_table()
            return _answers(table, some, k, width)

        keys = ["size", "shard", "block"]
        found = held.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(answer, f"query_id {kind}, vec_id {kind}, score double")
        merged = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        ranked = merged.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
        return run.hand_on(ranked.select("query_id", "rank", "vec_id", "score"), "nearest")


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(S.table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")
