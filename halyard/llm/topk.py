"""Exact top-k search by integer inner product, block at a time.

The components of a vector are its terms. Rows are packed into segments of document ranges; inside a segment rows are laid out
by their leading terms and cut into blocks, each with the largest and smallest weight of every term and its forward index (the
weights row by row). For a query the sum over its terms of weight times the block's maximum (minimum, where the query's weight
is negative) bounds every score in the block. Each query visits blocks in falling order of that sum, scores a block through its
forward index, and stops when the next sum falls below its k-th best score so far; a block that could only tie is still
visited, since ties go to the smaller id.

Queries are packed into tiles, segments dealt into chunks of `chunk_bytes`. A task holds one chunk and streams all tiles past it
(the stated queries against all rows, in blocks): the table is shuffled once, the queries once for each chunk, and what a task
holds is bounded by its chunk and one tile, whatever the size of either table. Each chunk returns k rows for each query; a window
merges them, after each task of its input has kept its own k best.

Cases: a vector that is null, empty, or holds a null or a non-finite component takes no part; a null id neither; weights and
scores are exact in 64 bits, and what does not fit there is an error, as in SQL; vectors of different lengths are compared as if
filled up with zeros; rows with the query's own id are no candidates; repeated rows are separate candidates and separate queries; fewer than k candidates give all of them;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.common import prepare, written

SEGMENT, BLOCK, TILE = 2048, 512, 1024
LIMIT = 1 << 63
_NONE = np.iinfo(np.int64).min


def weights(vector: Column, scale: int) -> Column:
    """floor(scale * component) as longs; null for a vector that takes no part. A weight beyond 64 bits is an error."""
    scaled = lambda x: x.cast("double") * scale
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    weight = lambda x: F.when((scaled(x) >= -float(LIMIT)) & (scaled(x) < float(LIMIT)), F.floor(scaled(x))).otherwise(F.raise_error(F.lit("a weight beyond 64 bits")).cast("long"))
    return F.when((F.size(vector) > 0) & sound, F.transform(vector, weight))


def _packed(ids: np.ndarray, rows: np.ndarray) -> dict:
    """Rows as integers of 32 bits, of 64 where a weight needs them."""
    narrow = -(1 << 31) <= int(rows.min(initial=0)) and int(rows.max(initial=0)) < 1 << 31
    return {"ids": ids.astype(np.int64).tobytes(), "width": rows.shape[1], "data": rows.astype(np.int32 if narrow else np.int64).tobytes()}


def _unpacked(n: int, width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int32 if len(data) == 4 * n * width else np.int64).reshape(n, width)


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the matrix of the weights (columns id, w), filled up with zeros on the right."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(ids), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return ids, out


def _widen(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] >= width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def _pack(size: int, by_term: bool):
    """A mapInArrow function: rows (id, w) of a task into packed rows of at most size."""

    def run(batches):
        from pyspark import TaskContext

        task, made, ids, rows = TaskContext.get().partitionId(), 0, np.zeros(0, np.int64), np.zeros((0, 0), np.int64)

        def out(i, r):
            nonlocal made
            if by_term:
                lead = np.argsort(-r, axis=1, kind="stable")[:, :2]
                order = np.lexsort((i, lead[:, -1], lead[:, 0]))
                i, r = i[order], r[order]
            p = _packed(i, r)
            made += 1
            return pa.record_batch([pa.array([task], pa.int32()), pa.array([made], pa.int32()), pa.array([p["ids"]], pa.binary()), pa.array([p["width"]], pa.int32()), pa.array([p["data"]], pa.binary())], names=["task", "made", "ids", "width", "data"])

        for batch in batches:
            if batch.num_rows:
                i, r = _rows(batch)
                width = max(r.shape[1], rows.shape[1])
                ids, rows = np.concatenate([ids, i]), np.concatenate([_widen(rows, width), _widen(r, width)])
                while len(ids) >= size:
                    yield out(ids[:size], rows[:size])
                    ids, rows = ids[size:], rows[size:]
        if len(ids):
            yield out(ids, rows)

    return run


class Blocks:
    """The rows of a chunk as blocks, with the largest and smallest weight of each term."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.starts = np.arange(0, len(rows), BLOCK)
        self.most, self.least = np.maximum.reduceat(rows, self.starts), np.minimum.reduceat(rows, self.starts)
        self.largest = max(int(rows.max(initial=0)), -int(rows.min(initial=0)), 1)
        self.held: dict = {}

    def of(self, kind, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and their bounds as numbers of a kind that holds all sums exactly."""
        if (kind, width) not in self.held:
            self.held = {(kind, width): tuple(_widen(x, width).astype(kind) for x in (self.rows, self.most, self.least))}
        return self.held[kind, width]


class Search:
    """Best k rows of each query of a tile among the blocks added so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.scores = np.full((len(ids), k), _NONE)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.scored = 0  # blocks scored, by query

    def add(self, blocks: Blocks) -> None:
        ids, starts = blocks.ids, blocks.starts
        width = max(blocks.rows.shape[1], self.queries.shape[1])
        queries = _widen(self.queries, width)
        top = blocks.largest * max(int(queries.max(initial=0)), -int(queries.min(initial=0)), 1) * width
        kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64 if top < 1 << 63 else object  # all exact
        queries = queries.astype(kind)
        rows, most, least = blocks.of(kind, width)
        bounds = np.maximum(queries, 0) @ most.T + np.minimum(queries, 0) @ least.T
        order = np.argsort(-bounds, axis=1, kind="stable")
        alive = np.arange(len(queries))
        for turn in range(len(starts)):
            block = order[alive, turn]
            going = bounds[alive, block] >= self.scores[alive, -1]
            alive, block = alive[going], block[going]
            if not len(alive):
                break
            self.scored += len(alive)
            by_block = np.argsort(block, kind="stable")
            edges = np.flatnonzero(np.diff(block[by_block], prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(by_block)], strict=True):
                at = starts[block[by_block[a]]]
                self._merge(alive[by_block[a:b]], ids[at : at + BLOCK], queries, rows[at : at + BLOCK])

    def _merge(self, who: np.ndarray, ids: np.ndarray, queries: np.ndarray, rows: np.ndarray) -> None:
        """Score the rows of a block for some queries and take over what reaches their k-th best."""
        product = queries[who] @ rows.T
        screen = product if product.dtype.kind == "f" else product.astype(np.float64)  # rounded alike, so nothing is lost by it
        own = self.ids[who][:, None] == ids[None, :]
        kth = self.scores[who, -1]
        least = np.where(kth == _NONE, -np.inf, kth)
        if product.shape[1] > self.k and (kth == _NONE).any():  # nothing below the block's own k-th best can stay
            least = np.maximum(least, np.partition(np.where(own, -np.inf, screen), -self.k, axis=1)[:, -self.k])
        r, c = np.nonzero((screen >= least[:, None].astype(screen.dtype)) & ~own)
        if not len(r):
            return
        touched, r2 = np.unique(r, return_inverse=True)
        held = self.scores[who[touched]]
        owner = np.concatenate([np.repeat(np.arange(len(touched)), self.k), r2])
        s = np.concatenate([held.ravel(), product[r, c].astype(np.int64)])
        i = np.concatenate([self.found[who[touched]].ravel(), ids[c]])
        order = np.lexsort((i, ~s, owner))  # ~s falls as s grows
        owner, s, i = owner[order], s[order], i[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(touched)))[owner]
        keep = rank < self.k
        self.scores[who[touched]] = s[keep].reshape(-1, self.k)
        self.found[who[touched]] = i[keep].reshape(-1, self.k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, chunk_bytes: int = 32 << 20) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row of queries its k best rows of vectors (both: vec_id, embedding)."""
    spark = vectors.sparkSession
    prepare(spark)
    packed = "task int, made int, ids binary, width int, data binary"

    def sound(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long").alias("id"), weights(F.col("embedding"), scale).alias("w")).where("id IS NOT NULL AND w IS NOT NULL")

    asked = sound(queries)
    tile_rows = written(asked.repartition(max(1, -(-asked.count() // TILE))).mapInArrow(_pack(TILE, False), packed))
    segments = written(sound(vectors).mapInArrow(_pack(SEGMENT, True), packed))
    size = segments.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("data") + F.length("ids")), F.lit(0)).alias("b")).first()
    cores = spark.sparkContext.defaultParallelism
    chunks = max(1, min(size["n"], max(-(-size["b"] // chunk_bytes), cores)))  # a small table is spread over the cores
    chunk = F.pmod(F.hash("task", "made"), F.lit(chunks))
    stream = (
        segments.select(chunk.alias("chunk"), F.lit(0).alias("kind"), "task", "made", "ids", "width", "data")
        .unionByName(tile_rows.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(1).alias("kind"), "task", "made", "ids", "width", "data"))
        .repartition(chunks, "chunk")
        .sortWithinPartitions("chunk", "kind", "task", "made")
    )

    def run(batches):
        key, blocks, wait = None, None, []
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                ids = np.frombuffer(r["ids"], np.int64)
                rows = _unpacked(len(ids), r["width"], r["data"])
                if r["chunk"] != key:
                    key, blocks, wait = r["chunk"], None, []
                if r["kind"] == 0:
                    wait.append((ids, rows))
                    continue
                if wait:
                    width = max(x.shape[1] for _, x in wait)
                    blocks, wait = Blocks(np.concatenate([x for x, _ in wait]), np.concatenate([_widen(x, width) for _, x in wait])), []
                if blocks is None:
                    continue
                search = Search(ids, rows, k)
                search.add(blocks)
                q, at = np.nonzero(search.found != np.iinfo(np.int64).max)
                if len(q):
                    tile = [pa.array(np.full(len(q), r[x], np.int32)) for x in ("task", "made")]
                    yield pa.record_batch([*tile, pa.array(q.astype(np.int32)), pa.array(search.ids[q]), pa.array(search.found[q, at]), pa.array(search.scores[q, at])], names=["task", "made", "row", "query_id", "vec_id", "score"])

    part = stream.mapInArrow(run, "task int, made int, row int, query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("task", "made", "row").orderBy(F.desc("score"), "vec_id"))
    return part.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.w, d.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
