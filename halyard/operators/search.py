"""Exact nearest-neighbour search.

A single query is a projection and TakeOrderedAndProject, filters pushed into the scan. Several queries at once run as matrix
products over Arrow batches, `QUERY_BLOCK` queries at a time, in one pass over the table: every task keeps the best k rows of each
query, so only queries * k rows a task are shuffled, and a window merges them. Queries of at most `BROADCAST_BYTES` in all go to
the tasks as they are. Beyond that, rows are packed into segments and segments dealt into chunks of `CHUNK_BYTES`; a task holds a
chunk and streams the packed queries past it, so nothing of either table passes the driver and the rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from halyard.contract import DimensionMismatch, InvalidRequest, Metric, SearchRequest, check_cuts, checked_vector
from halyard.functions import vectors as V
from halyard.functions.predicates import Filter, where

QUERY_BLOCK = 1024
BROADCAST_BYTES, CHUNK_BYTES, SEGMENT_ROWS = 64 << 20, 64 << 20, 4096
SPREAD_QUERIES = 256


def with_distance(df: DataFrame, query: Sequence[float], metric: Metric | str, vector: str = "embedding") -> DataFrame:
    """df with distance and score against one vector; rows without a vector of that dimension go."""
    q = checked_vector(query)
    d = V.distance(metric, F.col(vector), q)
    return df.where(F.size(vector) == len(q)).withColumn("distance", d).withColumn("score", V.score_of(metric, F.col("distance")))


def _cut(df: DataFrame, max_distance: float | None, min_score: float | None) -> DataFrame:
    check_cuts(max_distance, min_score)
    if max_distance is not None:
        df = df.where(F.col("distance") <= max_distance)
    return df if min_score is None else df.where(F.col("score") >= min_score)


def top_k(
    df: DataFrame, query: Sequence[float], k: int = 10, metric: Metric | str = Metric.COSINE, filter: Filter | None = None, max_distance: float | None = None, min_score: float | None = None,
    include_vector: bool = False, id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """The k nearest rows that pass the filter, with distance, score and rank, ordered by distance and id."""
    SearchRequest(query, k, filter, max_distance, min_score).validate()
    found = with_distance(where(df, filter), query, metric, vector)
    if not include_vector:
        found = found.drop(vector)
    best = _cut(found.orderBy("distance", id).limit(k), max_distance, min_score)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("distance", id)))  # at most k rows


def search(df: DataFrame, request: SearchRequest, metric: Metric | str, id: str = "id", vector: str = "vector") -> DataFrame:
    out = top_k(df, request.vector, request.k, metric, request.filter, request.max_distance, request.min_score, request.include_vector, id, vector)
    return out if request.include_metadata else out.select(id, "distance", "score", "rank", *([vector] if request.include_vector else []))


def range_search(df: DataFrame, query: Sequence[float], radius: float, metric: Metric | str = Metric.COSINE, filter: Filter | None = None, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """All rows within a distance, inclusive."""
    return _cut(with_distance(where(df, filter), query, metric, vector), radius, None).drop(vector)


def min_score_search(df: DataFrame, query: Sequence[float], least: float, metric: Metric | str = Metric.COSINE, filter: Filter | None = None, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """All rows with a score of least at least."""
    return _cut(with_distance(where(df, filter), query, metric, vector), None, least).drop(vector)


def average_distance(results: DataFrame) -> DataFrame:
    """Mean distance of the results of each search, or of one search."""
    keys = [c for c in ("query_id",) if c in results.columns]
    return results.groupBy(*keys).agg(F.avg("distance").alias("avg_distance"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow list column of vectors of one length as doubles."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def from_products(product: np.ndarray, a: np.ndarray, b: np.ndarray, metric: Metric) -> np.ndarray:
    """Distances from inner products and the lengths of both sides; all but L1."""
    if metric is Metric.DOT_PRODUCT:
        return -product
    if metric is Metric.EUCLIDEAN:
        return np.sqrt(np.maximum(a * a + b * b - 2 * product, 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        cos = np.clip(product / (a * b), -1, 1)
    return 1 - np.where((a == 0) & (b == 0), 1.0, np.where((a == 0) | (b == 0), 0.0, cos))


def distances(queries: np.ndarray, rows: np.ndarray, metric: Metric) -> np.ndarray:
    """All distances by matrix products (L1: by differences)."""
    if metric is Metric.MANHATTAN:
        return np.stack([np.abs(rows - q).sum(axis=1) for q in queries])
    return from_products(queries @ rows.T, np.linalg.norm(queries, axis=1)[:, None], np.linalg.norm(rows, axis=1)[None, :], metric)


def _nearest(held: list[np.ndarray], k: int) -> np.ndarray:
    """Places of the k smallest by (distance, id) in each row; held: distances and ids, row by row."""
    return np.lexsort((held[1], held[0]), axis=-1)[:, :k]


def batch_top_k(
    df: DataFrame, queries: DataFrame, k: int = 10, metric: Metric | str = Metric.COSINE, filter: Filter | None = None, max_distance: float | None = None, min_score: float | None = None,
    id: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", query: str = "query", max_broadcast: int = BROADCAST_BYTES,
) -> DataFrame:
    """query_id, id, distance, score and rank of the k nearest rows of every query (columns query_id, query)."""
    if k <= 0:
        raise InvalidRequest("k must be positive")
    metric = Metric.of(metric)
    wanted = queries.select(F.col(query_id).alias("query_id"), F.col(query).cast("array<double>").alias("q")).where(F.col("q").isNotNull())
    source = where(df, filter).select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    schema = StructType([StructField("query_id", wanted.schema["query_id"].dataType), StructField("id", source.schema["id"].dataType), StructField("distance", DoubleType())])
    few = wanted.limit(QUERY_BLOCK + 1).toArrow()
    if few.num_rows > QUERY_BLOCK:
        size = wanted.agg(F.count("*").alias("n"), F.min(F.size("q")).alias("least"), F.max(F.size("q")).alias("most")).first()
        if size["least"] != size["most"]:
            raise DimensionMismatch("queries of different dimensions")
        if size["n"] * size["most"] * 8 > max_broadcast:
            out = _chunked(source.where(F.size("v") == size["most"]), wanted, size["most"], k, metric, schema)
        else:
            out = _pass(source, wanted.toArrow(), k, metric, schema)
    elif few.num_rows:
        out = _pass(source, few, k, metric, schema)
    else:
        out = queries.sparkSession.createDataFrame([], schema)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k)
    scored = _cut(ranked.withColumn("score", V.score_of(metric, F.col("distance"))), max_distance, min_score)
    return scored.select("query_id", F.col("id").alias(id), "distance", "score", "rank")


class Best:
    """The k nearest rows so far of each of some queries."""

    def __init__(self, names: pa.Array, q: np.ndarray, k: int, metric: Metric):
        self.names, self.q, self.k, self.metric = names, q, k, metric
        self.held: list[np.ndarray] | None = None  # distances and ids, row by row

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        k = self.k
        for i in range(0, len(ids), 4096):
            own_rows = rows[i : i + 4096]
            d = distances(self.q, own_rows, self.metric)
            at = np.broadcast_to(np.arange(d.shape[1]), d.shape)
            if d.shape[1] > 4 * k:  # all that can be among the best: not above the k-th smallest
                kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                most = int((d <= kth).sum(axis=1).max())
                at = np.argsort(d, axis=1, kind="stable")[:, :most] if most > 4 * k else np.argpartition(d, most - 1, axis=1)[:, :most]
                d = np.take_along_axis(d, at, axis=1)
            if self.metric is Metric.EUCLIDEAN:  # the product form loses digits where vectors are close
                d = np.stack([np.sqrt(((own_rows[n] - v) ** 2).sum(axis=1)) for n, v in zip(at, self.q, strict=True)])
            own = [d, ids[i : i + 4096][at]]
            best = own if self.held is None else [np.concatenate([x, y], axis=1) for x, y in zip(self.held, own, strict=True)]
            places = _nearest(best, k)
            self.held = [np.take_along_axis(x, places, axis=1) for x in best]

    def found(self) -> Iterator[pa.RecordBatch]:
        if self.held is not None:
            n = self.held[0].shape[1]
            yield pa.record_batch([self.names.take(pa.array(np.repeat(np.arange(len(self.names)), n))), pa.array(self.held[1].ravel().tolist()), pa.array(self.held[0].ravel())], names=["query_id", "id", "distance"])


def _blocks(names: pa.Array, q: np.ndarray, k: int, metric: Metric) -> list[Best]:
    return [Best(names[i : i + QUERY_BLOCK], q[i : i + QUERY_BLOCK], k, metric) for i in range(0, len(q), QUERY_BLOCK)]


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _pass(source: DataFrame, queries: pa.Table, k: int, metric: Metric, schema: StructType) -> DataFrame:
    """The best of each task for queries that all tasks hold."""
    names, vectors = _flat(queries.column(0)), _flat(queries.column(1))
    sizes = np.diff(vectors.offsets.to_numpy())
    if len(set(sizes.tolist())) != 1:
        raise DimensionMismatch("queries of different dimensions")
    width = int(sizes[0])
    q = matrix(vectors, width)
    held = source.sparkSession.sparkContext.broadcast((names, q))

    def run(batches):
        blocks = _blocks(*held.value, k, metric)
        for batch in batches:
            if batch.num_rows:
                ids, rows = np.array(batch.column(0).to_pylist()), matrix(batch.column(1), width)
                for b in blocks:
                    b.add(ids, rows)
        for b in blocks:
            yield from b.found()

    return _spread(source.where(F.size("v") == width), len(names)).mapInArrow(run, schema)


def _spread(source: DataFrame, queries: int) -> DataFrame:
    """source, dealt out where many queries wait: a file of few row groups is few tasks."""
    return source.repartition(source.sparkSession.sparkContext.defaultParallelism) if queries > SPREAD_QUERIES else source


class AllRows:
    """A chunk of rows that every query meets whole."""

    def __init__(self, k: int, metric: Metric):
        self.k, self.metric = k, metric

    def hold(self, segments: list[tuple[np.ndarray, np.ndarray, bytes | None]]) -> None:
        self.segments = segments

    def found(self, names: pa.Array, q: np.ndarray, extra: bytes | None) -> Iterator[pa.RecordBatch]:
        best = Best(names, q, self.k, self.metric)
        for ids, rows, _ in self.segments:
            best.add(ids, rows)
        yield from best.found()


def _chunked(source: DataFrame, wanted: DataFrame, width: int, k: int, metric: Metric, schema: StructType) -> DataFrame:
    """The best of each chunk of rows for queries in packed blocks that stream past it."""
    return meetings(source, wanted, width, schema, lambda: AllRows(k, metric))


def meetings(source: DataFrame, wanted: DataFrame, width: int, schema: StructType, holder, of_row=None, of_query=None) -> DataFrame:
    """What holder() finds for queries (query_id, q, ...) in each chunk of rows (id, v, ...): hold(segments), then found(names, q, extra) for each block of queries.

    of_row and of_query turn an Arrow batch into bytes that go with a segment or block. A chunk has at most about CHUNK_BYTES of
    vectors; a block at most QUERY_BLOCK queries.
    """

    def pack(size: int, extra):
        def run(batches):
            from pyspark import TaskContext

            task, made = TaskContext.get().partitionId(), 0
            for batch in batches:
                for i in range(0, batch.num_rows, size):
                    part = batch.slice(i, size)
                    made += 1
                    yield pa.record_batch(
                        [
                            pa.array([task], pa.int32()),
                            pa.array([made], pa.int32()),
                            pa.array([part.column(0).to_pylist()], pa.list_(part.schema.field(0).type)),
                            pa.array([matrix(part.column(1), width).tobytes()], pa.binary()),
                            pa.array([extra(part) if extra else None], pa.binary()),
                        ],
                        names=["task", "made", "ids", "data", "extra"],
                    )

        return run

    def packed(df: DataFrame, size: int, extra) -> DataFrame:
        kind = df.schema[0].dataType
        return df.mapInArrow(pack(size, extra), StructType([StructField("task", IntegerType()), StructField("made", IntegerType()), StructField("ids", ArrayType(kind)), StructField("data", BinaryType()), StructField("extra", BinaryType())]))

    count = source.count()
    cores = source.sparkSession.sparkContext.defaultParallelism
    chunks = max(1, -(-count * width * 8 // CHUNK_BYTES), cores)
    size = max(1, min(SEGMENT_ROWS, -(-count // (8 * chunks))))  # enough segments that chunks are of like size
    dealt = F.pmod(F.col("made") + F.pmod(F.hash("task"), F.lit(chunks)), F.lit(chunks))
    rows = packed(source, size, of_row).select(dealt.alias("chunk"), F.col("ids").alias("row_ids"), F.lit(None).cast(ArrayType(wanted.schema[0].dataType)).alias("query_ids"), "task", "made", "data", "extra")
    tiles = packed(wanted, QUERY_BLOCK, of_query).select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(None).cast(ArrayType(source.schema[0].dataType)).alias("row_ids"), F.col("ids").alias("query_ids"), "task", "made", "data", "extra")
    stream = rows.unionByName(tiles).repartitionById(chunks, "chunk").sortWithinPartitions("chunk", F.col("row_ids").isNull(), "task", "made")

    def run(batches):
        key, held, ready = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, row_ids, query_ids, data, extra = batch.column(0)[i].as_py(), batch.column(1)[i], batch.column(2)[i], batch.column(5)[i], batch.column(6)[i].as_py()
                vectors = np.frombuffer(data.as_py(), np.float64).reshape(-1, width)
                if chunk != key:
                    key, held, ready = chunk, [], None
                if row_ids.is_valid:
                    held.append((np.array(row_ids.as_py()), vectors, extra))
                elif held:
                    if ready is None:
                        ready = holder()
                        ready.hold(held)
                    yield from ready.found(query_ids.values, vectors, extra)

    return stream.mapInArrow(run, schema)


def self_match(df: DataFrame, queries: DataFrame, metric: Metric | str = Metric.COSINE, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For stored vectors as queries: query_id, the nearest id and whether it is the vector itself."""
    best = batch_top_k(df, queries.select(F.col(id).alias("query_id"), F.col(vector).alias("query")), 1, metric, id=id, vector=vector)
    return best.select("query_id", F.col(id).alias("nearest"), (F.col(id) == F.col("query_id")).alias("matched"))


def recall(found: DataFrame, truth: DataFrame, k: int, id: str = "vec_id") -> DataFrame:
    """recall@k of each query: the share of the true k nearest that were found."""
    hits = truth.where(F.col("rank") <= k).select("query_id", id).join(found.select("query_id", id, F.lit(1).alias("hit")).distinct(), ["query_id", id], "left")
    return hits.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))


def merge_shards(hits: DataFrame, k: int, id: str = "id", min_score: float | None = None, metric: Metric | str = Metric.COSINE, keys: Sequence[str] = ()) -> DataFrame:
    """One ranking from the hits of several shards: an id that replicas return twice counts once, at its smallest distance."""
    best = hits.groupBy(*keys, id).agg(F.min("distance").alias("distance")).withColumn("score", V.score_of(metric, F.col("distance")))
    if keys:
        out = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("distance", id))).where(F.col("rank") <= k)
    else:
        out = best.orderBy("distance", id).limit(k).withColumn("rank", F.row_number().over(Window.orderBy("distance", id)))
    return out if min_score is None else out.where(F.col("score") >= min_score)


def diversify(results: DataFrame, gap: float = 0.1, id: str = "vec_id", keys: Sequence[str] = ()) -> DataFrame:
    """Results (at most k a query) without those whose score lies within gap of one kept before, in order of rank."""
    row = F.struct("rank", F.col(id).alias("id"), "distance", "score")
    kind = results.select(row.alias("r")).schema["r"].dataType.simpleString()
    kept = F.aggregate(
        F.array_sort(F.collect_list(row)),
        F.array().cast(f"array<{kind}>"),
        lambda done, x: F.when(F.exists(done, lambda y: F.abs(y["score"] - x["score"]) < gap), done).otherwise(F.concat(done, F.array(x))),
    )
    return results.groupBy(*keys).agg(kept.alias("r")).select(*keys, F.explode("r").alias("r")).select(*keys, F.col("r.id").alias(id), "r.distance", "r.score", "r.rank")


def nearest_centroid(df: DataFrame, centroids: Sequence[Sequence[float]], vector: str = "embedding", metric: Metric | str = Metric.EUCLIDEAN) -> Column:
    """Number of the nearest of a few fixed vectors, the first of equals."""
    pairs = F.array(*[F.struct(V.distance(metric, F.col(vector), list(c)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids)])
    return F.array_min(pairs)["i"]
