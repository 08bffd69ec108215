"""Approximate search: inverted lists over k-means cells, hyperplane hashing, and codes as a first stage.

All of them only choose candidates; what they return is ranked by exact distance. Recall is measured against exact search.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from halyard.contract import Metric, checked_vector
from halyard.functions.predicates import Filter
from halyard.operators import search as S
from halyard.operators.kmeans import assign, kmeans


def share_scanned(pairs: DataFrame, rows: int) -> DataFrame:
    """Of candidate pairs (query_id, ...) the mean share of the table's rows that a query met."""
    return pairs.groupBy("query_id").agg(F.count("*").alias("n")).agg((F.avg("n") / rows).alias("share"))


def append_column(df: DataFrame, vector: str, name: str, kind: str, function) -> DataFrame:
    """df with a column that function makes from the matrix of the vectors, batch by batch."""
    at = df.columns.index(vector)
    schema = StructType([*df.schema.fields, StructField(name, StructType.fromDDL(f"x {kind}")["x"].dataType)])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                column = batch.column(at)
                x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1)
                yield pa.record_batch([*batch.columns, function(x)], names=[*batch.schema.names, name])

    return df.where(F.col(vector).isNotNull()).mapInArrow(run, schema)


@dataclass(frozen=True)
class InvertedLists:
    """Cells of k-means; a query looks into the nearest of them."""

    centres: tuple[tuple[float, ...], ...]
    metric: Metric = Metric.COSINE

    @classmethod
    def train(cls, df: DataFrame, cells: int, metric: Metric | str = Metric.COSINE, iterations: int = 10, id: str = "vec_id", vector: str = "embedding") -> InvertedLists:
        return cls(tuple(map(tuple, kmeans(df, vector, id, cells, iterations)[0].tolist())), Metric.of(metric))

    def index(self, df: DataFrame, vector: str = "embedding") -> DataFrame:
        """All rows with their cell; written partitioned by it, a search reads its cells only."""
        centres = np.array(self.centres)
        return append_column(df, vector, "cell", "int", lambda x: pa.array(assign(x, centres).astype(np.int32)))

    def cells_of(self, query: Sequence[float], probes: int) -> list[int]:
        d = ((np.array(self.centres) - np.array(query)) ** 2).sum(axis=1)
        return [int(i) for i in np.argsort(d, kind="stable")[:probes]]

    def search(self, indexed: DataFrame, query: Sequence[float], k: int, probes: int = 4, filter: Filter | None = None, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
        near = indexed.where(F.col("cell").isin(self.cells_of(checked_vector(query), probes)))
        return S.top_k(near, query, k, self.metric, filter, id=id, vector=vector)

    def candidates(self, indexed: DataFrame, queries: DataFrame, probes: int = 4, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """query_id, query, id and vector of the rows in the probed cells. Queries (query_id, query) meet the rows of their cells in an equi-join."""
        centres = np.array(self.centres)

        def nearest(x: np.ndarray) -> pa.Array:
            d = (centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T
            return pa.array(np.argsort(d, axis=1, kind="stable")[:, :probes].tolist(), pa.list_(pa.int32()))

        probed = append_column(queries.select("query_id", F.col("query").cast("array<double>").alias("query")), "query", "cells", "array<int>", nearest)
        return probed.select("query_id", "query", F.explode("cells").alias("cell")).join(indexed.select(id, vector, "cell"), "cell").drop("cell")

    def search_batch(self, indexed: DataFrame, queries: DataFrame, k: int, probes: int = 4, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """The k nearest in the probed cells of each query, cell by cell as matrix products; met: number of rows in those cells."""
        centres = np.array(self.centres)

        def probed(part: pa.RecordBatch) -> bytes:
            x = S.matrix(part.column(1), centres.shape[1])
            d = (centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T
            return np.argsort(d, axis=1, kind="stable")[:, :probes].astype(np.int32).tobytes()

        return _search(indexed.withColumn("own", F.array("cell")), queries, k, self.metric, id, vector, centres.shape[1], lambda: Cells(k, self.metric, len(centres)), lambda part: part.column(2).flatten().to_numpy().astype(np.int32).tobytes(), probed)


class Nearest:
    """Places (ascending as the ids are) and distances of the k nearest rows of a chunk so far, for each of some queries, and how many rows each met."""

    def __init__(self, chunk: Chunk, q: np.ndarray):
        self.chunk, self.q, self.k = chunk, q, chunk.k
        self.d, self.at, self.met = np.full((len(q), self.k), np.inf), np.full((len(q), self.k), -1), np.zeros(len(q), np.int64)
        self.lengths = np.linalg.norm(q, axis=1)

    def add(self, who: np.ndarray, d: np.ndarray, at: np.ndarray) -> None:
        """Near enough distances d[query, row] of queries who to the rows at places at; those that can be among the best are made exact."""
        self.met[who] += d.shape[1]
        keep = np.broadcast_to(np.arange(d.shape[1]), d.shape)
        if d.shape[1] > 4 * self.k:  # not above the k-th smallest
            kth = np.partition(d, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            most = int((d <= kth + self.chunk.slack(self.lengths[who])[:, None]).sum(axis=1).max())
            keep = np.argpartition(d, most - 1, axis=1)[:, :most]
        step = max(1, (1 << 21) // (keep.shape[1] * self.q.shape[1]))
        for i in range(0, len(who), step):
            own, places = who[i : i + step], at[keep[i : i + step]]
            near = self.chunk.row_by_row(self.q[own], self.lengths[own], places)
            near, places = np.concatenate([self.d[own], near], axis=1), np.concatenate([self.at[own], places], axis=1)
            best = np.lexsort((places, near), axis=-1)[:, : self.k]
            self.d[own], self.at[own] = np.take_along_axis(near, best, axis=1), np.take_along_axis(places, best, axis=1)

    def found(self, names: pa.Array, ids: np.ndarray):
        who, which = np.nonzero(self.at >= 0)
        if len(who):
            met = np.where(which == 0, self.met[who], 0)  # once a query
            yield pa.record_batch([names.take(pa.array(who)), pa.array(ids[self.at[who, which]].tolist()), pa.array(self.d[who, which]), pa.array(met)], names=["query_id", "id", "distance", "met"])


class Chunk:
    """Rows in order of id, with their lengths."""

    def __init__(self, k: int, metric: Metric):
        self.k, self.metric = k, metric

    def take(self, segments: list, kind: type) -> np.ndarray:
        """Hold the rows; what goes with them, row by row."""
        ids = np.concatenate([x for x, _, _ in segments])
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], np.concatenate([x for _, x, _ in segments])[order]
        self.lengths = np.linalg.norm(self.rows, axis=1)
        return np.concatenate([np.frombuffer(x, kind).reshape(len(i), -1) for i, _, x in segments])[order]

    def slack(self, lengths: np.ndarray) -> np.ndarray:
        """How far off distances by matrix products may be, generously, for queries of some lengths."""
        scale = float(self.lengths.max(initial=0))
        if self.metric is Metric.DOT_PRODUCT:
            return 1e-9 * lengths * scale
        return 1e-6 * (lengths + scale) if self.metric is Metric.EUCLIDEAN else np.full(len(lengths), 1e-9 if self.metric is Metric.COSINE else 1e-9 * scale)

    def row_by_row(self, q: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distances of each query to the rows at its places [query, place]: the same for the same vectors, wherever they stand."""
        x = self.rows[at]
        if self.metric is Metric.MANHATTAN:
            return np.abs(x - q[:, None, :]).sum(axis=2)
        if self.metric is Metric.EUCLIDEAN:
            return np.sqrt(((x - q[:, None, :]) ** 2).sum(axis=2))
        return S.from_products((x * q[:, None, :]).sum(axis=2), lengths[:, None], self.lengths[at], self.metric)


class Cells(Chunk):
    """A chunk in inverted lists: the queries that probe a cell meet its rows, and no others do."""

    def __init__(self, k: int, metric: Metric, cells: int):
        super().__init__(k, metric)
        self.cells = cells

    def hold(self, segments: list) -> None:
        cell = self.take(segments, np.int32)[:, 0]
        order = np.argsort(cell, kind="stable")
        self.lists = np.split(order, np.searchsorted(cell[order], np.arange(1, self.cells)))

    def found(self, names: pa.Array, q: np.ndarray, extra: bytes):
        probed = np.frombuffer(extra, np.int32).reshape(len(q), -1)
        order = np.argsort(probed.ravel(), kind="stable")
        asking = np.split(order // max(probed.shape[1], 1), np.searchsorted(probed.ravel()[order], np.arange(1, self.cells)))
        best = Nearest(self, q)
        for who, at in zip(asking, self.lists, strict=True):
            if len(who):
                for i in range(0, len(at), 4096):
                    best.add(who, S.distances(q[who], self.rows[at[i : i + 4096]], self.metric), at[i : i + 4096])
        yield from best.found(names, self.ids)


def _search(indexed: DataFrame, queries: DataFrame, k: int, metric: Metric, id: str, vector: str, width: int, holder, of_row, of_query) -> DataFrame:
    """query_id, id, distance, score, rank and met (rows that the query met) of the k nearest that holder() finds. Rows are dealt into chunks, queries stream past; no pair of a query and a row is ever a row of a table."""
    from pyspark.sql import Window

    from halyard.functions import vectors as V

    def clean(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col(df.columns[0]).isNotNull() & (F.size(name) == width))

    rows = clean(indexed.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"), "own"), "v")
    wanted = clean(queries.select("query_id", F.col("query").cast("array<double>").alias("q")), "q")
    schema = StructType([StructField("query_id", wanted.schema[0].dataType), StructField("id", rows.schema[0].dataType), StructField("distance", DoubleType()), StructField("met", LongType())])
    hits = S.meetings(rows, wanted, width, schema, holder, of_row, of_query)
    every = Window.partitionBy("query_id")
    ranked = hits.withColumn("rank", F.row_number().over(every.orderBy("distance", "id"))).withColumn("met", F.sum("met").over(every)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("id").alias(id), "distance", V.score_of(metric, F.col("distance")).alias("score"), "rank", "met")


@dataclass(frozen=True)
class HyperplaneHashing:
    """`tables` signatures of `bits` signs against seeded random hyperplanes.

    A query looks into `probes` buckets of each table: its own and those that differ in signs that it lies nearest to the
    hyperplanes of. Candidates share such a bucket in `hits` tables at least. Bits should grow with the logarithm of the rows.
    """

    dimension: int
    tables: int = 64
    bits: int = 12
    probes: int = 48
    hits: int = 2
    seed: int = 42
    metric: Metric = Metric.COSINE

    def _projections(self, x: np.ndarray) -> np.ndarray:
        planes = np.random.default_rng(self.seed).normal(size=(self.dimension, self.tables * self.bits))
        return (x @ planes).reshape(len(x), self.tables, self.bits)

    def signatures(self, x: np.ndarray) -> np.ndarray:
        return (self._projections(x) > 0) @ (1 << np.arange(self.bits))

    def probed(self, x: np.ndarray) -> np.ndarray:
        """For each vector and table the buckets to look into, its own first."""
        flips = np.arange(1 << self.bits)
        flips = flips[np.bitwise_count(flips) <= 4]
        turned = ((flips[:, None] >> np.arange(self.bits)) & 1).T.astype(float)

        def some(part: np.ndarray) -> np.ndarray:
            near = self._projections(part)
            own = (near > 0) @ (1 << np.arange(self.bits))
            cost = near**2 @ turned  # how far the vector is from that bucket
            return own[:, :, None] ^ flips[np.argsort(cost, axis=2, kind="stable")[:, :, : self.probes]]

        return np.concatenate([some(x[i : i + 64]) for i in range(0, max(len(x), 1), 64)])  # so many at once: a vector has tables * buckets costs

    def index(self, df: DataFrame, vector: str = "embedding") -> DataFrame:
        return append_column(df, vector, "buckets", "array<long>", lambda x: pa.array(self.signatures(x).tolist(), pa.list_(pa.int64())))

    def candidates(self, indexed: DataFrame, queries: DataFrame, id: str = "vec_id") -> DataFrame:
        """query_id and id of the candidates, each once: a count of common buckets, pre-aggregated."""
        kind = pa.list_(pa.list_(pa.int64()))
        asked = append_column(queries.select("query_id", F.col("query").cast("array<double>").alias("query")), "query", "buckets", "array<array<long>>", lambda x: pa.array(self.probed(x).tolist(), kind))
        left = asked.select("query_id", F.posexplode("buckets").alias("table", "b")).select("query_id", "table", F.explode("b").alias("bucket"))
        right = indexed.select(id, F.posexplode("buckets").alias("table", "bucket"))
        return left.join(right, ["table", "bucket"]).groupBy("query_id", id).agg(F.count("*").alias("n")).where(F.col("n") >= self.hits).select("query_id", id)

    def search_batch(self, indexed: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """The k nearest of each query's candidates, which are counted table by table within chunks of rows; met: number of candidates."""

        def own(part: pa.RecordBatch) -> bytes:
            return part.column(2).flatten().to_numpy().astype(np.int32).tobytes()

        def probed(part: pa.RecordBatch) -> bytes:
            return self.probed(S.matrix(part.column(1), self.dimension)).astype(np.int32).tobytes()

        return _search(indexed.withColumnRenamed("buckets", "own"), queries, k, self.metric, id, vector, self.dimension, lambda: Buckets(k, self.metric, self.tables, 1 << self.bits, self.hits), own, probed)


class Buckets(Chunk):
    """A chunk in hash tables: for each table the places of its rows by bucket."""

    def __init__(self, k: int, metric: Metric, tables: int, buckets: int, hits: int):
        super().__init__(k, metric)
        self.tables, self.buckets, self.hits = tables, buckets, hits

    def hold(self, segments: list) -> None:
        own = self.take(segments, np.int32)
        self.order = np.concatenate([np.argsort(own[:, t], kind="stable").astype(np.int32) for t in range(self.tables)])
        sizes = np.stack([np.bincount(own[:, t], minlength=self.buckets) for t in range(self.tables)])
        self.ends = np.cumsum(sizes.ravel())  # rows stand table after table, bucket after bucket
        self.sizes = sizes.ravel()

    def candidates(self, probed: np.ndarray) -> np.ndarray:
        """Places of the rows that share enough of the buckets [table, probe]."""
        which = (np.arange(self.tables)[:, None] * self.buckets + probed).ravel()
        n = self.sizes[which]
        total = np.cumsum(n)
        if not len(total) or not total[-1]:
            return np.zeros(0, np.int64)
        places = np.arange(total[-1]) + np.repeat(self.ends[which] - total, n)
        return np.flatnonzero(np.bincount(self.order[places], minlength=len(self.ids)) >= self.hits)

    def found(self, names: pa.Array, q: np.ndarray, extra: bytes):
        probed = np.frombuffer(extra, np.int32).reshape(len(q), self.tables, -1)
        best = Nearest(self, q)
        for i in range(0, len(q), 32):
            mine = [self.candidates(x) for x in probed[i : i + 32]]
            # many candidates: one product for all of the block costs less than gathering the rows of each, and only theirs are looked at
            product = q[i : i + 32] @ self.rows.T if self.metric in (Metric.COSINE, Metric.DOT_PRODUCT) and 16 * sum(map(len, mine)) > len(mine) * len(self.ids) else None
            for j, at in enumerate(mine):
                if len(at):
                    who = np.array([i + j])
                    d = S.distances(q[who], self.rows[at], self.metric) if product is None else S.from_products(product[j : j + 1, at], best.lengths[who][:, None], self.lengths[at][None, :], self.metric)
                    best.add(who, d, at)
        yield from best.found(names, self.ids)
