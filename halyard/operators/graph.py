"""Layered proximity graphs as a stored index: one graph for each `graph_rows` rows at most, searched together.

Rows are dealt to graphs by hashes of their ids, so graphs are alike in size, as many tasks as there are graphs build them, and they
do not depend on the files. A graph is built once, over bounded rows in order of id, and is one row of a table that is written and read like any other;
a search reads that table alone. New rows make graphs of their own beside the stored ones (a batch add touches nothing that is
there); compacting builds all anew. In a graph a row gets a geometric number of layers, is linked to the best of its beam of
`ef_construction` candidates that are not closer to an earlier chosen one than to it, and links are cut to m (2m in the base
layer). A search walks every graph from its entry point down and merges the results, so a row is found in its graph whatever their
number. Edges can be had as a table for statistics.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.contract import Metric
from halyard.operators import search as S


class Graph:
    def __init__(self, rows: np.ndarray, metric: Metric, m: int, ef_construction: int, max_layer: int, seed: int):
        self._hold(rows, metric)
        self.m, self.ef = m, ef_construction
        rng = np.random.default_rng(seed)
        draws = np.minimum(rng.geometric(0.5, len(rows)) - 1, max_layer - 1)
        self.layers = np.minimum(draws, max(0, int(math.log2(max(len(rows), 1)))))
        self.links: list[list[dict[int, float]]] = [[{} for _ in range(n + 1)] for n in self.layers]
        self.entry: int | None = None
        for i in range(len(rows)):
            self._insert(i)

    def _hold(self, rows: np.ndarray, metric: Metric) -> None:
        """The rows, under cosine as unit vectors too, so that a distance is a product alone."""
        self.rows, self.metric = rows, metric
        self.x = self._unit(rows) if metric is Metric.COSINE else rows
        self.empty = ~self.x.any(axis=1) if metric is Metric.COSINE else np.zeros(0, bool)
        self.some_empty = bool(self.empty.any())

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=-1, keepdims=True)
        return np.divide(x, n, out=np.zeros_like(x), where=n != 0)

    def _to(self, q: np.ndarray, ids: Sequence[int]) -> np.ndarray:
        """Distances of q, which is a row of x or prepared as they are, to rows."""
        if self.metric is Metric.COSINE:
            if self.some_empty and not q.any():
                return np.where(self.empty[ids], 0.0, 1.0)
            return 1.0 - self.x[ids] @ q
        if self.metric is Metric.DOT_PRODUCT:
            return -(self.x[ids] @ q)
        d = self.x[ids] - q
        return np.abs(d).sum(axis=1) if self.metric is Metric.MANHATTAN else np.sqrt((d * d).sum(axis=1))

    def _among(self, ids: list[int]) -> np.ndarray:
        """Distances of all pairs of rows."""
        x = self.x[ids]
        if self.metric is not Metric.COSINE:
            return S.distances(x, x, self.metric)
        d = 1.0 - x @ x.T
        if self.some_empty:
            d[np.ix_(self.empty[ids], self.empty[ids])] = 0.0
        return d

    def _beam(self, q: np.ndarray, starts: list[tuple[float, int]], ef: int, layer: int) -> list[tuple[float, int]]:
        """The ef nearest that a best-first walk finds, nearest first."""
        seen = {i for _, i in starts}
        open_, best = list(starts), [(-d, i) for d, i in starts]
        heapq.heapify(open_)
        heapq.heapify(best)
        full, worst = len(best) >= ef, -best[0][0]
        while open_:
            d, i = heapq.heappop(open_)
            if full and d > worst:
                break
            new = [j for j in self.links[i][layer] if j not in seen]
            if not new:
                continue
            seen.update(new)
            for e, j in zip(self._to(q, new).tolist(), new, strict=True):
                if full:
                    if e < worst:
                        heapq.heappush(open_, (e, j))
                        heapq.heappushpop(best, (-e, j))
                        worst = -best[0][0]
                else:
                    heapq.heappush(open_, (e, j))
                    heapq.heappush(best, (-e, j))
                    full, worst = len(best) >= ef, -best[0][0]
        return sorted((-d, i) for d, i in best)

    def _chosen(self, found: list[tuple[float, int]], most: int) -> list[tuple[float, int]]:
        """Candidates that no chosen one is closer to than the new row, filled up with the nearest others."""
        if len(found) < 2:
            return found[:most]
        ids = [i for _, i in found]
        closer = np.packbits(self._among(ids) < np.array([d for d, _ in found]), axis=1, bitorder="little")  # [chosen, candidate]
        width, bits, shut = closer.shape[1], closer.tobytes(), 0
        out: list[tuple[float, int]] = []
        rest: list[tuple[float, int]] = []
        for n, one in enumerate(found):
            if len(out) == most:
                break
            if shut >> n & 1:
                rest.append(one)
            else:
                out.append(one)
                shut |= int.from_bytes(bits[n * width : (n + 1) * width], "little")
        return out + rest[: most - len(out)]

    def _insert(self, i: int) -> None:
        top = len(self.links[i]) - 1
        if self.entry is None:
            self.entry = i
            return
        q, at = self.x[i], self.entry
        starts = [(float(self._to(q, [at])[0]), at)]
        for layer in range(len(self.links[at]) - 1, top, -1):
            starts = self._beam(q, starts, 1, layer)
        for layer in range(min(top, len(self.links[at]) - 1), -1, -1):
            found = self._beam(q, starts, self.ef, layer)
            most = self.m if layer else 2 * self.m
            for d, j in self._chosen(found, self.m):
                self.links[i][layer][j] = d
                other = self.links[j][layer]
                other[i] = d
                if len(other) > most:
                    self.links[j][layer] = {b: a for a, b in self._chosen(sorted((x, y) for y, x in other.items()), most)}
            starts = found
        if top > len(self.links[at]) - 1:
            self.entry = i

    def search(self, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        if self.entry is None:
            return []
        if self.metric is Metric.COSINE:
            q = self._unit(q)
        starts = [(float(self._to(q, [self.entry])[0]), self.entry)]
        for layer in range(len(self.links[self.entry]) - 1, 0, -1):
            starts = self._beam(q, starts, 1, layer)
        return [(self._clipped(d), i) for d, i in self._beam(q, starts, max(ef, k), 0)[:k]]

    def _clipped(self, d: float) -> float:
        return min(max(d, 0.0), 2.0) if self.metric is Metric.COSINE else d

    def packed(self) -> dict[str, bytes | int]:
        """The graph without its vectors as flat arrays."""
        flat = [own for near in self.links for own in near]
        return {
            "entry": -1 if self.entry is None else self.entry,
            "layers": np.array([len(x) for x in self.links], np.int32).tobytes(),
            "degrees": np.array([len(x) for x in flat], np.int32).tobytes(),
            "targets": np.array([j for own in flat for j in own], np.int32).tobytes(),
        }

    @classmethod
    def unpacked(cls, rows: np.ndarray, metric: Metric, entry: int, layers: bytes, degrees: bytes, targets: bytes) -> Graph:
        """A graph that can be searched, not added to."""
        out = cls.__new__(cls)
        out._hold(rows, metric)
        out.entry = None if entry < 0 else entry
        ends = np.cumsum(np.frombuffer(degrees, np.int32))
        near = [x.tolist() for x in np.split(np.frombuffer(targets, np.int32), ends[:-1])] if len(ends) else []
        at, out.links = 0, []
        for n in np.frombuffer(layers, np.int32).tolist():
            out.links.append(near[at : at + n])
            at += n
        return out

    def edges(self) -> list[tuple[int, int, int, float]]:
        return [(i, j, layer, self._clipped(d)) for i, own in enumerate(self.links) for layer, near in enumerate(own) for j, d in near.items()]


def tuned(dimension: int) -> tuple[int, int]:
    """Links and beam by dimension."""
    return (12, 200) if dimension <= 128 else (16, 300) if dimension <= 1024 else (20, 400)


#: Up to so many rows are one graph; beyond that they make a few graphs at least, so that cores share the building.
SMALL_ROWS, FEW_GRAPHS = 2_000, 16


def graph_count(rows: int, graph_rows: int) -> int:
    """Into how many graphs rows are dealt: a function of the table, not of its files, tasks or cores."""
    full = 1 if rows <= graph_rows else math.ceil(rows / (0.95 * graph_rows))  # dealt by hashes, so not all are of one size
    return max(full, min(FEW_GRAPHS, -(-rows // SMALL_ROWS)))


def _graphs(df: DataFrame, id: str, vector: str, graph_rows: int, parameters: tuple, schema: str, use) -> DataFrame:
    """What use makes of each graph over at most graph_rows rows; rows are dealt out by hashes of their ids, a graph to a task, which holds no more than that and a batch."""

    def run(batches):
        key, ids, held = None, [], []

        def made():
            for i in range(0, len(ids), graph_rows):
                yield from use(ids[i : i + graph_rows], Graph(rows[i : i + graph_rows], *parameters))

        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(start, end - start)
                if ids and (own[start] != key or len(ids) >= graph_rows):
                    rows = np.concatenate(held)
                    whole = len(ids) if own[start] != key else len(ids) // graph_rows * graph_rows
                    ids, rest_ids, rows, rest = ids[:whole], ids[whole:], rows[:whole], rows[whole:]
                    yield from made()
                    ids, held = rest_ids, [rest] if rest_ids else []
                key = own[start]
                ids = ids + part.column(0).to_pylist()
                held.append(np.asarray(part.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(part.num_rows, -1))
        if ids:
            rows = np.concatenate(held)
            yield from made()

    source = df.where(F.col(vector).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    graphs = graph_count(source.count(), graph_rows)
    dealt = source.withColumn("graph", F.pmod(F.xxhash64("id"), F.lit(graphs)).cast("int")) if graphs > 1 else source.withColumn("graph", F.lit(0))
    return dealt.repartitionById(graphs, "graph").sortWithinPartitions("graph", "id").mapInArrow(run, schema)


INDEX = "ids array<long>, width int, data binary, entry int, layers binary, degrees binary, targets binary"


def build_graphs(df: DataFrame, metric: Metric | str = Metric.COSINE, m: int = 12, ef_construction: int = 64, max_layer: int = 16, seed: int = 42, graph_rows: int = 20_000, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The index: one row a graph, to be written."""

    def use(ids, graph):
        p = graph.packed()
        columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([graph.rows.shape[1]], pa.int32()), pa.array([graph.rows.tobytes()], pa.binary()), pa.array([p["entry"]], pa.int32())]
        yield pa.record_batch([*columns, *[pa.array([p[x]], pa.binary()) for x in ("layers", "degrees", "targets")]], names=["ids", "width", "data", "entry", "layers", "degrees", "targets"])

    return _graphs(df, id, vector, graph_rows, (Metric.of(metric), m, ef_construction, max_layer, seed), INDEX, use)


def write_graphs(df: DataFrame, path: str, **parameters) -> DataFrame:
    """Build and store the index of df at path, beside what is stored there already (a batch add)."""
    build_graphs(df, **parameters).write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


def compact_graphs(index: DataFrame, path: str, **parameters) -> DataFrame:
    """Store at another path the graphs of all rows of an index, built anew, so that many small ones become few."""

    def rows(batches):
        for batch in batches:
            for ids, width, data in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = np.frombuffer(data.as_py(), float).reshape(-1, width)
                yield pa.record_batch([ids.values, pa.array(own.tolist(), pa.list_(pa.float64()))], names=["vec_id", "embedding"])

    return write_graphs(index.select("ids", "width", "data").mapInArrow(rows, "vec_id long, embedding array<double>"), path, **parameters)


def graph_edges(df: DataFrame, metric: Metric | str = Metric.COSINE, m: int = 12, ef_construction: int = 64, max_layer: int = 16, seed: int = 42, graph_rows: int = 20_000, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The edges of the graphs: src, dst, layer, distance."""

    def use(ids, graph):
        edges = graph.edges()
        if edges:
            a, b, layer, d = zip(*edges, strict=True)
            yield pa.record_batch([pa.array([ids[x] for x in a], pa.int64()), pa.array([ids[x] for x in b], pa.int64()), pa.array(layer, pa.int32()), pa.array(d, pa.float64())], names=["src", "dst", "layer", "distance"])

    return _graphs(df, id, vector, graph_rows, (Metric.of(metric), m, ef_construction, max_layer, seed), "src long, dst long, layer int, distance double", use)


def _blocks(queries: DataFrame) -> list[DataFrame]:
    """Queries (query_id, q) in blocks of about search.BROADCAST_BYTES."""
    wanted = queries.select(F.col("query_id").cast("long"), F.col("query").cast("array<double>").alias("q")).where(F.col("q").isNotNull())
    n = -(-(wanted.agg(F.sum(F.size("q").cast("long") * 8)).first()[0] or 1) // S.BROADCAST_BYTES)
    return [wanted] if n == 1 else [wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b) for b in range(n)]


def search_graphs(index: DataFrame, queries: DataFrame, k: int, metric: Metric | str = Metric.COSINE, ef: int | None = None, id: str = "vec_id") -> DataFrame:
    """query_id, id, distance, score and rank by a stored index; queries (query_id, query) go in blocks of about search.BROADCAST_BYTES, each a pass over it."""
    return _searched(index, _blocks(queries), k, Metric.of(metric), ef, id)


def _searched(index: DataFrame, blocks: list[DataFrame], k: int, metric: Metric, ef: int | None, id: str) -> DataFrame:
    beam = ef or max(100, 4 * k)
    found = None
    for block in blocks:
        asked = block.toArrow()
        vectors = asked.column("q").combine_chunks()
        held = index.sparkSession.sparkContext.broadcast((asked.column("query_id").to_pylist(), np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), float), vectors.value_lengths().to_numpy(zero_copy_only=False)))

        def run(batches, held=held):
            names, flat, sizes = held.value
            parts = np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []
            for batch in batches:
                for row in batch.to_pylist():
                    graph = Graph.unpacked(np.frombuffer(row["data"], float).reshape(-1, row["width"]), metric, row["entry"], row["layers"], row["degrees"], row["targets"])
                    out = [(q, row["ids"][i], d) for q, v in zip(names, parts, strict=True) if len(v) == row["width"] for d, i in graph.search(v, k, beam)]
                    if out:
                        q, i, d = zip(*out, strict=True)
                        yield pa.record_batch([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.float64())], names=["query_id", "id", "distance"])

        own = index.mapInArrow(run, "query_id long, id long, distance double")
        found = own if found is None else found.unionByName(own)
    return S.merge_shards(found, k, "id", metric=metric, keys=["query_id"]).withColumnRenamed("id", id)


def graph_search(df: DataFrame, queries: DataFrame, k: int, metric: Metric | str = Metric.COSINE, ef: int | None = None, id: str = "vec_id", **parameters) -> DataFrame:
    """search_graphs over an index that is built for this search alone; more than a block of queries find it built once, on the executors' disks."""
    index, blocks = build_graphs(df, metric, id=id, **parameters), _blocks(queries)
    return _searched(index.persist(StorageLevel.DISK_ONLY) if len(blocks) > 1 else index, blocks, k, Metric.of(metric), ef, id)


def graph_stats(edges: DataFrame) -> DataFrame:
    """Nodes, edges, highest layer and mean degree in the base layer."""
    base = F.col("layer") == 0
    return edges.agg(F.count_distinct("src").alias("nodes"), F.count("*").alias("edges"), F.max("layer").alias("max_layer"), F.try_divide(F.count_if(base), F.count_distinct(F.when(base, F.col("src")))).alias("avg_degree"))
