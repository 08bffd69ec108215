"""Collections: a DataFrame of records and a configuration, with the verbs of a record store.

Every verb gives a new collection or a plan; nothing is changed in place. Writes are last writer wins by a pre-aggregated maximum,
deletes anti joins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.contract import AlreadyExists, CapacityExceeded, Closed, CollectionConfig, InvalidConfig, NotFound, SearchRequest, checked_page
from halyard.functions import vectors as V
from halyard.functions.predicates import Filter, where
from halyard.operators import search as S
from halyard.operators.ann import InvertedLists
from halyard.operators.graph import search_graphs
from halyard.plans.planner import choose_strategy


def page(df: DataFrame, id: str, limit: int = 0, offset: int = 0) -> DataFrame:
    """Rows in order of id from offset on; limit 0 means all."""
    checked_page(limit, offset)
    out = df.orderBy(id)
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit else out


def scan_range(df: DataFrame, id: str, start=None, end=None) -> DataFrame:
    """Rows with start <= id <= end in order; a bound that is None or empty is open."""
    if start not in (None, ""):
        df = df.where(F.col(id) >= start)
    if end not in (None, ""):
        df = df.where(F.col(id) <= end)
    return df.orderBy(id)


def get_batch(df: DataFrame, id: str, ids: Sequence) -> DataFrame:
    """Rows of the ids in the order asked, with that position; missing ones are left out."""
    spark, kind = df.sparkSession, df.schema[id].dataType.simpleString()
    asked = spark.createDataFrame([(i, p) for p, i in enumerate(ids)], f"`{id}` {kind}, position int")
    return df.where(F.col(id).isin(list(ids))).join(asked, id).orderBy("position") if len(ids) <= 1000 else df.join(asked, id).orderBy("position")


def contains_batch(df: DataFrame, id: str, asked: DataFrame) -> DataFrame:
    """asked with a column present."""
    there = df.select(id).distinct().withColumn("present", F.lit(True))
    return asked.join(there, id, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def last_writes(changes: DataFrame, id: str, seq: str) -> DataFrame:
    """The row of each id with the largest seq."""
    rest = [c for c in changes.columns if c != id]
    return changes.groupBy(id).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(id, *[F.col(f"r.{c}").alias(c) for c in rest])


def upsert(base: DataFrame, changes: DataFrame, id: str, seq: str | None = None) -> DataFrame:
    """base with the changes over it; among changes of one id the largest seq wins."""
    new = last_writes(changes, id, seq).drop(seq) if seq else changes
    return base.join(new.select(id), id, "left_anti").unionByName(new.select(*base.columns))


def delete(base: DataFrame, ids: DataFrame, id: str) -> DataFrame:
    return base.join(ids.select(id), id, "left_anti")


def invalid_rows(df: DataFrame, id: str, vector: str, dimension: int | None = None):
    """Rows that break the rules of a segment: no id, or no vector (of the dimension)."""
    bad = F.col(id).isNull() | F.col(vector).isNull() | (F.size(vector) == 0)
    if dimension is not None:
        bad = bad | (F.size(vector) != dimension)
    return F.coalesce(bad, F.lit(True))


class Collection:
    """Records and a configuration; with indexes (see indexed()) searches are routed to them."""

    def __init__(self, config: CollectionConfig, df: DataFrame):
        self.config, self.df = config, df
        self._open = True
        self._rows: int | None = None
        self._cells: tuple[InvertedLists, DataFrame, int] | None = None
        self._graphs: DataFrame | None = None
        for c in (config.id_column, config.vector_column):
            if c not in df.columns:
                raise InvalidConfig(f"no column {c}")

    @classmethod
    def empty(cls, spark: SparkSession, config: CollectionConfig, metadata: str = "") -> Collection:
        return cls(config, spark.createDataFrame([], f"{config.id_column} string, {config.vector_column} array<float>" + (f", {metadata}" if metadata else "")))

    def _use(self) -> tuple[DataFrame, str, str]:
        if not self._open:
            raise Closed(self.config.name)
        return self.df, self.config.id_column, self.config.vector_column

    def _with(self, df: DataFrame) -> Collection:
        return Collection(self.config, df)

    def close(self) -> None:
        self._open = False

    @property
    def metadata(self) -> list[tuple[str, str]]:
        df, id, vector = self._use()
        return [(n, t) for n, t in df.dtypes if n not in (id, vector)]

    def _checked(self, rows: DataFrame) -> DataFrame:
        """Rows whose vectors have the dimension; running the query fails otherwise."""
        _, _, vector = self._use()
        return rows.withColumn(vector, V.checked(F.col(vector), self.config.dimension))

    def _bounded(self, out: Collection) -> Collection:
        c = self.config
        if c.max_vectors is not None and out.df.count() > c.max_vectors:
            raise CapacityExceeded(f"more than {c.max_vectors} vectors")
        if c.max_bytes is not None and (out.stats().first()["size_bytes"] or 0) > c.max_bytes:
            raise CapacityExceeded(f"more than {c.max_bytes} bytes")
        return out

    def put(self, rows: DataFrame) -> Collection:
        """Insert; an id that is there already, or twice among the rows, is an error."""
        df, id, _ = self._use()
        if not rows.join(df.select(id), id, "left_semi").isEmpty() or not rows.groupBy(id).count().where("count > 1").isEmpty():
            raise AlreadyExists("an id exists already")
        return self._bounded(self._with(df.unionByName(self._checked(rows).select(*df.columns))))

    def put_batch(self, rows: DataFrame) -> Collection:
        """Insert or overwrite; an id twice in the batch is an error."""
        df, id, _ = self._use()
        if not rows.groupBy(id).count().where("count > 1").isEmpty():
            raise AlreadyExists("an id occurs twice in the batch")
        return self._bounded(self._with(upsert(df, self._checked(rows), id)))

    def update(self, rows: DataFrame, seq: str | None = None) -> Collection:
        df, id, _ = self._use()
        return self._bounded(self._with(upsert(df, self._checked(rows), id, seq)))

    def delete(self, *ids) -> Collection:
        """An id that is missing is an error."""
        df, id, _ = self._use()
        wanted = set(ids)
        if df.where(F.col(id).isin(list(wanted))).select(id).distinct().count() < len(wanted):
            raise NotFound("an id is missing")
        return self._with(df.where(~F.col(id).isin(list(wanted))))

    def delete_batch(self, ids: DataFrame) -> Collection:
        """Missing ids are ignored."""
        df, id, _ = self._use()
        return self._with(delete(df, ids, id))

    def clear(self) -> Collection:
        return self._with(self._use()[0].limit(0))

    def get(self, id_value) -> DataFrame:
        df, id, _ = self._use()
        out = df.where(F.col(id) == id_value)
        if out.isEmpty():
            raise NotFound(str(id_value))
        return out

    def get_batch(self, ids: Sequence) -> DataFrame:
        df, id, _ = self._use()
        return get_batch(df, id, ids).drop("position")

    def contains(self, id_value) -> bool:
        df, id, _ = self._use()
        return not df.where(F.col(id) == id_value).isEmpty()

    def count(self) -> int:
        return self._use()[0].count()

    def keys(self) -> DataFrame:
        df, id, _ = self._use()
        return df.select(id).orderBy(id)

    def list(self, limit: int = 0, offset: int = 0) -> DataFrame:
        df, id, _ = self._use()
        return page(df, id, limit, offset)

    def scan(self, callback: Callable | None = None):
        """Rows in order of id, or each of them given to callback until it returns False."""
        df, id, _ = self._use()
        if callback is None:
            return df.orderBy(id)
        for row in df.orderBy(id).toLocalIterator():
            if callback(row) is False:
                break
        return None

    def scan_range(self, start=None, end=None) -> DataFrame:
        df, id, _ = self._use()
        return scan_range(df, id, start, end)

    def filter(self, f: Filter, limit: int = 0) -> DataFrame:
        df, id, _ = self._use()
        return page(where(df, f), id, limit) if limit else where(df, f)

    def filter_keys(self, f: Filter) -> DataFrame:
        df, id, _ = self._use()
        return where(df, f).select(id).orderBy(id)

    def indexed(self, rows: int, cells: InvertedLists | None = None, lists: DataFrame | None = None, probes: int = 8, graphs: DataFrame | None = None) -> Collection:
        """The collection with stored indexes of just its records: inverted lists, graphs or both. Writes give collections without them."""
        self._use()
        out = self._with(self.df)
        out._rows, out._graphs = rows, graphs
        out._cells = (cells, lists, probes) if cells is not None and lists is not None else None
        return out

    def strategy(self, request: SearchRequest, exact: bool = False, selectivity: float = 1.0) -> str:
        """flat, cells or graph, of the indexes that there are."""
        if self._rows is None:
            return "flat"
        wanted = choose_strategy(self.config.dimension, request.k, self._rows, selectivity, exact)
        if wanted == "graph" and (self._graphs is None or request.filter is not None):  # a filter must hold before the k best are chosen
            wanted = "cells"
        if wanted == "cells" and self._cells is None:
            wanted = "graph" if self._graphs is not None and request.filter is None else "flat"
        return wanted

    def search(self, request: SearchRequest, exact: bool = False, selectivity: float = 1.0) -> DataFrame:
        """By an index where there is one and the request is for it, else by a scan; exact asks for the scan."""
        df, id, vector = self._use()
        SearchRequest(request.vector, request.k, request.filter, request.max_distance, request.min_score, dimension=self.config.dimension).validate()
        way = self.strategy(request, exact, selectivity)
        if way == "cells":
            cells, lists, probes = self._cells
            return S.search(lists.where(F.col("cell").isin(cells.cells_of(request.vector, probes))).drop("cell"), request, self.config.metric, id, vector)
        if way == "graph":
            spark = df.sparkSession
            asked = spark.createDataFrame([(0, [float(x) for x in request.vector])], "query_id long, query array<double>")
            found = search_graphs(self._graphs, asked, request.k, self.config.metric, id=id).drop("query_id")
            near = S._cut(found, request.max_distance, request.min_score)
            records = df if request.include_vector else df.drop(vector)
            out = records.join(F.broadcast(near), id).orderBy("rank")  # at most k rows
            return out if request.include_metadata else out.select(id, "distance", "score", "rank", *([vector] if request.include_vector else []))
        return S.search(df, request, self.config.metric, id, vector)

    def search_batch(self, queries: DataFrame, k: int = 10, filter: Filter | None = None) -> DataFrame:
        df, id, vector = self._use()
        return S.batch_top_k(df, queries, k, self.config.metric, filter, id=id, vector=vector)

    def stats(self) -> DataFrame:
        df, id, vector = self._use()
        size = V.record_size(id, vector, self.metadata)
        return df.agg(F.count("*").alias("count"), F.max(F.size(vector)).alias("dimension"), F.sum(size).alias("size_bytes"))

    def validate(self) -> DataFrame:
        """Rows that break the rules."""
        df, id, vector = self._use()
        return df.where(invalid_rows(df, id, vector, self.config.dimension))

    def repair(self) -> Collection:
        df, id, vector = self._use()
        return self._with(df.where(~invalid_rows(df, id, vector, self.config.dimension)))
