"""Streams of records (id, vector, metadata..., timestamp, priority).

Transforms are frame-to-frame functions, so they chain and work on batches and streams alike. Back-pressure is the source's rate
limit; nothing is dropped. The upsert sink keeps its table in buckets by a hash of the id: a micro-batch writes the buckets that it
touches anew, beside the others, and then a manifest of which version of each bucket counts. The newest manifest that can be read
counts, so a batch that is run again after a failure gives the same table, and readers never see half a batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from halyard.contract import EngineError
from halyard.functions import vectors as V
from halyard.functions.predicates import Filter, where
from halyard.operators import oplog
from halyard.operators import search as S
from halyard.operators.collection import delete, last_writes, upsert
from halyard.operators.quantize import signed_encode

Transform = Callable[[DataFrame], DataFrame]


def chain(*steps: Transform) -> Transform:
    """Each step gets what the one before made."""
    return lambda df: reduce(lambda d, step: step(d), steps, df)


def normalized(vector: str = "vector") -> Transform:
    return lambda df: df.withColumn(vector, V.normalize(vector))


def quantized(vector: str = "vector", to: str = "codes") -> Transform:
    return lambda df: df.withColumn(to, signed_encode(vector))


def indexed(id: str = "id", vector: str = "vector", timestamp: str = "timestamp", metadata: Sequence[str] = ()) -> Transform:
    """The entry of an index: id, dimension, timestamp and metadata."""
    return lambda df: df.select(id, F.size(vector).alias("dimension"), timestamp, *metadata)


def filtered(f: Filter) -> Transform:
    return lambda df: where(df, f)


def prioritized(df: DataFrame, priority: str = "priority", seq: str = "seq") -> DataFrame:
    """A batch by falling priority, first come first served among equals."""
    return df.orderBy(F.desc(priority), seq)


def read_files(spark: SparkSession, path: str, schema, files_per_trigger: int = 16, format: str = "parquet", glob: str | None = None) -> DataFrame:
    """A stream of the files of a folder (those named like glob), so many a micro-batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(format)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def _manifests(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the stored manifests of an upserted table, newest first."""
    return sorted((int(n[1:-5]) for n in oplog.children(spark, f"{path}/_manifest") if n.startswith("v") and n.endswith(".json")), reverse=True)


def _manifest(spark: SparkSession, path: str, number: int) -> dict | None:
    return oplog.read_json(spark, f"{path}/_manifest/v{number:012d}.json") or None


def _newest(spark: SparkSession, path: str) -> dict | None:
    return next((m for m in (_manifest(spark, path, n) for n in _manifests(spark, path)) if m), None)


def _read_buckets(spark: SparkSession, path: str, manifest: dict, buckets: Iterable[str]) -> DataFrame:
    schema = StructType.fromJson(manifest["schema"])
    folders = [f"{path}/v{manifest['held'][b]:012d}/_bucket={b}" for b in buckets if b in manifest["held"]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of an upserted table."""
    manifest = _newest(spark, path)
    if manifest is None:
        raise EngineError("no such table")
    return _read_buckets(spark, path, manifest, manifest["held"])


def _forget(spark: SparkSession, path: str, keep: int) -> None:
    """Delete all manifests but the newest, and the buckets that only they name."""
    numbers = _manifests(spark, path)
    kept = {tuple(x) for n in numbers[:keep] for x in (_manifest(spark, path, n) or {"held": {}})["held"].items()}
    for number in numbers[keep:]:
        for b, version in (_manifest(spark, path, number) or {"held": {}})["held"].items():
            if (b, version) not in kept:
                oplog.delete_snapshot(spark, path, f"v{version:012d}/_bucket={b}")
                if version not in {v for _, v in kept} and not any(n.startswith("_bucket=") for n in oplog.children(spark, f"{path}/v{version:012d}")):
                    oplog.delete_snapshot(spark, path, f"v{version:012d}")
        oplog.delete_snapshot(spark, path, f"_manifest/v{number:012d}.json")


def upsert_stream(
    stream: DataFrame, path: str, checkpoint: str, id: str = "id", seq: str = "seq", deleted: Column | None = None, keep: int = 3, available_now: bool = True, interval: str = "10 seconds", buckets: int = 64,
) -> StreamingQuery:
    """Write a stream as upserts (and deletes, where `deleted` holds) into the table at path.

    The number of buckets is fixed by the first batch: choose it so that a bucket is a few files. A batch costs the buckets that it
    touches, which for a batch of few ids is a small part of the table.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _newest(spark, path)
        if before and before["number"] >= number:
            return  # this batch was applied before
        count = before["buckets"] if before else buckets
        bucket = F.pmod(F.xxhash64(id), F.lit(count)).cast("int")
        # Kept, since it is read for the buckets touched, for what stays and for what goes.
        latest = last_writes(batch.withColumn("_gone", deleted if deleted is not None else F.lit(False)), id, seq).persist()
        touched = {str(r[0]) for r in latest.select(bucket).distinct().collect()}  # at most `count`
        new = latest.where(~F.col("_gone")).drop("_gone")
        whole = new
        if before:
            whole = upsert(delete(_read_buckets(spark, path, before, sorted(touched)), latest.where("_gone"), id), new, id)
        name = f"v{number:012d}"
        oplog.delete_snapshot(spark, path, name)  # what an attempt that broke off left
        whole.withColumn("_bucket", bucket).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{path}/{name}")
        latest.unpersist()
        held = {b: v for b, v in before["held"].items() if b not in touched} if before else {}
        held |= {n.partition("=")[2]: number for n in oplog.children(spark, f"{path}/{name}") if n.startswith("_bucket=")}
        schema = before["schema"] if before else json.loads(new.schema.json())
        oplog.write_json(spark, f"{path}/_manifest/{name}.json", {"number": number, "buckets": count, "schema": schema, "held": held})
        _forget(spark, path, keep)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to Parquet files, each row once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_stats(df: DataFrame, timestamp: str, value: str, keys: Sequence[str] = (), width: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Count, mean and largest value per event-time window (an extension); with late, older windows are closed."""
    if late is not None:
        df = df.withWatermark(timestamp, late)
    return df.groupBy(F.window(timestamp, width, slide), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("avg_value"), F.max(value).alias("max_value")).select(
        F.col("window.start").alias("window_start"), *keys, "n", "avg_value", "max_value"
    )


def progress(query: StreamingQuery) -> dict[str, float]:
    """Batches and rows so far, mean and largest batch latency in ms, rows per second, and errors with their share of the batches begun."""
    done = [p for p in query.recentProgress if "addBatch" in p["durationMs"]]
    took = [p["durationMs"]["triggerExecution"] for p in done]
    rows, errors = sum(p["numInputRows"] for p in done), int(query.exception() is not None)
    return {
        "batches": len(done), "rows": rows, "avg_latency_ms": sum(took) / len(took) if took else 0.0, "max_latency_ms": max(took, default=0), "rows_per_second": 1000 * rows / sum(took) if sum(took) else 0.0,
        "errors": errors, "error_rate": errors / (len(done) + errors) if done or errors else 0.0,
    }


def apply_operations(base: DataFrame, operations: DataFrame, id: str = "id", op: str = "op", seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """The table after a batch of insert, update and delete operations in order of seq, and a report of operations by outcome.

    Operations of another kind or without an id fail and change nothing.
    """
    good = F.col(op).isin("insert", "update", "delete") & F.col(id).isNotNull()
    last = last_writes(operations.where(good), id, seq)
    gone = last.where(F.col(op) == "delete")
    out = upsert(delete(base, gone, id), last.where(F.col(op) != "delete"), id)
    report = operations.groupBy(op).agg(F.count("*").alias("total"), F.count_if(good).alias("succeeded"), F.count_if(~good | good.isNull()).alias("failed"))
    return out, report


def run_operations(
    base: DataFrame, operations: DataFrame, stop_on_error: bool = False, k: int = 10, metric: str = "cosine", id: str = "id", vector: str = "vector", op: str = "op", seq: str = "seq",
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """A batch of insert, update, delete and search operations in order of seq: the table, a result for each operation, the hits of the searches.

    An operation fails if its kind is unknown, it has no id (a search: no vector), or its vector has another dimension than the
    table's first. With stop_on_error those from the first failure on are skipped. Searches see the table after the batch; their
    query_id is seq. Hits are None if there can be none (no vector column).
    """
    searches = F.col(op) == "search"
    writes = F.col(op).isin("insert", "update", "delete")
    error = F.when(~F.coalesce(writes | searches, F.lit(False)), F.lit("unknown operation")).when(~searches & F.col(id).isNull(), F.lit("no id"))
    if vector in operations.columns:
        first = base.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
        error = error.when((F.col(op) != "delete") & F.col(vector).isNull(), F.lit("no vector"))
        if first is not None:
            error = error.when((F.col(op) != "delete") & (F.size(vector) != first[0]), F.lit("dimension"))
    else:
        error = error.when(searches, F.lit("no vector"))
    marked = operations.withColumn("error", error)
    if stop_on_error:
        at = marked.where("error IS NOT NULL").agg(F.min(seq)).first()[0]
        if at is not None:
            marked = marked.withColumn("error", F.when(F.col(seq) > at, F.lit("skipped")).otherwise(F.col("error")))
    good = marked.where("error IS NULL").drop("error")
    table, _ = apply_operations(base, good.where(writes), id, op, seq)
    hits = None
    if vector in operations.columns:
        hits = S.batch_top_k(table, good.where(searches).select(F.col(seq).alias("query_id"), F.col(vector).alias("query")), k, metric, id=id, vector=vector)
    return table, marked.select(seq, op, id, F.col("error").isNull().alias("ok"), "error"), hits
