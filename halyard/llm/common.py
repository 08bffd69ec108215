"""What the operators of this subpackage share: session setup, written tables, Arrow batch helpers, connected components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

#: Bounds of one Arrow batch: texts and packed rows may be long, so batches are kept small to bound a worker's memory.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and bound their batches.

    Frames run after the call that made them, so these settings of the session stay: the path of the workers and the two of BATCH.
    """
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    for name, value in BATCH.items():
        if spark.conf.get(name) != value:
            spark.conf.set(name, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="halyard-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/halyard/{spark.sparkContext.applicationId}"


_SCOPES: list[str] = []


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing is at yet."""
    return "/".join([shared_folder(spark), *_SCOPES, uuid.uuid4().hex])


def written(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors, keeps column pruning and size statistics."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder by Hadoop's file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete what written() made for df, once nothing that is still to run reads it."""
    delete(df.sparkSession, df._written)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What written() makes within is deleted at the end: run and write what is built on it before."""
    _SCOPES.append(uuid.uuid4().hex)
    path = "/".join([shared_folder(spark), *_SCOPES])
    try:
        yield
    finally:
        _SCOPES.pop()
        delete(spark, path)


def drop_written(spark: SparkSession) -> None:
    """Delete all that written() made in this application; frames built on it end with it."""
    delete(spark, shared_folder(spark))


def spread(df: DataFrame, bytes_each: int = 8 << 20) -> DataFrame:
    """df over as many partitions as there are cores, where it is so small that a scan would leave cores idle: for heavy work per row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < cores * bytes_each
    return df.repartition(cores) if small else df


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def by_batch(function: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that treats each batch by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None:
                yield out

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame, source: str, target: str, max_rounds: int = 60) -> DataFrame:
    """Smallest node of the component of every node that has an edge: columns node, label.

    Large-star and small-star rounds in turn (each is a minimum per node, pre-aggregated, joined back to the edges), so a
    component of diameter d needs about log(d) rounds. A hub's edges are pre-aggregated and met in joins that can be split, so no
    component needs to fit in one task. The state of each round is a written table, freed after the next. Loops and nulls are ignored; no edges give no rows.
    """
    state = written(
        edges.where(F.col(source).isNotNull() & F.col(target).isNotNull() & (F.col(source) != F.col(target)))
        .select(F.greatest(source, target).alias("u"), F.least(source, target).alias("v"))
        .distinct()
    )
    mark = _mark(state)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Each minimum is written, so that its join has shuffles of its own and adaptive execution can split a hub's edges.
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large)
        least2 = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least2, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        held, state = (state, least, large, least2), written(small.select("e.u", "e.v").where("u != v").distinct())
        for used in held:
            discard(used)
        before, mark = mark, _mark(state)
        if before == mark:
            break
    else:
        raise RuntimeError("connected components did not settle")
    own = state.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    return own.union(own.select(F.col("label").alias("node"), "label").distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(row)
