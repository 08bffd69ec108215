"""Operation logs, snapshots, segments and their compaction.

A log is a frame (lsn, op, id, ...payload): ops insert, update, delete and clear; batches are a row per id. Replay needs one
maximum for the last clear and one maximum of the last operation per id, both pre-aggregated.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.contract import EngineError
from halyard.operators.collection import invalid_rows, last_writes

PUTS, DELETES, CLEARS = ("insert", "update", "batch_insert"), ("delete", "batch_delete"), ("clear",)


def checksum(*columns: str) -> Column:
    """CRC-32 of the row's values as JSON."""
    return F.crc32(F.to_json(F.struct(*columns)).cast("binary"))


def append(log: DataFrame, entries: DataFrame, order: str) -> DataFrame:
    """log with entries numbered after its last lsn in the order given, each with its checksum.

    Numbers are dealt out per partition of a range sort: lsn grows with the order, gaps are possible.
    """
    last = log.agg(F.coalesce(F.max("lsn"), F.lit(0)).alias("m")).first()["m"]
    payload = [c for c in entries.columns if c != order]
    numbered = entries.orderBy(order).withColumn("lsn", F.monotonically_increasing_id() + last + 1)
    return log.unionByName(numbered.select("lsn", *payload, checksum("lsn", *payload).alias("crc")), allowMissingColumns=True)


def corrupt(log: DataFrame) -> DataFrame:
    """Entries whose checksum is wrong."""
    payload = [c for c in log.columns if c not in ("lsn", "crc")]
    return log.where(~F.col("crc").eqNullSafe(checksum("lsn", *payload)))


def since(log: DataFrame, lsn: int) -> DataFrame:
    """The suffix from an lsn on: replay after a checkpoint, or what compaction keeps."""
    return log.where(F.col("lsn") >= lsn)


def replay(log: DataFrame, start: int = 0, id: str = "id", op: str = "op", lsn: str = "lsn") -> DataFrame:
    """The state after all operations from an lsn on: the last put of each id that no delete or clear follows."""
    known = [*PUTS, *DELETES, *CLEARS]
    after = log.where(F.col(lsn) >= start)
    odd = after.where(~F.col(op).isin(known)).limit(1).collect()
    if odd:
        raise EngineError(f"unknown operation {odd[0][op]!r}")
    cleared = after.agg(F.coalesce(F.max(F.when(F.col(op).isin(*CLEARS), F.col(lsn))), F.lit(start - 1)).alias("m")).first()["m"]
    last = last_writes(after.where((F.col(lsn) > cleared) & ~F.col(op).isin(*CLEARS)), id, lsn)
    return last.where(F.col(op).isin(*PUTS)).drop(op)


def recover(snapshot: DataFrame, log: DataFrame, snapshot_lsn: int, id: str = "id") -> DataFrame:
    """A snapshot and the operations after it: id and the snapshot's columns."""
    payload = snapshot.columns
    base = snapshot.withColumns({"lsn": F.lit(snapshot_lsn).cast("long"), "op": F.lit("insert")})
    suffix = log.where(F.col("lsn") > snapshot_lsn)
    return replay(base.unionByName(suffix.select(*base.columns)), snapshot_lsn, id).select(*payload)


def _digest(df: DataFrame) -> dict[str, str]:
    """Rows and a checksum of them all that does not depend on their order."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return {k: str(v) for k, v in df.agg(F.count("*").alias("rows"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).alias("sum")).first().asDict().items()}


def write_snapshot(df: DataFrame, path: str, name: str, keep: int = 3, lsn: int | None = None) -> None:
    """A Parquet folder with the checksum of its rows and the last lsn in it, beside the earlier ones, of which the newest `keep` stay; names sort by age."""
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(f"{path}/{name}")
    written = spark.read.parquet(f"{path}/{name}")
    write_json(spark, f"{path}/{name}/_checksum.json", {"digest": _digest(written), "lsn": lsn})
    for old in list_snapshots(spark, path)[keep:]:
        delete_snapshot(spark, path, old)


def snapshot_lsn(spark: SparkSession, path: str, name: str) -> int | None:
    """The last lsn in a snapshot, None if it was written without one."""
    return _stored(spark, path, name).get("lsn")


def _stored(spark: SparkSession, path: str, name: str) -> dict:
    stored = read_json(spark, f"{path}/{name}/_checksum.json")
    return {"digest": None} if stored is None else stored


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    p, fs = _folder(spark, path)
    stream = fs.create(p, True)
    stream.write(bytearray(json.dumps(value).encode()))
    stream.close()


def read_json(spark: SparkSession, path: str) -> dict | None:
    """What write_json stored; empty if there is no such file, None if its writing broke off."""
    p, fs = _folder(spark, path)
    if not fs.exists(p):
        return {}
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except ValueError:
        return None
    finally:
        stream.close()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    p, fs = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_snapshots(spark: SparkSession, path: str) -> list[str]:
    """Names of complete snapshots, newest first."""
    p, fs = _folder(spark, path)
    if not fs.exists(p):
        return []
    jvm = spark.sparkContext._jvm
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(names, reverse=True)


def restore_snapshot(spark: SparkSession, path: str, name: str | None = None, verify: bool = False) -> DataFrame:
    """The rows of a snapshot, the newest by default; verify compares them with their checksum, where there is one."""
    names = list_snapshots(spark, path)
    if not names or (name is not None and name not in names):
        raise EngineError("no such snapshot")
    out = spark.read.parquet(f"{path}/{name or names[0]}")
    if verify:
        stored = _stored(spark, path, name or names[0])
        if "digest" in stored and stored["digest"] != _digest(out):
            raise EngineError(f"snapshot {name or names[0]} does not match its checksum")
    return out


def recover_from(spark: SparkSession, path: str, log: DataFrame, id: str = "id", skip_corrupt: bool = False) -> DataFrame:
    """The state after a crash: the newest snapshot that matches its checksum, and the log after it.

    A damaged snapshot gives way to the one before; without any, the whole log is replayed. Entries with a wrong checksum (column
    crc, if there is one) are an error, or left out with skip_corrupt.
    """
    if "crc" in log.columns:
        bad = corrupt(log)
        if not skip_corrupt and not bad.isEmpty():
            raise EngineError("the log has damaged entries")
        payload = [c for c in log.columns if c not in ("lsn", "crc")]
        log = log.where(F.col("crc").eqNullSafe(checksum("lsn", *payload))).drop("crc")
    for name in list_snapshots(spark, path):
        lsn = snapshot_lsn(spark, path, name)
        try:
            snapshot = restore_snapshot(spark, path, name, verify=True)
        except EngineError:
            continue
        if lsn is not None:
            return recover(snapshot, log, lsn, id)
    return replay(log, id=id).drop("lsn")


def checkpoint(log: DataFrame, state: DataFrame, lsn: int, snapshots: str, logs: str, keep: int = 3) -> DataFrame:
    """Store the state up to an lsn as a snapshot and what follows in the log as its next version; the stored suffix.

    The snapshot comes first, so a crash in between leaves a log that repeats operations of the snapshot, which replay ignores.
    """
    spark = log.sparkSession
    name = f"s{lsn:020d}"
    if name not in list_snapshots(spark, snapshots):
        write_snapshot(state, snapshots, name, keep, lsn)
    if name not in list_snapshots(spark, logs):
        write_snapshot(since(log, lsn + 1), logs, name, keep)
    return restore_snapshot(spark, logs, name)


def delete_snapshot(spark: SparkSession, path: str, name: str) -> None:
    p, fs = _folder(spark, f"{path}/{name}")
    fs.delete(p, True)


def merge_segments(segments: list[DataFrame], id: str = "id") -> DataFrame:
    """One segment from several, the later ones over the earlier."""
    whole = None
    for i, s in enumerate(segments):
        s = s.withColumn("_seq", F.lit(i))
        whole = s if whole is None else whole.unionByName(s)
    return last_writes(whole, id, "_seq").drop("_seq")


def merge_by_segment(rows: DataFrame, id: str, segment: str, tombstone: Column | None = None) -> DataFrame:
    """The newest version of each id over all segments; a newest version that is a tombstone deletes it."""
    out = last_writes(rows.withColumn("_gone", tombstone if tombstone is not None else F.lit(False)), id, segment)
    return out.where(~F.col("_gone")).drop("_gone")


def compact(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Rewrite as files of about rows_per_file rows."""
    files = max(1, -(-df.count() // rows_per_file))
    df.repartition(files).write.option("maxRecordsPerFile", rows_per_file).parquet(path)


def valid_segment(df: DataFrame, id: str, vector: str, dimension: int | None = None) -> DataFrame:
    """Rows, ids and faulty rows of a segment, and whether it is valid."""
    bad = invalid_rows(df, id, vector, dimension)
    return df.agg(F.count("*").alias("rows"), F.count_distinct(id).alias("ids"), F.count_if(bad).alias("faulty")).withColumn("valid", (F.col("faulty") == 0) & (F.col("rows") == F.col("ids")))


def repaired(df: DataFrame, id: str, vector: str, dimension: int | None = None) -> DataFrame:
    return df.where(~invalid_rows(df, id, vector, dimension))
