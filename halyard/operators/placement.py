"""Data placement: consistent hashing, hash ranges, load and movement, shard hits."""

from __future__ import annotations

import bisect
import hashlib
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from halyard.contract import InvalidConfig

#: How each kind of ring names its virtual nodes, and the size of its hash space.
KINDS = {"crc32": ("{node}#{i}", 1 << 32), "sha256": ("{node}-{i}", 1 << 64)}


@dataclass(frozen=True)
class Ring:
    """Nodes on a ring of hashes: crc32 of 'node#i', or the first 8 bytes of SHA-256 of 'node-i'."""

    nodes: tuple[str, ...]
    virtual: int = 160
    kind: str = "sha256"

    def __post_init__(self) -> None:
        if self.kind not in KINDS or self.virtual <= 0:
            raise InvalidConfig("unknown ring or no virtual nodes")

    def hash(self, key: str) -> int:
        data = key.encode()
        return zlib.crc32(data) if self.kind == "crc32" else int.from_bytes(hashlib.sha256(data).digest()[:8], "big")

    @cached_property
    def points(self) -> list[tuple[int, str]]:
        name = KINDS[self.kind][0]
        return sorted({self.hash(name.format(node=n, i=i)): n for n in dict.fromkeys(self.nodes) for i in range(self.virtual)}.items())

    def successors(self, at: int, n: int) -> list[str]:
        """The first n different nodes from a point on."""
        out: list[str] = []
        for i in range(len(self.points)):
            node = self.points[(at + i) % len(self.points)][1]
            if node not in out:
                out.append(node)
                if len(out) == n:
                    break
        return out

    def owners(self, key: str, n: int = 1) -> list[str]:
        if not self.points:
            return []
        return self.successors(bisect.bisect_left(self.points, (self.hash(key), "")) % len(self.points), n)

    def with_node(self, node: str) -> Ring:
        return Ring((*self.nodes, node), self.virtual, self.kind)

    def without(self, node: str) -> Ring:
        return Ring(tuple(n for n in self.nodes if n != node), self.virtual, self.kind)

    def ranges(self) -> list[tuple[str, int, int]]:
        """(node, after, to): the node owns hashes in (after, to], around the end where after >= to."""
        return [(node, self.points[i - 1][0], h) for i, (h, node) in enumerate(self.points)]

    def place(self, df: DataFrame, key: str, replicas: int = 1) -> DataFrame:
        """df with key_hash (of 64 bits, as a decimal) and owners, its nodes in order."""
        space = np.array([h for h, _ in self.points], np.uint64)
        lists = [self.successors(i, replicas) for i in range(len(self.points))]
        text = F.col(key).cast("string")
        raw = F.crc32(text.cast("binary")) if self.kind == "crc32" else F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 16))
        source = df.withColumn("_raw", raw)
        small = self.kind == "crc32"

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    column = batch.column(batch.num_columns - 1)
                    h = column.to_numpy(zero_copy_only=False).astype(np.uint64) if small else np.array([int.from_bytes(x, "big") if x else 0 for x in column.to_pylist()], np.uint64)
                    at = np.searchsorted(space, h) % max(len(space), 1)
                    yield pa.record_batch([*batch.columns[:-1], pa.array([lists[i] if lists else [] for i in at], pa.list_(pa.string()))], names=[*batch.schema.names[:-1], "owners"])

        schema = StructType([*df.schema.fields, *StructType.fromDDL("owners array<string>").fields])
        return source.where(F.col("_raw").isNotNull()).mapInArrow(run, schema)


def sha256_hash(key: str | Column) -> Column:
    """The first 8 bytes of SHA-256 as an unsigned number."""
    c = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.sha2(c.cast("string").cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def in_range(h: Column, start: Column | int, end: Column | int) -> Column:
    """start <= h <= end, around the end of the space where start > end."""
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    return F.when(start <= end, (h >= start) & (h <= end)).otherwise((h >= start) | (h <= end))


def range_size(start: int, end: int, space: int = 1 << 64) -> int:
    """Hashes in a range, both ends included, around the end where start > end."""
    return end - start + 1 if start <= end else space - start + end + 1


def shard_ranges(shards: int, space: int = 1 << 64) -> list[tuple[int, int, int]]:
    """(shard, start, end): disjoint ranges that cover the space."""
    return [(i, i * space // shards, (i + 1) * space // shards - 1) for i in range(shards)]


def load(placed: DataFrame) -> DataFrame:
    """Keys and their share by first owner."""
    counts = placed.groupBy(F.col("owners")[0].alias("node")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("node", "n", (F.col("n") / F.col("total")).alias("share"))  # one row


def balanced(loads: DataFrame, nodes: int, tolerance: float) -> DataFrame:
    """Whether each node's share lies within the tolerance of an equal one."""
    off = F.abs(F.col("share") - 1 / nodes)
    return loads.select("node", "n", "share", off.alias("deviation"), (off <= tolerance).alias("balanced"))


def moves(df: DataFrame, key: str, before: Ring, after: Ring) -> DataFrame:
    """Keys whose first owner changes from one ring to the other."""
    was = before.place(df.select(key), key).select(key, F.col("owners")[0].alias("source"))
    both = after.place(was, key).select(key, "source", F.col("owners")[0].alias("target"))
    return both.where(F.col("source") != F.col("target"))


def cluster_health(nodes: DataFrame, state: str = "state") -> DataFrame:
    """Nodes by state, and a status: critical below half of them active, degraded below all."""
    active = F.count_if(F.col(state) == "active")
    return nodes.agg(F.count("*").alias("nodes"), active.alias("active"), F.count_if(F.col(state) == "failed").alias("failed")).withColumn(
        "status", F.when(F.col("active") * 2 < F.col("nodes"), "critical").when(F.col("active") < F.col("nodes"), "degraded").otherwise("healthy")
    )


def shard_of(key: str | Column, shards: int) -> Column:
    """Number of the range of shard_ranges that the key's hash lies in (by its upper half: exact for up to 2**20 shards that divide 2**32)."""
    top = F.conv(F.substring(F.sha2((F.col(key) if isinstance(key, str) else key).cast("string").cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(top * shards / (1 << 32)).cast("int")


def replicate(df: DataFrame, ring: Ring, key: str, factor: int = 3) -> DataFrame:
    """A row per copy: the node and its place among the owners."""
    return ring.place(df, key, factor).select("*", F.posexplode("owners").alias("replica", "node")).drop("owners")


