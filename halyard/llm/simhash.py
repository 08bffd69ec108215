"""SimHash near-duplicates by tiled exact comparison.

Fingerprints come from XXH64 of word shingles. Equal fingerprints are one row (a pre-aggregated minimum of doc_id), so copies
never meet as pairs. The distinct fingerprints are sorted by population count and then by the population counts of their four
16-bit quarters, and cut into blocks; neighbouring blocks make chunks, at most `CHUNK` blocks each. Two chunks meet only where
their population counts come within the radius (an equi-join on the count), and in one of the two by turns: a task holds a chunk
and streams the blocks of the others past it, so fingerprints are shuffled once for each chunk that they meet, not once for each
block. There numpy compares tile by tile with exclusive-or and bit counts and skips every tile pair whose population counts, in
whole or summed over the quarters, lie further apart than the radius: no linked pair can be there. Links leave a task only as
spanning forests, one for each block streamed (less than one edge a fingerprint), so a large group never emits its pairs. The
forests are joined to components by star rounds over written tables. The comparison is exact and so quadratic in the number
of distinct fingerprints, with the constant that the skipping leaves.

Cases: a text that is null or has no word has fingerprint zero and links like any other; fewer words than a shingle: the whole
sequence is the one shingle; rows of one fingerprint always link; a null doc_id gets a fingerprint and the component of that
fingerprint, but is never a component_id (null if nobody else has one); repeated rows give repeated results; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import by_batch, connected_components, free_name, prepare, spread, written

BLOCK, TILE, CHUNK = 4096, 1024, 256
LOWERED = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_EMPTY = np.zeros(0, np.uint64)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    words = text.encode("utf-8", "surrogatepass").translate(LOWERED).split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        pieces = [b" ".join(words)]
    else:
        pieces = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(p, seed) for p in pieces], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp, the 64 bits as a signed long."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)), np.uint64, batch.num_rows).view(np.int64)
        return pa.record_batch([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(by_batch(each), "doc_id long, fp long")


def quarter_counts(fps: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count((fps >> np.uint64(16 * i)) & np.uint64(0xFFFF)) for i in range(4)], axis=1).astype(np.int16)


def _order(fps: np.ndarray) -> np.ndarray:
    q = quarter_counts(fps)
    return np.lexsort((fps, q[:, 2], q[:, 1], q[:, 0], q.sum(axis=1)))


def _tiles(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and the smallest and largest population counts, whole and by quarter, of the tiles of sorted fingerprints."""
    q = quarter_counts(fps)
    counts = np.concatenate([q.sum(axis=1, keepdims=True), q], axis=1)
    starts = np.arange(0, len(fps), TILE)
    low, high = np.minimum.reduceat(counts, starts, axis=0), np.maximum.reduceat(counts, starts, axis=0)
    return starts, low[:, 0], high[:, 0], low[:, 1:], high[:, 1:]


def _settle(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the classes of i and j; labels point at the smallest member."""
    while True:
        a, b = labels[i], labels[j]
        differ = a != b
        if not differ.any():
            return labels
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = labels[labels]
            if np.array_equal(further, labels):
                break
            labels = further


def block_links(left: np.ndarray, right: np.ndarray | None, radius: int, tiles: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two sorted arrays (right None: within one): the two ends of each edge. tiles: those of left."""
    nodes = left if right is None else np.concatenate([left, right])
    base, other = (0, left) if right is None else (len(left), right)
    labels = np.arange(len(nodes))
    s, lo, hi, qlo, qhi = tiles or _tiles(left)
    t, lo2, hi2, qlo2, qhi2 = (s, lo, hi, qlo, qhi) if right is None else _tiles(right)
    near = np.maximum(lo2[None] - hi[:, None], lo[:, None] - hi2[None]) <= radius
    x, y = np.nonzero(near if right is not None else np.triu(near))
    apart = np.maximum(0, np.maximum(qlo2[y] - qhi[x], qlo[x] - qhi2[y])).sum(axis=1)
    for x, y in zip(x[apart <= radius].tolist(), y[apart <= radius].tolist(), strict=True):
        i, j = np.nonzero(np.bitwise_count(left[s[x] : s[x] + TILE, None] ^ other[None, t[y] : t[y] + TILE]) <= radius)
        if len(i):
            labels = _settle(labels, s[x] + i, base + t[y] + j)
    child = np.flatnonzero(labels != np.arange(len(nodes)))
    return nodes[child], nodes[labels[child]]


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (a, b) that connect just the distinct fingerprints (column fp) that chains of links connect."""

    def cut(batches):
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        held = _EMPTY

        def out(part: np.ndarray) -> pa.RecordBatch:
            nonlocal made
            pops = np.bitwise_count(part)
            row = [[task], [made], [int(pops.min())], [int(pops.max())], [part.tobytes()]]
            made += 1
            return pa.record_batch([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["task", "made", "low", "high", "data"])

        for batch in batches:
            held = np.concatenate([held, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)])
            while len(held) >= BLOCK:
                yield out(held[:BLOCK])
                held = held[BLOCK:]
        if len(held):
            yield out(held)

    def compare(batches):
        def edges(a, b):
            if len(a):
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        key, left, tiles, wait = None, _EMPTY, None, []

        def settled():
            nonlocal left, tiles, wait
            if wait:
                left, wait = np.concatenate(wait), []
                tiles = _tiles(left)
                yield from edges(*block_links(left, None, radius, tiles))

        for batch in batches:
            for chunk, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if chunk != key:
                    yield from settled()
                    key = chunk
                block = np.frombuffer(data.as_py(), np.uint64)
                if kind == 0:
                    wait.append(block)
                else:
                    yield from settled()
                    yield from edges(*block_links(left, block, radius, tiles))
        yield from settled()

    spark = distinct.sparkSession
    quarter = lambda i: F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long")))
    keys = [F.bit_count("fp").alias("pop"), *[quarter(i).alias(f"q{i}") for i in range(3)]]
    order = ["pop", "q0", "q1", "q2", "fp"]
    blocks = written(distinct.select("fp", *keys).repartitionByRange(*order).sortWithinPartitions(*order).select("fp").mapInArrow(cut, "task int, made int, low int, high int, data binary"))
    each = max(1, min(CHUNK, blocks.count() // (8 * spark.sparkContext.defaultParallelism)))  # a small table is spread over the cores
    blocks = blocks.withColumn("chunk", F.shiftleft(F.col("task").cast("long"), 32) + F.floor(F.col("made") / each))
    chunks = written(blocks.groupBy("chunk").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    left = chunks.select(F.col("chunk").alias("l"), F.explode(F.sequence("low", F.col("high") + radius)).alias("pop"))
    right = chunks.select(F.col("chunk").alias("r"), F.explode(F.sequence(F.col("low"), F.col("high") + radius)).alias("pop"))
    pairs = left.join(right, "pop").where("l < r").select("l", "r").distinct()
    turn = F.pmod(F.xxhash64("l", "r"), F.lit(2)) == 0
    meets = written(pairs.select(F.when(turn, F.col("l")).otherwise(F.col("r")).alias("holder"), F.when(turn, F.col("r")).otherwise(F.col("l")).alias("chunk")))
    streamed = meets.join(blocks, "chunk").select(F.col("holder").alias("chunk"), F.lit(1).alias("kind"), "task", "made", "data")
    held = blocks.select("chunk", F.lit(0).alias("kind"), "task", "made", "data")
    tasks = max(1, chunks.count())
    return held.unionByName(streamed).repartition(tasks, "chunk").sortWithinPartitions("chunk", "kind", "task", "made").select("chunk", "kind", "data").mapInArrow(compare, "a long, b long")


def near_duplicates(documents: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id that chains of links reach."""
    prepare(documents.sparkSession)
    own = written(fingerprints(documents, shingle, seed))
    distinct = written(own.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL"))
    labels = connected_components(links(distinct.select("fp"), radius), "a", "b")
    classed = distinct.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    least = classed.groupBy("label").agg(F.min("rep").alias("component_id"))
    of = classed.join(least, "label").select("fp", "component_id")
    return own.join(of, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, radius: int = 3) -> DataFrame:
    """The documents that are the smallest doc_id of their component; rows without a doc_id stay, rows of one doc_id go together."""
    id = free_name(documents, "_id")
    chosen = near_duplicates(documents, radius).where("doc_id = component_id").select(F.col("doc_id").alias(id)).distinct()
    stay = documents.where("doc_id IS NOT NULL").join(chosen, F.col("doc_id") == F.col(id), "left_semi")
    return stay.unionByName(documents.where("doc_id IS NULL"))
