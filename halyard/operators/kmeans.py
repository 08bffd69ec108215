"""Lloyd's k-means over the rows of a frame: a pass of partial sums an iteration; only centroids come to the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre, the first of equals."""
    d = (centres * centres).sum(axis=1)[None, :] - 2 * rows @ centres.T
    return d.argmin(axis=1)


def kmeans(df: DataFrame, vector: str, id: str, k: int, iterations: int = 10, parts: int = 1, seed: int = 42) -> np.ndarray:
    """Centres [part, centre, component] of the vectors cut into equal parts; they start at the rows with the smallest hash of id.

    Sums are taken in integers, so neither the number of tasks nor their order changes the result. An empty cluster keeps its centre.
    """
    source = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"), F.xxhash64(F.col(id), F.lit(seed)).alias("h"), F.col(id).alias("i"))
    first = source.orderBy("h", "i").limit(k).collect()
    if not first:
        return np.zeros((parts, 0, 0))
    width = len(first[0]["v"])
    start = np.array([r["v"] for r in first]).reshape(len(first), parts, width // parts)
    centres = start.transpose(1, 0, 2).copy()
    rows = source.where(F.size("v") == width).select("v")
    for _ in range(iterations):
        held = centres

        def sums(batches, held=held):
            total = np.zeros(held.shape, np.int64)
            n = np.zeros(held.shape[:2], np.int64)
            for batch in batches:
                if batch.num_rows:
                    x = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, held.shape[0], held.shape[2])
                    for p in range(held.shape[0]):
                        own = assign(x[:, p], held[p])
                        np.add.at(total[p], own, np.rint(x[:, p] * (1 << 24)).astype(np.int64))
                        n[p] += np.bincount(own, minlength=held.shape[1])
            at = np.argwhere(n > 0)
            if len(at):
                p, c = at[:, 0], at[:, 1]
                yield pa.record_batch([pa.array(p, pa.int32()), pa.array(c, pa.int32()), pa.array(n[p, c]), pa.array(total[p, c].tolist(), pa.list_(pa.int64()))], names=["p", "c", "n", "s"])

        partial = rows.mapInArrow(sums, "p int, c int, n long, s array<long>")
        flat = partial.select("p", "c", "n", F.posexplode("s").alias("j", "x")).groupBy("p", "c", "j").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        moved = centres.copy()
        for r in flat.collect():  # one row per component of each centre
            moved[r["p"], r["c"], r["j"]] = r["x"] / r["n"] / (1 << 24)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres
