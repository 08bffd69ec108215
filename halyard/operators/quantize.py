"""Quantization: scalar, binary and product codes, unit-range and signed codes, and measured quality.

Codebooks have a size set by their parameters (dimension, bits, subspaces), so they live on the driver; codes are columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.contract import InvalidConfig
from halyard.functions import vectors as V
from halyard.operators.ann import append_column
from halyard.operators.kmeans import kmeans


def component_ranges(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Smallest and largest value of each component: i, low, high."""
    return df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.min("x").cast("double").alias("low"), F.max("x").cast("double").alias("high"))


@dataclass(frozen=True)
class ScalarQuantizer:
    """Codes of `bits` bits per component between its smallest and largest value in training."""

    low: tuple[float, ...]
    high: tuple[float, ...]
    bits: int = 8

    @classmethod
    def train(cls, df: DataFrame, vector: str = "embedding", bits: int = 8) -> ScalarQuantizer:
        if not 1 <= bits <= 15:
            raise InvalidConfig("bits must lie in 1..15")
        rows = component_ranges(df, vector).orderBy("i").collect()  # a row per component
        return cls(tuple(r["low"] for r in rows), tuple(r["high"] for r in rows), bits)

    @property
    def scales(self) -> list[float]:
        return [(2**self.bits - 1) / (b - a) if b > a else 1.0 for a, b in zip(self.low, self.high, strict=True)]

    def encode(self, vector: str | Column) -> Column:
        low, high, scales = (F.lit([float(x) for x in v]) for v in (self.low, self.high, self.scales))
        return F.transform(V.vector(vector), lambda x, i: F.floor((F.least(F.greatest(x.cast("double"), F.get(low, i)), F.get(high, i)) - F.get(low, i)) * F.get(scales, i) + 0.5).cast("smallint"))

    def decode(self, codes: str | Column) -> Column:
        low, scales = F.lit([float(x) for x in self.low]), F.lit(self.scales)
        return F.transform(V.vector(codes), lambda q, i: F.get(low, i) + q.cast("double") / F.get(scales, i))


@dataclass(frozen=True)
class BinaryQuantizer:
    """The signs of fixed projections sin(i * dimension + j), normalised, packed into bytes from the lowest bit up."""

    dimension: int
    bits: int

    @property
    def projections(self) -> list[list[float]]:
        out = []
        for i in range(self.bits):
            row = [math.sin(i * self.dimension + j) for j in range(self.dimension)]
            n = math.sqrt(sum(x * x for x in row))
            out.append([x / n for x in row] if n else row)
        return out

    def signs(self, vector: str | Column) -> Column:
        v = V.vector(vector)
        return F.transform(F.lit(self.projections), lambda p: V.dot(v, p) > 0)

    def encode(self, vector: str | Column) -> Column:
        weighted = F.transform(self.signs(vector), lambda s, i: F.when(s, F.pow(F.lit(2), i % 8).cast("int")).otherwise(0))

        def packed(w: Column) -> Column:
            return F.array(*[F.aggregate(F.slice(w, 8 * b + 1, 8), F.lit(0), lambda s, x: s + x).cast("smallint") for b in range(-(-self.bits // 8))])

        return F.get(F.transform(F.array(weighted), packed), F.lit(0))  # bound to a variable, the signs are worked out once


    def encoded(self, df: DataFrame, vector: str = "embedding", to: str = "codes") -> DataFrame:
        """df with the codes of its vectors, signs by one matrix product a batch."""
        planes = np.array(self.projections)
        kind = pa.list_(pa.int16())
        return append_column(df, vector, to, "array<smallint>", lambda x: pa.array(np.packbits(x @ planes.T > 0, axis=1, bitorder="little").astype(np.int16).tolist(), kind))


@dataclass(frozen=True)
class ProductQuantizer:
    """Nearest centroid per subspace: codebooks[subspace][code] is a centroid."""

    codebooks: tuple[tuple[tuple[float, ...], ...], ...]

    @classmethod
    def train(cls, df: DataFrame, vector: str = "embedding", id: str = "vec_id", subspaces: int = 8, bits: int = 4, iterations: int = 10) -> ProductQuantizer:
        """Lloyd's algorithm in every subspace, from rows of the smallest id hashes, a distributed pass an iteration."""
        width = df.select(F.max(F.size(vector))).first()[0] or 0
        if not width or width % subspaces:
            raise InvalidConfig("the dimension must be a multiple of the subspaces")
        centres = kmeans(df, vector, id, 2**bits, iterations, subspaces)
        return cls(tuple(tuple(tuple(map(float, c)) for c in s) for s in centres))

    @property
    def width(self) -> int:
        return len(self.codebooks[0][0])

    def encode(self, vector: str | Column) -> Column:
        v = V.vector(vector)
        return F.array(*[self._nearest(F.slice(v, s * self.width + 1, self.width), book) for s, book in enumerate(self.codebooks)])

    @staticmethod
    def _nearest(own: Column, book: tuple[tuple[float, ...], ...]) -> Column:
        """Number of the nearest centroid, the first of equals."""
        pairs = F.transform(F.lit([list(c) for c in book]), lambda c, i: F.struct(V.squared_euclidean(own, c).alias("d"), i.alias("i")))
        return F.array_min(pairs)["i"].cast("smallint")

    def decode(self, codes: str | Column) -> Column:
        c = V.vector(codes)
        return F.flatten(F.array(*[F.get(F.lit([list(x) for x in book]), F.get(c, F.lit(s)).cast("int")) for s, book in enumerate(self.codebooks)]))

    def lookup(self, query: Sequence[float]) -> list[list[float]]:
        """Squared distances of the query's parts to all centroids."""
        q = np.asarray(query, float).reshape(len(self.codebooks), self.width)
        return [[float(((np.asarray(c) - q[s]) ** 2).sum()) for c in book] for s, book in enumerate(self.codebooks)]

    def asymmetric_distance(self, codes: str | Column, query: Sequence[float]) -> Column:
        """Squared distance of an exact query to coded vectors."""
        table = F.lit(self.lookup(query))
        return F.aggregate(F.transform(V.vector(codes), lambda c, s: F.get(F.get(table, s), c.cast("int"))), F.lit(0.0), lambda a, x: a + x)

    def compression_ratio(self) -> float:
        bits = max(1, math.ceil(math.log2(len(self.codebooks[0]))))
        return 32 * self.width * len(self.codebooks) / (bits * len(self.codebooks))


@dataclass(frozen=True)
class MultiLevelQuantizer:
    """Product codes, then scalar codes of what they leave."""

    coarse: ProductQuantizer
    fine: ScalarQuantizer

    @classmethod
    def train(cls, df: DataFrame, vector: str = "embedding", id: str = "vec_id", subspaces: int = 8, bits: int = 4, fine_bits: int = 4, iterations: int = 10) -> MultiLevelQuantizer:
        coarse = ProductQuantizer.train(df, vector, id, subspaces, bits, iterations)
        rest = df.where(F.col(vector).isNotNull()).select(V.subtract(vector, coarse.decode(coarse.encode(vector))).alias("rest"))
        return cls(coarse, ScalarQuantizer.train(rest, "rest", fine_bits))

    def encode(self, vector: str | Column) -> Column:
        """A struct of both levels' codes."""
        codes = self.coarse.encode(vector)
        return F.struct(codes.alias("coarse"), self.fine.encode(V.subtract(vector, self.coarse.decode(codes))).alias("fine"))

    def decode(self, codes: Column) -> Column:
        return V.add(self.coarse.decode(codes["coarse"]), self.fine.decode(codes["fine"]))


def adc_top_k(df: DataFrame, quantizer: ProductQuantizer, query: Sequence[float], k: int, codes: str = "codes", id: str = "vec_id") -> DataFrame:
    out = df.select(id, quantizer.asymmetric_distance(codes, query).alias("distance")).orderBy("distance", id).limit(k)
    return out.withColumn("rank", F.row_number().over(Window.orderBy("distance", id)))


def hamming_top_k(df: DataFrame, query_codes: Sequence[int], k: int, codes: str = "codes", id: str = "vec_id") -> DataFrame:
    d = V.bit_hamming(F.col(codes), F.lit(list(query_codes)).cast("array<smallint>"))
    return df.select(id, d.alias("distance")).orderBy("distance", id).limit(k)


def unit_encode(vector: str | Column, bits: int = 8) -> Column:
    """Components cut to 0..1 as codes of `bits` bits."""
    return F.transform(V.vector(vector), lambda x: F.floor(F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(1.0)) * (2**bits - 1) + 0.5).cast("int"))


def unit_decode(codes: str | Column, bits: int = 8) -> Column:
    return F.transform(V.vector(codes), lambda q: q.cast("double") / (2**bits - 1))


def signed_encode(vector: str | Column) -> Column:
    """Components of -1..1 as 0..255, truncated."""
    return F.transform(V.vector(vector), lambda x: F.floor(F.least(F.greatest((x.cast("double") + 1) * 127.5, F.lit(0.0)), F.lit(255.0))).cast("int"))


def mean_squared_error(vector: str | Column, decoded: str | Column) -> Column:
    """Per row, over its components."""
    return V.squared_euclidean(vector, decoded) / F.size(V.vector(vector))


def quality(df: DataFrame, vector: str, decoded: Column, bits_per_vector: int) -> DataFrame:
    """Measured error and compression of a quantizer over the rows."""
    error = mean_squared_error(vector, decoded)
    return df.agg(F.count("*").alias("n"), F.avg(error).alias("mse"), F.max(error).alias("worst_mse"), (F.avg(32.0 * F.size(vector)) / bits_per_vector).alias("ratio"), F.avg((error <= 0.1).cast("double")).alias("success_rate"))


def choose(df: DataFrame, vector: str = "embedding", id: str = "vec_id", largest_mse: float = 0.01) -> tuple[str, dict[str, float]]:
    """The strongest compression whose measured error is small enough, and the errors of all that were tried."""
    width = df.select(F.max(F.size(vector))).first()[0]
    sq = ScalarQuantizer.train(df, vector)
    errors = {"scalar": df.select(F.avg(mean_squared_error(vector, sq.decode(sq.encode(vector))))).first()[0]}
    if width % 8 == 0:
        pq = ProductQuantizer.train(df, vector, id)
        errors["product"] = df.select(F.avg(mean_squared_error(vector, pq.decode(pq.encode(vector))))).first()[0]
    for name in ("product", "scalar"):
        if errors.get(name, math.inf) <= largest_mse:
            return name, errors
    return "none", errors


def batch_report(df: DataFrame, vector: str = "embedding", id: str = "vec_id", bits: int = 8) -> DataFrame:
    """Per row its smallest and largest component, their range and the compression of codes of `bits` bits."""
    return df.select(id, V.smallest(vector).alias("low"), V.largest(vector).alias("high"), V.spread(vector).alias("range"), (F.size(vector) * 32.0 / F.ceil(F.size(vector) * bits / 8) / 8).alias("ratio"))
