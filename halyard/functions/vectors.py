"""Vector scalar functions as Columns over ARRAY<FLOAT> or ARRAY<DOUBLE>; arithmetic is DOUBLE, summed from left to right."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from halyard.contract import Metric, checked_vector

Vector = Column | str | Sequence[float]


def vector(v: Vector) -> Column:
    """A column of vectors, by name, as it is, or from numbers."""
    if isinstance(v, Column):
        return v
    if isinstance(v, str):
        return F.col(v)
    return F.lit(checked_vector(v)).cast("array<double>")


def _fold(pairs: Column, start: float = 0.0) -> Column:
    return F.aggregate(pairs, F.lit(start), lambda s, x: s + x)


def _pairs(a: Vector, b: Vector, function: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(vector(a), vector(b), lambda x, y: function(x.cast("double"), y.cast("double")))


def dot(a: Vector, b: Vector) -> Column:
    return _fold(_pairs(a, b, lambda x, y: x * y))


def norm(a: Vector) -> Column:
    """The norm; that of a vector given as numbers is worked out once, here."""
    if not isinstance(a, (Column, str)):
        total = 0.0
        for x in checked_vector(a):
            total += x * x
        return F.lit(math.sqrt(total))
    return F.sqrt(_fold(F.transform(vector(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine_similarity(a: Vector, b: Vector) -> Column:
    """cos in -1..1; 1 for two zero vectors, 0 if one is zero."""
    p, q = norm(a), norm(b)
    cos = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.try_divide(dot(a, b), p * q)))
    return F.when((p == 0) & (q == 0), 1.0).when((p == 0) | (q == 0), 0.0).otherwise(cos)


def cosine_distance(a: Vector, b: Vector) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def squared_euclidean(a: Vector, b: Vector) -> Column:
    return _fold(_pairs(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean_distance(a: Vector, b: Vector) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def manhattan_distance(a: Vector, b: Vector) -> Column:
    return _fold(_pairs(a, b, lambda x, y: F.abs(x - y)))


def dot_product_distance(a: Vector, b: Vector) -> Column:
    return -dot(a, b)


def hamming_distance(a: Vector, b: Vector) -> Column:
    """Components that differ."""
    return F.size(F.filter(F.zip_with(vector(a), vector(b), lambda x, y: x != y), lambda z: z))


def bit_hamming(a: Column, b: Column) -> Column:
    """Bits that differ between two arrays of integer codes."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


_DISTANCES: dict[Metric, Callable[[Vector, Vector], Column]] = {
    Metric.COSINE: cosine_distance,
    Metric.EUCLIDEAN: euclidean_distance,
    Metric.MANHATTAN: manhattan_distance,
    Metric.DOT_PRODUCT: dot_product_distance,
}


def distance(metric: Metric | str, a: Vector, b: Vector) -> Column:
    return _DISTANCES[Metric.of(metric)](a, b)


def score_of(metric: Metric | str, distance: Column) -> Column:
    """Similarity from distance."""
    return {
        Metric.COSINE: lambda d: F.lit(1.0) - d,
        Metric.EUCLIDEAN: lambda d: F.lit(1.0) / (F.lit(1.0) + d),
        Metric.MANHATTAN: lambda d: F.lit(1.0) / (F.lit(1.0) + d),
        Metric.DOT_PRODUCT: lambda d: -d,
    }[Metric.of(metric)](distance)


def distance_of(metric: Metric | str, score: Column) -> Column:
    """Distance from similarity; 1e9 where a reciprocal score is zero."""
    reciprocal = F.when(score == 0, 1e9).otherwise(F.try_divide(F.lit(1.0), score) - 1.0)
    return {Metric.COSINE: F.lit(1.0) - score, Metric.DOT_PRODUCT: -score}.get(Metric.of(metric), reciprocal)


def normalize(a: Vector) -> Column:
    """The vector divided by its norm; a zero vector stays as it is."""
    v = vector(a)
    n = norm(v)
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def add(a: Vector, b: Vector) -> Column:
    return _pairs(a, b, lambda x, y: x + y)


def subtract(a: Vector, b: Vector) -> Column:
    return _pairs(a, b, lambda x, y: x - y)


def scale(a: Vector, factor: float | Column) -> Column:
    return F.transform(vector(a), lambda x: x.cast("double") * factor)


def dimension(a: Vector) -> Column:
    return F.size(vector(a))


def smallest(a: Vector) -> Column:
    return F.array_min(vector(a)).cast("double")


def largest(a: Vector) -> Column:
    return F.array_max(vector(a)).cast("double")


def spread(a: Vector) -> Column:
    return largest(a) - smallest(a)


#: Bytes that a metadata value of each Spark type counts for; strings count for their length.
_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def record_size(id_column: str, vector_column: str, metadata: Sequence[tuple[str, str]]) -> Column:
    """Estimated bytes of a record: id, 4 per component, and each present metadata key with its value. metadata: names and types."""
    out = F.length(F.col(id_column).cast("string")) + 4 * F.size(vector_column)
    for name, kind in metadata:
        value = F.length(name) if kind == "string" else F.lit(8 if kind in _NUMERIC else 1 if kind == "boolean" else 16)
        out = out + F.when(F.col(name).isNull(), 0).otherwise(len(name) + value)
    return out.cast("long")


def checked(a: Vector, expected: int) -> Column:
    """The vector itself; running the query fails where its dimension differs."""
    v = vector(a)
    return F.when(F.size(v) == expected, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {expected} components, got "), F.size(v).cast("string"))))
