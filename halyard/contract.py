"""The contract of the engine: metrics, errors, configuration and request validation.

distance: lower is closer. cosine is 1 - cos (two zero vectors: 0, one: 1), euclidean L2, manhattan L1, dot_product -dot.
score: higher is better. cos; 1 / (1 + d); 1 / (1 + d); dot. Results are ordered by distance and then by id; filters hold before
the best are chosen; max_distance and min_score are inclusive.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from enum import Enum
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from halyard.functions.predicates import Filter


class Metric(str, Enum):
    COSINE = "cosine"
    EUCLIDEAN = "euclidean"
    MANHATTAN = "manhattan"
    DOT_PRODUCT = "dot_product"

    @classmethod
    def of(cls, name: str | Metric) -> Metric:
        try:
            return cls(name)
        except ValueError:
            raise InvalidConfig(f"unknown metric {name!r}") from None


class EngineError(ValueError):
    """Any error of this engine that its caller can mend."""


class InvalidConfig(EngineError):
    pass


class InvalidVector(EngineError):
    pass


class DimensionMismatch(InvalidVector):
    pass


class InvalidFilter(EngineError):
    pass


class InvalidRequest(EngineError):
    pass


class NotFound(EngineError):
    pass


class AlreadyExists(EngineError):
    pass


class Closed(EngineError):
    pass


class CapacityExceeded(EngineError):
    pass


@dataclass(frozen=True)
class CollectionConfig:
    """Settings of a collection; m, ef_construction and max_layer matter to the graph accelerator only."""

    name: str
    dimension: int
    metric: Metric | str = Metric.COSINE
    m: int = 16
    ef_construction: int = 200
    max_layer: int = 16
    seed: int = 42
    description: str = ""
    tags: Sequence[str] = ()
    id_column: str = "id"
    vector_column: str = "vector"
    max_vectors: int | None = None
    max_bytes: int | None = None

    def __post_init__(self) -> None:
        if not self.name:
            raise InvalidConfig("a collection needs a name")
        if self.dimension <= 0:
            raise InvalidConfig("dimension must be positive")
        for what in ("m", "ef_construction", "max_layer"):
            if getattr(self, what) <= 0:
                raise InvalidConfig(f"{what} must be positive")
        object.__setattr__(self, "metric", Metric.of(self.metric))


def checked_vector(vector: Sequence[float], dimension: int | None = None) -> list[float]:
    if vector is None or len(vector) == 0:
        raise InvalidVector("empty vector")
    if dimension is not None and len(vector) != dimension:
        raise DimensionMismatch(f"expected {dimension} components, got {len(vector)}")
    out = [float(x) for x in vector]
    if not all(map(math.isfinite, out)):
        raise InvalidVector("a component is not finite")
    return out


def checked_page(limit: int, offset: int) -> None:
    if limit < 0 or offset < 0:
        raise InvalidRequest("limit and offset must not be negative")


@dataclass(frozen=True)
class SearchRequest:
    """One search: the vector, how many results, and what bounds them."""

    vector: Sequence[float]
    k: int = 10
    filter: Filter | None = None
    max_distance: float | None = None
    min_score: float | None = None
    include_vector: bool = False
    include_metadata: bool = True
    dimension: int | None = field(default=None, repr=False)

    def validate(self) -> SearchRequest:
        checked_vector(self.vector, self.dimension)
        if self.k <= 0:
            raise InvalidRequest("k must be positive")
        check_cuts(self.max_distance, self.min_score)
        if self.filter is not None:
            self.filter.validate()
        return self


def check_cuts(max_distance: float | None, min_score: float | None) -> None:
    if max_distance is not None and not max_distance >= 0:
        raise InvalidRequest("max_distance must not be negative")
    if min_score is not None and not 0 <= min_score <= 1:
        raise InvalidRequest("min_score must lie in 0..1")
