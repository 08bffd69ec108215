"""Metadata predicates: a small immutable tree that becomes one boolean Column.

Leaves are two-valued: a missing (null) field makes every leaf false, `ne` and `nin` included, and `not` negates that. They are
written as IS NOT NULL AND ..., which keeps them right under NOT and lets the scan push them down. Values compare within their
family only: numbers as numbers, strings, booleans. Against a value of another family eq and in are false, ne and nin true
where the field is present.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, NumericType, StringType, StructType, TimestampType

from halyard.contract import InvalidFilter

COMPARISONS = ("gt", "gte", "lt", "lte")
OPERATORS = ("eq", "ne", "in", "nin", *COMPARISONS, "match", "contains")


class Filter:
    def validate(self) -> Filter:
        raise NotImplementedError

    def column(self, schema: StructType) -> Column:
        """The predicate over a frame with this schema."""
        raise NotImplementedError

    def fields(self) -> set[str]:
        raise NotImplementedError

    def __and__(self, other: Filter) -> Filter:
        return And((self, other))

    def __or__(self, other: Filter) -> Filter:
        return Or((self, other))

    def __invert__(self) -> Filter:
        return Not(self)


def _family(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "other"


def _family_of(kind: DataType) -> str:
    if isinstance(kind, BooleanType):
        return "boolean"
    if isinstance(kind, NumericType):
        return "number"
    return "string" if isinstance(kind, StringType) else "other"


@dataclass(frozen=True)
class Field(Filter):
    """One comparison of a field. Fields of a map or variant column are written column.key."""

    name: str
    op: str
    value: Any

    def validate(self) -> Filter:
        if not self.name:
            raise InvalidFilter("a filter needs a field")
        if self.op not in OPERATORS:
            raise InvalidFilter(f"unknown operator {self.op!r}")
        if self.value is None:
            raise InvalidFilter("a filter value must not be null")
        if self.op in ("in", "nin"):
            if isinstance(self.value, (str, bytes)) or not isinstance(self.value, Sequence) or not len(self.value):
                raise InvalidFilter(f"{self.op} needs a list of values")
        elif self.op in COMPARISONS and _family(self.value) != "number":
            raise InvalidFilter(f"{self.op} needs a number")
        elif self.op == "match" and not isinstance(self.value, str):
            raise InvalidFilter("match needs a string")
        return self

    def fields(self) -> set[str]:
        return {self.name}

    def column(self, schema: StructType) -> Column:
        named = {f.name: f.dataType for f in schema.fields}
        if self.name in named:
            return self._on(F.col(f"`{self.name}`"), named[self.name])
        outer, _, key = self.name.partition(".")
        if key and outer in named:
            kind = named[outer]
            if kind.typeName() == "map":
                return self._on(F.col(f"`{outer}`")[key], kind.valueType)
            if kind.typeName() == "variant":
                want = {"number": "double", "boolean": "boolean"}.get(_family(self.value if self.op not in ("in", "nin") else self.value[0]), "string")
                return self._on(F.try_variant_get(F.col(f"`{outer}`"), f"$.{key}", want), StructType.fromDDL(f"x {want}").fields[0].dataType)
            if kind.typeName() == "struct" and key in kind.names:
                return self._on(F.col(f"`{outer}`.`{key}`"), kind[key].dataType)
        return F.lit(False)  # a field that no row has

    def _on(self, c: Column, kind: DataType) -> Column:
        there, family = c.isNotNull(), _family_of(kind)
        if self.op == "contains":
            return there & F.array_contains(c, F.lit(self.value)) if kind.typeName() == "array" else F.lit(False)
        if self.op == "match":
            return there & c.startswith(self.value) if self.value and family == "string" else F.lit(False)
        if self.op in COMPARISONS:
            if family != "number":
                return F.lit(False)
            v = F.lit(self.value)
            return there & {"gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[self.op]
        comparable = lambda v: _family(v) == family or (isinstance(kind, TimestampType) and _family(v) != "boolean")
        if self.op in ("eq", "ne"):
            if not comparable(self.value):
                return F.lit(False) if self.op == "eq" else there
            return there & (c == F.lit(self.value) if self.op == "eq" else c != F.lit(self.value))
        values = [v for v in self.value if v is not None and comparable(v)]
        if self.op == "in":
            return there & c.isin(values) if values else F.lit(False)
        return there & ~c.isin(values) if values else there


@dataclass(frozen=True)
class And(Filter):
    children: tuple[Filter, ...]

    def validate(self) -> Filter:
        if not self.children:
            raise InvalidFilter("and needs an operand")
        for c in self.children:
            c.validate()
        return self

    def fields(self) -> set[str]:
        return set().union(*(c.fields() for c in self.children))

    def column(self, schema: StructType) -> Column:
        return reduce(lambda a, b: a & b, (c.column(schema) for c in self.children))


@dataclass(frozen=True)
class Or(And):
    def validate(self) -> Filter:
        if not self.children:
            raise InvalidFilter("or needs an operand")
        for c in self.children:
            c.validate()
        return self

    def column(self, schema: StructType) -> Column:
        return reduce(lambda a, b: a | b, (c.column(schema) for c in self.children))


@dataclass(frozen=True)
class Not(Filter):
    child: Filter

    def validate(self) -> Filter:
        self.child.validate()
        return self

    def fields(self) -> set[str]:
        return self.child.fields()

    def column(self, schema: StructType) -> Column:
        return ~self.child.column(schema)


@dataclass(frozen=True)
class Function(Filter):
    """A predicate of the caller's: given the schema it returns a boolean Column (built-in, or of a pandas UDF). Null counts as false."""

    build: Callable[[StructType], Column]
    reads: tuple[str, ...] = ()

    def validate(self) -> Filter:
        if not callable(self.build):
            raise InvalidFilter("a function filter needs a function")
        return self

    def fields(self) -> set[str]:
        return set(self.reads)

    def column(self, schema: StructType) -> Column:
        return F.coalesce(self.build(schema), F.lit(False))


def eq(name: str, value: Any) -> Filter:
    return Field(name, "eq", value)


def ne(name: str, value: Any) -> Filter:
    return Field(name, "ne", value)


def isin(name: str, values: Sequence[Any]) -> Filter:
    return Field(name, "in", values)


def nin(name: str, values: Sequence[Any]) -> Filter:
    return Field(name, "nin", values)


def gt(name: str, value: float) -> Filter:
    return Field(name, "gt", value)


def gte(name: str, value: float) -> Filter:
    return Field(name, "gte", value)


def lt(name: str, value: float) -> Filter:
    return Field(name, "lt", value)


def lte(name: str, value: float) -> Filter:
    return Field(name, "lte", value)


def match(name: str, prefix: str) -> Filter:
    """Starts with prefix; an empty prefix matches nothing."""
    return Field(name, "match", prefix)


def contains(name: str, value: Any) -> Filter:
    """An element of an array field (an extension)."""
    return Field(name, "contains", value)


def between(name: str, low: float | None = None, high: float | None = None, include_low: bool = True, include_high: bool = True) -> Filter:
    """A numeric range, open where a bound is missing."""
    parts: list[Filter] = []
    if low is not None:
        parts.append((gte if include_low else gt)(name, low))
    if high is not None:
        parts.append((lte if include_high else lt)(name, high))
    if not parts:
        raise InvalidFilter("a range needs a bound")
    return parts[0] if len(parts) == 1 else And(tuple(parts))


def all_of(*children: Filter) -> Filter:
    return And(children)


def any_of(*children: Filter) -> Filter:
    return Or(children)


def negate(child: Filter) -> Filter:
    return Not(child)


def where(df: DataFrame, f: Filter | None) -> DataFrame:
    """The rows for which the filter holds."""
    return df if f is None else df.where(f.validate().column(df.schema))


def from_json(text: str) -> Filter:
    """A filter from {"field", "op", "value"} or {"and" | "or": [...]} or {"not": {...}}."""
    return _from(json.loads(text)).validate()


def _from(x: dict) -> Filter:
    if not isinstance(x, dict):
        raise InvalidFilter("a filter is an object")
    if "and" in x:
        return And(tuple(map(_from, x["and"])))
    if "or" in x:
        return Or(tuple(map(_from, x["or"])))
    if "not" in x:
        return Not(_from(x["not"]))
    try:
        return Field(x["field"], x["op"], x["value"])
    except KeyError as e:
        raise InvalidFilter(f"a filter needs {e}") from None
