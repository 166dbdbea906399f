"""Reductions: a name, an aggregate, an identity, and how two partial results combine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LIMITS = {"tinyint": 1 << 7, "smallint": 1 << 15, "int": 1 << 31, "bigint": 1 << 63}


@dataclass(frozen=True)
class Functor:
    """An associative and commutative reduction.

    aggregate works as an aggregate and over a window; combine joins two partial results; identity
    is the result over nothing, for a Spark type name.
    """

    name: str
    aggregate: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]
    identity: Callable[[str], object]

    def over_nothing(self, kind: str = "double") -> Column:
        return F.lit(self.identity(kind)).cast(kind)

    def reduce(self, value: Column, kind: str = "double") -> Column:
        """The aggregate, or the identity where there are no values."""
        return F.coalesce(self.aggregate(value), self.over_nothing(kind))


def _lowest(kind: str) -> object:
    return -_LIMITS[kind] if kind in _LIMITS else False if kind == "boolean" else float("-inf")


def _highest(kind: str) -> object:
    return _LIMITS[kind] - 1 if kind in _LIMITS else True if kind == "boolean" else float("inf")


PLUS = Functor("plus", F.sum, lambda a, b: a + b, lambda k: 0)
MULTIPLIES = Functor("multiplies", F.product, lambda a, b: a * b, lambda k: 1)
MIN = Functor("min", F.min, F.least, _highest)
MAX = Functor("max", F.max, F.greatest, _lowest)
LOGICAL_AND = Functor("logical_and", F.bool_and, lambda a, b: a & b, lambda k: True)
LOGICAL_OR = Functor("logical_or", F.bool_or, lambda a, b: a | b, lambda k: False)
BIT_AND = Functor("bit_and", F.bit_and, lambda a, b: a.bitwiseAND(b), lambda k: -1)
BIT_OR = Functor("bit_or", F.bit_or, lambda a, b: a.bitwiseOR(b), lambda k: 0)
BIT_XOR = Functor("bit_xor", F.bit_xor, lambda a, b: a.bitwiseXOR(b), lambda k: 0)

FUNCTORS = {f.name: f for f in (PLUS, MULTIPLIES, MIN, MAX, LOGICAL_AND, LOGICAL_OR, BIT_AND, BIT_OR, BIT_XOR)}


def of(functor: str | Functor) -> Functor:
    return functor if isinstance(functor, Functor) else FUNCTORS[functor]


def argument(value: Column, index: Column, kind: str = "max") -> Column:
    """The aggregate struct (value, index) of the largest or smallest value, or of any true one; the smallest index wins ties."""
    if kind == "min":
        return F.min(F.when(value.isNotNull(), F.struct(value.alias("value"), index.alias("index"))))
    if kind == "max":
        best = F.max(F.when(value.isNotNull(), F.struct(value.alias("value"), (-index).alias("back"))))
        return F.when(best.isNotNull(), F.struct(best["value"].alias("value"), (-best["back"]).alias("index")))
    if kind == "any":
        first = F.min(F.when(value, index))
        return F.struct(first.isNotNull().alias("value"), first.alias("index"))
    raise ValueError(f"no such reduction with argument: {kind}")


def spark_type(frame_types: list[tuple[str, str]], name: str) -> str:
    return dict(frame_types)[name]


NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
