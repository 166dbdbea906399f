"""Vectors as frames (i, v): element-wise expressions, reductions, search, compaction, dictionaries.

A vector's index i is dense and unique, but rows are in no order. Ranges are half-open; None means
the vector's begin or end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import functors
from ridgeline.functions.functors import Functor
from ridgeline.operators.scan import row_numbers
from ridgeline.session import Workspace

Range = tuple[int | None, int | None]
ALL: Range = (None, None)


def within(between: Range, index: str = "i") -> Column:
    """The condition that an index lies in a range."""
    begin, end = between
    out = F.lit(True)
    if begin is not None:
        out = out & (F.col(index) >= begin)
    if end is not None:
        out = out & (F.col(index) < end)
    return out


def indexes(spark: SparkSession, *sizes: int, names: Sequence[str] = ("i", "j", "k")) -> DataFrame:
    """The index space of a box of up to three dimensions, made in parallel from one range without a join."""
    total = 1
    for s in sizes:
        total *= s
    out, rest = spark.range(total), F.col("id")
    for name, size in reversed(list(zip(names, sizes, strict=False))):
        out = out.withColumn(name, rest % size)
        rest = F.call_function("div", rest, F.lit(size))
    return out.select(*names[: len(sizes)])


def constant(spark: SparkSession, n: int, value: object) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.lit(value).alias("v"))


def random(spark: SparkSession, n: int, low: float, high: float, seed: int = 0) -> DataFrame:
    """Uniform values of [low, high); each depends on its index and the seed alone."""
    unit = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 53)).cast("double") / float(1 << 53)
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(low) + unit * (high - low)).alias("v"))


def for_elements(vector: DataFrame, f: Callable[[Column, Column], Column], between: Range = ALL) -> DataFrame:
    """v becomes f(i, v) inside the range."""
    return vector.withColumn("v", F.when(within(between), f(F.col("i"), F.col("v"))).otherwise(F.col("v")))


def fill(vector: DataFrame, value: object, between: Range = ALL) -> DataFrame:
    return for_elements(vector, lambda i, v: F.lit(value), between)


def zipped(*vectors: DataFrame) -> DataFrame:
    """Vectors side by side by index: i, v0, v1, ..."""
    out = vectors[0].select("i", F.col("v").alias("v0"))
    for k, v in enumerate(vectors[1:], 1):
        out = out.join(v.select("i", F.col("v").alias(f"v{k}")), "i")
    return out


def evaluate(f: Callable[..., Column], *vectors: DataFrame) -> DataFrame:
    """The vector of f of the vectors' elements."""
    if len(vectors) == 1:
        return vectors[0].select("i", f(F.col("v")).alias("v"))
    both = zipped(*vectors)
    return both.select("i", f(*(F.col(f"v{k}") for k in range(len(vectors)))).alias("v"))


def reduce(vector: DataFrame, functor: str | Functor, fetch: Callable[[Column, Column], Column] | None = None, between: Range = ALL) -> DataFrame:
    """One row with value: the reduction of fetch(i, v) over a range; over nothing the identity."""
    value = fetch(F.col("i"), F.col("v")) if fetch else F.col("v")
    rows = vector.where(within(between)).select(value.alias("value"))
    kind = rows.dtypes[0][1]
    return rows.agg(functors.of(functor).reduce(F.col("value"), kind).alias("value"))


def reduce_with_argument(vector: DataFrame, kind: str = "max", fetch: Callable[[Column, Column], Column] | None = None, between: Range = ALL) -> DataFrame:
    """One row (value, index) of the largest or smallest element, or of any true one; ties go to the smallest index."""
    value = fetch(F.col("i"), F.col("v")) if fetch else F.col("v")
    return vector.where(within(between)).agg(functors.argument(value, F.col("i"), kind).alias("r")).select("r.value", "r.index")


def evaluate_and_reduce(f: Callable[..., Column], functor: str | Functor, *vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vector of f of the vectors' elements, and the row with its reduction; the vector is written once and read for both."""
    made = Workspace(vectors[0].sparkSession, "evaluate").write(evaluate(f, *vectors))
    return made, reduce(made, functor)


def add_and_reduce(target: DataFrame, f: Callable[..., Column], functor: str | Functor, *vectors: DataFrame, absolute: bool = False) -> tuple[DataFrame, DataFrame]:
    """The target with f of the vectors' elements added, and the row with the reduction of f (or of its absolute value)."""
    change = evaluate(f, *vectors)
    both = Workspace(target.sparkSession, "add").write(target.join(change.withColumnRenamed("v", "change"), "i"))
    size = F.abs("change") if absolute else F.col("change")
    return both.select("i", (F.col("v") + F.col("change")).alias("v")), reduce(both.select("i", size.alias("v")), functor)


def lp_norm(value: Column, p: float) -> Column:
    """The aggregate p-norm; infinity gives the largest absolute value. Over nothing it is 0."""
    if p == float("inf"):
        return F.coalesce(F.max(F.abs(value)), F.lit(0.0))
    if p == 1:
        return F.coalesce(F.sum(F.abs(value)), F.lit(0.0))
    if p == 2:
        return F.sqrt(F.coalesce(F.sum(value * value), F.lit(0.0)))
    return F.pow(F.coalesce(F.sum(F.pow(F.abs(value), F.lit(p))), F.lit(0.0)), F.lit(1 / p))


def norms(vector: DataFrame) -> DataFrame:
    """One row with max_norm, l1_norm and l2_norm, from one pass."""
    v = F.col("v")
    return vector.agg(lp_norm(v, float("inf")).alias("max_norm"), lp_norm(v, 1).alias("l1_norm"), lp_norm(v, 2).alias("l2_norm"))


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    return zipped(a, b).agg(F.coalesce(F.sum(F.col("v0") * F.col("v1")), F.lit(0.0)).alias("value"))


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two vectors have the same indexes and values."""
    both = a.select("i", F.col("v").alias("v0"), F.lit(True).alias("in0")).join(b.select("i", F.col("v").alias("v1"), F.lit(True).alias("in1")), "i", "full")
    return both.agg(F.coalesce(F.bool_and(F.col("in0").isNotNull() & F.col("in1").isNotNull() & F.col("v0").eqNullSafe(F.col("v1"))), F.lit(True)).alias("value"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: -1, 0 or 1 as a stands before, equals or stands after b lexicographically; a missing element stands before any."""
    both = a.select("i", F.col("v").alias("v0")).join(b.select("i", F.col("v").alias("v1")), "i", "full").where(~F.col("v0").eqNullSafe(F.col("v1")))
    first = F.min(F.struct("i", F.when(F.col("v0").isNull() | (F.col("v0") < F.col("v1")), -1).otherwise(1).alias("sign")))
    return both.agg(F.coalesce(first["sign"], F.lit(0)).alias("value"))


def find(vector: DataFrame, value: object, between: Range = ALL) -> DataFrame:
    """One row (found, index): the first place of a value."""
    return vector.where(within(between) & (F.col("v") == F.lit(value))).agg(F.min("i").alias("index")).select(F.col("index").isNotNull().alias("found"), "index")


def upper_bound(vector: DataFrame, value: object, between: Range = ALL) -> DataFrame:
    """One row (found, index): the first place of an element above a value."""
    return vector.where(within(between) & (F.col("v") > F.lit(value))).agg(F.min("i").alias("index")).select(F.col("index").isNotNull().alias("found"), "index")


def contains(vector: DataFrame, value: object, between: Range = ALL) -> DataFrame:
    """One row: whether some element has the value; false over nothing."""
    return vector.where(within(between)).agg(F.coalesce(F.bool_or(F.col("v") == F.lit(value)), F.lit(False)).alias("value"))


def contains_only(vector: DataFrame, value: object, between: Range = ALL) -> DataFrame:
    """One row: whether all elements have the value; true over nothing."""
    return vector.where(within(between)).agg(F.coalesce(F.bool_and(F.col("v") == F.lit(value)), F.lit(True)).alias("value"))


def compress(marks: DataFrame, between: Range = ALL) -> DataFrame:
    """(slot, i): the indexes of true marks in order, slots from 0; a scan without a single-task sort."""
    return row_numbers(marks.where(within(between) & F.col("v").cast("boolean")).select("i"), "i", "slot").select("slot", "i")


def dictionary(rows: DataFrame, key: str, position: str) -> DataFrame:
    """(key, index): keys in the order in which they first appear, indexes from 0."""
    first = rows.groupBy(key).agg(F.min(position).alias("first"))
    return row_numbers(first, "first", "index").select(key, "index")


def dictionary_counts(rows: DataFrame, key: str, of: DataFrame) -> DataFrame:
    """(key, count): how often each key of a dictionary stands in rows; 0 for those that do not."""
    found = rows.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    return of.select(key).join(found, key, "left").select(key, F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def dictionary_erased(of: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The dictionary without the keys of gone; the indexes of the others stay."""
    return of.join(gone.select(key).distinct(), key, "left_anti")


def dictionary_extended(of: DataFrame, key: str, rows: DataFrame, position: str) -> DataFrame:
    """(key, index): the dictionary with the keys of rows that it lacks, numbered behind it in the order in which they first appear."""
    fresh = dictionary(rows.join(of.select(key), key, "left_anti"), key, position)
    after = of.agg(F.coalesce(F.max("index") + 1, F.lit(0)).alias("after"))  # one row
    return of.select(key, "index").unionByName(fresh.join(F.broadcast(after)).select(key, (F.col("index") + F.col("after")).alias("index")))


#: What concurrent updates of one place come to, by the operation's name.
SCATTERS: dict[str, Callable[[str], Column]] = {"add": F.sum, "sub": lambda v: -F.sum(v), "min": F.min, "max": F.max, "and": F.bit_and, "or": F.bit_or, "xor": F.bit_xor}


def scatter(vector: DataFrame, rows: DataFrame, target: str, value: str, operation: str = "add") -> DataFrame:
    """(i, v): the vector after the updates of rows, whose order does not matter; places without updates keep their value."""
    changes = rows.groupBy(F.col(target).alias("i")).agg(SCATTERS[operation](value).alias("__u"))
    v, u = F.col("v"), F.col("__u")
    new = {"add": v + u, "sub": v + u, "min": F.least(v, u), "max": F.greatest(v, u), "and": v.bitwiseAND(u), "or": v.bitwiseOR(u), "xor": v.bitwiseXOR(u)}[operation]
    return vector.select("i", "v").join(changes, "i", "left").select("i", F.when(u.isNull(), v).otherwise(new).alias("v"))


def exchange_if(vector: DataFrame, expected: DataFrame) -> DataFrame:
    """(i, v, done): compare and exchange: of expected (i, old, new), one a place, those whose old is the place's value set it."""
    rows = vector.select("i", "v").join(expected, "i", "left")
    done = F.coalesce(F.col("v") == F.col("old"), F.lit(False))
    return rows.select("i", F.when(done, F.col("new")).otherwise(F.col("v")).alias("v"), done.alias("done"))


def scatter_add(rows: DataFrame, target: str, value: str) -> DataFrame:
    """(i, v): sums of the values that fall on each target, what atomic additions give."""
    return rows.groupBy(F.col(target).alias("i")).agg(F.sum(value).alias("v"))
