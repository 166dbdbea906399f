"""Matrices as coordinate frames (row, col, v) with their dimensions; vectors are (i, v).

Elements that are not stored are 0. A symmetric matrix stores its lower half and stands for both.
Stored zeros are elements for traversals and reductions, but no non-zeros.

Where it is known how many elements are stored at most, sums by place are dealt to as many tasks as these need,
so that what a task holds does not grow with the matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions import functors
from ridgeline.functions.functors import Functor
from ridgeline.operators.segments import EVERY, Scope
from ridgeline.session import dealt


def _ids(spark: SparkSession, n: int, name: str) -> DataFrame:
    return spark.range(n).select(F.col("id").alias(name))


@dataclass(frozen=True)
class Matrix:
    elements: DataFrame
    rows: int
    cols: int
    symmetric: bool = False
    stored: int | None = None  #: elements at most, where known

    # Construction.

    @classmethod
    def of(cls, elements: DataFrame, rows: int, cols: int, symmetric: bool = False, duplicates: str = "last", order: str | None = None, count: int | None = None) -> Matrix:
        """From (row, col, v); of elements that repeat a place the last in `order` counts, or with duplicates="sum" their sum.

        count: how many elements there are at most, where places seldom repeat; elements are then exchanged before they are summed.
        """
        if symmetric:
            elements = elements.withColumns({"row": F.greatest("row", "col"), "col": F.least("row", "col")})
        if duplicates == "sum":
            elements = dealt(elements, count or 0, "row", "col").groupBy("row", "col").agg(F.sum("v").alias("v"))
        elif order:
            elements = elements.groupBy("row", "col").agg(F.max_by("v", order).alias("v"))
        return cls(elements.select("row", "col", "v"), rows, cols, symmetric, count)

    @classmethod
    def from_csr(cls, spark: SparkSession, offsets: Sequence[int], columns: Sequence[int], values: Sequence[float], cols: int) -> Matrix:
        """From the three arrays of compressed rows."""
        rows = [(r, int(columns[k]), float(values[k])) for r in range(len(offsets) - 1) for k in range(offsets[r], offsets[r + 1])]
        return cls(spark.createDataFrame(rows, "row bigint, col bigint, v double"), len(offsets) - 1, cols)

    @classmethod
    def from_ellpack(cls, spark: SparkSession, per_row: int, columns: Sequence[int], values: Sequence[float], rows: int, cols: int) -> Matrix:
        """From row-major arrays of per_row places a row; a column of -1 pads."""
        found = [(k // per_row, int(columns[k]), float(values[k])) for k in range(len(columns)) if columns[k] != -1]
        return cls(spark.createDataFrame(found, "row bigint, col bigint, v double"), rows, cols)

    @classmethod
    def from_dense(cls, spark: SparkSession, values: Sequence[Sequence[float]]) -> Matrix:
        """From nested lists; all places are stored."""
        found = [(r, c, float(v)) for r, line in enumerate(values) for c, v in enumerate(line)]
        return cls(spark.createDataFrame(found, "row bigint, col bigint, v double"), len(values), len(values[0]) if values else 0)

    @classmethod
    def banded(cls, spark: SparkSession, rows: int, cols: int, offsets: Sequence[int], value: Callable[[Column, Column], Column]) -> Matrix:
        """With value(row, col) on the diagonals of the given offsets, clipped to the matrix."""
        made = spark.range(rows).select(F.col("id").alias("row"), F.explode(F.array(*(F.lit(o).cast("bigint") for o in sorted(set(offsets))))).alias("offset"))
        made = made.select("row", (F.col("row") + F.col("offset")).alias("col")).where((F.col("col") >= 0) & (F.col("col") < cols))
        return cls(made.withColumn("v", value(F.col("row"), F.col("col")).cast("double")), rows, cols)

    @classmethod
    def tridiagonal(cls, spark: SparkSession, n: int, value: Callable[[Column, Column], Column]) -> Matrix:
        return cls.banded(spark, n, n, (-1, 0, 1), value)

    @classmethod
    def from_functions(cls, spark: SparkSession, rows: int, cols: int, length: Callable[[Column], Column], element: Callable[[Column, Column], tuple[Column, Column]]) -> Matrix:
        """A matrix that is never stored: length(row) elements a row, each (column, value) of element(row, loc)."""
        n = length(F.col("id"))
        locs = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))
        made = spark.range(rows).select(F.col("id").alias("row"), F.explode(locs).alias("loc"))
        col, v = element(F.col("row"), F.col("loc"))
        return cls(made.select("row", col.cast("bigint").alias("col"), v.cast("double").alias("v")), rows, cols)

    # Views.

    @property
    def spark(self) -> SparkSession:
        return self.elements.sparkSession

    def general(self) -> Matrix:
        """With both halves stored."""
        if not self.symmetric:
            return self
        upper = self.elements.where("row != col").select(F.col("col").alias("row"), F.col("row").alias("col"), "v")
        return Matrix(self.elements.unionByName(upper), self.rows, self.cols)

    def get_element(self, row: int, col: int) -> DataFrame:
        """One row: the element's value, 0 where none is stored."""
        r, c = (max(row, col), min(row, col)) if self.symmetric else (row, col)
        return self.elements.where((F.col("row") == r) & (F.col("col") == c)).agg(F.coalesce(F.max("v"), F.lit(0.0)).alias("value"))

    def get_row(self, row: int) -> DataFrame:
        """(col, v) of the elements that the row stores, by column."""
        return self.general().elements.where(F.col("row") == row).select("col", "v").orderBy("col")

    def find_element(self, row: int, col: int) -> DataFrame:
        """One row: whether the element is stored, and its value (null if not)."""
        r, c = (max(row, col), min(row, col)) if self.symmetric else (row, col)
        return self.elements.where((F.col("row") == r) & (F.col("col") == c)).agg((F.count(F.lit(1)) > 0).alias("found"), F.max("v").alias("value"))

    def for_rows(self, f: Callable[[Column, Column], Column], scope: Scope = EVERY) -> DataFrame:
        """(row, value): f(row, elements) of every row in the scope, elements an array of (col, v) by column; a row must fit a record."""
        lists = self.general().elements.where(scope.condition(F.col("row"))).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "v"))).alias("__e"))
        rows = _ids(self.spark, self.rows, "row").where(scope.condition(F.col("row"))).join(lists, "row", "left")
        kind = dict(lists.dtypes)["__e"]
        return rows.select("row", f(F.col("row"), F.coalesce("__e", F.array().cast(kind))).alias("value"))

    def sorted_columns(self) -> DataFrame:
        """(row, loc, col, v): the stored elements with their places by column inside each row, as compressed rows hold them."""
        place = F.row_number().over(Window.partitionBy("row").orderBy("col")) - 1
        return self.general().elements.select("row", place.cast("bigint").alias("loc"), "col", "v")

    def set_elements(self, changes: DataFrame) -> Matrix:
        """With the elements of changes (row, col, v) in place of what was stored."""
        return self._upsert(changes, lambda old, new: new)

    def add_elements(self, changes: DataFrame, multiplier: float = 1.0) -> Matrix:
        """With each change's value added to multiplier times the old one."""
        return self._upsert(changes, lambda old, new: F.coalesce(old, F.lit(0.0)) * multiplier + new)

    def _upsert(self, changes: DataFrame, f: Callable[[Column, Column], Column]) -> Matrix:
        if self.symmetric:
            changes = changes.withColumns({"row": F.greatest("row", "col"), "col": F.least("row", "col")})
        both = self.elements.join(changes.withColumnRenamed("v", "new"), ["row", "col"], "full")
        return replace(self, stored=None, elements=both.select("row", "col", F.when(F.col("new").isNotNull(), f(F.col("v"), F.col("new"))).otherwise(F.col("v")).alias("v")))

    def transpose(self, alpha: float = 1.0) -> Matrix:
        if self.symmetric:
            return replace(self, elements=self.elements.withColumn("v", F.col("v") * alpha))
        return Matrix(self.elements.select(F.col("col").alias("row"), F.col("row").alias("col"), (F.col("v") * alpha).alias("v")), self.cols, self.rows, stored=self.stored)

    def compressed(self) -> Matrix:
        """Without stored zeros."""
        return replace(self, elements=self.elements.where("v != 0"))

    def dense(self) -> DataFrame:
        """(row, col, v) with a row for every place."""
        places = self.spark.range(self.rows * self.cols).select(F.call_function("div", F.col("id"), F.lit(self.cols)).alias("row"), (F.col("id") % self.cols).alias("col"))
        return places.join(self.general().elements, ["row", "col"], "left").select("row", "col", F.coalesce("v", F.lit(0.0)).alias("v"))

    def row_lengths(self) -> DataFrame:
        """(row, length): how many non-zeros every row stores."""
        counts = self.elements.groupBy("row").agg(F.count_if(F.col("v") != 0).alias("length"))
        return _ids(self.spark, self.rows, "row").join(counts, "row", "left").select("row", F.coalesce("length", F.lit(0)).cast("bigint").alias("length"))

    def nonzeros(self) -> DataFrame:
        """One row: the number of non-zeros of the whole matrix; both halves of a symmetric one count."""
        weight = F.when(F.lit(self.symmetric) & (F.col("row") != F.col("col")), 2).otherwise(1)
        return self.elements.agg(F.coalesce(F.sum(F.when(F.col("v") != 0, weight).otherwise(0)), F.lit(0)).cast("bigint").alias("value"))

    def diagonal(self) -> DataFrame:
        """(i, v) of the diagonal."""
        found = self.elements.where("row = col").select(F.col("row").alias("i"), "v")
        return _ids(self.spark, min(self.rows, self.cols), "i").join(found, "i", "left").select("i", F.coalesce("v", F.lit(0.0)).alias("v"))

    def info(self) -> DataFrame:
        """One row: rows, cols, stored elements, non-zeros and their share of all places."""
        found = self.elements.agg(F.count(F.lit(1)).alias("stored"), F.count_if(F.col("v") != 0).alias("nonzeros"))
        places = F.lit(float(self.rows) * self.cols)
        return found.select(F.lit(self.rows).cast("bigint").alias("rows"), F.lit(self.cols).cast("bigint").alias("cols"), "stored", "nonzeros", (F.col("nonzeros") / places).alias("density"))

    # Products and sums.

    def vector_product(self, x: DataFrame, y: DataFrame | None = None, alpha: float = 1.0, beta: float = 0.0, between: tuple[int | None, int | None] = (None, None)) -> DataFrame:
        """(i, v) = alpha * A x + beta * y over a range of rows: a join on the column and a sum by row."""
        scope = Scope(between)
        rows = self.general().elements.where(scope.condition(F.col("row")))
        sums = rows.join(x.select(F.col("i").alias("col"), F.col("v").alias("x")), "col").groupBy(F.col("row").alias("i")).agg(F.sum(F.col("v") * F.col("x")).alias("s"))
        out = _ids(self.spark, self.rows, "i").where(scope.condition(F.col("i"))).join(sums, "i", "left")
        value = F.lit(alpha) * F.coalesce("s", F.lit(0.0))
        if y is not None and beta:
            out = out.join(y.select("i", F.col("v").alias("y")), "i", "left")
            value = value + F.lit(beta) * F.coalesce("y", F.lit(0.0))
        return out.select("i", value.alias("v"))

    def transposed_vector_product(self, x: DataFrame, y: DataFrame | None = None, alpha: float = 1.0, beta: float = 0.0) -> DataFrame:
        return self.general().transpose().vector_product(x, y, alpha, beta)

    def product(self, other: Matrix, alpha: float = 1.0) -> Matrix:
        """alpha * A B: a join on the inner index and a sum by place."""
        left = self.general().elements.select("row", F.col("col").alias("k"), F.col("v").alias("a"))
        right = other.general().elements.select(F.col("row").alias("k"), "col", F.col("v").alias("b"))
        return Matrix(left.join(right, "k").groupBy("row", "col").agg((F.sum(F.col("a") * F.col("b")) * alpha).alias("v")), self.rows, other.cols)

    def add(self, other: Matrix, alpha: float = 1.0, beta: float = 1.0) -> Matrix:
        """beta * A + alpha * B, stored where either is."""
        both = self.general().elements.select("row", "col", (F.col("v") * beta).alias("v")).unionByName(other.general().elements.select("row", "col", (F.col("v") * alpha).alias("v")))
        count = None if self.stored is None or other.stored is None else sum(m.stored * (2 if m.symmetric else 1) for m in (self, other))
        return Matrix(dealt(both, count or 0, "row", "col").groupBy("row", "col").agg(F.sum("v").alias("v")), self.rows, self.cols, stored=count)

    def symmetric_part(self) -> Matrix:
        """The mean of an element and its mirror where both are stored, and the one of them where only one is."""
        both = self.elements.unionByName(self.elements.where("row != col").select(F.col("col").alias("row"), F.col("row").alias("col"), "v"))
        count = None if self.stored is None else 2 * self.stored
        return Matrix(dealt(both, count or 0, "row", "col").groupBy("row", "col").agg(F.avg("v").alias("v")), self.rows, self.cols, stored=count)

    def adjacency(self, with_diagonal: bool = False, both_ways: bool = True) -> DataFrame:
        """(row, col): the places that are stored, with their mirrors."""
        places = self.elements.select("row", "col")
        if both_ways:
            places = places.unionByName(places.select(F.col("col").alias("row"), F.col("row").alias("col")))
        return (places if with_diagonal else places.where("row != col")).distinct()

    def equals(self, other: Matrix) -> DataFrame:
        """One row: whether all places agree; what is not stored is 0."""
        if (self.rows, self.cols) != (other.rows, other.cols):
            return self.spark.range(1).select(F.lit(False).alias("value"))
        both = self.general().elements.join(other.general().elements.withColumnRenamed("v", "w"), ["row", "col"], "full")
        return both.agg(F.coalesce(F.bool_and(F.coalesce("v", F.lit(0.0)) == F.coalesce("w", F.lit(0.0))), F.lit(True)).alias("value"))

    def permute(self, permutation: DataFrame, rows: bool = True, cols: bool = True) -> Matrix:
        """With row and column old moved to new."""
        out = self.general().elements
        for name, wanted in (("row", rows), ("col", cols)):
            if wanted:
                out = out.join(permutation.select(F.col("old").alias(name), F.col("new").alias("__new")), name).drop(name).withColumnRenamed("__new", name)
        return Matrix(out.select("row", "col", "v"), self.rows, self.cols)

    # Rows as segments.

    def reduce_rows(self, functor: str | Functor, fetch: Callable[[Column, Column, Column], Column] | None = None, scope: Scope = EVERY, kind: str = "double") -> DataFrame:
        """(row, value): the reduction of fetch(row, col, v) over the stored elements; rows without have the identity."""
        functor = functors.of(functor)
        value = fetch(F.col("row"), F.col("col"), F.col("v")) if fetch else F.col("v")
        partial = self.general().elements.where(scope.condition(F.col("row"))).groupBy("row").agg(functor.aggregate(value).cast(kind).alias("value"))
        rows = _ids(self.spark, self.rows, "row").where(scope.condition(F.col("row")))
        return rows.join(partial, "row", "left").select("row", F.coalesce("value", functor.over_nothing(kind)).alias("value"))

    def reduce_rows_with_argument(self, kind: str = "max", fetch: Callable[[Column, Column, Column], Column] | None = None, scope: Scope = EVERY) -> DataFrame:
        """(row, value, col): the extreme stored element, the first column where several tie."""
        value = fetch(F.col("row"), F.col("col"), F.col("v")) if fetch else F.col("v")
        found = self.general().elements.where(scope.condition(F.col("row"))).groupBy("row").agg(functors.argument(value, F.col("col"), kind).alias("r"))
        rows = _ids(self.spark, self.rows, "row").where(scope.condition(F.col("row")))
        return rows.join(found, "row", "left").select("row", F.col("r.value").alias("value"), F.col("r.index").alias("col"))

    def for_elements(self, f: Callable[[Column, Column, Column], Column], scope: Scope = EVERY) -> Matrix:
        new = f(F.col("row"), F.col("col"), F.col("v"))
        return replace(self, elements=self.elements.withColumn("v", F.when(scope.condition(F.col("row")), new).otherwise(F.col("v"))))


# Small matrices of fixed size, as lists of lists of Columns.


def determinant(m: Sequence[Sequence[Column]]) -> Column:
    """By expansion along the first row."""
    if len(m) == 1:
        return m[0][0]
    terms = [m[0][j] * determinant([[*row[:j], *row[j + 1 :]] for row in m[1:]]) * (-1) ** j for j in range(len(m))]
    return sum(terms[1:], terms[0])


def inverse(m: Sequence[Sequence[Column]]) -> list[list[Column]]:
    """The adjugate over the determinant."""
    n, d = len(m), determinant(m)
    if n == 1:
        return [[F.lit(1.0) / m[0][0]]]
    minor = lambda i, j: determinant([[v for c, v in enumerate(row) if c != j] for r, row in enumerate(m) if r != i])
    return [[minor(j, i) * (-1) ** (i + j) / d for j in range(n)] for i in range(n)]


def solve(m: Sequence[Sequence[Column]], b: Sequence[Column]) -> list[Column]:
    """By Cramer's rule."""
    d = determinant(m)
    return [determinant([[b[r] if c == k else v for c, v in enumerate(row)] for r, row in enumerate(m)]) / d for k in range(len(m))]


def multiply(a: Sequence[Sequence[Column]], b: Sequence[Sequence[Column]]) -> list[list[Column]]:
    out = []
    for row in a:
        line = []
        for j in range(len(b[0])):
            terms = [row[k] * b[k][j] for k in range(len(b))]
            line.append(sum(terms[1:], terms[0]))
        out.append(line)
    return out
