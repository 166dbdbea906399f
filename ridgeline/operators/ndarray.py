"""N-dimensional arrays as frames (i0, ..., ik, v) with their sizes, and grids over them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import functors
from ridgeline.functions import math as M
from ridgeline.functions.functors import Functor


@dataclass(frozen=True)
class NDArray:
    """All elements are stored. order: the axes from the slowest to the fastest in storage."""

    elements: DataFrame
    sizes: tuple[int, ...]
    order: tuple[int, ...] | None = None

    @property
    def axes(self) -> list[str]:
        return [f"i{k}" for k in range(len(self.sizes))]

    @classmethod
    def of(cls, spark: SparkSession, sizes: Sequence[int], value: Callable[..., Column]) -> NDArray:
        """With value(i0, ..., ik) everywhere, made in parallel from one range."""
        total = 1
        for s in sizes:
            total *= s
        out, rest = spark.range(total), F.col("id")
        for k in reversed(range(len(sizes))):
            out = out.withColumn(f"i{k}", rest % sizes[k])
            rest = F.call_function("div", rest, F.lit(sizes[k]))
        names = [f"i{k}" for k in range(len(sizes))]
        return cls(out.select(*names, value(*map(F.col, names)).alias("v")), tuple(sizes))

    def storage_index(self) -> Column:
        """Where an element lies in storage."""
        out = F.lit(0).cast("bigint")
        for k in self.order or range(len(self.sizes)):
            out = out * self.sizes[k] + F.col(f"i{k}")
        return out

    def strides(self) -> tuple[int, ...]:
        out, step = [0] * len(self.sizes), 1
        for k in reversed(self.order or range(len(self.sizes))):
            out[k] = step
            step *= self.sizes[k]
        return tuple(out)

    def box(self, begins: Sequence[int], ends: Sequence[int]) -> Column:
        out = F.lit(True)
        for k, (b, e) in enumerate(zip(begins, ends, strict=True)):
            out = out & (F.col(f"i{k}") >= b) & (F.col(f"i{k}") < e)
        return out

    def interior(self, width: int = 1) -> Column:
        return self.box([width] * len(self.sizes), [s - width for s in self.sizes])

    def for_all(self, f: Callable[..., Column]) -> NDArray:
        """v becomes f(i0, ..., ik, v)."""
        return NDArray(self.elements.withColumn("v", f(*map(F.col, [*self.axes, "v"]))), self.sizes, self.order)

    def for_interior(self, f: Callable[..., Column], width: int = 1) -> NDArray:
        return self.for_all(lambda *a: F.when(self.interior(width), f(*a)).otherwise(a[-1]))

    def for_boundary(self, f: Callable[..., Column], width: int = 1) -> NDArray:
        return self.for_all(lambda *a: F.when(~self.interior(width), f(*a)).otherwise(a[-1]))

    def subarray(self, fixed: dict[int, int]) -> NDArray:
        """Without the fixed axes, at their given places."""
        rows = self.elements
        for k, at in fixed.items():
            rows = rows.where(F.col(f"i{k}") == at)
        left = [k for k in range(len(self.sizes)) if k not in fixed]
        return NDArray(rows.select(*(F.col(f"i{k}").alias(f"i{n}") for n, k in enumerate(left)), "v"), tuple(self.sizes[k] for k in left))

    def is_contiguous(self, begins: Sequence[int], ends: Sequence[int]) -> bool:
        """Whether a box is one run in storage: only its first axis of more than one place may be cut."""
        cut = False
        for k in reversed(self.order or range(len(self.sizes))):
            if cut and ends[k] - begins[k] > 1:
                return False
            cut = cut or ends[k] - begins[k] < self.sizes[k]
        return True

    def combine(self, other: NDArray, f: Callable[[Column, Column], Column]) -> NDArray:
        """f of both arrays' elements, place by place."""
        both = self.elements.join(other.elements.withColumnRenamed("v", "w"), self.axes)
        return NDArray(both.select(*self.axes, f(F.col("v"), F.col("w")).alias("v")), self.sizes, self.order)

    def reduce(self, functor: str | Functor, axes: Sequence[int] | None = None) -> DataFrame:
        """The reduction along some axes (all by default): the axes that are left, and value."""
        functor = functors.of(functor)
        left = [f"i{k}" for k in range(len(self.sizes)) if axes is not None and k not in axes]
        kind = dict(self.elements.dtypes)["v"]
        return self.elements.groupBy(*left).agg(functor.reduce(F.col("v"), kind).alias("value")) if left else self.elements.agg(functor.reduce(F.col("v"), kind).alias("value"))

    def halo(self, edges: Sequence[int], width: int = 1, periodic: Sequence[bool] | None = None) -> DataFrame:
        """(b0, ..., i0, ..., v, ghost): the elements of every block of edges places an axis, with those of its neighbours up to `width` places away.

        Along a periodic axis the first and last blocks are neighbours, and their ghosts have places
        below 0 or from the axis' size on. An element is copied at most three times an axis, so only
        what lies near a block's side moves twice.
        """
        if any(e < width for e in edges) or any(s % e and s % e < width for s, e in zip(self.sizes, edges, strict=True)):
            raise ValueError("a block must not be thinner than its neighbours' halos")
        rows, ghost = self.elements, F.lit(False)
        for k, (size, edge) in enumerate(zip(self.sizes, edges, strict=True)):
            i, wraps, last = F.col(f"i{k}"), bool(periodic and periodic[k]), -(-size // edge) - 1
            own = F.floor(i / edge)
            place = lambda b, at, g: F.struct(F.lit(b).cast("bigint").alias("b") if isinstance(b, int) else b.alias("b"), at.alias("i"), F.lit(g).alias("g"))
            below = F.when((i - own * edge < width) & (own > 0), place(own - 1, i, True))
            above = F.when((F.least((own + 1) * edge, F.lit(size)) - i <= width) & (own < last), place(own + 1, i, True))
            around = [F.when(i < width, place(last, i + size, True)), F.when(i >= size - width, place(0, i - size, True))] if wraps else []
            rows = rows.withColumn("__p", F.explode(F.array_compact(F.array(place(own, i, False), below, above, *around))))
            rows = rows.withColumns({f"b{k}": F.col("__p.b"), f"i{k}": F.col("__p.i"), f"__g{k}": F.col("__p.g")}).drop("__p")
            ghost = ghost | F.col(f"__g{k}")
        return rows.select(*(f"b{k}" for k in range(len(edges))), *self.axes, "v", ghost.alias("ghost"))

    def stencil(self, weights: dict[tuple[int, ...], float], periodic: Sequence[bool] | None = None) -> NDArray:
        """Weighted sums over neighbours at fixed offsets; places outside count as 0, or, along periodic axes, as those at the other end.

        Every element is sent to the places that it is a neighbour of, and these add up: one
        exchange with partial sums, for any number of offsets.
        """
        target = lambda k, o: F.pmod(F.col(f"i{k}") - o, F.lit(self.sizes[k])) if periodic and periodic[k] else F.col(f"i{k}") - o
        sends = F.array(*(F.struct(*(target(k, o).alias(f"i{k}") for k, o in enumerate(at)), (F.col("v") * w).alias("v")) for at, w in weights.items()))
        moved = self.elements.select(F.explode(sends).alias("s")).select("s.*").where(self.box([0] * len(self.sizes), self.sizes))
        return NDArray(moved.groupBy(*self.axes).agg(F.sum("v").alias("v")), self.sizes, self.order)


#: Element-wise operations by name: of two arrays, and of one.
BINARY = {k: M.BINARY[n] for k, n in {"add": "plus", "subtract": "minus", "multiply": "times", "divide": "divide", "maximum": "maximum", "minimum": "minimum", "pow": "pow"}.items()}
UNARY = {k: M.UNARY[n] for k, n in {"absolute": "abs", "sign": "sign", "sqrt": "sqrt", "square": "sqr"}.items()}


def apply(name: str, a: NDArray, b: NDArray | None = None) -> NDArray:
    """A named element-wise operation."""
    if b is None:
        return a.for_all(lambda *x: UNARY[name](x[-1]))
    return a.combine(b, BINARY[name])


def life_step(board: NDArray) -> NDArray:
    """One generation of the game of life over a board of 0 and 1; what lies outside is dead."""
    near = board.stencil({(i, j): 1.0 for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j})
    alive = lambda v, n: F.when((n == 3) | ((v == 1) & (n == 2)), 1).otherwise(0)
    return board.combine(near, alive)


def split_range(n: Column | int, parts: int, part: Column) -> tuple[Column, Column]:
    """Begin and end of a part of range(n): the first n mod parts parts have one more."""
    n = F.lit(n) if isinstance(n, int) else n
    each, rest = F.call_function("div", n, F.lit(parts)), n % parts
    begin = part * each + F.least(part, rest)
    return begin, begin + each + F.when(part < rest, 1).otherwise(0)


def decompose(sizes: Sequence[int], parts: Sequence[int], spark: SparkSession) -> DataFrame:
    """The blocks of a box cut into parts along each axis: block, and begin<k>, end<k> for each axis."""
    total = 1
    for p in parts:
        total *= p
    out, rest = spark.range(total).withColumnRenamed("id", "block"), F.col("block")
    for k in reversed(range(len(sizes))):
        begin, end = split_range(sizes[k], parts[k], rest % parts[k])
        out = out.withColumn(f"begin{k}", begin).withColumn(f"end{k}", end)
        rest = F.call_function("div", rest, F.lit(parts[k]))
    return out.select("block", *(f"{side}{k}" for k in range(len(sizes)) for side in ("begin", "end")))


def best_decomposition(sizes: Sequence[int], parts: int) -> tuple[int, ...]:
    """The cut of a box into parts with the least surface between blocks; ties go to the fewest cuts of the first axes."""

    def tuples(n: int, k: int) -> list[tuple[int, ...]]:
        if k == 1:
            return [(n,)]
        return [(d, *rest) for d in range(1, n + 1) if n % d == 0 for rest in tuples(n // d, k - 1)]

    def surface(cut: tuple[int, ...]) -> float:
        total = 0.0
        for k, c in enumerate(cut):
            area = 1.0
            for j, s in enumerate(sizes):
                if j != k:
                    area *= s
            total += (c - 1) * area
        return total

    return min(tuples(parts, len(sizes)), key=lambda c: (surface(c), c))


@dataclass(frozen=True)
class Grid:
    """A regular grid: cells of a box, with an origin and steps; entities of lower dimension are its vertices and faces."""

    dimensions: tuple[int, ...]
    origin: tuple[float, ...]
    steps: tuple[float, ...]

    def cells(self, spark: SparkSession) -> DataFrame:
        """(cell, i0, ..., x0, ...): cells with their coordinates and centres; the first axis is the fastest."""
        total = 1
        for s in self.dimensions:
            total *= s
        out, rest = spark.range(total).withColumnRenamed("id", "cell"), F.col("cell")
        for k, s in enumerate(self.dimensions):
            out = out.withColumn(f"i{k}", rest % s).withColumn(f"x{k}", F.lit(self.origin[k]) + (rest % s + 0.5) * self.steps[k])
            rest = F.call_function("div", rest, F.lit(s))
        return out

    def cell_index(self, *coordinates: Column) -> Column:
        out, step = F.lit(0).cast("bigint"), 1
        for c, s in zip(coordinates, self.dimensions, strict=True):
            out = out + c * step
            step *= s
        return out

    def is_boundary(self) -> Column:
        out = F.lit(False)
        for k, s in enumerate(self.dimensions):
            out = out | (F.col(f"i{k}") == 0) | (F.col(f"i{k}") == s - 1)
        return out

    def neighbours(self, spark: SparkSession) -> DataFrame:
        """(cell, neighbour) over the faces of the cells."""
        offsets = [tuple(d if j == k else 0 for j in range(len(self.dimensions))) for k in range(len(self.dimensions)) for d in (-1, 1)]
        near = []
        for at in offsets:
            inside = F.lit(True)
            for k, o in enumerate(at):
                inside = inside & (F.col(f"i{k}") + o >= 0) & (F.col(f"i{k}") + o < self.dimensions[k])
            near.append(F.when(inside, self.cell_index(*(F.col(f"i{k}") + o for k, o in enumerate(at)))))
        return self.cells(spark).select("cell", F.explode(F.array_compact(F.array(*near))).alias("neighbour"))

    def vertices(self, spark: SparkSession) -> DataFrame:
        """(vertex, x0, ...) of the corners of the cells."""
        total = 1
        for s in self.dimensions:
            total *= s + 1
        out, rest = spark.range(total).withColumnRenamed("id", "vertex"), F.col("vertex")
        for k, s in enumerate(self.dimensions):
            out = out.withColumn(f"x{k}", F.lit(self.origin[k]) + (rest % (s + 1)) * self.steps[k])
            rest = F.call_function("div", rest, F.lit(s + 1))
        return out
