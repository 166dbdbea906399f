"""Segments: groups of consecutive elements, empty ones among them, with reductions, scans, sorts and searches inside each.

A frame of segments (seg, size) names all groups; elements are (seg, loc, v) with loc from 0. Every
operator takes a scope: all segments, a half-open range of them, a list of ids (kept in order, also
where it repeats), or a condition on the id.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import functors
from ridgeline.functions.functors import Functor
from ridgeline.operators.scan import BLOCK, scan
from ridgeline.operators.sorting import numbered

#: Elements of a segment up to which one task sorts it.
HOT = 1 << 20


@dataclass(frozen=True)
class Scope:
    """Which segments an operator works on."""

    between: tuple[int | None, int | None] = (None, None)
    ids: Sequence[int] | None = None
    where: Callable[[Column], Column] | None = None

    def condition(self, seg: Column) -> Column:
        begin, end = self.between
        out = F.lit(True)
        if begin is not None:
            out = out & (seg >= begin)
        if end is not None:
            out = out & (seg < end)
        if self.ids is not None:
            out = out & seg.isin(list(self.ids))
        if self.where is not None:
            out = out & self.where(seg)
        return out


EVERY = Scope()


def from_keys(rows: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Elements (seg, loc, v) of rows: the key names the segment, and loc follows the order, which must be total inside a key."""
    loc = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return rows.select(F.col(key).alias("seg"), loc.cast("bigint").alias("loc"), F.col(value).alias("v"))


@dataclass(frozen=True)
class Segments:
    """segments (seg, size) with dense seg, and elements (seg, loc, v)."""

    segments: DataFrame
    elements: DataFrame

    @classmethod
    def of(cls, ids: DataFrame, elements: DataFrame, seg: str = "seg") -> Segments:
        """From all ids and the elements; ids without elements are empty segments."""
        sizes = elements.groupBy("seg").agg(F.count(F.lit(1)).alias("size"))
        return cls(ids.select(F.col(seg).alias("seg")).join(sizes, "seg", "left").select("seg", F.coalesce("size", F.lit(0)).cast("bigint").alias("size")), elements)

    def offsets(self) -> DataFrame:
        """(seg, size, offset): where each segment starts in the common storage."""
        out = scan(self.segments, "plus", exclusive=True, index="seg", value="size")
        return out.withColumnRenamed("scan", "offset")

    def with_global_index(self) -> DataFrame:
        """The elements with gid, their place in the common storage."""
        return self.elements.join(self.offsets().select("seg", "offset"), "seg").withColumn("gid", F.col("offset") + F.col("loc")).drop("offset")

    def _scoped(self, scope: Scope) -> tuple[DataFrame, DataFrame]:
        keep = scope.condition(F.col("seg"))
        return self.segments.where(keep), self.elements.where(keep)

    def _placed(self, result: DataFrame, scope: Scope) -> DataFrame:
        """For a list of ids: a row for each place in the list, with pos."""
        if scope.ids is None:
            return result
        places = F.explode(F.transform(F.filter(F.sequence(F.lit(0), F.lit(len(scope.ids) - 1)), lambda p: F.element_at(F.array(*map(F.lit, scope.ids)), p + 1) == F.col("seg")), lambda p: p.cast("bigint")))
        return result.select(places.alias("pos"), *result.columns) if scope.ids else result.select(F.lit(0).cast("bigint").alias("pos"), *result.columns)

    def reduce(self, functor: str | Functor, fetch: Callable[[Column, Column, Column], Column] | None = None, scope: Scope = EVERY, kind: str = "double") -> DataFrame:
        """(seg, value): the reduction of fetch(seg, loc, v); empty segments have the identity."""
        functor = functors.of(functor)
        names, rows = self._scoped(scope)
        value = fetch(F.col("seg"), F.col("loc"), F.col("v")) if fetch else F.col("v")
        partial = rows.groupBy("seg").agg(functor.aggregate(value).cast(kind).alias("value"))
        out = names.select("seg").join(partial, "seg", "left").select("seg", F.coalesce("value", functor.over_nothing(kind)).alias("value"))
        return self._placed(out, scope)

    def reduce_with_argument(self, kind: str = "max", fetch: Callable[[Column, Column, Column], Column] | None = None, scope: Scope = EVERY) -> DataFrame:
        """(seg, value, loc, empty): the extreme element and its place, the first one where several tie."""
        names, rows = self._scoped(scope)
        value = fetch(F.col("seg"), F.col("loc"), F.col("v")) if fetch else F.col("v")
        found = rows.groupBy("seg").agg(functors.argument(value, F.col("loc"), kind).alias("r"))
        out = names.select("seg").join(found, "seg", "left").select("seg", F.col("r.value").alias("value"), F.col("r.index").alias("loc"), F.col("r").isNull().alias("empty"))
        return self._placed(out, scope)

    def reduce_all(self, functor: str | Functor, fetch: Callable[[Column, Column, Column], Column] | None = None, scope: Scope = EVERY) -> DataFrame:
        """One row: the reduction over the elements of all segments in the scope."""
        _, rows = self._scoped(scope)
        value = fetch(F.col("seg"), F.col("loc"), F.col("v")) if fetch else F.col("v")
        got = rows.select(value.alias("value"))
        return got.agg(functors.of(functor).reduce(F.col("value"), got.dtypes[0][1]).alias("value"))

    def scan(self, functor: str | Functor = "plus", exclusive: bool = False, scope: Scope = EVERY) -> DataFrame:
        """(seg, loc, v, scan) of the segments in the scope.

        A segment is scanned in blocks of BLOCK places, each by itself; only segments of more than one
        block need what their blocks hold before them.
        """
        functor = functors.of(functor)
        _, rows = self._scoped(scope)
        kind = dict(rows.agg(functor.aggregate(F.col("v")).alias("v")).dtypes)["v"]
        rows = rows.withColumn("__block", F.floor(F.col("loc") / BLOCK))
        upto = lambda *keys, last: Window.partitionBy("seg", *keys).orderBy("loc" if keys else "__block").rowsBetween(Window.unboundedPreceding, last)
        wide = rows.where("__block > 0").select("seg").distinct()
        totals = rows.join(wide, "seg", "left_semi").groupBy("seg", "__block").agg(functor.aggregate(F.col("v")).alias("__total"))
        before = totals.select("seg", "__block", functor.aggregate(F.col("__total")).over(upto(last=-1)).alias("__before"))
        local = F.coalesce(functor.aggregate(F.col("v")).over(upto("__block", last=-1 if exclusive else Window.currentRow)), functor.over_nothing(kind))
        out = rows.withColumn("__local", local).join(before, ["seg", "__block"], "left")
        value = F.when(F.col("__before").isNull(), F.col("__local")).otherwise(functor.combine(F.col("__before"), F.col("__local")))
        return out.select("seg", "loc", "v", value.alias("scan"))

    def sort(self, key: Callable[[Column], Column] = lambda v: v, descending: bool = False, scope: Scope = EVERY) -> DataFrame:
        """(seg, loc, v): elements in the order of their key, ties in their old order; segments outside the scope keep theirs.

        A segment is sorted in one task unless it has more than HOT elements; those are sorted together
        by a range exchange on (seg, key), which cuts a segment where it must.
        """
        by = F.desc("__key") if descending else F.asc("__key")
        place = F.row_number().over(Window.partitionBy("seg").orderBy(by, "loc")) - 1
        rows = self.elements.withColumn("__key", key(F.col("v")))
        small = lambda r: r.withColumn("loc", F.when(scope.condition(F.col("seg")), place.cast("bigint")).otherwise(F.col("loc"))).select("seg", "loc", "v")
        hot = self.elements.where(scope.condition(F.col("seg")) & (F.col("loc") >= HOT)).select("seg").distinct()
        if not hot.take(1):
            return small(rows)
        large = numbered(rows.join(hot, "seg", "left_semi"), "__place", F.asc("seg"), by, F.asc("loc"))
        first = large.groupBy("seg").agg(F.min("__place").alias("__first"))
        cut = large.join(first, "seg").select("seg", (F.col("__place") - F.col("__first")).alias("loc"), "v")
        return small(rows.join(hot, "seg", "left_anti")).unionByName(cut)

    def find(self, condition: Callable[[Column, Column, Column], Column], scope: Scope = EVERY) -> DataFrame:
        """(seg, found, loc): the first element of each segment for which the condition holds."""
        names, rows = self._scoped(scope)
        hits = rows.where(condition(F.col("seg"), F.col("loc"), F.col("v"))).groupBy("seg").agg(F.min("loc").alias("loc"))
        out = names.select("seg").join(hits, "seg", "left").select("seg", F.col("loc").isNotNull().alias("found"), "loc")
        return self._placed(out, scope)

    def for_elements(self, f: Callable[[Column, Column, Column], Column], scope: Scope = EVERY) -> DataFrame:
        """(seg, loc, v): v becomes f(seg, loc, v) in the scope."""
        new = f(F.col("seg"), F.col("loc"), F.col("v"))
        return self.elements.withColumn("v", F.when(scope.condition(F.col("seg")), new).otherwise(F.col("v")))

    def for_segments(self, f: Callable[[Column], Column], scope: Scope = EVERY) -> DataFrame:
        """(seg, value): f of each segment's values as an array in order; empty segments give f of an empty array.

        f sees a segment whole, so each segment in the scope must fit a row (2 GB); reductions, scans and
        sorts have no such bound.
        """
        names, rows = self._scoped(scope)
        lists = rows.groupBy("seg").agg(F.array_sort(F.collect_list(F.struct("loc", "v"))).alias("pairs"))
        kind = dict(rows.dtypes)["v"]
        values = F.coalesce(F.transform("pairs", lambda p: p["v"]), F.array().cast(f"array<{kind}>"))
        return self._placed(names.select("seg").join(lists, "seg", "left").select("seg", f(values).alias("value")), scope)

    def append(self, rows: DataFrame) -> Segments:
        """With rows (seg, order, v) put behind the elements of their segments, in their order."""
        place = F.row_number().over(Window.partitionBy("seg").orderBy("order")) - 1
        more = rows.withColumn("n", place).join(self.segments, "seg").select("seg", (F.col("size") + F.col("n")).cast("bigint").alias("loc"), "v")
        return Segments.of(self.segments, self.elements.unionByName(more))

    def remove(self, condition: Callable[[Column, Column, Column], Column]) -> Segments:
        """Without the elements for which the condition holds; the others close up."""
        left = self.elements.where(~condition(F.col("seg"), F.col("loc"), F.col("v")))
        place = F.row_number().over(Window.partitionBy("seg").orderBy("loc")) - 1
        return Segments.of(self.segments, left.withColumn("loc", place.cast("bigint")))

    def by_size(self) -> DataFrame:
        """(seg, size, rank): segments by falling size, ties by id; a range exchange, no single task."""
        return numbered(self.segments, "rank", F.desc("size"), F.asc("seg"))
