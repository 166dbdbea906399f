"""Graphs as vertices (v) and arcs (src, dst, w), with traversals that iterate joins to a fixpoint.

An undirected graph stores both arcs of an edge (a loop once). Iterations write each state to the
shared folder, so their lineage stays short and lost executors cost one step.

A traversal of at most SMALL_ARCS arcs, counted first, runs in one task. Beyond it every step exchanges
what the frontier reaches and no more: arcs lie in buckets by source, and the distances found so far
in a few tables in buckets by vertex, each at least twice as large as the next. A step joins the
frontier with the arcs, drops the offers that one of these tables betters, and adds the rest as a
new table; neighbours of like size are merged. All these joins merge tables sorted by vertex: a table
that is small as a file may be large in memory, and a broadcast in each step would pass the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import functors
from ridgeline.functions.functors import Functor
from ridgeline.operators.components import components
from ridgeline.operators.segments import EVERY, Scope
from ridgeline.session import Workspace

#: Arcs (and sources) of a traversal that runs in one task; 24 bytes each.
SMALL_ARCS = 1 << 20


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    arcs: DataFrame
    directed: bool = True

    @classmethod
    def of(cls, edges: DataFrame, vertices: DataFrame | None = None, directed: bool = True, order: str | None = None) -> Graph:
        """From edges (src, dst[, w]); weight 1 by default. Of edges that repeat the first in `order` counts (without it the lightest)."""
        w = F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)
        rows = edges.withColumn("w", w)
        if not directed:
            rows = rows.unionByName(rows.where("src != dst").withColumns({"src": F.col("dst"), "dst": F.col("src")}))
        first = F.min_by("w", order) if order else F.min("w")
        arcs = rows.groupBy("src", "dst").agg(first.alias("w"))
        if vertices is None:
            most = arcs.agg(F.max(F.greatest("src", "dst"))).first()[0]
            vertices = edges.sparkSession.range(0 if most is None else most + 1).select(F.col("id").alias("v"))
        return cls(vertices.select("v"), arcs, directed)

    # Counts and weights.

    def edge_count(self) -> DataFrame:
        """One row: arcs with a weight other than 0; of an undirected graph each edge once."""
        stored = self.arcs.where("w != 0")
        if self.directed:
            return stored.agg(F.count(F.lit(1)).alias("value"))
        return stored.agg(F.count_if(F.col("src") <= F.col("dst")).alias("value"))

    def total_weight(self) -> DataFrame:
        """One row: the sum of the arcs' weights, halved for an undirected graph."""
        return self.arcs.agg((F.coalesce(F.sum("w"), F.lit(0.0)) * (1.0 if self.directed else 0.5)).alias("value"))

    def degrees(self) -> DataFrame:
        """(v, degree): the number of arcs that leave each vertex."""
        counts = self.arcs.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("degree"))
        return self.vertices.join(counts, "v", "left").select("v", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))

    def edge_weight(self, src: int, dst: int) -> DataFrame:
        return self.arcs.where((F.col("src") == src) & (F.col("dst") == dst)).agg(F.coalesce(F.max("w"), F.lit(0.0)).alias("value"))

    def reduce_vertices(self, functor: str | Functor, fetch: Callable[[Column, Column, Column], Column] | None = None, scope: Scope = EVERY, kind: str = "double") -> DataFrame:
        """(v, value): the reduction of fetch(src, dst, w) over the arcs that leave each vertex; without any the identity."""
        functor = functors.of(functor)
        value = fetch(F.col("src"), F.col("dst"), F.col("w")) if fetch else F.col("w")
        found = self.arcs.where(scope.condition(F.col("src"))).groupBy(F.col("src").alias("v")).agg(functor.aggregate(value).cast(kind).alias("value"))
        return self.vertices.where(scope.condition(F.col("v"))).join(found, "v", "left").select("v", F.coalesce("value", functor.over_nothing(kind)).alias("value"))

    def reduce_vertices_with_argument(self, kind: str = "max", scope: Scope = EVERY) -> DataFrame:
        """(v, value, dst): the extreme arc that leaves each vertex, to the least vertex where several tie."""
        found = self.arcs.where(scope.condition(F.col("src"))).groupBy(F.col("src").alias("v")).agg(functors.argument(F.col("w"), F.col("dst"), kind).alias("r"))
        return self.vertices.where(scope.condition(F.col("v"))).join(found, "v", "left").select("v", F.col("r.value").alias("value"), F.col("r.index").alias("dst"))

    def for_edges(self, f: Callable[[Column, Column, Column], Column], scope: Scope = EVERY) -> Graph:
        new = f(F.col("src"), F.col("dst"), F.col("w"))
        return Graph(self.vertices, self.arcs.withColumn("w", F.when(scope.condition(F.col("src")), new).otherwise(F.col("w"))), self.directed)

    def for_vertices(self, f: Callable[[Column, Column], Column], scope: Scope = EVERY) -> DataFrame:
        """(v, value): f(v, degree) of every vertex in scope."""
        return self.degrees().where(scope.condition(F.col("v"))).select("v", f(F.col("v"), F.col("degree")).alias("value"))

    def set_edge_weights(self, edges: DataFrame) -> Graph:
        """The graph with the weights of edges (src, dst, w), of which the last to be given must be the only one; new edges are added.

        In an undirected graph both arcs of an edge get the weight.
        """
        new = Graph.of(edges, self.vertices, self.directed).arcs.withColumnRenamed("w", "__w")
        arcs = self.arcs.join(new, ["src", "dst"], "full").select("src", "dst", F.coalesce("__w", "w").alias("w"))
        return Graph(self.vertices, arcs, self.directed)

    def equals(self, other: Graph) -> DataFrame:
        """One row: whether both have the same vertices, and arcs of the same weights (of which those of weight 0 count as none)."""
        kind = F.lit(self.directed == other.directed)
        v = self.vertices.select("v", F.lit(1).alias("a")).join(other.vertices.select("v", F.lit(1).alias("b")), "v", "full").where("a is null or b is null")
        e = self.arcs.where("w != 0").join(other.arcs.where("w != 0").withColumnRenamed("w", "x"), ["src", "dst"], "full").where("not (w <=> x)")
        odd = v.select(F.lit(1)).unionByName(e.select(F.lit(1)))
        return odd.agg(((F.count(F.lit(1)) == 0) & kind).alias("value"))

    # Traversals.

    def distances(self, sources: list[int] | DataFrame, weighted: bool) -> DataFrame:
        """(v, dist): the least sum of weights (or number of arcs) from any source; -1 where none reaches.

        sources: vertices, or a frame (v) of them; those that are no vertices of the graph count for
        nothing. A cycle of negative weight that a source reaches is an error.
        """
        spark = self.vertices.sparkSession
        work, results = Workspace(spark, "distances"), Workspace(spark, "distances")
        kind = "double" if weighted else "bigint"
        given = sources.select("v") if isinstance(sources, DataFrame) else self.vertices.where(F.col("v").isin(list(sources)))
        start = given.join(self.vertices, "v", "left_semi").distinct() if isinstance(sources, DataFrame) else given.distinct()
        both = self.arcs.select("src", "dst", (F.col("w") if weighted else F.lit(1)).cast(kind).alias("step"))
        both = both.unionByName(start.select(F.col("v").alias("src"), F.lit(None).cast("bigint").alias("dst"), F.lit(0).cast(kind).alias("step")))
        held, seen = work.measured(both, n=F.count(F.lit(1)))
        if seen["n"] <= SMALL_ARCS:
            found = results.write(held.coalesce(1).mapInArrow(_relaxed(weighted), f"v bigint, dist {kind}"))
        else:
            found = results.write(_distances_by_frontier(held, kind, work))
        work.close()
        return self.vertices.join(found.hint("merge"), "v", "left").select("v", F.coalesce("dist", F.lit(-1).cast(kind)).alias("dist"))

    def breadth_first(self, source: int, visitor: Callable[[Column, Column], Column] | None = None) -> DataFrame:
        """(v, dist): the number of arcs from the source; -1 where none leads. With a visitor, (v, dist, value) of the vertices reached but the source."""
        found = self.distances([source], False)
        return found if visitor is None else found.where("dist > 0").withColumn("value", visitor(F.col("v"), F.col("dist")))

    def shortest_paths(self, source: int) -> DataFrame:
        return self.distances([source], True)

    def semiring_distances(self, source: int, steps: int, weighted: bool = True) -> DataFrame:
        """(v, dist): the least sum of weights over paths of at most `steps` arcs, as that many products of vector and matrix in (min, +); -1 where there is none."""
        kind = "double" if weighted else "bigint"
        work = Workspace(self.vertices.sparkSession, "semiring")
        arcs = self.arcs.select(F.col("src").alias("v"), "dst", (F.col("w") if weighted else F.lit(1)).cast(kind).alias("step"))
        x = self.vertices.where(F.col("v") == source).select("v", F.lit(0).cast(kind).alias("dist"))
        for _ in range(steps):
            moved = x.join(arcs, "v").select(F.col("dst").alias("v"), (F.col("dist") + F.col("step")).alias("dist"))
            x = work.write(x.unionByName(moved).groupBy("v").agg(F.min("dist").alias("dist")))
        return self.vertices.join(x, "v", "left").select("v", F.coalesce("dist", F.lit(-1).cast(kind)).alias("dist"))

    def components(self) -> DataFrame:
        """(v, component): the least vertex that each is connected with, whichever way arcs point."""
        work = Workspace(self.vertices.sparkSession, "components")
        found = components(self.arcs.select(F.col("src").alias("a"), F.col("dst").alias("b")), work)
        return self.vertices.join(found.withColumnRenamed("id", "v"), "v", "left").select("v", F.coalesce("component", "v").alias("component"))

    def _edges(self) -> DataFrame:
        """Each undirected edge once; loops are edges."""
        return self.arcs.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "w").groupBy("a", "b").agg(F.min("w").alias("w"))

    def is_forest(self, roots: DataFrame | None = None) -> DataFrame:
        """One row: whether the graph has no cycle: as many edges as vertices without components.

        With roots (v), also whether every component holds one of them.
        """
        n = self.vertices.agg(F.count(F.lit(1)).alias("n"))
        parts = self.components()
        if roots is not None:
            parts = parts.join(roots.select("v", F.lit(1).alias("root")).distinct(), "v", "left")
        held = parts.groupBy("component").agg(F.count("root").alias("roots") if roots is not None else F.lit(1).alias("roots"))
        trees = held.agg(F.count(F.lit(1)).alias("trees"), F.coalesce(F.bool_and(F.col("roots") >= 1), F.lit(True)).alias("rooted"))
        edges = self._edges().agg(F.count(F.lit(1)).alias("edges"))
        return n.join(trees).join(edges).select(((F.col("edges") == F.col("n") - F.col("trees")) & F.col("rooted")).alias("value"))

    def is_tree(self) -> DataFrame:
        """One row: whether the graph is a forest of one tree; the empty graph is one."""
        n = self.vertices.agg(F.count(F.lit(1)).alias("n"))
        trees = self.components().agg(F.count_distinct("component").alias("trees"))
        edges = self._edges().agg(F.count(F.lit(1)).alias("edges"))
        return n.join(trees).join(edges).select(((F.col("edges") == F.col("n") - F.col("trees")) & (F.col("trees") <= 1)).alias("value"))

    def minimum_spanning_forest(self) -> DataFrame:
        """(a, b, w) of a minimum spanning forest: Boruvka's steps, ties broken by (w, a, b).

        Each step gives every component its lightest edge out; the chosen edges join components. At most
        SMALL_ARCS edges are taken by rising weight in one task instead, which gives the same forest.
        """
        spark = self.vertices.sparkSession
        work = Workspace(spark, "forest")
        edges, seen = work.measured(self._edges().where("a != b").withColumns({"ca": F.col("a"), "cb": F.col("b")}), n=F.count(F.lit(1)))
        if seen["n"] <= SMALL_ARCS:
            return edges.select("a", "b", "w").coalesce(1).mapInArrow(_lightest, "a bigint, b bigint, w double")
        chosen: list[DataFrame] = []
        while seen["n"]:
            ends = edges.select("a", "b", "w", F.explode(F.array("ca", "cb")).alias("c"))
            picked = work.write(ends.groupBy("c").agg(F.min(F.struct("w", "a", "b")).alias("e")).select("e.*").distinct())
            chosen.append(picked)
            joined = edges.join(picked.select("a", "b"), ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
            names = work.write(components(joined, work))
            out = edges
            for side in ("ca", "cb"):
                out = out.join(names.select(F.col("id").alias(side), F.col("component").alias("__new")), side, "left").withColumn(side, F.coalesce("__new", side)).drop("__new")
            after, seen = work.measured(out.where("ca != cb").select("a", "b", "w", "ca", "cb"), n=F.count(F.lit(1)))
            work.drop(edges)
            edges = after
        if not chosen:
            return edges.select("a", "b", "w")
        out = chosen[0]
        for c in chosen[1:]:
            out = out.unionByName(c)
        return out.select("a", "b", "w").distinct()


def _relaxed(weighted: bool):
    """Least distances over all arcs (src, dst, step) of one task; rows without dst are the sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        rows = pa.Table.from_batches(parts).combine_chunks() if parts else None
        if rows is None or not rows.num_rows:
            return
        source = rows["dst"].is_null().to_numpy()
        src, step = rows["src"].to_numpy(), rows["step"].to_numpy()
        dst = rows["dst"].fill_null(0).to_numpy()
        names, place = np.unique(np.concatenate((src, dst[~source])), return_inverse=True)
        start, tail, head, step = place[: len(src)][source], place[: len(src)][~source], place[len(src) :], step[~source]
        order = np.argsort(tail, kind="stable")
        tail, head, step = tail[order], head[order], step[order]
        first = np.searchsorted(tail, np.arange(len(names) + 1))
        none = np.inf if weighted else np.iinfo(np.int64).max
        dist = np.full(len(names), none)
        dist[start] = 0
        fresh = np.unique(start)
        for _ in range(len(names) + 1):
            if not len(fresh):
                break
            size = first[fresh + 1] - first[fresh]
            arc = np.arange(size.sum()) + np.repeat(first[fresh] - (np.cumsum(size) - size), size)
            offer = np.repeat(dist[fresh], size) + step[arc]
            better = offer < dist[head[arc]]
            arc, offer = arc[better], offer[better]
            np.minimum.at(dist, head[arc], offer)
            fresh = np.unique(head[arc])
        else:
            raise ValueError("the graph has a cycle of negative weight")
        reached = dist != none
        yield pa.RecordBatch.from_arrays([pa.array(names[reached]), pa.array(dist[reached])], ["v", "dist"])

    return run


def _lightest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (a, b, w) of one task that join two parts of the forest of all edges before them, by (w, a, b)."""
    parts = list(batches)
    if not parts:
        return
    rows = pa.Table.from_batches(parts).sort_by([("w", "ascending"), ("a", "ascending"), ("b", "ascending")]).combine_chunks()
    names, place = np.unique(np.concatenate((rows["a"].to_numpy(), rows["b"].to_numpy())), return_inverse=True)
    above = list(range(len(names)))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    kept = np.zeros(rows.num_rows, bool)
    for k, (x, y) in enumerate(place.reshape(2, -1).T.tolist()):
        x, y = top(x), top(y)
        if x != y:
            above[x], kept[k] = y, True
    yield from rows.filter(pa.array(kept)).to_batches()


def _distances_by_frontier(held: DataFrame, kind: str, work: Workspace) -> DataFrame:
    """(v, dist) of all vertices reached, over arcs and sources (src, dst, step) of any number."""
    n = F.count(F.lit(1))
    arcs, _ = work.bucketed(held.where("dst is not null").select(F.col("src").alias("v"), "dst", "step"), "v")
    fresh, seen = work.bucketed(held.where("dst is null").select(F.col("src").alias("v"), F.col("step").alias("dist")).distinct(), "v", n=n)
    levels, sizes = [fresh], [seen["n"]]  # the newest last
    vertices, steps = 0, 0
    while seen["n"]:
        offers = fresh.join(arcs.hint("merge"), "v").groupBy(F.col("dst").alias("v")).agg(F.min(F.col("dist") + F.col("step")).cast(kind).alias("dist"))
        for level in reversed(levels):
            known = level.select(F.col("v").alias("kv"), F.col("dist").alias("kd"))
            offers = offers.join(known.hint("merge"), (F.col("v") == F.col("kv")) & (F.col("kd") <= F.col("dist")), "left_anti")
        fresh, seen = work.bucketed(offers, "v", n=n)
        steps += 1
        if steps >= 8 and steps & (steps - 1) == 0:  # a shortest path has fewer arcs than there are vertices
            vertices = vertices or 2 * held.agg(F.approx_count_distinct(F.coalesce("dst", "src"), 0.02)).first()[0]
            if steps > vertices:
                raise ValueError("the graph has a cycle of negative weight")
        size, merged = seen["n"], [fresh]
        while size and sizes and sizes[-1] <= 2 * size:
            size += sizes.pop()
            merged.append(levels.pop())
        if len(merged) > 1:
            levels.append(work.bucketed(work.plain(*merged).groupBy("v").agg(F.min("dist").alias("dist")), "v")[0])
            work.drop(*merged[1:])
        elif size:
            levels.append(fresh)
        if size:
            sizes.append(size)
    return work.plain(*levels).groupBy("v").agg(F.min("dist").alias("dist"))


def random_graph(spark, n: int, degree: int, seed: int = 0) -> DataFrame:
    """Edges (src, dst, w) of a random directed graph: `degree` targets a vertex, from hashes of its number."""
    arcs = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(degree - 1))).alias("k"))
    arcs = arcs.withColumn("dst", F.pmod(F.xxhash64("src", "k", F.lit(seed)), F.lit(n)))
    return arcs.select("src", "dst", (F.pmod(F.xxhash64("dst", "k", F.lit(seed + 1)), F.lit(1000)) / 100 + 0.01).alias("w")).where("src != dst")
