"""Unstructured meshes: points (pid, x, y, z) and cells (cid, shape, points), with incidence and geometry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import math as M
from ridgeline.operators.graph import Graph
from ridgeline.operators.scan import row_numbers
from ridgeline.operators.sorting import numbered
from ridgeline.session import Workspace

#: Faces of each shape as local points, outward where the shape's points are in the usual file order.
FACES: dict[str, tuple[tuple[int, ...], ...]] = {
    "edge": ((0,), (1,)),
    "triangle": ((0, 1), (1, 2), (2, 0)),
    "quadrangle": ((0, 1), (1, 2), (2, 3), (3, 0)),
    "tetrahedron": ((0, 2, 1), (0, 1, 3), (1, 2, 3), (0, 3, 2)),
    "hexahedron": ((0, 3, 2, 1), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7)),
    "wedge": ((0, 1, 2), (3, 5, 4), (0, 3, 4, 1), (1, 4, 5, 2), (2, 5, 3, 0)),
    "pyramid": ((0, 3, 2, 1), (0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4)),
}
#: Simplices that a shape is cut into, as local points.
SIMPLICES: dict[str, tuple[tuple[int, ...], ...]] = {
    "triangle": ((0, 1, 2),),
    "quadrangle": ((0, 1, 2), (0, 2, 3)),
    "tetrahedron": ((0, 1, 2, 3),),
    "pyramid": ((0, 1, 2, 4), (0, 2, 3, 4)),
    "wedge": ((0, 1, 2, 3), (1, 2, 3, 4), (2, 3, 4, 5)),
    "hexahedron": ((0, 1, 2, 6), (0, 2, 3, 6), (0, 3, 7, 6), (0, 7, 4, 6), (0, 4, 5, 6), (0, 5, 1, 6)),
}


def _lattice(dimension: int) -> tuple[tuple[tuple[int, ...], ...], ...]:
    """The halves of an edge, quadrangle or hexahedron along each axis: for each part its corners, each as the old corners whose middle it is."""
    places = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)][: 1 << dimension]
    middle = lambda at: tuple(k for k, p in enumerate(places) if all(a == 1 or a == 2 * x for a, x in zip(at, p, strict=True)))
    flat = lambda at: tuple(a if k < dimension else 0 for k, a in enumerate(at))
    return tuple(tuple(middle(flat(tuple(s + c for s, c in zip(start, corner, strict=True)))) for corner in places) for start in places)


#: Parts that a shape is refined into, by the old corners whose middle each new corner is.
REFINED: dict[str, tuple[tuple[tuple[int, ...], ...], ...]] = {
    "edge": _lattice(1),
    "quadrangle": _lattice(2),
    "hexahedron": _lattice(3),
    "triangle": (((0,), (0, 1), (0, 2)), ((0, 1), (1,), (1, 2)), ((0, 2), (1, 2), (2,)), ((0, 1), (1, 2), (0, 2))),
    # Four corners, and the inner octahedron cut along one diagonal.
    "tetrahedron": (
        ((0,), (0, 1), (0, 2), (0, 3)), ((0, 1), (1,), (1, 2), (1, 3)), ((0, 2), (1, 2), (2,), (2, 3)), ((0, 3), (1, 3), (2, 3), (3,)),
        ((0, 1), (0, 2), (0, 3), (1, 3)), ((0, 1), (0, 2), (1, 2), (1, 3)), ((0, 2), (0, 3), (1, 3), (2, 3)), ((0, 2), (1, 2), (1, 3), (2, 3)),
    ),
}


def _fan(points: Column) -> Column:
    """The triangles of a convex polygon that share its first point."""
    return F.transform(F.sequence(F.lit(1), F.size(points) - 2), lambda k: F.array(points[0], F.element_at(points, k + 1), F.element_at(points, k + 2)))


def _by_shape(table: dict[str, tuple[tuple[int, ...], ...]], points: Column, polygon: Column | None = None) -> Column:
    """For each row the point tuples of its shape; a polygon's are its sides, if no others are given."""
    sides = F.transform(F.sequence(F.lit(0), F.size(points) - 1), lambda k: F.array(F.element_at(points, k + 1), F.element_at(points, (k + 1) % F.size(points) + 1)))
    out = F.when(F.col("shape") == "polygon", sides if polygon is None else polygon)
    for shape, parts in table.items():
        out = out.when(F.col("shape") == shape, F.array(*(F.array(*(F.element_at(points, p + 1) for p in part)) for part in parts)))
    return out


@dataclass(frozen=True)
class Mesh:
    points: DataFrame
    cells: DataFrame

    def cell_points(self) -> DataFrame:
        """(cid, loc, pid)."""
        return self.cells.select("cid", F.posexplode("points").alias("loc", "pid"))

    def cell_faces(self) -> DataFrame:
        """(cid, loc, key, points): each cell's faces; equal keys are the same face."""
        rows = self.cells.select("cid", F.posexplode(_by_shape(FACES, F.col("points"))).alias("loc", "face"))
        return rows.select("cid", "loc", F.array_sort("face").alias("key"), F.col("face").alias("points"))

    def faces(self) -> DataFrame:
        """(fid, key, cells, boundary): each face once, numbered by its first cell and place; a boundary face has one cell."""
        once = self.cell_faces().groupBy("key").agg(F.min(F.struct("cid", "loc")).alias("first"), F.sort_array(F.collect_list("cid")).alias("cells"))
        placed = once.select("key", "cells", F.col("first.cid").alias("cid"), F.col("first.loc").alias("loc"))
        return numbered(placed, "fid", F.asc("cid"), F.asc("loc")).select("fid", "key", "cells", (F.size("cells") == 1).alias("boundary"))

    def neighbours(self) -> DataFrame:
        """(cid, neighbour) over common faces, both ways: the dual graph."""
        pair = self.cell_faces().select("cid", "key")
        cells = pair.groupBy("key").agg(F.collect_list("cid").alias("cells")).where(F.size("cells") == 2)
        ends = F.array(F.struct(F.col("cells")[0].alias("cid"), F.col("cells")[1].alias("neighbour")), F.struct(F.col("cells")[1].alias("cid"), F.col("cells")[0].alias("neighbour")))
        return cells.select(F.explode(ends).alias("e")).select("e.cid", "e.neighbour")

    def boundary_cells(self) -> DataFrame:
        """(cid) of the cells with a boundary face."""
        return self.faces().where("boundary").select(F.col("cells")[0].alias("cid")).distinct()

    def counts(self) -> DataFrame:
        """One row: points, cells, faces and boundary faces."""
        faces = self.faces().agg(F.count(F.lit(1)).alias("faces"), F.count_if("boundary").alias("boundary_faces"))
        points = self.points.agg(F.count(F.lit(1)).alias("points"))
        return points.join(self.cells.agg(F.count(F.lit(1)).alias("cells"))).join(faces)

    def with_coordinates(self) -> DataFrame:
        """(cid, shape, xyz): cells with their points' coordinates in order."""
        rows = self.cells.select("cid", "shape", F.posexplode("points").alias("loc", "pid")).join(self.points, "pid")
        lists = rows.groupBy("cid", "shape").agg(F.array_sort(F.collect_list(F.struct("loc", "x", "y", "z"))).alias("all"))
        return lists.select("cid", "shape", F.transform("all", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"))).alias("xyz"))

    def centers(self) -> DataFrame:
        """(cid, x, y, z): means of the cells' points."""
        return self.cell_points().join(self.points, "pid").groupBy("cid").agg(*(F.avg(c).alias(c) for c in "xyz"))

    def measures(self) -> DataFrame:
        """(cid, measure): lengths, areas or volumes, from the simplices of each shape; of a polygon in a plane of constant z by the shoelace sum."""
        at = self.with_coordinates()
        p = lambda k: [F.element_at("xyz", k + 1)[c] for c in "xyz"]
        value = F.when(F.col("shape") == "edge", M.norm([b - a for a, b in zip(p(0), p(1), strict=True)]))
        for shape, parts in SIMPLICES.items():
            total = F.lit(0.0)
            for part in parts:
                total = total + (M.triangle_area(p(part[0]), p(part[1]), p(part[2])) if len(part) == 3 else tetrahedron_volume(*(p(k) for k in part)))
            value = value.when(F.col("shape") == shape, total)
        shoelace = F.aggregate(F.sequence(F.lit(0), F.size("xyz") - 1), F.lit(0.0), lambda acc, k: acc + F.element_at("xyz", k + 1)["x"] * F.element_at("xyz", (k + 1) % F.size("xyz") + 1)["y"] - F.element_at("xyz", (k + 1) % F.size("xyz") + 1)["x"] * F.element_at("xyz", k + 1)["y"])
        return at.select("cid", value.when(F.col("shape") == "polygon", F.abs(shoelace) / 2).alias("measure"))

    def circumradii(self) -> DataFrame:
        """(cid, radius) of the circles or spheres around edges, triangles and tetrahedra."""
        at = self.with_coordinates()
        p = lambda k: [F.element_at("xyz", k + 1)[c] for c in "xyz"]
        side = lambda i, j: M.norm([b - a for a, b in zip(p(i), p(j), strict=True)])
        triangle = side(0, 1) * side(1, 2) * side(2, 0) / (4 * M.triangle_area(p(0), p(1), p(2)))
        # Of a tetrahedron: from the products of its opposite edges.
        a, b, c = side(0, 1) * side(2, 3), side(0, 2) * side(1, 3), side(0, 3) * side(1, 2)
        tetrahedron = F.sqrt((a + b + c) * (a + b - c) * (a - b + c) * (-a + b + c)) / (24 * tetrahedron_volume(p(0), p(1), p(2), p(3)))
        return at.select("cid", F.when(F.col("shape") == "edge", side(0, 1) / 2).when(F.col("shape") == "triangle", triangle).when(F.col("shape") == "tetrahedron", tetrahedron).alias("radius"))

    def outward_normals(self) -> DataFrame:
        """(cid, loc, x, y, z): unit normals of the cells' faces that point away from the cells' centres; of the sides of flat cells in their z-plane."""
        faces = self.cell_faces().select("cid", "loc", "points")
        corners = faces.select("cid", "loc", F.size("points").alias("n"), F.posexplode("points").alias("k", "pid")).where("k < 3").join(self.points, "pid")
        pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
        rows = corners.groupBy("cid", "loc", "n").agg(*(pick(k, c).alias(f"{c}{k}") for k in range(3) for c in "xyz")).join(self.centers().select("cid", *(F.col(c).alias(f"{c}m") for c in "xyz")), "cid")
        u = [F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"]
        v = [F.col(f"{c}2") - F.col(f"{c}0") for c in "xyz"]
        solid = M.cross(u, v)
        flat = [u[1], -u[0], F.lit(0.0)]
        n = [F.when(F.col("n") == 2, f).otherwise(s) for f, s in zip(flat, solid, strict=True)]
        away = M.dot(n, [F.col(f"{c}0") - F.col(f"{c}m") for c in "xyz"])
        size = M.norm(n) * F.when(away < 0, -1.0).otherwise(1.0)
        return rows.select("cid", "loc", *((x / size).alias(c) for x, c in zip(n, "xyz", strict=True)))

    def planar_faces(self, tolerance: float = 1e-9) -> DataFrame:
        """(cid, loc, planar): whether all points of a face lie in the plane of its first three."""
        corners = self.cell_faces().select("cid", "loc", F.posexplode("points").alias("k", "pid")).join(self.points, "pid")
        lists = corners.groupBy("cid", "loc").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y", "z"))).alias("p"))
        at = lambda k: [F.try_element_at("p", F.lit(k + 1))[c] for c in "xyz"]
        minus = lambda a, b: [x - y for x, y in zip(a, b, strict=True)]
        normal = M.cross(minus(at(1), at(0)), minus(at(2), at(0)))
        off = F.exists("p", lambda q: F.abs(M.dot(normal, minus([q[c] for c in "xyz"], at(0)))) > tolerance)
        return lists.select("cid", "loc", (~F.coalesce(off, F.lit(False))).alias("planar"))

    def simplices(self) -> Mesh:
        """The mesh of the simplices that the cells are cut into, numbered by cell and part; convex polygons become fans of triangles."""
        parts = self.cells.select("cid", F.posexplode(_by_shape(SIMPLICES, F.col("points"), _fan(F.col("points")))).alias("loc", "points"))
        shape = F.when(F.size("points") == 3, "triangle").otherwise("tetrahedron")
        return Mesh(self.points, numbered(parts, "__cid", F.asc("cid"), F.asc("loc")).select(F.col("__cid").alias("cid"), shape.alias("shape"), "points"))

    def refined(self) -> Mesh:
        """Every edge, triangle, quadrangle, tetrahedron or hexahedron cut at the middles of its edges, faces and itself.

        Cells are numbered by old cell and part. A middle is one new point, whichever cells it belongs
        to: it is known by the old points that it lies between, and numbered in their order. Cells of
        other shapes are an error.
        """
        work = Workspace(self.points.sparkSession, "refined")
        p = F.col("points")
        parts = F.when(F.lit(False), F.array().cast("array<array<array<bigint>>>"))
        for shape, children in REFINED.items():
            made = F.array(*(F.array(*(F.array_sort(F.array(*(F.element_at(p, k + 1) for k in corner))) for corner in child)) for child in children))
            parts = parts.when(F.col("shape") == shape, made)
        parts = parts.otherwise(F.raise_error(F.concat(F.lit("this shape is not refined: "), F.col("shape"))).cast("array<array<array<bigint>>>"))
        corners = self.cells.select("cid", "shape", F.posexplode(parts).alias("loc", "corners")).select("cid", "shape", "loc", F.posexplode("corners").alias("at", "key"))
        corners = work.write(corners)
        after = self.points.agg((F.max("pid") + 1).alias("after"))  # one row
        keys = numbered(corners.where(F.size("key") > 1).select("key").distinct(), "k", F.asc("key")).join(F.broadcast(after)).select("key", (F.col("after") + F.col("k")).alias("new"))
        keys = work.write(keys)
        middles = keys.select("new", F.explode("key").alias("pid")).join(self.points, "pid").groupBy(F.col("new").alias("pid")).agg(*(F.avg(c).alias(c) for c in "xyz"))
        named = corners.join(keys, "key", "left").select("cid", "shape", "loc", "at", F.coalesce("new", F.col("key")[0]).alias("pid"))
        cells = named.groupBy("cid", "shape", "loc").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "pid"))), lambda q: q["pid"]).alias("points"))
        cells = numbered(cells, "__cid", F.asc("cid"), F.asc("loc")).select(F.col("__cid").alias("cid"), "shape", "points")
        return Mesh(self.points.select("pid", "x", "y", "z").unionByName(middles), cells)

    def refined_triangles(self) -> Mesh:
        """Each triangle cut into four at the middles of its sides; a side's middle is one new point."""
        sides = self.cells.select(F.explode(_by_shape(FACES, F.col("points"))).alias("s")).select(F.array_sort("s").alias("s")).distinct().select(F.col("s")[0].alias("a"), F.col("s")[1].alias("b"))
        n = self.points.agg((F.max("pid") + 1).alias("n"))
        ends = sides.join(self.points.select(F.col("pid").alias("a"), *(F.col(c).alias(c + "a") for c in "xyz")), "a").join(self.points.select(F.col("pid").alias("b"), *(F.col(c).alias(c + "b") for c in "xyz")), "b")
        placed = row_numbers(ends.join(F.broadcast(n)).withColumn("place", F.col("a") * F.col("n") + F.col("b")), "place", "k").withColumn("pid", F.col("n") + F.col("k"))
        new = placed.select("pid", *(((F.col(c + "a") + F.col(c + "b")) / 2).alias(c) for c in "xyz"))
        middle = placed.select("a", "b", "pid")
        rows = self.cells.select("cid", *(F.col("points")[k].alias(f"p{k}") for k in range(3)))
        for k in range(3):
            rows = rows.withColumn("a", F.least(f"p{k}", f"p{(k + 1) % 3}")).withColumn("b", F.greatest(f"p{k}", f"p{(k + 1) % 3}")).join(middle.withColumnRenamed("pid", f"m{k}"), ["a", "b"]).drop("a", "b")
        four = F.array(F.array("p0", "m0", "m2"), F.array("m0", "p1", "m1"), F.array("m2", "m1", "p2"), F.array("m0", "m1", "m2"))
        cells = rows.select("cid", F.posexplode(four).alias("loc", "points")).select((F.col("cid") * 4 + F.col("loc")).alias("cid"), F.lit("triangle").alias("shape"), "points")
        return Mesh(self.points.select("pid", "x", "y", "z").unionByName(new), cells)


def tetrahedron_volume(a: list[Column], b: list[Column], c: list[Column], d: list[Column]) -> Column:
    u, v, w = ([y - x for x, y in zip(a, p, strict=True)] for p in (b, c, d))
    return F.abs(M.dot(u, M.cross(v, w))) / 6


def deduplicated(points: DataFrame, cells: DataFrame) -> Mesh:
    """A mesh without points of equal coordinates: the least pid stands for all, and cells follow."""
    first = points.groupBy("x", "y", "z").agg(F.min("pid").alias("new"))
    names = points.join(first, ["x", "y", "z"]).select(F.col("pid"), "new")
    rows = cells.select("cid", "shape", F.posexplode("points").alias("loc", "pid")).join(names, "pid")
    new = rows.groupBy("cid", "shape").agg(F.transform(F.array_sort(F.collect_list(F.struct("loc", "new"))), lambda p: p["new"]).alias("points"))
    return Mesh(first.select(F.col("new").alias("pid"), "x", "y", "z"), new)


def hilbert_key(x: Column, y: Column, bits: int = 16) -> Column:
    """The place of integer coordinates below 2**bits along the Hilbert curve, by bit steps."""
    start = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("d"))

    def step(acc: Column, k: Column) -> Column:
        s = F.pow(F.lit(2.0), F.lit(bits - 1) - k).cast("bigint")
        rx = F.when(acc["x"].bitwiseAND(s) > 0, 1).otherwise(0).cast("bigint")
        ry = F.when(acc["y"].bitwiseAND(s) > 0, 1).otherwise(0).cast("bigint")
        d = acc["d"] + s * s * (rx * 3).bitwiseXOR(ry)
        full = F.lit((1 << bits) - 1).cast("bigint")
        fx, fy = F.when(rx == 1, full - acc["x"]).otherwise(acc["x"]), F.when(rx == 1, full - acc["y"]).otherwise(acc["y"])
        nx, ny = F.when(ry == 0, fy).otherwise(acc["x"]), F.when(ry == 0, fx).otherwise(acc["y"])
        return F.struct(nx.alias("x"), ny.alias("y"), d.alias("d"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), start, step, lambda acc: acc["d"])


def kd_tree_order(points: DataFrame, leaf: int = 1024, axes: str = "xyz") -> DataFrame:
    """(old, new): points (pid, x, y, z) in the order of the leaves of a tree that halves them along each axis in turn.

    A level finds the middle of every part with more than `leaf` points by one aggregation (the middle
    is approximate, so parts differ a little in size; ties go left) and sends each point left or right;
    leaves then stand in the tree's order, points inside by the last axis and id. Points that no axis
    tells apart stay in one leaf.
    """
    work = Workspace(points.sparkSession, "kdtree")
    now = work.write(points.select("pid", *axes, F.lit(1).cast("decimal(38,0)").alias("part"), F.lit(False).alias("done")))
    level = 0
    while True:
        axis = axes[level % len(axes)]
        open_ = now.where("not done").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(axis, 0.5, 10_000).alias("middle"), *(F.min(a).alias(f"lo{a}") for a in axes), *(F.max(a).alias(f"hi{a}") for a in axes))
        flat = F.lit(True)
        for a in axes:
            flat = flat & (F.col(f"lo{a}") == F.col(f"hi{a}"))
        # Where the upper half is empty, because the middle is the largest, only the largest go right.
        wide = F.col(f"hi{axis}") > F.col(f"lo{axis}")
        cut, seen = work.measured(open_.select("part", "middle", F.col(f"hi{axis}").alias("hi"), wide.alias("wide"), ((F.col("n") <= leaf) | flat).alias("ends")), left=F.count_if(~F.col("ends")))
        if not seen["left"]:
            break
        right = F.col("wide") & F.when(F.col("middle") < F.col("hi"), F.col(axis) > F.col("middle")).otherwise(F.col(axis) >= F.col("hi"))
        moved = now.join(cut, "part", "left")
        ends = F.col("done") | F.coalesce("ends", F.lit(True))
        # A leaf keeps its place in the tree: its path grows by zeros like all others'.
        after = work.write(moved.select("pid", *axes, (F.col("part") * 2 + F.when(~ends & right, 1).otherwise(0)).cast("decimal(38,0)").alias("part"), ends.alias("done")))
        work.drop(now, cut)
        now, level = after, level + 1
    return numbered(now.select("pid", "part", F.col(axes[-1]).alias("last")), "new", F.asc("part"), F.asc("last"), F.asc("pid")).select(F.col("pid").alias("old"), "new")


def cuthill_mckee(neighbours: DataFrame, cells: DataFrame) -> DataFrame:
    """(old, new): the reverse Cuthill-McKee order of cells (cid) by their dual graph (cid, neighbour).

    From the cell of least degree of each part, cells by falling (part, level, degree, id).
    """
    arcs = neighbours.select(F.col("cid").alias("src"), F.col("neighbour").alias("dst"))
    g = Graph.of(arcs, cells.select(F.col("cid").alias("v")), directed=True)
    degree = g.degrees()
    parts = g.components().join(degree, "v")
    starts = parts.groupBy("component").agg(F.min(F.struct("degree", "v")).alias("s")).select("s.v")  # one cell a connected part
    level = g.distances(starts, False).withColumnRenamed("dist", "level")
    rows = parts.join(level, "v")
    return numbered(rows, "new", F.desc("component"), F.desc("level"), F.desc("degree"), F.desc("v")).select(F.col("v").alias("old"), "new")
