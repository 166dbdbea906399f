"""Operators against small literal cases and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import math as M
from ridgeline.operators import scan as S
from ridgeline.operators import sorting, vector
from ridgeline.operators.graph import Graph
from ridgeline.operators.matrix import Matrix, determinant, inverse, solve
from ridgeline.operators.mesh import Mesh, cuthill_mckee, deduplicated, hilbert_key
from ridgeline.operators.ndarray import NDArray, apply, best_decomposition, life_step
from ridgeline.operators.segments import Scope, Segments
from ridgeline.plans import ode, solvers


def vec(spark, values, kind="double"):
    return spark.createDataFrame(list(enumerate(values)), f"i bigint, v {kind}")


def values(df):
    return [r["v"] for r in df.orderBy("i").collect()]


def one(df):
    return df.first()["value"]


@pytest.mark.parametrize("n", [1, 10, 1000])
def test_reduce_constant(spark, n):
    assert one(vector.reduce(vector.constant(spark, n, 1), "plus")) == n


def test_reduce_iota_and_product(spark):
    assert one(vector.reduce(spark.range(9377).select(F.col("id").alias("i"), F.col("id").alias("v")), "plus")) == 9377 * 9376 // 2
    assert one(vector.reduce(vec(spark, [2.0] * 10), "multiplies", between=(0, 7))) == 128
    assert one(vector.reduce(vec(spark, [2.0] * 10), "multiplies", between=(0, 0))) == 1


def test_argument_ties(spark):
    v = vec(spark, [5.0, 7.0, 7.0, 1.0, 1.0])
    assert tuple(vector.reduce_with_argument(v, "max").first()) == (7.0, 1)
    assert tuple(vector.reduce_with_argument(v, "min").first()) == (1.0, 3)


def test_identities_over_nothing(spark):
    empty = vec(spark, [1.0]).where("false")
    assert one(vector.reduce(empty, "min")) == math.inf
    assert one(vector.reduce(empty, "max")) == -math.inf
    assert one(vector.contains(empty, 1.0)) is False
    assert one(vector.contains_only(empty, 1.0)) is True


@pytest.mark.parametrize("functor,f", [("plus", np.cumsum), ("max", np.maximum.accumulate), ("min", np.minimum.accumulate)])
def test_scan_in_blocks(spark, functor, f):
    data = [float(x) for x in random.Random(3).choices(range(100), k=97)]
    got = [r["scan"] for r in S.scan(vec(spark, data), functor, block=8).orderBy("i").collect()]
    assert got == list(f(data))


def test_exclusive_scan_and_range(spark):
    got = [r["scan"] for r in S.scan(vec(spark, [1.0] * 9), exclusive=True, block=2).orderBy("i").collect()]
    assert got == list(range(9))
    got = [r["scan"] for r in S.scan(vec(spark, [1.0] * 6), between=(2, 4), keep_outside=True).orderBy("i").collect()]
    assert got == [1, 1, 1, 2, 1, 1]


@pytest.mark.parametrize("block", [3, 64])
def test_segmented_scan(spark, block):
    n = 1000
    rows = spark.range(n).select(F.col("id").alias("i"), F.lit(1.0).alias("v"), (F.col("id") % 5 == 0).alias("flag"))
    got = [r["scan"] for r in S.segmented_scan(rows, block=block).orderBy("i").collect()]
    assert got == [i % 5 + 1 for i in range(n)]
    none = rows.withColumn("flag", F.lit(False))
    assert [r["scan"] for r in S.segmented_scan(none, block=block, exclusive=True).orderBy("i").collect()] == list(range(n))


def test_compress_and_find(spark):
    marks = vec(spark, [1, 0, 0, 0, 0, 1, 0, 1, 1, 0, 0], "int")
    assert [r["i"] for r in vector.compress(marks).orderBy("slot").collect()] == [0, 5, 7, 8]
    assert [r["i"] for r in vector.compress(marks, (1, 11)).orderBy("slot").collect()] == [5, 7, 8]
    assert tuple(vector.find(vec(spark, [float(k % 10) for k in range(20)]), 4.0).first()) == (True, 4)


def test_sort_with_ties(spark):
    data = random.Random(5).choices(range(7), k=200)
    assert values(sorting.sort(vec(spark, data, "int"))) == sorted(data)
    assert values(sorting.sort(vec(spark, data, "int"), descending=True)) == sorted(data, reverse=True)
    assert one(sorting.is_sorted(vec(spark, sorted(data), "int"))) is True
    assert one(sorting.is_sorted(vec(spark, [], "int"))) is True


def test_segments(spark):
    s = Segments.of(spark.range(4).select(F.col("id").alias("seg")), spark.createDataFrame([(0, 0, 3.0), (0, 1, 1.0), (2, 0, 5.0), (2, 1, 5.0), (2, 2, 4.0)], "seg bigint, loc bigint, v double"))
    assert {r["seg"]: r["value"] for r in s.reduce("plus").collect()} == {0: 4.0, 1: 0.0, 2: 14.0, 3: 0.0}
    assert {r["seg"]: (r["value"], r["loc"], r["empty"]) for r in s.reduce_with_argument("max").collect()} == {0: (3.0, 0, False), 1: (None, None, True), 2: (5.0, 0, False), 3: (None, None, True)}
    assert [tuple(r) for r in s.reduce("plus", scope=Scope(ids=[2, 0, 2])).orderBy("pos").collect()] == [(0, 2, 14.0), (1, 0, 4.0), (2, 2, 14.0)]
    assert [tuple(r) for r in s.sort(scope=Scope(where=lambda x: x == 2)).orderBy("seg", "loc").collect()] == [(0, 0, 3.0), (0, 1, 1.0), (2, 0, 4.0), (2, 1, 5.0), (2, 2, 5.0)]
    assert [r["offset"] for r in s.offsets().orderBy("seg").collect()] == [0, 2, 2, 5]
    grown = s.append(spark.createDataFrame([(1, 0, 9.0), (0, 0, 8.0)], "seg bigint, order bigint, v double"))
    assert [tuple(r) for r in grown.elements.where("seg < 2").orderBy("seg", "loc").collect()] == [(0, 0, 3.0), (0, 1, 1.0), (0, 2, 8.0), (1, 0, 9.0)]
    assert s.remove(lambda seg, loc, v: v == 5.0).elements.where("seg = 2").first()["loc"] == 0


def test_spmv(spark):
    a = Matrix(spark.createDataFrame([(0, 0, 1.0), (1, 1, 2.0), (1, 3, 3.0), (2, 1, 4.0), (3, 2, 5.0)], "row bigint, col bigint, v double"), 4, 4)
    x = vec(spark, [2.0] * 4)
    assert values(a.vector_product(x)) == [2, 10, 8, 10]
    assert values(a.transposed_vector_product(x)) == [2, 12, 10, 6]
    zero = Matrix(a.elements.where("false"), 4, 4)
    assert values(zero.vector_product(vec(spark, [1.0] * 4), vec(spark, [-1.0] * 4))) == [0, 0, 0, 0]
    assert one(a.nonzeros()) == 5
    assert one(a.add_elements(a.elements, -1.0).compressed().nonzeros()) == 0


def test_representations_agree(spark):
    dense = Matrix.from_dense(spark, [[1, 2, 0, 0], [0, 6, 0, 0], [9, 0, 0, 0], [0, 0, 15, 16]])
    csr = Matrix.from_csr(spark, [0, 2, 3, 4, 6], [0, 1, 1, 0, 2, 3], [1, 2, 6, 9, 15, 16], 4)
    ell = Matrix.from_ellpack(spark, 2, [0, 1, 1, -1, 0, -1, 2, 3], [1, 2, 6, 0, 9, 0, 15, 16], 4, 4)
    assert one(dense.equals(csr)) and one(csr.equals(ell))


def test_symmetric(spark):
    a = Matrix.of(spark.createDataFrame([(0, 1, 2.0), (2, 2, 3.0)], "row bigint, col bigint, v double"), 3, 3, symmetric=True)
    assert values(a.vector_product(vec(spark, [1.0, 10.0, 100.0]))) == [20, 2, 300]
    assert one(a.nonzeros()) == 3


def test_small_matrices(spark):
    m = [[F.lit(float(x)) for x in row] for row in ((2, 1, 0), (1, 3, 1), (0, 1, 4))]
    row = spark.range(1).select(determinant(m).alias("d"), inverse(m)[0][0].alias("i"), *(c.alias(f"x{k}") for k, c in enumerate(solve(m, [F.lit(3.0), F.lit(5.0), F.lit(5.0)])))).first()
    assert row["d"] == 18 and abs(row["i"] - 11 / 18) < 1e-12 and [round(row[f"x{k}"], 9) for k in range(3)] == [1, 1, 1]


EDGES5 = [(0, 1, 0.5), (0, 2, 1.2), (1, 3, 2.3), (1, 4, 3.7), (2, 3, 0.8), (3, 4, 1.5)]


def graph(spark, edges, n, directed):
    return Graph.of(spark.createDataFrame(edges, "src bigint, dst bigint, w double"), spark.range(n).select(F.col("id").alias("v")), directed)


def test_paths(spark):
    g = graph(spark, EDGES5, 5, False)
    assert [r["dist"] for r in g.breadth_first(0).orderBy("v").collect()] == [0, 1, 1, 2, 2]
    assert [r["dist"] for r in g.breadth_first(4).orderBy("v").collect()] == [2, 1, 2, 1, 0]
    assert [round(r["dist"], 9) for r in g.shortest_paths(0).orderBy("v").collect()] == [0, 0.5, 1.2, 2.0, 3.5]
    directed = graph(spark, [(0, 1, 0.5), (1, 2, 1.0)], 4, True)
    assert [r["dist"] for r in directed.shortest_paths(1).orderBy("v").collect()] == [-1, 0, 1, -1]


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_spanning_forest(spark, monkeypatch, small):
    monkeypatch.setattr("ridgeline.operators.graph.SMALL_ARCS", small)
    # Two small graphs and their least spanning forests.
    six = graph(spark, [(0, 1, 1.0), (0, 2, 3.0), (1, 2, 2.0), (3, 4, 4.0), (3, 5, 5.0), (4, 5, 3.0)], 6, False)
    assert sorted(tuple(r) for r in six.minimum_spanning_forest().collect()) == [(0, 1, 1.0), (1, 2, 2.0), (3, 4, 4.0), (4, 5, 3.0)]
    nine = [(1, 0, 4), (2, 1, 8), (3, 2, 7), (4, 3, 9), (5, 2, 4), (5, 3, 14), (5, 4, 10), (6, 5, 2), (7, 0, 8), (7, 1, 11), (7, 6, 1), (8, 2, 2), (8, 6, 6), (8, 7, 7)]
    g = graph(spark, [(a, b, float(w)) for a, b, w in nine], 9, False)
    assert g.minimum_spanning_forest().agg(F.sum("w")).first()[0] == 37


def test_trees(spark):
    tree = [(0, 1), (0, 2), (1, 3), (1, 4), (2, 5), (2, 6), (3, 7), (4, 8), (5, 9)]
    make = lambda e: graph(spark, [(a, b, 1.0) for a, b in e], 10, False)
    assert one(make(tree).is_tree()) is True
    assert one(make([*tree, (5, 0)]).is_tree()) is False
    assert one(make([e for e in tree if e != (5, 9)] + [(5, 0)]).is_tree()) is False
    assert one(make(tree[:-1]).is_forest()) is True


def test_solvers(spark):
    n = 8
    a = Matrix.tridiagonal(spark, n, lambda r, c: F.when(r == c, 4.0).when(r < c, -1.0).otherwise(-0.5))
    x = vec(spark, [float(k) for k in range(n)])
    b = a.vector_product(x)
    for solver in (solvers.bicgstab, solvers.gmres):
        assert np.allclose(values(solver(a, b, control=solvers.Control(1e-10)).x), range(n), atol=1e-6)
    assert np.allclose(values(solvers.gaussian_elimination(a, b)), range(n))
    assert one(solvers.residue(a, x, b)) < 1e-12
    with pytest.raises(ValueError):
        solvers.power_iteration(a, vec(spark, [0.0] * n))


@pytest.mark.parametrize("method", ["gradient_descent", "momentum", "nesterov", "adagrad", "rmsprop"])
def test_optimisers(method):
    w, _, _ = solvers.optimise(lambda w: [w[0] - 3.0], [0.0], method, rate=0.05 if method != "adagrad" else 0.5, control=solvers.Control(1e-7, most=2000))
    assert abs(w[0] - 3) < 0.1


@pytest.mark.parametrize("method", sorted(ode.METHODS))
def test_ode_order(method):
    def error(tau):
        u = ode.integrate(lambda t, u: np.exp(t)[:, None] + 0 * u, np.zeros(1), np.ones(1), np.ones((1, 1)), np.full(1, tau), ode.METHODS[method])
        return abs(u[0, 0] - math.e)

    order = math.log2(max(error(0.1), 1e-15) / max(error(0.05), 1e-15))
    least = {"euler": 0.9, "ode1": 0.9}.get(method, 1.8)
    assert order > least or error(0.05) < 1e-12


def test_ode_adaptive(spark):
    rows = spark.createDataFrame([(1, 0.0, 10.0, 0.5, [0.0])], "id bigint, t0 double, t1 double, tau double, u array<double>")
    u = ode.solve(rows, lambda t, u: t[:, None] + 0 * u, "merson", adaptivity=1e-6).first()["u"][0]
    assert abs(u - 50) < 1e-3


def test_functions(spark):
    row = spark.range(1).select(M.prime_factors(F.lit(360)).alias("f"), M.combinations(F.lit(3), F.lit(7)).alias("c"), M.swap_bits(F.lit(5).cast("bigint"), 0, 1).alias("s"), M.divide(F.lit(1.0), F.lit(0.0)).alias("d"), M.UNARY["log"](F.lit(0.0)).alias("l"), M.integer_divide(F.lit(-7), F.lit(2)).alias("q"), M.c_divide(M.complex_(F.lit(1), F.lit(2)), M.complex_(F.lit(0), F.lit(1))).alias("z")).first()
    assert row["f"] == [2, 2, 2, 3, 3, 5] and row["c"] == 35 and row["s"] == 6
    assert row["d"] == math.inf and row["l"] == -math.inf and row["q"] == -3
    assert (row["z"]["re"], row["z"]["im"]) == (2.0, -1.0)


def test_ndarray(spark):
    a = NDArray.of(spark, (3, 4), lambda i, j: i * 4 + j)
    assert a.strides() == (4, 1)
    assert [r["value"] for r in a.reduce("plus", [1]).orderBy("i0").collect()] == [6, 22, 38]
    assert a.is_contiguous((0, 0), (2, 4)) and not a.is_contiguous((0, 0), (2, 3))
    assert best_decomposition((100, 10), 4) == (4, 1)
    assert sorted(r["v"] for r in a.subarray({0: 1}).elements.collect()) == [4, 5, 6, 7]


def test_mesh(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 1.0, 1.0, 0.0), (3, 0.0, 1.0, 0.0), (4, 1.0, 1.0, 0.0)], "pid bigint, x double, y double, z double")
    cells = spark.createDataFrame([(0, "triangle", [0, 1, 2]), (1, "triangle", [0, 4, 3])], "cid bigint, shape string, points array<bigint>")
    m = deduplicated(points, cells)
    counts = m.counts().first()
    assert (counts["points"], counts["cells"], counts["faces"], counts["boundary_faces"]) == (4, 2, 5, 4)
    assert sorted(tuple(r) for r in m.neighbours().collect()) == [(0, 1), (1, 0)]
    assert [r["measure"] for r in m.measures().orderBy("cid").collect()] == [0.5, 0.5]
    fine = m.refined_triangles()
    assert fine.cells.count() == 8 and fine.points.count() == 9
    assert abs(fine.measures().agg(F.sum("measure")).first()[0] - 1) < 1e-12
    cube = Mesh(spark.createDataFrame([(k, float(k in (1, 2, 5, 6)), float(k in (2, 3, 6, 7)), float(k > 3)) for k in range(8)], "pid bigint, x double, y double, z double"), spark.createDataFrame([(0, "hexahedron", list(range(8)))], "cid bigint, shape string, points array<bigint>"))
    assert abs(cube.measures().first()["measure"] - 1) < 1e-12
    assert abs(cube.simplices().measures().agg(F.sum("measure")).first()[0] - 1) < 1e-12


def test_cell_geometry(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0)], "pid bigint, x double, y double, z double")
    tetra = Mesh(points, spark.createDataFrame([(0, "tetrahedron", [0, 1, 2, 3])], "cid bigint, shape string, points array<bigint>"))
    assert abs(tetra.circumradii().first()["radius"] - math.sqrt(3) / 2) < 1e-12
    normals = sorted(tuple(round(r[c], 6) + 0.0 for c in "xyz") for r in tetra.outward_normals().collect())
    third = round(1 / math.sqrt(3), 6)
    assert normals == [(-1, 0, 0), (0, -1, 0), (0, 0, -1), (third, third, third)]
    assert all(r["planar"] for r in tetra.planar_faces().collect())


def test_cell_order(spark):
    chain = [(k, k + 1) for k in (3, 0, 4, 1, 2)]
    arcs = spark.createDataFrame(chain + [(b, a) for a, b in chain], "cid bigint, neighbour bigint")
    order = cuthill_mckee(arcs, spark.range(6).select(F.col("id").alias("cid")))
    assert sorted((r["new"], r["old"]) for r in order.collect()) in ([(k, 5 - k) for k in range(6)], [(k, k) for k in range(6)])


def test_life_and_named_operations(spark):
    blinker = NDArray.of(spark, (5, 5), lambda i, j: F.when((i == 2) & j.between(1, 3), 1).otherwise(0))
    alive = {(r["i0"], r["i1"]) for r in life_step(blinker).elements.where("v = 1").collect()}
    assert alive == {(1, 2), (2, 2), (3, 2)}
    a = NDArray.of(spark, (2, 2), lambda i, j: (i * 2 + j).cast("double"))
    assert sorted(r["v"] for r in apply("multiply", a, apply("square", a)).elements.collect()) == [0, 1, 8, 27]


def test_fused_reductions(spark):
    a, b = vec(spark, [1.0, -2.0, 3.0]), vec(spark, [1.0, 1.0, 1.0])
    made, total = vector.evaluate_and_reduce(lambda x, y: x + y, "plus", a, b)
    assert values(made) == [2, -1, 4] and one(total) == 5
    target, size = vector.add_and_reduce(b, lambda x: 2 * x, "plus", a, absolute=True)
    assert values(target) == [3, -3, 7] and one(size) == 12


def test_hilbert_curve(spark):
    rows = spark.range(64).select((F.col("id") % 8).alias("x"), F.call_function("div", F.col("id"), F.lit(8)).alias("y"))
    path = [(r["x"], r["y"]) for r in rows.withColumn("k", hilbert_key(F.col("x"), F.col("y"), 3)).orderBy("k").collect()]
    assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(path, path[1:], strict=False))


def test_distances_by_frontier_equal_those_of_one_task(spark, monkeypatch):
    import random

    from ridgeline.operators import graph as G

    rng = random.Random(4)
    rows = [(rng.randrange(60), rng.randrange(60), float(rng.randrange(1, 9))) for _ in range(110)] + [(k, k + 1, 1.0) for k in range(60, 66)] + [(5, 60, 2.0)]
    edges = spark.createDataFrame(rows, "src bigint, dst bigint, w double")
    g = G.Graph.of(edges, spark.range(80).select(F.col("id").alias("v")))
    sources = spark.createDataFrame([(3,), (7,), (500,), (3,)], "v bigint")
    for weighted in (False, True):
        best = {v: 0.0 for v in (3, 7)}
        for _ in range(80):
            for a, b, w in rows:
                if a in best:
                    best[b] = min(best.get(b, 1e9), best[a] + (w if weighted else 1))
        want = {v: best.get(v, -1) for v in range(80)}
        for small in (1 << 20, 0):
            monkeypatch.setattr(G, "SMALL_ARCS", small)
            for given in (sources, [3, 7, 500]) if small else (sources,):
                assert {r["v"]: r["dist"] for r in g.distances(given, weighted).collect()} == want
    assert g.distances([], True).where("dist != -1").count() == 0
    assert {r["v"]: r["dist"] for r in g.semiring_distances(3, 80).collect()} == {r["v"]: r["dist"] for r in g.shortest_paths(3).collect()}
    visited = {r["v"]: r["value"] for r in g.breadth_first(3, lambda v, dist: v * 100 + dist).collect()}
    assert visited == {r["v"]: r["v"] * 100 + r["dist"] for r in g.breadth_first(3).collect() if r["dist"] > 0}


def test_a_vertex_that_is_bettered_late_has_one_row(spark, monkeypatch):
    monkeypatch.setattr("ridgeline.operators.graph.SMALL_ARCS", 0)
    rows = [(0, k, 10.0) for k in range(1, 21)] + [(0, 21, 1.0), (21, 1, 1.0)]
    g = Graph.of(spark.createDataFrame(rows, "src bigint, dst bigint, w double"))
    got = sorted((r["v"], r["dist"]) for r in g.shortest_paths(0).collect())
    assert got == [(0, 0.0), (1, 2.0), *((k, 10.0) for k in range(2, 21)), (21, 1.0)]


def test_distances_are_joined_without_broadcasts(spark, monkeypatch):
    from ridgeline.operators import graph as G

    made = []
    real = G.Workspace.bucketed
    monkeypatch.setattr(G.Workspace, "bucketed", lambda self, df, *a, **k: (made.append(df._jdf.queryExecution().executedPlan().toString()), real(self, df, *a, **k))[1])
    monkeypatch.setattr(G, "SMALL_ARCS", 0)
    found = Graph.of(spark.createDataFrame([(0, 1), (1, 2)], "src bigint, dst bigint")).breadth_first(0)
    made.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(made) > 3 and not [p for p in made if "BroadcastExchange" in p]


def test_prime_factors_use_the_primes_up_to_the_root(spark):
    def factors(n):
        out, p = [], 2
        while n > 1:
            while n % p == 0:
                out.append(p)
                n //= p
            p = p + 1 if p * p <= n else n
        return out

    near = sorted({max(1, (1 << 2 * k) + e) for k in range(17) for e in (-2, -1, 0)} | {p * p + e for p in (2, 3, 7, 31, 127, 251, 8191, 65521) for e in (-1, 0, 1)} | set(range(1, 300)))
    rows = spark.createDataFrame([(n,) for n in near], "n bigint").select("n", M.prime_factors(F.col("n")).alias("f"))
    assert {r["n"]: r["f"] for r in rows.collect()} == {n: factors(n) for n in near}


def test_prime_factors_of_a_table_in_one_file_take_many_tasks(spark, tmp_path):
    from ridgeline.plans import catalogue

    spark.range(1 << 16).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert catalogue.queries()["prime_factors"](spark, str(tmp_path)).rdd.getNumPartitions() >= 4


@pytest.mark.parametrize("name", ["add", "symmetric_part"])
def test_sums_of_matrices_take_tasks_by_the_number_of_elements(spark, monkeypatch, name):
    monkeypatch.setattr("ridgeline.session.dealt.__kwdefaults__", {"each": 4})
    made = spark.createDataFrame([(k % 7, k % 5, float(k)) for k in range(40)], "row bigint, col bigint, v double")
    a, plain = (Matrix.of(made, 7, 7, duplicates="sum", count=c) for c in (40, None))
    got, want = (m.add(m.transpose(), 1.0, 2.0) if name == "add" else m.symmetric_part() for m in (a, plain))
    assert sorted(map(tuple, got.elements.collect())) == sorted(map(tuple, want.elements.collect()))
    assert got.elements.rdd.getNumPartitions() == 20


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_cycles_of_negative_weight_are_errors(spark, monkeypatch, small):
    from ridgeline.operators import graph as G

    monkeypatch.setattr(G, "SMALL_ARCS", small)
    g = G.Graph.of(spark.createDataFrame([(0, 1, 1.0), (1, 2, -3.0), (2, 0, 1.0), (4, 4, 1.0)], "src bigint, dst bigint, w double"))
    with pytest.raises(Exception, match="negative"):
        g.shortest_paths(0).collect()
    assert [r["dist"] for r in g.shortest_paths(4).orderBy("v").collect()] == [-1.0, -1.0, -1.0, -1.0, 0.0]


def test_forest_roots_and_graph_equality(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (3, 4)], "src bigint, dst bigint")
    g = Graph.of(edges, directed=False)
    roots = lambda *v: spark.createDataFrame([(x,) for x in v], "v bigint")
    assert [g.is_forest(roots(*r)).first()["value"] for r in ((0, 3), (1, 4, 2), (0,), (3,))] == [True, True, False, False]
    cycle = Graph.of(spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src bigint, dst bigint"), directed=False)
    assert [x.first()["value"] for x in (cycle.is_forest(), cycle.is_tree(), cycle.is_forest(roots(0)))] == [False] * 3
    heavier = g.set_edge_weights(spark.createDataFrame([(0, 1, 5.0)], "src bigint, dst bigint, w double"))
    assert sorted((r["src"], r["w"]) for r in heavier.arcs.where("w != 1").collect()) == [(0, 5.0), (1, 5.0)]
    assert [g.equals(x).first()["value"] for x in (g, heavier, Graph.of(edges, directed=True), Graph.of(edges, spark.range(9).withColumnRenamed("id", "v"), False))] == [True, False, False, False]
    assert sorted(tuple(r) for r in g.for_vertices(lambda v, d: v * 10 + d).collect()) == [(0, 2), (1, 11), (2, 21), (3, 31), (4, 41)]


def test_large_segments_are_cut(spark, monkeypatch):
    """Scans and sorts of segments that are larger than what one task takes give the same."""
    from ridgeline.operators import segments as SG

    rng = random.Random(5)
    rows = [(s, k, float(rng.randrange(50))) for s, n in ((0, 300), (1, 3), (3, 120)) for k in range(n)]
    held = Segments.of(spark.range(4).select(F.col("id").alias("seg")), spark.createDataFrame(rows, "seg bigint, loc bigint, v double"))
    whole = {}
    for cut in (False, True):
        if cut:
            monkeypatch.setattr(SG, "BLOCK", 7)
            monkeypatch.setattr(SG, "HOT", 100)
        for name, df in (("scan", held.scan()), ("before", held.scan(exclusive=True)), ("max", held.scan("max")), ("sort", held.sort()), ("down", held.sort(descending=True)), ("odd", held.sort(scope=Scope(where=lambda s: s % 2 == 1)))):
            got = sorted(map(tuple, df.collect()))
            assert whole.setdefault(name, got) == got
    by_seg = {s: sorted(v for t, _, v in rows if t == s) for s in (0, 1, 3)}
    assert whole["sort"] == [(s, k, v) for s in (0, 1, 3) for k, v in enumerate(by_seg[s])]
    assert [tuple(r) for r in held.by_size().orderBy("rank").collect()] == [(0, 300, 0), (3, 120, 1), (1, 3, 2), (2, 0, 3)]


def test_kd_tree_order(spark):
    from ridgeline.operators.mesh import kd_tree_order

    rng = random.Random(8)
    rows = [(k, float(rng.randrange(40)), float(rng.randrange(40)), 0.0) for k in range(500)] + [(k, 7.0, 7.0, 0.0) for k in range(500, 560)]
    got = kd_tree_order(spark.createDataFrame(rows, "pid bigint, x double, y double, z double"), leaf=32, axes="xy").orderBy("new").collect()
    assert sorted(r["old"] for r in got) == list(range(560)) and [r["new"] for r in got] == list(range(560))
    at = {r[0]: r[1:3] for r in rows}
    place = [at[r["old"]] for r in got]
    assert max(x for x, _ in place[:200]) <= min(x for x, _ in place[-200:])  # the first cut is along x
    near = lambda order: sum(abs(a[0] - b[0]) + abs(a[1] - b[1]) for a, b in zip(order, order[1:], strict=False))
    assert near(place) < near([at[k] for k in range(560)])
    assert kd_tree_order(spark.createDataFrame([], "pid bigint, x double, y double, z double")).collect() == []


def test_monitor_sees_all_steps(spark):
    seen = []
    a = Matrix.tridiagonal(spark, 5, lambda r, c: F.when(r == c, 4.0).otherwise(-1.0))
    done = solvers.conjugate_gradients(a, vec(spark, [1.0] * 5), control=solvers.Control(1e-9, monitor=lambda step, rest: seen.append((step, rest))))
    assert [s for s, _ in seen] == list(range(done.steps + 1)) and seen[-1][1] == done.residue


@pytest.mark.parametrize("shape", ["edge", "triangle", "quadrangle", "tetrahedron", "hexahedron"])
def test_refined_shapes(spark, shape):
    """Two refinements keep the measure, and neighbours share their new points."""
    box = [(0, 0, 0), (2, 0, 0), (2, 2, 0), (0, 2, 0), (0, 0, 2), (2, 0, 2), (2, 2, 2), (0, 2, 2), (4, 0, 0), (4, 2, 0), (4, 0, 2), (4, 2, 2)]
    cells = {"edge": [[0, 1], [1, 8]], "triangle": [[0, 1, 2], [0, 2, 3]], "quadrangle": [[0, 1, 2, 3], [1, 8, 9, 2]], "tetrahedron": [[0, 1, 2, 5], [1, 8, 2, 5]], "hexahedron": [[0, 1, 2, 3, 4, 5, 6, 7], [1, 8, 9, 2, 5, 10, 11, 6]]}[shape]
    used = sorted({p for c in cells for p in c})
    m = Mesh(spark.createDataFrame([(k, *map(float, box[k])) for k in used], "pid bigint, x double, y double, z double"), spark.createDataFrame([(k, shape, c) for k, c in enumerate(cells)], "cid bigint, shape string, points array<bigint>"))
    whole = m.measures().agg(F.sum("measure")).first()[0]
    each = {"edge": 2, "triangle": 4, "quadrangle": 4, "tetrahedron": 8, "hexahedron": 8}[shape]
    once = m.refined()
    sizes = [r["measure"] for r in once.measures().collect()]
    assert len(sizes) == 2 * each and math.isclose(sum(sizes), whole) and min(sizes) > 0
    assert once.points.count() == once.points.select("x", "y", "z").distinct().count()
    assert once.points.join(once.cells.select(F.explode("points").alias("pid")).distinct(), "pid", "left_anti").count() == 0
    assert [r["cid"] for r in once.cells.orderBy("cid").collect()] == list(range(2 * each))
    inner = once.cell_faces().groupBy("key").count().where("count = 2").count()
    assert inner == {"edge": 3, "triangle": 8, "quadrangle": 10, "tetrahedron": 20, "hexahedron": 28}[shape]


def test_polygons_are_cut_into_fans(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0), (2, 3.0, 1.0, 0.0), (3, 2.0, 2.0, 0.0), (4, 0.0, 2.0, 0.0)], "pid bigint, x double, y double, z double")
    m = Mesh(points, spark.createDataFrame([(0, "polygon", [0, 1, 2, 3, 4])], "cid bigint, shape string, points array<bigint>"))
    cut = m.simplices()
    assert [(r["shape"], r["points"]) for r in cut.cells.orderBy("cid").collect()] == [("triangle", [0, 1, 2]), ("triangle", [0, 2, 3]), ("triangle", [0, 3, 4])]
    assert math.isclose(cut.measures().agg(F.sum("measure")).first()[0], m.measures().first()["measure"])
