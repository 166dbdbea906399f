"""Registered queries over many small systems, matrix updates, and meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators import matrix as MX
from ridgeline.operators.matrix import Matrix
from ridgeline.operators.mesh import Mesh, deduplicated, hilbert_key
from ridgeline.operators.ndarray import Grid
from ridgeline.operators.segments import Scope
from ridgeline.plans import small, solvers
from ridgeline.plans.catalogue import _B, _USERS, query, rounded, table, trade, user_segments
from ridgeline.session import Workspace

# One system a region: its nations, coupled by distance in key; the solution is 1, 2, 3, ...


def _systems(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nations = table(spark, d, "nation").select(F.col("n_regionkey").cast("bigint").alias("id"), F.call_function("div", F.col("n_nationkey"), F.lit(5)).cast("bigint").alias("k"))
    a = nations.select("id", F.col("k").alias("row")).join(nations.select("id", F.col("k").alias("col")), "id")
    a = a.withColumn("v", F.when(F.col("row") == F.col("col"), 6.0 + F.col("id")).otherwise(-1.0 / F.abs(F.col("row") - F.col("col"))))
    b = a.groupBy("id", "row").agg(F.sum(F.col("v") * (F.col("col") + 1)).alias("v"))
    return a, b


def _solved(method: str, precondition: str):
    def f(spark: SparkSession, d: str) -> DataFrame:
        a, b = _systems(spark, d)
        return rounded(small.solve(a, b, method, precondition), 6)

    f.__name__ = f"solve_{method}_{precondition}"
    return f


for _method, _precondition in (("sor", "none"), ("tfqmr", "diagonal"), ("idrs", "ilu0"), ("bicgstabl", "ilut")):
    query("SELECT n_regionkey::BIGINT AS id, n_nationkey // 5 AS i, (n_nationkey // 5 + 1)::DOUBLE AS v FROM nation")(_solved(_method, _precondition))


_SYSTEMS = "(SELECT a.n_regionkey::BIGINT AS id, a.n_nationkey // 5 AS r, b.n_nationkey // 5 AS c, CASE WHEN a.n_nationkey = b.n_nationkey THEN 6.0 + a.n_regionkey ELSE -1.0 / abs(a.n_nationkey // 5 - b.n_nationkey // 5) END::DOUBLE AS v FROM nation a JOIN nation b USING (n_regionkey))"


@query(f'SELECT id, r::BIGINT AS "row", c::BIGINT AS col, round(v, 6) AS v, CASE WHEN r = 0 THEN round(v, 6) WHEN c = 0 THEN round(v / (6.0 + id), 6) END AS factor FROM {_SYSTEMS}')
def lu_product(spark: SparkSession, d: str) -> DataFrame:
    """The product of the factors of each system's matrix, and what the factors hold in the first row and column."""
    a, _ = _systems(spark, d)
    f = solvers.lu(a)
    lower = f.where("row >= col").select("id", F.col("row"), F.col("col").alias("k"), F.when(F.col("row") == F.col("col"), 1.0).otherwise(F.col("v")).alias("l"))
    upper = f.where("row <= col").select("id", F.col("row").alias("k"), "col", F.col("v").alias("u"))
    product = lower.join(upper, ["id", "k"]).groupBy("id", "row", "col").agg(F.sum(F.col("l") * F.col("u")).alias("p"))
    first = F.when((F.col("row") == 0) | (F.col("col") == 0), F.round("v", 6))
    return product.join(f, ["id", "row", "col"]).select("id", "row", "col", F.round("p", 6).alias("v"), first.alias("factor"))


@query(f"WITH a AS {_SYSTEMS}, t AS (SELECT id, sum(v) FILTER (r = c) AS s1, sum(v * v) AS s2 FROM a GROUP BY id), u AS (SELECT x.id, sum(x.v * y.v * z.v) AS s3 FROM a x JOIN a y ON y.id = x.id AND y.r = x.c JOIN a z ON z.id = x.id AND z.r = y.c AND z.c = x.r GROUP BY x.id) SELECT id, round(s1, 4) AS s1, round(s2, 4) AS s2, round(s3, 4) AS s3 FROM t JOIN u USING (id)")
def qr_eigenvalues(spark: SparkSession, d: str) -> DataFrame:
    """Sums of powers of each system's eigenvalues: the traces of the matrix and of its products with itself."""
    a, _ = _systems(spark, d)
    powers = [F.round(F.sum(F.pow("value", F.lit(float(k)))), 4).alias(f"s{k}") for k in (1, 2, 3)]
    return solvers.qr_eigenvalues(a).groupBy("id").agg(*powers)


@query("SELECT c_custkey AS i, round((c_nationkey + 2.0) * 3 - 2, 4) AS det, round(3 / ((c_nationkey + 2.0) * 3 - 2), 6) AS inv00, round((3 * c_acctbal - 1) / ((c_nationkey + 2.0) * 3 - 2), 9) AS x0 FROM customer")
def static_matrices(spark: SparkSession, d: str) -> DataFrame:
    """Determinant, inverse and solution of a 2 x 2 matrix in every row."""
    m = [[F.col("c_nationkey") + 2.0, F.lit(1.0)], [F.lit(2.0), F.lit(3.0)]]
    x = MX.solve(m, [F.col("c_acctbal"), F.lit(1.0)])
    return table(spark, d, "customer").select(F.col("c_custkey").alias("i"), F.round(MX.determinant(m), 4).alias("det"), F.round(MX.inverse(m)[0][0], 6).alias("inv00"), F.round(x[0], 9).alias("x0"))


# Updates of the trade matrix.

_NATIONS = "(SELECT n_nationkey::BIGINT AS k, 100.0 AS w FROM nation)"


def _diagonal_changes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("row"), F.col("n_nationkey").cast("bigint").alias("col"), F.lit(100.0).alias("v"))


@query(f'SELECT coalesce(r, k) AS "row", coalesce(c, k) AS col, coalesce(w, v)::DOUBLE AS v FROM {_B} FULL JOIN {_NATIONS} ON r = k AND c = k')
def matrix_set_elements(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d).set_elements(_diagonal_changes(spark, d)).elements


@query(f'SELECT coalesce(r, k) AS "row", coalesce(c, k) AS col, (CASE WHEN k IS NULL THEN v ELSE 2 * coalesce(v, 0) + w END)::DOUBLE AS v FROM {_B} FULL JOIN {_NATIONS} ON r = k AND c = k')
def matrix_add_elements(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d).add_elements(_diagonal_changes(spark, d), 2.0).elements


@query(f'SELECT (24 - r) AS "row", (24 - c) AS col, v FROM {_B}')
def matrix_permute(spark: SparkSession, d: str) -> DataFrame:
    turned = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("old"), (24 - F.col("n_nationkey")).cast("bigint").alias("new"))
    return trade(spark, d).permute(turned).elements


@query(f'SELECT (SELECT count(*) FROM nation)::BIGINT AS "rows", (SELECT count(*) FROM nation)::BIGINT AS cols, count(*)::BIGINT AS stored, count(*) FILTER (v <> 0)::BIGINT AS nonzeros, count(*) FILTER (v <> 0) / 625.0 AS density FROM {_B}')
def matrix_info(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d).info()


@query(f"SELECT coalesce(max(v), 0.0) AS value FROM {_B} WHERE r = 3 AND c = 4")
def matrix_get_element(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d).get_element(3, 4)


@query(f'SELECT r AS "row", c AS col, CASE WHEN r < 5 THEN v * 2 + c ELSE v END AS v FROM {_B}')
def matrix_for_elements(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d).for_elements(lambda r, c, v: v * 2 + c, Scope(between=(None, 5))).elements


@query(f'SELECT n_nationkey::BIGINT AS "row", coalesce(max(v), \'-inf\'::DOUBLE) AS value FROM nation LEFT JOIN {_B} ON r = n_nationkey WHERE n_nationkey % 2 = 0 GROUP BY n_nationkey')
def row_reduce_if(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d).reduce_rows("max", scope=Scope(where=lambda r: r % 2 == 0))


@query(f'SELECT n_nationkey::BIGINT AS "row", n_regionkey::BIGINT AS col, (10 * n_nationkey + n_regionkey)::DOUBLE AS v FROM (SELECT a.n_nationkey, b.r_regionkey AS n_regionkey FROM nation a, region b)')
def matrix_from_functions(spark: SparkSession, d: str) -> DataFrame:
    n, m = table(spark, d, "nation").count(), table(spark, d, "region").count()
    return Matrix.from_functions(spark, n, m, lambda r: F.lit(m), lambda r, k: (k, 10.0 * r + k)).elements


@query(f"SELECT seg, row_number() OVER (PARTITION BY seg ORDER BY loc) - 1 AS loc, v FROM {_USERS} WHERE v <= 25")
def seg_remove(spark: SparkSession, d: str) -> DataFrame:
    return user_segments(spark, d).remove(lambda seg, loc, v: v > 25).elements


# A mesh over the nations x regions lattice: two triangles a cell, points repeated for each triangle before they are merged.


def lattice(spark: SparkSession, d: str) -> Mesh:
    sizes = (table(spark, d, "nation").count(), table(spark, d, "region").count())
    cells = Grid(sizes, (0.0, 0.0), (1.0, 2.0)).cells(spark).select("cell", "i0", "i1")
    corner = lambda a, b: F.struct((F.col("i0") + a).cast("double").alias("x"), (2.0 * (F.col("i1") + b)).alias("y"))
    three = F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1)), F.array(corner(0, 0), corner(1, 1), corner(0, 1)))
    triangles = cells.select("cell", F.posexplode(three).alias("half", "c")).select((F.col("cell") * 2 + F.col("half")).alias("cid"), "c")
    points = triangles.select("cid", F.posexplode("c").alias("loc", "p")).select((F.col("cid") * 3 + F.col("loc")).alias("pid"), "p.x", "p.y", F.lit(0.0).alias("z"))
    return deduplicated(points, triangles.select("cid", F.lit("triangle").alias("shape"), F.array(*((F.col("cid") * 3 + k) for k in range(3))).alias("points")))


@query("SELECT (n + 1) * (m + 1) AS points, 2 * n * m AS cells, 3 * n * m + n + m AS faces, 2 * (n + m) AS boundary_faces FROM (SELECT (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM region) AS m)")
def mesh_counts(spark: SparkSession, d: str) -> DataFrame:
    return lattice(spark, d).counts()


@query("SELECT unnest(range(0, 2 * (SELECT count(*) FROM nation) * (SELECT count(*) FROM region)))::BIGINT AS cid, 1.0::DOUBLE AS measure")
def mesh_measures(spark: SparkSession, d: str) -> DataFrame:
    return lattice(spark, d).measures()


@query("SELECT h.cell * 2 + half AS cid, round(x + 2.0 / 3 - half / 3.0, 6)::DOUBLE AS x, round(2 * (y + 1.0 / 3 + half / 3.0), 6)::DOUBLE AS y, 0.0::DOUBLE AS z FROM (SELECT (r_regionkey * 25 + n_nationkey)::BIGINT AS cell, n_nationkey AS x, r_regionkey AS y FROM nation, region) h, (SELECT unnest([0, 1]) AS half)")
def mesh_centers(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lattice(spark, d).centers(), 6)


_CELLS = "(SELECT (r_regionkey * n + n_nationkey)::BIGINT AS cell, n_nationkey AS x, r_regionkey AS y, n, m FROM nation, region, (SELECT (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM region) AS m))"
_SIDES = f"(SELECT 2 * cell AS a, 2 * cell + 1 AS b FROM {_CELLS} UNION ALL SELECT 2 * cell, 2 * (cell - n) + 1 FROM {_CELLS} WHERE y > 0 UNION ALL SELECT 2 * cell, 2 * (cell + 1) + 1 FROM {_CELLS} WHERE x < n - 1)"


@query(f"SELECT a AS cid, b AS neighbour FROM {_SIDES} UNION ALL SELECT b, a FROM {_SIDES}")
def mesh_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return lattice(spark, d).neighbours()


@query(f"WITH t AS (SELECT 2 * cell AS cid, [x, x + 1, x + 1] AS px, [2 * y, 2 * y, 2 * y + 2] AS py FROM {_CELLS} UNION ALL SELECT 2 * cell + 1, [x, x + 1, x], [2 * y, 2 * y + 2, 2 * y + 2] FROM {_CELLS}), w AS (SELECT unnest([0, 1, 2, 3]) AS part, unnest([[4, 1, 1], [1, 4, 1], [1, 1, 4], [2, 2, 2]]) AS k) SELECT cid * 4 + part AS cid, round(list_inner_product(px::DOUBLE[], k::DOUBLE[]) / 6, 6) AS x, round(list_inner_product(py::DOUBLE[], k::DOUBLE[]) / 6, 6) AS y, 0.25::DOUBLE AS measure FROM t, w")
def mesh_refined(spark: SparkSession, d: str) -> DataFrame:
    """Centre and area of each of the four parts of every triangle."""
    work, made = Workspace(spark, "refined"), lattice(spark, d).refined_triangles()
    m = Mesh(work.write(made.points), work.write(made.cells))
    return rounded(m.centers().join(m.measures(), "cid").select("cid", "x", "y", "measure"), 6)


@query(f"WITH RECURSIVE h(cell, x, y, s, d) AS (SELECT cell, x::BIGINT, y::BIGINT, 128::BIGINT, 0::BIGINT FROM {_CELLS} UNION ALL SELECT cell, CASE WHEN ry = 0 THEN fy ELSE x END, CASE WHEN ry = 0 THEN fx ELSE y END, s // 2, d + s * s * xor(3 * rx, ry) FROM (SELECT *, CASE WHEN rx = 1 THEN 255 - x ELSE x END AS fx, CASE WHEN rx = 1 THEN 255 - y ELSE y END AS fy FROM (SELECT *, ((x & s) > 0)::BIGINT AS rx, ((y & s) > 0)::BIGINT AS ry FROM h WHERE s > 0))) SELECT cell, d AS place FROM h WHERE s = 0")
def hilbert_order(spark: SparkSession, d: str) -> DataFrame:
    """The place of every lattice point along the Hilbert curve."""
    n, m = table(spark, d, "nation").count(), table(spark, d, "region").count()
    rows = spark.range(n * m).select(F.col("id").alias("cell"), (F.col("id") % n).alias("x"), F.call_function("div", F.col("id"), F.lit(n)).alias("y"))
    return rows.select("cell", hilbert_key(F.col("x"), F.col("y"), 8).alias("place"))


@query("SELECT cell, neighbour FROM (SELECT (r_regionkey * 25 + n_nationkey)::BIGINT AS cell, n_nationkey AS x, r_regionkey AS y FROM nation, region) a, LATERAL (SELECT unnest([CASE WHEN x > 0 THEN cell - 1 END, CASE WHEN x < 24 THEN cell + 1 END, CASE WHEN y > 0 THEN cell - 25 END, CASE WHEN y < 4 THEN cell + 25 END]) AS neighbour) WHERE neighbour IS NOT NULL")
def grid_neighbours(spark: SparkSession, d: str) -> DataFrame:
    sizes = (table(spark, d, "nation").count(), table(spark, d, "region").count())
    return Grid(sizes, (0.0, 0.0), (1.0, 2.0)).neighbours(spark)


