"""Registered queries that write tables in file formats of matrices, graphs and meshes and read them back, and those over halos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators.mesh import Mesh
from ridgeline.operators.ndarray import NDArray
from ridgeline.plans.catalogue import _ARCS, _BOTH, _B, events, part_graph, query, rounded, table, trade
from ridgeline.plans.systems import _CELLS, lattice
from ridgeline.session import Workspace
from ridgeline.sources import meshfiles, tables, text


def _path(spark: SparkSession, name: str) -> str:
    """A new folder's name in the session's shared folder."""
    return f"{Workspace(spark, 'files').root}/{name}"


@query("SELECT event_id::BIGINT AS i, trunc(value)::BIGINT AS v FROM events")
def source_typed_table(spark: SparkSession, d: str) -> DataFrame:
    """Values stored as a vector of doubles and loaded as whole numbers; the note is ignored."""
    path = _path(spark, "vector")
    tables.save(events(spark, d).withColumn("note", F.lit("x")), path, "vector")
    return tables.load(spark, path, "vector", "i bigint, v bigint")


@query(f'SELECT r AS "row", c AS col, v::DOUBLE AS v FROM {_B}')
def source_mtx(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "matrix")
    text.write_mtx(trade(spark, d), path, parts=3)
    return text.read_mtx(spark, path).elements.select("row", "col", "v")


@query(f'SELECT a.r AS "row", a.c AS col, (a.v + coalesce(b.v, 0))::DOUBLE AS v FROM {_B} a LEFT JOIN {_B} b ON b.r = a.c AND b.c = a.r UNION ALL SELECT a.c, a.r, a.v FROM {_B} a ANTI JOIN {_B} b ON b.r = a.c AND b.c = a.r')
def source_mtx_symmetric(spark: SparkSession, d: str) -> DataFrame:
    """The matrix plus its transpose: only its lower part is stored, and reading mirrors it."""
    path, a = _path(spark, "symmetric"), trade(spark, d)
    both = a.add(a.transpose(), 1.0, 1.0)
    low = type(both)(both.elements.where("row >= col"), both.rows, both.cols, symmetric=True)
    text.write_mtx(low, path)
    return text.read_mtx(spark, path).elements.select("row", "col", "v")


@query("SELECT unnest(['same', 'changed']) AS name, unnest([true, false]) AS value")
def source_mtx_matches(spark: SparkSession, d: str) -> DataFrame:
    """Whether a file holds a matrix: the one it was written from, and one with another element."""
    path, a = _path(spark, "matrix"), trade(spark, d)
    text.write_mtx(a, path)
    other = a.add_elements(spark.createDataFrame([(1, 1, 1.0)], "row bigint, col bigint, v double"), 1.0)
    same, changed = (text.matches(x, spark, path).select(F.lit(n).alias("name"), "value") for n, x in (("same", a), ("changed", other)))
    return same.unionByName(changed)


@query(f"SELECT c AS x, -r AS y, v::DOUBLE AS v FROM {_B} WHERE v <> 0")
def source_gnuplot(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "plot")
    text.write_gnuplot(trade(spark, d), path)
    word = F.split("value", " ")
    return spark.read.text(path).select(word[0].cast("bigint").alias("x"), word[1].cast("bigint").alias("y"), word[2].cast("double").alias("v"))


@query(f"SELECT src, dst, w FROM {_ARCS}")
def source_edges(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "edges")
    text.write_edges(part_graph(spark, d, True), path)
    return text.read_edges(spark, path).arcs.select("src", "dst", "w")


@query(f"SELECT src, dst, w FROM {_BOTH}")
def source_edges_undirected(spark: SparkSession, d: str) -> DataFrame:
    """Each edge is a line; both arcs come back."""
    path = _path(spark, "edges")
    text.write_edges(part_graph(spark, d, False), path)
    return text.read_edges(spark, path, directed=False).arcs.select("src", "dst", "w")


@query(f"SELECT n_nationkey::BIGINT AS v, count(c) AS degree FROM nation LEFT JOIN {_B} ON r = n_nationkey GROUP BY 1")
def source_graph_mtx(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "graph")
    text.write_mtx(trade(spark, d), path)
    return text.read_graph_mtx(spark, path).degrees()


# Meshes: the lattice of triangles, by what is left when a file is read back.

_TRIANGLES = f"(SELECT 2 * cell + half AS cid, round(x + 2.0 / 3 - half / 3.0, 6)::DOUBLE AS x, round(2 * (y + 1.0 / 3 + half / 3.0), 6)::DOUBLE AS y FROM {_CELLS}, (SELECT unnest([0, 1]) AS half))"
_TRIANGLE_ROWS = f"SELECT row_number() OVER (ORDER BY cid) - 1 AS cid, x, y, 1.0::DOUBLE AS measure FROM {_TRIANGLES}"


def _triangles(m: Mesh) -> DataFrame:
    return rounded(m.centers().join(m.measures(), "cid").select("cid", "x", "y", "measure"), 6)


def _held(spark: SparkSession, m: Mesh) -> Mesh:
    work = Workspace(spark, "mesh")
    return Mesh(work.write(m.points), work.write(m.cells))


def _mesh_query(kind: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        path = _path(spark, kind)
        meshfiles.write(_held(spark, lattice(spark, d)), path, kind)
        return _triangles(_held(spark, meshfiles.mesh(meshfiles.read(spark, path, kind))))

    f.__name__ = f"source_mesh_{kind}"
    query(_TRIANGLE_ROWS)(f)


for _kind in ("vtk", "vtu", "ng"):
    _mesh_query(_kind)


@query(f"SELECT x, y, count(*) AS cells, 1.0::DOUBLE AS measure FROM {_TRIANGLES} GROUP BY x, y")
def source_mesh_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Even and odd triangles as files of their own, with a file that names them; read back as one mesh."""
    path = _path(spark, "pieces")
    m = _held(spark, lattice(spark, d))
    for k in range(2):
        cells = m.cells.where(F.col("cid") % 2 == k)
        used = cells.select(F.explode("points").alias("pid")).distinct()
        meshfiles.write(Mesh(m.points.join(used, "pid"), cells), f"{path}/p{k}", "vtu")
    head = '<?xml version="1.0"?><VTKFile type="PUnstructuredGrid"><PUnstructuredGrid><Piece Source="p0"/><Piece Source="p1"/></PUnstructuredGrid></VTKFile>'
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.text(f"{path}/all")
    whole = _held(spark, meshfiles.mesh_of_pieces(meshfiles.read(spark, f"{path}/all", "pvtu")))
    return _triangles(whole).groupBy("x", "y", "measure").agg(F.count(F.lit(1)).alias("cells"))


@query("SELECT (row_number() OVER (ORDER BY c_custkey) - 1)::BIGINT AS i, c_acctbal AS v FROM customer ORDER BY c_custkey LIMIT (SELECT count(*) * (SELECT count(*) FROM region) FROM nation)")
def source_image(spark: SparkSession, d: str) -> DataFrame:
    """Balances of the first customers as an array over the cells of a nations x regions image."""
    n, m = table(spark, d, "nation").count(), table(spark, d, "region").count()
    path = _path(spark, "image")
    values = table(spark, d, "customer").where(F.col("c_custkey") < n * m).select(F.col("c_custkey").alias("i"), F.col("c_acctbal").alias("v"))
    meshfiles.write_lines(meshfiles.vti_lines(spark, (n, m), (0.0, 0.0), (1.0, 2.0), cells={"balance": values}), path)
    return meshfiles.read_data(spark, path, "balance")


# Halos of a nations x regions array.

_BOX = "(SELECT n_nationkey::BIGINT AS i0, r_regionkey::BIGINT AS i1, (n_nationkey * 5 + r_regionkey)::DOUBLE AS v FROM nation, region)"


def _box(spark: SparkSession, d: str) -> NDArray:
    return NDArray.of(spark, (table(spark, d, "nation").count(), table(spark, d, "region").count()), lambda i, j: (i * 5 + j).cast("double"))


@query(f"SELECT a.i0, a.i1, 4 * a.v - sum(b.v) AS v FROM {_BOX} a JOIN {_BOX} b ON (b.i1 = a.i1 AND b.i0 IN ((a.i0 + 1) % 25, (a.i0 + 24) % 25)) OR (b.i0 = a.i0 AND b.i1 IN ((a.i1 + 1) % 5, (a.i1 + 4) % 5)) GROUP BY a.i0, a.i1, a.v")
def stencil_periodic(spark: SparkSession, d: str) -> DataFrame:
    """A five-point stencil where the ends of both axes are neighbours."""
    return _box(spark, d).stencil({(0, 0): 4.0, (1, 0): -1.0, (-1, 0): -1.0, (0, 1): -1.0, (0, -1): -1.0}, (True, True)).elements


@query(f"SELECT b::BIGINT AS b0, 0::BIGINT AS b1, p::BIGINT AS i0, i1, v, p < 10 * b OR p >= least(10 * b + 10, 25) AS ghost FROM (SELECT unnest([0, 1, 2]) AS b) JOIN (SELECT unnest(range(-2, 27)) AS p) ON p >= 10 * b - 2 AND p < least(10 * b + 10, 25) + 2 JOIN {_BOX} ON i0 = (p + 25) % 25")
def halo_exchange(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of ten nations with the two nations on each side, around the ends."""
    return _box(spark, d).halo((10, 5), 2, (True, False))
