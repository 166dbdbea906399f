"""Text and mesh sources by round trips and literal files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators.graph import Graph
from ridgeline.operators.matrix import Matrix
from ridgeline.operators.mesh import Mesh
from ridgeline.sources import meshfiles, tables, text


def test_mtx_round_trip(spark, tmp_path):
    a = Matrix.from_dense(spark, [[1.5, 0, 2], [0, -3, 0]]).compressed()
    text.write_mtx(a, str(tmp_path / "a"))
    assert text.matches(a, spark, str(tmp_path / "a")).first()["value"] is True


def test_mtx_rules(spark, tmp_path):
    (tmp_path / "s.mtx").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n% note\n3 3 2\n2 1\n3 3\n")
    got = sorted(tuple(r) for r in text.read_mtx(spark, str(tmp_path / "s.mtx")).elements.collect())
    assert got == [(0, 1, 1.0), (1, 0, 1.0), (2, 2, 1.0)]
    (tmp_path / "d.mtx").write_text("%%MatrixMarket matrix coordinate real general\n2 2 2\n1 1 4\n1 1 5\n")
    assert [tuple(r) for r in text.read_mtx(spark, str(tmp_path / "d.mtx")).elements.collect()] == [(0, 0, 5.0)]
    (tmp_path / "o.mtx").write_text("%%MatrixMarket matrix coordinate real general\n2 2 1\n3 1 4\n")
    with pytest.raises(Exception, match="outside"):
        text.read_mtx(spark, str(tmp_path / "o.mtx")).elements.collect()
    (tmp_path / "x.mtx").write_text("%%MatrixMarket matrix array real general\n1 1\n1\n")
    with pytest.raises(ValueError):
        text.read_mtx(spark, str(tmp_path / "x.mtx"))


def test_edges(spark, tmp_path):
    (tmp_path / "e").write_text("# graph\n0 1 2.5\n1 2\n0 1 9 # again\n")
    g = text.read_edges(spark, str(tmp_path / "e"))
    assert sorted(tuple(r) for r in g.arcs.collect()) == [(0, 1, 2.5), (1, 2, 1.0)]
    text.write_edges(g, str(tmp_path / "out"))
    again = text.read_edges(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, again.arcs.collect())) == sorted(map(tuple, g.arcs.collect()))
    assert isinstance(g, Graph) and g.vertices.count() == 3


@pytest.mark.parametrize("kind", ["vtk", "vtu", "ng"])
def test_mesh_round_trip(spark, tmp_path, kind):
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0), (4, 1.0, 1.0, 1.25)], "pid bigint, x double, y double, z double")
    cells = spark.createDataFrame([(0, "tetrahedron", [0, 1, 2, 3]), (1, "tetrahedron", [1, 2, 3, 4])], "cid bigint, shape string, points array<bigint>")
    m = Mesh(points, cells)
    made = {"vtk": meshfiles.render_vtk, "vtu": meshfiles.render_vtu, "ng": meshfiles.render_netgen}[kind](m)
    (tmp_path / f"m.{kind}").write_text(made)
    back = meshfiles.mesh(meshfiles.read(spark, str(tmp_path / f"m.{kind}")))
    assert sorted(map(tuple, back.points.collect())) == sorted(map(tuple, points.collect()))
    assert [(r["shape"], r["points"]) for r in back.cells.orderBy("cid").collect()] == [("tetrahedron", [0, 1, 2, 3]), ("tetrahedron", [1, 2, 3, 4])]
    meshfiles.write(m, str(tmp_path / "parts"), kind, parts=3)
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "parts").glob("part-*")))
    assert whole.decode() == made


def test_compressed_arrays_and_pieces(spark, tmp_path):
    from xml.etree import ElementTree

    values = np.arange(30000) / 8
    node = ElementTree.fromstring(meshfiles.compressed_array("a", "Float64", values))
    assert np.array_equal(meshfiles._array(node, True, "UInt32"), values)
    for k in range(2):
        square = [(0, 0.0 + k), (1, 1.0 + k)]
        points = spark.createDataFrame([(2 * j + i, x, float(j), 0.0) for j in range(2) for i, x in square], "pid bigint, x double, y double, z double")
        m = Mesh(points, spark.createDataFrame([(0, "quadrangle", [0, 1, 3, 2])], "cid bigint, shape string, points array<bigint>"))
        (tmp_path / f"p{k}.vtu").write_text(meshfiles.render_vtu(m))
    (tmp_path / "all.pvtu").write_text('<?xml version="1.0"?><VTKFile type="PUnstructuredGrid"><PUnstructuredGrid><Piece Source="p0.vtu"/><Piece Source="p1.vtu"/></PUnstructuredGrid></VTKFile>')
    whole = meshfiles.mesh_of_pieces(meshfiles.read(spark, str(tmp_path / "all.pvtu")))
    assert whole.points.count() == 6 and sorted(r["measure"] for r in whole.measures().collect()) == [1.0, 1.0]
    assert whole.neighbours().count() == 2


def test_images(spark, tmp_path):
    heights = spark.range(12).select(F.col("id").alias("i"), (F.col("id") * 1.5).alias("v"))
    meshfiles.write_lines(meshfiles.vti_lines(spark, (3, 2), (0.0, 1.0), (0.5, 2.0), points={"height": heights}, cells={"id": spark.range(6).select(F.col("id").alias("i"), F.col("id").alias("v"))}), str(tmp_path / "image"))
    assert {r["i"]: r["v"] for r in meshfiles.read_data(spark, str(tmp_path / "image"), "height", "PointData").collect()} == {k: 1.5 * k for k in range(12)}
    m = meshfiles.mesh(meshfiles.read(spark, str(tmp_path / "image"), "vti"))
    assert (m.points.count(), m.cells.count()) == (12, 6)
    assert {round(r["measure"], 9) for r in m.measures().collect()} == {1.0}


def test_typed_tables(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1.5, "x"), (1, 2.0, "y")], "i bigint, v double, note string")
    tables.save(rows, str(tmp_path / "t"), "vector")
    assert sorted(map(tuple, tables.load(spark, str(tmp_path / "t"), "vector").collect())) == [(0, 1.5, "x"), (1, 2.0, "y")]
    got = tables.load(spark, str(tmp_path / "t"), "vector", "v bigint, i int")
    assert got.dtypes == [("v", "bigint"), ("i", "int")] and sorted(map(tuple, got.collect())) == [(1, 0), (2, 1)]
    assert tables.header(spark, str(tmp_path / "t"))[0] == "vector"
    for kind, schema in (("matrix", None), ("vector", "w double")):
        with pytest.raises(ValueError):
            tables.load(spark, str(tmp_path / "t"), kind, schema)
    rows.write.parquet(str(tmp_path / "bare"))
    with pytest.raises(ValueError, match="header"):
        tables.load(spark, str(tmp_path / "bare"), "vector")


def test_graph_of_matrix_file(spark, tmp_path):
    (tmp_path / "g.mtx").write_text("%%MatrixMarket matrix coordinate real general\n3 3 2\n1 2 4\n3 1 2\n")
    g = text.read_graph_mtx(spark, str(tmp_path / "g.mtx"))
    assert sorted(tuple(r) for r in g.arcs.collect()) == [(0, 1, 4.0), (2, 0, 2.0)] and g.vertices.count() == 3
    (tmp_path / "r.mtx").write_text("%%MatrixMarket matrix coordinate real general\n2 3 1\n1 2 4\n")
    with pytest.raises(ValueError, match="square"):
        text.read_graph_mtx(spark, str(tmp_path / "r.mtx"))
