"""Configuration, the log of JSON lines, polyhedral and image files, and one-task solvers."""

import numpy as np
import pytest

from ridgeline.plans import small
from ridgeline.sources import meshfiles
from ridgeline.sources.config import Description, JsonLines


def description():
    return Description().add("n", kind=int, required=True, allowed=(1, 2, 3)).add("name", default="x").add("sizes", kind=float, many=True).add("fast", kind=bool)


def test_arguments_and_ini():
    assert description().parse_arguments("--n 2 --sizes 1 2.5 --fast yes".split()) == {"n": 2, "sizes": [1.0, 2.5], "fast": True, "name": "x"}
    assert description().parse_ini("n = 3\nsizes = 1, 2\nname = a b\n") == {"n": 3, "sizes": [1.0, 2.0], "name": "a b"}
    for wrong in ("--n 7", "--name", "--odd 1", "--name y", "n 1"):
        with pytest.raises(ValueError):
            description().parse_arguments(wrong.split())


def test_log(spark, tmp_path):
    log = JsonLines(str(tmp_path / "log"), host="h")
    log.write(op="a", time=1.5)
    log.write(op="b", time=2.5)
    assert sorted((r["host"], r["op"], r["time"]) for r in log.read(spark).collect()) == [("h", "a", 1.5), ("h", "b", 2.5)]


def test_polyhedra(spark, tmp_path):
    points = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1.5]])
    faces = [[0, 1, 2], [0, 1, 3], [1, 2, 3], [0, 2, 3]]
    (tmp_path / "t.fpma").write_text(meshfiles.render_fpma(points, faces, [[0, 1, 2, 3]]))
    p, f, c = meshfiles.read_polyhedra(spark, str(tmp_path / "t.fpma"))
    assert (p.count(), f.count(), c.count()) == (4, 12, 4)
    assert [r["pid"] for r in f.where("fid = 2").orderBy("loc").collect()] == [1, 2, 3]


def test_image():
    found = meshfiles.parse_vti('<VTKFile type="ImageData"><ImageData WholeExtent="0 2 0 1 0 0" Origin="0 0 0" Spacing="1 2 1"><Piece><PointData><DataArray type="Float64" Name="u" format="ascii">1 2 3</DataArray></PointData></Piece></ImageData></VTKFile>')
    assert found["extent"] == [0, 2, 0, 1, 0, 0] and found["PointData"]["u"].tolist() == [1, 2, 3]


@pytest.mark.parametrize("method", sorted(small.METHODS))
@pytest.mark.parametrize("kind", small.PRECONDITIONERS)
def test_small_solvers(method, kind):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(30, 30)) * (rng.random((30, 30)) < 0.2) + 12 * np.eye(30)
    x = rng.normal(size=30)
    got = small.METHODS[method](a, a @ x, small.preconditioner(a, kind), 1e-11, 500)
    assert np.allclose(got, x, atol=1e-7)


def test_incomplete_lu_of_full_pattern():
    a = np.random.default_rng(4).normal(size=(6, 6)) + 6 * np.eye(6)
    m = small.incomplete_lu(a)
    assert np.allclose((np.tril(m, -1) + np.eye(6)) @ np.triu(m), a)
