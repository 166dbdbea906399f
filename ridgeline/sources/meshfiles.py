"""Mesh files: readers of VTK legacy (ASCII), VTU and VTI (ASCII, base64, zlib), files of their pieces, Netgen and polyhedra; writers of VTK, VTU, VTI, Netgen, gnuplot and Asymptote.

A file is parsed as a whole inside one task; many files, or pieces of one mesh, are read in parallel.
The result is one row a file with arrays, which mesh() turns into frames of points and cells. A
writer makes the lines of a file as a frame, in parallel, and sorts them by range.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.operators.mesh import Mesh, deduplicated
from ridgeline.operators.scan import row_numbers, scan

#: Cell types of the VTK formats.
VTK_SHAPES = {1: "vertex", 3: "edge", 5: "triangle", 7: "polygon", 9: "quadrangle", 10: "tetrahedron", 12: "hexahedron", 13: "wedge", 14: "pyramid"}
VTK_TYPES = {v: k for k, v in VTK_SHAPES.items()}
_KINDS = {"Float32": "<f4", "Float64": "<f8", "Int8": "<i1", "UInt8": "<u1", "Int16": "<i2", "UInt16": "<u2", "Int32": "<i4", "UInt32": "<u4", "Int64": "<i8", "UInt64": "<u8"}

Parsed = tuple[np.ndarray, list[str], list[list[int]]]
_SCHEMA = "path string, x array<double>, y array<double>, z array<double>, shapes array<string>, cells array<array<bigint>>"


def parse_vtk(text: str) -> Parsed:
    """Points, shapes and cells of a legacy file with an unstructured grid in ASCII."""
    words = iter(text.split("\n", 2)[2].split())
    points, cells, shapes = np.zeros((0, 3)), [], []
    for word in words:
        key = word.upper()
        if key == "BINARY":
            raise ValueError("binary legacy files are not read")
        if key == "POINTS":
            n = int(next(words))
            next(words)
            points = np.array([float(next(words)) for _ in range(3 * n)]).reshape(n, 3)
        elif key == "CELLS":
            n, _ = int(next(words)), next(words)
            follows = next(words)
            if follows.upper() == "OFFSETS":  # version 5: offsets, then connectivity
                next(words)
                offsets = [int(next(words)) for _ in range(n)]
                next(words), next(words)
                flat = [int(next(words)) for _ in range(offsets[-1])]
                cells = [flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
            else:
                size = int(follows)
                for k in range(n):
                    size = size if k == 0 else int(next(words))
                    cells.append([int(next(words)) for _ in range(size)])
        elif key == "CELL_TYPES":
            shapes = [VTK_SHAPES.get(int(next(words)), "unknown") for _ in range(int(next(words)))]
        elif key in ("CELL_DATA", "POINT_DATA"):
            break
    return points, shapes, cells


def _array(node: ElementTree.Element, compressed: bool, header: str) -> np.ndarray:
    kind = np.dtype(_KINDS[node.get("type")])
    body = (node.text or "").strip()
    if node.get("format", "ascii") == "ascii":
        return np.array(body.split(), float).astype(kind)
    if node.get("format") != "binary":
        raise ValueError("appended data are not read")
    wide = np.dtype(_KINDS[header])
    if not compressed:
        raw = base64.b64decode(body)
        size = int(np.frombuffer(raw, wide, 1)[0])
        return np.frombuffer(raw[wide.itemsize : wide.itemsize + size], kind)
    first = base64.b64decode(body[: 4 * -(-wide.itemsize // 3)])
    blocks = int(np.frombuffer(first[: wide.itemsize], wide)[0])
    head_bytes = wide.itemsize * (3 + blocks)
    head_chars = 4 * -(-head_bytes // 3)
    sizes = np.frombuffer(base64.b64decode(body[:head_chars])[:head_bytes], wide)[3:].astype(int)
    raw = base64.b64decode(body[head_chars:])
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(zlib.decompress(raw[e - s : e]) for s, e in zip(sizes, ends, strict=True)), kind)


def parse_vtu(text: str) -> Parsed:
    """Points, shapes and cells of an XML file with an unstructured grid."""
    root = ElementTree.fromstring(text)
    compressed, header = root.get("compressor") is not None, root.get("header_type", "UInt32")
    piece = root.find("./UnstructuredGrid/Piece")
    read = lambda node: _array(node, compressed, header)
    points = read(piece.find("./Points/DataArray")).astype(float).reshape(-1, 3)
    named = {n.get("Name"): n for n in piece.findall("./Cells/DataArray")}
    flat, offsets = read(named["connectivity"]).astype(int), read(named["offsets"]).astype(int)
    shapes = [VTK_SHAPES.get(int(t), "unknown") for t in read(named["types"])]
    return points, shapes, [flat[a:b].tolist() for a, b in zip(np.append(0, offsets[:-1]), offsets, strict=True)]


def parse_netgen(text: str) -> Parsed:
    """Points and simplices of a Netgen neutral file: points, then lines of a domain number and places from 1."""
    lines = iter([x for x in text.split("\n") if x.strip()])
    points = np.array([[float(x) for x in next(lines).split()] for _ in range(int(next(lines)))])
    dim = points.shape[1] if len(points) else 3
    cells = [[int(x) - 1 for x in next(lines).split()[1 : dim + 2]] for _ in range(int(next(lines)))]
    if dim < 3:
        points = np.column_stack((points, np.zeros((len(points), 3 - dim))))
    return points, [{2: "edge", 3: "triangle", 4: "tetrahedron"}[len(c)] for c in cells], cells


def parse_fpma(text: str) -> tuple[np.ndarray, list[list[int]], list[list[int]]]:
    """Points, faces (their points) and cells (their faces) of a polyhedral file; # starts a comment."""
    words = iter(" ".join(line.partition("#")[0] for line in text.split("\n")).split())

    def lists() -> list[list[int]]:
        return [[int(next(words)) for _ in range(int(next(words)))] for _ in range(int(next(words)))]

    points = np.array([float(next(words)) for _ in range(3 * int(next(words)))]).reshape(-1, 3)
    return points, lists(), lists()


def render_fpma(points: np.ndarray, faces: list[list[int]], cells: list[list[int]]) -> str:
    out = [f"# {len(points)}: number of vertices", str(len(points)), " ".join(repr(float(x)) for x in points.ravel())]
    for name, rows in (("faces", faces), ("cells", cells)):
        out += [f"# {len(rows)}: number of {name}", str(len(rows)), *(" ".join(map(str, [len(r), *r])) for r in rows)]
    return "\n".join(out) + "\n"


def read_polyhedra(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points (pid, x, y, z), face points (fid, loc, pid) and cell faces (cid, loc, fid) of one polyhedral file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for content in pdf.content:
                points, faces, cells = parse_fpma(bytes(content).decode())
                rows.append((points[:, 0], points[:, 1], points[:, 2], faces, cells))
            yield pd.DataFrame(rows, columns=["x", "y", "z", "faces", "cells"])

    one = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "x array<double>, y array<double>, z array<double>, faces array<array<bigint>>, cells array<array<bigint>>")
    points = one.select(F.posexplode(F.arrays_zip("x", "y", "z")).alias("pid", "p")).select(F.col("pid").cast("bigint").alias("pid"), "p.x", "p.y", "p.z")
    nested = lambda column, outer, inner: one.select(F.posexplode(column).alias(outer, "all")).select(F.col(outer).cast("bigint").alias(outer), F.posexplode("all").alias("loc", inner))
    return points, nested("faces", "fid", "pid"), nested("cells", "cid", "fid")


def parse_vti(text: str) -> dict:
    """Extent, origin, spacing, and named point and cell arrays of an XML image file."""
    root = ElementTree.fromstring(text)
    compressed, header = root.get("compressor") is not None, root.get("header_type", "UInt32")
    image = root.find("./ImageData")
    numbers = lambda name, kind: [kind(x) for x in image.get(name).split()]
    out: dict = {"extent": numbers("WholeExtent", int), "origin": numbers("Origin", float), "spacing": numbers("Spacing", float)}
    for side in ("PointData", "CellData"):
        out[side] = {n.get("Name"): _array(n, compressed, header) for n in image.findall(f"./Piece/{side}/DataArray")}
    return out


def attributes(text: str) -> dict[str, dict[str, np.ndarray]]:
    """Named point and cell arrays of an XML mesh or image file, those of several components as rows."""
    root = ElementTree.fromstring(text)
    compressed, header = root.get("compressor") is not None, root.get("header_type", "UInt32")
    out: dict[str, dict[str, np.ndarray]] = {}
    for side in ("PointData", "CellData"):
        found = {n.get("Name"): (_array(n, compressed, header), int(n.get("NumberOfComponents", 1))) for n in root.findall(f".//Piece/{side}/DataArray")}
        out[side] = {k: v if c == 1 else v.reshape(-1, c) for k, (v, c) in found.items()}
    return out


def parse_vti_cells(text: str) -> Parsed:
    """The points and cells (edges, quadrangles or hexahedra) of an image file."""
    image = parse_vti(text)
    lows, highs = np.array(image["extent"][0::2]), np.array(image["extent"][1::2])
    n = highs - lows
    axes = [np.arange(lo, hi + 1) for lo, hi in zip(lows, highs, strict=True)]
    z, y, x = np.meshgrid(axes[2], axes[1], axes[0], indexing="ij")
    points = np.column_stack([o + s * c.ravel() for o, s, c in zip(image["origin"], image["spacing"], (x, y, z), strict=True)])
    dim = int((n > 0).sum())
    k, j, i = np.meshgrid(*(np.arange(max(m, 1)) for m in n[::-1]), indexing="ij")
    first = (i + (n[0] + 1) * (j + (n[1] + 1) * k)).ravel()
    row, layer = n[0] + 1, (n[0] + 1) * (n[1] + 1)
    corners = {1: (0, 1), 2: (0, 1, row + 1, row), 3: (0, 1, row + 1, row, layer, layer + 1, layer + row + 1, layer + row)}[dim]
    cells = (first[:, None] + np.array(corners)).tolist()
    return points, [{1: "edge", 2: "quadrangle", 3: "hexahedron"}[dim]] * len(cells), cells


PARSERS = {"vtk": parse_vtk, "vtu": parse_vtu, "ng": parse_netgen, "vti": parse_vti_cells}
#: Extensions of files that name pieces, and of these.
PIECES = {"pvtu": "vtu", "pvti": "vti"}


def read(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A row a file: path, x, y, z, shapes, cells. The kind is that of the files' extension by default; files of pieces give a row a piece."""
    kind = kind or path.rstrip("/*").rsplit(".", 1)[-1]
    if kind in PIECES:
        text = spark.read.text(path, wholetext=True).first()["value"]
        names = [n.get("Source") for n in ElementTree.fromstring(text).iter("Piece")]
        folder = path.rsplit("/", 1)[0]
        return _read(spark, [f"{folder}/{n}" for n in names], PIECES[kind])
    return _read(spark, [path], kind)


def _read(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    parse = PARSERS[kind]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for name, content in zip(pdf.path, pdf.content, strict=True):
                points, shapes, cells = parse(bytes(content).decode())
                rows.append((name, points[:, 0], points[:, 1], points[:, 2], shapes, cells))
            yield pd.DataFrame(rows, columns=["path", "x", "y", "z", "shapes", "cells"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, _SCHEMA)


def read_data(spark: SparkSession, path: str, name: str, side: str = "CellData") -> DataFrame:
    """(i, v) of a named array of an XML mesh or image file; components of one place follow one another."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for content in pdf.content:
                values = np.asarray(attributes(bytes(content).decode())[side][name], float).ravel()
                yield pd.DataFrame({"i": np.arange(len(values)), "v": values})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "i bigint, v double")


def mesh_of_pieces(parsed: DataFrame) -> Mesh:
    """One mesh of all parsed files, in the order of their paths; points of equal coordinates become one."""
    sizes = parsed.select("path", F.size("x").alias("n"), F.size("shapes").alias("k"))
    order = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    before = sizes.select("path", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("p0"), F.coalesce(F.sum("k").over(order), F.lit(0)).alias("c0"))
    rows = parsed.join(before, "path")
    points = rows.select("p0", F.posexplode(F.arrays_zip("x", "y", "z")).alias("at", "p")).select((F.col("p0") + F.col("at")).alias("pid"), "p.x", "p.y", "p.z")
    cells = rows.select("p0", "c0", F.posexplode(F.arrays_zip("shapes", "cells")).alias("at", "c")).select((F.col("c0") + F.col("at")).alias("cid"), F.col("c.shapes").alias("shape"), F.transform("c.cells", lambda p: p + F.col("p0")).alias("points"))
    return deduplicated(points, cells)


def mesh(parsed: DataFrame) -> Mesh:
    """The mesh of one parsed file."""
    points = parsed.select(F.posexplode(F.arrays_zip("x", "y", "z")).alias("pid", "p")).select(F.col("pid").cast("bigint").alias("pid"), "p.x", "p.y", "p.z")
    cells = parsed.select(F.posexplode(F.arrays_zip("shapes", "cells")).alias("cid", "c")).select(F.col("cid").cast("bigint").alias("cid"), F.col("c.shapes").alias("shape"), F.col("c.cells").alias("points"))
    return Mesh(points, cells)


# Writers: a file is a frame of lines, made and sorted in parallel; no mesh comes to the driver.


def _placed(m: Mesh) -> tuple[DataFrame, DataFrame]:
    """Points (place, x, y, z) and cells (place, shape, points), numbered in the order of their ids; cells hold places."""
    points = row_numbers(m.points.select("pid", "x", "y", "z"), "pid", "place")
    cells = row_numbers(m.cells.select("cid", "shape", "points"), "cid", "place")
    corners = cells.select(F.col("place").alias("cell"), "shape", F.posexplode("points").alias("loc", "pid")).join(points.select("pid", F.col("place").alias("at")), "pid")
    lists = corners.groupBy(F.col("cell").alias("place"), "shape").agg(F.transform(F.array_sort(F.collect_list(F.struct("loc", "at"))), lambda p: p["at"]).alias("points"))
    return points, lists


def _section(number: int, rows: DataFrame, value: Column, place: str | Column = "place") -> DataFrame:
    return rows.select(F.lit(number).alias("section"), F.col(place).alias("place") if isinstance(place, str) else place.alias("place"), value.alias("value"))


def _joined(spark: SparkSession, heads: dict[int, list[str]], *sections: DataFrame) -> DataFrame:
    """(section, place, value): the lines of a file. heads: whole sections of a few lines."""
    out = spark.createDataFrame([(k, i, line) for k, lines in heads.items() for i, line in enumerate(lines)], "section int, place bigint, value string")
    for s in sections:
        out = out.unionByName(s.select("section", F.col("place").cast("bigint").alias("place"), "value"))
    return out


def _numbers(m: Mesh) -> tuple[int, int, int]:
    """How many points and cells there are, and how many places the cells hold."""
    cells = m.cells.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("points")), F.lit(0))).first()
    return m.points.count(), cells[0], cells[1]


def _type_of() -> Column:
    return F.element_at(F.create_map(*(x for k, v in VTK_TYPES.items() for x in (F.lit(k), F.lit(v)))), F.col("shape"))


def _coordinates(*names: str) -> Column:
    return F.concat_ws(" ", *(F.col(n).cast("string") for n in names))


def vtk_lines(m: Mesh) -> DataFrame:
    """A legacy ASCII file."""
    points, cells = _placed(m)
    n, k, size = _numbers(m)
    heads = {0: ["# vtk DataFile Version 2.0", "mesh", "ASCII", "DATASET UNSTRUCTURED_GRID", f"POINTS {n} double"], 2: [f"CELLS {k} {size + k}"], 4: [f"CELL_TYPES {k}"]}
    corners = F.concat_ws(" ", F.size("points").cast("string"), F.col("points").cast("array<string>"))
    return _joined(m.points.sparkSession, heads, _section(1, points, _coordinates("x", "y", "z")), _section(3, cells, corners), _section(5, cells, _type_of().cast("string")))


def vtu_lines(m: Mesh) -> DataFrame:
    """An XML file with ASCII arrays."""
    points, cells = _placed(m)
    n, k, _ = _numbers(m)
    array = lambda kind, name, extra="": f'<DataArray type="{kind}" Name="{name}"{extra} format="ascii">'
    heads = {
        0: ['<?xml version="1.0"?>', '<VTKFile type="UnstructuredGrid" version="1.0" byte_order="LittleEndian" header_type="UInt32">', f'<UnstructuredGrid><Piece NumberOfPoints="{n}" NumberOfCells="{k}">', "<Points>" + array("Float64", "Points", ' NumberOfComponents="3"')],
        2: ["</DataArray></Points>", "<Cells>" + array("Int64", "connectivity")],
        4: ["</DataArray>", array("Int64", "offsets")],
        6: ["</DataArray>", array("UInt8", "types")],
        8: ["</DataArray></Cells>", "</Piece></UnstructuredGrid></VTKFile>"],
    }
    ends = scan(cells.select(F.col("place").alias("i"), F.size("points").cast("bigint").alias("v")))
    return _joined(m.points.sparkSession, heads, _section(1, points, _coordinates("x", "y", "z")), _section(3, cells, F.concat_ws(" ", F.col("points").cast("array<string>"))), _section(5, ends, F.col("scan").cast("string"), "i"), _section(7, cells, _type_of().cast("string")))


def netgen_lines(m: Mesh) -> DataFrame:
    """A Netgen neutral file of triangles (of points x, y) or tetrahedra; other shapes are an error."""
    points, cells = _placed(m)
    n, k, size = _numbers(m)
    dim = size // k - 1 if k else 3
    bad = F.raise_error(F.lit("the format holds one kind of simplices"))
    corners = F.when(F.size("points") == dim + 1, F.concat_ws(" ", F.lit("1"), F.transform("points", lambda p: (p + 1).cast("string")))).otherwise(bad.cast("string"))
    heads = {0: [str(n)], 2: [str(k)], 4: ["0"]}
    return _joined(m.points.sparkSession, heads, _section(1, points, _coordinates(*"xyz"[:dim])), _section(3, cells, corners))


def gnuplot_lines(m: Mesh) -> DataFrame:
    """For each cell its points, a line each, the first again at the end, and a blank line."""
    corners = m.cells.select("cid", F.posexplode(F.concat("points", F.slice("points", 1, 1))).alias("loc", "pid")).join(m.points, "pid")
    lists = corners.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("loc", "x", "y", "z"))).alias("p"))
    text = F.concat(F.array_join(F.transform("p", lambda p: F.concat_ws(" ", *(p[c].cast("string") for c in "xyz"))), "\n"), F.lit("\n"))
    return _joined(m.points.sparkSession, {}, _section(0, lists, text, "cid"))


def asymptote_lines(m: Mesh) -> DataFrame:
    """A drawing of flat cells: a closed path for each."""
    corners = m.cells.select("cid", F.posexplode("points").alias("loc", "pid")).join(m.points, "pid")
    lists = corners.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("loc", "x", "y"))).alias("p"))
    text = F.concat(F.lit("draw("), F.array_join(F.transform("p", lambda p: F.concat(F.lit("("), p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit(")"))), "--"), F.lit("--cycle);"))
    return _joined(m.points.sparkSession, {0: ["size(500);"]}, _section(1, lists, text, "cid"))


def vti_lines(spark: SparkSession, sizes: tuple[int, ...], origin: tuple[float, ...], spacing: tuple[float, ...], points: dict[str, DataFrame] | None = None, cells: dict[str, DataFrame] | None = None) -> DataFrame:
    """An XML image file of sizes cells, with named arrays (i, v) over points or cells in storage order (x fastest)."""
    three = lambda values, rest: " ".join(str(x) for x in (*values, *[rest] * (3 - len(values))))
    extent = " ".join(f"0 {s}" for s in (*sizes, *[0] * (3 - len(sizes))))
    heads = {0: ['<?xml version="1.0"?>', '<VTKFile type="ImageData" version="1.0" byte_order="LittleEndian" header_type="UInt32">', f'<ImageData WholeExtent="{extent}" Origin="{three(origin, 0.0)}" Spacing="{three(spacing, 0.0)}">', f'<Piece Extent="{extent}">']}
    sections, at = [], 1
    for side, arrays in (("PointData", points or {}), ("CellData", cells or {})):
        heads[at] = [f"<{side}>"]
        at += 1
        for name, rows in arrays.items():
            heads[at] = [f'<DataArray type="Float64" Name="{name}" format="ascii">']
            sections.append(_section(at + 1, rows, F.col("v").cast("double").cast("string"), "i"))
            heads[at + 2] = ["</DataArray>"]
            at += 3
        heads[at] = [f"</{side}>"]
        at += 1
    heads[at] = ["</Piece></ImageData></VTKFile>"]
    return _joined(spark, heads, *sections)


LINES = {"vtk": vtk_lines, "vtu": vtu_lines, "ng": netgen_lines, "gplt": gnuplot_lines, "asy": asymptote_lines}


def write_lines(lines: DataFrame, path: str, parts: int = 1) -> None:
    """Lines as text files of a folder that, one after the other, are the file; with one part, one file."""
    dealt = lines.repartitionByRange(parts, "section", "place") if parts > 1 else lines.coalesce(1)
    dealt.sortWithinPartitions("section", "place").select("value").write.text(path)


def write(m: Mesh, path: str, kind: str, parts: int = 1) -> None:
    """A mesh as a file of the kind (a key of LINES)."""
    write_lines(LINES[kind](m), path, parts)


def _text(lines: DataFrame) -> str:
    """The lines of a file that fits the driver."""
    return "".join(r["value"] + "\n" for r in lines.orderBy("section", "place").toLocalIterator())


def render_vtk(m: Mesh) -> str:
    return _text(vtk_lines(m))


def render_vtu(m: Mesh) -> str:
    return _text(vtu_lines(m))


def render_netgen(m: Mesh) -> str:
    return _text(netgen_lines(m))


def compressed_array(name: str, kind: str, values: np.ndarray, block: int = 1 << 15) -> str:
    """An XML array in base64, in zlib blocks of so many bytes, with the sizes before them."""
    raw = values.astype(_KINDS[kind]).tobytes()
    blocks = [zlib.compress(raw[k : k + block]) for k in range(0, len(raw), block)]
    head = struct.pack(f"<{3 + len(blocks)}I", len(blocks), block, len(raw) % block, *map(len, blocks))
    return f'<DataArray type="{kind}" Name="{name}" format="binary">{base64.b64encode(head).decode()}{base64.b64encode(b"".join(blocks)).decode()}</DataArray>'
