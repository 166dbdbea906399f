"""Matrix Market files and edge lists, read and written as distributed text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators.graph import Graph
from ridgeline.operators.matrix import Matrix


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text) of the non-empty lines; line (file, start, id) grows with the place in the file, or in the files of a folder by name."""
    line = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    return spark.read.text(path).select(line.alias("line"), F.trim("value").alias("text")).where("text != ''")


def _words(text: Column) -> Column:
    return F.split(text, r"\s+")


def read_mtx(spark: SparkSession, path: str, keep_symmetric: bool = False) -> Matrix:
    """A coordinate matrix of real, integer or pattern elements, general or symmetric.

    Places count from 1 in the file and from 0 here; a pattern's elements are 1; of elements that
    repeat a place the last counts; a place outside the matrix is an error. A symmetric file is
    mirrored, or with keep_symmetric kept as a symmetric matrix.
    """
    lines = _lines(spark, path)
    first = lines.orderBy("line").limit(1).first()
    head = (first["text"] if first else "").lower().split()
    if len(head) < 5 or head[0] != "%%matrixmarket" or head[1] != "matrix":
        raise ValueError("this is no Matrix Market file")
    if head[2] != "coordinate" or head[3] not in ("real", "integer", "pattern") or head[4] not in ("general", "symmetric"):
        raise ValueError(f"matrices of this kind are not read: {' '.join(head[2:])}")
    body = lines.where(~F.startswith("text", F.lit("%")))
    size = body.orderBy("line").limit(1).first()
    if size is None:
        raise ValueError("the line of dimensions is missing")
    rows, cols, _ = map(int, size["text"].split())
    part = _words(F.col("text"))
    at = lambda k: F.try_element_at(part, F.lit(k))
    value = F.lit(1.0) if head[3] == "pattern" else at(3).cast("double")
    found = body.where(F.col("line") > F.struct(*(F.lit(x) for x in size["line"])).cast("struct<file:string,start:bigint,id:bigint>")).select("line", (at(1).cast("bigint") - 1).alias("row"), (at(2).cast("bigint") - 1).alias("col"), value.alias("v"))
    inside = (F.col("row") >= 0) & (F.col("row") < rows) & (F.col("col") >= 0) & (F.col("col") < cols) & F.col("v").isNotNull()
    found = found.withColumn("v", F.when(inside, F.col("v")).otherwise(F.raise_error(F.lit("an element of the file lies outside the matrix or has no value"))))
    out = Matrix.of(found, rows, cols, symmetric=head[4] == "symmetric", order="line")
    return out if keep_symmetric else out.general()


def read_graph_mtx(spark: SparkSession, path: str, directed: bool = True) -> Graph:
    """The graph of a square matrix's elements; another shape is a ValueError."""
    a = read_mtx(spark, path)
    if a.rows != a.cols:
        raise ValueError("the matrix of a graph must be square")
    arcs = a.elements.select(F.col("row").alias("src"), F.col("col").alias("dst"), "v")
    return Graph.of(arcs.withColumnRenamed("v", "w"), spark.range(a.rows).select(F.col("id").alias("v")), directed)


def write_mtx(matrix: Matrix, path: str, parts: int = 1) -> None:
    """As a Matrix Market file, a head and the stored elements by row and column: text files of a folder that, one after the other, are the file."""
    kind = "symmetric" if matrix.symmetric else "general"
    n = matrix.elements.count()
    head = matrix.spark.createDataFrame([(-2, 0, f"%%MatrixMarket matrix coordinate real {kind}"), (-1, 0, f"{matrix.rows} {matrix.cols} {n}")], "row bigint, col bigint, value string")
    body = matrix.elements.select("row", "col", F.concat_ws(" ", F.col("row") + 1, F.col("col") + 1, "v").alias("value"))
    head.unionByName(body).repartitionByRange(parts, "row", "col").sortWithinPartitions("row", "col").select("value").write.text(path)


def matches(matrix: Matrix, spark: SparkSession, path: str) -> DataFrame:
    """One row: whether a Matrix Market file holds the matrix."""
    return matrix.equals(read_mtx(spark, path))


def find_line(spark: SparkSession, path: str, row: int, col: int) -> DataFrame:
    """(line): where an element (places from 0) stands in a Matrix Market file."""
    lines = _lines(spark, path).where(~F.startswith("text", F.lit("%")))
    part = _words(F.col("text"))
    return lines.where((part[0].cast("bigint") == row + 1) & (part[1].cast("bigint") == col + 1)).select(F.col("line.id").alias("line"))


def write_gnuplot(matrix: Matrix, path: str) -> None:
    """Lines "col -row value" of the non-zeros."""
    matrix.general().elements.where("v != 0").select(F.concat_ws(" ", F.col("col"), -F.col("row"), "v").alias("value")).write.text(path)


def read_edges(spark: SparkSession, path: str, directed: bool = True) -> Graph:
    """Lines "src dst [weight]"; # starts a comment; weight 1 by default; of edges that repeat the first counts."""
    part = _words(F.trim(F.regexp_replace("text", "#.*", "")))
    at = lambda k: F.try_element_at(part, F.lit(k))
    rows = _lines(spark, path).select("line", at(1).try_cast("bigint").alias("src"), at(2).try_cast("bigint").alias("dst"), F.coalesce(at(3).cast("double"), F.lit(1.0)).alias("w"))
    return Graph.of(rows.where("src is not null and dst is not null"), directed=directed, order="line")


def write_edges(graph: Graph, path: str) -> None:
    """Lines "src dst weight" of all arcs; of an undirected graph each edge once."""
    arcs = graph.arcs if graph.directed else graph.arcs.where("src <= dst")
    arcs.select(F.concat_ws(" ", "src", "dst", "w").alias("value")).write.text(path)
