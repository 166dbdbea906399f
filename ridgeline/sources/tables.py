"""Tables with a type header: what a table holds is stored beside it and checked when it is read."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_HEADER = "_type_header"  # readers of the table pass over names that start with an underscore


def save(df: DataFrame, path: str, kind: str) -> None:
    """Writes df as Parquet with a header of the object's kind and schema; a table in its place is an error."""
    df.write.parquet(path)
    header = json.dumps({"kind": kind, "schema": df.schema.jsonValue()})
    df.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.text(f"{path}/{_HEADER}")


def header(spark: SparkSession, path: str) -> tuple[str, StructType]:
    """Kind and schema of a stored table; without a header a ValueError."""
    try:
        found = [r["value"] for r in spark.read.text(f"{path}/{_HEADER}").limit(2).collect()]
        known = json.loads(found[0])
        return known["kind"], StructType.fromJson(known["schema"])
    except Exception as e:
        raise ValueError(f"no type header at {path}") from e


def load(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """The table of that kind, its columns converted to those of schema (by default as stored).

    Columns that schema does not name are ignored, in the scan already. A header of another kind, or
    without one of the columns, is a ValueError; a value that does not fit its new type is an error
    where it is read.
    """
    stored, columns = header(spark, path)
    if stored != kind:
        raise ValueError(f"{path} holds {stored}, not {kind}")
    wanted = StructType.fromDDL(schema) if schema else columns
    if missing := [f.name for f in wanted if f.name not in columns.names]:
        raise ValueError(f"{path} has no columns {missing}")
    rows = spark.read.schema(columns).parquet(path)
    return rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted))
