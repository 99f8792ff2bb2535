"""JSON at the edge: arrays of objects and envelopes of several arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json_array(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table from files that hold one array of objects each.

    No such path is an empty table, elements that are no objects go, a file that is no array is an error when it is read.
    """
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    array = F.when(F.trim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.raise_error(F.lit("not a JSON array")))
    elements = files.select(F.explode(array).alias("e")).where(F.startswith("e", F.lit("{")))
    return json_rows(elements, "e", schema)


def json_rows(rows: DataFrame, column: str, schema: StructType) -> DataFrame:
    """Objects from a text column; what is no object goes."""
    return rows.select(F.from_json(column, schema, {"mode": "PERMISSIVE"}).alias("r")).where(F.col("r").isNotNull()).select("r.*")


def envelope_rows(rows: DataFrame, column: str, keys: Sequence[str], element: str) -> DataFrame:
    """The elements of all given arrays of an envelope, in key order, one row each with ``place``."""
    fields = ", ".join(": ".join(part.split()) for part in element.split(","))
    parsed = F.from_json(column, ", ".join(f"{k} array<struct<{fields}>>" for k in keys))
    together = F.concat(*[F.coalesce(parsed[k], F.array()) for k in keys])
    return rows.select(*[c for c in rows.columns if c != column], F.posexplode(together).alias("place", "_e")).select("*", "_e.*").drop("_e")
