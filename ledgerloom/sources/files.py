"""File listings, container signatures and exports that several paths name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, folder: str, suffixes: Sequence[str], skip: Sequence[str] = ()) -> DataFrame:
    """``(name, length)`` of the files below a folder with one of the suffixes, without lock files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    wanted = name.rlike("(?i)(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$") & ~F.startswith(name, F.lit("~$")) & ~name.isin(*(skip or ("",)))
    return files.where(wanted).select(name.alias("name"), "length")


def sniff(content: Column, signatures: Sequence[tuple[bytes, str]], default: str = "unknown") -> Column:
    """The kind of a file by its first bytes."""
    return F.coalesce(*[F.when(F.substring(content, 1, len(s)) == F.lit(bytearray(s)), F.lit(k)) for s, k in signatures], F.lit(default))


def read_exports(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Exports read once each, however often a path is named."""
    return spark.read.parquet(*dict.fromkeys(p.rstrip("/") for p in paths))
