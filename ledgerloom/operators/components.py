"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import remove, scratch_path


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Return ``(id, component)`` for every id that occurs in an edge; ``component`` is the smallest id reachable.

    Self-loops, repeated edges and either direction are allowed; edges with a null end are left out; an empty edge
    table gives an empty result. Each round is two joins on ids, so no neighbourhood is ever collected into one row,
    and each round's edges are written to the shared scratch folder. The number of rounds grows with the logarithm
    of the longest chain.
    """
    spark = edges.sparkSession
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    current = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(a.isNotNull() & b.isNotNull()).distinct()
    current, seen, path = _write(spark, current)
    first, first_path = current, path
    while True:
        both = current.where("u <> v").unionByName(current.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = small.unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        following, state, new_path = _write(spark, after)
        if state == seen:
            remove(spark, new_path)
            break
        if path != first_path:
            remove(spark, path)
        current, seen, path = following, state, new_path
    ends = first.select(F.col("u").alias("id")).unionByName(first.select(F.col("v").alias("id"))).distinct()
    return ends.join(current.where("u <> v").select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def label_rows(rows: DataFrame, classes: DataFrame, on: list[str], members: str, share: int = 1000) -> DataFrame:
    """``rows`` joined to their classes by ``on``; ``members`` says how many rows each class has, and is left out.

    Classes that hold more than one in ``share`` of all rows are fewer than ``share``, so they are broadcast; in the shuffled
    join that the others take no key has more than that share.
    """
    total = classes.agg(F.sum(members)).first()[0] or 0
    large = classes.where(F.col(members) > total / share).drop(members)
    small = classes.where(F.col(members) <= total / share).drop(members)
    if not large.limit(1).count():
        return rows.join(small, on)
    return rows.join(F.broadcast(large), on).unionByName(rows.join(F.broadcast(large.select(*on)), on, "left_anti").join(small, on))


def _write(spark, table: DataFrame):
    path = scratch_path(spark, "components")
    table.write.parquet(path)
    table = spark.read.schema(table.schema).parquet(path)
    row = table.where("u <> v").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return table, (row["n"], row["h"]), path
