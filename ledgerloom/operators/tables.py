"""Table-level operators: unions, upserts, fingerprints, gates, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators.latest import one_per_key
from ledgerloom.session import materialise, tasks


def append_unique(existing: DataFrame, new: DataFrame, key: str, ordinal: str) -> tuple[DataFrame, DataFrame]:
    """``(merged, added)``: new rows whose key is not stored yet, the first of each key."""
    added = one_per_key(new, [key], F.col(ordinal)).join(existing.select(key), key, "left_anti").select(*new.columns)
    return existing.unionByName(added, allowMissingColumns=True), added


def fingerprint(table: DataFrame) -> DataFrame:
    """``(n_rows, checksum)`` of a table, whatever its order; equal tables have equal fingerprints."""
    return table.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.xxhash64(*table.columns).cast("decimal(38,0)")), F.lit(0)).alias("checksum"))


def unchanged(before: DataFrame, after: DataFrame) -> bool:
    """Whether two snapshots have the same rows."""
    return fingerprint(before).first() == fingerprint(after).first()


def quality_gate(rows: DataFrame, status: str, blocking: Sequence[str]) -> DataFrame:
    """One row: how many rows block a write, by status, and whether it may go on."""
    counts = [F.count_if(F.col(status) == b).alias(f"n_{b}") for b in blocking]
    return rows.agg(*counts, (F.count_if(F.col(status).isin(*blocking)) == 0).alias("may_write"))


def count_by(rows: DataFrame, column: str, blank: str = "(blank)") -> DataFrame:
    """How many rows each value has; null and blank values share one bucket."""
    value = F.when(F.trim(F.col(column).cast("string")) != "", F.col(column).cast("string"))
    return rows.groupBy(F.coalesce(value, F.lit(blank)).alias("value")).agg(F.count("*").alias("n"))


def histograms(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Independent histograms of several columns in one pass: (kind, value, n)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.inline(pairs)).where("value IS NOT NULL").groupBy("kind", "value").agg(F.count("*").alias("n"))


def union_tagged(**tables: DataFrame) -> DataFrame:
    """Tables of one shape with the name of their source."""
    out = None
    for name, table in tables.items():
        tagged = table.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of ``left`` that ``right`` does not have."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that both tables have."""
    return left.intersect(right)


def first_of_key(rows: DataFrame, key: Column, ordinal: str) -> DataFrame:
    """The first row of each normalised key, in order of appearance."""
    return one_per_key(rows.withColumn("_key", key), ["_key"], F.col(ordinal)).drop("_key")


def fill_blanks(target: DataFrame, source: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Null columns of ``target`` filled from ``source``; ``filled`` lists which."""
    other = source.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = target.join(other, key, "left")
    was = F.array_compact(F.array(*[F.when(F.col(c).isNull() & F.col(f"_{c}").isNotNull(), F.lit(c)) for c in columns]))
    return joined.withColumn("filled", was).withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def patch(target: DataFrame, changes: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """``(patched, log)``: ``changes`` (key, new) set one column; the log has each value that differs."""
    joined = target.join(changes.select(key, F.col("new").alias("_new")), key, "left")
    log = joined.where(F.col("_new").isNotNull() & ~F.col(column).eqNullSafe(F.col("_new"))).select(key, F.lit(column).alias("field"), F.col(column).alias("old"), F.col("_new").alias("new"))
    return joined.withColumn(column, F.coalesce("_new", column)).drop("_new"), log


def within_budget(rows: DataFrame, order: Sequence[Column], size: str, budget: int) -> DataFrame:
    """The rows in a total order while their sizes so far (``spent``, this one's included) fit the budget; sizes are not negative.

    Rows are sorted by ranges; a part's rows are summed up within it, after the sums of the parts before, and parts that begin beyond the budget are not read.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialise(ranged.withColumn("_part", F.shiftright("_at", 33)), "budget")
    sums = ranged.groupBy("_part").agg(F.sum(size).alias("_sum"))
    # one row for each part
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")).where(F.col("_before") <= budget)
    own = F.sum(size).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    spent = ranged.join(F.broadcast(before), "_part").withColumn("spent", F.col("_before") + own)
    return spent.where(F.col("spent") <= budget).drop("_at", "_part", "_before")
