"""The ledger: matching records to its rows, planning updates, applying them.

Ledger rows have row_id (their serial, an integer), record_key, source_note, customer, project and the value fields; records have record_id, an optional row_id, the
same keys, source_file and the fields. Keys are compared as they are: callers normalise them with ``business_key``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import blank_to_null


def match(records: DataFrame, ledger: DataFrame) -> DataFrame:
    """``(record_id, method, row_id, hits)``: explicit row, else record key, else the note that names the source file, else the project of a
    row without a customer. A step with one hit decides; with several the record is ``ambiguous``; without any it is ``new``."""
    note = F.explode(F.split("source_note", r"\s*;\s*"))
    steps = [
        ("row", F.col("row_id").cast("string"), ledger.select(F.col("row_id").cast("string").alias("k"), "row_id")),
        ("key", F.col("record_key"), ledger.select(F.col("record_key").alias("k"), "row_id")),
        ("source", F.col("source_file"), ledger.select(note.alias("k"), "row_id")),
        ("project", F.col("project"), ledger.where(blank_to_null(F.col("customer")).isNull()).select(F.col("project").alias("k"), "row_id")),
    ]
    rows = records
    for name, key, table in steps:
        found = table.where(blank_to_null(F.col("k")).isNotNull()).distinct().groupBy("k").agg(F.count("*").alias(f"_{name}_hits"), F.min("row_id").alias(f"_{name}_row")).withColumnRenamed("k", f"_{name}")
        rows = rows.withColumn(f"_{name}", key).join(found, f"_{name}", "left")
    decided = lambda pick: F.coalesce(*[F.when(F.col(f"_{n}_hits").isNotNull(), pick(n)) for n, _, _ in steps])
    hits = F.coalesce(decided(lambda n: F.col(f"_{n}_hits")), F.lit(0))
    method = F.when(hits > 1, "ambiguous").otherwise(F.coalesce(decided(lambda n: F.lit(n)), F.lit("new")))
    return rows.select("record_id", method.alias("method"), F.when(hits == 1, decided(lambda n: F.col(f"_{n}_row"))).alias("row_id"), hits.alias("hits"))


def plan(records: DataFrame, ledger: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(record_id, row_id, action, conflicts)``: insert, update (blanks to fill), unchanged, conflict (a filled field differs) or ambiguous.

    Planned inserts count for the batch: of new records with one record key the first inserts, the rest are ``joined`` to it.
    """
    matched = match(records, ledger)
    old = ledger.select("row_id", *[F.col(f).alias(f"_{f}") for f in fields])
    joined = records.drop("row_id").join(matched, "record_id").join(old, "row_id", "left")
    filled = lambda c: blank_to_null(F.col(c).cast("string")).isNotNull()
    conflicts = F.array_compact(F.array(*[F.when(filled(f) & filled(f"_{f}") & (F.col(f) != F.col(f"_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"_{f}").cast("string").alias("existing"), F.col(f).cast("string").alias("incoming"))) for f in fields]))
    fills = reduce(lambda a, b: a | b, [filled(f) & ~filled(f"_{f}") for f in fields])
    first = joined.where("method = 'new'").groupBy("record_key").agg(F.min("record_id").alias("_first"))
    out = joined.join(first, "record_key", "left").withColumn("conflicts", conflicts)
    action = F.when(F.col("method") == "ambiguous", "ambiguous").when((F.col("method") == "new") & (F.col("_first").isNull() | (F.col("record_id") == F.col("_first"))), "insert").when(F.col("method") == "new", "joined").when(F.size("conflicts") > 0, "conflict").when(fills, "update").otherwise("unchanged")
    return out.select("record_id", "row_id", action.alias("action"), F.when(action == "conflict", F.col("conflicts")).alias("conflicts"))


def upsert(planned: DataFrame, records: DataFrame, ledger: DataFrame, fields: Sequence[str], overwrite: Sequence[str] = ()) -> DataFrame:
    """The ledger after the plan: blanks are filled (``overwrite`` fields replaced), inserts get the serials after the largest row_id.

    Of several records for one row the smallest record_id fills a field first. Serials are counted in blocks of the order, never in one task.
    """
    updates = planned.where(F.col("action").isin("update", "conflict")).select("record_id", "row_id").join(records.drop("row_id"), "record_id")
    text = lambda f: blank_to_null(F.col(f).cast("string"))
    per_row = updates.groupBy("row_id").agg(*[F.min_by(F.when(text(f).isNotNull(), F.col(f)), F.when(text(f).isNotNull(), F.col("record_id"))).alias(f"_{f}") for f in fields])
    old = ledger.join(per_row, "row_id", "left")
    value = lambda f: F.coalesce(F.col(f"_{f}"), F.col(f)) if f in overwrite else F.coalesce(F.when(text(f).isNotNull(), F.col(f)), F.col(f"_{f}"), F.col(f))
    kept = old.select(*[value(c).alias(c) if c in fields else F.col(c) for c in ledger.columns])
    fresh = planned.where("action = 'insert'").select("record_id").join(records.drop("row_id"), "record_id").withColumn("_block", F.pmod(F.xxhash64("record_id"), F.lit(64)))
    before = fresh.groupBy("_block").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = ledger.agg(F.coalesce(F.max("row_id"), F.lit(0))).scalar()
    serial = last + F.col("_before") + F.row_number().over(Window.partitionBy("_block").orderBy("record_id"))
    added = fresh.join(before, "_block").withColumn("row_id", serial.cast(ledger.schema["row_id"].dataType))
    return kept.unionByName(added.select(*[F.col(c) if c in added.columns else F.lit(None).cast(ledger.schema[c].dataType).alias(c) for c in ledger.columns]))
