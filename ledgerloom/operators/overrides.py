"""Audited overrides: targeting, conflicts, application and completeness.

Overrides have override_id, the matchers source_document_id, source_file and project_name, source, reason, updated_at, and one column per
override field. Records have record_id, source_document_id, source_file, project_name and the same fields.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import blank_to_null, search_text

STATUSES = ("applied", "no_change", "invalid", "skipped", "ambiguous", "conflict")


def errors(overrides: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Overrides with ``errors``: each of source, reason and updated_at that is blank, no matcher, no field."""
    blank = lambda c: blank_to_null(F.col(c).cast("string")).isNull()
    none = lambda cs: reduce(lambda a, b: a & b, map(blank, cs))
    found = [F.when(blank(c), f"{c} missing") for c in ("source", "reason", "updated_at")]
    found += [F.when(none(("source_document_id", "source_file", "project_name")), "no matcher"), F.when(none(fields), "no field")]
    return overrides.withColumn("errors", F.array_compact(F.array(*found)))


def plan(overrides: DataFrame, records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(override_id, record_id, field, before, after, status)``, one row per override field.

    The first matcher that is not blank decides alone. No record: skipped; several: ambiguous; an equal value: no_change; two overrides
    that want different values for one field: conflict on both. Invalid overrides match nothing.
    """
    judged = errors(overrides, fields)
    key = lambda kind, c: F.when(blank_to_null(F.col(c)).isNotNull(), F.concat(F.lit(kind), search_text(F.col(c))))
    matchers = [("id:", "source_document_id"), ("file:", "source_file"), ("name:", "project_name")]
    wanted = judged.withColumn("_key", F.when(F.size("errors") == 0, F.coalesce(*[key(*m) for m in matchers])))
    spread = records.select("record_id", F.explode(F.array_compact(F.array(*[key(*m) for m in matchers]))).alias("_key"))
    index = spread.groupBy("_key").agg(F.count("*").alias("_hits"), F.min("record_id").alias("_record"))
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("after")) for f in fields])
    rows = wanted.join(index, "_key", "left").select("override_id", "errors", "_hits", F.when(F.col("_hits") == 1, F.col("_record")).alias("record_id"), F.inline(cells)).where(blank_to_null(F.col("after")).isNotNull() | (F.size("errors") > 0))
    base = records.select("record_id", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("before")) for f in fields])))
    joined = rows.join(base, ["record_id", "field"], "left")
    status = F.when(F.size("errors") > 0, "invalid").when(F.col("_hits").isNull(), "skipped").when(F.col("_hits") > 1, "ambiguous").when(F.col("before").eqNullSafe(F.col("after")), "no_change").otherwise("applied")
    first = joined.withColumn("status", status)
    w = Window.partitionBy("record_id", "field")
    clash = F.col("record_id").isNotNull() & (F.min("after").over(w) != F.max("after").over(w))
    return first.withColumn("status", F.when(clash, "conflict").otherwise(F.col("status"))).select("override_id", "record_id", "field", "before", "after", "status")


def apply(planned: DataFrame, records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Records with the applied values; ``overridden`` lists the changed fields."""
    changes = planned.where("status = 'applied'").groupBy("record_id").agg(*[F.max(F.when(F.col("field") == f, F.col("after"))).alias(f"_{f}") for f in fields])
    joined = records.join(changes, "record_id", "left")
    changed = F.array_compact(F.array(*[F.when(F.col(f"_{f}").isNotNull(), F.lit(f)) for f in fields]))
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c).cast("string")).alias(c) if c in fields else F.col(c) for c in records.columns], changed.alias("overridden"))


def stats(planned: DataFrame) -> DataFrame:
    """One row: rows that are applied or unchanged, overrides that are anything else."""
    rows = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES[:2]]
    return planned.agg(*rows, *[F.count_distinct(F.when(F.col("status") == s, F.col("override_id"))).alias(s) for s in STATUSES[2:]])


def completeness(records: DataFrame, weights: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(record_id, score, missing)``: the share of its type's weights that a record fills, in percent.

    ``weights`` (doc_type, field, weight) is a rule table; types without rules score 0.
    """
    cells = records.select("record_id", "doc_type", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), blank_to_null(F.col(f).cast("string")).alias("value")) for f in fields])))
    rated = cells.join(weights, ["doc_type", "field"])
    filled = F.col("value").isNotNull()
    scored = rated.groupBy("record_id").agg(F.round(100.0 * F.sum(F.when(filled, F.col("weight")).otherwise(0)) / F.sum("weight"), 1).alias("score"), F.array_sort(F.collect_set(F.when(~filled, F.col("field")))).alias("missing"))
    return records.select("record_id").join(scored, "record_id", "left").select("record_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))
