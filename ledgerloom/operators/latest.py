"""Latest-wins, first-wins and ordered-history operators. Every order is total: callers name an ordinal column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import blank_to_null


def one_per_key(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``. The window's group limit keeps one row per key and task before the shuffle."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def preferred_item(items: DataFrame, key: str) -> DataFrame:
    """One item of each filled key: completed before others, then no duplicate, then visible, then the oldest; ``ordinal`` breaks ties."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return one_per_key(items.where(blank_to_null(F.col(key)).isNotNull()), [key], ~flag("completed"), flag("duplicate"), flag("hidden"), F.coalesce("created_time", F.lit("")), F.col("ordinal"))


def converge(items: DataFrame, key: str, item_id: str) -> DataFrame:
    """``(item_id, key, hidden, duplicate_of, attempts)``: of the items of one key the preferred one stays, the others are hidden duplicates of it.

    ``attempts`` counts the key's items. Items without a key stay as they are, alone.
    """
    kept = preferred_item(items, key).select(key, F.col(item_id).alias("_primary"))
    counted = items.groupBy(key).agg(F.count("*").alias("attempts"))
    joined = items.join(kept, key, "left").join(counted, key, "left")
    other = F.coalesce(F.col(item_id) != F.col("_primary"), F.lit(False))
    return joined.select(item_id, key, other.alias("hidden"), F.when(other, F.col("_primary")).alias("duplicate_of"), F.coalesce("attempts", F.lit(1)).cast("long").alias("attempts"))


def latest(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The last row of each key by the given columns."""
    return one_per_key(rows, keys, *[F.col(c).desc_nulls_last() for c in order])


def with_value_latest(rows: DataFrame, key: str, value: str, wanted: str, allowed: Sequence[str], *order: str) -> DataFrame:
    """Keys whose latest value is ``wanted``; an unknown value is an error."""
    if wanted not in allowed:
        raise ValueError(f"{wanted!r} is not one of {sorted(allowed)}")
    return latest(rows, [key], *order).where(F.col(value) == wanted)


def history(rows: DataFrame, key: str, columns: Sequence[str], *order: str) -> DataFrame:
    """Each key's number in its own order: a long key is sorted by Spark, never collected."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).select(key, "place", *columns)


def replay(events: DataFrame, key: str, status: str, *order: str) -> DataFrame:
    """Status changes in order: of neighbouring equal statuses the last stays; ``is_final`` marks the last of a key."""
    window = Window.partitionBy(key).orderBy(*order)
    following = F.lead(status).over(window)
    kept = events.withColumn("_next", following).where(F.col("_next").isNull() | (F.col("_next") != F.col(status)))
    return kept.withColumn("is_final", F.col("_next").isNull()).drop("_next")


def last_write_first_place(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The last row of each key, at the position of its first."""
    window = Window.partitionBy(key)
    placed = rows.withColumns({"first_place": F.min(ordinal).over(window), "_last": F.max(ordinal).over(window)})
    return placed.where(F.col(ordinal) == F.col("_last")).drop("_last")


def overlay(rows: DataFrame, key: str, precedence: str, columns: Sequence[str]) -> DataFrame:
    """One row per key; each column has its value of the highest precedence that is not blank."""
    text = lambda c: blank_to_null(F.col(c).cast("string"))
    return rows.groupBy(key).agg(*[F.max_by(F.when(text(c).isNotNull(), F.col(c)), F.when(text(c).isNotNull(), F.col(precedence))).alias(c) for c in columns])


def merge_fields(rows: DataFrame, key: str, ordinal: str, columns: Sequence[str], notes: str) -> DataFrame:
    """One row per key: each column's first value that is not blank, and the distinct notes in order, joined."""
    text = lambda c: blank_to_null(F.col(c).cast("string"))
    first = [F.min_by(F.when(text(c).isNotNull(), F.col(c)), F.when(text(c).isNotNull(), F.col(ordinal))).alias(c) for c in columns]
    seen = rows.where(text(notes).isNotNull()).groupBy(key, notes).agg(F.min(ordinal).alias("at"))
    joined = seen.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(notes).alias("note")))), lambda x: x["note"]), "; ").alias(notes))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*first).join(joined, key, "left")


def continuation_merge(rows: DataFrame, group: str, ordinal: str, is_head: Column, values: Sequence[str]) -> DataFrame:
    """Rows that continue a keyed row fold into it: ``island`` numbers the keyed rows, each value's distinct texts are joined in order."""
    window = Window.partitionBy(group).orderBy(ordinal)
    marked = rows.withColumn("island", F.sum(is_head.cast("int")).over(window)).where("island > 0")
    parts = []
    for v in values:
        seen = marked.where(F.col(v).isNotNull()).groupBy(group, "island", v).agg(F.min(ordinal).alias("at"))
        parts.append(seen.groupBy(group, "island").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(v).alias("v")))), lambda x: x["v"]), "; ").alias(v)))
    out = marked.groupBy(group, "island").agg(F.count("*").alias("n_rows"), F.min(ordinal).alias("first_row"))
    for p in parts:
        out = out.join(p, [group, "island"], "left")
    return out
