"""Manual corrections by compare-and-set, and snapshots with nested histories that are merged by id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import blank_to_null
from ledgerloom.session import Scratch

VERIFY, CORRECT = "verify_current_value", "correct_effective_value"


def replay_actions(actions: DataFrame, originals: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Every action with its ``status`` and, if applied, its ``revision`` and ``effective`` value.

    Actions are ``(item, ordinal, field, kind, value, operator, expected, action_id)``, ``ordinal`` a total order; originals ``(item, field,
    value)``. Taken in order, an action is applied if its item is at the revision it expects, which then grows by one; items begin at 0. One whose id
    was applied before is ``replayed`` (same item) or a ``conflict`` (another item), one that expects another revision is ``stale``, and
    ``invalid`` is one with an unknown field or kind, without an operator or a proper id, or without a value (its own, or the original to verify).

    The applied actions of an item form a chain: from the first that expects 0 to the next one that expects 1, and so on. Next ones are found by an
    as-of window over (item, revision), and chains are followed by pointer doubling, so an item with very many actions is no group. A chain
    that applies an id twice is cut there and followed anew; that happens as often as such an id is met at its revision.
    """
    scratch = Scratch(actions.sparkSession)
    known = originals.select("item", "field", blank_to_null(F.col("value")).alias("_original"))
    joined = actions.join(known, ["item", "field"], "left")
    effective = F.when(F.col("kind") == VERIFY, F.col("_original")).when(F.col("kind") == CORRECT, blank_to_null(F.trim("value")))
    proper = F.col("field").isin(*fields) & blank_to_null(F.col("operator")).isNotNull() & F.col("action_id").rlike(r"^[\p{L}\p{N}_-]{1,128}$") & (F.col("expected") >= 0) & F.col("item").isNotNull()
    rows = scratch.materialise(joined.withColumn("_effective", effective).withColumn("_valid", F.coalesce(proper & F.col("_effective").isNotNull(), F.lit(False))).drop("_original"), "actions")
    open_ = scratch.materialise(rows.where("_valid").select("item", "ordinal", F.col("expected").cast("long").alias("expected"), "action_id"), "valid-actions")
    while True:
        applied = _chains(open_, scratch)
        first = applied.groupBy("action_id").agg(F.min(F.struct("ordinal", "item")).alias("f")).select("action_id", F.col("f.ordinal").alias("_first"), F.col("f.item").alias("_where"))
        again = scratch.materialise(applied.join(first, "action_id").where("ordinal > _first"), "repeated-actions")
        if not again.limit(1).count():
            break
        # a repeat is sure where nothing before it, here or where its id was first applied, is in doubt
        doubt = again.groupBy("item").agg(F.min("ordinal").alias("_doubt"))
        sure = again.join(doubt, "item").where("ordinal = _doubt").drop("_doubt").join(doubt.select(F.col("item").alias("_where"), "_doubt"), "_where", "left").where("_doubt IS NULL OR _doubt > _first")
        open_ = scratch.materialise(open_.join(sure.select("ordinal"), "ordinal", "left_anti"), "valid-actions")
    revision = applied.select("ordinal", (F.col("expected") + 1).alias("revision"))
    out = rows.join(revision, "ordinal", "left").join(first, "action_id", "left")
    met = F.coalesce(F.col("_first") < F.col("ordinal"), F.lit(False))
    status = F.when(F.col("revision").isNotNull(), "applied").when(~F.coalesce(proper, F.lit(False)), "invalid").when(met & (F.col("_where") == F.col("item")), "replayed").when(met, "conflict").when(~F.col("_valid"), "invalid").otherwise("stale")
    return out.select(*actions.columns, status.alias("status"), "revision", F.when(F.col("revision").isNotNull(), F.col("_effective")).alias("effective"))


def _chains(open_: DataFrame, scratch: Scratch) -> DataFrame:
    """The actions on the chain of each item."""
    targets = open_.select("item", F.col("expected").alias("at"), "ordinal", F.col("ordinal").alias("target"))
    seekers = open_.select("item", (F.col("expected") + 1).alias("at"), "ordinal", F.lit(None).cast("long").alias("target"))
    after = Window.partitionBy("item", "at").orderBy("ordinal").rowsBetween(1, Window.unboundedFollowing)
    found = targets.unionByName(seekers).withColumn("next", F.min("target").over(after)).where("target IS NULL AND next IS NOT NULL")
    jump = scratch.materialise(found.select(F.col("ordinal").alias("from"), "next"), "next-actions")
    reached = scratch.materialise(open_.where("expected = 0").groupBy("item").agg(F.min("ordinal").alias("ordinal")).select("ordinal"), "reached")
    while jump.limit(1).count():
        further = reached.join(jump, reached["ordinal"] == jump["from"]).select(F.col("next").alias("ordinal"))
        reached = scratch.materialise(reached.unionByName(further).distinct(), "reached")
        jump = scratch.materialise(jump.alias("a").join(jump.alias("b"), F.col("a.next") == F.col("b.from")).select(F.col("a.from").alias("from"), F.col("b.next").alias("next")), "next-actions")
    return scratch.materialise(open_.join(reached, "ordinal", "left_semi"), "applied-actions")


def effective_values(replayed: DataFrame, originals: DataFrame) -> DataFrame:
    """``(item, field, original, effective, revision)`` of every original value and every corrected field: the last applied value, else the original."""
    last = replayed.where("status = 'applied'").groupBy("item", "field").agg(F.max_by("effective", "revision").alias("_value"), F.max("revision").alias("revision"))
    joined = originals.select("item", "field", F.col("value").alias("original")).join(last, ["item", "field"], "full")
    return joined.select("item", "field", "original", F.coalesce("_value", "original").alias("effective"), F.coalesce("revision", F.lit(0)).cast("long").alias("revision"))


def open_issues(effective: DataFrame, required: Sequence[str]) -> DataFrame:
    """``(item, missing)``: the required fields that have no value, in the order given, of every item that misses one."""
    have = effective.where(blank_to_null(F.col("effective")).isNotNull() & F.col("field").isin(*required)).groupBy("item").agg(F.collect_set("field").alias("_have"))
    missing = F.array_except(F.array(*map(F.lit, required)), F.coalesce("_have", F.array().cast("array<string>")))
    return effective.select("item").distinct().join(have, "item", "left").select("item", missing.alias("missing")).where(F.size("missing") > 0)


def merge_histories(current: DataFrame, incoming: DataFrame, item: str, entry: str, order: str) -> DataFrame:
    """Nested histories as rows ``(item, entry, order, …)``: entries with one id become one, at the first one's place, each column from the last
    that fills it; entries without an id stay apart. Incoming ones come after the current ones; ``place`` counts from 1 within an item."""
    both = current.withColumn("_late", F.lit(0)).unionByName(incoming.withColumn("_late", F.lit(1)))
    both = both.withColumn("_at", F.struct("_late", order)).withColumn("_own", F.when(blank_to_null(F.col(entry).cast("string")).isNull(), F.col("_at")))
    others = [c for c in current.columns if c not in (item, entry)]
    merged = both.groupBy(item, entry, "_own").agg(F.min("_at").alias("_first"), *[F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in others])
    place = F.row_number().over(Window.partitionBy(item).orderBy("_first"))
    return merged.withColumn("place", place.cast("long")).drop("_own", "_first")


def merge_items(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Snapshots by id: an incoming item replaces the columns it fills, others stay; items without an id are all kept."""
    filled = lambda df: df.where(blank_to_null(F.col(key).cast("string")).isNotNull())
    blank = lambda df: df.where(blank_to_null(F.col(key).cast("string")).isNull())
    others = [c for c in current.columns if c != key]
    new = filled(incoming).select(key, *[F.col(c).alias(f"_{c}") for c in others])
    merged = filled(current).join(new, key, "full").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in others])
    return merged.unionByName(blank(current).select(key, *others)).unionByName(blank(incoming).select(key, *others))


def append_snapshots(current: DataFrame, incoming: DataFrame, identity: Sequence[str], order: str) -> DataFrame:
    """All current rows, and of the incoming ones the first of each identity that is not there; nulls and blanks of an identity are alike."""
    marks = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{i}") for i, c in enumerate(identity)]
    names = [f"_{i}" for i in range(len(identity))]
    first = incoming.select("*", *marks).withColumn("_n", F.row_number().over(Window.partitionBy(*names).orderBy(order))).where("_n = 1").drop("_n")
    return current.unionByName(first.join(current.select(*marks).distinct(), names, "left_anti").select(*current.columns))
