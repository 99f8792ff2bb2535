"""Which stored project a new record belongs to: group id, then numbers, then name with customer.

Projects are counted per key before any join, so a key that many projects share costs one row, and records meet one row per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators.batches import first_creators
from ledgerloom.session import Scratch


def _identities(rows: DataFrame, key: str, suffixes: Sequence[str]) -> DataFrame:
    """Blank keys are null; numbers are upper case, distinct and filled."""
    name = X.search_text(X.core_name(F.col("name"), suffixes))
    numbers = F.filter(F.array_distinct(F.transform(F.coalesce("numbers", F.array()), lambda n: F.upper(F.trim(n)))), lambda n: F.length(n) > 0)
    return rows.select(F.col(key), X.blank_to_null(F.trim("group_id")).alias("group_id"), numbers.alias("numbers"), X.blank_to_null(name).alias("name"), X.blank_to_null(X.business_key(F.col("customer"))).alias("customer"))


def _span(prefix: str):
    return F.min("project_id").alias(f"{prefix}_low"), F.max("project_id").alias(f"{prefix}_high")


def resolve(records: DataFrame, projects: DataFrame, suffixes: Sequence[str] = (r"phase \w+",)) -> DataFrame:
    """``(record_id, status, project_id)``: matched, manual or new, for records and projects ``(…_id, group_id, numbers, name, customer)``.

    A group id decides first: several projects, one whose number, name or customer contradicts the record's, or one besides which the
    numbers (without any, name and customer) point elsewhere, need a person. Then the numbers: several projects, or another customer,
    need a person; without a hit, a project of the same name and customer that has other numbers does. Then name and customer
    together. Nothing found is new. Ids are unique; blanks count as missing.
    """
    scratch = Scratch(records.sparkSession)
    left, right = (scratch.materialise(_identities(rows, key, suffixes), "identities") for rows, key in ((records, "record_id"), (projects, "project_id")))
    return _resolved(left, right).select("record_id", "status", "project_id")


def _resolved(left: DataFrame, right: DataFrame, created: DataFrame | None = None) -> DataFrame:
    """The identities of records (``left``, against those of projects) with ``status``, ``project_id`` and ``creator``.

    With ``created`` (those of the records that create a project) a record also meets the projects of those with a smaller id. No two creators
    share a group, a number, or a name and customer (unless only the later has numbers), so each key has one at most.
    """
    fresh = (left.where("false") if created is None else created).withColumnRenamed("record_id", "_new")
    named = "name IS NOT NULL AND customer IS NOT NULL"
    by_group = right.where("group_id IS NOT NULL").groupBy("group_id").agg(*_span("g")).join(fresh.where("group_id IS NOT NULL").groupBy("group_id").agg(F.min("_new").alias("g_new")), "group_id", "full")
    new_numbers = fresh.select("_new", F.col("customer").alias("c_new"), F.explode("numbers").alias("number")).groupBy("number").agg(F.min("_new").alias("n_new"), F.min_by("c_new", "_new").alias("c_new"))
    by_number = right.select("project_id", "customer", F.explode("numbers").alias("number")).groupBy("number").agg(*_span("n"), F.min("customer").alias("c_low"), F.max("customer").alias("c_high")).join(new_numbers, "number", "full")
    numbered_new = F.when(F.size("numbers") > 0, F.col("_new"))
    new_names = fresh.where(named).groupBy("name", "customer").agg(F.min(numbered_new).alias("m_new"), F.min(F.when(numbered_new.isNull(), F.col("_new"))).alias("m_plain"))
    by_name = right.where(named).groupBy("name", "customer").agg(*_span("m"), F.max(F.size("numbers") > 0).alias("m_numbered")).join(new_names, ["name", "customer"], "full")

    target = lambda created, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(created).alias("created"), F.col(c).cast("long").alias("id")))
    seen = lambda c: F.when(F.col(c) < F.col("record_id"), F.struct(F.lit(True).alias("created"), F.col(c).cast("long").alias("id")))
    ends = lambda p, *new: {f"{p}_low": F.coalesce(target(False, f"{p}_low"), *map(seen, new)), f"{p}_high": F.coalesce(*map(seen, reversed(new)), target(False, f"{p}_high"))}
    numbered = left.select("record_id", F.explode("numbers").alias("number")).join(by_number, "number")
    heard = F.when(F.col("n_new") < F.col("record_id"), F.col("c_new"))
    numbered = numbered.withColumns({"c_low": F.least("c_low", heard), "c_high": F.greatest("c_high", heard)}).withColumns(ends("n", "n_new"))
    numbered = numbered.groupBy("record_id").agg(F.min("n_low").alias("n_low"), F.max("n_high").alias("n_high"), F.min("c_low").alias("c_low"), F.max("c_high").alias("c_high"))
    grouped = right.select(F.struct(F.lit(False).alias("created"), F.col("project_id").cast("long").alias("id")).alias("g_low"), "numbers", "name", "customer").unionByName(fresh.select(F.struct(F.lit(True).alias("created"), F.col("_new").cast("long").alias("id")).alias("g_low"), "numbers", "name", "customer"))
    grouped = grouped.select("g_low", F.col("numbers").alias("g_numbers"), F.col("name").alias("g_name"), F.col("customer").alias("g_customer"))
    rows = left.join(by_group, "group_id", "left").withColumns(ends("g", "g_new")).join(by_name, ["name", "customer"], "left")
    rows = rows.withColumn("m_numbered", F.coalesce("m_numbered", F.lit(False)) | F.coalesce(F.col("m_new") < F.col("record_id"), F.lit(False)))
    rows = rows.withColumns(ends("m", "m_new", "m_plain")).join(numbered, "record_id", "left").join(grouped, "g_low", "left")

    some = F.size("numbers") > 0
    low, high = (F.when(some, F.col(f"n_{end}")).otherwise(F.col(f"m_{end}")) for end in ("low", "high"))
    differs = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
    contradicts = (some & (F.size("g_numbers") > 0) & ~F.arrays_overlap("numbers", "g_numbers")) | differs("name", "g_name") | differs("customer", "g_customer")
    elsewhere = F.coalesce((low != F.col("g_low")) | (high != F.col("g_low")), F.lit(False))
    by_group_status = F.when((F.col("g_low") != F.col("g_high")) | contradicts | elsewhere, "manual").otherwise("matched")
    other_customer = differs("customer", "c_low") | differs("customer", "c_high")
    by_number_status = F.when(F.col("n_low").isNull(), F.when(F.col("m_numbered"), "manual").otherwise("new")).when((F.col("n_low") != F.col("n_high")) | other_customer, "manual").otherwise("matched")
    by_name_status = F.when(F.col("m_low").isNull(), "new").when(F.col("m_low") != F.col("m_high"), "manual").otherwise("matched")
    status = F.when(F.col("g_low").isNotNull(), by_group_status).when(some, by_number_status).otherwise(by_name_status)
    found = rows.select(*left.columns, status.alias("status"), F.coalesce("g_low", low).alias("_found"))
    hit = lambda created: F.when((F.col("status") == "matched") & (F.col("_found.created") == created), F.col("_found.id"))
    return found.withColumns({"project_id": hit(False), "creator": hit(True)}).drop("_found")


def confirm(records: DataFrame, projects: DataFrame, suffixes: Sequence[str] = (r"phase \w+",), few: int = 200_000) -> DataFrame:
    """``(record_id, outcome, project_id, creator)``: records taken by ascending id, each against the stored projects and those created before it.

    A record that is new creates a project; it is attached to a stored one, or joined to a created one (``creator``), or a person must
    decide. Of a record, all numbers, the group id, and name with customer count. Who creates is decided by ``first_creators``: an earlier creator
    stops a record if they share a group or a number, or name and customer while the record has no numbers or the creator has. Then
    every record is resolved once, against stored projects and earlier creators. Ids are integers.
    """
    scratch = Scratch(records.sparkSession)
    left, right = (scratch.materialise(_identities(rows, key, suffixes), "identities") for rows, key in ((records, "record_id"), (projects, "project_id")))
    stored = scratch.materialise(_resolved(left, right), "resolved")
    new = stored.where("status = 'new'")
    some = F.size("numbers") > 0
    own = [F.concat(F.lit("group "), F.col("group_id")), F.transform("numbers", lambda n: F.concat(F.lit("number "), n))]
    named = lambda kind: F.concat(F.lit(f"{kind} "), F.col("name"), F.lit("\n"), F.col("customer"))  # noqa: E731  null unless both are there
    keys = lambda *more: new.select(F.col("record_id").alias("id"), F.explode(F.array_compact(F.concat(F.array(own[0]), own[1], F.array(*more)))).alias("key"))
    offers = keys(F.when(some, named("numbered")).otherwise(named("plain")))
    listens = keys(named("numbered"), F.when(~some, named("plain")))
    creating = first_creators(offers, listens, scratch, few)
    keyless = new.join(offers.select(F.col("id").alias("record_id")).distinct(), "record_id", "left_anti").select("record_id")
    creators = scratch.materialise(creating.select(F.col("id").alias("record_id")).unionByName(keyless), "batch-creators")
    final = _resolved(left, right, left.join(creators, "record_id", "left_semi"))
    out = final.join(creators.withColumn("_creates", F.lit(True)), "record_id", "left")
    outcome = F.when(F.col("_creates"), "created").when(F.col("project_id").isNotNull(), "attached").when(F.col("creator").isNotNull(), "joined").otherwise("manual")
    return out.select("record_id", outcome.alias("outcome"), F.when(outcome == "attached", F.col("project_id")).alias("project_id"), F.when(outcome == "created", F.col("record_id")).when(outcome == "joined", F.col("creator")).alias("creator"))


def by_first_key(rows: DataFrame, key: str, steps: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """A plain cascade of equi-joins ``(column, index with project)``: the first step whose key is found decides; one hit matches, several need a person, none is new."""
    for name, index in steps:
        hits = index.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias(f"_{name}_hits"), F.min("project").alias(f"_{name}_id"))
        rows = rows.join(hits, name, "left")
    outcome, found = F.lit("new"), F.lit(None).cast("long")
    for name, _ in reversed(steps):
        hits = F.col(f"_{name}_hits")
        outcome = F.when(hits == 1, "matched").when(hits > 1, "manual").otherwise(outcome)
        found = F.when(hits == 1, F.col(f"_{name}_id")).when(hits > 1, F.lit(None)).otherwise(found)
    return rows.select(key, outcome.alias("outcome"), found.alias("project_id"))
