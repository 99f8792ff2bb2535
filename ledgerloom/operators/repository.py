"""Queries over the repository: projects, documents and the links between them, for all projects at once or for a keyword.

Projects have project_id, project_name, customer, winner, project_number and the times updated, status_updated, modified, created; documents
have document_id; links have project_id, document_id, relation_type, created_time. Blank ids are dropped and the last row of an id counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import blank_to_null, search_text
from ledgerloom.operators.latest import one_per_key

SEARCH_FIELDS = ("project_name", "customer", "winner", "project_number")


def index(rows: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    """One row per id: blank ids go, the last duplicate wins."""
    return one_per_key(rows.where(blank_to_null(F.col(key)).isNotNull()), [key], F.col(ordinal).desc())


def updated_time(rows: DataFrame) -> DataFrame:
    """Rows with ``updated_time``: the first of updated, status_updated, modified and created that is not empty."""
    first = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("updated", "status_updated", "modified", "created")])
    return rows.withColumn("updated_time", first)


def search_projects(projects: DataFrame, links: DataFrame, keyword: str) -> DataFrame:
    """Projects with the keyword: exact before prefix before contained, then by field, then the newest; each with its number of links
    (dangling ones count). A blank keyword lists all, newest first."""
    own = updated_time(index(projects, "project_id"))
    word = search_text(F.lit(keyword))
    if not keyword.strip():
        found = own.withColumn("rank", F.lit(None).cast("struct<match:int,field:int>"))
    else:
        ranks = []
        for place, field in enumerate(SEARCH_FIELDS):
            text = search_text(F.col(field))
            match = F.when(text == word, 0).when(F.startswith(text, word), 1).when(F.contains(text, word), 2)
            ranks.append(F.when(match.isNotNull(), F.struct(match.alias("match"), F.lit(place).alias("field"))))
        found = own.withColumn("rank", F.array_min(F.array_compact(F.array(*ranks)))).where("rank IS NOT NULL")
    counts = links.join(found.select("project_id"), "project_id", "left_semi").groupBy("project_id").agg(F.count("*").alias("n_links"))
    out = found.join(counts, "project_id", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    return out.orderBy(F.col("rank.match").asc_nulls_last(), F.col("rank.field").asc_nulls_last(), F.desc_nulls_last("updated_time"), "ordinal").select("project_id", *SEARCH_FIELDS, "updated_time", "n_links", F.col("rank.match").alias("match"))


def project_documents(projects: DataFrame, links: DataFrame, documents: DataFrame) -> DataFrame:
    """``(project_id, place, document_id, relation_type, created_time, is_stored)``: every relation of a known project in order of time, type
    and document; ``is_stored`` tells whether the document is there."""
    known = links.join(index(projects, "project_id").select("project_id"), "project_id", "left_semi")
    stored = index(documents, "document_id").select("document_id", F.lit(True).alias("_stored"))
    order = Window.partitionBy("project_id").orderBy("created_time", "relation_type", "document_id")
    joined = known.join(stored, "document_id", "left")
    return joined.select("project_id", F.row_number().over(order).alias("place"), "document_id", "relation_type", "created_time", F.coalesce("_stored", F.lit(False)).alias("is_stored"))


def document_projects(projects: DataFrame, links: DataFrame, documents: DataFrame) -> DataFrame:
    """``(document_id, project_id, relation_type, is_first)``: the known projects of each known document; the first link is marked."""
    joined = links.join(index(documents, "document_id").select("document_id"), "document_id", "left_semi").join(index(projects, "project_id").select("project_id"), "project_id", "left_semi")
    order = Window.partitionBy("document_id").orderBy("created_time", "relation_type", "project_id")
    return joined.select("document_id", "project_id", "relation_type", (F.row_number().over(order) == 1).alias("is_first"))


def merge_awards(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Award details by id: new ids are added; a new detail of a stored package (same project and package) only fills its blanks."""
    fields = ("winner", "award_amount")
    package = ["project_id", "package_id"]
    fill = new.groupBy(*package).agg(*[F.min_by(blank_to_null(F.col(f)), F.when(blank_to_null(F.col(f)).isNotNull(), F.col("ordinal"))).alias(f"_{f}") for f in fields])
    filled = existing.join(fill, package, "left").select(*[F.coalesce(blank_to_null(F.col(c)), F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in existing.columns])
    added = one_per_key(new, ["award_detail_id"], F.col("ordinal")).join(existing.select("award_detail_id"), "award_detail_id", "left_anti").join(existing.select(*package).distinct(), package, "left_anti")
    return filled.unionByName(added.select(*existing.columns))


def asset_score(projects: DataFrame, documents: DataFrame, records: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``(project_id, score, missing_kinds)``: 40 for three documents, 30 for three records, 30 for three known times.

    ``kinds`` maps a required kind of document to the pattern that names it; records have up to three times each.
    """
    has = [F.coalesce(F.bool_or(F.col("document_name").rlike(p)), F.lit(False)).alias(f"_{k}") for k, p in kinds.items()]
    docs = documents.groupBy("project_id").agg(F.count("*").alias("_docs"), *has)
    times = ("publish_time", "open_time", "award_time")
    recs = records.groupBy("project_id").agg(F.count("*").alias("_recs"), sum(F.max(blank_to_null(F.col(c)).isNotNull().cast("int")) for c in times).alias("_times"))
    joined = projects.select("project_id").join(docs, "project_id", "left").join(recs, "project_id", "left")
    third = lambda c: F.least(F.coalesce(c, F.lit(0)), F.lit(3)) / 3
    score = 40 * third(F.col("_docs")) + 30 * third(F.col("_recs")) + 30 * third(F.col("_times"))
    missing = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(f"_{k}"), F.lit(False)), F.lit(k)) for k in kinds]))
    return joined.select("project_id", F.round(score, 1).alias("score"), missing.alias("missing_kinds"))
