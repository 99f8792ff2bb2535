"""Review: lifecycles, queues, decisions, dry runs, controlled application, intake and repository."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import blank_to_null, stable_id
from ledgerloom.operators.latest import latest, one_per_key, replay

LIFECYCLE = ("DISCOVERED", "DEDUPED", "PROMOTION_READY", "PROMOTED", "APPLIED")
DECISIONS = ("ACCEPT", "REJECT", "DEFER", "NEEDS_MORE_INFO")
RELATIONS = ("bid_notice", "award_notice", "contract", "attachment", "other")


def lifecycles(candidates: DataFrame, deduped: DataFrame, promoted: DataFrame, applied: DataFrame) -> DataFrame:
    """``(asset_id, status, place, is_final)``: each asset's statuses in order, repeats collapsed.

    ``applied`` counts only where ``apply`` holds and ``dry_run`` does not. Only primaries are ready for promotion.
    """
    stage = lambda df, c, rank: df.select(F.col(c).alias("asset_id"), F.lit(LIFECYCLE[rank]).alias("status"), F.lit(rank).alias("rank"))
    events = stage(candidates, "candidate_id", 0).unionByName(stage(deduped, "candidate_id", 1)).unionByName(stage(deduped.where(F.coalesce("is_primary", F.lit(True))), "candidate_id", 2))
    events = events.unionByName(stage(promoted, "candidate_id", 3)).unionByName(stage(applied.where(F.col("apply") & ~F.coalesce("dry_run", F.lit(False))), "candidate_id", 4))
    return replay(events.where("asset_id IS NOT NULL").distinct(), "asset_id", "status", "rank").select("asset_id", "status", (F.col("rank") + 1).alias("place"), "is_final")


def priority(status, confidence):
    """P1: ready or promoted with confidence of 0.8; P2: ready or promoted, or confidence of 0.6; else P3."""
    ready = status.isin("PROMOTION_READY", "PROMOTED")
    return F.when(ready & (confidence >= 0.8), "P1").when(ready | (confidence >= 0.6), "P2").otherwise("P3")


def review_queue(candidates: DataFrame, promoted: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Every asset of the three tables with its title, confidence, status and priority, in queue order."""
    ids = candidates.select(F.col("candidate_id").alias("asset_id")).union(promoted.select("candidate_id")).union(lifecycle.select("asset_id")).where("asset_id IS NOT NULL").distinct()
    own = candidates.select(F.col("candidate_id").alias("asset_id"), F.col("title").alias("_t1"), F.col("confidence").alias("_c1"), F.col("source_type").alias("_s1"))
    put = promoted.select(F.col("candidate_id").alias("asset_id"), F.col("title").alias("_t2"), F.col("confidence").alias("_c2"), F.col("source_type").alias("_s2"))
    last = lifecycle.where("is_final").select("asset_id", F.col("status").alias("lifecycle_status"))
    joined = ids.join(own, "asset_id", "left").join(put, "asset_id", "left").join(last, "asset_id", "left")
    confidence = F.coalesce("_c1", "_c2", F.lit(0.0))
    view = joined.select("asset_id", F.coalesce(blank_to_null(F.col("_s1")), "_s2").alias("source_type"), F.coalesce(blank_to_null(F.col("_t1")), "_t2").alias("title"), "lifecycle_status", confidence.alias("confidence"))
    return view.withColumn("priority", priority(F.coalesce("lifecycle_status", F.lit("")), F.col("confidence"))).orderBy("priority", F.desc("confidence"), "asset_id")


def record_decisions(requests: DataFrame, queue: DataFrame, allowed: Sequence[str] = DECISIONS) -> tuple[DataFrame, DataFrame]:
    """``(recorded, errors)``: requests with a known decision for a queued asset keep the queue row as their snapshot."""
    snapshot = queue.select("asset_id", F.struct("*").alias("asset_snapshot"))
    judged = requests.join(snapshot, "asset_id", "left").withColumn("error", F.when(F.col("asset_snapshot").isNull(), "not queued").when(~F.coalesce(F.col("decision").isin(*allowed), F.lit(False)), "unknown decision"))
    decision_id = stable_id("decision_", F.col("asset_id"), F.col("decision"), F.col("reviewer"), F.col("review_time"))
    return judged.where("error IS NULL").drop("error").withColumn("decision_id", decision_id), judged.where("error IS NOT NULL").select("asset_id", "decision", "error")


def decision_summary(decisions: DataFrame, queue: DataFrame) -> DataFrame:
    """One row per latest decision with its number of assets, by priority; undecided queue items under ``(none)``."""
    last = latest(decisions, ["asset_id"], "review_time", "ordinal").select("asset_id", "decision")
    joined = queue.select("asset_id", "priority").join(last, "asset_id", "left")
    return joined.groupBy(F.coalesce("decision", F.lit("(none)")).alias("decision")).agg(F.count("*").alias("assets"), *[F.count_if(F.col("priority") == p).alias(p.lower()) for p in ("P1", "P2", "P3")])


def dry_run(decisions: DataFrame, promoted: DataFrame, known_projects: DataFrame) -> DataFrame:
    """Assets whose latest decision accepts: ready, or blocked with every reason."""
    accepted = latest(decisions, ["asset_id"], "review_time", "ordinal").where("decision = 'ACCEPT'").select("asset_id", "ordinal")
    joined = accepted.join(promoted.withColumnRenamed("candidate_id", "asset_id"), "asset_id", "left").join(known_projects.select("project_id", F.lit(True).alias("_known")), "project_id", "left")
    document = F.col("promotion_type") == "document_entity_candidate"
    reasons = F.array_compact(F.array(F.when(F.col("promotion_type").isNull(), "not promoted"), F.when(document & F.col("project_id").isNull(), "no project"), F.when(document & F.col("project_id").isNotNull() & F.col("_known").isNull(), "unknown project")))
    return joined.select("asset_id", "ordinal", "promotion_type", "project_id", F.when(F.size(reasons) == 0, "ready").otherwise("blocked").alias("outcome"), F.array_join(reasons, "; ").alias("reasons"))


def controlled_apply(items: DataFrame, stored: DataFrame, batch: str, most: int = 10) -> DataFrame:
    """The first ready items of a dry run (1 to 10, the feature), those stored already skipped, the rest stamped with a rollback key."""
    if not 1 <= most <= 10:
        raise ValueError("a batch has 1 to 10 items")
    chosen = items.where("outcome = 'ready'").orderBy("ordinal", "asset_id").limit(most)
    judged = chosen.join(stored.select("asset_id", F.lit(True).alias("_stored")), "asset_id", "left")
    return judged.select("asset_id", F.when(F.col("_stored"), "skipped").otherwise("applied").alias("result"), F.lit(batch).alias("batch"), F.when(F.col("_stored").isNull(), stable_id("rollback_", F.lit(batch), F.col("asset_id"))).alias("rollback_key"))


def intake(decisions: DataFrame) -> DataFrame:
    """Assets whose latest decision (later time, then larger decision id, then position) accepts: a related project makes a document item, none a project item."""
    accepted = latest(decisions, ["asset_id"], "review_time", "decision_id", "ordinal").where("decision = 'ACCEPT'")
    related = blank_to_null(F.col("related_project_id"))
    kind = F.when(related.isNotNull(), "document").otherwise("project")
    return accepted.select(stable_id("intake_", F.col("asset_id"), F.col("decision_id")).alias("intake_id"), "asset_id", kind.alias("kind"), related.alias("project_id"), "decision_id", "review_time")


def repository(items: DataFrame, projects: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(projects, documents)`` with the intake's new rows: ids come from the asset, so building twice adds nothing."""
    made = lambda kind, prefix: items.where(F.col("kind") == kind).withColumn("_id", stable_id(prefix, F.col("asset_id")))
    new_projects = made("project", "project_").select(F.col("_id").alias("project_id"), "asset_id", F.lit("candidate").alias("status"), F.col("review_time").alias("created_time"))
    new_documents = made("document", "document_").select(F.col("_id").alias("document_id"), "asset_id", "project_id", F.lit("candidate").alias("status"), F.col("review_time").alias("created_time"))
    add = lambda old, new, key: old.unionByName(one_per_key(new, [key], F.col("created_time"), F.col("asset_id")).join(old.select(key), key, "left_anti").select(*old.columns))
    return add(projects, new_projects, "project_id"), add(documents, new_documents, "document_id")


def set_status(rows: DataFrame, key: str, changes: DataFrame, allowed: Sequence[str] = ("candidate", "confirmed")) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejected)``: changes (key, new_status, time) to an allowed status; the same status changes nothing."""
    good = changes.where(F.col("new_status").isin(*allowed))
    joined = rows.join(one_per_key(good, [key], F.col("time").desc()), key, "left")
    differs = F.col("new_status").isNotNull() & ~F.col("status").eqNullSafe(F.col("new_status"))
    out = joined.select(*[F.when(differs, F.col("new_status")).otherwise(F.col("status")).alias("status") if c == "status" else F.col(c) for c in rows.columns], F.when(differs, F.col("time")).alias("status_time"))
    return out, changes.where(~F.coalesce(F.col("new_status").isin(*allowed), F.lit(False)))


def create_links(wanted: DataFrame, projects: DataFrame, documents: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(new, rejected)`` links (project_id, document_id, relation_type, created_time): both ends must exist, the type must be known, and a
    link that exists is not made again."""
    natural = ["project_id", "document_id", "relation_type"]
    joined = wanted.join(projects.select("project_id", F.lit(True).alias("_p")).distinct(), "project_id", "left").join(documents.select("document_id", F.lit(True).alias("_d")).distinct(), "document_id", "left")
    reason = F.when(F.col("_p").isNull(), "unknown project").when(F.col("_d").isNull(), "unknown document").when(~F.coalesce(F.col("relation_type").isin(*RELATIONS), F.lit(False)), "unknown relation")
    judged = joined.withColumn("reason", reason)
    fresh = one_per_key(judged.where("reason IS NULL"), natural, F.col("created_time")).join(existing.select(*natural), natural, "left_anti")
    return fresh.select(stable_id("link_", *map(F.col, natural)).alias("link_id"), *natural, "created_time"), judged.where("reason IS NOT NULL").select(*natural, "reason")


def verify_applied(items: DataFrame, assets: DataFrame, documents: DataFrame, project_candidates: DataFrame) -> DataFrame:
    """Whether each applied item ``(asset_id, status, project_id, written_ids, batch, hint)`` can be found again and rolled back.

    ``assets`` and ``project_candidates`` have asset_id, ``documents`` (project_id, document_id). Verified means that the asset is there, with a
    written document in its project or a project candidate; a hint has to name the batch and every written id.
    """
    applied = items.where("status = 'applied'")
    wanted = applied.select("asset_id", "project_id", F.explode("written_ids").alias("document_id"))
    written = wanted.join(documents.select("project_id", "document_id"), ["project_id", "document_id"], "left_semi").select("asset_id").distinct().withColumn("document_found", F.lit(True))
    known = lambda table, name: table.select("asset_id").distinct().withColumn(name, F.lit(True))
    joined = applied.join(known(assets, "asset_found"), "asset_id", "left").join(written, "asset_id", "left").join(known(project_candidates, "candidate_found"), "asset_id", "left")
    joined = joined.na.fill(False, ["asset_found", "document_found", "candidate_found"])
    hinted = F.coalesce(F.contains("hint", F.col("batch")) & F.forall("written_ids", lambda x: F.contains(F.col("hint"), x)), F.lit(False))
    out = joined.withColumn("verified", F.col("asset_found") & (F.col("document_found") | F.col("candidate_found"))).withColumn("rollback_complete", hinted)
    issues = F.array_compact(F.array(F.when(~F.col("verified"), "not found"), F.when(~F.col("rollback_complete"), "hint incomplete")))
    return out.select("asset_id", "asset_found", "document_found", "candidate_found", "verified", "rollback_complete", issues.alias("issues"))
