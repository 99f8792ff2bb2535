"""Candidates, reviews, overrides, ledgers and repository views: the shipped jobs over the given tables, cast in their schemas.

The roles (which row is a candidate, which a stored record) come from columns of the whole tables; nothing is left out to keep a query small.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import candidates as C
from ledgerloom.operators import ledger as G
from ledgerloom.operators import overrides as O
from ledgerloom.operators import repository as R
from ledgerloom.operators import review as V
from ledgerloom.plans.registry import query
from ledgerloom.plans.text_queries import matching_blocks


def _id(prefix: str, *parts: str) -> str:
    """The SQL of a stable id."""
    return f"'{prefix}' || sha256(concat_ws(chr(10), {', '.join(f'coalesce(CAST({p} AS VARCHAR), $$$$)' for p in parts)}))[1:16]"


# Candidates: pages. Every third is matched to a project, whose id may be blank; every fifth is no primary.

PAGES_SQL = r"""c AS (SELECT page_id AS candidate_id, CASE WHEN page_id % 4 = 1 THEN ' ' ELSE 'web' END AS source_type, CASE WHEN page_id % 4 = 1 THEN ' ' ELSE 'Notice: ' || page_id || ' / x' END AS title, url,
  (page_id % 100) / 100.0::DOUBLE AS confidence, page_id % 3 = 0 AND page_id % 9 <> 0 AS matched, 'p' || page_id % 7 AS project, page_id % 5 <> 0 AS is_primary FROM pages),
pro AS (SELECT candidate_id, CASE WHEN matched THEN 'document_entity_candidate' ELSE 'project_candidate' END AS promotion_type, CASE WHEN matched THEN project END AS project_id,
  CASE WHEN matched THEN coalesce(nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '/([^/]+)/?$', 1), ''), left(regexp_replace(title, '[\\/:*?"<>|\s]+', '_', 'g'), 80) || '.html') END AS file_name, confidence, title, source_type FROM c WHERE is_primary),
app AS (SELECT *, CASE WHEN promotion_type = 'project_candidate' THEN 'project' WHEN confidence >= 0.8 THEN 'document' ELSE 'skipped' END AS outcome FROM pro),
life AS (SELECT candidate_id AS asset_id, 'DISCOVERED' AS status, 1 AS place FROM c UNION ALL SELECT candidate_id, 'DEDUPED', 2 FROM c UNION ALL SELECT candidate_id, 'PROMOTION_READY', 3 FROM c WHERE is_primary
  UNION ALL SELECT candidate_id, 'PROMOTED', 4 FROM pro UNION ALL SELECT candidate_id, 'APPLIED', 5 FROM app WHERE outcome <> 'skipped' AND candidate_id % 2 = 1)"""


def page_candidates(t):
    n, blank = F.col("page_id"), F.col("page_id") % 4 == 1
    title = F.when(blank, " ").otherwise(F.concat(F.lit("Notice: "), n.cast("string"), F.lit(" / x")))
    project = F.when(n % 9 == 0, " ").otherwise(F.concat(F.lit("p"), (n % 7).cast("string")))
    primary = F.when(n % 5 == 0, False).when(n % 5 != 1, True)  # a missing flag counts as one
    return t.pages.select(n.alias("candidate_id"), F.when(blank, " ").otherwise("web").alias("source_type"), title.alias("title"), "url", (n % 100 / 100.0).alias("confidence"), F.when(n % 3 == 0, "MATCHED").otherwise("NEW").alias("status"), project.alias("matched_project_id"), primary.alias("is_primary"))


def page_lifecycles(t):
    found = page_candidates(t)
    promoted = C.promote(found)
    applied = C.apply_promotions(promoted).select("candidate_id", (F.col("outcome") != "skipped").alias("apply"), (F.col("candidate_id") % 2 == 0).alias("dry_run"))
    return found, promoted, V.lifecycles(found, found, promoted, applied)


@query(f"WITH {PAGES_SQL} SELECT candidate_id, promotion_type, project_id, file_name FROM pro")
def p5_promoted_file_name(t):
    return C.promote(page_candidates(t)).select("candidate_id", "promotion_type", "project_id", "file_name")


@query(f"WITH {PAGES_SQL} SELECT candidate_id, outcome, CASE WHEN outcome = 'skipped' THEN 'low confidence' END AS reason FROM app")
def p6_apply_gate(t):
    return C.apply_promotions(C.promote(page_candidates(t))).select("candidate_id", "outcome", "reason")


@query(f"""WITH {PAGES_SQL}, f AS (SELECT asset_id, arg_max(status, place) AS lifecycle_status FROM life GROUP BY 1)
SELECT asset_id, coalesce(nullif(trim(c.source_type), ''), pro.source_type) AS source_type, coalesce(nullif(trim(c.title), ''), pro.title) AS title, lifecycle_status, c.confidence,
  CASE WHEN lifecycle_status IN ('PROMOTION_READY', 'PROMOTED') AND c.confidence >= 0.8 THEN 'P1' WHEN lifecycle_status IN ('PROMOTION_READY', 'PROMOTED') OR c.confidence >= 0.6 THEN 'P2' ELSE 'P3' END AS priority
FROM f JOIN c ON c.candidate_id = asset_id LEFT JOIN pro ON pro.candidate_id = asset_id""")
def j6_review_queue(t):
    return V.review_queue(*page_lifecycles(t))


# Duplicates: parts whose titles, URLs or numbers agree.

#: Titles whose edit distance is beyond what a ratio of 0.88 leaves to insert and delete are not compared.
_TITLES = "SELECT a.title AS a, b.title AS b FROM c a JOIN c b ON a.ordinal < b.ordinal AND a.title <> b.title AND levenshtein(a.title, b.title) <= floor(0.12 * (len(a.title) + len(b.title)) + 1e-9)"
PARTS_SQL = rf"""c AS (SELECT p_partkey AS ordinal, 'c' || p_partkey AS candidate_id, p_retailprice::DOUBLE AS confidence, regexp_replace(lower(p_name || ' ' || p_partkey // 2), '[^\p{{L}}\p{{N}}_]+', '', 'g') AS title,
  CASE WHEN p_partkey % 10 = 0 THEN 'http://shop/' || p_partkey // 20 END AS url, CASE WHEN p_partkey % 7 = 0 THEN 'n' || p_partkey // 21 END AS number FROM part), {matching_blocks(_TITLES)},
e AS (SELECT ordinal AS x, min(ordinal) OVER (PARTITION BY url) AS y, 'url' AS reason FROM c WHERE url IS NOT NULL UNION ALL SELECT ordinal, min(ordinal) OVER (PARTITION BY number), 'number' FROM c WHERE number IS NOT NULL
  UNION ALL SELECT b.ordinal, a.ordinal, 'title' FROM c a JOIN c b ON a.ordinal < b.ordinal LEFT JOIN ratio ON ratio.a = a.title AND ratio.b = b.title WHERE a.title = b.title OR ratio.score >= 0.88),
b AS (SELECT x, y FROM e WHERE x <> y UNION SELECT y, x FROM e WHERE x <> y), rr AS (SELECT x, y FROM b UNION SELECT rr.x, b.y FROM rr JOIN b ON b.x = rr.y), g AS (SELECT x, least(x, min(y)) AS component FROM rr GROUP BY x),
m AS (SELECT c.*, coalesce(component, ordinal) AS component FROM c LEFT JOIN g ON x = ordinal), w AS (SELECT component, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons FROM e JOIN g ON g.x = e.x WHERE e.x <> e.y GROUP BY 1),
d AS (SELECT m.*, coalesce(reasons, 'unique') AS reasons, count(*) OVER (PARTITION BY m.component) AS group_size, row_number() OVER (PARTITION BY m.component ORDER BY confidence DESC, ordinal) = 1 AS is_primary FROM m LEFT JOIN w ON w.component = m.component)"""


def part_duplicates(t):
    return C.deduplicate(part_candidates(t))


def part_candidates(t):
    n = F.col("p_partkey")
    half = lambda k: F.floor(n / k).cast("string")
    url = F.when(n % 20 == 0, F.concat(F.lit("HTTP://Shop/"), half(20), F.lit("/"))).when(n % 10 == 0, F.concat(F.lit("http://shop/"), half(20))).otherwise("")
    numbers = F.when(n % 7 == 0, F.array(F.concat(F.lit("n"), half(21))))
    return t.part.select(n.alias("ordinal"), F.concat(F.lit("c"), n.cast("string")).alias("candidate_id"), F.lit("shop").alias("source_type"), F.concat_ws(" ", "p_name", half(2)).alias("title"), url.alias("url"), numbers.alias("numbers"), F.col("p_retailprice").cast("double").alias("confidence"))


@query(f"WITH RECURSIVE {PARTS_SQL} SELECT candidate_id, is_primary, reasons, group_size, {_id('dup_', 'min(candidate_id) OVER (PARTITION BY component)', 'component')} AS duplicate_group_id FROM d")
def a2_primary_election(t):
    return part_duplicates(t).select("candidate_id", "is_primary", F.array_join("duplicate_reasons", ",").alias("reasons"), "group_size", "duplicate_group_id")


@query(f"""WITH RECURSIVE {PARTS_SQL} SELECT count(*) AS rows_in, count(*) FILTER (is_primary) AS groups_out, count(*) FILTER (NOT is_primary) AS removed, count(*) FILTER (is_primary AND group_size > 1) AS duplicate_groups,
count(*) FILTER (is_primary AND contains(reasons, 'url')) AS reason_url, count(*) FILTER (is_primary AND contains(reasons, 'number')) AS reason_number, count(*) FILTER (is_primary AND contains(reasons, 'title')) AS reason_title, count(*) FILTER (is_primary AND reasons = 'unique') AS reason_unique FROM d""")
def a1_dedup_summary(t):
    return C.dedup_summary(part_duplicates(t))


@query(f"""WITH RECURSIVE {PARTS_SQL} SELECT 'project' AS outcome, count(*) AS n FROM d WHERE is_primary AND ordinal % 2 = 1 UNION ALL SELECT CASE WHEN confidence >= 1000 THEN 'document' ELSE 'skipped' END, count(*) FROM d WHERE is_primary AND ordinal % 2 = 0 GROUP BY 1""")
def d14_production_import(t):
    """Rows become candidates, duplicates go, primaries are promoted and applied; how many had each outcome."""
    matched = F.col("ordinal") % 2 == 0
    found = part_duplicates(t).withColumns({"status": F.when(matched, "MATCHED").otherwise("NEW"), "matched_project_id": F.when(matched, F.col("ordinal").cast("string"))})
    return C.apply_promotions(C.promote(found), 1000.0).groupBy("outcome").agg(F.count("*").alias("n"))


REFRESH_SQL = f"""WITH RECURSIVE {PARTS_SQL}, pr AS (SELECT *, ordinal % 2 = 0 AS matched FROM d WHERE is_primary), st AS (SELECT candidate_id, 1 AS place, 'DISCOVERED' AS status FROM d UNION ALL SELECT candidate_id, 2, 'DEDUPED' FROM d
  UNION ALL SELECT candidate_id, 3, 'PROMOTION_READY' FROM pr UNION ALL SELECT candidate_id, 4, 'PROMOTED' FROM pr UNION ALL SELECT candidate_id, 5, 'APPLIED' FROM pr WHERE NOT matched OR confidence >= 1000)"""


def refreshed(t):
    """Stored candidates (all but every fifth part) and a batch (every fifth, and every tenth once more with a new confidence)."""
    matched = F.col("ordinal") % 2 == 0
    found = part_candidates(t).withColumns({"status": F.when(matched, "MATCHED").otherwise("NEW"), "matched_project_id": F.when(matched, F.col("ordinal").cast("string"))})
    stored = found.where("ordinal % 5 <> 0").unionByName(found.where("ordinal % 10 = 0").withColumn("confidence", F.lit(0.0)))
    return C.refresh(stored, found.where("ordinal % 5 = 0"), least=1000.0)


@query(f"{REFRESH_SQL} SELECT candidate_id AS asset_id, status, place, place = max(place) OVER (PARTITION BY candidate_id) AS is_final FROM st")
def d1_candidate_refresh(t):
    return refreshed(t)[0]


@query(f"{REFRESH_SQL} SELECT 'candidates' AS stage, count(*) AS n FROM d UNION ALL SELECT 'duplicate groups', count(*) FILTER (is_primary) FROM d UNION ALL SELECT 'promoted', count(*) FROM pr UNION ALL SELECT 'applied', count(*) FROM st WHERE place = 5 UNION ALL SELECT 'queue', count(*) FROM d")
def d1_stage_counts(t):
    return refreshed(t)[2]


# Decisions: events, about customers.

EVENTS_SQL = """d AS (SELECT event_id AS decision_id, user_id AS asset_id, CASE event_type WHEN 'purchase' THEN 'ACCEPT' WHEN 'signup' THEN 'ACCEPT' WHEN 'error' THEN 'REJECT' WHEN 'view' THEN 'DEFER' ELSE 'LATER' END AS decision,
  date_trunc('day', ts) AS review_time, event_id AS ordinal, CASE WHEN value >= 60 THEN 'p' || user_id % 30 ELSE ' ' END AS related FROM events),
last AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY review_time DESC, ordinal DESC) = 1)"""
QUEUE_SQL = """q AS (SELECT c_custkey AS asset_id, CASE WHEN c_nationkey % 3 < 2 AND c_acctbal / 10000 >= 0.8 THEN 'P1' WHEN c_nationkey % 3 < 2 OR c_acctbal / 10000 >= 0.6 THEN 'P2' ELSE 'P3' END AS priority,
  CASE c_nationkey % 4 WHEN 0 THEN 'project_candidate' WHEN 3 THEN NULL ELSE 'document_entity_candidate' END AS promotion_type, CASE WHEN c_nationkey % 4 = 1 AND c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END AS project_id FROM customer)"""


def event_decisions(t):
    kind = F.col("event_type")
    decision = F.when(kind.isin("purchase", "signup"), "ACCEPT").when(kind == "error", "REJECT").when(kind == "view", "DEFER").otherwise("LATER")
    related = F.when(F.col("value") >= 60, F.concat(F.lit("p"), (F.col("user_id") % 30).cast("string"))).otherwise(" ")
    return t.events.select(F.col("event_id").alias("decision_id"), F.col("user_id").alias("asset_id"), decision.alias("decision"), F.date_trunc("day", "ts").alias("review_time"), F.col("event_id").alias("ordinal"), related.alias("related_project_id"), F.lit("r").alias("reviewer"))


def customer_queue(t):
    n = F.col("c_nationkey")
    status = F.when(n % 3 == 0, "PROMOTED").when(n % 3 == 1, "PROMOTION_READY").otherwise("DISCOVERED")
    return t.customer.select(F.col("c_custkey").alias("asset_id"), V.priority(status, F.col("c_acctbal") / 10000).alias("priority"))


def customer_promotions(t):
    n = F.col("c_nationkey")
    kind = F.when(n % 4 == 0, C.PROJECT).when(n % 4 < 3, C.DOCUMENT)
    return t.customer.select(F.col("c_custkey").alias("candidate_id"), kind.alias("promotion_type"), F.when(~((n % 4 == 1) & (F.col("c_custkey") % 3 == 0)), n).alias("project_id"))


@query(f"WITH {QUEUE_SQL} SELECT asset_id, priority FROM q")
def p8_priority(t):
    return customer_queue(t)


@query(f"WITH {EVENTS_SQL}, {QUEUE_SQL} SELECT coalesce(decision, '(none)') AS decision, count(*) AS assets, count(*) FILTER (priority = 'P1') AS p1, count(*) FILTER (priority = 'P2') AS p2, count(*) FILTER (priority = 'P3') AS p3 FROM q LEFT JOIN last USING (asset_id) GROUP BY 1")
def a4_decision_summary(t):
    return V.decision_summary(event_decisions(t), customer_queue(t))


@query(f"WITH {EVENTS_SQL}, {QUEUE_SQL} SELECT asset_id, decision, {_id('decision_', 'asset_id', 'decision', chr(39) + 'r' + chr(39), 'CAST(review_time AS TIMESTAMP)')} AS decision_id, priority, CASE WHEN decision = 'LATER' THEN 'unknown decision' END AS error FROM d JOIN q USING (asset_id) WHERE decision <> 'LATER' UNION ALL SELECT d.asset_id, decision, NULL, NULL, CASE WHEN q.asset_id IS NULL THEN 'not queued' ELSE 'unknown decision' END FROM d LEFT JOIN q USING (asset_id) WHERE q.asset_id IS NULL OR decision = 'LATER'")
def d20_record_decisions(t):
    recorded, errors = V.record_decisions(event_decisions(t), customer_queue(t))
    none = F.lit(None).cast("string")
    return recorded.select("asset_id", "decision", "decision_id", F.col("asset_snapshot.priority").alias("priority"), none.alias("error")).unionByName(errors.select("asset_id", "decision", none.alias("decision_id"), none.alias("priority"), "error"))


DRY_SQL = """dry AS (SELECT l.asset_id, l.ordinal, promotion_type, q.project_id, concat_ws('; ', CASE WHEN promotion_type IS NULL THEN 'not promoted' END, CASE WHEN promotion_type = 'document_entity_candidate' AND q.project_id IS NULL THEN 'no project' END,
  CASE WHEN promotion_type = 'document_entity_candidate' AND q.project_id IS NOT NULL AND n_nationkey IS NULL THEN 'unknown project' END) AS reasons FROM last l LEFT JOIN q USING (asset_id) LEFT JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2) ON n_nationkey = q.project_id WHERE decision = 'ACCEPT')"""


def customer_dry_run(t):
    return V.dry_run(event_decisions(t), customer_promotions(t), t.nation.where("n_regionkey <> 2").select(F.col("n_nationkey").alias("project_id")))


@query(f"WITH {EVENTS_SQL}, {QUEUE_SQL}, {DRY_SQL} SELECT asset_id, CASE WHEN reasons = '' THEN 'ready' ELSE 'blocked' END AS outcome, reasons FROM dry")
def p7_dry_run(t):
    return customer_dry_run(t).select("asset_id", "outcome", "reasons")


@query(f"""WITH {EVENTS_SQL}, {QUEUE_SQL}, {DRY_SQL}, x AS (SELECT asset_id FROM dry WHERE reasons = '' ORDER BY ordinal, asset_id LIMIT 10)
SELECT asset_id, CASE WHEN s_suppkey IS NULL THEN 'applied' ELSE 'skipped' END AS result, 'b1' AS batch, CASE WHEN s_suppkey IS NULL THEN {_id('rollback_', chr(39) + 'b1' + chr(39), 'asset_id')} END AS rollback_key FROM x LEFT JOIN supplier ON s_suppkey = asset_id""")
def d8_controlled_apply(t):
    return V.controlled_apply(customer_dry_run(t), t.supplier.select(F.col("s_suppkey").alias("asset_id")), "b1")


@query(f"""WITH {EVENTS_SQL}, {QUEUE_SQL}, {DRY_SQL}, x AS (SELECT asset_id, s_suppkey FROM (SELECT asset_id FROM dry WHERE reasons = '' ORDER BY ordinal, asset_id LIMIT 10) LEFT JOIN supplier ON s_suppkey = asset_id)
SELECT 'first' AS run, CASE WHEN s_suppkey IS NULL THEN 'applied' ELSE 'skipped' END AS result, count(*) AS n, count(*) AS traced FROM x GROUP BY 2 UNION ALL SELECT 'second', 'skipped', count(*), count(*) FROM x HAVING count(*) > 0""")
def d15_apply_report(t):
    """The batch applied twice: what the first run stored, the second skips; every item traces back to an accepted decision."""
    stored = t.supplier.select(F.col("s_suppkey").alias("asset_id"))
    accepted = V.intake(event_decisions(t)).select("asset_id", F.lit(1).alias("known"))
    first = V.controlled_apply(customer_dry_run(t), stored, "b1")
    second = V.controlled_apply(customer_dry_run(t), stored.union(first.where("result = 'applied'").select("asset_id")), "b2")
    both = first.select(F.lit("first").alias("run"), "asset_id", "result").unionByName(second.select(F.lit("second").alias("run"), "asset_id", "result"))
    return both.join(accepted, "asset_id", "left").groupBy("run", "result").agg(F.count("*").alias("n"), F.count("known").alias("traced"))


INTAKE_SQL = f"it AS (SELECT asset_id, review_time, nullif(trim(related), '') AS project_id, {_id('project_', 'asset_id')} AS new_project, {_id('document_', 'asset_id')} AS new_document FROM last WHERE decision = 'ACCEPT')"


@query(f"""WITH {EVENTS_SQL}, {INTAKE_SQL} SELECT 'project' AS kind, new_project AS id, asset_id, NULL AS project_id FROM it WHERE project_id IS NULL UNION ALL SELECT 'document', new_document, asset_id, project_id FROM it WHERE project_id IS NOT NULL
UNION ALL SELECT 'project', 'p' || s_suppkey, s_suppkey, NULL FROM supplier""")
def d2_intake(t):
    """Accepted assets enter the repository; a second build adds nothing."""
    items = V.intake(event_decisions(t))
    time = F.lit("2020-01-01").cast("timestamp_ntz")
    projects = t.supplier.select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("project_id"), F.col("s_suppkey").cast("long").alias("asset_id"), F.lit("confirmed").alias("status"), time.alias("created_time"))
    documents = items.where("false").select(F.col("intake_id").alias("document_id"), F.col("asset_id").cast("long").alias("asset_id"), "project_id", F.lit("").alias("status"), time.alias("created_time"))
    projects, documents = V.repository(items, *V.repository(items, projects, documents))
    return projects.select(F.lit("project").alias("kind"), F.col("project_id").alias("id"), "asset_id", F.lit(None).cast("string").alias("project_id")).unionByName(documents.select(F.lit("document").alias("kind"), F.col("document_id").alias("id"), "asset_id", "project_id"))


@query("""WITH ch AS (SELECT o_custkey AS k, arg_max(CASE o_orderstatus WHEN 'F' THEN 'confirmed' ELSE 'candidate' END, o_orderkey) AS s FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), old AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'confirmed' ELSE 'candidate' END AS status FROM customer)
SELECT c_custkey, coalesce(s, status) AS status, s IS NOT NULL AND s <> status AS changed FROM old LEFT JOIN ch ON k = c_custkey UNION ALL SELECT o_custkey, 'rejected', false FROM orders WHERE o_orderstatus = 'P'""")
def d19_status_transition(t):
    kind = F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "candidate").otherwise("archived")
    changes = t.orders.select(F.col("o_custkey").alias("c_custkey"), kind.alias("new_status"), F.col("o_orderkey").alias("time"))
    rows, rejected = V.set_status(t.customer.select("c_custkey", F.when(F.col("c_acctbal") < 0, "confirmed").otherwise("candidate").alias("status")), "c_custkey", changes)
    return rows.select("c_custkey", "status", F.col("status_time").isNotNull().alias("changed")).unionByName(rejected.select("c_custkey", F.lit("rejected").alias("status"), F.lit(False).alias("changed")))


# Overrides: labels, applied to documents through ids, files (two documents may share one) and names.

OVERRIDES_SQL = """rec AS (SELECT doc_id AS record_id, 'id:' || doc_id AS k1, 'file:f' || CASE WHEN doc_id % 2 = 0 THEN doc_id // 4 ELSE doc_id END AS k2, 'name:' || lower(source) AS k3, lang, CASE WHEN n_chars > 500 THEN 'long' ELSE 'short' END AS grade FROM documents),
idx AS (SELECT k, count(*) AS hits, min(record_id) AS rid FROM (SELECT unnest([k1, k2, k3]) AS k, record_id FROM rec) WHERE k IS NOT NULL GROUP BY k),
ov AS (SELECT doc_id AS override_id, CASE doc_id % 3 WHEN 0 THEN 'id:' || doc_id WHEN 1 THEN 'file:f' || (doc_id + 2) ELSE 'name:src' || doc_id % 25 END AS k, doc_id % 11 = 0 AS bad, CASE WHEN toxic = 1 THEN 'xx' WHEN quality = 1 THEN 'en' END AS lang, CASE WHEN doc_id % 2 = 0 THEN 'long' END AS grade FROM labels),
cell AS (SELECT override_id, CASE WHEN NOT invalid THEN k END AS k, invalid, unnest(['lang', 'grade']) AS field, unnest([lang, grade]) AS after FROM (SELECT *, bad OR (lang IS NULL AND grade IS NULL) AS invalid FROM ov)),
pre AS (SELECT override_id, field, after, invalid, hits, CASE WHEN hits = 1 THEN rid END AS record_id FROM cell LEFT JOIN idx USING (k) WHERE after IS NOT NULL OR invalid),
sta AS (SELECT pre.*, CASE field WHEN 'lang' THEN lang WHEN 'grade' THEN grade END AS before FROM pre LEFT JOIN rec USING (record_id)),
plan AS (SELECT override_id, record_id, field, before, after, CASE WHEN record_id IS NOT NULL AND min(after) OVER w <> max(after) OVER w THEN 'conflict' WHEN invalid THEN 'invalid' WHEN hits IS NULL THEN 'skipped' WHEN hits > 1 THEN 'ambiguous' WHEN before IS NOT DISTINCT FROM after THEN 'no_change' ELSE 'applied' END AS status FROM sta WINDOW w AS (PARTITION BY record_id, field))"""
FIELDS = ("lang", "grade")


def label_overrides(t):
    n = F.col("doc_id")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    return t.labels.select(
        n.alias("override_id"), F.when(n % 3 == 0, n.cast("string")).alias("source_document_id"), F.when(n % 3 == 1, text("F", n + 2)).otherwise(" ").alias("source_file"), F.when(n % 3 == 2, text("src", n % 25)).alias("project_name"),
        F.when(n % 11 != 0, "audit").alias("source"), F.lit("r").alias("reason"), F.lit("2024-01-01").alias("updated_at"), F.when(F.col("toxic") == 1, "xx").when(F.col("quality") == 1, "en").alias("lang"), F.when(n % 2 == 0, "long").otherwise("").alias("grade"),
    )


def document_records(t):
    n = F.col("doc_id")
    file = F.concat(F.lit("f"), F.when(n % 2 == 0, F.floor(n / 4)).otherwise(n).cast("string"))
    return t.documents.select(n.alias("record_id"), n.cast("string").alias("source_document_id"), file.alias("source_file"), F.col("source").alias("project_name"), "lang", F.when(F.col("n_chars") > 500, "long").otherwise("short").alias("grade"))


def override_plan(t):
    return O.plan(label_overrides(t), document_records(t), FIELDS)


@query(f"WITH {OVERRIDES_SQL} SELECT override_id, concat_ws(',', CASE WHEN bad THEN 'source missing' END, CASE WHEN lang IS NULL AND grade IS NULL THEN 'no field' END) AS errors FROM ov")
def p15_override_validity(t):
    return O.errors(label_overrides(t), FIELDS).select("override_id", F.array_join("errors", ",").alias("errors"))


@query(f"WITH {OVERRIDES_SQL} SELECT override_id, field, record_id, status FROM plan")
def j15_override_targets(t):
    return override_plan(t).select("override_id", "field", "record_id", "status")


@query(f"WITH {OVERRIDES_SQL} SELECT count(*) FILTER (status = 'applied') AS applied, count(*) FILTER (status = 'no_change') AS no_change, " + ", ".join(f"count(DISTINCT override_id) FILTER (status = '{s}') AS {s}" for s in O.STATUSES[2:]) + " FROM plan")
def a10_diff_stats(t):
    return O.stats(override_plan(t))


@query(f"WITH {OVERRIDES_SQL} SELECT record_id, field, min(before) AS before, count(DISTINCT after) AS wanted, count(*) AS overrides FROM plan WHERE status = 'conflict' GROUP BY ALL")
def a11_override_conflicts(t):
    return override_plan(t).where("status = 'conflict'").groupBy("record_id", "field").agg(F.min("before").alias("before"), F.count_distinct("after").alias("wanted"), F.count("*").alias("overrides"))


@query(f"""WITH {OVERRIDES_SQL}, ch AS (SELECT record_id, max(after) FILTER (field = 'lang') AS l, max(after) FILTER (field = 'grade') AS g FROM plan WHERE status = 'applied' GROUP BY 1)
SELECT record_id, coalesce(l, lang) AS lang, coalesce(g, grade) AS grade, concat_ws(',', CASE WHEN l IS NOT NULL THEN 'lang' END, CASE WHEN g IS NOT NULL THEN 'grade' END) AS overridden FROM rec LEFT JOIN ch USING (record_id)""")
def d4_override_apply(t):
    return O.apply(override_plan(t), document_records(t), FIELDS).select("record_id", "lang", "grade", F.array_join("overridden", ",").alias("overridden"))


RULES = [("en", "source", 2), ("en", "quality", 3), ("de", "source", 1), ("de", "toxic", 1), ("fr", "quality", 4), ("fr", "source", 1), ("fr", "toxic", 2)]
COMPLETE_SQL = f"""rule AS (SELECT * FROM (VALUES {', '.join(map(str, RULES))}) r(doc_type, field, weight)), rr AS (SELECT d.doc_id AS record_id, lang AS doc_type, unnest(['source', 'quality', 'toxic']) AS field, unnest([source, CAST(quality AS VARCHAR), CAST(toxic AS VARCHAR)]) AS value FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
sc AS (SELECT record_id, round(100.0 * sum(CASE WHEN trim(value) <> '' THEN weight ELSE 0 END) / sum(weight), 1) AS score, coalesce(string_agg(DISTINCT field, ',' ORDER BY field) FILTER (value IS NULL OR trim(value) = ''), '') AS missing FROM rr JOIN rule USING (doc_type, field) GROUP BY 1)"""


@query(f"WITH {COMPLETE_SQL} SELECT doc_id AS record_id, coalesce(score, 0.0) AS score, coalesce(missing, '') AS missing FROM documents LEFT JOIN sc ON record_id = doc_id")
def f31_completeness(t):
    records = t.documents.join(t.labels, "doc_id", "left").select(F.col("doc_id").alias("record_id"), F.col("lang").alias("doc_type"), "source", "quality", "toxic")
    found = O.completeness(records, t.spark.createDataFrame(RULES, "doc_type string, field string, weight int"), ("source", "quality", "toxic"))
    return found.select("record_id", "score", F.array_join("missing", ",").alias("missing"))


# Ledger: customers are its rows, orders the records that come in.

LEDGER_SQL = """l AS (SELECT c_custkey AS row_id, 'k' || c_custkey % 900 AS record_key, c_custkey, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_name END AS customer, 'p' || c_custkey // 3 AS project, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'x' END AS mark FROM customer),
r AS (SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey END AS want, CASE WHEN o_orderkey % 7 IN (1, 2) THEN 'k' || o_orderkey % 2000 END AS record_key, CASE WHEN o_orderkey % 7 IN (2, 3) THEN 'f' || o_orderkey % 3000 END AS source_file, CASE WHEN o_orderkey % 7 IN (4, 5) THEN 'p' || o_orderkey % 1000 END AS project,
  CASE o_orderstatus WHEN 'F' THEN 'BUILDING' WHEN 'P' THEN 'MACHINERY' END AS segment, CASE WHEN o_orderkey % 3 = 0 THEN 'x' END AS mark FROM orders),
i2 AS (SELECT record_key AS k, count(DISTINCT row_id) AS hits, min(row_id) AS row_id FROM l GROUP BY 1), i3 AS (SELECT k, count(DISTINCT row_id) AS hits, min(row_id) AS row_id FROM (SELECT 'f' || c_custkey AS k, row_id FROM l UNION ALL SELECT 'f' || (c_custkey + 7), row_id FROM l) GROUP BY 1),
i4 AS (SELECT project AS k, count(DISTINCT row_id) AS hits, min(row_id) AS row_id FROM l WHERE customer IS NULL GROUP BY 1),
h AS (SELECT r.*, CASE WHEN l.row_id IS NOT NULL THEN ['row', '1', CAST(l.row_id AS VARCHAR)] WHEN i2.k IS NOT NULL THEN ['key', CAST(i2.hits AS VARCHAR), CAST(i2.row_id AS VARCHAR)] WHEN i3.k IS NOT NULL THEN ['source', CAST(i3.hits AS VARCHAR), CAST(i3.row_id AS VARCHAR)]
  WHEN i4.k IS NOT NULL THEN ['project', CAST(i4.hits AS VARCHAR), CAST(i4.row_id AS VARCHAR)] ELSE ['new', '0', NULL] END AS found FROM r LEFT JOIN l ON l.row_id = want LEFT JOIN i2 ON i2.k = r.record_key LEFT JOIN i3 ON i3.k = source_file LEFT JOIN i4 ON i4.k = r.project),
m AS (SELECT *, CASE WHEN CAST(found[2] AS INT) > 1 THEN 'ambiguous' ELSE found[1] END AS method, CAST(found[2] AS BIGINT) AS hits, CASE WHEN found[2] = '1' THEN CAST(found[3] AS BIGINT) END AS row_id FROM h),
pl AS (SELECT m.record_id, m.row_id, m.record_key, m.segment, m.mark, method, l.segment AS old_segment, l.mark AS old_mark, min(CASE WHEN method = 'new' THEN m.record_id END) OVER (PARTITION BY m.record_key) AS first_id FROM m LEFT JOIN l ON l.row_id = m.row_id),
ac AS (SELECT *, CASE WHEN method = 'ambiguous' THEN 'ambiguous' WHEN method = 'new' AND (record_key IS NULL OR record_id = first_id) THEN 'insert' WHEN method = 'new' THEN 'joined' WHEN segment <> old_segment OR mark <> old_mark THEN 'conflict'
  WHEN (segment IS NOT NULL AND old_segment IS NULL) OR (mark IS NOT NULL AND old_mark IS NULL) THEN 'update' ELSE 'unchanged' END AS action FROM pl)"""
LEDGER_FIELDS = ("segment", "mark")


def ledger_rows(t):
    n = F.col("c_custkey")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    return t.customer.select(n.alias("row_id"), text("k", n % 900).alias("record_key"), F.concat_ws(" ; ", text("f", n), text("f", n + 7)).alias("source_note"), F.when(n % 2 == 0, " ").otherwise(F.col("c_name")).alias("customer"), text("p", F.floor(n / 3)).alias("project"), F.when(n % 4 != 0, F.col("c_mktsegment")).alias("segment"), F.when(n % 3 != 0, "x").alias("mark"))


def ledger_records(t):
    n = F.col("o_orderkey")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    part = n % 7
    return t.orders.select(n.alias("record_id"), F.when(part == 0, F.col("o_custkey")).alias("row_id"), F.when(part.isin(1, 2), text("k", n % 2000)).alias("record_key"), F.when(part.isin(2, 3), text("f", n % 3000)).alias("source_file"), F.when(part.isin(4, 5), text("p", n % 1000)).alias("project"), F.when(F.col("o_orderstatus") == "F", "BUILDING").when(F.col("o_orderstatus") == "P", "MACHINERY").alias("segment"), F.when(n % 3 == 0, "x").alias("mark"))


@query(f"WITH {LEDGER_SQL} SELECT record_id, method, row_id, hits FROM m")
def j18_ledger_match(t):
    return G.match(ledger_records(t), ledger_rows(t))


@query(f"WITH {LEDGER_SQL} SELECT method, count(*) AS n, count(DISTINCT row_id) AS ledger_rows, sum(hits)::BIGINT AS hits FROM m GROUP BY method")
def a9_ledger_summary(t):
    return G.match(ledger_records(t), ledger_rows(t)).groupBy("method").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("ledger_rows"), F.sum("hits").alias("hits"))


@query(f"WITH {LEDGER_SQL} SELECT record_id, row_id, action, CASE WHEN action = 'conflict' THEN concat_ws(',', CASE WHEN segment <> old_segment THEN 'segment:' || old_segment || '>' || segment END, CASE WHEN mark <> old_mark THEN 'mark:' || old_mark || '>' || mark END) END AS conflicts FROM ac")
def j19_sync_plan(t):
    told = F.array_join(F.transform("conflicts", lambda x: F.concat(x["field"], F.lit(":"), x["existing"], F.lit(">"), x["incoming"])), ",")
    return G.plan(ledger_records(t), ledger_rows(t), LEDGER_FIELDS).select("record_id", "row_id", "action", told.alias("conflicts"))


def ledger_after(t):
    records, rows = ledger_records(t), ledger_rows(t)
    return G.upsert(G.plan(records, rows, LEDGER_FIELDS), records, rows, LEDGER_FIELDS, overwrite=("mark",))


AFTER_SQL = """up AS (SELECT row_id, arg_min(segment, record_id) FILTER (segment IS NOT NULL) AS segment, arg_min(mark, record_id) FILTER (mark IS NOT NULL) AS mark FROM ac WHERE action IN ('update', 'conflict') GROUP BY 1),
af AS (SELECT l.row_id, l.record_key, coalesce(l.segment, up.segment) AS segment, coalesce(up.mark, l.mark) AS mark FROM l LEFT JOIN up ON up.row_id = l.row_id UNION ALL SELECT NULL, record_key, segment, mark FROM ac WHERE action = 'insert')"""


@query(f"WITH {LEDGER_SQL}, {AFTER_SQL} SELECT row_id, record_key, segment, mark FROM af")
def d13_ledger_upsert(t):
    """The ledger after all orders; the serials of inserted rows are left to ``d25_batch_sync``, as their order is free."""
    last = t.customer.agg(F.max("c_custkey")).scalar()
    return ledger_after(t).select(F.when(F.col("row_id") <= last, F.col("row_id")).alias("row_id"), "record_key", "segment", "mark")


@query(f"WITH {LEDGER_SQL}, {AFTER_SQL} SELECT count(*) AS n_rows, count(*) AS serials, (SELECT max(c_custkey) FROM customer) + count(*) FILTER (row_id IS NULL) AS last_serial, count(segment) AS with_segment FROM af")
def d25_batch_sync(t):
    """Serials go on without a gap after the largest one."""
    return ledger_after(t).agg(F.count("*").alias("n_rows"), F.count_distinct("row_id").alias("serials"), F.max("row_id").alias("last_serial"), F.count("segment").alias("with_segment"))


# Repository: orders are projects, their lines documents, linked by a relation.

RELATION = "CASE WHEN l_quantity = 50 THEN 'memo' WHEN l_returnflag = 'R' THEN 'bid_notice' WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 'award_notice' WHEN l_linestatus = 'F' THEN 'contract' ELSE 'attachment' END"
REPO_SQL = f"""k AS (SELECT CASE WHEN l_quantity = 1 THEN -l_orderkey ELSE l_orderkey END AS project_id, l_orderkey * 10 + l_linenumber AS document_id, {RELATION} AS relation_type, l_shipdate AS created_time, l_quantity FROM lineitem),
doc AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS document_id FROM lineitem WHERE l_quantity <> 2)"""


def repo_links(t):
    return t.lineitem.select(F.when(F.col("l_quantity") == 1, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("project_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("document_id"), F.expr(RELATION).alias("relation_type"), F.col("l_shipdate").alias("created_time"), "l_quantity")


def repo_projects(t):
    return t.orders.select(F.col("o_orderkey").alias("project_id"), F.col("o_orderkey").alias("ordinal"))


def repo_documents(t):
    """The lines that are stored; those with a quantity of two are dangling."""
    return t.lineitem.where("l_quantity <> 2").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("document_id"), F.col("l_partkey").alias("ordinal"))


@query(f"WITH {REPO_SQL} SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY created_time, relation_type, k.document_id) AS place, k.document_id, relation_type, doc.document_id IS NOT NULL AS is_stored FROM k JOIN orders ON o_orderkey = project_id LEFT JOIN doc ON doc.document_id = k.document_id")
def j1_project_documents(t):
    return R.project_documents(repo_projects(t), repo_links(t), repo_documents(t)).select("project_id", "place", "document_id", "relation_type", "is_stored")


@query(f"WITH {REPO_SQL} SELECT document_id, project_id, relation_type, row_number() OVER (PARTITION BY document_id ORDER BY created_time, relation_type, project_id) = 1 AS is_first FROM k JOIN orders ON o_orderkey = project_id JOIN doc USING (document_id)")
def j2_document_projects(t):
    return R.document_projects(repo_projects(t), repo_links(t), repo_documents(t))


@query(f"""WITH {REPO_SQL}, j AS (SELECT k.*, CASE WHEN o_orderkey IS NULL THEN 'unknown project' WHEN doc.document_id IS NULL THEN 'unknown document' WHEN relation_type = 'memo' THEN 'unknown relation' END AS reason FROM k LEFT JOIN orders ON o_orderkey = project_id LEFT JOIN doc ON doc.document_id = k.document_id),
old AS (SELECT DISTINCT project_id, document_id, relation_type FROM k WHERE l_quantity > 40)
SELECT {_id('link_', 'project_id', 'document_id', 'relation_type')} AS link_id, project_id, document_id, relation_type, NULL AS reason FROM (SELECT DISTINCT project_id, document_id, relation_type FROM j WHERE reason IS NULL) ANTI JOIN old USING (project_id, document_id, relation_type)
UNION ALL SELECT NULL, project_id, document_id, relation_type, reason FROM j WHERE reason IS NOT NULL""")
def j23_create_links(t):
    """All links are asked for; those of quantities above 40 are stored already."""
    made, rejected = V.create_links(repo_links(t).drop("l_quantity"), repo_projects(t), repo_documents(t), repo_links(t).where("l_quantity > 40").select("project_id", "document_id", "relation_type").distinct())
    return made.select("link_id", "project_id", "document_id", "relation_type", F.lit(None).cast("string").alias("reason")).unionByName(rejected.select(F.lit(None).cast("string").alias("link_id"), "project_id", "document_id", "relation_type", "reason"))


TIMES_SQL = "CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE CAST(o_orderdate AS VARCHAR) END AS updated, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status_updated, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS modified, 'created' AS created"


def timed_projects(t):
    n = F.col("o_orderkey")
    return t.orders.select(n.alias("project_id"), n.alias("ordinal"), "o_custkey", "o_orderpriority", F.when(n % 2 == 0, "").otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("updated"), F.when(n % 3 != 0, F.col("o_orderstatus")).alias("status_updated"), F.when(n % 5 == 0, "").otherwise(F.col("o_orderpriority")).alias("modified"), F.lit("created").alias("created"))


@query(f"SELECT o_orderkey AS project_id, coalesce(nullif(CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END, ''), nullif(status_updated, ''), nullif(modified, ''), created) AS updated_time FROM (SELECT o_orderkey, o_orderdate, {TIMES_SQL} FROM orders)")
def f42_updated_fallback(t):
    return R.updated_time(timed_projects(t)).select("project_id", "updated_time")


@query("""WITH p AS (SELECT o_orderkey AS project_id, o_orderpriority AS project_name, c_name AS customer, c_mktsegment AS winner, CAST(o_orderkey AS VARCHAR) AS project_number FROM orders LEFT JOIN customer ON c_custkey = o_custkey),
f AS (SELECT project_id, place - 1 AS field, lower(v) AS v FROM (SELECT project_id, unnest([project_name, customer, winner, project_number]) AS v, unnest([1, 2, 3, 4]) AS place FROM p)),
h AS (SELECT project_id, min(CASE WHEN v = 'customer#000000015' THEN 0 WHEN starts_with(v, 'customer#000000015') THEN 1 WHEN contains(v, 'customer#000000015') THEN 2 END) AS match FROM f GROUP BY 1),
n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT p.*, coalesce(n, 0) AS n_links, match FROM p JOIN h USING (project_id) LEFT JOIN n ON l_orderkey = project_id WHERE match IS NOT NULL""")
def t1_search_projects(t):
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("customer"), F.col("c_mktsegment").alias("winner"))
    projects = timed_projects(t).join(customers, "o_custkey", "left").withColumns({"project_name": F.col("o_orderpriority"), "project_number": F.col("project_id").cast("string")})
    found = R.search_projects(projects, t.lineitem.select(F.col("l_orderkey").alias("project_id")), "Customer#000000015")
    return found.drop("updated_time")


@query("""WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS project_id, l_linenumber AS package_id, 's' || l_suppkey AS winner, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS award_amount, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS ordinal FROM lineitem),
old AS (SELECT 'e' || o_orderkey AS award_detail_id, o_orderkey AS project_id, 1 AS package_id, CASE WHEN o_orderstatus = 'F' THEN ' ' ELSE 'w' || o_custkey END AS winner, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE '7' END AS award_amount FROM orders),
fi AS (SELECT project_id, package_id, arg_min(winner, ordinal) AS w, arg_min(award_amount, ordinal) AS a FROM x GROUP BY ALL)
SELECT award_detail_id, project_id, package_id, coalesce(nullif(trim(winner), ''), w, winner) AS winner, coalesce(nullif(trim(award_amount), ''), a, award_amount) AS award_amount FROM old LEFT JOIN fi USING (project_id, package_id)
UNION ALL SELECT 'n' || id, project_id, package_id, winner, award_amount FROM x ANTI JOIN old USING (project_id, package_id) QUALIFY row_number() OVER (PARTITION BY id ORDER BY ordinal) = 1""")
def u6_award_merge(t):
    """Each order holds its first package, often with blanks; its lines bring details of all packages."""
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    new = t.lineitem.select(F.concat(F.lit("n"), line.cast("string")).alias("award_detail_id"), F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").alias("package_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("winner"), F.col("l_quantity").cast("int").cast("string").alias("award_amount"), (F.col("l_linenumber") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("ordinal"))
    old = t.orders.select(F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("award_detail_id"), F.col("o_orderkey").alias("project_id"), F.lit(1).cast(new.schema["package_id"].dataType).alias("package_id"), F.when(F.col("o_orderstatus") == "F", " ").otherwise(F.concat(F.lit("w"), F.col("o_custkey").cast("string"))).alias("winner"), F.when(F.col("o_orderstatus") != "P", "7").alias("award_amount"))
    return R.merge_awards(old, new)


@query(f"""WITH d AS (SELECT l_orderkey, count(*) AS docs, bool_or({RELATION} = 'bid_notice') AS bid, bool_or({RELATION} = 'award_notice') AS award, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) + max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) + max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS times FROM lineitem GROUP BY 1)
SELECT o_orderkey AS project_id, round(40 * least(coalesce(docs, 0), 3) / 3.0::DOUBLE + 30 * least(coalesce(docs, 0), 3) / 3.0::DOUBLE + 30 * least(coalesce(times, 0), 3) / 3.0::DOUBLE, 1) AS score, concat_ws(',', CASE WHEN NOT coalesce(bid, false) THEN 'bid' END, CASE WHEN NOT coalesce(award, false) THEN 'award' END) AS missing FROM orders LEFT JOIN d ON l_orderkey = o_orderkey""")
def a13_asset_score(t):
    documents = t.lineitem.select(F.col("l_orderkey").alias("project_id"), F.expr(RELATION).alias("document_name"))
    time = lambda when: F.when(when, F.col("l_shipdate").cast("string"))
    records = t.lineitem.select(F.col("l_orderkey").alias("project_id"), time(F.col("l_returnflag") == "R").alias("publish_time"), time(F.col("l_linestatus") == "F").alias("open_time"), time(F.col("l_returnflag") == "A").alias("award_time"))
    found = R.asset_score(repo_projects(t), documents, records, {"bid": "bid_notice", "award": "award_notice"})
    return found.select("project_id", "score", F.array_join("missing_kinds", ",").alias("missing"))
