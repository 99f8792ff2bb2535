"""Decisions, review queues, lifecycles: queries over the events table as a decision log."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators import latest as L
from ledgerloom.operators import remediation as M
from ledgerloom.operators import tables as T
from ledgerloom.plans.registry import query

DECISIONS = {"purchase": "ACCEPT", "error": "REJECT", "view": "DEFER", "click": "NEEDS_MORE_INFO", "signup": "ACCEPT"}
_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DECISIONS.items()) + " END"
#: Review times are whole hours, so that ties occur.
D_SQL = f"d AS (SELECT event_id AS decision_id, user_id AS asset_id, {_CASE} AS decision, date_trunc('day', ts) AS review_time, event_id AS ordinal, value FROM events)"
PRIORITY = "CASE WHEN event_type = 'purchase' AND value >= 80 THEN 'P1' WHEN event_type IN ('purchase', 'signup') OR value >= 60 THEN 'P2' ELSE 'P3' END"


def decisions(t):
    return t.events.select(
        F.col("event_id").alias("decision_id"), F.col("user_id").alias("asset_id"), F.expr(_CASE).alias("decision"), F.date_trunc("day", "ts").alias("review_time"), F.col("event_id").alias("ordinal"), "value"
    )


@query(f"WITH {D_SQL} SELECT asset_id, decision_id, decision FROM d QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY review_time DESC, ordinal DESC) = 1")
def w1_latest_decision(t):
    return L.latest(decisions(t), ["asset_id"], "review_time", "ordinal").select("asset_id", "decision_id", "decision")


@query(f"WITH {D_SQL} SELECT asset_id, decision_id, decision FROM d QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY review_time DESC, CAST(decision_id AS VARCHAR) DESC, ordinal DESC) = 1")
def w2_latest_decision_by_id(t):
    rows = decisions(t).withColumn("id_text", F.col("decision_id").cast("string"))
    return L.latest(rows, ["asset_id"], "review_time", "id_text", "ordinal").select("asset_id", "decision_id", "decision")


@query(f"WITH {D_SQL} SELECT asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY review_time, ordinal) AS place, decision_id, decision FROM d")
def w3_decision_history(t):
    return L.history(decisions(t), "asset_id", ["decision_id", "decision"], "review_time", "ordinal")


@query(f"WITH {D_SQL} SELECT asset_id, decision_id FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY review_time DESC, ordinal DESC) = 1) WHERE decision = 'ACCEPT'")
def w15_assets_by_latest_decision(t):
    return L.with_value_latest(decisions(t), "asset_id", "decision", "ACCEPT", list(DECISIONS.values()), "review_time", "ordinal").select("asset_id", "decision_id")


@query("WITH r AS (SELECT user_id, event_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT user_id, event_id, event_type, n IS NULL AS is_final FROM r WHERE n IS NULL OR n <> event_type")
def w4_lifecycle_replay(t):
    return L.replay(t.events.select("user_id", "event_id", "event_type", "ts"), "user_id", "event_type", "ts", "event_id").drop("ts")


@query("SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, min(event_id) AS first_place FROM events GROUP BY user_id, event_type")
def w9_last_write_first_place(t):
    rows = t.events.select(F.concat_ws("|", "user_id", "event_type").alias("k"), "user_id", "event_type", "event_id")
    return L.last_write_first_place(rows, "k", "event_id").drop("k")


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def j20_never_decided(t):
    return T.difference(t.customer, t.events.select(F.col("user_id").alias("c_custkey")), "c_custkey")


def priority(status, score, high=80, middle=60):
    """P1 for promoted rows with a high score, P2 for promoted or middling ones, else P3."""
    return F.when((status == "purchase") & (score >= high), "P1").when(status.isin("purchase", "signup") | (score >= middle), "P2").otherwise("P3")


@query(f"SELECT event_id, {PRIORITY} AS priority, value FROM events")
def t3_queue_order(t):
    return t.events.select("event_id", priority(F.col("event_type"), F.col("value")).alias("priority"), "value").orderBy("priority", F.desc("value"), "event_id")


READY = "CASE WHEN event_type = 'error' THEN 'skipped' WHEN quality IS NULL OR value < 20 THEN 'blocked' ELSE 'ready' END"
REASONS = "concat_ws('; ', CASE WHEN event_type = 'error' THEN 'rejected' END, CASE WHEN quality IS NULL THEN 'no label' END, CASE WHEN value < 20 THEN 'low value' END)"


def dry_run(t):
    """Ready, blocked or skipped, with every reason."""
    joined = t.events.join(t.labels.withColumnRenamed("doc_id", "event_id"), "event_id", "left")
    low, bare, wrong = F.col("value") < 20, F.col("quality").isNull(), F.col("event_type") == "error"
    reasons = F.concat_ws("; ", F.when(wrong, "rejected"), F.when(bare, "no label"), F.when(low, "low value"))
    return joined.select("event_id", "value", F.when(wrong, "skipped").when(bare | low, "blocked").otherwise("ready").alias("outcome"), reasons.alias("reasons"))


@query(f"SELECT event_id FROM events LEFT JOIN labels ON doc_id = event_id WHERE {READY} = 'ready' ORDER BY event_id LIMIT 10")
def t7_batch_selection(t):
    return dry_run(t).where("outcome = 'ready'").orderBy("event_id").limit(10).select("event_id")


@query(f"""WITH {D_SQL}, l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY review_time DESC, ordinal DESC) = 1)
SELECT asset_id, decision_id, c_name, quality FROM l LEFT JOIN customer ON c_custkey = asset_id LEFT JOIN labels ON doc_id = asset_id WHERE decision = 'ACCEPT'""")
def j27_accepted_assets(t):
    accepted = L.latest(decisions(t), ["asset_id"], "review_time", "ordinal").where("decision = 'ACCEPT'")
    return accepted.join(t.customer, F.col("c_custkey") == F.col("asset_id"), "left").join(t.labels, F.col("doc_id") == F.col("asset_id"), "left").select("asset_id", "decision_id", "c_name", "quality")


@query("SELECT e.event_id, coalesce(CASE WHEN event_type <> 'view' THEN event_type END, CASE WHEN quality = 1 THEN 'labelled' END, 'unknown') AS source_type, coalesce(quality + 0.0, value) AS confidence FROM events e LEFT JOIN labels ON doc_id = event_id")
def p23_queue_item_view(t):
    joined = t.events.join(t.labels, F.col("doc_id") == F.col("event_id"), "left")
    return joined.select("event_id", F.coalesce(F.when(F.col("event_type") != "view", F.col("event_type")), F.when(F.col("quality") == 1, F.lit("labelled")), F.lit("unknown")).alias("source_type"), F.coalesce(F.col("quality").cast("double"), "value").alias("confidence"))


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p, count(*) FILTER (o_orderstatus = 'X') AS n_x FROM orders")
def a16_status_counters(t):
    return t.orders.agg(F.count("*").alias("total"), *[F.count_if(F.col("o_orderstatus") == s).alias(f"n_{s.lower()}") for s in "FOPX"])


@query("""WITH r AS (SELECT user_id, list_position(['signup', 'view', 'click', 'purchase'], event_type) AS stage, value FROM events WHERE event_type <> 'error'),
s AS (SELECT user_id, stage, CASE WHEN max(value) > 250 THEN 'failed' WHEN max(value) > 200 THEN 'blocked' ELSE 'success' END AS status FROM r GROUP BY ALL)
SELECT user_id, coalesce(min(stage) FILTER (status = 'failed'), min(stage) FILTER (status = 'blocked'), max(stage)) AS stage,
  CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'retry' WHEN count(*) FILTER (status = 'blocked') > 0 THEN 'review' ELSE 'none' END AS next_action FROM s GROUP BY user_id""")
def a18_stage_trace_summary(t):
    order = F.array(*map(F.lit, ("signup", "view", "click", "purchase")))
    stages = t.events.where("event_type <> 'error'").groupBy("user_id", F.array_position(order, F.col("event_type")).alias("stage")).agg(F.max("value").alias("top"))
    stages = stages.withColumn("status", F.when(F.col("top") > 250, "failed").when(F.col("top") > 200, "blocked").otherwise("success"))
    at = lambda s: F.min(F.when(F.col("status") == s, F.col("stage")))
    return stages.groupBy("user_id").agg(F.coalesce(at("failed"), at("blocked"), F.max("stage")).alias("stage"), F.when(at("failed").isNotNull(), "retry").when(at("blocked").isNotNull(), "review").otherwise("none").alias("next_action"))


@query(f"""WITH {D_SQL} SELECT count(*) AS decisions, count(*) FILTER (decision = 'ACCEPT') AS accepted, count(DISTINCT asset_id) FILTER (decision = 'ACCEPT') AS accepted_assets, count(*) FILTER (decision = 'REJECT') AS failures FROM d""")
def a21_flow_summary(t):
    d = decisions(t)
    accepted = F.col("decision") == "ACCEPT"
    return d.agg(F.count("*").alias("decisions"), F.count_if(accepted).alias("accepted"), F.count_distinct(F.when(accepted, F.col("asset_id"))).alias("accepted_assets"), F.count_if(F.col("decision") == "REJECT").alias("failures"))


def record_decisions(requests, queue, allowed):
    """``(recorded, errors)``: requests with a known decision for a queued asset get the queue row; the others say why not."""
    joined = requests.join(queue.withColumn("_queued", F.lit(True)), "asset_id", "left")
    error = F.when(F.col("_queued").isNull(), "not queued").when(~F.col("decision").isin(*allowed), "unknown decision")
    judged = joined.withColumn("error", error).drop("_queued")
    return judged.where("error IS NULL").drop("error"), judged.where("error IS NOT NULL").select("decision_id", "asset_id", "error")


@query("SELECT user_id, bool_or(event_type = 'error') AS blocked, min(event_id) FILTER (event_type <> 'error') AS canonical, count(*) AS members FROM events GROUP BY user_id")
def w17_group_ambiguity(t):
    wrong = F.col("event_type") == "error"
    return t.events.groupBy("user_id").agg(F.bool_or(wrong).alias("blocked"), F.min(F.when(~wrong, F.col("event_id"))).alias("canonical"), F.count("*").alias("members"))


@query("SELECT coalesce(nullif(trim(CASE WHEN value < 5 THEN ' ' ELSE event_type END), ''), '(blank)') AS value, count(*) AS n FROM events GROUP BY 1")
def a5_count_by(t):
    return T.count_by(t.events.select(F.when(F.col("value") < 5, " ").otherwise(F.col("event_type")).alias("kind")), "kind")


@query("""SELECT 'event_type' AS kind, event_type AS value, count(*) AS n FROM events GROUP BY event_type
UNION ALL SELECT 'band', CASE WHEN value < 50 THEN 'low' ELSE 'high' END, count(*) FROM events GROUP BY 2
UNION ALL SELECT 'flag', 'weak', count(*) FROM events WHERE value < 10 HAVING count(*) > 0""")
def a7_histograms(t):
    rows = t.events.select("event_type", F.when(F.col("value") < 50, "low").otherwise("high").alias("band"), F.when(F.col("value") < 10, "weak").alias("flag"))
    return T.histograms(rows, ["event_type", "band", "flag"])


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS done, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'error' AND value < 100) AS retryable, count(*) FILTER (event_type = 'error' AND value >= 100) > 0 AS blocking FROM events GROUP BY user_id")
def a17_attachment_progress(t):
    wrong, cheap = F.col("event_type") == "error", F.col("value") < 100
    return t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("done"), F.count_if(wrong).alias("failed"), F.count_if(wrong & cheap).alias("retryable"), (F.count_if(wrong & ~cheap) > 0).alias("blocking"))


@query("SELECT user_id % 20 AS site, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, rank() OVER (ORDER BY count(*) FILTER (event_type = 'error') DESC, user_id % 20) AS place FROM events GROUP BY 1")
def a20_site_diagnostics(t):
    per_site = t.events.groupBy((F.col("user_id") % 20).alias("site")).agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return per_site.withColumn("place", F.rank().over(Window.orderBy(F.desc("errors"), "site")).cast("long"))


@query("SELECT o_orderstatus AS outcome, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY o_orderstatus")
def a23_batch_outcomes(t):
    return t.orders.groupBy(F.col("o_orderstatus").alias("outcome")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("SELECT event_id FROM events WHERE NOT (event_type = 'error' AND value > 100) AND user_id % 10 <> 0")
def p10_visible(t):
    hidden = ((F.col("event_type") == "error") & (F.col("value") > 100)) | (F.col("user_id") % 10 == 0)
    return t.events.where(~hidden).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
def p11_status_filter(t):
    return t.orders.where(F.col("o_orderstatus").isin("F", "P")).select("o_orderkey")


@query("SELECT doc_id, lang FROM documents WHERE source = 'src1'")
def p22_source_filter(t):
    return t.documents.where(F.col("source") == "src1").select("doc_id", "lang")


@query("""SELECT event_id, 'event ' || event_id AS title, coalesce(TRY_CAST(nullif(CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(json_extract(props, '$.k') AS VARCHAR) END, '') AS DOUBLE), value) AS confidence,
CASE WHEN event_type = 'purchase' THEN 'MATCHED' ELSE 'NEW' END AS status FROM events""")
def p3_normalise_candidates(t):
    raw = F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(F.get_json_object("props", "$.k"))
    return t.events.select("event_id", F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("title"), F.coalesce(raw.try_cast("double"), "value").alias("confidence"), F.when(F.col("event_type") == "purchase", "MATCHED").otherwise("NEW").alias("status"))


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN value WHEN event_type IN ('error', 'view') THEN 0.55 ELSE 0.65 END AS confidence, strftime(ts, '%Y-%m-%d') AS discovered FROM events")
def p4_vendor_candidates(t):
    flags = F.array(F.col("event_type"))
    weak = F.arrays_overlap(flags, F.array(F.lit("error"), F.lit("view")))
    return t.events.select("event_id", F.when(F.col("event_type") == "purchase", F.col("value")).when(weak, 0.55).otherwise(0.65).alias("confidence"), F.date_format("ts", "yyyy-MM-dd").alias("discovered"))


GATE = "CASE WHEN event_type = 'purchase' AND value >= 80 AND user_id > 5 THEN 'document' WHEN event_type = 'signup' THEN 'project' ELSE 'skipped' END"


@query("""SELECT event_id, CASE WHEN event_type = 'signup' THEN 'manual' WHEN event_type = 'error' THEN 'technical' WHEN value < 50 THEN 'field' ELSE 'auto' END AS route,
CASE WHEN event_type = 'signup' THEN true WHEN event_type = 'error' THEN false WHEN value < 50 THEN user_id % 2 = 0 ELSE true END AS eligible FROM events""")
def p18_eligibility_route(t):
    route = F.when(F.col("event_type") == "signup", "manual").when(F.col("event_type") == "error", "technical").when(F.col("value") < 50, "field").otherwise("auto")
    fixed = F.col("user_id") % 2 == 0
    return t.events.select("event_id", route.alias("route"), F.when(route == "manual", True).when(route == "technical", False).when(route == "field", fixed).otherwise(True).alias("eligible"))


@query("""SELECT event_id, CASE WHEN event_type = 'purchase' THEN user_id END AS winner, CASE WHEN event_type = 'purchase' THEN value END AS amount,
coalesce(CASE WHEN value < 10 THEN 'weak' END, CASE WHEN event_type = 'error' THEN 'kind' END) AS first_flag FROM events""")
def p26_vendor_shape(t):
    award = F.col("event_type") == "purchase"
    flags = F.array_compact(F.array(F.when(F.col("value") < 10, "weak"), F.when(F.col("event_type") == "error", "kind")))
    return t.events.select("event_id", F.when(award, F.col("user_id")).alias("winner"), F.when(award, F.col("value")).alias("amount"), F.get(flags, 0).alias("first_flag"))


@query("""WITH c AS (SELECT user_id AS id, event_id AS prec, CASE WHEN value > 50 THEN event_type END AS kind, CASE WHEN value < 100 THEN CAST(event_id AS VARCHAR) ELSE ' ' END AS note FROM events)
SELECT id, arg_max(kind, prec) FILTER (kind IS NOT NULL) AS kind, arg_max(note, prec) FILTER (trim(note) <> '') AS note FROM c GROUP BY id""")
def j5_candidate_overlay(t):
    rows = t.events.select(F.col("user_id").alias("id"), F.col("event_id").alias("prec"), F.when(F.col("value") > 50, F.col("event_type")).alias("kind"), F.when(F.col("value") < 100, F.col("event_id").cast("string")).otherwise(" ").alias("note"))
    return L.overlay(rows, "id", "prec", ["kind", "note"])


@query("SELECT user_id, 'group_' || sha256(string_agg(CAST(event_id AS VARCHAR), chr(10) ORDER BY event_id))[1:16] AS group_id, count(*) AS members FROM events GROUP BY user_id")
def a3_group_id(t):
    return t.events.groupBy("user_id").agg(F.concat(F.lit("group_"), F.left(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), "\n"), 256), F.lit(16))).alias("group_id"), F.count("*").alias("members"))


#: The first half of the month is stored, the second comes in; a view has no value of its own.
_NESTED = "(SELECT user_id, event_type AS attempt, event_id, CASE WHEN event_type <> 'view' OR ts < TIMESTAMP '2024-01-16' THEN value END AS value, props, (ts >= TIMESTAMP '2024-01-16')::INT AS late FROM events)"


def histories(t):
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    rows = t.events.select("user_id", F.col("event_type").alias("attempt"), "event_id", F.when((F.col("event_type") != "view") | ~late, F.col("value")).alias("value"), "props", late.alias("_late"))
    return rows.where("NOT _late").drop("_late"), rows.where("_late").drop("_late")


@query(f"""WITH e AS {_NESTED}, h AS (SELECT user_id, attempt, arg_max(value, (late, event_id)) FILTER (value IS NOT NULL) AS value, arg_max(props, (late, event_id)) AS props, max((late, event_id)) AS last, min((late, event_id)) AS first FROM e GROUP BY ALL)
SELECT user_id, attempt, value, props, last[2] AS event_id, row_number() OVER (PARTITION BY user_id ORDER BY first) AS place FROM h""".replace("last[2]", "struct_extract_at(last, 2)"))
def u7_nested_history_merge(t):
    return M.merge_histories(*histories(t), "user_id", "attempt", "event_id")


@query(f"""WITH e AS (SELECT user_id, attempt, event_id, late, floor(value / 100) AS step FROM {_NESTED}), old AS (SELECT * FROM e WHERE late = 0),
new AS (SELECT * FROM e WHERE late = 1 QUALIFY row_number() OVER (PARTITION BY user_id, attempt, coalesce(step::VARCHAR, '') ORDER BY event_id) = 1)
SELECT user_id, attempt, event_id, step FROM old UNION ALL SELECT user_id, attempt, event_id, step FROM new WHERE NOT EXISTS (FROM old WHERE old.user_id = new.user_id AND old.attempt = new.attempt AND coalesce(old.step::VARCHAR, '') = coalesce(new.step::VARCHAR, ''))""")
def u5_snapshot_append(t):
    old, new = (x.select("user_id", "attempt", "event_id", F.floor(F.col("value") / 100).cast("double").alias("step")) for x in histories(t))
    return M.append_snapshots(old, new, ["user_id", "attempt", "step"], "event_id")


@query("SELECT user_id, arg_max(event_type, event_id) AS last_outcome, count(*) AS attempts FROM events GROUP BY user_id")
def d18_attachment_merge(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_outcome"), F.count("*").alias("attempts"))


#: Events as corrections: two neighbours of a user share an action id (a retry), and who acts saw the revision of some actions ago; the first retries guess the next one.
ACTIONS = """a AS (SELECT user_id AS item, event_id AS ordinal, event_type AS field, CASE WHEN value < 20 THEN 'verify_current_value' ELSE 'correct_effective_value' END AS kind, CASE WHEN value >= 30 THEN round(value)::BIGINT::VARCHAR ELSE '' END AS value,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS nth, user_id || '-' || ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 2) AS action_id FROM events),
x AS (SELECT *, (nth // 4 + CASE WHEN nth < 8 THEN nth % 2 ELSE 0 END) AS expected, CASE WHEN kind = 'verify_current_value' THEN (CASE WHEN field <> 'error' THEN 'old ' || field END) ELSE nullif(value, '') END AS eff FROM a WHERE field <> 'view'),
o AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY ordinal) AS rn FROM x WHERE eff IS NOT NULL),
r AS (SELECT item, rn, ordinal, expected = 0 AS applied, (expected = 0)::BIGINT AS rev, CASE WHEN expected = 0 THEN [action_id] ELSE [] END AS ids FROM o WHERE rn = 1
  UNION ALL SELECT o.item, o.rn, o.ordinal, o.expected = r.rev AND NOT list_contains(r.ids, o.action_id), r.rev + (o.expected = r.rev AND NOT list_contains(r.ids, o.action_id))::BIGINT, CASE WHEN o.expected = r.rev AND NOT list_contains(r.ids, o.action_id) THEN list_append(r.ids, o.action_id) ELSE r.ids END FROM r JOIN o ON o.item = r.item AND o.rn = r.rn + 1),
done AS (SELECT o.*, r.rev FROM r JOIN o ON o.item = r.item AND o.rn = r.rn WHERE applied)"""


def correction_log(t):
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    kind = F.when(F.col("value") < 20, M.VERIFY).otherwise(M.CORRECT)
    value = F.when(F.col("value") >= 30, F.round("value").cast("long").cast("string")).otherwise("")
    actions = t.events.select(F.col("user_id").alias("item"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("field"), kind.alias("kind"), value.alias("value"), F.lit("op").alias("operator"), (F.floor(nth / 4) + F.when(nth < 8, nth % 2).otherwise(0)).cast("long").alias("expected"), F.concat_ws("-", F.col("user_id").cast("string"), F.floor(nth / 2).cast("string")).alias("action_id"))
    originals = t.events.select(F.col("user_id").alias("item"), F.col("event_type").alias("field")).distinct().withColumn("value", F.when(F.col("field") != "error", F.concat(F.lit("old "), "field")))
    return actions, originals


@query(f"""WITH RECURSIVE {ACTIONS} SELECT a.item, a.ordinal, a.field, CASE WHEN done.ordinal IS NOT NULL THEN 'applied' WHEN a.field = 'view' THEN 'invalid'
  WHEN EXISTS (FROM done d WHERE d.action_id = a.action_id AND d.ordinal < a.ordinal) THEN 'replayed' WHEN x.eff IS NULL THEN 'invalid' ELSE 'stale' END AS status, done.rev AS revision, done.eff AS effective FROM a LEFT JOIN x ON x.ordinal = a.ordinal LEFT JOIN done ON done.ordinal = a.ordinal""")
def d9_remediation(t):
    actions, originals = correction_log(t)
    return M.replay_actions(actions, originals, ["click", "purchase", "error", "signup"]).select("item", "ordinal", "field", "status", "revision", "effective")


@query(f"""WITH RECURSIVE {ACTIONS}, l AS (SELECT item, field, arg_max(eff, rev) AS v, max(rev) AS rev FROM done GROUP BY ALL), f AS (SELECT DISTINCT user_id AS item, event_type AS field FROM events),
e AS (SELECT f.item, f.field, coalesce(v, CASE WHEN f.field <> 'error' THEN 'old ' || f.field END) AS effective FROM f LEFT JOIN l ON l.item = f.item AND l.field = f.field)
SELECT item, concat_ws(',', CASE WHEN NOT coalesce(bool_or(field = 'error' AND effective IS NOT NULL), false) THEN 'error' END, CASE WHEN NOT coalesce(bool_or(field = 'purchase' AND effective IS NOT NULL), false) THEN 'purchase' END) AS missing FROM e GROUP BY item HAVING missing <> ''""")
def d9_open_issues(t):
    """Items that still miss a required value once all corrections are applied."""
    actions, originals = correction_log(t)
    effective = M.effective_values(M.replay_actions(actions, originals, ["click", "purchase", "error", "signup"]), originals)
    return M.open_issues(effective, ["error", "purchase"]).select("item", F.array_join("missing", ",").alias("missing"))


@query("""WITH s AS (SELECT unnest(['signup', 'view', 'click', 'purchase', 'error', 'refund']) AS stage, generate_subscripts(['signup', 'view', 'click', 'purchase', 'error', 'refund'], 1) AS place),
u AS (SELECT DISTINCT user_id FROM events), l AS (SELECT user_id, event_type, arg_max(least(greatest(value, 0), 300), event_id) AS v FROM events GROUP BY ALL)
SELECT u.user_id, place, stage, coalesce(v, 0.0) AS value, v IS NOT NULL AS ran FROM u JOIN s ON true LEFT JOIN l ON l.user_id = u.user_id AND l.event_type = stage""")
def d21_stage_trace(t):
    stages = ["signup", "view", "click", "purchase", "error", "refund"]
    padded = t.events.select("user_id").distinct().select("user_id", F.posexplode(F.array(*map(F.lit, stages))).alias("at", "stage"))
    last = t.events.groupBy("user_id", F.col("event_type").alias("stage")).agg(F.max_by(F.least(F.greatest("value", F.lit(0)), F.lit(300)), "event_id").alias("v"))
    return padded.join(last, ["user_id", "stage"], "left").select("user_id", (F.col("at") + 1).cast("long").alias("place"), "stage", F.coalesce("v", F.lit(0.0)).alias("value"), F.col("v").isNotNull().alias("ran"))


@query("SELECT event_id, (CASE WHEN event_type = 'error' THEN NULL ELSE event_type END) AS kind, CASE WHEN value < 50 THEN NULL ELSE value END AS value, (event_type = 'error' OR value < 50) AS withheld FROM events")
def d24_withheld_values(t):
    snapshot = F.struct(F.col("event_type").alias("kind"), F.col("value").alias("value"))
    wrong, low = F.col("event_type") == "error", F.col("value") < 50
    clean = snapshot.withField("kind", F.when(~wrong, F.col("event_type"))).withField("value", F.when(~low, F.col("value")))
    return t.events.select("event_id", clean.alias("s"), (wrong | low).alias("withheld")).select("event_id", "s.kind", "s.value", "withheld")


@query("""SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS INT) AS k, CASE WHEN TRY_CAST(json_extract(props, '$.k') AS INT) > 50 THEN event_type END AS corrected FROM events""")
def d6_model_json(t):
    bare = F.regexp_replace(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")), r"^```\w*\s*|\s*```$", "")
    parsed = F.from_json(bare, "k int", {"mode": "PERMISSIVE"})
    return t.events.select("event_id", parsed["k"].alias("k"), F.when(parsed["k"] > 50, F.col("event_type")).alias("corrected"))


@query("""WITH e AS (SELECT *, epoch_us(ts) AS us, max(epoch_us(ts)) FILTER (event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS claimed FROM events),
f AS (SELECT user_id, event_id, claimed, us, row_number() OVER (PARTITION BY user_id, claimed ORDER BY us, event_id) AS nth FROM e WHERE event_type <> 'click' AND claimed IS NOT NULL)
SELECT user_id, event_id, (us - claimed) / 1e6 AS seconds, CASE WHEN us - claimed <= 300000000 THEN 'committed' ELSE 'late' END AS outcome FROM f WHERE nth = 1""")
def x2_attempt_deadline(t):
    """Clicks claim, the first other event after the last claim finishes it: within 300 seconds it is committed, later it has lost its lease."""
    order = ["ts", "event_id"]
    before = Window.partitionBy("user_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    marked = t.events.withColumn("us", micros).withColumn("claimed", F.max(F.when(F.col("event_type") == "click", F.col("us"))).over(before))
    finishes = marked.where("event_type <> 'click' AND claimed IS NOT NULL").withColumn("nth", F.row_number().over(Window.partitionBy("user_id", "claimed").orderBy("us", "event_id"))).where("nth = 1")
    waited = F.col("us") - F.col("claimed")
    return finishes.select("user_id", "event_id", (waited / 1e6).alias("seconds"), F.when(waited <= 300_000_000, "committed").otherwise("late").alias("outcome"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def x4_status_by_day(t):
    return t.events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")
