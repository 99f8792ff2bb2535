"""Projects, documents, links, awards and ledgers: queries over orders, lineitem, customer, supplier and part."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import text as X
from ledgerloom.operators import enrichment as E
from ledgerloom.operators import latest as L
from ledgerloom.operators import tables as T
from ledgerloom.plans.registry import query

MONEY = "decimal(18,2)"
DOC_ID = "l_orderkey * 10 + l_linenumber"
TYPES = "CASE WHEN l_returnflag = 'R' THEN 'bid_notice' WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 'award_notice' WHEN l_linestatus = 'F' THEN 'contract' ELSE 'attachment' END"
#: Lines of an order may repeat a number; the sort keys below are total all the same.
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
LINE_SQL = ", ".join(LINE)


def links(t):
    """Project-document links: the project is the order, the document its line."""
    return t.lineitem.select(F.col("l_orderkey").alias("project_id"), F.expr(DOC_ID).alias("document_id"), F.expr(TYPES).alias("relation_type"), F.col("l_shipdate").alias("created"), *LINE)


LINKS_SQL = f"links AS (SELECT l_orderkey AS project_id, {DOC_ID} AS document_id, {TYPES} AS relation_type, l_shipdate AS created, {LINE_SQL} FROM lineitem)"


def search_projects(t, keyword):
    """Exact before prefix before contained, then the newest, with link counts; only the hits' links are counted."""
    word = X.search_text(F.lit(keyword))
    rank = lambda c: F.when(c == word, 0).when(F.startswith(c, word), 1).when(F.contains(c, word), 2)
    projects = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    scored = projects.withColumn("rank", F.least(rank(X.search_text(F.col("c_name"))), rank(X.search_text(F.col("o_orderpriority"))))).where("rank IS NOT NULL")
    counts = t.lineitem.join(scored.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    counted = scored.join(counts, "o_orderkey", "left").orderBy("rank", F.desc("o_orderdate"), "o_orderkey")
    return counted.select(F.col("o_orderkey").alias("project_id"), "c_name", "rank", F.coalesce("n", F.lit(0)).alias("n_links"))


@query("SELECT o_orderkey, coalesce(nullif(trim(CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE c_mktsegment END), ''), nullif(c_name, ''), o_orderpriority) AS label, coalesce(nullif(c_name, ''), '-') AS customer FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def p1_alias_projection(t):
    joined = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("o_orderkey", X.first_filled(F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("c_mktsegment")), F.col("c_name"), F.col("o_orderpriority")).alias("label"), X.first_filled(F.col("c_name"), F.lit("-")).alias("customer"))


@query("""WITH w AS (SELECT l_orderkey, s_name, min(l_linenumber * 1000000 + l_partkey) AS pos FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL), j AS (SELECT l_orderkey, string_agg(s_name, '; ' ORDER BY pos, s_name) AS winners FROM w GROUP BY l_orderkey)
SELECT o_orderkey, coalesce(winners, o_orderstatus) AS winner FROM orders LEFT JOIN j ON l_orderkey = o_orderkey""")
def p2_award_override(t):
    seen = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).groupBy("l_orderkey", "s_name").agg(F.min(F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("at"))
    joined = seen.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "s_name"))), lambda x: x["s_name"]), "; ").alias("winners"))
    return t.orders.join(joined, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.coalesce("winners", "o_orderstatus").alias("winner"))


@query("SELECT coalesce(c_custkey, o_custkey, s_suppkey) AS asset_id, c_name, n_orders, s_name FROM customer FULL JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey FULL JOIN supplier ON s_suppkey = coalesce(c_custkey, o_custkey)")
def j3_full_view(t):
    a = t.customer.select(F.col("c_custkey").alias("asset_id"), "c_name")
    b = t.orders.groupBy(F.col("o_custkey").alias("asset_id")).agg(F.count("*").alias("n_orders"))
    c = t.supplier.select(F.col("s_suppkey").alias("asset_id"), "s_name")
    return a.join(b, "asset_id", "full_outer").join(c, "asset_id", "full_outer")


@query("SELECT o_orderkey AS project_id, count(l_orderkey) AS n_documents, min(l_partkey) AS first_part FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1")
def j4_project_assets(t):
    returned = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(returned, "o_orderkey", "left_semi").join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy(F.col("o_orderkey").alias("project_id")).agg(F.count("l_orderkey").alias("n_documents"), F.min("l_partkey").alias("first_part"))


@query(f"WITH {LINKS_SQL}, f AS (SELECT * FROM links QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created, {LINE_SQL}) = 1) SELECT document_id, project_id, o_orderstatus FROM f JOIN orders ON o_orderkey = project_id")
def j22_first_link(t):
    first = L.one_per_key(links(t), ["document_id"], F.col("created"), *map(F.col, LINE))
    return first.join(t.orders, F.col("o_orderkey") == F.col("project_id")).select("document_id", "project_id", "o_orderstatus")


@query(f"WITH {LINKS_SQL} SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY relation_type, document_id, {LINE_SQL}) AS place, document_id, relation_type FROM links")
def j24_ordered_documents(t):
    return L.history(links(t), "project_id", ["document_id", "relation_type"], "relation_type", "document_id", *LINE).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {LINKS_SQL} SELECT project_id, document_id, row_number() OVER w AS place, date_diff('day', lag(created) OVER w, created) AS gap_days FROM links WINDOW w AS (PARTITION BY project_id ORDER BY created, {LINE_SQL})")
def w8_timeline(t):
    w = Window.partitionBy("project_id").orderBy("created", *LINE)
    return links(t).select("project_id", "document_id", F.row_number().over(w).alias("place"), F.date_diff("created", F.lag("created").over(w)).alias("gap_days"))


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def t2_newest_first(t):
    return t.orders.orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("SELECT p_brand, p_partkey, place FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) WHERE place <= 5")
def t6_top_k_per_group(t):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return t.part.select("p_brand", "p_partkey", F.row_number().over(w).alias("place")).where("place <= 5")


@query("SELECT o_orderkey AS project_id, o_orderstatus, coalesce(n, 0) AS n_links FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def a24_link_counts(t):
    counts = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return t.orders.join(counts, "o_orderkey", "left").select(F.col("o_orderkey").alias("project_id"), "o_orderstatus", F.coalesce("n", F.lit(0)).alias("n_links"))


@query(f"WITH {LINKS_SQL} SELECT document_id, coalesce(bool_or(o_orderstatus = 'F'), false) AS documented, count(*) AS n_links, any_value(project_id) AS project_id FROM links LEFT JOIN orders ON o_orderkey = project_id GROUP BY document_id")
def j26_inbox_view(t):
    joined = links(t).join(t.orders, F.col("o_orderkey") == F.col("project_id"), "left")
    return joined.groupBy("document_id").agg(F.coalesce(F.bool_or(F.col("o_orderstatus") == "F"), F.lit(False)).alias("documented"), F.count("*").alias("n_links"), F.any_value("project_id").alias("project_id"))


@query(f"WITH {LINKS_SQL}, f AS (SELECT document_id, min(project_id) AS project_id FROM links GROUP BY 1) SELECT p_partkey * 10 + 1 AS wanted, coalesce(f.project_id, o_orderkey) AS project_id, CASE WHEN f.project_id IS NOT NULL THEN 'link' WHEN o_orderkey IS NOT NULL THEN 'document' ELSE 'none' END AS found_by FROM part LEFT JOIN f ON f.document_id = p_partkey * 10 + 1 LEFT JOIN orders ON o_orderkey = p_partkey")
def j28_stored_probe(t):
    wanted = t.part.select("p_partkey", (F.col("p_partkey") * 10 + 1).alias("wanted"))
    first = links(t).groupBy(F.col("document_id").alias("wanted")).agg(F.min("project_id").alias("linked"))
    joined = wanted.join(first, "wanted", "left").join(t.orders.select(F.col("o_orderkey").alias("p_partkey"), F.col("o_orderkey").alias("own")), "p_partkey", "left")
    return joined.select("wanted", F.coalesce("linked", "own").alias("project_id"), F.when(F.col("linked").isNotNull(), "link").when(F.col("own").isNotNull(), "document").otherwise("none").alias("found_by"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN o_orderkey IS NULL THEN 'missing' WHEN l_shipdate < o_orderdate THEN 'early' END AS issue FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL OR l_shipdate < o_orderdate")
def j21_provenance_check(t):
    joined = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    issue = F.when(F.col("o_orderkey").isNull(), "missing").when(F.col("l_shipdate") < F.col("o_orderdate"), "early")
    return joined.withColumn("issue", issue).where("issue IS NOT NULL").select("l_orderkey", "l_linenumber", "l_partkey", "issue")


@query("SELECT o_orderkey, o_orderpriority, count(*) OVER (PARTITION BY o_orderdate, o_orderpriority) AS run_size, row_number() OVER (PARTITION BY o_orderdate, o_orderpriority ORDER BY o_orderkey) AS row_index FROM orders")
def j25_audit_row_index(t):
    run = Window.partitionBy("o_orderdate", "o_orderpriority")
    return t.orders.select("o_orderkey", "o_orderpriority", F.count("*").over(run).alias("run_size"), F.row_number().over(run.orderBy("o_orderkey")).alias("row_index"))


@query("""WITH x AS (SELECT o_custkey AS k, o_orderkey AS ordinal, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE o_orderpriority END AS prio, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status, 'n' || o_orderkey % 2 AS note FROM orders),
n AS (SELECT k, string_agg(note, '; ' ORDER BY pos) AS note FROM (SELECT k, note, min(ordinal) AS pos FROM x GROUP BY ALL) GROUP BY k)
SELECT x.k, arg_min(prio, ordinal) FILTER (trim(prio) <> '') AS prio, arg_min(status, ordinal) FILTER (status IS NOT NULL) AS status, any_value(n.note) AS note FROM x JOIN n ON n.k = x.k GROUP BY x.k""")
def a8_input_merge(t):
    rows = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ordinal"), F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_orderpriority")).alias("prio"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), F.concat(F.lit("n"), (F.col("o_orderkey") % 2).cast("string")).alias("note"))
    return L.merge_fields(rows, "k", "ordinal", ["prio", "status"], "note")


def ledger_match(t):
    """Explicit row first, then key, else a new row."""
    incoming = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).alias("row_id"), F.col("o_custkey").alias("cust"))
    ledger = t.customer.where("c_custkey % 2 = 0")
    joined = incoming.join(ledger.select(F.col("c_custkey").alias("row_id"), F.col("c_custkey").alias("by_row")), "row_id", "left").join(ledger.select(F.col("c_custkey").alias("cust"), F.col("c_custkey").alias("by_key")), "cust", "left")
    return joined.select("id", F.when(F.col("by_row").isNotNull(), "row").when(F.col("by_key").isNotNull(), "key").otherwise("insert").alias("method"), F.coalesce("by_row", "by_key").alias("target"))


@query("SELECT o_orderkey AS id FROM orders UNION SELECT c_custkey FROM customer")
def s9_append_unique(t):
    merged, _ = T.append_unique(t.orders.select(F.col("o_orderkey").alias("id")), t.customer.select(F.col("c_custkey").alias("id")), "id", "id")
    return merged


@query("SELECT (SELECT count(*) FROM lineitem) AS n_rows, true AS unchanged")
def s11_fingerprint(t):
    again = t.lineitem.repartition("l_partkey")
    return T.fingerprint(t.lineitem).alias("a").join(T.fingerprint(again).alias("b"), "n_rows").select("n_rows", (F.col("a.checksum") == F.col("b.checksum")).alias("unchanged"))


@query("SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS n_invalid, count(*) FILTER (toxic = 1 AND quality = 1) AS n_conflict, count(*) FILTER (toxic = 1) = 0 AS may_write FROM labels")
def s12_quality_gate(t):
    status = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "invalid").when(F.col("toxic") == 1, "conflict").otherwise("ok")
    return T.quality_gate(t.labels.withColumn("status", status), "status", ["invalid", "conflict"])


@query("SELECT n_nationkey, n_name, coalesce(CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey END, 999) AS priority FROM nation WHERE coalesce(CASE WHEN n_nationkey % 5 = 0 THEN false WHEN n_nationkey % 5 = 1 THEN true END, true)")
def s7_rule_table(t):
    raw = t.nation.select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey")).alias("priority"), F.when(F.col("n_nationkey") % 5 == 0, False).when(F.col("n_nationkey") % 5 == 1, True).alias("enabled"))
    return rule_table(raw)


def rule_table(rules):
    """Enabled rules (the default) by priority (999 by default)."""
    return rules.where(F.coalesce("enabled", F.lit(True))).withColumn("priority", F.coalesce("priority", F.lit(999))).drop("enabled").orderBy("priority", "n_nationkey")


@query("SELECT l_orderkey, count(*) AS n, count(*) > 1 AS multi FROM lineitem GROUP BY l_orderkey")
def a12_groups(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), (F.count("*") > 1).alias("multi"))


@query("SELECT count(*) AS projects, count(*) FILTER (n > 1) AS multi_groups, max(n) AS largest FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def a12_workbook_summary(t):
    return a12_groups(t).agg(F.count("*").alias("projects"), F.count_if("multi").alias("multi_groups"), F.max("n").alias("largest"))


@query(f"""SELECT l_orderkey, count(*) AS n_documents, strftime(arg_min(l_shipdate, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey) FILTER (l_returnflag = 'R'), '%Y-%m-%d') AS bid_date, strftime(min(l_shipdate) FILTER (l_returnflag = 'A'), '%Y-%m-%d') AS award_date FROM lineitem GROUP BY l_orderkey""")
def a14_project_rollup(t):
    place = F.col("l_linenumber") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    bid = F.col("l_returnflag") == "R"
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n_documents"), F.date_format(F.min_by(F.when(bid, F.col("l_shipdate")), F.when(bid, place)), "yyyy-MM-dd").alias("bid_date"), F.date_format(F.min(F.when(F.col("l_returnflag") == "A", F.col("l_shipdate"))), "yyyy-MM-dd").alias("award_date"))


@query("SELECT o_custkey, count(DISTINCT o_orderkey) AS records, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY o_custkey")
def a15_accumulation(t):
    return t.orders.dropDuplicates(["o_orderkey"]).groupBy("o_custkey").agg(F.count("*").alias("records"), F.count_distinct("o_orderpriority").alias("kinds"))


@query("""WITH f AS (SELECT o_custkey, 'status' AS field, o_orderstatus AS value, least(0.99, 0.55 + (CASE WHEN o_orderkey % 2 = 0 THEN 0.15 ELSE 0 END) + (CASE WHEN o_orderkey % 3 = 0 THEN 0.10 ELSE 0 END)) AS confidence FROM orders
UNION ALL SELECT o_custkey, 'priority', o_orderpriority, least(0.99, 0.55 + (CASE WHEN o_orderkey % 5 = 0 THEN 0.30 ELSE 0 END)) FROM orders)
SELECT o_custkey, field, count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence < 0.8) AS low FROM f GROUP BY ALL""")
def a19_field_supplements(t):
    when = lambda m, w: F.when(F.col("o_orderkey") % m == 0, F.lit(w)).otherwise(F.lit(0.0))
    rows = t.orders.select("o_custkey", F.inline(F.array(F.struct(F.lit("status").alias("field"), F.least(F.lit(0.99), 0.55 + when(2, 0.15) + when(3, 0.10)).alias("confidence")), F.struct(F.lit("priority").alias("field"), F.least(F.lit(0.99), 0.55 + when(5, 0.30)).alias("confidence")))))
    return rows.groupBy("o_custkey", "field").agg(F.count_if(F.col("confidence") >= 0.8).alias("high"), F.count_if(F.col("confidence") < 0.8).alias("low"))


@query("SELECT o_custkey, max(CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END) AS priority, max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END) AS status FROM orders GROUP BY o_custkey")
def d17_enrichment_records(t):
    rows = t.orders.select("o_custkey", F.inline(F.array(F.struct(F.lit("priority").alias("field"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")).alias("value")), F.struct(F.lit("status").alias("field"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("value")))))
    return rows.groupBy("o_custkey").pivot("field", ["priority", "status"]).agg(F.max("value"))


@query(f"SELECT {LINE_SQL}, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_SQL}) AS place, count(*) OVER (PARTITION BY l_orderkey) AS size FROM lineitem")
def w5_group_position(t):
    w = Window.partitionBy("l_orderkey")
    return t.lineitem.select(*LINE, F.row_number().over(w.orderBy(*LINE)).alias("place"), F.count("*").over(w).alias("size"))


@query("SELECT c_name AS name, 'customer' AS source FROM customer UNION ALL SELECT s_name, 'supplier' FROM supplier UNION ALL SELECT p_name, 'part' FROM part")
def u1_tagged_union(t):
    return T.union_tagged(customer=t.customer.select(F.col("c_name").alias("name")), supplier=t.supplier.select(F.col("s_name").alias("name")), part=t.part.select(F.col("p_name").alias("name")))


@query("SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def u2_difference(t):
    return T.difference(t.customer.select(F.col("c_custkey").alias("id")), t.orders.select(F.col("o_custkey").alias("id")), "id")


@query("SELECT n_nationkey AS id FROM nation INTERSECT SELECT r_regionkey FROM region")
def u3_overlap(t):
    return T.overlap(t.nation.select(F.col("n_nationkey").alias("id")), t.region.select(F.col("r_regionkey").alias("id")))


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, c_mktsegment) AS label, CASE WHEN o_orderkey % 2 <> 0 AND c_mktsegment IS NOT NULL THEN 'label' ELSE '' END AS filled FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def u8_fill_blanks(t):
    target = t.orders.select("o_orderkey", F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("label"))
    source = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("label"))
    return T.fill_blanks(target, source, "k", ["label"]).select("o_orderkey", "label", F.array_join("filled", ",").alias("filled"))


@query("SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS old, CASE o_orderpriority WHEN '1-URGENT' THEN 'F' WHEN '5-LOW' THEN 'O' END AS new FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus <> CASE o_orderpriority WHEN '1-URGENT' THEN 'F' ELSE 'O' END")
def d10_targeted_correction(t):
    """Every order has a status that is right for its priority; those of other priorities keep theirs."""
    priority = F.col("o_orderpriority")
    changes = t.orders.select("o_orderkey", F.when(priority == "1-URGENT", "F").when(priority == "5-LOW", "O").otherwise(F.col("o_orderstatus")).alias("new"))
    return T.patch(t.orders, changes, "o_orderkey", "o_orderstatus")[1]


@query("SELECT o_orderkey, o_orderstatus AS old, 'F' AS new FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F'")
def d23_nested_overlay(t):
    nested = t.orders.select("o_orderkey", "o_orderpriority", F.struct(F.struct(F.col("o_orderstatus").alias("status")).alias("fields")).alias("trace"))
    target = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("F")).otherwise(F.col("trace.fields.status"))
    fixed = nested.withColumn("after", F.col("trace").withField("fields.status", target))
    return fixed.where("trace.fields.status <> after.fields.status").select("o_orderkey", F.col("trace.fields.status").alias("old"), F.col("after.fields.status").alias("new"))


@query("""WITH old AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS flag FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY ALL), new AS (SELECT l_orderkey, l_linenumber, max(l_linestatus) AS status FROM lineitem WHERE l_orderkey % 3 <> 1 GROUP BY ALL)
SELECT coalesce(old.l_orderkey, new.l_orderkey) AS l_orderkey, coalesce(old.l_linenumber, new.l_linenumber) AS l_linenumber, CASE WHEN new.status IS NULL THEN 'kept' WHEN old.flag IS NULL THEN 'added' WHEN old.flag = 'R' THEN 'retried' ELSE 'completed' END AS action
FROM old FULL JOIN new ON old.l_orderkey = new.l_orderkey AND old.l_linenumber = new.l_linenumber""")
def d12_row_upsert(t):
    key = ["l_orderkey", "l_linenumber"]
    old = t.lineitem.where("l_orderkey % 3 <> 0").groupBy(*key).agg(F.max("l_returnflag").alias("flag"))
    new = t.lineitem.where("l_orderkey % 3 <> 1").groupBy(*key).agg(F.max("l_linestatus").alias("status"))
    action = F.when(F.col("status").isNull(), "kept").when(F.col("flag").isNull(), "added").when(F.col("flag") == "R", "retried").otherwise("completed")
    return old.join(new, key, "full_outer").select(*key, action.alias("action"))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN s_name IS NOT NULL AND l_extendedprice > 20000 THEN s_name ELSE '' END AS winner, CASE WHEN s_name IS NOT NULL AND l_extendedprice > 20000 THEN CAST(CAST(l_extendedprice AS {MONEY}) AS VARCHAR) ELSE '' END AS amount FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey < 20""")
def p17_award_pairs(t):
    known = t.supplier.where("s_nationkey < 20").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    joined = t.lineitem.join(known, "l_suppkey", "left")
    amount = F.when(F.col("l_extendedprice") > 20000, F.col("l_extendedprice").cast(MONEY).cast("string"))
    pair = F.col("s_name").isNotNull() & amount.rlike(r"\d")
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", F.when(pair, F.col("s_name")).otherwise("").alias("winner"), F.when(pair, amount).otherwise("").alias("amount"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_extendedprice AS {MONEY}) / 10000 AS DECIMAL(20,6)) AS amount, CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' ELSE 'none' END AS label FROM lineitem")
def p21_display(t):
    label = F.create_map(F.lit("R"), F.lit("returned"), F.lit("A"), F.lit("accepted"))[F.col("l_returnflag")]
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice").cast(MONEY) / 10000).cast("decimal(20,6)").alias("amount"), F.coalesce(label, F.lit("none")).alias("label"))


@query("SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END, ''), c_name) AS name, concat_ws(' | ', o_orderstatus, c_mktsegment) AS note FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def p25_output_record(t):
    joined = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("o_orderkey", X.first_filled(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(""), F.col("c_name")).alias("name"), F.concat_ws(" | ", "o_orderstatus", "c_mktsegment").alias("note"))


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem WHERE l_extendedprice > 30000 AND l_suppkey % 7 <> 0)
SELECT l_orderkey, 'award_' || sha256(l_orderkey || chr(10) || l_linenumber || chr(10) || l_partkey || chr(10) || l_suppkey)[1:16] AS award_id, l_suppkey AS winner FROM p""")
def d7_packages_to_awards(t):
    """Orders hold their lines as packages; packages with a valid winner and amount become awards."""
    package = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    orders = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(package).alias("packages"))  # an order has few lines
    flat = orders.select("l_orderkey", F.inline("packages")).where("l_extendedprice > 30000 AND l_suppkey % 7 <> 0")
    return flat.select("l_orderkey", X.stable_id("award_", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")).alias("award_id"), F.col("l_suppkey").alias("winner"))


_FOLD = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', '', 'g')"
_TOKENS = rf"list_filter(list_transform(regexp_split_to_array(name, '[\s\p{{P}}+<>]+'), lambda w: {_FOLD.format('w')}), lambda k: len(k) >= 5 AND NOT regexp_full_match(k, '\d+'))[:8]"


def _about(text: str, name: str, words: str, customer: str) -> str:
    """SQL: whether a folded text is about a folded name with these words and this folded customer."""
    hits = f"len(list_filter({words}, lambda k: contains({text}, k)))"
    return f"""((len({name}) >= 16 AND contains({text}, left({name}, 16))) OR ({hits} > 0 AND {hits} >= least(2, len({words}))) OR (len({customer}) >= 6 AND contains({text}, {customer}) AND contains({text}, left({name}, 12))))"""


#: Suppliers' projects ask; parts of some types are results, whose brand won for their price.
ENRICH_SQL = rf"""r AS (SELECT s_suppkey AS id, s_suppkey AS ordinal, CASE s_suppkey % 3 WHEN 0 THEN p_name || ' lot ' || p_size WHEN 1 THEN 'supply of ' || p_name ELSE p_brand END AS name, p_brand AS customer, '' AS text, 'notice' AS doc_type, CASE WHEN s_nationkey = 3 THEN s_name END AS winner, NULL::DOUBLE AS amount FROM supplier JOIN part ON p_partkey = s_suppkey
UNION ALL SELECT 1000000000 + p_partkey, 1000000000 + p_partkey, p_name, p_brand, p_type || ' ' || p_size, CASE WHEN p_type IN ('PROMO', 'LARGE') THEN 'result' ELSE 'notice' END, CASE WHEN p_size > 10 THEN p_brand END, CASE WHEN p_size % 3 > 0 THEN p_retailprice END FROM part),
k AS (SELECT *, {_FOLD.format("concat_ws(' ', name, customer, text)")} AS whole, {_FOLD.format('name')} AS own, {_FOLD.format('customer')} AS owner, {_TOKENS} AS found FROM r),
w AS (SELECT * EXCLUDE (found), CASE WHEN len(found) > 0 THEN found WHEN len(own) >= 16 THEN [left(own, 16)] ELSE [] END AS words FROM k),
d AS (SELECT * FROM w WHERE doc_type = 'result' AND (winner IS NOT NULL OR amount IS NOT NULL)),
z AS (SELECT DISTINCT whole, own, words FROM d), y AS (SELECT DISTINCT own, owner, words FROM w WHERE winner IS NULL OR amount IS NULL),
met AS (SELECT y.own, y.owner, y.words, z.whole, z.own AS other FROM y, z WHERE {_about('z.whole', 'y.own', 'y.words', 'y.owner')} OR {_about('y.own', 'z.own', 'z.words', "''")}),
g AS (SELECT w.id, arg_min(d.id, d.ordinal) AS donor FROM w JOIN met ON met.own = w.own AND met.owner = w.owner JOIN d ON d.whole = met.whole AND d.own = met.other AND d.id <> w.id WHERE w.winner IS NULL OR w.amount IS NULL GROUP BY w.id)"""


def enrichable(t):
    key, name = F.col("s_suppkey"), F.col("p_name")
    named = F.when(key % 3 == 0, F.concat_ws(" ", name, F.lit("lot"), F.col("p_size").cast("string"))).when(key % 3 == 1, F.concat(F.lit("supply of "), name)).otherwise(F.col("p_brand"))
    asking = t.supplier.join(t.part, F.col("p_partkey") == key).select(key.alias("record_id"), named.alias("name"), F.col("p_brand").alias("customer"), F.lit("").alias("text"), F.lit("notice").alias("doc_type"), F.when(F.col("s_nationkey") == 3, F.col("s_name")).alias("winner"), F.lit(None).cast("double").alias("amount"))
    kind = F.when(F.col("p_type").isin("PROMO", "LARGE"), "result").otherwise("notice")
    parts = t.part.select((F.col("p_partkey") + 1_000_000_000).alias("record_id"), name.alias("name"), F.col("p_brand").alias("customer"), F.concat_ws(" ", "p_type", F.col("p_size").cast("string")).alias("text"), kind.alias("doc_type"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("winner"), F.when(F.col("p_size") % 3 > 0, F.col("p_retailprice").cast("double")).alias("amount"))
    return asking.unionByName(parts).withColumn("ordinal", F.col("record_id"))


@query(f"WITH {ENRICH_SQL} SELECT w.id AS record_id, g.donor AS donor_id, coalesce(w.winner, d.winner) AS winner, coalesce(w.amount, d.amount) AS amount, CASE WHEN g.donor IS NOT NULL THEN 'local' END AS method FROM w LEFT JOIN g ON g.id = w.id LEFT JOIN d ON d.id = g.donor")
def j16_self_enrichment(t):
    return E.enrich_from_results(enrichable(t), ["result"])
