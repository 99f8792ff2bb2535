"""Keys and values found in texts, evidence of documents, and resolution of records, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import text as X
from ledgerloom.operators import candidates as C
from ledgerloom.operators import evidence as E
from ledgerloom.operators import latest as L
from ledgerloom.operators import resolution as S
from ledgerloom.operators import review as V
from ledgerloom.operators import tables as T
from ledgerloom.plans.registry import query
from ledgerloom.plans.text_queries import HOST, IDENTITY, LINES, PAGE, document_lines

# --- keys and values -------------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, regexp_replace(lower(text), '[\s\p{P}]+', '', 'g') AS key FROM documents")
def f3_business_key(t):
    return t.documents.select("doc_id", X.business_key(F.col("text")).alias("key"))


@query(r"""WITH n AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '[' || p_brand || '] ' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN '(' || p_type || ')' ELSE '' END || p_name || CASE WHEN p_size % 5 < 2 THEN ' phase two' ELSE '' END || CASE WHEN p_size % 7 < 3 THEN ' final' ELSE '' END AS name FROM part)
SELECT p_partkey, regexp_replace(regexp_replace(name, '^(?:\s*(?:\([^)]*\)|\[[^\]]*\]))+\s*', ''), '(?:\s*(?:phase two|final))+\s*$', '') AS core FROM n""")
def f4_core_name(t):
    part = lambda m, least, text: F.when(F.col("p_size") % m < least, text).otherwise("")
    name = F.concat(part(2, 1, F.concat(F.lit("["), "p_brand", F.lit("] "))), part(3, 1, F.concat(F.lit("("), "p_type", F.lit(")"))), "p_name", part(5, 2, F.lit(" phase two")), part(7, 3, F.lit(" final")))
    return t.part.select("p_partkey", X.core_name(name, ["phase two", "final"]).alias("core"))


@query(r"""WITH f AS (SELECT page_id, list_distinct(list_filter(regexp_extract_all(upper(url), '[A-Z0-9]+(?:-[A-Z0-9]+)+'), lambda x: length(x) >= 5 AND regexp_matches(x, '[0-9]') AND NOT regexp_full_match(x, '(?:19|20)\d\d(?:-(?:19|20)\d\d)?'))) AS ids
FROM (SELECT page_id, regexp_replace(url, '[/=]', '-', 'g') AS url FROM pages)) SELECT page_id, array_to_string(list_sort(ids), ',') AS ids FROM f""")
def f6_identifiers(t):
    return t.pages.select("page_id", F.array_join(X.identifiers(F.regexp_replace("url", "[/=]", "-")), ",").alias("ids"))


@query("""SELECT doc_id, nullif(regexp_extract(text, 'Version ([0-9.]*[0-9])', 1), '') AS version, coalesce(nullif(regexp_extract(text, 'token = "([0-9a-f]+)"', 1), ''), nullif(regexp_extract(text, 'under the ([A-Z]+) License', 1), '')) AS mark FROM documents""")
def f7_labelled_identifiers(t):
    text = F.col("text")
    return t.documents.select("doc_id", X.first_match(text, [r"Version ([0-9.]*[0-9])"]).alias("version"), X.first_match(text, ['token = "([0-9a-f]+)"', "under the ([A-Z]+) License"]).alias("mark"))


@query(r"SELECT doc_id, coalesce(nullif(regexp_extract(text, 'de[^0-9]{0,120}([0-9]+(?:\.[0-9]+)?)', 1), ''), nullif(regexp_extract(text, '([0-9]+(?:\.[0-9]+)?)', 1), '')) AS money FROM documents")
def f9_money_near_label(t):
    return t.documents.select("doc_id", X.first_match(F.col("text"), [r"de[^0-9]{0,120}([0-9]+(?:\.[0-9]+)?)", r"([0-9]+(?:\.[0-9]+)?)"]).alias("money"))


KINDS = [(r"License, ([^\n]+)", 300), (r"(?:^|[.\n] ?)The ([^.\n]{10,})", 200), (r"(?:^|[.\n] ?)(?:Die|La|El) ([^.\n]{10,})", 100), (r"(?:^|[.\n] ?)(?:And|De|Und) ([^\n]{10,})", 100)]
KINDS_SQL = " UNION ALL ".join(f"SELECT doc_id, text, {s} AS score, unnest(regexp_extract_all(text, '{p}', 0)) AS whole, unnest(regexp_extract_all(text, '{p}', 1)) AS value FROM documents" for p, s in KINDS)


CONTENT_SQL = rf"""WITH f AS (SELECT doc_id, score, instr(text, whole) AS place, regexp_replace(regexp_replace(value, '[ \t]+', ' ', 'g'), '^[ :;,.]+|[ :;,.]+$', '', 'g') AS value FROM ({KINDS_SQL}))
SELECT d.doc_id, left(f.value, 2000) AS value FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id AND length(value) >= 10 QUALIFY row_number() OVER (PARTITION BY d.doc_id ORDER BY f.score DESC, length(value) DESC, place, value DESC) = 1"""


@query(CONTENT_SQL)
def f10_long_content(t):
    return t.documents.select("doc_id", X.best_of_kinds(F.col("text"), KINDS).alias("value"))


@query("SELECT o_orderkey, strftime(try_cast(year(o_orderdate) || '-' || lpad((o_orderkey % 14)::VARCHAR, 2, '0') || '-' || lpad((o_orderkey % 33)::VARCHAR, 2, '0') AS DATE), '%Y-%m-%d') AS day FROM orders")
def f13_date_of(t):
    """Months up to 13 and days up to 32: not every text names a day."""
    sign = F.element_at(F.array(F.lit("-"), F.lit("/"), F.lit(".")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    number = lambda m: (F.col("o_orderkey") % m).cast("string")
    text = F.concat(F.lit("on "), F.year("o_orderdate").cast("string"), sign, number(14), sign, number(33), F.lit(" at noon"))
    return t.orders.select("o_orderkey", F.date_format(X.date_of(text), "yyyy-MM-dd").alias("day"))


@query("""WITH v AS (SELECT doc_id, source || '#' || doc_id AS record_key, 1 AS version FROM documents UNION ALL SELECT doc_id, 'label#' || quality || toxic, 2 FROM labels)
SELECT doc_id, record_key, version FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY version DESC, record_key) = 1""")
def u9_document_store(t):
    """Stored documents, and labels that arrive later under the same ids or new ones."""
    stored = t.documents.select("doc_id", F.concat_ws("#", "source", F.col("doc_id").cast("string")).alias("record_key"), F.lit(1).alias("version"))
    later = t.labels.select("doc_id", F.concat(F.lit("label#"), F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("record_key"), F.lit(2).alias("version"))
    return L.one_per_key(stored.unionByName(later), ["doc_id"], F.desc("version"), F.col("record_key"))


# --- items and candidates --------------------------------------------------------------------------------------------------

ITEMS = f"SELECT page_id, {IDENTITY} AS source_key, contains(html, 'lang=\"en\"') AS completed, contains(url, 'utm_') AS duplicate, contains(url, '#') AS hidden, regexp_extract(url, '/([0-9]+)', 1) AS created_time FROM pages"


@query(f"SELECT source_key, page_id, completed, duplicate, hidden FROM ({ITEMS}) WHERE source_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY completed DESC, duplicate, hidden, created_time, page_id) = 1")
def w7_preferred_item(t):
    has = lambda column, part: F.contains(F.col(column), F.lit(part))
    items = t.pages.select("page_id", X.url_identity(F.col("url")).alias("source_key"), has("html", 'lang="en"').alias("completed"), has("url", "utm_").alias("duplicate"), has("url", "#").alias("hidden"), F.regexp_extract("url", "/([0-9]+)", 1).alias("created_time"), F.col("page_id").alias("ordinal"))
    return L.preferred_item(items, "source_key").select("source_key", "page_id", "completed", "duplicate", "hidden")


@query(r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS value, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2), 1) - 1 AS ordinal FROM pages),
c AS (SELECT page_id AS record_id, lower(left(value, 1)) AS field, value, url, ordinal, CASE WHEN length(value) >= 8 THEN 0 WHEN length(value) >= 4 THEN 1 WHEN length(value) >= 3 THEN 2 ELSE 9 END AS confidence_rank, (value = lower(value))::INT + regexp_matches(value, '[,.]$')::INT AS n_flags FROM a)
SELECT record_id, field, value, url, confidence_rank, n_flags FROM c QUALIFY row_number() OVER (PARTITION BY record_id, field, regexp_replace(lower(value), '[^\p{L}\p{N}_]+', '', 'g'), url ORDER BY ordinal) = 1""")
def t5_candidate_order(t):
    pattern = F.lit('<a href="([^"]*)">([^<]*)</a>')
    pairs = F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("url"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("value"))
    links = t.pages.select("page_id", F.posexplode(pairs).alias("ordinal", "pair")).select(F.col("page_id").alias("record_id"), "ordinal", "pair.url", "pair.value")
    size = F.length("value")
    confidence = F.when(size >= 8, "high").when(size >= 4, "medium").when(size >= 3, "low").otherwise("none")
    flags = F.array_compact(F.array(F.when(F.col("value") == F.lower("value"), "lower case"), F.when(F.col("value").rlike("[,.]$"), "cut")))
    found = links.select("*", F.lower(F.left("value", F.lit(1))).alias("field"), confidence.alias("confidence"), flags.alias("flags"))
    return C.ordered_candidates(found).select("record_id", "field", "value", "url", "confidence_rank", "n_flags")


KEY = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', '', 'g')".format


@query(rf"""WITH n AS (SELECT page_id, {PAGE} AS body, CASE WHEN page_id % 3 = 0 THEN regexp_extract(html, '<title>([^<]*)</title>', 1) ELSE regexp_extract(text, '^([^.\n]*)', 1) END AS name FROM pages JOIN documents ON doc_id = page_id),
k AS (SELECT page_id, {KEY('body')} AS whole, {KEY('name')} AS key, list_filter(list_transform(regexp_split_to_array(name, '[\s()\[\],._\-]+'), lambda w: {KEY('w')}), lambda w: length(w) >= 5)[1:8] AS words FROM n),
h AS (SELECT *, len(list_filter(words, lambda w: contains(whole, w))) AS hits FROM k)
SELECT page_id, CASE WHEN length(key) >= 12 AND contains(whole, left(key, 18)) THEN 'strong' WHEN hits >= 2 THEN 'medium' WHEN hits = 1 THEN 'weak' ELSE 'none' END AS strength FROM h""")
def j17_match_strength(t):
    """Each page against the record it was found for: its own title, or a document's opening words."""
    pairs = t.pages.join(t.documents.select(F.col("doc_id").alias("page_id"), "text"), "page_id")
    name = F.when(F.col("page_id") % 3 == 0, F.regexp_extract("html", "<title>([^<]*)</title>", 1)).otherwise(F.regexp_extract("text", r"^([^.\n]*)", 1))
    return pairs.select("page_id", X.match_strength(X.page_text(F.col("html")), name).alias("strength"))


# --- evidence of documents -------------------------------------------------------------------------------------------------

CATEGORIES = ("the", "of", "and")


@query(f"""WITH RECURSIVE {LINES}, s AS (SELECT doc_id, place, strlen(line) AS size, length(line) <= 120 AS head, len(string_split(line, ',')) > 2 AS concrete, length(line) <= 20 AS major FROM l),
n AS (SELECT a.doc_id, a.place, b.place - a.place AS k, b.size, b.concrete, b.major FROM s a JOIN s b ON b.doc_id = a.doc_id AND b.place BETWEEN a.place + 1 AND a.place + 15 WHERE a.head),
g AS (SELECT doc_id, place, min(k) FILTER (concrete AND NOT major AND k <= 12) AS goal, min(k) FILTER (major AND k <= 12) AS stop FROM n GROUP BY ALL),
h AS (SELECT s.doc_id, s.place, s.size, CASE WHEN stop IS NULL OR goal < stop THEN goal END AS goal FROM s LEFT JOIN g ON g.doc_id = s.doc_id AND g.place = s.place),
r AS (SELECT doc_id, place, goal, 0::BIGINT AS k, size AS used, [place] AS places, true AS fitted FROM h WHERE goal IS NOT NULL
 UNION ALL SELECT r.doc_id, r.place, r.goal, n.k, CASE WHEN ok THEN r.used + n.size ELSE r.used END, CASE WHEN ok THEN list_append(r.places, r.place + n.k) ELSE r.places END, ok
 FROM r JOIN n ON n.doc_id = r.doc_id AND n.place = r.place AND n.k = r.k + 1, LATERAL (SELECT r.used + n.size <= 4096 AND (n.k <= r.goal OR NOT n.major) AS ok) WHERE r.k < r.goal + 3 AND (r.k < r.goal OR r.fitted)),
e AS (SELECT doc_id, place, arg_max(places, k) AS places, bool_or(k = goal AND NOT fitted) AS failed FROM r GROUP BY ALL)
SELECT h.doc_id, h.place, array_to_string(CASE WHEN h.goal IS NULL THEN [h.place] WHEN failed AND h.size + n.size <= 4096 THEN [h.place, h.place + h.goal] WHEN failed THEN [h.place] ELSE places END, ',') AS related
FROM h LEFT JOIN e ON e.doc_id = h.doc_id AND e.place = h.place LEFT JOIN n ON n.doc_id = h.doc_id AND n.place = h.place AND n.k = h.goal""")
def w13_context_window(t):
    size = F.length("line")
    sections = document_lines(t).select("doc_id", F.col("place").cast("long").alias("place"), F.octet_length("line").alias("size"), (size <= 120).alias("head"), (F.size(F.split("line", ",")) > 2).alias("concrete"), (size <= 20).alias("major"))
    return E.context_windows(sections).select("doc_id", "place", F.array_join(F.col("related").cast("array<string>"), ",").alias("related"))


def _picked(limit: str, condition: str, category: str, more: str) -> str:
    return f"""list_sort(list_transform(list_filter(a.items, lambda x: NOT list_contains(r.places, x.place) AND r.used + x.size <= {limit} AND {condition}),
  lambda x: {{'weakly': NOT list_contains(x.strong, {category}), 'more': {more}, 'rank': x.rank, 'place': x.place, 'size': x.size, 'strong': x.strong}}))[1]"""


_OPEN = "NOT list_contains(r.covered, {0}) AND (list_contains(x.strong, {0}) OR list_contains(x.weak, {0}))".format
_MORE = "-len(list_filter(x.strong, lambda y: NOT list_contains(r.covered, y)))"
_TIMES = "len(list_filter(string_split(line, ' '), lambda w: w = c))"


@query(f"""WITH RECURSIVE {LINES}, s AS (SELECT doc_id, place, strlen(line) AS size, len(string_split(line, ',')) > 3 AS tabular, len(string_split(line, '.')) - 2 AS anchors, max(place) OVER (PARTITION BY doc_id) AS last,
  list_filter({list(CATEGORIES)}, lambda c: {_TIMES} >= 2) AS strong, list_filter({list(CATEGORIES)}, lambda c: {_TIMES} = 1) AS weak FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN tabular OR anchors > 0 THEN 0 WHEN place = 0 OR place = last THEN 1 ELSE 2 END, tabular DESC, anchors DESC, place) AS rank FROM s),
a AS (SELECT doc_id, count(*) AS n, list({{'rank': rank, 'place': place, 'size': size, 'strong': strong, 'weak': weak}} ORDER BY rank) AS items, list_filter({list(CATEGORIES)}, lambda c: list_contains(flatten(list(strong)), c)) AS borne FROM k GROUP BY doc_id),
r AS (SELECT doc_id, 0::BIGINT AS step, 0::BIGINT AS used, []::BIGINT[] AS places, []::VARCHAR[] AS covered, false AS rescued FROM a
 UNION ALL SELECT doc_id, step + 1, used + coalesce(p.size, 0), CASE WHEN p IS NULL THEN places ELSE list_append(places, p.place) END, CASE WHEN p IS NULL THEN covered ELSE list_concat(covered, p.strong) END, rescued OR (p IS NOT NULL AND step >= n + 4)
 FROM (SELECT r.*, a.n, CASE WHEN step = 0 THEN {_picked('600', 'x.place = 0', "''", '0')} WHEN step <= 3 THEN {_picked('600', _OPEN(f'{list(CATEGORIES)}[step]'), f'{list(CATEGORIES)}[step]', _MORE)}
  WHEN step <= n + 3 THEN {_picked('600', 'x.rank = step - 3', "''", '0')} ELSE {_picked('900', f'NOT list_contains(r.covered, {list(CATEGORIES)}[step - n - 3]) AND list_contains(x.strong, {list(CATEGORIES)}[step - n - 3])', "''", '0')} END AS p FROM r JOIN a ON a.doc_id = r.doc_id WHERE step < n + 7))
SELECT r.doc_id, array_to_string(list_sort(places), ',') AS places, used AS bytes, array_to_string(list_filter(borne, lambda c: NOT list_contains(covered, c)), ',') AS missing, rescued FROM r JOIN a ON a.doc_id = r.doc_id WHERE step = n + 7""")
def w11_budget_selection(t):
    words = lambda line, c: F.size(F.filter(F.split(line, " "), lambda w: w == c))
    wanted = F.array(*map(F.lit, CATEGORIES))

    def section(line, place):
        strong, weak = (F.filter(wanted, test) for test in (lambda c: words(line, c) >= 2, lambda c: words(line, c) == 1))
        return F.struct(place.alias("place"), F.octet_length(line).alias("size"), (F.size(F.split(line, ",")) > 3).alias("tabular"), (F.size(F.split(line, "[.]")) - 2).alias("anchors"), strong.alias("strong"), weak.alias("weak"))

    sections = t.documents.select("doc_id", F.transform(F.split("text", "\n"), section).alias("sections"))
    chosen = sections.select("doc_id", E.budgeted_sections(F.col("sections"), CATEGORIES, 600, 900).alias("s"))
    return chosen.select("doc_id", F.array_join(F.col("s.places").cast("array<string>"), ",").alias("places"), F.col("s.used").alias("bytes"), F.array_join("s.missing", ",").alias("missing"), "s.rescued")


FIELDS_SQL = """f AS (SELECT doc_id, 'opening' AS field, doc_id % 4 AS section, right(string_split(text, chr(10))[1], 30) AS quote, string_split(text, ' ')[1] AS value, 'The' AS label FROM documents
 UNION ALL SELECT doc_id, 'second', CASE WHEN doc_id % 5 <> 0 THEN 1 END, left(string_split(text, chr(10))[2], 40), string_split(string_split(text, chr(10))[2], ' ')[3], 'of' FROM documents
 UNION ALL SELECT doc_id, 'lang', 0, string_split(text, chr(10))[1], lang, '' FROM documents)"""


@query(rf"""WITH {LINES}, {FIELDS_SQL}, j AS (SELECT f.*, line, CASE WHEN section IS NULL THEN 'no reference' WHEN line IS NULL THEN 'no section' WHEN coalesce(trim(quote), '') = '' THEN 'no quote' WHEN NOT contains(line, quote) THEN 'quote not in section' END AS broken FROM f LEFT JOIN l ON l.doc_id = f.doc_id AND l.place = section),
i AS (SELECT doc_id, field, 0 AS place, broken AS issue FROM j WHERE broken IS NOT NULL UNION ALL SELECT doc_id, field, 1, 'value not in quote' FROM j WHERE broken IS NULL AND (coalesce(trim(value), '') = '' OR NOT contains(quote, value))
 UNION ALL SELECT doc_id, field, 2, 'no label' FROM j WHERE broken IS NULL AND trim(label) <> '' AND NOT contains(line, label) UNION ALL SELECT doc_id, field, 3, 'truncated' FROM j WHERE broken IS NULL AND ends_with(line, quote) AND NOT regexp_matches(rtrim(line), '[.!?]$')
 UNION ALL SELECT doc_id, field, 4, 'ambiguous' FROM j WHERE broken IS NULL AND trim(value) <> '' AND len(string_split(line, value)) > 2)
SELECT doc_id, field, issue FROM i QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY field, place) <= 16""")
def d5_integrity_audit(t):
    lines = F.split("text", "\n")
    field = lambda name, section, quote, value, label: F.struct(F.lit(name).alias("field"), section.cast("int").alias("section"), quote.alias("quote"), value.alias("value"), F.lit(label).alias("label"))
    second = F.get(lines, F.lit(1))
    fields = F.array(
        field("opening", F.col("doc_id") % 4, F.right(lines[0], F.lit(30)), F.split("text", " ")[0], "The"),
        field("second", F.when(F.col("doc_id") % 5 != 0, 1), F.left(second, F.lit(40)), F.get(F.split(second, " "), F.lit(2)), "of"),
        field("lang", F.lit(0), lines[0], F.col("lang"), ""),
    )
    return E.audit_fields(t.documents.select("doc_id", F.inline(fields)), document_lines(t).withColumnRenamed("line", "text"))


# --- resolution ------------------------------------------------------------------------------------------------------------

RESOLVE_SQL = """p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'g' || c_custkey % 900 END AS gid, CASE WHEN c_custkey % 4 <> 0 THEN ['N-' || c_custkey % 700] ELSE [] END AS numbers, lower(c_mktsegment) || ' ' || c_nationkey AS name, 'c' || c_custkey % 40 AS customer FROM customer),
r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'g' || o_custkey % 900 END AS gid, CASE o_orderkey % 3 WHEN 0 THEN ['N-' || o_custkey % 700] WHEN 1 THEN ['N-' || o_orderkey % 4000, 'N-' || (o_orderkey + 1) % 4000] ELSE [] END AS numbers,
  CASE WHEN o_orderkey % 11 = 0 THEN lower(c_name) ELSE lower(c_mktsegment) || ' ' || c_nationkey END AS name, CASE WHEN o_orderkey % 7 <> 0 THEN 'c' || o_custkey % 40 END AS customer, o_orderstatus AS status FROM orders JOIN customer ON c_custkey = o_custkey),
gm AS (SELECT r.id, list_sort(list(p.id)) AS ids FROM r JOIN p ON p.gid = r.gid GROUP BY 1),
nm AS (SELECT r.id, list_sort(list(DISTINCT p.id)) AS ids, bool_or(p.customer <> r.customer) AS other FROM (SELECT id, customer, unnest(numbers) AS n FROM r) r JOIN (SELECT id, customer, unnest(numbers) AS n FROM p) p ON p.n = r.n GROUP BY 1),
mm AS (SELECT r.id, list_sort(list(p.id)) AS ids, bool_or(len(p.numbers) > 0) AS numbered FROM r JOIN p ON p.name = r.name AND p.customer = r.customer GROUP BY 1),
z AS (SELECT r.*, gm.ids AS g, CASE WHEN len(r.numbers) > 0 THEN nm.ids ELSE mm.ids END AS named, nm.ids AS n, nm.other, mm.ids AS m, mm.numbered, q.name AS qname, q.customer AS qcustomer, q.numbers AS qnumbers
  FROM r LEFT JOIN gm ON gm.id = r.id LEFT JOIN nm ON nm.id = r.id LEFT JOIN mm ON mm.id = r.id LEFT JOIN p q ON q.id = gm.ids[1]),
o AS (SELECT id, numbers, name, customer, gid, status AS kind, CASE
  WHEN g IS NOT NULL THEN CASE WHEN len(g) > 1 OR qname <> name OR qcustomer <> customer OR (len(numbers) > 0 AND len(qnumbers) > 0 AND NOT list_has_any(numbers, qnumbers)) OR (named IS NOT NULL AND named <> g) THEN 'manual' ELSE 'matched' END
  WHEN len(numbers) > 0 THEN CASE WHEN n IS NULL THEN CASE WHEN numbered THEN 'manual' ELSE 'new' END WHEN len(n) > 1 OR other THEN 'manual' ELSE 'matched' END
  WHEN m IS NULL THEN 'new' WHEN len(m) > 1 THEN 'manual' ELSE 'matched' END AS status, coalesce(g[1], named[1]) AS found FROM z)"""


def records_and_projects(t):
    """Orders as records, customers as projects."""
    key, size = F.col("c_custkey"), F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string"))
    tag = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    projects = t.customer.select(key.alias("project_id"), F.when(key % 3 == 0, tag("g", key % 900)).otherwise(" ").alias("group_id"), F.when(key % 4 != 0, F.array(tag("n-", key % 700))).alias("numbers"), F.concat(size, F.lit(" phase one")).alias("name"), tag("(C)", key % 40).alias("customer"))
    order, owner = F.col("o_orderkey"), F.col("o_custkey")
    numbers = F.when(order % 3 == 0, F.array(tag("N-", owner % 700))).when(order % 3 == 1, F.array(tag("N-", order % 4000), tag(" n-", (order + 1) % 4000), F.lit("")))
    records = t.orders.join(t.customer, owner == key)
    return records.select(order.alias("record_id"), F.when(order % 5 == 0, tag("g", owner % 900)).alias("group_id"), numbers.alias("numbers"), F.when(order % 11 == 0, F.col("c_name")).otherwise(F.concat(F.lit("[x]"), size)).alias("name"), F.when(order % 7 != 0, tag("C", owner % 40)).otherwise("").alias("customer"), "o_orderstatus"), projects


@query(f"WITH {RESOLVE_SQL} SELECT id AS record_id, status, CASE WHEN status = 'matched' THEN found END AS project_id FROM o")
def j14_resolution_cascade(t):
    return S.resolve(*records_and_projects(t))


#: Rounds over pairs of new records: one that no undecided earlier record stops creates, and stops those that hear it. Then the cascade
#: once more, where a record also sees what was created before it (ids from 10^12 on).
CONFIRM_SQL = f"""{RESOLVE_SQL}, w AS (SELECT * FROM o WHERE kind <> 'F'), nw AS (SELECT * FROM w WHERE status = 'new'),
offer AS (SELECT id, 'g ' || gid AS k FROM nw WHERE gid IS NOT NULL UNION SELECT id, 'n ' || unnest(numbers) FROM nw UNION SELECT id, CASE WHEN len(numbers) > 0 THEN 'm1 ' ELSE 'm0 ' END || name || chr(10) || customer FROM nw WHERE customer IS NOT NULL),
hear AS (SELECT id, k FROM offer UNION SELECT id, 'm1 ' || name || chr(10) || customer FROM nw WHERE customer IS NOT NULL),
stops AS (SELECT DISTINCT a.id AS i, b.id AS j FROM offer a JOIN hear b ON a.k = b.k AND a.id < b.id),
rounds AS (SELECT 0 AS n, id, 0 AS state FROM nw UNION ALL
  SELECT n + 1, id, CASE WHEN state > 0 THEN state WHEN NOT waits THEN 1 WHEN hears THEN 2 ELSE 0 END
  FROM (SELECT r.n, r.id, r.state, coalesce(bool_or(b.state = 0), false) AS waits, coalesce(bool_or(b.state = 0 AND b.free), false) AS hears
    FROM rounds r LEFT JOIN stops ON stops.j = r.id LEFT JOIN (SELECT x.id, any_value(x.state) AS state, NOT coalesce(bool_or(y.state = 0), false) AS free FROM rounds x LEFT JOIN stops s ON s.j = x.id LEFT JOIN rounds y ON y.id = s.i GROUP BY x.id) b ON b.id = stops.i
    WHERE EXISTS (FROM rounds WHERE state = 0) GROUP BY r.n, r.id, r.state)),
made AS (SELECT id FROM rounds WHERE state = 1 AND n = (SELECT max(n) FROM rounds)),
p2 AS (SELECT id, gid, numbers, name, customer, -1 AS since FROM p UNION ALL SELECT id + 1000000000000, gid, numbers, name, customer, id FROM nw WHERE id IN (FROM made)),
gm2 AS (SELECT r.id, list_sort(list(p.id)) AS ids FROM w r JOIN p2 p ON p.gid = r.gid AND since < r.id GROUP BY 1),
nm2 AS (SELECT r.id, list_sort(list(DISTINCT p.id)) AS ids, bool_or(p.customer <> r.customer) AS other FROM (SELECT id, customer, unnest(numbers) AS n FROM w) r JOIN (SELECT id, since, customer, unnest(numbers) AS n FROM p2) p ON p.n = r.n AND since < r.id GROUP BY 1),
mm2 AS (SELECT r.id, list_sort(list(p.id)) AS ids, bool_or(len(p.numbers) > 0) AS numbered FROM w r JOIN p2 p ON p.name = r.name AND p.customer = r.customer AND since < r.id GROUP BY 1),
z2 AS (SELECT r.* EXCLUDE (status, found), gm2.ids AS g, CASE WHEN len(r.numbers) > 0 THEN nm2.ids ELSE mm2.ids END AS named, nm2.ids AS n, nm2.other, mm2.ids AS m, mm2.numbered, q.name AS qname, q.customer AS qcustomer, q.numbers AS qnumbers
  FROM w r LEFT JOIN gm2 ON gm2.id = r.id LEFT JOIN nm2 ON nm2.id = r.id LEFT JOIN mm2 ON mm2.id = r.id LEFT JOIN p2 q ON q.id = gm2.ids[1]),
o2 AS (SELECT id, CASE
  WHEN g IS NOT NULL THEN CASE WHEN len(g) > 1 OR qname <> name OR qcustomer <> customer OR (len(numbers) > 0 AND len(qnumbers) > 0 AND NOT list_has_any(numbers, qnumbers)) OR (named IS NOT NULL AND named <> g) THEN 'manual' ELSE 'matched' END
  WHEN len(numbers) > 0 THEN CASE WHEN n IS NULL THEN CASE WHEN numbered THEN 'manual' ELSE 'new' END WHEN len(n) > 1 OR other THEN 'manual' ELSE 'matched' END
  WHEN m IS NULL THEN 'new' WHEN len(m) > 1 THEN 'manual' ELSE 'matched' END AS status, coalesce(g[1], named[1]) AS found FROM z2)"""


@query(f"""WITH RECURSIVE {CONFIRM_SQL}
SELECT id AS record_id, CASE WHEN id IN (FROM made) THEN 'created' WHEN status = 'manual' THEN 'manual' WHEN found >= 1000000000000 THEN 'joined' ELSE 'attached' END AS outcome,
  CASE WHEN status = 'matched' AND found < 1000000000000 THEN found END AS project_id, CASE WHEN id IN (FROM made) THEN id WHEN status = 'matched' AND found >= 1000000000000 THEN found - 1000000000000 END AS creator FROM o2""")
def d3_batch_confirm(t):
    """Orders that are not finished are eligible."""
    records, projects = records_and_projects(t)
    return S.confirm(records.where("o_orderstatus <> 'F'"), projects)


@query("SELECT p_partkey, spent FROM (SELECT p_partkey, sum(p_size) OVER (ORDER BY p_retailprice DESC, p_partkey) AS spent FROM part) WHERE spent <= 500")
def w14_request_budget(t):
    """Targets by price while the sizes so far fit the budget, whatever the sizes are."""
    return T.within_budget(t.part.select("p_partkey", "p_size", "p_retailprice"), [F.desc("p_retailprice"), F.col("p_partkey")], "p_size", 500).select("p_partkey", "spent")


@query("SELECT l_orderkey, count(*) AS n_rows, count(*) FILTER (l_returnflag = 'R') AS failed, count(*) FILTER (l_linestatus = 'F') AS done, min(l_linenumber) AS first_row FROM lineitem GROUP BY l_orderkey")
def a26_import_summaries(t):
    """A workbook is an order, its rows are the lines."""
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n_rows"), F.count_if(F.col("l_returnflag") == "R").alias("failed"), F.count_if(F.col("l_linestatus") == "F").alias("done"), F.min("l_linenumber").alias("first_row"))


# --- names, records and exports --------------------------------------------------------------------------------------------

WEAK = ("thering", "ungen")
TOKENS_SQL = r"list_filter(regexp_split_to_array({0}, '[\s\p{{P}}+<>]+'), lambda w: length({1}) >= 5 AND {1} NOT IN ('thering', 'ungen') AND NOT regexp_full_match({1}, '[0-9]+'))[1:8]".format


@query(rf"""WITH t AS (SELECT doc_id, {TOKENS_SQL('text', KEY('w'))} AS found, {KEY('text')} AS key FROM documents)
SELECT doc_id, array_to_string(CASE WHEN len(found) > 0 THEN found WHEN length(key) >= 16 THEN [left(key, 16)] ELSE [] END, ',') AS tokens FROM t""")
def f20_name_tokens(t):
    return t.documents.select("doc_id", F.array_join(X.name_tokens(F.col("text"), WEAK), ",").alias("tokens"))


#: Pages against the record they were found for: a name (its own title, a document's opening words) and a customer (a word of its address).
PAIRS_SQL = rf"""n AS (SELECT page_id, {PAGE} AS body, CASE WHEN page_id % 3 = 0 THEN regexp_extract(html, '<title>([^<]*)</title>', 1) WHEN page_id % 3 = 1 THEN left(regexp_extract(html, '<title>([^<]*)</title>', 1), 13) || 'zzzzz' ELSE regexp_extract(text, '^([^.\n]*)', 1) END AS name, regexp_extract(html, '<a href="/([a-zA-Z]{{6,}})"', 1) AS customer FROM pages JOIN documents ON doc_id = page_id),
k AS (SELECT page_id, body, {KEY('body')} AS whole, {KEY('name')} AS key, {KEY('customer')} AS owner, {TOKENS_SQL('name', KEY('w'))} AS found FROM n),
w AS (SELECT *, CASE WHEN len(found) > 0 THEN found WHEN length(key) >= 16 THEN [left(key, 16)] ELSE [] END AS words FROM k), h AS (SELECT *, len(list_filter(words, lambda w: contains(whole, {KEY('w')}))) AS hits FROM w),
hit AS (SELECT page_id, body, (length(key) >= 16 AND contains(whole, left(key, 16))) OR (hits > 0 AND hits >= least(2, len(words))) OR (length(owner) >= 6 AND contains(whole, owner) AND contains(whole, left(key, 12))) AS relevant FROM h)"""


def page_records(t):
    pairs = t.pages.join(t.documents.select(F.col("doc_id").alias("page_id"), "text"), "page_id")
    title, third = F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.col("page_id") % 3
    name = F.when(third == 0, title).when(third == 1, F.concat(F.left(title, F.lit(13)), F.lit("zzzzz"))).otherwise(F.regexp_extract("text", r"^([^.\n]*)", 1))
    customer = F.regexp_extract("html", '<a href="/([a-zA-Z]{6,})"', 1)
    return pairs.select("page_id", X.page_text(F.col("html")).alias("body"), name.alias("name"), customer.alias("customer")).withColumn("relevant", X.relevant(F.col("body"), F.col("name"), F.col("customer"), WEAK))


@query(f"WITH {PAIRS_SQL} SELECT page_id, relevant FROM hit")
def f21_relevance(t):
    return page_records(t).select("page_id", "relevant")


def _sane(pattern: str) -> str:
    value = f"trim(regexp_extract(body, '{pattern}', 1))"
    return f"CASE WHEN length({value}) BETWEEN 4 AND 90 AND NOT contains({value}, 'ing ') THEN {value} END"


@query(f"""WITH {PAIRS_SQL}, v AS (SELECT page_id, relevant, CASE WHEN relevant THEN coalesce({_sane('The ([a-z ]+)')}, {_sane('(?:La|Die|El) ([a-z ]+)')}) END AS winner, CASE WHEN relevant THEN nullif(regexp_extract(body, '([0-9]{{2,}})', 1), '') END AS amount FROM hit)
SELECT page_id, winner, amount, CASE WHEN NOT relevant THEN 'not relevant' WHEN winner IS NULL AND amount IS NULL THEN 'nothing found' ELSE 'matched' END AS message FROM v""")
def f38_bounded_amount(t):
    """An attempt to read winner and amount off each page, with its message."""
    found = page_records(t)
    winner = F.when(F.col("relevant"), X.bounded_match(F.col("body"), ["The ([a-z ]+)", "(?:La|Die|El) ([a-z ]+)"], without=["ing "]))
    amount = F.when(F.col("relevant"), X.first_match(F.col("body"), ["([0-9]{2,})"]))
    message = F.when(~F.col("relevant"), "not relevant").when(winner.isNull() & amount.isNull(), "nothing found").otherwise("matched")
    return found.select("page_id", winner.alias("winner"), amount.alias("amount"), message.alias("message"))


RECORD_TYPES = [(" with ", "result"), (" que ", "contract"), ("License", "notice")]


@query(r"""SELECT d.doc_id, CASE WHEN contains(text, ' with ') THEN 'result' WHEN contains(text, ' que ') THEN 'contract' WHEN contains(text, 'License') THEN 'notice' ELSE 'other' END AS doc_type,
nullif(trim(regexp_extract(text, '\bby ([a-z]+)', 1)), '') AS customer, nullif(trim(regexp_extract(text, '^([A-Z][a-z]+ [a-z ]+)', 1)), '')[1:120] AS project_name, f.value AS content, nullif(regexp_extract(text, '([0-9]{3,})', 1), '') AS budget,
strftime(try_cast(nullif(regexp_extract(text, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') AS DATE), '%Y-%m-%d') AS day, CASE WHEN contains(text, ' with ') OR contains(text, ' que ') THEN nullif(regexp_extract(text, '\bof ([a-z]+)', 1), '') END AS winner,
CASE WHEN contains(text, ' with ') OR contains(text, ' que ') THEN nullif(regexp_extract(text, 'de[^0-9]{0,120}([0-9]+)', 1), '') END AS award_amount, CASE WHEN length(text) < 200 THEN 'short text' ELSE '' END AS note, length(text) AS text_chars
FROM documents d JOIN (""" + CONTENT_SQL + r""") f ON f.doc_id = d.doc_id""")
def f12_extract_record(t):
    text = F.col("text")
    first = lambda *patterns: X.first_match(text, list(patterns))
    kind = X.classify(text, RECORD_TYPES, "other")
    awarded = kind.isin("result", "contract")
    return t.documents.select(
        "doc_id", kind.alias("doc_type"), first(r"\bby ([a-z]+)").alias("customer"), first("^([A-Z][a-z]+ [a-z ]+)").alias("project_name"), X.best_of_kinds(text, KINDS).alias("content"), first("([0-9]{3,})").alias("budget"),
        F.date_format(X.date_of(text), "yyyy-MM-dd").alias("day"), F.when(awarded, first(r"\bof ([a-z]+)")).alias("winner"), F.when(awarded, first("de[^0-9]{0,120}([0-9]+)")).alias("award_amount"),
        F.when(F.length(text) < 200, "short text").otherwise("").alias("note"), F.length(text).alias("text_chars"),
    )


@query(r"""WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'user' AND turn % 4 <> 2 THEN turn::VARCHAR ELSE '' END AS sequence, CASE WHEN role = 'user' AND turn % 4 <> 2 THEN string_split(text, ' ')[1] ELSE ' ' END AS title,
  CASE WHEN length(text) % 3 = 0 THEN '-' WHEN length(text) % 5 < 3 THEN string_split(text, ' ')[1] END AS winner, CASE WHEN length(text) % 2 = 0 THEN (length(text) // 100)::VARCHAR END AS award_amount, CASE WHEN length(text) % 7 = 0 THEN 'http://' || conv_id ELSE '' END AS source_url FROM conversations),
s AS (SELECT *, trim(sequence) <> '' OR trim(title) <> '' AS keyed, source_url <> '' AS linked, coalesce(winner, '') <> '' OR coalesce(award_amount, '') <> '' AS more FROM c),
m AS (SELECT *, min(turn) FILTER (keyed OR linked) OVER (PARTITION BY conv_id) AS first_head FROM s), h AS (SELECT *, keyed OR (linked AND NOT more) OR turn = first_head AS head FROM m),
i AS (SELECT *, count(*) FILTER (head) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM h), k AS (SELECT * FROM i WHERE island > 0 AND (head OR more)),
v AS (SELECT conv_id, island, string_agg(winner, '; ' ORDER BY place) AS winner FROM (SELECT conv_id, island, winner, min(turn) AS place FROM k WHERE winner <> '' AND winner <> '-' GROUP BY ALL) GROUP BY ALL),
a AS (SELECT conv_id, island, string_agg(award_amount, '; ' ORDER BY place) AS award_amount FROM (SELECT conv_id, island, award_amount, min(turn) AS place FROM k WHERE award_amount <> '' GROUP BY ALL) GROUP BY ALL)
SELECT k.conv_id, min(turn) AS turn, arg_min(k.title, turn) AS title, arg_min(k.source_url, turn) AS source_url, coalesce(any_value(v.winner), '') AS winner, coalesce(any_value(a.award_amount), '') AS award_amount, count(*) - 1 AS continuations
FROM k LEFT JOIN v ON v.conv_id = k.conv_id AND v.island = k.island LEFT JOIN a ON a.conv_id = k.conv_id AND a.island = k.island GROUP BY k.conv_id, k.island""")
def s6_vendor_scan(t):
    """Conversations as exports, turns as their rows; the path is named twice and read once."""
    from ledgerloom.sources.files import read_exports
    from ledgerloom.sources.sheets import vendor_rows

    rows = read_exports(t.spark, [f"{t.folder}/conversations.parquet", f"{t.folder}/conversations.parquet/"])
    size, word, keyed = F.length("text"), F.split("text", " ")[0], (F.col("role") == "user") & (F.col("turn") % 4 != 2)
    cells = rows.select(
        "conv_id", "turn", F.when(keyed, F.col("turn").cast("string")).otherwise("").alias("sequence"), F.when(keyed, word).otherwise(" ").alias("title"), F.when(size % 3 == 0, "-").when(size % 5 < 3, word).alias("winner"),
        F.when(size % 2 == 0, F.floor(size / 100).cast("string")).alias("award_amount"), F.when(size % 7 == 0, F.concat(F.lit("http://"), F.col("conv_id").cast("string"))).otherwise("").alias("source_url"),
    )
    return vendor_rows(cells, "conv_id", "turn").select("conv_id", "turn", "title", "source_url", "winner", "award_amount", "continuations")


@query("""WITH i AS (SELECT event_id AS asset_id, 'p' || event_id % 50 AS project, ['d' || event_id] || CASE WHEN event_id % 2 = 0 THEN ['d' || (event_id + 1)] ELSE [] END AS written, 'b' || user_id % 9 AS batch, 'undo ' || user_id || ': d' || event_id || ' d' || (event_id + 1) || CASE WHEN value > 20 THEN ' b' || user_id % 9 ELSE '' END AS hint FROM events WHERE event_type <> 'error'),
d AS (SELECT 'p' || (doc_id + CASE WHEN lang = 'en' THEN 0 ELSE 1 END) % 50 AS project, 'd' || doc_id AS document FROM documents), c AS (SELECT DISTINCT page_id FROM pages WHERE contains(url, 'utm_')),
x AS (SELECT i.*, EXISTS (SELECT 1 FROM labels WHERE doc_id = asset_id) AS asset_found, EXISTS (SELECT 1 FROM d WHERE d.project = i.project AND list_contains(i.written, d.document)) AS document_found, asset_id IN (SELECT page_id FROM c) AS candidate_found, contains(hint, batch) AND len(list_filter(written, lambda w: NOT contains(hint, w))) = 0 AS rollback_complete FROM i)
SELECT asset_id, asset_found, document_found, candidate_found, asset_found AND (document_found OR candidate_found) AS verified, rollback_complete, concat_ws(',', CASE WHEN NOT (asset_found AND (document_found OR candidate_found)) THEN 'not found' END, CASE WHEN NOT rollback_complete THEN 'hint incomplete' END) AS issues FROM x""")
def a25_post_apply_verification(t):
    """Events as applied items (errors were not applied), labels as assets, documents as what the items wrote."""
    tag = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    n, own = F.col("event_id"), tag("d", F.col("event_id"))
    batch, after = tag("b", F.col("user_id") % 9), tag("d", F.col("event_id") + 1)
    hint = F.concat_ws("", F.lit("undo "), F.col("user_id").cast("string"), F.lit(": "), own, F.lit(" "), after, F.when(F.col("value") > 20, F.concat(F.lit(" "), batch)))
    items = t.events.select(n.alias("asset_id"), F.when(F.col("event_type") == "error", "failed").otherwise("applied").alias("status"), tag("p", n % 50).alias("project_id"), F.when(n % 2 == 0, F.array(own, after)).otherwise(F.array(own)).alias("written_ids"), batch.alias("batch"), hint.alias("hint"))
    stored = t.documents.select(tag("p", (F.col("doc_id") + F.when(F.col("lang") == "en", 0).otherwise(1)) % 50).alias("project_id"), tag("d", F.col("doc_id")).alias("document_id"))
    made = t.pages.where(F.contains("url", F.lit("utm_"))).select(F.col("page_id").alias("asset_id"))
    found = V.verify_applied(items, t.labels.select(F.col("doc_id").alias("asset_id")), stored, made)
    return found.withColumn("issues", F.array_join("issues", ","))
