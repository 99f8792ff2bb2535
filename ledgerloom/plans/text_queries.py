"""Documents, pages, parts and conversations: extraction, page candidates, linkage and evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import text as X
from ledgerloom.operators import candidates as C
from ledgerloom.operators import latest as L
from ledgerloom.operators import linkage as K
from ledgerloom.operators import sections as S
from ledgerloom.plans.registry import query


@query("SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS key FROM documents")
def f1_search_text(t):
    return t.documents.select("doc_id", X.search_text(F.col("text")).alias("key"))


@query("SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', '', 'g') AS key FROM documents")
def f2_title_key(t):
    return t.documents.select("doc_id", X.title_key(F.col("text")).alias("key"))


def matching_blocks(pairs: str) -> str:
    """CTEs that end in ``ratio(a, b, score)``, the matching-blocks ratio of all pairs ``(a, b)``: the longest common run, the first among
    equals, splits an area of both strings into two, until no area has one."""
    longest = "SELECT area.*, i, j, least(k, ahi - i, bhi - j) AS k FROM area JOIN run USING (a, b) WHERE i >= alo AND i < ahi AND j >= blo AND j < bhi QUALIFY row_number() OVER (PARTITION BY a, b, alo, blo, ahi, bhi ORDER BY least(k, ahi - i, bhi - j) DESC, i, j) = 1"
    return f"""pair AS (SELECT DISTINCT a, b FROM ({pairs})),
cell AS (SELECT a, b, i, unnest(range(len(b))) AS j FROM (SELECT a, b, unnest(range(len(a))) AS i FROM pair)),
met AS (SELECT *, i - row_number() OVER (PARTITION BY a, b, i - j ORDER BY i) AS g FROM cell WHERE a[i + 1] = b[j + 1]),
run AS (SELECT a, b, i, j, count(*) OVER (PARTITION BY a, b, i - j, g ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS k FROM met),
area AS (SELECT a, b, 0::BIGINT AS alo, len(a) AS ahi, 0::BIGINT AS blo, len(b) AS bhi FROM pair
  UNION ALL SELECT a, b, p.alo, p.ahi, p.blo, p.bhi FROM (SELECT a, b, unnest([{{'alo': alo, 'ahi': i, 'blo': blo, 'bhi': j}}, {{'alo': i + k, 'ahi': ahi, 'blo': j + k, 'bhi': bhi}}]) AS p FROM ({longest})) WHERE p.alo < p.ahi AND p.blo < p.bhi),
ratio AS (SELECT a, b, 2.0::DOUBLE * coalesce(sum(k), 0) / (len(a) + len(b)) AS score FROM pair LEFT JOIN ({longest}) USING (a, b) GROUP BY a, b)"""


_NAMES = "SELECT x.p_name AS a, y.p_name AS b FROM part x, part y WHERE x.p_name <> y.p_name"


@query("WITH n AS (SELECT DISTINCT p_name FROM part) SELECT a.p_name AS a, b.p_name AS b, 1 - levenshtein(a.p_name, b.p_name) / greatest(len(a.p_name), len(b.p_name))::DOUBLE AS score FROM n a JOIN n b ON a.p_name < b.p_name WHERE 1 - levenshtein(a.p_name, b.p_name) / greatest(len(a.p_name), len(b.p_name))::DOUBLE >= 0.7")
def f5_similar_names(t):
    return K.similar_names(t.part, "p_name", 0.7)


@query(f"WITH RECURSIVE {matching_blocks(_NAMES)} SELECT r.a, r.b, r.score AS ratio, z.score AS back FROM ratio r JOIN ratio z ON z.a = r.b AND z.b = r.a WHERE r.a < r.b AND greatest(r.score, z.score) >= 0.6")
def f5_matching_ratio(t):
    return K.similar_names(t.part, "p_name", 0.6, metric="blocks").select("a", "b", F.col("score").alias("ratio"), "back")


@query("SELECT doc_id, nullif(regexp_extract(text, '\\bof ([a-z]+)', 1), '') AS value FROM documents")
def f8_labelled_value(t):
    return t.documents.select("doc_id", X.first_match(F.col("text"), [r"\bof ([a-z]+)"]).alias("value"))


TYPE_RULES = [("ECONOMY|SMALL", "contract"), ("STANDARD", "result"), ("PROMO", "notice")]


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'ECONOMY|SMALL') THEN 'contract' WHEN regexp_matches(p_type, 'STANDARD') THEN 'result' WHEN regexp_matches(p_type, 'PROMO') THEN 'notice' ELSE 'other' END AS doc_type FROM part")
def f11_document_type(t):
    return t.part.select("p_partkey", X.classify(F.col("p_type"), TYPE_RULES, "other").alias("doc_type"))


@query("SELECT o_orderkey, rtrim(rtrim(CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) / 10000 AS DECIMAL(30,6)) AS VARCHAR), '0'), '.') AS amount FROM orders")
def f14_amount(t):
    return t.orders.select("o_orderkey", X.amounts_in_ten_thousands(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("amount"))


PAGE = "html"
for _n, _c in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&copy;", "(c)"), ("&middot;", ".")):
    PAGE = f"replace({PAGE}, '{_n}', '{_c}')"
PAGE = f"trim(regexp_replace(regexp_replace(regexp_replace({PAGE}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, {PAGE} AS text FROM pages")
def f15_page_text(t):
    return t.pages.select("page_id", X.page_text(F.col("html")).alias("text"))


@query(r"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS title, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2), 1) AS place FROM pages),
u AS (SELECT page_id, title, place, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([^:]*:)', 1) || href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([^:]*://[^/?#]*)', 1) || href ELSE regexp_extract(url, '^([^:]*://[^?#]*/)', 1) || href END AS href FROM a WHERE len(trim(title)) >= 3)
SELECT page_id, href, trim(title) AS title, row_number() OVER (PARTITION BY page_id ORDER BY place) AS place FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY place) = 1) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY place) <= 20""")
def f16_anchors(t):
    """The first 20 links of a page with titles of three characters or more, each absolute URL once."""
    found = t.pages.select("page_id", X.links_of(F.col("html"), F.col("url"), least=3, most=20).alias("links"))
    return found.select("page_id", F.posexplode("links").alias("place", "link")).select("page_id", "link.href", "link.title", (F.col("place") + 1).cast("long").alias("place"))


def anchors(t):
    pattern = F.lit('<a href="([^"]*)">([^<]*)</a>')
    pairs = F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("href"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("title"))
    return t.pages.select("page_id", "url", F.inline(pairs))


HOST = "nullif(regexp_replace(regexp_replace(lower(regexp_extract(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^([^/?#]*)', 1)), ':\\d*$', ''), '^www\\.', ''), '')"


@query("SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS identity FROM pages")
def f17_url_identity(t):
    return t.pages.select("page_id", X.url_identity(F.col("url")).alias("identity"))


@query("SELECT page_id, lower(rtrim(trim(url), '/')) AS key FROM pages")
def f18_url_key(t):
    return t.pages.select("page_id", X.url_key(F.col("url")).alias("key"))


@query(f"SELECT page_id, CASE WHEN ends_with({HOST}, '.example.org') THEN 'public' WHEN ends_with({HOST}, '.example.net') THEN 'trade' ELSE 'other' END AS class FROM pages")
def f19_site_class(t):
    return t.pages.select("page_id", X.classify(X.host(F.col("url")), [(r"\.example\.org$", "public"), (r"\.example\.net$", "trade")], "other").alias("class"))


@query("SELECT c_custkey, unnest(['\"' || c_name || '\"', c_name || ' award', c_mktsegment || ' ' || c_name]) AS q FROM customer")
def f22_search_queries(t):
    made = F.array(F.concat(F.lit('"'), F.col("c_name"), F.lit('"')), F.concat(F.col("c_name"), F.lit(" award")), F.concat_ws(" ", "c_mktsegment", "c_name"))
    return t.customer.select("c_custkey", F.explode(F.slice(F.array_distinct(made), 1, 12)).alias("q"))


@query("SELECT doc_id, CASE WHEN instr(text, ' of ') > 0 THEN text[greatest(1, instr(text, ' of ') - 80):greatest(1, instr(text, ' of ') - 80) + instr(text, ' of ') - greatest(1, instr(text, ' of ') - 80) + 4 + 120 - 1] END AS evidence FROM documents")
def f23_evidence_snippet(t):
    return t.documents.select("doc_id", X.snippet(F.col("text"), F.lit(" of ")).alias("evidence"))


@query("SELECT event_id, concat_ws(',', CASE WHEN event_type = 'error' THEN 'kind' END, CASE WHEN value < 20 THEN 'weak' END, CASE WHEN user_id % 7 = 0 THEN 'customer' END) AS flags FROM events")
def f24_risk_flags(t):
    flags = X.distinct_compact(F.when(F.col("event_type") == "error", "kind"), F.when(F.col("value") < 20, "weak"), F.when(F.col("user_id") % 7 == 0, "customer"))
    return t.events.select("event_id", F.array_join(flags, ",").alias("flags"))


@query("SELECT event_id, CASE WHEN value >= 100 AND event_type <> 'error' THEN 'high' WHEN value >= 40 THEN 'medium' ELSE 'low' END AS class FROM events")
def f25_confidence_class(t):
    return t.events.select("event_id", F.when((F.col("value") >= 100) & (F.col("event_type") != "error"), "high").when(F.col("value") >= 40, "medium").otherwise("low").alias("class"))


_SECRET = "(?:api[_-]?key|token|secret|password)"
_FOLDED = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ\u0130\u0131\u212a\u017f', 'abcdefghijklmnopqrstuvwxyziiks'"
_LETTER, _APART, _SK = "[A-Za-z\u0130\u0131\u212a\u017f]", "(?:^|[^0-9A-Za-z_])", "[Ss\u017f][Kk\u212a]-"


#: Words with the spaces after them; what each ends with; what it makes of the next word, and how many characters at its end each kind hides; then its mark.
REDACTED = rf"""
WITH p AS (SELECT doc_id, list_transform(regexp_extract_all(regexp_replace(text, '[\x00-\x1f\x7f]+', ' ', 'g'), '[^ ]+ *| +'), lambda p: {{'x': rtrim(p, ' '), 'gap': p[len(rtrim(p, ' ')) + 1:], 'low': translate(rtrim(p, ' '), {_FOLDED})}}) AS w FROM documents),
b AS (SELECT doc_id, list_transform(w, lambda x, i: {{'x': x.x, 'gap': x.gap, 'low': x.low, 'bare': ltrim(x.low, '([{{<"' || chr(39)), 'api': coalesce(ends_with(w[i - 1].low, 'api'), false), 'followed': i < len(w)}}) AS w FROM p),
e AS (SELECT doc_id, list_transform(w, lambda x: {{'s': x,
  'name': regexp_matches(x.low, '{_SECRET}\z') OR (x.api AND x.bare = 'key'), 'label': regexp_matches(x.low, '{_SECRET}[=:]+\z') OR (x.api AND regexp_matches(x.bare, '^key[=:]+\z')),
  'title': ends_with(x.low, 'authorization'), 'header': regexp_matches(x.low, 'authorization:+\z')}}) AS w FROM b),
l AS (SELECT doc_id, list_transform(w, lambda x, i: {{'e': x, 's': x.s, 'name': coalesce(w[i - 1].name, false), 'label': coalesce(w[i - 1].label, false), 'title': coalesce(w[i - 1].title, false)}}) AS w FROM e),
n AS (SELECT doc_id, list_transform(w, lambda x: {{'s': x.s,
  'value': x.e.label OR (regexp_matches(x.s.low, '^[=:]+\z') AND (x.name OR x.label)),
  'scheme': x.e.header OR (x.title AND regexp_matches(x.s.low, '^:+\z')),
  'credential': regexp_matches(x.s.low, '(?:bearer|authorization:+[a-z]+)\z') OR (x.title AND regexp_matches(x.s.low, '^:+[a-z]+\z')),
  'auth': greatest(len(CASE WHEN x.s.followed THEN regexp_extract(x.s.low, 'authorization:[^ ]*|bearer\z') ELSE regexp_extract(x.s.low, 'authorization:[^ ]+') END), CASE WHEN x.title THEN len(regexp_extract(x.s.low, '^:+([^: ][^ ]*)', 1)) ELSE 0 END),
  'url': CASE WHEN contains(x.s.bare, '://') THEN len(x.s.bare) ELSE 0 END,
  'key': greatest(len(regexp_extract(x.s.low, '{_SECRET}[=:][^ ]*')), len(regexp_extract(x.s.x, '{_APART}({_SK}[^ ]{{8,}})', 1)), len(regexp_extract(x.s.bare, '^[^=]*=["'']?sk-[^ ]{{8,}}')), CASE WHEN x.s.api THEN len(regexp_extract(x.s.bare, '^key[=:][^ ]*')) ELSE 0 END, CASE WHEN x.name THEN len(regexp_extract(x.s.low, '^[=:]+([^=: ][^ ]*)', 1)) ELSE 0 END),
  'mail': CASE WHEN regexp_matches(x.s.bare, '^[^ ][^@]*@[^ ][^.]*[.][^ ]') THEN len(x.s.bare) ELSE 0 END,
  'path': greatest(len(regexp_extract(x.s.x, '{_APART}(/[^ ]+|{_LETTER}:[\\/][^ ]*)', 1)), len(regexp_extract(x.s.x, '[\\]{{2}}[^ ]+|{_LETTER}:[\\][^ ]+')))}}) AS w FROM l),
a AS (SELECT doc_id, list_transform(w, lambda x, i: {{'x': x, 's': x.s, 'n': greatest(x.auth, x.url, x.key, x.mail, x.path), 'auth_next': x.scheme OR x.credential OR coalesce(w[i - 1].scheme AND regexp_matches(x.s.low, '^[a-z]+\z'), false)}}) AS w FROM n),
t AS (SELECT doc_id, list_transform(w, lambda x, i: {{'a': x, 'x': x.x, 's': x.s, 'kept': left(x.s.x, len(x.s.x) - x.n), 'secret': coalesce(w[i - 1].x.value, false), 'credential': coalesce(w[i - 1].auth_next, false)}}) AS w FROM a),
m AS (SELECT doc_id, list_transform(w, lambda x: CASE
  WHEN (x.secret OR x.credential) AND x.s.followed AND (x.x.value OR x.a.auth_next) THEN ''
  WHEN x.credential THEN '[auth]' || x.s.gap
  WHEN x.secret THEN '[key]' || x.s.gap
  WHEN x.a.n = 0 THEN x.s.x || x.s.gap
  WHEN x.s.followed AND ((x.x.value AND x.a.n = x.x.key) OR (x.a.auth_next AND x.a.n = x.x.auth)) THEN x.kept
  ELSE x.kept || CASE x.a.n WHEN x.x.auth THEN '[auth]' WHEN x.x.url THEN '[url]' WHEN x.x.key THEN '[key]' WHEN x.x.mail THEN '[mail]' ELSE '[path]' END || x.s.gap END) AS w FROM t)
SELECT doc_id, array_to_string(w, '')[1:240] AS safe FROM m"""


@query(REDACTED)
def f26_redacted(t):
    return t.documents.select("doc_id", X.redacted(F.col("text")).alias("safe"))


@query("SELECT event_id, CASE WHEN event_type = 'error' AND value > 100 THEN 'TIMEOUT' WHEN event_type = 'error' THEN 'PARSE' WHEN value < 1 THEN 'EMPTY' ELSE 'OK' END AS code FROM events")
def f27_error_code(t):
    wrong = F.col("event_type") == "error"
    return t.events.select("event_id", F.when(wrong & (F.col("value") > 100), "TIMEOUT").when(wrong, "PARSE").when(F.col("value") < 1, "EMPTY").otherwise("OK").alias("code"))


@query("SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events WHERE TRY_CAST(json_extract(props, '$.k') AS DOUBLE) BETWEEN 0 AND 1e9")
def f28_safe_counts(t):
    counts = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: k.rlike("^[a-z_]+$") & v.try_cast("double").between(0, 1e9))
    return t.events.select("event_id", F.explode(counts).alias("name", "k")).select("event_id", F.col("k").cast("double").alias("k"))


@query("SELECT o_orderkey, 'grp_' || sha256(o_custkey || chr(10) || o_orderpriority)[1:16] AS group_id FROM orders")
def f29_group_id(t):
    return t.orders.select("o_orderkey", X.stable_id("grp_", F.col("o_custkey"), F.col("o_orderpriority")).alias("group_id"))


@query("SELECT c_custkey, 'name=' || c_name || ';segment=' || c_mktsegment AS details FROM customer")
def f30_package_map(t):
    entries = F.filter(F.array(F.struct(F.lit("name").alias("k"), F.col("c_name").alias("v")), F.struct(F.lit("segment").alias("k"), F.col("c_mktsegment").alias("v")), F.struct(F.lit("blank").alias("k"), F.lit("").alias("v"))), lambda e: e["v"] != "")
    detail = F.map_from_entries(entries)
    return t.customer.select("c_custkey", F.array_join(F.transform(F.map_entries(detail), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("details"))


SCORE = "(CASE WHEN lang IS NOT NULL THEN 30 ELSE 0 END + CASE WHEN n_chars > 500 THEN 40 WHEN n_chars > 100 THEN 20 ELSE 0 END + CASE WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 30 ELSE 0 END)"


def completeness(t):
    joined = t.documents.join(t.labels, "doc_id", "left")
    either = F.col("quality").isNotNull() | F.col("toxic").isNotNull()
    score = F.when(F.col("lang").isNotNull(), 30).otherwise(0) + F.when(F.col("n_chars") > 500, 40).when(F.col("n_chars") > 100, 20).otherwise(0) + F.when(either, 30).otherwise(0)
    return joined.withColumn("score", score)


@query("SELECT doc_id, CASE WHEN instr(lower(text), 'nation') > 0 THEN instr(lower(text), 'nation') - 1 END AS span_start FROM documents")
def f32_text_span(t):
    return t.documents.select("doc_id", X.text_span(F.col("text"), F.lit("Nation"))["start"].cast("long").alias("span_start"))


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE len(b.text) >= 12")
def f33_quote_in_section(t):
    return K.contained(t.documents, "doc_id", "text", t.benchmark, "item_id", "text", 12).select("item_id", "doc_id")


@query("SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS local_time FROM events")
def f34_local_time(t):
    return t.events.select("event_id", F.date_format(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "+08:00"), "yyyy-MM-dd HH:mm").alias("local_time"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS cell FROM lineitem")
def f35_clean_cell(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", X.clean_cell(F.col("l_quantity").cast("string")).alias("cell"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS numbers, len(regexp_extract_all(text, '[.]')) AS stops, len(regexp_extract_all(text, '\\bthe\\b')) AS anchors FROM documents")
def f36_signal_counters(t):
    return t.documents.select("doc_id", *[F.regexp_count("text", F.lit(p)).alias(n) for n, p in (("numbers", "[0-9]+"), ("stops", "[.]"), ("anchors", r"\bthe\b"))])


@query("SELECT c_custkey, unnest(CASE WHEN c_mktsegment = 'BUILDING' THEN ['build.example.org'] WHEN c_nationkey = 1 THEN ['one.example.org', 'two.example.org'] ELSE ['a.example.net', 'b.example.net', 'c.example.net'] END) AS site FROM customer")
def f37_routing(t):
    routed = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("build.example.org"))).when(F.col("c_nationkey") == 1, F.array(F.lit("one.example.org"), F.lit("two.example.org")))
    return t.customer.select("c_custkey", F.explode(F.slice(F.array_distinct(F.coalesce(routed, F.array(*map(F.lit, ("a.example.net", "b.example.net", "c.example.net"))))), 1, 3)).alias("site"))


@query("SELECT c_custkey, c_name AS project FROM customer")
def f39_file_project(t):
    file = F.concat(F.lit("tender_"), F.regexp_replace("c_name", " ", "+"), F.lit(".pdf"))
    return t.customer.select("c_custkey", F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(file, r"^(?:tender|award)_", ""), r"\+", " "), r"\.\w+$", "")).alias("project"))


@query("SELECT c_custkey, 'A1-' || c_custkey || 'X,' || upper(replace(c_name, '#', '-')) AS ids FROM customer")
def f40_identifier_list(t):
    text = F.concat(F.lit("A1-"), F.col("c_custkey").cast("string"), F.lit("X "), F.regexp_replace("c_name", "#", "-"))
    return t.customer.select("c_custkey", F.array_join(F.slice(X.identifiers(text, least=4), 1, 6), ",").alias("ids"))


@query("SELECT page_id, contains(html, '<nav>') AND contains(html, '<article>') AS recognised FROM pages")
def f41_sheet_recognition(t):
    headers = F.regexp_extract_all("html", F.lit("<([a-z]+)>"), F.lit(1))
    return t.pages.select("page_id", (F.array_contains(headers, "nav") & F.array_contains(headers, "article")).alias("recognised"))


@query(f"SELECT page_id, {HOST} AS host FROM pages WHERE ends_with('.' || {HOST}, '.example.org')")
def p9_domain_allow_list(t):
    allowed = t.spark.createDataFrame([("example.org",)], "domain string")
    return allow_list(t.pages.select("page_id", X.host(F.col("url")).alias("host")), "host", allowed)


def allow_list(rows, host, allowed):
    """Rows whose host is an allowed domain or below one, by equi-join on the host's own suffixes."""
    spread = rows.withColumn("domain", F.explode(X.domain_suffixes(F.col(host))))
    return spread.join(allowed, "domain", "left_semi").drop("domain").distinct()


@query("SELECT doc_id, CASE WHEN trim(text) = '' THEN 'blank' WHEN text LIKE 'Total%' THEN 'summary' WHEN n_chars < 50 THEN 'no identity' ELSE 'valid' END AS row_status FROM documents")
def p12_row_classification(t):
    status = F.when(F.trim("text") == "", "blank").when(F.startswith("text", F.lit("Total")), "summary").when(F.col("n_chars") < 50, "no identity").otherwise("valid")
    return t.documents.select("doc_id", status.alias("row_status"))


@query("SELECT doc_id, concat_ws(',', CASE WHEN len(text) < 20 THEN 'short' END, CASE WHEN len(text) > 10000 THEN 'long' END, CASE WHEN lower(text) IN ('none', 'null', '-') THEN 'placeholder' END) AS suspicious FROM documents")
def p13_suspicious(t):
    low = F.lower("text")
    return t.documents.select("doc_id", F.array_join(X.distinct_compact(F.when(F.length("text") < 20, "short"), F.when(F.length("text") > 10000, "long"), F.when(low.isin("none", "null", "-"), "placeholder")), ",").alias("suspicious"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS number FROM part")
def p14_placeholder_rejection(t):
    raw = F.when(F.col("p_size") % 5 == 0, "No. 20XX-XXX").otherwise(F.col("p_brand"))
    return t.part.select("p_partkey", F.when(~raw.rlike(r"X{3}|20XX"), raw).alias("number"))


@query("""SELECT d.doc_id, concat_ws(',', CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN n_chars < 100 THEN 'text' END) AS missing, quality IS NOT NULL AND n_chars >= 100 AND coalesce(toxic, 0) = 0 AS eligible FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def p16_readiness(t):
    joined = t.documents.join(t.labels, "doc_id", "left")
    present = F.array_compact(F.array(F.when(F.col("quality").isNotNull(), "quality"), F.when(F.col("n_chars") >= 100, "text")))
    missing = F.array_except(F.array(F.lit("quality"), F.lit("text")), present)
    return joined.select("doc_id", F.array_join(missing, ",").alias("missing"), ((F.size(missing) == 0) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("eligible"))


@query("SELECT p_partkey, CASE WHEN contains(p_type, 'PROMO') THEN 'award_notice' WHEN contains(p_type, 'ECONOMY') THEN 'bid_notice' WHEN contains(p_type, 'STANDARD') THEN 'contract' ELSE 'other' END AS relation_type FROM part")
def p19_relation_type(t):
    return t.part.select("p_partkey", X.classify(F.col("p_type"), [("PROMO", "award_notice"), ("ECONOMY", "bid_notice"), ("STANDARD", "contract")], "other").alias("relation_type"))


@query("SELECT d.doc_id, CASE (CASE WHEN quality IS NULL THEN 0 ELSE 1 END + CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END) WHEN 0 THEN 'none' WHEN 1 THEN 'partial' ELSE 'full' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def p20_extraction_status(t):
    filled = F.col("quality").isNotNull().cast("int") + (F.col("n_chars") > 1000).cast("int")
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.when(filled == 0, "none").when(filled == 1, "partial").otherwise("full").alias("status"))


@query("SELECT page_id, 'doc_' || page_id AS document_id, CASE WHEN regexp_extract(regexp_replace(url, '[?#].*$', ''), '\\.(\\w+)$', 1) IN ('html', 'pdf') THEN regexp_extract(regexp_replace(url, '[?#].*$', ''), '\\.(\\w+)$', 1) ELSE 'html' END AS file_type, CASE WHEN len(html) < 1000 THEN 'short' ELSE '' END AS warnings FROM pages")
def p24_document_normalisation(t):
    suffix = F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"\.(\w+)$", 1)
    return t.pages.select("page_id", F.concat(F.lit("doc_"), F.col("page_id").cast("string")).alias("document_id"), F.when(suffix.isin("html", "pdf"), suffix).otherwise("html").alias("file_type"), F.array_join(X.distinct_compact(F.when(F.length("html") < 1000, "short")), ",").alias("warnings"))


@query("""WITH a AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS u FROM pages), x AS (SELECT page_id, unnest(u) AS href, generate_subscripts(u, 1) - 1 AS place FROM a)
SELECT page_id, place, href, CASE WHEN regexp_matches(href, '\\.(zip|rar)$') THEN 'archive' WHEN regexp_matches(href, '\\.\\w+$') THEN 'downloadable' ELSE 'pending' END AS status FROM x""")
def p27_attachments(t):
    listed = t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1))).alias("place", "href"))
    return listed.withColumn("status", F.when(F.col("href").rlike(r"\.(zip|rar)$"), "archive").when(F.col("href").rlike(r"\.[0-9A-Za-z_]+$"), "downloadable").otherwise("pending"))


@query(f"WITH RECURSIVE {matching_blocks(_NAMES)} SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM ratio WHERE score >= 0.85")
def j9_title_edges(t):
    return K.similar_names(t.part, "p_name", 0.85, metric="blocks").select("a", "b")


@query("SELECT min(doc_id) OVER (PARTITION BY text) AS src, doc_id AS dst FROM documents QUALIFY src <> dst")
def j9_exact_edges(t):
    return K.star_edges(t.documents, "doc_id", F.sha2("text", 256))


@query(f"""WITH RECURSIVE {matching_blocks(_NAMES)}, n AS (SELECT p_name, min(p_partkey) AS id, max(p_partkey) AS last FROM part GROUP BY 1),
e AS (SELECT x.id AS x, y.id AS y FROM ratio JOIN n x ON x.p_name = a JOIN n y ON y.p_name = b WHERE score >= 0.85 AND x.id < y.last),
both_ways AS (SELECT id AS x, id AS y FROM n UNION SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT x, y FROM both_ways UNION SELECT r.x, e.y FROM r JOIN both_ways e ON e.x = r.y), g AS (SELECT x, min(y) AS component FROM r GROUP BY x)
SELECT p_partkey, component FROM part JOIN n USING (p_name) JOIN g ON g.x = n.id""")
def j10_duplicate_groups(t):
    return K.groups(K.similar_rows(t.part, "p_partkey", "p_name", 0.85, metric="blocks"), t.part.select("p_partkey"), "p_partkey")


RECORDS = "r AS (SELECT p_partkey AS id, p_name AS name, p_brand AS customer, p_type || '-' || p_size AS number, p_partkey * 7919 % 1000 AS day FROM part)"


@query(f"""WITH RECURSIVE {matching_blocks("SELECT x.p_name AS a, y.p_name AS b FROM part x, part y")}, {RECORDS},
p AS (SELECT a.id AS a, b.id AS b, a.number = b.number AS num, ratio.score AS sim, a.customer AS ca, b.customer AS cb, abs(a.day - b.day) <= 90 AS near FROM r a JOIN r b ON a.id < b.id JOIN ratio ON ratio.a = a.name AND ratio.b = b.name),
s AS (SELECT a, b, least(1.0, least(1.0, (CASE WHEN num THEN 0.45 ELSE 0 END) + (CASE WHEN sim >= 0.55 THEN 0.55 * sim ELSE 0 END) + 0 + (CASE WHEN near THEN 0.05 ELSE 0 END)) + CASE WHEN ca = cb THEN 0.20 WHEN contains(ca, cb) OR contains(cb, ca) THEN 0.12 ELSE 0 END) AS score FROM p)
SELECT a, b, score FROM s WHERE score >= 0.68""")
def j7_record_linkage(t):
    """Parts as records: the brand is the customer, type and size the number."""
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("p_partkey") * 7919 % 1000).cast("int"))
    records = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("customer"), F.array(F.concat_ws("-", "p_type", F.col("p_size").cast("string"))).alias("numbers"), day.alias("day"))
    return K.match_records(records)


_KEY = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', '', 'g')"
#: Parts as candidates; suppliers, each with the part of its number, as projects whose names, customers, numbers and days differ more or less.
PROJECTS = f"""cand AS (SELECT p_partkey AS id, {_KEY.format('p_name')} AS name, {_KEY.format('p_brand')} AS customer, upper(p_type || '-' || p_size) AS number, p_partkey * 7919 % 1000 AS day FROM part),
proj AS (SELECT s_suppkey AS id, {_KEY.format("CASE s_suppkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' works' WHEN 2 THEN 'new ' || p_name ELSE 'lot ' || p_size || ' ' || p_name END")} AS name,
  {_KEY.format("p_brand || CASE WHEN s_suppkey % 3 = 0 THEN ' group' ELSE '' END")} AS customer, CASE WHEN s_nationkey % 2 = 0 THEN upper(p_type || '-' || p_size) END AS number, s_suppkey * 31 % 1000 AS day FROM supplier JOIN part ON p_partkey = s_suppkey)"""
_PAIRS = "SELECT cand.name AS a, proj.name AS b FROM cand, proj"
BEST = f"""WITH RECURSIVE {PROJECTS}, {matching_blocks(_PAIRS)},
s AS (SELECT c.id AS candidate_id, p.id, least(1.0, (CASE WHEN c.number = p.number THEN 0.45::DOUBLE ELSE 0 END) + (CASE WHEN score >= 0.55 THEN score * 0.55 ELSE 0 END)
  + (CASE WHEN c.customer = p.customer THEN 0.20::DOUBLE WHEN contains(c.customer, p.customer) OR contains(p.customer, c.customer) THEN 0.12::DOUBLE ELSE 0 END) + (CASE WHEN abs(c.day - p.day) <= 90 THEN 0.05::DOUBLE ELSE 0 END)) AS score
  FROM cand c, proj p, ratio WHERE ratio.a = c.name AND ratio.b = p.name),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, id) = 1)
SELECT candidate_id, CASE WHEN score >= 0.68 THEN id END AS matched_project_id, score FROM best"""


def _day(key, step: int):
    return F.date_add(F.lit("2020-01-01").cast("date"), (key * step % 1000).cast("int"))


def part_candidates(t):
    number = F.array(F.concat_ws("-", "p_type", F.col("p_size").cast("string")))
    return t.part.select(F.col("p_partkey").alias("candidate_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("customer"), number.alias("numbers"), _day(F.col("p_partkey"), 7919).alias("day"))


def supplier_projects(t):
    joined, key, name = t.supplier.join(t.part, F.col("p_partkey") == F.col("s_suppkey")), F.col("s_suppkey"), F.col("p_name")
    named = F.when(key % 4 == 0, name).when(key % 4 == 1, F.concat(name, F.lit(" works"))).when(key % 4 == 2, F.concat(F.lit("new "), name)).otherwise(F.concat_ws(" ", F.lit("lot"), F.col("p_size").cast("string"), name))
    customer = F.when(key % 3 == 0, F.concat("p_brand", F.lit(" group"))).otherwise(F.col("p_brand"))
    number = F.when(F.col("s_nationkey") % 2 == 0, F.array(F.concat_ws("-", "p_type", F.col("p_size").cast("string"))))
    return joined.select(key.alias("project_id"), named.alias("project_name"), customer.alias("customer"), number.alias("numbers"), _day(key, 31).alias("day"), key.alias("ordinal"))


@query(f"SELECT candidate_id, matched_project_id, score FROM ({BEST}) WHERE matched_project_id IS NOT NULL")
def j8_best_match(t):
    return C.best_project_match(part_candidates(t), supplier_projects(t)).where("matched_project_id IS NOT NULL")


@query(BEST)
def j8_best_scores(t):
    """Every candidate with its best score, weak ones too; ``j8_best_match`` has the matches only."""
    return C.best_project_match(part_candidates(t), supplier_projects(t))


@query(f"""WITH RECURSIVE {PROJECTS}, {matching_blocks(_PAIRS)}
SELECT c.id AS candidate_id, p.id AS project_id, score, row_number() OVER (PARTITION BY c.id ORDER BY score DESC, p.id) AS place FROM cand c, proj p, ratio WHERE ratio.a = c.name AND ratio.b = p.name AND score >= 0.6 QUALIFY place <= 5""")
def j11_similar_hint(t):
    return C.similar_projects(part_candidates(t), supplier_projects(t))


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE len(b.text) >= 12")
def j12_containment(t):
    return K.existing_matches(t.documents, "doc_id", "text", t.benchmark, "item_id", "text", 12)


@query("SELECT doc_id, contains(lower(text), 'with') OR contains(lower(text), 'pour') AS any_match, contains(lower(text), 'with') AND contains(lower(text), 'this') AND NOT contains(lower(text), 'license') AS all_match FROM documents")
def j13_keywords(t):
    text = F.col("text")
    return t.documents.select("doc_id", K.keyword_matches(text, ["with", "pour"]).alias("any_match"), (K.keyword_matches(text, ["with", "this"], "all") & ~K.keyword_matches(text, ["license"])).alias("all_match"))


@query(f"SELECT d.doc_id, lang, {SCORE} AS score FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def t4_completeness_queue(t):
    return completeness(t).select("doc_id", "lang", "score").orderBy(F.desc("score"), "lang", "doc_id")


@query("SELECT count(*) AS n, count(quality) AS filled, CASE WHEN count(*) = 0 THEN 0.0 ELSE round(100.0 * count(quality) / count(*), 1) END AS completeness FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def a6_completeness(t):
    joined = t.documents.join(t.labels, "doc_id", "left")
    return joined.agg(F.count("*").alias("n"), F.count("quality").alias("filled"), F.when(F.count("*") == 0, 0.0).otherwise(F.round(100.0 * F.count("quality") / F.count("*"), 1)).alias("completeness"))


@query("SELECT CASE WHEN toxic = 1 THEN 'known' WHEN quality = 1 THEN 'unknown' ELSE 'ambiguous' END AS status, count(*) AS n, count(*) FILTER (doc_id NOT IN (SELECT item_id FROM benchmark)) AS outside FROM labels GROUP BY 1")
def a22_annotation_counters(t):
    status = F.when(F.col("toxic") == 1, "known").when(F.col("quality") == 1, "unknown").otherwise("ambiguous")
    inside = t.benchmark.select(F.col("item_id").alias("doc_id"), F.lit(True).alias("inside"))
    return t.labels.join(inside, "doc_id", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("inside").isNull()).alias("outside"))


@query(f"SELECT count(*) AS pages, count(*) FILTER (ends_with({HOST}, '.example.org')) AS confirmed, count(*) FILTER (contains(url, 'utm_')) AS tracking FROM pages")
def a27_page_summary(t):
    return t.pages.agg(F.count("*").alias("pages"), F.count_if(F.endswith(X.host(F.col("url")), F.lit(".example.org"))).alias("confirmed"), F.count_if(F.contains("url", F.lit("utm_"))).alias("tracking"))


#: Scheme and host in lower case, no default port, no fragment.
IDENTITY = r"lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), CASE WHEN lower(url) LIKE 'https%' THEN ':443$' ELSE ':80$' END, '') || regexp_extract(url, '://[^/?#]*([^#]*)', 1)"


@query(f"""WITH i AS (SELECT page_id, {IDENTITY} AS source_key, contains(html, 'lang="en"') AS completed, contains(url, '#') AS hidden FROM (SELECT page_id, url, html FROM pages UNION ALL SELECT page_id + 1000000000, replace(url, 'http://', 'HTTP://') || '#again', html FROM pages)),
f AS (SELECT page_id, source_key, first_value(page_id) OVER (PARTITION BY source_key ORDER BY completed DESC, hidden, page_id) AS primary_id FROM i)
SELECT page_id, source_key, page_id <> primary_id AS hidden, CASE WHEN page_id <> primary_id THEN primary_id END AS duplicate_of, count(*) OVER (PARTITION BY source_key) AS attempts FROM f""")
def d11_url_convergence(t):
    """Pages and a second visit of each, whose URL is written in another way."""
    again = t.pages.select((F.col("page_id") + 1_000_000_000).alias("page_id"), F.concat(F.replace(F.col("url"), F.lit("http://"), F.lit("HTTP://")), F.lit("#again")).alias("url"), "html")
    items = t.pages.select("page_id", "url", "html").unionByName(again)
    items = items.select("page_id", X.url_identity(F.col("url")).alias("source_key"), F.contains("html", F.lit('lang="en"')).alias("completed"), F.lit(False).alias("duplicate"), F.contains("url", F.lit("#")).alias("hidden"), F.lit("").alias("created_time"), F.col("page_id").alias("ordinal"))
    return L.converge(items, "source_key", "page_id")


@query("SELECT min(page_id) AS page_id FROM pages GROUP BY lower(rtrim(trim(regexp_replace(url, '[?#].*$', '')), '/'))")
def u4_distinct_urls(t):
    from ledgerloom.operators.tables import first_of_key

    return first_of_key(t.pages, X.url_key(F.regexp_replace("url", r"[?#].*$", "")), "page_id").select("page_id")


@query("""WITH m AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM conversations)
SELECT conv_id, island, count(*) AS n_rows, min(turn) AS first_row, count(DISTINCT role) AS roles FROM m WHERE island > 0 GROUP BY ALL""")
def w6_continuations(t):
    rows = t.conversations.select("conv_id", "turn", "role")
    merged = L.continuation_merge(rows, "conv_id", "turn", F.col("role") == "user", ["role"])
    return merged.select("conv_id", "island", "n_rows", "first_row", F.size(F.split("role", "; ")).cast("long").alias("roles"))


def document_lines(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))


LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS place FROM documents)"


#: Lines as elements: short lines of few words that end without a full stop are titles, lines with a bar are table rows.
_KIND = "CASE WHEN strlen(line) < 60 AND NOT regexp_matches(line, '[.!?]\\s*$') THEN 'Title' WHEN contains(line, '|') THEN 'Table' ELSE 'NarrativeText' END"
#: Sections by recursion over the pieces of a document. Pieces are cut where the bytes of their code points reach the bound.
SECTIONS_SQL = f"""{LINES}, el AS (SELECT doc_id, place, {_KIND} AS kind, trim(line) AS text FROM l WHERE trim(line) <> ''),
long AS (SELECT doc_id, place, 0 AS piece, text, '' AS head FROM el WHERE strlen(text) > 2048 UNION ALL
  SELECT doc_id, place, piece + 1, text[len(head) + 1:], (SELECT max_by(left(text[len(head) + 1:], n), n) FROM (SELECT unnest(range(512, 2049)) AS n) WHERE strlen(left(text[len(head) + 1:], n)) <= 2048) FROM long WHERE len(text) > len(head)),
pc AS (SELECT doc_id, place, 0 AS piece, kind, text FROM el WHERE strlen(text) <= 2048 UNION ALL SELECT doc_id, place, piece - 1, kind, head FROM long JOIN (SELECT doc_id, place, kind FROM el) USING (doc_id, place) WHERE piece > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place, piece) AS nth FROM pc),
r AS (SELECT doc_id, nth, strlen(text) AS used, 0 AS section FROM o WHERE nth = 1 UNION ALL
  SELECT o.doc_id, o.nth, CASE WHEN (kind = 'Title' AND piece = 0) OR used + strlen(text) > 2048 THEN strlen(text) ELSE used + strlen(text) END, CASE WHEN (kind = 'Title' AND piece = 0) OR used + strlen(text) > 2048 THEN section + 1 ELSE section END FROM r JOIN o ON o.doc_id = r.doc_id AND o.nth = r.nth + 1),
sec AS (SELECT o.doc_id, o.place, o.piece, o.kind, o.text, r.section FROM r JOIN o ON o.doc_id = r.doc_id AND o.nth = r.nth QUALIFY row_number() OVER (PARTITION BY o.doc_id, r.section, o.kind, trim(o.text) ORDER BY o.place, o.piece) = 1)"""


def line_elements(t):
    line = F.col("line")
    kind = F.when((F.octet_length(line) < 60) & ~line.rlike(r"[.!?]\s*$"), "Title").when(F.contains(line, F.lit("|")), "Table").otherwise("NarrativeText")
    return document_lines(t).select("doc_id", "place", kind.alias("kind"), line.alias("text"))


@query(f"WITH RECURSIVE {SECTIONS_SQL} SELECT doc_id, section::BIGINT AS section, count(*) AS n_rows, sum(strlen(text))::BIGINT AS bytes, bool_or(kind = 'Title') AS titled, sha256(string_agg(text, chr(10) ORDER BY place, piece)) AS digest FROM sec GROUP BY doc_id, section")
def w10_sections(t):
    """Whole sections as digests of their rows."""
    rows = S.build_sections(line_elements(t))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece", "text"))), lambda x: x["text"]), "\n")  # a section is bounded in bytes
    return rows.groupBy("doc_id", "section").agg(F.count("*").alias("n_rows"), F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.bool_or(F.col("kind") == "Title").alias("titled"), F.sha2(text, 256).alias("digest"))


@query(f"""WITH RECURSIVE {LINES}, k AS (SELECT doc_id, place, strlen(line) AS size, CASE WHEN place = 0 THEN -1 ELSE -len(regexp_extract_all(line, '[.]')) END AS relevance FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN place = 0 THEN 0 ELSE 1 END, relevance, place) AS rank FROM k),
r AS (SELECT doc_id, rank, size AS used, true AS kept FROM o WHERE rank = 1 UNION ALL SELECT o.doc_id, o.rank, CASE WHEN used + o.size <= 1000 THEN used + o.size ELSE used END, used + o.size <= 1000 FROM r JOIN o ON o.doc_id = r.doc_id AND o.rank = r.rank + 1)
SELECT doc_id, count(*) FILTER (kept) AS kept, max(used) AS bytes FROM r GROUP BY doc_id""")
def w12_row_retention(t):
    rows = F.array_sort(F.transform(F.split("text", "\n"), lambda x, i: F.struct((i > 0).cast("int").alias("tier"), F.when(i == 0, -1).otherwise(-F.regexp_count(x, F.lit("[.]"))).alias("relevance"), i.cast("long").alias("place"), F.octet_length(x).cast("long").alias("size"))))
    empty = F.expr("named_struct('used', 0L, 'kept', 0L)")

    def add(state, item):
        fits = (item["tier"] == 0) | (state["used"] + item["size"] <= 1000)
        return F.struct(F.when(fits, state["used"] + item["size"]).otherwise(state["used"]).alias("used"), F.when(fits, state["kept"] + 1).otherwise(state["kept"]).alias("kept"))

    return t.documents.select("doc_id", F.aggregate(rows, empty, add).alias("s")).select("doc_id", "s.kept", F.col("s.used").alias("bytes"))


_LABELS = {"article": "the|le|la|der|die|el", "link": "of|de|von|und|and"}
_FOLLOWS = {"article": r"\p{L}{4}"}
_AVOIDS = {"link": r"\d"}
#: The words of the first line are cells of one row, the others are lines of two words each, so that labels have neighbours of both sorts.
_CELLS = "cells AS (SELECT doc_id, unnest(string_split(split_part(text, chr(10), 1), ' ')) AS text, generate_subscripts(string_split(split_part(text, chr(10), 1), ' '), 1) - 1 AS col FROM documents)"


@query(rf"""WITH {_CELLS}, w AS (SELECT doc_id, col AS place, text AS label, trim(lead(text) OVER (PARTITION BY doc_id ORDER BY col)) AS value FROM cells),
b AS (SELECT doc_id, place, 'cell' AS source, trim(label) AS label, value FROM w UNION ALL SELECT doc_id, place, 'line', regexp_replace(trim(label), '^([(]?[0-9]{{1,3}}[.)]|[ivxIVX]{{1,5}}[.)])\s*', ''), value FROM w),
k AS (SELECT b.*, f.field FROM b JOIN (VALUES ('article', '(?i)^({_LABELS["article"]})$'), ('link', '(?i)^({_LABELS["link"]})$')) f(field, p) ON regexp_matches(label, p) WHERE len(value) > 0 AND NOT regexp_matches(value, '(?i)^({_LABELS["article"]}|{_LABELS["link"]})$'))
SELECT doc_id, field, CASE source WHEN 'cell' THEN 0 ELSE place END AS place, source, label, value FROM k WHERE (field <> 'article' OR regexp_matches(value, '\p{{L}}{{4}}')) AND (field <> 'link' OR NOT regexp_matches(value, '\d'))""")
def w16_adjacent_values(t):
    """The words of each first line, once as lines and once as the cells of one row."""
    words = t.documents.select("doc_id", F.posexplode(F.split(F.split("text", "\n")[0], " ")).alias("place", "text"))
    cells = words.select("doc_id", F.lit(0).alias("table_index"), F.lit(0).alias("row"), F.col("place").alias("col"), "text")
    return S.adjacent_values(words, cells, _LABELS, _FOLLOWS, _AVOIDS)


_CATEGORIES = {"the": (r"\b[Tt]he\b", r"ing\b"), "of": (r"\bof\b", r"tion\b"), "and": (r"\band\b", r"[0-9]")}


@query(rf"""WITH RECURSIVE {SECTIONS_SQL}, nx AS (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY section, place) AS next FROM (SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id ORDER BY place, piece) AS place, kind, text FROM sec)),
c AS (SELECT doc_id, section, category, regexp_matches(text, label) AS hit, regexp_matches(text, label) AND (regexp_matches(text, val) OR coalesce(regexp_matches(next, val) AND NOT regexp_matches(next, label), false)) AS valued, lower(kind) IN ('title', 'header') AS head, lower(kind) = 'table' AS tab FROM nx, (VALUES {", ".join(f"('{c}', '{a}', '{v}')" for c, (a, v) in _CATEGORIES.items())}) f(category, label, val)),
p AS (SELECT doc_id, section, category, count(*) FILTER (hit) AS hits, bool_or(valued) AS valued, bool_or(hit AND head) AS heading, bool_or(tab) AS tab FROM c GROUP BY ALL HAVING count(*) FILTER (hit) > 0),
d AS (SELECT *, count(*) OVER (PARTITION BY doc_id, section) = 1 AS dedicated, CASE WHEN valued THEN 0 WHEN heading THEN 1 ELSE 2 END AS strength FROM p)
SELECT doc_id, category, section::BIGINT AS section, strength, heading, dedicated, hits, row_number() OVER (PARTITION BY doc_id, category ORDER BY strength, heading DESC, dedicated DESC, hits DESC, tab, section) AS rank FROM d""")
def w18_evidence_rank(t):
    rows = S.build_sections(line_elements(t))
    numbered = rows.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("place", "piece")))
    return S.evidence_ranks(numbered, _CATEGORIES)


@query("""WITH p AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders)
SELECT 'pair_' || sha256(CASE WHEN a::VARCHAR < b::VARCHAR THEN a || chr(10) || b ELSE b || chr(10) || a END)[1:16] AS pair_id, a, b FROM p WHERE b IS NOT NULL""")
def d16_pair_candidates(t):
    pairs = t.orders.select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("b")).where("b IS NOT NULL")
    ends = F.array_sort(F.array(F.col("a").cast("string"), F.col("b").cast("string")))
    return pairs.select(F.concat(F.lit("pair_"), F.left(F.sha2(F.array_join(ends, "\n"), 256), F.lit(16))).alias("pair_id"), "a", "b").dropDuplicates(["pair_id"])


@query("""SELECT doc_id, 'lang' AS field, lang AS value, instr(lower(text), lower(lang)) - 1 AS span_start FROM documents WHERE lang IS NOT NULL
UNION ALL SELECT doc_id, 'source', source, instr(lower(text), lower(source)) - 1 FROM documents WHERE source IS NOT NULL""")
def d22_fact_rows(t):
    facts = t.documents.select("doc_id", "text", F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("lang", "source")]))).where("value IS NOT NULL")
    return facts.select("doc_id", "field", "value", F.coalesce(X.text_span(F.col("text"), F.col("value"))["start"], F.lit(-1)).cast("long").alias("span_start"))


# --- sources ---------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, quality, toxic FROM labels")
def s1_json_rows(t):
    from ledgerloom.sources.json_tables import json_rows

    written = t.labels.select(F.to_json(F.struct("doc_id", "quality", "toxic")).alias("value"))
    return json_rows(written, "value", t.labels.schema)


@query("SELECT conv_id, turn, role FROM conversations")
def s2_envelope(t):
    from ledgerloom.sources.json_tables import envelope_rows

    row = F.struct("turn", "role")
    pick = lambda user: F.collect_list(F.when((F.col("role") == "user") if user else (F.col("role") != "user"), row))
    payloads = t.conversations.withColumn("part", F.floor(F.col("turn") / 64)).groupBy("conv_id", "part").agg(F.to_json(F.struct(pick(True).alias("candidates"), pick(False).alias("results"))).alias("payload"))
    return envelope_rows(payloads, "payload", ["candidates", "results"], "turn long, role string").select("conv_id", "turn", "role")


@query()
def s3_file_listing(t):
    from ledgerloom.sources.files import list_files

    return list_files(t.spark, t.folder, [".parquet"])


@query("SELECT doc_id, CASE WHEN starts_with(text, 'Th') THEN 'th' WHEN starts_with(text, 'D') THEN 'd' ELSE 'unknown' END AS kind FROM documents")
def s4_sniffing(t):
    from ledgerloom.sources.files import sniff

    return t.documents.select("doc_id", sniff(F.col("text").cast("binary"), [(b"Th", "th"), (b"D", "d")]).alias("kind"))


HEADER = {"the": "article", "of": "preposition", "and": "conjunction"}


@query(f"""WITH {LINES}, c AS (SELECT doc_id, place, unnest(string_split(line, ' ')) AS v FROM l WHERE place < 20), m AS (SELECT doc_id, place, v FROM c WHERE v IN ('the', 'of', 'and')),
g AS (SELECT doc_id, place, count(DISTINCT v) AS fields, count(*) AS hits FROM m GROUP BY ALL) SELECT doc_id, min(place) AS header_row FROM g WHERE fields >= 2 AND hits = fields GROUP BY doc_id""")
def s5_header_rows(t):
    from ledgerloom.sources.sheets import header_rows

    lines = document_lines(t).where("place < 20")
    cells = lines.select("doc_id", F.col("place").alias("row"), F.posexplode(F.split("line", " ")).alias("col", "value"))
    aliases = t.spark.createDataFrame(list(HEADER.items()), "value string, field string")
    return header_rows(cells, ["doc_id"], aliases).select("doc_id", F.col("row").cast("long").alias("header_row"))


@query("SELECT doc_id, quality FROM labels")
def s8_snapshot(t):
    from ledgerloom.session import materialise

    return materialise(t.labels.select("doc_id", "quality"), "snapshot")
