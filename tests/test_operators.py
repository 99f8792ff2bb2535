import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import latest as L
from ledgerloom.operators import linkage as K
from ledgerloom.operators import tables as T
from ledgerloom.operators.components import connected_components
from ledgerloom.operators.resolution import by_first_key
from ledgerloom.plans.text_queries import allow_list, j12_containment


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def one(spark, column, **given):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()] or [F.lit(1)])
    return row.select(column.alias("x")).first()["x"]


def closure(edges):
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {a: find(a) for a in parent}


@pytest.mark.parametrize("kind", ["empty", "chain", "star", "random", "loops"])
def test_components(spark, kind):
    r = random.Random(3)
    edges = {"empty": [], "chain": [(i, i + 1) for i in range(60)], "star": [(500, i) for i in range(40)], "random": [(r.randrange(200), r.randrange(200)) for _ in range(120)], "loops": [(1, 1), (2, 3), (3, 2), (2, 3)]}[kind]
    df = spark.createDataFrame([*edges, (None, 4)], "src long, dst long")
    got = {r["id"]: r["component"] for r in connected_components(df).collect()}
    want = closure(edges)
    assert {k: v for k, v in got.items() if k != 4 or k in want} == want


def test_latest_rules_differ_on_ties(spark):
    rows = spark.createDataFrame([("a", "9", "t1", 1), ("a", "10", "t1", 2), ("b", "1", "t0", 3)], "asset string, decision string, time string, ordinal int")
    assert values(L.latest(rows, ["asset"], "time", "ordinal").select("asset", "decision")) == [("a", "10"), ("b", "1")]
    assert values(L.latest(rows, ["asset"], "time", "decision", "ordinal").select("asset", "decision")) == [("a", "9"), ("b", "1")]


def test_unknown_decision_is_an_error(spark):
    with pytest.raises(ValueError):
        L.with_value_latest(spark.createDataFrame([("a", "x")], "k string, v string"), "k", "v", "MAYBE", ["ACCEPT"], "v")


def test_replay_collapses_repeats(spark):
    rows = spark.createDataFrame([("a", "X", 1), ("a", "X", 2), ("a", "Y", 3), ("a", "X", 4)], "k string, s string, n int")
    assert values(L.replay(rows, "k", "s", "n").select("n", "is_final")) == [(2, False), (3, False), (4, True)]


def test_continuation_starts_with_no_head(spark):
    rows = spark.createDataFrame([("f", 1, False, "w0"), ("f", 2, True, "w1"), ("f", 3, False, "w1"), ("f", 4, False, "w2"), ("f", 5, False, None)], "g string, n int, head boolean, w string")
    assert values(L.continuation_merge(rows, "g", "n", F.col("head"), ["w"]).select("island", "n_rows", "w")) == [(1, 4, "w1; w2")]


def test_overlay_takes_filled_values_only(spark):
    rows = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, " ", None), (1, 3, None, "y")], "k int, p int, a string, b string")
    assert values(L.overlay(rows, "k", "p", ["a", "b"])) == [(1, "a", "y")]


def test_append_unique_is_idempotent(spark):
    old, new = spark.createDataFrame([(1, "old")], "id int, v string"), spark.createDataFrame([(1, "new"), (2, "first"), (2, "second")], "id int, v string")
    merged, added = T.append_unique(old, new, "id", "v")
    assert values(merged) == [(1, "old"), (2, "first")] and values(added) == [(2, "first")]
    again, nothing = T.append_unique(merged, new, "id", "v")
    assert values(again) == values(merged) and not nothing.count()


def test_fingerprint_ignores_order_and_sees_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string")
    assert T.unchanged(a, a.orderBy(F.desc("id"))) and not T.unchanged(a, a.withColumn("v", F.lit("z")))


def test_gate_blocks(spark):
    rows = spark.createDataFrame([("ok",), ("invalid",)], "status string")
    assert T.quality_gate(rows, "status", ["invalid", "conflict"]).first() == (1, 0, False)
    assert T.quality_gate(rows.where("status = 'ok'"), "status", ["invalid"]).first()["may_write"]


def test_patch_logs_only_differences(spark):
    target, changes = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(1, "a"), (2, "c")], "id int, new string")
    patched, log = T.patch(target, changes, "id", "v")
    assert values(patched.select("id", "v")) == [(1, "a"), (2, "c")] and values(log) == [(2, "v", "b", "c")]


def test_resolution_gives_each_row_one_outcome(spark):
    rows = spark.createDataFrame([(1, "g", None), (2, "z", "n"), (3, "z", "m"), (4, None, None)], "id int, gid string, num string")
    index = lambda c, *v: spark.createDataFrame(list(v), f"{c} string, project long")
    out = by_first_key(rows, "id", [("gid", index("gid", ("g", 10))), ("num", index("num", ("n", 20), ("m", 30), ("m", 31)))])
    assert values(out) == [(1, "matched", 10), (2, "matched", 20), (3, "manual", None), (4, "new", None)]


def test_similar_names_lose_nothing(spark):
    r = random.Random(5)
    names = ["".join(r.choice("abc") for _ in range(r.randrange(1, 12))) for _ in range(120)]
    df = spark.createDataFrame([(n,) for n in names], "n string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[:], i
            for j, y in enumerate(b, 1):
                row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
        return row[-1]

    kinds = sorted(set(names))
    want = {(a, b) for a in kinds for b in kinds if a < b and 1 - distance(a, b) / max(len(a), len(b)) >= 0.7}
    assert {(r["a"], r["b"]) for r in K.similar_names(df, "n", 0.7).collect()} == want


def test_star_edges_are_linear(spark):
    df = spark.createDataFrame([(i, "same") for i in range(50)] + [(99, None)], "id long, k string")
    assert K.star_edges(df, "id", F.col("k")).count() == 49


def test_containment_needs_twelve_characters(spark):
    texts = spark.createDataFrame([(1, "xx a long passage here yy"), (2, None), (3, "")], "id int, t string")
    contexts = spark.createDataFrame([(7, "a long passage"), (8, "xx a"), (9, None)], "cid int, c string")
    assert values(K.contained(texts, "id", "t", contexts, "cid", "c")) == [(1, 7)]


def test_existing_matches_equal_or_contained_either_way(spark):
    names = ["road", "road works", "north road works phase two", "the north road works phase two contract", "roadworks 12", "x roadworks 12 x", "", " ", None, "Road", "a.b"]
    texts = spark.createDataFrame(list(enumerate(names)), "id int, t string")
    contexts = spark.createDataFrame([(100 + i, n) for i, n in enumerate(names)], "cid int, c string")
    full = [(i, n) for i, n in enumerate(names) if n and n.strip()]
    want = sorted((i, 100 + j) for i, a in full for j, b in full if a == b or (len(b) >= 12 and b in a) or (len(a) >= 12 and a in b))
    assert {(0, 100), (2, 103), (3, 102), (5, 104)} <= set(want)
    assert values(K.existing_matches(texts, "id", "t", contexts, "cid", "c")) == want
    planted = spark.createDataFrame([(1, "passage of the long text"), (2, "short"), (3, "a passage of the long text here")], "doc_id long, text string")
    stored = spark.createDataFrame([(7, "a passage of the long text here"), (8, "short")], "item_id long, text string")
    tables = type("Tables", (), {"documents": planted, "benchmark": stored})
    assert values(j12_containment(tables)) == [(1, 7), (2, 8), (3, 7)]


def test_link_score_thresholds(spark):
    score = lambda number, sim, customer, date: one(spark, K.link_score(F.lit(number), F.lit(sim), F.lit(customer), F.lit(date)))
    assert score(True, 0.0, False, False) == pytest.approx(0.45)
    assert score(True, 0.0, True, True) == pytest.approx(0.70)
    assert score(False, 1.0, False, True) == pytest.approx(0.60)
    assert score(False, 0.54, True, False) == pytest.approx(0.20)
    assert score(True, 1.0, True, True) == 1.0


def test_record_linkage_edges(spark):
    rows = [(1, "north road", "city", ["N-1"], "2024-01-01"), (2, "completely different", "city", ["N-1"], "2024-02-01"), (3, "other", "town", ["N-1"], "2024-02-01"), (4, "", "city", [], "2024-01-01"), (5, "", "city", None, "2024-01-01"), (6, "north road", "old city", None, "2024-01-02"), (7, "north road", "old city", None, "2022-01-02"), (8, "north road", None, None, None), (9, None, "city", ["N-1"], None)]
    records = spark.createDataFrame(rows, "id long, name string, customer string, numbers array<string>, day string").withColumn("day", F.to_date("day"))
    got = {(r["a"], r["b"]): round(r["score"], 2) for r in K.match_records(records).collect()}
    assert got == {(1, 2): 0.70, (1, 6): 0.72, (6, 7): 0.75}
    with pytest.raises(ValueError):
        K.match_records(records, 0.5)


def test_allow_list_knows_look_alikes(spark):
    hosts = spark.createDataFrame([("a.example.org",), ("example.org",), ("notexample.org",), (None,)], "host string")
    allowed = spark.createDataFrame([("example.org",)], "domain string")
    assert [r[0] for r in values(allow_list(hosts, "host", allowed))] == ["a.example.org", "example.org"]


@pytest.mark.parametrize(
    ("url", "identity", "host"),
    [
        ("HTTP://User@Example.COM:80/A?b=1#c", "http://user@example.com/A?b=1", "example.com"),
        ("https://www.x.org:443", "https://www.x.org", "x.org"),
        ("https://x.org:8443/p", "https://x.org:8443/p", "x.org"),
        ("x.org/path#f", "x.org/path", "x.org"),
        ("", "", None),
        (None, None, None),
    ],
)
def test_urls(spark, url, identity, host):
    u = F.lit(url).cast("string")
    assert (one(spark, X.url_identity(u)), one(spark, X.host(u))) == (identity, host)


@pytest.mark.parametrize(("value", "want"), [(None, None), ("", None), ("  　\t", None), ("-", None), ("x", "x"), (" x ", " x ")])
def test_blanks(spark, value, want):
    assert one(spark, X.blank_to_null(F.lit(value).cast("string"), ["-"])) == want


def test_text_functions(spark):
    assert one(spark, X.search_text(F.lit(" Ａｂ　 C "))) == "ab c"
    assert one(spark, X.date_of(F.lit("on 2024/2/30"))) is None
    assert str(one(spark, X.date_of(F.lit("on 2024/2/9")))) == "2024-02-09"
    assert one(spark, X.amounts_in_ten_thousands(F.lit("1,234,500.50 and 20000"))) == "123.45005; 2"
    assert one(spark, X.identifiers(F.lit("2019-2021 ab-12 A-1"))) == ["AB-12"]
    assert one(spark, X.core_name(F.lit("[a] (b) Road works phase two final"), ["phase two", "final"])) == "Road works"
    assert one(spark, X.page_text(F.lit("<p>a &amp; b</p><script>x</script>"))) == "a & b"
    assert one(spark, X.redacted(F.lit("see https://a.b/c and token=abc x@y.org"))) == "see [url] and [key] [mail]"
    assert tuple(one(spark, X.text_span(F.lit("Big Word"), F.lit("word")))) == (4, 8)
    assert one(spark, X.clean_cell(F.lit(" 5.0 "))) == "5"


def test_json_array_source(spark, tmp_path):
    from ledgerloom.sources.json_tables import read_json_array

    schema = spark.createDataFrame([], "a int, b string").schema
    (tmp_path / "x.json").write_text('[{"a": 1, "b": "u"}, 7, {"a": 2}]')
    assert [r["a"] for r in read_json_array(spark, f"file://{tmp_path}/x.json", schema).orderBy("a").collect()] == [1, 2]
    assert read_json_array(spark, f"file://{tmp_path}/none.json", schema).count() == 0


def test_entry_runs_without_the_optional_part(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize(
    ("raw", "safe"),
    [
        ("open /root/a/b.txt failed", "open [path] failed"),
        ("(/mnt/x), and/or 1/2", "([path] and/or 1/2"),
        (r"share \\host\dir\f.doc x", "share [path] x"),
        (r"C:\Users\me d:/data", "[path] [path]"),
        ("key sk-abcdefgh12 end", "key [key] end"),
        ("Authorization: Basic dXNlcjpwYXNz next", "[auth] next"),
        ("Authorization: Bearer abc.def-1", "[auth]"),
        ("line one\nline\ttwo\x00", "line one line two "),
    ],
)
def test_redaction_covers_every_root(spark, raw, safe):
    assert one(spark, X.redacted(F.lit(raw))) == safe


def test_name_blocking_loses_no_pair(spark):
    import random

    from ledgerloom.operators.linkage import similar_names

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    r = random.Random(7)
    names = {"".join(r.choice("abc") for _ in range(r.randrange(1, 12))) for _ in range(90)}
    for long in ["".join(r.choice("abcdefgh") for _ in range(30)) for _ in range(3)]:
        for _ in range(12):
            x = list(long)
            for _ in range(r.randrange(7)):
                at = r.randrange(len(x))
                x[at : at + 1] = r.choice([[], [r.choice("abcz")], [x[at], r.choice("abcz")]])
            names.add("".join(x))
    names = sorted(names)
    for threshold in (0.55, 0.8):
        want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if 1 - distance(a, b) / max(len(a), len(b)) >= threshold - 1e-12}
        got = {(x["a"], x["b"]) for x in similar_names(spark.createDataFrame([(n,) for n in names], "n string"), "n", threshold).collect()}
        assert got == want


@pytest.mark.parametrize(
    ("raw", "safe"),
    [
        (None, None),
        ("", ""),
        ("password: hunter2, then", "[key] then"),
        ("API key: abc PASSWORD = x1 y", "API [key] PASSWORD = [key] y"),
        ("(token=abc) secret=", "([key] [key]"),
        ("bearer", "bearer"),
        ("Bearer abc left", "[auth] left"),
        ("file=/etc/passwd a/b c:/x", "file=[path] a/b [path]"),
        ("<me@x.org> ftp://h/x @x a@b", "<[mail] [url] @x a@b"),
        ("x " * 200, ("x " * 200)[:240]),
    ],
)
def test_redaction_reads_words_with_their_neighbours(spark, raw, safe):
    assert one(spark, X.redacted(F.lit(raw).cast("string"))) == safe


HIDDEN = [
    ("access_token=abc1 x", "access_[key] x"),
    ("--client-secret: abc1 x", "--client-[key] x"),
    ("(password:  abc1) x", "([key] x"),
    ("api key = abc1 x", "api key = [key] x"),
    ("token =abc1 PASSWORD :abc2", "token =[key] PASSWORD :[key]"),
    ("secret := abc1 x", "secret := [key] x"),
    ("use:sk-abcdefgh12 x", "use:[key] x"),
    ("sk-abcdefgh12=x", "[key]"),
    ("Authorization:Bearer abc1 x", "[auth] x"),
    ("Authorization : Basic abc1 x", "Authorization : [auth] x"),
    ("Authorization: Custom abc1 x", "[auth] x"),
    ('{"h": "Bearer abc1"} x', '{"h": "[auth] x'),
    ("bearer  abc1 x", "[auth] x"),
    ("log:/etc/abc1 x", "log:[path] x"),
    ("/srv/abc1?a=b x", "[path] x"),
    (r"C:\abc1=/x in,D:\abc2 x", "[path] in,[path] x"),
    (r"(at)\\host\abc1 x", "(at)[path] x"),
    ("me@x.org;password: abc1 x", "[mail] [key] x"),
    ("to\u212aen=abc1 pa\u017fsword=abc2 token\u0130/abc3", "[key] [key] token\u0130[path]"),
    ("  a  b ", "  a  b "),
    ("token", "token"),
]


@pytest.mark.parametrize(("raw", "safe"), HIDDEN)
def test_redaction_hides_every_form(spark, raw, safe):
    assert one(spark, X.redacted(F.lit(raw))) == safe


def test_redaction_equals_its_sql(spark):
    import duckdb

    from ledgerloom.plans.text_queries import REDACTED

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    texts = [raw for raw, _ in HIDDEN] + [None, "", " ", "\x00", " ".join(raw for raw, _ in HIDDEN[:8]), "-".join(raw for raw, _ in HIDDEN[8:14])]
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    found = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", X.redacted(F.col("text")))
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(REDACTED).fetchall())


def test_redaction_of_very_long_words(spark):
    assert one(spark, X.redacted(F.lit("@" * 200_000 + " token" + ":" * 200_000 + "x"))) == "@" * 240
    assert one(spark, X.redacted(F.lit("token:" * 50_000 + " x"))) == "[key]"
    assert one(spark, X.redacted(F.lit("authorization:" * 50_000 + "= x"))) == "[auth] x"


def test_long_runs_do_not_break_patterns(spark):
    assert one(spark, X.core_name(F.lit("[a] " * 100_000 + "Road works" + " final" * 100_000), ["phase two", "final"])) == "Road works"
    assert one(spark, X.core_name(F.lit("final final"), ["final"])) == ""
    assert one(spark, X.core_name(F.lit("final cut"), ["final"])) == "final cut"
    assert one(spark, X.clean_cell(F.lit("a" + " \n" * 1_000_000 + "b"))) == "a\nb"
    assert one(spark, X.redacted(F.lit("x\n" * 200_000))) == ("x " * 200)[:240]


@pytest.mark.parametrize("threshold", [0.6, 0.68, 0.78, 0.88])
def test_ratio_join_loses_nothing(spark, threshold):
    from difflib import SequenceMatcher

    r = random.Random(int(threshold * 100))
    words = ["road", "works", "ngo", "北京市", "bridge", "roof", "a", "works works", "é"]
    names = {" ".join(r.choice(words) for _ in range(r.randrange(1, 5))) for _ in range(120)}
    for n in sorted(names)[:60]:
        i = r.randrange(len(n) + 1)
        names |= {n[:i] + r.choice("xyab ") + n[i:], n[i:] + n[:i]}
    names = sorted(n for n in names if n)
    like = lambda a, b: SequenceMatcher(None, a, b).ratio()
    want = {(a, b): (like(a, b), like(b, a)) for a in names for b in names if a < b and max(like(a, b), like(b, a)) >= threshold}
    df = spark.createDataFrame([(n, 1) for n in [*names, names[0]]] + [(None, 1), ("", 1)], "n string, score int")
    assert {(x["a"], x["b"]): (x["score"], x["back"]) for x in K.similar_names(df, "n", threshold, metric="blocks").collect()} == want


def test_ratio_join_makes_no_crowd_of_one_opening(spark):
    """Names that begin alike meet only if they have enough characters in common order."""
    from difflib import SequenceMatcher

    r = random.Random(5)
    names = sorted({f"largewidget{r.randrange(100_000)}" for _ in range(400)})
    df = spark.createDataFrame([(n, n[-1]) for n in names], "n string, k string")
    want = {(a, b) for a in names for b in names if a < b and max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) >= 0.88}
    met = K._meet_by_deletions(df, "n", 0.88, ())
    assert 0 < met.count() < 4 * len(want) < len(names) ** 2 / 20
    assert want <= {(x["a"], x["b"]) for x in met.collect()}
    assert {(x["a"], x["b"]) for x in K.similar_names(df, "n", 0.88, metric="blocks").collect()} == want
    inside = K.similar_names(df, "n", 0.88, ["k"], "blocks").collect()
    assert {(x["k"], x["a"], x["b"]) for x in inside} == {(a[-1], a, b) for a, b in want if a[-1] == b[-1]}


@pytest.mark.parametrize("threshold", [0.61, 0.68])
def test_linkage_is_that_of_all_pairs(spark, threshold):
    """Several shared numbers, missing and blank parts, contained and blank customers; names are not compared for each pair of records."""
    import datetime
    from difflib import SequenceMatcher

    r = random.Random(11)
    name = lambda: r.choice([None, "", " ".join(r.choice(["road", "works", "north", "roof", "rd"]) for _ in range(r.randrange(1, 4)))])
    many = lambda: r.choice([None, [], ["a"], ["a", "b"], ["b", "a", "a"], ["c", None], ["d"], ["e", "b", "a"], [None]])
    when = lambda: r.choice([None, datetime.date(2020, 1, 1) + datetime.timedelta(days=r.randrange(400))])
    rows = [(i, name(), r.choice([None, "", "city", "city of ames", "ames", "county"]), many(), when()) for i in range(150)]
    want = {}
    for a, x, c, m, d in rows:
        for b, y, e, n, f in rows:
            if a < b:
                like = SequenceMatcher(None, x, y).ratio() if x and y else 0.0
                score = 0.45 if {*(m or [])} & {*(n or [])} - {None} else 0.0
                score = min(1.0, score + (0.55 * like if like >= 0.55 else 0.0) + (0.05 if d and f and abs((d - f).days) <= 90 else 0.0))
                score = min(1.0, score + (0.0 if c is None or e is None else 0.20 if c == e else 0.12 if c in e or e in c else 0.0))
                if score >= threshold:
                    want[a, b] = round(score, 9)
    records = spark.createDataFrame(rows, "id long, name string, customer string, numbers array<string>, day date")
    matches = K.match_records(records, threshold)
    found = matches.collect()
    assert len(found) == len(want) and {(x["a"], x["b"]): round(x["score"], 9) for x in found} == want
    assert "EvalPython" not in matches._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("threshold", [0.6, 0.88])
def test_two_tables_of_names_are_compared_with_each_other_only(spark, threshold):
    from difflib import SequenceMatcher

    r = random.Random(9)
    base = [f"{r.choice(['red', 'cold', 'old'])}{r.choice(['bolt', 'ring', 'rod'])}" for _ in range(30)]
    asked, stock = {x + str(r.randrange(30)) for x in base}, {r.choice(["lot", "", "new"]) + x + str(r.randrange(30)) for x in base * 5} | {"n" * 60, "n" * 57 + "m"}
    asked |= {sorted(stock)[3], "n" * 58}
    like = lambda a, b: SequenceMatcher(None, a, b).ratio()
    rows = lambda names: spark.createDataFrame([(n,) for n in names], "n string")
    want = sorted((a, b, like(a, b)) for a in asked for b in stock if like(a, b) >= threshold)
    assert values(K.related_names(rows(asked), rows(stock), "n", threshold)) == want
    sided = spark.createDataFrame([(n, 1 * (n in asked) + 2 * (n in stock)) for n in asked | stock], "n string, s int")
    pairs = K.similar_names(sided, "n", threshold, metric="blocks", side="s").collect()
    assert pairs and all((x["a"] in asked and x["b"] in stock) or (x["b"] in asked and x["a"] in stock) for x in pairs)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh ", "é😀a", "a"])
def test_ratios_of_whole_arrays(letters):
    from difflib import SequenceMatcher

    from ledgerloom.functions.ratio import ratios

    r = random.Random(len(letters))
    text = lambda: "".join(r.choice(letters) for _ in range(r.choice([0, 3, 9, 17, 48, 49, 250])))
    a, b = [text() for _ in range(700)], [text() for _ in range(700)]
    assert ratios(a, b).tolist() == [SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)]
    assert [x != x for x in ratios([None, "a", None], ["a", None, None])] == [True] * 3


def test_containment_at_one_opening(spark):
    """Contexts that share their opening, texts that are full of it, and short contexts."""
    opening = "all rights reserved by the authority of the city; "
    texts = spark.createDataFrame([(i, opening * 3 + f"text {i} é") for i in range(300)], "id long, t string")
    contexts = spark.createDataFrame([(i, opening + f"text {i} ") for i in range(300)] + [(900, opening + "nothing"), (901, "text 299 é"), (902, "é"), (903, "299")], "cid long, c string")
    want = sorted([(i, j) for i in range(300) for j in range(300) if f"text {i} é".startswith(f"text {j} ")])
    assert values(K.contained(texts, "id", "t", contexts, "cid", "c")) == want
    short = K.contained(texts, "id", "t", contexts.where("cid > 900"), "cid", "c", 1)
    assert values(short) == sorted([(299, 901), (299, 903)] + [(i, 902) for i in range(300)])
