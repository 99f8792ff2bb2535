"""Vector, page and conversation operators against brute force."""

import importlib

import numpy as np
import pytest

from ledgerloom.llm import ann, chat, embedding_dedup, queries, url_filter
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"


def vectors(seed, n=260, size=8, dense=120):
    r = np.random.default_rng(seed)
    base = r.standard_normal((n, size))
    centre = r.standard_normal(size)
    near = centre + 0.12 * r.standard_normal((dense, size))
    rows = [(i, [float(np.float32(v)) for v in x], int(r.integers(0, 3))) for i, x in enumerate(base)]
    rows += [(1000 + i, [float(np.float32(v)) for v in x], 1) for i, x in enumerate(near)]
    rows += [(2000 + i, rows[4][1], rows[4][2]) for i in range(30)]
    rows += [(3000, None, 1), (3001, [0.0] * size, 1), (3002, [1.0] * (size - 1) + [None], 1), (3003, [float("nan")] * size, 1), (3004, [float("inf")] + [1.0] * (size - 1), 1), (3005, [], 1), (3006, rows[4][1], None), (3100, [1.0, 2.0], 1), (3101, [1.0, 2.0], 1), (None, rows[4][1], rows[4][2])]
    return rows


def usable(row):
    v = row[1]
    return row[0] is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("block", [40, 2000])
def test_embedding_links(spark, block):
    rows = vectors(1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as cell", "2 as vector")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df, threshold=0.95, cell=60, block=block).collect()}
    good = [r for r in rows if usable(r) and r[2] is not None]
    links = {r[0]: set() for r in good}
    for i, a in enumerate(good):
        for b in good[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                    links[a[0]].add(b[0])
                    links[b[0]].add(a[0])
    assert any(len(x) > 50 for x in links.values())
    for r in rows:
        if r[0] in links:
            seen, todo = {r[0]}, [r[0]]
            while todo:
                for x in links[todo.pop()] - seen:
                    seen.add(x)
                    todo.append(x)
            assert got[r[0]] == (len(links[r[0]]), min(seen), r[0] == min(seen))
        else:
            assert got[r[0]] == (0, r[0], True)
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_nearest_neighbours(spark):
    rows = vectors(2, n=900, size=16, dense=300)
    rows = [r for r in rows if usable(r) and len(r[1]) == 16] + [r for r in rows if not usable(r)] + [(5, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = [r for r in rows if usable(r) and len(r[1]) == 16]
    ids, x = np.array([r[0] for r in good]), np.array([r[1] for r in good], np.float32).astype(float)
    hits = total = 0
    for q in [i for i in ids if i % 100 == 0]:
        far = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, far)) if ids[i] != q][:10]
        mine = got.pop(q)
        assert [m[0] for m in mine] == list(range(1, 11))
        for _, v, s in mine:
            assert s == pytest.approx(far[ids == v][0], abs=1e-12)
        assert [m[2] for m in mine] == sorted(m[2] for m in mine)
        hits += len({m[1] for m in mine} & {ids[i] for i in order})
        total += 10
    assert not got and hits / total >= 0.9
    few = spark.createDataFrame([(0, [1.0, 2.0], 1), (7, [1.0, 2.5], 1), (8, [9.0, 9.0], 1)], df.schema)
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(few).collect()] == [(0, 1, 7), (0, 2, 8)]
    assert ann.nearest(df.where("false")).count() == 0


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    table = df.toPandas()
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"].to_numpy()).astype(float)
    got = queries.op4_nearest_neighbours(spark, "/root/testdata/sf0.01").toPandas()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        far[ids == q] = np.inf
        best = set(ids[np.lexsort((ids, far))[:10]])
        hits += len(best & set(got[got["query_id"] == q]["vec_id"]))
        total += len(best)
    assert hits / total >= 0.9


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("HTTP://A.Example.ORG/es/x?y", "a.example.org", "/es/x", "example.org/es/", "block"),
        ("http://example.org/en/12#f", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("x://b.com/fr/", "b.com", "/fr/", "com/fr/", "allow"),
        ("x://b.com/FR/", "b.com", "/FR/", None, None),
        ("http://b.com/de/1", "b.com", "/de/1", "com/de/", "block"),
        ("http://b.net?x=://org/", "b.net", "", None, None),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    base = [(i, f"http://h{i % 7}.example.{'org' if i % 2 else 'com'}/{'de' if i % 2 == 0 else 'en'}/{i}") for i in range(60)]
    pages = spark.createDataFrame([(500, url), *base], "page_id long, url string").selectExpr("*", "1 as gram", "2 as score")
    row = url_filter.judge(pages).where("page_id = 500").first()
    assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
    assert row["verdict"] == verdict if verdict else row["verdict"] in ("allow", "block")


def test_url_model(spark):
    good = [(i, f"http://news{i % 9}.org/story/{i}") for i in range(200)]
    bad = [(1000 + i, f"http://casino{i % 9}.com/de/win/{i}") for i in range(200)]
    new = [(5001, "http://news3.net/story/77"), (5002, "http://casino4.net/win/5"), (5002, "http://casino4.net/win/5")]
    pages = spark.createDataFrame(good + bad + new, "page_id long, url string")
    got = sorted((r["page_id"], r["verdict"]) for r in url_filter.judge(pages).where("page_id > 5000").collect())
    assert got == [(5001, "allow"), (5002, "block"), (5002, "block")]
    only = url_filter.judge(spark.createDataFrame(bad + new, pages.schema)).where("page_id > 5000")
    assert {r["verdict"] for r in only.collect()} == {"block"}
    assert {r["verdict"] for r in url_filter.judge(spark.createDataFrame(new, pages.schema)).collect()} == {"allow"}
    assert url_filter.judge(pages.where("false")).count() == 0


@pytest.mark.parametrize("ids", [lambda i: 10 * i, lambda i: 5 * i + 1])
def test_url_filter_learns_whatever_the_ids(spark, ids):
    urls = [f"https://example.org/en/2{i:03d}/good" for i in range(40)] + [f"https://example.org/es/{i:03d}/malo" for i in range(40)] + ["https://unknown.net/es/777/malo", "https://unknown.net/en/2777/good"]
    pages = spark.createDataFrame([(ids(i), u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["score"]) for r in url_filter.judge(pages).where("rule IS NULL").collect()}
    assert got[ids(80)][0] == "block" and got[ids(81)][0] == "allow" and got[ids(80)][1] < got[ids(81)][1]


def test_url_filter_is_native(spark):
    plan = url_filter.judge(spark.read.parquet(f"{SMALL}/pages.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    compare(spark, "/root/testdata/sf0.01", queries.queries()[name], queries.oracle_sql()[name], connect("/root/testdata/sf0.01"))


def test_chat_links(spark):
    rows = [
        (1, 0, "user", "Hello there friend\nhow are you"),
        (1, 1, "assistant", "I am fine thanks"),
        (1, 2, "user", "On Mon, A wrote:\n> Hello  there FRIEND\n> how are you\nmy reply"),
        (1, 3, "user", "> I am fine thanks\nok good"),
        (1, 4, "user", "> my reply\n>> Hello there friend\nnested"),
        (1, 5, "user", "> nobody said this\nlost"),
        (1, 6, "user", "> how are you\r\npartly"),
        (2, None, None, None),
        (2, 0, "a", ""),
        (None, 0, "user", "> x"),
    ]
    got = [tuple(r) for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("conv_id", "turn", "reply_to", "thread", "depth", "position", "body").orderBy("conv_id", "position").collect()]
    assert got == [
        (None, 0, None, 0, 0, 0, ""),
        (1, 0, None, 0, 0, 1, "Hello there friend\nhow are you"),
        (1, 2, 0, 0, 1, 2, "my reply"),
        (1, 4, 2, 0, 2, 3, "nested"),
        (1, 6, 0, 0, 1, 4, "partly"),
        (1, 1, None, 1, 0, 5, "I am fine thanks"),
        (1, 3, 1, 1, 1, 6, "ok good"),
        (1, 5, None, 5, 0, 7, "lost"),
        (2, None, None, None, 0, 1, ""),
        (2, 0, None, 0, 0, 2, ""),
    ]


def test_chat_long_chain_and_shared_line(spark):
    n = 70
    rows = [(9, 0, "user", "line number 0")] + [(9, i, "user", f"> line number {i - 1}\nline number {i}") for i in range(1, n)] + [(9, n + i, "user", "> line number 3\nsame words") for i in range(40)]
    got = {r["turn"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[i]["depth"] for i in range(n)] == list(range(n))
    assert all(got[n + i]["reply_to"] == 3 and got[n + i]["thread"] == 0 for i in range(40))
    assert sorted(r["position"] for r in got.values()) == list(range(1, n + 41))


def test_chat_is_native_and_keeps_every_message(spark):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet")
    out = chat.format_chats(table)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert out.count() == table.count()
    text = "".join(r["text"] for r in chat.chat_segments(out, 4).collect())
    assert text.count("<|end|>") == table.count()
    assert chat.format_chats(table.where("false")).count() == 0


def test_every_operator_is_registered():
    entry = importlib.import_module("__spark_entry__")
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names


def test_nearest_neighbours_of_repeated_rows(spark):
    r = np.random.default_rng(9)
    rows = [(i, [float(v) for v in r.standard_normal(8)]) for i in range(1, 90)]
    rows += [(100, rows[3][1]), (100, [float(v) for v in r.standard_normal(8)]), (200, rows[5][1]), (200, rows[5][1]), (21, rows[5][1]), (21, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    want = []
    for at in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, far)) if j != at][:10]
        want.append([(int(ids[at]), n + 1, int(ids[j]), round(float(far[j]), 9)) for n, j in enumerate(order)])
    for probes, deal, ask in ((None, 4000, 8000), (99, 7, 2)):
        got = {}
        for y in ann.nearest(df, lists=5, probes=probes or 5, deal=deal, ask=ask).orderBy("query_row", "rank").collect():
            got.setdefault(y["query_row"], []).append((y["query_id"], y["rank"], y["vec_id"], round(y["score"], 9)))
        assert sorted(got.values()) == sorted(want)


def brute_replies(rows):
    """Each message's original, by comparing every quoted unit with every earlier message."""
    import re

    level = lambda line: re.match(r"(?:[ \t]*>)*", line)[0].count(">")
    plain = lambda line: " ".join(re.sub(r"^(?:[ \t]*>)+", "", line).lower().split())

    def units(text):
        lines = [x for x in (text or "").split("\n")]
        kept = []
        for i, x in enumerate(lines):
            after = next((y for y in lines[i + 1 :] if y.replace(">", "").strip() or (">" in y and not lines[i + 1 :][lines[i + 1 :].index(y) + 1 :])), "")
            if re.fullmatch(r"(?:[ \t]*>)*[ \t]*on\b.{1,200}\bwrote:[ \t]*", x, re.I) and level(after) > 0:
                continue
            kept.append((level(x), plain(x)))
        out, run = set(), []
        for lv, words in [k for k in kept if k[1]] + [(None, "")]:
            if run and run[0][0] != lv:
                if len(run) > 1:
                    out.add((run[0][0], 1, " ".join(w for _, w in run)))
                run = []
            if lv is not None:
                out.add((lv, 0, words))
                run.append((lv, words))
        return out

    found = {}
    own = {(c, t): units(x) for c, t, _, x in rows}
    for (c, t), mine in own.items():
        weight = {}
        for lv, kind, words in mine:
            if lv:
                before = [t2 for (c2, t2), other in own.items() if c2 == c and t2 < t and (0, kind, words) in other]
                if before:
                    key = (lv, max(before))
                    weight[key] = weight.get(key, 0) + len(words)
        if weight:
            lv, origin = max(weight, key=lambda k: (-k[0], weight[k], k[1]))
            found[c, t] = origin
    return found


@pytest.mark.parametrize("seed", range(3))
def test_chat_links_are_those_of_a_brute_force_linker(spark, seed):
    import random

    r = random.Random(seed)
    said = ["the same line", "how  are you", "fine thanks", "see below", "On time as ever", "a > b"]
    rows = []
    for c in range(4):
        texts = []
        for turn in range(40):
            lines = []
            if texts and r.random() < 0.7:
                source = r.choice(texts).split("\n")
                some = source if r.random() < 0.5 else source[r.randrange(len(source)) :][: r.randrange(1, 4)]
                if r.random() < 0.5:
                    lines.append("On Monday, A wrote:")
                lines += [(">" if x.startswith(">") else "> ") + x for x in some]
            if r.random() < 0.2:
                lines.append("> nobody wrote this")
            lines += [r.choice(said) if r.random() < 0.4 else f"line {r.randrange(200)}" for _ in range(r.randrange(1, 4))]
            texts.append("\n".join(lines))
            rows.append((c, turn, "user", texts[-1]))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df).collect()
    want = brute_replies(rows)
    assert {(x["conv_id"], x["turn"]): x["reply_to"] for x in out if x["reply_to"] is not None} == want and len(want) > 60
    for x in out:
        thread, depth, at = x["turn"], 0, (x["conv_id"], x["turn"])
        while at in want:
            thread, depth, at = want[at], depth + 1, (at[0], want[at])
        assert (x["thread"], x["depth"]) == (thread, depth)
    for c in range(4):
        own = sorted((x for x in out if x["conv_id"] == c), key=lambda x: x["position"])
        assert [x["position"] for x in own] == list(range(1, 41))
        assert [(x["thread"], x["turn"]) for x in own] == sorted((x["thread"], x["turn"]) for x in own)
    texts = {(c, t): x for c, t, _, x in rows}
    for x in out:
        lines = texts[x["conv_id"], x["turn"]].split("\n")
        assert (x["quoted"] or "").split("\n") == ([y for y in lines if y.startswith(">")] or [""])


def test_chat_keeps_lines_that_only_look_like_attributions(spark):
    rows = [(1, 0, "user", "On Monday he wrote:\nx -> y"), (1, 1, "user", "On Monday he wrote:\n\n> x -> y\nyes"), (1, 2, "user", ">>> print(1)\nhelp")]
    got = {x["turn"]: x for x in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as position", "2 as `row`", "'q' as quoted")).collect()}
    assert [got[i]["body"] for i in range(3)] == ["On Monday he wrote:\nx -> y", "yes", "help"]
    assert got[1]["reply_to"] == 0 and got[2]["quoted"] == ">>> print(1)"


CHAT = "conv_id long, turn long, role string, text string"


def test_chat_survives_very_long_runs(spark):
    rows = [(1, 1, "a", "hello there"), (1, 2, "b", "On Monday x wrote:\n" + "\n" * 1_000_000 + "> hello there\nyes"), (1, 3, "c", ">" * 300_000 + " hello there\nno"), (1, 4, "d", "On Monday x wrote:\n" * 20_000 + "> hello there")]
    got = {r["turn"]: r for r in chat.format_chats(spark.createDataFrame(rows, CHAT)).collect()}
    assert [got[t]["reply_to"] for t in (1, 2, 3, 4)] == [None, 1, 1, 1]
    assert [got[t]["body"].strip() for t in (2, 3)] == ["yes", "no"]
    assert got[4]["body"].count("wrote:") == 19_999  # only the line right before the quote introduces it


def test_chat_query_links_on_a_table_with_quotes(spark, tmp_path):
    """The registered query, over a table whose even turns quote an earlier turn."""
    rows = []
    for conv in range(30):
        said = []
        for turn in range(1, 9):
            own = f"message {conv} {turn}\nsecond line of {turn}"
            rows.append((conv, turn, "user", f"On day {turn} you wrote:\n\n> message {conv} {turn - 1}\n> second line of {turn - 1}\n{own}" if turn % 2 == 0 else own))
            said.append(own)
    spark.createDataFrame(rows, CHAT).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.queries()["op7_chat_quotes"](spark, str(tmp_path)).collect()
    assert {(r["conv_id"], r["turn"]): r["reply_to"] for r in got} == {(c, t): t - 1 if t % 2 == 0 else None for c in range(30) for t in range(1, 9)}
    assert all(">" not in r["body"] and "wrote:" not in r["body"] for r in got)
    assert all((r["quoted"] is None) == (r["turn"] % 2 == 1) for r in got)
