import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import candidates as C
from ledgerloom.operators import evidence as E
from ledgerloom.operators import latest as L
from ledgerloom.operators import resolution as S


def window_of(sections, i, ahead, tail, budget):
    """The rule read out step by step, for one section."""
    size, head, concrete, major = zip(*sections)
    goal = None
    for j in range(i + 1, min(len(sections), i + ahead + 1)):
        if not head[i] or major[j]:
            break
        if concrete[j]:
            goal = j
            break
    if goal is None:
        return [i]
    out, used = [i], size[i]
    for j in range(i + 1, goal + 1):
        if used + size[j] <= budget:
            out.append(j)
            used += size[j]
    if out[-1] != goal:
        return [i, goal] if size[i] + size[goal] <= budget else [i]
    for j in range(goal + 1, min(len(sections), goal + tail + 1)):
        if major[j] or used + size[j] > budget:
            break
        out.append(j)
        used += size[j]
    return out


def test_context_windows_follow_the_rule(spark):
    rng = random.Random(5)
    docs = {d: [(rng.choice([5, 20, 40, 90]), rng.random() < 0.5, rng.random() < 0.25, rng.random() < 0.1) for _ in range(rng.randrange(1, 30))] for d in range(60)}
    rows = [(d, p, *s, "kept") for d, sections in docs.items() for p, s in enumerate(sections)]
    table = spark.createDataFrame(rows, "doc_id long, place int, size int, head boolean, concrete boolean, major boolean, related_note string")
    found = {(r.doc_id, r.place): r.related for r in E.context_windows(table, 6, 2, 100).collect()}
    assert found == {(d, p): window_of(sections, p, 6, 2, 100) for d, sections in docs.items() for p in range(len(sections))}
    assert E.context_windows(table.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, 0, 1, None, None, None), (1, 1, 1, None, None, None)], "doc_id long, place int, size int, head boolean, concrete boolean, major boolean")
    assert [r.related for r in E.context_windows(blank).orderBy("place").collect()] == [[0], [1]]


SECTION = "struct<place:int,size:int,tabular:boolean,anchors:int,strong:array<string>,weak:array<string>>"


def chosen(spark, sections, target, most):
    row = spark.createDataFrame([(sections,)], f"s array<{SECTION}>").select(E.budgeted_sections(F.col("s"), ["name", "date"], target, most).alias("r")).first().r
    return row.places, row.used, row.missing, row.rescued


def test_budgeted_sections(spark):
    plain = lambda place, size, tabular=False, anchors=0, strong=(), weak=(): (place, size, tabular, anchors, list(strong), list(weak))
    # an oversized first-ranked section is passed over while later ones fit
    assert chosen(spark, [plain(0, 10), plain(1, 200, True, 5), plain(2, 30, False, 1), plain(3, 40)], 100, 100) == ([0, 2, 3], 80, [], False)
    # exactly the budget fits
    assert chosen(spark, [plain(0, 60), plain(1, 40)], 100, 100) == ([0, 1], 100, [], False)
    # a reservation comes before the better-ranked table; strong before weak
    assert chosen(spark, [plain(0, 10), plain(1, 60, True, 9), plain(2, 50, weak=["name"]), plain(3, 50, strong=["name"])], 100, 100) == ([0, 3], 60, [], False)
    # one section that bears both categories is preferred
    assert chosen(spark, [plain(0, 10), plain(1, 40, True, 3, ["name"]), plain(2, 40, False, 0, ["name", "date"])], 60, 60) == ([0, 2], 50, [], False)
    # the larger budget is for categories that are still open, and only that
    assert chosen(spark, [plain(0, 50), plain(1, 70, False, 0, ["date"]), plain(2, 70)], 100, 130) == ([0, 1], 120, [], True)
    assert chosen(spark, [plain(0, 50), plain(1, 90, False, 0, ["date"])], 100, 130) == ([0], 50, ["date"], False)
    assert chosen(spark, [], 100, 130) == ([], 0, [], False)


def test_audit(spark):
    sections = spark.createDataFrame([(1, 0, "Name: Oak Hall. Oak is old."), (1, 1, "It ends in the mid")], "doc_id long, place int, text string")
    fields = [("a", 0, "Name: Oak Hall", "Hall", "Name"), ("b", 0, "Name: Oak Hall", "Oak", "Size"), ("c", None, "x", "x", ""), ("d", 7, "x", "x", ""), ("e", 0, " ", "x", ""), ("f", 0, "Elm", "Elm", ""), ("g", 1, "the mid", "", ""), ("h", 1, "the mid", "mid", None)]
    table = spark.createDataFrame([(1, *f) for f in fields], "doc_id long, field string, section int, quote string, value string, label string")
    found = [(r.field, r.issue) for r in E.audit_fields(table, sections).collect()]
    want = [("b", "no label"), ("b", "ambiguous"), ("c", "no reference"), ("d", "no section"), ("e", "no quote"), ("f", "quote not in section"), ("g", "value not in quote"), ("g", "truncated"), ("h", "truncated")]
    assert sorted(found) == sorted(want)
    assert sorted((r.field, r.issue) for r in E.audit_fields(table, sections, 2).collect()) == sorted(want[:2])


RECORD = "group_id string, numbers array<string>, name string, customer string"


def test_resolution_cascade(spark):
    projects = [(1, "g1", ["A-1"], "Oak", "Acme"), (2, "", ["A-2"], "Elm", "Acme"), (3, None, ["A-2"], "Fir", "Bolt"), (4, " ", [], "Ash", "Bolt"), (5, "g5", None, "Ash", "Crow"), (6, "g6", [], "Yew", "Crow"), (7, "g6", [], "Yew", "Dove")]
    cases = {
        "group": ("g1", [], "oak phase two", "ACME", "matched", 1),
        "group, other customer": ("g1", [], "Oak", "Bolt", "manual", None),
        "group, other numbers": ("g1", ["A-9"], "", "", "manual", None),
        "group, numbers point elsewhere": ("g5", ["A-2"], "Ash", "Crow", "manual", None),
        "group, name points elsewhere": ("g5", None, "", "", "matched", 5),
        "two projects in the group": ("g6", [], "Yew", "", "manual", None),
        "number": (None, [" a-1", ""], "Oaks", "acme!", "matched", 1),
        "number, other customer": (None, ["A-1"], "", "Bolt", "manual", None),
        "two projects of one number": ("g-none", ["A-2"], "", "", "manual", None),
        "same name and customer, other numbers": (None, ["A-7"], "Elm", "Acme", "manual", None),
        "same name and customer, no stored number": (None, ["A-7"], "Ash", "Bolt", "new", None),
        "name and customer": (None, [], "[x] Ash", "bolt", "matched", 4),
        "name alone": (None, [], "Ash", " ", "new", None),
        "nothing": (None, None, None, None, "new", None),
    }
    right = spark.createDataFrame(projects, f"project_id long, {RECORD}")
    left = spark.createDataFrame([(n, *c[:4], "more") for n, c in cases.items()], f"record_id string, {RECORD}, note string")
    assert {r.record_id: (r.status, r.project_id) for r in S.resolve(left, right).collect()} == {n: c[4:] for n, c in cases.items()}
    assert {r.status for r in S.resolve(left, right.limit(0)).collect()} == {"new"}
    assert S.resolve(left.limit(0), right).count() == 0


def test_batch_creates_one_project_per_key(spark):
    rows = [(1, None, ["B-2", "B-1"], "", ""), (2, None, ["b-1"], "", ""), (3, None, [], "Oak", "Acme"), (4, None, None, "oak phase one", "ACME"), (5, None, [], "", ""), (6, None, [], "", ""), (7, "g", [], "", ""), (8, "g", [], "", "")]
    out = S.confirm(spark.createDataFrame(rows, f"record_id long, {RECORD}"), spark.createDataFrame([], f"project_id long, {RECORD}"))
    found = {r.record_id: (r.outcome, r.creator) for r in out.collect()}
    assert found == {1: ("created", 1), 2: ("joined", 1), 3: ("created", 3), 4: ("joined", 3), 5: ("created", 5), 6: ("created", 6), 7: ("created", 7), 8: ("joined", 7)}


def test_content_strength_items_and_order(spark):
    kinds = [(r"(?m)^\d+\.\d+ (.+)$", 300), (r"note: ([^\n]+)", 200)]
    text = "note: a rather long remark that wins by length only\n1.2 short but numbered;\n1.3 also  numbered 7,"
    row = spark.createDataFrame([(text,), ("note: tiny",), ("",), (None,)], "t string")
    assert [r.v for r in row.select(X.best_of_kinds(F.col("t"), kinds).alias("v")).collect()] == ["short but numbered", None, None, None]
    pairs = [("all about the North Harbour Bridge works", "North Harbour Bridge repair", "strong"), ("the harbour has a bridge", "North Harbour Bridge", "medium"), ("harbour", "North Harbour", "weak"), ("sea", "North Harbour", "none"), ("", "", "none")]
    table = spark.createDataFrame(pairs, "text string, name string, want string")
    assert all(r.want == r.got for r in table.select("want", X.match_strength(F.col("text"), F.col("name")).alias("got")).collect())
    items = [("k", True, True, False, "2020", 1), ("k", True, False, True, "2019", 2), ("k", True, False, False, "2021", 3), ("k", True, False, False, "2020", 4), ("k", True, False, False, "2020", 5), ("k", False, False, False, "2000", 6), (" ", True, False, False, "", 7), ("n", None, None, None, None, 8)]
    best = L.preferred_item(spark.createDataFrame(items, "key string, completed boolean, duplicate boolean, hidden boolean, created_time string, ordinal int"), "key")
    assert {r.key: r.ordinal for r in best.collect()} == {"k": 4, "n": 8}
    found = [(1, "f", "A b", "u", "low", [], 0), (1, "f", "ab", "u", "high", [], 1), (2, "f", "x", "u", "high", ["y"], 2), (2, "e", "x", "u", "high", None, 3), (3, "f", "x", "u", None, None, 4)]
    table = spark.createDataFrame(found, "record_id int, field string, value string, url string, confidence string, flags array<string>, ordinal int")
    assert [r.ordinal for r in C.ordered_candidates(table).collect()] == [3, 2, 0, 4]


def test_vendor_rows(spark):
    from ledgerloom.sources.sheets import vendor_rows

    rows = [
        ("a", 1, "", " ", "Lost", "1", "", "r0"),  # nothing to continue, no link
        ("a", 2, "", "", "Kept", "", "http://x", "r1"),  # nothing to continue, but a link
        ("a", 3, "", None, "Kept", "7", "", "r2"),  # repeats the winner
        ("a", 4, "", "", "", "", "http://y", "r3"),  # only a link
        ("a", 5, "", "", "-", "8", "http://z", "r4"),  # continues, whatever its link
        ("a", 6, "", "", "", "", "", "r5"),  # nothing
        ("a", 7, "2", "Oak", "-", None, "", "r6"),
        ("a", 8, None, "", "One", "5", "", "r7"),
        ("a", 9, "", "", "Two", "5", "", "r8"),
        ("b", 1, "1", "", "W", "", "", "r9"),
    ]
    table = spark.createDataFrame(rows, "file string, row int, sequence string, title string, winner string, award_amount string, source_url string, `a.b` string")
    found = {(r.file, r.row): (r["a.b"], r.winner, r.award_amount, r.continuations) for r in vendor_rows(table, "file", "row").collect()}
    assert found == {("a", 2): ("r1", "Kept", "7", 1), ("a", 4): ("r3", "", "8", 1), ("a", 7): ("r6", "One; Two", "5", 2), ("b", 1): ("r9", "W", "", 0)}
    assert vendor_rows(table.limit(0), "file", "row").count() == 0


def test_applied_items_are_verified(spark):
    from ledgerloom.operators.review import verify_applied

    items = [("x", "applied", "p", ["d1", "d2"], "b1", "b1 d1 d2"), ("y", "applied", "p", ["d3"], "b1", "d3"), ("z", "applied", None, [], "b1", None), ("w", "failed", "p", ["d1"], "b1", ""), ("v", "applied", "q", ["d1"], "b1", "b1 d1")]
    table = spark.createDataFrame(items, "asset_id string, status string, project_id string, written_ids array<string>, batch string, hint string")
    assets, made = (spark.createDataFrame([(i,) for i in ids], "asset_id string") for ids in (["x", "x", "y", "v"], ["y", "z"]))
    documents = spark.createDataFrame([("p", "d2"), ("p", "d2"), ("p", "d9")], "project_id string, document_id string")
    found = {r.asset_id: (r.verified, r.rollback_complete, r.issues) for r in verify_applied(table, assets, documents, made).collect()}
    assert found == {"x": (True, True, []), "y": (True, False, ["hint incomplete"]), "z": (False, False, ["not found", "hint incomplete"]), "v": (False, True, ["not found"])}


def test_names_and_winners(spark):
    cases = [("new north harbour bridge", "North Harbour", "", True), ("harbour", "North Harbour", "", False), ("harbour", "Harbour", None, True), ("the citycouncil and the pier", "pier", "City Council", True), ("the citycouncil", "pier", "City Council", False), ("any", "12345", "", False), ("any", None, None, False), (None, "North Harbour", "City Council", False), ("any", "", "", False)]
    table = spark.createDataFrame(cases, "text string, name string, customer string, want boolean")
    assert all(r.want == r.got for r in table.select("want", X.relevant(F.col("text"), F.col("name"), F.col("customer")).alias("got")).collect())
    names = spark.createDataFrame([("North-Harbour 12345 (weakly) pier",), ("a b c d e f g h i j k l m n o p q",), ("ab",), (None,)], "n string").select(X.name_tokens(F.col("n"), ["weakly"]).alias("t")).collect()
    assert [r.t for r in names] == [["North", "Harbour"], ["abcdefghijklmnop"], [], []]
    winners = spark.createDataFrame([("winner: Bo. bidder: Acme Ltd",), ("winner: fee notice. bidder: x",), ("winner: " + "y" * 91,), (None,)], "t string")
    assert [r.w for r in winners.select(X.bounded_match(F.col("t"), [r"winner: ([^.]+)", r"bidder: ([^.]+)"], without=["notice"]).alias("w")).collect()] == ["Acme Ltd", None, None, None]


def brute_confirm(records, projects):
    """Records one after the other; what is created is seen by those that follow."""
    norm = lambda x: (x or "").strip().lower() or None
    stock = [("stored", pid, norm(g), {n.strip().upper() for n in ns or []} - {""}, norm(name), norm(c)) for pid, g, ns, name, c in projects]
    out = {}
    for rid, g, ns, name, c in sorted(records):
        g, ns, name, c = norm(g), {n.strip().upper() for n in ns or []} - {""}, norm(name), norm(c)
        by_group = [p for p in stock if g and p[2] == g]
        by_number = [p for p in stock if ns & p[3]]
        by_name = [p for p in stock if name and c and (p[4], p[5]) == (name, c)]
        named = by_number if ns else by_name
        ids = lambda ps: {p[:2] for p in ps}
        differ = lambda a, b: bool(a and b and a != b)
        if by_group:
            p = by_group[0]
            bad = len(ids(by_group)) > 1 or (ns and p[3] and not ns & p[3]) or differ(name, p[4]) or differ(c, p[5]) or (named and ids(named) != ids(by_group))
            status, hit = ("manual", None) if bad else ("matched", p)
        elif ns and not by_number:
            status, hit = ("manual" if any(p[3] for p in by_name) else "new"), None
        elif ns:
            bad = len(ids(by_number)) > 1 or any(differ(c, p[5]) for p in by_number)
            status, hit = ("manual", None) if bad else ("matched", by_number[0])
        else:
            status, hit = ("new", None) if not by_name else ("manual", None) if len(ids(by_name)) > 1 else ("matched", by_name[0])
        if status == "new":
            stock.append(("created", rid, g, ns, name, c))
            out[rid] = ("created", None, rid)
        elif status == "manual":
            out[rid] = ("manual", None, None)
        else:
            out[rid] = ("attached", hit[1], None) if hit[0] == "stored" else ("joined", None, hit[1])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_batch_confirm_is_the_sequential_replay(spark, seed):
    """Records with up to three numbers, groups and names that bridge what earlier records created; long chains of shared numbers."""
    r = random.Random(seed)
    some = lambda n: [f"N-{r.randrange(1, 40)}" for _ in range(r.randrange(n + 1))]
    make = lambda i: (i, r.choice([None, "", "g%d" % r.randrange(8)]), some(3), r.choice([None, "oak", "elm", "ash", "fir", "yew"]), r.choice([None, "acme", "bolt", "crow"]))
    records = [make(i) for i in r.sample(range(1000), 60)] + [(2000 + i, None, [f"C-{i}", f"C-{i + 1}"], None, None) for i in range(12)]
    projects = [(i, r.choice([None, "g%d" % r.randrange(8)]), some(2), r.choice([None, "oak", "elm"]), r.choice([None, "acme", "bolt"])) for i in range(6)]
    out = S.confirm(spark.createDataFrame(records, f"record_id long, {RECORD}"), spark.createDataFrame(projects, f"project_id long, {RECORD}"), suffixes=("phase",), few=0 if seed % 2 else 200_000)
    assert {x.record_id: (x.outcome, x.project_id, x.creator) for x in out.collect()} == brute_confirm(records, projects)
