"""Corrections and nested merges against plain loops."""

import random
import re

import pytest

from ledgerloom.operators import remediation as M

ACTIONS = "item string, ordinal long, field string, kind string, value string, operator string, expected long, action_id string"


def brute(actions, originals, fields):
    revision, ids, out = {}, {}, {}
    blank = lambda x: not (x or "").strip()
    for item, at, field, kind, value, operator, expected, action in sorted(actions, key=lambda a: a[1]):
        own = originals.get((item, field))
        effective = own if kind == M.VERIFY else (value or "").strip() if kind == M.CORRECT else None
        proper = item is not None and field in fields and not blank(operator) and expected is not None and expected >= 0 and bool(re.fullmatch(r"[\w-]{1,128}", action or ""))
        now = revision.get(item, 0)
        if not proper or kind not in (M.VERIFY, M.CORRECT):
            out[at] = ("invalid" if not proper else "replayed" if ids.get(action) == item else "conflict" if action in ids else "invalid", None, None)
        elif action in ids:
            out[at] = ("replayed" if ids[action] == item else "conflict", None, None)
        elif blank(effective):
            out[at] = ("invalid", None, None)
        elif expected != now:
            out[at] = ("stale", None, None)
        else:
            revision[item], ids[action] = now + 1, item
            out[at] = ("applied", now + 1, effective)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_replay_is_that_of_a_loop(spark, seed):
    """Stale, repeated, foreign and improper actions; ids that come back at the right revision."""
    r = random.Random(seed)
    originals = {("i%d" % i, f): r.choice([None, "", "old"]) for i in range(4) for f in ("name", "date")}
    actions, guess = [], {}
    for at in r.sample(range(1000), 120):
        item = r.choice(["i0", "i0", "i1", "i2", "i3", None])
        actions.append([item, at, r.choice(["name", "date", "date", "other"]), r.choice([M.VERIFY, M.CORRECT, M.CORRECT, "x"]), r.choice([None, " ", "new", "v"]), r.choice(["me", "me", "me", ""]), None, r.choice([f"a{r.randrange(40)}", f"b{at}", f"b{at}", "bad id"])])
    for a in sorted(actions, key=lambda a: a[1]):  # who acts mostly knows the revision
        a[6] = r.choice([guess.get(a[0], 0), guess.get(a[0], 0), max(0, guess.get(a[0], 0) - 1)])
        if brute([x for x in actions if x[6] is not None], originals, ("name", "date"))[a[1]][0] == "applied":
            guess[a[0]] = guess.get(a[0], 0) + 1
    table = spark.createDataFrame([(k[0], k[1], v) for k, v in originals.items()], "item string, field string, value string")
    got = M.replay_actions(spark.createDataFrame([tuple(a) for a in actions], ACTIONS), table, ["name", "date"])
    want = brute(actions, originals, ("name", "date"))
    assert {x.ordinal: (x.status, x.revision, x.effective) for x in got.collect()} == want
    last = {}
    for a in sorted(actions, key=lambda a: a[1]):
        if want[a[1]][0] == "applied":
            last[a[0], a[2]] = want[a[1]][2]
    values = M.effective_values(got, table)
    assert {(x.item, x.field): x.effective for x in values.collect()} == {**originals, **last}
    missing = {x.item: x.missing for x in M.open_issues(values, ["name", "date"]).collect()}
    full = {**originals, **last}
    assert missing == {f"i{i}": m for i in range(4) if (m := [f for f in ("name", "date") if not (full[f"i{i}", f] or "").strip()])}


def test_nothing_to_replay(spark):
    none = spark.createDataFrame([], ACTIONS)
    assert M.replay_actions(none, spark.createDataFrame([], "item string, field string, value string"), ["name"]).count() == 0


def test_histories_merge_by_entry(spark):
    schema = "item string, entry string, at int, state string, note string"
    old = spark.createDataFrame([("a", "1", 1, "open", "n1"), ("a", "", 2, "loose", None), ("a", "2", 3, "open", None), ("b", "1", 1, "x", None)], schema)
    new = spark.createDataFrame([("a", "2", 1, "done", "n2"), ("a", "1", 2, None, "n3"), ("a", None, 3, "loose", None), ("a", "3", 4, "open", None), ("c", "9", 1, "y", None)], schema)
    got = sorted((x.item, x.place, x.entry, x.state, x.note) for x in M.merge_histories(old, new, "item", "entry", "at").collect())
    assert [(i, p, e or "", s, n) for i, p, e, s, n in got] == [("a", 1, "1", "open", "n3"), ("a", 2, "", "loose", None), ("a", 3, "2", "done", "n2"), ("a", 4, "", "loose", None), ("a", 5, "3", "open", None), ("b", 1, "1", "x", None), ("c", 1, "9", "y", None)]
    items = lambda *rows: spark.createDataFrame(list(rows), "id string, state string, n int")
    merged = M.merge_items(items(("a", "old", 1), ("b", "old", None), (None, "stay", 1)), items(("a", "new", None), ("c", "new", 3), ("", "stay too", 2)), "id")
    assert sorted(map(tuple, merged.collect()), key=str) == sorted([("a", "new", 1), ("b", "old", None), ("c", "new", 3), (None, "stay", 1), ("", "stay too", 2)], key=str)


def test_snapshots_are_appended_once(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "source string, url string, at int, body string")
    got = M.append_snapshots(rows(("s", "u", 1, "old"), ("s", "u", 1, "old twice")), rows(("s", "u", 1, "new"), ("s", None, 2, "first"), ("s", "", 2, "second"), ("t", "u", 1, "other")), ["source", "url", "at"], "body")
    assert sorted(x.body for x in got.collect()) == ["first", "old", "old twice", "other"]
