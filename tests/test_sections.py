"""Sections, neighbours of labels and evidence ranks against plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import latest as L
from ledgerloom.operators import sections as S
from ledgerloom.operators import tables as T

ELEMENTS = "doc_id long, place long, kind string, text string"


def cut(text, most):
    out, now, used = [], "", 0
    for c in text:
        size = len(c.encode())
        if now and used + size > most:
            out.append(now)
            now, used = "", 0
        now, used = now + c, used + size
    return [*out, now] if now else out


def brute_sections(rows, most):
    """Element by element: a title, or a piece that does not fit, begins a section."""
    out = []
    for doc in {r[0] for r in rows}:
        section, used, seen, some = 0, 0, set(), False
        for _, place, kind, text in sorted((r for r in rows if r[0] == doc), key=lambda r: (r[1] is not None, r[1] or 0)):
            kind, text = kind or "NarrativeText", (text or "").strip()
            for i, piece in enumerate(cut(text, most)):
                size = len(piece.encode())
                if some and ((kind == "Title" and i == 0) or used + size > most):
                    section, used, seen = section + 1, 0, set()
                some, used = True, used + size
                if (kind, piece.strip()) not in seen:
                    out.append((doc, place, i, kind, piece, section))
                seen.add((kind, piece.strip()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_sections_are_those_of_a_loop(spark, seed):
    r = random.Random(seed)
    rows = []
    for doc in range(12):
        for place in range(r.randrange(12)):
            text = r.choice([None, "", "  ", "same", "same", "x" * r.randrange(1, 90), "é" * r.randrange(1, 60), "日本語😀" * r.randrange(1, 30), "a\nb " * r.randrange(1, 9)])
            rows.append((doc, place, r.choice([None, "Title", "Table", "NarrativeText"]), text))
    rows += [(99, 0, "Title", "t" * 64), (99, 1, "Title", "u" * 32), (99, 2, None, "v" * 32), (99, 3, None, "w"), (98, None, None, "first"), (98, 0, None, "second")]
    got = S.build_sections(spark.createDataFrame([(*x, "k", 1) for x in rows], f"{ELEMENTS}, run string, size int"), 64)
    assert sorted(map(tuple, got.select("doc_id", "place", "piece", "kind", "text", "section").collect()), key=str) == brute_sections(rows, 64)


def test_sections_of_nothing_and_of_very_many_lines(spark):
    assert S.build_sections(spark.createDataFrame([], ELEMENTS)).count() == 0
    began = time.time()
    lines = spark.range(200_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("place"), F.lit(None).cast("string").alias("kind"), F.format_string("line %07d %s", "id", F.repeat(F.lit("x"), 40)).alias("text"))
    one = S.build_sections(lines).agg(F.max("section").alias("m"), F.count("*").alias("n")).first()
    assert one["n"] == 200_000 and one["m"] == (200_000 - 1) // (2048 // 53)
    assert time.time() - began < 120
    long = spark.createDataFrame([(1, 0, None, "é" * 3_000_000 + "x")], ELEMENTS)
    assert S.build_sections(long).agg(F.max("section"), F.max(F.octet_length("text"))).first()[:] == (6_000_001 // 2048, 2048)


def test_neighbours_of_labels(spark):
    fields = {"name": "name|project", "date": "date"}
    lines = [(1, 0, "", "1. Name"), (1, 1, "", "North road"), (1, 2, "", "Date"), (1, 3, "", "soon"), (1, 4, "", "date"), (1, 5, "", "2024-01-02"), (1, 6, "", "name"), (1, 7, "", "Date"), (1, 8, "", None), (2, 0, "", "project"), (2, 1, "", "2024 x"), (3, 0, "", "name")]
    cells = [(1, 0, 0, 0, "PROJECT"), (1, 0, 0, 1, "Bridge"), (1, 0, 0, 2, "date"), (1, 0, 0, 4, "2024-05-06"), (1, 0, 1, 0, "date"), (1, 0, 1, 1, "2024-05-06"), (1, 1, 0, 2, "name")]
    got = S.adjacent_values(spark.createDataFrame(lines, ELEMENTS), spark.createDataFrame(cells, "doc_id long, table_index int, row int, col int, text string"), fields, {"date": r"\d{4}"}, {"name": r"^\d{4}"})
    want = {(1, "name", 0, "line", "North road"), (1, "date", 4, "line", "2024-01-02"), (1, "name", 0, "cell", "Bridge"), (1, "date", 1, "cell", "2024-05-06")}
    assert {(x.doc_id, x.field, x.place, x.source, x.value) for x in got.collect()} == want


def test_evidence_ranks(spark):
    rows = [(1, 0, 0, "Title", "Budget and scope"), (1, 1, 0, None, "the budget is 500"), (1, 1, 1, None, "scope"), (1, 2, 0, None, "budget of the year"), (1, 3, 0, "Table", "scope follows"), (1, 4, 0, None, "600 pieces"), (2, 0, 0, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, section long, place long, kind string, text string")
    ranks = S.evidence_ranks(table, {"budget": ("(?i)budget", r"\d"), "scope": ("(?i)scope", r"pieces")})
    got = {(x.category, x.section): (x.strength, x.heading, x.dedicated, x.hits, x.rank) for x in ranks.collect()}
    assert got == {("budget", 0): (1, True, False, 1, 2), ("budget", 1): (0, False, False, 1, 1), ("budget", 2): (2, False, True, 1, 3), ("scope", 0): (1, True, False, 1, 2), ("scope", 1): (2, False, False, 1, 3), ("scope", 3): (0, False, True, 1, 1)}
    assert [(x.doc_id, x.missing) for x in S.coverage(ranks, ["budget", "scope", "date"]).collect()] == [(1, ["date"])]
    assert S.evidence_ranks(table.where("false"), {"budget": ("a", "b")}).count() == 0


def test_convergence_keeps_the_preferred_item(spark):
    rows = [(1, "u", False, False, False, "1"), (2, "u", True, False, True, "2"), (3, "u", True, False, False, "3"), (4, "v", None, None, None, None), (5, None, True, False, False, ""), (6, " ", True, False, False, "")]
    items = spark.createDataFrame(rows, "id long, k string, completed boolean, duplicate boolean, hidden boolean, created_time string").withColumn("ordinal", F.col("id"))
    got = {x.id: (x.hidden, x.duplicate_of, x.attempts) for x in L.converge(items, "k", "id").collect()}
    assert {i: got[i] for i in (1, 2, 3, 4)} == {1: (True, 3, 3), 2: (True, 3, 3), 3: (False, None, 3), 4: (False, None, 1)}
    assert got[5][:2] == got[6][:2] == (False, None)


def test_absolute_links(spark):
    html = '<a href="/a">one</a><a href="b.html">two</a><a href="//h/c">three</a><a href="mailto:x@y">four</a><a href="HTTP://z/">five</a><a href="/a">again</a><a href="/d"> </a>'
    row = spark.createDataFrame([(html, "https://s.org/dir/page?q=/x"), (None, None)], "html string, url string")
    got = row.select(X.links_of(F.col("html"), F.col("url"), 3, 4).alias("l")).collect()
    assert [x["href"] for x in got[0]["l"]] == ["https://s.org/a", "https://s.org/dir/b.html", "https://h/c", "mailto:x@y"]
    assert not got[1]["l"]


def test_budget_over_parts(spark):
    r = random.Random(4)
    rows = [(i, r.randrange(0, 4), r.random()) for i in range(500)]
    got = T.within_budget(spark.createDataFrame(rows, "id long, size long, w double"), [F.desc("w"), F.col("id")], "size", 100)
    want, spent = {}, 0
    for i, size, _ in sorted(rows, key=lambda x: -x[2]):
        spent += size
        if spent <= 100:
            want[i] = spent
    assert {x.id: x.spent for x in got.collect()} == want
