"""Attempt leases against a replay of the whole input, whatever the micro-batches."""

import datetime
import os
import random
from collections import defaultdict

import pytest

from ledgerloom.plans.registry import QUERIES
from ledgerloom.plans import stream_queries  # noqa: F401  registers x2
from ledgerloom.session import ship
from ledgerloom.streaming import intake

START = datetime.datetime(2024, 1, 1)


def replay(rows):
    """Outcomes of (key, seconds, kind) by a clock that stops at the last row."""
    last, by_key, out = max(r[1] for r in rows), defaultdict(list), []
    for key, second, kind in rows:
        by_key[key].append((second, kind == "claim"))
    for key, steps in by_key.items():
        opened = None
        for second, claim in sorted(steps):
            if opened is not None and second > opened + 300:
                out.append((key, opened, "expired"))
                opened = None
            if claim:
                opened = second if opened is None else opened
            elif opened is not None:
                out.append((key, opened, "committed"))
                opened = None
        if opened is not None and last > opened + 300:
            out.append((key, opened, "expired"))
    return sorted(out)


def streamed(spark, tmp_path, batches):
    ship(spark)
    folder, schema = f"{tmp_path}/in", "k string, ts timestamp, kind string"
    frame = lambda rows: spark.createDataFrame([(k, START + datetime.timedelta(seconds=s), w) for k, s, w in rows], schema)
    whole = frame([r for b in batches for r in b])
    for i, part in enumerate([*map(frame, batches), intake.closing_row(whole, "k", "ts", "kind")]):
        part.coalesce(1).write.parquet(f"{folder}/n={i}")
        for name in os.listdir(f"{folder}/n={i}"):
            os.utime(f"{folder}/n={i}/{name}", (1_700_000_000 + 10 * i,) * 2)
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    intake.attempt_outcomes(read, "k", "ts", "kind").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    base = START.replace(tzinfo=datetime.timezone.utc).timestamp()
    return sorted((r["k"], r["opened"] - base, r["outcome"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())


@pytest.mark.parametrize("cuts", [1, 4])
def test_attempts_do_not_depend_on_batches(spark, tmp_path, cuts):
    rng = random.Random(5)
    rows = [("edge", 0, "claim"), ("edge", 300, "finish"), ("edge", 400, "claim"), ("edge", 401, "claim"), ("edge", 701, "claim"), ("edge", 1002, "finish"), ("edge", 8000, "claim")]
    rows += [(rng.choice("abc"), rng.randrange(8000), rng.choice(["claim", "finish"])) for _ in range(200)]
    want = replay(rows)
    assert {w[2] for w in want} == {"committed", "expired"} and ("edge", 400, "expired") in want and ("edge", 701, "expired") in want
    # rows come up to 500 s out of order, also over the edges of the batches
    rows.sort(key=lambda r: r[1] + rng.randrange(500))
    size = -(-len(rows) // cuts)
    assert streamed(spark, tmp_path, [rows[i : i + size] for i in range(0, len(rows), size)]) == want


def test_query_replays_the_table(spark):
    folder = "/root/testdata/sf0.001"
    base = START.replace(tzinfo=datetime.timezone.utc).timestamp()
    seconds = "cast(unix_micros(cast(ts AS timestamp)) AS double) / 1e6"
    events = spark.read.parquet(f"{folder}/events.parquet").selectExpr("cast(user_id AS string) AS k", f"{seconds} AS s", "if(event_type = 'click', 'claim', 'finish') AS kind")
    want = [(k, round(s - base, 6), o) for k, s, o in replay([tuple(r) for r in events.collect()])]
    got = sorted((r["user_id"], round(r["opened"] - base, 6), r["outcome"]) for r in QUERIES["x2_stream_attempts"](spark, folder).collect())
    assert got == want and any(o == "expired" for _, _, o in got)


def arriving(spark, folder, schema, batches):
    """A stream that takes one of the batches at a time, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/n={i}")
        for name in os.listdir(f"{folder}/n={i}"):
            os.utime(f"{folder}/n={i}/{name}", (1_700_000_000 + 10 * i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_first_sightings_over_batches(spark, tmp_path):
    ship(spark)
    batches = [[(1, "http://A/x/"), (2, "http://a/x"), (3, None)], [(4, " http://a/X"), (5, "http://b"), (6, None)], [(7, "http://B/"), (8, "http://c"), (9, "")]]
    pages = arriving(spark, f"{tmp_path}/in", "page_id long, url string", batches)
    intake.write_first_sightings(pages, "url", "page_id", f"{tmp_path}/out", f"{tmp_path}/state", 4).awaitTermination()
    assert sorted(r.page_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 3, 5, 8, 9]


def test_last_states_over_batches(spark, tmp_path):
    ship(spark)
    batches = [[(1, "a", "new"), (5, "a", "late"), (2, "b", "new")], [(3, "a", "early"), (4, "b", "done")], [(6, "c", "new"), (7, None, "lost")]]
    events = arriving(spark, f"{tmp_path}/in", "n long, k string, s string", batches)
    intake.write_last_states(events, "k", "s", "n", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert {r.k: (r.s, r.n) for r in intake.last_states(spark, "k", "s", "n", f"{tmp_path}/out").collect()} == {"a": ("late", 5), "b": ("done", 4), "c": ("new", 6), None: ("lost", 7)}
