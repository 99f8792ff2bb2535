"""Repository queries and ledger jobs on hand-written edge cases."""

import pytest

from ledgerloom.operators import ledger as G
from ledgerloom.operators import repository as R

from tests.test_jobs import by


@pytest.fixture(scope="module")
def projects(spark):
    rows = [("p1", "North Road", "City", "", "N-1", "2024", "", "", "2020", 1), ("p2", "Road", "Town", "North", "N-2", "", "2023", "", "2020", 2), ("p1", "Northern", "City", "", "N-1", "2025", "", "", "2020", 3), (" ", "Road", "x", "", "", "", "", "", "", 4), ("p3", "South", "Road builders", None, None, None, None, None, "2019", 5)]
    return spark.createDataFrame(rows, "project_id string, project_name string, customer string, winner string, project_number string, updated string, status_updated string, modified string, created string, ordinal long")


@pytest.fixture(scope="module")
def links(spark):
    return spark.createDataFrame([("p1", "d1", "contract", "2"), ("p1", "gone", "other", "1"), ("p2", "d1", "contract", "1"), ("none", "d2", "contract", "1")], "project_id string, document_id string, relation_type string, created_time string")


def test_search(projects, links):
    found = R.search_projects(projects, links, " ROAD ")
    assert [(r["project_id"], r["match"], r["n_links"]) for r in found.collect()] == [("p2", 0, 1), ("p3", 1, 0)]
    assert [r["project_id"] for r in R.search_projects(projects, links, "north").collect()] == ["p2", "p1"]
    assert [(r["project_id"], r["updated_time"]) for r in R.search_projects(projects, links, " ").collect()] == [("p1", "2025"), ("p2", "2023"), ("p3", "2019")]


def test_views(spark, projects, links):
    documents = spark.createDataFrame([("d1", 1), ("d2", 2)], "document_id string, ordinal long")
    view = R.project_documents(projects, links, documents).orderBy("project_id", "place").collect()
    assert [(r["project_id"], r["place"], r["document_id"], r["is_stored"]) for r in view] == [("p1", 1, "gone", False), ("p1", 2, "d1", True), ("p2", 1, "d1", True)]
    back = R.document_projects(projects, links, documents).orderBy("project_id").collect()
    assert [(r["document_id"], r["project_id"], r["is_first"]) for r in back] == [("d1", "p1", False), ("d1", "p2", True)]


def test_award_merge(spark):
    schema = "award_detail_id string, project_id string, package_id string, winner string, award_amount string, ordinal long"
    old = spark.createDataFrame([("a1", "p", "1", "W", "", 1)], schema)
    new = spark.createDataFrame([("a1", "p", "1", "X", "5", 2), ("a2", "p", "2", "Y", "6", 3), ("a3", "p", "1", "Z", "7", 4)], schema)
    once = R.merge_awards(old, new)
    assert by(once, "award_detail_id", "winner", "award_amount") == {"a1": ("W", "5"), "a2": ("Y", "6")}
    assert by(R.merge_awards(once, new), "award_detail_id", "winner", "award_amount") == by(once, "award_detail_id", "winner", "award_amount")


def test_asset_score(spark, projects):
    documents = spark.createDataFrame([("p1", "the bid notice"), ("p1", "x")], "project_id string, document_name string")
    records = spark.createDataFrame([("p1", "2024", " ", None)], "project_id string, publish_time string, open_time string, award_time string")
    got = by(R.asset_score(R.index(projects, "project_id"), documents, records, {"bid": "bid", "award": "award"}), "project_id", "score", "missing_kinds")
    assert got == {"p1": (46.7, ["award"]), "p2": (0.0, ["bid", "award"]), "p3": (0.0, ["bid", "award"])}


def test_ledger(spark):
    ledger = spark.createDataFrame([(1, "k1", "a.pdf; b.pdf", "c", "one", None, "n"), (2, "k2", "b.pdf", "", "two", "10", None), (3, "k3", None, "c", "three", "20", "n")], "row_id long, record_key string, source_note string, customer string, project string, amount string, name string")
    rows = [("r1", 1, "k3", "x", "q", "5", None), ("r2", None, "k3", "b.pdf", "q", "20", "m"), ("r3", None, "k9", "b.pdf", "q", "1", "m"), ("r4", None, "k8", "none", "two", "10", "z"), ("r5", None, "k7", "none", "q", "1", "v"), ("r6", None, "k7", "none", "q", "2", "w"), ("r7", None, "k3", None, None, "20", "n"), ("r8", None, "k6", "a.pdf", "q", None, None)]
    records = spark.createDataFrame(rows, "record_id string, row_id long, record_key string, source_file string, project string, amount string, name string").selectExpr("*", "'c' as customer")
    matched = by(G.match(records, ledger), "record_id", "method", "row_id")
    assert matched == {"r1": ("row", 1), "r2": ("key", 3), "r3": ("ambiguous", None), "r4": ("project", 2), "r5": ("new", None), "r6": ("new", None), "r7": ("key", 3), "r8": ("source", 1)}
    planned = G.plan(records, ledger, ["amount", "name"]).cache()
    assert by(planned, "record_id", "action") == {"r1": "update", "r2": "conflict", "r3": "ambiguous", "r4": "update", "r5": "insert", "r6": "joined", "r7": "unchanged", "r8": "unchanged"}
    after = by(G.upsert(planned, records, ledger, ["amount", "name"]), "row_id", "amount", "name")
    assert after == {1: ("5", "n"), 2: ("10", "z"), 3: ("20", "n"), 4: ("1", "v")}
    assert by(G.upsert(planned, records, ledger, ["amount", "name"], overwrite=["name"]), "row_id", "name")[3] == "m"
