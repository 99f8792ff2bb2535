"""Self-enrichment against a walk over all records, one after the other."""

import random
import re

import pytest

from ledgerloom.operators import enrichment as E

SCHEMA = "record_id string, ordinal long, name string, customer string, text string, doc_type string, winner string, amount string"


def key(x):
    return re.sub(r"[\W]+", "", (x or "").lower())


def tokens(name):
    found = [w for w in re.split(r"[\s!-/:-@\[-`{-~+<>]+", name or "") if len(key(w)) >= 5 and not re.fullmatch(r"\d+", key(w))][:8]
    return found or ([key(name)[:16]] if len(key(name)) >= 16 else [])


def about(text, name, customer):
    whole, own, owner, words = key(text), key(name), key(customer), tokens(name)
    hits = sum(key(w) in whole for w in words)
    return (len(own) >= 16 and own[:16] in whole) or (hits > 0 and hits >= min(2, len(words))) or (len(owner) >= 6 and owner in whole and own[:12] in whole)


def brute(rows, types=("result",)):
    blank = lambda x: not (x or "").strip()
    out = {}
    for rid, at, name, customer, _, _, winner, amount in rows:
        donor = None
        if blank(winner) or blank(amount):
            for d in sorted(rows, key=lambda r: r[1]):
                if d[1] == at or d[5] not in types or (blank(d[6]) and blank(d[7])):
                    continue
                if about(" ".join(x for x in (d[2], d[3], d[4]) if x), name, customer) or about(name, d[2], None):
                    donor = d
                    break
        fill = lambda own, i, donor=donor: (donor[i] if donor and blank(own) and donor[i] is not None else own)
        out[rid] = (donor[0] if donor else None, fill(winner, 6), fill(amount, 7))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_first_related_result_gives_its_values(spark, seed):
    r = random.Random(seed)
    words = ["bridge", "school", "northern", "roof", "renovation", "lot", "2024", "stations", "12345", "stations"]
    name = lambda: r.choice([None, "", " ".join(r.choice(words) for _ in range(r.randrange(1, 6)))])
    rows = []
    for i in range(90):
        owner = r.choice([None, "City", "City of Ames", "Ames county", ""])
        rows.append((f"r{i}", (i * 41) % 97, name(), owner, name(), r.choice(["result", "result", "notice", None]), r.choice([None, "", "Acme", "Bolt"]), r.choice([None, " ", "12", "7"])))
    got = {x["record_id"]: (x["donor_id"], x["winner"], x["amount"]) for x in E.enrich_from_results(spark.createDataFrame(rows, SCHEMA), ["result"]).collect()}
    assert got == brute(rows)


def test_self_and_nothing(spark):
    rows = [("a", 1, "bridge renovation", None, None, "result", "Acme", None), ("b", 2, "bridge renovation", None, None, "notice", None, "1")]
    got = {x["record_id"]: (x["donor_id"], x["winner"], x["amount"], x["method"]) for x in E.enrich_from_results(spark.createDataFrame(rows, SCHEMA), ["result"]).collect()}
    assert got == {"a": (None, "Acme", None, None), "b": ("a", "Acme", "1", "local")}
    assert E.enrich_from_results(spark.createDataFrame([], SCHEMA), ["result"]).count() == 0
