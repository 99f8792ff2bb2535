"""Batches in which earlier rows count for later ones: who creates, decided in rounds over keys instead of row by row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import Scratch, ship


def first_creators(offers: DataFrame, listens: DataFrame, scratch: Scratch, few: int = 200_000) -> DataFrame:
    """``id`` of the rows that create when rows are taken by ascending id, and a row creates unless one that created before it offers a key it listens to.

    ``offers`` and ``listens`` are ``(id, key)``. A round decides every row that hears no undecided earlier one: it creates, and whoever hears
    it later does not. Each round is two aggregations by key and a join, so a key that very many rows share costs one row of each. Rounds
    go on until ``few`` rows ``(id, key)`` at most are undecided; these are taken one by one in a single task, whose size is bounded by that. Rows
    without keys are not given: they create.
    """
    ship(offers.sparkSession)
    offers, listens = scratch.materialise(offers.distinct(), "offers"), scratch.materialise(listens.distinct(), "listens")
    created = []
    while offers.count() + listens.count() > few:
        ids = offers.select("id").unionByName(listens.select("id")).distinct()
        still = offers.groupBy("key").agg(F.min("id").alias("first"))
        waiting = listens.join(still, "key").where(F.col("first") < F.col("id")).select("id").distinct()
        fresh = scratch.materialise(ids.join(waiting, "id", "left_anti"), "creators")
        created.append(fresh)
        heard = offers.join(fresh, "id", "left_semi").groupBy("key").agg(F.min("id").alias("first"))
        told = listens.join(heard, "key").where(F.col("first") < F.col("id")).select("id")
        decided = scratch.materialise(fresh.unionByName(told.distinct()), "decided")
        offers, listens = (scratch.materialise(x.join(decided, "id", "left_anti"), "undecided") for x in (offers, listens))
    tagged = offers.withColumn("offers", F.lit(True)).unionByName(listens.withColumn("offers", F.lit(False)))
    created.append(tagged.coalesce(1).sortWithinPartitions("id").mapInPandas(_one_by_one, tagged.select("id").schema))
    out = created[0]
    for more in created[1:]:
        out = out.unionByName(more)
    return out


def _one_by_one(frames):
    """The ids that create, of rows ``(id, key, offers)`` by ascending id."""
    taken: set[str] = set()
    last, gives, hears = None, [], []

    def creates() -> bool:
        if last is None or not taken.isdisjoint(hears):
            return False
        taken.update(gives)
        return True

    for frame in frames:
        found = []
        for row, key, offers in zip(frame["id"].tolist(), frame["key"].tolist(), frame["offers"].tolist(), strict=True):
            if row != last:
                if creates():
                    found.append(last)
                last, gives, hears = row, [], []
            (gives if offers else hears).append(key)
        yield pd.DataFrame({"id": found}, dtype=frame["id"].dtype)
    if creates():
        yield pd.DataFrame({"id": [last]})
