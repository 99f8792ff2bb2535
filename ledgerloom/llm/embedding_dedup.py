"""Embedding near-duplicates: an exact metric range join on the unit sphere.

Vectors link when their labels are equal and not null and their cosine, in double precision, is at least ``threshold``. On unit
vectors that is a Euclidean radius ``r = sqrt(2 - 2 threshold)``.

1. Copies (equal label and components) become one numbered class with its number of members.
2. Each label takes ``pivots`` of its classes, by hash, and every class belongs to the cell of its nearest pivot. A class can only have
   partners in another cell if, by the triangle inequality, that cell's pivot is at most ``2 r`` farther away than its own, and if it lies
   within ``r`` of the plane between both pivots. Of such cells it is a guest of those with a smaller number, so every pair of
   neighbours meets once. The number of pivots follows the size of the label, up to ``max_pivots``.
3. Cells are compared independently. A cell with more than ``block`` rows is dealt out in blocks, and each two blocks are compared, so
   no task holds more than two. A comparison gives the number of links of each member that has some and a forest of links, never
   all pairs.
4. Components of the forests name each class by its smallest vec_id.

**Edge cases.** A vector that is null, empty, zero, or holds a null or non-finite component, or has no label, links with nothing
(``n_links`` 0, itself its component). Vectors of different lengths never link. A null vec_id links with nothing either. Rows that repeat a
vec_id are separate vectors that share a component. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators.components import connected_components, label_rows
from ledgerloom.session import Scratch, materialise, ship


def _stack(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable():
    v = F.col("vector")
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, cell: int = 1000, max_pivots: int = 48, block: int = 2000) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    ship(spark)
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("vector"))
    good = own.where(_usable())
    grouped = good.groupBy("label", "vector").agg(F.min("vec_id").alias("cid"), F.count("*").alias("members")).withColumn("size", F.size("vector"))
    # (class) names a class from here on; a vec_id that repeats with another vector is another class of the same (cid)
    classes, scratch = materialise(grouped.withColumn("class", F.monotonically_increasing_id()), "vector-classes"), Scratch(spark)
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    groups = classes.groupBy("label", "size").agg(F.count("*").alias("n"))
    wanted = groups.select("label", "size", F.least(F.lit(max_pivots), F.greatest(F.lit(1), F.ceil(F.col("n") / cell))).cast("int").alias("wanted"), F.greatest(F.lit(1), F.ceil(F.col("n") / 4000)).cast("int").alias("deals"))
    order = Window.partitionBy("label", "size").orderBy(F.xxhash64("class"), "class")
    pivot = classes.select("label", "size", "class", F.row_number().over(order).alias("place")).where(F.col("place") <= max_pivots).join(wanted, ["label", "size"]).where(F.col("place") <= F.col("wanted"))
    pivot = pivot.join(classes.select("class", F.col("vector").alias("mark")), "class")
    pivot = pivot.select(F.col("label").alias("pivot_label"), F.col("size").alias("pivot_size"), "place", "mark", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("pivot_deal"))
    dealt = classes.join(wanted, ["label", "size"]).withColumn("deal", F.pmod(F.xxhash64("class"), F.col("deals")).cast("int")).drop("wanted", "deals")

    def assign(rows: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(marks):
            return pd.DataFrame({"label": pd.Series(dtype="object"), "size": [], "cell": [], "own": [], "class": [], "cid": [], "members": [], "vector": []})
        marks = marks.sort_values("place")
        x, p = _unit(_stack(rows["vector"])), _unit(_stack(marks["mark"]))
        dot = x @ p.T
        far = np.sqrt(np.maximum(0, 2 - 2 * dot))
        nearest = dot.argmax(axis=1)
        gap = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))[nearest]
        ahead = dot[np.arange(len(x)), nearest][:, None] - dot
        # rounding is far below the slack in reach; between pivots in one place there is no plane
        near = (far <= far.min(axis=1)[:, None] + 2 * reach) & ((gap < 1e-6) | (ahead <= reach * gap)) & (np.arange(len(p)) <= nearest[:, None])
        row, at = np.nonzero(near)
        out = rows.iloc[row]
        return pd.DataFrame({"label": out["label"].values, "size": out["size"].values, "cell": marks["place"].values[at], "own": nearest[row] == at, "class": out["class"].values, "cid": out["cid"].values, "members": out["members"].values, "vector": out["vector"].values})

    kind = classes.schema["label"].dataType.simpleString()
    schema = f"label {kind}, size int, cell int, own boolean, class long, cid long, members long, vector array<double>"
    placed = scratch.materialise(dealt.groupBy("label", "size", "deal").cogroup(pivot.groupBy("pivot_label", "pivot_size", "pivot_deal")).applyInPandas(assign, schema), "vector-cells")
    extent = placed.groupBy("label", "size", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    spread = placed.join(extent, ["label", "size", "cell"]).withColumn("part", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    # a block meets itself and every other once
    pairs = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        part = rows["part"].to_numpy()
        at_a, at_b = np.flatnonzero(part == rows["i"].iloc[0]), np.flatnonzero(part == rows["j"].iloc[0])
        x = _stack(rows["vector"])
        x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares finite
        norm, own, cid, members = np.linalg.norm(x, axis=1), rows["own"].to_numpy(bool), rows["cid"].to_numpy(), rows["members"].to_numpy(np.float64)
        links, low, top = np.zeros(len(x)), cid.copy(), np.iinfo(np.int64).max
        if len(at_a) and len(at_b):
            cosine = x[at_a] @ x[at_b].T
            cosine /= norm[at_a][:, None]
            cosine /= norm[at_b][None, :]
            close = cosine >= threshold
            del cosine
            close &= own[at_a][:, None] | own[at_b][None, :]
            if rows["i"].iloc[0] == rows["j"].iloc[0]:
                close &= np.arange(len(at_a))[:, None] < np.arange(len(at_b))[None, :]
            some_a, some_b = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
            if len(some_a):
                close = close[np.ix_(some_a, some_b)]
                at_a, at_b = at_a[some_a], at_b[some_b]
                weight = close.astype(np.float64)
                np.add.at(links, at_a, weight @ members[at_b])
                np.add.at(links, at_b, weight.T @ members[at_a])
                # the smallest id that each row reaches inside these two blocks
                while True:
                    before = low.copy()
                    low[at_a] = np.minimum(low[at_a], np.where(close, low[at_b][None, :], top).min(axis=1))
                    low[at_b] = np.minimum(low[at_b], np.where(close, low[at_a][:, None], top).min(axis=0))
                    if (low == before).all():
                        break
        found = np.flatnonzero(links > 0)
        return pd.DataFrame({"class": rows["class"].to_numpy()[found], "cid": cid[found], "other": low[found], "links": links[found].astype(np.int64)})

    found = materialise(pairs.groupBy("label", "size", "cell", "i", "j").applyInPandas(compare, "class long, cid long, other long, links long"), "vector-links")
    scratch.clear()
    component = connected_components(found.where("cid <> other").select("cid", "other").distinct(), "cid", "other")
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    named = classes.join(counts, "class", "left").join(component.select(F.col("id").alias("cid"), "component"), "cid", "left")
    named = named.select("label", "vector", "members", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("links"), F.coalesce("component", "cid").alias("component"))
    known = label_rows(good, named, ["label", "vector"], "members").select("vec_id", "links", "component")
    rest = own.where(~F.coalesce(_usable(), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component"))
    return known.unionByName(rest).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"))
