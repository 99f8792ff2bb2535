"""Approximate nearest neighbours: inverted lists searched by an adaptive dimension scan.

**Index.** Centroids are trained on a bounded sample (``sample`` rows, the smallest hashes of vec_id); every vector goes to the list of
its nearest centroid. Vectors are rotated by one random orthogonal matrix, so that any leading columns give an unbiased estimate
of a distance.

**Search.** A query probes the ``probes`` lists whose centroids are nearest (by default as many as hold ``target`` of the
neighbours within the sample), and more until they hold ``k`` candidates. Its nearest list is searched first; the distance of the k-th
best there bounds the search of the other lists. Inside a list the
rotated columns are read in blocks of ``columns``: after ``d`` of ``D`` columns a candidate whose partial squared distance exceeds
``d / D * (1 + epsilon / sqrt(d))**2`` times the squared distance of the k-th best is abandoned: under the hypothesis that it is nearer,
so large a partial distance is very unlikely. Survivors get their exact distance from the original vectors, in double precision.
Lists with more than ``deal`` rows or ``ask`` queries are dealt to several tasks; each returns at most ``k`` rows for a query.

**Edge cases.** Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those whose length is not
the most frequent one (the greater, in a tie), or whose vec_id is null. With fewer than ``k`` candidates all are returned. Equal distances go to
the smaller vec_id. Rows are told apart by number (``query_row``): query rows that repeat a vec_id are separate queries, each ranked from 1, and
a row that repeats the query's vec_id or vector is a candidate like any other. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.session import materialise, ship


def _train(sample: np.ndarray, lists: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    centres = sample[np.random.default_rng(seed).permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        nearest = _nearest(sample, centres)
        for i in range(len(centres)):
            if (own := nearest == i).any():
                centres[i] = sample[own].mean(axis=0)
    return centres


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return _squared(x, centres).argmin(axis=1)


def _probes(sample: np.ndarray, centres: np.ndarray, k: int, target: float, queries: int = 200, seed: int = 5) -> int:
    """How many lists hold ``target`` of the ``k`` nearest of the sample's own rows. Neighbours in a sample are farther away than in
    all rows, so this errs towards more lists."""
    if len(sample) < 2:
        return 1
    chosen = np.random.default_rng(seed).permutation(len(sample))[:queries]
    far = _squared(sample[chosen], sample)
    far[np.arange(len(chosen)), chosen] = np.inf
    near = np.argpartition(far, min(k, len(sample) - 1) - 1, axis=1)[:, : min(k, len(sample) - 1)]
    order = np.argsort(_squared(sample[chosen], centres), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(centres)), order.shape), axis=1)
    needed = np.sort(np.take_along_axis(place, _nearest(sample, centres)[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) + 1


def rotation(size: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def scan(query: np.ndarray, turned_query: np.ndarray, own: int, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, turned: np.ndarray, k: int, columns: int, epsilon: float, bound: float = np.inf, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``k`` nearest of one list found for one query, nearest first: their places and exact distances, and how many components
    were read. ``bound`` is a distance within which ``k`` others are known."""
    size, read = len(query), 0
    best_at, best = np.zeros(0, np.int64), np.zeros(0)
    first = 8 * k if np.isinf(bound) else chunk
    cuts = [0, *range(min(first, len(ids)), len(ids), chunk), len(ids)] if len(ids) else [0]
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        alive = np.arange(begin, end)
        alive = alive[rows[alive] != own]
        limit = min(bound, best[-1] if len(best) == k else np.inf) ** 2
        partial = np.zeros(len(alive))
        for at in range(0, size, columns) if np.isfinite(limit) else ():
            d = min(at + columns, size)
            difference = turned[alive, at:d] - turned_query[at:d]
            read += difference.size
            partial = partial + (difference * difference).sum(axis=1)
            # the last block completes the distance itself, up to rounding
            most = limit * d / size * (1 + epsilon / np.sqrt(d)) ** 2 if d < size else limit * (1 + 1e-9)
            keep = partial <= most + 1e-12
            alive, partial = alive[keep], partial[keep]
        difference = vectors[alive] - query
        read += difference.size
        exact = np.sqrt((difference * difference).sum(axis=1))
        best_at, best = np.concatenate([best_at, alive]), np.concatenate([best, exact])
        order = np.lexsort((rows[best_at], ids[best_at], best))[:k]
        best_at, best = best_at[order], best[order]
    return best_at, best, read


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, lists: int | None = None, probes: int | None = None, target: float = 0.97, sample: int = 20_000, columns: int = 16, epsilon: float = 2.1, deal: int = 4000, ask: int = 8000) -> DataFrame:
    """``(query_id, rank, vec_id, score, query_row)`` for the rows whose vec_id is divisible by ``every``, searched among all other rows."""
    spark = vectors.sparkSession
    ship(spark)
    v = F.col("vector")
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    good = own.where(F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    common = good.groupBy(F.size(v).alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, query_row long")
    size, n = common["size"], common["n"]
    good = good.where(F.size(v) == size)
    drawn = np.array([r["vector"] for r in good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()], np.float64)
    lists = lists or max(1, min(4096, len(drawn), round(n**0.5 / 2)))
    trained = _train(drawn, lists)
    probes = probes or _probes(drawn, trained, k, target)
    model = spark.sparkContext.broadcast((trained, rotation(size)))  # at most 4096 centroids

    def to_list(batches):
        centres, _ = model.value
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_nearest(x, centres).astype(np.int32))], ["vec_id", "vector", "list"])

    index = good.select("vec_id", "vector").mapInArrow(to_list, "vec_id long, vector array<double>, list int")
    index = materialise(index.withColumn("row", F.monotonically_increasing_id()), "ann-index")
    held = {r["list"]: r["count"] for r in index.groupBy("list").count().collect()}  # one row for each list
    extent = np.array([held.get(i, 0) for i in range(lists)])

    def probe(batches):
        centres, _ = model.value
        for batch in batches:
            if batch.num_rows:
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                order = np.argsort(_squared(x, centres), axis=1, kind="stable")
                order = [[int(i) for i in row if extent[i]] for row in order]
                chosen = [row[: max(probes, 1 + int(np.searchsorted(np.cumsum(extent[row]), k + 1)))] for row in order]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chosen, pa.list_(pa.int32()))], ["row", "vec_id", "vector", "lists"])

    asked = materialise(index.where(F.col("vec_id") % every == 0).select("row", "vec_id", "vector").mapInArrow(probe, "row long, vec_id long, vector array<double>, lists array<int>"), "ann-queries")

    def search(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"query_row": [], "query_id": [], "vec_id": [], "row": [], "score": []}
        if len(rows) and len(queries):
            turn = model.value[1]
            rows = rows.sort_values("row")
            number, ids, x = rows["row"].to_numpy(), rows["vec_id"].to_numpy(), np.stack(rows["vector"].to_numpy())
            asking = np.stack(queries["vector"].to_numpy())
            turned, turned_asking = x @ turn, asking @ turn
            for i, (q, name, bound) in enumerate(zip(queries["row"], queries["vec_id"], queries["bound"], strict=True)):
                near, far, _ = scan(asking[i], turned_asking[i], q, number, ids, x, turned, k, columns, epsilon, bound)
                out["query_row"] += [q] * len(near)
                out["query_id"] += [name] * len(near)
                out["vec_id"] += ids[near].tolist()
                out["row"] += number[near].tolist()
                out["score"] += far.tolist()
        return pd.DataFrame(out).astype({n: "float64" if n == "score" else "int64" for n in out})

    order = Window.partitionBy("query_row").orderBy("score", "vec_id", "row")

    def searched(queries: DataFrame) -> DataFrame:
        """The best of what each (list, deal, ask) finds; ``queries`` has row, vec_id, vector, bound and list."""
        wanted = {r["list"]: r["count"] for r in queries.groupBy("list").count().collect()}  # one row for each list
        sizes = spark.createDataFrame([(i, int(-(-extent[i] // deal)), int(-(-x // ask))) for i, x in wanted.items()], "list int, deals int, asks int")
        q = queries.join(F.broadcast(sizes), "list").withColumn("ask", F.pmod(F.xxhash64("row"), F.col("asks")).cast("int")).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
        r = index.join(F.broadcast(sizes), "list").withColumn("deal", F.pmod(F.xxhash64("row"), F.col("deals")).cast("int")).withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
        key = ["list", "deal", "ask"]
        found = q.select(*key, "row", "vec_id", "vector", "bound").groupBy(*key).cogroup(r.select(*key, "row", "vec_id", "vector").groupBy(*key)).applyInPandas(search, "query_row long, query_id long, vec_id long, row long, score double")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    if asked.limit(1).count() == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, query_row long")
    nearby = materialise(searched(asked.select("row", "vec_id", "vector", F.lit(float("inf")).alias("bound"), F.col("lists")[0].alias("list"))), "ann-nearby")
    bounds = nearby.where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").alias("bound"))
    others = asked.where(F.size("lists") > 1).join(bounds, "row", "left").select("row", "vec_id", "vector", F.coalesce("bound", F.lit(float("inf"))).alias("bound"), F.explode(F.slice("lists", 2, lists)).alias("list"))
    both = nearby.drop("rank").unionByName(searched(others).drop("rank")) if lists > 1 else nearby.drop("rank")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_row")
