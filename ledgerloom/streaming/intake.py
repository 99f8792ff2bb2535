"""Structured Streaming forms of the intake steps.

Each takes a streaming DataFrame with an event time; run with ``availableNow`` over stored files they give the batch results.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.functions.text import url_key
from ledgerloom.operators.latest import one_per_key

LEASE_SECONDS, LATE_SECONDS = 300, 600


def first_sightings(pages: DataFrame, url: str, time: str, horizon: str = "7 days") -> DataFrame:
    """One row per URL key within the horizon: state is dropped once the watermark has passed it, so a key may come again later."""
    keyed = pages.withColumn("source_key", url_key(F.col(url)))
    return keyed.withWatermark(time, horizon).dropDuplicatesWithinWatermark(["source_key"])


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_first_sightings(pages: DataFrame, url: str, ordinal: str, path: str, checkpoint: str, buckets: int = 64):
    """Exact for ever: each micro-batch keeps the keys that the target does not have. Returns the started query.

    The target is partitioned by a hash of the key (``key_bucket``), so a micro-batch reads only the buckets that its keys fall in. A missing URL
    is one key of its own.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keyed = batch.withColumn("source_key", url_key(F.col(url)))
        first = one_per_key(keyed, ["source_key"], F.col(ordinal)).withColumn("key_bucket", F.pmod(F.xxhash64("source_key"), F.lit(buckets)).cast("int"))
        if _exists(spark, path):
            touched = [r["key_bucket"] for r in first.select("key_bucket").distinct().collect()]  # at most ``buckets``
            known = spark.read.parquet(path).where(F.col("key_bucket").isin(touched)).select(F.col("source_key").alias("_known"))
            # a batch that is run again finds its own rows and adds nothing
            first = first.join(known, F.col("source_key").eqNullSafe(F.col("_known")), "left_anti")
        first.repartition("key_bucket").write.mode("append").partitionBy("key_bucket").parquet(path)

    return pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_counts(events: DataFrame, time: str, status: str, late: str = "1 day") -> DataFrame:
    """Rows of each status per day; days are final once the watermark has passed them."""
    return events.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), status).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), status, "n")


def attempt_outcomes(attempts: DataFrame, key: str, time: str, kind: str) -> DataFrame:
    """State machine of attempts: ``claim`` opens a lease, ``finish`` within ``LEASE_SECONDS`` commits it, and a lease that event time overtakes is
    ``expired``. A claim while a lease is open is refused, and a finish without an open lease (a late one has lost it) changes nothing; at one
    moment finishes come first. ``key`` is text; ``kind`` holds claim or finish, other rows only move event time.

    A row counts once no earlier one of its key can come (``LATE_SECONDS``), and until then waits in the state, so the outcomes do not depend on
    how the input is cut into batches. ``closing_row`` settles what waits at the end of a finished input.
    """
    lease, late = LEASE_SECONDS * 1_000_000, LATE_SECONDS * 1000

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        opened, waiting = state.get if state.exists else (None, [])
        watermark = state.getCurrentWatermarkMs()
        horizon, waiting = watermark * 1000, list(waiting)
        if not state.hasTimedOut:
            for rows in frames:
                rows = rows[(rows["_micros"] > watermark * 1000) & rows[kind].isin(["claim", "finish"])]
                waiting += (rows["_micros"].astype("int64") * 2 + (rows[kind] == "claim")).tolist()
        waiting.sort()  # by time, finishes first
        if waiting:
            horizon = max(horizon, (waiting[-1] // 2000 - late) * 1000)  # what the watermark will be at least
        due = bisect_right(waiting, horizon * 2 + 1)
        for code in waiting[:due]:
            micros, claim = divmod(code, 2)
            if opened is not None and micros > opened + lease:
                out.append((name[0], opened / 1e6, "expired"))
                opened = None
            if claim:
                opened = micros if opened is None else opened
            elif opened is not None:
                out.append((name[0], opened / 1e6, "committed"))
                opened = None
        waiting = waiting[due:]
        if opened is not None and opened + lease < horizon:
            out.append((name[0], opened / 1e6, "expired"))
            opened = None
        nearest = [code // 2 for code in waiting[:1]] + ([opened + lease] if opened is not None else [])
        if nearest:
            state.update((opened, waiting))
            state.setTimeoutTimestamp(max(min(nearest) // 1000, watermark + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, "opened", "outcome"])

    marked = attempts.select(F.col(key).cast("string").alias(key), F.col(time).cast("timestamp").alias(time), kind).withWatermark(time, f"{LATE_SECONDS} seconds")
    marked = marked.withColumn("_micros", F.unix_micros(time))
    return marked.groupBy(key).applyInPandasWithState(step, f"{key} string, opened double, outcome string", "opened long, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def closing_row(attempts: DataFrame, key: str, time: str, kind: str) -> DataFrame:
    """The row that ends a finished input of ``attempt_outcomes``: it moves event time just past the last attempt and is none itself."""
    shift = F.make_dt_interval(secs=F.lit(LATE_SECONDS + 0.001))
    return attempts.agg((F.max(time) + shift).alias(time)).select(F.lit(None).cast(attempts.schema[key].dataType).alias(key), time, F.lit(None).cast("string").alias(kind))


def write_last_states(events: DataFrame, key: str, status: str, ordinal: str, path: str, checkpoint: str):
    """Last status of each key: a micro-batch adds the last rows of its own keys, and nothing is read or rewritten. Returns the started query.

    ``last_states`` reads the result; a batch that is run again replaces its own rows.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(status, ordinal).alias(status), F.max(ordinal).alias(ordinal))
        last.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_states(spark: SparkSession, key: str, status: str, ordinal: str, path: str) -> DataFrame:
    """The last status of each key over all that ``write_last_states`` has added, by ordinal, whatever the batches."""
    added = spark.read.option("basePath", path).parquet(path)
    return added.groupBy(key).agg(F.max_by(status, F.struct(ordinal, "batch")).alias(status), F.max(ordinal).alias(ordinal))
