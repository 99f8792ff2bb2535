"""The streaming operators over stored tables, run to the end with ``availableNow``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.plans.registry import query
from ledgerloom.session import scratch_path, ship
from ledgerloom.streaming import intake


def _stream(t, name):
    """A table's folder or file as a stream."""
    table = getattr(t, name)
    return t.spark.readStream.schema(table.schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.folder}/{name}.parquet" if _is_folder(t, name) else f"{t.folder}/{name}.parque[t]")


def _is_folder(t, name) -> bool:
    path = t.spark._jvm.org.apache.hadoop.fs.Path(f"{t.folder}/{name}.parquet")
    return path.getFileSystem(t.spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


@query("SELECT min(page_id) AS page_id FROM pages GROUP BY lower(rtrim(trim(url), '/'))")
def x1_first_sightings(t):
    out, state = scratch_path(t.spark, "sightings"), scratch_path(t.spark, "stream")
    intake.write_first_sightings(_stream(t, "pages"), "url", "page_id", out, state).awaitTermination()
    return t.spark.read.parquet(out).select("page_id")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def x3_last_states(t):
    out, state = scratch_path(t.spark, "states"), scratch_path(t.spark, "stream")
    intake.write_last_states(_stream(t, "events"), "user_id", "event_type", "event_id", out, state).awaitTermination()
    return intake.last_states(t.spark, "user_id", "event_type", "event_id", out).select("user_id", "event_type")


ATTEMPTS_SQL = """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, event_type = 'click' AS claim, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type = 'click') AS rn FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL),
n AS (SELECT *, min(rn) FILTER (NOT claim) OVER w AS finish, min(rn) FILTER (claim) OVER w AS claim_after, min(rn) FILTER (claim) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 300000001 FOLLOWING AND UNBOUNDED FOLLOWING) AS claim_past FROM e WINDOW w AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
s AS (SELECT n.user_id, n.rn, n.us, f.us <= n.us + 300000000 AS committed, CASE WHEN f.us <= n.us + 300000000 THEN f.claim_after ELSE n.claim_past END AS following FROM n LEFT JOIN n f ON f.user_id = n.user_id AND f.rn = n.finish WHERE n.claim),
r AS (SELECT * FROM s QUALIFY rn = min(rn) OVER (PARTITION BY user_id) UNION ALL SELECT s.* FROM r JOIN s ON s.user_id = r.user_id AND s.rn = r.following)
SELECT user_id::VARCHAR AS user_id, us / 1e6 AS opened, CASE WHEN committed THEN 'committed' ELSE 'expired' END AS outcome FROM r WHERE committed OR us + 300000000 < (SELECT max(epoch_us(ts)) FROM events)"""


@query(ATTEMPTS_SQL)
def x2_stream_attempts(t):
    ship(t.spark)
    out, state, end = scratch_path(t.spark, "attempts"), scratch_path(t.spark, "stream"), scratch_path(t.spark, "end")
    kinds = lambda events: events.select("user_id", "ts", F.when(F.col("event_type") == "click", "claim").otherwise("finish").alias("kind"))
    closing = intake.closing_row(kinds(t.events), "user_id", "ts", "kind")
    closing.where("false").write.parquet(end)
    attempts = kinds(_stream(t, "events")).unionByName(t.spark.readStream.schema(closing.schema).parquet(end))
    writer = intake.attempt_outcomes(attempts, "user_id", "ts", "kind").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True)
    writer.start().awaitTermination()
    closing.write.mode("append").parquet(end)  # the table is whole: what still waits is settled
    writer.start().awaitTermination()
    return t.spark.read.schema("user_id string, opened double, outcome string").parquet(out)


@query("WITH c AS (SELECT date_trunc('day', ts) AS d, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT strftime(d, '%Y-%m-%d') AS day, event_type, n FROM c WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def x4_stream_status_counts(t):
    out, state = scratch_path(t.spark, "counts"), scratch_path(t.spark, "stream")
    events = _stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    intake.status_counts(events, "ts", "event_type").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("day timestamp, event_type string, n long").parquet(out).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")
