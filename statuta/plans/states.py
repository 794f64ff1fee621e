"""Queries over streams with state."""

from __future__ import annotations

from pyspark.sql import functions as F

from statuta.plans.catalog import _drained, _stream, query
from statuta.streaming import keyed


@query(
    "q80",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
b AS (SELECT user_id, event_id, t, n, true AS accepted, 2000000::BIGINT AS room FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.event_id, e.t, e.n, least(3000000, b.room + (e.t - b.t) // 43200) >= 1000000,
least(3000000, b.room + (e.t - b.t) // 43200) - CASE WHEN least(3000000, b.room + (e.t - b.t) // 43200) >= 1000000 THEN 1000000 ELSE 0 END FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1)
SELECT event_id AS id, accepted, room AS "left" FROM b""",
)
def buckets_of_clients(spark, sf_dir):
    """A token bucket for each user: three tokens, and one more in half a day. Times are counted in steps of 43200 microseconds."""
    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _drained(spark, keyed.token_bucket(events, "user_id", "ts", "event_id", rate=1, burst=3, step=43_200), "buckets")


@query(
    "q81",
    """SELECT user_id AS document, event_id AS "row", CASE WHEN n = 1 THEN 'new' WHEN same THEN 'unchanged' ELSE 'updated' END AS status,
sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY n)::BIGINT AS version FROM (
SELECT user_id, event_id, row_number() OVER w AS n, coalesce(lag(event_type) OVER w = event_type, false) AS same FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""",
)
def versions_in_a_stream(spark, sf_dir):
    return _drained(spark, keyed.current(_stream(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type"), "current")


@query(
    "q82",
    """SELECT user_id AS key, 'window' AS kind, epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS start, count(*) AS n FROM events GROUP BY user_id, time_bucket(INTERVAL 6 HOUR, ts)
HAVING time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
)
def windows_of_users(spark, sf_dir):
    """Windows of each user as they close; a stream whose rows come in one batch has none that are late."""
    return _drained(spark, keyed.windows_and_late(_stream(spark, sf_dir, "events"), "user_id", "ts", 6 * 3600, "10 minutes"), "windows")
