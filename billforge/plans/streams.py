"""Registered queries of the scheduler's stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billforge.plans.queries import query
from billforge.sources import tables as T
from billforge.streaming import scheduler


@query("""WITH RECURSIVE e AS (SELECT event_id AS tick_id, user_id % 25 AS client_id, ts, CAST(props->>'$.k' AS BIGINT) % 3 AS files, 3600 * (user_id % 3 + 1) AS secs, row_number() OVER (PARTITION BY user_id % 25 ORDER BY ts, event_id) AS n FROM events),
 g AS (SELECT tick_id, client_id, n, true AS accepted, CASE WHEN files > 0 THEN ts END AS last FROM e WHERE n = 1
  UNION ALL SELECT tick_id, client_id, n, ok, CASE WHEN ok AND files > 0 THEN ts ELSE last END FROM (SELECT e.*, g.last, g.last IS NULL OR epoch_us(e.ts) - epoch_us(g.last) >= secs * 1000000 AS ok FROM g JOIN e ON e.client_id = g.client_id AND e.n = g.n + 1) AS x)
 SELECT tick_id, client_id, accepted FROM g""")
def q_scheduler_stream(spark: SparkSession, d: str) -> DataFrame:
    """Ticks that the gates of the tenants let through, read by a stream that is stopped half way and started again."""
    e = T.read(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    ticks = e.select(F.col("event_id").alias("tick_id"), (F.col("user_id") % 25).alias("client_id"), F.col("ts").cast("timestamp").alias("at"), (3600 * (F.col("user_id") % 3 + 1)).cast("long").alias("interval_seconds"), (k % 3).alias("n_files"))
    place = T.new_folder(spark)
    low, high = ticks.agg(F.unix_micros(F.min("at")), F.unix_micros(F.max("at"))).first()
    early = F.unix_micros("at") <= F.lit((low + high) // 2)
    out = None
    for half in (early, ~early):
        ticks.where(half).write.mode("append").parquet(f"{place}/ticks")
        out = scheduler.run_gate(spark, f"{place}/ticks", place)
    return out
