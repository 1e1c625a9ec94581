from __future__ import annotations

from pyspark.sql import functions as F

from rowkeeper.checks.registry import check
from rowkeeper.session import workspace
from rowkeeper.streaming.collect import stream_collect as collect


@check("stream_collect", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def stream_collect(t):
    root = workspace(t.spark, "stream")
    t.events.write.parquet(f"{root}/in")
    for _ in range(2):  # The second run finds nothing new.
        collect(t.spark, f"{root}/in", t.events.schema, f"{root}/out", f"{root}/ckpt").awaitTermination()
    return t.spark.read.schema(t.events.schema).parquet(f"{root}/out")


@check("stream_collect_keyed", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def stream_collect_keyed(t):
    """Events arrive in three parts, the last of which sends a third of all rows again."""
    root = workspace(t.spark, "stream_keyed")
    for part in (F.col("event_id") % 3 == 0, F.col("event_id") % 3 == 1, F.col("event_id") % 3 != 1):
        t.events.filter(part).write.mode("append").parquet(f"{root}/in")
        collect(t.spark, f"{root}/in", t.events.schema, f"{root}/out", f"{root}/ckpt", keys=["event_id"]).awaitTermination()
    return t.spark.read.schema(t.events.schema).parquet(f"{root}/out")
