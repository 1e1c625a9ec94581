from __future__ import annotations

from pyspark.sql import functions as F

from rowkeeper.checks.registry import check
from rowkeeper.operators import windows

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@check("retention_candidates", """
SELECT * FROM (
  SELECT user_id, event_id, event_type, ts,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS row_num,
    CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id
      ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS full_sets
  FROM events) WHERE full_sets > 3
""")
def retention_candidates(t):
    rows = t.events.select("user_id", "event_id", "event_type", "ts")
    return windows.retention_candidates(
        rows, ["user_id"], "ts", "event_id", "event_type", "purchase", EVENT_TYPES, keep=3
    )


@check("size_buckets", """
WITH p AS (SELECT p_size, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS place FROM part)
SELECT p_size, place // p_size AS chunk, count(*) AS n_members,
  string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS members
FROM p GROUP BY p_size, place // p_size
""")
def size_buckets(t):
    return windows.size_buckets(t.part, "p_size", "p_partkey")


@check("fixed_chunks", """
WITH p AS (SELECT conv_id, turn, role, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS chunk
  FROM conversations)
SELECT conv_id, chunk, count(*) AS n_members, string_agg(role, ',' ORDER BY turn) AS members
FROM p GROUP BY conv_id, chunk
""")
def fixed_chunks(t):
    return windows.fixed_chunks(t.conversations, ["conv_id"], ["turn"], 2, "role")


@check("drop_top_counts", """
WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)
SELECT p_brand, n FROM c WHERE n NOT IN (SELECT n FROM c ORDER BY n DESC, p_brand LIMIT 2)
""")
def drop_top_counts(t):
    return windows.drop_top_counts(t.part, "p_brand")


@check("island_heads", """
WITH c AS (SELECT DISTINCT user_id, dayofyear(ts) AS day FROM events)
SELECT user_id, CAST(day AS INTEGER) AS day FROM c
WHERE NOT EXISTS (SELECT 1 FROM c u WHERE u.user_id = c.user_id - 1 AND u.day = c.day)
  AND NOT EXISTS (SELECT 1 FROM c l WHERE l.user_id = c.user_id AND l.day = c.day - 1)
""")
def island_heads(t):
    return windows.island_heads(t.events.select("user_id", F.dayofyear("ts").alias("day")), "user_id", "day")


@check("coverage_rank", """
WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey),
  r AS (SELECT row_number() OVER w AS k, sum(n) OVER w AS covered, (SELECT sum(n) // 2 FROM c) AS half
    FROM c WINDOW w AS (ORDER BY n DESC, l_suppkey ROWS UNBOUNDED PRECEDING))
SELECT k, CAST(covered AS BIGINT) AS covered_rows FROM r WHERE covered >= half ORDER BY k LIMIT 1
""")
def coverage_rank(t):
    return windows.coverage_rank(t.lineitem, "l_suppkey")


@check("run_changes", """
WITH l AS (SELECT user_id, event_type, lag(event_type, 1, 'start') OVER (PARTITION BY user_id ORDER BY ts) AS before
  FROM events)
SELECT user_id, CAST(sum(CASE WHEN before <> event_type THEN 1 ELSE 0 END) AS BIGINT) AS n_changes FROM l GROUP BY user_id
""")
def run_changes(t):
    return windows.run_changes(t.events, ["user_id"], ["ts"], "event_type", "start")


CIRCULAR_SQL = """
WITH p AS (SELECT event_id, user_id, CAST(value AS DECIMAL(18,2)) AS amount,
    row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT a.event_id, a.user_id, CAST(sum(b.amount) AS DECIMAL(28,2)) AS circular
FROM p a CROSS JOIN (SELECT unnest(range({first}, {last} + 1)) AS step) AS s
JOIN p b ON a.user_id = b.user_id AND b.place = ((a.place + s.step) % a.n + a.n) % a.n
GROUP BY a.event_id, a.user_id
"""


def circle(t, k):
    rows = t.events.select("event_id", "user_id", "ts", F.col("value").cast("decimal(18,2)").alias("amount"))
    return windows.circular_sum(rows, ["user_id"], ["ts"], "amount", k).select("event_id", "user_id", "circular")


@check("circular_sum", CIRCULAR_SQL.format(first=1, last=3))
def circular_sum(t):
    return circle(t, 3)


@check("circular_sum_back", CIRCULAR_SQL.format(first=-2, last=-1))
def circular_sum_back(t):
    return circle(t, -2)


@check("circular_sum_around", CIRCULAR_SQL.format(first=1, last=150))
def circular_sum_around(t):
    """Many keys have fewer rows than that, some exactly as many: whole turns count."""
    return circle(t, 150)


@check("circular_sum_around_back", CIRCULAR_SQL.format(first=-101, last=-1))
def circular_sum_around_back(t):
    return circle(t, -101)


@check("systematic_sample", """
SELECT user_id, event_id, value, position FROM (
  SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS position,
    count(*) OVER (PARTITION BY user_id) // 3 AS skipped FROM events)
WHERE position > skipped AND (position - 1 - skipped) % 2 = 0
""")
def systematic_sample(t):
    return windows.systematic_sample(
        t.events.select("user_id", "event_id", "value"), ["user_id"], ["value", "event_id"]
    )
