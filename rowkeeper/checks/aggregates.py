from __future__ import annotations

from pyspark.sql import functions as F

from rowkeeper.checks.registry import check
from rowkeeper.operators import aggregates


@check("latest_per_key", """
SELECT user_id, event_type, max(ts) AS max_ts, max(event_id) AS max_event_id FROM events GROUP BY user_id, event_type
""")
def latest_per_key(t):
    return aggregates.latest_per_key(t.events, ["user_id", "event_type"], "ts", "event_id")


@check("latest_row_per_key", """
SELECT user_id, event_type, event_id, ts, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1
""")
def latest_row_per_key(t):
    rows = t.events.select("user_id", "event_type", "event_id", "ts", "value")
    return aggregates.latest_row_per_key(rows, ["user_id", "event_type"], "ts", "event_id")


@check("high_water_mark", """
SELECT c_custkey, coalesce(max(o_orderkey), 0) AS mark FROM customer LEFT JOIN orders ON o_custkey = c_custkey
GROUP BY c_custkey
""")
def high_water_mark(t):
    loaded = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return aggregates.high_water_mark(t.customer, loaded, "c_custkey", "o_orderkey")


@check("distinct_rows", "SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem")
def distinct_rows(t):
    return aggregates.distinct_rows(t.lineitem, ["l_orderkey", "l_suppkey"])


@check("check_summary", """
WITH f AS (SELECT user_id, event_id, props, CASE WHEN value > 60 THEN 8989 ELSE 8990 END AS error
  FROM events WHERE event_type = 'error' AND value > 40),
  s AS (SELECT user_id, count(*) AS n, arg_min(props, event_id) FILTER (error = 8989) AS first_message
  FROM f GROUP BY user_id)
SELECT u.user_id, coalesce(n, 0) AS n_findings, CASE WHEN n IS NULL THEN 'ok' ELSE 'failed' END AS result, first_message
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN s ON s.user_id = u.user_id
""")
def check_summary(t):
    found = t.events.filter((F.col("event_type") == "error") & (F.col("value") > 40)).select(
        "user_id", F.col("event_id").alias("id"), F.col("props").alias("message_text"),
        F.when(F.col("value") > 60, 8989).otherwise(8990).alias("error"),
    )
    return aggregates.check_summary(t.events.select("user_id").distinct(), found, "user_id")


@check("id_list", """
WITH p AS (SELECT o_custkey, o_orderkey,
  (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 1000 AS part FROM orders)
SELECT o_custkey, part, count(*) AS n_items, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS items
FROM p GROUP BY o_custkey, part
""")
def id_list(t):
    return aggregates.id_list(t.orders, "o_custkey", "o_orderkey")


@check("join_names", """
WITH p AS (SELECT r_name, n_name, (row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1) // 1000 AS part
  FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT r_name, part, count(*) AS n_items, string_agg(n_name, ', ' ORDER BY n_name) AS items FROM p GROUP BY r_name, part
""")
def join_names(t):
    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return aggregates.join_names(named, "r_name", "n_name")


@check("char_frequency", """
SELECT symbol, count(*) AS n FROM (SELECT unnest(string_split(p_name, '')) AS symbol FROM part) GROUP BY symbol
""")
def char_frequency(t):
    return aggregates.char_frequency(t.part, "p_name")


@check("sum_by_key", """
SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM lineitem
GROUP BY l_returnflag
""")
def sum_by_key(t):
    rows = t.lineitem.select("l_returnflag", F.col("l_quantity").cast("decimal(18,2)").alias("quantity"))
    return aggregates.sum_by_key(rows, ["l_returnflag"], "quantity")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]


@check("pivot_counts", "SELECT c_nationkey, " + ", ".join(
    f"count(*) FILTER (c_mktsegment = '{s}') AS \"{s}\"" for s in SEGMENTS
) + ", count(*) FILTER (c_mktsegment IS NULL OR c_mktsegment NOT IN (" + ", ".join(f"'{s}'" for s in SEGMENTS) + """)) AS other
FROM customer GROUP BY c_nationkey""")
def pivot_counts(t):
    return aggregates.pivot_counts(t.customer, "c_nationkey", "c_mktsegment", SEGMENTS, other="other")


@check("duplicate_values", """
SELECT l_orderkey, l_linenumber FROM (
  SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber) AS rn FROM lineitem)
WHERE rn > 1
""")
def duplicate_values(t):
    return aggregates.duplicate_values(t.lineitem, ["l_orderkey", "l_linenumber"])


@check("common_multiset", """
WITH i AS (SELECT u.user_id, y.event_type, (SELECT count(*) FROM events e WHERE e.user_id = u.user_id
    AND e.event_type = y.event_type) AS n
  FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) y),
  m AS (SELECT event_type, min(n) AS times FROM i GROUP BY event_type)
SELECT event_type FROM (SELECT event_type, unnest(range(times)) FROM m)
""")
def common_multiset(t):
    return aggregates.common_multiset(t.events, "user_id", "event_type")


@check("route_average", """
WITH l AS (SELECT event_type AS end_place, lag(event_type) OVER w AS start_place, epoch_us(ts) AS came,
  lag(epoch_us(ts)) OVER w AS gone FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT start_place, end_place, count(*) AS n_legs, round(avg(came - gone) / 1000000, 3) AS avg_duration
FROM l WHERE gone IS NOT NULL GROUP BY start_place, end_place
""")
def route_average(t):
    routes = aggregates.route_average(t.events, "user_id", "event_type", "ts")
    return routes.withColumn("avg_duration", F.round("avg_duration", 3))


ALLOWED = "abdegilmnrstw"


@check("covered_length", f"""
SELECT p_brand, CAST(sum(coalesce(list_sum(list_transform(list_filter(string_split(p_name, ' '),
  lambda w: regexp_full_match(w, '[{ALLOWED}]*')), lambda w: length(w))), 0)) AS BIGINT) AS covered_length
FROM part GROUP BY p_brand
""")
def covered_length(t):
    return aggregates.covered_length(t.part, "p_name", ALLOWED, ["p_brand"])


@check("fold_sum", """
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings
""")
def fold_sum(t):
    folded = aggregates.fold_sum(t.embeddings, "embedding")
    return folded.select("vec_id", F.round("total", 6).alias("total"))


@check("token_rule_score", r"""
WITH w AS (SELECT doc_id, lang, list_filter(string_split_regex(text, '[ \t\n\r\f]+'), lambda w: w <> '') AS words
  FROM documents)
SELECT doc_id, lang, CAST(len(words) AS BIGINT) AS n_words,
  CAST(coalesce(list_sum(list_transform(words, lambda w:
    CASE WHEN length(regexp_replace(w, '[^aeiouy]', '', 'g')) % 2 = 0 THEN 2 ELSE 1 END)), 0) AS BIGINT) AS score
FROM w
""")
def token_rule_score(t):
    return aggregates.token_rule_score(t.documents, "doc_id", "text", keep=["lang"])


@check("sortedness_check", """
WITH l AS (SELECT user_id, ts, value, event_id, lag(ts) OVER w AS pt, lag(value) OVER w AS pv, lag(event_id) OVER w AS pe
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  k AS (SELECT user_id, max(CASE WHEN pt > ts THEN 1 ELSE 0 END) AS t, max(CASE WHEN pv > value THEN 1 ELSE 0 END) AS v,
    max(CASE WHEN pe > event_id THEN 1 ELSE 0 END) AS e FROM l GROUP BY user_id)
SELECT column_name, n_unsorted_keys, n_unsorted_keys = 0 AS is_sorted FROM (
  SELECT 'ts' AS column_name, CAST(sum(t) AS BIGINT) AS n_unsorted_keys FROM k
  UNION ALL SELECT 'value', CAST(sum(v) AS BIGINT) FROM k UNION ALL SELECT 'event_id', CAST(sum(e) AS BIGINT) FROM k)
""")
def sortedness_check(t):
    return aggregates.sortedness_check(t.events, ["user_id"], ["event_id"], ["ts", "value", "event_id"])
