from __future__ import annotations

from pyspark.sql import functions as F

from rowkeeper.checks.registry import check
from rowkeeper.functions.scalars import epoch_micros
from rowkeeper.operators import joins
from rowkeeper.plans.concordance import concordance_counts as pair_counts
from rowkeeper.sources.readers import inline_rows

SIX_HOURS = 6 * 3_600_000_000


def money(col):
    return F.col(col).cast("decimal(12,2)")


@check("history_join", """
SELECT DISTINCT o_orderkey, o_custkey, o_orderdate, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey
""")
def history_join(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return joins.history_join(t.orders, lines, ["o_orderkey"], ["o_orderkey", "o_custkey", "o_orderdate", "l_suppkey"])


@check("multi_key_join", """
SELECT l_orderkey, l_linenumber, l.l_partkey, l.l_suppkey, l_quantity, n_lines, max_quantity
FROM lineitem l JOIN (
  SELECT l_partkey, l_suppkey, count(*) AS n_lines, max(l_quantity) AS max_quantity
  FROM lineitem GROUP BY l_partkey, l_suppkey) a ON l.l_partkey = a.l_partkey AND l.l_suppkey = a.l_suppkey
""")
def multi_key_join(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return joins.multi_key_join(lines, t.lineitem, ["l_partkey", "l_suppkey"], [
        F.count(F.lit(1)).alias("n_lines"), F.max("l_quantity").alias("max_quantity"),
    ])


@check("star_join", """
SELECT c_custkey, c_name, n_name, r_name FROM customer
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def star_join(t):
    customer = t.customer.withColumnRenamed("c_nationkey", "n_nationkey")
    region = t.region.withColumnRenamed("r_regionkey", "n_regionkey")
    joined = joins.star_join(customer, [(t.nation, ["n_nationkey"]), (region, ["n_regionkey"])])
    return joined.select("c_custkey", "c_name", "n_name", "r_name")


def orders_by_customer(t):
    return t.orders.withColumnRenamed("o_custkey", "c_custkey")


@check("anti_join", """
SELECT c_custkey, c_name FROM customer
LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' WHERE o_custkey IS NULL
""")
def anti_join(t):
    return joins.anti_join(
        t.customer.select("c_custkey", "c_name"), orders_by_customer(t), ["c_custkey"], F.col("o_orderstatus") == "F"
    )


@check("semi_join", """
SELECT s_suppkey, s_name FROM supplier
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R')
""")
def semi_join(t):
    lines = t.lineitem.withColumnRenamed("l_suppkey", "s_suppkey")
    return joins.semi_join(
        t.supplier.select("s_suppkey", "s_name"), lines, ["s_suppkey"], F.col("l_returnflag") == "R"
    )


@check("update_from_join", """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0)
  THEN 1 ELSE 0 END AS discounted FROM orders
""")
def update_from_join(t):
    orders = t.orders.select("o_orderkey", "o_custkey", F.lit(0).alias("discounted"))
    changes = t.lineitem.filter(F.col("l_discount") > 0).select(
        F.col("l_orderkey").alias("o_orderkey"), F.lit(1).alias("discounted")
    )
    return joins.update_from_join(orders, changes, ["o_orderkey"], "discounted")


@check("one_row_cross", """
SELECT n_nationkey, n_name, max_balance, n_customers FROM nation
JOIN (SELECT max(c_acctbal) AS max_balance, count(*) AS n_customers FROM customer) ON 1 = 1
""")
def one_row_cross(t):
    one = t.customer.agg(F.max("c_acctbal").alias("max_balance"), F.count(F.lit(1)).alias("n_customers"))
    return joins.one_row_cross(t.nation.select("n_nationkey", "n_name"), one)


@check("lateral_values", """
WITH n AS (SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(12,2))
  * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS net, CAST(l_tax AS DECIMAL(4,2)) AS rate FROM lineitem)
SELECT l_orderkey, l_linenumber, net, CAST(net * rate AS DECIMAL(18,6)) AS tax,
  CAST(net + CAST(net * rate AS DECIMAL(18,6)) AS DECIMAL(18,6)) AS gross FROM n
""")
def lateral_values(t):
    net = money("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    return joins.lateral_values(rows, {
        "net": net.cast("decimal(18,4)"),
        "tax": (F.col("net") * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(18,6)"),
        "gross": (F.col("net") + F.col("tax")).cast("decimal(18,6)"),
    }).drop("l_extendedprice", "l_discount", "l_tax")


@check("directory_lookup", """
SELECT c_name, lower(c_name) || '@example.com' AS email FROM customer WHERE c_acctbal > 9000
""")
def directory_lookup(t):
    names = t.customer.filter(F.col("c_acctbal") > 9000).select("c_name")
    directory = t.customer.select("c_name", F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"))
    return joins.directory_lookup(names, directory, "c_name")


@check("dict_lookup", """
SELECT o_orderpriority, weight, CASE WHEN weight IS NULL THEN 1 ELSE 0 END AS missing, count(*) AS n_orders
FROM orders LEFT JOIN (VALUES ('1-URGENT', 9), ('2-HIGH', 7), ('4-NOT SPECIFIED', 3), ('5-LOW', 1)) AS w(p, weight)
  ON o_orderpriority = p
GROUP BY ALL
""")
def dict_lookup(t):
    weights = [("1-URGENT", 9), ("2-HIGH", 7), ("4-NOT SPECIFIED", 3), ("5-LOW", 1)]
    lookup = inline_rows(t.spark, weights, "o_orderpriority string, weight int")
    found = joins.dict_lookup(t.orders.select("o_orderpriority"), "o_orderpriority", lookup)
    return found.groupBy("o_orderpriority", "weight", "missing").agg(F.count(F.lit(1)).alias("n_orders"))


def spans(events, kind):
    """Events of one type as closed spans in microseconds; the value is their length in minutes."""
    start = epoch_micros(F.col("ts"))
    length = F.floor(F.col("value") * 60).cast("bigint") * 1_000_000
    return events.filter(F.col("event_type") == kind).select(
        "user_id", "event_id", start.alias("start_us"), (start + length).alias("end_us")
    )


SPANS_SQL = """SELECT user_id, event_id, epoch_us(ts) AS start_us,
  epoch_us(ts) + CAST(floor(value * 60) AS BIGINT) * 1000000 AS end_us FROM events WHERE event_type = '{}'"""


@check("interval_overlap", f"""
WITH a AS ({SPANS_SQL.format('purchase')}), b AS ({SPANS_SQL.format('error')})
SELECT a.user_id, a.event_id AS event_id_a, a.start_us AS start_us_a, a.end_us AS end_us_a,
  b.event_id AS event_id_b, b.start_us AS start_us_b, b.end_us AS end_us_b,
  greatest(a.start_us, b.start_us) AS overlap_start, least(a.end_us, b.end_us) AS overlap_end
FROM a JOIN b ON a.user_id = b.user_id AND a.start_us <= b.end_us AND b.start_us <= a.end_us
""")
def interval_overlap(t):
    events = t.events
    return joins.interval_overlap(
        spans(events, "purchase"), spans(events, "error"), "start_us", "end_us", ["user_id"]
    )


@check("inventory_match", """
WITH h AS (SELECT upper(url) AS full_name, count(*) AS n_sets FROM pages GROUP BY upper(url))
SELECT f.url AS full_name, f.page_id, h.n_sets FROM pages f JOIN h ON lower(f.url) = lower(h.full_name)
""")
def inventory_match(t):
    files = t.pages.select(F.col("url").alias("full_name"), "page_id")
    history = t.pages.groupBy(F.upper("url").alias("full_name")).agg(F.count(F.lit(1)).alias("n_sets"))
    return joins.inventory_match(files, history, "full_name")


@check("dense_scaffold", """
WITH facts AS (
  SELECT n_regionkey AS r_regionkey, o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n_orders
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT r.r_regionkey, p.priority, s.status, coalesce(n_orders, 0) AS n_orders
FROM region r
CROSS JOIN (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW'), ('6-NONE')) AS p(priority)
CROSS JOIN (VALUES ('F'), ('O'), ('P')) AS s(status)
LEFT JOIN facts f ON f.r_regionkey = r.r_regionkey AND f.priority = p.priority AND f.status = s.status
""")
def dense_scaffold(t):
    # Counted per customer first: orders shrink before they meet the dimensions.
    per_customer = t.orders.groupBy(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
    ).agg(F.count(F.lit(1)).alias("n"))
    nation = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("r_regionkey"))
    facts = (
        per_customer.join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey").join(nation, "c_nationkey")
        .groupBy("r_regionkey", "priority", "status").agg(F.sum("n").alias("n_orders"))
    )
    return joins.dense_scaffold(
        t.region.select("r_regionkey"),
        {"priority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"],
         "status": ["F", "O", "P"]},
        facts, "n_orders",
    )


@check("scaffold_chain", """
SELECT r_regionkey, y, m, status, priority, size FROM region
CROSS JOIN (SELECT unnest(range(1992, 1999)) AS y) CROSS JOIN (SELECT unnest(range(1, 13)) AS m)
CROSS JOIN (VALUES ('F'), ('O'), ('P')) AS s(status) CROSS JOIN (VALUES ('1-URGENT'), ('2-HIGH')) AS p(priority)
CROSS JOIN (SELECT unnest(range(1, 51)) AS size)
WHERE (y * 12 + m) % 5 = r_regionkey AND (status <> 'P' OR m <= 6) AND size % 12 = m % 12 AND size > y - 1990
""")
def scaffold_chain(t):
    """Five domains, each tested as soon as its columns are there; the last is a table of its own."""
    sizes = t.part.select(F.col("p_size").cast("bigint")).distinct()
    return joins.dense_scaffold(
        t.region.select("r_regionkey"),
        {"y": list(range(1992, 1999)), "m": list(range(1, 13)), "status": ["F", "O", "P"], "priority": ["1-URGENT", "2-HIGH"], "size": sizes},
        when={
            "m": (F.col("y") * 12 + F.col("m")) % 5 == F.col("r_regionkey"),
            "status": (F.col("status") != "P") | (F.col("m") <= 6),
            "size": (F.col("size") % 12 == F.col("m") % 12) & (F.col("size") > F.col("y") - 1990),
        },
    ).select("r_regionkey", F.col("y").cast("bigint").alias("y"), F.col("m").cast("bigint").alias("m"), "status", "priority", "size")


@check("concordance_counts", """
WITH c AS (
  SELECT a.user_id, a.event_id, a.value,
    count(*) FILTER (b.event_id < a.event_id AND b.value < a.value) AS earlier_smaller,
    count(*) FILTER (b.event_id < a.event_id AND b.value > a.value) AS earlier_greater,
    count(*) FILTER (b.event_id > a.event_id AND b.value < a.value) AS later_smaller,
    count(*) FILTER (b.event_id > a.event_id AND b.value > a.value) AS later_greater
  FROM events a JOIN events b ON a.user_id = b.user_id GROUP BY ALL)
SELECT *, earlier_smaller * later_greater + earlier_greater * later_smaller AS n_monotone FROM c
""")
def concordance_counts(t):
    return pair_counts(t.events, ["user_id"], ["event_id"], "value")


@check("nearest_each_side", f"""
WITH p AS (SELECT user_id, event_id, epoch_us(ts) AS at_us FROM events WHERE event_type = 'purchase'),
  e AS (SELECT user_id, event_id, epoch_us(ts) AS at_us FROM events WHERE event_type = 'error')
SELECT p.user_id, p.at_us, p.event_id,
  arg_max(e.event_id, e.at_us) FILTER (e.at_us < p.at_us AND p.at_us - e.at_us < {SIX_HOURS}) AS before_label,
  p.at_us - max(e.at_us) FILTER (e.at_us < p.at_us AND p.at_us - e.at_us < {SIX_HOURS}) AS before_distance,
  arg_min(e.event_id, e.at_us) FILTER (e.at_us > p.at_us AND e.at_us - p.at_us < {SIX_HOURS}) AS after_label,
  min(e.at_us) FILTER (e.at_us > p.at_us AND e.at_us - p.at_us < {SIX_HOURS}) - p.at_us AS after_distance
FROM p LEFT JOIN e ON p.user_id = e.user_id GROUP BY p.user_id, p.at_us, p.event_id
""")
def nearest_each_side(t):
    events = t.events.select("user_id", "event_id", epoch_micros(F.col("ts")).alias("at_us"), "event_type")
    probes = events.filter(F.col("event_type") == "purchase").drop("event_type")
    points = events.filter(F.col("event_type") == "error").drop("event_type")
    return joins.nearest_each_side(probes, points, ["user_id"], "at_us", SIX_HOURS, "event_id")
