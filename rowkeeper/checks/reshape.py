from __future__ import annotations

from pyspark.sql import functions as F

from rowkeeper.checks.registry import check
from rowkeeper.operators import reshape


@check("union_distinct", "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return reshape.union_distinct(
        t.customer.select(F.col("c_nationkey").alias("nationkey")), t.supplier.select("s_nationkey")
    )


def buyers(t, year):
    bought = t.orders.filter(F.year("o_orderdate") == year).select("o_custkey")
    name = F.upper("c_name") if year == 1996 else F.col("c_name")
    return t.customer.join(bought, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(name.alias("member"))


@check("membership_diff", """
WITH b AS (SELECT lower(c_name) AS member, year(o_orderdate) AS y FROM orders JOIN customer ON o_custkey = c_custkey),
  c AS (SELECT DISTINCT member FROM b WHERE y = 1996), w AS (SELECT DISTINCT member FROM b WHERE y = 1997)
SELECT coalesce(c.member, w.member) AS member, CASE WHEN c.member IS NULL THEN 'add' ELSE 'remove' END AS action
FROM c FULL OUTER JOIN w ON c.member = w.member WHERE c.member IS NULL OR w.member IS NULL
""")
def membership_diff(t):
    return reshape.membership_diff(buyers(t, 1996), buyers(t, 1997), "member")


@check("unpivot_columns", """
SELECT c_name AS label FROM customer WHERE c_name <> ''
UNION ALL
SELECT c_mktsegment FROM customer WHERE c_acctbal >= 0
""")
def unpivot_columns(t):
    rows = t.customer.select(
        "c_name", F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment")).alias("segment")
    )
    return reshape.unpivot_columns(rows, ["c_name", "segment"], "label")


@check("transpose", """
WITH c AS (SELECT label, i - 1 AS pos, max(CAST(floor(CAST(embedding[i] AS DOUBLE) * 1000) AS BIGINT)) AS v
  FROM embeddings, range(1, 65) AS r(i) WHERE i <= len(embedding) GROUP BY label, i),
  s AS (SELECT pos, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS sorted_values FROM c GROUP BY pos)
SELECT CAST(c.pos AS INTEGER) AS pos, s.sorted_values, """ + ", ".join(
    f"max(v) FILTER (label = {i}) AS row_{i}" for i in range(10)
) + " FROM c JOIN s ON s.pos = c.pos GROUP BY c.pos, s.sorted_values")
def transpose(t):
    cells = reshape.matrix_cells(t.embeddings, "label", "embedding").select(
        "label", "pos", F.floor(F.col("value").cast("double") * 1000).cast("bigint").alias("value")
    )
    # A label has several vectors; the greatest of their cells stands for it.
    cells = cells.groupBy("label", "pos").agg(F.max("value").alias("value"))
    wide = reshape.transpose(cells, "label", "pos", "value", list(range(10)))
    return wide.withColumn(
        "sorted_values", F.array_join(F.transform("sorted_values", lambda v: v.cast("string")), ",")
    )


@check("nested_explode_report", """
SELECT p_partkey, unnest(string_split(p_name, ' ')) AS child FROM part
""")
def nested_explode_report(t):
    return reshape.nested_explode_report(
        t.part.select("p_partkey", F.split("p_name", " ").alias("words")), "p_partkey", "words"
    )
