"""Batches, JSON columns, updates and state over documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators import review
from foliant.plans.registry import query, table


@query("SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 25 AS batch FROM documents WHERE lang <> 'en'")
def batch_of_25(spark: SparkSession, d: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    return table(spark, d, "documents").filter("lang <> 'en'").select("source", "doc_id", F.floor(nth / 25).cast("long").alias("batch"))


@query("SELECT k, count(*) AS events, count(DISTINCT user_id) AS users, min(event_id) AS first_event FROM (SELECT json_extract(props, '$.k')::INTEGER AS k, * FROM events) GROUP BY k")
def json_property_groups(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("k", F.from_json("props", "k int")["k"])
    return e.groupBy("k").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"), F.min("event_id").alias("first_event"))


@query("""
WITH q AS (SELECT o_orderkey, o_orderstatus AS subject, o_orderpriority AS topic, CASE WHEN o_custkey % 3 = 0 THEN 'approved' ELSE 'pending' END AS status FROM orders),
c AS (SELECT o_orderkey AS k, o_orderkey % 5 AS kind FROM orders WHERE o_orderkey % 2 = 0)
SELECT o_orderkey, CASE kind WHEN 0 THEN 'X' WHEN 1 THEN NULL ELSE subject END AS subject, topic, CASE WHEN kind < 2 AND status = 'approved' THEN 'pending' ELSE status END AS status, coalesce(kind < 2, false) AS edited FROM q LEFT JOIN c ON o_orderkey = k
""")
def partial_updates(spark: SparkSession, d: str) -> DataFrame:
    """Unset is not null: kind 1 sets the subject to null, kinds 2 to 4 leave it."""
    o = table(spark, d, "orders")
    q = o.select(F.lit(1).alias("project_id"), F.col("o_orderkey").alias("number"), F.col("o_orderstatus").alias("subject"), F.col("o_orderpriority").alias("topic"), F.when(F.col("o_custkey") % 3 == 0, "approved").otherwise("pending").alias("status"), F.lit("auto").alias("approved_by"), F.lit(False).alias("edited"))
    kind = F.col("o_orderkey") % 5
    named = F.when(kind < 2, F.array(F.lit("subject"))).otherwise(F.array().cast("array<string>"))
    c = o.filter("o_orderkey % 2 = 0").select(F.lit(1).alias("project_id"), F.col("o_orderkey").alias("number"), named.alias("set_fields"), F.when(kind == 0, "X").alias("subject"), F.lit("ignored").alias("topic"))
    return review.update_questions(q, c, ["subject", "topic"]).select(F.col("number").alias("o_orderkey"), "subject", "topic", "status", "edited")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN 'approved' WHEN o_totalprice > 250000 THEN 'approved' ELSE 'pending' END AS status, o_orderstatus = 'O' AND o_totalprice > 250000 AS approved_now FROM orders
""")
def auto_approval(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "O", "approved").otherwise("pending").alias("status"), F.lit(None).cast("string").alias("approved_by"), "o_totalprice")
    return review.auto_approve(o, F.col("o_totalprice") > 250000).select("o_orderkey", "status", "approved_now")


@query("""
WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS nth FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM q WHERE NOT (l_linenumber = 2 AND nth = 1)
""")
def delete_first_match(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").withColumns({"project_id": F.col("l_orderkey"), "number": F.col("l_linenumber"), "seq": F.col("l_partkey") * 100000 + F.col("l_suppkey")})
    return review.delete_questions(l, l.filter("number = 2")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, -1 FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 3 = 0")
def insert_new_only(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    have = o.filter("o_orderstatus = 'F'").select(F.lit(1).alias("project_id"), F.col("o_orderkey").alias("number"), "o_custkey")
    new = o.filter("o_orderkey % 3 = 0").select(F.lit(1).alias("project_id"), F.col("o_orderkey").alias("number"), F.lit(-1).cast("long").alias("o_custkey"))
    return review.add_questions(have, new)[0].select(F.col("number").alias("o_orderkey"), "o_custkey")


@query("""
WITH m AS (SELECT user_id, 'd' || (event_id % 3) AS page, max_by(event_type IN ('purchase', 'signup'), event_id) AS approved FROM events GROUP BY ALL)
SELECT user_id, string_agg(page || '=' || CASE WHEN approved THEN 'true' ELSE 'false' END, ',' ORDER BY page) AS pages FROM m GROUP BY user_id
""")
def page_status_map(spark: SparkSession, d: str) -> DataFrame:
    """The last status of each page as a map, by user."""
    e = table(spark, d, "events").withColumn("page", F.concat(F.lit("d"), (F.col("event_id") % 3).cast("string")))
    last = e.groupBy("user_id", "page").agg(F.max_by(F.col("event_type").isin("purchase", "signup"), "event_id").alias("approved"))
    m = last.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("page", "approved"))).alias("status"))
    shown = F.transform(F.array_sort(F.map_entries("status")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))
    return m.select("user_id", F.array_join(shown, ",").alias("pages"))
