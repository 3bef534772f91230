"""Sequential parsers over documents written from the tables: what is parsed must be what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import parse, quality, reconcile
from foliant.plans.registry import query, table


def _booklets(spark: SparkSession, d: str) -> DataFrame:
    """Ten parts to a booklet, each a question with four options."""
    p = table(spark, d, "part")
    n = F.col("p_partkey") % 10 + 1
    written = F.array(F.concat(n.cast("string"), F.lit("- "), "p_name", F.lit(" کدام است؟")), F.concat(F.lit("الف) "), "p_brand"), F.concat(F.lit("ب) "), "p_type"), F.concat(F.lit("ج) قیمت ب) "), F.col("p_size").cast("string")), F.lit("د) هیچکدام"))
    lines = p.select(F.floor(F.col("p_partkey") / 10).cast("string").alias("doc"), n.alias("n"), F.posexplode(written).alias("at", "text"))
    return lines.select("doc", (F.col("n") * 10 + F.col("at")).cast("int").alias("line_no"), "text")


@query("""
SELECT (p_partkey // 10)::VARCHAR AS doc, (p_partkey % 10 + 1)::INTEGER AS number, p_name || ' کدام است؟' AS stem, concat_ws(' / ', p_brand, p_type, 'قیمت ب) ' || p_size, 'هیچکدام') AS options FROM part
""")
def question_fsm(spark: SparkSession, d: str) -> DataFrame:
    q = parse.parse_questions(_booklets(spark, d))
    return q.select("doc", "number", "stem", F.array_join(F.transform("options", lambda o: o["text"]), " / ").alias("options"))


@query("SELECT (s_suppkey // 20)::VARCHAR AS doc, (s_suppkey % 20 + 5)::INTEGER AS number, (s_nationkey % 4 + 1)::VARCHAR AS key, false AS partial FROM supplier")
def key_table_parse(spark: SparkSession, d: str) -> DataFrame:
    """Twenty suppliers to a key: a heading, then pairs."""
    s = table(spark, d, "supplier")
    rows = s.select(F.floor(F.col("s_suppkey") / 20).cast("string").alias("doc"), F.lit(1).alias("page"), (F.col("s_suppkey") % 20 + 1).cast("int").alias("line_no"), F.concat((F.col("s_suppkey") % 20 + 5).cast("string"), F.lit(" - "), (F.col("s_nationkey") % 4 + 1).cast("string")).alias("text"))
    heads = rows.select("doc", "page").distinct().select("doc", "page", F.lit(0).alias("line_no"), F.lit("پاسخنامه").alias("text"))
    return parse.parse_keys(rows.unionByName(heads))


@query("SELECT (s_suppkey // 20)::VARCHAR AS doc, (s_suppkey % 20 + 1)::INTEGER AS number, 'گزینه ' || (s_nationkey % 4 + 1) || ' صحیح است. ' || s_name AS explanation FROM supplier")
def explanation_sections(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    text = F.concat(F.lit("سوال "), (F.col("s_suppkey") % 20 + 1).cast("string"), F.lit(": گزینه "), (F.col("s_nationkey") % 4 + 1).cast("string"), F.lit(" صحیح است. "), "s_name")
    rows = s.select(F.floor(F.col("s_suppkey") / 20).cast("string").alias("doc"), (F.col("s_suppkey") % 20).cast("int").alias("line_no"), text.alias("text"))
    return parse.parse_explanations(rows)


@query("""
WITH w AS (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_brand || ' ' || p_type || ' end', ' ')) AS word, generate_subscripts(string_split(p_name || ' ' || p_brand || ' ' || p_type || ' end', ' '), 1) AS i FROM part)
SELECT (p_partkey // 100)::VARCHAR AS doc, (p_partkey % 100)::INTEGER AS page, (i - 1)::INTEGER AS pos, CASE WHEN p_partkey % 3 = 0 AND i = 2 THEN 'changed' ELSE word END AS text, CASE WHEN p_partkey % 3 = 0 AND i = 2 THEN 'disagree' END AS flag, CASE WHEN p_partkey % 3 = 0 AND i = 2 THEN word END AS alt FROM w
""")
def consensus_merge(spark: SparkSession, d: str) -> DataFrame:
    """An answer that differs from the offline reading in one word of every third page."""
    p = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 100).cast("string").alias("doc"), (F.col("p_partkey") % 100).cast("int").alias("page"), "p_partkey", F.split(F.concat_ws(" ", "p_name", "p_brand", "p_type", F.lit("end")), " ").alias("words"))
    box = {c: F.lit(0.5) for c in ("x0", "y0", "x1", "y1")}
    read = p.select("doc", "page", F.lit(0).alias("line"), F.posexplode("words").alias("pos", "text")).withColumns(box | {"conf": F.lit(80.0)})
    said = F.transform("words", lambda w, i: F.when((F.col("p_partkey") % 3 == 0) & (i == 1), "changed").otherwise(w))
    out = reconcile.merge_readings(read, p.select("doc", "page", F.array_join(said, " ").alias("answer"), F.lit(False).alias("trust")))
    return out.select("doc", "page", "pos", "text", "flag", "alt")


@query("""
WITH w AS (SELECT doc_id, unnest(string_split_regex(trim(text), '\\s+')) AS word, generate_subscripts(string_split_regex(trim(text), '\\s+'), 1) AS i FROM documents),
k AS (SELECT doc_id, trim(word, '«»()[]{}"''.,،;؛:!?؟-–—ـ*•') AS k, i % 101 AS conf, word FROM w),
s AS (SELECT DISTINCT doc_id, k FROM k WHERE conf >= 80 AND NOT regexp_matches(k, '[يكة]') AND NOT coalesce(list_bool_or(list_transform(range(1, length(k) - 1), lambda j: substr(k, j, 1) = substr(k, j + 1, 1) AND substr(k, j, 1) = substr(k, j + 2, 1))), false) AND NOT regexp_matches(trim(word), '^\\(?[0-9]{1,3}[)\\-.]$'))
SELECT doc_id, count(*) FILTER (k <> '' AND conf < 60 AND (conf < 20 OR (doc_id, k) NOT IN (SELECT (doc_id, k) FROM s)) AND NOT (conf >= 20 AND regexp_matches(word, '^\\(?[0-9]{1,3}[)\\-.]$')) OR
   (k <> '' AND conf >= 20 AND conf < 88 AND NOT regexp_matches(word, '^\\(?[0-9]{1,3}[)\\-.]$') AND coalesce(list_bool_or(list_transform(range(1, length(k) - 1), lambda j: substr(k, j, 1) = substr(k, j + 1, 1) AND substr(k, j, 1) = substr(k, j + 2, 1))), false))) AS flagged FROM k GROUP BY doc_id
""")
def refined_flags(spark: SparkSession, d: str) -> DataFrame:
    """Words with made-up confidences: those that a document reads with confidence elsewhere are trusted."""
    words = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split(F.btrim("text", F.lit(" \t\n\r\x0b\x0c")), r"\s+")).alias("i", "text"))
    words = words.withColumn("conf", ((F.col("i") + 1) % 101).cast("double")).withColumn("flag", F.lit(None).cast("string"))
    out = quality.refine_flags(words, spark.sql("SELECT 'x' AS word WHERE false"))
    return out.groupBy(F.col("doc").alias("doc_id")).agg(F.count("flag").alias("flagged"))
