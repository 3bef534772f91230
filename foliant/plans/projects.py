"""Review, summaries, numbering, keys and exports; orders stand for projects and line items for questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators import classify, export, issues, lines, quality, review
from foliant.plans.registry import query, table

ISSUES = "array<struct<level:string,code:string>>"


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Line items with what questions have; (order, line) isn't a key, part and supplier settle ties."""
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    found = F.array_compact(F.array(_when(F.col("l_discount") >= 0.09, "error", "key_mismatch"), _when(F.col("l_tax") >= 0.07, "warning", "duplicate")))
    q = l.select(F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").alias("number"), "l_partkey", "l_suppkey", "l_returnflag", found.alias("issues"), F.when(F.col("l_quantity") > 45, 1).otherwise(0).alias("flags"))
    q = q.withColumn("status", F.when(F.col("l_returnflag") == "R", "approved").otherwise("pending"))
    return q.join(o, q["project_id"] == o["o_orderkey"]).withColumns({"created_at": F.col("o_orderdate"), "project_status": F.when(F.col("o_orderstatus") == "P", "processing").otherwise("ready"), "mode": F.lit("questions")})


def _when(rule: Column, level: str, code: str) -> Column:
    return F.when(rule, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code")))


@query("""
WITH q AS (
  SELECT l_orderkey AS project_id, l_linenumber AS number, l_partkey, l_suppkey, o_orderdate,
    CASE WHEN l_discount >= 0.09 THEN 'error' WHEN l_tax >= 0.07 OR l_quantity > 45 THEN 'warning' ELSE 'pending' END AS level,
    concat_ws(',', CASE WHEN l_tax >= 0.07 THEN 'duplicate' END, CASE WHEN l_discount >= 0.09 THEN 'key_mismatch' END) AS codes,
    CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END AS flags
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND l_returnflag <> 'R'
)
SELECT project_id, number, level, codes, flags, l_partkey, l_suppkey FROM q
ORDER BY CASE level WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, o_orderdate, project_id, number, l_partkey, l_suppkey LIMIT 200
""")
def review_queue_topk(spark: SparkSession, d: str) -> DataFrame:
    return review.review_queue(_questions(spark, d), 200, ("l_partkey", "l_suppkey"))


@query("""
SELECT c_custkey AS id, count(o_orderkey) AS questions, count(*) FILTER (o_orderstatus <> 'O') AS approved,
  count(*) FILTER (o_orderstatus = 'F') AS auto_approved, count(*) FILTER (o_orderpriority = '1-URGENT') AS with_errors,
  count(*) FILTER (o_totalprice > 300000) AS with_duplicates
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey
""")
def project_summary(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    q = o.select(F.col("o_custkey").alias("project_id"), F.when(F.col("o_orderstatus") != "O", "approved").otherwise("pending").alias("status"), F.when(F.col("o_orderstatus") == "F", "auto").alias("approved_by"), F.array_compact(F.array(_when(F.col("o_orderpriority") == "1-URGENT", "error", "missing_key"))).alias("issues"), (F.col("o_totalprice") > 300000).cast("int").alias("duplicates"))
    return review.project_summary(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), q)


PRICES = (("view", 1, 5), ("click", 3, 15), ("error", 0, 0), ("signup", 2, 8))


@query("""
WITH p(engine, in_price, out_price) AS (VALUES ('view', 1, 5), ('click', 3, 15), ('error', 0, 0), ('signup', 2, 8))
SELECT user_id, count(*) AS calls, count(*) FILTER (event_id % 4 = 0) AS cached, sum(event_id % 1000)::BIGINT AS input_tokens, sum(event_id % 77)::BIGINT AS output_tokens,
  sum((event_id % 1000) * coalesce(in_price, 0) + (event_id % 77) * coalesce(out_price, 0))::BIGINT AS cost_micro
FROM events LEFT JOIN p ON event_type = engine GROUP BY user_id
""")
def usage_cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("engine"), (F.col("event_id") % 4 == 0).alias("cached"), (F.col("event_id") % 1000).alias("input_tokens"), (F.col("event_id") % 77).alias("output_tokens"))
    return quality.usage_rollup(e, spark.createDataFrame(list(PRICES), "engine string, in_price int, out_price int"), ["user_id"])


@query("SELECT user_id, string_agg(DISTINCT event_type, ' / ' ORDER BY event_type) AS engines, count(*) AS pages, count(*) FILTER (event_type IN ('click', 'view')) AS ai_pages FROM events GROUP BY user_id")
def engine_set_label(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), " / ").alias("engines"), F.count(F.lit(1)).alias("pages"), F.count_if(F.col("event_type").isin("click", "view")).alias("ai_pages"))


@query("""
WITH r(blueprint, range_no, lo, hi, subject_key) AS (VALUES
  ('BAR-1405', 0, 1, 20, 'civil'), ('BAR-1405', 1, 21, 40, 'civil_procedure'), ('BAR-1405', 2, 41, 60, 'commercial'), ('BAR-1405', 3, 61, 70, 'usul_fiqh'),
  ('BAR-1405', 4, 71, 80, 'fiqh_bar'), ('BAR-1405', 5, 81, 100, 'criminal'), ('BAR-1405', 6, 101, 120, 'criminal_procedure'), ('BAR-1405', 7, 121, 140, 'constitutional'),
  ('CENTER-1402', 0, 1, 20, 'civil'), ('CENTER-1402', 1, 21, 40, 'civil_procedure'), ('CENTER-1402', 2, 41, 60, 'commercial'), ('CENTER-1402', 3, 61, 80, 'criminal'),
  ('CENTER-1402', 4, 81, 100, 'criminal_procedure'), ('CENTER-1402', 5, 101, 110, 'fiqh_center'), ('CENTER-1402', 6, 111, 120, 'registration_law'), ('CENTER-1402', 7, 121, 130, 'constitutional')),
p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'BAR-1405' ELSE 'CENTER-1402' END AS blueprint, p_size * 3 AS n FROM part)
SELECT p_partkey, n AS number, subject_key FROM p LEFT JOIN r ON p.blueprint = r.blueprint AND n BETWEEN lo AND hi
""")
def blueprint_range_subject(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "BAR-1405").otherwise("CENTER-1402").alias("blueprint"), (F.col("p_size") * 3).alias("number"))
    ranges = classify.blueprint_ranges(spark).withColumnRenamed("blueprint", "key")
    return classify.first_range(p, ranges, F.col("blueprint"), F.col("number"), ["subject_key"], [F.col("range_no")]).select("p_partkey", "number", "subject_key")


TOPICS = (("a", "general", 1, 100000, 0), ("a", "sales", 10, 30, 1), ("a", "offers", 12, 18, 2), ("a", "transfer", 31, 45, 3), ("b", "courts", 1, 25, 0), ("b", "appeal", 20, 40, 1))


@query("""
WITH t(law, topic, lo, hi, o) AS (VALUES ('a', 'general', 1, 100000, 0), ('a', 'sales', 10, 30, 1), ('a', 'offers', 12, 18, 2), ('a', 'transfer', 31, 45, 3), ('b', 'courts', 1, 25, 0), ('b', 'appeal', 20, 40, 1)),
m AS (SELECT p_partkey, topic, row_number() OVER (PARTITION BY p_partkey ORDER BY hi - lo, o) AS rn FROM part JOIN t ON law = CASE WHEN p_partkey % 3 = 0 THEN 'b' ELSE 'a' END AND p_size BETWEEN lo AND hi)
SELECT p.p_partkey, p_size, topic FROM part p LEFT JOIN m ON p.p_partkey = m.p_partkey AND rn = 1
""")
def most_specific_range(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_size")
    topics = spark.createDataFrame(list(TOPICS), "key string, topic string, lo int, hi int, o int")
    return classify.first_range(p, topics, F.when(F.col("p_partkey") % 3 == 0, "b").otherwise("a"), F.col("p_size"), ["topic"], [F.col("hi") - F.col("lo"), F.col("o")])


@query("""
WITH have AS (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem), m AS (SELECT l_orderkey, max(n) AS top FROM have GROUP BY 1),
gaps AS (SELECT l_orderkey, unnest(generate_series(1, greatest(top, 4))) AS n FROM m EXCEPT SELECT l_orderkey, n FROM have),
runs AS (SELECT l_orderkey, n, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS g FROM gaps),
parts AS (SELECT l_orderkey, min(n) AS lo, max(n) AS hi FROM runs GROUP BY l_orderkey, g)
SELECT l_orderkey, sum(hi - lo + 1)::BIGINT AS n_missing, string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS missing FROM parts GROUP BY l_orderkey
""")
def missing_numbers_gaps(spark: SparkSession, d: str) -> DataFrame:
    from foliant.functions.text import compact_runs

    gaps = issues.missing_numbers(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", F.lit(4))
    return gaps.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_missing"), compact_runs(F.array_sort(F.collect_list("n")), "-", ", ").alias("missing"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS times FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_numbers(spark: SparkSession, d: str) -> DataFrame:
    return issues.duplicate_numbers(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("""
WITH f AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority <> '5-LOW' THEN 4 END AS expected, o_orderstatus = 'F' AS has, count(l_orderkey) AS n, count(DISTINCT l_linenumber) AS k, coalesce(max(l_linenumber), 0) AS top,
    count(*) FILTER (l_tax >= 0.08) AS explained, count(*) FILTER (l_discount = 0.1) AS tabled, count(*) FILTER (l_returnflag = 'N') AS keyless
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderstatus)
SELECT id, concat_ws(',', CASE WHEN n > 0 AND k < greatest(top, coalesce(expected, 0)) THEN 'missing_numbers' END, CASE WHEN n > 0 AND k < n THEN 'duplicate_numbers' END, CASE WHEN expected <> n THEN 'count_mismatch' END,
  CASE WHEN has AND n > 0 AND explained = 0 THEN 'explanations_unmatched' END, CASE WHEN n > 0 AND tabled = 0 AND keyless > 0 THEN 'key_table_missing' END) AS codes FROM f
""")
def project_issue_codes(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    q = l.select(F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").alias("number"), F.when(F.col("l_tax") >= 0.08, "because").otherwise("").alias("explanation"), F.when(F.col("l_discount") == 0.1, "table").otherwise("inline").alias("key_source"), F.when(F.col("l_returnflag") != "N", "1").alias("correct_key"))
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("has_explanations"), F.when(F.col("o_orderpriority") != "5-LOW", 4).alias("expected_count"))
    return issues.project_issues(q, p).select("id", F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("codes"))


@query("""
WITH n AS (SELECT o_orderkey, o_custkey % 5 AS expected, count(l_orderkey) AS found FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT o_orderkey, expected, found FROM n WHERE expected <> found
""")
def count_mismatch(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("found"))
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("expected"))
    return o.join(n, "o_orderkey", "left").na.fill(0, ["found"]).filter("expected <> found").select("o_orderkey", "expected", "found")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents as questions: the first line is the stem, the next four are options."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    parts = F.split("text", "\n", -1)
    options = F.transform(F.slice(parts, 2, 4), lambda x, i: F.struct((i + 1).cast("string").alias("key"), x.alias("text")))
    return docs.select(
        "doc_id", (F.col("doc_id") % 90).cast("int").alias("number"), F.get(parts, F.lit(0)).alias("stem"), options.alias("options"), F.when(F.col("quality") == 1, "1").when(F.col("quality") == 0, "7").alias("correct_key"),
        F.lit("table").alias("key_source"), F.when(F.col("n_chars") % 3 > 0, "").otherwise("long text").alias("explanation"), F.when(F.col("lang") != "es", F.col("lang")).alias("subject_key"), F.when(F.col("n_chars") % 2 == 0, "x").otherwise("").alias("topic"),
        F.array_repeat(F.lit("f"), F.coalesce("toxic", F.lit(0))).alias("flags"), F.array().cast("array<string>").alias("duplicates"), F.array(F.struct(F.lit("law").alias("law"), F.when(F.col("doc_id") % 7 > 0, "k").alias("law_key"))).alias("articles"),
    )


_LABELLED_SQL = r"""
WITH q AS (SELECT d.doc_id, string_split(text, chr(10)) AS parts, CASE quality WHEN 1 THEN '1' WHEN 0 THEN '7' END AS key, n_chars, CASE WHEN lang <> 'es' THEN lang END AS subject, coalesce(toxic, 0) AS flags, d.doc_id % 90 AS number FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
o AS (SELECT *, parts[1] AS stem, parts[2:5] AS opts, list_transform(parts[2:5], lambda x: length(x)) AS lens FROM q),
m AS (SELECT doc_id, i, lens[i] AS len, opts[i] AS text, (SELECT coalesce(median(x), 0) FROM (SELECT unnest(lens) AS x, unnest(range(1, len(lens) + 1)) AS j) WHERE j <> i AND x > 0) AS med FROM o, unnest(range(1, len(opts) + 1)) AS r(i)),
inner_marks AS (SELECT doc_id, i, len > 400 OR (med > 0 AND len > greatest(150, 4 * med)) OR regexp_matches(text, '(^|\s)\(?([1-4]|الف|ب|ج|د)\s*[)\-]\s*[\p{L}_]') AS bad FROM m),
e AS (
  SELECT doc_id, 'error' AS level, 'empty_stem' AS code, 'stem' AS field FROM o WHERE trim(stem) = ''
  UNION ALL SELECT doc_id, 'error', 'option_count', NULL FROM o WHERE len(opts) <> 4
  UNION ALL SELECT doc_id, 'error', 'empty_option', 'option:' || i FROM m WHERE trim(text) = ''
  UNION ALL SELECT doc_id, 'error', 'missing_key', NULL FROM o WHERE key IS NULL
  UNION ALL SELECT doc_id, 'error', 'invalid_key', NULL FROM o WHERE key = '7' OR (key = '1' AND len(opts) > 0 AND len(opts) < 1)
  UNION ALL SELECT doc_id, 'warning', 'missing_explanation', 'explanation' FROM o WHERE n_chars % 3 > 0
  UNION ALL SELECT doc_id, 'warning', 'suspicious_words', NULL FROM o WHERE flags > 0
  UNION ALL SELECT doc_id, 'warning', 'merged_suspect', 'stem' FROM o WHERE regexp_matches(stem || ' ', '(^|\s)' || (number + 1) || '\s*[-.)]\s') OR (regexp_matches(stem, '(^|\s)\(?1\s*[)\-]\s*[\p{L}_]') AND regexp_matches(stem, '(^|\s)\(?2\s*[)\-]\s*[\p{L}_]'))
  UNION ALL SELECT doc_id, 'warning', 'merged_suspect', 'option:' || i FROM inner_marks WHERE bad
  UNION ALL SELECT doc_id, 'warning', 'missing_subject', NULL FROM o WHERE subject IS NULL
  UNION ALL SELECT doc_id, 'warning', 'missing_topic', NULL FROM o WHERE subject IN ('en', 'fr') AND n_chars % 2 = 1
  UNION ALL SELECT doc_id, 'warning', 'article_unknown_law', NULL FROM o WHERE doc_id % 7 = 0
)
"""


@query(_LABELLED_SQL + "SELECT doc_id, level, code, field FROM e")
def issue_rules_long(spark: SparkSession, d: str) -> DataFrame:
    q = _labelled(spark, d).withColumn("issues", issues.question_issues(F.lit(True), ["en", "fr"]))
    return issues.long_form(q, "issues", "doc_id")


@query(_LABELLED_SQL + "SELECT doc_id, flags = 0 AND coalesce(key, '') = '1' AND doc_id NOT IN (SELECT doc_id FROM e WHERE level = 'error' OR code NOT IN ('missing_topic', 'missing_subject', 'article_unknown_law')) AS clean FROM o")
def clean_predicate(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).select("doc_id", issues.is_clean(F.lit(True), ["en", "fr"]).alias("clean"))


@query("""
WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS len FROM lineitem),
p AS (SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, any_value(a.len) AS len, median(b.len) AS med FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND (a.l_linenumber, a.l_partkey, a.l_suppkey) <> (b.l_linenumber, b.l_partkey, b.l_suppkey) GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM p WHERE len > 4 * med
""")
def option_length_outlier(spark: SparkSession, d: str) -> DataFrame:
    """Leave-one-out medians of a group in its row, without a join of its members with each other."""
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("all"))
    key = lambda x: F.struct(x["l_linenumber"], x["l_partkey"], x["l_suppkey"])
    others = lambda x: F.transform(F.filter("all", lambda y: key(y) != key(x)), lambda y: y["l_extendedprice"])
    far = F.filter("all", lambda x: (F.size("all") > 1) & (x["l_extendedprice"] > 4 * issues.median(others(x))))
    return o.select("l_orderkey", F.explode(far).alias("x")).select("l_orderkey", "x.l_linenumber", "x.l_partkey", "x.l_suppkey")


@query("""
WITH keys(place, key) AS (VALUES (0, '2'), (1, '4'), (2, '1'), (3, '3'), (4, NULL), (5, NULL), (6, NULL)),
q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (1 + l_suppkey % 4)::VARCHAR AS old, key FROM lineitem LEFT JOIN keys ON l_linenumber = place + 2)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(key, old) AS correct_key, coalesce(key <> old, false) AS changed, CASE WHEN key <> old THEN 'manual' ELSE 'table' END AS key_source,
  CASE WHEN key <> old THEN 'pending' ELSE 'approved' END AS status FROM q
""")
def key_positional_join(spark: SparkSession, d: str) -> DataFrame:
    from foliant.functions.text import parse_keys

    l = table(spark, d, "lineitem")
    q = l.select(F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").alias("number"), "l_partkey", "l_suppkey", (1 + F.col("l_suppkey") % 4).cast("string").alias("correct_key"), F.lit("table").alias("key_source"), F.lit("approved").alias("status"), F.lit("auto").alias("approved_by"))
    typed = l.select(F.col("l_orderkey").alias("project_id")).distinct().withColumn("keys", parse_keys(F.lit("۲۴۱۳-0x")))
    out = review.apply_keys(q, review.numbered_keys(typed, 2))
    return out.select(F.col("project_id").alias("l_orderkey"), F.col("number").alias("l_linenumber"), "l_partkey", "l_suppkey", "correct_key", "changed", "key_source", "status")


@query("""
WITH k AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN (o_custkey % 4 + 1)::VARCHAR END AS key FROM orders), q AS (SELECT DISTINCT l_orderkey, (l_orderkey % 4)::VARCHAR AS old FROM lineitem WHERE l_linenumber = 1)
SELECT o_orderkey AS project_id, CASE WHEN l_orderkey IS NULL THEN 'missing' WHEN key IS NULL THEN 'skip' WHEN old = '0' THEN 'new' WHEN key = old THEN 'same' ELSE 'change' END AS effect FROM k LEFT JOIN q ON o_orderkey = l_orderkey
""")
def key_preview(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "orders").select(F.col("o_orderkey").alias("project_id"), F.lit(1).alias("number"), F.when(F.col("o_custkey") % 3 > 0, (F.col("o_custkey") % 4 + 1).cast("string")).alias("key"))
    q = table(spark, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("project_id"), F.lit(1).alias("number"), F.when(F.col("l_orderkey") % 4 > 0, (F.col("l_orderkey") % 4).cast("string")).alias("correct_key")).distinct()
    return review.key_preview(q, k).select("project_id", "effect")


@query("""
WITH q AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS place, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
s AS (SELECT *, CASE WHEN l_discount >= 0.09 THEN 0 WHEN l_tax >= 0.07 THEN 1 WHEN l_returnflag <> 'R' THEN 2 END AS severity, (place - 2 - 1 + 2 * n) % n AS ahead FROM q)
SELECT l_orderkey, place, severity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY severity, ahead) AS rn FROM s WHERE severity IS NOT NULL) WHERE rn = 1
""")
def cyclic_next_problem(spark: SparkSession, d: str) -> DataFrame:
    severity = F.when(F.col("l_discount") >= 0.09, 0).when(F.col("l_tax") >= 0.07, 1).when(F.col("l_returnflag") != "R", 2)
    out = review.next_problem(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], severity, F.lit(2))
    return out.select("l_orderkey", F.col("at").cast("long").alias("place"), "severity")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS position FROM events WHERE event_type = 'signup'")
def queue_position(spark: SparkSession, d: str) -> DataFrame:
    return review.queue_positions(table(spark, d, "events"), ["ts", "event_id"], F.col("event_type") != "signup").select("event_id", F.col("position").cast("long").alias("position"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem WHERE l_returnflag = 'A'")
def renumber_export(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").filter("l_returnflag = 'A'")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", n.cast("long").alias("n"))


@query("""
WITH b AS (SELECT CASE WHEN o_custkey % 4 > 0 THEN (o_custkey % 50)::VARCHAR ELSE 'p' || o_orderkey END AS batch, o_orderkey, o_orderstatus FROM orders)
SELECT batch, min(o_orderkey) AS first_at, count(*) AS projects, count(*) FILTER (o_orderstatus = 'F') AS ready, count(*) FILTER (o_orderstatus = 'P') AS failed FROM b GROUP BY batch
""")
def batch_first_appearance(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 4 > 0, F.col("o_custkey") % 50).alias("batch_id"), F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "P", "failed").alias("status"))
    return review.batches(o, "batch_id", "o_orderkey", "o_orderkey")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), '7') OR p_partkey::VARCHAR = '7'")
def nav_search(spark: SparkSession, d: str) -> DataFrame:
    return review.search(table(spark, d, "part"), "7", ["p_name", "p_brand", "p_type"], "p_partkey").select("p_partkey", "p_name", "p_brand")


@query("""
WITH v AS (SELECT DISTINCT p_partkey, CASE WHEN p_size > 40 THEN NULL ELSE unnest(string_split(p_name || ' ' || p_type, ' ')) END AS value FROM part)
SELECT value, count(*) AS rows, min(p_partkey) AS first_number FROM v GROUP BY value
""")
def multi_valued_group(spark: SparkSession, d: str) -> DataFrame:
    values = F.when(F.col("p_size") <= 40, F.split(F.concat_ws(" ", "p_name", "p_type"), " "))
    return review.grouped(table(spark, d, "part"), values, "p_partkey")


@query("WITH v AS (SELECT DISTINCT l_orderkey, l_partkey % 100 AS value FROM lineitem) SELECT value, count(*) AS rows FROM v GROUP BY value ORDER BY rows DESC, value LIMIT 20")
def topn_with_ties(spark: SparkSession, d: str) -> DataFrame:
    return review.most_frequent(table(spark, d, "lineitem"), F.array(F.col("l_partkey") % 100), ["l_orderkey"], 20)


@query("""
WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name, p_type, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'N')
SELECT l_orderkey AS project_id, count(*) AS questions, sha256('[' || string_agg('{"source_number":' || l_linenumber || ',"stem_html":"<p>' || p_name || ' &amp; ' || p_type || '</p>","options":[{"key":"1","order":1,"text_html":"' || p_brand || '"},{"key":"2","order":2,"text_html":"&lt;b&gt;"}]}', ',' ORDER BY l_linenumber, l_partkey, l_suppkey) || ']') AS payload_sha256
FROM q GROUP BY l_orderkey
""")
def nested_export_payload(spark: SparkSession, d: str) -> DataFrame:
    from foliant.functions import text as t

    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_brand")
    l = table(spark, d, "lineitem").filter("l_returnflag <> 'N'").join(p, "l_partkey")
    stem = t.html_paragraphs(F.concat("p_name", F.lit(" & "), "p_type"))
    options = F.array_sort(F.array(F.struct(F.lit("2").alias("key"), F.lit("<b>").alias("text")), F.struct(F.lit("1").alias("key"), F.col("p_brand").alias("text"))))
    shown = F.transform(options, lambda o, i: F.struct(o["key"].alias("key"), (i + 1).alias("order"), t.escape_html(o["text"]).alias("text_html")))
    q = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.struct(F.col("l_linenumber").alias("source_number"), stem.alias("stem_html"), shown.alias("options")).alias("payload"))
    out = l.groupBy(F.col("l_orderkey").alias("project_id")).agg(F.array_sort(F.collect_list(q)).alias("all"))
    return out.select("project_id", F.size("all").cast("long").alias("questions"), F.sha2(F.to_json(F.transform("all", lambda x: x["payload"])), 256).alias("payload_sha256"))


@query("""
WITH n AS (SELECT o_orderkey, regexp_replace(o_orderpriority, '[^0-9A-Z]+', ' ', 'g') AS safe FROM orders)
SELECT o_orderkey, CASE WHEN rn = 1 THEN safe ELSE safe || ' (' || rn || ')' END AS file_name FROM (SELECT *, row_number() OVER (PARTITION BY safe ORDER BY o_orderkey) AS rn FROM n)
""")
def unique_file_names(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("title", F.regexp_replace("o_orderpriority", "[^0-9A-Z]+", ":"))
    return export.unique_names(o, "title", "o_orderkey").select("o_orderkey", "file_name")


@query("""
WITH s AS (SELECT l_partkey, epoch(l_shipdate)::BIGINT // 86400 AS lo, epoch(l_shipdate)::BIGINT // 86400 + 20 AS hi FROM lineitem),
m AS (SELECT *, max(hi) OVER (PARTITION BY l_partkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
b AS (SELECT *, sum(CASE WHEN lo - reach > 5 OR reach IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY l_partkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS band FROM m)
SELECT l_partkey, min(lo) AS lo, max(hi) AS hi, count(*) AS spans FROM b GROUP BY l_partkey, band
""")
def interval_merge_bands(spark: SparkSession, d: str) -> DataFrame:
    # seconds round and days are cut towards 1970, as the SQL has them
    seconds = "cast(rint(cast(cast(cast(l_shipdate - timestamp_ntz'1970-01-01' AS interval second) AS decimal(18, 6)) AS double)) AS bigint)"
    s = table(spark, d, "lineitem").select("l_partkey", F.expr(f"{seconds} div 86400").alias("lo"))
    return lines.merge_bands(s.withColumn("hi", F.col("lo") + 20), ["l_partkey"], "lo", "hi", 5)


@query("""
SELECT l_orderkey, min(l_quantity) AS x0, min(l_discount) AS y0, max(l_quantity + l_tax) AS x1, max(l_discount + l_tax) AS y1 FROM lineitem GROUP BY l_orderkey
""")
def bbox_union_per_group(spark: SparkSession, d: str) -> DataFrame:
    from foliant.functions import geometry as g

    b = g.box(F.col("l_quantity"), F.col("l_discount"), F.col("l_quantity") + F.col("l_tax"), F.col("l_discount") + F.col("l_tax"))
    return table(spark, d, "lineitem").withColumn("b", b).groupBy("l_orderkey").agg(g.union_agg(F.col("b")).alias("u")).select("l_orderkey", "u.x0", "u.y0", "u.x1", "u.y1")


@query("SELECT event_id, user_id, cached OR rn <= 5 AS granted FROM (SELECT *, event_type = 'view' AS cached, row_number() OVER (PARTITION BY user_id, event_type = 'view' ORDER BY ts, event_id) AS rn FROM events)")
def budget_rank_cap(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("cached", F.col("event_type") == "view")
    return quality.within_budget(e, "user_id", ["ts", "event_id"], 5).select("event_id", "user_id", "granted")


@query("""
WITH v AS (SELECT n_nationkey, o_orderpriority AS priority, sum(CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'O' THEN 3 ELSE 2 END)::BIGINT AS score FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY score DESC, priority) AS rn, sum(score) OVER (PARTITION BY n_nationkey)::BIGINT AS total, coalesce(lead(score) OVER (PARTITION BY n_nationkey ORDER BY score DESC, priority), 0) AS runner_up FROM v)
SELECT n_nationkey, priority AS winner, score, total, runner_up FROM r WHERE rn = 1
""")
def weighted_vote(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    weight = F.when(F.col("o_orderstatus") == "F", 4).when(F.col("o_orderstatus") == "O", 3).otherwise(2)
    return classify.vote(o.withColumn("weight", weight), ["n_nationkey"], "o_orderpriority", "weight")


@query("""
WITH v AS (SELECT l_suppkey, l_returnflag, sum(CASE WHEN l_quantity > 25 THEN 3 ELSE 2 END)::BIGINT AS score FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, l_returnflag) AS rn, coalesce(lead(score) OVER (PARTITION BY l_suppkey ORDER BY score DESC, l_returnflag), 0) AS runner FROM v)
SELECT l_suppkey, l_returnflag AS winner, score, runner AS runner_up FROM r WHERE rn = 1 AND score * 10 >= runner * 11
""")
def runner_up_margin(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").withColumn("weight", F.when(F.col("l_quantity") > 25, 3).otherwise(2))
    return classify.vote(l, ["l_suppkey"], "l_returnflag", "weight").filter("score * 10 >= runner_up * 11").select("l_suppkey", "winner", "score", "runner_up")
