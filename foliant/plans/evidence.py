"""Citations, headings, votes, corrections, boxes and small listings over parts, orders and customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import geometry as g
from foliant.operators import classify, quality, reconcile, records
from foliant.plans.registry import query, table


def _case(n: int, *values: Column) -> Column:
    """One of n values, by the part's key."""
    return F.element_at(F.array(*values), (F.col("p_partkey") % n + 1).cast("int"))


@query("""
SELECT p_partkey, place, coalesce(n, p_size::VARCHAR) AS number, law_key, source FROM part, (VALUES (0, '10', 'civil', 'text'), (1, NULL, 'penal', 'text'), (2, '3', 'penal', 'rules'), (3, '40', 'constitution', 'text')) AS c(place, n, law_key, source)
""")
def law_citations(spark: SparkSession, d: str) -> DataFrame:
    """Articles with the law that follows them, or that of the citation before."""
    p = table(spark, d, "part")
    text = F.concat(F.lit("ماده ۱۰ قانون مدنی و ماده "), F.col("p_size").cast("string"), F.lit(" از ق.م.ا و ماده ۳ و اصل ۴۰ "), "p_name")
    c = p.select("p_partkey", F.posexplode(classify.citations(text)).alias("place", "c")).select("p_partkey", "place", "c.kind", F.element_at("c.numbers", 1).alias("number"), "c.after")
    aliases = spark.createDataFrame([("قانون مدنی", "civil"), ("ق.م", "civil"), ("ق.م.ا", "penal"), ("قانون", "other")], "name string, law_key string")
    return classify.carried_law(classify.law_after(c, "after", aliases), ["p_partkey"], ["place"]).select("p_partkey", "place", "number", "law_key", "source")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'civil' WHEN 1 THEN 'commercial' WHEN 3 THEN 'usul_fiqh' END AS subject FROM part")
def innermost_subjects(spark: SparkSession, d: str) -> DataFrame:
    path = _case(4, F.array(F.lit("درس حقوق مدنی"), F.lit("فصل اول")), F.array(F.lit("حقوق مدنی"), F.lit("حقوق تجارت")), F.array("p_name"), F.array(F.lit("اصول فقه و متون فقه"), F.col("p_name")))
    return table(spark, d, "part").select("p_partkey", classify.innermost_heading(path, classify.subject_names(spark)).alias("subject"))


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 20 THEN 'narrow' ELSE 'wide' END AS topic, CASE WHEN p_size BETWEEN 10 AND 20 THEN 0.65 ELSE 0.85 END::DOUBLE AS confidence FROM part")
def article_topics(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "part").select("p_partkey", F.lit("civil").alias("law_key"), F.col("p_size").cast("string").alias("number"), F.lit("stem").alias("field"), F.lit("text").alias("source"))
    ranges = spark.createDataFrame([("civil", "wide", 1, 60, 0, False), ("civil", "narrow", 10, 20, 1, True)], "law_key string, topic string, lo int, hi int, topic_order int, unverified boolean")
    return classify.topic_from_articles(a, ranges, ["p_partkey"])


@query("SELECT p_partkey, 'civil' AS subject, CASE WHEN p_size % 2 = 0 THEN 0.75 ELSE 0.77 END::DOUBLE AS confidence FROM part")
def article_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Two articles vote: a stem's counts 4, an option's 3; ties go to the name."""
    two = F.array(F.struct(F.lit("c1").alias("law_key"), F.lit("stem").alias("field")), F.struct(F.lit("p1").alias("law_key"), F.when(F.col("p_size") % 2 == 0, "stem").otherwise("option:1").alias("field")), F.struct(F.lit("none").alias("law_key"), F.lit("stem").alias("field")))
    a = table(spark, d, "part").select("p_partkey", F.explode(two).alias("a")).select("p_partkey", "a.law_key", "a.field", F.lit("text").alias("source"))
    laws = spark.createDataFrame([("c1", "civil"), ("p1", "criminal"), ("none", None)], "law_key string, subject_key string")
    return classify.subject_from_articles(a, laws, ["p_partkey"])


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'عقود' WHEN 1 THEN 'اموال و مالکیت' ELSE p_name END AS topic, CASE p_partkey % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.85 ELSE 0.7 END::DOUBLE AS confidence FROM part
""")
def heading_topics(spark: SparkSession, d: str) -> DataFrame:
    path = _case(3, F.array(F.lit("بخش"), F.lit("فصل اول: عقود")), F.array(F.lit("اموال مالکیت")), F.array("p_name"))
    topics = spark.createDataFrame([("civil", "عقود", 0), ("civil", "اموال و مالکیت", 1)], "subject_key string, topic string, topic_order int")
    return classify.topic_from_heading(table(spark, d, "part").select("p_partkey", F.lit("civil").alias("subject_key"), path.alias("path")), "path", topics, ["p_partkey"])


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'manual' WHEN p_size % 3 = 1 THEN 'text' ELSE 'rules' END AS source, CASE WHEN p_size % 3 = 1 THEN 'stem' ELSE 'option:1' END AS field FROM part
""")
def primary_articles(spark: SparkSession, d: str) -> DataFrame:
    """Manual before text before rules, then by field."""
    one = lambda source, field: F.struct(source.alias("source"), F.lit(field).alias("field"))
    kind = F.when(F.col("p_size") % 3 == 0, "manual").otherwise("rules")
    articles = F.when(F.col("p_size") % 3 == 1, F.array(one(F.lit("rules"), "stem"), one(F.lit("text"), "explanation"), one(F.lit("text"), "stem"))).otherwise(F.array(one(F.lit("rules"), "explanation"), one(kind, "option:1")))
    a = classify.primary_article(articles)
    return table(spark, d, "part").select("p_partkey", a["source"].alias("source"), a["field"].alias("field"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 3 <> 0 THEN 'X' ELSE o_orderstatus END AS subject_key, CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 3 <> 0 THEN 'ai' WHEN o_custkey % 3 = 0 THEN 'manual' ELSE 'rules' END AS subject_source,
  CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 3 <> 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS subject_confidence, o_orderpriority AS topic, 'rules' AS topic_source FROM orders
""")
def merged_classification(spark: SparkSession, d: str) -> DataFrame:
    """What an AI says replaces what no person chose; a confidence beyond 1 is 1."""
    o = table(spark, d, "orders")
    q = o.select(F.lit(1).alias("project_id"), F.col("o_orderkey").alias("number"), F.col("o_orderstatus").alias("subject_key"), F.lit(0.5).alias("subject_confidence"), F.when(F.col("o_custkey") % 3 == 0, "manual").otherwise("rules").alias("subject_source"), F.col("o_orderpriority").alias("topic"), F.lit(0.5).alias("topic_confidence"), F.lit("rules").alias("topic_source"))
    a = o.filter("o_orderkey % 2 = 0").select(F.lit(1).alias("project_id"), F.col("o_orderkey").alias("number"), F.lit("X").alias("subject"), F.lit(None).cast("string").alias("topic"), F.lit(1.5).alias("confidence"))
    return reconcile.merge_classification(q, a).select(F.col("number").alias("o_orderkey"), "subject_key", "subject_source", "subject_confidence", "topic", "topic_source")


def _line(spark: SparkSession, d: str, *texts: Column) -> DataFrame:
    """A line of each part, its second word flagged."""
    w = table(spark, d, "part").select("p_partkey", F.posexplode(F.array(*texts)).alias("pos", "text"))
    return w.select(F.lit("d").alias("doc"), F.col("p_partkey").alias("page"), F.lit(0).alias("line"), "pos", "text", F.when(F.col("pos") == 1, "low_conf").alias("flag"))


@query("""
SELECT p_partkey AS page, 0 AS pos, 'alpha' AS text, NULL AS flag FROM part UNION ALL SELECT p_partkey, 3, p_brand, NULL FROM part
UNION ALL SELECT p_partkey, 1, 'wrong word', NULL FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 1, 'wrng', CASE WHEN p_partkey % 3 <> 0 THEN 'low_conf' END FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT p_partkey, 2, 'word', NULL FROM part WHERE p_partkey % 2 = 1
""")
def corrections_applied(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of two words corrected on even pages; lines that were checked lose their doubts."""
    words = _line(spark, d, F.lit("alpha"), F.lit("wrng"), F.lit("word"), F.col("p_brand"))
    p = table(spark, d, "part").select(F.lit("d").alias("doc"), F.col("p_partkey").alias("page"), F.lit(0).alias("line"))
    wanted = p.filter("page % 2 = 0").select("*", F.lit("wrng word").alias("wrong"), F.lit("wrong word").alias("right"))
    return reconcile.apply_corrections(words, wanted, p.filter("page % 3 = 0")).select("page", "pos", "text", "flag")


@query("""
SELECT p_partkey AS page, line, CASE WHEN line = 1 THEN 'correct' ELSE 'context' END AS role, CASE WHEN line = 1 THEN p_brand || ' ⟦x⟧' ELSE p_brand || ' x' END AS text FROM part, (VALUES (0), (1), (2)) AS l(line)
""")
def correction_context(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "part").select(F.lit("d").alias("doc"), F.col("p_partkey").alias("page"), F.explode(F.array(*map(F.lit, range(5)))).alias("line"), "p_brand")
    w = w.select("doc", "page", "line", F.posexplode(F.array("p_brand", F.lit("x"))).alias("pos", "text")).withColumn("flag", F.when((F.col("line") == 1) & (F.col("pos") == 1), "low_conf"))
    return reconcile.correction_lines(w).select("page", "line", "role", "text")


@query("""
WITH f AS (SELECT p_partkey, (p_size % 3) / 4.0 AS f FROM part)
SELECT p_partkey AS page, round(0.30 * greatest(0, least(1, 1 - f / 0.30)) + 0.35 * (0.2 / 0.55) + 0.20 * 0.8 + 0.15, 3)::DOUBLE AS quality FROM f
""")
def page_scores(spark: SparkSession, d: str) -> DataFrame:
    """Four words: one in the lexicon, one not, a number and a Latin word."""
    p = table(spark, d, "part")
    w = p.select(F.lit("d").alias("doc"), F.col("p_partkey").alias("page"), "p_size", F.posexplode(F.array(*map(F.lit, ("کتاب", "خانه", "12)", "abc")))).alias("pos", "text"))
    w = w.withColumns({"conf": F.lit(80.0), "flag": F.when(F.col("pos") < F.col("p_size") % 3, "low_conf")})
    pages = p.select(F.lit("d").alias("doc"), F.col("p_partkey").alias("page"), F.lit(None).cast("double").alias("ink_ratio"))
    return quality.page_quality(w, spark.createDataFrame([("کتاب",)], "word string"), pages).select("page", "quality")


def _question(spark: SparkSession, d: str) -> DataFrame:
    option = lambda key, text: F.struct(F.lit(key).alias("key"), text.alias("text"))
    return table(spark, d, "part").select("p_partkey", F.col("p_name").alias("stem"), F.array(option("1", F.col("p_brand")), option("2", F.lit(""))).alias("options"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("explanation"))


@query("SELECT p_partkey, 'stem' AS field, p_name AS text FROM part UNION ALL SELECT p_partkey, 'option:1', p_brand FROM part UNION ALL SELECT p_partkey, 'explanation', p_type FROM part WHERE p_size % 2 = 0")
def question_field_rows(spark: SparkSession, d: str) -> DataFrame:
    return records.question_fields(_question(spark, d), ["p_partkey"]).select("p_partkey", "field", "text")


@query("SELECT o_custkey, o_orderstatus AS kind, o_orderpriority AS number, min(o_orderkey) AS first_order FROM orders GROUP BY ALL")
def distinct_citations(spark: SparkSession, d: str) -> DataFrame:
    """Orders as citations of a customer: the first of each kind and number."""
    a = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.lit("civil").alias("law_key"), F.lit("").alias("law"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("number"), F.lit("").alias("clause"))
    return records.distinct_articles(a, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "kind", "number", F.col("o_orderkey").alias("first_order"))


@query("""
SELECT o_custkey AS project_id, CASE WHEN count(*) FILTER (o_orderkey % 3 = 0 AND o_orderstatus <> 'P') >= 3 OR count(*) FILTER (o_orderkey % 3 = 0 AND o_orderstatus <> 'P') * 2 >= count(*) THEN 'questions' ELSE 'text' END AS mode FROM orders GROUP BY o_custkey
""")
def project_modes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), F.when(F.col("o_orderstatus") != "P", "stem").alias("stem"), F.array_repeat(F.lit("x"), F.when(F.col("o_orderkey") % 3 == 0, 4).otherwise(2)).alias("options"))
    return records.detect_mode(o)


@query("""
WITH c AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'O' AS e FROM orders), r AS (SELECT *, sum(CASE WHEN e THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS g FROM c),
n AS (SELECT o_custkey, g, count(*) FILTER (e) AS n FROM r GROUP BY ALL) SELECT o_custkey, max(n) AS longest FROM n GROUP BY o_custkey
""")
def longest_empty_runs(spark: SparkSession, d: str) -> DataFrame:
    return records.longest_run(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", F.col("o_orderstatus") == "O")


@query("""
WITH l AS (SELECT o_custkey AS page, o_orderkey AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderkey % 7 AS k FROM orders),
y AS (SELECT page, n, i * 10.0 + k AS y0, i * 10.0 + k + 4 AS y1, k / 10.0 AS x0 FROM l), p AS (SELECT *, lead(y0) OVER (PARTITION BY page ORDER BY n) - y1 AS gap FROM y)
SELECT page, list_sort(list(gap) FILTER (gap > 0))[count(gap) FILTER (gap > 0) // 2 + 1]::DOUBLE AS gap, min(x0)::DOUBLE AS "left" FROM p GROUP BY page
""")
def usual_gaps(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    i, k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")), F.col("o_orderkey") % 7
    l = table(spark, d, "orders").select(F.lit("d").alias("doc"), F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("line_no"), (i * 10.0 + k).alias("y0"), (i * 10.0 + k + 4).alias("y1"), (k / 10.0).alias("x0"))
    return records.usual_gap(l).select("page", "gap", "left")


@query("""
SELECT c_custkey AS project_id, CASE WHEN c_custkey % 5 = 0 THEN 'not_ready' WHEN c_custkey % 7 = 0 THEN 'no_questions' WHEN count(o_orderkey) FILTER (o_orderstatus = 'F') = 0 THEN 'nothing_approved' ELSE 'send' END AS outcome, count(o_orderkey) FILTER (o_orderstatus = 'F') AS questions
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey
""")
def push_outcomes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 == 0, "processing").otherwise("ready").alias("status"), F.when(F.col("c_custkey") % 7 == 0, "text").otherwise("questions").alias("mode"))
    q = table(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending").alias("status"))
    return records.push_results(p, q)


@query("""
SELECT string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (o_orderstatus = 'P') AS running, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) FILTER (o_orderstatus = 'F' AND o_totalprice > 400000) AS waiting FROM orders
""")
def queue_states(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "processing").when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000), "queued").otherwise("done")
    s = records.queue_state(table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderdate").alias("submitted_at")))
    shown = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return s.select(shown(F.col("running")).alias("running"), shown(F.col("waiting")).alias("waiting"))


@query("SELECT p_brand AS subject_key, string_agg(p_type, '|' ORDER BY p_partkey) AS topics FROM part GROUP BY p_brand")
def topic_listing(spark: SparkSession, d: str) -> DataFrame:
    t = records.topic_lists(table(spark, d, "part").select(F.col("p_brand").alias("subject_key"), F.col("p_partkey").alias("topic_order"), F.col("p_type").alias("topic")))
    return t.select("subject_key", F.array_join("topics", "|").alias("topics"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'approved' WHEN o_orderkey % 3 = 0 THEN 'error' WHEN o_orderkey % 3 = 1 OR o_custkey % 4 = 0 THEN 'warning' ELSE 'neutral' END AS state, CASE WHEN o_orderkey % 3 = 2 THEN 0 WHEN o_custkey % 2 = 0 THEN 0 ELSE 1 END AS open FROM orders
""")
def question_states(spark: SparkSession, d: str) -> DataFrame:
    """What a list shows, and how many issues are left of fields that weren't edited."""
    one = lambda level: F.array(F.struct(F.lit(level).alias("level"), F.lit("x").alias("code"), F.lit("stem").alias("field")))
    found = F.when(F.col("o_orderkey") % 3 == 0, one("error")).when(F.col("o_orderkey") % 3 == 1, one("warning")).otherwise(F.array().cast("array<struct<level:string,code:string,field:string>>"))
    edited = F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("stem"))).otherwise(F.array().cast("array<string>"))
    state = records.states(found, (F.col("o_custkey") % 4 == 0).cast("int"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending"))
    return table(spark, d, "orders").select("o_orderkey", state.alias("state"), F.size(records.open_issues(found, edited)).alias("open"))


@query("""
WITH b AS (SELECT p_partkey, p_size / 100.0 AS s FROM part)
SELECT p_partkey, 0.1 AS ux0, greatest(0.5, 0.2 + s) AS ux1, least(0.2, 0.1 + s) - 0.1 > 0.05 AS same_row, round(0.5 - 0.2 / 2, 6) AS part_x0, round(0.5 + 0.1 * 0.5, 6) AS page_x0, s BETWEEN 0.1 AND 0.3 AS inside, abs(s - 0.3) < 0.002 AS near_equal, (0.2 + s - 0.1) * 1.0 >= 0.5 AS covers, least(300, greatest(36, floor(least(300, 72 + p_partkey % 400))))::INTEGER AS dpi
FROM b
""")
def box_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """Union, rows, parts, crops, containment, equality and coverage of boxes made from sizes."""
    s = F.col("p_size") / 100.0
    lit = lambda *v: g.box(*map(F.lit, v))
    union = g.union_of(F.array(lit(0.3, 0.0, 0.5, 0.1), g.box(F.lit(0.1), F.lit(0.0), 0.2 + s, F.lit(1.0)), F.lit(None).cast(g.BOX)))
    row = g.same_row(lit(0.0, 0.1, 0.1, 0.2), g.box(F.lit(0.2), F.lit(0.0), F.lit(0.3), 0.1 + s))
    part = g.split_box(lit(0.3, 0.0, 0.5, 0.1), F.lit(2))[0]["x0"]
    page = g.to_page(lit(0.1, 0.0, 0.2, 1.0), lit(0.5, 0.0, 1.0, 1.0))["x0"]
    return table(spark, d, "part").select(
        "p_partkey", union["x0"].alias("ux0"), union["x1"].alias("ux1"), row.alias("same_row"), F.round(part, 6).alias("part_x0"), F.round(page, 6).alias("page_x0"),
        g.holds(lit(0.1, 0.0, 0.3, 1.0), s, F.lit(0.5)).alias("inside"), g.near_equal(g.box(s, s, s, s), lit(0.3, 0.3, 0.3, 0.3)).alias("near_equal"),
        g.covers_page(g.box(F.lit(0.1), F.lit(0.0), 0.2 + s, F.lit(1.0)), 0.5).alias("covers"), g.effective_dpi(F.lit(300), 72 + F.col("p_partkey") % 400, F.lit(8.0), F.lit(11.0)).alias("dpi"),
    )
