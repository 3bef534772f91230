"""Subjects, topics and law articles: range joins, votes, keyword scores, and the order in which evidence counts.

Dimensions (subjects, blueprints, laws, topics) are tables that the caller passes; the fixed ones are below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as t

# Subjects with their other names, and question ranges of the exams.
SUBJECTS = (
    ("civil", "حقوق مدنی", ("مدنی",)),
    ("civil_procedure", "آیین دادرسی مدنی", ("آ.د.م", "دادرسی مدنی")),
    ("commercial", "حقوق تجارت", ("تجارت",)),
    ("usul_fiqh", "اصول فقه", ("اصول", "اصول فقه و متون فقه")),
    ("fiqh_bar", "متون فقه کانون وکلا", ("متون فقه کانون", "متون فقه کانون وکلای دادگستری")),
    ("criminal", "حقوق جزا", ("جزا", "حقوق کیفری")),
    ("criminal_procedure", "آیین دادرسی کیفری", ("آ.د.ک", "دادرسی کیفری")),
    ("constitutional", "حقوق اساسی", ("اساسی",)),
    ("fiqh_center", "متون فقه مرکز وکلا", ("متون فقه مرکز", "متون فقه مرکز وکلای قوه قضاییه")),
    ("registration_law", "حقوق ثبت مرکز وکلا", ("حقوق ثبت", "ثبت", "حقوق ثبت مرکز")),
)
_BAR = ((1, 20, "civil"), (21, 40, "civil_procedure"), (41, 60, "commercial"), (61, 70, "usul_fiqh"), (71, 80, "fiqh_bar"), (81, 100, "criminal"), (101, 120, "criminal_procedure"), (121, 140, "constitutional"))
_CENTER = ((1, 20, "civil"), (21, 40, "civil_procedure"), (41, 60, "commercial"), (61, 80, "criminal"), (81, 95, "criminal_procedure"), (96, 110, "fiqh_center"), (111, 125, "registration_law"), (126, 135, "constitutional"))
_CENTER_1402 = ((1, 20, "civil"), (21, 40, "civil_procedure"), (41, 60, "commercial"), (61, 80, "criminal"), (81, 100, "criminal_procedure"), (101, 110, "fiqh_center"), (111, 120, "registration_law"), (121, 130, "constitutional"))
BLUEPRINTS = (("BAR-1405", "bar", 1405, 140, 170, _BAR), ("CENTER-1404", "center", 1404, 135, 150, _CENTER), ("CENTER-1405", "center", 1405, 135, 150, _CENTER), ("CENTER-1402", "center", 1402, 130, 150, _CENTER_1402))
HEADING_FILLER = ("درس", "بخش", "قسمت", "مبحث", "دروس", "سوال", "سوالات", "سوالهای", "سوالها", "از", "تا", "شماره", "اول", "دوم", "سوم", "چهارم", "پنجم", "ششم", "هفتم", "هشتم", "نهم", "دهم")


#: A dimension of no more rows than this is broadcast.
DIMENSION = 100_000


def small(dimension: DataFrame, most: int = DIMENSION) -> DataFrame:
    """The dimension, to be broadcast if its rows have been counted to be few; joined by shuffle otherwise."""
    return F.broadcast(dimension) if dimension.limit(most + 1).count() <= most else dimension


def blueprint_ranges(spark: SparkSession) -> DataFrame:
    """(blueprint, range_no, lo, hi, subject_key)"""
    rows = [(code, i, lo, hi, s) for code, _, _, _, _, ranges in BLUEPRINTS for i, (lo, hi, s) in enumerate(ranges)]
    return spark.createDataFrame(rows, "blueprint string, range_no int, lo int, hi int, subject_key string")


def subject_names(spark: SparkSession) -> DataFrame:
    """(heading, subject_key): comparison forms of all names, also without their spaces."""
    rows = spark.createDataFrame([(k, n) for k, name, more in SUBJECTS for n in (name, *more)], "subject_key string, name string")
    form = t.comparison_form(F.col("name"))
    rows = rows.select("subject_key", F.explode(F.array_distinct(F.array(form, F.replace(form, F.lit(" "), F.lit(""))))).alias("heading"))
    return rows.dropDuplicates(["heading"]).select("heading", "subject_key")


def heading_key(text: Column) -> Column:
    """What is left of a short heading without filler words and numbers; null if it isn't one."""
    words = F.split(t.comparison_form(text), " ")
    kept = F.filter(words, lambda w: ~w.isin(*HEADING_FILLER) & ~w.rlike(r"^\p{Nd}+$") & (w != ""))
    return F.when((F.size(words) <= 10) & F.size(kept).between(1, 6), F.array_join(kept, " "))


def in_range(rows: DataFrame, ranges: DataFrame, key: str, value: str, order: str, most: int = DIMENSION) -> DataFrame:
    """rows with the first range of their key that holds the value (left join). ranges: key, lo, hi, order and more.

    Ranges are a dimension: they are broadcast while they are few, and joined by key otherwise.
    """
    few = small(ranges, most)
    mine = rows.withColumn("_row", F.monotonically_increasing_id())
    hit = mine.join(few, (mine[key] == few[key]) & F.col(value).between(F.col("lo"), F.col("hi"))).drop(few[key])
    first = Window.partitionBy("_row").orderBy(order)
    hit = hit.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").select("_row", *[c for c in few.columns if c != key])
    return mine.join(hit, "_row", "left").drop("_row")


def first_range(rows: DataFrame, ranges: DataFrame, key: Column, value: Column, take: list[str], order: list[Column]) -> DataFrame:
    """The same with ranges in the row: each key's ranges are one array, so no pair of row and range is ever a row."""
    packed = ranges.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], "lo", "hi", *take))).alias("ranges"))
    out = rows.withColumn("key", key).join(small(packed), "key", "left")
    hit = F.get(F.filter(F.coalesce("ranges", F.array().cast(packed.schema["ranges"].dataType)), lambda r: value.between(r["lo"], r["hi"])), F.lit(0))
    return out.withColumn("hit", hit).select(*rows.columns, *[F.col(f"hit.{c}").alias(c) for c in take])


def field_weight(field: Column) -> Column:
    """In halves, so that sums are exact: stem 4, an option 3, anything else 2."""
    return F.when(field == "stem", 4).when(field.startswith("option:"), 3).otherwise(2)


def vote(ballots: DataFrame, group: list[str], choice: str, weight: str) -> DataFrame:
    """group, winner, score, total, runner_up: the choice with most weight, ties by its name."""
    s = ballots.groupBy(*group, choice).agg(F.sum(weight).alias("score"))
    w = Window.partitionBy(*group)
    order = w.orderBy(F.desc("score"), choice)
    s = s.withColumn("nth", F.row_number().over(order)).withColumn("total", F.sum("score").over(w)).withColumn("runner_up", F.coalesce(F.lead("score").over(order), F.lit(0)))
    return s.filter("nth = 1").select(*group, F.col(choice).alias("winner"), "score", "total", "runner_up")


def dominant(rows: DataFrame, group: list[str], choice: str, percent: int = 60, least: int = 2) -> DataFrame:
    """group, hint: the most frequent choice where it has the given share and count."""
    v = vote(rows.filter(F.col(choice).isNotNull()).withColumn("one", F.lit(1)), group, choice, "one")
    return v.filter((F.col("score") >= least) & (F.col("score") * 100 >= F.col("total") * percent)).select(*group, F.col("winner").alias("hint"), "score", "total")


def keyword_scores(texts: DataFrame, keywords: DataFrame, ids: list[str], form=t.comparison_form) -> DataFrame:
    """ids, topic, score (in quarters): keywords within texts, at word bounds, once for each field.

    texts: ids, field, text (one row for each field); keywords: topic, keyword. A phrase counts 2, a word of up to 3 letters 0.5, another 1, times the
    weight of the field. Single words are an equi-join on tokens; phrases are looked for among the texts that hold their
    first word.
    """
    kw = keywords.select("topic", form(F.col("keyword")).alias("kw")).filter("kw <> ''")
    base = F.when(F.contains("kw", F.lit(" ")), 4).when(F.char_length("kw") <= 3, 1).otherwise(2)
    kw = kw.withColumn("base", base).withColumn("token", F.substring_index("kw", " ", 1))
    single, phrases = small(kw.filter(~F.contains("kw", F.lit(" ")))), kw.filter(F.contains("kw", F.lit(" ")))
    plain = texts.select(*ids, "field", form(F.col("text")).alias("plain"))
    words = F.array_distinct(F.split("plain", " "))
    hit = plain.select(*ids, "field", F.explode(words).alias("token")).join(single, "token").select(*ids, "field", "topic", "kw", "base")
    # a text is carried on only beside words that begin a phrase
    firsts = [r.token for r in phrases.select("token").distinct().limit(DIMENSION + 1).collect()]
    begins = F.filter(words, lambda w: w.isin(firsts)) if len(firsts) <= DIMENSION else words
    whole = F.contains(F.concat(F.lit(" "), F.col("plain"), F.lit(" ")), F.concat(F.lit(" "), F.col("kw"), F.lit(" ")))
    found = plain.select(*ids, "field", "plain", F.explode(begins).alias("token")).join(small(phrases), "token").filter(whole)
    hit = hit.unionByName(found.select(*ids, "field", "topic", "kw", "base"))
    return hit.select(*ids, "topic", (F.col("base") * field_weight(F.col("field"))).alias("score")).groupBy(*ids, "topic").agg(F.sum("score").alias("score"))


def precedence(*candidates: Column) -> Column:
    """The first candidate (a struct of value, confidence, source) whose value isn't null."""
    return F.coalesce(*[F.when(c["value"].isNotNull(), c) for c in candidates])


def candidate(value: Column, confidence: float | Column, source: str) -> Column:
    confidence = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    return F.struct(value.alias("value"), confidence.cast("double").alias("confidence"), F.lit(source).alias("source"))


def primary_article(articles: Column) -> Column:
    """The article that counts: manual before text before AI before rules, then by field, then the first."""
    rank = lambda a: F.when(a["source"] == "manual", 0).when(a["source"] == "text", 1).when(a["source"] == "ai", 2).when(a["source"] == "rules", 3).otherwise(4)
    keyed = F.transform(articles, lambda a, i: F.struct(rank(a).alias("r"), (-field_weight(F.coalesce(a["field"], F.lit("")))).alias("w"), i.alias("i"), a.alias("a")))
    return F.array_min(keyed)["a"]


# The shape of a citation.
CITATION = r"(?<![\p{L}\p{N}_])(?:(بند|تبصره|جزء|قسمت)\s*[«\"(]?\s*(\d{1,3}|[آ-ی]{1,3})\s*[»\")]?\s+(?:(?:از|ذیل|الحاقی\s+به)\s+)?)?(ماده|مواد|اصل|اصول)(?:‌?ی)?\s+(واحده|\d{1,4}(?:\s*مکرر(?:\s*\d{1,2})?)?(?:\s*(?:،|,|و|تا|الی|-|–)\s*\d{1,4}(?:\s*مکرر(?:\s*\d{1,2})?)?)*)(?=\s*([^\n]{0,300}))"


def citations(text: Column) -> Column:
    """Array of (clause, clause_id, kind, numbers, after): citations of articles with the words that follow."""
    plain = F.replace(t.ascii_digits(t.display_form(text)), F.lit("\n"), F.lit(" "))
    parts = [F.regexp_extract_all(plain, F.lit(CITATION), F.lit(i)).alias(n) for i, n in enumerate(("clause", "clause_id", "kind", "numbers", "after"), 1)]
    kind = lambda k: F.when(k.isin("اصل", "اصول"), "اصل").otherwise("ماده")
    return F.transform(F.arrays_zip(*parts), lambda c: F.struct(c["clause"].alias("clause"), c["clause_id"].alias("clause_id"), kind(c["kind"]).alias("kind"), t.expand_numbers(c["numbers"]).alias("numbers"), c["after"].alias("after")))


def law_keys(aliases: DataFrame) -> DataFrame:
    """(alias, law_key) by comparison form; of equal forms the first by key."""
    a = aliases.select(t.alias_form(F.col("name")).alias("alias"), "law_key").filter("alias <> ''")
    return a.groupBy("alias").agg(F.min("law_key").alias("law_key"))


def law_after(rows: DataFrame, after: str, aliases: DataFrame) -> DataFrame:
    """rows with law_key of the longest alias that the text begins with (null if none): an equi-join on its first words."""
    words = F.split(t.alias_form(F.regexp_replace(F.col(after), r"^\s*(?:از|در)\s+", "")), " ")
    keys = law_keys(aliases)
    longest = keys.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 1
    mine = rows.withColumn("_row", F.monotonically_increasing_id())
    heads = mine.select("_row", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(words), F.lit(longest))), lambda n: F.array_join(F.slice(words, 1, n), " "))).alias("alias"))
    hit = heads.join(small(keys), "alias").groupBy("_row").agg(F.max_by("law_key", F.char_length("alias")).alias("law_key"))
    return mine.join(hit, "_row", "left").drop("_row")


def carried_law(citations: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """law_key where it is null from the citation before it (source rules); an اصل without a law is of the constitution."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.coalesce(F.col("law_key"), F.when(F.col("kind") == "اصل", F.lit("constitution")))
    c = citations.withColumn("source", F.when(own.isNotNull(), "text").otherwise("rules")).withColumn("law_key", F.coalesce(own, F.last(own, ignorenulls=True).over(w)))
    return c.filter("law_key is not null")


def subject_from_articles(articles: DataFrame, laws: DataFrame, ids: list[str]) -> DataFrame:
    """ids, subject, confidence: votes of articles that name their law, by field. laws: law_key, subject_key."""
    known = laws.filter("subject_key is not null").select("law_key", "subject_key").dropDuplicates(["law_key"])
    v = vote(articles.filter("source = 'text'").join(known, "law_key").withColumn("weight", field_weight(F.coalesce("field", F.lit("")))), ids, "subject_key", "weight")
    return v.select(*ids, F.col("winner").alias("subject"), F.round(0.6 + 0.3 * F.col("score") / F.col("total"), 2).alias("confidence"))


def subject_from_keywords(scores: DataFrame, topics: DataFrame, ids: list[str]) -> DataFrame:
    """ids, subject: the best topic and a quarter of the others, if that is 2 or more and 1.5 times the next subject's.

    scores: ids, topic, score (in quarters); topics: topic, subject_key.
    """
    s = scores.join(topics.select("topic", "subject_key"), "topic").groupBy(*ids, "subject_key").agg((F.max("score") * 3 + F.sum("score")).alias("weight"))
    v = vote(s, ids, "subject_key", "weight")  # weights are 16 times the score
    return v.filter("score >= 32 and score * 2 >= runner_up * 3").select(*ids, F.col("winner").alias("subject"))


def innermost_heading(path: Column, names: DataFrame, most: int = 5000) -> Column:
    """The subject of the innermost heading that names one; names: heading, subject_key (a dimension, as a literal map).

    More names than `most` are refused, never cut.
    """
    pairs = names.limit(most + 1).collect()
    if len(pairs) > most:
        raise ValueError(f"more than {most} names of subjects")
    known = F.create_map(*[F.lit(x) for r in pairs for x in (r.heading, r.subject_key)])
    found = F.filter(F.transform(F.reverse(path), lambda h: F.try_element_at(known, heading_key(h))), lambda s: s.isNotNull())
    return F.get(found, F.lit(0))


def topic_from_articles(articles: DataFrame, ranges: DataFrame, ids: list[str]) -> DataFrame:
    """ids, topic, confidence: each article votes for its most specific topic. ranges: law_key, topic, lo, hi, topic_order, unverified."""
    n = t.leading_number(F.col("number"))
    a = articles.withColumn("n", n).filter("n is not null and law_key is not null")
    r = ranges.withColumnRenamed("law_key", "key")
    hit = first_range(a, r, F.col("law_key"), F.col("n"), ["topic", "unverified"], [F.col("hi") - F.col("lo"), F.col("topic_order")]).filter("topic is not null")
    weight = field_weight(F.coalesce("field", F.lit(""))) * F.when(F.col("source") == "text", 5).otherwise(3)
    v = vote(hit.withColumn("weight", weight), ids, "topic", "weight")
    sure = ranges.groupBy(F.col("topic").alias("winner")).agg(F.max("unverified").alias("unverified"))
    return v.join(sure, "winner").select(*ids, F.col("winner").alias("topic"), F.when(F.col("unverified"), 0.65).otherwise(0.85).alias("confidence"))


def topic_from_keywords(scores: DataFrame, ids: list[str]) -> DataFrame:
    """ids, topic, confidence: the strictly best topic of at least 2; scores in quarters."""
    v = vote(scores, ids, "topic", "score").filter("score >= 8 and score > runner_up")
    return v.select(*ids, F.col("winner").alias("topic"), F.least(F.lit(0.75), F.round(0.35 + 0.05 * F.col("score") / 4, 2)).alias("confidence"))


def topic_from_heading(rows: DataFrame, path: str, topics: DataFrame, ids: list[str], most: int = 2000) -> DataFrame:
    """ids, topic, confidence: the innermost heading's topic by name (0.9), by shared words (0.85), or its own title (0.7).

    topics: subject_key, topic, topic_order; rows: ids, subject_key, path. Topics of a subject are an array in the row.
    """
    title = t.heading_title(t.display_form(F.element_at(F.col(path), -1)))
    packed = topics.groupBy("subject_key").agg(F.array_sort(F.collect_list(F.struct("topic_order", "topic", t.comparison_form(F.col("topic")).alias("form")))).alias("topics"))
    h = rows.filter(F.size(path) > 0).withColumn("title", title).withColumn("form", t.comparison_form(F.col("title"))).filter("form <> ''").join(packed, "subject_key", "left")
    have = F.coalesce("topics", F.array().cast(packed.schema["topics"].dataType))
    named = F.filter(have, lambda x: (x["form"] == F.col("form")) | F.contains(F.col("form"), x["form"]) | ((F.char_length("form") > 4) & F.contains(x["form"], F.col("form"))))
    words = lambda c: F.filter(F.split(c, " "), lambda w: (F.char_length(w) > 2) & (w != "و"))
    shared = F.filter(have, lambda x: (F.size(words(x["form"])) > 0) & (F.size(F.array_intersect(words(x["form"]), F.split("form", " "))) >= F.greatest(F.lit(1), F.size(words(x["form"])) - 1)))
    best = F.coalesce(F.get(named, F.lit(0))["topic"], F.get(shared, F.lit(0))["topic"], F.col("title"))
    confidence = F.when(F.size(named) > 0, 0.9).when(F.size(shared) > 0, 0.85).otherwise(0.7)
    return h.select(*ids, best.alias("topic"), confidence.alias("confidence"))


def classify_questions(questions: DataFrame, by_blueprint: DataFrame, by_articles: DataFrame, by_heading: Column, by_keywords: DataFrame, ids: list[str]) -> DataFrame:
    """questions with subject_key, subject_confidence and subject_source by the order in which evidence counts.

    A person's choice stays; then blueprint, articles, the innermost heading, keywords, the document's dominant subject (for
    questions that have nothing better), the default, what the parser left, an AI's answer, nothing. The three tables: ids,
    subject and, for articles, confidence; questions: ids, project_id, default_subject, subject_key, subject_source, subject_confidence.
    """
    q = questions.withColumn("_heading", by_heading)
    for name, found in (("_blueprint", by_blueprint), ("_articles", by_articles), ("_keywords", by_keywords)):
        columns = [F.col("subject").alias(name)] + ([F.col("confidence").alias("_sure")] if name == "_articles" else [])
        q = q.join(found.select(*ids, *columns), ids, "left")
    c = candidate
    manual = F.when(F.col("subject_source") == "manual", F.col("subject_key"))
    strong = [c(F.col("_blueprint"), 1.0, "blueprint"), c(F.col("_articles"), F.col("_sure"), "text"), c(F.col("_heading"), 0.8, "heading")]
    kept = [c(F.when(F.col("subject_source").isNull(), F.col("subject_key")), 0.6, "heading"), c(F.when(F.col("subject_source") == "ai", F.col("subject_key")), F.coalesce("subject_confidence", F.lit(0.0)), "ai")]
    first = q.withColumn("_best", precedence(c(manual, F.coalesce("subject_confidence", F.lit(1.0)), "manual"), *strong, c(F.col("_keywords"), 0.5, "rules"), c(F.col("default_subject"), 0.5, "default"), *kept))
    sure = first.filter(F.col("_best.source").isin("blueprint", "text", "heading", "manual", "ai")).select("project_id", F.col("_best.value").alias("subject"))
    hint = dominant(sure, ["project_id"], "subject").select("project_id", F.col("hint").alias("_hint"))
    second = first.join(hint, "project_id", "left")
    weak = F.col("_best").isNull() | (F.col("_best.source") == "default")
    best = F.when(weak & F.col("_hint").isNotNull(), c(F.col("_hint"), 0.45, "rules")).otherwise(F.col("_best"))
    second = second.withColumn("_best", best)
    return second.withColumns({"subject_key": F.col("_best.value"), "subject_confidence": F.col("_best.confidence"), "subject_source": F.col("_best.source")}).select(*questions.columns)


def needs_ai(threshold: float = 0.6) -> Column:
    """Subject or topic is missing or unsure, and no person chose it."""

    def open_(value: str, confidence: str, source: str) -> Column:
        lacks = (F.coalesce(value, F.lit("")) == "") | (F.coalesce(confidence, F.lit(0.0)) < threshold)
        return lacks & ~F.coalesce(F.col(source) == "manual", F.lit(False))

    return open_("subject_key", "subject_confidence", "subject_source") | open_("topic", "topic_confidence", "topic_source")


def pick_blueprint(blueprints: DataFrame, track: str, year: int) -> DataFrame:
    """The blueprint of the track and year, else the track's latest."""
    return blueprints.filter(F.col("track") == track).orderBy(F.desc(F.col("year") == year), F.desc("year"), "code").limit(1)
