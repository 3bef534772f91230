"""Small operators on records: fields of a question, regions, modes, gaps, runs, listings, and results of a push."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import geometry as g
from foliant.functions import text as t


def question_fields(questions: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, field_no, field, text): stem, options and explanation that aren't empty, as rows."""
    options = F.transform("options", lambda o: F.struct(F.concat(F.lit("option:"), o["key"]).alias("field"), o["text"].alias("text")))
    one = lambda name: F.array(F.struct(F.lit(name).alias("field"), F.col(name).alias("text")))
    rows = questions.select(*ids, F.posexplode(F.concat(one("stem"), F.coalesce(options, F.array().cast("array<struct<field:string,text:string>>")), one("explanation"))).alias("field_no", "f"))
    return rows.select(*ids, "field_no", "f.field", "f.text").filter(F.coalesce("text", F.lit("")) != "")


def distinct_articles(articles: DataFrame, ids: list[str], order: list[str]) -> DataFrame:
    """The first of each (law, kind, number, clause) of a question."""
    law = F.coalesce(F.nullif("law_key", F.lit("")), "law")
    nth = F.row_number().over(Window.partitionBy(*ids, law, "kind", "number", "clause").orderBy(*order))
    return articles.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def regions(lines: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, regions): of each page the box around the lines that a question takes up. lines: ids, doc, page, line_no, bbox."""
    pages = lines.dropDuplicates([*ids, "doc", "page", "line_no"]).groupBy(*ids, "doc", "page").agg(g.union_agg(F.col("bbox")).alias("bbox")).filter("bbox is not null")
    return pages.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("doc", "page", "bbox"))).alias("regions"))


def distinct_flags(tokens: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, flags): flagged words of a question, each word once however many tokens it gave."""
    f = tokens.filter("flag is not null").dropDuplicates([*ids, "field", "word_id"])
    return f.groupBy(*ids).agg(F.transform(F.array_sort(F.collect_list(F.struct("word_id", "field", "text", F.col("flag").alias("reason"), "alt"))), lambda x: F.struct(x["field"], x["text"], x["reason"], x["alt"])).alias("flags"))


def detect_mode(questions: DataFrame) -> DataFrame:
    """(project_id, mode): questions if three, or half of all, have a stem and four options."""
    good = (t.strip(F.coalesce("stem", F.lit(""))) != "") & (F.size("options") == 4)
    c = questions.groupBy("project_id").agg(F.count_if(good).alias("good"), F.count(F.lit(1)).alias("n"))
    return c.select("project_id", F.when((F.col("good") >= 3) | (F.col("good") * 2 >= F.col("n")), "questions").otherwise("text").alias("mode"))


def usual_gap(lines: DataFrame) -> DataFrame:
    """(doc, page, gap, left): the upper median of positive gaps between lines, and where text begins. lines: y0, y1, x0."""
    order = Window.partitionBy("doc", "page").orderBy("line_no")
    gaps = lines.withColumn("gap", F.lead("y0").over(order) - F.col("y1"))
    s = gaps.groupBy("doc", "page").agg(F.sort_array(F.collect_list(F.when(F.col("gap") > 0, F.col("gap")))).alias("gaps"), F.min("x0").alias("left"))
    return s.select("doc", "page", F.get("gaps", F.floor(F.size("gaps") / 2).cast("int")).alias("gap"), "left")


def longest_run(cells: DataFrame, group: list[str], place: str, empty: Column) -> DataFrame:
    """(group, longest): the longest run of empty cells."""
    order = Window.partitionBy(*group).orderBy(place)
    c = cells.withColumn("_empty", empty).withColumn("_full", F.sum((~empty).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = c.groupBy(*group, "_full").agg(F.count_if("_empty").alias("n"))
    return runs.groupBy(*group).agg(F.max("n").alias("longest"))


def in_band(box: Column, nth: Column, n_lines: Column) -> Column:
    """In the band at a page's top (among the first four lines) or bottom (among the last three), where running titles stand."""
    return ((nth < 4) & (box["y1"] < 0.09)) | ((nth >= n_lines - 3) & (box["y0"] > 0.95))


def band_noise(box: Column, nth: Column, n_lines: Column, text: Column, flagged_share: Column, is_heading: Column, begins_marker: Column) -> Column:
    """A running title or page number in such a band: numbered at an end, mostly flagged, or narrow."""
    words = F.split(t.squeeze(t.ascii_digits(text)), " ")
    number = lambda w: w.rlike(r"^\d{1,3}$")
    numbered = number(F.element_at(words, 1)) | number(F.element_at(words, -1))
    width = box["x1"] - box["x0"]
    narrow = (width < 0.12) | ((width < 0.35) & t.ascii_digits(text).rlike(r"\d"))
    return in_band(box, nth, n_lines) & (t.strip(text) != "") & ~(is_heading & ~numbered) & ~begins_marker & (numbered | (flagged_share >= 0.5) | narrow)


def topic_lists(topics: DataFrame) -> DataFrame:
    """(subject_key, topics): names in the order of the taxonomy, for clients."""
    return topics.groupBy("subject_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("topic_order", "topic"))), lambda x: x["topic"]).alias("topics"))


def own_laws_first(laws: DataFrame, subject: str, place: str) -> DataFrame:
    """Laws of the subject, then the others, each in their order."""
    return laws.orderBy(~F.col("subject_key").eqNullSafe(F.lit(subject)), place)


def states(issues: Column, flags: Column, status: Column) -> Column:
    """What a list shows of a question: approved, error, warning or neutral."""
    return F.when(status == "approved", "approved").when(F.exists(issues, lambda i: i["level"] == "error"), "error").when((F.size(issues) > 0) | (flags > 0), "warning").otherwise("neutral")


def open_issues(issues: Column, edited_fields: Column) -> Column:
    """Issues of fields that haven't been edited since they were found."""
    return F.filter(issues, lambda i: i["field"].isNull() | ~F.array_contains(edited_fields, F.coalesce(i["field"], F.lit(""))))


def reread(questions: DataFrame, readings: DataFrame, fields: list[str]) -> DataFrame:
    """Questions with fields that were read again; flags of the booklet give way to those of the new reading.

    readings: project_id, number, the fields (null: not read) and flags.
    """
    r = readings.select("project_id", "number", *[F.col(f).alias(f"_{f}") for f in fields], F.col("flags").alias("_flags"), F.lit(True).alias("_new"))
    q = questions.join(r, ["project_id", "number"], "left")
    kept = F.concat(F.filter("flags", lambda x: x["doc"] != "booklet"), "_flags")
    q = q.withColumns({f: F.coalesce(f"_{f}", f) for f in fields} | {"flags": F.when(F.col("_new"), kept).otherwise(F.col("flags"))})
    return q.drop("_flags", "_new", *[f"_{f}" for f in fields])


def push_results(projects: DataFrame, approved: DataFrame) -> DataFrame:
    """(project_id, outcome, questions): what a push of approved questions sends, and why a project is left out."""
    n = approved.filter("status = 'approved'").groupBy("project_id").agg(F.count(F.lit(1)).alias("questions"))
    p = projects.select(F.col("id").alias("project_id"), "status", "mode").join(n, "project_id", "left").na.fill(0, ["questions"])
    outcome = F.when(F.col("status") != "ready", "not_ready").when(F.col("mode") != "questions", "no_questions").when(F.col("questions") == 0, "nothing_approved").otherwise("send")
    return p.select("project_id", outcome.alias("outcome"), "questions")


def queue_state(jobs: DataFrame) -> DataFrame:
    """(running, waiting): ids of jobs that run, sorted, and of those that wait, in order of arrival."""
    waiting = F.array_sort(F.collect_list(F.when(F.col("status") == "queued", F.struct("submitted_at", "job_id"))))
    return jobs.agg(F.array_sort(F.collect_list(F.when(F.col("status") == "processing", F.col("job_id")))).alias("running"), F.transform(waiting, lambda w: w["job_id"]).alias("waiting"))
