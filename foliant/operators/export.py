"""Exports: nested payloads, numbered template lines, page text, names of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as t

# Letters of options and the words that begin a template line.
LETTERS = {"1": "الف", "2": "ب", "3": "ج", "4": "د"}
MARKER_START = (
    r"^\s*(?:(?:س(?:ؤال|وال|ئوال)|پرسش|تست)\s*)?\(?\s*(?:[0-9۰-۹]{1,4}|الف|ب|ج|د|[A-Da-d])\s*[).\-ـ:：]"
    r"|^\s*(?:پاسخ|جواب|کلید|درس|مبحث|موضوع|سطح|سختی|ماده|منبع|توضیح|تشریح)\s*[:：]"
)


def question_payload() -> Column:
    """A question as the site imports it; options in the order of their keys."""
    options = F.array_sort(F.transform("options", lambda o: F.struct(o["key"].alias("key"), o["text"].alias("text"))))
    shown = F.transform(options, lambda o, i: F.struct(o["key"].alias("key"), (i + 1).alias("order"), t.escape_html(t.strip(o["text"])).alias("text_html")))
    articles = F.transform("articles", lambda a: F.struct(a["law"].alias("law"), a["law_key"].alias("law_key"), a["kind"].alias("kind"), a["number"].alias("number"), a["clause"].alias("clause")))
    return F.struct(
        F.col("number").alias("source_number"), "subject_key", t.html_paragraphs(F.col("stem")).alias("stem_html"), shown.alias("options"), "correct_key",
        t.html_paragraphs(F.col("explanation")).alias("explanation_html"), "source_ref", "topic", articles.alias("articles"),
    )


def payloads(projects: DataFrame, questions: DataFrame, only_approved: bool = False) -> DataFrame:
    """(project_id, payload): one JSON document for each project; questions in the order of their numbers."""
    q = questions.filter("status = 'approved'") if only_approved else questions
    q = q.select("project_id", F.struct("number", "seq", question_payload().alias("payload")).alias("q"))
    q = q.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list("q")), lambda x: x["payload"]).alias("questions"))
    source = F.struct(F.lit("official").alias("kind"), "track", "year", "title")
    p = projects.select(F.col("id").alias("project_id"), source.alias("source")).join(q, "project_id", "left")
    return p.select("project_id", F.to_json(F.struct("source", "questions")).alias("payload"))


def glued_paragraphs(text: Column) -> Column:
    """Paragraphs, one that would be read as a marker joined to the one before."""
    parts = F.transform(t.paragraphs(text), t.squeeze)
    start = F.array().cast("array<string>")

    def step(done: Column, p: Column) -> Column:
        glued = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")), F.lit(" "), p)))
        return F.when((F.size(done) > 0) & p.rlike(MARKER_START), glued).otherwise(F.concat(done, F.array(p)))

    return F.aggregate(parts, start, step)


def template_lines(questions: DataFrame, title: str, only_approved: bool = False) -> DataFrame:
    """(project_id, line_no, line): questions numbered anew from 1, with options, key, explanation and source."""
    q = questions.filter("status = 'approved'") if only_approved else questions
    q = q.withColumn("n", F.row_number().over(Window.partitionBy("project_id").orderBy("number", "seq")))
    letters = F.create_map(*[F.lit(x) for pair in LETTERS.items() for x in pair])
    letter = lambda key: F.coalesce(F.try_element_at(letters, key), key)
    options = F.transform(F.array_sort(F.transform("options", lambda o: F.struct(o["key"], o["text"]))), lambda o: F.concat(letter(o["key"]), F.lit(") "), t.squeeze(o["text"])))
    explained = glued_paragraphs(F.coalesce("explanation", F.lit("")))
    first = F.when(F.size(explained) > 0, F.array(F.concat(F.lit("پاسخ تشریحی: "), F.get(explained, F.lit(0))))).otherwise(F.array().cast("array<string>"))
    key = F.when(F.col("correct_key").isin(*LETTERS), F.concat(F.lit("پاسخ صحیح: "), F.try_element_at(letters, F.col("correct_key"))))
    lines = F.concat(
        F.array(F.concat(F.lit("سوال "), F.col("n").cast("string"), F.lit(": "), t.squeeze(F.col("stem")))), options, F.array_compact(F.array(key)), first, F.slice(explained, 2, F.size(explained)),
        F.array_compact(F.array(F.when(F.coalesce("topic", F.lit("")) != "", F.concat(F.lit("مبحث: "), t.squeeze(F.col("topic")))))), F.array(F.concat(F.lit("منبع: "), t.squeeze(F.col(title))), F.lit("")),
    )
    q = q.select("project_id", "n", F.posexplode(lines).alias("at", "line"))
    return q.select("project_id", F.row_number().over(Window.partitionBy("project_id").orderBy("n", "at")).alias("line_no"), "line")


def full_text(pages: DataFrame) -> DataFrame:
    """(project_id, text): pages in order, an edited text before the automatic one, titles where there are several documents.

    pages: project_id, doc_no, doc_title, page, edited_text, auto_text.
    """
    p = pages.withColumn("text", t.strip(F.coalesce("edited_text", "auto_text", F.lit("")))).filter("text <> ''")
    docs = p.groupBy("project_id", "doc_no").agg(F.first("doc_title").alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    both = F.array_sort(F.collect_list(F.struct("doc_no", "title", "text")))
    shown = F.transform("docs", lambda d: F.when(F.size("docs") > 1, F.concat(d["title"], F.lit("\n\n"), d["text"])).otherwise(d["text"]))
    return docs.groupBy("project_id").agg(both.alias("docs")).select("project_id", F.array_join(shown, "\n\n").alias("text"))


def unique_names(projects: DataFrame, title: str, position: str) -> DataFrame:
    """Adds file_name: the title made safe, with (2), (3) ... where it repeats."""
    safe = F.coalesce(F.nullif(t.squeeze(F.regexp_replace(F.col(title), r'[\\/:*?"<>|\p{Cc}]+', " ")), F.lit("")), F.lit("export"))
    p = projects.withColumn("_safe", safe)
    nth = F.row_number().over(Window.partitionBy("_safe").orderBy(position))
    return p.withColumn("_nth", nth).withColumn("file_name", F.when(F.col("_nth") == 1, F.col("_safe")).otherwise(F.concat(F.col("_safe"), F.lit(" ("), F.col("_nth").cast("string"), F.lit(")")))).drop("_safe", "_nth")
