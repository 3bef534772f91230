"""Sources and sinks: project records as JSON, uploads as binary files, caches and learned words as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant import schemas
from foliant.functions import text as t


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """Projects of a folder (one folder each), newest first; records that can't be read are left out."""
    raw = spark.read.schema(schemas.PROJECT + ", _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(f"{path}/*/project.json")
    return raw.filter(F.col("_bad").isNull() & F.col("id").isNotNull()).drop("_bad").orderBy(F.desc("created_at"), "id")


def find_project(projects: DataFrame, project_id: str) -> DataFrame:
    """One project, or no row; an id that is not alphanumeric finds nothing."""
    return projects.filter(F.col("id") == project_id) if project_id.isalnum() else projects.limit(0)


def questions_of(projects: DataFrame) -> DataFrame:
    """Questions as rows, with their place among those of their project."""
    q = projects.select(F.col("id").alias("project_id"), "created_at", F.col("status").alias("project_status"), "mode", F.posexplode("questions").alias("seq", "q"))
    return q.select("project_id", "created_at", "project_status", "mode", "seq", "q.*")


def write_projects(projects: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A table of projects, committed as a whole, by project."""
    projects.write.mode(mode).partitionBy("id").json(path)


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, kind): files as they came; kind by their first bytes, not their names."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    head = F.substring("content", 1, 5)
    kind = F.when(head == F.lit(b"%PDF-"), "pdf").when(F.substring("content", 1, 3) == F.lit(b"\xff\xd8\xff"), "image").when(F.substring("content", 1, 4) == F.lit(b"\x89PNG"), "image").when(F.substring("content", 1, 4).isin(b"II*\x00", b"MM\x00*"), "image")
    return f.select("path", "length", "modificationTime", "content", kind.alias("kind"))


def split_uploads(files: DataFrame, most_bytes: int = 200 << 20) -> tuple[DataFrame, DataFrame]:
    """(usable files, rejected files with a reason): one bad file doesn't sink the others."""
    reason = F.when(F.col("length") == 0, "empty").when(F.col("length") > most_bytes, "too_large").when(F.col("kind").isNull(), "unknown_type")
    f = files.withColumn("reason", reason)
    return f.filter("reason is null").drop("reason"), f.filter("reason is not null").drop("content")


def combine(files: DataFrame, group: list[str], order: str, pages: str) -> DataFrame:
    """(group, file, file_page, page): files in upload order as one document; pages: how many each file has."""
    before = F.sum(pages).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    f = files.filter(F.col(pages) > 0).withColumn("_before", F.coalesce(before, F.lit(0)))
    return f.select(*group, F.col(order).alias("file"), "_before", F.explode(F.sequence(F.lit(0), F.col(pages) - 1)).alias("file_page")).withColumn("page", F.col("_before") + F.col("file_page")).drop("_before")


def reject_reason(pages: DataFrame) -> DataFrame:
    """Adds reason why a page's text layer isn't used (null: it is); pages: text, rotated, full_image (booleans)."""
    n = F.char_length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", ""))
    reason = F.when(F.col("rotated"), "rotated_text").when(n == 0, "no_text").when(n < 20, "too_little_text").when(F.col("full_image"), "scanned_image").when(t.is_garbage(F.col("text")), "garbage")
    return pages.withColumn("reason", reason)


def word_lines(words: DataFrame) -> DataFrame:
    """Lines from a recogniser's word table: doc, page, block, par, line, i, text, conf.

    Lines stand in the order in which they are first seen; blank words, words without a confidence and watermarks go.
    """
    w = words.filter((t.strip(F.coalesce("text", F.lit(""))) != "") & (F.col("conf") >= 0)).withColumn("flag", F.when(F.col("conf") < 60, "low_conf"))
    lines = w.groupBy("doc", "page", "block", "par", "line").agg(F.min("i").alias("first"), F.array_sort(F.collect_list(F.struct("i", "text", "conf", "flag"))).alias("words"))
    lines = lines.withColumn("text", F.array_join(F.transform("words", lambda x: x["text"]), " ")).filter(~F.col("text").rlike(r"(?i)scanned\s+(with|by)|camscanner"))
    return lines.withColumn("line_no", F.row_number().over(Window.partitionBy("doc", "page").orderBy("first")) - 1).select("doc", "page", "line_no", "words", "text")


def better_reading(first: str, second: str):
    """The second reading (text columns) only if it has more than twice the characters of a first with fewer than 40."""
    n, m = (F.char_length(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", "")) for c in (first, second))
    return F.when((n < 40) & (m > 2 * F.greatest(n, F.lit(1))), F.col(second)).otherwise(F.col(first))


def read_lexicon(spark: SparkSession, *paths: str) -> DataFrame:
    """(word): keys of all files, one word a line, without comments."""
    return spark.read.text(list(paths)).filter(~F.col("value").startswith("#")).select(t.lexicon_key(F.col("value")).alias("word")).filter("word <> ''").distinct()


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(subject_key, topic_order, topic, keywords, law_key, ranges, unverified); a topic's law is its subject's unless it has its own."""
    topic = "struct<name:string,keywords:array<string>,ranges:array<array<int>>,law_key:string,unverified:boolean>"
    raw = spark.read.schema(f"subjects map<string,struct<main_law:string,topics:array<{topic}>>>").option("multiLine", True).json(path)
    s = raw.select(F.explode("subjects").alias("subject_key", "s")).select("subject_key", "s.main_law", F.posexplode("s.topics").alias("topic_order", "t"))
    ranges = F.transform(F.coalesce("t.ranges", F.array().cast("array<array<int>>")), lambda r: F.struct(r[0].alias("lo"), r[1].alias("hi")))
    return s.select("subject_key", "topic_order", F.col("t.name").alias("topic"), "t.keywords", F.coalesce("t.law_key", "main_law").alias("law_key"), ranges.alias("ranges"), F.coalesce("t.unverified", F.lit(False)).alias("unverified"))


def read_laws(spark: SparkSession, path: str) -> DataFrame:
    """(law_key, name, kind, subject_key): one row for each name and alias."""
    raw = spark.read.schema("laws array<struct<key:string,name:string,aliases:array<string>,subject_key:string,kind:string>>").option("multiLine", True).json(path)
    law = raw.select(F.explode("laws").alias("l")).select(F.col("l.key").alias("law_key"), F.explode(F.array_distinct(F.concat(F.array("l.name"), F.coalesce("l.aliases", F.array().cast("array<string>"))))).alias("name"), F.coalesce("l.kind", F.lit("ماده")).alias("kind"), "l.subject_key")
    return law


def append_cache(answers: DataFrame, path: str) -> None:
    """Complete answers, in folders by the first two digits of their keys."""
    answers.filter(F.col("answer").isNotNull()).withColumn("shard", F.substring("key", 1, 2)).write.mode("append").partitionBy("shard").parquet(path)


def append_words(words: DataFrame, path: str) -> None:
    words.select("word").filter("word <> ''").distinct().write.mode("append").parquet(path)
