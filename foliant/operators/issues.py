"""Rules that find what is wrong with a question or a project.

All rules of a question are one array column, made in a single pass over the row; long form is an explode of it. Rules of
a project need its questions together: one aggregation by project.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as t

KEYS = ("1", "2", "3", "4")
#: Warnings that a question may have and still be approved without a person.
HARMLESS = ("missing_topic", "missing_subject", "article_unknown_law")
ISSUE = "struct<level:string,code:string,field:string>"


def issue(rule: Column, level: str, code: str, field: Column | str | None = None) -> Column:
    """The issue if the rule holds, else null; a rule that is null doesn't hold."""
    field = F.lit(field) if field is None or isinstance(field, str) else field
    return F.when(rule, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), field.cast("string").alias("field")))


def blank(text: Column) -> Column:
    return t.strip(F.coalesce(text, F.lit(""))) == ""


def options_wrong(options: Column) -> Column:
    """Not exactly the keys 1 to 4."""
    keys = F.transform(options, lambda o: o["key"])
    want = F.array(*[F.lit(k) for k in KEYS])
    return (F.size(options) != 4) | (F.size(F.array_except(want, keys)) > 0) | (F.size(F.array_except(keys, want)) > 0)


def median(values: Column) -> Column:
    """Of a numeric array; 0 for none."""
    s, n = F.array_sort(values), F.size(values)
    upper, lower = F.get(s, F.floor(n / 2).cast("int")), F.get(s, F.floor((n - 1) / 2).cast("int"))
    return F.when(n == 0, F.lit(0.0)).otherwise((upper + lower) / 2.0)


def too_long(options: Column, option: Column) -> Column:
    """An option beyond 400 characters, or beyond 150 and four times the median of the others that aren't empty."""
    others = F.filter(options, lambda o: (o["key"] != option["key"]) & (o["text"] != ""))
    middle = median(F.transform(others, lambda o: F.char_length(o["text"])))
    n = F.char_length(option["text"])
    return (n > 400) | ((middle > 0) & (n > F.greatest(F.lit(150.0), 4 * middle)))


def question_issues(has_explanations: Column, subjects_with_topics: list[str] = ()) -> Column:
    """Array of issues in a fixed order, from the columns of a question."""
    options = F.coalesce(F.col("options"), F.array().cast("array<struct<key:string,text:string>>"))
    key, explanation = F.col("correct_key"), F.coalesce(F.col("explanation"), F.lit(""))
    keys = F.transform(options, lambda o: o["key"])
    no_key = F.coalesce(key, F.lit("")) == ""
    bad_key = ~no_key & (~key.isin(*KEYS) | ((F.size(options) > 0) & ~F.array_contains(keys, F.coalesce(key, F.lit("")))))
    stated = t.stated_key(explanation)
    other_key = ~no_key & ~bad_key & (F.coalesce(F.col("key_source"), F.lit("")) != "manual") & (explanation != "") & (stated != key)
    stem = F.coalesce(F.col("stem"), F.lit(""))
    marks = t.inner_markers(stem)
    follows = F.concat(t.ascii_digits(stem), F.lit(" ")).rlike(r"(?:^|\s)\d") & F.regexp_like(F.concat(t.ascii_digits(stem), F.lit(" ")), F.concat(F.lit(r"(?:^|\s)"), (F.col("number") + 1).cast("string"), F.lit(r"\s*[-.)]\s")))
    per_option = F.transform(options, lambda o: issue(blank(o["text"]), "error", "empty_option", F.concat(F.lit("option:"), o["key"])))
    merged = F.transform(options, lambda o: issue((F.size(t.inner_markers(o["text"])) > 0) | too_long(options, o), "warning", "merged_suspect", F.concat(F.lit("option:"), o["key"])))
    no_subject = F.coalesce(F.col("subject_key"), F.lit("")) == ""
    has_topics = F.col("subject_key").isin(*subjects_with_topics) if subjects_with_topics else F.lit(False)
    unknown_law = F.exists(F.col("articles"), lambda a: (F.coalesce(a["law"], F.lit("")) != "") & (F.coalesce(a["law_key"], F.lit("")) == ""))
    groups = [
        F.array(issue(blank(F.col("stem")), "error", "empty_stem", "stem"), issue(options_wrong(options), "error", "option_count")),
        per_option,
        F.array(
            issue(no_key, "error", "missing_key"),
            issue(bad_key, "error", "invalid_key"),
            issue(other_key, "error", "key_mismatch", "explanation"),
            issue(has_explanations & blank(explanation), "warning", "missing_explanation", "explanation"),
            issue(F.size(F.col("flags")) > 0, "warning", "suspicious_words"),
            issue((F.array_contains(marks, "1") & F.array_contains(marks, "2")) | follows, "warning", "merged_suspect", "stem"),
        ),
        merged,
        F.array(
            issue(no_subject, "warning", "missing_subject"),
            issue(~no_subject & has_topics & (F.coalesce(F.col("topic"), F.lit("")) == ""), "warning", "missing_topic"),
            issue(F.size(F.col("duplicates")) > 0, "warning", "duplicate"),
            issue(unknown_law, "warning", "article_unknown_law"),
        ),
    ]
    return F.array_compact(F.concat(*groups))


def is_clean(has_explanations: Column, subjects_with_topics: list[str] = ()) -> Column:
    """Fit to be approved without a person."""
    issues = question_issues(has_explanations, subjects_with_topics)
    harmless = F.forall(issues, lambda i: (i["level"] == "warning") & i["code"].isin(*HARMLESS))
    return harmless & (F.coalesce(F.size("flags"), F.lit(0)) <= 0) & F.coalesce(F.col("correct_key").isin(*KEYS), F.lit(False))


def long_form(df: DataFrame, issues: str, *ids: str) -> DataFrame:
    return df.select(*ids, F.explode(issues).alias("issue")).select(*ids, "issue.level", "issue.code", "issue.field")


def missing_numbers(numbers: DataFrame, project: str, number: str, expected: Column | None = None) -> DataFrame:
    """(project, n) for every number from 1 to the largest (or the expected count) that no question has.

    Gaps come from neighbours among the distinct numbers, so a project costs as many rows as it has questions and gaps.
    """
    from pyspark.sql import Window

    have = numbers.select(project, F.col(number).alias("n"), (expected if expected is not None else F.lit(0)).alias("most")).groupBy(project, "n").agg(F.max("most").alias("most"))
    order = Window.partitionBy(project).orderBy("n")
    have = have.withColumn("before", F.coalesce(F.lag("n").over(order), F.lit(0))).withColumn("next", F.lead("n").over(order))
    inner = F.when(F.col("n") - F.col("before") > 1, F.sequence(F.col("before") + 1, F.col("n") - 1))
    tail = F.when(F.col("next").isNull() & (F.col("most") > F.col("n")), F.sequence(F.col("n") + 1, F.greatest("most", F.col("n") + 1)))
    gaps = F.concat(F.coalesce(inner, F.array().cast("array<int>")), F.coalesce(tail, F.array().cast("array<int>")))
    return have.select(project, F.explode(gaps).alias("n"))


def duplicate_numbers(numbers: DataFrame, project: str, number: str) -> DataFrame:
    """(project, number, times) of numbers that more than one question has."""
    return numbers.groupBy(project, number).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def project_issues(questions: DataFrame, projects: DataFrame) -> DataFrame:
    """(id, issues): rules over all questions of a project. projects: id, has_explanations, expected_count (or null)."""
    facts = questions.groupBy(F.col("project_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sort_array(F.collect_set("number")).alias("numbers"),
        F.count_if(F.coalesce("explanation", F.lit("")) != "").alias("explained"),
        F.count_if(F.col("key_source") == "table").alias("from_table"),
        F.count_if(F.coalesce("correct_key", F.lit("")) == "").alias("keyless"),
    )
    p = projects.join(facts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    upper = F.greatest(F.array_max("numbers"), F.coalesce("expected_count", F.lit(0)))
    rules = F.array_compact(
        F.array(
            issue((F.col("n") > 0) & (F.size("numbers") < upper), "error", "missing_numbers"),
            issue((F.col("n") > 0) & (F.size("numbers") < F.col("n")), "error", "duplicate_numbers"),
            issue(F.col("expected_count") != F.col("n"), "warning", "count_mismatch"),
            issue(F.col("has_explanations") & (F.col("n") > 0) & (F.col("explained") == 0), "warning", "explanations_unmatched"),
            issue((F.col("n") > 0) & (F.col("from_table") == 0) & (F.col("keyless") > 0), "warning", "key_table_missing"),
        )
    )
    return p.select("id", rules.alias("issues"))
