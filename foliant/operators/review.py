"""Review: the queue over all projects, summaries, quick keys, approval, and the next problem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = {"error": 0, "warning": 1, "pending": 2}
MOST = 2000


def level(issues: Column, flags: Column) -> Column:
    """error if an issue is one, warning if there is any issue or flag, else pending."""
    worst = F.exists(issues, lambda i: i["level"] == "error")
    return F.when(worst, "error").when((F.size(issues) > 0) | (flags > 0), "warning").otherwise("pending")


def review_queue(questions: DataFrame, limit: int = 200, extra: tuple[str, ...] = ()) -> DataFrame:
    """The first questions to look at: errors first, then by project and number.

    questions: project_id, created_at, project_status, mode, number, status, issues (array of level, code), flags (count);
    extra: columns that are carried along and settle ties. One top-k, no full sort.
    """
    q = questions.filter("project_status = 'ready' AND mode = 'questions' AND status <> 'approved'")
    q = q.withColumn("level", level(F.col("issues"), F.col("flags")))
    codes = F.array_join(F.array_sort(F.array_distinct(F.transform("issues", lambda i: i["code"]))), ",")
    rank = F.when(F.col("level") == "error", 0).when(F.col("level") == "warning", 1).otherwise(2)
    q = q.withColumn("codes", codes).orderBy(rank, "created_at", "project_id", "number", *extra).limit(max(1, min(limit, MOST)))
    return q.select("project_id", "number", "level", "codes", "flags", *extra)


def project_summary(projects: DataFrame, questions: DataFrame) -> DataFrame:
    """Counts by project; projects: id; questions: project_id, status, approved_by, issues, duplicates (count)."""
    facts = questions.groupBy(F.col("project_id").alias("id")).agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if(F.col("status") == "approved").alias("approved"),
        F.count_if((F.col("status") == "approved") & (F.col("approved_by") == "auto")).alias("auto_approved"),
        F.count_if(F.exists("issues", lambda i: i["level"] == "error")).alias("with_errors"),
        F.count_if(F.col("duplicates") > 0).alias("with_duplicates"),
    )
    return projects.join(facts, "id", "left").na.fill(0, ["questions", "approved", "auto_approved", "with_errors", "with_duplicates"])


def apply_keys(questions: DataFrame, keys: DataFrame) -> DataFrame:
    """Questions with typed keys; keys: project_id, number, key (null skips). Adds changed.

    A key that changes is manual, and takes an automatic approval back.
    """
    q = questions.join(keys.select("project_id", "number", F.col("key").alias("_key")), ["project_id", "number"], "left")
    changed = F.coalesce(F.col("_key").isNotNull() & ~F.col("_key").eqNullSafe(F.col("correct_key")), F.lit(False))
    undone = changed & (F.col("status") == "approved") & (F.col("approved_by") == "auto")
    return q.withColumns({
        "changed": changed,
        "correct_key": F.when(changed, F.col("_key")).otherwise(F.col("correct_key")),
        "key_source": F.when(changed, "manual").otherwise(F.col("key_source")),
        "status": F.when(undone, "pending").otherwise(F.col("status")),
        "approved_by": F.when(~undone, F.col("approved_by")),
    }).drop("_key")


def key_preview(questions: DataFrame, keys: DataFrame) -> DataFrame:
    """What typed keys would do: missing, skip, new, same or change, by (project_id, number)."""
    both = keys.join(questions.select("project_id", "number", "correct_key", F.lit(True).alias("_there")), ["project_id", "number"], "left")
    effect = F.when(F.col("_there").isNull(), "missing").when(F.col("key").isNull(), "skip").when(F.coalesce("correct_key", F.lit("")) == "", "new")
    return both.select("project_id", "number", "key", effect.when(F.col("key") == F.col("correct_key"), "same").otherwise("change").alias("effect"))


def numbered_keys(typed: DataFrame, start: int, keys: str = "keys") -> DataFrame:
    """(project_id, number, key) from an array of answers that begins at number start."""
    return typed.select("project_id", F.posexplode(keys).alias("at", "key")).select("project_id", (F.col("at") + start).alias("number"), "key")


def auto_approve(questions: DataFrame, clean: Column) -> DataFrame:
    """Approves clean questions that aren't; adds approved_now."""
    now = (F.col("status") != "approved") & clean
    return questions.withColumns({"approved_now": now, "status": F.when(now, "approved").otherwise(F.col("status")), "approved_by": F.when(now, "auto").otherwise(F.col("approved_by"))})


def update_questions(questions: DataFrame, changes: DataFrame, fields: list[str]) -> DataFrame:
    """Partial updates; changes: project_id, number, set_fields (array) and the fields. A field is set only if it is named.

    An edit of an approval that was automatic takes it back, and a new key or subject is manual.
    """
    new = changes.select("project_id", "number", "set_fields", *[F.col(f).alias(f"_{f}") for f in fields])
    q = questions.join(new, ["project_id", "number"], "left")
    named = lambda f: F.coalesce(F.array_contains("set_fields", f), F.lit(False))
    edited = F.lit(False)
    for f in fields:
        edited = edited | (named(f) & ~F.col(f"_{f}").eqNullSafe(F.col(f)))
    undone = edited & (F.col("status") == "approved") & (F.col("approved_by") == "auto")
    out = {f: F.when(named(f), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}
    if "correct_key" in fields:
        out["key_source"] = F.when(named("correct_key") & ~F.col("_correct_key").eqNullSafe(F.col("correct_key")), "manual").otherwise(F.col("key_source"))
    out |= {"edited": F.coalesce("edited", F.lit(False)) | edited, "status": F.when(undone, "pending").otherwise(F.col("status")), "approved_by": F.when(~undone, F.col("approved_by"))}
    return q.withColumns(out).drop("set_fields", *[f"_{f}" for f in fields])


def add_questions(questions: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions with the new ones, new ones whose number is taken)."""
    on = ["project_id", "number"]
    taken = questions.select(*on).distinct()
    return questions.unionByName(new.join(taken, on, "left_anti"), allowMissingColumns=True), new.join(taken, on, "left_semi")


def delete_questions(questions: DataFrame, gone: DataFrame, order: str = "seq") -> DataFrame:
    """Without the first question of each (project_id, number) in gone."""
    first = F.row_number().over(Window.partitionBy("project_id", "number").orderBy(order)) == 1
    q = questions.withColumn("_first", first).join(gone.select("project_id", "number").distinct().withColumn("_gone", F.lit(True)), ["project_id", "number"], "left")
    return q.filter(~(F.col("_first") & F.coalesce("_gone", F.lit(False)))).drop("_first", "_gone")


def set_page_status(status: Column, doc: Column, page: Column, approved: Column) -> Column:
    """The map with one entry set; its keys are doc:page."""
    key = F.concat_ws(":", doc, page.cast("string"))
    return F.map_concat(F.map_filter(F.coalesce(status, F.create_map().cast("map<string,boolean>")), lambda k, v: k != key), F.create_map(key, approved))


def next_problem(questions: DataFrame, project: str, order: list[str], severity: Column, current: Column) -> DataFrame:
    """Of each project the question to go to next: the worst kind there is, the first after the current one, around the end.

    severity: 0 for an error, 1 for a warning, 2 for one that waits, null for none of these; current: place (from 0) of the
    question shown now.
    """
    w = Window.partitionBy(project)
    q = questions.withColumn("at", F.row_number().over(w.orderBy(*order)) - 1).withColumn("size", F.count(F.lit(1)).over(w))
    q = q.withColumn("severity", severity).withColumn("ahead", F.pmod(F.col("at") - current - 1 + F.col("size"), F.col("size")))
    q = q.filter(F.col("severity").isNotNull())
    return q.withColumn("nth", F.row_number().over(w.orderBy("severity", "ahead"))).filter("nth = 1").drop("nth", "size")


def queue_positions(jobs: DataFrame, submitted: list[str], running: Column) -> DataFrame:
    """Jobs that wait, with their place from 1 on; the order is global, over waiting jobs only."""
    return jobs.filter(~running).withColumn("position", F.row_number().over(Window.orderBy(*submitted)))


def batches(projects: DataFrame, batch: str, project: str, position: str) -> DataFrame:
    """Projects grouped by batch (or alone), in order of first appearance, with counts by status."""
    key = F.coalesce(F.col(batch).cast("string"), F.concat(F.lit("p"), F.col(project).cast("string")))
    return projects.groupBy(key.alias("batch")).agg(
        F.min(position).alias("first_at"), F.count(F.lit(1)).alias("projects"), F.count_if(F.col("status") == "ready").alias("ready"), F.count_if(F.col("status") == "failed").alias("failed")
    )


def search(rows: DataFrame, query: str, haystack: list[str], number: str) -> DataFrame:
    """Rows whose texts hold the query, or whose number is the query."""
    wanted = F.lit(query.lower())
    return rows.filter(F.contains(F.lower(F.concat_ws(" ", *haystack)), wanted) | (F.col(number).cast("string") == F.lit(query)))


def grouped(rows: DataFrame, values: Column, number: str) -> DataFrame:
    """Groups by a value that a row may have several of; rows without one are in the group of null."""
    g = rows.select(number, F.explode_outer(values).alias("value")).distinct().groupBy("value")
    return g.agg(F.count(F.lit(1)).alias("rows"), F.min(number).alias("first_number"))


def most_frequent(rows: DataFrame, values: Column, ids: list[str], n: int) -> DataFrame:
    """The n most frequent values, counted once for each row, ties by value."""
    g = rows.select(*ids, F.explode(values).alias("value")).distinct().groupBy("value").agg(F.count(F.lit(1)).alias("rows"))
    return g.orderBy(F.desc("rows"), "value").limit(n)
