"""Uploads as a stream: new files of a folder become jobs, each once; progress is counted as pages arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOBS = "job_id string, project_id string, submitted_at timestamp, pages int"
PAGES = "job_id string, page int, done_at timestamp"


def job_stream(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """Jobs of a folder of JSON files; a job that is handed in again within the delay counts once."""
    jobs = spark.readStream.schema(JOBS).json(path)
    return jobs.withWatermark("submitted_at", late).dropDuplicatesWithinWatermark(["job_id"])


def progress_stream(spark: SparkSession, path: str, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Pages done by job and window."""
    pages = spark.readStream.schema(PAGES).json(path)
    return pages.withWatermark("done_at", late).groupBy(F.window("done_at", window), "job_id").agg(F.approx_count_distinct("page").alias("pages_done"), F.max("page").alias("last_page"))


def resume(jobs: DataFrame) -> DataFrame:
    """After a restart: jobs that waited or ran wait again."""
    return jobs.withColumn("status", F.when(F.col("status").isin("queued", "processing"), "queued").otherwise(F.col("status")))
