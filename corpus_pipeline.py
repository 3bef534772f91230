"""From documents to token pieces: rejects, repeated lines, near-duplicates, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and returns a data frame; run() writes each result as Parquet to the shared folder
and reads it again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import line_dedup, mixing, near_dedup, pieces, quality
from foliant.llm.runtime import Cut
from foliant.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labels of these documents, does not reject."""
    ship(spark)
    return quality.keep_good(spark, docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of repeated line runs; a document of which nothing else is left goes."""
    clean = line_dedup.dedup_lines(docs.select(COLUMNS), marks=True)
    lost_all = (F.size("deleted") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    clean = clean.filter(~F.coalesce(lost_all, F.lit(False)))
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    ship(spark)
    return near_dedup.keep_first(docs).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents drawn to the targets of their sources, repeated where drawn again, shuffled in shards."""
    return mixing.mix(docs).select(COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, pieces (packed numbers), n_pieces, and the hash of the text decoded again, with whether it is
    the text; a document that was drawn twice is segmented twice."""
    ship(spark)
    return pieces.encode(docs, keep=["doc_id", "lang", "source"], check=True, by_row=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("pieces", encode_pieces),
]
#: Fitted weights and merges are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        now = Cut(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if before:
            before.drop()
        before, docs = now, now.frame
    return STAGES[-1][1](spark, docs, sf_dir)
