"""Tables that cut lineage, kept in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than 1/HEAVY of the rows is heavy, so there are fewer than HEAVY such keys at any size.
HEAVY = 2000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only in local mode, where it may be unset, a folder of our own."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="foliant-"))
        folder = sc.getCheckpointDir()
    return f"{folder}/{sc.applicationId}"


class Cut:
    """A data frame written once as Parquet; frame reads it, drop() deletes it. by: a column by which each task parts its files."""

    def __init__(self, df: DataFrame, name: str, by: str | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        (df.write.partitionBy(by) if by else df.write).parquet(self.path)
        self.frame = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a lost executor costs no more than the rows read again."""
    return Cut(df, name).frame


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str | list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to per_key (one row for each key, whose size column counts its rows) without a hot task.

    Keys that hold more than 1/HEAVY of all rows are fewer than HEAVY, whatever the input: they are broadcast.
    The rest is shuffled; none of its keys has more than 1/HEAVY of the rows.
    """
    heavy = F.broadcast(per_key.filter(F.col(size) * HEAVY > F.lit(total)))
    light = per_key.filter(F.col(size) * HEAVY <= F.lit(total))
    keys = [key] if isinstance(key, str) else key
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(*keys), key, "left_anti").join(light, key, how))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, made so that df has no column of any of them."""
    taken, sign = {c.lower() for c in df.columns}, "_"
    while any(f"{sign}{n}".lower() in taken for n in names):
        sign += "_"
    return [f"{sign}{n}" for n in names]


def columns_for(docs: DataFrame, **wanted: str) -> list[Column]:
    """Only the columns that are needed, under our own names, so that extra columns can't clash."""
    return [docs[f"`{column}`"].alias(name) for name, column in wanted.items()]


#: Bytes of texts that a Python worker gets at once; the JVM holds as much outside its heap for each task.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_BYTES if they may be larger, so that workers are small at every size."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


#: What a Python worker keeps from task to task, by the operator that does.
kept: dict[str, dict] = {}


def released(work: Callable[[Iterator], Iterator], keeps: str = "") -> Callable[[Iterator], Iterator]:
    """work, after which a worker gives free memory back to the system instead of keeping it for its next task.

    What other operators than `keeps` have kept in the worker goes before it begins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        yield from work(batches)
        trim()

    return run


def forget(but: str) -> None:
    """A function of the module, so that a worker's own table is meant and not a copy that came with the work."""
    for other in [name for name in kept if name != but]:
        del kept[other]
    trim()


def trim() -> None:
    pa.set_memory_pool(pa.system_memory_pool())  # Arrow's own pools keep what is freed
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)
