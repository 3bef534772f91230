"""Exact dedup: two passes over a Bloom filter find the hashes that may be repeated; only those rows shuffle.

The first pass puts the SHA-256 of every normalised text (A-Z lower-cased) into a Bloom filter whose places count to
two. A text that occurs once leaves its places at one unless others share them. The second pass looks each text up:
if one of its places counts one, the text has no copy and its row passes straight through. The others are grouped by
their whole hash, so a false alarm of the filter costs a shuffled row and never a wrong result.

The filter is blocked: the hash picks a block of 65,536 places and four places in it. Blocks are made side by side, each
from its own hashes. There are about 8 places for each document at every size. What the driver gathers and broadcasts at
once is `filter_bytes` at most (for about 33 million documents): beyond that, hashes are dealt to ranges as they are written, and the
two passes are made range by range, each over its own files, so every hash is still read twice and written once.

Defined results: null text counts as empty; null ids count as smallest; of rows that repeat an id and a text one is
kept; an empty table gives an empty table; other columns of the input are not touched, whatever their names are.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.runtime import Cut, columns_for, cut, fresh, join_per_key, released, small_batches

PLACES = 1 << 16
FILTER_BYTES = 32 << 20
PER_DOC = 8


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        sha = [hashlib.sha256((t or b"").lower()).digest() for t in texts]  # bytes.lower() changes A-Z only
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("token"), pa.array(sha, pa.binary())], ["id", "token", "sha"])


def _halves(sha: pa.Array) -> np.ndarray:
    """The first 16 bytes of each hash as two numbers: the first picks a block, the second places."""
    return np.frombuffer(b"".join(x[:16] for x in sha.to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)


def _places(second: np.ndarray) -> np.ndarray:
    return np.stack([(second >> np.uint64(s)) & np.uint64(PLACES - 1) for s in (0, 16, 32, 48)], axis=1).astype(np.int64)


def _inserts(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[np.ndarray]] = defaultdict(list)
        for batch in batches:
            h = _halves(batch.column("sha"))
            block = (h[:, 0] >> np.uint64(40)) >> np.uint64(24 - bits)
            order = np.argsort(block, kind="stable")
            blocks, at = np.unique(block[order], return_index=True)
            for b, part in zip(blocks, np.split(h[order, 1], at[1:]), strict=True):
                parts[int(b)].append(part)
        out = {}
        for b, part in parts.items():
            values, counts = np.unique(np.concatenate(part), return_counts=True)
            out[b] = np.repeat(values, np.minimum(counts, 2)).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array(list(out.values()), pa.binary())], ["block", "inserts"])

    return run


def _block(frame: pd.DataFrame) -> pd.DataFrame:
    second = np.frombuffer(b"".join(frame["inserts"]), np.uint64)
    repeated = np.bincount(_places(second).ravel(), minlength=PLACES) > 1
    return pd.DataFrame({"block": frame["block"].iloc[:1], "places": [np.packbits(repeated).tobytes()]})


def _lookup(bits: int, blocks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(blocks.value, np.uint8).reshape(1 << bits, PLACES // 8)
        for batch in batches:
            h = _halves(batch.column("sha"))
            block = ((h[:, 0] >> np.uint64(40)) >> np.uint64(24 - bits)).astype(np.int64)
            places = _places(h[:, 1])
            hit = (table[block[:, None], places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit.all(axis=1))], [*batch.schema.names, "maybe"])

    return run


def _filter(rows: DataFrame, bits: int):
    """First pass: which places more than one hash of rows (sha) was put into, sent to all workers."""
    blocks = bytearray(PLACES // 8 << bits)  # filter_bytes at most
    inserts = rows.select("sha").mapInArrow(released(_inserts(bits)), "block int, inserts binary")
    for x in inserts.groupBy("block").applyInPandas(_block, "block int, places binary").collect():
        blocks[x.block * PLACES // 8 : (x.block + 1) * PLACES // 8] = x.places
    return rows.sparkSession.sparkContext.broadcast(bytes(blocks))


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256, and possible (looked up as maybe repeated)."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    total = docs.count()
    bits, most = 0, max(0, min(24, (filter_bytes * 8 // PLACES).bit_length() - 1))
    ranges = -(-total * PER_DOC // (PLACES << most)) or 1
    while bits < most and total * PER_DOC > ranges * (PLACES << bits):
        bits += 1
    rows = docs.select(*columns_for(docs, id=id_col, text=text_col), F.monotonically_increasing_id().alias("token"))
    columns = f"id {kind}, token long, sha binary"
    rows = rows.mapInArrow(released(_digest), columns)
    looked = None
    if ranges > 1:
        rows = rows.withColumn("range", F.pmod(F.xxhash64("sha"), F.lit(ranges)).cast("int"))
        rows = Cut(rows, "digests", by="range").frame
        for r in range(ranges):
            mine = rows.filter(F.col("range") == r).select("id", "token", "sha")
            sent = _filter(mine, bits)
            found = cut(mine.mapInArrow(released(_lookup(bits, sent)), f"{columns}, maybe boolean"), "looked")
            sent.destroy()
            looked = found if looked is None else looked.unionByName(found)
    else:
        rows = cut(rows, "digests")
        looked = rows.mapInArrow(released(_lookup(bits, _filter(rows, bits))), f"{columns}, maybe boolean")

    alone = looked.filter(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", "maybe")
    maybe = looked.filter("maybe")
    groups = maybe.groupBy("sha").agg(F.max(F.struct("id", "token")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    grouped = join_per_key(maybe, groups, "sha", "group_size", total).select("id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("token") == F.col("keep.token")).alias("kept"), "sha", "maybe")
    return alone.unionByName(grouped).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), F.col("maybe").alias("possible"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows of which an equal text with a larger id stays. Ids must be distinct here."""
    (name,) = fresh(docs, "gone")
    gone = find_copies(docs, id_col, text_col, **options).filter(~F.col("kept")).select(F.col(id_col).alias(name))
    return docs.join(gone.hint("merge"), docs[f"`{id_col}`"].eqNullSafe(F.col(name)), "left_anti")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("possible")


OP1_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM documents),
g AS (SELECT n, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM t JOIN g USING (n)
"""
