"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree, in DataFrame functions only.

1. Sizes and targets. Every document has a size in words. Sources share `share` times all sizes by weight; a source's
   target stops at `most` times its size and the excess is shared again, which is a level found on the sorted ratios.
2. Blocks. A hash of id and text deals each source's documents into blocks of about equal size; there are about
   `per_shard` blocks for each output shard in all, and one for each source at least. Shards hold SHARD_WORDS words each,
   so their number follows the input (`shards` at least), and blocks and tasks are alike at every size.
3. Quotas. A source is drawn in whole passes and a last part: blocks in the order of a seeded hash until the next does not
   fit; of that one, documents in hash order until the next does not fit, and the document that fills the rest best, or
   else the block further on that does.
   No document is drawn more often than the passes begun, so none exceeds `most` times its size.
4. Tree. All drawn blocks stand at the root. Each node deals half of its blocks, rounded down, to the left by a seeded
   permutation, which draws the counts by source from the multivariate hypergeometric law; the leaves are the shards.
   Blocks are disjoint, so each shard reads its own; rows are shuffled within a shard by hash. Windows over blocks see
   `per_shard` narrow rows for each shard, those over documents one block of each source.

Everything follows from seed, ids and texts: reruns and other partitionings agree.

Defined results: null or empty text has size 0 and is drawn with its block, which changes no sum; a null source is a
source of its own and the last; rows that are equal in id, text and source are drawn alike; an empty table gives an empty
table; other columns are carried along unchanged, whatever their names are, but for those named like columns made here
(shard, draw and the marks), which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.runtime import cut

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
SHARDS, PER_SHARD = 16, 64
#: Words of a shard, and tasks that write it.
SHARD_WORDS, PARTS = 100_000_000, 8
#: Plans of more rows than this (sources, or drawn blocks) are joined by shuffle rather than broadcast.
BROADCAST_ROWS = 50_000


def words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, keep: Sequence[str] = ()) -> DataFrame:
    """_size, _source (never null, in the order of sources), _rank, and the columns in keep as one struct, _row."""
    source, text = docs[f"`{source_col}`"].cast("string"), docs[f"`{text_col}`"]
    return docs.select(
        words(text).alias("_size"),
        F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), source)).alias("_source"),
        F.xxhash64(F.lit(seed), docs[f"`{id_col}`"], text).alias("_rank"),
        *([F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(keep)]).alias("_row")] if keep else []),
    )


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (_source, _size) by source: source_size, target, passes (whole ones) and rest (words of the last part)."""
    by = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    nth = F.pmod(F.row_number().over(Window.orderBy("_source")) - 1, F.lit(len(weights)))  # as many rows as sources
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth.cast("int") + 1))
    by = by.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio", "_source")
    full = F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    free = F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    by = by.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - full) / free)
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    by = by.withColumn("target", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap"))))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    by = by.withColumn("passes", passes.cast("int"))
    return by.select("_source", "source_size", "target", "passes", (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest"))


def plan(sized: DataFrame, weights: Sequence[float], share: float, most: float, shards: int, per_shard: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Tables of sources (with their number of blocks) and of drawn blocks (with the shards of each draw); sized: _source, _size, _rank."""
    sources = cut(targets(sized, weights, share, most), "targets")
    shards = max(shards, math.ceil((sources.agg(F.sum("target").alias("n")).first().n or 0) / SHARD_WORDS))
    whole = F.sum("source_size").over(Window.partitionBy()) / F.lit(shards * per_shard)
    sources = cut(sources.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.greatest(whole, F.lit(1.0))).cast("int"))), "sources")
    at = placed(sized, sources).select("_source", "_block", "_size", "_rank", "rest")
    blocks = at.groupBy("_source", "_block").agg(F.sum("_size").alias("size"))
    order = Window.partitionBy("_source").orderBy(F.xxhash64(F.lit(seed), F.lit("block"), "_source", "_block"), "_block")
    blocks = blocks.join(sources, "_source").withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = cut(blocks.select("_source", "_block", "passes", "size", (F.col("rest") - F.col("upto")).alias("left")), "blocks")
    # the block at which the rest ends: documents in hash order, and the one that fills what is left best
    ends = blocks.filter("left < 0 and left + size > 0").select("_source", "_block", (F.col("left") + F.col("size")).alias("room"))
    inner = at.join(F.broadcast(ends) if few(sources) else ends, ["_source", "_block"])
    inner = inner.withColumn("upto", F.sum("_size").over(Window.partitionBy("_source", "_block").orderBy("_rank")))
    inner = inner.groupBy("_source", "_block", "room", "_rank").agg(F.max("_size").alias("one"), F.sum("_size").alias("all"), F.max("upto").alias("upto"))
    taken = inner.groupBy("_source", "_block", "room").agg(F.max(F.when(F.col("upto") <= F.col("room"), F.struct("upto", "_rank"))).alias("last"))
    taken = taken.withColumn("gap", F.col("room") - F.coalesce("last.upto", F.lit(0)))
    fill = inner.join(taken.select("_source", "_block", "gap"), ["_source", "_block"]).filter((F.col("upto") > F.col("room")) & (F.abs(F.col("gap") - F.col("all")) < F.col("gap")))
    fill = fill.groupBy("_source", "_block").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("all")).alias("off"), F.col("_rank").alias("fill"))).alias("best"))
    taken = taken.join(fill, ["_source", "_block"], "left").select("_source", "_block", F.col("last._rank").alias("upto_rank"), F.col("best.fill").alias("fill_rank"), F.lit(True).alias("part"), "gap", F.coalesce("best.off", "gap").alias("off"))
    taken = cut(taken, "ends")
    # if no document there has filled it, the block further on that does it best
    more = blocks.filter("left < 0").join(taken.filter("off = gap and gap > 0").select("_source", "gap", F.col("_block").alias("end")), "_source").filter("_block <> end and abs(gap - size) < gap")
    more = more.groupBy("_source").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), F.col("_block"))).alias("best")).select("_source", F.col("best._block").alias("_block"), F.lit(True).alias("further"))
    drawn = blocks.join(taken.drop("gap", "off"), ["_source", "_block"], "left").join(more, ["_source", "_block"], "left").withColumn("whole", (F.col("left") >= 0) | F.coalesce("further", F.lit(False)))
    draws = F.col("passes") + F.when(F.col("whole") | F.coalesce("part", F.lit(False)), 1).otherwise(0)
    drawn = drawn.withColumn("draw", F.explode(F.when(draws > 0, F.sequence(F.lit(1), draws))))
    # the splitting tree
    drawn = drawn.withColumn("node", F.lit(0))
    for level in range((shards - 1).bit_length()):
        node = Window.partitionBy("node")
        nth = F.row_number().over(node.orderBy(F.xxhash64(F.lit(seed), F.lit(level), "_source", "_block", "draw"), "_source", "_block", "draw"))
        drawn = drawn.withColumn("right", (nth > F.floor(F.count(F.lit(1)).over(node) / 2)).cast("int")).withColumn("node", F.col("node") * 2 + F.col("right"))
    drawn = drawn.groupBy("_source", "_block").agg(F.first("passes").alias("passes"), F.first("whole").alias("whole"), F.first("part").alias("part"), F.first("upto_rank").alias("upto_rank"), F.first("fill_rank").alias("fill_rank"), F.array_sort(F.collect_list(F.struct("draw", "node"))).alias("draws"))
    return sources, cut(drawn, "draws")


def few(table: DataFrame) -> bool:
    return table.count() <= BROADCAST_ROWS


def placed(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Each row with the columns of its source, and its block."""
    small = sources.select("_source", "source_size", "target", "rest", "blocks")
    return sized.join(F.broadcast(small) if few(sources) else small, "_source", "left").withColumn("_block", F.pmod(F.xxhash64("_rank"), F.col("blocks")).cast("int"))


def drawn(sized: DataFrame, sources: DataFrame, draws: DataFrame) -> DataFrame:
    """Each row of sized with _draws: the draws that take it, each with its shard."""
    draws = F.broadcast(draws) if few(draws) else draws
    rows = placed(sized, sources).join(draws, ["_source", "_block"], "left")
    no = F.lit(False)
    last = F.coalesce(F.col("_rank") <= F.col("upto_rank"), no) | F.coalesce(F.col("_rank") == F.col("fill_rank"), no)
    part = F.coalesce("whole", no) | F.coalesce(F.col("part"), no) & last
    return rows.withColumn("_draws", F.filter(F.coalesce("draws", F.array().cast("array<struct<draw:int,node:int>>")), lambda d: (d["draw"] <= F.col("passes")) | part))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, shards: int = SHARDS, per_shard: int = PER_SHARD, seed: int = 1, keep: Sequence[str] | None = None, marks: bool = False) -> DataFrame:
    """The mix: rows of docs (the columns in keep, or all), repeated where drawn again, with shard and draw; dealt by
    shard and shuffled within it. marks: also size, source_size, target and row_key, a hash that is equal for rows of equal
    id and text."""
    made = ["shard", "draw", *(["size", "source_size", "target", "row_key"] if marks else [])]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    keyed = _keyed(docs, id_col, text_col, source_col, seed, keep)
    sources, draws = plan(cut(keyed.select("_source", "_size", "_rank"), "sizes"), weights, share, most, shards, per_shard, seed)
    rows = drawn(keyed, sources, draws).withColumn("_draw", F.explode("_draws"))
    place = F.xxhash64(F.lit(seed), F.col("_draw.draw"), "_rank").alias("_place")
    rows = rows.select("_row", F.col("_draw.node").alias("shard"), F.col("_draw.draw").alias("draw"), place, *([F.col("_size").alias("size"), "source_size", "target", F.col("_rank").alias("row_key")] if marks else []))
    rows = rows.repartition("shard", F.pmod("_place", F.lit(PARTS))).sortWithinPartitions("shard", "_place")
    return rows.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(keep)], *made)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix(docs, keep=["doc_id", "source"], marks=True)
    key = [F.col("doc_id"), F.col("source"), F.col("row_key")]
    taken = mixed.groupBy(*key).agg(F.count(F.lit(1)).alias("draws"))
    own = docs.select("doc_id", "source", F.xxhash64(F.lit(1), "doc_id", "text").alias("row_key"), words(F.col("text")).alias("size"))
    # rows that are equal are drawn alike
    own = own.withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    same = own["doc_id"].eqNullSafe(taken["doc_id"]) & own["source"].eqNullSafe(taken["source"]) & (own["row_key"] == taken["row_key"])
    out = own.join(taken.hint("merge"), same, "left").select(own["doc_id"], own["source"], "size", (F.coalesce(F.col("draws") / F.col("rows"), F.lit(0)) * F.col("size")).cast("long").alias("taken"))
    by = targets(_keyed(docs, "doc_id", "text", "source", 1).select("_source", "_size")).select("_source", "source_size", "target")
    name = F.when(out["source"].isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), out["source"].cast("string")))
    by = cut(by, "targets")
    return out.withColumn("_source", name).join(F.broadcast(by) if few(by) else by, "_source").select("doc_id", "size", "source_size", "target", "taken")
