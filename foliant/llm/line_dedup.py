"""Line dedup over the suffix array of line-ID sequences, in DataFrame functions only.

Each line's ID is a 64-bit hash. Lines that occur once end every repeat, so only the others are kept; neighbours among
them form segments. Suffixes of segments are ranked by prefix doubling: a suffix has as its rank how many suffixes sort
before it by their first line, then by 2, 4, 8 ... lines. A round pairs each rank with the rank 2**k lines on, counts
equal pairs, and adds up the counts within each rank. Pairs are counted before they are moved, so a line that fills a third
of the table costs few rows; where very many different lines follow a line, its pairs are added up in ranges of the second
rank first, which are as even as ranks are, and then over the ranges, so no line has its followers in one task.

A repeat counts from `min_words` words on. For every suffix the shortest prefix with so many words is looked up, and for
every line the shortest run that ends with it. A run of n lines, 2**k <= n < 2**(k+1), is named by n and by the ranks after
round k at its start and at 2**k lines before its end. Both ranks cover 2**k lines and overlap, so two runs have one name
if and only if all their lines are equal, which is to say if the longest common prefix of their suffixes has n lines or
more: runs of one name are an LCP interval, found without the array of all LCPs. The union of both kinds of runs is every
maximal repeated run, to the line. The first run of an interval (by id, then line) stays, lines of later runs that don't
overlap it are deleted, so each line's first occurrence always stays.

Defined results: null text stays null; an empty text has one empty line; rows that repeat an id and a text are one
document and come out alike; null ids come first; a table without repeats comes out unchanged; an empty table gives an
empty table; other columns are carried along, whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from foliant.llm.mixing import words
from foliant.llm.runtime import HEAVY, Cut, columns_for, cut, fresh, join_per_key

MIN_WORDS = 50
DOC = ["id", "known", "th"]
#: Ranges of hashes over which distinct lines are added up, and of ranks that follow a frequent line.
HASH_BITS, RANGES = 16, 256


def _runs(active: DataFrame, min_words: int) -> DataFrame:
    """(id, th, start, end): for each line the shortest runs with min_words that start and that end with it."""
    seg = Window.partitionBy(*DOC, "seg")
    at = active.withColumn("upto", F.sum("w").over(seg.orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)))
    before = F.col("upto") - F.col("w")
    # a run from line i ends at the first line whose words up to it reach those before i and min_words more;
    # lines and searched values are merged and sorted together
    data = at.select(*DOC, "seg", "ln", F.col("upto").alias("value"), F.lit(1).alias("kind"), F.col("ln").alias("hit"))
    asked = at.select(*DOC, "seg", "ln", (before + min_words).alias("value"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("hit"))
    order = seg.orderBy("value", "kind", "ln").rowsBetween(0, Window.unboundedFollowing)
    forward = data.unionByName(asked).withColumn("end", F.first("hit", ignorenulls=True).over(order)).filter("kind = 0 and end is not null")
    data = at.select(*DOC, "seg", "ln", before.alias("value"), F.lit(0).alias("kind"), F.col("ln").alias("hit"))
    asked = at.select(*DOC, "seg", "ln", (F.col("upto") - min_words).alias("value"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("hit"))
    order = seg.orderBy("value", "kind", "ln").rowsBetween(Window.unboundedPreceding, 0)
    backward = data.unionByName(asked).withColumn("start", F.last("hit", ignorenulls=True).over(order)).filter("kind = 1 and start is not null")
    return forward.select(*DOC, F.col("ln").alias("start"), "end").unionByName(backward.select(*DOC, "start", F.col("ln").alias("end"))).distinct()


def _ranked(counts: DataFrame) -> DataFrame:
    """counts (h, n) with r: how many lines sort before h. Added up in ranges of hashes, then over the ranges."""
    top = counts.withColumn("top", F.shiftright("h", 64 - HASH_BITS))
    ranges = top.groupBy("top").agg(F.sum("n").alias("size"))  # 2**HASH_BITS rows at most, whatever the input
    before = lambda w: F.coalesce(F.sum(w[1]).over(w[0].rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("top", before((Window.orderBy("top"), "size")).alias("start"))
    return top.join(F.broadcast(ranges), "top").withColumn("r", F.col("start") + before((Window.partitionBy("top").orderBy("h"), "n"))).select("h", "n", "r")


def _next_ranks(ranks: DataFrame, step: int, total: int) -> DataFrame:
    """Ranks by 2 * step lines from ranks by step lines."""
    on = F.max("r").over(Window.partitionBy(*DOC).orderBy("ln").rangeBetween(step, step))
    pairs = cut(ranks.withColumn("r2", F.coalesce(on, F.lit(-1))), "pairs")
    kinds = cut(pairs.groupBy("r", "r2", "hot").agg(F.count(F.lit(1)).alias("n")), "kinds")
    before = lambda order: F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    few = kinds.filter("not hot").select("r", "r2", before(Window.partitionBy("r").orderBy("r2")).alias("more"))
    many = kinds.filter("hot").withColumn("range", F.floor((F.col("r2") + 1) / F.lit(total // RANGES + 1)))
    starts = many.groupBy("r", "range").agg(F.sum("n").alias("n")).select("r", "range", before(Window.partitionBy("r").orderBy("range")).alias("start"))
    many = many.select("r", "r2", "range", before(Window.partitionBy("r", "range").orderBy("r2")).alias("within")).join(starts, ["r", "range"])
    more = few.unionByName(many.select("r", "r2", (F.col("start") + F.col("within")).alias("more")))
    return pairs.join(more, ["r", "r2"]).select(*DOC, "ln", (F.col("r") + F.col("more")).alias("r"), "hot")


def _later(runs: DataFrame, ranks: DataFrame, step: int, size: int) -> DataFrame:
    """(DOC, start, end), written: those of the `size` runs with step lines or more, but fewer than 2 * step, that repeat one before."""
    first = ranks.select(*DOC, F.col("ln").alias("start"), F.col("r").alias("r1"))
    last = ranks.select(*DOC, (F.col("ln") + (step - 1)).alias("end"), F.col("r").alias("r2"))
    named, name = Cut(runs.join(first, [*DOC, "start"]).join(last, [*DOC, "end"]), "named"), ["length", "r1", "r2"]
    found = named.frame.groupBy(*name).agg(F.min(F.struct("known", "id", "th", "start", "end")).alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    intervals = Cut(found, "intervals")
    same = (F.col("id") == F.col("keep.id")) & (F.col("known") == F.col("keep.known")) & (F.col("th") == F.col("keep.th"))
    joined = join_per_key(named.frame, intervals.frame, name, "n", size)
    later = cut(joined.filter(~(same & (F.col("start") <= F.col("keep.end")))).select(*DOC, "start", "end"), "later")
    named.drop()
    intervals.drop()
    return later


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(DOC, deleted): line numbers (from 0) of later copies, for documents that have any; th is xxhash64 of the text.

    A null id is written as a zero (or empty string) that is not known, so that it joins.
    """
    rows = docs.select(*columns_for(docs, id=id_col, text=text_col)).filter("text is not null")
    zero = F.lit(0).cast(rows.schema["id"].dataType) if isinstance(rows.schema["id"].dataType, NumericType) else F.lit("")
    rows = rows.select(F.coalesce("id", zero).alias("id"), F.col("id").isNotNull().alias("known"), "text")
    lines = rows.select("id", "known", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("ln", "line"))
    lines = cut(lines.select(*DOC, "ln", F.xxhash64("line").alias("h"), words(F.col("line")).alias("w")), "lines")
    counts = cut(_ranked(lines.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")), "repeated")
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    active = join_per_key(lines, counts, "h", "n", total).withColumn("hot", F.col("n") * HEAVY > F.lit(total))
    active = active.select(*DOC, "ln", "w", "r", "hot").repartition(*DOC).dropDuplicates([*DOC, "ln"])
    nth = F.row_number().over(Window.partitionBy(*DOC).orderBy("ln"))
    active = cut(active.withColumn("seg", F.col("ln") - nth), "active")
    runs = cut(_runs(active, min_words).withColumn("length", F.col("end") - F.col("start") + 1), "runs")
    # by how many bits the length has, which names the round; 31 rows at most
    sizes = runs.groupBy(F.length(F.bin("length")).alias("bits")).agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).collect()
    longest, sizes = max((r.longest for r in sizes), default=0), {r.bits: r.n for r in sizes}

    ranks, found, step = Cut(active.select(*DOC, "ln", "r", "hot"), "ranks"), runs.select(*DOC, "start", "end").limit(0), 1
    while step <= longest:
        r = ranks.frame
        if size := sizes.get(step.bit_length()):
            # written by round: one plan over all rounds would make the driver build the broadcasts of all at once
            found = found.unionByName(_later(runs.filter((F.col("length") >= step) & (F.col("length") < 2 * step)), r, step, size))
        step *= 2
        if step <= longest:
            following = Cut(_next_ranks(r, step // 2, total), "ranks")
            ranks.drop()
            ranks = following
    gone = found.select(*DOC, F.explode(F.sequence("start", "end")).alias("ln")).distinct()
    return gone.groupBy(*DOC).agg(F.collect_list("ln").alias("deleted"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, marks: bool = False) -> DataFrame:
    """docs with the later copies of repeated runs taken out of the text; with marks also n_lines and deleted (sorted)."""
    own = fresh(docs, "id", "known", "th", "deleted")
    found = cut(repeated_lines(docs, id_col, text_col, min_words), "deleted").toDF(*own)
    text = docs[f"`{text_col}`"]
    # what is deleted grows with the input, so it is never broadcast
    joined = docs.join(found.hint("merge"), docs[f"`{id_col}`"].eqNullSafe(F.when(F.col(own[1]), F.col(own[0]))) & (F.xxhash64(text) == F.col(own[2])), "left")
    lines = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(own[3]))
    clean = F.when(F.col(own[3]).isNull(), text).otherwise(F.array_join(F.transform(kept, lambda k: F.get(lines, k)), "\n"))
    columns: list[Column] = [clean.alias(c) if c == text_col else docs[f"`{c}`"] for c in docs.columns]
    if marks:
        columns += [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.array_sort(F.coalesce(own[3], F.array().cast("array<int>"))).alias("deleted")]
    return joined.select(*columns)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs, marks=True)
    return out.select("doc_id", "n_lines", F.size("deleted").cast("long").alias("n_deleted"), F.array_join(F.transform("deleted", lambda x: x.cast("string")), ",").alias("deleted"), "text")
