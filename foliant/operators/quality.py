"""Words and pages of a reading: flags, quality, and whether a page needs an AI at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as t

ALWAYS_BELOW, CHECK_BELOW, SHAPE_BELOW, TRUSTED = 20.0, 60.0, 88.0, 80.0
BLANK_INK, CHARS_PER_INK = 0.002, 25_000.0


def clamp(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def refine_flags(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """words (doc, text, conf, flag) with flags made anew; lexicon: word.

    A word is trusted if the lexicon has it or if it was read with confidence elsewhere in its document.
    """
    w = words.withColumn("_key", t.lexicon_key(F.col("text")))
    sure = w.filter((F.col("conf") >= TRUSTED) & ~t.is_malformed(F.col("text"))).select("doc", "_key").distinct().withColumn("_sure", F.lit(True))
    known = lexicon.select(t.lexicon_key(F.col("word")).alias("_key")).distinct().withColumn("_known", F.lit(True))
    w = w.join(known, "_key", "left").join(sure, ["doc", "_key"], "left")
    trusted = F.coalesce("_known", F.lit(False)) | F.coalesce("_sure", F.lit(False))
    conf = F.col("conf")
    doubt = (conf < ALWAYS_BELOW) | ((conf < CHECK_BELOW) & ~trusted) | ((conf < SHAPE_BELOW) & t.is_malformed(F.col("text")))
    doubt = (F.col("_key") != "") & ~(t.is_option_marker(F.col("text")) & (conf >= ALWAYS_BELOW)) & doubt
    keep = F.coalesce(F.col("flag") == "disagree", F.lit(False)) | conf.isNull()
    return w.withColumn("flag", F.when(keep, F.col("flag")).when(doubt, "low_conf")).drop("_key", "_sure", "_known")


def is_known(text: Column, key: Column, in_lexicon: Column) -> Column:
    """true, false, or null for what a lexicon can't tell."""
    plain = t.strip(text)
    number = plain.rlike(r"^[(\[]?[0-9۰-۹٠-٩]+[)\].\-/:]*$") | t.is_option_marker(plain)
    persian = key.rlike("[؀-ۿ]")
    return F.when(number, True).when(persian, in_lexicon).when(plain.rlike("[A-Za-z]"), False)


def is_garbage(text: Column, key: Column) -> Column:
    plain = t.strip(text)
    mixed = plain.rlike("[A-Za-z]") & plain.rlike("[؀-ۿ]")
    alone = (F.char_length(key) == 1) & key.rlike(r"^[؀-ۿ&&[\p{L}]]$") & ~key.isin("و", "ب", "ج", "د")
    return t.is_malformed(plain) | mixed | alone


def weighted(flagged: Column, known: Column, conf: Column, garbage: Column) -> Column:
    """The score of shares: flagged, known (null: none could be told), mean confidence (null: none), garbage."""
    return 0.30 * clamp(1 - flagged / 0.30) + 0.35 * clamp((F.coalesce(known, F.lit(0.0)) - 0.30) / 0.55) + 0.20 * clamp((F.coalesce(conf, F.lit(85.0)) - 40) / 50) + 0.15 * clamp(1 - garbage / 0.25)


def page_quality(words: DataFrame, lexicon: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, page, quality); pages: doc, page, ink_ratio (or null). One aggregation over words."""
    w = words.filter(t.strip(F.col("text")) != "").withColumn("_key", t.lexicon_key(F.col("text")))
    known = lexicon.select(t.lexicon_key(F.col("word")).alias("_key")).distinct().withColumn("_known", F.lit(True))
    w = w.join(known, "_key", "left")
    share = lambda c: F.avg(c.cast("double"))
    s = w.groupBy("doc", "page").agg(
        share(F.col("flag").isNotNull()).alias("flagged"), share(is_known(F.col("text"), F.col("_key"), F.coalesce("_known", F.lit(False)))).alias("known"),
        F.avg("conf").alias("conf"), share(is_garbage(F.col("text"), F.col("_key"))).alias("garbage"), F.sum(F.char_length("text")).alias("chars"),
    )
    p = pages.join(s, ["doc", "page"], "left")
    cover = F.when(F.col("ink_ratio") > 0, clamp(F.col("chars") / (0.25 * F.col("ink_ratio") * CHARS_PER_INK))).otherwise(1.0)
    score = clamp(weighted(F.col("flagged"), F.col("known"), F.col("conf"), F.col("garbage")) * cover)
    quality = F.when(F.col("ink_ratio") < BLANK_INK, 1.0).when(F.col("chars").isNull(), 0.0).otherwise(F.round(score, 3))
    return p.select("doc", "page", quality.alias("quality"))


def ai_mode(policy: Column, quality: Column, flags: Column, blank: Column, threshold: float = 0.6) -> Column:
    """none, correct or transcribe."""
    return F.when(blank | (policy == "off"), "none").when(policy == "full", "transcribe").when(quality < threshold, "transcribe").when(flags > 0, "correct").otherwise("none")


def within_budget(calls: DataFrame, project: str, order: list[str], cap: int) -> DataFrame:
    """Calls that aren't cached, the first `cap` of each project in a fixed order; adds granted."""
    nth = F.row_number().over(Window.partitionBy(project, "cached").orderBy(*order))
    return calls.withColumn("granted", F.col("cached") | (nth <= cap))


def usage_rollup(calls: DataFrame, prices: DataFrame, group: list[str]) -> DataFrame:
    """Sums of usage and cost in millionths; prices: engine, in_price, out_price (for a million tokens, whole numbers)."""
    c = calls.join(F.broadcast(prices), "engine", "left")  # one row for each engine
    cost = F.col("input_tokens") * F.coalesce("in_price", F.lit(0)) + F.col("output_tokens") * F.coalesce("out_price", F.lit(0))
    return c.groupBy(*group).agg(F.count(F.lit(1)).alias("calls"), F.count_if("cached").alias("cached"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(cost).alias("cost_micro"))


def new_words(before: DataFrame, after: DataFrame, known: DataFrame) -> DataFrame:
    """(word): keys of words typed in that were neither there before nor known; all three: text or word columns named word."""
    key = lambda d: d.select(t.lexicon_key(F.col("word")).alias("word"))
    typed = after.filter(~t.is_malformed(F.col("word"))).select(t.lexicon_key(F.col("word")).alias("word")).filter(F.char_length("word") >= 2)
    return typed.distinct().join(key(before), "word", "left_anti").join(key(known), "word", "left_anti")
