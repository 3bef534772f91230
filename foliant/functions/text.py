"""Scalar text functions as column expressions; nothing leaves the JVM except NFKC, which Spark lacks.

Java's \\p{L}\\p{N}_ stands for a word character and \\p{Nd} for a digit; BLANK spells out white space, since Java's own
class is ASCII. Every function maps null to null unless it says otherwise.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Alphabets and character classes of the normal forms.
ZWNJ = "‌"
ASCII_DIGITS, PERSIAN_DIGITS, ARABIC_DIGITS = "0123456789", "۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩"
ARABIC_LETTER = "ء-غف-يٱ-ۓۺ-ۿ"
INVISIBLE = "​﻿‎‏‪-‮⁦-⁩­"
DIACRITICS = "ً-ٰٟۖ-ۭ"
BLANK = " \t\x0b\f\r\x1c-\x1f\x85   -     　"
BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85                 　"
WORD = r"\p{L}\p{N}_"
EDGE_PUNCTUATION = "«»()[]{}\"'.,،;؛:!?؟-–—ـ*•"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, by Arrow batches."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[\n{BLANK}]+", " "))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, PERSIAN_DIGITS + ARABIC_DIGITS, ASCII_DIGITS * 2)


def persian_digits(text: Column) -> Column:
    return F.translate(text.cast("string"), ASCII_DIGITS + ARABIC_DIGITS, PERSIAN_DIGITS * 2)


#: Patterns and what they become, in the order in which the display form applies them.
_DISPLAY = (
    (f"[{INVISIBLE}]", ""),
    (f"(?<=[{ARABIC_LETTER}])ـ+(?=[{ARABIC_LETTER}])", ""),
    (f"[{BLANK}]+", " "),
    (f"{ZWNJ}{{2,}}", ZWNJ),
    (f" *{ZWNJ} +| +{ZWNJ} *", " "),
    (f"(?m)^{ZWNJ}+|{ZWNJ}+$", ""),
    (f"(?<![{WORD}{ZWNJ}])(ن?می) +(?=[{ARABIC_LETTER}])", f"$1{ZWNJ}"),
    ("(?<=[؀-ۿ‌]) *\\?", "؟"),
    (" +(?=[؟،؛!])", ""),
    (f" *\n[\n{BLANK}]*", "\n"),
)


#: Text without any of these is changed by three of the rules only: white space, blanks before "!", line ends.
_SPECIAL = f"[؀-ۿ{ZWNJ}{INVISIBLE}]"
_PLAIN = ((f"[{BLANK}]+", " "), (" +(?=!)", ""), (f" *\n[\n{BLANK}]*", "\n"))


def _by_rules(text: Column) -> Column:
    out = F.translate(text, "يىك" + ARABIC_DIGITS, "ییک" + PERSIAN_DIGITS)
    for pattern, replacement in _DISPLAY:
        out = F.regexp_replace(out, pattern, replacement)
    return strip(out)


def display_form(text: Column, compose: bool = False) -> Column:
    """How text is shown and stored. compose: apply NFKC first, for text that may not be in that form already."""
    text = nfkc(text) if compose else text
    plain = text
    for pattern, replacement in _PLAIN:
        plain = F.regexp_replace(plain, pattern, replacement)
    return F.when(text.rlike(_SPECIAL), _by_rules(text)).otherwise(strip(plain))


def _folded(text: Column) -> Column:
    return F.translate(text, "أإآٱؤئةۀ" + ZWNJ, "اااا" + "ویهه")


def comparison_form(text: Column, compose: bool = False) -> Column:
    """For equality and containment: digits in ASCII, letters folded, words of letters and digits with single spaces."""
    text = nfkc(text) if compose else text
    out = F.regexp_replace(_folded(ascii_digits(_by_rules(text))), f"[{DIACRITICS}ـ]", "")
    return F.trim(F.lower(F.regexp_replace(F.when(text.rlike(_SPECIAL), out).otherwise(text), r"[^\p{L}\p{N}]+", " ")))


def plain_comparison_form(text: Column) -> Column:
    """The comparison form of text that has no Arabic script, marks or invisibles: what is left of the rules then."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def reading_form(text: Column, compose: bool = False) -> Column:
    """For comparing two readings of a word: marks and everything but word characters deleted, no spaces put in."""
    out = nfkc(text) if compose else text
    out = F.translate(out, "يىك" + ARABIC_DIGITS + PERSIAN_DIGITS, "ییک" + ASCII_DIGITS * 2)
    return F.lower(F.regexp_replace(_folded(F.regexp_replace(out, f"[{DIACRITICS}ـ]", "")), f"[^{WORD}]+", ""))


def lexicon_key(text: Column, compose: bool = False) -> Column:
    """Key of a word in lexicons: without punctuation at its ends and joiners."""
    return F.translate(F.btrim(nfkc(text) if compose else text, F.lit(EDGE_PUNCTUATION)), "يك" + ZWNJ, "یک")


def alias_form(text: Column, compose: bool = False) -> Column:
    """Key of a law's name: dots part letters."""
    return comparison_form(F.replace(text, F.lit("."), F.lit(" ")), compose)


def search_form(text: Column) -> Column:
    """What a search box compares."""
    return F.lower(ascii_digits(F.regexp_replace(F.translate(text, "يك", "یک"), f"[{ZWNJ}{INVISIBLE}]", "")))


# Shapes that a Persian print doesn't have, and option markers, which are no such words.
PERSIAN = "؀-ۿ‌"
MALFORMED = (
    f"[{PERSIAN}][0-9۰-۹٠-٩]|[0-9۰-۹٠-٩][{PERSIAN}]",
    f"[{PERSIAN}][.:،,؛;][{PERSIAN}]",
    "[ً-ِْ]",
    "[يكة]",
    f"[A-Za-z][{PERSIAN}]|[{PERSIAN}][A-Za-z]",
    r"(.)\1\1",
)
OPTION_MARKER = r"^\(?(?:[0-9۰-۹]{1,3}|الف|ب|ج|د)[)\-.]$"


def is_option_marker(word: Column) -> Column:
    return strip(word).rlike(OPTION_MARKER)


def is_malformed(word: Column) -> Column:
    core = F.btrim(word, F.lit(EDGE_PUNCTUATION))
    hit = F.lit(False)
    for pattern in MALFORMED:
        hit = hit | core.rlike(pattern)
    return (core != "") & ~is_option_marker(word) & hit


def is_garbage(text: Column) -> Column:
    """Private-use or control characters beyond 5 %, or Latin-1 in place of Arabic script."""
    full = F.regexp_count(text, F.lit(f"[^\n{BLANK}]"))
    odd = F.regexp_count(text, F.lit(r"[\p{Co}\p{Cc}�&&[^\n\t\r]]"))
    latin = F.regexp_count(text, F.lit("[À-ÿ]"))
    arabic = F.regexp_count(text, F.lit("[؀-ۿ]"))
    return (full > 0) & ((odd * 20 > full) | ((latin * 10 > full * 3) & (arabic * 5 < full)))


def reverse_if_arabic(word: Column) -> Column:
    return F.when(word.rlike("[؀-ۿ]"), F.reverse(word)).otherwise(word)


def split_glued_marker(word: Column) -> Column:
    """Array of the word's parts: an option or question marker at its start stands alone; empty for no word."""
    core = F.btrim(word, F.lit("*#•▪"))
    glued = r"^([(\[]?(?:\p{Nd}{1,3}|الف|لف|اف|ب|ج|د)[)\].\-–—ـ:]+)(\S+)$"
    parts = F.array(F.regexp_extract(core, glued, 1), F.regexp_extract(core, glued, 2))
    return F.when(core == "", F.array().cast("array<string>")).when(core.rlike(glued), parts).otherwise(F.array(core))


HEADING_PREFIX = r"^(بخش|فصل|مبحث|گفتار|قسمت|باب|درس|مقدمه)(\s+[^\s:]+){0,2}\s*:"


def is_section_heading(text: Column) -> Column:
    return text.rlike(HEADING_PREFIX) & (F.size(F.split(squeeze(text), " ")) <= 14)


def heading_title(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, HEADING_PREFIX + r"\s*", ""), F.lit(" .:؛"))


def clip(text: Column, n: int) -> Column:
    """Squeezed, at most n characters, the last an ellipsis if anything was cut."""
    one = squeeze(text)
    return F.when(F.char_length(one) <= n, one).otherwise(F.concat(F.rtrim(F.left(one, F.lit(n - 1))), F.lit("…")))


# How explanations name an option.
KEY_WORDS = {"الف": "1", "ب": "2", "ج": "3", "د": "4", "یک": "1", "اول": "1", "دو": "2", "دوم": "2", "سه": "3", "سوم": "3", "چهار": "4", "چهارم": "4"}
KEY = "[«\"'(\\[]?\\s*([1-4]|الف|چهارم|چهار|سوم|دوم|اول|یک|سه|دو|ب|ج|د)(?![\\p{L}\\p{N}_])[»\"')\\]]?"
OPTION_WORD = f"گزینه[{ZWNJ}\\s]*(?:ی\\s*)?(?:شماره\\s*)?"
CORRECT = r"\s*(?:درست|صحیح)(?!\s*نیست)"
ANSWER_WORD = r"(?:پاسخ|جواب)\s*(?:صحیح|درست)?\s*"
STRONG = (f"(?<![{WORD}]){OPTION_WORD}{KEY}{CORRECT}", f"(?<![{WORD}]){ANSWER_WORD}[:：]\\s*(?:{OPTION_WORD})?{KEY}")
WEAK = (f"{OPTION_WORD}{KEY}", f"{ANSWER_WORD}[:：]?\\s*(?:گزینه\\s*)?{KEY}")
INLINE = (f"^(?:{ANSWER_WORD}[:：]?\\s*)?{OPTION_WORD}{KEY}{CORRECT}", f"^{ANSWER_WORD}[:：]\\s*(?:{OPTION_WORD})?{KEY}")


def key_value(word: Column) -> Column:
    """1 to 4 for a digit or word; null for none."""
    named = F.create_map(*[F.lit(x) for pair in KEY_WORDS.items() for x in pair])
    return F.coalesce(F.try_element_at(named, word), F.when(word.rlike("^[1-4]$"), word))


def _earliest(text: Column, patterns: tuple[str, ...]) -> Column:
    """The key of the match that begins first."""
    hits = F.array_compact(F.array(*[F.when(F.regexp_instr(text, F.lit(p)) > 0, F.struct(F.regexp_instr(text, F.lit(p)).alias("at"), F.lit(i).alias("i"), F.regexp_extract(text, p, 1).alias("key"))) for i, p in enumerate(patterns)]))
    return F.when(F.size(hits) > 0, F.array_min(hits)["key"])


def stated_key(explanation: Column, window: int = 200) -> Column:
    """The option that an explanation states: outright anywhere, or mentioned near its start."""
    text = ascii_digits(display_form(explanation))
    return key_value(F.coalesce(_earliest(text, STRONG), _earliest(F.left(text, F.lit(window)), WEAK)))


def inline_key_statement(line: Column) -> Column:
    """The key if the line begins with a statement of it."""
    text = ascii_digits(display_form(line))
    return key_value(F.coalesce(*[F.when(text.rlike(p), F.regexp_extract(text, p, 1)) for p in INLINE]))


GUARDS = ("ماده", "مواد", "بند", "تبصره", "اصل", "فصل", "جزء", "قسمت", "فقره", "شماره")


def inner_markers(text: Column) -> Column:
    """Option markers within a text (array), without those that a guard word makes a reference."""
    pattern = r"(?:(\S+)\s+|^\s*)\(?([1-4]|الف|ب|ج|د)\s*[)\-]\s*(?=\p{L}|_)"
    plain = ascii_digits(text)
    words, marks = F.regexp_extract_all(plain, F.lit(pattern), F.lit(1)), F.regexp_extract_all(plain, F.lit(pattern), F.lit(2))
    pairs = F.filter(F.arrays_zip(words.alias("w"), marks.alias("m")), lambda p: ~F.coalesce(p["w"].isin(*GUARDS), F.lit(False)))
    found = plain.rlike(r"(?:[1-4]|الف|[بجد])\s*[)\-]\s*[\p{L}_]")  # far cheaper than the whole pattern
    return F.when(found, F.transform(pairs, lambda p: p["m"])).when(plain.isNotNull(), F.array().cast("array<string>"))


def parse_keys(text: Column) -> Column:
    """Typed answers as an array: 1 to 4, or null for a skipped one; null for a text with any other character.

    Tokens with white space between them may be letters; without letters every character is one answer.
    """
    letters = {"الف": "1", "ب": "2", "ج": "3", "د": "4", "a": "1", "b": "2", "c": "3", "d": "4"}
    named = F.create_map(*[F.lit(x) for pair in letters.items() for x in pair])
    plain = F.lower(squeeze(ascii_digits(text)))
    tokens = F.split(plain, " ")
    lettered = (F.size(tokens) > 1) & F.exists(tokens, lambda t: t.isin(*letters))
    by_token = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(named, t), F.when(t.rlike("^[1-4]$"), t)))
    chars = F.regexp_replace(plain, r"[\s,،|/]+", "")
    by_char = F.transform(F.filter(F.split(chars, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[1-4]"), c))
    return F.when(lettered, by_token).when(chars.rlike(r"^[1-40\-_.?؟x]*$"), by_char)


def parse_keys_lenient(text: Column) -> Column:
    """The review page's variant: a blank skips one answer and unknown characters are passed over."""
    chars = F.filter(F.split(ascii_digits(text), ""), lambda c: c.rlike(r"^[1-40\-_.?؟xX ]$"))
    return F.transform(chars, lambda c: F.when(c.rlike("[1-4]"), c))


def compact_runs(numbers: Column, dash: str = "–", comma: str = "، ") -> Column:
    """Sorted distinct numbers as runs: [1, 2, 3, 7] as 1–3، 7."""
    start = F.struct(F.array().cast("array<struct<lo:int,hi:int>>").alias("runs"))
    last = lambda a: F.element_at(a, -1)

    def step(acc: Column, n: Column) -> Column:
        grown = F.concat(F.slice(acc["runs"], 1, F.greatest(F.size(acc["runs"]) - 1, F.lit(0))), F.array(F.struct(last(acc["runs"])["lo"].alias("lo"), n.cast("int").alias("hi"))))
        fresh = F.concat(acc["runs"], F.array(F.struct(n.cast("int").alias("lo"), n.cast("int").alias("hi"))))
        joins = (F.size(acc["runs"]) > 0) & (F.try_element_at(acc["runs"], F.lit(-1))["hi"] + 1 == n)
        return F.struct(F.when(F.coalesce(joins, F.lit(False)), grown).otherwise(fresh).alias("runs"))

    runs = F.aggregate(numbers, start, step)["runs"]
    return F.array_join(F.transform(runs, lambda r: F.when(r["lo"] == r["hi"], r["lo"].cast("string")).otherwise(F.concat(r["lo"].cast("string"), F.lit(dash), r["hi"].cast("string")))), comma)


def expand_numbers(text: Column, longest: int = 30) -> Column:
    """Numbers of a list with ranges: 10 to 12, 15 as [10, 11, 12, 15]; of a range longer than `longest` the ends only."""
    plain = ascii_digits(text)
    part = r"(\d{1,4}(?:\s*مکرر(?:\s*\d{1,2})?)?)(?:\s*(?:تا|الی|-|–)\s*(\d{1,4}(?:\s*مکرر(?:\s*\d{1,2})?)?))?"
    first, last = F.regexp_extract_all(plain, F.lit(part), F.lit(1)), F.regexp_extract_all(plain, F.lit(part), F.lit(2))

    def numbers(p: Column) -> Column:
        a, b = p["a"].try_cast("int"), p["b"].try_cast("int")
        # sequence() counts down if its end is smaller
        full = F.transform(F.sequence(a, F.when((b > a) & (b - a <= longest), b).otherwise(a)), lambda n: n.cast("string"))
        return F.when((p["b"] == "") | p["b"].isNull(), F.array(p["a"])).when((b > a) & (b - a <= longest), full).otherwise(F.array(p["a"], p["b"]))

    return F.when(plain == "واحده", F.array(plain)).otherwise(F.flatten(F.transform(F.arrays_zip(first.alias("a"), last.alias("b")), numbers)))


def leading_number(text: Column) -> Column:
    return F.regexp_extract(ascii_digits(text), r"^\d+", 0).try_cast("int")


def cache_key(*parts: Column) -> Column:
    """SHA-256 over parts with their lengths, so that no two lists of parts are the same string."""
    joined = F.concat(*[F.concat(F.char_length(p).cast("string"), F.lit(":"), p, F.lit(";")) for p in parts])
    return F.sha2(joined, 256)


def escape_html(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def paragraphs(text: Column) -> Column:
    """Lines that aren't blank."""
    return F.filter(F.transform(F.split(text, "\n", -1), strip), lambda p: p != "")


def html_paragraphs(text: Column) -> Column:
    return F.array_join(F.transform(paragraphs(text), lambda p: F.concat(F.lit("<p>"), escape_html(p), F.lit("</p>"))), "")


def format_article(number: Column, law: Column) -> Column:
    return F.concat_ws(" ", F.nullif(number, F.lit("")), F.nullif(law, F.lit("")))


def percent(done: Column, total: Column) -> Column:
    """0 to 100, as a whole number; 0 of nothing."""
    return F.when(total > 0, F.floor(F.least(F.greatest(done / total, F.lit(0.0)), F.lit(1.0)) * 100 + 0.5)).otherwise(0).cast("int")


def without_fences(answer: Column) -> Column:
    """An answer without the code fence around it."""
    return strip(F.regexp_replace(strip(answer), r"^```[A-Za-z]*\s*|\s*```$", ""))


def corrections(answer: Column) -> Column:
    """Array of (line, wrong, right) from an answer in JSON; an answer that isn't JSON gives none, odd items are dropped."""
    found = F.from_json(without_fences(answer), "struct<corrections:array<struct<line:int,`from`:string,`to`:string>>>")["corrections"]
    named = F.transform(F.coalesce(found, F.array().cast("array<struct<line:int,`from`:string,`to`:string>>")), lambda c: F.struct(c["line"].alias("line"), c["from"].alias("wrong"), c["to"].alias("right")))
    return F.filter(named, lambda c: c["line"].isNotNull() & (F.coalesce(c["wrong"], F.lit("")) != "") & c["right"].isNotNull())
