"""Text functions over every part: a case is chosen by the part's key and holds the part's name where it has braces.

The test tables have no Persian text, so the texts are written here, beside what must become of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as t
from foliant.operators import classify
from foliant.plans.registry import QUERIES, SQL, table

Z = t.ZWNJ


def _literal(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def cases(name: str, apply: Callable[[Column], Column], *pairs: tuple[str, str | None]) -> None:
    """Register a query: p_partkey and result, apply() of the case's text as a string."""
    n = len(pairs)

    def run(spark: SparkSession, d: str) -> DataFrame:
        p = table(spark, d, "part")
        text = F.element_at(F.array(*[F.lit(given) for given, _ in pairs]), (F.col("p_partkey") % n + 1).cast("int"))
        p = p.select("p_partkey", F.replace(text, F.lit("{}"), F.col("p_name")).alias("text"))
        return p.select("p_partkey", apply(F.col("text")).cast("string").alias("result"))

    values = ", ".join(f"({i}, {_literal(want)})" for i, (_, want) in enumerate(pairs))
    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = f"SELECT p_partkey, replace(want, '{{}}', p_name) AS result FROM part JOIN (VALUES {values}) AS c(i, want) ON p_partkey % {n} = i"


def _joined(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda x: F.coalesce(x, F.lit("-"))), "|")


cases(
    "display_forms", t.display_form,
    ("مي روم  كتاب {} ٣٤", f"می{Z}روم کتاب {{}} ۳۴"), ("نمي دانم {}", f"نمی{Z}دانم {{}}"), ("کتـــاب {}", "کتاب {}"), (" {}\n\n  دو ", "{}\nدو"), ("آیا {} کتاب ?", "آیا {} کتاب؟"), (f"خانه{Z} ها {{}}", "خانه ها {}"),
)
cases("persian_digits", t.persian_digits, ("12 {}", "۱۲ {}"), ("٣٤٥ {}", "۳۴۵ {}"), ("{} 0-9", "{} ۰-۹"))
cases("reading_forms", t.reading_form, ("كتابِ ؟", "کتاب"), ("۱۲ - ٣٤", "1234"), (f"می{Z}روم.", "میروم"), ("ABC d", "abcd"), ("مسؤول أمة", "مسوولامه"))
cases("lexicon_keys", t.lexicon_key, ("«كتاب»", "کتاب"), (f"می{Z}روم،", "میروم"), ("(word)", "word"), ("...", ""))
cases("alias_forms", t.alias_form, ("ق.م.ا", "ق م ا"), ("قانون  مدنی", "قانون مدنی"), ("آ.د.م", "ا د م"), ("Civil.Code", "civil code"))
cases("malformed_words", t.is_malformed, ("ماده5", "true"), ("کتاب", "false"), ("1)", "false"), ("aaa", "true"), ("abکتاب", "true"), ("كتاب", "true"), ("قانون.مدنی", "true"), ("...", "false"))
cases("garbage_texts", t.is_garbage, ("{}", "false"), (" ab", "true"), ("éèàùâê", "true"), ("کتاب {}", "false"), ("  ", "false"))
cases("reversed_words", t.reverse_if_arabic, ("باتک", "کتاب"), ("{}", "{}"), ("12", "12"))
cases("glued_markers", lambda x: _joined(t.split_glued_marker(x)), ("الف)کتاب", "الف)|کتاب"), ("12-سوال", "12-|سوال"), ("کتاب", "کتاب"), ("*ب)بله*", "ب)|بله"), ("**", ""))
cases("section_headings", t.is_section_heading, ("فصل اول: {}", "true"), ("بخش: {}", "true"), ("فصل {}", "false"), ("{}", "false"), ("مبحث سوم کلیات: یک دو سه چهار پنج شش هفت هشت نه ده یازده دوازده", "false"))
cases("heading_titles", t.heading_title, ("فصل اول: {}", "{}"), ("بخش: {}.", "{}"), ("{}", "{}"))
cases("stated_keys", t.stated_key, ("گزینه 2 صحیح است {}", "2"), ("پاسخ: ج", "3"), ("{} گزینه الف", "1"), ("{}", None), ("گزینه ۴ درست است", "4"), ("گزینه 1 صحیح نیست. گزینه دو صحیح است", "2"))
cases("inline_key_statements", t.inline_key_statement, ("پاسخ: گزینه 3", "3"), ("گزینه ب صحیح است {}", "2"), ("{} گزینه 2", None), ("جواب صحیح: ۴", "4"))
cases("inner_marker_lists", lambda x: _joined(t.inner_markers(x)), ("1) آری 2) نه", "1|2"), ("بند الف) کتاب", ""), ("{}", ""), ("متن ب) کتاب", "ب"), ("ماده 1) قانون ۳- {}", "3"))
cases("lenient_keys", lambda x: _joined(t.parse_keys_lenient(x)), ("12 3", "1|2|-|3"), ("۱-۴", "1|-|4"), ("1a2", "1|2"), ("x4?", "-|4|-"))
cases("search_forms", t.search_form, ("كتاب ۱۲", "کتاب 12"), ("ABC d", "abc d"), (f"می{Z}روم", "میروم"))
cases("number_lists", lambda x: _joined(t.expand_numbers(x)), ("10 تا 12 و 15", "10|11|12|15"), ("۵، ۷", "5|7"), ("واحده", "واحده"), ("1 تا 99", "1|99"), ("4", "4"))
cases("leading_numbers", t.leading_number, ("۱۲ مکرر", "12"), ("7", "7"), ("{}", None))
cases("key_values", t.key_value, ("الف", "1"), ("چهارم", "4"), ("3", "3"), ("5", None), ("{}", None))
cases("articles_shown", lambda x: t.format_article(F.lit("10"), x), ("{}", "10 {}"), ("", "10"))
cases("fences_removed", t.without_fences, ("```json\n{}\n```", "{}"), ("{}", "{}"), ("``` {}```", "{}"))
cases(
    "correction_lists", lambda x: _joined(F.transform(t.corrections(x), lambda c: F.concat_ws(":", c["line"].cast("string"), c["wrong"], c["right"]))),
    ('{"corrections":[{"line":1,"from":"a","to":"b"},{"line":2,"from":"","to":"c"}]}', "1:a:b"), ("not json", ""), ('```json\n{"corrections":[{"line":3,"from":"x","to":""}]}\n```', "3:x:"), ('{"corrections":[{"from":"x","to":"y"}]}', ""),
)
cases("progress_percent", lambda x: t.percent(F.char_length(x), F.lit(8)), ("1234", "50"), ("", "0"), ("123456789", "100"), ("1", "13"))
cases("heading_keys", classify.heading_key, ("درس حقوق مدنی", "حقوق مدنی"), ("سوالات ۱ تا ۲۰", None), ("حقوق تجارت از ۴۱ تا ۶۰", "حقوق تجارت"), ("", None))
cases(
    "citation_lists", lambda x: _joined(F.transform(classify.citations(x), lambda c: F.concat_ws("/", c["clause"], c["clause_id"], c["kind"], F.array_join(c["numbers"], ",")))),
    ("طبق ماده ۱۰ قانون مدنی", "//ماده/10"), ("بند ۲ ماده 5 و مواد 7 تا 9 {}", "بند/2/ماده/5|//ماده/7,8,9"), ("اصل ۴۰", "//اصل/40"), ("{}", ""),
)
cases("html_of_texts", t.html_paragraphs, ("{}\n\n دو ", "<p>{}</p><p>دو</p>"), ("a<b & 'c'", "<p>a&lt;b &amp; &#x27;c&#x27;</p>"), (" ", ""))
cases("typed_keys", lambda x: F.coalesce(_joined(t.parse_keys(x)), F.lit("none")), ("1 2 3", "1|2|3"), ("الف ب د", "1|2|4"), ("12-4", "1|2|-|4"), ("۱،۲", "1|2"), ("1z", "none"))
