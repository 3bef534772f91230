"""Normal forms, statements of keys, markers, numbers: given strings and what they become."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.functions import pytext
from foliant.functions import text as t

Z = t.ZWNJ


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("r"))
    return [r.r for r in df.orderBy("i").collect()]


DISPLAY = {
    "كتاب علي ٣٤ صفحه": "کتاب علی ۳۴ صفحه", "موسى": "موسی", "قانــــون مدنـی": "قانون مدنی", "۱ـ متن": "۱ـ متن", f"کتاب{Z}{Z}ها": f"کتاب{Z}ها", f"خانه {Z}ای": "خانه ای", f"{Z}سلام{Z}": "سلام",
    "حق​وق﻿": "حقوق", "حکم صادر می شود و نمی توان": f"حکم صادر می{Z}شود و نمی{Z}توان", "کمی دیر": "کمی دیر", "کدام صحیح است ?": "کدام صحیح است؟", "What ?": "What ?", "الف ، ب": "الف، ب",
    "  الف \t  ب  ": "الف ب", "بند اول\n\n  بند دوم": "بند اول\nبند دوم", "": "",
}


def test_display_form(spark):
    assert apply(spark, t.display_form, list(DISPLAY)) == list(DISPLAY.values())
    assert [pytext.display(x) for x in DISPLAY] == list(DISPLAY.values())
    assert apply(spark, lambda c: t.display_form(c, compose=True), ["ﻻ", None]) == ["لا", None]


def test_comparison_form(spark):
    pairs = ["آئین دادرسیِ مدنی", "آيين دادرسي مدني", "سؤال ۱۲:", f"پاسخ{Z}نامه", "A_b  C-d"]
    out = apply(spark, t.comparison_form, pairs)
    assert out[0] == out[1] and out[2:] == ["سوال 12", "پاسخنامه", "a b c d"]
    assert [pytext.comparison(x) for x in pairs] == out
    assert apply(spark, t.plain_comparison_form, ["A_b  C-d"]) == ["a b c d"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ابپتيكی۱۲٣ \n‌ـ؟?،.abcXY_-", max_size=40))
def test_forms_are_stable(text):
    once = pytext.display(text)
    assert pytext.comparison(pytext.comparison(text)) == pytext.comparison(text) == pytext.comparison(once)


def test_digits(spark):
    assert apply(spark, t.ascii_digits, ["۱۲-٣"]) == ["12-3"]
    assert apply(spark, t.persian_digits, ["12 و ٣"]) == ["۱۲ و ۳"]


STATED = {"گزینه ۳ صحیح است": "3", "پاسخ: ۲ — طبق ماده ۱۰": "2", "جواب صحیح گزینه «ج» است": "3", "پاسخ صحیح گزینه چهارم است": "4", f"گزینه{Z}ی ۱ درست است": "1", "طبق ماده ۱۲ قانون مدنی": None}
INLINE = {f"گزینه{Z}ی «د» درست است. تعریف تاجر": "4", "گزینه «ب» صحیح است": "2", "پاسخ: گزینه ۴": "4", "جواب: ج": "3", f"گزینه{Z}ی «الف» به این دلیل نادرست است": None, "گزینه «ب» درست نیست": None, "طبق ماده ۲ گزینه ۳ درست است": None}


def test_keys_in_explanations(spark):
    assert apply(spark, t.stated_key, list(STATED)) == list(STATED.values()) == [pytext.stated_key(x) for x in STATED]
    assert apply(spark, t.inline_key_statement, list(INLINE)) == list(INLINE.values()) == [pytext.inline_key(x) for x in INLINE]


def test_parse_keys(spark):
    out = apply(spark, t.parse_keys, ["۲۴۱۳ ۳۱-۲", "الف ب - د", "12z", "1، 2"])
    assert out == [["2", "4", "1", "3", "3", "1", None, "2"], ["1", "2", None, "4"], None, ["1", "2"]]
    assert apply(spark, t.parse_keys_lenient, ["12 z3"]) == [["1", "2", None, "3"]]


def test_malformed_and_markers(spark):
    words = ["کتاب", "کتاب۲", "مت.ن", "كتاب", "abcفارسی", "ااا", "۱)", "الف-", ""]
    assert apply(spark, t.is_malformed, words) == [False, True, True, True, True, True, False, False, False]
    assert apply(spark, t.split_glued_marker, ["۱)متن", "متن", "**"]) == [["۱)", "متن"], ["متن"], []]
    assert apply(spark, t.inner_markers, ["متن ۱) الف ۲) ب", "ماده ۱- متن", "ساده"]) == [["1", "2"], [], []]


def test_numbers(spark):
    assert apply(spark, t.expand_numbers, ["۱۰ تا ۱۲", "۱۰ و ۱۱", "۱ تا ۹۹", "واحده", "۱۰ مکرر"]) == [["10", "11", "12"], ["10", "11"], ["1", "99"], ["واحده"], ["10 مکرر"]]
    assert apply(spark, t.compact_runs, [[1, 2, 3, 7], [5], []], "array<int>") == ["1–3، 7", "5", ""]
    assert apply(spark, t.leading_number, ["۱۲ مکرر", "x"]) == [12, None]


def test_html_and_clip(spark):
    assert apply(spark, t.html_paragraphs, ["a & <b>\n\n 'c' "]) == ["<p>a &amp; &lt;b&gt;</p><p>&#x27;c&#x27;</p>"]
    assert apply(spark, lambda c: t.clip(c, 5), ["ab  cd", "abcdefg"]) == ["ab cd", "abcd…"]


def test_corrections(spark):
    good = '```json\n{"corrections": [{"line": 1, "from": "a", "to": "b"}, {"line": null, "from": "x", "to": "y"}, {"line": 2, "from": "", "to": "y"}]}\n```'
    assert [[tuple(c) for c in r] for r in apply(spark, t.corrections, [good, "no json"])] == [[(1, "a", "b")], []]


def test_garbage(spark):
    assert apply(spark, t.is_garbage, ["plain text", " x", "سلام دنیا", "ÃÂÃÂÃ ÃÂ", ""]) == [False, True, False, True, False]


@pytest.mark.parametrize(("text", "kind"), [("فصل نخست: تعریف تاجر", True), ("متن ساده", False)])
def test_headings(spark, text, kind):
    assert apply(spark, t.is_section_heading, [text]) == [kind]
    if kind:
        assert apply(spark, t.heading_title, [text]) == ["تعریف تاجر"]
