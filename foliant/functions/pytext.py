"""The display and comparison forms for code that runs in Python anyway; patterns are those of text.py."""

from __future__ import annotations

import re
import unicodedata

from foliant.functions import text as t

_PASSES = [(re.compile(p.replace(t.WORD, r"\w")), r.replace("$1", r"\1")) for p, r in t._DISPLAY]
_LETTERS = str.maketrans("يىك" + t.ARABIC_DIGITS, "ییک" + t.PERSIAN_DIGITS)
_ASCII = str.maketrans(t.PERSIAN_DIGITS + t.ARABIC_DIGITS, t.ASCII_DIGITS * 2)
_FOLD = str.maketrans("أإآٱؤئةۀ", "ااااویهه", t.ZWNJ)
_MARKS, _REST = re.compile(f"[{t.DIACRITICS}ـ]"), re.compile(r"[\W_]+")
_MARK_FREE = [re.compile(p.replace(r"\p{L}\p{N}_", r"\w")) for p in t.INLINE]
_STRONG, _WEAK = ([re.compile(p.replace(r"\p{L}\p{N}_", r"\w")) for p in ps] for ps in (t.STRONG, t.WEAK))


def display(text: str) -> str:
    out = unicodedata.normalize("NFKC", text).translate(_LETTERS)
    for pattern, replacement in _PASSES:
        out = pattern.sub(replacement, out)
    return out.strip()


def ascii_digits(text: str) -> str:
    return text.translate(_ASCII)


def comparison(text: str) -> str:
    return _REST.sub(" ", _MARKS.sub("", ascii_digits(display(text)).translate(_FOLD))).strip().lower()


def reading(text: str) -> str:
    return comparison(text).replace(" ", "")


def _key(word: str) -> str:
    return t.KEY_WORDS.get(word, word)


def inline_key(line: str) -> str | None:
    plain = ascii_digits(display(line))
    return next((_key(m[1]) for p in _MARK_FREE if (m := p.match(plain))), None)


def stated_key(text: str, window: int = 200) -> str | None:
    plain = ascii_digits(display(text))
    found = [m for p in _STRONG if (m := p.search(plain))] or [m for p in _WEAK if (m := p.search(plain[:window]))]
    return _key(min(found, key=lambda m: m.start())[1]) if found else None
