"""Tokenisers for the two kinds of index, as columns and as their Python twins for queries.

Section text keeps ``-`` inside words, folds case and diacritics and is stemmed; chunk text splits at
every other character than letters and digits and is only folded.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROSE, CODE = r"[\p{L}\p{N}-]+", r"[\p{L}\p{N}]+"


def plain_tokens(text: Column, pattern: str = PROSE) -> Column:
    """Lower-cased tokens, without stems or folded diacritics: built-in functions alone."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), 0)


def fold(text: str) -> str:
    """Lower case without diacritics."""
    text = text.lower()
    return text if text.isascii() else _marks().sub("", unicodedata.normalize("NFD", text))


@functools.cache
def _marks() -> re.Pattern[str]:
    """Nonspacing marks."""
    return re.compile("[" + "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Mn") + "]+")


@functools.lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Porter's stem of an ASCII word; other words are kept."""
    if len(word) <= 2 or not word.isascii():
        return word
    word = _plural(word)
    word = _past(word)
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for suffixes in (_DOUBLE, _SINGLE):
        for suffix, short in suffixes:
            if word.endswith(suffix):
                if _measure(word[: -len(suffix)]) > 0:
                    word = word[: -len(suffix)] + short
                break
    for suffix in _RESIDUAL:
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short_end(base)):
            word = base
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


#: The suffix tables of Porter's algorithm, the longest of each ending first.
_DOUBLE = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
_SINGLE = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_RESIDUAL = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _consonants(word: str) -> str:
    """``c`` or ``v`` for every letter; a y after a consonant is a vowel."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out.endswith("c")) else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _consonants(word)))


def _has_vowel(word: str) -> bool:
    return "v" in _consonants(word)


def _short_end(word: str) -> bool:
    return _consonants(word).endswith("cvc") and word[-1] not in "wxy"


def _plural(word: str) -> str:
    if word.endswith("sses") or word.endswith("ies"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix) and _has_vowel(word[: -len(suffix)]):
            base = word[: -len(suffix)]
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if len(base) > 1 and base[-1] == base[-2] and _consonants(base)[-1] == "c" and base[-1] not in "lsz":
                return base[:-1]
            return base + "e" if _measure(base) == 1 and _short_end(base) else base
    return word


_PROSE_RE, _CODE_RE = re.compile(r"[\w-]+"), re.compile(r"[^\W_]+")


def prose_words(text: str) -> list[str]:
    """The folded words of prose, of which ``stem`` makes tokens."""
    return _PROSE_RE.findall(fold(text).replace("_", " "))


def prose_tokens(text: str) -> list[str]:
    return [stem(x) for x in prose_words(text)]


def code_tokens(text: str) -> list[str]:
    return _CODE_RE.findall(fold(text))


@F.arrow_udf(T.ArrayType(T.StringType()))
def prose_token_column(text: pa.Array) -> pa.Array:
    return pa.array([prose_tokens(x or "") for x in text.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(T.ArrayType(T.StringType()))
def code_token_column(text: pa.Array) -> pa.Array:
    return pa.array([code_tokens(x or "") for x in text.to_pylist()], pa.list_(pa.string()))
