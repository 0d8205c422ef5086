"""Text functions as columns. Strings are treated as Python does: white space is Unicode's and
U+001C..U+001F, lengths are code points."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's str.split and str.strip know it.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Java looks single Latin characters of a class up in a table, and asks one range after the other; a class that asks
# first whether a character is Latin at all is several times as fast on Latin texts.
_LATIN_RARE = r"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"
_WIDE = r"[[^\x00-\xff]&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
WS = rf"[\x20{_LATIN_RARE}{_WIDE}]"

#: Fixed values.
CJK_LANGUAGES = ("zh", "ja", "ko")
CJK = r"\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}"
PLACEHOLDER = r"\{[A-Za-z0-9_.]{1,50}\}|%\([\w]+\)[sdfgxX]|%[sdfgxX]"
URL = r"(?i)https?://[^\s\x1c-\x1f]+"
URL_TAIL = ".,;:!?)'\"、。，；：！？）"
PAIRS = ("()", "（）", "[]", "{}", "《》", "「」", "『』", "【】", "“”", "‘’")
WIDTHS = (("!", "！"), ("?", "？"), (":", "："), (";", "；"), ("(", "（"), (")", "）"))
MONTHS = {"January": 1, "February": 2, "March": 3, "April": 4, "June": 6, "July": 7, "August": 8, "September": 9, "October": 10, "November": 11, "December": 12, "Jan": 1, "Feb": 2, "Mar": 3, "Apr": 4, "Jun": 6, "Jul": 7, "Aug": 8, "Sept": 9, "Sep": 9, "Oct": 10, "Nov": 11, "Dec": 12}
MAGNITUDES = {"thousand": 10**3, "million": 10**6, "billion": 10**9, "bn": 10**9, "trillion": 10**12, "trn": 10**12, "万亿": 10**12, "万": 10**4, "亿": 10**8}


def py_strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def nolen(c: Column) -> Column:
    """Length without white space: the space is counted apart, as nearly all white space is."""
    return F.length(F.replace(c, F.lit(" "), F.lit(""))) - F.regexp_count(c, F.lit(rf"[{_LATIN_RARE}{_WIDE}]"))


def is_cjk_lang(c: Column) -> Column:
    return F.lower(F.split_part(F.coalesce(c, F.lit("")), F.lit("-"), F.lit(1))).isin(*CJK_LANGUAGES)


def looks_cjk(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(f"[{CJK}]")) / F.nullif(nolen(c), F.lit(0)) > 0.3, F.lit(False))


def word_count(text: Column, lang: Column) -> Column:
    words = F.size(F.filter(F.split(text, rf"{WS}+"), lambda x: x != ""))
    return F.when(is_cjk_lang(lang), nolen(text)).otherwise(words).cast("long")


def band_of(pct: Column) -> Column:
    return F.when(pct >= 100, "exact").when(pct >= 95, "95-99").when(pct >= 85, "85-94").when(pct >= 75, "75-84").when(pct >= 50, "50-74").otherwise("no_match")


def placeholders(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?U){PLACEHOLDER}"), F.lit(0))))


def urls(c: Column) -> Column:
    tail = F.lit(URL_TAIL)
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(f"(?U){URL}"), F.lit(0)), lambda x: F.rtrim(x, tail))))


def tag_names(markup: Column) -> Column:
    """The multiset of tag names, sorted; '?' for a tag without a name."""
    name = lambda x: F.regexp_extract(x["content"], r"(?U)<\s*([a-zA-Z][\w:-]*)", 1)
    tags = F.filter(F.coalesce(markup, F.array().cast("array<struct<kind:string,content:string>>")), lambda x: x["kind"] == "tag")
    return F.array_sort(F.transform(tags, lambda x: F.when(name(x) == "", "?").otherwise(name(x))))


def unbalanced(c: Column) -> Column:
    """Pairs whose members differ in number; a surplus of ’ is an apostrophe's."""
    wide = "".join(x for x in "".join(PAIRS) if ord(x) > 255)
    some = c.rlike(rf"[()\[\]{{}}[[^\x00-\xff]&&[{wide}]]]")  # most texts have none
    n = lambda p, i: F.length(c) - F.length(F.replace(c, F.substring(p, i, 1), F.lit("")))
    bad = F.filter(F.array(*map(F.lit, PAIRS)), lambda p: F.when(p == "‘’", n(p, 1) > n(p, 2)).otherwise(n(p, 1) != n(p, 2)))
    return F.when(some, bad).otherwise(F.array().cast("array<string>"))


def width_mixed(c: Column) -> Column:
    """Punctuation present in half and in full width."""
    return F.filter(F.array(*(F.when(F.contains(c, F.lit(a)) & F.contains(c, F.lit(b)), F.lit(a)) for a, b in WIDTHS)), lambda x: x.isNotNull())


def edge_space(c: Column) -> Column:
    return py_strip(c) != c


def year_of(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, r"^(\d{4})", 1), F.lit("")), F.lit("unknown"))


def base_name(c: Column) -> Column:
    return F.element_at(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), -1)


# What Catalyst has no expression for: normal forms, case folding, arithmetic inside replacements.


# Python gets only the rows that need it: the others are null to it, and what it gives for them is null too. So
# a coalesce puts both ways together; CASE with the same test once more is three times as slow (generated code).


@F.pandas_udf(T.StringType())
def _squeezed(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else squeeze(t))


@F.pandas_udf(T.StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else fold(t))


def _plain_squeezed(c: Column) -> Column:
    """Of texts below U+0300; most have nothing to squeeze."""
    some = c.rlike(rf"[{_LATIN_RARE}]|  |^ | $")
    return F.when(some, F.trim(F.regexp_replace(c, rf"{WS}+", " "))).otherwise(c)


def nfc_squeezed(c: Column | str) -> Column:
    """In normal form C, each run of white space as one space. Below U+0300 every text is in that form."""
    c = F.col(c) if isinstance(c, str) else c
    other = c.rlike(r"[^\x00-\x{2FF}]")
    return F.coalesce(_squeezed(F.when(other, c)), _plain_squeezed(c))


def folded(c: Column | str) -> Column:
    """nfc_squeezed and case folded, which in Latin-1 is lower case but for two characters."""
    c = F.col(c) if isinstance(c, str) else c
    other = c.rlike(r"[^\x00-\xFF]")
    plain = F.replace(F.replace(F.lower(_plain_squeezed(c)), F.lit("ß"), F.lit("ss")), F.lit("µ"), F.lit("μ"))
    return F.coalesce(_folded(F.when(other, c)), plain)


def squeeze(t: str) -> str:
    return " ".join(unicodedata.normalize("NFC", t).split())


def fold(t: str) -> str:
    return squeeze(t).casefold()


# The patterns of numbers.
_MONTH = re.compile(r"\b(" + "|".join(sorted(MONTHS, key=len, reverse=True)) + r")\.?\b")
_MAGNITUDE = re.compile(r"(\d+(?:\.\d+)?)\s*(" + "|".join(m + r"\b" * m.isascii() for m in MAGNITUDES) + ")", re.I)
_CURRENCY = re.compile(r"(?:\b(?:USD|EUR|CNY|RMB|GBP|JPY)\b|[$€¥£])\s*", re.I)
_THOUSANDS = re.compile(r"(?<=\d)[,，](?=\d{3}(?:\D|$))")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)?")


def numbers(text: str) -> list[str]:
    """The distinct numbers of a text in one notation, sorted."""

    def larger(m: re.Match) -> str:
        v = float(m[1]) * MAGNITUDES[m[2].lower()]
        return f" {int(v) if v == int(v) else v} "

    t = _MAGNITUDE.sub(larger, _MONTH.sub(lambda m: f" {MONTHS[m[1]]} ", text))
    t = re.sub(r"(\d),(\d)", r"\1.\2", _THOUSANDS.sub("", _CURRENCY.sub("", t)))
    plain = lambda x: (x.rstrip("0").rstrip(".") if "." in x else x)
    return sorted({plain(x) for x in _NUMBER.findall(t)})


@F.pandas_udf(T.ArrayType(T.StringType()))
def number_set(s: pd.Series) -> pd.Series:
    return s.map(lambda t: numbers(t) if t else [])


def number_set_of(c: Column) -> Column:
    """number_set, without Python for texts that have neither a digit nor a month."""
    short = [m for m in MONTHS if len(m) == 3]
    some = c.rlike(r"\p{Nd}|(?=[" + "".join(sorted({m[0] for m in short})) + "])(?:" + "|".join(short) + ")")
    return number_set(F.when(some, c))  # none for the others


def fnv1a64_of(t: str | None) -> int | None:
    """The signed 64-bit FNV-1a hash of a text's UTF-8 bytes."""
    if t is None:
        return None
    h = 0xCBF29CE484222325
    for b in t.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h - (1 << 64) if h >> 63 else h


@F.pandas_udf(T.LongType())
def fnv1a64(s: pd.Series) -> pd.Series:
    """The signed 64-bit FNV-1a hash of the UTF-8 bytes."""
    return s.map(fnv1a64_of)


@lru_cache(maxsize=65536)
def bounded(term: str, ignore_case: bool = False) -> re.Pattern:
    """A term as a whole word: edges that are word characters must not go on."""
    left = r"(?<!\w)" if re.match(r"\w", term) else ""
    right = r"(?!\w)" if re.search(r"\w\Z", term) else ""
    return re.compile(left + re.escape(term) + right, re.I if ignore_case else 0)


def is_cjk(lang: str | None) -> bool:
    return (lang or "").split("-")[0].lower() in CJK_LANGUAGES


_SPANS = {
    "PLACEHOLDER_MISMATCH": re.compile(PLACEHOLDER),
    "URL_MISMATCH": re.compile(r"https?://\S+", re.I),
    "PUNCTUATION_UNBALANCED": re.compile("[" + re.escape("".join(PAIRS)) + "]"),
    "WIDTH_MIXING": re.compile("[" + re.escape("".join(map("".join, WIDTHS))) + "]"),
    "LEADING_TRAILING_SPACE": re.compile(r"\A\s+|\s+\Z"),
}


def issue_spans(text: str, issues: list[str]) -> list[tuple[int, int]]:
    """Merged (start, end) spans of what a row's issues are about."""
    found: list[tuple[int, int]] = []
    for code in issues:
        if code == "NUMBER_MISMATCH":
            taken = [m.span() for p in (_MAGNITUDE, _MONTH) for m in p.finditer(text)]
            found += taken + [m.span() for m in _NUMBER.finditer(text) if not any(a <= m.start() < b for a, b in taken)]
        elif code == "PUNCTUATION_UNBALANCED":
            bad = "".join(p for p in PAIRS if (text.count(p[0]) > text.count(p[1]) if p == "‘’" else text.count(p[0]) != text.count(p[1])))
            found += [m.span() for m in _SPANS[code].finditer(text) if m[0] in bad]
        elif code == "WIDTH_MIXING":
            bad = "".join(a + b for a, b in WIDTHS if a in text and b in text)
            found += [m.span() for m in _SPANS[code].finditer(text) if m[0] in bad]
        elif code == "URL_MISMATCH":
            found += [(m.start(), m.start() + len(m[0].rstrip(URL_TAIL))) for m in _SPANS[code].finditer(text)]
        elif code in _SPANS:
            found += [m.span() for m in _SPANS[code].finditer(text)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(x for x in found if x[1] > x[0]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def highlight_spans(text: pd.Series, issues: pd.Series) -> pd.Series:
    return pd.Series([[{"start": a, "end": b} for a, b in issue_spans(t or "", list(i) if i is not None else [])] for t, i in zip(text, issues)])
