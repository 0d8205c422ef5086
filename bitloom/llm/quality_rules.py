"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

A rule bounds a ratio of two counts of a document (or one count, over 1) from below, from above or both. The
counts are arrays and strings worked on where they are: words by splitting, repeats by sorting a document's
own three-word windows, so that a document is judged by itself, in the task that reads it, without a shuffle
and without user functions. Ratios are compared as products of whole numbers, so no rounding decides.

The base rules (too few words, too many repeated words) go first and name the documents that fail whatever
the table says; ``kept`` is the table's verdict on the rest.

Nulls: a null text has no words and fails the base rules; a null id stays null. Empty and blank texts count 0
throughout. Repeated rows are judged each; an empty table gives no rows; other columns don't matter,
whatever they are called. A very long text is one row's arrays: memory and time grow with the words of the
longest text (n log n for its repeats).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._rows import named

#: White space between words, and symbols.
SPACE, SOLID = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"

LAST = (1 << 31) - 1  # places; a text has fewer words

#: Frequent words of the corpus's languages; prose has them, lists and noise don't. They count in lower case, in
#: capitals and with a capital first.
STOP_WORDS = {
    "en": "the of and to a in is that for it was on with be as by this are at from or an not which have",
    "de": "der die und in den von zu das sich mit auf des für ist nicht im dem ein eine als auch es an aus",
    "fr": "de la le et les des en un du une que pour est qui dans par pas au sur avec ce il ne plus",
    "es": "de la que el en y los se del las por un no con su una es para al lo como más pero sus",
}


@dataclass(frozen=True)
class Rule:
    """least <= 100 * part / whole <= most, in percent; a document whose whole is 0 has a ratio of 0."""

    name: str
    part: str
    whole: str | None = None
    least: int | None = None
    most: int | None = None


#: Percentages; without whole, plain numbers.
RULES = (
    Rule("length", "n_words", None, 50, 1_000_000),
    Rule("word_length", "word_chars", "n_words", 200, 1200),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop_words", "n_words", 2, 90),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 40),
)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, not wherever f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def words(text: Column) -> Column:
    """Runs of characters that aren't white space, in order."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def repeated_words(w: Column, size: int = 3) -> Column:
    """How many words stand in a window of ``size`` words that the text has twice or more.

    33 bits of the hashes of a window's words, and its place, make a long that sorts fast. Windows whose bits
    meet no other can't be repeated; the rest, few in prose, are compared word for word."""

    def suspects(h: Column) -> Column:
        runs = F.arrays_zip(*(F.slice(h, k + 1, F.size(h) - size + 1).alias(f"h{k}") for k in range(size)))
        bits = lambda x: reduce(lambda a, b: a.bitwiseXOR(b), (F.shiftleft(x[f"h{k}"], 31 + 7 * k) for k in range(size)))
        packed = F.sort_array(F.transform(runs, lambda x, i: bits(x).bitwiseOR(i.cast("long"))))
        met = bound(packed, lambda s: F.filter(F.arrays_zip(s.alias("a"), F.slice(s, 2, F.size(s)).alias("b")), lambda p: F.shiftright(p["a"].bitwiseXOR(p["b"]), 31) == 0))
        return F.array_distinct(F.flatten(F.transform(met, lambda p: F.array(*(p[k].bitwiseAND(LAST).cast("int") for k in ("a", "b"))))))

    def window(i: Column) -> Column:
        return F.concat_ws(" ", *(F.get(w, i + k) for k in range(size)))

    def twins(s: Column) -> Column:
        return F.filter(s, lambda x, i: (x["g"] == F.get(s, i - 1)["g"]) | (x["g"] == F.get(s, i + 1)["g"]))

    def union(starts: Column) -> Column:
        return F.aggregate(F.transform(starts, lambda p, i: F.coalesce(F.least(F.get(starts, i + 1) - p, F.lit(size)), F.lit(size))), F.lit(0), lambda a, b: a + b)

    at = bound(F.transform(w, lambda x: F.xxhash64(x)), suspects)
    placed = F.sort_array(F.transform(at, lambda i: F.struct(window(i).alias("g"), i.alias("i"))))
    covered = bound(placed, lambda s: bound(F.sort_array(F.transform(twins(s), lambda x: x["i"])), union))
    return F.when(F.size(w) > size, covered).otherwise(F.lit(0)).cast("long")


def forms_of_stop_words(stop_words: Iterable[str] | None = None) -> list[str]:
    chosen = stop_words if stop_words is not None else " ".join(STOP_WORDS.values()).split()
    return sorted({f(x) for x in chosen for f in (str.lower, str.capitalize, str.upper)})


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop_words: Iterable[str] | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words)."""
    stops = forms_of_stop_words(stop_words)
    t = docs.select(named(id_col).alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("t"))
    d = t.select("doc_id", "t", words(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(SOLID)).alias("lines"))
    long = lambda c: c.cast("long")
    return d.select(
        "doc_id",
        long(F.size("w")).alias("n_words"),
        long(F.length(F.array_join("w", ""))).alias("word_chars"),
        long(F.regexp_count("t", F.lit(SYMBOLS))).alias("n_symbols"),
        long(F.size("lines")).alias("n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        long(F.size(F.filter("w", lambda x: x.isin(*stops)))).alias("n_stop_words"),
    )


def failed(rule: Rule) -> Column:
    """Whether a document breaks a rule."""
    part, whole = F.col(rule.part), F.col(rule.whole) if rule.whole else None
    scaled, unit = (100 * part, whole) if rule.whole else (part, F.lit(1))
    low = scaled < rule.least * unit if rule.least is not None else F.lit(False)
    return low | (scaled > rule.most * unit) if rule.most is not None else low


def judge(docs: DataFrame, rules: Iterable[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", stop_words: Iterable[str] | None = None) -> DataFrame:
    """The counts of each document with base_failed, kept and the names of the rules that it breaks."""
    rules = tuple(rules)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    broken = F.array_compact(F.array(*(F.when(failed(r), F.lit(r.name)) for r in rules), F.lit(None).cast("string")))
    d = counts(docs, id_col, text_col, stop_words).select("*", base.alias("base_failed"), F.array_join(broken, ",").alias("broken"))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("broken") == ""))
