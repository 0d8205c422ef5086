"""Spelling variants: words that differ by one code point, found in wildcard groups without pairs of words.

A word of L code points stands in L groups (position, prefix, suffix): the word with one code point replaced by
a wildcard. Words of a group differ in that place alone, so each is near all others of it, and a group needs
only its size and its two most frequent words to tell every member how many words it is near and which of them
comes first. For insertions and deletions a word's deletions meet the vocabulary: a deletion that is a word is
near the word, and that word is near all words with that deletion, of which again the number and the first are
enough. Both kinds go through one exchange by key; what comes out is added up by word.

A wildcard group has at most as many words as the alphabet has letters, and a deletion's group at most that
many times its places, so no group grows with the input. Counts are summed where the text is read before they
are shuffled, so a word that is a third of all words is one row a task.

Forms point from a word to a near one that is at least twice as frequent: they form trees, whose roots are
found by pointer doubling, in as many rounds as the logarithm of the longest chain.

Nulls: a null text has no runs; a null id is the empty string in what is hashed. Empty texts, empty tables: no
rows. Repeated rows count again. Ties go to the smaller word in code-point order. Keys of over ``LONG`` code
points are digests, so a very long run of letters costs a digest a place, not its square in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.plans.lineage import dropped, kept

from ._rows import named

#: Letters of a run, after A-Z went to lower case.
LETTERS = "a-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WILD = "*"  # not a letter
LONG = 64


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, least: int = 3, every: int | None = 97) -> DataFrame:
    """(word, n): words of at least ``shortest`` code points that occur at least ``least`` times.

    every: runs whose crc32 with their document's id it divides lose a code point (None: no run does)."""
    text = F.translate(named(text_col), UPPER, LOWER)
    runs = F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    d = docs.select(F.coalesce(named(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    if every is None:
        return d.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    d = d.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    d = d.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= shortest)
    return d.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _key(s: Column) -> Column:
    return F.when(F.length(s) > LONG, F.concat(F.lit("#"), F.sha2(s.cast("binary"), 256))).otherwise(s)


def _places(word: Column, instead: str) -> Column:
    """The word with each of its code points replaced in turn."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.lit(instead), F.substring(word, i + 1, F.length(word))))


def near_words(words: DataFrame, shortest: int = 5) -> DataFrame:
    """words (word, n), distinct -> (word, n, n_near, near, near_n): how many words are near, and the first of them."""
    w = F.col("word")
    keys = lambda xs, kind: F.transform(xs, lambda k: F.struct(_key(k).alias("key"), F.lit(kind).alias("kind")))
    less = F.when(F.length(w) > shortest, F.array_distinct(_places(w, ""))).otherwise(F.array().cast("array<string>"))
    d = words.select("word", "n", F.inline(F.concat(keys(_places(w, WILD), "wild"), keys(less, "less"), keys(F.array(w), "own"))))
    # a group: its members by place, then the word itself whose deletions they are, if it is one
    own, me = F.col("kind") == "own", F.struct((-F.col("n")).alias("p"), F.col("word").alias("w"))
    group = Window.partitionBy("key").orderBy(own, "me.p", "me.w").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumn("me", me).select(
        "word", "n", "kind", "me",
        F.count(F.when(~own, 1)).over(group).alias("size"), F.first("me").over(group).alias("first"), F.nth_value("me", 2).over(group).alias("second"),
        F.last(F.when(own, F.col("me"))).over(group).alias("whole"),
    )
    wild = F.col("kind") == "wild"
    d = d.select(
        "word", "n", "kind",
        F.when(wild, F.col("size") - 1).when(own, F.col("size")).otherwise(F.when(F.col("whole").isNotNull(), 1).otherwise(0)).alias("near"),
        F.when(wild, F.when(F.col("first.w") == w, F.col("second")).otherwise(F.col("first"))).when(own, F.when(F.col("size") > 0, F.col("first"))).otherwise(F.col("whole")).alias("best"),
    ).filter((F.col("near") > 0) | own)
    d = d.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return d.select("word", "n", "n_near", F.col("best.w").alias("near"), (-F.col("best.p")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form), one form a word, without circles -> (word, root): where the forms of a word lead."""
    d = kept(forms.select("word", F.col("form").alias("root")))
    while d.select(F.col("root").alias("at")).join(d.select(F.col("word").alias("at")), "at", "left_semi").limit(1).count():
        further = d.select(F.col("word").alias("root"), F.col("root").alias("next"))
        d, old = kept(d.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))), d
        dropped(old)
    return d


def variants(words: DataFrame, shortest: int = 5, times: int = 2) -> DataFrame:
    """words (word, n), distinct -> (word, form, root, n, n_near, form_n).

    form: the near word of largest n, if that is at least ``times`` the word's; times is above 1, so that
    forms have no circles."""
    if times <= 1:
        raise ValueError("times must be above 1")
    near = near_words(words, shortest)
    enough = F.col("near_n") >= times * F.col("n")
    d = kept(near.select("word", F.when(enough, F.col("near")).alias("form"), "n", "n_near", F.when(enough, F.col("near_n")).alias("form_n")))
    ends = roots(d.filter("form is not null").select("word", "form"))
    return d.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = 97) -> DataFrame:
    """The spelling variants among the words of documents."""
    return variants(kept(vocabulary(docs, id_col, text_col, every=every)))
