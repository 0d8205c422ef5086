"""Quality checks of translation units: twelve predicates, what differs, a confidence, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.functions import text as X
from bitloom.schema import ISSUES


def length_ratio(units: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each value of within: length_ratio, source characters per target character
    without white space (1 if empty)."""
    s, t = F.sum(X.nolen(F.col("src_text"))), F.sum(X.nolen(F.col("tgt_text")))
    return units.groupBy(*within).agg(F.coalesce(s / F.greatest(t, F.lit(1)), F.lit(1.0)).alias("length_ratio"))


def _digests(tag: int, *of: Column) -> list[Column]:
    """Two digests that stand for texts; a null isn't an empty text."""
    known = [x for c in of for x in (c.isNull(), c)]
    return [F.xxhash64(F.lit(tag), *known), F.xxhash64(*known, F.lit(tag))]


def _conflicts(units: DataFrame, within: tuple[str, ...]) -> DataFrame:
    """(_p1, _p2, _sc, _tc) of the pairs of texts whose source stands beside several targets, or the other way.

    Different pairs are told and counted by digests, so that rows are a few numbers; a very common text is as
    many rows as it has partners. Blank texts take no part."""
    s, t, own = F.col("_s"), F.col("_t"), [F.col(w) for w in within]
    keys = {f"_{k}{i}": h for k, tag, of in (("p", 0, (s, t)), ("s", 1, (s,)), ("t", 2, (t,))) for i, h in enumerate(_digests(tag, *own, *of), 1)}
    pairs = units.filter((s != "") & (t != "")).select(*(h.alias(k) for k, h in keys.items())).distinct()
    several = lambda k: pairs.groupBy(f"_{k}1", f"_{k}2").count().filter("count > 1").select(f"_{k}1", f"_{k}2", F.lit(True).alias(f"_{k}c"))
    marked = pairs.join(several("s"), ["_s1", "_s2"], "left").join(several("t"), ["_t1", "_t2"], "left")
    return marked.filter("_sc or _tc").select("_p1", "_p2", F.coalesce("_sc", F.lit(False)).alias("_sc"), F.coalesce("_tc", F.lit(False)).alias("_tc"))


_SIDES = "struct<src:array<string>,tgt:array<string>>"


def check(units: DataFrame, ratio: float | None = None, numbers: bool = True, codes: tuple[str, ...] = ISSUES, details: bool = False, within: tuple[str, ...] = ()) -> DataFrame:
    """Adds qa_issues (array in ISSUES order), qa_confidence and, with details, qa_details: for each check
    that tells more, what differs on the two sides (null where it found nothing).

    ratio: expected source to target length; None takes the corpus's own. codes: the checks to run; only
    what they need is worked out. numbers: False leaves out the one check that runs Python. within: columns,
    e.g. the file, whose values are corpora of their own: conflicts and the ratio don't reach over them."""
    codes = tuple(c for c in ISSUES if c in codes and (numbers or c != "NUMBER_MISMATCH"))
    if ratio is not None or "LENGTH_RATIO_OUTLIER" not in codes:
        units = units.withColumn("_ratio", F.lit(float(ratio or 1.0)))
    elif within:
        each = length_ratio(units, within).select(*(F.col(w).alias(f"_k{i}") for i, w in enumerate(within)), F.col("length_ratio").alias("_ratio"))
        units = units.join(each, [F.col(w).eqNullSafe(F.col(f"_k{i}")) for i, w in enumerate(within)]).drop(*(f"_k{i}" for i in range(len(within))))
    else:
        units = units.crossJoin(F.broadcast(length_ratio(units).withColumnRenamed("length_ratio", "_ratio")))  # one row
    raw_s, raw_t = F.coalesce(F.col("src_text"), F.lit("")), F.coalesce(F.col("tgt_text"), F.lit(""))
    d = units.withColumn("_s", X.py_strip(raw_s)).withColumn("_t", X.py_strip(raw_t))
    s, t = F.col("_s"), F.col("_t")
    conflicts = [c for c in codes if c in ("SOURCE_CONFLICT", "TARGET_CONFLICT")]
    pairs = _conflicts(d, within) if conflicts else None
    both = (s != "") & (t != "")
    told = {"PLACEHOLDER_MISMATCH": X.placeholders, "URL_MISMATCH": X.urls, "PUNCTUATION_UNBALANCED": X.unbalanced, "WIDTH_MIXING": X.width_mixed}
    for c, find in told.items():
        if c in codes:
            d = d.withColumn(f"_{c}", F.when(both, F.struct(find(s).alias("src"), find(t).alias("tgt"))))
    if "NUMBER_MISMATCH" in codes:
        d = d.withColumn("_NUMBER_MISMATCH", F.when(both, F.struct(X.number_set_of(s).alias("src"), X.number_set_of(t).alias("tgt"))))
    differs = lambda c: F.coalesce(F.col(f"_{c}.src") != F.col(f"_{c}.tgt"), F.lit(False))
    some = lambda c: F.coalesce((F.size(f"_{c}.src") > 0) | (F.size(f"_{c}.tgt") > 0), F.lit(False))
    if "LENGTH_RATIO_OUTLIER" in codes:
        d = d.withColumn("_relative", F.when(both & (F.col("_ratio") > 0), X.nolen(t) / F.greatest(X.nolen(s) / F.col("_ratio"), F.lit(1e-6))))
    relative = F.col("_relative")
    markup = "src_markup" in units.columns and "tgt_markup" in units.columns
    found = {
        "EMPTY_SOURCE": lambda: s == "",
        "EMPTY_TARGET": lambda: t == "",
        "LEADING_TRAILING_SPACE": lambda: X.edge_space(raw_s) | X.edge_space(raw_t),
        "LENGTH_RATIO_OUTLIER": lambda: both & (F.col("_ratio") > 0) & ((relative < 0.3) | (relative > 3.0)),
        "NUMBER_MISMATCH": lambda: differs("NUMBER_MISMATCH"),
        "PLACEHOLDER_MISMATCH": lambda: differs("PLACEHOLDER_MISMATCH"),
        "URL_MISMATCH": lambda: differs("URL_MISMATCH"),
        "TAG_MISMATCH": lambda: (both & (X.tag_names(F.col("src_markup")) != X.tag_names(F.col("tgt_markup")))) if markup else F.lit(False),
        "PUNCTUATION_UNBALANCED": lambda: some("PUNCTUATION_UNBALANCED"),
        "WIDTH_MIXING": lambda: some("WIDTH_MIXING"),
        "SOURCE_CONFLICT": lambda: F.col("_sc"),
        "TARGET_CONFLICT": lambda: F.col("_tc"),
    }
    some_of = lambda cs: F.filter(F.array(*(F.when(found[c](), F.lit(c)) for c in cs)), lambda x: x.isNotNull()) if cs else F.array().cast("array<string>")
    if conflicts:  # the last ones in order; before the join all else is known, so that it takes along only what is asked for
        p = dict(zip(("_p1", "_p2"), _digests(0, *(F.col(w) for w in within), s, t)))
        d = d.withColumns({"_found": some_of([c for c in codes if c not in conflicts])} | p).join(pairs, ["_p1", "_p2"], "left").drop("_p1", "_p2")
        issues = F.concat("_found", some_of(conflicts))
    else:
        issues = some_of(codes)
    d = d.withColumn("qa_issues", issues).withColumn("qa_confidence", F.greatest(F.lit(0.0), 1 - 0.25 * F.size("qa_issues")))
    if details:
        edge = F.filter(F.array(F.when(X.edge_space(raw_s), F.lit("src")), F.when(X.edge_space(raw_t), F.lit("tgt"))), lambda x: x.isNotNull())
        sides = F.when(F.array_contains("qa_issues", "LEADING_TRAILING_SPACE"), edge).alias("LEADING_TRAILING_SPACE")
        more = (F.when(F.array_contains("qa_issues", c), F.col(f"_{c}") if c in codes else F.lit(None).cast(_SIDES)).cast(_SIDES).alias(c) for c in ("NUMBER_MISMATCH", *told))
        d = d.withColumn("qa_details", F.struct(sides, *more))
    return d.drop("_s", "_t", "_sc", "_tc", "_found", "_ratio", "_relative", *(f"_{c}" for c in (*told, "NUMBER_MISMATCH")))


#: What the issues are called in reports.
LABELS = {
    "EMPTY_SOURCE": "原文为空",
    "EMPTY_TARGET": "译文为空",
    "LENGTH_RATIO_OUTLIER": "长度比异常",
    "NUMBER_MISMATCH": "数字不匹配",
    "PLACEHOLDER_MISMATCH": "占位符不匹配",
    "URL_MISMATCH": "URL 不匹配",
    "TAG_MISMATCH": "标签不匹配",
    "PUNCTUATION_UNBALANCED": "括号/引号不成对",
    "WIDTH_MIXING": "全半角混用",
    "LEADING_TRAILING_SPACE": "首尾空格",
    "SOURCE_CONFLICT": "原文冲突",
    "TARGET_CONFLICT": "译文冲突",
}


def labelled(issues: Column) -> Column:
    """Issue codes by their labels in reports; unknown codes stay."""
    names = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    return F.transform(issues, lambda c: F.coalesce(names[c], c))


def status_of(issues: Column, confidence: Column) -> Column:
    return F.when(F.size(issues) == 0, "HIGH").when(confidence < 0.5, "LOW").otherwise("MEDIUM")


def by_type(checked: DataFrame) -> DataFrame:
    """(issue, units), only issues that occur."""
    return checked.select(F.explode("qa_issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("units"))


def totals(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("total"), F.count_if(F.size("qa_issues") > 0).alias("flagged"))


def confident(checked: DataFrame, least: float) -> DataFrame:
    return checked.filter(F.col("qa_confidence") >= least)


def review(checked: DataFrame, order: list[str], limit: int = 500) -> DataFrame:
    """The first flagged units in corpus order; the limit is the report's size."""
    return checked.filter(F.size("qa_issues") > 0).orderBy(*order).limit(limit)
