"""Queries of the quality checks, over views of the test tables and over one with planted defects."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitloom.functions import text as X
from bitloom.operators import qa
from bitloom.plans import views as V
from bitloom.plans.registry import query
from bitloom.schema import ISSUES
from bitloom.sinks import tables

# SQL building blocks over a view v(ord, src_text, tgt_text, ...): stripped texts and the column checks.
_BLANK = r"[\s\x1c-\x1f\x{a0}\x{3000}]+"
_LETTERS = "[À-ÖØ-öø-ɏ]"  # to RE2 word boundaries are ASCII's


def strip(c: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({c}, ''), '^{_BLANK}', ''), '{_BLANK}$', '')"


def nolen(c: str) -> str:
    return f"length(regexp_replace({c}, '{_BLANK}', '', 'g'))"


def base(v: str) -> str:
    return f"base AS (SELECT *, {strip('src_text')} AS s, {strip('tgt_text')} AS t FROM {v})"


def numbers(c: str) -> str:
    """The distinct numbers of a text in one notation, sorted, without look-around."""
    t = f"regexp_replace({c}, '{_LETTERS}', 'x', 'g')"
    for n in sorted(set(X.MONTHS.values())):
        names = "|".join(sorted((m for m, i in X.MONTHS.items() if i == n), key=len, reverse=True))
        t = rf"regexp_replace({t}, '\b(?:{names})\.?\b', ' {n} ', 'g')"
    words = "|".join(m + r"\b" * m.isascii() for m in X.MAGNITUDES)
    large = rf"'(?i)\d+(?:\.\d+)?\s*(?:{words})'"
    times = " ".join(f"WHEN lower(regexp_extract(m, '[^\\d.\\s]+$')) = '{w}' THEN {n}" for w, n in X.MAGNITUDES.items())
    values = rf"list_transform(regexp_extract_all(t, {large}), lambda m: CAST(CAST(CAST(regexp_extract(m, '\d+(?:\.\d+)?') AS DOUBLE) * (CASE {times} END) AS HUGEINT) AS STRING))"
    rest = rf"regexp_replace(regexp_replace(t, {large}, ' ', 'g'), '(?i)(?:\b(?:USD|EUR|CNY|RMB|GBP|JPY)\b|[$€¥£])\s*', '', 'g')"
    for _ in range(5):
        rest = rf"regexp_replace({rest}, '(\d)[,，](\d{{3}})(\D|$)', '\1\2\3', 'g')"
    rest = rf"regexp_replace({rest}, '(\d),(\d)', '\1.\2', 'g')"
    plain = rf"list_transform(regexp_extract_all({rest}, '\d+(?:[.,]\d+)?'), lambda x: CASE WHEN contains(x, '.') THEN rtrim(rtrim(x, '0'), '.') ELSE x END)"
    return f"list_transform([{t}], lambda t: list_sort(list_distinct(list_concat({values}, {plain}))))[1]"


def _odd(c: str) -> str:
    n = lambda x: f"(length({c}) - length(replace({c}, '{x}', '')))"
    return "[" + ", ".join(f"CASE WHEN {n(p[0])} {'>' if p == '‘’' else '<>'} {n(p[1])} THEN '{p}' END" for p in X.PAIRS) + "]"


def _wide(c: str) -> str:
    return "[" + ", ".join(f"CASE WHEN contains({c}, '{a}') AND contains({c}, '{b}') THEN '{a}' END" for a, b in X.WIDTHS) + "]"


def _set(c: str, pattern: str, each: str = "x") -> str:
    return f"list_sort(list_distinct(list_transform(regexp_extract_all({c}, {pattern}), lambda x: {each})))"


_SOME = "list_filter({}, lambda x: x IS NOT NULL)"
_PLACEHOLDER = r"'\{[A-Za-z0-9_.]{1,50}\}|%\(\w+\)[sdfgxX]|%[sdfgxX]'"
_URL = r"'(?i)https?://[^\s\x1c-\x1f]+'"
_TAIL = "rtrim(x, '" + X.URL_TAIL.replace("'", "''") + "')"
#: What the checks with details find on a side.
_FIND = {
    "NUMBER_MISMATCH": numbers,
    "PLACEHOLDER_MISMATCH": lambda c: _set(c, _PLACEHOLDER),
    "URL_MISMATCH": lambda c: _set(c, _URL, _TAIL),
    "PUNCTUATION_UNBALANCED": lambda c: _SOME.format(_odd(c)),
    "WIDTH_MIXING": lambda c: _SOME.format(_wide(c)),
}
_SHORT = {"NUMBER_MISMATCH": "n", "PLACEHOLDER_MISMATCH": "p", "URL_MISMATCH": "u", "PUNCTUATION_UNBALANCED": "o", "WIDTH_MIXING": "w"}
_TAGS = r"list_sort(list_transform(coalesce({}, []), lambda x: coalesce(nullif(regexp_extract(x, '<\s*([a-zA-Z][\w:-]*)', 1), ''), '?')))"
_BOTH = "s <> '' AND t <> '' AND "
_TESTS = {
    "EMPTY_SOURCE": "s = ''",
    "EMPTY_TARGET": "t = ''",
    "LEADING_TRAILING_SPACE": "(coalesce(src_text, '') <> s OR coalesce(tgt_text, '') <> t)",
    "LENGTH_RATIO_OUTLIER": f"({_BOTH}ratio > 0 AND ({nolen('t')} / greatest({nolen('s')} / ratio, 1e-6) < 0.3 OR {nolen('t')} / greatest({nolen('s')} / ratio, 1e-6) > 3.0))",
    "NUMBER_MISMATCH": f"({_BOTH}n1 <> n2)",
    "PLACEHOLDER_MISMATCH": f"({_BOTH}p1 <> p2)",
    "URL_MISMATCH": f"({_BOTH}u1 <> u2)",
    "TAG_MISMATCH": f"({_BOTH}{_TAGS.format('src_tags')} <> {_TAGS.format('tgt_tags')})",
    "PUNCTUATION_UNBALANCED": f"({_BOTH}len(o1) + len(o2) > 0)",
    "WIDTH_MIXING": f"({_BOTH}len(w1) + len(w2) > 0)",
    "SOURCE_CONFLICT": "(s IN (SELECT s FROM base WHERE s <> '' AND t <> '' GROUP BY s HAVING count(DISTINCT t) > 1))",
    "TARGET_CONFLICT": "(t IN (SELECT t FROM base WHERE s <> '' AND t <> '' GROUP BY t HAVING count(DISTINCT s) > 1))",
}


def checked_sql(view: str, v: str, markup: bool = False) -> str:
    """WITH ... checked(..., issues) by all checks and the corpus's own length ratio."""
    found = ", ".join(f"{f('s')} AS {_SHORT[c]}1, {f('t')} AS {_SHORT[c]}2" for c, f in _FIND.items())
    ratio = f"(SELECT sum({nolen('src_text')}) / greatest(sum({nolen('tgt_text')}), 1) FROM {v} WHERE src_text IS NOT NULL OR tgt_text IS NOT NULL)"
    ratio = ratio.replace("'[", "'[", 1)
    tests = ", ".join(f"CASE WHEN {_TESTS[c]} THEN '{c}' END" for c in ISSUES if markup or c != "TAG_MISMATCH")
    return f"WITH {view}, {base(v)}, found AS (SELECT *, {ratio} AS ratio, {found} FROM base), checked AS (SELECT *, {_SOME.format('[' + tests + ']')} AS issues FROM found)"


_SEGMENTS, _DEFECTS = checked_sql(V.SEGMENTS, "segments"), checked_sql(V.DEFECTS, "defects", True)
_CONFIDENCE = "greatest(0.0, 1 - 0.25 * len(issues))"
_STATUS = "CASE WHEN len(issues) = 0 THEN 'HIGH' WHEN 1 - 0.25 * len(issues) < 0.5 THEN 'LOW' ELSE 'MEDIUM' END"


def _flagged(code: str, view):
    """One check alone: nothing else is worked out."""
    return lambda spark, sf_dir: qa.check(view(spark, sf_dir), codes=(code,)).filter(F.array_contains("qa_issues", code)).select("ord", "src_text", "tgt_text")


#: One query a check over planted defects, and some over the lines of documents.
for _code in ISSUES:
    query(f"{_DEFECTS} SELECT ord, src_text, tgt_text FROM checked WHERE list_contains(issues, '{_code}')", f"qa_{_code.lower()}")(_flagged(_code, V.defects))
    if _code in ("LENGTH_RATIO_OUTLIER", "NUMBER_MISMATCH", "SOURCE_CONFLICT"):
        query(f"{_SEGMENTS} SELECT ord, src_text, tgt_text FROM checked WHERE list_contains(issues, '{_code}')", f"qa_{_code.lower()}_of_lines")(_flagged(_code, V.segments))


@query(_DEFECTS + " SELECT issue, count(*)::BIGINT AS units FROM (SELECT unnest(issues) AS issue FROM checked) GROUP BY issue")
def qa_summary(spark, sf_dir):
    return qa.by_type(qa.check(V.defects(spark, sf_dir)))


@query(checked_sql(V.PAIRS, "pairs") + " SELECT issue, count(*)::BIGINT AS units FROM (SELECT unnest(issues) AS issue FROM checked) GROUP BY issue")
def qa_summary_of_answers(spark, sf_dir):
    return qa.by_type(qa.check(V.pairs(spark, sf_dir)))


@query(_SEGMENTS + " SELECT count(*)::BIGINT AS total, count_if(len(issues) > 0)::BIGINT AS flagged FROM checked")
def qa_totals(spark, sf_dir):
    return qa.totals(qa.check(V.segments(spark, sf_dir)))


@query(_SEGMENTS + f" SELECT ord, array_to_string(issues, '|') AS issues, {_CONFIDENCE}::DOUBLE AS confidence, {_STATUS} AS status FROM checked")
def qa_confidence(spark, sf_dir):
    d = qa.check(V.segments(spark, sf_dir))
    return d.select("ord", F.array_join("qa_issues", "|").alias("issues"), F.col("qa_confidence").alias("confidence"), qa.status_of(F.col("qa_issues"), F.col("qa_confidence")).alias("status"))


@query(_DEFECTS + f" SELECT {_STATUS} AS status, count(*)::BIGINT AS units FROM checked GROUP BY ALL")
def qa_status_bucket(spark, sf_dir):
    d = qa.check(V.defects(spark, sf_dir))
    return d.groupBy(qa.status_of(F.col("qa_issues"), F.col("qa_confidence")).alias("status")).agg(F.count("*").alias("units"))


@query(_SEGMENTS + " SELECT ord, src_text FROM checked WHERE 1 - 0.25 * len(issues) >= 0.75")
def min_confidence_filter(spark, sf_dir):
    return qa.confident(qa.check(V.segments(spark, sf_dir)), 0.75).select("ord", "src_text")


@query(_SEGMENTS + " SELECT ord, array_to_string(issues, '|') AS issues FROM checked WHERE len(issues) > 0 ORDER BY ord LIMIT 500")
def review_top500(spark, sf_dir):
    return qa.review(qa.check(V.segments(spark, sf_dir)), ["ord"]).select("ord", F.array_join("qa_issues", "|").alias("issues"))


_SIDE = "CASE WHEN list_contains(issues, '{}') THEN array_to_string({}, ' ') END"


@query(
    _DEFECTS
    + " SELECT ord, "
    + _SIDE.format("LEADING_TRAILING_SPACE", _SOME.format("[CASE WHEN coalesce(src_text, '') <> s THEN 'src' END, CASE WHEN coalesce(tgt_text, '') <> t THEN 'tgt' END]"))
    + " AS sides, "
    + ", ".join(f"{_SIDE.format(c, x + i)} AS {x}{i}" for c, x in _SHORT.items() for i in "12")
    + " FROM checked WHERE len(issues) > 0"
)
def qa_details(spark, sf_dir):
    d = qa.check(V.defects(spark, sf_dir), details=True).filter(F.size("qa_issues") > 0)
    side = lambda c, k: F.array_join(F.col(f"qa_details.{c}.{k}"), " ")
    return d.select("ord", F.array_join("qa_details.LEADING_TRAILING_SPACE", " ").alias("sides"), *(side(c, k).alias(f"{x}{i}") for c, x in _SHORT.items() for i, k in (("1", "src"), ("2", "tgt"))))


@query(_SEGMENTS + f" SELECT ord AS \"No\", src_text AS src, tgt_text AS tgt, printf('%.2f', {_CONFIDENCE}) AS confidence, {_STATUS} AS status, array_to_string(issues, '; ') AS issues FROM checked")
def review_csv_projection(spark, sf_dir):
    return tables.review_rows(qa.check(V.segments(spark, sf_dir)).withColumn("No", F.col("ord")), "No")


_LABEL = "CASE x " + " ".join(f"WHEN '{c}' THEN '{label}'" for c, label in qa.LABELS.items()) + " END"


@query(_DEFECTS + f" SELECT ord, array_to_string(list_transform(issues, lambda x: {_LABEL}), '; ') AS labels FROM checked WHERE len(issues) > 0")
def qa_labels(spark, sf_dir):
    d = qa.check(V.defects(spark, sf_dir)).filter(F.size("qa_issues") > 0)
    return d.select("ord", F.array_join(qa.labelled(F.col("qa_issues")), "; ").alias("labels"))


@query(f"WITH {V.PAIRS} SELECT round(sum({nolen('src_text')}) / greatest(sum({nolen('tgt_text')}), 1), 6) AS length_ratio FROM pairs")
def length_ratio(spark, sf_dir):
    return qa.length_ratio(V.pairs(spark, sf_dir)).select(F.round("length_ratio", 6).alias("length_ratio"))


@query(f"WITH {V.DEFECTS} SELECT ord, array_to_string({numbers('src_text')}, ' ') AS numbers FROM defects")
def number_notation(spark, sf_dir):
    return V.defects(spark, sf_dir).select("ord", F.array_join(X.number_set_of(F.coalesce("src_text", F.lit(""))), " ").alias("numbers"))


@query()
def highlight_spans(spark, sf_dir):
    d = qa.check(V.defects(spark, sf_dir)).filter(F.size("qa_issues") > 0)
    return d.select("ord", F.to_json(X.highlight_spans("src_text", "qa_issues")).alias("spans"))


@query(f"""WITH {V.DEFECTS} SELECT ord, (CASE WHEN ord % 2 = 0 THEN {nolen(strip('tgt_text'))} ELSE len(list_filter(string_split_regex({strip('tgt_text')}, '\\s+'), lambda x: x <> '')) END)::BIGINT AS words FROM defects""")
def words_of_chinese(spark, sf_dir):
    """Units whose language is Chinese, Japanese or Korean count characters."""
    lang = F.when(F.col("ord") % 2 == 0, F.element_at(F.array(F.lit("zh-CN"), F.lit("ja"), F.lit("KO-kr")), (F.col("ord") % 3 + 1).cast("int"))).otherwise("en-US")
    return V.defects(spark, sf_dir).select("ord", X.word_count(X.py_strip(F.coalesce("tgt_text", F.lit(""))), lang).alias("words"))
