"""Sentence alignment of paragraph pairs: split, length ratio of the file, and a shortest path per pair."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.functions import text as X

#: Moves in the order in which equally cheap ones win, and costs.
MOVES = ((1, 1), (2, 1), (1, 2), (2, 2), (3, 2), (2, 3), (1, 3), (3, 1), (3, 3), (1, 0), (0, 1))
SPREAD, PER_SENTENCE, NOT_ONE_TO_ONE, GAP = 0.8, 2.5, 2.0, 60.0
#: What the moves are called in reports.
MOVE_LABELS = {
    "1:1": "一一对应",
    "2:1": "合并（2→1）",
    "1:2": "拆分（1→2）",
    "2:2": "合并+拆分（2→2）",
    "3:2": "合并+拆分（3→2）",
    "2:3": "合并+拆分（2→3）",
    "1:3": "拆分（1→3）",
    "3:1": "合并（3→1）",
    "3:3": "合并+拆分（3→3）",
    "1:0": "跳过（原文无对应）",
    "0:1": "跳过（译文无对应）",
}
ABBREVIATIONS = frozenset("mr mrs ms dr prof sr jr vs etc e.g i.e inc ltd co corp no fig st approx cf al u.s u.k a.m p.m ph.d jan feb mar apr jun jul aug sep sept oct nov dec".split())

_CJK = "一-鿿　-〿＀-￯"
_END = re.compile(r"[.!?][\"')\]}]*(?= |\Z)")
_LAST_TOKEN = re.compile(r"[A-Za-z0-9À-ɏ.'\-&$%]+")
_INITIAL = re.compile(r"(?:^|\s)[A-Z]\.\Z")


def split_en(text: str, repair=None) -> list[str]:
    """Sentences end at . ! ? with closing marks before a space or the end, but not after an
    abbreviation or a single initial."""
    text = html.unescape(repair(text) if repair else text)
    for a, b in (("’", "'"), ("“", '"'), ("”", '"')):
        text = text.replace(a, b)
    text = " ".join(text.split())
    out, start = [], 0
    for m in _END.finditer(text):
        so_far = text[start : m.start() + 1]
        if m[0][0] == ".":
            tokens = _LAST_TOKEN.findall(so_far.lower())
            if tokens and tokens[-1].rstrip(".") in ABBREVIATIONS or _INITIAL.search(so_far):
                continue
        out.append(text[start : m.end()].strip())
        start = m.end()
    return [s for s in [*out, text[start:].strip()] if s]


def split_zh(text: str, repair=None) -> list[str]:
    text = html.unescape(text)
    text = repair(text) if repair else text
    text = re.sub(r" {2,}", " ", re.sub(r"[\r\n\t ]+", " ", text))
    text = re.sub(rf"(?<=[{_CJK}])\s+(?=[{_CJK}])", "", text)
    return [s for s in (x.strip() for x in re.split(r"(?<=[。！？；])", text.strip())) if s]


def repairer(rules: dict | None, lang: str):
    """rules: {en: {wrong: right}, zh: {...}, regex: [[pattern, replacement]]}."""
    if not rules:
        return None

    def repair(text: str) -> str:
        for wrong, right in (rules.get(lang) or {}).items():
            text = X.bounded(wrong).sub(lambda m, r=right: r, text) if lang == "en" else text.replace(wrong, right)
        for pattern, by in rules.get("regex") or []:
            text = re.sub(pattern, by, text)
        return text

    return repair


def cost(src: int, tgt: int, n: int, m: int, ratio: float) -> float:
    """Of joining n source sentences of src characters with m target sentences of tgt characters."""
    if not src or not tgt:
        return GAP
    expected = src / ratio
    z = (tgt - expected) / math.sqrt(max(expected * SPREAD, 1.0))
    return 0.5 * z * z + PER_SENTENCE * (n + m - 2) + (0.0 if n == m == 1 else NOT_ONE_TO_ONE)


def best_path(src: list[int], tgt: list[int], ratio: float) -> list[tuple[int, int, int, int, float]]:
    """(i, j, n, m, cost) of the cheapest path's moves; lengths of sentences without white space."""
    at_s, at_t = [0], [0]
    for x in src:
        at_s.append(at_s[-1] + x)
    for x in tgt:
        at_t.append(at_t[-1] + x)
    best = {(0, 0): (0.0, None)}
    for i in range(len(src) + 1):
        for j in range(len(tgt) + 1):
            if (i, j) not in best:
                continue
            here = best[i, j][0]
            for n, m in MOVES:
                to = (i + n, j + m)
                if to[0] <= len(src) and to[1] <= len(tgt):
                    c = cost(at_s[to[0]] - at_s[i] if n else 0, at_t[to[1]] - at_t[j] if m else 0, n, m, ratio)
                    if to not in best or here + c < best[to][0]:
                        best[to] = (here + c, (i, j, n, m, c))
    path, at = [], (len(src), len(tgt))
    while (step := best[at][1]) is not None:
        path.append(step)
        at = step[:2]
    return path[::-1]


_ALIGNED = "source_file string, file_ord int, para_ord long, unit_ord int, source_key string, src_text string, tgt_text string, alignment_cost double, align_move string, align_gap boolean"


def align(paragraphs: DataFrame, src_lang: str, tgt_lang: str, rules: dict | None = None) -> DataFrame:
    """Units with alignment_cost, align_move, align_gap, in order (file_ord, para_ord, unit_ord).

    A side whose declared language isn't Chinese, Japanese or Korean but whose first text looks so is
    split as Chinese. Pairs never reach over paragraphs, so all of it but the ratio runs row by row."""
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("para_ord")))
    kind = lambda lang, c: F.lit(True) if X.is_cjk(lang) else F.coalesce(X.looks_cjk(first(c)), F.lit(False))
    files = paragraphs.groupBy("file_ord").agg(kind(src_lang, "src_text").alias("src_cjk"), kind(tgt_lang, "tgt_text").alias("tgt_cjk"))
    d = paragraphs.join(F.broadcast(files), "file_ord")  # a row a file

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(text: pd.Series, cjk: pd.Series) -> pd.Series:
        return pd.Series([(split_zh(t or "", repairer(rules, "zh")) if c else split_en(t or "", repairer(rules, "en"))) for t, c in zip(text, cjk)])

    d = d.withColumn("src", split("src_text", "src_cjk")).withColumn("tgt", split("tgt_text", "tgt_cjk"))
    sum_len = lambda c: F.sum(F.aggregate(c, F.lit(0), lambda a, x: a + X.nolen(x)))
    ratio = d.groupBy("file_ord").agg((sum_len("src") / F.greatest(sum_len("tgt"), F.lit(1))).alias("ratio"))
    d = d.join(F.broadcast(ratio), "file_ord").select("source_file", "file_ord", "para_ord", "key", "src", "tgt", "src_cjk", "tgt_cjk", "ratio")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = lambda s: len("".join(s.split()))
        for p in batches:
            out = []
            for f, o, k, key, s, t, sc, tc, r in p.itertuples(index=False):
                s, t = list(s), list(t)
                for n_th, (i, j, n, m, c) in enumerate(best_path([size(x) for x in s], [size(x) for x in t], r) if r > 0 else best_path([0] * len(s), [0] * len(t), 1.0)):
                    out.append((f, o, k, n_th, key, ("" if sc else " ").join(s[i : i + n]), ("" if tc else " ").join(t[j : j + m]), round(c, 4), f"{n}:{m}", n == 0 or m == 0))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _ALIGNED.split(", ")])

    return d.mapInPandas(run, _ALIGNED).withColumn("src_lang", F.lit(src_lang)).withColumn("tgt_lang", F.lit(tgt_lang))


def move_label(move: Column) -> Column:
    """A move by its label in reports; unknown moves stay."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in MOVE_LABELS.items() for x in kv))[move], move)


def summarize(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("total"), F.count_if("align_gap").alias("gaps"), F.count_if(F.size("qa_issues") > 0).alias("flagged"))


def batch_summary(checked: DataFrame, failed: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """(file, units, gap_count, qa_flagged, status) of each file: ok, review, or what went wrong.

    failed: (path, error) of files that can't be read; they have no counts. files: (path) of all files;
    those that nothing was read from need review."""
    bad = (F.col("gap_count") > 0) | (F.col("qa_flagged") > 0) | (F.col("units") == 0)
    d = checked.groupBy(F.col("source_file").alias("file")).agg(F.count("*").alias("units"), F.count_if("align_gap").alias("gap_count"), F.count_if(F.size("qa_issues") > 0).alias("qa_flagged"))
    if files is not None:
        known = files.select(F.col("path").alias("file"))
        known = known if failed is None else known.join(failed.select(F.col("path").alias("file")), "file", "left_anti")
        d = known.join(d, "file", "left").na.fill(0, ["units", "gap_count", "qa_flagged"])
    d = d.withColumn("status", F.when(bad, "review").otherwise("ok"))
    blank = F.lit(None).cast("long")
    return d if failed is None else d.unionByName(failed.select(F.col("path").alias("file"), blank.alias("units"), blank.alias("gap_count"), blank.alias("qa_flagged"), F.col("error").alias("status")))


def batch_tallies(summary: DataFrame) -> DataFrame:
    """One row: files checked, failed and in need of review."""
    return summary.agg(F.count("units").alias("checked"), F.count_if(F.col("units").isNull()).alias("failed"), F.count_if(F.col("status") == "review").alias("needs_review"))


def switched(paragraphs: DataFrame, src_lang: str, tgt_lang: str) -> DataFrame:
    """(file_ord, side, lang): sides that are split as Chinese though their language isn't, by their looks."""
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("para_ord")))
    files = paragraphs.groupBy("file_ord").agg(X.looks_cjk(first("src_text")).alias("src"), X.looks_cjk(first("tgt_text")).alias("tgt"))
    sides = [F.when(F.col(side) & F.lit(not X.is_cjk(lang)), F.struct(F.lit(side).alias("side"), F.lit(lang).alias("lang"))) for side, lang in (("src", src_lang), ("tgt", tgt_lang))]
    return files.select("file_ord", F.explode(F.filter(F.array(*sides), lambda x: x.isNotNull())).alias("s")).select("file_ord", "s.side", "s.lang")


def moves(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy("align_move").agg(F.count("*").alias("units"))
