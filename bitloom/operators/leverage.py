"""Match bands of candidate units against a translation memory, and quotes from them.

The best match of a text is found in two steps: equal normalised texts by an equi-join; the rest in
blocks of texts whose lengths allow the least ratio, where bounds of all pairs are worked out at once
(functions.similar) and difflib looks at the most promising first. A block gives one row a candidate, never a
row a pair.
"""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.functions import similar
from bitloom.functions import text as X
from bitloom.plans.lineage import kept
from bitloom.schema import BANDS

PAIR = ["src_lang", "tgt_lang"]
PAIRS = 100_000  # whose bounds are worked out at once


def length_steps(ratio: float, longest: int = 1 << 22) -> list[int]:
    """Bounds of length buckets: texts whose lengths differ by up to ratio are in one or in neighbours."""
    steps, ratio = [1], max(ratio, 1.05)  # coarser is as right
    while steps[-1] < longest:
        steps.append(max(steps[-1] + 1, int(steps[-1] * ratio) + 1))
    return steps


def bucket_of(text: str, steps: list[int]):
    return F.expr(f"size(filter(array({', '.join(map(str, steps))}), x -> x <= length({text})))")


def _best(text: str, known: list[str], may: np.ndarray, least: float) -> tuple[float, str] | None:
    """(ratio, match): difflib looks at the texts of highest bound first, until none can be better."""
    m, best = difflib.SequenceMatcher(), None
    if not (may >= least).any():
        return None
    m.set_seq2(text)
    for i in np.argsort(-may, kind="stable"):
        wanted = max(least, best[0]) if best else least
        if may[i] < wanted:
            break
        m.set_seq1(known[i])
        r = similar.ratio(m, wanted, may[i])
        if r is not None and (best is None or (r, known[i]) > best):
            best = (r, known[i])
    return best


def best_matches(asked: DataFrame, pool: DataFrame, least: float, asked_rows: int = 2000, pool_rows: int = 1000) -> DataFrame:
    """(*PAIR, norm, ratio, match): each text's best of the pool, of equal ones the last in text order.

    asked, pool: distinct (*PAIR, norm). Texts of a length bucket meet in pairs of blocks of about
    asked_rows and pool_rows; larger buckets give more pairs, not larger ones."""
    steps, keys = length_steps((2 - least) / least), [*PAIR, "b"]
    own = asked.select(*PAIR, "norm", bucket_of("norm", steps).alias("b")).select(*PAIR, "norm", F.explode(F.array(F.col("b") - 1, "b", F.col("b") + 1)).alias("b"))
    other = pool.select(*PAIR, "norm", bucket_of("norm", steps).alias("b"))
    count = lambda d, rows, name: d.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(rows)).cast("int").alias(name))
    sizes = F.broadcast(count(own, asked_rows, "n").join(count(other, pool_rows, "k"), keys))  # a row a language pair and length bucket
    one = lambda n: F.pmod(F.xxhash64("norm"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = own.join(sizes, keys).select(*keys, "norm", one("n").alias("i"), each("k").alias("j"))
    other = other.join(sizes, keys).select(*keys, "norm", each("n").alias("i"), one("k").alias("j"))

    def block(a: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out, known, size = [], similar.Texts(list(p["norm"])), len(p)
        a = a.sort_values("norm", key=lambda t: t.str.len())
        for at in range(0, len(a) if size else 0, step := max(1, PAIRS // max(1, size))):
            part = a.iloc[at : at + step]
            texts = similar.Texts(list(part["norm"]))
            may = similar.crossed_bounds(texts, known, least)
            for *langs, text, row in zip(part["src_lang"], part["tgt_lang"], texts.texts, may):
                if best := _best(text, known.texts, row, least):
                    out.append((*langs, text, *best))
        return pd.DataFrame(out, columns=["src_lang", "tgt_lang", "norm", "ratio", "match"])

    met, parts = [*keys, "i", "j"], int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own, other = (d.repartition(parts, *met) for d in (own, other))  # few bytes are much work here: partitions stay apart
    got = own.groupBy(*met).cogroup(other.groupBy(*met)).applyInPandas(block, "src_lang string, tgt_lang string, norm string, ratio double, match string")
    return got.groupBy(*PAIR, "norm").agg(F.max(F.struct("ratio", "match")).alias("m")).select(*PAIR, "norm", "m.ratio", "m.match")


@F.pandas_udf(T.DoubleType())
def turned_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


@F.pandas_udf(T.DoubleType())
def _percent(r: pd.Series) -> pd.Series:
    return r.map(lambda x: round(x * 100, 1))  # half even on the binary value


def analyze(tm: DataFrame, candidates: DataFrame, least: float = 0.5, within: list[str] | None = None) -> DataFrame:
    """candidates (ord, src_lang, tgt_lang, src_text, ...) with leverage_band, leverage_match_pct,
    leverage_repetition. within: columns inside which repetitions are looked for, e.g. the file."""
    within = within or []
    c = kept(candidates.withColumn("_norm", X.folded(F.coalesce("src_text", F.lit("")))))  # normal forms are dear
    # the first of equal texts by an aggregate that is joined back, blank ones apart
    first = c.filter("_norm <> ''").groupBy(*within, "_norm").agg(F.min("ord").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    c = c.join(first, [*within, "_norm"], "left") if not within else c.join(first.withColumnsRenamed({w: f"_w{i}" for i, w in enumerate(within)}).withColumnRenamed("_norm", "_same"), [F.col("_norm") == F.col("_same"), *(F.col(w).eqNullSafe(F.col(f"_w{i}")) for i, w in enumerate(within))], "left").drop("_same", *(f"_w{i}" for i in range(len(within))))
    c = c.withColumn("leverage_repetition", F.coalesce(F.col("ord") != F.col("_first"), F.lit(False))).drop("_first")
    pool = tm.select(*PAIR, X.folded(F.coalesce("src_text", F.lit(""))).alias("norm")).distinct()
    pool = kept(pool)
    asked = c.filter("not leverage_repetition and _norm <> ''").select(*PAIR, F.col("_norm").alias("norm")).distinct()
    exact = asked.join(pool, [*PAIR, "norm"], "left_semi").withColumn("final", F.lit(1.0))
    found = exact.select(*PAIR, "norm", "final")
    if least < 1:
        fuzzy = best_matches(asked.join(pool, [*PAIR, "norm"], "left_anti"), pool, least).withColumn("final", turned_ratio("norm", "match"))
        found = found.unionByName(fuzzy.select(*PAIR, "norm", "final"))
    found = found.withColumn("pct", _percent("final"))
    c = c.join(found.withColumnRenamed("norm", "_norm"), [*PAIR, "_norm"], "left")
    rep = F.col("leverage_repetition")
    band = F.when(rep, "repetition").when(F.col("final").isNull(), "no_match").when(F.col("final") >= 1.0, "exact").otherwise(X.band_of(F.least("pct", F.lit(99.9))))
    pct = F.when(rep, 100.0).otherwise(F.coalesce("pct", F.lit(0.0)))
    return c.withColumn("leverage_band", band).withColumn("leverage_match_pct", pct).drop("_norm", "final", "pct")


def bands(spark) -> DataFrame:
    return spark.createDataFrame([(b, i, w) for i, (b, w) in enumerate(BANDS.items())], "band string, band_ord int, weight double")


def summarize(analyzed: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(band, band_ord, segments, words, weighted): every band, also those that nothing is in."""
    dim = bands(analyzed.sparkSession)
    if weights:
        dim = dim.withColumn("weight", F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("band")], "weight"))
    got = analyzed.groupBy(F.col("leverage_band").alias("band")).agg(F.count("*").alias("segments"), F.sum(X.word_count(X.py_strip(F.coalesce("src_text", F.lit(""))), F.col("src_lang"))).alias("words"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return dim.join(got, "band", "left").select("band", "band_ord", zero("segments").alias("segments"), zero("words").alias("words"), (zero("words") * F.col("weight") / 100).alias("weighted"))


def quote(tm: DataFrame, candidates: DataFrame, file: str = "file_label", weights: dict[str, float] | None = None, least: float = 0.5) -> DataFrame:
    """(file, band, segments, words, weighted) by file and, with a null file, in total; bands without
    segments are left out here (summarize has them)."""
    return quote_of(analyze(tm, candidates, least, [file]), file, weights)


def quote_of(analyzed: DataFrame, file: str = "file_label", weights: dict[str, float] | None = None) -> DataFrame:
    weight = F.create_map(*(F.lit(x) for kv in (BANDS | (weights or {})).items() for x in kv))[F.col("band")]
    d = analyzed.select(F.col(file).alias("file"), F.col("leverage_band").alias("band"), X.word_count(X.py_strip(F.coalesce("src_text", F.lit(""))), F.col("src_lang")).alias("w"))
    sets = d.groupingSets([["file", "band"], ["band"]], "file", "band").agg(F.count("*").alias("segments"), F.sum("w").alias("words"))
    return sets.withColumn("weighted", F.col("words") * weight / 100)
