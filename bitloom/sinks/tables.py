"""Tabular exports as projections; physical writing is Spark's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.functions import text as X
from bitloom.operators.qa import status_of


def jsonl_rows(units: DataFrame, *more: str) -> DataFrame:
    """(*more, src_lang, tgt_lang, src, tgt) of units with both sides."""
    full = lambda c: X.py_strip(F.coalesce(c, F.lit(""))) != ""
    return units.filter(full("src_text") & full("tgt_text")).select(*more, "src_lang", "tgt_lang", F.col("src_text").alias("src"), F.col("tgt_text").alias("tgt"))


def write_jsonl(units: DataFrame, path: str) -> None:
    """One JSON object a line, keys in order; a folder of parts."""
    jsonl_rows(units).select(F.to_json(F.struct("src_lang", "tgt_lang", "src", "tgt")).alias("value")).write.text(path)


def review_rows(units: DataFrame, number: str) -> DataFrame:
    """The review sheet's columns that the units have: number, texts, alignment, quality, terms, matches,
    semantic issues."""
    has, out = set(units.columns), [F.col(number).alias("No"), F.col("src_text").alias("src"), F.col("tgt_text").alias("tgt")]
    if "align_move" in has:
        out += [F.col("source_key").alias("paragraph"), F.col("align_move")]
    if "qa_issues" in has:
        out += [F.format_string("%.2f", "qa_confidence").alias("confidence"), status_of(F.col("qa_issues"), F.col("qa_confidence")).alias("status"), F.array_join("qa_issues", "; ").alias("issues")]
    if "term_issues" in has:
        one = lambda h: F.concat(F.when(h["status"] == "approved", "approved: ").otherwise(""), h["src_term"], F.lit("->"), h["tgt_term"], F.when(F.coalesce(h["note"], F.lit("")) != "", F.concat(F.lit("("), h["note"], F.lit(")"))).otherwise(""))
        out.append(F.array_join(F.transform("term_issues", one), "; ").alias("term_issues"))
    if "leverage_band" in has:
        out += [F.col("leverage_band"), F.format_string("%.1f", "leverage_match_pct").alias("match_pct")]
    if "semantic_issues" in has:
        one = lambda h: F.concat(h["type"], F.lit("("), h["description"], F.lit(")"), F.when(F.coalesce(h["span_hint"], F.lit("")) != "", F.concat(F.lit(" -- "), h["span_hint"])).otherwise(""))
        out.append(F.array_join(F.transform("semantic_issues", one), "; ").alias("semantic_issues"))
    return units.select(*out)
