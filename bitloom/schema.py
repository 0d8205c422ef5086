"""Row layouts and fixed vocabularies of bilingual corpora."""

from __future__ import annotations

from pyspark.sql import types as T

MARKUP = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("content", T.StringType())]))

#: A translation unit; (file_ord, unit_ord) is the corpus order and comes from the source.
UNIT = T.StructType(
    [T.StructField("file_ord", T.IntegerType()), T.StructField("unit_ord", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("src_lang", "tgt_lang", "src_text", "tgt_text", "guid", "source_file", "source_key", "created_at", "modified_at")]
    + [T.StructField("src_markup", MARKUP), T.StructField("tgt_markup", MARKUP), T.StructField("domain", T.StringType())]
)

PARAGRAPH = T.StructType([T.StructField("file_ord", T.IntegerType()), T.StructField("para_ord", T.LongType())] + [T.StructField(c, T.StringType()) for c in ("source_file", "key", "src_text", "tgt_text")])

GLOSSARY = T.StructType(
    [T.StructField("entry_ord", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("src_lang", "tgt_lang", "src_term", "tgt_term", "status")]
    + [T.StructField("status_declared", T.BooleanType())]
    + [T.StructField(c, T.StringType()) for c in ("domain", "note", "guid", "source_file", "created_at", "modified_at")]
)

#: Issue codes in report order.
ISSUES = ("EMPTY_SOURCE", "EMPTY_TARGET", "LEADING_TRAILING_SPACE", "LENGTH_RATIO_OUTLIER", "NUMBER_MISMATCH", "PLACEHOLDER_MISMATCH", "URL_MISMATCH", "TAG_MISMATCH", "PUNCTUATION_UNBALANCED", "WIDTH_MIXING", "SOURCE_CONFLICT", "TARGET_CONFLICT")

#: Match bands in report order, with default weights in percent.
BANDS = {"repetition": 0.0, "exact": 0.0, "95-99": 30.0, "85-94": 60.0, "75-84": 100.0, "50-74": 100.0, "no_match": 100.0}
