"""Translation-unit views over the test tables, in Spark and in DuckDB SQL.

``ord`` is the corpus order: made of the tables' own keys, never of a physical row number."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ord(group: str, place: str) -> Column:
    """The place of a part in its whole; a whole has less than 2^30 parts, as Spark's arrays and texts do."""
    return F.col(group).cast("long") * (1 << 30) + F.col(place)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn with the assistant's answer to it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    d = table(spark, sf_dir, "conversations").withColumn("r2", F.lead("role").over(w)).withColumn("t2", F.lead("text").over(w)).filter("role = 'user' and r2 = 'assistant'")
    return d.select(_ord("conv_id", "turn").alias("ord"), F.lit("en").alias("src_lang"), F.lit("en").alias("tgt_lang"), F.col("text").alias("src_text"), F.col("t2").alias("tgt_text"), F.concat(F.lit("conv/"), (F.col("conv_id") % 7).cast("string"), F.lit(".tmx")).alias("source_file"), F.lit(None).cast("string").alias("modified_at"), F.lit(None).cast("string").alias("domain"))


PAIRS = """pairs AS (SELECT conv_id::BIGINT * 1073741824 + turn AS ord, text AS src_text, t2 AS tgt_text, 'conv/' || (conv_id % 7) || '.tmx' AS source_file
  FROM (SELECT *, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r2 = 'assistant')"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's line with the line after it. A row has its two lines alone: beside all lines of the document
    each row would be as large as the document, and Python functions' queues with it."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.split("text", "\n").alias("l"))
    two = F.arrays_zip(F.slice("l", F.lit(1), F.size("l") - 1).alias("s"), F.slice("l", F.lit(2), F.size("l") - 1).alias("t"))
    d = d.select("doc_id", "lang", "source", F.posexplode(two).alias("pos", "x"))
    return d.select(_ord("doc_id", "pos").alias("ord"), F.col("lang").alias("src_lang"), F.col("lang").alias("tgt_lang"), F.col("x.s").alias("src_text"), F.col("x.t").alias("tgt_text"), F.col("source").alias("source_file"), F.col("source").alias("label"), F.lit(None).cast("string").alias("modified_at"), F.lit(None).cast("string").alias("domain"))


SEGMENTS = """segments AS (SELECT doc_id::BIGINT * 1073741824 + i - 1 AS ord, lang AS src_lang, lang AS tgt_lang, l[i] AS src_text, l[i + 1] AS tgt_text, source AS source_file, source AS label
  FROM (SELECT doc_id, lang, source, l, unnest(range(1, len(l))) AS i FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents)))"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue: part names with their types."""
    d = table(spark, sf_dir, "part")
    return d.select(F.col("p_partkey").alias("ord"), F.lit("en").alias("src_lang"), F.lit("en").alias("tgt_lang"), F.col("p_name").alias("src_text"), F.col("p_type").alias("tgt_text"), F.col("p_brand").alias("label"), F.col("p_brand").alias("source_file"), F.lit(None).cast("string").alias("modified_at"), F.lit(None).cast("string").alias("domain"))


PARTS = "parts AS (SELECT p_partkey AS ord, p_name AS src_text, p_type AS tgt_text, p_brand AS label FROM part)"


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities with their status, dated."""
    d = table(spark, sf_dir, "orders")
    return d.select(F.col("o_orderkey").alias("ord"), F.lit("en").alias("src_lang"), F.lit("de").alias("tgt_lang"), F.concat_ws(" ", "o_orderpriority", (F.col("o_custkey") % 50).cast("string")).alias("src_text"), F.col("o_orderstatus").alias("tgt_text"), F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss'Z'").alias("modified_at"), F.lit(None).cast("string").alias("source_file"), F.when(F.col("o_orderkey") % 3 == 0, "legal").alias("domain"))


DATED = """dated AS (SELECT o_orderkey AS ord, o_orderpriority || ' ' || (o_custkey % 50) AS src_text, o_orderstatus AS tgt_text, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') AS modified_at,
  CASE WHEN o_orderkey % 3 = 0 THEN 'legal' END AS domain FROM orders)"""


#: Units with one kind of defect after the other, by the key; the same SQL for Spark and DuckDB.
_NAME = "p_name || ' no ' || CAST(p_partkey AS STRING)"
_PLANTED = {  # remainder of the key by 16: source, target
    0: ("''", _NAME),
    1: (_NAME, "'  '"),
    2: (f"' ' || {_NAME}", _NAME),
    3: (_NAME, f"repeat({_NAME} || ' and ', 6) || 'end'"),
    4: (f"{_NAME} || ' costs 1,250.50 USD'", f"{_NAME} || ' costs 1250.5'"),
    5: (f"{_NAME} || ' in Sept. 2024'", f"{_NAME} || ' in 10 2024'"),
    6: (f"{_NAME} || ' {{user.name}} and %s'", f"{_NAME} || ' {{user.name}} and %d'"),
    7: (f"{_NAME} || ' at https://a.example/x.'", f"{_NAME} || ' at HTTPS://a.example/x'"),
    8: (f"{_NAME} || ' at https://a.example/x,'", f"{_NAME} || ' at https://a.example/x'"),
    9: (f"{_NAME} || ' (open'", f"{_NAME} || ' 《open》“'"),
    10: (f"{_NAME} || ' yes! no！'", f"{_NAME} || ' yes! no!'"),
    11: ("'twin ' || CAST(CAST(floor(p_partkey / 48) AS INT) AS STRING)", _NAME),
    12: (_NAME, "'twin ' || CAST(CAST(floor(p_partkey / 48) AS INT) AS STRING)"),
    13: (f"{_NAME} || ' 3 million, 2.5 bn and 4万'", f"{_NAME} || ' 3,000,000 2500000000 40000'"),
    14: (f"{_NAME} || ' it’s 12,5 March'", f"{_NAME} || ' it‘s 3, 12.50'"),
    15: (f"' (' || {_NAME} || ' 7'", f"{_NAME} || ' 8 '"),
}
_CASE = {side: "CASE p_partkey % 16 " + " ".join(f"WHEN {r} THEN {x[i]}" for r, x in _PLANTED.items()) + " END" for i, side in enumerate(("src", "tgt"))}
_CASE = {side: x.replace("{{", "{").replace("}}", "}") for side, x in _CASE.items()}
#: Content of the tags of a side, by the key.
_NODES = {"src": {0: ('<b id="1">', "</b>"), 1: ('<i x="1">', "</i>"), 2: ("<br/>",), 3: ("< >",)}, "tgt": {0: ("<b>", "</b>"), 1: ("<b>", "</b>"), 2: ("<br/>",), 4: ("<br/>", "<x>")}}


def defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue with defects of all kinds, planted by arithmetic on the key."""

    def nodes(side: str) -> Column:
        out = F.lit(None).cast("array<struct<kind:string,content:string>>")
        for r, tags in _NODES[side].items():
            out = F.when(F.col("ord") % 9 == r, F.array(*(F.struct(F.lit("tag").alias("kind"), F.lit(x).alias("content")) for x in tags))).otherwise(out)
        return out

    d = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("ord"), F.expr(_CASE["src"]).alias("src_text"), F.expr(_CASE["tgt"]).alias("tgt_text"))
    return d.select("ord", F.lit("en").alias("src_lang"), F.lit("zh-CN").alias("tgt_lang"), "src_text", "tgt_text", nodes("src").alias("src_markup"), nodes("tgt").alias("tgt_markup"))


_LISTS = {side: "CASE p_partkey % 9 " + " ".join(f"WHEN {r} THEN [{', '.join(repr(x) for x in tags)}]" for r, tags in _NODES[side].items()) + " END" for side in _NODES}
DEFECTS = f"defects AS (SELECT p_partkey::BIGINT AS ord, {_CASE['src']} AS src_text, {_CASE['tgt']} AS tgt_text, {_LISTS['src']} AS src_tags, {_LISTS['tgt']} AS tgt_tags FROM part)"


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the benchmark items as a translation memory of all languages."""
    d = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", "\n")).alias("src_text"))
    return d.crossJoin(F.broadcast(table(spark, sf_dir, "documents").select(F.col("lang").alias("src_lang")).distinct())).select("src_lang", F.col("src_lang").alias("tgt_lang"), "src_text")  # a row a language


MEMORY = "memory AS (SELECT lang, src_text FROM (SELECT DISTINCT lang FROM documents), (SELECT unnest(string_split(text, chr(10))) AS src_text FROM benchmark))"


def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glossary over the catalogue: some types are forbidden for some names, others approved."""
    rows = [(0, "blue", "LARGE", "forbidden"), (1, "green", "SMALL", "forbidden"), (2, "red", "PROMO", "approved"), (3, "small", "ECONOMY", "approved")]
    return spark.createDataFrame([(i, "en", "en", s, t, k, True, None) for i, s, t, k in rows], "entry_ord int, src_lang string, tgt_lang string, src_term string, tgt_term string, status string, status_declared boolean, note string")


def _hanzi(words: pa.Array) -> pa.Array:
    """Lines in Chinese characters, one a word, by a digest of the word; each word of a batch once."""
    coded = words.flatten().dictionary_encode()
    place = np.array([int(hashlib.md5(w.encode()).hexdigest()[:3], 16) + 0x4E00 for w in coded.dictionary.to_pylist()], np.int64)
    three = np.stack([0xE0 | place >> 12, 0x80 | place >> 6 & 63, 0x80 | place & 63], axis=1).astype(np.uint8)  # in UTF-8
    ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)) * 3].astype(np.int32)
    out = pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(three[coded.indices.to_numpy()].tobytes())])
    return pc.if_else(words.is_valid(), out, pa.scalar(None, pa.string()))


def in_hanzi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the documents, a Chinese character for each word."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)).alias(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["ord"], _hanzi(b["src_text"]), _hanzi(b["tgt_text"])], names=["ord", "src_text", "tgt_text"])

    d = segments(spark, sf_dir).select("ord", words("src_text"), words("tgt_text")).mapInArrow(run, "ord long, src_text string, tgt_text string")
    return d.select("ord", F.lit("zh").alias("src_lang"), F.lit("zh").alias("tgt_lang"), "src_text", "tgt_text")


HANZI = """hanzi AS (SELECT ord, array_to_string(list_transform(regexp_extract_all(lower(src_text), '[a-z]+'), lambda w: chr(19968 + ('0x' || md5(w)[1:3])::INT)), '') AS src_text, array_to_string(list_transform(regexp_extract_all(lower(tgt_text), '[a-z]+'), lambda w: chr(19968 + ('0x' || md5(w)[1:3])::INT)), '') AS tgt_text FROM segments)"""


def _as_glossary(terms: DataFrame, lang: str) -> DataFrame:
    """Of (src_term, tgt_term): the smallest target of each term; terms of an even length are forbidden with it, others approved."""
    d = terms.groupBy("src_term").agg(F.min("tgt_term").alias("tgt_term"))
    status = F.when(F.length("src_term") % 2 == 0, "forbidden").otherwise("approved")
    return d.select(F.length("src_term").alias("entry_ord"), F.lit(lang).alias("src_lang"), F.lit(lang).alias("tgt_lang"), "src_term", "tgt_term", status.alias("status"), F.lit(True).alias("status_declared"), F.lit(None).cast("string").alias("note"))


_AS_GLOSSARY = "SELECT src_term, min(tgt_term) AS tgt_term, CASE WHEN length(src_term) % 2 = 0 THEN 'forbidden' ELSE 'approved' END AS status FROM {} GROUP BY src_term"


def glossary_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry for the first two words of each line, with the first word of the next line."""
    two = lambda k: F.regexp_extract(F.lower("src_text"), "([a-z]+)[^a-z]+([a-z]+)", k)
    d = segments(spark, sf_dir).select(F.concat_ws(" ", two(1), two(2)).alias("src_term"), F.regexp_extract(F.lower("tgt_text"), "[a-z]+", 0).alias("tgt_term"))
    return _as_glossary(d.filter("src_term <> ' ' and tgt_term <> ''"), "en")


GLOSSARY_OF_LINES = f"""two AS (SELECT array_to_string(s[1:2], ' ') AS src_term, t[1] AS tgt_term FROM (SELECT regexp_extract_all(lower(src_text), '[a-z]+') AS s, regexp_extract_all(lower(tgt_text), '[a-z]+') AS t FROM segments) WHERE len(s) > 1 AND len(t) > 0),
entries AS ({_AS_GLOSSARY.format('two')})"""


def glossary_in_hanzi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry for the first characters of each line, two or three by its length, with the first of the next line."""
    d = in_hanzi(spark, sf_dir).filter("length(src_text) > 2 and tgt_text <> ''")
    return _as_glossary(d.select(F.substring(F.col("src_text"), F.lit(1), 2 + F.length("src_text") % 2).alias("src_term"), F.substring("tgt_text", 1, 1).alias("tgt_term")), "zh")


GLOSSARY_IN_HANZI = f"""three AS (SELECT src_text[1 : 2 + length(src_text) % 2] AS src_term, tgt_text[1:1] AS tgt_term FROM hanzi WHERE length(src_text) > 2 AND tgt_text <> ''),
entries AS ({_AS_GLOSSARY.format('three')})"""
