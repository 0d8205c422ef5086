"""A corpus pipeline over documents: each stage is one operator of bitloom.llm.

Language identification rejects documents without a letter and those whose language can't be told;
the Jaccard join keeps one document of each group of near copies; substring deduplication takes out
repeated passages; mixing puts the documents in the order of the target weights; encoding gives ids.

Documents with null or blank texts are rejected by the first stage. Null ids, languages, sources and counts
pass; a null source is pooled with those that have no weight. Repeated rows are copies, of which one stays.
Columns beside those of documents pass all stages but the last, whatever their names. An empty table gives no
rows. A text of any length is worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import jaccard, languages, mixing, pieces, substrings
from bitloom.llm.queries import WEIGHTS, vocabulary_path
from bitloom.plans.lineage import dropped, kept, passing

#: The least score with which a language counts as told: more likely than all others together.
TOLD = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return languages.told(docs, vocabulary_path(), TOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substrings.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, WEIGHTS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed order isn't kept by files, so positions are worked out again (they depend on ids, texts and
    sources alone); rows come in their order and carry them."""
    docs = mixing.mixed(docs, WEIGHTS, position="position")
    return pieces.encode_pieces(docs, vocabulary_path(), carry=("position",))


STAGES = [("language_id", language_id), ("jaccard_join", near_duplicates), ("substring_dedup", repeated_passages), ("mixing", mixing_sources), ("sentencepiece", encoding)]

#: Learned language probabilities and the library's encoding have no SQL; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each one's rows written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before = docs
        with passing() as stay:  # a stage's own tables go when its rows are written, and so does its input
            docs = kept(stage(spark, before, sf_dir))
            stay.append(docs)
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
