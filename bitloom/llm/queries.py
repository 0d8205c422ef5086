"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, jaccard, languages, leaderboard, mixing, neighbours, oracles, order_minhash, pieces, quality_rules, sharding, spellings, substrings, toxicity

#: Target weights of the sources; others are pooled.
WEIGHTS = {f"src{i}": 3 if i < 5 else 2 if i < 10 else 1 for i in range(20)}


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(table(spark, sf_dir, "documents"), vocabulary_path())


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_edited(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.positions(table(spark, sf_dir, "documents"), WEIGHTS).drop("text_hash")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return languages.identify(docs, vocabulary_path()).select("doc_id", "held_out", "lang_pred", "score")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chain = toxicity.train(docs, labels, ["quality", "toxic"])
    return toxicity.score_toxicity(docs, chain).select("doc_id", F.col("p_quality"), F.col("p_toxic"), F.col("is_toxic").alias("toxic"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.group_variants(table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op13_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.leaderboard_changes(*(table(spark, sf_dir, t) for t in ("sale_lines", "items", "vendors")))


_WORDS = """docs AS (SELECT doc_id, list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents)"""

ORACLE_OP7 = f"""WITH RECURSIVE {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
grams AS (
    SELECT doc_id, array_to_string(w, ' ') AS g FROM docs WHERE len(w) BETWEEN 1 AND 4
    UNION SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM docs WHERE len(w) >= 5)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce((SELECT n FROM sizes s WHERE s.doc_id = d.doc_id), 0)::BIGINT AS n_shingles, c.component_id, coalesce(l.n_links, 0)::BIGINT AS n_links
FROM documents d JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) l ON l.a = d.doc_id"""

ORACLE_OP8 = f"""WITH {_WORDS.format(text="coalesce(text, '')")},
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)),
firsts AS (SELECT g, min(doc_id) AS owner FROM windows GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM windows JOIN firsts USING (g), range(0, 13) t(o) WHERE owner < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM docs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_order_minhash, op3_mixing, op4_language_id, op5_html_text, op6_sharding, op7_jaccard_join, op8_substring_dedup, op9_neighbours, op10_toxicity, op11_spelling_variants, op12_quality_rules, op13_leaderboard)}


def oracle_sql() -> dict[str, str]:
    stops = ", ".join(f"'{x}'" for x in quality_rules.forms_of_stop_words())
    return {"op7_jaccard_join": ORACLE_OP7, "op8_substring_dedup": ORACLE_OP8, "op11_spelling_variants": oracles.OP11, "op12_quality_rules": oracles.OP12.replace("{stops}", stops), "op13_leaderboard": oracles.OP13}
