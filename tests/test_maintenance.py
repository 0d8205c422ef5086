"""The stream's memory against a batch merge after each start; sources that are let go; hot sources."""

import random

from pyspark.sql import functions as F

from bitloom.operators import corpus
from bitloom.streaming import drop_folder, maintenance

SCHEMA = "ord long, src_text string, tgt_text string, modified_at string"


def _feed(spark, at, rows, keep=None):
    spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{at}/feed")
    stream = maintenance.newest(spark.readStream.schema(SCHEMA).parquet(f"{at}/feed"), keep)
    drop_folder.write(stream, f"{at}/rows", f"{at}/checkpoint").awaitTermination()
    return maintenance.current(spark.read.schema(maintenance.ROW).parquet(f"{at}/rows"))


def test_stream_equals_batch_after_each_start(spark, tmp_path):
    rnd, seen = random.Random(6), []
    for start in range(4):
        rows = [(start * 100 + i, rnd.choice(("hot", "hot", " hot ", f"s{rnd.randint(0, 20)}", None, "")), rnd.choice(("t", " t", "u", None)), rnd.choice((None, "20240101T000000Z", f"202401{rnd.randint(10, 28)}T000000Z"))) for i in range(60)]
        seen += rows
        got = {r.src: (r.tgt_text, r.ord, r.units, r.conflict) for r in _feed(spark, tmp_path, rows).collect()}
        units = spark.createDataFrame(seen, SCHEMA)
        best = corpus.merge(units, "prefer-newer").collect()
        kinds = {}
        for _, s, t, _ in seen:
            kinds.setdefault((s or "").strip(), []).append((t or "").strip())
        assert got == {(r.src_text or "").strip(): (r.tgt_text or "", r.ord, len(k := kinds[(r.src_text or "").strip()]), len(set(k)) > 1) for r in best}


def test_sources_are_let_go(spark, tmp_path):
    day = lambda n: f"202401{n:02}T000000Z"
    assert {r.src for r in _feed(spark, tmp_path, [(1, "a", "x", day(1)), (2, "b", "x", day(5))], "5 days").collect()} == {"a", "b"}
    _feed(spark, tmp_path, [(3, "c", "x", day(20))], "5 days")
    got = _feed(spark, tmp_path, [(4, "b", "late", day(6)), (5, "c", "y", day(21))], "5 days")
    assert {(r.src, r.tgt_text, r.conflict) for r in got.collect()} == {("c", "y", True)}


def test_conflicts_of_a_hot_source(spark):
    """A third of all units has one source; no range holds them all, and the count is that of a plain walk."""
    rnd = random.Random(2)
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 50}", rnd.choice("tuv"), f"2024{rnd.randint(1, 9):02}01T000000Z") for i in range(3000)]
    units, last, n = spark.createDataFrame(rows, SCHEMA), {}, 0
    for _, s, t, m in sorted(rows, key=lambda r: (r[3], r[0])):
        n += last.setdefault(s, t) != t
        last[s] = t
    assert corpus.conflicts_resolved(units, "prefer-newer").first()[0] == n
    assert corpus.conflicts_resolved(units.limit(0), "prefer-last").first()[0] == 0
    got = {r.src: (r.kind, r.targets) for r in corpus.compare(units.withColumn("label", F.col("ord") % 2)).collect()}
    assert got["hot"] == ("conflict", 3)
