"""The pipeline's stages on a small table."""

import pytest

from bitloom.plans.lineage import kept

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    base = "the house of the old man by the river was sold to a young woman from the city last year"
    rows = [(i, f"{base} {i} " + " ".join(f"own{i}x{j}" for j in range(30)), "en", f"src{i % 3}", None) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " more", "en", "src0", None) for i in range(5)] + [(200, "12 34 56", "en", "src1", None), (201, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append((name, docs.count()))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == d.columns
        if name == "substring_dedup":
            assert docs.filter("text like 'the house%'").count() == 1
    assert [n for _, n in counts] == [45, 40, 40, 40, 40]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 40


def _brute_force_order(rows, weights, block_rows=16):
    """Rows (doc_id, text, source) by walking slot after slot."""
    from pyspark.sql import functions as F
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    d = d.withColumn("turn", F.xxhash64("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))))
    waiting: dict = {}
    for r in sorted(d.collect(), key=lambda r: (r.turn, r.doc_id)):
        waiting.setdefault(r.source if r.source in weights else "other", []).append(r.doc_id)
    weights, out = {"other": 1} | weights, []
    while waiting:  # a phase: until a source has no rows left
        total, served = sum(weights[s] for s in waiting), dict.fromkeys(waiting, 0)
        for slot in range(1 << 30):
            free = [s for s in waiting if served[s] * total // weights[s] <= slot]
            s = min(free, key=lambda s: (-(-(served[s] + 1) * total // weights[s]), s))
            served[s] += 1
            out += waiting[s][:block_rows]
            waiting[s] = waiting[s][block_rows:]
            if not waiting[s]:
                del waiting[s]
                break
    return out


def test_run_gives_the_mixed_order(spark, tmp_path):
    words = "the house old man river sold young woman city last year small garden behind long wall summer bread market".split()
    text = lambda i: " ".join(words[(i * 7 + j * (i % 5 + 1)) % len(words)] + ("" if j % 3 else f" word{i}of{j}") for j in range(30 + i % 9 * 40))
    rows = [(i, text(i), "en", f"src{i % 3 * 6}" if i % 4 else "unnamed", None) for i in range(240)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several part files between stages
    try:
        got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) > 200
    source = {r[0]: r[3] for r in rows}
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        d = kept(stage(spark, d, str(tmp_path)))
    want = _brute_force_order([(r.doc_id, r.text, source[r.doc_id]) for r in d.collect()], corpus_pipeline.WEIGHTS)
    assert want != sorted(want)
    assert [r.doc_id for r in got] == want  # as run() gives them
    assert [r.doc_id for r in sorted(got, key=lambda r: r.position)] == want and sorted(r.position for r in got) == list(range(len(want)))


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", "en", None, 0), (2, " ", None, "src0", None)]])
def test_run_on_nothing(spark, tmp_path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_other_columns_nulls_and_one_of_repeated_rows(spark, tmp_path):
    text = "the house of the old man by the river was sold to a young woman from the city last year and it was not cheap"
    long = " ".join(f"the river{i} of city{i}" for i in range(30_000))
    rows = [(i, t, "en" if i else None, s, None, f"row {i}", "p") for i, t, s in ((1, text, "src0"), (1, text, "src0"), (None, text + " at all", None), (4, long, "src1"), (5, text[::-1], None))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, position string, `a.b` string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = kept(stage(spark, d, str(tmp_path)))
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars", "position", "a.b"], name
    got = {r.position: (r.doc_id, len(r.text)) for r in d.collect()}
    assert ("row 4" in got and got["row 4"] == (4, len(long))) and len([p for p in got if p in ("row 1", "row None")]) == 1
