"""The command line: each command reads files, runs one operator, prints a summary and writes results.

``python -m bitloom COMMAND ...``. Exit codes: 0; 1 where the input is wrong (one line says why); 2 where
``--fail-on-issues`` or ``--fail-on-conflicts`` is given and there are some.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.operators import align, corpus, leverage, near_dup, qa, review, terms
from bitloom.plans.lineage import numbered
from bitloom.schema import BANDS, ISSUES
from bitloom.sinks import files as sink
from bitloom.sinks import reports
from bitloom.sinks.tables import jsonl_rows, review_rows
from bitloom.sources import files as source

ORDER = ["file_ord", "unit_ord"]


def labels(paths: list[str]) -> list[str]:
    """Base names; the second and later of the same name are numbered."""
    out: list[str] = []
    for p in paths:
        stem, ext = os.path.splitext(os.path.basename(p.replace("\\", "/")))
        name, n = stem + ext, 1
        while name in out:
            n += 1
            name = f"{stem}-{n}{ext}"
        out.append(name)
    return out


def weights(path: str | None) -> dict[str, float]:
    """The bands' weights in percent, the defaults where the file names none."""
    if path is None:
        return dict(BANDS)
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    if not isinstance(given, dict):
        raise ValueError("a rate card is an object of bands and percents")
    for band, v in given.items():
        if band not in BANDS:
            raise ValueError(f"unknown band {band!r}")
        if isinstance(v, bool) or not isinstance(v, int | float) or not 0 <= v <= 100:
            raise ValueError(f"{band}: a percent is a number from 0 to 100")
    return BANDS | given


def _kind(path: str) -> str:
    return os.path.splitext(path)[1].lower().lstrip(".")


def _whole(spark: SparkSession, path: str) -> str:
    """A path as Spark's readers name it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def read(spark: SparkSession, paths: list[str], src: str | None = None, tgt: str | None = None, rules: dict | None = None, options: dict | None = None) -> DataFrame:
    """Units of memories, and of bilingual documents after alignment, in the order of the paths; label
    tells the file, ord the place in the whole. Files of a kind are read together."""
    by_kind: dict[str, list[tuple[str, int, str]]] = {}
    for i, (path, label) in enumerate(zip(paths, labels(paths))):
        kind = _kind(path)
        if "://" not in path and not os.path.exists(path):
            raise FileNotFoundError(f"no such file: {path}")
        if kind not in source.UNITS and kind not in source.PARAGRAPHS:
            raise ValueError(f"{path}: not a kind of file that can be read")
        if kind not in source.UNITS and (not src or not tgt):
            raise ValueError(f"{path}: both languages are needed")
        by_kind.setdefault(kind, []).append((_whole(spark, path), i, label))
    out = None
    for kind, files in by_kind.items():
        names = sorted({f[0] for f in files})
        if kind in source.UNITS:
            langs = {k: v for k, v in (("src_lang", src), ("tgt_lang", tgt)) if v} if kind == "tmx" else {}
            d = source.read_units(spark, names, **langs)
        else:
            d = align.align(source.read_paragraphs(spark, names, **(options or {})), src, tgt, rules)
        place = spark.createDataFrame([(p.split(":", 1)[-1].lstrip("/"), i, label) for p, i, label in files], "_path string, _ord int, label string")
        d = d.withColumn("_path", F.regexp_replace("source_file", "^[a-zA-Z0-9+.-]*:/*", "")).drop("file_ord", "label").join(F.broadcast(place), "_path").drop("_path").withColumnRenamed("_ord", "file_ord")  # a row a file
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    for c in ("created_at", "modified_at", "domain"):
        out = out if c in out.columns else out.withColumn(c, F.lit(None).cast("string"))
    out = out if "para_ord" in out.columns else out.withColumn("para_ord", F.lit(0))
    order = ["file_ord", "para_ord", "unit_ord"]
    return numbered(out, [F.coalesce(F.col(c), F.lit(0)).cast("long") for c in order], "ord").withColumn("unit_ord", F.col("ord")).drop("para_ord")


def write(units: DataFrame, path: str, order: list[str], src: str | None = None, tgt: str | None = None) -> int:
    """A memory or a table, by the path's extension. Gives the number of units written."""
    kind = _kind(path)
    if kind in ("tmx", "sdltm"):
        if not src or not tgt:
            first = units.orderBy(*order).select("src_lang", "tgt_lang").first() or ("und", "und")
            src, tgt = src or first[0], tgt or first[1]
        return (sink.write_tmx if kind == "tmx" else sink.write_sdltm)(units, path, order, src, tgt)
    if kind == "jsonl":
        return sink.write_jsonl_file(jsonl_rows(units, *order), path, order)
    if kind == "csv":
        return sink.write_csv(review_rows(units.orderBy(*order), order[-1]), path, numbered=True)
    raise ValueError(f"{path}: not a kind of file that can be written")


def say(**values) -> None:
    print(" ".join(f"{k}={v}" for k, v in values.items()))


def _share(flagged: int, total: int) -> str:
    return f"{flagged} ({100 * flagged / max(total, 1):.1f}%)"


def _report(args, make) -> None:
    if args.report:
        sink.write_report(make(), args.report)


def convert_file(spark, path: str, base: str, src: str | None = None, tgt: str | None = None, formats: tuple[str, ...] = ("sdltm", "tmx", "csv"), rules: dict | None = None, options: dict | None = None, check: bool = False, least: float = 0.0) -> dict:
    """Reads a file, aligns it if it isn't a memory, and writes base.<format> for each format.

    check: tables have the quality checks' columns; least: memories have units of that confidence and more.
    Gives units, exported, length_ratio, and written: {path: units}."""
    if any(os.path.abspath(f"{base}.{kind}") == os.path.abspath(path) for kind in formats):
        raise ValueError(f"the input {path} would be overwritten; give --output")
    units = read(spark, [path], src, tgt, rules, options)
    ratio = qa.length_ratio(units).first()[0]
    d = (qa.check(units, ratio) if check or least > 0 else units).persist()
    good, written = qa.confident(d, least) if least > 0 else d, {}
    for kind in formats:
        written[f"{base}.{kind}"] = write(d if kind == "csv" else good, f"{base}.{kind}", ORDER, src, tgt)
    return {"units": d.count(), "exported": good.count(), "length_ratio": ratio, "written": written}


def convert(spark, a) -> int:
    rules = json.load(open(a.repair, encoding="utf-8")) if a.repair else None
    options = {"layout": a.layout} if _kind(a.input) == "docx" else {}
    base = a.output or os.path.splitext(a.input)[0]
    got = convert_file(spark, a.input, base, a.src, a.tgt, tuple(a.formats.split(",")), rules, options, a.qa, a.min_confidence)
    say(Units=got["units"], Exported=got["exported"], LengthRatio=f"{got['length_ratio']:.3f}")
    for path, n in got["written"].items():
        print(f"Wrote {path} ({n} units)")
    return 0


def clean(spark, a) -> int:
    d = corpus.clean(read(spark, [a.input]), not a.no_normalize, not a.no_dedupe, not a.no_remove_empty, a.remove_identical).persist()
    r = corpus.clean_report(d).first()
    write(corpus.kept(d), a.output or a.input, ORDER)
    say(Input=r.input, Output=r.output, Duplicates=r.removed_duplicate, Empty=r.removed_empty, Identical=r.removed_identical, Normalized=r.normalized)
    return 0


def near(spark, a) -> int:
    units = read(spark, [a.input]).persist()
    found = near_dup.clusters(units, a.threshold, a.side, a.min_cluster_size).persist()
    r = near_dup.summarize(found).first()
    say(Clusters=r.clusters, UnitsInClusters=f"{r.units} (of {units.count()} total)")
    table = found.select("cluster_id", "cluster_size", "ord").join(units.select("ord", "src_text", "tgt_text", "source_file"), "ord").orderBy(F.desc("cluster_size"), "cluster_id", "ord").drop("ord")
    if a.export:
        sink.write_csv(table, a.export)
    _report(a, lambda: reports.of_near_duplicates(found))
    return 0


def merge(spark, a) -> int:
    units = read(spark, a.inputs).persist()
    merged = corpus.merge(units, a.strategy).persist()
    write(merged, a.output, ["merged_ord"])
    say(Input=units.count(), Output=merged.count(), ConflictsResolved=corpus.conflicts_resolved(units, a.strategy).first()[0], Strategy=a.strategy)
    return 0


def compare(spark, a) -> int:
    units, names = read(spark, a.inputs).persist(), labels(a.inputs)
    found = corpus.compare(units).persist()
    sizes = dict(units.groupBy("label").count().collect())  # one row a file
    alone = dict(found.filter("kind = 'unique'").groupBy(F.element_at("owners", 1)).count().collect())
    kinds = dict(found.groupBy("kind").count().collect())
    say(Inputs=len(names))
    for n in names:
        print(f"{n}: segments={sizes.get(n, 0)} unique={alone.get(n, 0)}")
    say(Shared=kinds.get("shared", 0), Conflicts=kinds.get("conflict", 0))
    table = corpus.conflict_table(units, names).orderBy("source")
    if a.export:
        sink.write_csv(table, a.export)
    _report(a, lambda: reports.of_comparison(units, names))
    return 2 if a.fail_on_conflicts and kinds.get("conflict") else 0


def stats(spark, a) -> int:
    units = read(spark, a.inputs).persist()
    r = corpus.stats(units).first().asDict()
    say(**{k.title().replace("_", ""): v for k, v in r.items()}, LengthRatio=f"{qa.length_ratio(units).first()[0]:.3f}")
    for y in corpus.aging(units).orderBy("year").collect():  # one row a year
        print(f"{y.year}: {y.units}")
    table = corpus.by_domain(units).orderBy("pair", "domain")
    for d in table.collect():  # one row a pair and domain
        print(f"{d.pair} {d.domain}: {d.units}")
    _report(a, lambda: reports.of_statistics(units))
    return 0


def check(spark, a) -> int:
    d = qa.check(read(spark, [a.input]))
    d = review.attach(d, review.load(a.semantic_review)) if a.semantic_review else d
    d = d.persist()
    t, by = qa.totals(d).first(), dict(qa.by_type(d).collect())  # twelve rows at most
    say(Total=t.total, Flagged=_share(t.flagged, t.total))
    lines = [f"{c}: {by[c]}" for c in ISSUES if c in by]
    print(*lines, sep="\n", end="\n" if lines else "")
    if a.semantic_review:
        print(f"Semantic flagged={d.filter(F.size('semantic_issues') > 0).count()}")
    if a.export:
        write(d, a.export, ORDER)
    _report(a, lambda: reports.of_review(d, ORDER) if a.bilingual else reports.of_checks(d))
    return 2 if a.fail_on_issues and t.flagged else 0


def matches(spark, a) -> int:
    d = leverage.analyze(read(spark, [a.tm]), read(spark, [a.input], a.src, a.tgt), a.min_match / 100).persist()
    bands = leverage.summarize(d).orderBy("band_ord").collect()
    say(Total=sum(b.segments for b in bands), Words=sum(b.words for b in bands))
    for b in bands:
        if b.segments:
            print(f"{b.band}: segments={b.segments} words={b.words}")
    if a.export:
        write(d, a.export, ORDER)
    _report(a, lambda: reports.of_matches(d))
    return 0


def quote(spark, a) -> int:
    card, names = weights(a.weights), labels(a.inputs)
    got = leverage.quote(read(spark, [a.tm]), read(spark, a.inputs, a.src, a.tgt), "label", card).persist()
    each = got.collect()  # seven rows a file
    rows = []
    for name in [*names, None]:
        mine = {r.band: r for r in each if r.file == name}
        sums = [sum(getattr(r, c) for r in mine.values()) for c in ("segments", "words", "weighted")]
        rows.append((name or "TOTAL", sums[0], sums[1], round(float(sums[2]), 1), *(mine[b].segments if b in mine else 0 for b in BANDS)))
    say(Files=len(names), Segments=rows[-1][1], Words=rows[-1][2], WeightedWords=f"{rows[-1][3]:.1f}")
    for r in rows[:-1]:
        print(f"{r[0]}: segments={r[1]} words={r[2]} weighted={r[3]:.1f}")
    table = spark.createDataFrame(rows, "file string, segments long, words long, weighted_words double, " + ", ".join(f"`{b}` long" for b in BANDS)).coalesce(1)
    if a.export:
        sink.write_csv(table, a.export)
    _report(a, lambda: reports.of_quote(got, names))
    return 0


def term_check(spark, a) -> int:
    units = read(spark, [a.input])
    d = terms.check(units, source.read_glossary(spark, a.glossary, a.src, a.tgt), a.check_approved).persist()
    total, flagged = d.count(), d.filter(F.size("term_issues") > 0).count()
    say(Total=total, Flagged=_share(flagged, total))
    by = dict(terms.check_summary(d).collect())  # two rows at most
    for status in ("forbidden", "approved"):
        if by.get(status):
            print(f"{status}: {by[status]}")
    if a.export:
        write(d, a.export, ORDER)
    _report(a, lambda: reports.of_terms(d))
    return 2 if a.fail_on_issues and flagged else 0


def term_extract(spark, a) -> int:
    got = terms.pairs(read(spark, [a.input]), a.src, a.tgt, a.min_freq, a.max_ngram, a.top_n, a.min_pair_freq).persist()
    n, paired = got.count(), got.filter("tgt_term <> ''").count()
    say(Candidates=n, Paired=_share(paired, n))
    print("Candidates are guesses: review the decisions before promoting them.")
    blank = F.lit("")
    sink.write_csv(got.orderBy("rank").select("src_term", "tgt_term", blank.alias("decision"), blank.alias("status"), blank.alias("domain"), blank.alias("note"), "src_freq", "pair_freq", "concentration"), a.output)
    return 0


def promote(spark, a) -> int:
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(a.input)
    got = terms.promote(rows, a.src, a.tgt)
    sink.write_glossary(got, a.output)
    say(Promoted=got.count(), Total=rows.count())
    return 0


def alignment(spark, a) -> int:
    d = qa.check(read(spark, [a.input], a.src, a.tgt)).persist()
    r = align.summarize(d).first()
    say(Units=r.total, Gaps=r.gaps, Flagged=r.flagged)
    for m in align.moves(d).orderBy("align_move").collect():  # eleven rows at most
        print(f"{m.align_move}: {m.units}")
    if a.export:
        write(d, a.export, ORDER)
    _report(a, lambda: reports.of_alignment(d))
    return 2 if a.fail_on_issues and (r.gaps or r.flagged) else 0


def batch(spark, a) -> int:
    """Alignment checks of many files; one that can't be read doesn't stop the others."""
    rows = source.read_paragraphs(spark, a.inputs, errors="report").persist()
    failed = rows.filter("error is not null").select(F.col("source_file").alias("path"), "error")
    checked = qa.check(align.align(rows.filter("error is null").drop("error"), a.src, a.tgt), within=("source_file",))
    summary = align.batch_summary(checked, failed, source.listed(spark, a.inputs))
    summary = summary.persist()
    r = align.batch_tallies(summary).first()
    say(Checked=r.checked, Failed=r.failed, NeedsReview=r.needs_review)
    if a.export:
        sink.write_csv(summary, a.export, ["file"])
    return 2 if a.fail_on_issues and (r.failed or r.needs_review) else 0


def preflight(spark, a) -> int:
    bad = 0
    for r in source.preflight(spark, a.inputs, a.src, a.tgt).orderBy("path").toLocalIterator():
        if r.error:
            raise ValueError(f"{r.path}: {r.error}")
        print(f"{r.path}: {r.best_layout} {r.best_score:.2f} (table {r.table_score:.2f}, numbered {r.numbered_score:.2f}, alternating {r.alternating_score:.2f})")
        print(*(r.issues or ["No issues found."]), sep="\n")
        bad += bool(r.issues)
    return 2 if a.fail_on_issues and bad else 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bitloom")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *names: str, langs: bool | None = None, out: str = "", **kw) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for n in names:
            c.add_argument(n, **({"nargs": "+"} if n == "inputs" else {}))
        if langs is not None:
            c.add_argument("--src", required=langs), c.add_argument("--tgt", required=langs)
        for flag in out.split():
            c.add_argument(flag, action="store_true") if flag.startswith("--fail") else c.add_argument(flag)
        return c

    c = command("convert", convert, "input", langs=True, out="--output --repair")
    c.add_argument("--formats", default="sdltm,tmx,csv"), c.add_argument("--qa", action="store_true"), c.add_argument("--min-confidence", type=float, default=0.0)
    c.add_argument("--layout", default="auto", choices=["auto", "table", "numbered", "alternating"])
    c = command("clean", clean, "input", out="--output")
    for flag in ("--no-normalize", "--no-dedupe", "--no-remove-empty", "--remove-identical"):
        c.add_argument(flag, action="store_true")
    c = command("near-dup", near, "input", out="--export --report")
    c.add_argument("--threshold", type=float, default=0.85), c.add_argument("--side", choices=["src", "tgt"], default="src"), c.add_argument("--min-cluster-size", type=int, default=2)
    c = command("merge", merge, "inputs")
    c.add_argument("--output", required=True), c.add_argument("--strategy", default="keep-all", choices=["keep-all", "prefer-first", "prefer-last", "prefer-newer"])
    command("compare", compare, "inputs", out="--export --report --fail-on-conflicts")
    command("stats", stats, "inputs", out="--report")
    c = command("qa", check, "input", out="--export --report --semantic-review --fail-on-issues")
    c.add_argument("--bilingual", action="store_true", help="the report shows the flagged units")
    c = command("leverage", matches, "input", langs=False, out="--export --report")
    c.add_argument("--tm", required=True), c.add_argument("--min-match", type=float, default=50)
    c = command("quote", quote, "inputs", langs=False, out="--export --report --weights")
    c.add_argument("--tm", required=True)
    c = command("term-check", term_check, "input", langs=True, out="--export --report --fail-on-issues")
    c.add_argument("--glossary", required=True), c.add_argument("--check-approved", action="store_true")
    c = command("term-extract", term_extract, "input", langs=True)
    c.add_argument("--output", required=True)
    for flag, n in (("--top-n", 100), ("--min-freq", 2), ("--max-ngram", 4), ("--min-pair-freq", 2)):
        c.add_argument(flag, type=int, default=n)
    c = command("term-extract-promote", promote, "input", langs=True)
    c.add_argument("--output", required=True)
    command("align", alignment, "input", langs=True, out="--export --report --fail-on-issues")
    command("align-batch", batch, "inputs", langs=True, out="--export --fail-on-issues")
    command("preflight", preflight, "inputs", langs=False, out="--fail-on-issues")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if getattr(args, "report", None):
            sink.report_kind(args.report)
        return args.run(SparkSession.builder.appName("bitloom").getOrCreate(), args)
    except (ValueError, OSError, PySparkException) as e:
        lines = [x.strip() for x in str(e).splitlines() if x.strip()]
        told = [x for x in lines if x.startswith(("ValueError: ", "pyspark.errors"))]
        print((told or lines or [type(e).__name__])[0].removeprefix("ValueError: "), file=sys.stderr)
        return 1
