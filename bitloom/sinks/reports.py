"""Reports: what the operators found as a title, summary lines and one table, to be written as HTML or PDF.

Tables are summaries, but for the review's, which shows flagged units up to ``REVIEWED`` and says so."""

from __future__ import annotations

import html
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.functions import text as X
from bitloom.operators import align, corpus, leverage, near_dup, qa, terms
from bitloom.schema import ISSUES

REVIEWED = 500


@dataclass
class Report:
    title: str
    lines: list[str]
    columns: list[str] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    marked: bool = False  # cells are HTML


def _share(n: int, total: int) -> str:
    return f"{n} ({100 * n / total if total else 0:.1f}%)"


def of_checks(checked: DataFrame) -> Report:
    total, by = qa.totals(checked).first(), dict(qa.by_type(checked).collect())  # a row a check
    return Report("QA Report", [f"Total segments: {total.total}", f"Flagged: {_share(total.flagged, total.total)}"], ["Issue type", "Count"], [(c, by[c]) for c in ISSUES if c in by])


def marked(text: str | None, issues: list[str]) -> str:
    """A text in HTML, with what the issues are about in spans of the class hl."""
    text, out, at = text or "", [], 0
    for a, b in X.issue_spans(text, issues):
        out += [html.escape(text[at:a]), '<span class="hl">', html.escape(text[a:b]), "</span>"]
        at = b
    return "".join([*out, html.escape(text[at:])])


def of_review(checked: DataFrame, order: list[str]) -> Report:
    total = qa.totals(checked).first()
    lines = [f"Total segments: {total.total}", f"Flagged: {total.flagged}"]
    if total.flagged > REVIEWED:
        lines.append(f"Showing first {REVIEWED} of {total.flagged} flagged segments (see CSV export for the full list)")
    rows = qa.review(checked, order, REVIEWED).select("src_text", "tgt_text", "qa_issues").collect()
    return Report("Bilingual Review", lines, ["Source", "Target", "Issues"], [(marked(s, i), marked(t, i), ", ".join(i)) for s, t, i in rows], True)


def of_matches(analyzed: DataFrame) -> Report:
    bands = leverage.summarize(analyzed).orderBy("band_ord").collect()  # a row a band
    return Report("Leverage Analysis", [f"Total segments: {sum(b.segments for b in bands)}", f"Total words: {sum(b.words for b in bands)}"], ["Band", "Segments", "Words"], [(b.band, b.segments, b.words) for b in bands])


def of_near_duplicates(found: DataFrame) -> Report:
    r = near_dup.summarize(found).first()
    return Report("Near-Duplicate Clusters", [f"Clusters found: {r.clusters}", f"Units in a cluster: {r.units}"])


def of_quote(quoted: DataFrame, files: list[str]) -> Report:
    """quoted: leverage.quote's rows, a row a file and band."""
    got = {f: (0, 0, 0.0) for f in [*files, None]}
    for r in quoted.groupBy("file").agg(F.sum("segments"), F.sum("words"), F.sum("weighted")).collect():
        got[r[0]] = (r[1], r[2], float(r[3]))
    total = got[None]
    lines = [f"Files: {len(files)}", f"Total segments: {total[0]}", f"Total words: {total[1]}", f"Weighted words: {total[2]:.1f}"]
    return Report("Quote Estimate", lines, ["File", "Words", "Weighted words"], [(f, got[f][1], f"{got[f][2]:.1f}") for f in files])


def of_alignment(checked: DataFrame) -> Report:
    r = align.summarize(checked).first()
    lines = [f"Total segments: {r.total}", f"Gaps (no corresponding sentence): {r.gaps}", f"QA-flagged: {r.flagged}"]
    rows = align.moves(checked).withColumn("label", align.move_label(F.col("align_move"))).orderBy("align_move").collect()  # a row a move
    return Report("Alignment Check", lines, ["Move type", "Segments"], [(f"{m.align_move}（{m.label}）", m.units) for m in rows])


def of_terms(checked: DataFrame, most: int = 10_000) -> Report:
    """most: rows of the table; the most frequent hits."""
    r = checked.agg(F.count("*").alias("total"), F.count_if(F.size("term_issues") > 0).alias("flagged")).first()
    names = {"forbidden": "Forbidden", "approved": "Approved missing"}
    rows = [(h.src_term, h.tgt_term, names.get(h.status, h.status), h.hits) for h in terms.hit_table(checked).limit(most).collect()]
    return Report("Term-Consistency Check", [f"Total segments: {r.total}", f"Flagged: {_share(r.flagged, r.total)}"], ["Source term", "Target term", "Status", "Hits"], rows)


def of_comparison(units: DataFrame, labels: list[str], most: int = 10_000) -> Report:
    """most: rows of the table of conflicts, by source; the count is of all."""
    found = corpus.compare(units)
    sizes = dict(units.groupBy("label").count().collect())  # a row a file
    alone = dict(found.filter("kind = 'unique'").groupBy(F.element_at("owners", 1)).count().collect())
    kinds = dict(found.groupBy("kind").count().collect())
    lines = [f"Inputs: {len(labels)}", *(f"{x}: {sizes.get(x, 0)} segments, {alone.get(x, 0)} unique to this TM" for x in labels)]
    lines += [f"Shared: {kinds.get('shared', 0)}", f"Conflicts: {kinds.get('conflict', 0)}"]
    rows = [tuple(r) for r in corpus.conflict_table(units, labels).orderBy("source").limit(most).collect()]
    return Report("TM Comparison", lines, ["Source", *labels], rows)


def of_statistics(units: DataFrame) -> Report:
    s, ratio = corpus.stats(units).first(), qa.length_ratio(units).first()[0]
    lines = [f"Total segments: {s.total}", f"Unique pairs: {s.unique}", f"Duplicates: {_share(s.duplicate, s.total)}", f"Empty source: {s.empty_source}", f"Empty target: {s.empty_target}", f"Length ratio (src/tgt chars): {ratio:.3f}"]
    domains = corpus.by_domain(units).orderBy("pair", "domain").collect()  # a row a language pair and domain
    pairs: dict[str, int] = {}
    for r in domains:
        pairs[r["pair"]] = pairs.get(r["pair"], 0) + r.units
    rows = [("Language pair", p, n) for p, n in sorted(pairs.items())]
    rows += [("Aging (modified_at year)", r.year, r.units) for r in corpus.aging(units).orderBy("year").collect()]
    rows += [("Language pair x domain", f"{r['pair']} / {r.domain}", r.units) for r in domains]
    return Report("Corpus Inventory", lines, ["Breakdown", "Key", "Count"], rows)

