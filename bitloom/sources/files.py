"""Bilingual files as DataFrames.

Files come in through Spark's binaryFile reader, so any store that Spark reads will do and each file is
parsed by one task, its rows passed on in pieces; they are numbered within it, and files by the order of
their paths, directory by directory. A file that can't be parsed fails the read, or, with errors="report",
gives one row with its error. What a file has that isn't taken in is told by ``warnings``, a table of its own.
Readers of further kinds of files are added by ``register``.
"""

from __future__ import annotations

import csv
import io
import re
import sqlite3
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions.text import is_cjk
from bitloom.schema import GLOSSARY, PARAGRAPH, UNIT

Rows = Iterator[dict]
#: The name of the value by which a parser's row is a warning and no row of the file's.
WARNING = "warning"
PIECE = 5000  # rows of a file that are passed on at once


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _each(source, *names: str) -> Iterator[ET.Element]:
    """The elements of these names, one after the other: each is taken out of the tree when the next one is asked for."""
    above = []
    for event, e in ET.iterparse(source, ("start", "end")):
        if event == "start":
            above.append(e)
            continue
        above.pop()
        if _local(e.tag) in names:
            yield e
            e.clear()
            if above:
                above[-1].remove(e)


# translation memories


def _segment(seg: ET.Element) -> tuple[str, list[dict] | None]:
    """A seg's text, inline content included, and its nodes if it has any."""
    text = "".join(seg.itertext()).strip()
    if not len(seg):
        return text, None
    nodes = [{"kind": "text", "content": seg.text or ""}]
    for child in seg:
        tail, child.tail = child.tail or "", None
        nodes += [{"kind": "tag", "content": ET.tostring(child, encoding="unicode", short_empty_elements=False)}, {"kind": "text", "content": tail}]
    while nodes and nodes[0]["kind"] == "text" and not nodes[0]["content"].strip():
        nodes.pop(0)
    while nodes and nodes[-1]["kind"] == "text" and not nodes[-1]["content"].strip():
        nodes.pop()
    return text, [n for n in nodes if n["content"]]


def _pick(found: list[tuple[str, ET.Element]], lang: str) -> tuple[str, ET.Element] | None:
    low = lang.lower()
    exact = [x for x in found if x[0].lower() == low]
    base = [x for x in found if x[0].lower().split("-")[0] == low.split("-")[0]]
    return next(iter(exact or base), None)


def tmx(data: bytes, src_lang: str | None = None, tgt_lang: str | None = None) -> Rows:
    for tu in _each(io.BytesIO(data), "tu"):
        found = []
        for tuv in (x for x in tu if _local(x.tag) == "tuv"):
            lang = next((v for k, v in tuv.attrib.items() if _local(k) == "lang"), "")
            if (seg := next((x for x in tuv if _local(x.tag) == "seg"), None)) is not None:
                found.append((lang, seg))
        if len(found) >= 2:
            src = _pick(found, src_lang) if src_lang else found[0]
            tgt = _pick(found, tgt_lang) if tgt_lang else found[1]
            if src and tgt:
                (s, sm), (t, tm) = _segment(src[1]), _segment(tgt[1])
                yield {"src_lang": src_lang or src[0], "tgt_lang": tgt_lang or tgt[0], "src_text": s, "tgt_text": t, "src_markup": sm, "tgt_markup": tm, "created_at": tu.get("creationdate"), "modified_at": tu.get("changedate")}


#: A segment of plain text alone, as most are: an XML parser finds the same in it.
_PLAIN = re.compile(r'<Segment(?: xmlns:\w+="[^"<&]*")*><Elements><Text><Value>([\t\n\x20-%\'-;=?-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]*)</Value></Text></Elements><CultureName>([\w-]+)</CultureName></Segment>')


def sdltm(data: bytes) -> Rows:
    db = sqlite3.connect(":memory:")
    db.deserialize(data)

    def side(xml: str) -> tuple[str, str | None]:
        if m := _PLAIN.fullmatch(xml or ""):
            return m[1], m[2]
        value, names = "", []
        for x in ET.fromstring(xml).iter():
            if x.tag.endswith("Value") and _local(x.tag) == "Value":
                value += x.text or ""
            elif x.tag.endswith("CultureName") and _local(x.tag) == "CultureName":
                names.append(x.text)
        return value, names[0] if names else None

    try:
        langs = db.execute("SELECT source_language, target_language FROM translation_memories LIMIT 1").fetchone() or (None, None)
        for guid, s, t, made, changed in db.execute("SELECT guid, source_segment, target_segment, creation_date, change_date FROM translation_units ORDER BY id"):
            try:
                (src, sl), (tgt, tl) = side(s), side(t)
            except ET.ParseError as e:
                raise ValueError(f"a segment isn't XML: {e}") from e
            yield {"src_lang": sl or langs[0], "tgt_lang": tl or langs[1], "src_text": src, "tgt_text": tgt, "guid": guid.hex() if isinstance(guid, bytes) else guid, "created_at": made, "modified_at": changed}
    finally:
        db.close()


# paragraph pairs


def decoded(data: bytes) -> str:
    for code in ("utf-8-sig", "gb18030"):
        try:
            return data.decode(code)
        except UnicodeDecodeError:
            continue
    raise ValueError("neither UTF-8 nor GB18030")


def is_header(cells: list[str]) -> bool:
    return all(len(c) <= 20 and not re.search(r"[.!?。！？]", c) for c in cells)


def columns(n: int, src: int | None = None, tgt: int | None = None) -> tuple[int, int]:
    """Both of two columns, the last two of more; one that is named moves the other off its place."""
    if n < 2:
        raise ValueError("fewer than two columns")
    a, b = n - 2, n - 1
    if src is not None and tgt is None:
        return src, b if b != src else a
    if tgt is not None and src is None:
        return (a if a != tgt else b), tgt
    return (src, tgt) if src is not None else (a, b)


def _pairs(rows: list[list[str]], header: bool | None, src: int | None, tgt: int | None) -> Rows:
    a, b = columns(max(map(len, rows), default=0), src, tgt)
    skip = header if header is not None else bool(rows) and is_header([c for c in rows[0] if c])
    for i, r in enumerate(rows, 1):
        if not (i == 1 and skip):
            yield from _pair(str(i), *(r[x] if x < len(r) else "" for x in (a, b)))


def _pair(key: str, s: str, t: str) -> Rows:
    """A pair, or what is to be told of one with one side."""
    s, t = s.replace("\xa0", " ").strip(), t.replace("\xa0", " ").strip()
    if s and t:
        yield {"key": key, "src_text": s, "tgt_text": t}
    elif s or t:
        yield {WARNING: "one side only", "place": key}


def csv_pairs(data: bytes, delimiter: str | None = None, header: bool | None = None, src: int | None = None, tgt: int | None = None) -> Rows:
    text = decoded(data)
    if delimiter is None:
        try:
            delimiter = csv.Sniffer().sniff(text[:4096], ",\t;|").delimiter
        except csv.Error:
            delimiter = ","
    yield from _pairs(list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)), header, src, tgt)


#: Built-in number formats of workbooks that show days or times.
_DAYS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """The numbers of the cell styles that show days or times."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    codes = {int(x.get("numFmtId")): x.get("formatCode", "") for x in root.iter() if _local(x.tag) == "numFmt"}
    shows = lambda n: n in _DAYS or bool(re.search("[dmhysDMHYS]", re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]|General', "", codes.get(n, ""))))
    styles = next((x for x in root if _local(x.tag) == "cellXfs"), ())
    return {i for i, x in enumerate(styles) if shows(int(x.get("numFmtId", 0)))}


def _cell(kind: str | None, value: str, dated: bool, epoch: datetime) -> str:
    """A cell's value as text: numbers, truth values, days and times as Python prints them."""
    if kind == "b":
        return {"1": "True", "0": "False"}.get(value, value)
    if kind in (None, "n") and value:
        number = float(value)
        if dated:
            at = epoch + timedelta(milliseconds=round(number * 86_400_000))
            return str(at if number >= 1 else at.time())
        return str(int(number)) if number == int(number) and not re.search("[.eE]", value) else str(number)
    return value


def sheet_rows(data: bytes, sheet: str | None = None) -> list[list[str]]:
    """The cells of a workbook's sheet, the first one by default; rows at their own numbers."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml")) if _local(si.tag) == "si"]
    dated, book = _date_styles(z), ET.fromstring(z.read("xl/workbook.xml"))
    late = any(x.get("date1904") in ("1", "true") for x in book.iter() if _local(x.tag) == "workbookPr")
    epoch = datetime(1904, 1, 1) if late else datetime(1899, 12, 30)
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    names = {s.get("name"): next(v for k, v in s.attrib.items() if _local(k) == "id" and "}" in k) for s in book.iter() if _local(s.tag) == "sheet"}
    if sheet is not None and sheet not in names:
        raise ValueError(f"no sheet {sheet!r}")
    path = targets[names[sheet] if sheet is not None else next(iter(names.values()))].lstrip("/")
    out: list[list[str]] = []
    for row in _each(z.open(path if path.startswith("xl/") else f"xl/{path}"), "row"):
        while len(out) < int(row.get("r", len(out) + 1)) - 1:
            out.append([])
        cells: list[str] = []
        for c in row:
            at = 0
            for ch in re.match(r"[A-Z]*", c.get("r", "")).group():
                at = at * 26 + ord(ch) - 64
            cells += [""] * (at - 1 - len(cells))
            kind, v = c.get("t"), next((x.text or "" for x in c if _local(x.tag) == "v"), "")
            text = shared[int(v)] if kind == "s" else "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t") if kind == "inlineStr" else None
            cells.append(_cell(kind, v, int(c.get("s", 0)) in dated, epoch) if text is None else text)
        out.append(cells)
    return out


def xlsx_pairs(data: bytes, sheet: str | None = None, header: bool | None = None, src: int | None = None, tgt: int | None = None) -> Rows:
    yield from _pairs(sheet_rows(data, sheet), header, src, tgt)


def _paragraph(p: ET.Element) -> str:
    return "".join({"t": x.text or "", "tab": "\t", "br": "\n"}.get(_local(x.tag), "") for x in p.iter()).replace(" ", " ").strip()


def document(data: bytes) -> tuple[list[str], list[list[list[str]]]]:
    """(paragraphs, tables as rows of cell texts) of a word-processing document."""
    body = next(x for x in ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")) if _local(x.tag) == "body")
    kids = lambda e, name: [x for x in e if _local(x.tag) == name]
    tables = [[["\n".join(x for p in c.iter() if _local(p.tag) == "p" and (x := _paragraph(p))) for c in kids(r, "tc")] for r in kids(t, "tr")] for t in kids(body, "tbl")]
    return [_paragraph(p) for p in body.iter() if _local(p.tag) == "p"], tables


_NUMBERED = re.compile(r"\A\[(\d+)\]\s*(.*)\Z", re.S)


def usable(tables: list[list[list[str]]]) -> list[tuple[list[tuple[int, str, str]], bool]]:
    """Tables of two columns or more with a full row, as (rows (number, source, target), has a header);
    the last two columns count."""
    out = []
    for t in tables:
        width = max(map(len, t), default=0)
        if width >= 2:
            a, b = columns(width)
            head = is_header(t[0])
            rows = [(i, r[a].strip() if a < len(r) else "", r[b].strip() if b < len(r) else "") for i, r in enumerate(t, 1)][head:]
            if any(s and x for _, s, x in rows):
                out.append((rows, head))
    return out


def confidences(paragraphs: list[str], tables: list[list[list[str]]]) -> dict[str, float]:
    """How far a document looks like each layout, in the order in which equal scores win."""
    found = usable(tables)
    numbers = [int(m[1]) for p in paragraphs if (m := _NUMBERED.match(p))]
    filled, ones = sum(map(bool, paragraphs)), numbers.count(1)
    # The scores of the three layouts.
    table = 0.0 if not found else 0.95 if len(found) > 1 or sum(bool(s and x) for _, s, x in found[0][0]) >= 4 else 0.85
    numbered = {0: 0.0, 1: 0.5, 2: 0.95 if len(numbers) >= 4 else 0.85}.get(ones, 0.7)
    return {"table": table, "numbered": numbered, "alternating": 0.5 if filled and filled % 2 == 0 else 0.0}


def layouts(paragraphs: list[str], tables: list[list[list[str]]]) -> dict[str, list[dict]]:
    """Each layout's pairs: tables' last two columns, [N] blocks joined on N, alternating paragraphs."""
    out: dict[str, list[dict]] = {"table": [], "numbered": [], "alternating": []}
    for n, (rows, _) in enumerate(usable(tables), 1):
        for i, s, x in rows:
            out["table"] += _pair(f"t{n}:{i}" if n > 1 else str(i), s, x)
    numbers = [(int(m[1]), m[2].strip()) for p in paragraphs if (m := _NUMBERED.match(p))]
    # the second language begins where 1 comes again, after the first number
    if second := next((i for i, (n, _) in enumerate(numbers) if i and n == 1), 0):
        s, t = dict(numbers[:second]), dict(numbers[second:])
        out["numbered"] = [{"key": str(n), "src_text": s[n], "tgt_text": t[n]} for n in sorted(s.keys() & t.keys())]
        out["numbered"] += [{WARNING: "number without a partner", "place": str(n)} for n in sorted(s.keys() ^ t.keys())]
    filled = [p for p in paragraphs if p]
    if filled and len(filled) % 2 == 0:
        out["alternating"] = [{"key": str(i // 2 + 1), "src_text": filled[i], "tgt_text": filled[i + 1]} for i in range(0, len(filled), 2)]
    return out


def docx_pairs(data: bytes, layout: str = "auto") -> Rows:
    parts = document(data)
    found = layouts(*parts)
    if layout == "auto":
        scores = confidences(*parts)
        layout = max(scores, key=scores.get)
    if not any(WARNING not in r for r in found[layout]):
        raise ValueError(f"no pairs in the layout {layout}")
    yield from found[layout]


#: A best layout below this score is ambiguous; characters of each side that the direction is judged on.
SURE, SAMPLE = 0.85, 500
_SCRIPT = re.compile("[一-鿿　-〿＀-￯]")


def inspected(data: bytes, src_lang: str | None = None, tgt_lang: str | None = None) -> dict:
    """What may go wrong with a document: unclear layout, merged cells, empty tables, sides that don't
    look like their languages."""
    paragraphs, tables = document(data)
    scores = confidences(paragraphs, tables)
    best = max(scores, key=scores.get)
    body = next(x for x in ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")) if _local(x.tag) == "body")
    merged = 0
    for cell in (x for t in body if _local(t.tag) == "tbl" for r in t if _local(r.tag) == "tr" for x in r if _local(x.tag) == "tc"):
        marks = {_local(m.tag): next(iter(m.attrib.values()), "") for pr in cell if _local(pr.tag) == "tcPr" for m in pr}
        merged += "vMerge" in marks or int(marks.get("gridSpan") or 1) > 1
    empty = sum(bool(t) and not any(c.strip() for r in t for c in r) for t in tables)
    sides = [" ".join(x for r in usable(tables)[:1] for x in (row[k] for row in r[0]) if x)[:SAMPLE] for k in (1, 2)]
    wrong = []
    for name, lang, text in zip(("source", "target"), (src_lang, tgt_lang), sides):
        solid = len(re.sub(r"\s", "", text))
        if lang and solid and ((cjk := len(_SCRIPT.findall(text)) / solid > 0.3) != is_cjk(lang)):
            wrong.append(f"the {name} column {'looks' if cjk else 'does not look'} CJK, but its language is {lang}")
    notes = [f"unclear layout: {best} at {scores[best]:.2f}"] * (scores[best] < SURE) + [f"{merged} merged cells"] * bool(merged) + [f"{empty} empty tables"] * bool(empty) + wrong
    return {"best_layout": best, "best_score": scores[best], **{f"{k}_score": v for k, v in scores.items()}, "ambiguous": scores[best] < SURE, "merged_cells": merged, "empty_tables": empty, "issues": notes}


# glossaries

#: Header names of glossary columns, and statuses of the exchange format.
COLUMNS = {"src_term": ("src_term", "source", "src", "source term", "原文", "源术语", "源语"), "tgt_term": ("tgt_term", "target", "tgt", "target term", "译文", "目标术语", "译语"), "status": ("status", "状态"), "domain": ("domain", "领域"), "note": ("note", "备注", "说明")}
FORBIDDEN = frozenset("forbidden deprecated deprecatedterm-admn-sts superseded supersededterm-admn-sts notrecommended obsolete".split())
APPROVED = frozenset("preferred preferredterm-admn-sts admitted admittedterm-admn-sts approved confirmed legalterm-admn-sts regulatedterm-admn-sts standardizedterm-admn-sts".split())


def _entry(status: str) -> dict:
    s = status.strip().lower()
    known = s in FORBIDDEN or s in APPROVED
    return {"status": "forbidden" if s in FORBIDDEN else "approved", "status_declared": known}


def glossary_rows(rows: list[list[str]], src_lang: str, tgt_lang: str) -> Rows:
    rows = [r for r in rows if any((c or "").strip() for c in r)]
    if not rows:
        return
    head = [(c or "").strip().lower() for c in rows[0]]
    at = {name: next((i for i, h in enumerate(head) if h in names), None) for name, names in COLUMNS.items()}
    if at["src_term"] is None or at["tgt_term"] is None:
        raise ValueError("no columns for source and target terms")
    get = lambda r, c: (r[at[c]] or "").strip() if at[c] is not None and at[c] < len(r) else ""
    for i, r in enumerate(rows[1:], 2):
        if get(r, "status") and not _entry(get(r, "status"))["status_declared"]:
            yield {WARNING: "unknown status", "place": str(i)}
        if get(r, "src_term") or get(r, "tgt_term"):
            yield {"src_lang": src_lang, "tgt_lang": tgt_lang, "src_term": get(r, "src_term"), "tgt_term": get(r, "tgt_term"), "domain": get(r, "domain") or None, "note": get(r, "note") or None, **_entry(get(r, "status"))}


def tbx(data: bytes, src_lang: str, tgt_lang: str) -> Rows:
    for entry in _each(io.BytesIO(data), "termEntry", "conceptEntry"):
        sides = {}
        for lang_set in (x for x in entry if _local(x.tag) in ("langSet", "langSec")):
            lang = next((v for k, v in lang_set.attrib.items() if _local(k) == "lang"), "")
            group = next((x for x in lang_set if _local(x.tag) in ("tig", "ntig", "termSec")), None)
            if group is not None:
                sides.setdefault(lang.lower().split("-")[0], (lang_set, group))
        s, t = (sides.get(x.lower().split("-")[0]) for x in (src_lang, tgt_lang))
        if not s or not t:
            continue

        def first(places: list[ET.Element], name: str, kind: str | None = None) -> str:
            for p in places:
                for x in p.iter() if p is not entry else p:
                    if _local(x.tag) == name and (kind is None or x.get("type") == kind) and (v := "".join(x.itertext()).strip()):
                        return v
            return ""

        status = first([t[1], s[1]], "termNote", "administrativeStatus")
        if status and not _entry(status)["status_declared"]:
            yield {WARNING: "unknown status", "place": first([s[1]], "term")}
        yield {"src_lang": src_lang, "tgt_lang": tgt_lang, "src_term": first([s[1]], "term"), "tgt_term": first([t[1]], "term"), "note": first([t[1], s[1]], "note") or None, "domain": first([t[1], s[1], t[0], s[0], entry], "descrip", "subjectField") or None, **_entry(status)}


# reading

UNITS: dict[str, Callable] = {"tmx": tmx, "sdltm": sdltm}
PARAGRAPHS: dict[str, Callable] = {"csv": csv_pairs, "tsv": csv_pairs, "xlsx": xlsx_pairs, "xlsm": xlsx_pairs, "docx": docx_pairs}


def register(kind: str, parser: Callable, units: bool = False) -> None:
    """Adds a reader of files by their extension: parser(content, **options) gives rows as dicts, of units
    or of paragraph pairs."""
    if not callable(parser) or not re.fullmatch(r"[a-z0-9]+", kind):
        raise ValueError("a reader is a function, and a kind the small letters of an extension")
    (UNITS if units else PARAGRAPHS)[kind] = parser


def _files(spark: SparkSession, paths: str | list[str], kinds) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else paths
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "content")
    return files.filter(~F.col("path").rlike(r"/[._][^/]*") & F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*kinds))


def _read(spark: SparkSession, paths: str | list[str], parsers: dict[str, Callable], schema, order: str, options: dict, errors: str) -> DataFrame:
    d = parsed(_files(spark, paths, parsers), parsers, schema, order, options, errors)
    names = d.sparkSession.createDataFrame(_ordered(_files(spark, paths, parsers)), "path string, file_ord int")
    d = d.drop("file_ord").join(names, "path").filter(F.col(WARNING).isNull())
    return d.select("error", *schema.fieldNames()) if errors == "report" else d.select(*schema.fieldNames())


def listed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path) of the bilingual documents at the paths."""
    return _files(spark, paths, PARAGRAPHS).select("path")


def _ordered(files: DataFrame) -> list[tuple[str, int]]:
    """Names, which a file system's listing brings to the driver anyhow, and their places: by the names of
    directories from the top, a directory's own files by theirs."""
    names = sorted((r.path for r in files.select("path").collect()), key=lambda p: p.split("/"))
    if not names:
        raise ValueError("no files of a kind that can be read")
    return [(p, i) for i, p in enumerate(names)]


def parsed(files: DataFrame, parsers: dict[str, Callable], schema, order: str, options: dict, errors: str = "fail") -> DataFrame:
    """(path, error, warning, *schema) of the rows in files (path, content), of a batch or a stream; the
    place of a warning is its row's first text column."""
    fields = ["path", "error", WARNING, "place", *schema.fieldNames()]
    wide = "path string, error string, warning string, place string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=fields).astype(object)
        for b in batches:
            for path, data in zip(b["path"], b["content"]):
                rows, n = [], 0
                try:
                    for r in parsers[path.rsplit(".", 1)[-1].lower()](bytes(data), **options):
                        rows.append(dict.fromkeys(fields) | r | {"path": path} | ({} if WARNING in r else {order: n}))
                        n += WARNING not in r
                        if len(rows) == PIECE and errors != "report":  # else a later error takes the file's rows back
                            yield frame(rows)
                            rows = []
                except Exception as e:
                    if errors != "report":
                        raise ValueError(f"{path}: {e}") from e
                    rows = [dict.fromkeys(fields) | {"path": path, "error": f"{type(e).__name__}: {e}"}]
                if rows:
                    yield frame(rows)

    d = files.select("path", "content").mapInPandas(run, wide)
    return d.withColumn("source_file", F.coalesce("source_file", "path")) if "source_file" in schema.fieldNames() else d


def warnings(spark: SparkSession, paths: str | list[str], src_lang: str = "und", tgt_lang: str = "und", glossary: bool = False, **options) -> DataFrame:
    """(path, warning, place): rows with one side, numbers without a partner, unknown statuses."""
    parsers, schema, order = (_glossary_parsers(), GLOSSARY, "entry_ord") if glossary else (PARAGRAPHS, PARAGRAPH, "para_ord")
    options |= {"src_lang": src_lang, "tgt_lang": tgt_lang} if glossary else {}
    d = parsed(_files(spark, paths, parsers), parsers, schema, order, options, "report")
    return d.filter(F.col(WARNING).isNotNull()).select("path", WARNING, "place")


def _glossary_parsers() -> dict[str, Callable]:

    def table(data: bytes, **kw) -> Rows:
        text = decoded(data)
        return glossary_rows(list(csv.reader(io.StringIO(text), delimiter="\t" if "\t" in text[:200] else ",")), **kw)

    sheet = lambda data, **kw: glossary_rows(sheet_rows(data), **kw)
    return {"csv": table, "tsv": table, "xlsx": sheet, "xlsm": sheet, "tbx": tbx}


def read_units(spark: SparkSession, paths: str | list[str], errors: str = "fail", **options) -> DataFrame:
    """Units of translation memories (.tmx, .sdltm)."""
    return _read(spark, paths, UNITS, UNIT, "unit_ord", options, errors)


def read_paragraphs(spark: SparkSession, paths: str | list[str], errors: str = "fail", **options) -> DataFrame:
    """Paragraph pairs of bilingual documents (.csv, .tsv, .xlsx, .xlsm, .docx)."""
    return _read(spark, paths, PARAGRAPHS, PARAGRAPH, "para_ord", options, errors)


def read_glossary(spark: SparkSession, paths: str | list[str], src_lang: str, tgt_lang: str) -> DataFrame:
    """Entries of glossaries (.csv, .tsv, .xlsx, .xlsm, .tbx)."""
    return _read(spark, paths, _glossary_parsers(), GLOSSARY, "entry_ord", {"src_lang": src_lang, "tgt_lang": tgt_lang}, "fail")


def preflight(spark: SparkSession, paths: str | list[str], src_lang: str | None = None, tgt_lang: str | None = None) -> DataFrame:
    """One row a document (.docx): scores of the layouts, merged cells, empty tables, issues; error where
    it can't be read."""
    return inspect(_files(spark, paths, ["docx"]), src_lang, tgt_lang)


def inspect(files: DataFrame, src_lang: str | None = None, tgt_lang: str | None = None) -> DataFrame:
    """preflight of files (path, content)."""
    schema = "path string, error string, best_layout string, best_score double, table_score double, numbered_score double, alternating_score double, ambiguous boolean, merged_cells int, empty_tables int, issues array<string>"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, data in zip(b["path"], b["content"]):
                try:
                    out.append(dict.fromkeys(names) | {"path": path} | inspected(bytes(data), src_lang, tgt_lang))
                except Exception as e:
                    out.append(dict.fromkeys(names) | {"path": path, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=names).astype(object)

    return files.mapInPandas(run, schema)
