"""Single-file formats, written in corpus order from a streaming iterator and moved into place when whole; or, by
``write_set``, as a set of files of some thousand rows each, which the tasks write that hold the rows."""

from __future__ import annotations

import contextlib
import csv
import functools
import html
import itertools
import json
import os
import re
import shutil
import sqlite3
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions.text import fnv1a64_of
from bitloom.sinks import pdf
from bitloom.sinks.sdltm_tables import SCHEMA

_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def xml_text(t: str) -> str:
    return escape(_CONTROL.sub("�", t))


@contextlib.contextmanager
def placed(path: str) -> Iterator[str]:
    """A local file to write, which takes the place of path when it is whole; a path with a scheme is in a
    store, where Spark's file systems put it."""
    if not re.match(r"[a-zA-Z][a-zA-Z0-9+.\-]+:/", path):
        yield f"{path}.part"
        os.replace(f"{path}.part", path)
        return
    with tempfile.TemporaryDirectory() as folder:
        yield (part := os.path.join(folder, "part"))
        spark = SparkSession.active()
        of = spark._jvm.org.apache.hadoop.fs.Path
        of(path).getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(True, True, of(f"file:{part}"), of(path))


def _put(path: str, lines: Iterable[str], bom: bool = False) -> None:
    with placed(path) as part, open(part, "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as f:
        f.writelines(lines)


def _rows(df: DataFrame, order: list[str]):
    return (df.orderBy(*order) if order else df).toLocalIterator(prefetchPartitions=True)


def _dicts(df: DataFrame, order: list[str]) -> Iterator[dict]:
    return (r.asDict() for r in _rows(df, order))


def _put_tmx(rows: Iterable[dict], path: str, src_lang: str, tgt_lang: str) -> int:
    n = 0

    def seg(text: str, markup) -> str:
        return "".join(m["content"] if m["kind"] == "tag" else xml_text(m["content"]) for m in markup) if markup else xml_text(text)

    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<tmx version="1.4">\n<header creationtool="bitloom" creationtoolversion="1" segtype="sentence" o-tmf="none" adminlang="en" srclang={quoteattr(src_lang)} datatype="plaintext"/>\n<body>\n')
        for d in rows:
            if (d["src_text"] or "").strip() and (d["tgt_text"] or "").strip():
                n += 1
                changed = f" changedate={quoteattr(d['modified_at'])}" if d.get("modified_at") else ""
                f.write(f"<tu{changed}>" + "".join(f"<tuv xml:lang={quoteattr(lang)}><seg>{seg(d[f'{side}_text'], d.get(f'{side}_markup'))}</seg></tuv>" for side, lang in (("src", src_lang), ("tgt", tgt_lang))) + "</tu>\n")
        f.write("</body>\n</tmx>\n")
    return n


def write_tmx(units: DataFrame, path: str, order: list[str], src_lang: str, tgt_lang: str) -> int:
    """Units with both sides; markup as it is, else escaped text. Gives the number written."""
    with placed(path) as part:
        return _put_tmx(_dicts(units, order), part, src_lang, tgt_lang)


def write_csv(df: DataFrame, path: str, order: list[str] | None = None, bom: bool = True, numbered: bool = False) -> int:
    """All rows with a header; numbered: the first column counts from 1. Gives the number of rows."""
    n = 0

    class Line(list):
        write = list.append

    def lines():
        nonlocal n
        out = Line()
        w = csv.writer(out, lineterminator="\r\n")
        w.writerow(df.columns)
        for r in _rows(df, order or []):
            n += 1
            w.writerow([n, *("" if x is None else x for x in r[1:])] if numbered else ["" if x is None else x for x in r])
            yield from out
            out.clear()
        yield from out

    _put(path, lines(), bom)
    return n


def write_jsonl_file(rows: DataFrame, path: str, order: list[str]) -> int:
    """One JSON object a line, without the columns of the order. Gives the number of lines."""
    n = 0

    def lines():
        nonlocal n
        for r in _rows(rows, order):
            n += 1
            yield json.dumps({k: v for k, v in r.asDict().items() if k not in order}, ensure_ascii=False) + "\n"

    _put(path, lines())
    return n


#: Accepted forms of times, and the memory format's constants.
TIMES = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S.%f", "%Y%m%dT%H%M%SZ")
PARAMETERS = {"VERSION": "8.06", "FREQUENCYTOP": "1000", "LAST_ANALYZE": "0", "TokenDataVersion": "1", "AlignmentDataVersion": "1", "VERSION_CREATED": "8.12"}
OF_MEMORY = ("VERSION", "FREQUENCYTOP", "LAST_ANALYZE")  # the others have no memory
SETTINGS, INDEXES, FLAGS, EXPIRY = 127, 9, 131073, "9999-12-31 23:59:59"
USER = "bitloom"
XSI, XSD = "http://www.w3.org/2001/XMLSchema-instance", "http://www.w3.org/2001/XMLSchema"


@functools.lru_cache(1 << 16)
def _retimed(value: str, form: str) -> str | None:
    for known in TIMES:
        try:
            return datetime.strptime(value, known).strftime(form)
        except ValueError:
            continue
    return None


def retimed(value: str | None, form: str, otherwise: str) -> str:
    """A time in another form; otherwise where it is missing or can't be read."""
    return _retimed(value.strip(), form) or otherwise if value else otherwise


def _full(units: DataFrame) -> DataFrame:
    """Units with both sides."""
    return units.filter(r"src_text rlike '\\S' and tgt_text rlike '\\S'")


def _put_sdltm(rows: Iterable[dict], path: str, src_lang: str, tgt_lang: str, title: str) -> int:
    form = "%Y-%m-%d %H:%M:%S"
    now, n = datetime.now(UTC).strftime(form), 0

    def segment(text: str, lang: str) -> str:
        return f'<Segment xmlns:xsi="{XSI}" xmlns:xsd="{XSD}"><Elements><Text><Value>{xml_text(text)}</Value></Text></Elements><CultureName>{xml_text(lang)}</CultureName></Segment>'

    if os.path.exists(path):
        os.remove(path)
    db = sqlite3.connect(path)

    def put(table: str, row: dict) -> None:
        db.execute(f"INSERT INTO {table} ({', '.join(row)}) VALUES ({', '.join('?' * len(row))})", (*row.values(),))

    try:
        db.execute("PRAGMA page_size = 8192")
        db.execute("PRAGMA synchronous = OFF")  # a file takes its place when it is whole
        db.execute("PRAGMA journal_mode = MEMORY")
        db.executescript(f"BEGIN; {SCHEMA} COMMIT;")
        memory = {"id": 1, "guid": uuid.uuid4().bytes, "name": title, "source_language": src_lang, "target_language": tgt_lang, "settings": SETTINGS}
        put("translation_memories", memory | {"creation_user": USER, "creation_date": now, "expiration_date": EXPIRY, "fuzzy_indexes": INDEXES})
        for key, value in PARAMETERS.items():
            put("parameters", {"translation_memory_id": 1 if key in OF_MEMORY else None, "name": key, "value": value})
        put("attributes", {"guid": uuid.uuid4().bytes, "name": "StructureContext", "type": 2, "tm_id": 1})
        fixed = {"translation_memory_id": 1, "usage_counter": 0, "flags": FLAGS, "creation_user": USER, "change_user": USER, "last_used_date": now, "last_used_user": USER}

        def units() -> Iterator[tuple]:
            nonlocal n
            for d in rows:
                n += 1
                s, t, made = d["src_text"], d["tgt_text"], retimed(d.get("created_at"), form, now)
                yield (n, uuid.uuid4().bytes, fnv1a64_of(s), segment(s, src_lang), fnv1a64_of(t), segment(t, tgt_lang), made, retimed(d.get("modified_at"), form, made), *fixed.values())

        own = ("id", "guid", "source_hash", "source_segment", "target_hash", "target_segment", "creation_date", "change_date", *fixed)
        db.executemany(f"INSERT INTO translation_units ({', '.join(own)}) VALUES ({', '.join('?' * len(own))})", units())
        db.execute("UPDATE translation_memories SET tucount = ?", (n,))
        db.commit()
    finally:
        db.close()
    return n


def write_sdltm(units: DataFrame, path: str, order: list[str], src_lang: str, tgt_lang: str, name: str | None = None) -> int:
    """Units with both sides as an SQLite memory with all tables of the format; each unit gets a new id.
    Gives the number written."""
    with placed(path) as part:
        return _put_sdltm(_dicts(_full(units), order), part, src_lang, tgt_lang, name or os.path.splitext(os.path.basename(path))[0][:80])


def _put_xlsx(rows: Iterable[dict], path: str, columns: list[str]) -> int:
    n = 0
    kinds, main = "application/vnd.openxmlformats-officedocument.spreadsheetml", "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    packed = "http://schemas.openxmlformats.org/package/2006"
    link = lambda kind, target: f'<Relationships xmlns="{packed}/relationships"><Relationship Id="rId1" Type="{rel}/{kind}" Target="{target}"/></Relationships>'
    row = lambda values: "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{xml_text("" if v is None else str(v))}</t></is></c>' for v in values) + "</row>"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{packed}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", link("officeDocument", "xl/workbook.xml"))
        z.writestr("xl/_rels/workbook.xml.rels", link("worksheet", "worksheets/sheet1.xml"))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<worksheet xmlns="{main}"><sheetData>{row(columns)}'.encode())
            for d in rows:
                n += 1
                f.write(row(d[c] for c in columns).encode())
            f.write(b"</sheetData></worksheet>")
    return n


def write_xlsx(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """All rows with a header on one sheet, as text."""
    with placed(path) as part:
        _put_xlsx(_dicts(df, order or []), part, df.columns)


def glossary_table(entries: DataFrame) -> DataFrame:
    """The columns of a glossary's table, and entry_ord."""
    return entries.selectExpr("entry_ord", "src_term", "tgt_term", "if(status_declared, status, '') as status", "domain", "note")


def write_glossary(entries: DataFrame, path: str) -> None:
    """.xlsx, or CSV."""
    (write_xlsx if path.lower().endswith(".xlsx") else write_csv)(glossary_table(entries).orderBy("entry_ord").drop("entry_ord"), path)


def _put_tbx(rows: Iterable[dict], path: str) -> int:
    def one(d: dict) -> str:
        note = f"<note>{xml_text(d['note'])}</note>" if d["note"] else ""
        status = f'<termNote type="administrativeStatus">{"deprecatedTerm-admn-sts" if d["status"] == "forbidden" else "preferredTerm-admn-sts"}</termNote>' if d["status_declared"] else ""
        field = f'<descrip type="subjectField">{xml_text(d["domain"])}</descrip>' if d["domain"] else ""
        return f'<termEntry>{field}<langSet xml:lang={quoteattr(d["src_lang"])}><tig><term>{xml_text(d["src_term"])}</term></tig></langSet><langSet xml:lang={quoteattr(d["tgt_lang"])}><tig><term>{xml_text(d["tgt_term"])}</term>{status}{note}</tig></langSet></termEntry>\n'

    n = 0
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n<martif type="TBX-Basic" xml:lang="en"><martifHeader><fileDesc><sourceDesc><p>glossary</p></sourceDesc></fileDesc></martifHeader><text><body>\n')
        for d in rows:
            n += 1
            f.write(one(d))
        f.write("</body></text></martif>\n")
    return n


def write_tbx(entries: DataFrame, path: str) -> None:
    with placed(path) as part:
        _put_tbx(_dicts(entries, ["entry_ord"]), part)


def _put_csv(rows: Iterable[dict], path: str, columns: list[str]) -> int:
    n = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f, lineterminator="\r\n")
        w.writerow(columns)
        for d in rows:
            n += 1
            w.writerow("" if d[c] is None else d[c] for c in columns)
    return n


# sets of files

SET_ROWS = 10_000  # of a file of a set
_KINDS = {"tmx": _put_tmx, "sdltm": _put_sdltm, "xlsx": _put_xlsx, "csv": _put_csv, "tbx": _put_tbx}


def ship(local: str, path: str) -> None:
    """Moves a file to a path that all machines share, from any of them; it takes its place when it is whole."""
    if m := re.match(r"([a-zA-Z][a-zA-Z0-9+.\-]+):/", path):
        if m[1] != "file":
            from pyarrow import fs

            store, at = fs.FileSystem.from_uri(re.sub(r"\As3[an]:", "s3:", path))
            with open(local, "rb") as f, store.open_output_stream(f"{at}.part") as out:
                shutil.copyfileobj(f, out)
            store.move(f"{at}.part", at)
            os.remove(local)
            return
        path = re.sub(r"\Afile:/+", "/", path)
    part = f"{path}.{uuid.uuid4().hex}.part"  # tries of a task don't meet
    shutil.copyfile(local, part)
    os.remove(local)
    os.replace(part, path)


def write_set(df: DataFrame, folder: str, order: list[str], kind: str, rows: int = SET_ROWS, **options) -> list[tuple[str, int]]:
    """The rows of df in the order as files of a kind (tmx, sdltm, tbx, or tables: xlsx, csv) of up to ``rows`` rows, each
    whole by itself, written by the tasks that hold the ranges of the order. Gives the files' names, which are in
    the order, and how many rows were written to those before; the driver sees no more of them.

    options: src_lang and tgt_lang of units; columns of tables."""
    put = functools.partial(_KINDS[kind], **options | ({"title": "memory"} if kind == "sdltm" else {}))
    if kind == "sdltm":
        df = _full(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (d for b in batches for d in b.to_pylist())
        with tempfile.TemporaryDirectory() as own:
            for k in itertools.count():
                if (first := next(stream, None)) is None:
                    break
                name = f"part-{TaskContext.get().partitionId():06d}-{k:06d}.{kind}"
                n = put(itertools.chain([first], itertools.islice(stream, rows - 1)), f"{own}/{name}")
                ship(f"{own}/{name}", f"{folder}/{name}")
                yield pa.RecordBatch.from_pydict({"name": [name], "n": [n]}, pa.schema([("name", pa.string()), ("n", pa.int64())]))

    parts = max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows)))
    written = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, "name string, n long").collect()  # a row a file
    if not written:
        with placed(f"{folder}/part-000000-000000.{kind}") as part:
            put((), part)
        return [(f"part-000000-000000.{kind}", 0)]
    written = sorted(map(tuple, written))
    return list(zip((name for name, _ in written), itertools.accumulate((n for _, n in written), initial=0)))


def report_kind(path: str) -> str:
    kind = os.path.splitext(path)[1].lower()
    if kind not in (".html", ".htm", ".pdf"):
        raise ValueError(f"a report is .html or .pdf, not {kind!r}")
    return kind


def write_report(report, path: str) -> None:
    """A reports.Report as HTML or PDF, by the path's extension."""
    if report_kind(path) == ".pdf":
        if report.marked:
            raise ValueError("this report is HTML only")
        with placed(path) as part:
            pdf.put(report.title, report.lines, report.columns, report.rows, part)
        return
    text = lambda x: html.escape("" if x is None else str(x))
    cell = lambda tag, x: f"<{tag}>{x}</{tag}>"
    body = "".join(f"<tr>{''.join(cell('td', x if report.marked else text(x)) for x in r)}</tr>\n" for r in report.rows)
    head = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{text(report.title)}</title><style>.hl{{background:#ffe08a}}</style></head><body><h1>{text(report.title)}</h1>\n'
    table = f"<table><tr>{''.join(cell('th', text(c)) for c in report.columns)}</tr>\n{body}</table>" if report.rows else ""
    _put(path, [head, *(cell("p", text(x)) + "\n" for x in report.lines), table, "</body></html>\n"])
