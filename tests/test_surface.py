"""Memory and workbook writers, document preflight, the drop folder and the command line."""

import contextlib
import io
import json
import re
import sqlite3
import zipfile

import pytest

from bitloom import cli
from bitloom.sinks import files as out
from bitloom.sinks import pdf
from bitloom.sources import files as src
from bitloom.streaming import drop_folder

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _units(spark, *rows):
    return spark.createDataFrame([(0, i, "en-US", "zh-CN", s, t, m) for i, (s, t, m) in enumerate(rows)], "file_ord int, unit_ord long, src_lang string, tgt_lang string, src_text string, tgt_text string, modified_at string")


def _tmx(spark, path, *rows):
    out.write_tmx(_units(spark, *rows), str(path), ["unit_ord"], "en-US", "zh-CN")
    return str(path)


def _docx(path, body):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    path.write_bytes(z.getvalue())
    return str(path)


def _table(rows, extra=""):
    cell = lambda t: f"<w:tc>{extra}<w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    return "<w:tbl>" + "".join(f"<w:tr>{''.join(map(cell, r))}</w:tr>" for r in rows) + "</w:tbl>"


@pytest.mark.parametrize(("given", "want"), [("20240105T080910Z", "2024-01-05 08:09:10"), ("2024-01-05T08:09:10.5", "2024-01-05 08:09:10"), ("2024-01-05T08:09:10+02:00", "2024-01-05 08:09:10"), ("soon", "x"), (None, "x"), ("", "x")])
def test_times(given, want):
    assert out.retimed(given, "%Y-%m-%d %H:%M:%S", "x") == want


def test_memory_round_trip(spark, tmp_path):
    u = _units(spark, ("a <b> & c\x0c", "甲", "20240105T080910Z"), ("", "x", None), ("second", "乙", None))
    path = str(tmp_path / "m.sdltm")
    assert out.write_sdltm(u, path, ["unit_ord"], "en-US", "zh-CN") == 2
    got = src.read_units(spark, path).orderBy("unit_ord").collect()
    assert [(r.src_text, r.tgt_text, r.src_lang, r.tgt_lang) for r in got] == [("a <b> & c�", "甲", "en-US", "zh-CN"), ("second", "乙", "en-US", "zh-CN")]
    assert got[0].modified_at == "2024-01-05 08:09:10" and len({r.guid for r in got}) == 2
    with contextlib.closing(sqlite3.connect(path)) as db:
        one = lambda q: db.execute(q).fetchall()
        kinds = dict(one("SELECT type, count(*) FROM sqlite_master WHERE name NOT LIKE 'sqlite_%' GROUP BY type"))
        assert kinds == {"table": 20, "index": 20} and one("PRAGMA integrity_check") == [("ok",)]
        assert one("PRAGMA foreign_key_check") == [] and one("PRAGMA page_size") == [(8192,)]
        assert one("SELECT name, tucount, fga_support, data_version FROM translation_memories") == [("m", 2, 1, 1)]
        assert one("SELECT name, type, tm_id FROM attributes") == [("StructureContext", 2, 1)]
        assert dict(one("SELECT translation_memory_id, count(*) FROM parameters GROUP BY 1")) == {None: 3, 1: 3}
        empty = [t for (t,) in one("SELECT name FROM sqlite_master WHERE type = 'table'") if not one(f"SELECT 1 FROM {t} LIMIT 1")]
        assert len(empty) == 16
    assert out.write_sdltm(u.limit(0), path, ["unit_ord"], "en", "zh") == 0 and src.read_units(spark, path).count() == 0


def test_workbook_round_trip(spark, tmp_path):
    path = str(tmp_path / "w.xlsx")
    out.write_xlsx(spark.createDataFrame([(2, " b&", None), (1, "a", "甲")], "n int, s string, t string"), path, ["n"])
    with open(path, "rb") as f:
        assert src.sheet_rows(f.read()) == [["n", "s", "t"], ["1", "a", "甲"], ["2", " b&", ""]]


def test_preflight(spark, tmp_path):
    good = _docx(tmp_path / "good.docx", _table([("One", "一"), ("Two two", "二二"), ("Three", "三"), ("Four.", "四。"), ("Five.", "五。")]))
    odd = _docx(tmp_path / "odd.docx", _table([("甲。", "a."), ("乙", "b")], '<w:tcPr><w:gridSpan w:val="2"/></w:tcPr>') + _table([("", "")]))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    got = {r.path.rsplit("/", 1)[1]: r for r in src.preflight(spark, str(tmp_path), "en", "zh").collect()}
    assert (got["good.docx"].best_layout, got["good.docx"].best_score, got["good.docx"].issues) == ("table", 0.95, [])
    assert (got["odd.docx"].best_score, got["odd.docx"].merged_cells, got["odd.docx"].empty_tables, len(got["odd.docx"].issues)) == (0.85, 4, 1, 4)
    assert got["bad.docx"].error and not got["bad.docx"].best_layout
    assert cli.main(["preflight", good, "--src", "en", "--tgt", "zh", "--fail-on-issues"]) == 0
    assert cli.main(["preflight", odd, "--fail-on-issues"]) == 2


def test_layout_with_most_confidence(spark):
    numbered = [f"[{n}] {t}" for n, t in ((1, "a"), (2, "b"), (1, "甲"), (2, "乙"))]
    assert src.confidences(numbered, []) == {"table": 0.0, "numbered": 0.95, "alternating": 0.5}
    assert src.confidences(["a"], []) == {"table": 0.0, "numbered": 0.0, "alternating": 0.0}
    assert src.confidences(numbered[:1] + numbered[2:3], [[["x.", "y."]]])["table"] == 0.85
    assert [p["key"] for p in src.layouts([], [[["No", "EN", "ZH"], ["1", "a", "甲"]], [["b", "乙。"]]])["table"]] == ["2", "t2:1"]


def test_drop_folder(spark, tmp_path):
    box, at, mark = tmp_path / "box", str(tmp_path / "out"), str(tmp_path / "mark")
    box.mkdir()
    _tmx(spark, box / "a.tmx", ("one", "一", None), ("two", "二", None))
    (box / "bad.tmx").write_text("<tmx>")

    def run():
        drop_folder.write(drop_folder.first_seen(drop_folder.units(spark, str(box))), at, mark).awaitTermination(120)
        return sorted(r.src_text for r in spark.read.parquet(at).collect())

    assert run() == ["one", "two"]
    _tmx(spark, box / "c.tmx", ("two", "二", None), ("three", "三", None))
    assert run() == ["one", "three", "two"]


def _shown(page):
    return [bytes.fromhex(x).decode("utf-16-be") for x in re.findall(r"<([0-9a-f]*)> Tj", page)]


def test_pdf(tmp_path):
    path = tmp_path / "r.pdf"
    rows = [(i, "确定 " * 40 if i == 3 else "a (b) \\ \U0001f600", None) for i in range(200)] + [(200, "x" * 30000, "")]
    pdf.put("Títle 报告", ["one", ""], ["n", "text", "none"], rows, str(path))
    data = path.read_bytes()
    at = int(data.rsplit(b"startxref\n", 1)[1].split()[0])
    starts = [int(x[:10]) for x in data[at:].split(b"\n")[3:] if x.endswith(b" n ")]
    assert data[at:].startswith(b"xref") and all(data[s:].startswith(f"{i} 0 obj".encode()) for i, s in enumerate(starts, 1))
    pages = re.findall(rb"stream\n(.*?)\nendstream", data, re.S)
    text = [t for p in pages for t in _shown(p.decode())]
    assert len(pages) > 3 and text[:3] == ["Títle 报告", "• one", "• "] and [t for t in text if t.isdigit()] == [str(i) for i in range(201)]
    assert "".join(text).count("x") == 30000 + 1 and text.count("a (b) \\ �") == 199 and "".join(text).count("确定") == 40
    assert all(float(y) >= pdf.MARGIN for p in pages for y in re.findall(r" ([\d.]+) Td", p.decode()))
    pdf.put("", [], [], [], str(path))
    assert path.read_bytes().count(b"/Type /Page ") == 1


def test_pdf_lines():
    assert pdf.wrapped("", 10) == [""] and pdf.wrapped("ab cd", 4 * 9 * 0.5) == ["ab", "cd"] and pdf.wrapped("甲乙丙", 18) == ["甲乙", "丙"] and pdf.wrapped("abc", 1) == ["a", "b", "c"]


def test_labels_and_weights(tmp_path):
    assert cli.labels(["a/x.tmx", "b/x.tmx", "x-2.tmx", "c\\x.tmx"]) == ["x.tmx", "x-2.tmx", "x-2-2.tmx", "x-3.tmx"]
    card = tmp_path / "w.json"
    for bad in ([], {"none": 1}, {"exact": True}, {"exact": 101}, {"exact": "1"}):
        card.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            cli.weights(str(card))


def test_commands(spark, tmp_path, capsys):
    a = _tmx(spark, tmp_path / "a.tmx", ("Click OK now", "点击确定", None), ("Click OK please", "请点击确定", None), ("Click OK now", "点击确定", None), ("5 cats", "6 猫", None))
    b = _tmx(spark, tmp_path / "b.tmx", ("5 cats", "五猫", None), ("new", "新", None))
    (tmp_path / "g.csv").write_text("source,target,status\nOK,确定,forbidden\n", encoding="utf-8")
    (tmp_path / "p.csv").write_text("EN,ZH\nOne here. Two here.,一在这里。二在这里。\n", encoding="utf-8")
    at = lambda n: str(tmp_path / n)
    langs = ["--src", "en-US", "--tgt", "zh-CN"]

    def run(*argv, code=0):
        assert cli.main(list(argv)) == code, capsys.readouterr()
        return capsys.readouterr().out.splitlines()

    assert run("clean", a, "--output", at("c.sdltm")) == ["Input=4 Output=3 Duplicates=1 Empty=0 Identical=0 Normalized=0"]
    assert run("merge", a, b, "--output", at("m.tmx"), "--strategy", "prefer-last") == ["Input=6 Output=4 ConflictsResolved=1 Strategy=prefer-last"]
    assert run("compare", a, b, "--export", at("k.csv"), "--fail-on-conflicts", code=2) == ["Inputs=2", "a.tmx: segments=4 unique=2", "b.tmx: segments=2 unique=1", "Shared=0 Conflicts=1"]
    assert (tmp_path / "k.csv").read_text("utf-8-sig").splitlines() == ["source,a.tmx,b.tmx", "5 cats,6 猫,五猫"]
    assert run("qa", a, "--export", at("q.csv"), "--report", at("q.html"))[0].startswith("Total=4 Flagged=")
    assert [x.split(",")[0] for x in (tmp_path / "q.csv").read_text("utf-8-sig").splitlines()] == ["No", "1", "2", "3", "4"]
    assert run("stats", a, b, "--report", at("s.pdf"))[0].startswith("Total=6 Unique=5 ") and (tmp_path / "s.pdf").read_bytes().startswith(b"%PDF-")
    assert run("stats", a, b, "--report", at("s.txt"), code=1) == []
    assert run("near-dup", a, "--export", at("n.csv")) and run("leverage", b, "--tm", a)[0] == "Total=2 Words=3"
    assert run("quote", a, b, "--tm", b, "--export", at("w.csv"))[0].startswith("Files=2 Segments=6 Words=")
    assert run("term-check", a, "--glossary", at("g.csv"), *langs, "--fail-on-issues", code=2)[1] == "forbidden: 3"
    assert run("term-extract", a, *langs, "--output", at("t.csv"))[0].startswith("Candidates=")
    (tmp_path / "r.csv").write_text("src_term,tgt_term,decision\nOK,确定,approve\nnow,现,\n", encoding="utf-8")
    assert run("term-extract-promote", at("r.csv"), *langs, "--output", at("y.xlsx")) == ["Promoted=1 Total=2"]
    assert run("align", at("p.csv"), "--src", "en", "--tgt", "zh")[:2] == ["Units=2 Gaps=0 Flagged=0", "1:1: 2"]
    got = run("convert", at("p.csv"), "--src", "en", "--tgt", "zh", "--output", at("z"), "--formats", "sdltm,tmx,csv,jsonl", "--qa")
    assert got[0].startswith("Units=2 Exported=2 LengthRatio=") and [x.rsplit("(", 1)[1] for x in got[1:]] == ["2 units)"] * 4
    assert json.loads((tmp_path / "z.jsonl").read_text("utf-8").splitlines()[0]) == {"src_lang": "en", "tgt_lang": "zh", "src": "One here.", "tgt": "一在这里。"}
    assert run("qa", at("none.tmx"), code=1) == [] and run("convert", at("p.csv"), "--src", "en", "--tgt", "zh", code=1) == []
    assert not (tmp_path / "p.tmx").exists()  # nothing is written where the input would be overwritten
    (tmp_path / "e.csv").write_text("EN,ZH\n", encoding="utf-8")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "half.csv").write_text("EN,ZH\nOne here.,一在这里。\nTwo 2 here.,二在这里。\n", encoding="utf-8")
    files = [at(n) for n in ("p.csv", "e.csv", "bad.docx", "half.csv")]
    assert run("align-batch", *files, "--src", "en", "--tgt", "zh", "--export", at("sum.csv"), "--fail-on-issues", code=2) == ["Checked=3 Failed=1 NeedsReview=2"]
    lines = {x.split(",")[0].rsplit("/", 1)[1]: x.split(",")[1:] for x in (tmp_path / "sum.csv").read_text("utf-8-sig").splitlines()[1:]}
    assert lines["p.csv"] == ["2", "0", "0", "ok"] and lines["e.csv"] == ["0", "0", "0", "review"] and lines["half.csv"] == ["2", "0", "1", "review"] and lines["bad.docx"][:3] == ["", "", ""]
    for name, argv in {"qa": ["qa", a], "review": ["qa", a, "--bilingual"], "near": ["near-dup", a], "terms": ["term-check", a, "--glossary", at("g.csv"), *langs], "cmp": ["compare", a, b], "quote": ["quote", a, "--tm", b], "lev": ["leverage", b, "--tm", a], "align": ["align", at("p.csv"), "--src", "en", "--tgt", "zh"], "stats": ["stats", a]}.items():
        run(*argv, "--report", at(f"{name}.html"))
        page = (tmp_path / f"{name}.html").read_text("utf-8")
        assert {"qa": "<td>NUMBER_MISMATCH</td><td>1</td>", "review": '<span class="hl">5</span> cats', "near": "Clusters found: 1", "terms": "<td>Forbidden</td><td>3</td>", "cmp": "<td>5 cats</td><td>6 猫</td><td>五猫</td>", "quote": "Files: 1", "lev": "<td>exact</td><td>1</td>", "align": "1:1（一一对应）", "stats": "<td>Language pair</td>"}[name] in page, name
    assert run("qa", a, "--bilingual", "--report", at("x.pdf"), code=1)[0].startswith("Total=")
