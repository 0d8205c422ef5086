"""Corpus operators on small cases with known answers, and files written and read again."""

import difflib
import io
import math
import random
import zipfile

import pytest

from bitloom.functions import text as X
from bitloom.operators import align, corpus, edits, leverage, near_dup, qa, review, terms
from bitloom.sinks import files as out
from bitloom.sources import files as src


def _units(spark, rows):
    return spark.createDataFrame([(i, "en", "zh", s, t, m) for i, (s, t, m) in enumerate(rows)], "ord long, src_lang string, tgt_lang string, src_text string, tgt_text string, modified_at string")


def _issues(spark, *pairs):
    got = qa.check(_units(spark, [(s, t, None) for s, t in pairs]), 1.0).orderBy("ord").collect()
    return [r.qa_issues for r in got]


@pytest.mark.parametrize(("a", "b"), [("$350bn", "3500亿美元"), ("$4trn", "4万亿"), ("Sept. 2024", "2024年9月"), ("1,000 and 1.50", "1000 1,5")])
def test_equal_numbers(a, b):
    assert X.numbers(a) == X.numbers(b)


def test_checks(spark):
    got = _issues(spark, ("Say {name}", "说"), ("(a", "（甲）"), ("a!", "甲！!"), (" x", "y"), ("", "z"), ("see https://a.b/c.", "见 https://a.b/c。"), ("5 cats", "6 猫"), ("same", "甲"), ("same", "乙"))
    assert "PLACEHOLDER_MISMATCH" in got[0] and "PUNCTUATION_UNBALANCED" in got[1] and "WIDTH_MIXING" in got[2] and "LEADING_TRAILING_SPACE" in got[3] and got[4][0] == "EMPTY_SOURCE"
    assert "URL_MISMATCH" not in got[5] and "NUMBER_MISMATCH" in got[6] and "SOURCE_CONFLICT" in got[7] and "SOURCE_CONFLICT" in got[8]


def test_maintenance(spark):
    u = _units(spark, [("a", "x", "2"), (" a", "y", "1"), ("b c", "z", None), ("b c", "z", None), ("", "q", None), ("a", "x", "0")])
    rep = corpus.clean_report(corpus.clean(u)).first()
    assert (rep.input, rep.removed_empty, rep.removed_duplicate, rep.output) == (6, 1, 2, 3) and rep.normalized == 2
    pick = lambda s: {r.src_text.strip(): r.tgt_text for r in corpus.merge(u, s).collect()}["a"]
    assert (pick("prefer-last"), pick("prefer-first"), pick("prefer-newer")) == ("x", "x", "x")
    assert corpus.conflicts_resolved(u, "prefer-last").first()[0] == 2


def test_leverage(spark):
    tm = _units(spark, [("the quick brown fox jumps over it", "t", None), ("Exact one", "t", None)])
    cand = _units(spark, [("exact  ONE", "t", None), ("the quick brown fox jumped over it", "t", None), ("exact one", "t", None), ("zzzz", "t", None)])
    got = [(r.leverage_band, r.leverage_match_pct) for r in leverage.analyze(tm, cand).orderBy("ord").collect()]
    want = round(difflib.SequenceMatcher(None, "the quick brown fox jumped over it", "the quick brown fox jumps over it").ratio() * 100, 1)
    assert got == [("exact", 100.0), ("95-99" if want >= 95 else "85-94", want), ("repetition", 100.0), ("no_match", 0.0)]


def _near(texts, threshold):
    """Clusters by trying all pairs, the shorter text first; of equal lengths either way counts."""
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(texts):
        for j in range(i):
            t = texts[j]
            ways = [(t, s), (s, t)] if len(s) == len(t) else [min((s, t), (t, s), key=lambda p: len(p[0]))]
            order = ways[:1] if len(s) == len(t) else ways  # the earlier unit comes first
            if any(difflib.SequenceMatcher(None, *p).ratio() >= threshold for p in order):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(find(i), []).append(i)
    return sorted(g for g in groups.values() if len(g) > 1)


@pytest.mark.parametrize("threshold", [0.6, 0.85])
def test_near_duplicates_by_all_pairs(spark, threshold):
    """Lengths at the bounds of what a threshold allows, ties, and texts in which difflib leaves out what is frequent."""
    rnd, texts = random.Random(threshold), []
    for n in (1, 3, 17, 20, 40):
        base = "".join(rnd.choice("abcdefgh ") for _ in range(n)).strip() or "x"
        texts += [base, base + "q" * round(n * (2 - threshold) / threshold - n), base[:-1] + "z", base[::-1]]
    for _ in range(4):  # over 200 characters
        base = " ".join(rnd.choice(("lorem", "ipsum", "dolor", "sit")) for _ in range(60))
        texts += [base, base.replace("sit", "amet"), base[: len(base) // 2], base[5:] + base[:5]]
    for _ in range(120):
        texts.append("".join(rnd.choice("ab ") for _ in range(rnd.randint(2, 12))).strip() or "y")
    texts = list(dict.fromkeys(X.fold(t) for t in texts))
    got = {}
    for r in near_dup.clusters(_units(spark, [(t, "x", None) for t in texts]), threshold).collect():
        got.setdefault(r.cluster_id, []).append(r.ord)
    assert sorted(sorted(g) for g in got.values()) == _near(texts, threshold)


def test_near_duplicates_write_a_text_once(spark, monkeypatch):
    """Whatever the number of blocks that a block meets; where files can't be opened, texts go to the tasks as before."""
    rnd = random.Random(8)
    texts = list(dict.fromkeys(X.fold("".join(rnd.choice("abcd ") for _ in range(rnd.randint(20, 26))).strip()) for _ in range(150)))
    texts += [t[:9] + "x" + t[10:] for t in texts[:30]]
    monkeypatch.setattr(near_dup, "LEAST", 12)  # 15 blocks, each with most others
    units, folders, written = _units(spark, [(t, "x", None) for t in texts]), [], near_dup._written
    monkeypatch.setattr(near_dup, "_written", lambda *a: folders.append(written(*a)) or folders[-1])
    with monkeypatch.context() as m:
        m.setattr(near_dup, "_tasks", lambda linker: 1 / 0)
        got = sorted(map(tuple, near_dup.clusters(units, 0.85).collect()))
    files = spark.read.parquet(folders[0])
    assert files.count() == len(set(texts)) and files.select("k").distinct().count() > 10
    assert {s for _, s, _ in got} and len({c for c, _, _ in got}) == len(_near(texts, 0.85))
    monkeypatch.setattr(near_dup, "_opens", lambda folder: False)
    assert sorted(map(tuple, near_dup.clusters(units, 0.85).collect())) == got
    assert not near_dup._opens("viewfs://nowhere/at/all")


def test_numbered_documents_with_restarts():
    numbers = [f"[{n}] {t}" for n, t in ((2, "before"), (1, "a"), (2, "b"), (1, "甲"), (2, "乙"), (1, "x"))]
    got = src.layouts(numbers[1:], [])["numbered"]
    assert [(p["key"], p["src_text"], p["tgt_text"]) for p in got if "key" in p] == [("1", "a", "x"), ("2", "b", "乙")]
    got = src.layouts(numbers, [])["numbered"]
    assert [(p.get("key"), p.get("place")) for p in got] == [("2", None), (None, "1")]


def test_workbook_values():
    def book(cells, styles=""):
        out_file = io.BytesIO()
        with zipfile.ZipFile(out_file, "w") as z:
            z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="rId1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
            z.writestr("xl/styles.xml", '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0.0&quot;day&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="21"/></cellXfs></styleSheet>')
            z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData><row>{cells}</row></sheetData></worksheet>")
        return src.sheet_rows(out_file.getvalue())[0]

    cells = '<c s="1"><v>45296</v></c><c s="2"><v>45296.25</v></c><c s="3"><v>2.5</v></c><c s="4"><v>0.5</v></c><c t="b"><v>1</v></c><c t="b"><v>0</v></c><c><v>7</v></c><c><v>7.0</v></c><c t="str"><v>x</v></c>'
    assert book(cells) == ["2024-01-05 00:00:00", "2024-01-05 06:00:00", "2.5", "12:00:00", "True", "False", "7", "7.0", "x"]


def test_registered_reader(spark, tmp_path):
    src.register("lines", lambda data: ({"key": str(i), "src_text": x, "tgt_text": x.upper()} for i, x in enumerate(data.decode().split())))
    try:
        (tmp_path / "a.lines").write_text("one two")
        assert [(r.src_text, r.tgt_text) for r in src.read_paragraphs(spark, str(tmp_path)).orderBy("para_ord").collect()] == [("one", "ONE"), ("two", "TWO")]
    finally:
        src.PARAGRAPHS.pop("lines")
    with pytest.raises(ValueError):
        src.register("no.good", None)


def test_reader_warnings(spark, tmp_path):
    (tmp_path / "a.csv").write_text("EN,ZH\nOne.,\nTwo.,二。\n", encoding="utf-8")
    got = [(r.path.rsplit("/", 1)[1], r.warning, r.place) for r in src.warnings(spark, str(tmp_path)).collect()]
    assert got == [("a.csv", "one side only", "2")]
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "g.csv").write_text("source,target,status\nOK,确定,odd\n", encoding="utf-8")
    assert [(r.warning, r.place) for r in src.warnings(spark, str(tmp_path / "g"), "en", "zh", True).collect()] == [("unknown status", "2")]
    p = spark.createDataFrame([("f", 0, 0, "k", "你好世界", "x"), ("g", 1, 0, "k", "plain", "x")], "source_file string, file_ord int, para_ord long, key string, src_text string, tgt_text string")
    assert [tuple(r) for r in align.switched(p, "en", "de").collect()] == [(0, "src", "en")]


def test_check_details_and_spans(spark):
    u = _units(spark, [(" Pay {x} 5", "付 {y} 6", None), ("(a", "“甲", None), ("see http://a.b/c.", "见 http://a.b/d", None), ("a! b！", "x", None)])
    got = [r.qa_details for r in qa.check(u, 1.0, details=True).orderBy("ord").collect()]
    assert (got[0].LEADING_TRAILING_SPACE, got[0].NUMBER_MISMATCH.asDict(), got[0].PLACEHOLDER_MISMATCH.asDict()) == (["src"], {"src": ["5"], "tgt": ["6"]}, {"src": ["{x}"], "tgt": ["{y}"]})
    assert got[1].PUNCTUATION_UNBALANCED.asDict() == {"src": ["()"], "tgt": ["“”"]} and got[2].URL_MISMATCH.asDict() == {"src": ["http://a.b/c"], "tgt": ["http://a.b/d"]} and got[3].WIDTH_MIXING.src == ["!"]
    assert got[3].NUMBER_MISMATCH is None and got[1].URL_MISMATCH is None
    assert X.issue_spans("3 million on 5 May", ["NUMBER_MISMATCH"]) == [(0, 9), (13, 14)] and X.issue_spans(" x! ！", ["LEADING_TRAILING_SPACE", "WIDTH_MIXING"]) == [(0, 1), (2, 3), (4, 5)]
    one = qa.check(u, codes=("NUMBER_MISMATCH",)).orderBy("ord").collect()
    assert [r.qa_issues for r in one] == [["NUMBER_MISMATCH"], [], [], []]


def _greedy(units, lang, min_freq, max_ngram):
    """Candidates of English texts by a walk over the ranked grams."""
    freq, first = {}, {}
    for o, text in units:
        tokens = terms._TOKEN.findall(text)
        for n in range(1, max_ngram + 1):
            for i in range(len(tokens) - n + 1):
                g = " ".join(tokens[i : i + n])
                freq[g] = freq.get(g, 0) + 1
                first[g] = min(first.get(g, (o, n, i)), (o, n, i))
    stop = terms.EN_STOPWORDS
    rows = [g for g in freq if freq[g] >= min_freq and g.split()[0] not in stop and g.split()[-1] not in stop]
    size = lambda g: len(g.split())
    rows.sort(key=lambda g: (-freq[g] * math.log2(size(g) + 1), -freq[g], -size(g), first[g][0], size(g), first[g][2]))
    stays = []
    for g in rows:
        if not any(freq[g] <= 1.2 * freq[k] and f" {g} " in f" {k} " for k in stays):
            stays.append(g)
    return [(i, g, freq[g]) for i, g in enumerate(stays)]


def test_candidates_equal_the_greedy_walk(spark):
    rnd = random.Random(8)
    words = "alpha beta gamma delta of the epsilon zeta".split()
    phrases = ["alpha beta gamma delta", "beta gamma", "zeta of epsilon", "delta"]
    texts = [" ".join(rnd.choice(phrases) if rnd.random() < 0.5 else rnd.choice(words) for _ in range(rnd.randint(1, 6))) for _ in range(80)]
    for n in (1, 2, 4):
        got = [(r["rank"], r.text, r.freq) for r in terms.candidates(_units(spark, [(t, "x", None) for t in texts]), "en", "src", 2, 1, n).orderBy("rank").collect()]
        assert got == _greedy(list(enumerate(texts)), "en", 2, n)


def test_terms_by_their_rarest_key(spark):
    u = _units(spark, [("Click OK now", "点击确定", None), ("the .NET way İstanbul", "x 伊", None), ("确定 two", "b", None), (None, None, None)])
    rows = [(0, "en", "zh", "OK", "确定", "forbidden"), (1, "en", "zh", ".net", "x", "forbidden"), (2, "zh", "en", "确定", "b", "forbidden"), (3, "zh", "en", "定", "b", "forbidden"), (4, "en", "zh", "--", "b", "forbidden"), (5, "en", "zh", "now", "点击", "forbidden"), (6, "en", "zh", "i̇stanbul", "伊", "forbidden")]
    g = spark.createDataFrame([(*r, True, None) for r in rows], "entry_ord int, src_lang string, tgt_lang string, src_term string, tgt_term string, status string, status_declared boolean, note string")
    want = [[e for e in rows if terms.has_term(r.src_text or "", e[3], e[1]) and terms.has_term(r.tgt_text or "", e[4], e[2])] for r in u.orderBy("ord").collect()]
    got = [[h.src_term for h in r.term_issues] for r in terms.check(u, g).orderBy("ord").collect()]
    assert got == [[e[3] for e in w] for w in want] and sum(map(len, got)) >= 5
    assert all(r.term_issues == [] for r in terms.check(u, g.limit(0)).collect())
    assert terms.check(u.limit(0), g).count() == 0


def test_terms_by_brute_force(spark):
    rnd, words = random.Random(5), ["alpha", "Beta", "beta-ray", "ß", "ẞ", "STRASSE", "straße", "İx", "ix", "K", "k", "naïve", "x_1", "½", "10", "日", "日本", "本", "®", "--", "."]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice((" ", "", ", ", "'", "\u0301")) for _ in range(n))
    u = _units(spark, [(text(8), text(4), None) for _ in range(60)] + [(None, "x", None), ("alpha", None, None), ("", "", None)])
    rows = [(i, rnd.choice(("en", "zh", None)), rnd.choice(("en", "ja")), rnd.choice(words) if i % 2 else text(2).strip(), rnd.choice((*words, None)), rnd.choice(("forbidden", "approved"))) for i in range(120)]
    g = spark.createDataFrame([(*r, i % 7 > 0, None) for i, r in enumerate(rows)], "entry_ord int, src_lang string, tgt_lang string, src_term string, tgt_term string, status string, status_declared boolean, note string")
    order = [r for r in rows if r[5] == "forbidden"] + [r for r in rows if r[5] == "approved" and r[0] % 7]
    for r in terms.check(u, g, True).collect():
        s, t = r.src_text or "", r.tgt_text or ""
        want = [e[3] for e in order if terms.has_term(s, e[3], e[1]) and terms.has_term(t, e[4] or "", e[2]) == (e[5] == "forbidden") and (e[5] == "forbidden" or (e[4] and t.strip()))]
        assert [h.src_term for h in r.term_issues] == want, (s, t)


def test_all_pairs_of_terms(spark):
    u = _units(spark, [("Click OK now", "点击确定", None), ("Click OK please", "请点击确定", None), ("Click OK", "点击确定", None), ("other words", "别的", None), ("more words", "更多", None)])
    some, every = (terms.pairs(u, "en", "zh", top_n=n, floor=1.5).collect() for n in (1, None))
    assert len(some) == 1 and len(every) > 1 and some[0] in every


def test_reviewer_specs():
    assert review.load("operator:itemgetter(0)")("ab") == "a" and review.load("os.path.basename")("a/b") == "b"
    for bad in ("no_such_module:x", "operator:nothing", "operator:itemgetter("):
        with pytest.raises((ValueError, TypeError)):
            review.load(bad)


def test_edits(spark):
    kind = "array<struct<kind:string,content:string>>"
    u = spark.createDataFrame([(i, "en", "de", f"s{i}", f"t{i}", None, None, f"g{i}") for i in range(4)], f"ord long, src_lang string, tgt_lang string, src_text string, tgt_text string, src_markup {kind}, tgt_markup {kind}, guid string")
    node = lambda *xs: [("tag" if x.startswith("<") else "text", x) for x in xs]
    schema = f"op string, ord long, seq int, src_lang string, tgt_lang string, src_nodes {kind}, tgt_nodes {kind}"
    e = spark.createDataFrame([("change", 1, 0, None, None, node("old"), node("x")), ("change", 1, 1, None, None, node(" a", "<b/>", " c "), node(" x ")), ("delete", 2, 0, None, None, None, None), ("add", 0, 1, "en", "de", node("second"), node("x")), ("add", 0, 0, "en", "de", node("first"), node("x")), ("delete", 9, 0, None, None, None, None)], schema)
    got = [(r.src_text, r.tgt_text, r.guid, r.src_markup and [tuple(m) for m in r.src_markup]) for r in edits.apply(u, e).orderBy("place").collect()]
    assert got == [("s0", "t0", "g0", None), ("first", "x", None, None), ("second", "x", None, None), ("a c", "x", None, node("a", "<b/>", " c")), ("s3", "t3", "g3", None)]
    with pytest.raises(Exception, match="without both texts"):
        edits.apply(u, spark.createDataFrame([("change", 1, 0, None, None, node(" "), node("x"))], schema)).collect()


def test_alignment(spark):
    assert align.split_en('Dr. Smith left. He said "Go!" Then J. Doe came.') == ["Dr. Smith left.", 'He said "Go!"', "Then J. Doe came."]
    assert align.split_zh("你好。 再见！App Store 好") == ["你好。", "再见！", "App Store 好"]
    p = spark.createDataFrame([("f", 0, 0, "k", "One sentence here. And two.", "一句话在这里。还有二。"), ("f", 0, 1, "k", "Only source.", "")], "source_file string, file_ord int, para_ord long, key string, src_text string, tgt_text string")
    got = [(r.src_text, r.tgt_text, r.align_move) for r in align.align(p, "en", "zh").orderBy("para_ord", "unit_ord").collect()]
    assert got == [("One sentence here.", "一句话在这里。", "1:1"), ("And two.", "还有二。", "1:1"), ("Only source.", "", "1:0")]


def test_terms(spark):
    u = _units(spark, [("Click OK now", "点击确定", None), ("Click OK please", "请点击确定", None), ("Click OK", "点击确定", None), ("other words", "别的", None), ("more words", "更多", None)])
    g = spark.createDataFrame([(0, "en", "zh", "OK", "确定", "forbidden", True, "n"), (1, "en", "zh", "words", "词", "approved", True, None)], "entry_ord int, src_lang string, tgt_lang string, src_term string, tgt_term string, status string, status_declared boolean, note string")
    hits = [len(r.term_issues) for r in terms.check(u, g, True).orderBy("ord").collect()]
    assert hits == [1, 1, 1, 1, 1]
    assert [r.text for r in terms.candidates(u, "en").orderBy("rank").collect()][0] == "Click OK"
    best = {r.src_term: r.tgt_term for r in terms.pairs(u, "en", "zh", floor=1.5).collect()}
    assert best["Click OK"] == "点击确定"


def test_review(spark):
    got = review.attach(_units(spark, [("a", "a", None), ("a", "b", None)]), lambda u: [{"type": "SAME", "description": "d"}] if u["src_text"] == u["tgt_text"] else [])
    assert [len(r.semantic_issues) for r in got.orderBy("ord").collect()] == [1, 0]


def test_files(spark, tmp_path):
    tmx = '<tmx><body><tu changedate="20240101T000000Z"><tuv xml:lang="en-US"><seg>Click <bpt i="1">&lt;b&gt;</bpt>OK<ept i="1"/> go</seg></tuv><tuv xml:lang="zh-CN"><seg>点 &amp; 击</seg></tuv></tu></body></tmx>'
    (tmp_path / "a.tmx").write_text(tmx, encoding="utf-8")
    u = src.read_units(spark, str(tmp_path / "a.tmx"), src_lang="en", tgt_lang="zh")
    r = u.first()
    assert (r.src_text, r.tgt_text, r.modified_at) == ("Click <b>OK go", "点 & 击", "20240101T000000Z") and [n.kind for n in r.src_markup] == ["text", "tag", "text", "tag", "text"]
    assert out.write_tmx(u, str(tmp_path / "b.tmx"), ["file_ord", "unit_ord"], "en", "zh") == 1
    assert [x.src_text for x in src.read_units(spark, str(tmp_path / "b.tmx")).collect()] == [r.src_text]
    (tmp_path / "c.csv").write_bytes("EN,ZH\nOne. Two.,一。二。\n\nx,\n".encode("utf-8-sig"))
    (tmp_path / "d.tsv").write_bytes("你好。\t世界。\n".encode("gb18030"))
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body>' + "".join(f"<w:p><w:r><w:t>[{n}] {t}</w:t></w:r></w:p>" for n, t in ((1, "a"), (2, "b"), (1, "甲"), (2, "乙"))) + "</w:body></w:document>")
    (tmp_path / "e.docx").write_bytes(z.getvalue())
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    p = src.read_paragraphs(spark, str(tmp_path), errors="report").orderBy("file_ord", "para_ord").collect()
    assert [(x.key, x.src_text, x.tgt_text) for x in p if not x.error] == [("2", "One. Two.", "一。二。"), ("1", "你好。", "世界。"), ("1", "a", "甲"), ("2", "b", "乙")]
    assert sum(bool(x.error) for x in p) == 1
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "g.csv").write_text("source,target,status,note\nOK,确定,forbidden,n\nGo,走,,\n", encoding="utf-8")
    g = src.read_glossary(spark, str(tmp_path / "g"), "en", "zh")
    out.write_tbx(g, str(tmp_path / "g.tbx"))
    again = src.read_glossary(spark, str(tmp_path / "g.tbx"), "en", "zh").orderBy("entry_ord").collect()
    assert [(x.src_term, x.tgt_term, x.status, x.status_declared, x.note) for x in again] == [("OK", "确定", "forbidden", True, "n"), ("Go", "走", "approved", False, None)]


def test_terms_of_many_parts(spark, monkeypatch):
    """Parts ask once for what their units share, and units of many small parts find the entries that all units do."""
    import numpy as np
    import pyarrow as pa

    hashes = pa.array([[1, 2], [2, 1, 3], [], [2, 4]], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0, 5, 5]), hashes], names=["_part", "hashes"])
    bits = np.zeros(terms.MAP, np.int64)
    bits[[1, 2, 4]] = 1
    got = [tuple(r.values()) for b in terms._asking(bits)(iter([batch, batch.slice(2)])) for r in b.to_pylist()]
    assert got == [(0, 1), (0, 2), (5, 2), (5, 4)]

    monkeypatch.setattr(terms, "LEAST", 3)
    rnd, chars = random.Random(6), "的一是不了人我在有他"
    text = lambda: "".join(rnd.choice(chars) for _ in range(rnd.randint(0, 12)))
    rows = [(text(), text()) for _ in range(70)] + [("无此", "x")] * 20 + [(None, None)]
    u = spark.createDataFrame([(i, "zh", "zh", s, t) for i, (s, t) in enumerate(rows)], "ord long, src_lang string, tgt_lang string, src_text string, tgt_text string")
    found = sorted({"".join(rnd.choice(chars) for _ in range(n)) for n in (1, 2, 2, 3, 3, 4, 5) for _ in range(6)})
    g = spark.createDataFrame([(len(x), "zh", "zh", x, x[0], "forbidden" if len(x) % 2 == 0 else "approved", True, None) for x in found], "entry_ord int, src_lang string, tgt_lang string, src_term string, tgt_term string, status string, status_declared boolean, note string")
    for r in terms.check(u, g, True).collect():
        s, t = r.src_text or "", r.tgt_text or ""
        want = {(x, "forbidden") for x in found if len(x) % 2 == 0 and x in s and x[0] in t} | {(x, "approved") for x in found if len(x) % 2 and x in s and t.strip() and x[0] not in t}
        own = [(h.src_term, h.status) for h in r.term_issues]
        assert set(own) == want and len(own) == len(want)
        assert [h[1] == "approved" for h in own] == sorted(h[1] == "approved" for h in own)
