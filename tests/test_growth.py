"""What keeps work in proportion to the input."""

import re

import pytest
from pyspark.sql import functions as F

from bitloom.functions import text as X
from bitloom.operators import corpus, near_dup, qa
from bitloom.plans import views as V


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("lines"))
    rows = [(1, "a b\nc\n\na b\nc", "en", "x"), (2, "one line", "en", "x"), (3, None, "en", "x"), (4, "", "de", "y"), (5, "a b\nc\n A  b\nd", None, "y")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    return at


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_line_does_not_carry_its_document(spark, lines):
    d = V.segments(spark, lines)
    assert [(r.ord - (r.ord >> 30 << 30), r.src_text, r.tgt_text) for r in d.orderBy("ord").collect()] == [(0, "a b", "c"), (1, "c", ""), (2, "", "a b"), (3, "a b", "c"), (0, "a b", "c"), (1, "c", " A  b"), (2, " A  b", "d")]
    kept = next(x for x in _plan(d.select("ord", X.folded("src_text"), "tgt_text")).split("\n") if "Generate" in x)
    dropped = re.search(r"\), \[([\d, ]+)\], false", kept)  # places of the child's columns that go no further
    assert dropped, "the array of lines goes along with every line"


def test_texts_are_folded_once(spark, lines):
    d = V.segments(spark, lines)
    for got in (near_dup.clusters(d, 1.0), corpus.clean(d)):
        got.collect()
    assert not re.search(r"Filter .*regexp_replace", _plan(corpus.clean(d))), "a filter works the texts out once more"
    assert sorted(map(tuple, near_dup.clusters(d, 1.0).collect())) == [((1 << 30), 4, o) for o in ((1 << 30), (1 << 30) + 3, 5 << 30, (5 << 30) + 2)] + [((1 << 30) + 1, 2, (1 << 30) + 1), ((1 << 30) + 1, 2, (5 << 30) + 1)]
    gone = {r.ord: r.removed for r in corpus.clean(d).collect()}
    assert [gone[k] for k in sorted(gone)] == [None, "empty", "empty", "duplicate", "duplicate", None, None]


def test_conflicts_are_found_by_numbers(spark):
    rows = [(1, "a", "x", "f"), (2, "a", "y", "f"), (3, "b", "x", "g"), (4, "", "z", "f"), (5, "", "w", "f"), (6, "c", "", None), (7, "a", "x", None), (8, "d", "v", None), (9, "d", "u", None)]
    d = spark.createDataFrame([(o, "en", "en", s, t, f) for o, s, t, f in rows], "ord long, src_lang string, tgt_lang string, src_text string, tgt_text string, file string")
    two = ("SOURCE_CONFLICT", "TARGET_CONFLICT")
    get = lambda x: {r.ord: [c[:1] for c in r.qa_issues] for r in x.collect()}
    assert get(qa.check(d, codes=two)) == {1: ["S", "T"], 2: ["S"], 3: ["T"], 4: [], 5: [], 6: [], 7: ["S", "T"], 8: ["S"], 9: ["S"]}
    assert get(qa.check(d, codes=two, within=("file",))) == {1: ["S"], 2: ["S"], 3: [], 4: [], 5: [], 6: [], 7: [], 8: ["S"], 9: ["S"]}
    # without the texts no exchange has them
    plan = qa.check(d, codes=two).groupBy(F.size("qa_issues")).count()._jdf.queryExecution().optimizedPlan().toString()
    join = next(x for x in plan.split("\n") if "Join LeftOuter" in x)
    assert "src_text" not in join and "_s#" not in join


def test_classes_say_what_they_did(spark):
    """Each character up to U+FFFF alone and between letters, against Python and the plain classes."""
    import unicodedata

    chars = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    d = spark.createDataFrame([(i, f" {x}a {x}{x}b{x}") for i, x in enumerate(chars)], "i int, t string")
    from bitloom.operators import terms

    got = d.select("t", X.nolen(F.col("t")).alias("n"), X.nfc_squeezed("t").alias("q"), X.edge_space(F.col("t")).alias("e"), F.size(F.regexp_extract_all("t", F.lit(terms.TOKEN), F.lit(0))).alias("k"), F.size(F.regexp_extract_all("t", F.lit(r"(?U)[\p{L}\p{Nl}\p{Mn}\p{Mc}]+(?:['’][\p{L}\p{Nl}\p{Mn}\p{Mc}]+)*"), F.lit(0))).alias("k0"), F.regexp_count("t", F.lit(terms._RUN)).alias("r"), F.regexp_count("t", F.lit(r"[\p{L}\p{Nd}_]+")).alias("r0"), X.unbalanced(F.col("t")).alias("u")).collect()
    for r in got:
        assert (r.n, r.q, r.e) == (len("".join(r.t.split())), " ".join(unicodedata.normalize("NFC", r.t).split()), True), r.t
        assert (r.k, r.r) == (r.k0, r.r0), r.t
        assert r.u == [p for p in X.PAIRS if (r.t.count(p[0]) > r.t.count(p[1]) if p == "‘’" else r.t.count(p[0]) != r.t.count(p[1]))], r.t


@pytest.mark.parametrize("name", ["leverage_exact", "leverage_repetition", "quote_rollup_exact", "quote_weighted_exact", "report_bands_zero_fill_exact", "near_dup_exact"])
def test_sql_folds_case_as_the_query_does(spark, tmp_path, name):
    """Sharp s and double s, final sigma, and white space that isn't ASCII's."""
    import duckdb

    from bitloom.plans import catalogue

    text = "Weiße Straße\nWEISSE STRASSE\nστάσις\nΣΤΆΣΙΣ\na b\na b\nİx\ni̇x\nend"
    spark.createDataFrame([(1, text, "de", "x"), (2, "weisse strasse\nend", "de", "y")], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "weisse STRASSE\nother")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = catalogue.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(got.collect()) == order(want)


def test_grams_are_counted_before_they_are_dealt_out(spark):
    """A gram once a batch; of three words and more only those whose neighbours are frequent together, by group."""
    import random
    from collections import Counter

    from bitloom.operators import terms

    rnd = random.Random(5)
    words = ["the", "term", "rate", "l’eau", "Ünder", "plan", *(f"{a}{b}" for a in "bcdfg" for b in "aeiou")]
    lines = [(k, rnd.choice("xy"), " ".join(rnd.choice(words[: rnd.choice((6, 31))]) for _ in range(rnd.randint(0, 14)))) for k in range(1, 301)] + [(301, None, None), (302, "x", "plan")]
    units = spark.createDataFrame([(o, f, t) for o, f, t in lines], "ord long, file string, src_text string")
    for by in ([], ["file"]):
        freq, first = Counter(), {}
        for o, f, t in sorted(lines, key=lambda x: x[0]):
            w = (t or "").split()
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    key = (*([f] if by else []), " ".join(w[i : i + n]), n)
                    freq[key] += 1
                    first.setdefault(key, (o, i + 1))
        for least in (1, 3):
            got = terms.frequencies(units, False, by=by, least=least).select(*by, "text", "length", "freq", "ord", "pos").collect()
            assert sorted(map(tuple, got), key=str) == sorted(((*k, n, *first[k]) for k, n in freq.items() if n >= least), key=str)
    batch = units.select("ord", F.regexp_extract_all(F.coalesce("src_text", F.lit("")), F.lit(terms.TOKEN), F.lit(0)).alias("words"))
    pairs = terms._bits_of(spark.createDataFrame([(["term", "rate"],), (["rate", "term"],)], "words array<string>").mapInArrow(terms._pairs_of([]), "h long"))
    long = batch.coalesce(1).mapInArrow(terms._counting([], range(3, 5), pairs), "text string, n int, freq long, ord long, pos int").collect()
    assert long and len(long) < 30 and {w for r in long for w in r.text.split()} == {"term", "rate"}
    assert len({r.text for r in long}) == len(long)


def test_terms_of_latin_1_are_found_without_patterns(monkeypatch):
    """As patterns that ignore case find them: each character of Latin-1, its neighbours, and letters beyond that match them."""
    import random

    from bitloom.operators import terms

    rnd = random.Random(3)
    letters = [chr(i) for i in range(1, 256)]
    few = "aA bB_1-éÉßµÿ.²ªsSkKåÅiI"
    cases = [(x + y + z, y, lang) for y in letters for x, z in ((" ", " "), (rnd.choice(letters), rnd.choice(letters)), ("", "")) for lang in ("en", "zh")]
    cases += [(x, y, "en") for y in letters for x in (y.upper(), y.lower(), y.swapcase())]
    cases += [("".join(rnd.choice(few) for _ in range(rnd.randint(0, 12))), "".join(rnd.choice(few) for _ in range(rnd.randint(0, 3))), "en") for _ in range(4000)]
    wide = [(x, y, "en") for x in ("ſ", "K", "Å", "ẞ", "μ", "ı", "İ", "Ÿ", "日本") for y in ("s", "k", "å", "ß", "µ", "i", "ÿ", "日")] + [("a s b", "ſ", "en"), ("日本語", "本", "ja"), ("x 日", "日", "en")]
    want = [terms.has_term(*c) for c in cases + wide]
    assert 500 < sum(want) < len(want) - 500
    find = lambda c: terms._Term(c[1], c[2]).inside(terms._Folded(c[0]))
    assert [find(c) for c in cases + wide] == want
    monkeypatch.setattr(terms.X, "bounded", lambda *a: 1 / 0)
    narrow = [k for k, c in enumerate(cases) if max(c[0] + c[1], default="") < "\u0100"]
    assert len(narrow) > 5000 and [find(cases[k]) for k in narrow] == [want[k] for k in narrow]


def test_keys_are_hashed_alike_in_units_and_entries(spark):
    """For each kind what an entry's keys hash to is among what a text with the term hashes to, beside text in another batch."""
    import pyarrow as pa

    from bitloom.operators import terms

    text = "Le Café «noir», 日本語 und 𠮷野 😀x, the CAFÉ"
    d = spark.createDataFrame([("", 0), (None, 1), (text, 2), ("other", 3)], "t string, i int").coalesce(1).orderBy("i")
    having = d.select(*(of(F.coalesce("t", F.lit(""))).alias(name) for name, (of, _) in terms._HASHED.items())).toArrow()
    keys = {k: d.filter("i = 2").select(F.explode(terms._keys(F.col("t"), k)).alias("key")).toArrow()["key"].to_pylist() for k in terms._KINDS}
    assert {k: len(v) for k, v in keys.items() if k in "nw"} == {"n": 8, "w": 8} and all(keys.values())
    for kinds in (["2"], ["3"], ["n"], ["w"], ["2", "3", "n", "w"]):
        row, h = terms._hashes_of(having, kinds)
        assert (row[1:] >= row[:-1]).all() and not set(row.tolist()) & {0, 1}
        own = [k for kind in kinds for k in keys[kind]]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(own))), pa.array([1] * len(own), pa.int32()), pa.array(own)], names=["id", "n", "key"])
        asked = [r["h"] for b in terms._keys_hashed(iter([batch])) for r in b.to_pylist()]
        assert len(set(asked)) == len(own) and set(asked) == set(h[row == 2].tolist())
    row, h = terms._hashes_of(having, ["c"])
    one = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([1, 1], pa.int32()), pa.array(["c:é", "c:日"])], names=["id", "n", "key"])
    assert {r["h"] for b in terms._keys_hashed(iter([one])) for r in b.to_pylist()} <= set(h[row == 2].tolist())


def test_hanzi_of_words(spark):
    import hashlib

    import pyarrow as pa

    got = V._hanzi(pa.array([["a", "bc"], [], None, ["a"]], pa.list_(pa.string())).slice(0, 4)).to_pylist()
    sign = lambda w: chr(int(hashlib.md5(w.encode()).hexdigest()[:3], 16) + 0x4E00)
    assert got == [sign("a") + sign("bc"), "", None, sign("a")]
    assert V._hanzi(pa.array([["z"], ["a", "bc"]]).slice(1)).to_pylist() == [sign("a") + sign("bc")]


def test_a_unit_in_several_groups_is_one_row(spark, monkeypatch):
    """Its words are taken once; counts by group are those of a row a group, and grams that no bitmap has stay out."""
    import random

    from bitloom.operators import terms

    rnd, names = random.Random(9), ["g one", "h", None, "ü"]
    rows = [(k, rnd.sample(names, rnd.randint(0, 4)), " ".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, 9)))) for k in range(1, 200)] + [(200, None, "a b c"), (201, ["h"], None)]
    units = spark.createDataFrame(rows, "ord long, g array<string>, src_text string").coalesce(1)
    monkeypatch.setattr(terms, "WORDS", 40)
    for least in (1, 2, 4):
        got, want = (sorted(map(tuple, terms.frequencies(u, False, by=["g"], least=least).select("g", "text", "length", "freq", "ord", "pos").collect()), key=str) for u in (units, units.withColumn("g", F.explode("g"))))
        assert got == want and len(got) > 100
    some = terms._bits_of(spark.createDataFrame([(["a"],), (["a", "b"],)], "words array<string>").mapInArrow(terms._pairs_of([]), "h long"))
    few = terms.frequencies(units, False, by=["g"], among=some).collect()
    full = {(r.g, r.text): r.freq for r in terms.frequencies(units, False, by=["g"]).collect() if r.text in ("a", "a b")}
    assert {(r.g, r.text): r.freq for r in few} == full and len(full) == 8
