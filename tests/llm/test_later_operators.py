"""Spelling variants, quality rules, leaderboards and pages in unusual wrappers, against brute force."""

import datetime
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("bitloom.llm")
from bitloom.llm import html_text, leaderboard, neighbours, quality_rules, sharding, spellings, toxicity

W = "The old house by the river was sold to a young woman from the city last year, and it was not cheap at all"


# spelling variants


def _variants(rows, every=97):
    count = Counter()
    for i, text in rows:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form = best if best and words[best] >= 2 * n else None
        out[w] = (form, n, len(others), words.get(form))
    last = lambda w: w if out[w][0] is None else last(out[w][0])
    return {(w, f, last(w), n, k, fn) for w, (f, n, k, fn) in out.items()}


SPELT = ["house", "houses", "horse", "hourse", "hoise", "HOUSE", "tree", "trees", "treees", "treess", "Étoile", "étoile", "étoiles", "ètoile", "aaaaa", "aaaaaa", "aaaaaaa", "abaaa"]


@pytest.mark.parametrize("every", [97, 2])
def test_spelling_variants(spark, every):
    rnd = random.Random(every)
    weights = [1 / (1 + i % 7) for i in range(len(SPELT))]
    rows = [(i, rnd.choice((" ", ", ", "1")).join(rnd.choices(SPELT, weights, k=40))) for i in range(40)] + [(None, "house house" * 3), (5, None), (6, ""), (7, " house"), (7, " house")]
    long = "".join(rnd.choice("abc") for _ in range(300))
    rows += [(90, f"{long} {long} {long} {long[:-1]} {long[:-1]} {long[:-1]} {long[:-1]} x{long[1:]} x{long[1:]} x{long[1:]}")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, word string, n string").repartition(3)
    got = [tuple(r) for r in spellings.group_variants(docs, every=every).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = _variants(rows, every)
    assert len(got) == len(want) and set(got) == want


def test_spelling_forms_lead_to_the_last(spark):
    chain = [("a" * (5 + i), 3 * 2**i) for i in range(12)]
    got = {r.word: r.root for r in spellings.variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert got == {w: chain[-1][0] for w, _ in chain}
    ties = spark.createDataFrame([("aaaab", 3), ("aaaac", 6), ("aaaad", 6), ("aaaaé", 6)], "word string, n long")
    assert {r.word: (r.form, r.n_near) for r in spellings.variants(ties).collect()}["aaaab"] == ("aaaac", 3)
    with pytest.raises(ValueError):
        spellings.variants(ties, times=1)


def test_no_spellings(spark):
    assert spellings.group_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spellings.group_variants(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 0


# quality rules


def _measures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), base


def test_quality_rules(spark):
    rnd = random.Random(4)
    texts = [None, "", " \n\t", "a", "a a", "a a a", "a a a a", "a b a b a b", "x y z x y", "é ü x y #*$%&|<>", "l\nl\n \nl\r\nl", f"{W}. {W}. {W}", "word " * 500, "\x0b\x0c x\x1cy", "😀 😀 😀 😀"]
    texts += [" ".join(rnd.choice("abcdefgh") + rnd.choice(("", "#", "\n")) for _ in range(rnd.randint(1, 120))) for _ in range(60)]
    prose = " ".join(rnd.choice(f"{W} and some other words that are of use to the people here".split()) + rnd.choice(("", "", ",", ".\n")) for _ in range(400))
    texts += [prose, prose + " ***" * 300, " ".join(f"w{i}" for i in range(90)), prose * 40]
    rows = [(i if i != 3 else None, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    got = quality_rules.judge(docs.unionByName(docs.limit(1))).collect()
    assert len(got) == len(texts) + 1
    by = {r.doc_id: r for r in got}
    for i, t, *_ in rows:
        r = by[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == _measures(t), t
        assert not (r.base_failed and r.kept) and r.kept == (not r.base_failed and r.broken == "")
    n = len(texts)
    assert by[n - 3].broken == "symbols" and "stop_words" in by[n - 2].broken and by[n - 4].kept == (not by[n - 4].base_failed)
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_a_rule_is_a_row_of_the_table(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "one")], "doc_id long, text string")
    rules = [quality_rules.Rule("some", "n_words", None, 2), quality_rules.Rule("short", "word_chars", "n_words", None, 350)]
    assert {r.doc_id: r.broken for r in quality_rules.judge(docs, rules).collect()} == {1: "short", 2: "some"}


def test_rules_need_no_python(spark):
    plan = quality_rules.judge(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# leaderboards


def _feed(lines, items, vendors):
    """The change feed line by line."""
    price, nation = dict(items), dict(vendors)
    text = lambda x: "" if x is None else str(x)
    rows = []
    for r in lines:
        h = zlib.crc32(",".join(map(text, (r[0], r[2], r[3], r[1]))).encode())
        s = 19723 + h % 150 if r[7] is None else (r[7].date() - datetime.date(1970, 1, 1)).days
        a = s + h % 7 + (20 if h % 5 == 0 else 0)
        rows.append((max(1, min(12, 1 + (a - 19723) * 12 // 180)), a, s, r))
    ends = defaultdict(int)
    for b, _, s, _ in rows:
        ends[b] = max(ends[b], s)
    days = defaultdict(list)
    for b, a, s, r in rows:
        n = nation.get(r[3])
        if n is None or r[2] not in price or s + 8 < max((ends[x] for x in ends if x < b), default=s):
            continue
        cents = math.floor(100 * r[5] + 0.5) if r[5] is not None else r[4] * math.floor(100 * price[r[2]] + 0.5) if r[4] is not None and price[r[2]] is not None else 0
        days[a].append((n, r[2], -cents if r[6] == "returned" else cents, b))
    revenue, boards, out = defaultdict(Counter), defaultdict(list), []
    for a in sorted(days):
        for n, i, c, _ in days[a]:
            revenue[n][i] += c
        for n in {x[0] for x in days[a]}:
            new = sorted((i for i, v in revenue[n].items() if v > 0), key=lambda i: (-revenue[n][i], i))[:10]
            old, boards[n] = boards[n], new
            for i in {*old, *new}:
                o, w = (x.index(i) + 1 if i in x else None for x in (old, new))
                if o != w:
                    out.append((n, a, i, days[a][0][3], "enter" if o is None else "exit" if w is None else "move", o, w, revenue[n][i]))
    return out


LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, flag string, shipped_at timestamp_ntz, nation_id string, cents string"


@pytest.fixture(scope="module")
def shop(spark):
    rnd = random.Random(12)
    items = [(i, None if i % 9 == 0 else round(rnd.random() * 40, 2)) for i in range(40)]
    vendors = [(v, None if v == 4 else v % 3) for v in range(9)]
    start = datetime.datetime(2024, 1, 1, 7)
    lines = []
    for k in range(900):
        item = 7 if rnd.random() < 0.33 else rnd.choice((None, *range(44)))
        amount = None if rnd.random() < 0.1 else rnd.choice((5.0, 10.0, 10.0, round(rnd.random() * 50, 2)))
        when = None if rnd.random() < 0.05 else start + datetime.timedelta(days=rnd.randint(0, 148), hours=rnd.randint(0, 16))
        lines.append((rnd.choice((None, k, k)), k % 4, item, rnd.choice((None, *range(11))), rnd.choice((None, 1, 3)), amount, rnd.choice(("kept", "returned", None)), when))
    lines += lines[:40]
    at = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    tables = at([(*r, "x", "y") for r in lines], LINES), at([*items, (None, 1.0), items[3]], "item_id long, price double"), at([*vendors, (None, 1), vendors[2]], "vendor_id long, nation_id int")
    return lines, items, vendors, tables


def test_leaderboard(shop, monkeypatch):
    lines, items, vendors, tables = shop
    want = sorted(map(str, _feed(lines, items, vendors)))
    assert {x.split(", ")[4] for x in want} == {"'enter'", "'exit'", "'move'"}
    monkeypatch.setattr(leaderboard, "SHARE", 9)  # several shares a nation
    got = leaderboard.leaderboard_changes(*tables)
    assert [t for _, t in got.dtypes] == ["int", "bigint", "bigint", "int", "string", "int", "int", "bigint"]
    assert sorted(str(tuple(int(x) if isinstance(x, float) else x for x in r)) for r in got.collect()) == want


def test_leaderboard_of_nothing(spark, shop):
    lines, items, vendors = (t.limit(0) for t in shop[3])
    assert leaderboard.leaderboard_changes(lines, items, vendors).count() == 0
    assert leaderboard.leaderboard_changes(shop[3][0].limit(5), items, vendors).count() == 0


def test_board_skips_old_entries():
    rnd = random.Random(3)
    board, revenue = leaderboard.Board({}), Counter()
    for _ in range(3000):
        i, c = rnd.randint(0, 30), rnd.randint(-5, 5)
        board.add(i, float(c))
        revenue[i] += c
        if rnd.random() < 0.2:
            want = sorted((i for i, r in revenue.items() if r > 0), key=lambda i: (-revenue[i], i))[:10]
            assert list(board.top().items()) == [(i, float(revenue[i])) for i in want]
            assert len(board.heap) <= 2 * len(revenue) + 64 + 10


# pages


def test_no_article_is_lost_to_its_wrappers():
    article = f"<article><h1>A title</h1><p>{W}.</p><p>One.</p></article>"
    want = ["A title", W + ".", "One."]
    pages = [
        f"<div class='wrap nav-open'>{article}</div>", f"<div class='site header-fixed'>{article.replace('article', 'main')}</div>", f"<div class='layout sidebar-right'>{article}<div class=sidebar><p>{W}</p></div></div>",
        f"<nav><ul><li><a>Home</a></ul>{article}", f"<div class=sidebar-right><p>{W}</p></div>{article}", f"<div class=sidebar>{article}</div>", f"<div id=comments><article><p>{W}</p></article></div>{article}",
        f"<header>Site<main><h1>A title</h1><p>{W}.</p><p>One.</p></main>", article.replace("</article>", f"<section><h3>3 comments</h3><p>{W}</p></section></article>"),
    ]
    for page in pages:
        assert html_text.main_text(page).split("\n") == want, page
    assert html_text.main_text(f"<div class='content menu-open'><h1>A title</h1><p>{W}.</p><p>{W}!</p></div>").split("\n") == ["A title", W + ".", W + "!"]


def test_lists_and_short_paragraphs_between_prose_stay():
    page = f"<div><a>Home</a></div><h1>Title</h1><p>{W}.</p><p>{W}.</p><ol><li>Look well before you leap over it.<li>Go.</ol><p>Yes.</p><dl><dt>a<dd>b</dl><p>{W}.</p><p>{W}.</p><section><h3>Comments</h3><p>{W}</p><p>{W}</p></section>"
    assert html_text.main_text(page).split("\n") == ["Title", W + ".", W + ".", "Look well before you leap over it.", "Go.", "Yes.", "a", "b", W + ".", W + "."]
    assert html_text.joined([("x", 9, 0, False, False, False)] * 3, [True, False, True]) == [True] * 3
    assert html_text.joined([("x", 9, 0, False, i == 1, False) for i in range(3)], [True, False, True]) == [True, False, True]
    assert html_text.joined([("x", 9, 4 * (i == 1), False, False, False) for i in range(3)], [True, False, True]) == [True, False, True]


def test_a_very_long_page(spark):
    page = "<div>" * 20_000 + "<article>" + f"<p>{W}.</p>" * 20_000
    d = spark.createDataFrame([(1, "u", page, "t", 1)], "page_id long, url string, html string, text string, n_chars int")
    r = html_text.extract_text(d).select(F.length("text").alias("n"), "n_chars").first()
    assert r.n == r.n_chars == 20_000 * (len(W) + 2) - 1


# clashing names, empty tables and repeats of earlier operators


def test_toxicity_of_odd_tables(spark):
    rows = [(i, "you vile fool" if i % 3 == 0 else "a fine day for all", "x", 0.5, True) for i in range(60)]
    schema = "doc_id long, text string, labels string, p_toxic double, is_toxic boolean"
    docs = spark.createDataFrame(rows + rows[:1] * 50, schema)  # an id with very many rows
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "y") for i in range(60)], "doc_id long, toxic int, n string")
    once = toxicity.train(spark.createDataFrame(rows, schema), labels, ["toxic"])
    many = toxicity.train(docs, labels, ["toxic"])
    assert (many.words == once.words).all() and abs(many.weights[0] - once.weights[0]).max() < 1e-9
    got = toxicity.score_toxicity(docs, many).collect()
    assert len(got) == 110 and all(r.is_toxic == (r.doc_id % 3 == 0) for r in got)
    assert toxicity.score_toxicity(docs.limit(0), many).count() == 0
    for d, n in ((docs, labels.limit(0)), (docs.limit(0), labels)):
        none = toxicity.train(d, n, ["toxic"])
        assert {r.p_toxic < 1e-9 for r in toxicity.score_toxicity(docs, none).collect()} == {True}


def test_other_columns_dont_matter(spark):
    d = spark.createDataFrame([(i, [float(i), 1.0], "v", "q", 1) for i in range(150)], "vec_id long, embedding array<double>, v string, q string, dim int")
    got = neighbours.nearest(d).filter("query_id = 100").orderBy("rank").collect()
    assert [r.vec_id for r in got][:4] == [99, 101, 98, 102]
    s = spark.createDataFrame([(i, "t" * i, 9, "x") for i in range(30)], "doc_id long, text string, size int, h string")
    assert sharding.shard_by_bytes(s, 4).count() == 30 and sharding.shard_by_bytes(s.limit(0), 4).count() == 0
