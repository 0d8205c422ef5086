"""Each operator against brute force on a small table with nulls, empty and long texts, ties, repeats."""

import array
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("bitloom.llm")
from bitloom.llm import html_text, jaccard, languages, mixing, neighbours, order_minhash, pieces, sharding, substrings, toxicity
from bitloom.llm.queries import WEIGHTS, vocabulary_path

MODEL = vocabulary_path()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pid int, class string"


def _docs():
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    base = " ".join(rnd.choice(words) for _ in range(60))
    texts = [None, "", " ", "one", "a b c", base, base, base + " tail", base.replace("w1 ", "x "), base.upper(), "Über straße 日本 😀\nnew\tline ", "a " * 3000]
    texts += [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 80))) for _ in range(30)]
    texts += [base[:150] + " " + " ".join(rnd.choice(words) for _ in range(20)) for _ in range(6)]
    texts += [" ".join(map(str, range(n))) for n in range(4, 22)] + [" ".join([*map(str, range(n)), "z"]) for n in range(8, 22)]
    rows = [(i, t, ("en", "de", None)[i % 3], f"src{i % 4}" if i % 5 else None, None, 1, "x") for i, t in enumerate(texts)]
    return rows + [(None, "no id here at all", None, None, None, None, None), rows[6]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_docs(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(t, lower=False):
    t = t or ""
    if lower:
        t = "".join(c.lower() if c.isascii() else c for c in t)
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def _no_id(i):
    return 1 << 62 if i is None else i


def test_encoding_equals_the_library(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for check in ("words", "texts"):
        got = {r.doc_id: r for r in pieces.encode_pieces(docs, MODEL, check=check, keep=True).collect()}
        assert len(got) == len({r[0] for r in _docs()})
        for i, t, *_ in _docs():
            ids = sp.encode(t or "", add_bos=True, add_eos=True)
            r = got[i]
            assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == sp.decode(ids)
            assert r.ids_sha256 == hashlib.sha256(array.array("I", ids).tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert pieces.encode_pieces(docs, MODEL).count() == len(_docs()) and pieces.encode_pieces(none, MODEL).count() == 0


def test_encoding_of_random_texts():
    v, rnd, signs = pieces.vocabulary(MODEL), random.Random(3), "abcde  ▁\n\t éßñ日本😀\x00\r019.,'-THing"
    for _ in range(3000):
        t = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60)))
        ids = array.array("I", v.encode_text(t, [])).tolist()
        assert ids == v.library.encode(t) and v.decode(ids) == v.library.decode(ids)


def test_order_minhash(docs, none):
    rows = sorted({(_no_id(i), t or "") for i, t, *_ in _docs()})
    got = sorted(order_minhash.compare_edited(docs).collect(), key=lambda r: _no_id(r.doc_id))
    assert len(got) == len(rows)
    marks = {}
    for k, ((i, t), r) in enumerate(zip(rows, got)):
        after = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert marks.setdefault(t, r.fingerprint) == r.fingerprint and marks.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (t != edited or r.near_edited == 1)
    assert order_minhash.compare_edited(none).count() == 0


def test_order_minhash_entries(spark):
    """The selected pair of each order by brute force, with occurrence numbers."""
    texts = ["a b a b a b c", "x", "", "q r s t u v w x y z"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.omh for r in order_minhash.fingerprints(d, ["i"], m=4).collect()}
    hash_of = lambda *xs: spark.range(1).selectExpr(f"xxhash64({', '.join(xs)}) as h").first().h
    for i, t in enumerate(texts):
        tok = t.split()
        seen, items = {}, []
        for p in range(max(len(tok) - 1, min(1, len(tok)))):
            h = hash_of(*(f"'{x}'" for x in tok[p : p + 2])) << 30 >> 30
            h = ((h & ((1 << 34) - 1)) ^ (1 << 33)) - (1 << 33)
            items.append((hash_of(f"{h}L", str(seen.get(h, 0))), p))
            seen[h] = seen.get(h, 0) + 1
        if not items:
            assert got[i] == []
            continue
        for j in range(4):
            order = sorted((hash_of(f"{e}L", str(j)) & -(1 << 30) | p) for e, p in items)
            a, b = order[0], order[-1]
            x, y = (a, b) if a & ((1 << 30) - 1) <= b & ((1 << 30) - 1) else (b, a)
            assert got[i][j] == hash_of(f"{x >> 30}L", f"{y >> 30}L")


def test_order_tells_moved_text(spark):
    words = [f"word{i}" for i in range(200)]
    turned = words[100:] + words[:100]
    d = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(turned)), (2, " ".join(words[:190] + ["new"] * 10))], "i int, text string")
    f = {r.i: r.omh for r in order_minhash.fingerprints(d, ["i"], m=64).collect()}
    like = lambda a, b: sum(x == y for x, y in zip(f[a], f[b])) / 64
    assert like(0, 2) > like(0, 1) + 0.15


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "一丁三丏世並中丸主乃久乍乏乐乘乙九乡买乱乳予事二于亏五井亚些交亦人什仁今从仓他付代以仰件任份企伊伍休众优会伟传伤伦估伴伸佐体何余你作佩使來例供依侯便俗保信俩俱個倍倒候值假偏做停健", "のをはにがとでもしてれさあるいうえおかきくけこ", "ACGT"])
def test_change_in_a_run_without_spaces(spark, letters):
    """A character put in near the start moves the cuts beside it alone; words of up to 16 stay whole."""
    r = random.Random(3)
    text = "".join(r.choices(letters, k=3000))
    other = "".join(r.choices(letters, k=3000))
    d = spark.createDataFrame([(0, text), (1, text[:5] + letters[1] + text[5:]), (2, other)], "i int, text string")
    f = {x.i: x.omh for x in order_minhash.fingerprints(d, ["i"], m=64).collect()}
    like = lambda a, b: sum(x == y for x, y in zip(f[a], f[b])) / 64
    assert like(0, 1) > 0.85 and like(0, 1) > like(0, 2) + 0.3


def test_tokens_of_order_minhash(spark):
    d = spark.createDataFrame([("internationalise it\tsix", "x" * 30, "bcdfgabcdfgabcdfgabc")], "a string, b string, c string")
    got = d.select(*(F.regexp_extract_all(c, F.lit(order_minhash.TOKENS), F.lit(0)).alias(c) for c in "abc")).first()
    assert got.a == ["internationalise", "it", "six"] and got.b == ["x" * 12, "x" * 12, "x" * 6] and got.c == ["bcdfga", "bcdfga", "bcdfga", "bc"]


def test_mixing(docs, none):
    got = mixing.positions(docs, WEIGHTS, block_rows=2).collect()
    assert sorted(r.position for r in got) == list(range(len({r[:4] for r in _docs()})))
    assert mixing.positions(none, WEIGHTS).count() == 0
    assert mixing.mixed(docs, WEIGHTS).count() == len(_docs()) and mixing.mixed(docs, WEIGHTS).columns == docs.columns


@pytest.mark.parametrize("weights", [{"a": 3, "b": 2, "c": 1}, {"a": 1}, {"a": 7, "b": 1, "c": 1, "d": 4}, {"a": 5, "b": 5}])
def test_schedule_keeps_shares(weights):
    plan, total = mixing.frame(weights), sum(weights.values())
    done = dict.fromkeys(weights, 0)
    for t, s in enumerate(plan * 3, 1):
        done[s] += 1
        assert all(abs(done[x] - t * w / total) < 1 for x, w in weights.items())
    blocks = {s: 3 + 5 * i for i, s in enumerate(weights)}
    slots = sorted(start + k // len(at) * w + at[k % len(at)] for _, _, n, start, w, at in mixing.phases(blocks, weights) for k in range(n))
    assert slots == list(range(sum(blocks.values())))


def test_language(spark, none):
    rnd, rows = random.Random(1), []
    own = {"xx": "abcdefgh", "yy": "efghijkl"}
    for i in range(300):
        lang = ("xx", "yy")[i % 2]
        rows.append((i, " ".join("".join(rnd.choice(own[lang]) for _ in range(rnd.randint(2, 8))) for _ in range(12)), lang))
    rows += [(900, None, "xx"), (901, "12 34 --", "yy"), (902, "", None), (903, "abc " * 3000 + "a" * 3000, None), (None, "abcd", "xx")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in languages.identify(d, MODEL).collect()}
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"} and got[903].lang_pred == "xx" and not got[None].held_out
    import zlib

    tested = [(i, lang) for i, _, lang in rows[:300] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i, _ in tested) and sum(got[i].lang_pred == lang for i, lang in tested) >= 0.95 * len(tested)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert languages.identify(none, MODEL).count() == 0


def test_forward_sums_all_segmentations():
    table = {"▁": 1, "▁a": 2, "a": 3, "ab": 4, "b": 5, "▁ab": 6}
    prob = np.array([[1e-3], [0.1], [0.2], [0.15], [0.25], [0.05], [0.3]])

    def brute(s):
        if not s:
            return 1.0
        whole = sum(prob[table[s[:n]], 0] * brute(s[n:]) for n in range(1, len(s) + 1) if s[:n] in table)
        return whole + (prob[0, 0] * brute(s[1:]) if s[0] not in table else 0)

    words = ["a", "ab", "abba", "axb", "b" * 30]
    got = languages.Lattice(table).forward(["▁" + w for w in words], prob)
    assert np.allclose(got[:, 0], [np.log(brute("▁" + w)) for w in words])


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href=x>Home</a><li><a>About</a></ul></nav>
    <header>Site name</header><div class="cookie-notice">We use cookies for all sorts of things that you may agree to or not.</div><div class=ad>Buy this now, it is very cheap indeed.</div>
    <article><h1>A &amp; B&nbsp;title</h1><p>First <b>para</b>graph with   some\n text &lt;tag&gt; and more words to read here.<p>Second.<br>line &copy;</p><aside>Related things to read that are of no interest</aside></article>
    <div id="comments"><p>Nice article, thank you very much for writing it all down for the rest of us.</p></div><form><p>Your name please and mail address</p></form><!-- <p>hidden</p> --><footer>&copy; me</footer></body>"""
    want = "A & B title\nFirst paragraph with some text <tag> and more words to read here.\nSecond. line ©"
    assert html_text.main_text(page) == want
    d = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<article><p>cut off <b>te"), (5, "u", "<div>" * 5000 + "x < y"), (5, "u", "<nav>a")], "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in html_text.extract_text(d).collect())
    assert ("1", want, len(want)) in got and ("2", "", 0) in got and ("3", "", 0) in got and ("None", "cut off te", 10) in got and len(got) == 6


def test_html_raw_elements_end_at_their_own_tag():
    text = "The old house by the river was sold to a young woman from the city last year, and it was not cheap at all."
    want = [text, text + " Again."]
    after = f"<article><p>{text}</p><p>{text} Again.</p></article>"
    for raw in ("<script>for(i=0;i<n;i++){f()}</script>", "<SCRIPT>if(a<b)c='it</Script >", "<script>'<!--'</script>", "<style>a<b{}</style>", "<textarea>1 <b</textarea>", "<svg><style>a<b \"{}</style><title>T</title></svg>", "<svg><!-- </svg> <p>no --></svg>", "<script>a</scripts><p>no</p></script>"):
        assert html_text.main_text(f"<html><body>{raw}{after}</body></html>").split("\n") == want, raw
    for head in ("<head><title>T</title>", "<head><meta charset=utf-8><script>if(a<b){}</script><title>T</title><body>", "<head><title>T</title></head>", "<HEAD><style>p{}</style><link rel=x></HEAD><body>"):
        assert html_text.main_text(f"<html>{head}{after}</html>").split("\n") == want, head
    assert html_text.main_text(f"{after}<script>for(;i<n;){{}} <p>{text}</p>").split("\n") == want  # to the page's end


def test_sharding(docs, none):
    got = sharding.shard_by_bytes(docs, 5).collect()
    assert len(got) == len(_docs())
    total, top = sum(r.size for r in got), max(r.size for r in got)
    for s in range(5):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and abs(sum(r.size for r in got if r.shard == s) - total / 5) <= 2 * top
    assert sharding.shard_by_bytes(none).count() == 0


def test_jaccard(docs, none):
    rows = [(_no_id(i), t) for i, t, *_ in _docs()]
    sets = []
    for _, t in rows:
        w = _words(t, True)
        sets.append({tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    link = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)
    n = len(rows)
    near = [[j for j in range(n) if j != i and link(sets[i], sets[j])] for i in range(n)]

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        return min(rows[j][0] for j in seen)

    want = sorted((rows[i][0], len(sets[i]), reach(i), len(near[i])) for i in range(n))
    got = sorted((_no_id(r.doc_id), r.n_shingles, _no_id(r.component_id), r.n_links) for r in jaccard.jaccard_join(docs).collect())
    assert got == want and sum(x[3] for x in want) > 20
    assert jaccard.jaccard_join(none).count() == 0
    stay = jaccard.one_of_each(docs)
    assert sorted(_no_id(r.doc_id) for r in stay.collect()) == sorted({x[2] for x in want} | {x[0] for x in want if x[1] == 0}) and stay.columns == docs.columns


def test_light_subsets_beyond_lists(spark):
    """Near copies of all small sizes, one word changed at an end."""
    rows = [(1000 * n + c, " ".join(f"t{n}_{i}" for i in range(n)) + (f" e{c}" if c else "")) for n in range(8, 40) for c in range(4)]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for n in range(8, 40):
        s = n - 4
        linked = 100 * s >= 80 * (s + 1)
        assert [got[1000 * n + c] for c in range(4)] == ([1000 * n] * 4 if linked else [1000 * n + c for c in range(4)])


def test_substrings(docs, none):
    rows = [(_no_id(i), t) for i, t, *_ in _docs()]
    first = {}
    for i, t in rows:
        w = _words(t)
        for a in range(len(w) - 12):
            key = tuple(w[a : a + 13])
            first[key] = min(i, first.get(key, i))
    want = []
    for i, t in rows:
        w = _words(t)
        keep = [True] * len(w)
        for a in range(len(w) - 12):
            if first[tuple(w[a : a + 13])] < i:
                keep[a : a + 13] = [False] * 13
        body = " ".join(x for x, k in zip(w, keep) if k)
        want.append((i, len(w), keep.count(False), hashlib.sha256(body.encode()).hexdigest()))
    got = sorted((_no_id(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_substrings(docs).collect())
    assert got == sorted(want) and sum(x[2] for x in want) > 100
    assert substrings.dedup_substrings(none).count() == 0
    out = substrings.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == sum(1 for x in want if x[2] == 0 or x[2] < x[1])


@pytest.mark.parametrize("small", [False, True])
def test_neighbours(spark, monkeypatch, small):
    """Against brute force; small: many shards, cells of several shards, blocks of few queries."""
    if small:
        monkeypatch.setattr(neighbours, "ROWS", 100)
    rng = np.random.default_rng(5)
    v = rng.standard_normal((1500, 32)).astype(np.float32)
    v[200:700] = v[100]  # a third of all rows is one vector
    v[900:1100] = v[900] + 0.01 * v[900:1100]
    rows = [(i, [float(x) for x in v[i]]) for i in range(1500)] + [(1600, None), (1700, [0.0] * 32), (1800, [float("nan")] * 32), (None, [1.0] * 32), (1900, [1.0, None] * 16), (2000, [1.0, 2.0]), (3, [float(x) for x in v[3]])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, verified = {}, {}
    for r in neighbours.nearest(d, sample_rows=600 if small else 20_000, block_rows=3 if small else 1000).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
        verified[r.query_id] = r.verified
    assert sorted(got) == [i for i in range(0, 1500, 100)]
    x, hits = v.astype(float), 0
    for q, found in got.items():
        d2 = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = sorted((d2[i], i) for i in range(1500) if i != q)[:10]
        assert sorted(found) == list(range(1, 11)) and all(abs(s - d2[i]) < 1e-9 for i, s in found.values())
        assert [found[i] for i in range(1, 11)] == sorted(found.values(), key=lambda y: (y[1], y[0]))
        if d2[best[-1][1]] == 0:
            assert [i for i, _ in (found[j] for j in range(1, 11))] == [i for _, i in best]  # ties go to the smaller id
        hits += len({i for _, i in best} & {i for i, _ in found.values()})
    assert hits >= 0.9 * 150 and np.mean(list(verified.values())) < 0.8 * 1001
    few = neighbours.nearest(d.filter("vec_id < 4 or vec_id is null")).collect()
    assert len(few) == 3
    assert neighbours.nearest(d.filter("false")).count() == 0


@pytest.mark.parametrize("n", [300, 3000, 20_000])
def test_neighbours_recall_and_share(n):
    """Recall and the share of vectors verified by one shard, on vectors without any structure."""
    rng = np.random.default_rng(n)
    v = rng.standard_normal((n, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    p = v @ neighbours.axes(64, 24)
    shard = neighbours.Shard.build([np.array([i]) for i in range(n)], v, p)
    stop, hits, looked = neighbours.chi2_quantile(0.95, 24) / 1.02**2, 0, 0
    for q in range(40):
        ids, d2, seen = shard.search(v[q], p[q], 11, stop)
        looked += seen
        true = ((v - v[q]) ** 2).sum(axis=1)
        hits += len(set(np.lexsort((np.arange(n), true))[:11].tolist()) & set(ids.tolist())) - 1
        assert np.allclose(d2, true[ids])
    assert hits >= 0.9 * 400 and looked <= {300: 0.8, 3000: 0.6, 20_000: 0.5}[n] * 40 * n


def test_neighbours_order_is_that_of_projections():
    """With a stop that never comes every point is verified and the result is exact; with confidence 0, few are."""
    rng = np.random.default_rng(1)
    v = rng.standard_normal((500, 8))
    p = v @ neighbours.axes(8, 4)
    shard = neighbours.Shard.build([np.array([i]) for i in range(500)], v, p)
    again = neighbours.Shard.unpacked(shard.packed(), 8, 4)
    ids, d2, seen = again.search(v[7], p[7], 5, 1e9)
    assert seen == 500 and ids.tolist() == np.argsort(((v - v[7]) ** 2).sum(axis=1))[:5].tolist()
    assert shard.search(v[7], p[7], 5, 1e-9)[2] <= 3 * neighbours.CHUNK
    order, spans, splits = neighbours.cut(p, 32)
    assert sorted(order.tolist()) == list(range(500)) and max(b - a for a, b in spans) <= 32
    leaf = neighbours.leaf_of(p, splits)
    assert all((leaf[order[a:b]] == i).all() for i, (a, b) in enumerate(spans))


def test_chi_square():
    assert abs(neighbours.chi2_cdf(15.507, 8) - 0.95) < 1e-4 and abs(neighbours.chi2_quantile(0.95, 8) - 15.507) < 1e-2


def test_toxicity(spark, none):
    rnd, rows, labels = random.Random(2), [], []
    for i in range(600):
        bad, junk = i % 6 == 0, i % 5 == 0
        w = [f"w{rnd.randint(0, 300)}" for _ in range(40)] + ["Idiot!"] * bad + ["zzz"] * junk
        rnd.shuffle(w)
        rows.append((i, " ".join(w)))
        if i < 400:
            labels.append((i, 1 - junk, int(bad)))
    rows += [(900, None), (901, ""), (None, "idiot"), (903, "w1 " * 20000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (5, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(d, lab, ["quality", "toxic"])
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, chain).collect()}
    assert all(got[i].is_toxic == (i % 6 == 0) for i in range(400, 600)) and got[None].is_toxic and not got[900].is_toxic and not got[903].is_toxic
    empty = toxicity.train(d, lab.filter("false"), ["quality", "toxic"])
    assert toxicity.score_toxicity(d, empty).filter("is_toxic").count() == 0 and toxicity.score_toxicity(none, chain).count() == 0


CLASHES = ("score", "held_out", "lang_pred", "_at", "_text", "_id", "_hash", "_mix_hash", "_mix_id", "row", "h", "s", "position", "class", "pid", "kept", "at", "a.b", "word", "c0")


def _clashing(spark, n=40):
    base = "the house of the old man by the river was sold to a young woman from the city last year".split()
    rows = [(i, " ".join(base[(i + j * (i % 7 + 1)) % len(base)] + f"{i}x" * (j % 3 == 0) for j in range(30)), "en", f"src{i % 3}", None, *(f"{c}{i}" for c in CLASHES)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))


def test_clashing_columns_come_back_as_they_are(spark):
    d = _clashing(spark)
    want = {r.doc_id: tuple(r[5:]) for r in d.collect()}
    for out in (languages.told(d, MODEL, 0.0), jaccard.one_of_each(d), substrings.without_repeats(d), mixing.mixed(d, WEIGHTS)):
        assert out.columns == d.columns
        assert {r.doc_id: tuple(r[5:]) for r in out.collect()} == want
    got = languages.identify(d, MODEL)
    assert {"held_out", "lang_pred", "score"} <= set(got.columns) and dict(got.dtypes)["score"] == "double" and got.count() == len(want)
    for out in (pieces.encode_pieces(d, MODEL), order_minhash.compare_edited(d), sharding.shard_by_bytes(d), jaccard.jaccard_join(d), substrings.dedup_substrings(d), mixing.positions(d, WEIGHTS)):
        assert out.count() == len(want)
    assert mixing.mixed(d, WEIGHTS, position="position").filter("position = 0").count() == 1


def test_expected_counts_are_those_of_all_segmentations():
    """One round of training against sums over all segmentations, and words of any length."""
    table = {"▁": 1, "▁a": 2, "a": 3, "ab": 4, "b": 5, "▁ab": 6, "bb": 7}
    q = np.array([1e-3, 0.1, 0.2, 0.15, 0.25, 0.05, 0.15, 0.1])

    def ways(s):
        if not s:
            yield ()
        for n in range(1, len(s) + 1):
            if s[:n] in table or n == 1:
                yield from ((table.get(s[:n], 0), *w) for w in ways(s[n:]))

    words = {"a": 3, "ab": 1, "abba": 2, "axbb": 5, "bbbbb": 1}
    want = np.zeros(len(q))
    for w, n in words.items():
        found = list(ways("▁" + w))
        mass = [np.prod(q[list(f)]) for f in found]
        for f, m in zip(found, mass):
            np.add.at(want, list(f), n * m / sum(mass))
    lattice = languages.Lattice(table)
    assert np.allclose(languages.Counter(lattice, ["▁" + w for w in words], np.array(list(words.values()), float)).counts(q), want)
    long = "▁" + "ab" * 30_000
    got = languages.Counter(lattice, [long], np.ones(1)).counts(q)
    assert np.isfinite(got).all() and abs(sum(got[i] * len(p) for p, i in table.items()) - len(long)) < 0.1
    assert lattice.parts("abx" * 40) == ["▁ab", *["x", "ab"] * 39, "x"] and lattice.parts("abx") == ["▁abx"]


def test_long_words_train_and_are_told(spark):
    """Languages without spaces: every word is longer than 40 characters, one has 100,000."""
    rnd, own = random.Random(4), {"xx": "abcdefgh", "yy": "stuvwxyz"}
    rows = [(i, "".join(rnd.choice(own[("xx", "yy")[i % 2]]) for _ in range(41 + i)), ("xx", "yy")[i % 2]) for i in range(60)]
    rows += [(100, "abc" * 33_333 + "d", "xx"), (101, "xyz" * 33_333 + "s", None), (102, "hgfe" * 100, None)]
    got = {r.doc_id: r for r in languages.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), MODEL).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if lang) and got[101].lang_pred == "yy" and got[102].lang_pred == "xx"


def test_forward_in_stretches(monkeypatch):
    table = {"▁": 1, "a": 2, "ab": 3, "b": 4, "aba": 5}
    prob = np.array([[1e-8], [0.1], [0.2], [0.3], [0.1], [0.2]])
    lattice, words = languages.Lattice(table), ["▁" + "ab" * 40, "▁a", "▁" + "ba" * 17]
    whole = lattice.forward(words, prob)
    monkeypatch.setattr(languages, "STRETCH", 7)
    assert np.allclose(lattice.forward(words, prob), whole)


def test_kept_words_are_bounded(monkeypatch):
    v = pieces.Vocabulary(MODEL)
    monkeypatch.setattr(pieces, "KEPT", 20_000)
    rnd = random.Random(9)
    for _ in range(400):
        t = " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 12))) for _ in range(20))
        assert array.array("I", v.encode_text(t, [])).tolist() == v.library.encode(t)
        assert len(v.packed) < 200 and v.parts_size <= 5500


def test_mixing_positions_by_walking_slots(docs):
    """Every row's position against brute force: one slot after another, earliest deadline first."""
    rows = {(r.doc_id, r.text_hash): r for r in mixing.positions(docs, {"src0": 6, "src1": 2, "src3": 4, "other": 2}, block_rows=2).collect()}
    waiting = {}
    for r in rows.values():
        waiting.setdefault(r.source, []).append(r)
    for s in waiting:
        waiting[s].sort(key=lambda r: r.position)
    at, start = 0, 0
    weights = {"src0": 3, "src1": 1, "src3": 2, "other": 1}
    assert set(waiting) == set(weights)
    while waiting:
        total, served = sum(weights[s] for s in waiting), dict.fromkeys(waiting, 0)
        for slot in range(1 << 20):
            free = [s for s in waiting if served[s] * total // weights[s] <= slot]
            s = min(free, key=lambda s: (-(-(served[s] + 1) * total // weights[s]), s))
            served[s] += 1
            for r in waiting[s][:2]:
                assert (r.position, r.slot) == (at, start + slot)
                at += 1
            del waiting[s][:2]
            if not waiting[s]:
                del waiting[s]
                start += slot + 1
                break
    assert at == len(rows)
    with pytest.raises(ValueError):
        mixing.positions(docs, {"a": 10**6 + 1, "b": 10**6})


def test_sharding_by_brute_force(docs):
    """Sizes, checksums, and shards cut from the sorted rows, groups of equal texts no larger than the largest row as one."""
    import zlib

    got = sharding.shard_by_bytes(docs, 5).collect()
    want_size = sorted((_no_id(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in _docs())
    assert sorted((_no_id(r.doc_id), r.size, r.text_crc32) for r in got) == want_size
    total, top = sum(r.size for r in got), max(r.size for r in got)
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    shards_of, at, size = {}, 0, {}
    for r in order:
        size[r.text_crc32] = size.get(r.text_crc32, 0) + r.size
    for r in order:
        shards_of.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for c, s in shards_of.items() if size[c] <= top)
    seen = set()
    for r in order:  # the middle of each row, or of its group of equal texts, tells its shard
        g = size[r.text_crc32] if size[r.text_crc32] <= top else r.size
        if size[r.text_crc32] > top or r.text_crc32 not in seen:
            seen.add(r.text_crc32)
            assert r.shard == min((2 * at + g) * 5 // (2 * total), 4)
            at += g
    assert at == total and all(abs(sum(r.size for r in got if r.shard == s) - total / 5) < top for s in range(5))


def test_empty_tables(spark, none):
    e = none
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    for out in (languages.told(e, MODEL, 0.5), jaccard.one_of_each(e), substrings.without_repeats(e), mixing.mixed(e, WEIGHTS)):
        assert out.count() == 0 and out.columns == e.columns


W = "the old house by the river was sold to a young woman from the city last year and it was not cheap at all"


def test_html_swallows_nothing():
    article = f"<article><h1>A title</h1><p>{W}.</p><p>One.</p></article>"
    want = ["A title", W + ".", "One."]
    pages = {
        f"<html><head><title>T</title><body>{article}": want,
        f"<script>for(i=0;i<n;i++){{}}</script>{article}": want,
        f"<script><!-- x() </script>{article}": want,
        **{f"<div><{t}>x</div>{article}": want for t in ("select", "template", "noscript", "nav")},
        f"<article><h1>A title</h1><p>{W}.</p><video src=x><p>One.</p></article>": want,
        f"<article><h1>A title</h1><p>{W}.</p><canvas>One.</article><p>": want,
        f"<article><p class='related-work'>{W}.</p><p class='lead skip-intro'>One.</p><p class=ad>{W}</p></article>": [W + ".", "One."],
        f"<article><p>{W} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> <svg><title>no</title><text>label</text></svg></p></article>": [W + " x=2 label"],
        f"<form id=aspnetForm><div>{article}</div><p>Your name please</p></form>": want,
        f"<article><header><h1>A title</h1><p>by someone</p></header><p>{W}.</p><p>One.</p><footer>{W}</footer></article>": want,
        f"<div class='post has-sidebar'><article class='no-comments'><h1>A title</h1><p>{W}.</p><p>One.</p></article></div>": want,
        f"<article><ul class=menu><li>a<li>b</ul><h1>A title</h1><p>{W}.</p><p>One.</p></article>": want,
    }
    for page, lines in pages.items():
        assert html_text.main_text(page).split("\n") == lines, page


def test_html_density_alone_decides():
    """No element or name tells here; every decision of the tree's looks at words and links as well."""
    page = f"<div class=topbar><a>Home</a> <a>Products and services list</a></div><table><tr><td><a>News</a><td><a>All articles</a></table><h2>What happened</h2><p>{W}.<p>{W} <a>here</a>, {W}.<p>{W}.<div><a>Another story that you may want to read</a></div><div><a>One more of them, with a long headline</a></div><div>All rights reserved</div>"
    assert html_text.main_text(page) == f"What happened\n{W}.\n{W} here, {W}.\n{W}."
    assert html_text.tree().feature in (2, 3)
    x, y = html_text.labelled()
    assert all(html_text.tree().decide(tuple(a)) == bool(b) for a, b in zip(x, y))


def test_html_blocks_and_features_by_brute_force():
    """Random nestings against a plain walk over the same pieces."""
    rnd = random.Random(11)
    for _ in range(200):
        page, want = [], []
        for _ in range(rnd.randint(1, 9)):
            tag = rnd.choice(("p", "div", "h2", "li", "td"))
            out = rnd.choice(("", "article", "aside", "section"))
            n, m = rnd.randint(0, 9), rnd.randint(0, 3)
            words = [rnd.choice(("a", "b&amp;c", "&lt;p&gt;", "d\n\te")) for _ in range(n)]
            links = [rnd.choice(("x", "y &eacute;")) for _ in range(m)]
            body = " ".join(words) + " " + "".join(f"<a href='#'>{x}</a> " for x in links)
            page.append(f"<{out}>" * bool(out) + f"<{tag} title=\"a > b\">{body}</{tag}>" + f"</{out}>" * bool(out))
            plain = " ".join(" ".join(words + links).replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">").replace("&eacute;", "é").split())
            if plain:
                want.append((plain, len(plain.split()), sum(len(x.split()) for x in links), tag == "h2", out == "aside", out == "article"))
        got = html_text.blocks("".join(page))
        assert got == want
        for i, f in enumerate(html_text.features(got)):
            near = [got[j] if 0 <= j < len(got) else ("", 0, 0) for j in (i - 1, i, i + 1)]
            assert f == tuple(v for b in near for v in (b[1], b[2] / b[1] if b[1] else 0.0)) + got[i][3:]


def test_html_tree_is_the_best_cut():
    x = np.array([[0, 1, 0], [1, 1, 0], [2, 0, 1], [3, 1, 1], [4, 0, 1], [5, 0, 0]], float)
    y = np.array([0, 0, 1, 1, 1, 1], float)
    t = html_text.grow(x, y, first=1)
    assert (t.feature, t.cut) == (0, 1.5) and [t.decide(tuple(r)) for r in x] == [False, False, True, True, True, True]


def test_sets_that_share_a_class_by_chance(docs, monkeypatch):
    """With a first digest of a few bits only, many different sets share a class; the result is the same."""
    calls, keep = [], jaccard.kept
    monkeypatch.setattr(jaccard, "kept", lambda d: calls.append(0) or keep(d))
    want = sorted(map(str, jaccard.jaccard_join(docs).collect()))
    plain, init = len(calls), jaccard._Sets.__init__

    def few(self, t, k):
        init(self, t, k)
        self.cls = np.where(self.n > 0, self.cls % 7 + 1, 0)
        self.one = np.flatnonzero(self.n > 0)
        self.one = self.one[np.unique(self.check[self.one], return_index=True)[1]]
        self.slots = np.concatenate([np.arange(self.first[r], self.first[r + 1]) for r in self.one]) if len(self.one) else np.zeros(0, np.int64)
        self.values, inverse, self.local = np.unique(self.v[self.slots], return_inverse=True, return_counts=True)
        self.at = np.zeros(len(self.v), np.int64)
        self.at[self.slots] = inverse

    # workers get functions by value only where they are defined here
    monkeypatch.setattr(jaccard, "_Sets", type("_Sets", (), {"__init__": few, "__module__": "__main__"}))
    assert sorted(map(str, jaccard.jaccard_join(docs).collect())) == want
    assert len(calls) > 2 * plain  # classes were named anew


def test_components_of_many_sizes(spark, monkeypatch):
    """A chain of documents of all sizes, more than a block, against brute force."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[: 12 + 3 * i])) for i in range(110)] + [(500 + i, " ".join(words[: 30 + i % 3]) + f" e{i}") for i in range(40)]
    sets = {i: {tuple(t.split()[a : a + 5]) for a in range(len(t.split()) - 4)} for i, t in rows}
    near = {i: [j for j in sets if j != i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])] for i in sets}

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        return min(seen)

    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (reach(i), len(near[i])) for i in sets}


def test_spans_at_both_coordinates(docs):
    """The words of every path that goes stand at both of its coordinates, and the paths cover what is removed."""
    texts: dict = {}
    for i, t, *_ in _docs():
        texts.setdefault(i, []).append(_words(t))
    spans = substrings.repeated_spans(docs).collect()
    gone: dict = {}
    for r in spans:
        a = [w[r.start : r.start + r.n_words] for w in texts[r.doc_id]]
        b = [w[r.owner_start : r.owner_start + r.n_words] for w in texts[r.owner]]
        assert any(x == y for x in a for y in b) and r.n_words >= 13 and r.owner < _no_id(r.doc_id)
        gone.setdefault((r.doc_id, r.text_hash), set()).update(range(r.start, r.start + r.n_words))
    removed = sum(len(x) * (2 if i == 6 else 1) for (i, _), x in gone.items())  # document 6 is there twice
    assert removed == sum(r.n_removed for r in substrings.dedup_substrings(docs).collect())


def test_groups_follow_the_bytes(spark):
    from bitloom.llm import _exchange

    d = spark.createDataFrame([("x" * 1000,)] * 50, "text string")
    assert _exchange.partitions(d) == 8
    _exchange.GROUP, old = 1000, _exchange.GROUP
    try:
        assert _exchange.partitions(d) == 50
    finally:
        _exchange.GROUP = old


def test_chain_by_plain_fit():
    """Every model of a chain is at the least of its ridge loss, over words and earlier probabilities from
    models that haven't seen the row; prediction multiplies out."""
    rng = np.random.default_rng(3)
    texts = [np.unique(rng.integers(1, 40, 12).astype(np.uint64)) for _ in range(400)]
    has = lambda w: np.array([w in t for t in texts], float)
    y = np.stack((np.maximum(has(3), has(7)), np.maximum(has(5), has(3) * has(9))), axis=1)
    y = np.where(rng.random(y.shape) < 0.05, 1 - y, y)
    fold = np.arange(400) % 5
    chain = toxicity.Chain(["a", "b"]).fit(texts, y, fold, 50, 5, 0.3)
    assert {3, 5, 7} <= set(chain.words.tolist())
    x = np.array([[float(w in t) for w in chain.words] for t in texts])
    assert (chain.matrix(texts) == x).all()
    sigma = lambda z: 1 / (1 + np.exp(-z))
    one = lambda m: np.hstack((m, np.ones((len(m), 1))))

    def least(z, t):  # by plain gradient steps
        w, z = np.zeros(z.shape[1] + 1), one(z)
        for _ in range(20_000):
            w -= 0.01 * (z.T @ (sigma(z @ w) - t) + np.append(np.full(len(w) - 1, 0.3), 1e-6) * w)
        return w

    assert np.allclose(chain.weights[0], least(x, y[:, 0]), atol=1e-3)
    apart = np.zeros(400)
    for f in range(5):
        apart[fold == f] = sigma(one(x[fold == f]) @ least(x[fold != f], y[fold != f, 0]))
    assert np.allclose(chain.weights[1], least(np.hstack((x, apart[:, None])), y[:, 1]), atol=5e-3)
    p = chain.predict(x)
    first = sigma(one(x) @ chain.weights[0])
    assert np.allclose(p[:, 0], first) and np.allclose(p[:, 1], sigma(one(np.hstack((x, first[:, None]))) @ chain.weights[1]))
    new = [np.unique(rng.integers(1, 40, 12).astype(np.uint64)) for _ in range(300)]
    sure = np.array([5 in t for t in new])
    clean = np.array([not {3, 5, 7, 9} & set(t.tolist()) for t in new])
    caught = chain.predict(chain.matrix(new))[:, 1] >= 0.5
    assert (caught & sure).sum() >= 0.9 * sure.sum() and (caught & clean).sum() <= 0.1 * clean.sum()
