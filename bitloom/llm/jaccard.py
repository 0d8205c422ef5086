"""Exact Jaccard self-join of documents on word shingles: a size-aware heavy-light join.

A document's set holds its distinct k-word shingles (A-Z lower-cased); documents with equal sets form
a class. Two classes link when ``den * |A & B| >= num * |A | B|``. Two sets of s <= t shingles that
link share at least ``need(s, t)`` of them.

* Light sets, of at most ``boundary`` shingles, enumerate for every partner size their subsets of
  exactly ``need`` elements: linked light sets meet in an equal subset. The boundary is the largest
  size up to which this makes no more keys than scanning inverted lists costs (``costs``).
* Heavy sets put a prefix of their shingles, rarest first, on inverted lists. Frequencies of all
  shingles come from ``_exchange``; a shingle that one class alone has opens no list.

Lists hold no pairs: each member is tied to its list's smallest class, and the ties give candidate
components. A component of more than ``BLOCK`` classes is parted by set size, as sets link only with such
of their own or a neighbouring size class, so documents of all sizes that common text chains together
don't all meet. Inside parts every pair is counted exactly, in blocks of about ``BLOCK`` classes. A block
gives back one row a class, with its links and the smallest class that it reaches in the block. No list
is capped and no pair that could link is left out.

A class is a 64-bit digest of a set; a second one finds different sets with the same digest, which are
then named anew until there are none.

Nulls: a null text is empty; an empty set links with nothing and is its own component. Null ids come
after all others and are given back as null. Repeated rows are equal documents. Ties: all ids count.
An empty table gives no rows. Other columns are not looked at, whatever their names; ``one_of_each`` gives
them back as they are.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.operators.components import components
from bitloom.plans.lineage import kept

from . import _exchange as X
from . import _text as T
from ._rows import named, row_of, unpacked
from ._worker import light

BLOCK = 256
SCAN = 8  # what one posting costs beside one subset key: it is met again in verification

_DOC = "doc_id long, text_hash long, n int, class long, check long, keys array<long>"
_SET = "comp long, span int, guest boolean, class long, mult long, n int, blocks int, shingles binary"
_LINKS = "class long, links long, root long"


def need(s: int, t: int, num: int, den: int) -> int:
    """The smallest intersection with which sets of s and t elements link."""
    return -(-num * (s + t) // (num + den))


def costs(s: int, num: int, den: int) -> tuple[int, int]:
    """(subset keys of a light set of s elements, cost of the list postings of a heavy one)."""
    low, high = -(-num * s // den), s * den // num
    light = sum(comb(s, need(s, t, num, den)) for t in range(low, high + 1) if need(s, t, num, den) <= min(s, t))
    return light, 2 * SCAN * (s - low + 1)


@lru_cache(maxsize=None)
def boundary(num: int, den: int) -> int:
    s = 1
    while (c := costs(s + 1, num, den))[0] <= c[1]:
        s += 1
    return s


@lru_cache(maxsize=4096)
def _left_out(n: int, r: int) -> np.ndarray:
    return np.array(list(combinations(range(n), r)), dtype=np.int64).reshape(comb(n, r), r)


@lru_cache(maxsize=None)
def _steps(num: int, den: int) -> np.ndarray:
    """Size classes such that linked sets are in the same or in adjacent ones."""
    e = [1]
    while e[-1] < 1 << 40:
        e.append(max(e[-1] + 1, e[-1] * den // num + 1))
    return np.array(e)


class _Sets:
    """The sets of a group of documents, and its classes."""

    def __init__(self, t: pa.Table, k: int):
        v, n = [], []
        for _, data, off in T.pieces(t["text"]):
            values, first = T.shingle_sets(data, off, k)
            v.append(values), n.append(np.diff(first))
        self.v = np.concatenate(v) if v else np.zeros(0, np.uint64)
        self.n = np.concatenate(n) if n else np.zeros(0, np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.n)))
        total = np.concatenate(([np.uint64(0)], np.cumsum(T.mix(self.v ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
        digest = T.mix(total[self.first[1:]] - total[self.first[:-1]] + self.n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.cls = np.where(self.n > 0, digest, 0).view(np.int64)
        # a second digest tells sets apart that the first one doesn't
        total = np.concatenate(([np.uint64(0)], np.cumsum(T.mix(self.v * np.uint64(0x2545F4914F6CDD1D) + np.uint64(0x9FB21C651E98DF25)), dtype=np.uint64)))
        self.check = T.mix(total[self.first[1:]] - total[self.first[:-1]]).view(np.int64)
        self.one = np.flatnonzero(self.n > 0)
        self.one = self.one[np.unique(self.cls[self.one], return_index=True)[1]]  # a row for each class
        self.slots = np.concatenate([np.arange(self.first[r], self.first[r + 1]) for r in self.one]) if len(self.one) else np.zeros(0, np.int64)
        self.values, inverse, self.local = np.unique(self.v[self.slots], return_inverse=True, return_counts=True)
        self.at = np.zeros(len(self.v), np.int64)
        self.at[self.slots] = inverse


def _keys(g: _Sets, said: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """The list keys of each row in g.one."""
    grade = np.where(said > 0, said, np.where(g.local > 1, 1, 0)).astype(np.int64)
    edge, steps, out = boundary(num, den), _steps(num, den), []
    for r in g.one:
        a, b = g.first[r], g.first[r + 1]
        s = int(b - a)
        v, f = g.v[a:b], grade[g.at[a:b]]
        keys = [np.zeros(0, np.uint64)]
        alone = int((f == 0).sum())
        low, high = -(-num * s // den), s * den // num
        if s <= edge:
            part = T.mix(v)
            order = np.argsort(f > 0, kind="stable")  # those that no other set has are left out of every subset
            part = part[order]
            rest = part[alone:].sum(dtype=np.uint64)
            for t in range(low, min(high, edge) + 1):
                o = need(s, t, num, den)
                if o > min(s, t) or s - o < alone:
                    continue
                cut = _left_out(s - alone, s - o - alone)
                sums = rest - part[alone:][cut].sum(axis=1, dtype=np.uint64)
                keys.append(T.mix(sums + np.uint64((1000 * min(s, t) + max(s, t)) * 0xD1342543DE82EF95 % (1 << 64))))
        if high > edge:
            long = s - low + 1
            if alone < long:
                order = np.lexsort((v, f))[alone:long]
                size = int(np.searchsorted(steps, s, "right"))
                for x in (size, size + 1):
                    keys.append(T.mix(v[order] + np.uint64(x * 0xA24BAED4963EE407 % (1 << 64))))
        out.append(np.concatenate(keys))
    return out


def _count(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs, by scanning the inverted lists of one block."""
    m = len(sets)
    if m == 2:
        c = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), c], [c, len(sets[1])]])
    values, inverse, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    who = np.repeat(np.arange(m), [len(x) for x in sets])
    use = n[inverse] > 1
    column = np.cumsum(n > 1) - 1
    inverse, who = column[inverse[use]], who[use]
    order = np.argsort(inverse, kind="stable")
    inverse, who = inverse[order], who[order]
    total = np.zeros((m, m))
    width, wide = max(256, (1 << 22) // m), int(inverse[-1]) + 1 if len(inverse) else 0
    for a in range(0, wide, width):
        i, j = np.searchsorted(inverse, (a, a + width))
        x = np.zeros((m, min(width, wide - a)), np.float32)
        x[who[i:j], inverse[i:j] - a] = 1
        total += x @ x.T
    return total.astype(np.int64)


def _verify(num: int, den: int):
    def block(t: pa.Table) -> pa.Table:
        comp, span, bi, bj, side, cls, mult, n = (t[c].to_numpy() for c in ("comp", "span", "bi", "bj", "block", "class", "mult", "n"))
        guest = np.array(t["guest"].to_pylist(), bool)
        order = np.lexsort((cls, bj, bi, span, comp))
        new = np.ones(len(order), bool)
        key = np.stack((comp, span, bi, bj))[:, order]
        new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
        bounds = np.append(np.flatnonzero(new), len(order))
        raw = t["shingles"]
        out_c, out_l, out_r = [], [], []
        for a, b in zip(bounds[:-1], bounds[1:]):
            rows = order[a:b]
            if len(rows) < 2:
                continue
            g = _count([np.frombuffer(raw[int(r)].as_buffer(), np.uint64) for r in rows])
            size = n[rows].astype(np.int64)
            link = den * g >= num * (size[:, None] + size[None, :] - g)
            np.fill_diagonal(link, False)
            if bi[rows[0]] != bj[rows[0]]:
                link &= side[rows][:, None] != side[rows][None, :]
            link &= ~(guest[rows][:, None] & guest[rows][None, :])  # they meet as no guests elsewhere
            mine = cls[rows]
            low = mine.copy()
            top = np.iinfo(np.int64).max
            while True:
                nxt = np.minimum(low, np.where(link, low[None, :], top).min(axis=1))
                if (nxt == low).all():
                    break
                low = nxt
            out_c.append(mine), out_l.append(link @ mult[rows]), out_r.append(low)
        if not out_c:
            return X.none(_LINKS)
        return pa.table({"class": np.concatenate(out_c), "links": np.concatenate(out_l).astype(np.int64), "root": np.concatenate(out_r)})

    return block


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row; n_links counts the linked rows.

    num / den: the least Jaccard likeness."""
    out = _linked(docs, id_col, text_col, k, num, den)
    null = lambda c: F.when(c != X.LAST, c)
    return out.select(null(F.col("doc_id")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), null(F.coalesce("component_id", "doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component, that with the smallest id; rows with an empty set all stay."""
    linked = _linked(docs, id_col, text_col, k, num, den).select("doc_id", "text_hash", "n", "root")
    low = linked.filter("n > 0").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("d")).select(F.col("d.doc_id").alias("_id"), F.col("d.text_hash").alias("_hash"))
    stay = low.unionByName(linked.filter("n = 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    worded = F.coalesce(named(text_col), F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    me = docs.select(F.coalesce(named(id_col).cast("long"), F.lit(X.LAST)).alias("at"), F.xxhash64(F.coalesce(named(text_col), F.lit(""))).alias("hash"), worded.alias("worded"), row_of(docs).alias("row"))
    me = me.join(stay, (me["at"] == stay["_id"]) & (me["hash"] == stay["_hash"]), "left_semi")
    return me.filter("worded").dropDuplicates(["at", "hash"]).unionByName(me.filter("not worded")).select(*unpacked(docs))


def _linked(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, text_hash, n, class, component_id, n_links, root) for every row."""
    d, groups = X.dealt(docs, id_col, text_col)

    @light
    def ask(t: pa.Table) -> pa.Table:
        return X.ask(t["pid"][0].as_py(), _Sets(t, k).values, X.buckets(groups))

    @light
    def sign(t: pa.Table, said: pa.Table) -> pa.Table:
        if not t.num_rows:
            return X.none("doc_id long, text_hash long, n int, class long, check long").append_column("keys", pa.array([], pa.list_(pa.int64())))
        g = _Sets(t, k)
        keys: list = [None] * t.num_rows
        for r, x in zip(g.one, _keys(g, X.heard(said, g.values, X.buckets(groups)), num, den)):
            keys[r] = x.view(np.int64)
        return pa.table({"doc_id": t["doc_id"], "text_hash": t["text_hash"], "n": pa.array(g.n, pa.int32()), "class": pa.array(g.cls, pa.int64()), "check": pa.array(g.check, pa.int64()), "keys": pa.array(keys, pa.list_(pa.int64()))})

    by = d.groupBy("pid")
    signed = kept(by.cogroup(X.answers(by.applyInArrow(ask, X.ASK), X.counted).groupBy("pid")).applyInArrow(sign, _DOC))

    # classes, from one document of each; sets that share a class by chance get classes of their own
    first = F.min(F.struct("doc_id", "text_hash"))
    for again in range(1 << 30):
        classes = kept(signed.filter("n > 0").groupBy("class").agg(first.alias("d"), F.count("*").alias("mult"), F.min("doc_id").alias("low_doc"), F.max("n").alias("n"), F.min("check").alias("c0"), F.max("check").alias("c1")).select("class", "mult", "low_doc", "n", "d.doc_id", "d.text_hash", "c0", "c1"))
        clash = classes.filter("c0 != c1").select("class", F.lit(True).alias("clash"))
        if not clash.limit(1).count():
            break
        name = F.when(F.col("clash") & (F.col("n") > 0), F.xxhash64("class", "check", F.lit(again))).otherwise(F.col("class"))
        signed = kept(signed.join(clash, "class", "left").withColumn("class", name).drop("clash"))

    # ties: each member of a list with the list's smallest class
    posted = signed.filter("size(keys) > 0").select(F.explode("keys").alias("key"), "class")
    lists = posted.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low != high").select("key", "low")
    ties = posted.join(lists, "key").filter("class != low").select(F.col("class").alias("a"), F.col("low").alias("b")).distinct()
    near = kept(components(ties).select(F.col("node").alias("class"), F.col("root").alias("comp")))

    # a component of more than a block is parted by size: what links is of the same size class or the next
    # one, so a part has the sets of a size class and, as guests, those of the next
    size_class = F.expr(f"size(filter(array({', '.join(f'{x}L' for x in _steps(num, den).tolist())}), x -> x <= n))").cast("int")
    near = near.join(classes.drop("c0", "c1"), "class")
    many = near.groupBy("comp").agg(F.count("*").alias("sets"))
    near = near.join(many, "comp").withColumn("large", F.col("sets") > BLOCK).drop("sets")
    span = F.when(F.col("large"), F.array(F.struct(size_class.alias("span"), F.lit(False).alias("guest")), F.struct((size_class - 1).alias("span"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.lit(-1).alias("span"), F.lit(False).alias("guest"))))
    parts = kept(near.withColumn("p", F.explode(span)).select("comp", "p.span", "p.guest", "class", "mult", "doc_id", "text_hash"))
    # parts of guests alone have nothing to count
    sizes = parts.groupBy("comp", "span").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"), F.count_if(~F.col("guest")).alias("own")).filter("own > 0").drop("own")
    wanted = parts.join(sizes, ["comp", "span"]).select(X.group_of(groups).alias("pid"), "doc_id", "text_hash", "class", "comp", "span", "guest", "mult", "blocks")

    @light
    def gather(t: pa.Table, want: pa.Table) -> pa.Table:
        if not t.num_rows or not want.num_rows:
            return X.none(_SET)
        asked: dict[tuple[int, int], list[tuple]] = {}
        for i, h, *info in zip(*(want[c].to_pylist() for c in ("doc_id", "text_hash", "comp", "span", "guest", "class", "mult", "blocks"))):
            asked.setdefault((i, h), []).append(info)
        rows = [r for r, key in enumerate(zip(t["doc_id"].to_pylist(), t["text_hash"].to_pylist())) if key in asked]
        keys = list(zip(t["doc_id"].take(rows).to_pylist(), t["text_hash"].take(rows).to_pylist()))
        g = _Sets(t.take(pa.array(rows, pa.int64())), k)
        out: dict[str, list] = {c.split()[0]: [] for c in _SET.split(", ")}
        for r, key in enumerate(keys):
            raw = g.v[g.first[r] : g.first[r + 1]].tobytes()
            for comp, span, guest, cls, mult, blocks in asked.pop(key, ()):
                for c, v in zip(out, (comp, span, guest, cls, mult, int(g.n[r]), blocks, raw)):
                    out[c].append(v)
        return pa.table(out, schema=X.none(_SET).schema)

    sets = by.cogroup(wanted.groupBy("pid")).applyInArrow(gather, _SET)
    sets = sets.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = sets.select("comp", "span", "guest", "class", "mult", "n", "shingles", "block", F.least("block", "other").cast("int").alias("bi"), F.greatest("block", "other").cast("int").alias("bj"), "blocks")
    # small components share a task; each pair of blocks of a large part has its own
    job = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp", "span"), F.lit(8 * groups))).otherwise(-1 - F.shiftrightunsigned(F.xxhash64("comp", "span", "bi", "bj"), 1))
    links = kept(sets.withColumn("job", job).drop("blocks").groupBy("job").applyInArrow(_verify(num, den), _LINKS))

    joined = components(links.select(F.col("class").alias("a"), F.col("root").alias("b")))
    degree = links.groupBy("class").agg(F.sum("links").alias("links"))
    named = classes.select("class", "mult", "low_doc").join(joined.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    lowest = named.groupBy("root").agg(F.min("low_doc").alias("component_id"))
    named = named.join(lowest, "root").join(degree, "class", "left").select("class", "component_id", "root", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return signed.select("doc_id", "text_hash", "n", "class").join(named, "class", "left")
