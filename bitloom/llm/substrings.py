"""Substring deduplication by de Bruijn compaction.

Every window of ``k`` consecutive words is an edge between two nodes of ``k - 1`` words.

1. Edges that occur in one group of documents and once there are dropped (``_exchange``).
2. Nodes whose every occurrence has the same edge before and the same edge after are plain; each
   document's runs of repeated edges are cut at all other nodes into nonbranching paths.
3. Equal paths meet in Spark: an aggregation finds each path's first source (smallest document, then
   position), a join gives it to the places where the path is. The key of a path is a 128-bit digest of the words at its source coordinates (not of window hashes), so a path counts as
   repeated only where the words at both coordinates agree; ``repeated_spans`` gives both.
4. Words under paths whose first source is an earlier document go.

Windows are judged on the input. A word is a run of characters other than U+0020, U+0009..U+000D.
Nulls: a null text has no words, null ids come after all others (and come back as null). Equal rows
are separate results. Texts of fewer than k words keep everything. An empty table gives no rows. Other
columns are not looked at, whatever their names; ``without_repeats`` gives them back as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.plans.lineage import kept

from . import _exchange as X
from . import _text as T
from ._rows import row_of, unpacked
from ._worker import light

_PATH = "pid int, path binary, n_words int, doc_id long, text_hash long, start int"
_RESULT = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"


class _Group:
    """The windows of one group of documents."""

    def __init__(self, t: pa.Table, k: int):
        self.k, self.ids = k, t["doc_id"].to_numpy()
        self.parts, first, base, edges, nodes = [], [np.zeros(1, np.int64)], 0, [], []
        for rows, data, off in T.pieces(t["text"]):
            s, e, f = T.words(data, off)
            h = T.word_hashes(data, s, e)
            self.parts.append((rows, data, s, e, f))
            edges.append(_window(h, k)), nodes.append(_window(h, k - 1))
            first.append(f[1:] + base)
            base += len(h)
        self.first = np.concatenate(first)
        self.edge = np.concatenate(edges) if edges else np.zeros(0, np.uint64)  # by word position; those across rows are never used
        self.node = np.concatenate(nodes) if nodes else np.zeros(0, np.uint64)
        self.at, self.row = T.inside(self.first, k)
        self.values, self.inverse = np.unique(self.edge[self.at], return_inverse=True)

    def repeated(self, said: np.ndarray) -> np.ndarray:
        """For each window, whether it is met again anywhere."""
        twice = np.bincount(self.inverse, minlength=len(self.values)) > 1
        return ((said > 0) | twice)[self.inverse]

    def junctions(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(values, extra, inverse, windows): the nodes at which a repeated window starts, with a
        fingerprint of the edges on both sides, 0 if these differ or one isn't repeated."""
        mine = np.flatnonzero(hit)
        p = self.at[mine]
        before = np.zeros(len(mine), bool)
        before[1:] = (mine[1:] == mine[:-1] + 1) & (self.row[mine[1:]] == self.row[mine[:-1]])
        pair = np.zeros(len(mine), np.uint64)
        pair[before] = T.mix(self.edge[p[before] - 1] * np.uint64(3) + self.edge[p[before]]) | np.uint64(1)
        # the node after a window that nothing repeated follows: it must not look plain to others
        last = np.ones(len(mine), bool)
        last[:-1] = ~before[1:]
        keys = np.concatenate((self.node[p], self.node[p[last] + 1]))
        extra = np.concatenate((pair, np.zeros(int(last.sum()), np.uint64)))
        values, inverse = np.unique(keys, return_inverse=True)
        low = np.full(len(values), 0xFFFFFFFFFFFFFFFF, np.uint64)
        high = np.zeros(len(values), np.uint64)
        np.minimum.at(low, inverse, extra), np.maximum.at(high, inverse, extra)
        return values, np.where(low == high, low, np.uint64(0)), inverse[: len(mine)], mine


def _window(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words by position of the first, as long as h."""
    out = np.zeros(len(h), np.uint64)
    w = T.window_hashes(h, k)
    out[: len(w)] = w
    return out


def _paths(g: _Group, t: pa.Table, plain: np.ndarray, node: np.ndarray, mine: np.ndarray) -> pa.Table:
    """A row for each nonbranching path of each document."""
    begins = np.ones(len(mine), bool)
    if len(mine):
        begins[1:] = ~((mine[1:] == mine[:-1] + 1) & (g.row[mine[1:]] == g.row[mine[:-1]]) & (plain[node][1:] > 0))
    a = np.flatnonzero(begins)
    n = np.diff(np.append(a, len(mine)))
    row, at = g.row[mine[a]], g.at[mine[a]]
    keys: list[bytes] = []
    where = 0
    for rows, data, s, e, f in g.parts:
        base = int(g.first[rows.start])
        raw = data.tobytes()
        to = int(np.searchsorted(row, rows.stop))
        for p, m in zip((at[where:to] - base).tolist(), n[where:to].tolist()):
            span = raw[s[p] : e[p + m + g.k - 2]]
            keys.append(hashlib.blake2b(b" ".join(span.split()), digest_size=16).digest())
        where = to
    hashes = t["text_hash"].to_numpy()
    return pa.table({"pid": pa.array([t["pid"][0].as_py()] * len(keys), pa.int32()), "path": pa.array(keys, pa.binary()), "n_words": pa.array(n + g.k - 1, pa.int32()), "doc_id": pa.array(g.ids[row], pa.int64()), "text_hash": pa.array(hashes[row], pa.int64()), "start": pa.array(at - g.first[row], pa.int32())})


def repeated_paths(dealt: DataFrame, groups: int, k: int = 13) -> DataFrame:
    """(path, n_words, doc_id, text_hash, start) of every nonbranching path of repeated windows.

    dealt: (pid, doc_id, text, text_hash) in groups by pid."""
    at_most = X.buckets(groups)

    @light
    def edges(t: pa.Table) -> pa.Table:
        return X.ask(t["pid"][0].as_py(), _Group(t, k).values, at_most)

    @light
    def nodes(t: pa.Table, said: pa.Table) -> pa.Table:
        if not t.num_rows:
            return X.none(X.ASK)
        g = _Group(t, k)
        values, extra, _, _ = g.junctions(g.repeated(X.heard(said, g.values, at_most)))
        return X.ask(t["pid"][0].as_py(), values, at_most, extra)

    @light
    def paths(t: pa.Table, said: pa.Table) -> pa.Table:
        if not t.num_rows:
            return X.none(_PATH)
        g = _Group(t, k)
        both = np.array(said["kind"].to_pylist(), dtype=np.int64) if said.num_rows else np.zeros(0, np.int64)
        values, _, inverse, mine = g.junctions(g.repeated(X.heard(said.filter(pa.array(both == 0)), g.values, at_most)))
        plain = X.heard(said.filter(pa.array(both == 1)), values, at_most)
        return _paths(g, t, plain, inverse, mine)

    by = dealt.groupBy("pid")
    shared = X.answers(by.applyInArrow(edges, X.ASK), X.counted)
    plain = X.answers(by.cogroup(shared.groupBy("pid")).applyInArrow(nodes, X.ASK), X.same, extra=True)
    told = shared.withColumn("kind", F.lit(0)).unionByName(plain.withColumn("kind", F.lit(1)))
    return by.cogroup(told.groupBy("pid")).applyInArrow(paths, _PATH)


def repeats(paths: DataFrame) -> DataFrame:
    """paths with owner and owner_start, their first source, where that is an earlier document.

    Partial aggregates make a passage in a third of all documents a row a task. The join that gives the
    source to its places has one row a path on one side, which is written first: between two exchanges
    adaptive execution splits the places of a frequent path."""
    first = paths.groupBy("path", "n_words").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max("doc_id").alias("last"))
    first = kept(first.filter("first.doc_id < last").drop("last"))
    d = paths.join(first, ["path", "n_words"]).filter("first.doc_id < doc_id")
    return d.select("pid", "doc_id", "text_hash", "start", "n_words", F.col("first.doc_id").alias("owner"), F.col("first.start").alias("owner_start"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13) -> DataFrame:
    """(doc_id, text_hash, start, n_words, owner, owner_start) of every path that goes: n_words words from
    the word start on, which are also those of the document owner from its word owner_start on."""
    d = repeats(kept(repeated_paths(*X.dealt(docs, id_col, text_col), k)))
    return d.select(F.when(F.col("doc_id") != X.LAST, F.col("doc_id")).alias("doc_id"), "text_hash", "start", "n_words", "owner", "owner_start")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256) for every row: the text without the words of
    windows that also start in a document with a smaller id; kept words are joined by one space."""
    return _cut(*X.dealt(docs, id_col, text_col), k)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13) -> DataFrame:
    """docs with the repeated words gone from their texts, which is what other columns say of them left
    alone. Texts that nothing is taken from stay as they are; rows of which nothing is left go."""
    d, groups = X.dealt(docs, id_col, text_col, row_of(docs).alias("row"))
    out = _cut(d, groups, k, d.schema["row"].dataType.simpleString()).filter("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(f"row.c{docs.columns.index(text_col)}"))
    return out.select(*unpacked(docs, instead={text_col: text}))


def _cut(d: DataFrame, groups: int, k: int, row: str = "") -> DataFrame:
    told = repeats(kept(repeated_paths(d.drop("row"), groups, k))).select("pid", "doc_id", "text_hash", "start", "n_words")

    @light
    def cut(t: pa.Table, spans: pa.Table) -> pa.Table:
        mine: dict[tuple[int, int], list[tuple[int, int]]] = {}
        if t.num_rows:
            for i, h, a, n in zip(*(spans[c].to_pylist() for c in ("doc_id", "text_hash", "start", "n_words"))):
                mine.setdefault((i, h), []).append((a, n))
        ids, hashes, text = (t[c] for c in ("doc_id", "text_hash", "text")) if t.num_rows else ([], [], [])
        out: dict[str, list] = {c.split()[0]: [] for c in _RESULT.split(", ")}
        for r in range(t.num_rows):
            i, left = ids[r].as_py(), text[r].as_py().encode().split()
            n = len(left)
            if found := mine.get((i, hashes[r].as_py())):
                keep = np.ones(n, bool)
                for a, m in found:
                    keep[a : a + m] = False
                left = [w for w, x in zip(left, keep.tolist()) if x]
            body = b" ".join(left)
            for c, v in zip(out, (None if i == X.LAST else i, n, n - len(left), body.decode(), hashlib.sha256(body).hexdigest())):
                out[c].append(v)
        done = pa.table(out, schema=X.none(_RESULT).schema)
        return done.append_column("row", t["row"]) if row else done

    # the same exchange for all readers of the text; with row, its columns travel along
    return d.groupBy("pid").cogroup(told.groupBy("pid")).applyInArrow(cut, _RESULT + f", row {row}" * bool(row))
