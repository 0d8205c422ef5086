"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability in
a language is the sum over all its segmentations into pieces, by a forward pass over its characters;
a text's is the product over its words that have a letter (a word, with its word mark in front, is
where every segmentation breaks, for no piece goes on over a mark). Characters outside the vocabulary
have the same small probability everywhere. Languages are equally likely beforehand.

Training: piece probabilities are fitted by expectation maximisation (forward-backward counts, in
logarithms) on the words, of any length, of about ``per_language`` labelled documents of each language,
taken by a hash of the row; that bound is the only sample, every document is predicted from its whole
text. The driver gets the sample's word counts and holds vocabulary times languages numbers; more than
``max_languages`` languages raise.

Long words are taken apart where two characters are side by side in no piece, as every segmentation
breaks there; in training also after each ``STRETCH`` characters.

A prediction looks at the text alone. ``und`` with score 0: null texts, texts without a letter, and
all texts if nothing could be learned from, an empty table's rows among them. Ties go to the language
first in order. Null and repeated ids pass through, one row each. Columns of the input that are called
held_out, lang_pred or score give way to the result's in ``identify``; ``told`` gives all columns back
as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import mix
from ._rows import named, row_of, unpacked
from ._worker import slim
from .pieces import EACH, MARK

KEPT = 64 << 20  # bytes of words kept by a worker
LONG = 48  # characters from which a word is taken apart
STRETCH = 1 << 16  # characters of a word looked at at once
STRANGE = 1e-8  # probability of a character outside the vocabulary
SMOOTH = 0.02  # added to each piece's count


def load_pieces(path: str) -> dict[str, int]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}


class Lattice:
    """All pieces in marked words or parts of them: edges (part, start, length, piece); piece 0 stands for
    a strange character.

    Substrings are looked up by rolling 64-bit hashes in a sorted table of the pieces' prefixes."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, pieces: dict[str, int]):
        table: dict[int, int] = {}
        for piece, i in pieces.items():
            h = 0
            for n, v in enumerate(self._values(np.array([ord(c) for c in piece], np.uint32)).tolist(), 1):
                h = (h * self.BASE + v) % (1 << 64)
                table[h] = i if n == len(piece) else table.get(h, -1)
        self.keys = np.array(sorted(table), np.uint64)
        self.piece = np.array([table[k] for k in sorted(table)], np.int64)
        # where the keys with the same first 18 bits begin, and the most of them that are together
        self.begin = np.searchsorted(self.keys, np.arange((1 << 18) + 1, dtype=np.uint64) << np.uint64(46) if len(table) else [])
        self.begin[-1:] = len(self.keys)
        self.deep = int(np.diff(self.begin).max(initial=0))
        self.longest = max(map(len, pieces), default=1)
        self.inner = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}

    def parts(self, word: str) -> list[str]:
        """A word with its mark; a long one cut between characters that no piece has side by side."""
        word = MARK + word
        if len(word) <= LONG:
            return [word]
        inner, cuts = self.inner, [0]
        cuts += (i for i in range(1, len(word)) if word[i - 1 : i + 1] not in inner)
        return [word[a:b] for a, b in zip(cuts, [*cuts[1:], len(word)])]

    @staticmethod
    def _values(codes: np.ndarray) -> np.ndarray:
        return mix(codes.astype(np.uint64) + np.uint64(1))

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the table, which of h) of those that are in the table."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bucket = (h >> np.uint64(46)).astype(np.int64)
        slot, end = self.begin[bucket], self.begin[bucket + 1]
        left, places, which = np.flatnonzero(slot < end), [], []
        slot = slot[left]
        for _ in range(self.deep):
            same = self.keys[slot] == h[left]
            places.append(slot[same]), which.append(left[same])
            slot, left = slot[~same] + 1, left[~same]
            more = slot < end[left]
            slot, left = slot[more], left[more]
        places, which = np.concatenate(places), np.concatenate(which)
        order = np.argsort(which, kind="stable")
        return places[order], which[order]

    def edges(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(x) for x in parts])
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        values, ends = self._values(codes), np.cumsum(size)
        word = np.repeat(np.arange(len(parts)), size)
        at, h, out = np.arange(len(codes)), np.zeros(len(codes), np.uint64), []
        single = np.zeros(len(codes), bool)
        for n in range(1, self.longest + 1):
            ok = at + n <= ends[word[at]]
            at, h = at[ok], h[ok]
            if not len(at):
                break
            h = h * np.uint64(self.BASE) + values[at + n - 1]
            slot, hit = self._find(h)
            at, h, found = at[hit], h[hit], self.piece[slot]
            whole = at[found >= 0]
            if n == 1:
                single[whole] = True
            out.append((whole, np.full(len(whole), n), found[found >= 0]))
        strange = np.flatnonzero(~single)
        out.append((strange, np.ones(len(strange), np.int64), np.zeros(len(strange), np.int64)))
        a, n, p = (np.concatenate(x) for x in zip(*out))
        w = word[a]
        return w, a - (ends - size)[w], n, p

    def forward(self, parts: list[str], prob: np.ndarray) -> np.ndarray:
        """Log probabilities (parts x languages); prob: (pieces x languages). Rescaled at each
        character, so that parts of any length stay in range; looked up a stretch at a time."""
        size = np.array([len(x) for x in parts])
        m, top_size = self.longest + 1, int(size.max())
        ring = np.zeros((m, len(parts), prob.shape[1]))
        ring[0] = 1.0
        scale, result = np.zeros((len(parts), 1)), np.zeros((len(parts), prob.shape[1]))
        for first in range(0, top_size, STRETCH):
            w, i, n, p = self.edges([x[first : first + STRETCH + self.longest] for x in parts])
            order = np.argsort(i, kind="stable")
            w, i, n, p = w[order], i[order], n[order], p[order]
            to = min(STRETCH, top_size - first)
            bounds = np.searchsorted(i, np.arange(to + 1))
            for at in range(to):
                a, b = bounds[at], bounds[at + 1]
                now = (first + at) % m
                ww, nn = w[a:b], n[a:b]
                add = ring[now][ww] * prob[p[a:b]]
                for k in np.unique(nn):
                    x = nn == k
                    ring[(now + k) % m][ww[x]] += add[x]  # one piece of a length starts here in a part
                ring[now] = 0.0
                nxt = ring[(now + 1) % m]
                top = nxt.max(axis=1)
                live = (top > 0) & (top < 1e-60)
                if live.any():
                    ring[:, live] /= top[live][None, :, None]
                    scale[live, 0] += np.log(top[live])
                done = size == first + at + 1
                if done.any():
                    result[done] = np.log(np.maximum(nxt[done], 1e-300)) + scale[done]
        return result


class Counter:
    """Expected piece counts of weighted parts of words, by the forward-backward algorithm in logarithms."""

    def __init__(self, lattice: Lattice, parts: list[str], weight: np.ndarray):
        w, i, k, self.p = lattice.edges(parts)
        base = np.concatenate(([0], np.cumsum([len(x) + 1 for x in parts])))
        self.first, self.last, self.weight = base[:-1], base[1:] - 1, weight
        self.w, self.a, self.b = w, base[w] + i, base[w] + i + k
        self.into, self.outof = self._steps(i + k, self.b), self._steps(-i, self.a)

    @staticmethod
    def _steps(rank: np.ndarray, node: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(edges, where each node's begin, nodes) of one character after another."""
        order = np.lexsort((node, rank))
        rank, node = rank[order], node[order]
        new = np.ones(len(order), bool)
        new[1:] = node[1:] != node[:-1]  # a node has one rank
        at = np.flatnonzero(new)
        cuts = np.append(np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1]))), len(rank))
        spans = np.searchsorted(at, cuts)
        return [(order[x:y], at[s:t] - x, node[at[s:t]]) for x, y, s, t in zip(cuts[:-1], cuts[1:], spans[:-1], spans[1:])]

    def counts(self, q: np.ndarray) -> np.ndarray:
        log = np.log(q)[self.p]
        fwd = np.full(self.last[-1] + 1, -np.inf)
        bwd = fwd.copy()
        fwd[self.first] = bwd[self.last] = 0.0
        for e, at, node in self.into:
            fwd[node] = np.logaddexp.reduceat(fwd[self.a[e]] + log[e], at)
        for e, at, node in self.outof:
            bwd[node] = np.logaddexp.reduceat(bwd[self.b[e]] + log[e], at)
        share = np.exp(fwd[self.a] + log + bwd[self.b] - fwd[self.last][self.w])
        return np.bincount(self.p, weights=self.weight[self.w] * share, minlength=len(q))


def fit(counts: dict[str, dict[str, int]], pieces: dict[str, int], rounds: int = 4) -> tuple[list[str], np.ndarray]:
    """counts: language -> word -> count. Gives (languages, probabilities)."""
    langs, lattice = sorted(counts), Lattice(pieces)
    n = max(pieces.values(), default=0) + 1
    prob = np.full((n, len(langs)), 1.0 / n)
    for l, lang in enumerate(langs):
        weight: dict[str, int] = {}
        for word, c in counts[lang].items():
            for part in lattice.parts(word):
                for at in range(0, len(part), STRETCH):
                    x = part[at : at + STRETCH]
                    weight[x] = weight.get(x, 0) + c
        if not weight:
            continue
        parts = sorted(weight, key=lambda x: (len(x), x))
        ends = np.cumsum([len(x) for x in parts])
        cuts = [0, *(int(np.searchsorted(ends, z, "right")) for z in range(2 * STRETCH, int(ends[-1]), 2 * STRETCH)), len(parts)]
        chunks = [Counter(lattice, parts[a:b], np.array([weight[x] for x in parts[a:b]], float)) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]
        q = np.full(n, 1.0 / n)
        for _ in range(rounds):
            q[0] = STRANGE
            got = sum(c.counts(q) for c in chunks)
            got[0] = 0
            q = (got + SMOOTH) / (got.sum() + SMOOTH * n)
        prob[:, l] = q
    prob[0] = STRANGE
    return langs, prob


class Scorer:
    def __init__(self, langs: list[str], prob: np.ndarray, pieces: dict[str, int]):
        self.langs, self.prob, self.lattice = langs, prob, Lattice(pieces)
        self.slot: dict[str, int] = {}
        self.rows = np.zeros((0, len(langs)))
        self.size = 0

    def _learn(self, new: list[str]) -> None:
        base, parts = len(self.slot), [self.lattice.parts(w) if any(map(str.isalpha, w)) else [] for w in new]
        order = sorted({p for x in parts for p in x}, key=len)
        found = np.zeros((len(order) + 1, len(self.langs)))  # the last one for words without a letter
        for c in range(0, len(order), 2000):  # of about equal length
            some = order[c : c + 2000]
            short = sum(len(x) <= 4 * LONG for x in some)
            if short:
                found[c : c + short] = self.lattice.forward(some[:short], self.prob)
            for j in range(c + short, c + len(some)):  # the ones that are much longer go alone
                found[j] = self.lattice.forward([order[j]], self.prob)[0]
        if base + len(new) > len(self.rows):
            self.rows = np.concatenate((self.rows[:base], np.zeros((len(new) + max(4096, base // 4), len(self.langs)))))
        place = {x: j for j, x in enumerate(order)}
        self.rows[base : base + len(new)] = found[[place[x[0]] if x else -1 for x in parts]]
        for j, x in enumerate(parts, base):
            if len(x) > 1:
                self.rows[j] = found[[place[y] for y in x]].sum(axis=0)
        self.slot.update(zip(new, range(base, base + len(new))))
        self.size += sum(EACH + len(w) + 8 * len(self.langs) for w in new)

    def _forget(self) -> None:
        """The words met first are the frequent ones."""
        if self.size > KEPT:
            self.slot = dict(islice(self.slot.items(), len(self.slot) // 2))
            self.rows = self.rows[: len(self.slot)].copy()
            self.size = sum(EACH + len(w) + 8 * len(self.langs) for w in self.slot)

    def texts(self, batch: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for at in range(0, len(batch), 200):
            self._forget()
            split = [(t or "").split() for t in batch[at : at + 200]]
            if self.langs and (new := {w for ws in split for w in ws if w not in self.slot}):
                self._learn(sorted(new))
            for text, ws in zip(batch[at : at + 200], split):
                if not self.langs or not text or not any(map(str.isalpha, text)):
                    names.append("und"), scores.append(0.0)
                    continue
                total = self.rows[np.fromiter(map(self.slot.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
                best = int(total.argmax())
                names.append(self.langs[best])
                scores.append(float(1.0 / np.exp(total - total[best]).sum()))
        return names, scores


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text is 1 modulo 3; false for a null id, which isn't learned from either."""
    return F.coalesce(F.crc32(named(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300, max_languages: int = 1000) -> tuple[list[str], np.ndarray]:
    """Learns from documents that aren't held out; what reaches the driver are the word counts of
    about per_language documents of each language."""
    rows = docs.select(named(id_col).alias("i"), named(text_col).alias("t"), named(lang_col).cast("string").alias("l"))
    rows = rows.filter("i is not null and t is not null and l is not null").filter(~held_out("i"))
    sizes = rows.groupBy("l").count().limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages to learn")
    shares = docs.sparkSession.createDataFrame([(l, min(1.0, per_language / n)) for l, n in sizes], "l string, share double")
    picked = rows.join(F.broadcast(shares), "l").filter(F.pmod(F.xxhash64("i", "t"), F.lit(1 << 30)) < F.col("share") * F.lit(float(1 << 30)))  # max_languages rows at most
    words = picked.select("l", F.explode(F.split("t", r"\s+")).alias("w")).filter(F.col("w").rlike(r"\p{L}")).groupBy("l", "w").count()
    counts: dict[str, dict[str, int]] = {}
    for b in words.toArrow().to_batches(max_chunksize=50_000):
        for l, w, n in zip(*(c.to_pylist() for c in b.columns)):
            counts.setdefault(l, {})[w] = n
    return fit(counts, load_pieces(model))


def _scored(docs: DataFrame, model: str, id_col: str, text_col: str, lang_col: str, per_language: int, trained: tuple[list[str], np.ndarray] | None) -> DataFrame:
    """(row, held_out, lang_pred, score)"""
    langs, prob = trained or train(docs, model, id_col, text_col, lang_col, per_language)
    shipped = docs.sparkSession.sparkContext.broadcast((langs, prob))  # vocabulary size x languages, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slim()
        scorer = Scorer(*shipped.value, load_pieces(model))
        try:
            for b in batches:
                for at in range(0, b.num_rows, 400):
                    part = b.slice(at, 400)
                    names, scores = scorer.texts(part["text"].to_pylist())
                    yield pa.RecordBatch.from_arrays([part["held_out"], part["row"], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["held_out", "row", "lang_pred", "score"])
        finally:
            del scorer
            slim()

    d = docs.select(named(text_col).cast("string").alias("text"), held_out(id_col).alias("held_out"), row_of(docs).alias("row"))
    return d.mapInArrow(run, f"held_out boolean, row {d.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300, trained: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """docs with the columns held_out, lang_pred and score (0 to 1) added.

    model: path of the vocabulary. trained: from train(); else learned from docs first."""
    own = ("lang_pred", "score", "held_out")
    return _scored(docs, model, id_col, text_col, lang_col, per_language, trained).select(*unpacked(docs, leave=own), *own)


def told(docs: DataFrame, model: str, least: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300, trained: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """The rows of docs, unchanged, whose language is told with a score of at least ``least``."""
    d = _scored(docs, model, id_col, text_col, lang_col, per_language, trained)
    return d.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*unpacked(docs))
