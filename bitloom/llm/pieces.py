"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

``encode_word`` is a score-ordered agenda of adjacent symbol pairs: the pair whose joined piece has
the best score is merged first, the leftmost of equals; symbols outside the vocabulary fall back to
their UTF-8 bytes. No piece of the vocabulary has a word mark after another character (checked when it
is loaded), so merges never cross a word's start and words are encoded one at a time and kept.

Texts are decoded from their ids, by the vocabulary's table.

Every word that a worker meets for the first time is checked against the sentencepiece library, one
call for an Arrow batch's new words, and so is the whole of every ``EVERY``-th text, ids and decoded
text; ``check="texts"`` checks every whole text. A difference raises.

A worker keeps words and parts of words up to ``KEPT`` bytes and lets go of them when its batches end.

Nulls: a null text is an empty one, which has no pieces besides begin and end. Null and repeated ids
pass through, a row in is a row out; an empty table gives no rows. Long words and texts are encoded
whole. Other columns are not looked at, whatever their names; ``carry`` names those that go along,
which may not be called like the result's own.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rows import named
from ._worker import slim

MARK = "▁"
KEPT = 96 << 20  # bytes of words kept by a worker, and a quarter as many of parts of words
EACH = 200  # bytes that a kept word takes besides its characters and ids: two objects and a place in the table
EVERY = 16  # of so many texts, one is checked whole
ROWS = 512  # rows taken out of an Arrow batch at once
SHORT = 32  # characters up to which the agenda is a list, not a heap
NEVER = float("inf")
LONG = 64  # longer words are encoded each time
_WORD = re.compile(" +[^ ]*")


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.ids, self.scores, self.bytes, self.text = {}, {}, {}, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i):
                self.text.append(b"")
            elif sp.is_unknown(i):
                self.text.append(" ⁇ ".encode())
            else:
                self.ids[piece], self.scores[piece] = i, sp.get_score(i)
                self.text.append(piece.replace(MARK, " ").encode())
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a word mark inside; words can't be encoded apart")
        self.inner = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.lines = not any("\n" in p for p in self.inner)
        self.parts: dict[str, tuple[int, ...]] = {}
        self.packed: dict[str, bytes] = {}
        self.packed_size = self.parts_size = 0

    def _agenda(self, word: str) -> list[str]:
        sym: list[str] = list(word)
        n = len(sym)
        if n == 1:
            return sym
        scores = self.scores
        if n <= SHORT:  # the agenda as a list by position: its smallest entry's first place is the next pair
            agenda = [-scores[p] if (p := sym[i] + sym[i + 1]) in scores else NEVER for i in range(n - 1)]
            while agenda and (best := min(agenda)) < NEVER:
                i = agenda.index(best)
                sym[i] += sym.pop(i + 1)
                del agenda[i]
                if i < len(agenda):
                    agenda[i] = -scores[p] if (p := sym[i] + sym[i + 1]) in scores else NEVER
                if i:
                    agenda[i - 1] = -scores[p] if (p := sym[i - 1] + sym[i]) in scores else NEVER
            return sym
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(-scores[p], i, i + 1, len(p)) for i in range(n - 1) if (p := sym[i] + sym[i + 1]) in scores]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            if not sym[i] or not sym[j] or len(sym[i]) + len(sym[j]) != size or right[i] != j:
                continue  # one of both has merged meanwhile
            sym[i] += sym[j]
            sym[j] = ""
            right[i] = r = right[j]
            if r < n:
                left[r] = i
                if (p := sym[i] + sym[r]) in scores:
                    heapq.heappush(agenda, (-scores[p], i, r, len(p)))
            if (l := left[i]) >= 0 and (p := sym[l] + sym[i]) in scores:
                heapq.heappush(agenda, (-scores[p], l, i, len(p)))
        return [s for s in sym if s]

    def _part(self, part: str) -> list[int]:
        out: list[int] = []
        for s in self._agenda(part):
            if (i := self.ids.get(s)) is not None:
                out.append(i)
            elif self.bytes:
                out += (self.bytes[b] for b in s.encode())
            else:
                out.append(self.unknown)
        return out

    def encode_word(self, word: str) -> list[int]:
        """word: with its leading word marks. Two characters that are side by side in no piece never
        come together, so the parts on both sides are encoded (and kept) apart."""
        inner, known, out, start = self.inner, self.parts, [], 0
        if (whole := known.get(word)) is not None:
            return list(whole)
        for i in range(1, len(word) + 1):
            if i == len(word) or word[i - 1 : i + 1] not in inner:
                part = word[start:i]
                if (ids := known.get(part)) is None:
                    ids = tuple(self._part(part))
                    if len(part) <= LONG and self.parts_size < KEPT // 4:
                        known[part] = ids
                        self.parts_size += EACH + len(part) + 8 * len(ids)
                out += ids
                start = i
        return out

    def raw(self, ids: Iterable[int]) -> bytes:
        """The text of ids in UTF-8; the space that encoding puts first goes."""
        raw = b"".join(map(self.text.__getitem__, ids))
        return raw[1:] if raw[:1] == b" " else raw

    def decode(self, ids: Iterable[int]) -> str:
        return self.raw(ids).decode(errors="replace")

    def check(self, words: list[tuple[str, bytes]]) -> None:
        """Raises where the library encodes one of the words (with marks as spaces, packed ids) otherwise."""
        one = len(self.library.encode("a"))  # behind a letter, as the library puts a mark in front of a text
        for (w, ids), theirs in zip(words, self.library.encode(["a" + w for w, _ in words], num_threads=1)):
            if ids != array("I", theirs[one:]).tobytes():
                raise ValueError(f"{w!r}: {array('I', ids).tolist()}, but the library has {theirs[one:]}")

    def encode_text(self, text: str, fresh: list[tuple[str, bytes]]) -> bytes:
        """Ids without begin and end as little-endian 32-bit numbers; words met for the first time are
        added to fresh.

        Keys of words: the characters after the first word mark, further marks as spaces; and, as
        a line's end never merges, from a line's end on, with the marks in front of it as spaces."""
        if not text:
            return b""
        text = text.replace(MARK, " ")
        text = text.replace("\n", " \n") if self.lines else text
        words = text.split(" ") if "  " not in text and text[0] != " " and text[-1] != " " else [w[1:] for w in _WORD.findall(" " + text)]
        packed = self.packed
        if new := [w for w in set(words) if w not in packed]:
            if self.packed_size > KEPT:  # the words met first are the frequent ones
                packed = self.packed = dict(islice(packed.items(), len(packed) // 2))
                self.packed_size = sum(EACH + len(w) + len(x) for w, x in packed.items())
                new = [w for w in set(words) if w not in packed]
            for w in new:
                marked = w if w.lstrip(" ")[:1] == "\n" else " " + w
                packed[w] = array("I", self.encode_word(marked.replace(" ", MARK))).tobytes()
                self.packed_size += EACH + len(w) + len(packed[w])
                fresh.append((marked, packed[w]))
        ids = b"".join(map(packed.__getitem__, words))
        for w in new:
            if len(w) > LONG:
                self.packed_size -= EACH + len(w) + len(packed.pop(w))
        return ids


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", check: str = "words", keep: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row; keep: ids and decoded as well; carry:
    columns that go along, last. Rows stay in the order of docs.

    model: path of the vocabulary, the same on all machines."""
    if check not in ("words", "texts", "none"):
        raise ValueError(check)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * keep
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    own = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep
    kinds = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int64()), pa.string()] * keep
    whole = {"words": EVERY, "texts": 1, "none": 0}[check]

    def rows(v: Vocabulary, b: pa.RecordBatch) -> pa.RecordBatch:
        begin, end = array("I", [v.begin]).tobytes(), array("I", [v.end]).tobytes()
        fresh: list[tuple[str, bytes]] = []
        cols: list[list] = [[] for _ in own]
        for i, text in enumerate(b["text"].to_pylist()):
            packed = begin + v.encode_text(text or "", fresh) + end
            ids = array("I", packed)
            raw = v.raw(ids)
            if whole and i % whole == 0:
                theirs = v.library.encode(text or "", add_bos=True, add_eos=True)
                if ids.tolist() != theirs or raw.decode(errors="replace") != v.library.decode(theirs):
                    raise ValueError(f"{(text or '')[:80]!r}: other ids or another decoded text than the library's")
            got = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(raw).hexdigest()) + ((ids.tolist(), raw.decode(errors="replace")) if keep else ())
            for c, x in zip(cols, got):
                c.append(x)
        if check == "words":
            v.check(fresh)
        return pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, k) for c, k in zip(cols, kinds)), *b.columns[2:]], names=["doc_id", *own, *carry])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slim()
        v = vocabulary(model)
        try:
            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    yield rows(v, b.slice(at, ROWS))
        finally:
            del v
            vocabulary.cache_clear()
            slim()

    return docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"), *map(named, carry)).mapInArrow(run, schema)
