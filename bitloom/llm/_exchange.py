"""Which 64-bit values occur in several groups of documents, asked and answered in packed form.

Documents are dealt to groups (``pid``) once. Each group sends its sorted distinct values to value
buckets as zstd-packed differences (about 3 bytes a value instead of a 24-byte row); a bucket
compares its groups and answers in the order it was asked, so answers carry no values at all.
A value costs one entry per group that holds it, however often it occurs there: a passage in a
third of all documents puts at most one entry per group into its bucket. Nothing reaches the
driver; a lost executor recomputes the same groups because ``pid`` is a hash of the row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._rows import named

ASK = "pid int, bucket int, n int, payload binary"
LAST = (1 << 63) - 1


GROUP = 32 << 20  # bytes of text in a group, about; a longer text is one group's


def partitions(d: DataFrame) -> int:
    """Groups to deal the texts of d into: by their bytes, and at least twice the shuffle partitions. A
    group is what one task holds, so it must not grow with the input."""
    size = d.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return max(2, 2 * int(d.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-size // GROUP))


def buckets(groups: int) -> int:
    """Value buckets: fewer than groups, as each group sends up to one message to each bucket, but never
    more messages than values: with very many groups a message comes down to a few values, and all of
    them to what an exchange of single values would be."""
    return max(2, groups // 3)


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(doc_id, text, text_hash, *more); null ids become LAST, null texts ''."""
    d = docs.select(F.coalesce(named(id_col).cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text"), *more)
    return d.withColumn("text_hash", F.xxhash64("text"))


def dealt(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> tuple[DataFrame, int]:
    """(pid, doc_id, text, text_hash, *more) in groups, and their number; pid follows from doc_id and text_hash."""
    d = keyed(docs, id_col, text_col, *more)
    n = partitions(d)
    return d.select(group_of(n).alias("pid"), "*").repartition(n, "pid"), n


def group_of(n: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(n)).cast("int")


def _planes(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def _unplanes(raw: bytes, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(pa.decompress(raw, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, n).T).view(dtype).ravel()


def bucket_spans(values: np.ndarray, buckets: int) -> np.ndarray:
    """values sorted ascending: bounds[b] .. bounds[b + 1] of each bucket of the value range."""
    edges = np.array([(b << 64) // buckets for b in range(buckets)], dtype=np.uint64)
    return np.append(np.searchsorted(values, edges), len(values))


def ask(pid: int, values: np.ndarray, buckets: int, extra: np.ndarray | None = None) -> pa.Table:
    """values: sorted and distinct. Without extra, bucket-relative 32 bits stand for a value (a rare
    clash only makes it look shared); with extra, a uint64 for each value goes along."""
    bounds = bucket_spans(values, buckets)
    at, sizes, loads = [], [], []
    width = np.uint64(((1 << 64) // buckets >> 32) + 1)
    for b in np.flatnonzero(np.diff(bounds)):
        lo, hi = bounds[b], bounds[b + 1]
        low = ((values[lo:hi] - np.uint64((int(b) << 64) // buckets)) // width).astype(np.uint64)
        step = np.diff(low, prepend=np.uint64(0)).astype(np.uint32)
        raw = _planes(step)
        if extra is not None:
            raw = len(raw).to_bytes(4, "little") + raw + _planes(np.ascontiguousarray(extra[lo:hi]))
        at.append(int(b)), sizes.append(int(hi - lo)), loads.append(raw)
    return pa.table({"pid": pa.array([pid] * len(at), pa.int32()), "bucket": pa.array(at, pa.int32()), "n": pa.array(sizes, pa.int32()), "payload": pa.array(loads, pa.binary())})


def _asked(t: pa.Table, extra: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    values, more, sizes = [], [], t["n"].to_numpy()
    for n, raw in zip(sizes, t["payload"].to_pylist()):
        cut = int.from_bytes(raw[:4], "little") if extra else None
        values.append(np.cumsum(_unplanes(raw[4 : 4 + cut] if extra else raw, n, np.uint32).astype(np.uint64)))
        if extra:
            more.append(_unplanes(raw[4 + cut :], n, np.uint64))
    return np.concatenate(values), sizes, np.concatenate(more) if extra else None, np.concatenate(([0], np.cumsum(sizes)))


def answers(asked: DataFrame, judge: Callable[[np.ndarray, np.ndarray | None], np.ndarray], extra: bool = False) -> DataFrame:
    """judge(values, extra) gets a bucket's values grouped (sorted) and gives a uint8 for each entry."""

    def bucket(t: pa.Table) -> pa.Table:
        values, sizes, more, first = _asked(t, extra)
        order = np.argsort(values, kind="stable")
        said = np.empty(len(values), np.uint8)
        said[order] = judge(values[order], more[order] if extra else None)
        loads = [pa.compress(said[first[i] : first[i + 1]].tobytes(), codec="zstd", asbytes=True) for i in range(len(sizes))]
        return pa.table({"pid": t["pid"], "bucket": t["bucket"], "n": t["n"], "payload": pa.array(loads, pa.binary())})

    return asked.groupBy("bucket").applyInArrow(bucket, ASK)


def none(schema: str) -> pa.Table:
    """No rows of a schema in Spark's short form."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.table({c: pa.array([], kinds[t]) for c, t in (x.split() for x in schema.split(", "))})


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the run, lengths of runs) of a sorted array."""
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    which = np.cumsum(new) - 1
    return which, np.bincount(which, minlength=0)


def counted(values: np.ndarray, _extra: np.ndarray | None) -> np.ndarray:
    """0 for a value that one group asked for, else 1 + log2 of how many groups did."""
    which, n = runs(values)
    return np.where(n > 1, 1 + np.log2(np.maximum(n, 1)).astype(np.uint8), 0).astype(np.uint8)[which]


def same(values: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """1 where all groups sent the same extra for a value and it isn't 0."""
    which, n = runs(values)
    at = np.concatenate(([0], np.cumsum(n)))[:-1]
    low, high = np.minimum.reduceat(extra, at), np.maximum.reduceat(extra, at)
    return ((low == high) & (low > 0)).astype(np.uint8)[which]


def heard(replies: pa.Table, values: np.ndarray, buckets: int) -> np.ndarray:
    """The answers, in the order of the values asked for."""
    bounds = bucket_spans(values, buckets)
    out = np.zeros(len(values), np.uint8)
    for b, n, raw in zip(replies["bucket"].to_pylist(), replies["n"].to_pylist(), replies["payload"].to_pylist()):
        out[bounds[b] : bounds[b + 1]] = np.frombuffer(pa.decompress(raw, decompressed_size=n, codec="zstd", asbytes=True), np.uint8)
    return out
