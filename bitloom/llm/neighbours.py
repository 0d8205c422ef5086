"""Approximate nearest neighbours by low-dimensional stable projections.

Vectors are projected onto ``m`` Gaussian directions (2-stable: a squared projected distance over the
squared distance is chi-square with m degrees of freedom). A query's projected neighbours are taken in
order of their projected distance r and verified by the true distance; it ends when the k-th best
distance d found so far satisfies chi2_m(c^2 r^2 / d^2) >= ``confidence``: a vector nearer than d / c
would lie as far away in projection with a probability of at most 1 - confidence. All vectors are indexed.

* Equal vectors are one point, with the k + 1 smallest ids that have it, which is all that any answer can
  name; equal queries are one search.
* A kd-tree over the projections of about ``sample_rows`` points (that bound is the only sample) cuts the
  space into cells of about a shard's rows; a cell of more rows is dealt to several shards. Each shard's own
  kd-tree is built once and written: the index is a table of shards.
* A query searches the shard of its own place first, its nearest leaves before the others. With the distance found there it goes to those shards
  alone whose cells' bounding boxes the stopping test doesn't rule out. Vectors aren't copied, but for a
  shard that more than ``block_rows`` queries go to, which is read once for each so many.

Driver: the sample's projections and a row a cell, of which there are no more than sample rows. Vectors
that are null, all zeros or hold null or non-finite components take no part, nor do null ids; of rows with
one id the smallest vector counts. Only vectors of a query's length are its candidates. Fewer than k
candidates: all are returned. Ties go to the smaller id. An empty table gives no rows. Other columns are
not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitloom.plans.lineage import kept

from ._rows import named

LEAF = 32
CHUNK = 96  # points verified between two looks at the stopping test
SHARD = 4 << 20  # bytes of vectors in a shard, and
ROWS = 8192  # rows at most
LEAST = 8  # sample points of a cell

_SHARD = "dim int, cell int, sub int, ids binary, first binary, vectors binary, points binary, low binary, high binary, spans binary"
_FOUND = "q long, vec_id long, score double, verified long"


def chi2_cdf(x: float, m: int) -> float:
    """Of m degrees of freedom, m even."""
    term = total = math.exp(-x / 2)
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - total


def chi2_quantile(p: float, m: int) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, m) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, m) < p else (low, mid)
    return high


def axes(dim: int, m: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(dim)).standard_normal((dim, m))


def cut(points: np.ndarray, most: int) -> tuple[np.ndarray, list[tuple[int, int]], list]:
    """(order, spans of leaves of at most ``most`` points unless these are equal, splits): each time at the
    median of the widest direction; splits are nested (direction, place, low, high) or numbers of leaves."""
    order, spans = np.arange(len(points)), []

    def part(a: int, b: int):
        own = points[order[a:b]]
        if b - a > most:
            low, high = own.min(axis=0), own.max(axis=0)
            if (high > low).any():
                axis = int((high - low).argmax())
                mid = (b - a) // 2
                by = np.argsort(own[:, axis], kind="stable")
                order[a:b] = order[a:b][by]
                place = own[by[mid], axis]
                mid = int(np.searchsorted(own[by, axis], place, "left")) or int(np.searchsorted(own[by, axis], place, "right"))
                place = own[by[mid], axis]
                return (axis, float(place), part(a, a + mid), part(a + mid, b))
        spans.append((a, b))
        return len(spans) - 1

    return order, spans, part(0, len(points)) if len(points) else 0


def leaf_of(points: np.ndarray, splits) -> np.ndarray:
    """The leaf of each point."""
    out = np.zeros(len(points), np.int32)
    todo = [(np.arange(len(points)), splits)]
    while todo:
        at, node = todo.pop()
        if isinstance(node, tuple):
            up = points[at, node[0]] >= node[1]
            todo += [(at[~up], node[2]), (at[up], node[3])]
        else:
            out[at] = node
    return out


def gaps(low: np.ndarray, high: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances of a point to boxes."""
    g = np.maximum(np.maximum(low - p, p - high), 0)
    return (g * g).sum(axis=1)


class Shard:
    """Points with their ids and projections, in the order of a kd-tree's leaves."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, vectors: np.ndarray, points: np.ndarray, low: np.ndarray, high: np.ndarray, spans: np.ndarray):
        self.ids, self.first, self.vectors, self.points, self.low, self.high, self.spans = ids, first, vectors, points, low, high, spans

    @classmethod
    def build(cls, ids: list[np.ndarray], vectors: np.ndarray, points: np.ndarray) -> Shard:
        order, spans, _ = cut(points, LEAF)
        points = points[order]
        boxes = [(points[a:b].min(axis=0), points[a:b].max(axis=0)) for a, b in spans]
        first = np.concatenate(([0], np.cumsum([len(ids[i]) for i in order])))
        return cls(np.concatenate([ids[i] for i in order]), first, vectors[order], points, np.array([x for x, _ in boxes]), np.array([x for _, x in boxes]), np.array(spans))

    def search(self, q: np.ndarray, p: np.ndarray, k: int, stop: float, bound2: float = np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, squared distances, points verified) of the k nearest; bound2: squared distance of a k-th
        nearest that is known from elsewhere."""
        far = gaps(self.low, self.high, p)
        ids, best, verified = np.zeros(0, np.int64), np.zeros(0), 0
        seen = np.zeros(len(self.points), bool)

        def verify(at: np.ndarray) -> None:
            nonlocal ids, best, verified
            g = self.vectors[at] - q
            d2 = (g * g).sum(axis=1)
            verified += len(at)
            seen[at] = True
            ok = d2 <= (min(bound2, best[-1]) if len(best) >= k else bound2)
            if ok.any():
                rows, d2 = at[ok], d2[ok]
                n_ids = self.first[rows + 1] - self.first[rows]
                which = np.repeat(np.arange(len(rows)), n_ids)
                own = self.first[rows][which] + np.arange(len(which)) - np.repeat(np.cumsum(n_ids) - n_ids, n_ids)
                ids, best = np.concatenate((ids, self.ids[own])), np.concatenate((best, d2[which]))
                order = np.lexsort((ids, best))[:k]
                ids, best = ids[order], best[order]

        if bound2 == np.inf:  # the points of the nearest leaves give a first distance
            for i in np.argsort(far, kind="stable")[: -(-4 * k // LEAF)]:
                verify(np.arange(*self.spans[i]))
        limit = stop * (min(bound2, best[-1]) if len(best) >= k else bound2)
        inside = np.zeros(len(self.points) + 1, np.int64)
        use = self.spans[far <= limit]
        np.add.at(inside, use[:, 0], 1), np.add.at(inside, use[:, 1], -1)
        at = np.flatnonzero((np.cumsum(inside[:-1]) > 0) & ~seen)
        g = self.points[at] - p
        r = (g * g).sum(axis=1)
        order = np.argsort(r, kind="stable")
        r, at = r[order], at[order]
        done = 0
        while done < len(r) and r[done] <= limit:
            to = min(done + CHUNK, int(np.searchsorted(r, limit, "right")))
            verify(at[done:to])
            done = to
            limit = stop * (min(bound2, best[-1]) if len(best) >= k else bound2)
        return ids, best, verified

    def packed(self) -> list[bytes]:
        return [np.ascontiguousarray(x).tobytes() for x in (self.ids, self.first, self.vectors, self.points, self.low, self.high, self.spans)]

    @classmethod
    def unpacked(cls, raw: list[bytes], dim: int, m: int) -> Shard:
        kinds = ((np.int64, ()), (np.int64, ()), (np.float64, (dim,)), (np.float64, (m,)), (np.float64, (m,)), (np.float64, (m,)), (np.int64, (2,)))
        return cls(*(np.frombuffer(x, t).reshape(-1, *s) for x, (t, s) in zip(raw, kinds)))


def _matrix(c: pa.ChunkedArray | pa.Array) -> np.ndarray:
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


def _projected(d: DataFrame, m: int) -> DataFrame:
    """d (dim, v, ...) with the projections p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.zeros((b.num_rows, m))
            dims, v = b["dim"].to_numpy(), b["v"]
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                p[at] = _matrix(v.take(pa.array(at))) @ axes(int(dim), m)
            yield b.append_column("p", pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), m).cast(pa.list_(pa.float64())))

    return d.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema) + ", p array<double>")


def _points(vectors: DataFrame, id_col: str, vector_col: str, every: int, k: int, m: int) -> tuple[DataFrame, DataFrame]:
    """(points (dim, v, ids, p), queries (id, dim, v)): ids: the k + 1 smallest of a vector."""
    v = F.transform(named(vector_col), lambda x: x.cast("double"))
    d = vectors.select(named(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and size(v) > 0")
    d = d.filter("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)")
    d = kept(d.groupBy("id").agg(F.min("v").alias("v")))
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = d.withColumn("place", place).filter(F.col("place") <= k + 1)  # cut before the shuffle, too
    points = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.size("v").alias("dim"), "v", "ids")
    return kept(_projected(points, m)), d.filter(F.pmod("id", F.lit(every)) == 0).select("id", F.size("v").alias("dim"), "v")


def _cells(points: DataFrame, m: int, sample_rows: int) -> dict[int, tuple[int, object]]:
    """dim -> (rows of a shard, splits)."""
    sizes = {r["dim"]: r["n"] for r in points.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row a vector length
    total = sum(sizes.values())
    picked = points if total <= sample_rows else points.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(sample_rows / total * (1 << 30)))
    seen: dict[int, list] = {}
    t = picked.select("dim", "p").toArrow()
    dims, p = t["dim"].to_numpy(), _matrix(t["p"]) if t.num_rows else np.zeros((0, m))
    for dim, n in sizes.items():
        rows = max(1, min(ROWS, SHARD // (8 * dim)))
        mine = p[dims == dim]
        cells = min(-(-n // rows), max(1, len(mine) // LEAST))
        seen[dim] = (rows, cut(mine, -(-len(mine) // cells))[2] if len(mine) else 0)
    return seen


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, m: int = 24, c: float = 1.02, confidence: float = 0.95, sample_rows: int = 20_000, block_rows: int = 32_768) -> DataFrame:
    """(query_id, rank, vec_id, score, verified): queries are the rows whose id is divisible by every;
    verified: how many different vectors the query's true distance was worked out for."""
    spark, stop, more = vectors.sparkSession, chi2_quantile(confidence, m) / c**2, k + 1
    points, queries = _points(vectors, id_col, vector_col, every, k, m)
    trees = _cells(points, m, sample_rows)
    shipped = spark.sparkContext.broadcast(trees)  # as many nodes as sample points at most

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, p, cell = b["dim"].to_numpy(), _matrix(b["p"]), np.zeros(b.num_rows, np.int32)
            for dim in np.unique(dims):
                at = dims == dim
                cell[at] = leaf_of(p[at], shipped.value[int(dim)][1])
            yield b.append_column("cell", pa.array(cell))

    wide = "dim int, v array<double>, ids array<long>, p array<double>, cell int"
    inside = points.mapInArrow(placed, wide)
    boxes = inside.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.array(*(F.min(F.col("p")[i]) for i in range(m))).alias("low"), F.array(*(F.max(F.col("p")[i]) for i in range(m))).alias("high")).orderBy("dim", "cell").collect()
    known: dict[int, tuple] = {}
    for dim in trees:
        mine = [r for r in boxes if r["dim"] == dim]
        known[dim] = (np.array([r["cell"] for r in mine]), np.array([-(-r["n"] // trees[dim][0]) for r in mine]), np.array([r["low"] for r in mine]), np.array([r["high"] for r in mine]))
    subs = spark.createDataFrame([(int(d), int(x), int(n)) for d, (cells, ns, _, _) in known.items() for x, n in zip(cells, ns)], "dim int, cell int, subs int")
    where = spark.sparkContext.broadcast(known)  # a row a cell

    def build(t: pa.Table) -> pa.Table:
        ids = [np.array(x, np.int64) for x in t["ids"].to_pylist()]
        raw = Shard.build(ids, _matrix(t["v"]), _matrix(t["p"])).packed()
        names = [x.split()[0] for x in _SHARD.split(", ")]
        return pa.table([t[x].slice(0, 1).combine_chunks() for x in names[:3]] + [pa.array([x], pa.binary()) for x in raw], names=names)

    dealt = inside.join(F.broadcast(subs), ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("v"), F.col("subs")).cast("int"))
    index = kept(dealt.groupBy("dim", "cell", "sub").applyInArrow(build, _SHARD))

    # equal queries are one, q is their smallest id
    asked = kept(_projected(queries.groupBy("dim", "v").agg(F.min("id").alias("q")), m))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {x: [] for x in ("row", "cell", "sub")}
            for i, (q, dim, p) in enumerate(zip(b["q"].to_pylist(), b["dim"].to_pylist(), _matrix(b["p"]))):
                cells, ns, low, high = where.value[dim]
                j = int(gaps(low, high, p).argmin())
                out["row"].append(i), out["cell"].append(int(cells[j])), out["sub"].append(q % int(ns[j]))
            yield _routed(b, out, [np.inf] * len(out["row"]))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, bounds = {x: [] for x in ("row", "cell", "sub")}, []
            for i, (q, dim, p, bound2) in enumerate(zip(b["q"].to_pylist(), b["dim"].to_pylist(), _matrix(b["p"]), b["bound2"].to_pylist())):
                cells, ns, low, high = where.value[dim]
                g = gaps(low, high, p)
                own = int(g.argmin())
                for j in np.flatnonzero(g <= stop * bound2):
                    for s in range(int(ns[j])):
                        if j != own or s != q % int(ns[j]):
                            out["row"].append(i), out["cell"].append(int(cells[j])), out["sub"].append(s), bounds.append(bound2)
            yield _routed(b, out, bounds)

    def _routed(b: pa.RecordBatch, out: dict[str, list], bounds: list[float]) -> pa.RecordBatch:
        at = pa.array(out["row"], pa.int64())
        return pa.RecordBatch.from_arrays([*(b[x].take(at) for x in ("q", "dim", "v", "p")), pa.array(out["cell"], pa.int32()), pa.array(out["sub"], pa.int32()), pa.array(bounds, pa.float64())], names=["q", "dim", "v", "p", "cell", "sub", "bound2"])

    def look(t: pa.Table, qs: pa.Table) -> pa.Table:
        out_q, out_i, out_d, out_n = [], [], [], []
        if t.num_rows and qs.num_rows:
            shard = Shard.unpacked([t[x][0].as_py() for x in ("ids", "first", "vectors", "points", "low", "high", "spans")], t["dim"][0].as_py(), m)
            for q, v, p, bound2 in zip(qs["q"].to_pylist(), _matrix(qs["v"]), _matrix(qs["p"]), qs["bound2"].to_pylist()):
                ids, d2, n = shard.search(v, p, more, stop, bound2)
                out_q.append(np.full(len(ids) + 1, q)), out_i.append(np.append(ids, -1)), out_d.append(np.append(np.sqrt(d2), np.inf)), out_n.append(np.append(np.zeros(len(ids), np.int64), n))
        cat = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
        return pa.table({"q": cat(out_q, pa.int64()), "vec_id": cat(out_i, pa.int64()), "score": cat(out_d, pa.float64()), "verified": cat(out_n, pa.int64())})

    def met(routed: DataFrame) -> DataFrame:
        """Queries and shards by shard, in blocks of at most about block_rows queries."""
        routed = kept(routed)
        keys = ["dim", "cell", "sub"]
        blocks = routed.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("blocks"))
        left = index.join(blocks, keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        right = routed.join(blocks, keys).withColumn("block", F.pmod(F.xxhash64("q", F.lit(7)), F.col("blocks")).cast("int")).drop("blocks")
        return left.groupBy(*keys, "block").cogroup(right.groupBy(*keys, "block")).applyInArrow(look, _FOUND)

    schema = "q long, dim int, v array<double>, p array<double>, cell int, sub int, bound2 double"
    first = kept(met(asked.mapInArrow(home, schema)))
    order = Window.partitionBy("q").orderBy("score", "vec_id")
    bound = first.filter("vec_id >= 0 or score < double('infinity')").withColumn("place", F.row_number().over(order)).filter(F.col("place") == more).select("q", (F.col("score") * F.col("score") * (1 + 1e-12)).alias("bound2"))
    second = met(asked.join(bound, "q", "left").withColumn("bound2", F.coalesce("bound2", F.lit(float("inf")))).mapInArrow(others, schema))
    found = kept(first.unionByName(second))
    looked = found.groupBy("q").agg(F.sum("verified").alias("verified"))
    best = found.filter("score < double('infinity')").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= more).drop("verified", "place")
    mine = queries.join(asked.select("q", "dim", "v"), ["dim", "v"]).select(F.col("id").alias("query_id"), "q")
    got = mine.join(best, "q").filter("vec_id != query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")).filter(F.col("rank") <= k)
    return got.join(looked, "q").select("query_id", "rank", "vec_id", "score", "verified")
