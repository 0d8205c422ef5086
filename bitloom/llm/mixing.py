"""Mixing sources to target weights by Pfair scheduling.

A source's rows form blocks of ``block_rows``. Of sources with weights w out of W = sum of weights, the
j-th block of one (from 1) is released at slot floor((j - 1) W / w) and due before slot ceil(j W / w);
each slot goes to the released block with the earliest deadline. One slot serves one block, so this
meets all deadlines: at every slot each source has had its share of the slots up to less than one block.
When a source has no blocks left, the others go on with a new schedule (a phase) from that slot, by the
same rule. A schedule repeats after W slots, so the driver works out W slots a phase, at most one phase
a source, whatever the number of rows; rows take their slots from that table by arithmetic.

Weights are brought to lowest terms; such that still add up to more than ``MOST_SLOTS`` raise.

Sources without a weight are pooled under ``other``, null sources too. All rows are kept. Rows of a
source are taken in order of a hash of id and text; repeated rows share a position. Null ids and texts
are values like others. Positions are from 0 and, without repeated rows, gapless. An empty table has no
positions. ``mixed`` gives all columns back as they are, whatever their names.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.plans.lineage import kept

from ._rows import named, row_of, unpacked

OTHER = "other"
MOST_SLOTS = 1_000_000  # of a schedule, which the driver walks once a phase


def frame(weights: dict[str, int]) -> list[str]:
    """The sources of the W slots of a schedule, earliest deadline first among the released blocks."""
    total, names = sum(weights.values()), sorted(weights)
    waiting = [(0, s, 1) for s in names]  # release, source, block
    ready: list[tuple[int, str, int]] = []
    heapq.heapify(waiting)
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * total // weights[s]), s, j))
        due, s, j = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a deadline is missed")
        out.append(s)
        heapq.heappush(waiting, (j * total // weights[s], s, j + 1))
    return out


def phases(blocks: dict[str, int], weights: dict[str, int]) -> list[tuple[str, int, int, int, int, list[int]]]:
    """(source, first block, blocks, first slot, W, slots of its blocks in a schedule), phase by phase."""
    left = {s: n for s, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    start, out = 0, []
    while left:
        now = {s: weights[s] for s in left}
        slots: dict[str, list[int]] = {s: [] for s in now}
        for i, s in enumerate(frame(now)):
            slots[s].append(i)
        total = sum(now.values())
        end = min((left[s] - 1) // w * total + slots[s][(left[s] - 1) % w] + 1 for s, w in now.items())
        for s, w in now.items():
            n = end // total * w + sum(x < end % total for x in slots[s])
            if n:
                out.append((s, done[s], n, start, total, slots[s]))
            done[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
        start += end
    return out


def _lowest(weights: dict[str, int]) -> dict[str, int]:
    """The same shares in lowest terms."""
    low = {s: w // math.gcd(*weights.values()) for s, w in weights.items()}
    if sum(low.values()) > MOST_SLOTS:
        raise ValueError(f"weights that add up to more than {MOST_SLOTS}: give coarser ones")
    return low


def _source(c: Column, weights: dict[str, int]) -> Column:
    name = c.cast("string")
    return F.when(name.isin(*{OTHER: 1} | weights), name).otherwise(F.lit(OTHER))


def positions(docs: DataFrame, weights: dict[str, int], id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block_rows: int = 16) -> DataFrame:
    """(doc_id, text_hash, source, weight, block, slot, position) of each distinct (id, source, text).

    weights: positive integers by source; may name ``other``, which counts 1 if it doesn't."""
    if any(w < 1 or int(w) != w for w in weights.values()):
        raise ValueError("weights are positive integers")
    spark, weights = docs.sparkSession, _lowest({OTHER: 1} | {k: int(v) for k, v in weights.items()})
    d = docs.select(named(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(named(text_col), F.lit(""))).alias("text_hash"), _source(named(source_col), weights).alias("source")).distinct()
    d = d.withColumn("turn", F.xxhash64("doc_id", "text_hash"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = kept(d.repartitionByRange(n, "source", "turn", "doc_id").withColumn("part", F.spark_partition_id()))

    counts = d.groupBy("part", "source").count()  # at most as many rows as partitions and sources
    sums = counts.withColumn("before", F.sum("count").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    per_source = {r["source"]: r["n"] for r in counts.groupBy("source").agg(F.sum("count").alias("n")).collect()}  # at most one row a weight
    plan = phases({s: -(-c // block_rows) for s, c in per_source.items()}, weights)

    by_source: dict[str, list] = {}
    lasts = []  # (slot of a source's last block, rows that it lacks)
    for s, first, k, start, total, slots in plan:
        by_source.setdefault(s, []).append((first, k, start, total, slots))
        j = first + k - 1
        if j == -(-per_source[s] // block_rows) - 1:
            lasts.append((start + (k - 1) // len(slots) * total + slots[(k - 1) % len(slots)], -per_source[s] % block_rows))
    table = spark.createDataFrame([(s, weights[s], p, lasts) for s, p in by_source.items()], "source string, weight int, plan array<struct<first: long, n: long, start: long, total: long, slots: array<int>>>, lasts array<struct<slot: long, lacks: long>>")
    own = Window.partitionBy("part", "source").orderBy("turn", "doc_id", "text_hash")
    d = d.withColumn("rank", F.row_number().over(own) - 1).join(F.broadcast(sums.drop("count")), ["part", "source"]).join(F.broadcast(table), "source")
    d = d.withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0))).withColumn("block", F.floor(F.col("rank") / block_rows).cast("long"))
    d = d.withColumn("p", F.expr("filter(plan, x -> block >= x.first and block < x.first + x.n)[0]"))
    d = d.withColumn("slot", F.expr("p.start + (block - p.first) div size(p.slots) * p.total + p.slots[cast((block - p.first) % size(p.slots) as int)]"))
    position = F.expr(f"slot * {block_rows} + rank % {block_rows} - aggregate(lasts, 0L, (a, x) -> if(x.slot < slot, a + x.lacks, a))")
    return d.select("doc_id", "text_hash", "source", "weight", "block", "slot", position.cast("long").alias("position"))


def mixed(docs: DataFrame, weights: dict[str, int], id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block_rows: int = 16, position: str | None = None) -> DataFrame:
    """All rows of docs, in the order of their positions; position: the name of a column for them, which
    takes the place of one of docs that is called so."""
    at = positions(docs, weights, id_col, source_col, text_col, block_rows)
    text = F.xxhash64(F.coalesce(named(text_col), F.lit("")))
    mine = docs.select(named(id_col).cast("long").alias("i"), text.alias("h"), _source(named(source_col), weights).alias("s"), row_of(docs).alias("row"))
    at = at.select("doc_id", "text_hash", "source", "position")
    both = mine.join(at, mine.i.eqNullSafe(at.doc_id) & (mine.h == at.text_hash) & (mine.s == at.source)).orderBy("position")
    return both.select(*unpacked(docs, leave=(position,) if position else ()), *([F.col("position").alias(position)] if position else []))
