"""Change feed of revenue leaderboards: a stateful stream over batches of sale lines.

Lines are priced and put to nations by joins, cut into batches by arrival and fed in order to one streaming query
that is started anew for each batch on one checkpoint. Its state is kept per nation and share of its items
(``SHARE`` items about, by a hash of the item), so that neither a large nation nor its dictionary meets in one
task: a serialized dictionary of revenues. A max-heap over it, built when the state is read, is popped lazily:
entries that no longer tell an item's revenue are skipped until ten items are valid, which are pushed back after
each arrival day. A share reports what came onto, changed on, or left its own ten.

A nation's ten are among the tens of its shares. They are ranked day by day from the shares' reports, where
tasks drop all but ten before anything is shuffled, and two boards in a row make the changes.

Lines are summed by nation, item and day in the tasks that read them, so a hot item or nation is few rows in the
shuffle to the state. A batch is one micro-batch: a restart repeats it from its files, the state's last version
and the sink's log, so every row is written once whatever is lost.

Nulls: lines without shipped_at get a day from their hash; without amount, the quantity at the item's price,
without that too 0 (amounts and prices that aren't finite count as null); lines without a nation or an item row
are ignored, though their days count for what is late. Repeated lines count again; of repeated item or vendor
rows the smallest price and nation hold. Empty tables give no rows. Other columns don't matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bitloom.plans.lineage import kept, new_folder, remove

TOP = 10
SHARE = 8192  # items of a share of a nation, about

LINE = "batch int, ship_day int, arrival_day int, nation_id int, item_id long, cents double, largest int"
SUM = "nation_id int, share int, item_id long, arrival_day int, batch int, cents double"
REPORT = "nation_id int, item_id long, arrival_day int, batch int, cents double, on_board boolean"


@dataclass(frozen=True)
class Calendar:
    """Arrival days are cut into ``batches`` equal parts of ``days`` days from ``first``; a line is late if it
    shipped over ``slack`` days before the largest day of earlier batches."""

    first: int = 19723
    days: int = 180
    batches: int = 12
    slack: int = 8


def _finite(c: str) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.col(c))


def _cents(c: str) -> Column:
    return F.floor(100 * _finite(c) + 0.5).cast("double")


def priced_lines(lines: DataFrame, items: DataFrame, vendors: DataFrame, calendar: Calendar = Calendar()) -> DataFrame:
    """(batch, ship_day, arrival_day, nation_id, item_id, cents) of every line; item_id is null without an item row."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    h = F.crc32(F.concat_ws(",", text("sale_id"), text("item_id"), text("vendor_id"), text("line_no")))
    d = lines.select("item_id", "vendor_id", "quantity", "amount", "flag", "shipped_at", h.alias("h"))
    d = d.withColumn("ship_day", F.coalesce(F.unix_date(F.to_date("shipped_at")), (calendar.first + F.col("h") % 150).cast("int")))
    d = d.withColumn("arrival_day", (F.col("ship_day") + F.col("h") % 7 + F.when(F.col("h") % 5 == 0, 20).otherwise(0)).cast("int"))
    batch = 1 + F.floor((F.col("arrival_day") - calendar.first) * calendar.batches / calendar.days)
    d = d.withColumn("batch", F.greatest(F.lit(1), F.least(F.lit(calendar.batches), batch)).cast("int"))
    # one row an id, written, so that the joins read plain tables and Spark can split their hot keys
    one = lambda t, c, v: kept(t.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("long").alias(c)).agg(v)).hint("merge")
    prices = one(items, "item_id", F.min(_cents("price")).alias("price")).withColumn("known", F.lit(True))
    nations = one(vendors, "vendor_id", F.min(F.col("nation_id").cast("int")).alias("nation_id"))
    d = d.join(prices, "item_id", "left").join(nations, "vendor_id", "left")
    cents = F.coalesce(_cents("amount"), F.col("quantity") * F.col("price"), F.lit(0.0))
    signed = F.when(F.col("flag") == "returned", -cents).otherwise(cents)
    return d.select("batch", "ship_day", "arrival_day", "nation_id", F.when(F.col("known"), F.col("item_id")).cast("long").alias("item_id"), signed.alias("cents"))


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the cents of equal rows of a batch."""
    keys = ["nation_id", "share", "item_id", "arrival_day", "batch"]
    for b in batches:
        t = pa.Table.from_batches([b]).group_by(keys).aggregate([("cents", "sum")]).rename_columns([*keys, "cents"])
        yield from t.to_batches()


class Board:
    """The revenues of items, and a max-heap over them in which old revenues may remain."""

    def __init__(self, revenue: dict[int, float]):
        self.revenue = revenue
        self._fill()

    def _fill(self) -> None:
        self.heap = [(-r, i) for i, r in self.revenue.items() if r > 0]
        heapq.heapify(self.heap)

    def add(self, item: int, cents: float) -> None:
        r = self.revenue[item] = self.revenue.get(item, 0.0) + cents
        if r > 0:
            heapq.heappush(self.heap, (-r, item))
        if len(self.heap) > 2 * len(self.revenue) + 64:  # mostly old ones
            self._fill()

    def top(self) -> dict[int, float]:
        """The valid items of highest revenue, best first; they stay in the heap."""
        found: dict[int, float] = {}
        while self.heap and len(found) < TOP:
            r, item = heapq.heappop(self.heap)
            if item not in found and self.revenue[item] == -r:
                found[item] = -r
        for item, r in found.items():
            heapq.heappush(self.heap, (-r, item))
        return found


def share_changes(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One batch of a share of a nation: the reports of its days; the state takes the new revenues."""
    revenue: dict[int, float] = {}
    if state.exists:
        items, values = state.get
        revenue = dict(zip(np.frombuffer(items, np.int64).tolist(), np.frombuffer(values, np.float64).tolist()))
    board, out = Board(revenue), []
    old = board.top()
    d = pd.concat(list(parts), ignore_index=True)
    for (day, batch), lines in d.groupby(["arrival_day", "batch"], sort=True):
        for item, cents in zip(lines["item_id"].tolist(), lines["cents"].tolist()):
            board.add(item, cents)
        new = board.top()
        out += [(key[0], i, day, batch, r, True) for i, r in new.items() if old.get(i) != r]
        out += [(key[0], i, day, batch, revenue[i], False) for i in old if i not in new]
        old = new
    state.update((np.fromiter(revenue.keys(), np.int64, len(revenue)).tobytes(), np.fromiter(revenue.values(), np.float64, len(revenue)).tobytes()))
    yield pd.DataFrame(out, columns=[x.split()[0] for x in REPORT.split(", ")])


def reports(spark: SparkSession, folder: str, shares: int, calendar: Calendar = Calendar()) -> DataFrame:
    """The streaming query: lines that come into the folder -> what the shares report."""
    lines = spark.readStream.schema(LINE).option("recursiveFileLookup", "true").parquet(folder)
    live = lines.filter("nation_id is not null and item_id is not null").filter(F.coalesce(F.col("ship_day") + calendar.slack >= F.col("largest"), F.lit(True)))
    share = F.pmod(F.xxhash64("item_id"), F.lit(shares)).cast("int").alias("share")
    sums = live.select("nation_id", share, "item_id", "arrival_day", "batch", "cents").mapInArrow(summed, SUM)
    return sums.groupBy("nation_id", "share").applyInPandasWithState(share_changes, REPORT, "items binary, revenue binary", "append", GroupStateTimeout.NoTimeout)


def fed(spark: SparkSession, lines: DataFrame, shares: int, calendar: Calendar = Calendar()) -> DataFrame:
    """Reports of all batches of lines (priced_lines), each fed to a new start of the query on one checkpoint."""
    at = new_folder(spark, "board")
    lines.write.partitionBy("batch").option("compression", "zstd").parquet(f"{at}/cut")
    cut = spark.read.schema(LINE).parquet(f"{at}/cut").drop("largest")
    ends = {r["batch"]: r["day"] for r in cut.groupBy("batch").agg(F.max("ship_day").alias("day")).collect()}  # a row a batch
    largest = None
    for b in sorted(ends):
        cut.filter(F.col("batch") == b).withColumn("largest", F.lit(largest).cast("int")).write.option("compression", "zstd").parquet(f"{at}/feed/{b:03}")
        stream = reports(spark, f"{at}/feed", shares, calendar).writeStream.format("parquet").outputMode("append")
        stream.option("path", f"{at}/reports").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        largest = max(ends[b], ends[b] if largest is None else largest)
    for done in ("cut", "feed", "checkpoint"):
        remove(spark, f"{at}/{done}")
    return spark.read.schema(REPORT).parquet(f"{at}/reports") if ends else spark.createDataFrame([], REPORT)


def board_changes(reported: DataFrame) -> DataFrame:
    """(nation_id, arrival_day, item_id, batch, change, old_rank, new_rank, revenue) from the shares' reports."""
    day = Window.partitionBy("nation_id").orderBy("arrival_day")
    days = kept(reported.select("nation_id", "arrival_day", "batch").distinct().withColumn("k", F.row_number().over(day)))  # a row a nation and day
    last = days.groupBy("nation_id").agg(F.max("k").alias("last"))
    own = Window.partitionBy("nation_id", "item_id").orderBy("k")
    spans = reported.join(days.drop("batch"), ["nation_id", "arrival_day"]).join(last, "nation_id")
    spans = kept(spans.select("nation_id", "item_id", "k", F.coalesce(F.lead("k").over(own) - 1, "last").alias("to"), "cents", "on_board"))
    order = Window.partitionBy("nation_id", "k").orderBy(F.desc("cents"), "item_id")
    each = spans.filter("on_board").select("nation_id", "item_id", "cents", F.explode(F.sequence("k", "to")).alias("k"))
    boards = kept(each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP))
    none = F.lit(None).cast("int")
    now = boards.select("nation_id", "k", "item_id", none.alias("old_rank"), F.col("rank").alias("new_rank"))
    then = boards.select("nation_id", (F.col("k") + 1).alias("k"), "item_id", F.col("rank").alias("old_rank"), none.alias("new_rank"))
    moved = now.unionByName(then).groupBy("nation_id", "k", "item_id").agg(F.max("old_rank").alias("old_rank"), F.max("new_rank").alias("new_rank")).filter("not old_rank <=> new_rank")
    change = F.when(F.col("old_rank").isNull(), "enter").when(F.col("new_rank").isNull(), "exit").otherwise("move")
    worth = spans.select("nation_id", "item_id", F.col("k").alias("since"), "to", F.col("cents").cast("long").alias("revenue"))
    d = moved.join(worth, ["nation_id", "item_id"]).filter("k between since and to").join(days, ["nation_id", "k"])
    return d.select("nation_id", F.col("arrival_day").cast("long").alias("arrival_day"), "item_id", "batch", change.alias("change"), "old_rank", "new_rank", "revenue")


def leaderboard_changes(lines: DataFrame, items: DataFrame, vendors: DataFrame, calendar: Calendar = Calendar()) -> DataFrame:
    """The change feed of all nations' boards."""
    shares = max(1, -(-items.count() // SHARE))
    return board_changes(fed(lines.sparkSession, priced_lines(lines, items, vendors, calendar), shares, calendar))
