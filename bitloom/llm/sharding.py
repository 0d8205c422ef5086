"""Contiguous shards of near equal byte size.

Rows are range-partitioned by (hash of the text, id), so equal texts are neighbours. Each partition's
byte total gives, summed over the partitions before it, the global prefix of every row; shard i has the
rows whose middle falls into the i-th of equal parts of all bytes. A group of equal texts that isn't
larger than the largest row is cut as one row and so stays together; larger groups are cut between
their rows. Every shard's size differs from the target by less than the largest row's.

Only one summary row a partition reaches the driver; a text in a third of all rows is spread over as
many partitions as it fills. Null texts have no bytes, and ``size`` counts ``ROW`` more for each row.
Null ids come first within equal texts. Repeated rows are rows. An empty table has no shards. Other columns
are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitloom.plans.lineage import kept


ROW = 8


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + ROW).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = kept(d.repartitionByRange(n, "h", "doc_id").withColumn("part", F.spark_partition_id()))

    groups = d.groupBy("part", "h").agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.max("size").alias("top"))
    g = F.struct("h", "size")
    parts = groups.groupBy("part").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows"), F.max("top").alias("top"), F.min(g).alias("low"), F.max(g).alias("high")).orderBy("part").collect()
    total, top = sum(p["size"] for p in parts), max((p["top"] for p in parts), default=0)
    # of the groups at a partition's ends: where they begin and how large they are over all partitions
    begin: dict[int, int] = {}
    whole: dict[int, int] = {}
    before, rows, table = 0, 0, []
    for p in parts:
        for end, at in ((p["low"], before), (p["high"], before + p["size"] - p["high"]["size"])):
            begin.setdefault(end["h"], at)
        for h, size in {p["low"]["h"]: p["low"]["size"], p["high"]["h"]: p["high"]["size"]}.items():
            whole[h] = whole.get(h, 0) + size
        table.append((p["part"], before, rows, p["low"]["h"], p["high"]["h"]))
        before, rows = before + p["size"], rows + p["rows"]
    table = [(*t, begin[t[3]], whole[t[3]], begin[t[4]], whole[t[4]]) for t in table]
    ends = spark.createDataFrame(table, "part int, bytes_before long, rows_before long, low long, high long, low_at long, low_size long, high_at long, high_size long")

    order = Window.partitionBy("part").orderBy("h", "doc_id", "size")
    d = d.withColumn("to", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("row", F.row_number().over(order))
    own = Window.partitionBy("part", "h")
    d = d.withColumn("g_at", F.min(F.col("to") - F.col("size")).over(own)).withColumn("g_size", F.sum("size").over(own)).join(F.broadcast(ends), "part")  # one row a partition
    at_low, at_high = F.col("h") == F.col("low"), F.col("h") == F.col("high")
    g_at = F.when(at_low, F.col("low_at")).when(at_high, F.col("high_at")).otherwise(F.col("g_at") + F.col("bytes_before"))
    g_size = F.when(at_low, F.col("low_size")).when(at_high, F.col("high_size")).otherwise(F.col("g_size"))
    middle2 = F.when(g_size <= top, 2 * g_at + g_size).otherwise(2 * (F.col("bytes_before") + F.col("to")) - F.col("size"))
    shard = F.least((middle2.cast("decimal(38,0)") * shards / F.lit(2 * max(total, 1)).cast("decimal(38,0)")).cast("int"), F.lit(shards - 1))
    d = d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), shard.alias("shard"), (F.col("rows_before") + F.col("row")).alias("row"))
    d = kept(d)
    first = d.groupBy("shard").agg(F.min("row").alias("first"))
    return d.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "law", "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
