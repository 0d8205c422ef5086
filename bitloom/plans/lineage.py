"""Cutting lineage: intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset, a session on one machine gets an own
    temporary folder; a cluster must name a folder that its machines share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="bitloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; what is written there goes when Python ends."""
    path = f"{shared_folder(spark)}/bitloom-{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    _written.pop(path, None)
    _delete(path, spark)


def kept(df: DataFrame) -> DataFrame:
    """The rows of df, written once: later stages, and stages run again after a loss, read the files."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/bitloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with name (long), the number of each row in the order, from 0: ranges of the order are sorted
    apart, and what is summed over them is one row a range. Rows that are equal in it come in any order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)))
    d = kept(df.withColumn("_order", keys).repartitionByRange(n, "_order").withColumn("_part", F.spark_partition_id()))
    sums = d.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.join(F.broadcast(sums.drop("count")), "_part")  # a row a range
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_order"))
    return d.withColumn(name, (F.col("_before") + own - 1).cast("long")).drop("_order", "_part", "_before")


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables from kept() that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_kept_at", None):
            _delete(path, _written.pop(path, t.sparkSession))


@contextlib.contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """Deletes at its end what kept() wrote inside, but for the tables put into the list."""
    before, stay = set(_written), []
    yield stay
    stays = {getattr(t, "_kept_at", None) for t in stay}
    for path in [p for p in _written if p not in before and p not in stays]:
        _delete(path, _written.pop(path))


def _delete(path: str, spark: SparkSession) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clear() -> None:
    for path, spark in _written.items():
        _delete(path, spark)
