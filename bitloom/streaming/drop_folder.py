"""Translation memories that are dropped into a folder, as a stream of units.

Every file is read once (the stream's checkpoint keeps the list); one that can't be parsed gives a row
with its error. Units have no file order, as files come in when they come in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from bitloom.schema import UNIT
from bitloom.sources.files import UNITS, WARNING, parsed


def units(spark: SparkSession, folder: str, files_a_batch: int = 1000, **options) -> DataFrame:
    """(path, error, unit columns) of the memories in the folder, those to come included."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = files.option("pathGlobFilter", "*.{" + ",".join(UNITS) + "}").option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", "true").load(folder)
    return parsed(files, UNITS, UNIT, "unit_ord", options, "report").drop(WARNING, "place")


def first_seen(stream: DataFrame) -> DataFrame:
    """Units that no earlier file had; the state holds one key a distinct unit, on the executors."""
    return stream.filter("error is null").dropDuplicates(["src_lang", "tgt_lang", "src_text", "tgt_text"])


def write(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends to a Parquet folder; once: what is there now, else until stopped. The checkpoint lies in a
    folder that all machines share; after a failure the query goes on from it, each row written once."""
    out = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
