"""Files that arrive in a folder, as a stream of sniffed rows.

The ``binaryFile`` source itself skips files of no bytes, so they give no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shutterlake.functions.binary import detect_format
from shutterlake.sources.container import gate

_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def sniffed(files: DataFrame) -> DataFrame:
    """file_id, bytes, format, error for rows of the ``binaryFile`` source, batch or stream."""
    error = gate(F.col("length"))
    return files.select(F.col("path").alias("file_id"), F.col("length").alias("bytes"), F.when(error.isNull(), detect_format(F.col("content"))).alias("format"), error.alias("error"))


def arrivals(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    return spark.readStream.format("binaryFile").schema(_SCHEMA).option("pathGlobFilter", glob).load(folder)


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, glob: str = "*") -> StreamingQuery:
    """Take what has arrived since the last run, exactly once, and stop."""
    rows = sniffed(arrivals(spark, folder, glob))
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
