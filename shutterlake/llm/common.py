"""Helpers shared by the operators: shared storage, text batches, shapes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only in a local session
    may it be unset; a temporary folder of this process then stands in.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="shutterlake-")
    return _own_dirs[app]


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    It cuts lineage the way ``checkpoint()`` does (a lost executor costs a
    re-read, not a recomputation), but as compressed columns. The files go when
    the application ends, or before by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at, files = _files(spark, path)
    files.deleteOnExit(at)
    found = spark.read.schema(df.schema).parquet(path)
    found._written_to = path
    return found


def discard(df: DataFrame) -> None:
    """Delete the files behind a result of ``materialize`` that nothing reads any more."""
    at, files = _files(df.sparkSession, df._written_to)
    files.delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that the operators read; a null text counts as empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session end at BATCH_BYTES, unless the session has a limit of its own.

    By Spark's default (10,000 rows or 64 MB) a task has tens of MB of texts several times over,
    in buffers of its JVM and in its Python worker. A text that is longer is a batch of its own.
    """
    spark.conf.set(BATCH_LIMIT, spark.conf.get(BATCH_LIMIT, f"{BATCH_BYTES}b"))


def crc_mod(col: Column, mod: int) -> Column:
    """crc32 of a column's text form, modulo ``mod``; a null id counts as empty."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod


def text_batches(
    batches: Iterable[pa.RecordBatch], max_bytes: int = 4 << 20
) -> Iterator[tuple[list, list]]:
    """(ids, texts) in slices of about ``max_bytes``, whole texts each; one slice at a time becomes Python objects."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        lo = size = 0
        for i, n in enumerate(pc.binary_length(texts).to_pylist()):
            size += n
            if size >= max_bytes:
                yield ids[lo : i + 1].to_pylist(), texts[lo : i + 1].to_pylist()
                lo, size = i + 1, 0
        if lo < len(texts):
            yield ids[lo:].to_pylist(), texts[lo:].to_pylist()


def group_starts(sizes: np.ndarray) -> np.ndarray:
    """Offsets of consecutive groups with these sizes."""
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
