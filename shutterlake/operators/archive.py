"""Stored ZIP archives of cleaned files as parts with places, so that no archive is one task's group.

A file's local part can be made where the file is, once its place is known; places
are running sums of sizes in the order of names, taken in two steps: within buckets
of an archive (ranges of names), and over the buckets' totals. The directory at the end is made of one small row for
each file in the same way. ``save`` streams parts into files.
"""

from __future__ import annotations

import os
import struct
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

#: Files of an archive whose places are summed by one task.
BUCKET_FILES = 100_000
#: Names that are looked at for each bucket's bounds.
_LOOKED = 32
_WIDE = 0xFFFFFFFF
#: Bytes of a local header, a directory entry and the end record without names; a day that all entries have.
_LOCAL, _ENTRY, _END, _DAY = 30, 46, 22, (1980 - 1980) << 9 | 1 << 5 | 1


def unique_names(files: DataFrame, group: str, name: str, *order: str) -> DataFrame:
    """The second and later file of a name gets `` (2)``, `` (3)`` before its extension."""
    rank = F.row_number().over(Window.partitionBy(group, name).orderBy(*order))
    dotted = F.regexp_replace(name, r"^(.*?)(\.[^.]*)?$", "$1")
    tail = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return files.withColumn("_n", rank).withColumn(name, F.when(F.col("_n") > 1, F.concat(dotted, F.lit(" ("), F.col("_n").cast("string"), F.lit(")"), tail)).otherwise(F.col(name))).drop("_n")


def batches(files: DataFrame, most_bytes: int, *order: str) -> DataFrame:
    """``batch``: files by name hash, so that archives stay near a size."""
    total = files.agg(F.sum(F.length("content"))).first()[0] or 0
    return files.withColumn("batch", F.pmod(F.xxhash64(*order), F.lit(total // most_bytes + 1)))


def running(rows: DataFrame, group: str, size: str, out: str, *order: str) -> DataFrame:
    """``out``: the sum of the sizes before, over (bucket, order) of a group, as two sums of bounded groups."""
    inside = Window.partitionBy(group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(group, "_bucket").agg(F.sum(size).alias("_total"))
    base = F.sum("_total").over(Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select(group, "_bucket", F.coalesce(base, F.lit(0)).alias("_base"))
    return rows.withColumn("_own", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(starts, [group, "_bucket"]).withColumn(out, F.col("_own") + F.col("_base")).drop("_own", "_base")


def _bounds(files: DataFrame, group: str, name: str, bucket_files: int) -> dict[str | None, list[str]]:
    """Names that cut the larger groups into buckets of about so many files; a name for each bucket comes to the driver.

    They are ranks in a sample by the names' hashes, so they are the same at each call.
    """
    step = max(1, bucket_files // _LOOKED)
    seen = files.where(F.pmod(F.xxhash64(name), F.lit(step)) == 0).groupBy(F.col(group).cast("string").alias("g")).agg(F.sort_array(F.collect_list(name)).alias("names"))
    each = max(1, bucket_files // step)
    cut = seen.where(F.size("names") > each).select("g", F.transform(F.sequence(F.lit(each), F.size("names") - 1, F.lit(each)), lambda i: F.get(F.col("names"), i)).alias("names"))
    return {r["g"]: r["names"] for r in cut.collect()}


def _bucket(bounds: dict[str | None, list[str]]):
    """The number of bounds up to a name; names are held by code points, which is the order of their bytes."""

    @F.pandas_udf(LongType())
    def found(group: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds.get(g, ()), n or "") for g, n in zip(group, name, strict=True)], index=name.index, dtype="int64")

    return found


@F.pandas_udf(BinaryType())
def _local_part(name: pd.Series, content: pd.Series, crc: pd.Series) -> pd.Series:
    def one(n: str, c: bytes, k: int) -> bytes:
        raw = n.encode("utf-8", "replace")
        return b"PK\3\4" + struct.pack("<5H3I2H", 20, 0x800, 0, 0, _DAY, k, len(c), len(c), len(raw), 0) + raw + c

    return pd.Series([one(*x) for x in zip(name, content, crc, strict=True)])


@F.pandas_udf(BinaryType())
def _directory_entry(name: pd.Series, size: pd.Series, crc: pd.Series, at: pd.Series) -> pd.Series:
    def one(n: str, s: int, k: int, a: int) -> bytes:
        raw, far = n.encode("utf-8", "replace"), a >= _WIDE
        extra = struct.pack("<HHQ", 1, 8, a) if far else b""
        return b"PK\1\2" + struct.pack("<6H3I5H2I", 45, 45 if far else 20, 0x800, 0, 0, _DAY, k, s, s, len(raw), len(extra), 0, 0, 0, 0, _WIDE if far else a) + raw + extra

    return pd.Series([one(*x) for x in zip(name, size, crc, at, strict=True)])


@F.pandas_udf(BinaryType())
def _end_record(n: pd.Series, start: pd.Series, size: pd.Series) -> pd.Series:
    def one(n: int, at: int, s: int) -> bytes:
        wide = b""
        if n > 0xFFFE or at >= _WIDE or s >= _WIDE:
            wide = b"PK\6\6" + struct.pack("<Q2H2I4Q", 44, 45, 45, 0, 0, n, n, s, at) + b"PK\6\7" + struct.pack("<IQI", 0, at + s, 1)
        return wide + b"PK\5\6" + struct.pack("<4H2IH", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(s, _WIDE), min(at, _WIDE), 0)

    return pd.Series([one(*x) for x in zip(n, start, size, strict=True)])


def parts(files: DataFrame, group: str, name: str = "name", bucket_files: int = BUCKET_FILES) -> DataFrame:
    """(group, at, data): joined by ``at``, the rows of a group are its archive, without compression since pictures do not shrink.

    Names are taken to differ within a group (``unique_names``), files to be under 4 GiB;
    a null content is an empty file. Within an archive files stand by name, however many
buckets it takes.
    """
    most = files.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    content = F.coalesce(F.col("content"), F.lit(b""))
    own = files.select(group, F.col(name).alias("_name"), content.alias("_content"))
    # a group of no more files than a bucket takes has one, and nothing is looked at
    bounds = _bounds(own, group, "_name", bucket_files) if most > bucket_files else {}
    number = _bucket(bounds)(F.col(group).cast("string"), F.col("_name")) if bounds else F.lit(0).cast("long")
    sizes = own.select(group, "_name", number.alias("_bucket"), F.length("_content").cast("long").alias("_size"), F.crc32("_content").alias("_crc"))
    sizes = sizes.withColumn("_part", F.col("_size") + _LOCAL + F.octet_length("_name"))
    placed = running(sizes, group, "_part", "_at", "_name")
    placed = placed.withColumn("_entry", F.octet_length("_name") + F.when(F.col("_at") >= _WIDE, _ENTRY + 12).otherwise(_ENTRY).cast("long"))
    listed = running(placed, group, "_entry", "_listed", "_name")
    whole = placed.groupBy(group).agg(F.count("*").alias("_n"), F.sum("_part").alias("_start"), F.sum("_entry").alias("_length"))
    local = own.join(placed.select(group, "_name", "_at", "_crc"), [group, "_name"]).select(group, F.col("_at").alias("at"), _local_part("_name", "_content", "_crc").alias("data"))
    entries = listed.join(whole, group).select(group, (F.col("_start") + F.col("_listed")).alias("at"), _directory_entry("_name", "_size", "_crc", "_at").alias("data"))
    ends = whole.select(group, (F.col("_start") + F.col("_length")).alias("at"), _end_record("_n", "_start", "_length").alias("data"))
    return local.unionByName(entries).unionByName(ends)


def save(archive_parts: DataFrame, group: str, folder: str) -> DataFrame:
    """(path, bytes) of the archives, one file for each group in a folder that every executor can open.

    A task streams the sorted parts of its groups, a batch of rows at a time; a file
    appears under its name when it is whole, so a task that is run again does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[str, int]] = []
        current, out, temporary = None, None, ""

        def close() -> None:
            if out is not None:
                size = out.tell()
                out.close()
                os.replace(temporary, f"{folder}/{current}.zip")
                done.append((f"{folder}/{current}.zip", size))

        for b in batches:
            for key, data in zip(b["_key"].to_pylist(), b["data"], strict=True):
                if key != current:
                    close()
                    current, temporary = key, f"{folder}/.{key}.{os.getpid()}.part"
                    out = open(temporary, "wb")
                out.write(data.as_py())
        close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "bytes"])

    keyed = archive_parts.select(F.col(group).cast("string").alias("_key"), "at", "data")
    return keyed.repartition("_key").sortWithinPartitions("_key", "at").select("_key", "data").mapInArrow(run, "path string, bytes long")


def downloads(files: DataFrame, group: str, archive: Column) -> DataFrame:
    """(group, n, name): what there is to fetch of each group's finished files: nothing, the file itself, or an archive.

    ``files`` has status, name, output_name and content; a file without an output counts as unfinished.
    """
    ready = (F.col("status") == "done") & F.col("content").isNotNull()
    first = F.first(F.when(ready, F.coalesce("output_name", "name")), ignorenulls=True)
    found = files.groupBy(group).agg(F.count(F.when(ready, 1)).alias("n"), first.alias("_one"))
    return found.select(group, "n", F.when(F.col("n") == 1, F.col("_one")).when(F.col("n") > 1, archive).alias("name"))
