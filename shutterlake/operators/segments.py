"""Relational operators over segments: policy, tallies, first-of-label, relocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake import dims


def tally(segments: DataFrame, policy: DataFrame, size: str = "bytes") -> DataFrame:
    """Removed bytes and count per category, by the policy's switches (``dims.switched_off`` checks that there are nine at most)."""
    gone = segments.where(F.col("category").isin(*dims.switched_off(policy)))
    return gone.groupBy("category").agg(F.sum(size).alias("bytes"), F.count("*").alias("n"))


def kept(segments: DataFrame, policy: DataFrame) -> DataFrame:
    """The segments that stay; those without a category do."""
    return segments.where(~F.coalesce(F.col("category").isin(*dims.switched_off(policy)), F.lit(False)))


def largest_of(rows: DataFrame, label: list[str], size: Column, *ties: Column) -> DataFrame:
    """The largest row per label; ties go to the first in the given order."""
    order = Window.partitionBy(*label).orderBy(size.desc(), *ties)
    return rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def relocate(parts: DataFrame, file: str, size: Column, *order: Column) -> DataFrame:
    """``offset``: the sum of the sizes before, within a file."""
    before = Window.partitionBy(file).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)))


def queue(files: DataFrame, cap: int, *order: Column) -> DataFrame:
    """The first ``cap`` files by arrival, then one of each (name, size)."""
    first = Window.partitionBy("name", "size").orderBy(*order)
    return files.orderBy(*order).limit(cap).withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def dense_counts(rows: DataFrame, by: str, dimension: DataFrame) -> DataFrame:
    """A count for every value of a small dimension, zeros included."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    return dimension.join(counts, by, "left").select(by, F.coalesce("n", F.lit(0)).alias("n"))


def gone(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys that were there before and are not any more."""
    return before.select(*keys).subtract(after.select(*keys))


def breakdown(rows: DataFrame, by: str, category: Column, names: list[str], size: Column | None = None) -> DataFrame:
    """One column per category: its rows, or the sum of ``size``, zeros included."""
    one = lambda c: F.count(F.when(category == c, 1)) if size is None else F.coalesce(F.sum(F.when(category == c, size)), F.lit(0))
    return rows.groupBy(by).agg(*(one(c).alias(c) for c in names))


def removal_stats(before: DataFrame, after: DataFrame, size: str = "bytes") -> DataFrame:
    """(file_id, category, bytes, n, place): what each file lost, ``place`` from 1 for the most bytes (then by name); categories that lost nothing are left out."""
    signed = before.select("file_id", "category", F.col(size).alias("bytes"), F.lit(1).alias("n")).unionByName(after.select("file_id", "category", (-F.col(size)).alias("bytes"), F.lit(-1).alias("n")))
    return signed.groupBy("file_id", "category").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).where("bytes > 0 or n > 0").withColumn("place", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("bytes"), "category")))


def remaining(kept: DataFrame) -> DataFrame:
    """Of each file's (label, bytes, reason) the largest per label."""
    return largest_of(kept, ["file_id", "label"], F.col("bytes"), F.col("reason"))


def progress(files: DataFrame) -> DataFrame:
    """Share done and bytes removed over a queue of (status, progress, bytes_removed); 0 for an empty one."""
    ended = F.col("status").isin("done", "failed", "cancelled")
    share = F.when(ended, 1.0).when(F.col("status").isin("processing", "analyzing"), F.col("progress")).otherwise(0.0)
    return files.agg(F.coalesce(F.avg(share), F.lit(0.0)).alias("progress"), F.coalesce(F.sum("bytes_removed"), F.lit(0)).alias("bytes_removed"))


def chips(found: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first ``limit`` labels of each file, and how many more there are."""
    file = Window.partitionBy("file_id")
    ranked = found.withColumn("_rank", F.row_number().over(file.orderBy(*order))).withColumn("more", F.greatest(F.count("*").over(file) - limit, F.lit(0)))
    return ranked.where(F.col("_rank") <= limit).withColumnRenamed("_rank", "place")
