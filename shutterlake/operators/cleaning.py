"""Mixed image files cleaned each by its own format's rules, and held against what is really left.

Every step is row-local: one scan of the files, no shuffle of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions import text
from shutterlake.operators import report
from shutterlake.sources import bundle, rewrite, walk

KEPT = "Kept because its switch is off"


def clean(files: DataFrame, removed: frozenset[str]) -> DataFrame:
    """file_id, format, content, original_size, cleaned_size, bytes_removed, percent_reduction, removed, preserved, warnings, error, message.

    ``removed`` lists (category, bytes, n), the most bytes first; ``preserved`` what had
    to stay and why. Files that can't be read or written have no content and a reason;
    the others go on.
    """

    def run(content: bytes) -> Iterator[tuple]:
        form, size, error, message = bundle.gated(content)
        done, why = (None, None) if error else rewrite.rewritten(content, form, removed)
        yield form, size, error, message, done and done.content, *rewrite.as_row(done, why)

    done = walk.rows_of(files, run, f"{bundle.KEYS}, fresh binary, {rewrite.COLUMNS}")
    after = F.length("fresh").cast("long")
    less = F.when(after.isNotNull(), F.greatest(F.col("original_size") - after, F.lit(0)))
    percent = F.when(F.col("original_size") > 0, less * 100.0 / F.col("original_size")).otherwise(less * 1.0)
    return done.select(
        "file_id",
        "format",
        F.col("fresh").alias("content"),
        "original_size",
        after.alias("cleaned_size"),
        less.alias("bytes_removed"),
        percent.alias("percent_reduction"),
        largest_first(F.col("removed")).alias("removed"),
        "preserved",
        "warnings",
        F.coalesce("error", F.when(F.col("why").isNotNull(), "corrupt-container")).alias("error"),
        F.coalesce("message", "why").alias("message"),
    )


def largest_first(removed: Column) -> Column:
    """(category, bytes, n) by bytes, the first seen of equal ones first; categories that lost nothing are left out."""
    some = F.filter(removed, lambda r: (r["bytes"] > 0) | (r["n"] > 0))
    placed = F.transform(some, lambda r, i: F.struct((-r["bytes"]).alias("b"), i.alias("i"), r.alias("r")))
    return F.transform(F.array_sort(placed), lambda x: x["r"])


def remaining_of(preserved: Column, segments: Column) -> Column:
    """(label, bytes, reason) of what is still there, the largest of a label; of equal ones what had to stay comes first."""
    kept = F.transform(F.filter(segments, lambda s: s["category"] != "structural"), lambda s: F.struct(s["label"].alias("label"), s["bytes"].alias("bytes"), F.coalesce(s["reason"], F.lit(KEPT)).alias("reason")))
    every = F.transform(F.concat(preserved, kept), lambda x, i: F.struct((-x["bytes"]).alias("b"), i.alias("i"), x.alias("x")))

    def best(all_: Column) -> Column:
        labels = F.array_distinct(F.transform(all_, lambda e: e["x"]["label"]))
        return F.transform(labels, lambda label: F.array_min(F.filter(all_, lambda e: e["x"]["label"] == label))["x"])

    return text.once(every, best)


def verified(files: DataFrame, removed: frozenset[str]) -> DataFrame:
    """Each file cleaned, and the output read again, in one row: what it says is proven.

    The columns of ``clean`` without the bytes, with: before and after (segments of the
    file and of the output), remaining (label, bytes, reason), and in ``warnings`` that
    a written file could not be read again; such a file has no segments after.
    """

    def run(content: bytes) -> Iterator[tuple]:
        form, size, error, message = bundle.gated(content)
        done, why = (None, None) if error else rewrite.rewritten(content, form, removed)
        before = after = None
        if done:
            before, _ = bundle.as_struct(content, form)
            after, broken = bundle.as_struct(done.content, form)
            if after is None:
                done.warnings.append(f"The cleaned file could not be re-inspected ({broken})")
        seen = ((x or {}).get("segments", []) for x in (before, after))
        yield form, size, error, message, done and len(done.content), *seen, *rewrite.as_row(done, why)

    rows = walk.rows_of(files, run, f"{bundle.KEYS}, cleaned_size long, before array<{bundle.SEGMENT}>, after array<{bundle.SEGMENT}>, {rewrite.COLUMNS}")
    return rows.select(
        "file_id",
        "format",
        "original_size",
        "cleaned_size",
        F.when(F.col("cleaned_size").isNotNull(), F.greatest(F.col("original_size") - F.col("cleaned_size"), F.lit(0))).alias("bytes_removed"),
        largest_first(F.col("removed")).alias("removed"),
        "before",
        "after",
        F.when(F.col("cleaned_size").isNotNull(), remaining_of(F.col("preserved"), F.col("after"))).alias("remaining"),
        "warnings",
        F.coalesce("error", F.when(F.col("why").isNotNull(), "corrupt-container")).alias("error"),
        F.coalesce("message", "why").alias("message"),
    )


def read_again(files: DataFrame, removed: frozenset[str], keys: str = "file_id string") -> DataFrame:
    """``keys``, content and bytes_removed as of ``clean``, and of that content a row of ``bundle.bundles``, for ``report.of_bundles``.

    A file is read again by the task that cleaned it, so its report need not be joined to
    it. Spark takes rows of files to be as small as the table's that they were made of:
    a join would send large ones to the driver.
    """

    def run(content: bytes) -> Iterator[tuple]:
        form, size, error, _ = bundle.gated(content)
        done, _ = (None, None) if error else rewrite.rewritten(content, form, removed)
        fresh = done and done.content
        yield fresh, None if fresh is None else max(size - len(fresh), 0), *bundle.as_row(fresh or b"")

    return walk.rows_of(files, run, f"fresh binary, bytes_removed long, {bundle.ROW}", keys).drop("ord").withColumnRenamed("fresh", "content")


def by_category(rows: DataFrame) -> DataFrame:
    """file_id, category, bytes and n before and after, of rows of ``verified``; a switch that finds nothing has no row."""
    seen = lambda c: report.breakdown_of(F.col(c))
    names = F.array(*(F.lit(n) for n in report.SWITCHES))
    told = rows.select("file_id", seen("before").alias("_b"), seen("after").alias("_a")).select("*", F.explode(names).alias("category"))
    of = lambda c, part: F.coalesce(F.col(c)[F.col("category")][part], F.lit(0))
    flat = told.select("file_id", "category", of("_b", "bytes").alias("bytes_before"), of("_a", "bytes").alias("bytes_after"), of("_b", "n").alias("n_before"), of("_a", "n").alias("n_after"))
    return flat.where("n_before > 0 or n_after > 0")
