"""Mixed image files: what can be read, and the segments of each by its own format's walk."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake import dims
from shutterlake.functions import binary
from shutterlake.sources import bundle, walk

READABLE = bundle.READABLE


def gate(length: Column) -> Column:
    """Error code of a file by its size; null if it may be read."""
    size = F.coalesce(length, F.lit(0))
    return F.when(size == 0, "empty-file").when(size < dims.LEAST_BYTES, "corrupt-container").when(size > dims.MOST_BYTES, "too-large")


def checked(files: DataFrame) -> DataFrame:
    """file_id, content, format, error, message: what can't be read says why; the first reason counts."""
    kind = binary.detect_format(F.col("content"))
    named = F.concat(F.upper(kind), F.lit(" is not supported. Convert it to PNG or JPEG first."))
    error = F.coalesce(gate(F.length("content")), F.when(~kind.isin(*READABLE), "unsupported-format"))
    said = F.coalesce(*(F.when(error == code, F.lit(words)) for code, words in dims.ERRORS.items()))
    message = F.when((error == "unsupported-format") & kind.isin("gif", "bmp"), named).otherwise(said)
    return files.select("file_id", "content", F.coalesce(kind, F.lit("unknown")).alias("format"), error.alias("error"), message.alias("message"))


def parts(files: DataFrame) -> DataFrame:
    """One row per segment of every readable file: file_id, format, ord, category, container, label, detail, offset, bytes, reason."""

    def run(content: bytes) -> Iterator[tuple]:
        form, _, error, _ = bundle.gated(content)
        try:
            for s in () if error else bundle.bundle_of(content, form).segments:
                yield form, *s.values()
        except bundle.BROKEN:
            return

    return walk.rows_of(files, run, "format string, category string, container string, label string, detail string, offset long, bytes long, reason string")
