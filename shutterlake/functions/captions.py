"""Image-generator captions and tags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(text: Column, *names: str) -> Column:
    """Value of the first ``--name value`` in a caption; null where there is none."""
    found = F.regexp_extract(text, rf"(?i)--(?:{'|'.join(names)})\s+([^\s-][^\s]*)", 1)
    return F.nullif(found, F.lit(""))


def caption(text: Column) -> Column:
    """Prompt, version, aspect and seed of a flagged caption; null where nothing names the tool.

    A single common flag proves nothing: the tool's name, or a version, aspect,
    niji or stylize flag is needed, in at most 4,000 characters.
    """
    named = text.rlike("(?i)midjourney")
    known = named | text.rlike(r"(?i)--(?:v|version|ar|aspect|niji|stylize)\b")
    parts = F.struct(
        F.trim(F.element_at(F.split(text, r"\s--"), 1)).alias("prompt"),
        flag(text, "v", "version").alias("version"),
        flag(text, "ar", "aspect").alias("aspect"),
        flag(text, "seed").alias("seed"),
        F.when(named, "confirmed").otherwise("likely").alias("confidence"),
    )
    return F.when(known & (F.length(text) <= 4000), parts)


def lora_names(text: Column) -> Column:
    """Names of inline ``<lora:name:weight>`` tags, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"<lora:([^:>]+)"), 1))
