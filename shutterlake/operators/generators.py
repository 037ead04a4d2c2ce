"""Image generators behind metadata texts, and findings merged with what provenance says."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from shutterlake.functions import detect as detector
from shutterlake.functions import signals

SHAPE, FIELDS = detector.SHAPE, detector.FIELDS
FINDING = StructType([StructField(n, StringType()) for n in SHAPE[:-2]] + [StructField(n, ArrayType(StringType())) for n in SHAPE[-2:]])


def said(v: Column, *paths: str) -> Column:
    """The first scalar at these paths of a variant as text; objects, arrays and blanks do not count."""
    value = lambda p: F.try_variant_get(v, "$." + p, "variant")
    one = lambda p: F.when(~F.schema_of_variant(value(p)).rlike("^(OBJECT|ARRAY|VOID)"), F.nullif(F.trim(F.try_variant_get(v, "$." + p, "string")), F.lit("")))
    return F.coalesce(*map(one, paths))


def detect(sources: DataFrame) -> DataFrame:
    """(file_id, ord, bytes, finding) for the (file_id, ord, key, text, bytes) that some reader knows.

    Each text is read once: a filter on what a function found would call it again.
    """
    rows = sources.select("file_id", "ord", "bytes", "key", "text")
    shape = StructType([*rows.schema.fields[:3], StructField("finding", FINDING)])
    form = to_arrow_type(FINDING)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [detector.detect(t, k) for t, k in zip(batch.column("text").to_pylist(), batch.column("key").to_pylist(), strict=True)]
            known = batch.select(["file_id", "ord", "bytes"]).filter(pa.array([f is not None for f in found], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*known.columns, pa.array([f for f in found if f is not None], form)], names=["file_id", "ord", "bytes", "finding"])

    return rows.mapInArrow(run, shape)


def findings(sources: DataFrame) -> DataFrame:
    """One row per (file, generator, prompt, seed) with its bytes; named generators suppress the unnamed one."""
    # a file's findings meet in one shuffle, for the grouping and for the window
    rows = detect(sources).select("file_id", "ord", "bytes", "finding", "finding.generator", "finding.prompt", "finding.seed").repartition("file_id")
    once = rows.groupBy("file_id", "generator", "prompt", "seed").agg(F.min_by("finding", "ord").alias("finding"), F.sum("bytes").alias("bytes"), F.min("ord").alias("ord"))
    named = F.max(F.col("generator") != "generic").over(Window.partitionBy("file_id"))
    return once.withColumn("_named", named).where("generator <> 'generic' or not _named").select("file_id", "ord", "bytes", "finding.*")


#: What the fields of a finding are called in its list of values.
CALLED = {"seed": "Seed", "steps": "Steps", "cfg": "CFG scale", "sampler": "Sampler", "scheduler": "Scheduler", "model": "Model", "checkpoint": "Checkpoint", "vae": "VAE", "clip_skip": "Clip skip", "size": "Size", "version": "Version"}
#: Names of the generators for display.
LABELS = {"automatic1111": "Automatic1111 / WebUI", "stable-diffusion": "Stable Diffusion", "comfyui": "ComfyUI", "fooocus": "Fooocus", "invokeai": "InvokeAI", "novelai": "NovelAI", "flux": "Flux", "midjourney": "Midjourney", "adobe-firefly": "Adobe Firefly", "openai": "OpenAI Images", "google-imagen": "Google Imagen", "generic": "Unidentified generator"}


def _values(pairs: list[tuple[str, Column]]) -> Column:
    """A map of the values that are there."""
    listed = F.map_from_arrays(F.array(*(F.lit(n) for n, _ in pairs)), F.array(*(F.nullif(F.trim(v), F.lit("")) for _, v in pairs)))
    return F.map_filter(listed, lambda k, v: v.isNotNull())


def by_provenance(source: Column, size: Column, claim: Column, tool: Column, software: Column, source_type: Column, names: Column) -> Column:
    """A finding from what signed or wrote a file; null where nothing names or declares a generator."""
    p = signals.by_provenance(source_type, claim, tool, software, F.array_join(names, " "))
    values = _values([("Claim generator", claim), ("Creator tool", tool), ("Software", software), ("Digital source type", source_type), ("Assertions", F.array_join(names, ", "))])
    none = F.array().cast("array<string>")
    own = {n: F.lit(None).cast("string") for n in FIELDS} | {"generator": p["generator"], "confidence": p["confidence"], "model": F.nullif(F.trim(claim), F.lit("")), "loras": none, "control_nets": none}
    return F.when(p.isNotNull(), F.struct(source.alias("source"), size.cast("long").alias("bytes"), *(own[n].alias(n) for n in SHAPE), values.alias("fields")))


def with_values(found: Column) -> Column:
    """Findings, each with a map of its values by name."""
    return F.transform(found, lambda f: F.struct(*(f[n].alias(n) for n in ("source", "bytes", *SHAPE)), _values([(name, f[n]) for n, name in CALLED.items()]).alias("fields")))


def merged(found: Column, provenance: Column) -> Column:
    """Findings (with values) and the one from provenance: one of its generator takes the values that it lacks and at most its confidence, else it is added.

    Values that are there already stay. Both should be columns of their own, since they
    are used more than once.
    """
    first = F.array_position(F.transform(found, lambda f: f["generator"]), provenance["generator"])
    lacking = lambda f: F.map_filter(provenance["fields"], lambda k, v: ~F.map_contains_key(f["fields"], k))
    sure = lambda f: F.when(provenance["confidence"] == "confirmed", F.lit("confirmed")).otherwise(f["confidence"])
    richer = lambda f: f.withField("fields", F.map_concat(lacking(f), f["fields"])).withField("confidence", sure(f))
    joined = F.transform(found, lambda f, i: F.when(i + 1 == first, richer(f)).otherwise(f))
    return F.when(provenance.isNull(), found).when(first > 0, joined).otherwise(F.concat(found, F.array(provenance)))
