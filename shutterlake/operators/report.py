"""What files say about themselves: one nested row per file, and what each removal switch would take out.

The walk of ``bundle`` sends every payload to its own reader in one task; the
summaries are column expressions over that row, so a report needs one scan and no
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake import dims
from shutterlake.functions import icc, labels, text, xmp
from shutterlake.operators import exif, generators
from shutterlake.sources import bundle, manifest, resources

SWITCHES = [c for c, _ in dims.CATEGORIES]


def switch(category: Column) -> Column:
    """The switch that a segment's category belongs to; null for structural parts."""
    return F.when(category == "structural", None).when(category.isin(*SWITCHES), category).otherwise("other")


def breakdown(parts: DataFrame) -> DataFrame:
    """(file_id, category, bytes, n): what each switch would take out of each file, from part rows."""
    return parts.withColumn("category", switch(F.col("category"))).where("category is not null").groupBy("file_id", "category").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))


def breakdown_of(segments: Column) -> Column:
    """{category: (bytes, n)} of a file's own array of segments; switches that find nothing are left out."""

    def tally(mine: Column) -> Column:
        return F.struct(F.aggregate(mine, F.lit(0).cast("long"), lambda a, s: a + s["bytes"]).alias("bytes"), F.size(mine).cast("long").alias("n"))

    def tallies(own: Column) -> Column:
        there = F.array_distinct(F.transform(own, lambda s: s["switch"]))
        names = F.filter(F.array(*map(F.lit, SWITCHES)), lambda n: F.array_contains(there, n))
        return F.map_from_entries(F.transform(names, lambda n: F.struct(n, tally(F.filter(own, lambda s: s["switch"] == n)))))

    # each segment's switch is looked up once, and only switches that are there are tallied
    return text.once(F.transform(segments, lambda s: F.struct(switch(s["category"]).alias("switch"), s["bytes"].alias("bytes"))), tallies)


def _c2pa(b: Column) -> Column:
    payloads, names = b["c2pa"], b["c2pa_labels"]
    claims = F.filter(F.transform(payloads, manifest.claim_generator), lambda g: g.isNotNull())
    size = F.aggregate(payloads, F.lit(0).cast("long"), lambda a, p: a + F.length(p))
    signed = F.exists(names, lambda n: F.lower(n).contains("signature"))
    return F.when(F.size(payloads) > 0, F.struct(F.coalesce(b["c2pa_location"], F.lit("Embedded manifest")).alias("location"), size.alias("bytes"), F.get(claims, F.lit(0)).alias("claim_generator"), names.alias("assertions"), signed.alias("has_signature")))


def _once(rows: DataFrame, **values: Column) -> DataFrame:
    """``rows`` with these values as columns, each computed once.

    The optimiser copies an expression into every field that is read of it, until plans
    no longer fit the driver; what a generator gives out is not copied, and needs no
    passage through Python.
    """
    one = F.struct(*(v.alias(n) for n, v in values.items()))
    return rows.select("*", F.explode(F.array(one)).alias("_one")).select(*rows.columns, "_one.*")


def inspect(files: DataFrame) -> DataFrame:
    """One row per row of (file_id, content): the report.

    file_id, format, file_size, container (geometry), megapixels, segments,
    metadata_bytes (of all parts with a switch), categories, exif and gps (of the first
    EXIF), icc (the first), iptc and xmp (all), c2pa, ai (findings of texts and of
    provenance, merged), warnings, lossless_supported and why not, error, message.
    A null, empty or unreadable file has an error and no report; ``file_id`` may repeat.
    """
    return of_bundles(bundle.bundles(files))


def of_bundles(rows: DataFrame, *also: str) -> DataFrame:
    """The reports of rows of ``bundle.bundles``; the columns ``also`` go along."""
    rows, b = rows.withColumnRenamed("original_size", "file_size"), F.col("bundle")
    words = F.when(F.size(b["packets"]) > 0, F.array_join(b["packets"], "\n"))
    rows = _once(
        _once(rows, _words=words),
        exif=exif.summary_of(b["camera"]),
        gps=exif.position_of(b["place"]),
        iptc=resources.caption_of(b["records"]),
        icc=F.when(b["icc"].isNotNull(), icc.summary(b["icc"])),
        c2pa=_c2pa(b),
        _xmp=xmp.summary(F.col("_words")),
        _tool=xmp.read(F.col("_words"), "xmp:CreatorTool"),
        _kind=xmp.read(F.col("_words"), "Iptc4xmpExt:DigitalSourceType"),
        _found=generators.with_values(b["ai"]),
        categories=breakdown_of(b["segments"]),
    )
    c2pa = F.col("c2pa")
    origin = F.when(c2pa.isNotNull(), c2pa["location"]).otherwise("XMP / software fields")
    signer = generators.by_provenance(origin, F.coalesce(c2pa["bytes"], F.lit(0)), c2pa["claim_generator"], F.col("_tool"), F.coalesce(F.col("exif")["software"], b["hint"]), F.col("_kind"), F.coalesce(c2pa["assertions"], F.array().cast("array<string>")))
    total = F.aggregate(F.map_values("categories"), F.lit(0).cast("long"), lambda a, v: a + v["bytes"])
    summary = F.struct(F.size(b["packets"]).cast("long").alias("packets"), b["xmp_bytes"].alias("bytes"), *(F.col("_xmp")[n].alias(n) for n in ("toolkit", "creator", "rights", "title", "description", "created", "document_id", "has_provenance")), F.length(b["extended_xmp"]).cast("long").alias("extended_bytes"))
    return rows.select(
        "file_id",
        *also,
        "format",
        "file_size",
        b["container"].alias("container"),
        labels.megapixels(b["container"]["width"], b["container"]["height"]).alias("megapixels"),
        b["segments"].alias("segments"),
        total.alias("metadata_bytes"),
        # a position is part of EXIF, so its switch is listed without bytes of its own
        F.when((F.col("gps")["tag_count"] > 0) & ~F.map_contains_key("categories", "gps"), F.map_concat("categories", F.create_map(F.lit("gps"), F.struct(F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("n"))))).otherwise(F.col("categories")).alias("categories"),
        "exif",
        "gps",
        "icc",
        "iptc",
        F.when(F.col("_words").isNotNull(), summary).alias("xmp"),
        "c2pa",
        text.once(signer, lambda s: generators.merged(F.col("_found"), s)).alias("ai"),
        b["warnings"].alias("warnings"),
        F.when(b.isNotNull(), b["blocked"].isNull()).alias("lossless_supported"),
        b["blocked"].alias("lossless_blocked"),
        F.coalesce("error", F.when(F.col("why").isNotNull(), "corrupt-container")).alias("error"),
        F.coalesce("message", F.concat(F.lit("The image structure could not be read: "), F.col("why"))).alias("message"),
    )


def detections(reports: DataFrame) -> DataFrame:
    """file_id, detections: what was found as an ordered list of (key, label, detail)."""
    one = lambda there, key, label, detail: F.when(there, F.struct(F.lit(key).alias("key"), label.alias("label"), detail.cast("string").alias("detail")))
    c, none = F.col, F.lit(None)
    first = F.get(c("ai"), F.lit(0))
    name = F.coalesce(*(F.when(first["generator"] == g, F.lit(said)) for g, said in generators.LABELS.items()))
    camera = F.concat_ws(" ", c("exif")["make"], c("exif")["model"])
    listed = F.array(
        one(c("gps").isNotNull(), "gps", F.lit("GPS"), c("gps")["coordinates"]),
        one(F.size("ai") > 0, "ai", name, F.substring(first["prompt"], 1, 90)),
        one(c("c2pa").isNotNull(), "c2pa", F.lit("C2PA"), c("c2pa")["claim_generator"]),
        one(c("exif").isNotNull(), "exif", F.lit("EXIF"), F.when(camera != "", camera).otherwise(F.concat(c("exif")["tag_count"].cast("string"), F.lit(" tags")))),
        one(c("xmp").isNotNull(), "xmp", F.lit("XMP"), none),
        one(c("iptc").isNotNull(), "iptc", F.lit("IPTC"), none),
        one(c("icc").isNotNull(), "icc", F.lit("ICC"), c("icc")["description"]),
    )
    return reports.select("file_id", F.filter(listed, lambda d: d.isNotNull()).alias("detections"))
