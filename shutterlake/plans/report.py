"""Registered queries over mixed files built from the tables: dispatch, reports, cleaning and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake import dims
from shutterlake.functions import text
from shutterlake.operators import cleaning, report, segments
from shutterlake.plans.catalog import dealt, query, read
from shutterlake.plans.media import _big, _bytes, _files, _hex, _key
from shutterlake.sources import container, heif, heif_write, jpeg, png, png_encode


def _chunk(kind: bytes, data: Column) -> Column:
    return text.once(data.cast("binary"), lambda d: _bytes(_big(F.octet_length(d)), kind, d, _big(F.crc32(_bytes(kind, d)))))


def _little(n: Column) -> Column:
    return F.concat(*(F.unhex(F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(255)), 2, "0")) for k in range(4)))


def _riff(kind: bytes, data: Column) -> Column:
    return text.once(data.cast("binary"), lambda d: _bytes(kind, _little(F.octet_length(d)), d, F.when(F.octet_length(d) % 2 == 1, F.lit(b"\0")).otherwise(F.lit(b""))))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part: a JPEG with a comment, a PNG with a text, a WebP with EXIF, or a GIF, by its key."""
    name, kind, size = F.col("p_name"), F.col("p_type"), F.col("p_size")
    jpg = _bytes(_hex("FFD8FFE000104A46494600010100000100010000"), jpeg.segment(F.lit(jpeg.COM), name.cast("binary")), _hex("FFC0000B080040003001011100FFDA00021234FF005678FFD9"))
    # bodies are columns of their own, since lengths and checksums read them again
    rows = dealt(spark, sf_dir, "part", "p_partkey").select("*", _bytes(_big(size), _big(size + 1), b"\x08\x06\0\0\0").alias("_ihdr"), _bytes(b"parameters\0", name).alias("_words"), _bytes(b"Title\0", kind).alias("_title"), F.substring(_little(size), 1, 3).alias("_w"), F.substring(_little(size + 1), 1, 3).alias("_h"))
    rows = rows.select("*", _chunk(b"IHDR", F.col("_ihdr")).alias("_c1"), _chunk(b"tEXt", F.col("_words")).alias("_c2"), _chunk(b"tEXt", F.col("_title")).alias("_c3"), _chunk(b"IEND", F.lit("").cast("binary")).alias("_c4"), _riff(b"VP8X", _bytes(b"\x08\0\0\0", F.col("_w"), F.col("_h"))).alias("_r1"), _riff(b"VP8L", name.cast("binary")).alias("_r2"), _riff(b"EXIF", kind.cast("binary")).alias("_r3"))
    rows = rows.withColumn("_body", _bytes(b"WEBP", F.col("_r1"), F.col("_r2"), F.col("_r3")))
    pic, web = _bytes(png.SIGNATURE, *(F.col(f"_c{i}") for i in range(1, 5))), _bytes(b"RIFF", _little(F.octet_length("_body")), F.col("_body"))
    pick = F.col("p_partkey") % 4
    content = F.when(pick == 0, jpg).when(pick == 1, pic).when(pick == 2, web).otherwise(_bytes(b"GIF89a", name, bytes(12)))
    return _files(rows, "p_partkey", content)


_TEXT = "strlen(p_name) + 11 + 12"
_COMMENT = "strlen(p_name) + 4"
_EXIF = "8 + strlen(p_type) + strlen(p_type) % 2"


@query("SELECT CASE p_partkey % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' ELSE 'gif' END AS format, CASE WHEN p_partkey % 4 = 3 THEN 'unsupported-format' END AS error, count(*) AS n FROM part GROUP BY ALL")
def container_dispatch(spark, sf_dir):
    return container.checked(_mixed(spark, sf_dir)).groupBy("format", "error").agg(F.count("*").alias("n"))


@query(f"SELECT p_partkey, unnest(CASE p_partkey % 4 WHEN 0 THEN ['comment'] WHEN 1 THEN ['ai', 'comment'] ELSE ['exif'] END) AS category, unnest(CASE p_partkey % 4 WHEN 0 THEN [{_COMMENT}] WHEN 1 THEN [{_TEXT}, strlen(p_type) + 6 + 12] ELSE [{_EXIF}] END) AS bytes FROM part WHERE p_partkey % 4 < 3")
def category_breakdown(spark, sf_dir):
    return _key(report.breakdown(container.parts(_mixed(spark, sf_dir))).select("file_id", "category", "bytes"), "p_partkey")


# bytes before and after: what stands around the texts, then the texts
_JPEG = "20 + 25 + strlen(p_name) + 4"
_PNG = f"8 + 25 + ({_TEXT}) + (strlen(p_type) + 6 + 12) + 12"
_WEBP = f"12 + 18 + (8 + strlen(p_name) + strlen(p_name) % 2) + ({_EXIF})"


@query(f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' ELSE 'gif' END AS format, CASE p_partkey % 4 WHEN 0 THEN {_JPEG} WHEN 1 THEN {_PNG} WHEN 2 THEN {_WEBP} ELSE 18 + strlen(p_name) END AS original_size, CASE p_partkey % 4 WHEN 0 THEN {_COMMENT} WHEN 1 THEN {_TEXT} + strlen(p_type) + 6 + 12 WHEN 2 THEN {_EXIF} ELSE 0 END AS bytes_removed, CASE WHEN p_partkey % 4 = 3 THEN 'unsupported-format' END AS error FROM part")
def cleaned_files(spark, sf_dir):
    done = cleaning.clean(_mixed(spark, sf_dir), dims.removed())
    # files that were not written removed nothing; `error` tells them apart
    return _key(done.select("file_id", "format", "original_size", F.coalesce("bytes_removed", F.lit(0)).alias("bytes_removed"), "error"), "p_partkey")


@query(f"SELECT p_partkey, unnest(CASE p_partkey % 4 WHEN 0 THEN ['comment'] WHEN 1 THEN ['ai', 'comment'] ELSE ['exif'] END) AS category, unnest(CASE p_partkey % 4 WHEN 0 THEN [{_COMMENT}] WHEN 1 THEN [{_TEXT}, strlen(p_type) + 6 + 12] ELSE [{_EXIF}] END) AS bytes_before, unnest(CASE p_partkey % 4 WHEN 0 THEN [{_COMMENT}] WHEN 1 THEN [0, strlen(p_type) + 6 + 12] ELSE [0] END) AS bytes_after FROM part WHERE p_partkey % 4 < 3")
def verified_files(spark, sf_dir):
    rows = cleaning.by_category(cleaning.verified(_mixed(spark, sf_dir), frozenset(["exif", "ai"])))
    return _key(rows.select("file_id", "category", "bytes_before", "bytes_after"), "p_partkey")


def _box(kind: bytes, *parts: Column | bytes) -> Column:
    return text.once(_bytes(*parts), lambda body: _bytes(_big(F.octet_length(body) + 8), kind, body))


def _avif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part: a picture item of its name behind an EXIF item of its type."""
    name, tags = F.col("p_name"), _bytes(bytes(4), F.col("p_type"))
    start = 24 + 130 + 8
    place = lambda item, at, data: _bytes(_big(item, 2), bytes(4), _big(1, 2), _big(at), _big(F.octet_length(data)))
    iloc = _box(b"iloc", b"\1\0\0\0\x44\0", _big(2, 2), place(1, F.lit(start) + F.octet_length(tags), name), place(2, start, tags))
    entry = lambda item, kind: _box(b"infe", b"\2\0\0\0", _big(item, 2), bytes(2), kind, bytes(1))
    meta = _box(b"meta", bytes(4), _box(b"pitm", bytes(4), _big(1, 2)), iloc, _box(b"iinf", bytes(4), _big(2, 2), entry(1, b"av01"), entry(2, b"Exif")))
    content = _bytes(_box(b"ftyp", b"avif", bytes(4), b"avifmif1"), meta, _box(b"mdat", tags, name))
    return _files(dealt(spark, sf_dir, "part", "p_partkey"), "p_partkey", content)


@query("SELECT p_partkey, 162 + strlen(p_name) + 4 + strlen(p_type) AS original_size, 125 + strlen(p_name) AS cleaned_size, 'exif' AS lost, 4 + strlen(p_type) + 21 AS lost_bytes, p_name AS picture, 1 AS items FROM part")
def avif_cleaned(spark, sf_dir):
    files = _avif(spark, sf_dir)
    # written files are read again: the picture by its new place
    fresh = heif_write.clean(files, dims.removed())
    place = heif.items(fresh.select("file_id", "content")).groupBy("file_id").agg(F.count("*").alias("items"), F.min_by(F.col("extents")[0], F.when(F.col("is_primary"), F.col("ord"))).alias("at"))
    sizes = files.select("file_id", F.length("content").alias("original_size"))
    seen = F.substring("content", F.col("at.offset").cast("int") + 1, F.col("at.length").cast("int")).cast("string")
    rows = fresh.join(place, "file_id").join(sizes, "file_id")
    return _key(rows.select("file_id", "original_size", F.length("content").alias("cleaned_size"), F.col("lost")[0]["category"].alias("lost"), F.col("lost")[0]["bytes"].alias("lost_bytes"), seen.alias("picture"), "items"), "p_partkey")


_LOST = "SELECT user_id AS file_id, event_type AS category, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS bytes, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) DESC, event_type) AS place FROM events WHERE value > 50 GROUP BY user_id, event_type HAVING n > 0"


def _losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), F.col("event_type").alias("category"), F.floor(F.col("value") * 100).cast("long").alias("bytes"), "value")


@query(_LOST)
def removal_stats(spark, sf_dir):
    rows = _losses(spark, sf_dir)
    return segments.removal_stats(rows, rows.where("value <= 50"))


@query("SELECT user_id AS file_id, event_type AS label, CAST(max(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS bytes FROM events GROUP BY 1, 2")
def remaining_labels(spark, sf_dir):
    rows = _losses(spark, sf_dir).withColumnRenamed("category", "label").withColumn("reason", F.lit("kept"))
    return segments.remaining(rows).select("file_id", "label", "bytes")


@query("SELECT avg(CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'P' THEN 0.5 ELSE 0.0 END) AS progress, CAST(sum(o_custkey) AS BIGINT) AS bytes_removed FROM orders")
def queue_progress(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "processing").otherwise("queued")
    files = read(spark, sf_dir, "orders").select(status.alias("status"), F.lit(0.5).alias("progress"), F.col("o_custkey").alias("bytes_removed"))
    return segments.progress(files)


@query("SELECT o_custkey AS file_id, o_orderpriority AS label, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, greatest(count(*) OVER (PARTITION BY o_custkey) - 4, 0) AS more FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 4")
def first_chips(spark, sf_dir):
    found = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderpriority").alias("label"), "o_orderkey")
    return segments.chips(found, 4, F.col("o_orderkey")).select("file_id", "label", "place", "more")


@query("SELECT p_partkey, CASE WHEN p_size > 20 THEN 20 ELSE p_size END AS width, CASE WHEN p_size > 20 THEN CAST(greatest(1, floor(5 * (20.0 / p_size) + 0.5)) AS BIGINT) ELSE 5 END AS height, CASE WHEN p_partkey % 9 < 3 THEN ['jpeg', 'png', 'webp'][1 + p_partkey % 9] ELSE 'png' END AS format, p_partkey % 9 >= 3 AS substituted FROM part")
def rebuild_targets(spark, sf_dir):
    source = F.element_at(F.array(*(F.lit(f) for f, _, _ in dims.FORMATS)), (F.col("p_partkey") % 9 + 1).cast("int"))
    size = png_encode.target_size(F.col("p_size"), F.lit(5), 20)
    return read(spark, sf_dir, "part").select("p_partkey", size.alias("size"), png_encode.target_format(F.lit("original"), source).alias("to")).select("p_partkey", "size.*", "to.*")


_PIXELS = "substr(repeat(p_name || '    ', p_size * 2), 1, p_size * 8)"


@query(f"SELECT p_partkey, CAST(p_size AS BIGINT) AS width, CAST(2 AS BIGINT) AS height, p_partkey % 2 = 0 AS has_alpha, md5(CASE WHEN p_partkey % 2 = 0 THEN {_PIXELS} ELSE regexp_replace({_PIXELS}, '(?s)(...).', '\\1', 'g') END) AS pixels_md5 FROM part")
def png_encoded(spark, sf_dir):
    # pixels repeat the part's name; the written file is walked again and its pixels are read back
    pixels = F.substring(F.repeat(F.concat("p_name", F.lit("    ")), F.col("p_size") * 2), F.lit(1), F.col("p_size") * 8).cast("binary")
    pictures = dealt(spark, sf_dir, "part", "p_partkey").select(F.col("p_partkey").cast("string").alias("file_id"), pixels.alias("pixels"), F.col("p_size").alias("width"), F.lit(2).alias("height"), (F.col("p_partkey") % 2 == 0).alias("alpha"))
    written = png_encode.encode(pictures)
    heads = png.headers(png.chunks(written)).select("file_id", "width", "height", "has_alpha")
    return _key(heads.join(png_encode.decode(written).select("file_id", F.md5("pixels").alias("pixels_md5")), "file_id"), "p_partkey")
