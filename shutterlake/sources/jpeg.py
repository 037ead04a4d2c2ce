"""JPEG files as part rows, and back: every byte belongs to exactly one part."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions import binary, plain, signals, text, xmp
from shutterlake.sources import walk

#: Markers without a length, start of scan, end of image, comment.
STANDALONE = frozenset([0x01, *range(0xD0, 0xDA)])
SOS, EOI, COM, DRI = 0xDA, 0xD9, 0xFE, 0xDD
#: Application segments by marker and leading bytes.
APPLICATION = [
    (0xE0, b"JFIF\0", "structural", "JFIF header"),
    (0xE0, b"JFXX\0", "thumbnail", "JFIF extension thumbnail"),
    (0xE1, b"Exif\0\0", "exif", "EXIF"),
    (0xE1, b"http://ns.adobe.com/xap/1.0/\0", "xmp", "XMP"),
    (0xE1, b"http://ns.adobe.com/xmp/extension/\0", "xmp", "XMP (extended)"),
    (0xE2, b"ICC_PROFILE\0", "icc", "ICC colour profile"),
    (0xE2, b"MPF\0", "other", "Multi-picture format index"),
    (0xE2, b"FPXR\0", "other", "FlashPix data"),
    (0xEB, b"JP", "other", "JPEG universal box"),
    (0xED, b"Photoshop 3.0\0", "iptc", "Photoshop / IPTC resources"),
    (0xEE, b"Adobe", "other", "Adobe colour transform"),
]
_MARKER = re.compile(rb"\xff[\x01-\xfe]")
_AFTER_SCAN = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]")


def parts_of(content: bytes) -> Iterator[tuple[int | None, int, int, int, bytes]]:
    """(marker, offset, size, bytes before the payload, bytes); runs between segments have no marker.

    A segment that is cut or has no valid length ends the walk, and the rest is one run.
    """
    if content[:2] != b"\xff\xd8":
        return
    at, pattern = 0, _MARKER
    while found := pattern.search(content, at):
        marker, body = content[found.start() + 1], found.end()
        if marker not in STANDALONE:
            length = int.from_bytes(content[body : body + 2], "big")
            if length < 2 or body + length > len(content):
                break
        end, head = (body, body) if marker in STANDALONE else (body + length, body + 2)
        start = found.start()
        while start > at and content[start - 1] == 0xFF:  # fill bytes
            start -= 1
        if start > at:
            yield None, at, start - at, 0, content[at:start]
        yield marker, start, end - start, head - start, content[start:end]
        at, pattern = end, _AFTER_SCAN if marker == SOS else _MARKER
        if marker == EOI:
            break
    if at < len(content):
        yield None, at, len(content) - at, 0, content[at:]


def parts(files: DataFrame) -> DataFrame:
    """One row per part of each (file_id, content), with marker, category and label.

    ``category`` is null for runs of data; ``payload`` is what follows the length.
    """
    rows = walk.rows_of(files, parts_of, "marker int, offset long, bytes long, head int, raw binary")
    payload = F.when(F.col("marker").isNotNull(), F.substring("raw", F.col("head") + 1, F.length("raw")))
    return rows.withColumn("payload", payload).withColumn("_c", classify(F.col("marker"), F.col("payload"))).select("*", "_c.*").drop("_c")


def _byte(data: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(data, at + 1, 1)), 16, 10).cast("int")


def _starts(data: Column, prefix: bytes) -> Column:
    return F.substring(data, 1, len(prefix)) == F.lit(prefix)


def has_thumbnail(payload: Column) -> Column:
    """A JFIF header that carries pixels."""
    return (F.length(payload) >= 16) & (_byte(payload, 12) > 0) & (_byte(payload, 13) > 0)


def marker_name(marker: Column) -> Column:
    code = F.lpad(F.hex(marker), 2, "0")
    return F.when(marker.between(0xE0, 0xEF), F.concat(F.lit("APP"), (marker - 0xE0).cast("string"))).when(marker == COM, "COM").otherwise(F.concat(F.lit("0xFF"), code))


def is_frame(marker: Column) -> Column:
    return marker.between(0xC0, 0xCF) & ~marker.isin(0xC4, 0xC8, 0xCC)


def classify(marker: Column, payload: Column) -> Column:
    """(category, label) of a segment; the first rule that holds counts."""
    named = lambda category, label: F.struct(F.lit(category).alias("category"), (F.lit(label) if isinstance(label, str) else label).alias("label"))
    manifest = text.looks_like_manifest(F.substring(payload, F.lit(9), F.length(payload))) | text.looks_like_manifest(F.substring(payload, F.lit(3), F.length(payload)))
    rules = F.when(marker == COM, named("comment", "JPEG comment"))
    rules = rules.when((marker == 0xE0) & _starts(payload, b"JFIF\0") & has_thumbnail(payload), named("thumbnail", "JFIF header"))
    rules = rules.when((marker == 0xEB) & _starts(payload, b"JP") & manifest, named("c2pa", "C2PA manifest (JUMBF)"))
    rules = reduce(lambda r, a: r.when((marker == a[0]) & _starts(payload, a[1]), named(a[2], a[3])), APPLICATION, rules)
    unknown = F.concat(marker_name(marker), F.lit(" (unrecognised)"))
    return rules.when(marker.between(0xE0, 0xEF), named("other", unknown)).when(marker.isNotNull(), named("structural", marker_name(marker)))


def class_of(marker: int, payload: bytes) -> tuple[str, str]:
    """(category, label) of a segment on plain values, as ``classify`` has it."""
    if marker == COM:
        return "comment", "JPEG comment"
    if marker == 0xE0 and payload.startswith(b"JFIF\0") and len(payload) >= 16 and payload[12] and payload[13]:
        return "thumbnail", "JFIF header"
    if marker == 0xEB and payload.startswith(b"JP") and (plain.manifest_like(payload[8:]) or plain.manifest_like(payload[2:])):
        return "c2pa", "C2PA manifest (JUMBF)"
    known = next(((category, label) for m, lead, category, label in APPLICATION if m == marker and payload.startswith(lead)), None)
    name = f"APP{marker - 0xE0}" if 0xE0 <= marker <= 0xEF else "COM" if marker == COM else f"0xFF{marker:02X}"
    return known or (("other", f"{name} (unrecognised)") if 0xE0 <= marker <= 0xEF else ("structural", name))


def colour_of(parts: list[tuple]) -> tuple[int | None, int | None]:
    """(components, transform) from the last frame header and the last Adobe marker."""
    components = transform = None
    for marker, _, _, head, raw in parts:
        if marker is not None and 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(raw) - head >= 6:
            components = raw[head + 5]
        elif marker == 0xEE and raw[head : head + 5] == b"Adobe" and len(raw) - head >= 12:
            transform = raw[head + 11]
    return components, transform


def frames(rows: DataFrame) -> DataFrame:
    """Geometry and colour space per file, from its last frame header and Adobe marker."""
    p, m = F.col("payload"), F.col("marker")
    words = lambda at: _byte(p, at) * 256 + _byte(p, at + 1)
    frame = F.struct(_byte(p, 0).alias("precision"), words(1).alias("height"), words(3).alias("width"), _byte(p, 5).alias("components"), m.alias("frame"))
    seen = rows.where(m.isNotNull()).groupBy("file_id").agg(
        F.max_by(frame, F.when(is_frame(m) & (F.length(p) >= 6), F.col("ord"))).alias("f"),
        F.max_by(_byte(p, 11), F.when(_is_adobe(m, p), F.col("ord"))).alias("transform"),
    )
    n, t = F.col("components"), F.col("transform")
    space = F.when(n == 1, "Grayscale").when((n == 3) & F.coalesce(t == 0, F.lit(False)), "RGB").when(n == 3, "YCbCr").when((n == 4) & F.coalesce(t == 2, F.lit(False)), "YCCK").when(n == 4, "CMYK")
    frame_code = F.col("frame")
    return seen.select("file_id", "f.*", "transform").withColumn("color_space", space).withColumn("progressive", frame_code.isin(0xC2, 0xC6, 0xCA, 0xCE)).withColumn("lossless", frame_code.isin(0xC3, 0xC7, 0xCB, 0xCF)).withColumn("arithmetic", frame_code >= 0xC9)


def _is_adobe(marker: Column, payload: Column) -> Column:
    return (marker == 0xEE) & _starts(payload, b"Adobe") & (F.length(payload) >= 12)


def segment(marker: Column, payload: Column) -> Column:
    """Marker, length and payload as bytes."""
    return text.once(payload, lambda p: F.concat(F.unhex(F.concat(F.lit("FF"), F.lpad(F.hex(marker), 2, "0"), F.lpad(F.hex(F.length(p) + 2), 4, "0"))), p))


def decide(rows: DataFrame, removed: frozenset[str]) -> DataFrame:
    """``switch``, ``kept`` (bytes to write, null to drop) and ``reason`` for a part that has to stay.

    A comment with a generator's signature counts as ``ai``. The Adobe marker goes
    only where three components with transform 1 make it redundant. A JFIF header
    loses its thumbnail and stays.
    """
    file = Window.partitionBy("file_id")
    m, p = F.col("marker"), F.col("payload")
    components = F.max(F.when(is_frame(m) & (F.length(p) >= 6), _byte(p, 5))).over(file)
    switch = F.when(F.col("category") == "structural", None).when(F.col("category") == "thumbnail", "other").when((m == COM) & signals.has_signature(text.latin1(p)), "ai").otherwise(F.col("category"))
    goes = F.coalesce(F.col("switch").isin(*removed), F.lit(False))
    needed = (m == 0xEE) & _starts(p, b"Adobe") & ~F.coalesce((F.col("components") == 3) & (_byte(p, 11) == 1), F.lit(False))
    trimmed = segment(m, F.concat(F.substring(p, 1, 12), F.lit(b"\0\0")))
    reason = F.when(goes & needed, F.when(F.col("components") == 4, "Removing it would break CMYK/YCCK colour decoding").otherwise("It declares a non-default colour transform the decoder needs"))
    kept = F.when(~goes | needed, F.col("raw")).when((F.col("category") == "thumbnail") & (F.col("label") == "JFIF header"), trimmed)
    # a packet that stays loses what else is removed in it
    if "xmp" not in removed and removed & {"ai", "c2pa"}:
        head = next(lead for _, lead, _, name in APPLICATION if name == "XMP")
        found = text.utf8(xmp.packet(F.when(F.col("label") == "XMP", F.substring(p, F.lit(len(head) + 1), F.length(p)))))
        fresh = xmp.stripped(found, removed)
        kept = F.when(fresh != found, segment(m, F.concat(F.lit(head), fresh.cast("binary")))).otherwise(kept)
    return rows.withColumn("components", components).withColumn("switch", switch).withColumn("kept", kept).withColumn("reason", reason)


def assemble(rows: DataFrame) -> DataFrame:
    """(file_id, content) from ``kept`` in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "kept"))), lambda x: x["kept"])
    return rows.groupBy("file_id").agg(binary.joined(ordered).alias("content"))


def exif_payloads(rows: DataFrame) -> DataFrame:
    """(file_id, content) of the first EXIF segment of each file, from its byte order mark on."""
    body = F.substring("payload", F.lit(7), F.length("payload"))
    return rows.where("label = 'EXIF'").groupBy("file_id").agg(F.min_by(body, "ord").alias("content"))


def clean(files: DataFrame, removed: frozenset[str]) -> DataFrame:
    """Files without the segments of the removed categories, each by the task that read it; the scan stays byte for byte."""
    from shutterlake.sources import rewrite

    return rewrite.contents(files, "jpeg", removed)
