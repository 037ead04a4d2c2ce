"""WebP files as RIFF chunk rows, and back."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake import dims
from shutterlake.functions import binary
from shutterlake.sources import walk

#: Chunks with a switch, and those that make up the picture.
SWITCHES = {"EXIF": "exif", "XMP ": "xmp", "ICCP": "icc", "C2PA": "c2pa"}
PICTURE = ("VP8 ", "VP8L", "VP8X", "ALPH", "ANIM", "ANMF")
#: Flag bits of the extended header.
FLAGS = {"ICCP": 0x20, "EXIF": 0x08, "XMP ": 0x04}

#: Names of chunks.
LABELS = {"VP8 ": "VP8 image data", "VP8L": "VP8L image data", "VP8X": "Extended format header", "ALPH": "Alpha channel", "ANIM": "Animation parameters", "ANMF": "Animation frame", "EXIF": "EXIF", "XMP ": "XMP", "ICCP": "ICC colour profile", "C2PA": "C2PA manifest (JUMBF)"}


def chunks_of(content: bytes) -> list[tuple[str, int, int, bytes]]:
    """(FourCC, offset, padded size with header, payload); a cut chunk ends the walk."""
    out, at, end = [], 12, min(len(content), int.from_bytes(content[4:8], "little") + 8)
    while content[:4] == b"RIFF" and content[8:12] == b"WEBP" and at + 8 <= end:
        (size,) = struct.unpack_from("<I", content, at + 4)
        if at + 8 + size > len(content):
            break
        out.append((content[at : at + 4].decode("latin-1"), at, 8 + size + size % 2, content[at + 8 : at + 8 + size]))
        at += 8 + size + size % 2
    return out


def rows_of_file(content: bytes) -> Iterator[tuple]:
    for kind, at, size, data in chunks_of(content):
        yield kind, "structural" if kind in PICTURE else SWITCHES.get(kind, "other"), at, size, data


def shape_of(chunks: list[tuple[str, int, int, bytes]]) -> dict:
    """Canvas, alpha, animation and coding on plain values, as ``geometry`` has them."""
    first = lambda kind: next((d for k, _, _, d in chunks if k == kind), None)
    x, packed, lossy = first("VP8X") or b"", first("VP8L"), first("VP8 ")
    wide, films = len(x) >= 10, sum(k == "ANMF" for k, *_ in chunks)
    width = height = None
    alpha, animated = wide and bool(x[0] & 0x10), wide and bool(x[0] & 0x02)
    if wide:
        width, height = (int.from_bytes(x[i : i + 3], "little") + 1 for i in (4, 7))
    elif packed is not None and len(packed) >= 5 and packed[0] == 0x2F:
        bits = int.from_bytes(packed[1:5], "little")
        width, height, alpha = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, bool(bits >> 28 & 1)
    elif packed is None and lossy is not None and len(lossy) >= 10 and lossy[3:6] == b"\x9d\x01\x2a":
        width, height = (int.from_bytes(lossy[i : i + 2], "little") & 0x3FFF for i in (6, 8))
    alpha = alpha or (packed is None and lossy is not None and first("ALPH") is not None)
    encoding = "VP8L (lossless)" if packed is not None else "VP8 (lossy)" if lossy is not None else f"Animated, {films} frame(s)" if animated else "Unknown"
    return {"width": width, "height": height, "color_space": "YCbCr", "channels": 4 if alpha else 3, "has_alpha": alpha, "animated": animated, "progressive": False, "encoding": encoding}


def label(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair)), kind), F.concat(F.trim(kind), F.lit(" chunk")))


def chunks(files: DataFrame) -> DataFrame:
    """One row per chunk of each (file_id, content)."""
    return walk.rows_of(files, rows_of_file, "type string, category string, offset long, bytes long, data binary").withColumn("label", label(F.col("type")))


def _number(data: Column, at: int, size: int) -> Column:
    """Little-endian."""
    return sum((F.conv(F.hex(F.substring(data, at + k + 1, 1)), 16, 10).cast("long") * (1 << 8 * k) for k in range(size)), F.lit(0).cast("long"))


def geometry(rows: DataFrame) -> DataFrame:
    """Canvas, alpha, animation and coding per file: from the extended header, else from the picture's own."""
    first = lambda kind: F.min_by(F.substring("data", 1, 10), F.when(F.col("type") == kind, F.col("ord")))
    seen = rows.groupBy("file_id").agg(first("VP8X").alias("x"), first("VP8L").alias("l"), first("VP8 ").alias("v"), F.count(F.when(F.col("type") == "ANMF", 1)).alias("frames"), F.max(F.col("type") == "ALPH").alias("alph"))
    x, packed = F.col("x"), _number(F.col("l"), 1, 4)
    wide = F.length(x) >= 10
    own_l = F.coalesce(~wide, F.lit(True)) & (F.length("l") >= 5) & (_number(F.col("l"), 0, 1) == 0x2F)
    own_v = F.coalesce(~wide, F.lit(True)) & F.col("l").isNull() & (F.length("v") >= 10) & (F.substring("v", 4, 3) == F.unhex(F.lit("9D012A")))
    side = lambda at, shift, low: F.when(wide, _number(x, at, 3) + 1).when(own_l, F.shiftright(packed, shift).bitwiseAND(0x3FFF) + 1).when(own_v, _number(F.col("v"), low, 2).bitwiseAND(0x3FFF))
    flag = lambda bit: F.coalesce(wide & (_number(x, 0, 1).bitwiseAND(bit) != 0), F.lit(False))
    animated = flag(0x02)
    alpha = flag(0x10) | F.coalesce(own_l & (F.shiftright(packed, 28).bitwiseAND(1) == 1), F.lit(False)) | (F.col("l").isNull() & F.col("v").isNotNull() & F.col("alph"))
    encoding = F.when(F.col("l").isNotNull(), "VP8L (lossless)").when(F.col("v").isNotNull(), "VP8 (lossy)").when(animated, F.concat(F.lit("Animated, "), F.col("frames").cast("string"), F.lit(" frame(s)"))).otherwise("Unknown")
    return seen.select("file_id", side(4, 0, 6).alias("width"), side(7, 14, 8).alias("height"), alpha.alias("has_alpha"), animated.alias("animated"), F.col("frames").cast("int").alias("frames"), encoding.alias("encoding"))


def _byte(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n), 2, "0"))


def _little(n: Column) -> Column:
    return F.concat(*(_byte(F.shiftright(n, 8 * k).bitwiseAND(255)) for k in range(4)))


def assemble(rows: DataFrame) -> DataFrame:
    """(file_id, content) from chunk rows in order; header flags and sizes match what is left."""
    size = F.length("data")
    body = F.concat(F.col("type").cast("binary"), _little(size), F.col("data"), F.when(size % 2 == 1, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit(""))))
    held = rows.groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "type", "data", body.alias("raw")))).alias("parts"),
        F.collect_set("type").alias("types"),
    )
    clear = sum((F.when(F.array_contains("types", k), 0).otherwise(bit) for k, bit in FLAGS.items()), F.lit(0))
    flags = lambda x: F.conv(F.hex(F.substring(x["data"], 1, 1)), 16, 10).cast("int")
    fixed = lambda x: F.when((x["type"] == "VP8X") & (F.length(x["data"]) > 0), F.concat(F.substring(x["raw"], 1, 8), _byte(flags(x).bitwiseAND(F.bitwise_not(F.col("clear")))), F.substring(x["raw"], F.lit(10), F.length(x["raw"])))).otherwise(x["raw"])
    joined = held.withColumn("clear", clear).select("file_id", F.concat(F.lit(b"WEBP"), binary.joined(F.transform("parts", fixed))).alias("body"))
    return joined.select("file_id", F.concat(F.lit(b"RIFF"), _little(F.length("body")), F.col("body")).alias("content"))


def clean(files: DataFrame, policy: DataFrame) -> DataFrame:
    """Files without the chunks whose category the policy removes, each by the task that read it."""
    from shutterlake.sources import rewrite

    return rewrite.contents(files, "webp", dims.switched_off(policy))
