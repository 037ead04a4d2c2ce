"""PNG files as chunk rows, and back."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from shutterlake import dims
from shutterlake.functions import binary, plain, signals
from shutterlake.sources import walk

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Chunk types with a switch of their own.
SWITCHES = {"eXIf": "exif", "iCCP": "icc", "caBX": "c2pa", "tEXt": "comment", "zTXt": "comment", "iTXt": "comment", "tIME": "other"}
#: Ancillary chunks that change how pixels look.
FUNCTIONAL = frozenset("tRNS cHRM gAMA sBIT sRGB cICP mDCV cLLI bKGD hIST pHYs sPLT acTL fcTL fdAT".split())
XMP_KEY = b"XML:com.adobe.xmp"

#: Names of chunk types and colour types (with their channels).
LABELS = {"IHDR": "Image header", "PLTE": "Palette", "IDAT": "Image data", "IEND": "End of image", "iCCP": "ICC colour profile", "eXIf": "EXIF", "caBX": "C2PA manifest (JUMBF)", "tEXt": "Text (uncompressed)", "zTXt": "Text (compressed)", "iTXt": "Text (international)", "tIME": "Last modification time", "acTL": "Animation control", "fcTL": "Frame control", "fdAT": "Frame data"}
COLORS = {0: ("Grayscale", 1), 2: ("RGB", 3), 3: ("Indexed", 1), 4: ("Grayscale + alpha", 2), 6: ("RGB + alpha", 4)}
TEXTS = frozenset(["tEXt", "zTXt", "iTXt"])
#: What an inflated text or profile may have at most, against chunks that blow up.
INFLATED = 64 << 20
_FIELDS = "type string, base string, offset long, bytes long, crc_ok boolean, data binary, keyword string, language string, text string, error string"


def category_of(kind: str, data: bytes) -> str:
    if kind[:1].isupper() or kind in FUNCTIONAL:
        return "structural"
    if kind == "iTXt" and data.startswith(XMP_KEY):
        return "xmp"
    return SWITCHES.get(kind, "other")


def chunks_of(content: bytes) -> list[tuple[str, int, int, bool, bytes]]:
    """(type, offset, framed size, CRC holds, data) up to IEND; a cut chunk ends the walk."""
    out, at = [], len(SIGNATURE)
    while content.startswith(SIGNATURE) and at + 12 <= len(content):
        (size,), kind = struct.unpack_from(">I", content, at), content[at + 4 : at + 8]
        if at + 12 + size > len(content):
            break
        data = content[at + 8 : at + 8 + size]
        (crc,) = struct.unpack_from(">I", content, at + 8 + size)
        out.append((kind.decode("latin-1"), at, size + 12, crc == zlib.crc32(kind + data), data))
        at += size + 12
        if kind == b"IEND":
            break
    return out


def inflated(data: bytes) -> tuple[bytes, str | None]:
    """(plain bytes, error) of a zlib stream."""
    if not data:
        return b"", None
    try:
        d = zlib.decompressobj()
        out = d.decompress(data, INFLATED)
        return (out, None) if d.eof else (b"", "over the limit" if d.unconsumed_tail else "cut stream")
    except zlib.error as e:
        return b"", str(e)


def text_of(kind: str, data: bytes) -> tuple[str | None, str | None, str | None, str | None]:
    """(keyword, language, text, error) of a text or profile chunk; a bad one has an error, not an exception."""
    end = data.find(b"\0", 0, 80)
    if end < 0:
        return None, None, None, None
    keyword, rest = plain.latin1(data[:end]).strip("\0"), data[end + 1 :]
    if kind == "tEXt":
        return keyword, None, plain.latin1(rest), None
    if kind in ("zTXt", "iCCP"):
        if rest[:1] != b"\0":
            return keyword, None, "", f"unknown compression method {rest[0] if rest else None}"
        body, error = inflated(rest[1:])
        return keyword, None, plain.utf8(body) if kind == "zTXt" else None, error
    language_end = rest.find(b"\0", 2)
    if len(rest) < 2 or language_end < 0:
        return keyword, None, "", "missing language tag"
    name_end = rest.find(b"\0", language_end + 1)
    if name_end < 0:
        return keyword, None, "", "missing translated keyword"
    body, error = (rest[name_end + 1 :], None) if rest[0] != 1 else inflated(rest[name_end + 1 :])
    return keyword, plain.latin1(rest[2:language_end]) or None, plain.utf8(body), error


def rows_of_file(content: bytes) -> Iterator[tuple]:
    for kind, at, size, ok, data in chunks_of(content):
        named = text_of(kind, data) if kind in TEXTS or kind == "iCCP" else (None,) * 4
        yield (kind, category_of(kind, data), at, size, ok, data, *named)


def category(base: Column, keyword: Column, words: Column) -> Column:
    """A text chunk with a packet is ``xmp``, one with a generator's key or signature ``ai``."""
    marked = signals.is_generator_key(keyword) | signals.has_signature(words)
    return F.when((base == "comment") & (keyword == XMP_KEY.decode()), "xmp").when((base == "comment") & marked, "ai").otherwise(base)


def label(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair)), kind), F.concat(kind, F.lit(" chunk")))


def chunks(files: DataFrame) -> DataFrame:
    """One row per chunk of each (file_id, content), text chunks with their keyword, language and text."""
    rows = walk.rows_of(files, rows_of_file, _FIELDS)
    return rows.withColumn("category", category(F.col("base"), F.col("keyword"), F.col("text"))).withColumn("label", label(F.col("type"))).drop("base")


@F.pandas_udf(BinaryType())
def profile(data: pd.Series) -> pd.Series:
    """The colour profile in the data of an iCCP chunk; null where it cannot be inflated."""

    def one(d: bytes | None) -> bytes | None:
        end = d.find(b"\0", 0, 80) if d else -1
        return inflated(d[end + 2 :])[0] or None if end >= 0 and d[end + 1 : end + 2] == b"\0" else None

    return data.map(one)


def _number(data: Column, at: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10).cast("long")


def headers(rows: DataFrame) -> DataFrame:
    """Geometry per file from its first header and animation chunks."""
    first = lambda kind: F.min_by("data", F.when(F.col("type") == kind, F.col("ord")))
    held = rows.where("type in ('IHDR', 'acTL')").groupBy("file_id").agg(first("IHDR").alias("_h"), first("acTL").alias("_a"))
    h, kind = F.col("_h"), _number(F.col("_h"), 9, 1).cast("int")
    pick = lambda i, other: F.coalesce(F.element_at(F.create_map(*(x for k, v in COLORS.items() for x in (F.lit(k), F.lit(v[i])))), kind), other)
    animated = F.col("_a").isNotNull()
    encoding = F.when(animated, F.concat(F.lit("APNG, "), F.coalesce(_number(F.col("_a"), 0, 4).cast("string"), F.lit("?")), F.lit(" frames"))).when(_number(h, 12, 1) == 1, "Adam7 interlaced").otherwise("Deflate")
    return held.where(F.length(h) >= 13).select("file_id", _number(h, 0, 4).alias("width"), _number(h, 4, 4).alias("height"), _number(h, 8, 1).cast("int").alias("bit_depth"), pick(0, F.concat(F.lit("Colour type "), kind.cast("string"))).alias("color_space"), pick(1, F.lit(1)).alias("channels"), kind.isin(4, 6).alias("has_alpha"), animated.alias("animated"), (_number(h, 12, 1) == 1).alias("progressive"), encoding.alias("encoding"))


def itxt(keyword: Column, language: Column, words: Column) -> Column:
    """The data of an uncompressed international text chunk."""
    return F.concat(keyword.cast("binary"), F.lit(b"\0\0\0"), F.coalesce(language, F.lit("")).cast("binary"), F.lit(b"\0\0"), words.cast("binary"))


def assemble(rows: DataFrame) -> DataFrame:
    """(file_id, content) from chunk rows in order, with fresh CRCs, in column expressions."""
    word = lambda n: F.unhex(F.lpad(F.hex(n), 8, "0"))
    kind = F.col("type").cast("binary")
    framed = F.concat(word(F.length("data")), kind, F.col("data"), word(F.crc32(F.concat(kind, F.col("data")))))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", framed.alias("raw")))), lambda x: x["raw"])
    return rows.groupBy("file_id").agg(F.concat(F.lit(SIGNATURE), binary.joined(ordered)).alias("content"))


def clean(files: DataFrame, policy: DataFrame) -> DataFrame:
    """Files without the chunks whose category the policy removes, each by the task that read it; pixels stay as they are."""
    from shutterlake.sources import rewrite

    return rewrite.contents(files, "png", dims.switched_off(policy))
