"""Column expressions over file bytes."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


@F.pandas_udf(BinaryType())
def joined(parts: pd.Series) -> pd.Series:
    """Byte strings as one, copied once however many they are; nulls are left out."""
    return parts.map(lambda listed: None if listed is None else b"".join(p for p in listed if p is not None))


def _at(content: Column, start: int, hex_bytes: str) -> Column:
    return F.substring(content, start + 1, len(hex_bytes) // 2) == F.unhex(F.lit(hex_bytes))


def _ascii(text: str) -> str:
    return text.encode("ascii").hex()


def compatible_brands(content: Column) -> Column:
    """Major and compatible four-byte brands of an ``ftyp`` box."""
    size = F.least(F.conv(F.hex(F.substring(content, 1, 4)), 16, 10).cast("int"), F.length(content))
    listed = F.when(size >= 20, F.transform(F.sequence(F.lit(17), size - 3, F.lit(4)), lambda i: F.substring(content, i, F.lit(4)).cast("string")))
    return F.concat(F.array(F.substring(content, 9, 4).cast("string")), F.coalesce(listed, F.array().cast("array<string>")))


def detect_format(content: Column) -> Column:
    """Format by content, never by name; under 12 bytes it is unknown."""
    brands = compatible_brands(content)
    has = lambda *names: reduce(lambda a, b: a | b, (F.array_contains(brands, n) for n in names))
    ftyp = _at(content, 4, _ascii("ftyp"))
    return (
        F.when(F.length(content) < 12, "unknown")
        .when(_at(content, 0, "ffd8ff"), "jpeg")
        .when(_at(content, 0, "89504e470d0a1a0a"), "png")
        .when(_at(content, 0, _ascii("RIFF")) & _at(content, 8, _ascii("WEBP")), "webp")
        .when(ftyp & has("avif", "avis"), "avif")
        .when(ftyp & has("heic", "heix", "heim", "heis", "hevc", "mif1", "msf1"), "heic")
        .when(_at(content, 0, "49492a00") | _at(content, 0, "4d4d002a") | _at(content, 0, "49492b00") | _at(content, 0, "4d4d002b"), "tiff")
        .when(_at(content, 0, _ascii("GIF8")), "gif")
        .when(_at(content, 0, _ascii("BM")), "bmp")
        .otherwise("unknown")
    )
