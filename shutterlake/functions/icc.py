"""Colour profiles, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shutterlake.functions import text

#: Device classes and colour spaces.
CLASSES = {"scnr": "Input device", "mntr": "Display device", "prtr": "Output device", "link": "DeviceLink", "spac": "Colour space", "abst": "Abstract", "nmcl": "Named colour"}
SPACES = {"RGB ": "RGB", "GRAY": "Grayscale", "CMYK": "CMYK", "Lab ": "CIELAB", "XYZ ": "CIEXYZ", "YCbr": "YCbCr", "CMY ": "CMY"}
#: Fixed value: most tags a table may declare.
_TAGS = 512


def _cut(data: Column, start: Column | int, size: Column | int) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.substring(data, (as_column(start) + 1).cast("int"), as_column(size).cast("int"))


def _word(data: Column, start: Column | int) -> Column:
    return F.conv(F.hex(_cut(data, start, 4)), 16, 10).cast("long")


def _named(code: Column, names: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(code == k, v) for k, v in names.items()), text.strip(code))


def is_profile(data: Column) -> Column:
    return (F.length(data) >= 132) & (_cut(data, 36, 4) == F.lit(b"acsp"))


def _tag_text(tag: Column) -> Column:
    """Text of a description tag in any of its three forms; null where it is cut or empty."""
    kind, size = _cut(tag, 0, 4), F.length(tag)
    length, at = _word(tag, 20), _word(tag, 24)
    plain = F.when((_word(tag, 8) > 0) & (_word(tag, 8) + 12 <= size), text.latin1(_cut(tag, 12, _word(tag, 8))))
    wide = F.when((_word(tag, 8) > 0) & (length > 0) & (at + length <= size), text.utf16(_cut(tag, at, length), False))
    found = F.when(kind == F.lit(b"desc"), plain).when(kind == F.lit(b"mluc"), wide).when(kind == F.lit(b"text"), text.latin1(_cut(tag, 8, size)))
    return text.some(text.strip(found))


def description(data: Column) -> Column:
    count = _word(data, 128)
    table = F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda i: F.struct(_cut(data, i * 12 + 132, 4).alias("name"), _word(data, i * 12 + 136).alias("at"), _word(data, i * 12 + 140).alias("size")))
    hit = F.get(F.filter(table, lambda t: t["name"] == F.lit(b"desc")), F.lit(0))
    fits = lambda h: (h["at"] + h["size"] <= F.length(data)) & (h["size"] >= 12)
    told = text.once(hit, lambda h: F.when(fits(h), text.once(_cut(data, h["at"], h["size"]), _tag_text)))
    return F.when(count.between(1, _TAGS), told)


def summary(data: Column) -> Column:
    """Size, and for a valid profile its maker, version, class, space and description."""
    fine = is_profile(data)
    number = lambda at: F.conv(F.hex(_cut(data, at, 1)), 16, 10).cast("int")
    version = F.concat(number(8).cast("string"), F.lit("."), F.shiftright(number(9), 4).cast("string"))
    name = lambda at: _cut(data, at, 4).cast("string")
    return F.struct(
        F.length(data).cast("long").alias("bytes"),
        F.when(fine, F.nullif(text.strip(name(4)), F.lit(""))).alias("cmm"),
        F.when(fine, version).alias("version"),
        F.when(fine, _named(name(12), CLASSES)).alias("device_class"),
        F.when(fine, _named(name(16), SPACES)).alias("color_space"),
        F.when(fine, description(data)).alias("description"),
    )
