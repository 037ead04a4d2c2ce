"""AVIF and HEIC files as box rows and item rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions import text
from shutterlake.sources import manifest, walk

#: Boxes that hold boxes, with the bytes before the first.
HOLDERS = {b"meta": 4, b"iprp": 0, b"ipco": 0, b"dinf": 0, b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0}
_DEPTH = 8


def boxes_of(content: bytes) -> Iterator[tuple[int, str, int, int, int, bytes | None]]:
    """(depth, type, offset, header, size, uuid), outer boxes first; a box that does not fit ends its level."""
    stack = [(0, len(content), 0)]
    while stack:
        at, end, depth = stack.pop()
        while at + 8 <= end:
            size, kind, head = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8], 8
            if size == 1:
                size, head = int.from_bytes(content[at + 8 : at + 16], "big"), 16
            size = size or end - at
            uuid = content[at + head : at + head + 16] if kind == b"uuid" else None
            head += 16 if uuid else 0
            if size < head or at + size > end:
                break
            yield depth, kind.decode("latin-1"), at, head, size, uuid
            if kind in HOLDERS and depth < _DEPTH and size >= head + HOLDERS[kind]:
                stack.append((at + size, end, depth))
                at, end, depth = at + head + HOLDERS[kind], at + size, depth + 1
            else:
                at += size


class _Cursor:
    """Big-endian reads that fail past the end."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def number(self, size: int) -> int:
        if self.at + size > len(self.data):
            raise ValueError("past the end")
        self.at += size
        return int.from_bytes(self.data[self.at - size : self.at], "big")

    def word(self) -> str:
        end = self.data.find(b"\0", self.at)
        end = len(self.data) if end < 0 else end
        found, self.at = self.data[self.at : end].decode("utf-8", "replace"), end + 1
        return found


def _locations(body: bytes, external: set[int] | None = None) -> dict[int, tuple[int, list[tuple[int, int]]]]:
    """Item id to (construction method, extents with the base added); of an id the last counts.

    Items whose bytes lie in another file are added to ``external``.
    """
    c = _Cursor(body, 4)
    version, widths = body[0], c.number(2)
    wide = [widths >> 12, widths >> 8 & 15, widths >> 4 & 15, widths & 15 if version else 0]
    out = {}
    for _ in range(c.number(4 if version == 2 else 2)):
        item = c.number(4 if version == 2 else 2)
        method = c.number(2) & 15 if version else 0
        if c.number(2) and external is not None:
            external.add(item)
        base, extents = c.number(wide[2]), []
        for _ in range(c.number(2)):
            c.number(wide[3])
            extents.append((base + c.number(wide[0]), c.number(wide[1])))
        out[item] = method, extents
    return out


def _entry(body: bytes) -> tuple[int, str, str, str]:
    """(id, type, name, content type) of an item entry of any version."""
    c, version = _Cursor(body, 4), body[0]
    item = c.number(4 if version == 3 else 2)
    c.number(2)
    if version < 2:
        return item, "", c.word(), c.word()
    kind = c.number(4).to_bytes(4, "big").decode("latin-1")
    return item, kind, c.word(), c.word() if kind == "mime" else ""


def _collected(content: bytes, extents: list[tuple[int, int]], area: tuple[int, int]) -> bytes | None:
    low, high = area
    if any(low + at + n > high for at, n in extents):
        return None
    return b"".join(content[low + at : low + at + n] for at, n in extents)


def items_of(content: bytes) -> list[tuple]:
    """(id, type, name, content type, method, bytes, extents, primary, data); pixels are not copied into ``data``."""
    found: dict[str, tuple[int, int]] = {}
    for _, kind, at, head, size, _ in boxes_of(content):
        found.setdefault(kind, (at + head, at + size))
    part = lambda kind: content[slice(*found[kind])] if kind in found else b""
    out = []
    try:
        places, pitm, listed = _locations(part("iloc")) if "iloc" in found else {}, part("pitm"), part("iinf")
        primary = int.from_bytes(pitm[4 : 8 if pitm[0] else 6], "big") if pitm else None
        for _, kind, at, head, size, _ in boxes_of(listed[6 if listed[:1] == b"\0" else 8 :]) if listed else ():
            skip = 6 if listed[:1] == b"\0" else 8
            if kind != "infe":
                continue
            item, form, name, mime = _entry(listed[skip + at + head : skip + at + size])
            method, extents = places.get(item, (0, []))
            area = {0: (0, len(content)), 1: found.get("idat", (0, 0))}.get(method, (0, 0))
            held = form in ("Exif", "mime", "uri ", "jumb", "c2pa", "")
            out.append((item, form, name, mime, method, sum(n for _, n in extents), extents, item == primary, _collected(content, extents, area) if held and extents else None))
    except (ValueError, IndexError, struct.error):
        pass
    return out


def boxes(files: DataFrame) -> DataFrame:
    return walk.rows_of(files, boxes_of, "depth int, type string, offset long, head int, bytes long, uuid binary")


def items(files: DataFrame) -> DataFrame:
    """Items joined to their places, with a category; a kind that is not known belongs to the picture."""
    rows = walk.rows_of(files, items_of, "item_id long, type string, name string, content_type string, method int, bytes long, extents array<struct<offset:long,length:long>>, is_primary boolean, data binary")
    packet = (F.col("type") == "mime") & F.lower("content_type").rlike("rdf|xmp|xml")
    category = F.when(F.col("type") == "Exif", "exif").when(packet, "xmp").when(text.looks_like_manifest(F.col("data")), "c2pa").otherwise("structural")
    return rows.withColumn("category", category)


def exif_payloads(rows: DataFrame) -> DataFrame:
    """(file_id, content) of the first EXIF item, behind the offset that its first four bytes give."""
    skip = F.conv(F.hex(F.substring("data", 1, 4)), 16, 10).cast("int")
    body = F.substring("data", skip + 5, F.length("data"))
    return rows.where("category = 'exif' and data is not null").groupBy("file_id").agg(F.min_by(body, "ord").alias("content"))


def segments(files: DataFrame) -> DataFrame:
    """(file_id, category, label, bytes) of everything but the picture: items, and manifest boxes at the top."""
    held = items(files).where("category <> 'structural'").select("file_id", "category", F.coalesce(F.nullif("name", F.lit("")), "type").alias("label"), "bytes")
    signed = boxes(files).where((F.col("depth") == 0) & (F.col("uuid") == F.lit(manifest.UUID))).select("file_id", F.lit("c2pa").alias("category"), F.lit("uuid").alias("label"), "bytes")
    return held.unionByName(signed)


def refusals(files: DataFrame) -> DataFrame:
    """(file_id, reason) of files whose pixels cannot be moved without decoding."""
    from shutterlake.sources import heif_write

    def run(content: bytes) -> Iterator[tuple]:
        reason = heif_write.refusal(content) if content[4:8] == b"ftyp" else None
        if reason:
            yield (reason,)

    return walk.rows_of(files, run, "reason string").drop("ord")
