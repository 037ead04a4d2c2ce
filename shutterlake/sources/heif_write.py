"""AVIF and HEIC files written again without some of their items.

A file is written by the task that read it, so no bytes are shuffled. Items that go
leave the item list, the references and the property associations; the bytes of all
others move together. Positions are not known before the boxes in front of them are:
a first layout with empty positions gives the sizes, a second one has the positions.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions import plain
from shutterlake.sources import heif, manifest, walk

_TOP = 0xFFFFFFFF


class Refused(ValueError):
    """The picture can't be moved without decoding it."""


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 > _TOP:
        raise Refused("An item extent is larger than the 32-bit item location table allows")
    return struct.pack(">I", len(body) + 8) + kind + body


def full_box(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, bytes([version]), flags.to_bytes(3, "big"), *parts)


def _children(content: bytes, low: int, high: int) -> list[tuple[bytes, int, int]]:
    """(type, start of the body, end) of the boxes between two places."""
    out = []
    for depth, kind, at, head, size, _ in heif.boxes_of(content[low:high]):
        if not depth:
            out.append((kind.encode("latin-1"), low + at + head, low + at + size))
    return out


def references_of(body: bytes) -> list[tuple[bytes, int, list[int]]]:
    """(type, from, to) of a reference box; one that is cut short is passed over."""
    wide, out = 4 if body[:1] != b"\0" else 2, []
    for kind, low, high in _children(body, 4, len(body)):
        c = heif._Cursor(body[:high], low)
        try:
            item = c.number(wide)
            out.append((kind, item, [c.number(wide) for _ in range(c.number(2))]))
        except ValueError:
            continue
    return out


def associations_of(body: bytes) -> list[tuple[int, list[tuple[int, bool]]]]:
    """(item, [(property, essential)]) of an association box; what is cut short ends it."""
    c, out = heif._Cursor(body, 4), []
    wide, size = 4 if body[:1] != b"\0" else 2, 2 if body[3:4] and body[3] & 1 else 1
    try:
        for _ in range(c.number(4)):
            item, n = c.number(wide), c.number(1)
            marks = [c.number(size) for _ in range(n)]
            top = 1 << (8 * size - 1)
            out.append((item, [(m & (top - 1), bool(m & top)) for m in marks]))
    except ValueError:
        pass
    return out


def written_references(found: list[tuple[bytes, int, list[int]]], gone: set[int]) -> bytes:
    """References between items that stay; empty if none does."""
    left = [(k, a, [b for b in to if b not in gone]) for k, a, to in found if a not in gone]
    left = [one for one in left if one[2]]
    if not left:
        return b""
    version = int(any(max(a, *to) > 0xFFFF for _, a, to in left))
    form = "I" if version else "H"
    return full_box(b"iref", version, 0, *(box(k, struct.pack(f">{form}H{len(to)}{form}", a, len(to), *to)) for k, a, to in left))


def written_associations(found: list[tuple[int, list[tuple[int, bool]]]], gone: set[int]) -> bytes:
    """Associations of the items that stay, as narrow as ids and properties allow."""
    left = sorted((one for one in found if one[0] not in gone), key=lambda one: one[0])
    version, flags = int(any(i > 0xFFFF for i, _ in left)), int(any(p > 127 for _, ps in left for p, _ in ps))
    form, bit = ("H", 1 << 15) if flags else ("B", 1 << 7)
    rows = (struct.pack(f">{'I' if version else 'H'}B{len(ps)}{form}", i, len(ps), *(p | bit * e for p, e in ps)) for i, ps in left)
    return full_box(b"ipma", version, flags, struct.pack(">I", len(left)), *rows)


def written_places(places: list[tuple[int, int, list[tuple[int, int]]]]) -> bytes:
    """Item places in 32 bits each: (item, method, [(offset, length)])."""
    version = 2 if any(i > 0xFFFF for i, _, _ in places) or len(places) > 0xFFFF else 1
    form = "I" if version == 2 else "H"
    rows = (struct.pack(f">{form}HHH", i, method, 0, len(ext)) + b"".join(struct.pack(">II", *e) for e in ext) for i, method, ext in places)
    return full_box(b"iloc", version, 0, b"\x44\x00", struct.pack(f">{form}", len(places)), *rows)


#: What a content type of a packet contains, and item types of manifests.
_PACKETS, _SIGNED = ("rdf+xml", "xmp", "xml"), ("uuid", "jumb", "c2pa")


def class_of(form: str, mime: str, data: bytes | None) -> tuple[str | None, str]:
    """(category, label) of an item; what is not known belongs to the picture and has no category."""
    if form == "Exif":
        return "exif", "EXIF item"
    if form == "mime":
        if any(w in mime.lower() for w in _PACKETS):
            return "xmp", "XMP item"
        return ("c2pa", "C2PA manifest item") if plain.manifest_like(data) else ("other", f"MIME item ({mime or 'unknown'})")
    if form in _SIGNED:
        return ("c2pa", "C2PA manifest item") if data is None or plain.manifest_like(data) else ("other", "UUID item")
    return None, f"{form or 'unnamed'} item"


def _top(content: bytes) -> list[tuple[bytes, int, int, int, bytes | None]]:
    return [(kind.encode("latin-1"), at, head, size, uuid) for depth, kind, at, head, size, uuid in heif.boxes_of(content) if not depth]


def refusal(content: bytes) -> str | None:
    """Why a file can't be written without decoding it; None if it can."""
    top = _top(content)
    if not top:
        return "The file contains no readable ISOBMFF boxes"
    if any(kind == b"moov" for kind, *_ in top):
        return "Image sequences carry a movie box whose sample tables cannot be relocated safely"
    meta = next(((at + head, at + size) for kind, at, head, size, _ in top if kind == b"meta"), None)
    iloc = next((content[a:b] for kind, a, b in _children(content, meta[0] + 4, meta[1]) if kind == b"iloc"), None) if meta else None
    if iloc is None:
        return None
    external: set[int] = set()
    try:
        places = heif._locations(iloc, external)
    except (ValueError, IndexError) as e:
        return f"The item location table could not be read ({e})"
    if any(method == 2 for method, _ in places.values()):
        return "Items stored inside other items (construction method 2) cannot be relocated"
    if external:
        return "Items stored in an external file cannot be rewritten"
    if any(length > _TOP for _, extents in places.values() for _, length in extents):
        return "An item extent is larger than the 32-bit item location table allows"
    return None


def entry_sizes(content: bytes) -> dict[int, int]:
    """Bytes of each item's entry in the item list, which goes with the item."""
    out = {}
    for body in _meta_bodies(content, b"iinf"):
        for kind, low, high in _children(body, 6 if body[:1] == b"\0" else 8, len(body)):
            if kind == b"infe":
                try:
                    out[heif._entry(body[low:high])[0]] = high - low + 8
                except (ValueError, IndexError):
                    continue
        break
    return out


def brands_of(content: bytes) -> list[str]:
    body = next((content[at + head : at + size] for kind, at, head, size, _ in _top(content) if kind == b"ftyp"), b"")
    return [body[i : i + 4].decode("latin-1") for i in (0, *range(8, len(body) - 3, 4)) if len(body) >= 4]


def shape_of(content: bytes, boxes: list[tuple]) -> tuple[dict, tuple[int, int, bytes] | None]:
    """(size, depth and channels by the first property of a kind, the last colour profile's place, size and bytes)."""
    out: dict = {"has_alpha": False}
    profile = None
    inside = next(((at + head, at + size) for _, kind, at, head, size, _ in boxes if kind == "ipco"), None)
    for kind, low, high in _children(content, *inside) if inside else ():
        data = content[low:high]
        if kind == b"ispe" and len(data) >= 12 and "width" not in out:
            out["width"], out["height"] = struct.unpack(">II", data[4:12])
        elif kind == b"pixi" and len(data) >= 5 and "bit_depth" not in out:
            out["channels"] = data[4]
            if data[4] and len(data) >= 5 + data[4]:
                out["bit_depth"] = data[5]
        elif kind == b"av1C" and len(data) >= 3 and "bit_depth" not in out:
            out["bit_depth"] = 12 if data[2] & 0x20 else 10 if data[2] & 0x40 else 8
            out.setdefault("channels", 1 if data[2] & 0x10 else 3)
        elif kind == b"auxC":
            out["has_alpha"] = True
        elif kind == b"colr" and data[:4] in (b"prof", b"rICC") and len(data) > 4:
            profile = low - 8, high - low + 8, data[4:]
    return out, profile


class _Area:
    """Bytes that move together; an extent that several items share is kept once."""

    def __init__(self, content: bytes, low: int, high: int) -> None:
        self.content, self.low, self.high = content, low, high
        self.parts: list[bytes] = []
        self.size, self.at = 0, {}

    def move(self, extent: tuple[int, int]) -> tuple[int, int]:
        offset, length = extent
        length = length or self.high - self.low - offset  # no length: all that follows
        if length < 0 or self.low + offset + length > self.high:
            raise ValueError("extent outside the file")
        if (offset, length) not in self.at:
            self.at[offset, length] = self.size
            self.parts.append(self.content[self.low + offset : self.low + offset + length])
            self.size += length
        return self.at[offset, length], length


def without(content: bytes, removed: frozenset[str]) -> tuple[bytes, list[tuple[str, str, int]]]:
    """The file without items and manifest boxes of these categories, and (category, label, bytes) of what went.

    An item's bytes count with its entry in the item list. The picture's item never
    goes. A file that loses nothing stays byte for byte; what lies behind the last
    box goes with the first loss. Without an item table only manifest boxes can go.
    """
    reason = refusal(content)
    if reason:
        raise Refused(reason)
    top = _top(content)
    lost = [("c2pa", "uuid", size) for _, _, _, size, uuid in top if uuid == manifest.UUID and "c2pa" in removed]
    meta = next(((at + head, at + size) for kind, at, head, size, _ in top if kind == b"meta"), None)
    inner = _children(content, meta[0] + 4, meta[1]) if meta else []
    part = {kind: content[low:high] for kind, low, high in reversed(inner)}
    gone, sizes = set(), entry_sizes(content)
    for item, form, name, mime, _, size, _, primary, data in heif.items_of(content):
        category, _ = class_of(form, mime, data)
        if category in removed and not primary:
            gone.add(item)
            lost.append((category, name or form, size + sizes.get(item, 0)))
    if not lost:
        return content, []
    if meta is None:
        return b"".join(content[at : at + size] for _, at, _, size, uuid in top if uuid != manifest.UUID), lost
    if b"iinf" not in part or b"iloc" not in part:
        raise Refused("The rebuilt file lost its item location table")
    places = heif._locations(part[b"iloc"])
    idat = next(((low, high) for kind, low, high in inner if kind == b"idat"), (0, 0))
    areas = {0: _Area(content, 0, len(content)), 1: _Area(content, *idat)}
    moved = [(i, method, [areas[method].move(e) for e in ext]) for i, (method, ext) in places.items() if i not in gone]

    listed = part[b"iinf"]
    skip = 6 if listed[:1] == b"\0" else 8
    entries = [(heif._entry(listed[low:high])[0], box(b"infe", listed[low:high])) for kind, low, high in _children(listed, skip, len(listed)) if kind == b"infe"]
    stay = [raw for item, raw in entries if item not in gone]
    wide = len(stay) > 0xFFFF
    infos = full_box(b"iinf", int(wide), 0, struct.pack(">I" if wide else ">H", len(stay)), *stay)

    def properties(low: int, high: int) -> bytes:
        return box(b"iprp", *(written_associations(associations_of(content[a:b]), gone) if kind == b"ipma" else box(kind, content[a:b]) for kind, a, b in _children(content, low, high)))

    def table(start: int) -> bytes:
        out = [content[meta[0] : meta[0] + 4]]
        for kind, low, high in inner:
            if kind == b"iloc":
                out.append(written_places([(i, m, [(at + (0 if m else start), n) for at, n in ext]) for i, m, ext in moved]))
            elif kind == b"iinf":
                out.append(infos)
            elif kind == b"iref":
                out.append(written_references(references_of(content[low:high]), gone))
            elif kind == b"iprp":
                out.append(properties(low, high))
            elif kind == b"idat":
                out.append(box(b"idat", *areas[1].parts) if areas[1].size else b"")
            else:
                out.append(box(kind, content[low:high]))
        return box(b"meta", *out)

    def layout(start: int) -> tuple[list[bytes], int]:
        """The boxes of the file, and where the moved bytes begin in them."""
        out, at, begin = [], 0, 0
        pixels, tables = box(b"mdat", *areas[0].parts), table(start)
        for n, (kind, low, _, size, uuid) in enumerate(top):
            if kind == b"mdat" and not begin:
                one, begin = pixels, at + 8
            elif kind == b"mdat" or (uuid == manifest.UUID and "c2pa" in removed):
                one = b""
            elif kind == b"meta" and meta[1] == low + size:
                one = tables
            else:
                one = content[low : low + size] if n + 1 < len(top) else _sized(content[low : low + size], kind)
            out.append(one)
            at += len(one)
        if not begin and areas[0].size:
            out.append(pixels)
            begin = at + 8
        return out, begin

    _, start = layout(0)
    return b"".join(layout(start)[0]), lost


def _sized(raw: bytes, kind: bytes) -> bytes:
    """The last box of a file, with its size written where it said "to the end"."""
    return struct.pack(">I", len(raw)) + raw[4:] if raw[:4] == bytes(4) else raw


_LOST = "array<struct<category:string,label:string,bytes:long>>"


def clean(files: DataFrame, removed: frozenset[str]) -> DataFrame:
    """file_id, content, lost, reason: each file without the removed categories, or why it can't be written.

    A null or broken file has no content and the reason ``corrupt-container``.
    """

    def run(content: bytes) -> Iterator[tuple]:
        try:
            fresh, lost = without(content, removed)
            names = ("category", "label", "bytes")
            yield fresh, [dict(zip(names, one, strict=True)) for one in lost], None
        except Refused as e:
            yield None, None, str(e)
        except (ValueError, IndexError, struct.error):
            yield None, None, "corrupt-container"

    return walk.rows_of(files, run, f"content binary, lost {_LOST}, reason string").drop("ord")


def _meta_bodies(content: bytes, kind: bytes, within: bytes | None = None) -> Iterator[bytes]:
    for _, form, at, head, size, _ in heif.boxes_of(content):
        if form.encode("latin-1") == (within or kind):
            if not within:
                yield content[at + head : at + size]
            else:
                yield from (content[a:b] for k, a, b in _children(content, at + head, at + size) if k == kind)


def references(files: DataFrame) -> DataFrame:
    """One row per reference between items: type, from_id, to_id."""
    run = lambda content: ((k.decode("latin-1"), a, b) for body in _meta_bodies(content, b"iref") for k, a, to in references_of(body) for b in to)
    return walk.rows_of(files, run, "type string, from_id long, to_id long")


def associations(files: DataFrame) -> DataFrame:
    """One row per property of an item: item_id, property (counted from 1), essential, type and the property's data."""

    def run(content: bytes) -> Iterator[tuple]:
        held = [(k, content[a:b]) for _, form, at, head, size, _ in heif.boxes_of(content) if form == "ipco" for k, a, b in _children(content, at + head, at + size)]
        for body in _meta_bodies(content, b"ipma", b"iprp"):
            for item, marks in associations_of(body):
                for n, essential in marks:
                    kind, data = held[n - 1] if 0 < n <= len(held) else (None, None)
                    yield item, n, essential, kind.decode("latin-1") if kind else None, data

    return walk.rows_of(files, run, "item_id long, property int, essential boolean, type string, data binary")


def primary_properties(files: DataFrame) -> DataFrame:
    """file_id, width, height, bit_depth, channels, has_alpha, icc of each file's picture, by its first property of a kind."""
    mine = associations(files).join(heif.items(files).where("is_primary").select("file_id", "item_id").distinct(), ["file_id", "item_id"])
    first = lambda kind: F.min_by("data", F.when(kind, F.col("ord")))
    kind = F.col("type")
    number = lambda c, at, n: F.conv(F.hex(F.substring(c, at + 1, n)), 16, 10).cast("int")
    profile = (kind == "colr") & F.substring("data", 1, 4).isin(F.lit(b"prof"), F.lit(b"rICC"))
    held = mine.groupBy("file_id").agg(first(kind == "ispe").alias("_size"), first(kind == "pixi").alias("_bits"), first(kind == "av1C").alias("_av1"), first(profile).alias("_icc"), F.max(kind == "auxC").alias("_own_alpha"))
    helpers = associations(files).where(kind == "auxC").groupBy("file_id").agg(F.lit(True).alias("_alpha"))
    high, twelve = (number(F.col("_av1"), 2, 1).bitwiseAND(bit) > 0 for bit in (0x40, 0x20))
    by_codec = F.when(~high, 8).when(twelve, 12).otherwise(10)
    return held.join(helpers, "file_id", "left").select(
        "file_id",
        number(F.col("_size"), 4, 4).alias("width"),
        number(F.col("_size"), 8, 4).alias("height"),
        F.coalesce(number(F.col("_bits"), 5, 1), by_codec).alias("bit_depth"),
        number(F.col("_bits"), 4, 1).alias("channels"),
        F.coalesce("_own_alpha", F.lit(False)).__or__(F.coalesce("_alpha", F.lit(False))).alias("has_alpha"),
        F.substring("_icc", F.lit(5), F.length("_icc")).alias("icc"),
    )


def relocations(items: DataFrame, removed: frozenset[str]) -> DataFrame:
    """The same move as rows, for analytics: file_id, item_id, bytes and each kept item's start behind the others."""
    before = Window.partitionBy("file_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    kept = items.where(~F.col("category").isin(*removed) | F.col("is_primary")) if removed else items
    return kept.select("file_id", "ord", "item_id", "bytes", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))
