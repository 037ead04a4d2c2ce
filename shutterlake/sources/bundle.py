"""What a file says about itself: one pass over its bytes, with every payload inside it walked in the same task.

A payload can lie in a chunk, a segment, an item, a resource inside a segment or a
tag; each is sent to the walk of its own kind. Profiles and packets that were cut
into several segments are joined first. One nested row per file leaves the task.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from shutterlake import dims
from shutterlake.functions import detect, plain
from shutterlake.sources import heif, heif_write, jpeg, manifest, png, resources, rewrite, tiff, walk, webp

#: Tags with texts that generators reuse, in the order they are looked at.
TEXTS = [("exif", 37510, "UserComment"), ("ifd0", 270, "ImageDescription"), ("ifd0", 40092, "XP:9c9c"), ("ifd0", 40091, "XP:9c9b"), ("ifd0", 40095, "XP:9c9f"), ("ifd0", 305, "Software")]
#: Names of compressions and colour models of TIFF files.
COMPRESSIONS = {1: "Uncompressed", 2: "CCITT Group 3 (1D)", 3: "CCITT Group 3", 4: "CCITT Group 4", 5: "LZW", 6: "JPEG (old style)", 7: "JPEG", 8: "Deflate (Adobe)", 32773: "PackBits", 32946: "Deflate", 34712: "JPEG 2000", 34925: "LZMA", 50000: "Zstd", 50001: "WebP"}
PHOTOMETRICS = {0: "Grayscale (white is zero)", 1: "Grayscale (black is zero)", 2: "RGB", 3: "Palette", 4: "Transparency mask", 5: "CMYK", 6: "YCbCr", 8: "CIELAB", 9: "ICCLab", 10: "ITULab", 32803: "Colour filter array", 34892: "Linear raw"}

SEGMENT = "struct<category:string,container:string,label:string,detail:string,offset:long,bytes:long,reason:string>"
SHAPE = "struct<width:long,height:long,color_space:string,bit_depth:int,channels:int,has_alpha:boolean,animated:boolean,progressive:boolean,encoding:string>"
FINDING = "struct<source:string,bytes:long," + ",".join(f"{n}:string" for n in detect.SHAPE[:-2]) + ",loras:array<string>,control_nets:array<string>>"
COLUMNS = (
    f"container {SHAPE}, segments array<{SEGMENT}>, camera {tiff.CAMERA}, place {tiff.PLACE}, "
    "records array<struct<dataset:int,value:binary>>, icc binary, c2pa array<binary>, c2pa_labels array<string>, c2pa_location string, packets array<string>, xmp_bytes long, extended_xmp binary, "
    f"sources array<struct<origin:string,key:string,text:string,bytes:long>>, ai array<{FINDING}>, hint string, warnings array<string>, blocked string"
)
_SEGMENT, _SHAPE = (["category", "container", "label", "detail", "offset", "bytes", "reason"], ["width", "height", "color_space", "bit_depth", "channels", "has_alpha", "animated", "progressive", "encoding"])


class Bundle:
    """The payloads of a file by kind, in the order they lie in it."""

    def __init__(self) -> None:
        self.shape: dict = {}
        self.segments: list[dict] = []
        self.exif: list[bytes] = []
        self.entries: dict[bytes, list[tuple]] = {}
        self.iptc: list[bytes] = []
        self.icc: list[bytes] = []
        self.c2pa: list[bytes] = []
        self.packets: list[str] = []
        self.sources: list[dict] = []
        self.warnings: list[str] = []
        self.location: str | None = None
        self.hint: str | None = None
        self.blocked: str | None = None
        self.xmp_bytes = 0
        self.extended: bytes | None = None

    def segment(self, *values) -> None:
        self.segments.append(dict(zip(_SEGMENT, values, strict=True)))

    def xmp(self, data: bytes, size: int, whole: bool = False) -> None:
        found = plain.packet(data)
        if found is not None or whole:
            self.packets.append(plain.utf8(data if found is None else found))
            self.xmp_bytes += size

    def signed(self, data: bytes, where: str) -> None:
        self.c2pa.append(data)
        self.location = where

    def text(self, origin: str, key: str | None, words: str, size: int) -> None:
        if plain.trim(words):
            self.sources.append({"origin": origin, "key": key, "text": words, "bytes": size})

    def entries_of(self, payload: bytes) -> list[tuple]:
        """A payload's entries, walked once."""
        if payload not in self.entries:
            self.entries[payload] = tiff.entries_of(payload)
        return self.entries[payload]

    def exif_texts(self, origin: str) -> None:
        """Fields of every EXIF payload that a generator may have written its settings into."""
        for payload in self.exif:
            rows = self.entries_of(payload)
            for kind, tag, key in TEXTS:
                value = next((r[6] for r in rows if (r[2], r[3]) == (kind, tag)), None)
                if value is not None:
                    self.text(f"{origin}:{key}", key, tiff.entry_text_of(tag, value), len(value))

    def packet_texts(self, origin: str) -> None:
        for packet in self.packets:
            self.sources.append({"origin": origin, "key": "xmp", "text": packet, "bytes": len(packet)})

    def row(self) -> tuple:
        camera = place = None
        if self.exif:
            camera, place = tiff.camera_of(self.entries_of(self.exif[0]))
            if self.exif[0][:4] not in (b"II*\0", b"MM\0*"):
                self.warnings.append("EXIF could not be read (no TIFF header); it will still be removed")
        records = [{"dataset": d, "value": v} for payload in self.iptc for n, d, v in resources.records_of(payload) if n == 2]
        labels = [one for payload in self.c2pa for one in manifest_labels(payload)]
        shape = {n: self.shape.get(n) for n in _SHAPE}
        return shape, self.segments, camera, place, records, next(iter(self.icc), None), self.c2pa, list(dict.fromkeys(labels)), self.location, self.packets, self.xmp_bytes, self.extended, self.sources, detect.findings(self.sources), self.hint, self.warnings, self.blocked


def manifest_labels(payload: bytes) -> list[str]:
    """Labels of a manifest's boxes, inner boxes first."""
    found = [(at + size, -depth, label) for depth, _, at, size, label in manifest.boxes_of(payload) if label]
    return [label for *_, label in sorted(found)]


def _joined(chunks: list[tuple[int, int, bytes]]) -> bytes:
    """Numbered pieces as one, by number if each of them is there once, else in the order of the file."""
    numbers = sorted(n for n, _, _ in chunks)
    if numbers == list(range(1, len(chunks) + 1)):
        chunks = sorted(chunks, key=lambda c: c[0])
    return b"".join(data for _, _, data in chunks)


def _of_jpeg(content: bytes) -> Bundle:
    b, parts = Bundle(), list(jpeg.parts_of(content))
    components, transform = jpeg.colour_of(parts)
    profile: list[tuple[int, int, bytes]] = []
    extended: list[tuple[int, bytes]] = []
    frame = None
    for marker, at, size, head, raw in parts:
        if marker is None or marker in jpeg.STANDALONE:
            continue
        payload = raw[head:]
        category, label = jpeg.class_of(marker, payload)
        name = f"APP{marker - 0xE0}" if 0xE0 <= marker <= 0xEF else "COM" if marker == jpeg.COM else f"0xFF{marker:02X}"
        needed = label == "Adobe colour transform" and not (components == 3 and transform == 1)
        b.segment(category, name, label, None, at, size, "Required for correct colour decoding" if needed else None)
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(payload) >= 6:
            frame = marker, payload
        if marker == jpeg.COM:
            b.text("JPEG COM", "comment", plain.latin1(payload), len(payload))
        elif label == "EXIF":
            if len(payload) >= 14:
                b.exif.append(payload[6:])
            else:
                b.warnings.append("The EXIF segment is too short to contain a TIFF header")
        elif label == "XMP":
            b.xmp(payload[29:], size)
        elif label == "XMP (extended)":
            b.xmp_bytes += size
            if len(payload) > 75:  # identifier, a GUID of 32, whole length, place
                extended.append((int.from_bytes(payload[71:75], "big"), payload[75:]))
        elif label == "ICC colour profile" and len(payload) > 14:
            profile.append((payload[12], payload[13], payload[14:]))
        elif label in ("C2PA manifest (JUMBF)", "JPEG universal box") and len(payload) > 8:
            b.signed(payload[8:], "JPEG APP11 (JUMBF)")
        elif label == "Photoshop / IPTC resources":
            for kind, _, _, data in resources.resources_of(payload):
                if kind == 0x0404:
                    b.iptc.append(data)
                elif kind == 0x0424:
                    b.xmp(data, len(data))
                elif kind == 0x040F:
                    b.icc.append(data)
    if profile:
        b.icc.append(_joined(profile))
    if extended:
        b.extended = b"".join(data for _, data in sorted(extended))
    if frame:
        marker, payload = frame
        space = {1: "Grayscale", 3: "RGB" if transform == 0 else "YCbCr", 4: "YCCK" if transform == 2 else "CMYK"}.get(payload[5])
        b.shape = {"width": payload[3] * 256 + payload[4], "height": payload[1] * 256 + payload[2], "color_space": space, "bit_depth": payload[0], "channels": payload[5], "has_alpha": False, "animated": False, "progressive": marker in (0xC2, 0xC6, 0xCA, 0xCE), "encoding": dims.FRAMES.get(marker)}
    b.exif_texts("JPEG EXIF")
    b.packet_texts("JPEG XMP")
    return b


def _of_png(content: bytes) -> Bundle:
    b, chunks = Bundle(), png.chunks_of(content)
    for kind, at, size, ok, data in chunks:
        base = png.category_of(kind, data)
        if not ok:
            b.warnings.append(f"The {kind} chunk has a wrong checksum")
        if base == "structural":
            continue
        keyword, _, words, error = png.text_of(kind, data) if kind in png.TEXTS or kind == "iCCP" else (None,) * 4
        # a packet keeps its chunk's own category in the report
        own = "ai" if rewrite.png_category(kind, data) == "ai" else base
        detail = None
        if kind == "eXIf":
            b.exif.append(data)
        elif kind == "caBX":
            b.signed(data, "PNG caBX (JUMBF)")
        elif kind == "iCCP":
            if error:
                b.warnings.append(f"The iCCP chunk could not be decompressed: {error}")
            end = data.find(b"\0", 0, 80)
            found = png.inflated(data[end + 2 :])[0] if end >= 0 and data[end + 1 : end + 2] == b"\0" else b""
            if found:
                b.icc.append(found)
            detail = keyword or None
        elif keyword is not None:
            if error:
                b.warnings.append(f'The {kind} chunk "{keyword}" could not be read: {error}')
            if keyword == png.XMP_KEY.decode():
                b.xmp((words or "").encode("utf-8", "replace"), size)
                detail = "XMP packet"
            else:
                b.text(f"PNG {kind}:{keyword}", keyword, words or "", size)
                if keyword.lower() == "software":
                    b.hint = plain.trim(words or "") or b.hint
                start = plain.trim(words or "")[:60]
                detail = (f"{keyword}: {start}{'…' if len(words or '') > 60 else ''}" if start else keyword) or None
        b.segment(own, kind, png.LABELS.get(kind, f"{kind} chunk"), detail, at, size, None)
    first = lambda wanted: next((d for k, _, _, _, d in chunks if k == wanted), None)
    header, film = first("IHDR"), first("acTL")
    if header and len(header) >= 13:
        width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", header[:13])
        name, channels = png.COLORS.get(colour, (f"Colour type {colour}", 1))
        encoding = f"APNG, {int.from_bytes(film[:4], 'big') if len(film) >= 4 else '?'} frames" if film is not None else "Adam7 interlaced" if laced == 1 else "Deflate"
        b.shape = {"width": width, "height": height, "color_space": name, "bit_depth": depth, "channels": channels, "has_alpha": colour in (4, 6), "animated": film is not None, "progressive": laced == 1, "encoding": encoding}
    if chunks and chunks[-1][0] != "IEND":
        b.warnings.append("No IEND chunk was found; the file may be truncated")
    elif chunks and chunks[-1][1] + chunks[-1][2] < len(content):
        b.warnings.append(f"{len(content) - chunks[-1][1] - chunks[-1][2]} byte(s) follow IEND and were discarded")
    b.exif_texts("PNG eXIf")
    return b


def _of_webp(content: bytes) -> Bundle:
    b, chunks = Bundle(), webp.chunks_of(content)
    for kind, at, size, data in chunks:
        if kind in webp.PICTURE:
            continue
        b.segment(webp.SWITCHES.get(kind, "other"), kind.strip(), webp.LABELS.get(kind, f"{kind.strip()} chunk"), None, at, size, None)
        if kind == "EXIF":
            b.exif.append(data)
        elif kind == "XMP ":
            b.xmp(data, size)
        elif kind == "ICCP":
            b.icc.append(data)
        elif kind == "C2PA":
            b.signed(data, "WebP C2PA chunk (JUMBF)")
    b.shape = webp.shape_of(chunks)
    b.exif_texts("WebP EXIF")
    b.packet_texts("WebP XMP")
    return b


def _of_tiff(content: bytes) -> Bundle:
    b, tree = Bundle(), tiff.Tree(content)
    if not tree.rows:
        raise ValueError("no readable directory")
    b.exif.append(content)
    for row in tree.rows:
        steps = row["path"].split("/")
        page = int(steps[0])
        name = "/".join([f"IFD{page}", *(tiff.POINTERS[int(s.split(".")[0])] for s in steps[1:])])
        tag, value = row["tag"], row["value"]
        category = tiff.class_of(row["kind"], tag, row["type"], value, embedded=False)
        if category == "structural":
            continue
        below = tree.below(row)
        told = f"{sum(len(tree.tables[p]) for p in below)} nested tag(s)" if below else f"{len(value)} byte(s)"
        if row["type"] == 2:
            told = plain.strip(plain.latin1(value))[:80] or None
        b.segment("exif" if category == "gps" else category, name, dims.tag_name(tag, row["kind"] == "gps"), told, row["value_offset"], tree.size(row), None)
        if tag == 700:
            b.xmp(value, len(value))
        elif tag == 33723:
            b.iptc.append(value)
        elif tag == 34675:
            b.icc.append(value)
        elif tag == 52545 or plain.manifest_like(value):
            b.signed(value, "TIFF private tag (JUMBF)")
    pages = {r["path"] for r in tree.rows if "/" not in r["path"]}
    if len(pages) > 1:
        b.warnings.append(f"This TIFF holds {len(pages)} directories; every page is preserved with its pixel data")

    def number(tag: int) -> int | None:
        row = next((r for r in tree.tables.get("0", []) if r["tag"] == tag), None)
        found = tiff.numbers_of(row["value"], row["type"], row["little"]) if row else None
        return int(found[0]) if found else None

    colour, compression, samples = number(262), number(259), number(277)
    b.shape = {"width": number(256), "height": number(257), "color_space": None if colour is None else PHOTOMETRICS.get(colour, f"Photometric {colour}"), "bit_depth": number(258), "channels": samples, "has_alpha": (samples or 0) > 3 or colour == 4, "animated": False, "progressive": False, "encoding": None if compression is None else COMPRESSIONS.get(compression, f"Compression {compression}")}
    b.exif_texts("TIFF")
    return b


def _of_items(content: bytes, form: str) -> Bundle:
    b, kind = Bundle(), form.upper()
    boxes = list(heif.boxes_of(content))
    for depth, name, at, head, size, uuid in boxes:
        if depth == 0 and uuid == manifest.UUID:
            b.segment("c2pa", "uuid", "C2PA manifest (BMFF uuid box)", None, at, size, None)
            b.signed(content[at + head : at + size], f"{kind} uuid box (JUMBF)")
    if not any(depth == 0 and name == "meta" for depth, name, *_ in boxes):
        b.warnings.append("No metadata box was found in this file")
    sizes = heif_write.entry_sizes(content)
    for item, name, own, mime, _, size, extents, _, data in heif.items_of(content):
        category, label = heif_write.class_of(name, mime, data)
        if category is None:
            continue
        whole = size + sizes.get(item, 0)
        b.segment(category, name or "item", label, own or mime, extents[0][0] if extents else 0, whole, None)
        if data is None:
            b.warnings.append(f"Item {item} ({label}) could not be located")
        elif category == "exif":
            start = 4 + int.from_bytes(data[:4], "big")
            if len(data) >= 8 and start + 8 <= len(data):
                b.exif.append(data[start:])
            else:
                b.warnings.append("The EXIF item does not contain a readable TIFF header")
        elif category == "xmp":
            b.xmp(data, whole, whole=True)
        elif category == "c2pa":
            b.signed(data, f"{kind} metadata item (JUMBF)")
    brands = heif_write.brands_of(content)
    shape, profile = heif_write.shape_of(content, boxes)
    if profile:
        at, size, data = profile
        b.icc.append(data)
        b.segment("icc", "colr", "ICC colour profile", None, at, size, None)
    b.shape = shape | {"color_space": "Monochrome" if shape.get("channels") == 1 else "YCbCr", "animated": "avis" in brands or "msf1" in brands, "progressive": False, "encoding": f"Brands: {', '.join(brands[:4])}" if brands else None}
    b.blocked = heif_write.refusal(content)
    b.exif_texts(f"{kind} EXIF")
    b.packet_texts(f"{kind} XMP")
    return b


WALKS: dict[str, Callable[..., Bundle]] = {"jpeg": _of_jpeg, "png": _of_png, "webp": _of_webp, "tiff": _of_tiff}


def bundle_of(content: bytes, form: str) -> Bundle:
    """The bundle of a readable format; a file that can't be read is a ValueError."""
    return WALKS[form](content) if form in WALKS else _of_items(content, form)


BROKEN = (ValueError, IndexError, KeyError, struct.error, RecursionError)
_FIELDS = [part.split()[0] for part in COLUMNS.split(", ")]


def as_struct(content: bytes, form: str) -> tuple[dict | None, str | None]:
    """(COLUMNS by name, None), or (None, why the file can't be read)."""
    try:
        return dict(zip(_FIELDS, bundle_of(content, form).row(), strict=True)), None
    except BROKEN as e:
        return None, str(e)


STRUCT = "struct<" + ",".join(p.replace(" ", ":", 1) for p in COLUMNS.split(", ")) + ">"
#: Formats with a byte-level cleaner.
READABLE = ["jpeg", "png", "webp", "avif", "heic", "tiff"]
KEYS = "format string, original_size long, error string, message string"


def gated(content: bytes) -> tuple[str, int, str | None, str | None]:
    """(format, size, error, message): what can't be read says why; the first reason counts."""
    form, size = plain.sniff(content), len(content)
    error = "empty-file" if not size else "corrupt-container" if size < dims.LEAST_BYTES else "too-large" if size > dims.MOST_BYTES else None if form in READABLE else "unsupported-format"
    message = dims.ERRORS.get(error)
    if error == "unsupported-format" and form in ("gif", "bmp"):
        message = f"{form.upper()} is not supported. Convert it to PNG or JPEG first."
    return form, size, error, message


ROW = f"{KEYS}, bundle {STRUCT}, why string"


def as_row(content: bytes) -> tuple:
    """ROW of a file."""
    form, size, error, message = gated(content)
    found, why = (None, None) if error else as_struct(content, form)
    return form, size, error, message, found, why


def bundles(files: DataFrame) -> DataFrame:
    """file_id, KEYS, bundle (COLUMNS as one struct) and why, one row for each (file_id, content); files with an error have no bundle."""

    def run(content: bytes) -> Iterator[tuple]:
        yield as_row(content)

    return walk.rows_of(files, run, ROW).drop("ord")
