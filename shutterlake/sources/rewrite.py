"""Files cleaned where they are read: parsed, decided and put together by one task, row by row.

No bytes are shuffled. ``contents`` and ``results`` run ``rewritten`` over Arrow
batches; what a file lost, what had to stay and why come along as nested columns.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from shutterlake.functions import plain
from shutterlake.sources import heif_write, jpeg, png, resources, tiff, walk, webp

_MOST_SEGMENT = 0xFFFF - 2


@dataclass
class Result:
    """A written file, {category: [bytes, n]} of what went, (label, bytes, reason) of what had to stay, and warnings."""

    content: bytes
    removed: dict[str, list[int]] = field(default_factory=dict)
    preserved: list[tuple[str, int, str]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def lose(self, category: str, size: int, n: int = 1) -> None:
        tally = self.removed.setdefault(category, [0, 0])
        tally[0] += size
        tally[1] += n


def dominant(lost: dict[str, list[int]]) -> str:
    """The category that lost most; the first of equal ones."""
    return max(lost, key=lambda c: lost[c][0], default="exif")


def _filtered(payload: bytes, removed: frozenset[str]) -> tuple[bytes | None, str] | None:
    """(EXIF without the entries of these categories, the category that lost most); None where nothing changes.

    The payload is None if nothing is left. A payload without a header raises ValueError.
    """
    if payload[:4] not in (b"II*\0", b"MM\0*") or len(payload) < 8:
        raise ValueError("no TIFF header")
    tree = tiff.Tree(payload)
    stay, lost = tree.without(removed, embedded=True)
    if stay is None:
        return None, "exif"
    return (tiff.write(stay), dominant(lost)) if lost else None


def _jpeg_segment(marker: int, payload: bytes) -> bytes:
    return b"\xff" + bytes([marker]) + struct.pack(">H", len(payload) + 2) + payload


def _photoshop(payload: bytes, removed: frozenset[str]) -> tuple[bytes | None, str] | None:
    """(the payload without the resources of these categories, the first that went); None where nothing changes."""
    listed = [(i, data, resources.RESOURCES.get(i, "other")) for i, _, _, data in resources.resources_of(payload)]
    gone = [c for _, _, c in listed if c in removed]
    if not listed:
        return (None, "iptc") if "iptc" in removed else None
    if not gone:
        return None
    kept = [b"8BIM" + struct.pack(">HHI", i, 0, len(data)) + data + b"\0" * (len(data) % 2) for i, data, c in listed if c not in removed]
    return resources.LEADS[0] + b"".join(kept) if kept else None, gone[0]


def _of_jpeg(content: bytes, removed: frozenset[str]) -> Result:
    parts = list(jpeg.parts_of(content))
    if not parts:
        raise ValueError("no start of image")
    components, transform = jpeg.colour_of(parts)
    out, done = [], Result(b"")
    for marker, _, size, head, raw in parts:
        if marker is None or marker in jpeg.STANDALONE:
            out.append(raw)
            continue
        payload = raw[head:]
        category, label = jpeg.class_of(marker, payload)
        switch = "other" if category == "thumbnail" else category
        if marker == jpeg.COM and plain.signed(plain.latin1(payload)):
            switch = "ai"
        # what is written in the segment's place: the same, nothing, or (payload, category)
        fresh: tuple[bytes | None, str] | None = (None, switch) if switch in removed else None
        if switch == "structural":
            fresh = None
        elif label == "Adobe colour transform" and fresh and not (components == 3 and transform == 1):
            fresh = None
            done.preserved.append((label, size, "Removing it would break CMYK/YCCK colour decoding" if components == 4 else "It declares a non-default colour transform the decoder needs"))
        elif label == "JFIF header" and fresh:
            fresh = payload[:12] + b"\0\0", "other"
        elif label == "EXIF" and not fresh and removed and len(payload) >= 14:
            try:
                found = _filtered(payload[6:], removed)
                if found:
                    fresh = (payload[:6] + found[0] if found[0] is not None else None), found[1]
                    if fresh[0] is not None and len(fresh[0]) > _MOST_SEGMENT:
                        fresh = None, "exif"
                        done.warnings.append("Rewritten EXIF exceeded the JPEG segment limit and was removed instead")
            except ValueError as e:
                fresh = None, "exif"
                done.warnings.append(f"EXIF could not be rewritten ({e}); the whole block was removed")
        elif label == "XMP" and not fresh and removed & {"ai", "c2pa"}:
            lead = len(b"http://ns.adobe.com/xap/1.0/\0")
            packet = plain.packet(payload[lead:])
            words, first = plain.stripped(plain.utf8(packet), removed) if packet else ("", None)
            fresh = (payload[:lead] + words.encode("utf-8", "replace"), first) if first else None
        elif label == "XMP (extended)" and not fresh and removed & {"ai", "c2pa"}:
            done.warnings.append("Extended XMP was kept intact: it is chunked across segments and cannot be edited in place")
        elif label == "Photoshop / IPTC resources":
            fresh = _photoshop(payload, removed)
        if fresh is None:
            out.append(raw)
        elif fresh[0] is None:
            done.lose(fresh[1], size)
        else:
            written = _jpeg_segment(marker, fresh[0])
            out.append(written if len(written) < size else raw)
            if len(written) < size:
                done.lose(fresh[1], size - len(written))
    done.content = b"".join(out)
    return done


def _png_text(kind: str, data: bytes, removed: frozenset[str]) -> tuple[bytes, str] | None:
    """A packet's chunk without what these categories cover in it; a compressed one is inflated and deflated again."""
    keyword, language, words, error = png.text_of(kind, data)
    if error or not words:
        return None
    fresh, first = plain.stripped(words, removed)
    if not first:
        return None
    body, name = fresh.encode("utf-8", "replace"), data.split(b"\0", 1)[0]
    if kind == "iTXt" and data[len(name) + 1 : len(name) + 2] == b"\1":
        return name + b"\0\1\0" + (language or "").encode() + b"\0\0" + zlib.compress(body, 9), first
    if kind == "zTXt":
        return name + b"\0\0" + zlib.compress(body, 9), first
    if kind == "iTXt":
        return name + b"\0\0\0" + (language or "").encode() + b"\0\0" + body, first
    return None


def _png_chunk(kind: str, data: bytes) -> bytes:
    raw = kind.encode("latin-1")
    return struct.pack(">I", len(data)) + raw + data + struct.pack(">I", zlib.crc32(raw + data))


def png_category(kind: str, data: bytes) -> str:
    """Category of a chunk by its type and, for texts, by what they hold."""
    base = png.category_of(kind, data)
    if base != "comment":
        return base
    keyword, _, words, _ = png.text_of(kind, data)
    if keyword == png.XMP_KEY.decode():
        return "xmp"
    return "ai" if plain.generator_key(keyword) or plain.signed(words) else "comment"


def _of_png(content: bytes, removed: frozenset[str]) -> Result:
    chunks = png.chunks_of(content)
    if not chunks:
        raise ValueError("no chunk")
    out, done = [png.SIGNATURE], Result(b"")
    for kind, _, size, _, data in chunks:
        category = png_category(kind, data)
        if category in removed:
            done.lose(category, size)
            continue
        fresh = None
        if kind == "eXIf" and removed:
            try:
                found = _filtered(data, removed)
                fresh = found and (found[0] or b"", found[1])
            except ValueError as e:
                done.warnings.append(f"The eXIf chunk could not be rewritten ({e})")
        elif category == "xmp" and removed & {"ai", "c2pa"}:
            fresh = _png_text(kind, data, removed)
        if fresh and len(fresh[0]) < len(data):
            done.lose(fresh[1], len(data) - len(fresh[0]))
            data = fresh[0]
        out.append(_png_chunk(kind, data))
    last = chunks[-1][1] + chunks[-1][2]
    if chunks[-1][0] == "IEND" and last < len(content):
        done.warnings.append(f"{len(content) - last} byte(s) follow IEND and were discarded")
        done.lose("other", len(content) - last)
    elif chunks[-1][0] != "IEND":
        done.warnings.append("No IEND chunk was found; the file may be truncated")
    done.content = b"".join(out)
    return done


def _of_webp(content: bytes, removed: frozenset[str]) -> Result:
    chunks = webp.chunks_of(content)
    if not chunks:
        raise ValueError("no chunk")
    kept, done = [], Result(b"")
    for kind, _, size, data in chunks:
        category = "structural" if kind in webp.PICTURE else webp.SWITCHES.get(kind, "other")
        if category in removed:
            done.lose(category, size)
            continue
        fresh = None
        if kind == "EXIF" and removed:
            try:
                found = _filtered(data, removed)
                fresh = found and (found[0] or b"", found[1])
            except ValueError as e:
                done.warnings.append(f"The WebP EXIF chunk could not be rewritten ({e})")
        elif kind == "XMP " and removed & {"ai", "c2pa"} and (packet := plain.packet(data)):
            words, first = plain.stripped(plain.utf8(packet), removed)
            fresh = (words.encode("utf-8", "replace"), first) if first else None
        if fresh and len(fresh[0]) < len(data):
            done.lose(fresh[1], len(data) - len(fresh[0]))
            data = fresh[0]
        kept.append((kind, data))
    types = {k for k, _ in kept}
    clear = sum(bit for k, bit in webp.FLAGS.items() if k not in types)
    body = b"WEBP"
    parts = []
    for kind, data in kept:
        if kind == "VP8X" and data:
            data = bytes([data[0] & ~clear & 0xFF]) + data[1:]
        parts.append(kind.encode("latin-1") + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2))
    body += b"".join(parts)
    done.content = b"RIFF" + struct.pack("<I", len(body)) + body
    return done


def _of_tiff(content: bytes, removed: frozenset[str]) -> Result:
    tree = tiff.Tree(content)
    if not tree.rows:
        raise ValueError("no readable directory")
    if any(r["tag"] in tiff.OLD_JPEG and "/" not in r["path"] for r in tree.rows):
        raise ValueError("This TIFF uses the deprecated JPEG-in-TIFF layout, whose table offsets cannot be relocated")
    stay, lost = tree.without(removed, embedded=False)
    done = Result(content, lost)
    if stay and lost:
        done.content = tiff.write(stay)
        # padding and gaps that the file carried go as well
        rest = len(content) - len(done.content) - sum(b for b, _ in lost.values())
        if rest > 0:
            done.lose("other", rest, 0)
    return done


def _of_items(content: bytes, removed: frozenset[str]) -> Result:
    fresh, lost = heif_write.without(content, removed)
    done = Result(fresh)
    for category, _, size in lost:
        done.lose(category, size)
    return done


WAYS = {"jpeg": _of_jpeg, "png": _of_png, "webp": _of_webp, "tiff": _of_tiff, "avif": _of_items, "heic": _of_items}


def rewritten(content: bytes, form: str, removed: frozenset[str]) -> tuple[Result | None, str | None]:
    """(the file without these categories, None), or (None, why it can't be written)."""
    if form not in WAYS:
        return None, "This container has no byte-level cleaner. Try rebuild mode."
    try:
        return WAYS[form](content, removed), None
    except heif_write.Refused as e:
        return None, f"{e}. Try rebuild mode."
    except (ValueError, IndexError, struct.error, RecursionError) as e:
        return None, f"The file could not be rebuilt: {e}"


COLUMNS = "removed array<struct<category:string,bytes:long,n:long>>, preserved array<struct<label:string,bytes:long,reason:string>>, warnings array<string>, why string"


def as_row(done: Result | None, why: str | None) -> tuple:
    """COLUMNS of a result."""
    if done is None:
        return [], [], [], why
    return [{"category": c, "bytes": b, "n": n} for c, (b, n) in done.removed.items()], [dict(zip(("label", "bytes", "reason"), p, strict=True)) for p in done.preserved], done.warnings, None


def contents(files: DataFrame, form: str, removed: frozenset[str]) -> DataFrame:
    """(file_id, content) of the files of one format that can be written."""

    def run(content: bytes) -> Iterator[tuple]:
        done, _ = rewritten(content, form, removed)
        if done is not None:
            yield (done.content,)

    return walk.rows_of(files, run, "fresh binary").selectExpr("file_id", "fresh as content")
