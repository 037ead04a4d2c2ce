"""The rules of the column expressions on plain values, for walks that decide about bytes where they are."""

from __future__ import annotations

import re

from shutterlake.functions import signals, text, xmp

_EDGES = "".join(map(chr, [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
_STRONG, _WEAK = ([re.compile(p) for p in found] for found in (signals.STRONG, signals.WEAK))
_CP1252 = str.maketrans({chr(k): v for k, v in text.C1.items()})


def strip(words: str) -> str:
    return words.strip("\0").strip(_EDGES)


def trim(words: str) -> str:
    return words.strip(_EDGES)


def utf8(data: bytes) -> str:
    return data.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")


def latin1(data: bytes) -> str:
    return data.decode("latin-1").translate(_CP1252)


def utf8_or_latin1(data: bytes) -> str:
    try:
        return strip(data.removeprefix(b"\xef\xbb\xbf").decode("utf-8"))
    except UnicodeDecodeError:
        return strip(latin1(data))


def utf16(data: bytes, little: bool) -> str:
    return data[: len(data) // 2 * 2].decode("utf-16-le" if little else "utf-16-be", "replace")


def user_comment(data: bytes) -> str:
    kind, rest = data[:8], data[8:]
    if kind.startswith(b"ASCII") and len(kind) == 8:
        return strip(utf8(rest))
    if kind.startswith(b"UNICODE") and len(kind) == 8:
        marked = rest[:2] in (b"\xff\xfe", b"\xfe\xff")
        return strip(utf16(rest[2:] if marked else rest, rest[:2] == b"\xff\xfe"))
    if kind.startswith(b"JIS") and len(kind) == 8:
        return strip(latin1(rest))
    return utf8_or_latin1(data)


_CONTROLS = re.compile(r"[\x00-\x08\x0B-\x1F\x7F-\x9F]")


def sanitized(words: str | None, most: int) -> str | None:
    """``labels.sanitize``; null for what is empty."""
    clean = trim(_CONTROLS.sub("", (words or "").replace("\r\n", "\n").replace("\r", "\n")))
    return (clean[:most] + "…" if len(clean) > most else clean) or None


def sniff(content: bytes) -> str:
    """``binary.detect_format``."""
    if len(content) < 12:
        return "unknown"
    for lead, name in ((b"\xff\xd8\xff", "jpeg"), (b"\x89PNG\r\n\x1a\n", "png")):
        if content.startswith(lead):
            return name
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
        return "webp"
    if content[4:8] == b"ftyp":
        end = min(int.from_bytes(content[:4], "big"), len(content))
        brands = {content[8:12], *(content[i : i + 4] for i in range(16, end - 3, 4))}
        if brands & {b"avif", b"avis"}:
            return "avif"
        if brands & {b"heic", b"heix", b"heim", b"heis", b"hevc", b"mif1", b"msf1"}:
            return "heic"
    if content[:4] in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
        return "tiff"
    return "gif" if content[:4] == b"GIF8" else "bmp" if content[:2] == b"BM" else "unknown"


def signed(words: str | None) -> bool:
    """``signals.has_signature``."""
    head = (words or "")[:20000]
    return len(words or "") >= 6 and (any(p.search(head) for p in _STRONG) or sum(bool(p.search(head)) for p in _WEAK) > 1)


def generator_key(key: str | None) -> bool:
    return (key or "").strip(" ").lower() in signals.KEYS


def manifest_like(data: bytes | None) -> bool:
    """``text.looks_like_manifest``."""
    head = (data or b"")[:128]
    return len(data or b"") >= 16 and (head[4:8] == b"jumb" or -1 < head.find(b"jumb") < head.find(b"jumd"))


def packet(data: bytes) -> bytes | None:
    """``xmp.packet``."""
    start = data.find(b"<?xpacket begin")
    end = data.find(b"<?xpacket end", start) if start >= 0 else -1
    if end >= 0:
        close = data.find(b"?>", end)
        return data[start : close + 2 if close >= 0 else len(data)]
    start = data.find(b"<x:xmpmeta")
    if start >= 0:
        end = data.find(b"</x:xmpmeta>", start)
        return data[start : end + 12 if end >= 0 else len(data)]
    return data if b"<rdf:RDF" in data else None


_WITHOUT = [re.compile(xmp.forms(name)) for name in xmp.PROVENANCE]
_SPACES = [re.compile(xmp.space(name)) for name in xmp.GENERATORS]


def stripped(words: str, removed: frozenset[str]) -> tuple[str, str | None]:
    """``xmp.stripped``, and the first category that changed the packet."""
    first = None
    if "ai" in removed:
        left = xmp.without_marked(words)
        for pattern in _SPACES:
            left = pattern.sub("", left)
        first, words = "ai" if left != words else None, left
    if "c2pa" in removed:
        left = words
        for pattern in _WITHOUT:
            left = pattern.sub("", left)
        first, words = first or ("c2pa" if left != words else None), left
    return words, first
