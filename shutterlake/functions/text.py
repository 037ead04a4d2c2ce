"""Byte strings of metadata fields as text, in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What windows-1252 has at 0x80 to 0x9F where it differs from latin-1.
C1 = {0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ"}
_EDGE = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def once(value: Column, used: Callable[[Column], Column]) -> Column:
    """``used(value)``, the value computed once however often it is read; no Python function may be inside.

    A column expression that is read several times is copied into each place, and one
    that is read inside a lambda is computed for each element.
    """
    return F.get(F.transform(F.array(value), used), F.lit(0))


def some(words: Column) -> Column:
    """Null for an empty text, which is computed once."""
    return once(words, lambda w: F.nullif(w, F.lit("")))


def strip(text: Column) -> Column:
    """No NULs, then no white space, at both ends."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^\x00+|\x00+\z", ""), rf"^{_EDGE}", "")
    return F.regexp_replace(bare, rf"{_EDGE}\z", "")


def trim(words: Column) -> Column:
    """No white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(words, rf"^{_EDGE}", ""), rf"{_EDGE}\z", "")


def utf8(data: Column) -> Column:
    """Bad bytes become U+FFFD; a leading byte order mark goes."""
    return F.regexp_replace(F.make_valid_utf8(data.cast("string")), r"^\x{FEFF}", "")


def latin1(data: Column) -> Column:
    """Windows-1252, as platforms read ``iso-8859-1``."""
    return F.translate(F.decode(data, "ISO-8859-1"), "".join(map(chr, C1)), "".join(C1.values()))


def utf8_or_latin1(data: Column) -> Column:
    return strip(F.coalesce(F.regexp_replace(F.try_validate_utf8(data.cast("string")), r"^\x{FEFF}", ""), latin1(data)))


def utf16(data: Column, little: bool) -> Column:
    """Whole units only; an odd last byte is not read."""
    whole = F.substring(data, F.lit(1), (F.length(data) / 2).cast("int") * 2)
    return F.decode(whole, "UTF-16LE" if little else "UTF-16BE")


def user_comment(data: Column) -> Column:
    """A field whose first eight bytes name its character set."""
    kind, rest = F.substring(data, 1, 8), F.substring(data, F.lit(9), F.length(data))
    mark, body = F.substring(rest, 1, 2), F.substring(rest, F.lit(3), F.length(rest))
    wide = F.when(mark == F.unhex(F.lit("FFFE")), utf16(body, True)).when(mark == F.unhex(F.lit("FEFF")), utf16(body, False)).otherwise(utf16(rest, False))
    named = lambda word: F.substring(kind, 1, len(word)) == F.lit(word.encode())
    return F.when(F.length(data) < 8, utf8_or_latin1(data)).when(named("ASCII"), strip(utf8(rest))).when(named("UNICODE"), strip(wide)).when(named("JIS"), strip(latin1(rest))).otherwise(utf8_or_latin1(data))


def looks_like_manifest(data: Column) -> Column:
    """A ``jumb`` box at the start, or one before a ``jumd`` in the first 128 bytes."""
    head = F.hex(F.substring(data, 1, 128))
    outer, inner = (F.regexp_instr(head, F.lit(rf"^(?:..)*?{w.encode().hex().upper()}")) for w in ("jumb", "jumd"))
    at = lambda w: F.length(F.regexp_extract(head, rf"^((?:..)*?){w.encode().hex().upper()}", 1))
    early = (outer > 0) & (inner > 0) & (at("jumb") < at("jumd"))
    return F.coalesce((F.length(data) >= 16) & ((F.substring(data, 5, 4) == F.lit(b"jumb")) | early), F.lit(False))
