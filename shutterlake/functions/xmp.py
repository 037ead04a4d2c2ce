"""XMP packets: finding them, reading properties, and taking properties out."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from shutterlake.functions import labels, signals
from shutterlake.functions import text as texts

#: What links a packet to a signed manifest.
LINKS = ["c2pa", "contentauth", "dcterms:provenance", "xmpmm:manifest", "cai:"]
#: Properties that go with provenance, and those that may hold settings of a generator.
PROVENANCE = ["dcterms:provenance", "xmpMM:Manifest", "c2pa:manifest"]
SHARED = ["exif:UserComment", "dc:description", "dc:title", "xmp:CreatorTool", "tiff:ImageDescription", "photoshop:Instructions"]
#: Name spaces that only generators write.
GENERATORS = ["sdxl", "comfy", "invokeai", "novelai", "fooocus", "stableDiffusion"]
#: Named entities but the ampersand, which comes last.
_NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}


def packet(content: Column) -> Column:
    """Bytes of the packet: between its processing instructions, else the meta element, else all that holds RDF."""
    hexed = F.hex(content)
    hx = lambda s: s.encode().hex().upper()
    pairs = r"(?:..)*?"
    wrapped = F.regexp_extract(hexed, rf"^{pairs}({hx('<?xpacket begin')}{pairs}{hx('<?xpacket end')}(?:{pairs}{hx('?>')}|(?:..)*))", 1)
    meta = F.regexp_extract(hexed, rf"^{pairs}({hx('<x:xmpmeta')}(?:{pairs}{hx('</x:xmpmeta>')}|(?:..)*))", 1)
    bare = F.when(F.position(F.lit(b"<rdf:RDF"), content) > 0, content)
    return F.when(wrapped != "", F.unhex(wrapped)).when(meta != "", F.unhex(meta)).otherwise(bare)


def _character(entity: Column) -> Column:
    """The character of a numeric entity; U+FFFD where there is none of that number."""
    hexed = F.lower(F.substring(entity, 3, 1)) == "x"
    digits = F.regexp_replace(entity, r"^&#[xX]?0*|;\z", "")
    number = F.coalesce(F.nullif(digits, F.lit("")), F.lit("0"))
    known = F.when(F.length(digits) <= 7, F.when(hexed, F.conv(number, 16, 10)).otherwise(number).cast("long"))
    valid = lambda n: (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
    pair = lambda n: F.concat(F.hex(F.shiftright(n - 0x10000, 10) + 0xD800), F.hex((n - 0x10000).bitwiseAND(1023) + 0xDC00))
    units = lambda n: F.when(n < 0x10000, F.lpad(F.hex(n), 4, "0")).otherwise(pair(n))
    return texts.once(known, lambda n: F.when(valid(n), F.decode(F.unhex(units(n)), "UTF-16BE")).otherwise(F.lit("\ufffd")))


_ENTITY = "&#(?:[xX][0-9a-fA-F]+|[0-9]+);"


def _numeric_entities(text: Column) -> Column:
    between = lambda t: F.split(t, _ENTITY, -1)
    met = lambda t: F.transform(F.regexp_extract_all(t, F.lit(_ENTITY), 0), _character)
    joined = lambda t: F.array_join(F.zip_with(between(t), met(t), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return texts.once(text, lambda t: F.when(t.contains("&#"), joined(t)).otherwise(t))


def unescape(text: Column) -> Column:
    """Entities once; ``&amp;`` last, so what was escaped twice stays escaped once."""
    for entity, plain in _NAMED.items():
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.replace(_numeric_entities(text), F.lit("&amp;"), F.lit("&"))


def _element(name: str) -> str:
    return rf"(?is)<{re.escape(name)}[^>]*>(.*?)</{re.escape(name)}>"


def _plain(text: Column) -> Column:
    return texts.some(F.regexp_replace(F.regexp_replace(unescape(F.regexp_replace(text, "<[^>]*>", "")), r"^\s+", ""), r"\s+\z", ""))


def read(xmp: Column, name: str) -> Column:
    """A property as attribute or element; of a list its first item. Null where absent or empty."""
    quoted = lambda q: texts.some(F.regexp_extract(xmp, rf"(?i){re.escape(name)}\s*=\s*{q}([^{q}]*){q}", 1))
    item = lambda inner: texts.some(F.regexp_extract(inner, r"(?is)<rdf:li[^>]*>(.*?)</rdf:li>", 1))
    inner = texts.once(F.regexp_extract(xmp, _element(name), 1), lambda x: F.coalesce(item(x), F.nullif(x, F.lit(""))))
    # most properties are absent, which costs less to see than four patterns
    return F.when(F.lower(xmp).contains(name.lower()), _plain(F.coalesce(quoted('"'), quoted("'"), inner)))


def read_list(xmp: Column, name: str) -> Column:
    """Every item of a property, without tags; empty ones are left out."""
    items = F.regexp_extract_all(F.regexp_extract(xmp, _element(name), 1), F.lit(r"(?is)<rdf:li[^>]*>(.*?)</rdf:li>"), 1)
    # entities are decoded in the joined text, since a Python function takes no lambda variable
    joined = unescape(F.array_join(F.transform(items, lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", ""))), "\x00"))
    return F.filter(F.split(joined, "\x00"), lambda x: x != "")


def has_provenance(xmp: Column) -> Column:
    return F.lower(xmp).rlike("|".join(map(re.escape, LINKS)))


def summary(xmp: Column) -> Column:
    """Fields of a packet (or of packets joined by line ends), each by its first source."""
    first = lambda *names: F.coalesce(*(read(xmp, n) for n in names))
    return F.struct(
        read(xmp, "x:xmptk").alias("toolkit"),
        first("dc:creator", "xmp:CreatorTool", "photoshop:Credit").alias("creator"),
        read(xmp, "dc:rights").alias("rights"),
        read(xmp, "dc:title").alias("title"),
        labels.sanitize(first("dc:description", "exif:UserComment"), 600).alias("description"),
        first("xmp:CreateDate", "photoshop:DateCreated").alias("created"),
        first("xmpMM:DocumentID", "xmpMM:OriginalDocumentID").alias("document_id"),
        has_provenance(xmp).alias("has_provenance"),
    )


def forms(name: str) -> str:
    n = re.escape(name)
    return rf"(?is)\s*<{n}(?:\s[^>]*)?/>|\s*<{n}(?:\s[^>]*)?>.*?</{n}>|\s+{n}\s*=\s*(?:\"[^\"]*\"|'[^']*')"


def without(xmp: Column, *names: str) -> Column:
    """No property of these names, as element or attribute."""
    for name in names:
        xmp = F.regexp_replace(xmp, forms(name), "")
    return xmp


def without_provenance(xmp: Column) -> Column:
    return without(xmp, *PROVENANCE)


_STRONG, _WEAK = ([re.compile(p) for p in found] for found in (signals.STRONG, signals.WEAK))
_SHARED = re.compile("|".join(f"(?:{forms(n).removeprefix('(?is)')})" for n in SHARED), re.I | re.S)
_SOURCE = re.compile(forms("Iptc4xmpExt:DigitalSourceType"))


def without_marked(words: str) -> str:
    """Shared properties go only where their own text has a signature."""

    def marked(m: re.Match) -> str:
        head = m[0][:20000]
        return "" if any(p.search(head) for p in _STRONG) or sum(bool(p.search(head)) for p in _WEAK) > 1 else m[0]

    return _SOURCE.sub(lambda m: "" if "algorithmicmedia" in m[0].lower() else m[0], _SHARED.sub(marked, words))


@F.pandas_udf(StringType())
def _without_marked(texts: pd.Series) -> pd.Series:
    """Spark's replace takes no condition."""
    return texts.map(lambda t: t if t is None else without_marked(t))


def space(name: str) -> str:
    """Every element of a name space."""
    return rf"(?is)\s*<{name}:[\w.-]+(?:\s[^>]*)?(?:/>|>.*?</{name}:[\w.-]+>)"


def without_generator(xmp: Column) -> Column:
    """No settings of a generator: marked shared properties, its source type, and its name spaces."""
    xmp = _without_marked(xmp)
    for name in GENERATORS:
        xmp = F.regexp_replace(xmp, space(name), "")
    return xmp


def stripped(xmp: Column, removed: frozenset[str]) -> Column:
    """A packet that stays, without what the removed categories ``ai`` and ``c2pa`` cover in it."""
    xmp = without_generator(xmp) if "ai" in removed else xmp
    return without_provenance(xmp) if "c2pa" in removed else xmp
