"""TIFF and EXIF payloads as entry rows, and back."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions import plain, signals, text
from shutterlake.sources import walk

#: Bytes of one value by field type.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
#: Tags that point at a directory, and its kind.
POINTERS = {34665: "exif", 34853: "gps", 40965: "interop", 330: "sub"}
#: Offset tags and the tags of their lengths.
BLOCKS = {273: 279, 324: 325, 513: 514, 288: 289}
#: Tags that a file needs to decode.
STRUCTURAL = [254, 255, 256, 257, 258, 259, 262, 263, 264, 265, 266, 273, 274, 277, 278, 279, 280, 281, 282, 283, 284, 286, 287, 290, 291, 292, 293, 296, 297, 301, 317, 318, 319, 320, 321, 322, 323, 324, 325, 332, 333, 334, 336, 338, 339, 340, 341, 342, 512, 515, 529, 530, 531, 532, 50706, 50707]
#: Tags that name a camera or an author, and free texts.
IDENTITY = [271, 272, 305, 306, 315, 316, 33432, 269, 285, 32781, 337, 50708, 50735, 50827, 18246, 18249]
COMMENTS = [270, 37510, 40091, 40092, 40093, 40094, 40095]
#: Tags with a category of their own.
OWN = {700: "xmp", 33723: "iptc", 34377: "iptc", 34675: "icc", 52545: "c2pa", 37500: "exif", 50341: "exif", 59932: "exif"}
#: Tables of the old JPEG-in-TIFF form, which cannot be moved.
OLD_JPEG = [519, 520, 521]
#: Fields of a camera's summary by directory kind and tag: texts, other bytes, and first numbers.
CAMERA_TEXTS = {"make": ("ifd0", 271), "model": ("ifd0", 272), "software": ("ifd0", 305), "modified": ("ifd0", 306), "artist": ("ifd0", 315), "copyright": ("ifd0", 33432), "serial": ("ifd0", 50735), "taken": ("exif", 36867), "digitized": ("exif", 36868), "owner": ("exif", 42032), "body_serial": ("exif", 42033), "lens_make": ("exif", 42035), "lens_model": ("exif", 42036), "lens_serial": ("exif", 42037)}
CAMERA_BYTES = {"_description": ("ifd0", 270), "_xp": ("ifd0", 40092), "_comment": ("exif", 37510)}
CAMERA_NUMBERS = {"_orientation": ("ifd0", 274), "_exposure": ("exif", 33434), "_f": ("exif", 33437), "_iso": ("exif", 34855), "_focal": ("exif", 37386)}
PLACE_BYTES, PLACE_NUMBERS = (1, 3, 29), (2, 4, 5, 6, 7, 17)
_STRUCTURAL = frozenset(STRUCTURAL)
_DEPTH, _ENTRIES, _CHAIN = 8, 4096, 64
_FIELDS = "path string, above array<struct<tag:int,kind:string>>, kind string, tag int, type int, count long, value binary, value_offset long, inline boolean, little boolean, children int, blocks array<binary>"
_NAMES = [part.split()[0] for part in re.sub(r"<[^>]*>+", "", _FIELDS).split(",")]


def entries_of(payload: bytes) -> list[tuple]:
    """Every readable entry of every directory; loops, cut tables and values out of range are left out."""
    little = payload[:2] == b"II"
    if payload[:4] not in (b"II*\0", b"MM\0*") or len(payload) < 8:
        return []
    end, seen, out = "<" if little else ">", set(), []

    def directory(at: int, path: str, kind: str, above: list[tuple[int, str]]) -> int | None:
        if at < 8 or at + 2 > len(payload) or at in seen or len(above) > _DEPTH:
            return None
        seen.add(at)
        (n,) = struct.unpack_from(end + "H", payload, at)
        if n > _ENTRIES:
            return None
        found = {}
        rows = []
        for field in range(at + 2, min(at + 2 + 12 * n, len(payload) - 11), 12):
            tag, form, count = struct.unpack_from(end + "HHI", payload, field)
            size = SIZES.get(form, 0) * count
            (far,) = struct.unpack_from(end + "I", payload, field + 8)
            start = field + 8 if size <= 4 else far
            if form in SIZES and start + size <= len(payload):
                rows.append((tag, form, count, payload[start : start + size], start))
                found[tag] = rows[-1]
        for row in rows:
            tag, form, count, value, start = row
            children = 0
            if tag in POINTERS:
                for i, child in enumerate(numbers_of(value, form, little)):
                    if directory(int(child), f"{path}/{tag}.{i}", POINTERS[tag], [*above, (tag, kind)]) is not None:
                        children += 1
            sized = found.get(BLOCKS.get(tag)) if row is found[tag] else None
            out.append((path, above, kind, tag, form, count, value, start, len(value) <= 4, little, children, _blocks(payload, row, sized, little)))
        tail = at + 2 + 12 * n
        return struct.unpack_from(end + "I", payload, tail)[0] if tail + 4 <= len(payload) else 0

    at = struct.unpack_from(end + "I", payload, 4)[0]
    for page in range(_CHAIN):
        after = directory(at, str(page), "page" if page else "ifd0", []) if at else None
        if after is None:
            break
        at = after
    return out


def _blocks(payload: bytes, offsets: tuple, lengths: tuple | None, little: bool) -> list[bytes] | None:
    if lengths is None:
        return None
    at, size = (numbers_of(x[3], x[1], little) for x in (offsets, lengths))
    if not at or len(at) != len(size) or any(a + n > len(payload) for a, n in zip(at, size, strict=True)):
        return None
    return [payload[int(a) : int(a + n)] for a, n in zip(at, size, strict=True)]


def numbers_of(value: bytes, form: int, little: bool) -> list[float]:
    """Numbers in a field's bytes; a rational with denominator 0 reads 0, ASCII has none."""
    code = {1: "B", 3: "H", 4: "I", 5: "I", 6: "b", 7: "B", 8: "h", 9: "i", 10: "i", 11: "f", 12: "d", 13: "I"}.get(form)
    if code is None:
        return []
    width = struct.calcsize(code)
    flat = struct.unpack(("<" if little else ">") + code * (len(value) // width), value[: len(value) // width * width])
    if form not in (5, 10):
        return list(flat)
    return [a / b if b else 0.0 for a, b in zip(flat[::2], flat[1::2], strict=False)]


def entries(payloads: DataFrame) -> DataFrame:
    """One row per entry of each (file_id, content); ``above`` are the pointers on the way to it."""
    return walk.rows_of(payloads, entries_of, _FIELDS)


def entry_text(tag: Column, value: Column) -> Column:
    return F.when(tag == 37510, text.user_comment(value)).when(tag.between(40091, 40095), text.strip(text.utf16(value, True))).otherwise(text.strip(text.latin1(value)))


def _pointer_category(tag: Column, kind: Column) -> Column:
    inner = kind.isin("exif", "interop")
    return F.when((kind == "gps") | (tag == 34853), "gps").when(inner | (tag == 34665), "exif").when(tag == 330, "structural").otherwise("other")


def classify(embedded: bool) -> Column:
    """Category of an entry; the first rule that holds counts. In a file some tags are structural."""
    tag, kind, value = F.col("tag"), F.col("kind"), F.col("value")
    rules = F.when((kind == "gps") | (tag == 34853), "gps")
    for t, category in OWN.items():
        rules = rules.when(tag == t, category)
    rules = rules.when(F.col("type").isin(1, 7) & text.looks_like_manifest(value), "c2pa")
    rules = rules.when(tag.isin(COMMENTS), F.when(signals.has_signature(entry_text(tag, value)), "ai").otherwise("comment"))
    if not embedded:
        rules = rules.when(tag.isin(STRUCTURAL), "structural").when(tag.isin(288, 289), "other")
    rules = rules.when(tag.isin(IDENTITY) | kind.isin("exif", "interop") | (tag == 34665), "exif").when(tag == 330, "structural")
    return rules.when(tag.isin(STRUCTURAL), "exif").otherwise("other") if embedded else rules.otherwise("other")


def keep(rows: DataFrame, removed: frozenset[str], embedded: bool) -> DataFrame:
    """Entries that stay: not of a removed category, nor under one, nor a pointer to nothing.

    Ancestors are judged in the row itself; only the pointers that still lead
    to an entry are found by a join, on at most eight keys a row.
    """
    goes = list(removed)
    under = F.exists("above", lambda a: _pointer_category(a["tag"], a["kind"]).isin(*goes)) if goes else F.lit(False)
    left = rows.withColumn("category", classify(embedded)).where(~under & ~F.col("category").isin(*goes) if goes else ~under)
    # a path is page/tag.child/tag.child; its prefixes before a dot name pointers
    steps = F.split("path", "/")
    named = F.transform(F.sequence(F.lit(2), F.size(steps)), lambda i: F.struct(F.array_join(F.slice(steps, 1, i - 1), "/").alias("path"), F.split_part(F.element_at(steps, i), F.lit("."), F.lit(1)).cast("int").alias("tag")))
    live = left.where("children = 0 and size(above) > 0").select("file_id", F.explode(named).alias("p")).select("file_id", "p.*").distinct()
    return left.where("children = 0").unionByName(left.where("children > 0").join(live, ["file_id", "path", "tag"], "left_semi"))


def entry_text_of(tag: int, value: bytes) -> str:
    """``entry_text`` on plain values."""
    if tag == 37510:
        return plain.user_comment(value)
    return plain.strip(plain.utf16(value, True)) if 40091 <= tag <= 40095 else plain.strip(plain.latin1(value))


def class_of(kind: str, tag: int, form: int, value: bytes, embedded: bool) -> str:
    """Category of an entry on plain values, as ``classify`` has it."""
    if kind == "gps" or tag == 34853:
        return "gps"
    if tag in OWN:
        return OWN[tag]
    if form in (1, 7) and plain.manifest_like(value):
        return "c2pa"
    if tag in COMMENTS:
        return "ai" if plain.signed(entry_text_of(tag, value)) else "comment"
    if not embedded and (tag in _STRUCTURAL or tag in (288, 289)):
        return "structural" if tag in _STRUCTURAL else "other"
    if tag in IDENTITY or kind in ("exif", "interop") or tag == 34665:
        return "exif"
    return "structural" if tag == 330 else "exif" if embedded and tag in _STRUCTURAL else "other"


CAMERA = "struct<" + ",".join([*(f"{n}:binary" for n in (*CAMERA_TEXTS, *CAMERA_BYTES)), *(f"{n}:double" for n in CAMERA_NUMBERS), "_maker:int,_thumb:double,_little:boolean,tag_count:long"]) + ">"
PLACE = "struct<" + ",".join([*(f"_v{t}:binary" for t in PLACE_BYTES), *(f"_n{t}:array<double>" for t in PLACE_NUMBERS), "tag_count:long"]) + ">"


def camera_of(rows: list[tuple]) -> tuple[dict | None, dict | None]:
    """(CAMERA, PLACE) of a payload's entries, each value by the first entry of its kind; null without entries or without a position."""
    first: dict[tuple[str, int], tuple] = {}
    for r in rows:
        first.setdefault((r[2], r[3]), r)
    value = lambda at: first[at][6] if at in first else None
    numbers = lambda r: numbers_of(r[6], r[4], r[9]) if r else None
    one = lambda r: next(iter(numbers(r) or ()), None)
    camera = {n: value(at) for n, at in (CAMERA_TEXTS | CAMERA_BYTES).items()} | {n: one(first.get(at)) for n, at in CAMERA_NUMBERS.items()}
    thumb = next((r for r in rows if r[0] == "1" and r[3] == 514), None)
    maker = value(("exif", 37500))
    camera |= {"_maker": maker and len(maker), "_thumb": one(thumb), "_little": rows[0][9] if rows else None, "tag_count": len(rows)}
    count = sum(r[2] == "gps" for r in rows)
    place = {f"_v{t}": value(("gps", t)) for t in PLACE_BYTES} | {f"_n{t}": numbers(first.get(("gps", t))) for t in PLACE_NUMBERS} | {"tag_count": count}
    return camera if rows else None, place if count else None


class Tree:
    """The entries of one payload with their directories, to be filtered and written again."""

    def __init__(self, payload: bytes):
        self.rows = [dict(zip(_NAMES, row, strict=True), ord=i) for i, row in enumerate(entries_of(payload))]
        self.tables: dict[str, list[dict]] = {}
        for row in self.rows:
            self.tables.setdefault(row["path"], []).append(row)
        self.kids: dict[str, list[str]] = {}
        for path in sorted((p for p in self.tables if "/" in p), key=lambda p: int(p.rpartition(".")[2])):
            self.kids.setdefault(path.rpartition(".")[0], []).append(path)

    def below(self, row: dict) -> list[str]:
        """Paths of the directories that an entry points at."""
        return self.kids.get(f"{row['path']}/{row['tag']}", []) if row["children"] else []

    def size(self, row: dict) -> int:
        """Bytes of an entry with its value, blocks and directories."""
        own = 12 + (0 if row["inline"] else len(row["value"])) + sum(map(len, row["blocks"] or ()))
        return own + sum(6 + sum(map(self.size, self.tables[p])) for p in self.below(row))

    def without(self, removed: frozenset[str], embedded: bool) -> tuple[list[dict] | None, dict[str, list[int]]]:
        """(entries that stay, {category: [bytes, n]} of those that went); None if nothing worth keeping is left."""
        lost: dict[str, list[int]] = {}

        def record(category: str, row: dict) -> None:
            tally = lost.setdefault(category, [0, 0])
            tally[0] += self.size(row)
            tally[1] += 1

        def left(path: str) -> list[dict]:
            out = []
            for row in self.tables[path]:
                category = class_of(row["kind"], row["tag"], row["type"], row["value"], embedded)
                if category in removed:
                    record(category, row)
                    continue
                kept = [x for x in map(left, self.below(row)) if x]
                if row["children"] and not kept:
                    record("other" if category == "structural" else category, row)
                    continue
                out += [row, *(one for x in kept for one in x)]
            return out

        pages = [left(p) for p in sorted((p for p in self.tables if "/" not in p), key=int)]
        stay = [row for page in pages for row in page]
        return stay or None, lost


def write(rows: list[dict]) -> bytes:
    """One payload from its entries: tables by tag, values and blocks behind, even offsets."""
    little = rows[0]["little"]
    end, tables = "<" if little else ">", {}
    for row in sorted(rows, key=lambda r: (r["tag"], r["ord"])):
        tables.setdefault(row["path"], []).append(row)
    out = bytearray((b"II*\0" if little else b"MM\0*") + bytes(4))

    def append(data: bytes) -> int:
        out.extend(bytes(len(out) % 2))
        at = len(out)
        out.extend(data)
        return at

    def place(path: str) -> int:
        table = tables.get(path, [])
        at = append(struct.pack(end + "H", len(table)) + bytes(12 * len(table) + 4))
        for i, row in enumerate(table):
            form, count, value, far = row["type"], row["count"], row["value"], None
            if row["children"]:
                lead = f"{path}/{row['tag']}."
                far = [place(p) for p in sorted((p for p in tables if p.startswith(lead) and "/" not in p[len(lead) :]), key=lambda p: int(p[len(lead) :]))]
            elif row["blocks"] is not None:
                far = [append(b) for b in row["blocks"]]
            if far is not None:
                form, count, value = 4, len(far), struct.pack(f"{end}{len(far)}I", *far)
            field = value.ljust(4, b"\0") if len(value) <= 4 else struct.pack(end + "I", append(value))
            struct.pack_into(end + "HHI", out, at + 2 + 12 * i, row["tag"], form, count)
            out[at + 10 + 12 * i : at + 14 + 12 * i] = field
        return at

    link = 4
    for page in sorted({int(p.split("/")[0]) for p in tables}):
        at = place(str(page))
        struct.pack_into(end + "I", out, link, at)
        link = at + 2 + 12 * len(tables.get(str(page), []))
    return bytes(out)


def assemble(rows: DataFrame) -> DataFrame:
    """(file_id, content) from entry rows; a file holds what one task holds."""
    fields = ["ord", "path", "tag", "type", "count", "value", "little", "children", "blocks"]

    @F.pandas_udf("binary")
    def written(listed: pd.Series) -> pd.Series:
        return listed.map(lambda found: write([dict(r) for r in found]))

    return rows.groupBy("file_id").agg(F.collect_list(F.struct(*fields)).alias("_rows")).select("file_id", written("_rows").alias("content"))


def clean(files: DataFrame, removed: frozenset[str], embedded: bool = False) -> DataFrame:
    """Files without the entries of the removed categories; pixel blocks move, their bytes do not change.

    An embedded payload of which nothing is left gives no row.
    """
    return assemble(keep(entries(files), removed, embedded))


def rewritten(files: DataFrame, removed: frozenset[str], embedded: bool = False) -> DataFrame:
    """file_id, content, kinds, tags, values: ``clean``, and the entries of what was written, read again by the same task.

    One row for each payload of which something is left; nothing is shuffled.
    """

    def run(content: bytes) -> Iterator[tuple]:
        tree = Tree(content)
        stay, _ = tree.without(removed, embedded) if tree.rows else (None, None)
        if stay is not None:
            fresh = write(stay)
            again = entries_of(fresh)
            yield fresh, [e[2] for e in again], [e[3] for e in again], [e[6] for e in again]

    return walk.rows_of(files, run, "fresh binary, kinds array<string>, tags array<int>, values array<binary>").selectExpr("file_id", "fresh as content", "kinds", "tags", "values")


def unsupported(rows: DataFrame) -> DataFrame:
    """Files whose pixels lie behind offsets that only old tables know."""
    return rows.where(F.col("tag").isin(OLD_JPEG)).select("file_id").distinct()
