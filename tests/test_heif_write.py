import struct

from shutterlake.sources import heif, heif_write, manifest
from tests.test_heif import EXIF, PIXELS, XMP, box, entry

GONE = frozenset(["exif", "xmp", "c2pa"])


def build(shift=0, idat=False, method=0):
    """A picture, an EXIF item and a packet with references and properties; the table comes first or last."""
    props = box(b"iprp", box(b"ipco", box(b"ispe", bytes(4), struct.pack(">II", 30, 20)), box(b"pixi", bytes(4), b"\3\x0a\x0a\x0a"), box(b"colr", b"prof", b"profile")), box(b"ipma", bytes(4), struct.pack(">I", 2), b"\0\1\3\x81\2\3", b"\0\2\1\1"))
    refs = box(b"iref", bytes(4), box(b"cdsc", struct.pack(">HHH", 2, 1, 1)), box(b"cdsc", struct.pack(">HHH", 3, 1, 1)), box(b"thmb", struct.pack(">HHHH", 1, 2, 2, 1)), box(b"cut ", b"\0"))
    infos = box(b"iinf", b"\0\0\0\0\0\3", entry(1, b"av01"), entry(2, b"Exif"), entry(3, b"mime", b"", b"application/rdf+xml"))
    held = box(b"idat", XMP) if idat else b""

    def meta(start):
        exts = [(1, method, [(start + len(EXIF), 40), (start + len(EXIF) + 40, 24)]), (2, 0, [(start, len(EXIF))]), (3, 1 if idat else 0, [(0 if idat else start + len(EXIF) + 64, len(XMP))])]
        rows = b"".join(struct.pack(">HHHH", i, m, 0, len(e)) + b"".join(struct.pack(">II", *x) for x in e) for i, m, e in exts)
        return box(b"meta", bytes(4), box(b"pitm", bytes(4), b"\0\1"), box(b"iloc", b"\1\0\0\0\x44\0", struct.pack(">H", 3), rows), infos, refs, props, held)

    head, signed = box(b"ftyp", b"avif", bytes(4), b"avifmif1"), box(b"uuid", manifest.UUID, b"signed")
    data = EXIF + PIXELS[:40] + b"\1" * 24 + (b"" if idat else XMP)
    if shift:
        return head + box(b"mdat", data) + signed + meta(len(head) + 8)
    return head + signed + meta(len(head) + len(signed) + len(meta(0)) + 8) + box(b"mdat", data)


def picture(content):
    method, extents = heif._locations(next(content[a + h : a + n] for _, k, a, h, n, _ in heif.boxes_of(content) if k == "iloc"))[1]
    return b"".join(content[a : a + n] for a, n in extents)


def test_items_go_and_pixels_stay():
    for content in (build(), build(1), build(idat=True), build(1, idat=True)):
        fresh, lost = heif_write.without(content, GONE)
        assert sorted(lost) == [("c2pa", "uuid", 30), ("exif", "Exif", len(EXIF) + 21), ("xmp", "mime", len(XMP) + 41)]
        assert picture(fresh) == picture(content) == bytes(40) + b"\1" * 24
        assert EXIF not in fresh and XMP not in fresh and manifest.UUID not in fresh
        assert [i[0] for i in heif.items_of(fresh)] == [1]
        assert sum(n for d, _, _, _, n, _ in heif.boxes_of(fresh) if d == 0) == len(fresh)
        assert heif_write.without(fresh, GONE) == (fresh, [])
        some, lost = heif_write.without(content, frozenset(["xmp"]))
        assert [x[0] for x in lost] == ["xmp"] and picture(some) == picture(content)
        assert {i[0]: i[8] for i in heif.items_of(some)}[2] == EXIF
    assert heif_write.without(build(), frozenset()) == (build(), [])


def test_tables(spark):
    rows = [("a", bytearray(build())), ("b", bytearray(heif_write.without(build(), frozenset(["xmp"]))[0])), ("none", None), ("cut", bytearray(build()[:90]))]
    files = spark.createDataFrame(rows, "file_id string, content binary")
    got = sorted((r["file_id"], r["type"], r["from_id"], r["to_id"]) for r in heif_write.references(files).collect())
    both = [("cdsc", 2, 1), ("thmb", 1, 1), ("thmb", 1, 2)]
    assert got == sorted([("a", *r) for r in [*both, ("cdsc", 3, 1)]] + [("b", *r) for r in both])
    marks = [(1, 1, True, "ispe"), (1, 2, False, "pixi"), (1, 3, False, "colr"), (2, 1, False, "ispe")]
    for k in "ab":
        assert sorted((r["item_id"], r["property"], r["essential"], r["type"]) for r in heif_write.associations(files).where(f"file_id = '{k}'").collect()) == marks
    first = heif_write.primary_properties(files).where("file_id = 'a'").first()
    assert (first["width"], first["height"], first["bit_depth"], first["channels"], first["has_alpha"], bytes(first["icc"])) == (30, 20, 10, 3, False, b"profile")


def test_clean_and_refusals(spark):
    film = build() + box(b"moov", b"")
    rows = [("a", build()), ("film", film), ("odd", build(method=2)), ("far", build().replace(struct.pack(">HHHH", 2, 0, 0, 1), struct.pack(">HHHH", 2, 0, 1, 1))), ("bare", box(b"ftyp", b"avif", bytes(4)) + box(b"mdat", b"x")), ("cut", build()[:90]), ("none", None), ("empty", b"")]
    files = spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, c in rows], "file_id string, content binary")
    got = {r["file_id"]: r for r in heif_write.clean(files, GONE).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {
        "a": None,
        "film": "Image sequences carry a movie box whose sample tables cannot be relocated safely",
        "odd": "Items stored inside other items (construction method 2) cannot be relocated",
        "far": "Items stored in an external file cannot be rewritten",
        "bare": None,
        "cut": None,
        "none": "The file contains no readable ISOBMFF boxes",
        "empty": "The file contains no readable ISOBMFF boxes",
    }
    # without an item table there is nothing but a manifest to take out
    bare, signed = box(b"ftyp", b"avif", bytes(4)) + box(b"mdat", b"x"), box(b"uuid", manifest.UUID, b"signed")
    assert bytes(got["bare"]["content"]) == bare and heif_write.without(bare + signed, GONE) == (bare, [("c2pa", "uuid", 30)])
    assert heif_write.without(build() + b"tail", GONE)[0] == heif_write.without(build(), GONE)[0] and heif_write.without(build() + b"tail", frozenset()) == (build() + b"tail", [])
    assert bytes(got["a"]["content"]) == heif_write.without(build(), GONE)[0] and len(got["a"]["lost"]) == 3
    starts = heif_write.relocations(heif.items(files.where("file_id = 'a'")), frozenset(["exif"])).orderBy("item_id").collect()
    assert [(r["item_id"], r["start"]) for r in starts] == [(1, 0), (3, 64)]
