import struct

from shutterlake.sources import heif, manifest


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind + body


def entry(item, kind, name=b"", mime=None):
    return box(b"infe", b"\2\0\0\0", struct.pack(">HH", item, 0), kind, name + b"\0", b"" if mime is None else mime + b"\0")


EXIF = b"\0\0\0\0MM\0*rest"
XMP = b"<x:xmpmeta/>"
PIXELS = bytes(64)


def build():
    def meta(start):
        places, at = b"", start
        for item, data in ((1, PIXELS), (2, EXIF), (3, XMP)):
            places += struct.pack(">HHHHII", item, 0, 0, 1, at, len(data))
            at += len(data)
        iloc = box(b"iloc", b"\1\0\0\0\x44\0", struct.pack(">H", 3), places)
        infos = box(b"iinf", b"\0\0\0\0\0\3", entry(1, b"av01"), entry(2, b"Exif"), entry(3, b"mime", b"", b"application/rdf+xml"))
        return box(b"meta", bytes(4), box(b"pitm", bytes(4), b"\0\1"), iloc, infos)

    head = box(b"ftyp", b"avif", bytes(4), b"avifmif1")
    signed = box(b"uuid", manifest.UUID, b"signed")
    start = len(head) + len(meta(0)) + len(signed) + 8
    return head + meta(start) + signed + box(b"mdat", PIXELS, EXIF, XMP)


def test_items_and_segments(spark):
    files = spark.createDataFrame([("a", bytearray(build())), ("cut", bytearray(build()[:70])), ("none", None)], "file_id string, content binary")
    rows = {r["item_id"]: r for r in heif.items(files).where("file_id = 'a'").collect()}
    assert [(rows[i]["category"], rows[i]["bytes"], rows[i]["is_primary"]) for i in (1, 2, 3)] == [("structural", 64, True), ("exif", len(EXIF), False), ("xmp", len(XMP), False)]
    assert rows[1]["data"] is None and bytes(rows[3]["data"]) == XMP
    assert bytes(heif.exif_payloads(heif.items(files)).first()["content"]) == EXIF[4:]
    got = sorted((r["category"], r["bytes"]) for r in heif.segments(files).collect())
    assert got == [("c2pa", 30), ("exif", len(EXIF)), ("xmp", len(XMP))]
    assert heif.refusals(files).count() == 0
    tops = heif.boxes(files).where("file_id = 'a' and depth = 0")
    assert tops.selectExpr("sum(bytes)").first()[0] == len(build())

