import struct

from shutterlake import dims
from shutterlake.sources import webp


def build(parts):
    body = b"WEBP" + b"".join(k + struct.pack("<I", len(d)) + d + b"\0" * (len(d) % 2) for k, d in parts)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def header(flags):
    return bytes([flags]) + b"\0\0\0" + b"\x3f\0\0" + b"\x2f\0\0"


PICTURE = bytes([0x2F, 0x3F, 0x00, 0x2F, 0x00, 0x11, 0x22, 0x33])
FILE = build([(b"VP8X", header(0x2C)), (b"ICCP", b"icc"), (b"VP8L", PICTURE), (b"EXIF", b"MM\0*x"), (b"XMP ", b"<x/>"), (b"abcd", b"?")])


def test_walk_and_clean(spark):
    files = spark.createDataFrame([("a", bytearray(FILE)), ("none", None), ("cut", bytearray(FILE[:25]))], "file_id string, content binary")
    rows = webp.chunks(files).where("file_id = 'a'").orderBy("ord").collect()
    assert [r["category"] for r in rows] == ["structural", "icc", "structural", "exif", "xmp", "other"]
    assert sum(r["bytes"] for r in rows) + 12 == len(FILE)
    got = {r["file_id"]: bytes(r["content"]) for r in webp.clean(files, dims.policy(spark)).collect()}
    assert got["a"] == build([(b"VP8X", header(0x20)), (b"ICCP", b"icc"), (b"VP8L", PICTURE)])
    all_off = dims.policy(spark, **{c: False for c, _ in dims.CATEGORIES})
    assert bytes(webp.clean(files, all_off).where("file_id = 'a'").first()["content"]) == FILE
