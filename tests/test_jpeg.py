import struct

import pytest
from pyspark.sql import functions as F

from shutterlake import dims
from shutterlake.functions import signals, text
from shutterlake.sources import jpeg


def segment(marker, payload):
    return b"\xff" + bytes([marker]) + struct.pack(">H", len(payload) + 2) + payload


SCAN = bytes.fromhex("1234ff0056ffd3789a")
JFIF = segment(0xE0, b"JFIF\0\1\2\0\0\1\0\1\0\0")
EXIF = segment(0xE1, b"Exif\0\0MM\0*\0\0\0\x08\0\0")
TABLE = segment(0xDB, bytes(5))
COMMENT = segment(0xFE, b"hello")
PROMPT = segment(0xFE, b"cat\nSteps: 20, Sampler: Euler")


def frame(n):
    return segment(0xC0, struct.pack(">BHHB", 8, 64, 48, n) + bytes(3 * n))


def adobe(transform):
    return segment(0xEE, b"Adobe\0\x64\0\0\0\0" + bytes([transform]))


def build(*extra, components=3, tail=b""):
    return b"\xff\xd8" + JFIF + b"".join(extra) + TABLE + frame(components) + segment(0xDA, b"\1\1\0\0\x3f\0") + SCAN + b"\xff\xd9" + tail


def frame_of(spark, **files):
    return spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in files.items()], "file_id string, content binary")


def test_parts_cover_the_file(spark):
    cut = build(COMMENT)[:30]
    files = frame_of(spark, a=build(EXIF, b"\xff\xff" + COMMENT, b"stray", tail=b"tail"), cut=cut, none=None, empty=b"", text=b"no image")
    rows = jpeg.parts(files).orderBy("file_id", "ord").collect()
    assert b"".join(r["raw"] for r in rows if r["file_id"] == "a") == build(EXIF, b"\xff\xff" + COMMENT, b"stray", tail=b"tail")
    assert b"".join(r["raw"] for r in rows if r["file_id"] == "cut") == cut
    assert {r["file_id"] for r in rows} == {"a", "cut"}
    assert [(r["category"], bytes(r["payload"])) for r in rows if r["marker"] == 0xFE and r["file_id"] == "a"] == [("comment", b"hello")]
    got = jpeg.frames(jpeg.parts(files)).where("file_id = 'a'").first()
    assert (got["width"], got["height"], got["components"], got["color_space"], got["progressive"]) == (48, 64, 3, "YCbCr", False)


@pytest.mark.parametrize("extra,components,want", [((EXIF, COMMENT, PROMPT), 3, ()), ((adobe(1),), 3, ()), ((adobe(0),), 3, (adobe(0),)), ((adobe(2), COMMENT), 4, (adobe(2),))])
def test_clean(spark, extra, components, want):
    files = frame_of(spark, a=build(*extra, components=components))
    assert bytes(jpeg.clean(files, dims.removed()).first()["content"]) == build(*want, components=components)
    assert bytes(jpeg.clean(files, frozenset()).first()["content"]) == build(*extra, components=components)


def test_switches_and_thumbnail(spark):
    header = segment(0xE0, b"JFIF\0\1\2\0\0\1\0\1\1\1abc")
    files = frame_of(spark, a=b"\xff\xd8" + header + COMMENT + PROMPT + b"\xff\xd9")
    rows = jpeg.decide(jpeg.parts(files), dims.removed(comment=False)).where("marker in (224, 254)").orderBy("ord").collect()
    assert [r["switch"] for r in rows] == ["other", "comment", "ai"]
    assert [r["kept"] and bytes(r["kept"]) for r in rows] == [JFIF[:-2] + b"\0\0", COMMENT, None]


def test_texts_and_signatures(spark):
    df = frame_of(spark, u=b"UNICODE\0\xff\xfeh\0i\0", a=b"ASCII\0\0\0Hello\0", w=b"\x80 caf\xe9", n=None)
    got = {r["file_id"]: (r["c"], r["l"]) for r in df.select("file_id", text.user_comment(F.col("content")).alias("c"), text.latin1(F.col("content")).alias("l")).collect()}
    assert got["u"][0] == "hi" and got["a"][0] == "Hello" and got["w"] == ("€ café", "€ café") and got["n"] == (None, None)
    cases = [("a quiet street", False), ("Steps: 20", True), ('{"seed": 1}', False), ('{"seed": 1, "scheduler": "x"}', True), (None, False), ("", False)]
    df = spark.createDataFrame(cases, "t string, want boolean")
    assert df.where(signals.has_signature(F.col("t")) != F.col("want")).count() == 0
    who = spark.createDataFrame([("Adobe Firefly", None), (None, "http://x/trainedAlgorithmicMedia"), ("Camera", None)], "s string, d string")
    assert [r["p"] and tuple(r["p"]) for r in who.select(signals.by_provenance(F.col("d"), F.col("s")).alias("p")).collect()] == [("adobe-firefly", "likely"), ("generic", "confirmed"), None]
