import struct
import zlib

from pyspark.sql import functions as F

from shutterlake import dims
from shutterlake.functions import binary, labels
from shutterlake.sources import png


def chunk(kind, data, bad=False):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data) ^ bad)


PARTS = [(b"IHDR", struct.pack(">IIBBBBB", 4, 4, 8, 6, 0, 0, 0)), (b"tEXt", b"Comment\0hi"), (b"iTXt", b"XML:com.adobe.xmp\0\0\0\0\0<x/>"), (b"eXIf", b"MM\0*"), (b"iCCP", b"icc\0\0"), (b"gAMA", b"\0\0\0\1"), (b"IDAT", zlib.compress(b"\0" * 68)), (b"IEND", b"")]
FILE = png.SIGNATURE + b"".join(chunk(*p) for p in PARTS) + b"trailing"


def test_walk_clean_verify(spark):
    files = spark.createDataFrame([("a", bytearray(FILE)), ("empty", None), ("cut", bytearray(FILE[:40]))], "file_id string, content binary")
    rows = png.chunks(files).orderBy("file_id", "ord").collect()
    assert [r["type"] for r in rows if r["file_id"] == "a"] == [k.decode() for k, _ in PARTS]
    assert [r["category"] for r in rows if r["file_id"] == "a"] == ["structural", "comment", "xmp", "exif", "icc", "structural", "structural", "structural"]
    assert all(r["crc_ok"] for r in rows)
    out = {r["file_id"]: bytes(r["content"]) for r in png.clean(files, dims.policy(spark)).collect()}
    assert out["a"] == png.SIGNATURE + b"".join(chunk(k, d) for k, d in PARTS if k not in (b"tEXt", b"iTXt", b"eXIf"))
    again = png.chunks(spark.createDataFrame([("a", bytearray(out["a"]))], "file_id string, content binary"))
    assert again.where("category not in ('structural', 'icc')").count() == 0
    same = png.clean(files, dims.policy(spark, exif=False, comment=False, xmp=False)).where("file_id = 'a'").first()
    assert bytes(same["content"]) == FILE[: -len(b"trailing")]


def test_formats_and_labels(spark):
    heads = {"jpeg": b"\xff\xd8\xff\xe0" + b"\0" * 9, "png": FILE[:16], "avif": struct.pack(">I", 24) + b"ftypmif1\0\0\0\0avifmiaf", "tiff": b"MM\0*" + b"\0" * 9, "unknown": b"\xff\xd8\xff"}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in heads.items()], "want string, content binary")
    assert df.where(binary.detect_format(F.col("content")) != F.col("want")).count() == 0
    sizes = spark.createDataFrame([(0,), (999,), (1536,), (5 << 20,)], "n long").select(labels.format_bytes(F.col("n")).alias("x"))
    assert [r["x"] for r in sizes.collect()] == ["0 B", "999 B", "1.5 KB", "5.0 MB"]
    names = spark.createDataFrame([("holiday.JPG", "jpg"), ("a/b:c.png", "png")], "n string, e string").select(labels.cleaned_file_name(F.col("n"), F.col("e")).alias("x"))
    assert [r["x"] for r in names.collect()] == ["holiday_clean.jpg", "a_b_c_clean.png"]
    crc = spark.range(1).select(F.crc32(F.lit("123456789").cast("binary")).alias("c")).first()["c"]
    assert crc == 0xCBF43926
