"""The rules on plain values against the column expressions."""

import random

from pyspark.sql import functions as F

from shutterlake.functions import binary, labels, plain, signals, text, xmp
from shutterlake.sources import jpeg, tiff
from tests.test_generators import BLOCK
from tests.test_jpeg import build
from tests.test_tiff import camera


def test_texts_and_packets(spark):
    rng = random.Random(1)
    rows = [b"", b"\0 a \0", b"UNICODE\0\xff\xfeh\0i\0", b"UNICODE\0\0h\0i", b"ASCII\0\0\0x\0", b"JIS\0\0\0\0\0\x80", b"\xef\xbb\xbfcaf\xc3\xa9", b"caf\xe9 \x99", BLOCK.encode(), b'{"seed": 1, "scheduler": 2}', b"a<x:xmpmeta><a c2pa:manifest='x' b='y'/></x:xmpmeta>z", b"<?xpacket begin?>q<?xpacket end?>r", b"<rdf:RDF>Steps: 1</rdf:RDF>", bytes(4) + b"jumb" + bytes(20), b"jumd jumb" + bytes(9), b"ab jumb jumd" + bytes(9)]
    rows += [bytes(rng.choice(b"\0 aA\xe9\x80\xc3\xa9<>-\r\n") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(rows)], "i int, c binary")
    c = F.col("c")
    words = text.latin1(c)
    got = df.select("i", text.utf8(c).alias("utf8"), words.alias("latin1"), text.utf8_or_latin1(c).alias("either"), text.user_comment(c).alias("comment"), signals.has_signature(words).alias("signed"), signals.is_generator_key(words).alias("key"), text.looks_like_manifest(c).alias("manifest"), xmp.packet(c).alias("packet"), labels.sanitize(words, 20).alias("clean"), xmp.stripped(words, frozenset(["ai", "c2pa"])).alias("stripped")).collect()
    for r in got:
        raw = rows[r["i"]]
        w = plain.latin1(raw)
        want = (plain.utf8(raw), w, plain.utf8_or_latin1(raw), plain.user_comment(raw), plain.signed(w), plain.generator_key(w), plain.manifest_like(raw), plain.packet(raw), plain.sanitized(w, 20), plain.stripped(w, frozenset(["ai", "c2pa"]))[0])
        assert tuple(r)[1:] == (*want[:7], want[7] and bytearray(want[7]), want[8] or "", want[9]), raw


def test_classes_and_formats(spark):
    parts = [(m, raw[head:]) for m, _, _, head, raw in jpeg.parts_of(build(b"\xff\xe1\0\x0aExif\0\0ab", b"\xff\xe9\0\x04xx", b"\xff\xe0\0\x13JFIF\0\1\2\0\0\1\0\1\1\1abc", b"\xff\xeb\0\x04JP")) if m is not None]
    df = spark.createDataFrame([(m, bytearray(p)) for m, p in parts], "m int, p binary")
    assert [tuple(r["c"]) for r in df.select(jpeg.classify(F.col("m"), F.col("p")).alias("c")).collect()] == [jpeg.class_of(m, p) for m, p in parts]
    entries = tiff.entries(spark.createDataFrame([("a", bytearray(camera()))], "file_id string, content binary"))
    for embedded in (True, False):
        for r in entries.withColumn("category", tiff.classify(embedded)).collect():
            assert r["category"] == tiff.class_of(r["kind"], r["tag"], r["type"], bytes(r["value"]), embedded)
    heads = [b"\xff\xd8\xff" + bytes(9), b"\xff\xd8\xff", b"RIFF\0\0\0\0WEBP", b"\0\0\0\x18ftypmif1\0\0\0\0avifmiaf", b"\0\0\0\x10ftypmsf1\0\0\0\0", b"\0\0\0\x10ftypxxxx\0\0\0\0", b"II*\0" + bytes(8), b"MM\0+" + bytes(8), b"GIF89a" + bytes(6), b"BM" + bytes(10), bytes(12), b""]
    df = spark.createDataFrame([(bytearray(h),) for h in heads], "c binary")
    assert [r[0] for r in df.select(binary.detect_format(F.col("c"))).collect()] == [plain.sniff(h) for h in heads]
