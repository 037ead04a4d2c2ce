import struct

from shutterlake import dims
from shutterlake.operators import exif
from shutterlake.sources import jpeg, tiff


def rows(*entries, path="0", above=(), kind="ifd0", little=False):
    return [dict(path=path, tag=t, type=f, count=n, value=v, little=little, children=c, blocks=b, ord=i) for i, (t, f, n, v, c, b) in enumerate(entries)]


def ascii_(tag, s):
    return (tag, 2, len(s) + 1, s.encode() + b"\0", 0, None)


def rational(tag, *pairs):
    return (tag, 5, len(pairs), b"".join(struct.pack(">II", *p) for p in pairs), 0, None)


def short(tag, n):
    return (tag, 3, 1, struct.pack(">H", n), 0, None)


def pointer(tag):
    return (tag, 4, 1, bytes(4), 1, None)


def camera():
    main = rows(ascii_(271, "Canon"), ascii_(272, "EOS"), short(274, 6), ascii_(305, "Editor"), pointer(34665), pointer(34853))
    inner = rows(rational(33434, (1, 250)), rational(33437, (28, 10)), short(34855, 400), (37510, 7, 13, b"ASCII\0\0\0Hello", 0, None), path="0/34665.0")
    place = rows(ascii_(1, "N"), rational(2, (48, 1), (51, 1), (2999, 100)), ascii_(3, "W"), rational(4, (2, 1), (17, 1), (40, 1)), rational(7, (9, 1), (5, 1), (3, 1)), path="0/34853.0")
    return tiff.write(main + inner + place)


def picture():
    pixels = bytes(range(5))
    return tiff.write(rows(short(256, 5), short(257, 1), ascii_(271, "Maker"), (273, 4, 1, bytes(4), 0, [pixels]), (279, 4, 1, struct.pack(">I", 5), 0, None), ascii_(315, "An Artist"), pointer(34853)) + rows(ascii_(1, "N"), path="0/34853.0")), pixels


def files_of(spark, **files):
    return spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in files.items()], "file_id string, content binary")


def test_summary_and_position(spark):
    loop = b"MM\0*" + struct.pack(">IHHHIII", 8, 1, 34665, 4, 1, 8, 8)
    found = tiff.entries(files_of(spark, a=camera(), loop=loop, none=None, cut=camera()[:20], big=b"MM\0+" + bytes(8)))
    s = exif.summary(found).where("file_id = 'a'").first()
    assert (s["tag_count"], s["make"], s["model"], s["orientation_label"], s["exposure"], s["aperture"], s["iso"], s["comment"], s["byte_order"]) == (15, "Canon", "EOS", "Rotated 90° clockwise", "1/250 s", "f/2.8", "400", "Hello", "big")
    p = exif.position(found).first()
    assert (p["latitude"], p["longitude"], p["timestamp_utc"]) == (48.858331, -2.294444, "09:05:03 UTC")
    assert p["coordinates"] == "48.858331 N, 2.294444 W"
    assert {r["key"]: r["text"] for r in exif.text_sources(found).where("file_id = 'a'").collect()} == {"UserComment": "Hello", "Software": "Editor"}


def test_categories_can_go_alone(spark):
    files = files_of(spark, a=camera())
    names = lambda df: {(r["kind"], r["tag"]) for r in df.collect()}
    all_ = names(tiff.entries(files))
    assert names(tiff.entries(tiff.clean(files, frozenset(), True))) == all_
    assert names(tiff.entries(tiff.clean(files, frozenset(["gps"]), True))) == {(k, t) for k, t in all_ if k != "gps" and t != 34853}
    assert names(tiff.entries(tiff.clean(files, frozenset(["comment"]), True))) == all_ - {("exif", 37510)}
    assert tiff.clean(files, frozenset(["exif", "gps"]), True).count() == 0


def test_pixels_move_unchanged(spark):
    content, pixels = picture()
    out = tiff.clean(files_of(spark, a=content), dims.removed())
    got = tiff.entries(out)
    assert sorted(r["tag"] for r in got.collect()) == [256, 257, 273, 279]
    assert got.where("tag = 273").first()["blocks"] == [pixels]
    assert len(out.first()["content"]) < len(content)
    again = tiff.clean(files_of(spark, a=content), frozenset())
    assert bytes(again.first()["content"]) == content


def test_exif_in_jpeg_loses_position_alone(spark):
    segment = b"\xff\xe1" + struct.pack(">H", len(camera()) + 8) + b"Exif\0\0" + camera()
    files = files_of(spark, a=b"\xff\xd8" + segment + b"\xff\xd9")
    out = jpeg.clean(files, dims.removed(exif=False))
    payload = jpeg.exif_payloads(jpeg.parts(out))
    kinds = {r["kind"] for r in tiff.entries(payload).collect()}
    assert kinds == {"ifd0", "exif"} and exif.summary(tiff.entries(payload)).first()["make"] == "Canon"
