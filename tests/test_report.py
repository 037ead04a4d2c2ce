import struct
import zlib

from shutterlake import dims
from shutterlake.operators import cleaning, report
from shutterlake.sources import bundle, png, resources, rewrite, tiff
from tests.test_generators import BLOCK
from tests.test_heif_write import build as avif
from tests.test_jpeg import adobe, build, segment
from tests.test_png import chunk
from tests.test_tiff import ascii_, camera, pointer, rows, short
from tests.test_webp import PICTURE
from tests.test_webp import build as webp

XMP = b'<x:xmpmeta x:xmptk="kit"><rdf:RDF><dc:title>T</dc:title><xmp:CreatorTool>Adobe Firefly</xmp:CreatorTool><Iptc4xmpExt:DigitalSourceType>http://x/trainedAlgorithmicMedia</Iptc4xmpExt:DigitalSourceType><dcterms:provenance>urn:x</dcterms:provenance></rdf:RDF></x:xmpmeta>'
ICC = bytes(36) + b"acsp" + bytes(88) + struct.pack(">I", 0) + bytes(range(200))
IPTC = b"\x1c\x02\x50\x00\x03Ann" + b"\x1c\x02\x19\x00\x01k"
SIGNED = struct.pack(">I", 50) + b"jumb" + struct.pack(">I", 30) + b"jumd" + bytes(16) + b"\x03c2pa\0" + struct.pack(">I", 12) + b"cbor" + bytes(4)


def block(kind, data):
    return b"8BIM" + struct.pack(">HHI", kind, 0, len(data)) + data + b"\0" * (len(data) % 2)


def app(marker, *parts):
    return segment(marker, b"".join(parts))


def photo(*more):
    profile = [app(0xE2, b"ICC_PROFILE\0", bytes([n, 3]), ICC[a:b]) for n, a, b in ((3, 200, 999), (1, 0, 100), (2, 100, 200))]
    return build(app(0xE1, b"Exif\0\0", camera()), app(0xE1, b"http://ns.adobe.com/xap/1.0/\0", XMP), *profile, app(0xED, resources.LEADS[0], block(0x0404, IPTC), block(0x0404, IPTC[8:]), block(0x0424, b"<x:xmpmeta><dc:rights>R</dc:rights></x:xmpmeta>")), segment(0xFE, BLOCK.encode()), *more)


def scan():
    held = lambda tag, data: (tag, 7, len(data), data, 0, None)
    return tiff.write(rows(short(256, 5), ascii_(305, "Firefly"), held(700, XMP), held(33723, IPTC), held(34675, ICC), held(52545, SIGNED), held(50000, b"odd words"), pointer(34853)) + rows(ascii_(1, "N"), path="0/34853.0"))


def files_of(spark, **files):
    return spark.createDataFrame([(k, None if v is None else bytearray(v), 1) for k, v in files.items()], "file_id string, content binary, format int")


def test_report_of_every_payload(spark):
    files = files_of(spark, jpg=photo(), tif=scan(), none=None, empty=b"", small=b"\xff\xd8\xff", gif=b"GIF89a" + bytes(12), cut=photo()[:700], avif=avif(), broken=b"MM\0*" + bytes(20))
    got = {r["file_id"]: r for r in report.inspect(files).collect()}
    j, t = got["jpg"], got["tif"]
    assert (j["exif"]["make"], j["gps"]["latitude"], j["iptc"]["byline"], j["iptc"]["keywords"], j["xmp"]["packets"], j["xmp"]["title"], j["xmp"]["rights"]) == ("Canon", 48.858331, "Ann", ["k", "k"], 2, "T", "R")
    assert j["icc"]["bytes"] == len(ICC) and j["container"]["encoding"] == "Baseline DCT"
    assert [(a["generator"], a["confidence"]) for a in j["ai"]] == [("automatic1111", "confirmed"), ("adobe-firefly", "confirmed")]
    assert j["metadata_bytes"] == sum(s["bytes"] for s in j["segments"] if s["category"] != "structural") == sum(v["bytes"] for v in j["categories"].values())
    assert j["categories"]["gps"]["n"] == 0 and j["categories"]["icc"]["n"] == 3
    assert (t["iptc"]["byline"], t["icc"]["bytes"], t["xmp"]["toolkit"], t["c2pa"]["assertions"], t["c2pa"]["location"], t["exif"]["software"]) == ("Ann", len(ICC), "kit", ["c2pa"], "TIFF private tag (JUMBF)", "Firefly")
    assert [(s["label"], s["detail"]) for s in t["segments"] if s["container"] == "IFD0"][:1] == [("Software", "Firefly")]
    assert {s["label"] for s in t["segments"]} == {"Software", "XMP", "IPTCNAA", "InterColorProfile", "Tag 0xcd41", "Tag 0xc350", "GPSIFDPointer", "GPSLatitudeRef"}
    assert t["ai"][0]["generator"] == "adobe-firefly" and t["ai"][0]["fields"]["Digital source type"].endswith("trainedAlgorithmicMedia")
    assert {k: (r["error"], r["message"]) for k, r in got.items() if r["error"]} == {
        "none": ("empty-file", "The file is empty."),
        "empty": ("empty-file", "The file is empty."),
        "small": ("corrupt-container", "The file is too small to contain an image header."),
        "gif": ("unsupported-format", "GIF is not supported. Convert it to PNG or JPEG first."),
        "broken": ("corrupt-container", "The image structure could not be read: no readable directory"),
    }
    assert got["avif"]["lossless_supported"] and got["avif"]["container"]["width"] == 30 and got["avif"]["icc"]["bytes"] == 7
    assert report.inspect(files.limit(0)).count() == 0


def test_detections_in_order(spark):
    found = {r["file_id"]: [(d["key"], d["detail"]) for d in r["detections"]] for r in report.detections(report.inspect(files_of(spark, jpg=photo(), tif=scan(), bare=build()))).collect()}
    assert [k for k, _ in found["jpg"]] == ["gps", "ai", "exif", "xmp", "iptc", "icc"]
    assert found["jpg"][0][1] == "48.858331 N, 2.294444 W" and found["jpg"][2][1] == "Canon EOS"
    assert [k for k, _ in found["tif"]] == ["gps", "ai", "c2pa", "exif", "xmp", "iptc", "icc"] and found["bare"] == []


def test_payloads_are_filtered_inside_containers():
    for compressed in (False, True):
        body = zlib.compress(XMP) if compressed else XMP
        file = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 6, 0, 0, 0)) + chunk(b"eXIf", camera()) + chunk(b"iTXt", png.XMP_KEY + (b"\0\1\0" if compressed else b"\0\0\0") + b"\0\0" + body) + chunk(b"IDAT", zlib.compress(bytes(5))) + chunk(b"IEND", b"") + b"tail"
        done, why = rewrite.rewritten(file, "png", frozenset(["gps", "c2pa"]))
        kinds = {k: d for k, _, _, ok, d in png.chunks_of(done.content) if ok}
        assert why is None and kinds["IDAT"] == zlib.compress(bytes(5)) and set(kinds) == {"IHDR", "eXIf", "iTXt", "IDAT", "IEND"}
        left = tiff.entries_of(kinds["eXIf"])
        assert {r[2] for r in left} == {"ifd0", "exif"} and len(left) == 9
        assert b"provenance" not in png.text_of("iTXt", kinds["iTXt"])[2].encode() and png.text_of("iTXt", kinds["iTXt"])[2].startswith("<x:xmpmeta")
        assert set(done.removed) == {"gps", "c2pa", "other"} and done.removed["other"] == [4, 1]
        assert sum(b for b, _ in done.removed.values()) == len(file) - len(done.content)
    file = webp([(b"VP8X", b"\x0c" + bytes(9)), (b"VP8L", PICTURE), (b"EXIF", camera()), (b"XMP ", XMP)])
    done, _ = rewrite.rewritten(file, "webp", frozenset(["gps", "ai"]))
    back = bundle.bundle_of(done.content, "webp")
    assert len(tiff.entries_of(back.exif[0])) == 9 and b"Firefly" not in done.content and b"<dc:title>T" in done.content and b"AlgorithmicMedia" not in done.content and PICTURE in done.content
    same, _ = rewrite.rewritten(file, "webp", frozenset())
    assert same.content == file


def test_jpeg_rules():
    file = photo(adobe(0))
    done, _ = rewrite.rewritten(file, "jpeg", dims.removed())
    assert [(label, reason[:11]) for label, _, reason in done.preserved] == [("Adobe colour transform", "It declares")]
    assert sum(b for b, _ in done.removed.values()) == len(file) - len(done.content) and set(done.removed) == {"exif", "xmp", "iptc", "ai"}
    some, _ = rewrite.rewritten(file, "jpeg", frozenset(["xmp"]))
    assert b"Ann" in some.content and b"<dc:rights>" not in some.content
    odd, _ = rewrite.rewritten(build(app(0xE1, b"Exif\0\0", b"no header")), "jpeg", frozenset(["gps"]))
    assert odd.content == build() and odd.warnings == ["EXIF could not be rewritten (no TIFF header); the whole block was removed"]
    old = tiff.write(rows(short(256, 5), (519, 4, 1, bytes(4), 0, None)))
    assert rewrite.rewritten(old, "tiff", dims.removed())[1].startswith("The file could not be rebuilt: This TIFF uses the deprecated")


def test_verified_in_one_row(spark, monkeypatch):
    files = files_of(spark, jpg=photo(adobe(0)), gif=b"GIF89a" + bytes(12), none=None)
    got = {r["file_id"]: r for r in cleaning.verified(files, dims.removed()).collect()}
    left = {(x["label"], x["reason"]) for x in got["jpg"]["remaining"]}
    assert left == {("Adobe colour transform", "It declares a non-default colour transform the decoder needs"), ("ICC colour profile", "Kept because its switch is off")}
    sizes = [r["bytes"] for r in got["jpg"]["removed"]]
    assert sizes == sorted(sizes, reverse=True) and got["jpg"]["bytes_removed"] == sum(sizes)
    assert got["gif"]["error"] == "unsupported-format" and got["gif"]["remaining"] is None and got["none"]["error"] == "empty-file"
    plan = cleaning.verified(files, dims.removed())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_what_cannot_be_cleaned_or_read_again(spark):
    # a file of which nothing would be left stays as it was
    files = files_of(spark, tif=tiff.write(rows(ascii_(271, "Maker"))), gif=b"GIF89a" + bytes(12))
    got = {r["file_id"]: r for r in cleaning.verified(files, dims.removed()).collect()}
    assert got["tif"]["error"] is None and [s["label"] for s in got["tif"]["after"]] == ["Make"] and got["tif"]["bytes_removed"] == 0
    assert got["gif"]["bytes_removed"] is None and got["gif"]["after"] == []
    assert bundle.as_struct(b"MM\0*" + bytes(20), "tiff") == (None, "no readable directory")
