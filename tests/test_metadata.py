import struct

from pyspark.sql import functions as F

from shutterlake.functions import icc, xmp
from shutterlake.sources import manifest, resources


def files_of(spark, **files):
    return spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in files.items()], "file_id string, content binary")


PACKET = """<?xpacket begin="x"?><x:xmpmeta x:xmptk="Kit &amp;lt; 1"><rdf:RDF><rdf:Description c2pa:manifest="urn:1" xmp:CreatorTool='Tool'>
<dc:creator><rdf:Seq><rdf:li>Jo &#66; &#x43;</rdf:li><rdf:li>Al</rdf:li></rdf:Seq></dc:creator>
<dc:description><rdf:Alt><rdf:li>Steps: 20, Sampler: Euler</rdf:li></rdf:Alt></dc:description><dc:title>Plain</dc:title>
<sdxl:seed>5</sdxl:seed><Iptc4xmpExt:DigitalSourceType>http://x/trainedAlgorithmicMedia</Iptc4xmpExt:DigitalSourceType>
</rdf:Description></rdf:RDF></x:xmpmeta><?xpacket end="w"?>"""


def test_xmp(spark):
    df = files_of(spark, a=b"\x00junk" + PACKET.encode() + b"tail", b=b"no packet", c=b"<x:xmpmeta>cut", n=None)
    found = {r["file_id"]: r["p"] and bytes(r["p"]) for r in df.select("file_id", xmp.packet(F.col("content")).alias("p")).collect()}
    assert found == {"a": PACKET.encode(), "b": None, "c": b"<x:xmpmeta>cut", "n": None}
    t = spark.createDataFrame([(PACKET,), (None,), ("",)], "x string")
    x = F.col("x")
    got = t.select(xmp.summary(x).alias("s"), xmp.read_list(x, "dc:creator").alias("all"), xmp.without_provenance(x).alias("np"), xmp.without_generator(x).alias("ng")).collect()
    s = got[0]["s"]
    assert (s["toolkit"], s["creator"], s["title"], s["description"], s["has_provenance"]) == ("Kit &lt; 1", "Jo B C", "Plain", "Steps: 20, Sampler: Euler", True)
    assert got[0]["all"] == ["Jo B C", "Al"]
    assert "c2pa:manifest" not in got[0]["np"] and "Plain" in got[0]["np"]
    assert not any(w in got[0]["ng"] for w in ("Sampler", "sdxl", "Algorithmic")) and "<dc:title>Plain</dc:title>" in got[0]["ng"]
    assert got[1]["s"]["creator"] is None and got[1]["ng"] is None and got[2]["ng"] == ""


def record(n, value, rec=2):
    return b"\x1c" + bytes([rec, n]) + struct.pack(">H", len(value)) + value


def test_resources_and_records(spark):
    iim = record(0, b"\0\4") + record(25, b"one") + b"\0" + record(25, "zwei ü".encode()) + record(80, b"caf\xe9") + b"\x1c\2\x78\x80\4" + struct.pack(">I", 5) + b"Hello" + record(5, b"x", rec=1)
    block = lambda i, name, d: b"8BIM" + struct.pack(">H", i) + bytes([len(name)]) + name + b"\0" * ((len(name) + 1) % 2) + struct.pack(">I", len(d)) + d + b"\0" * (len(d) % 2)
    payload = resources.LEADS[0] + block(0x0404, b"", iim) + block(0x03ED, b"nam", b"abc") + block(0x040F, b"ab", b"icc")
    rows = resources.resources(files_of(spark, a=payload, cut=payload[:40], n=None))
    assert [(r["id"], r["category"], bytes(r["data"])) for r in rows.where("file_id = 'a'").orderBy("ord").collect()] == [(0x0404, "iptc", iim), (0x03ED, "other", b"abc"), (0x040F, "icc", b"icc")]
    s = resources.caption_summary(resources.records(rows.where("id = 1028").select("file_id", F.col("data").alias("content")))).first()
    assert (s["byline"], s["caption"], s["keywords"], s["field_count"], s["city"]) == ("café", "Hello", ["one", "zwei ü"], 4, None)
    back = resources.assemble(rows.where("category <> 'iptc' and file_id = 'a'")).first()["content"]
    assert bytes(back) == resources.LEADS[0] + block(0x03ED, b"", b"abc") + block(0x040F, b"", b"icc")


def test_icc(spark):
    head = bytearray(128)
    head[4:8], head[8:10], head[12:16], head[16:20], head[36:40] = b"ADBE", b"\x02\x40", b"mntr", b"RGB ", b"acsp"
    text = b"desc\0\0\0\0" + struct.pack(">I", 6) + b"sRGB 1"
    wide = b"mluc\0\0\0\0" + struct.pack(">II", 1, 12) + b"enUS" + struct.pack(">II", 4, 28) + "é1".encode("utf-16-be")
    profile = lambda d: bytes(head) + struct.pack(">I", 1) + b"desc" + struct.pack(">II", 144, len(d)) + d
    df = files_of(spark, a=profile(text), m=profile(wide), none=bytes(head) + bytes(4), bad=b"x", n=None)
    got = {r["file_id"]: r["s"] for r in df.select("file_id", icc.summary(F.col("content")).alias("s")).collect()}
    assert tuple(got["a"])[1:] == ("ADBE", "2.4", "Display device", "RGB", "sRGB 1")
    assert got["m"]["description"] == "é1" and got["none"]["description"] is None and tuple(got["bad"]) == (1, None, None, None, None, None)


def test_manifest(spark):
    box = lambda k, d: struct.pack(">I", len(d) + 8) + k + d
    about = lambda s: box(b"jumd", bytes(16) + b"\3" + s + b"\0")
    claim = box(b"cbor", b"\xa1\x6fclaim_generator\x6aTool/1.0 x")
    payload = box(b"jumb", about(b"c2pa") + box(b"jumb", about(b"c2pa.claim") + claim) + box(b"jumb", about(b"c2pa.signature")))
    got = {r["file_id"]: r for r in manifest.summary(files_of(spark, a=payload, junk=b"no boxes here", n=None)).collect()}
    assert got["a"]["labels"] == ["c2pa.claim", "c2pa.signature", "c2pa"] and got["a"]["has_signature"] and got["a"]["claim_generator"] == "Tool/1.0 x"
    assert got["a"]["bytes"] == len(payload) and not got["junk"]["valid"] and got["n"]["claim_generator"] is None
