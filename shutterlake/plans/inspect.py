"""Registered queries over files that hold every kind of payload: reports, detections, merged findings, entry-wise cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake import dims
from shutterlake.functions import labels
from shutterlake.operators import archive, cleaning, report
from shutterlake.plans.catalog import dealt, query, read
from shutterlake.plans.media import _big, _bytes, _files, _hex, _key
from shutterlake.plans.report import _box, _chunk, _little, _riff
from shutterlake.sources import jpeg, png, resources

_HEAD = "FFD8FFE000104A46494600010100000100010000"
_TAIL = "FFC0000B080040003001011100FFDA00021234FF005678FFD9"
_ADOBE = "FFEE000E41646F626500640000000000"


def _profile(name: Column) -> Column:
    """A colour profile with one description."""
    return _bytes(bytes(4), b"ADBE", b"\x04\x20\0\0", b"mntr", b"RGB ", bytes(16), b"acsp", bytes(88), _big(1), b"desc", _big(144), _big(F.octet_length(name) + 12), b"desc", bytes(4), _big(F.octet_length(name)), name)


def _record(n: int, value: Column) -> Column:
    return _bytes(b"\x1c\x02" + bytes([n]), _big(F.octet_length(value), 2), value)


def _packet(creator: Column, title: Column) -> Column:
    return _bytes(b'<x:xmpmeta x:xmptk="k"><rdf:RDF><dc:creator>', creator, b"</dc:creator><dc:title>", title, b"</dc:title><dcterms:provenance>urn:x</dcterms:provenance></rdf:RDF></x:xmpmeta>")


def _manifest(label: Column, signer: Column) -> Column:
    about = lambda name: _box(b"jumd", bytes(16), b"\x03", name, b"\0")
    return _box(b"jumb", about(F.lit("c2pa")), _box(b"jumb", about(label), _box(b"cbor", b"claim_generator", b"\x78", _big(F.octet_length(signer), 1), signer)))


def _entry(tag: int, form: int, count: Column | int, value: Column) -> Column:
    return _bytes(_big(tag, 2), _big(form, 2), _big(count), value)


def _app(marker: int, *parts: Column | bytes) -> Column:
    return jpeg.segment(F.lit(marker), _bytes(*parts))


def _camera(key: Column) -> Column:
    """EXIF: maker, a position and a comment in an inner directory; its values lie behind the tables."""
    main = _bytes(_big(3, 2), _entry(271, 2, 4, F.lit("Abc\0")), _entry(34665, 4, 1, _big(50)), _entry(34853, 4, 1, _big(68)), _big(0))
    inner = _bytes(_big(1, 2), _entry(34855, 3, 1, _bytes(_big(key % 6400, 2), b"\0\0")), _big(0))
    place = _bytes(_big(2, 2), _entry(1, 2, 2, F.lit("N\0\0\0")), _entry(2, 5, 3, _big(98)), _big(0), _big(key % 90), _big(1), _big(0), _big(1), _big(0), _big(1))
    return _bytes(b"MM\0*", _big(8), main, inner, place)


def _photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer a JPEG with EXIF, a packet, captions, a profile in three segments out of order and a comment with settings."""
    key, name, kind = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    profile = _profile(name)
    third = F.lit(60)
    part = lambda n, at, size: _app(0xE2, b"ICC_PROFILE\0" + bytes([n, 3]), F.substring(profile, F.lit(at + 1), size))
    captions = _bytes(_record(80, name), _record(25, kind))
    return _files(
        dealt(spark, sf_dir, "customer", "c_custkey"),
        "c_custkey",
        _bytes(
            _hex(_HEAD),
            _app(0xE1, b"Exif\0\0", _camera(key)),
            _app(0xE1, b"http://ns.adobe.com/xap/1.0/\0", _packet(name, kind)),
            _app(0xED, resources.LEADS[0], b"8BIM\x04\x04\0\0", _big(F.octet_length(captions)), captions),
            part(2, 60, third),
            part(1, 0, third),
            part(3, 120, F.octet_length(profile) - 120),
            _app(0xFE, name, b"\nSteps: 20, Sampler: Euler, Seed: ", key.cast("string")),
            _hex(_ADOBE),
            _hex(_TAIL),
        ),
    )


_NAME, _KIND = "strlen(c_name)", "strlen(c_mktsegment)"
_CAPTIONS = f"(5 + {_NAME} + 5 + {_KIND})"
_PACKET = f"(strlen('<x:xmpmeta x:xmptk=\"k\"><rdf:RDF><dc:creator></dc:creator><dc:title></dc:title><dcterms:provenance>urn:x</dcterms:provenance></rdf:RDF></x:xmpmeta>') + {_NAME} + {_KIND})"
_PARTS = {"exif": "(4 + 6 + 122)", "xmp": f"(4 + 29 + {_PACKET})", "iptc": f"(4 + 14 + 12 + {_CAPTIONS})", "icc": f"(3 * 18 + 156 + {_NAME})", "ai": f"(4 + {_NAME} + strlen(chr(10) || 'Steps: 20, Sampler: Euler, Seed: ') + strlen(c_custkey::VARCHAR))", "other": "16"}
_SOME = " + ".join(_PARTS.values())


@query(f"SELECT c_custkey, 20 + 25 + {_SOME} AS file_size, {_SOME} AS metadata_bytes, 'Abc' AS make, (c_custkey % 6400)::VARCHAR AS iso, (c_custkey % 90)::DOUBLE AS latitude, c_name AS profile, 156 + {_NAME} AS profile_bytes, c_name AS byline, c_mktsegment AS keywords, c_name AS creator, c_mktsegment AS title, true AS has_provenance, 'automatic1111' AS generator, c_custkey::VARCHAR AS seed, 48 AS width, 0.003072::DOUBLE AS megapixels FROM customer")
def file_reports(spark, sf_dir):
    r = report.inspect(_photos(spark, sf_dir))
    first = F.get(F.col("ai"), F.lit(0))
    return _key(r.select("file_id", "file_size", "metadata_bytes", "exif.make", "exif.iso", "gps.latitude", F.col("icc.description").alias("profile"), F.col("icc.bytes").alias("profile_bytes"), "iptc.byline", F.array_join("iptc.keywords", ";").alias("keywords"), "xmp.creator", "xmp.title", "xmp.has_provenance", first["generator"].alias("generator"), first["seed"].alias("seed"), "container.width", "megapixels"), "c_custkey")


@query(f"SELECT c_custkey, unnest(['{"', '".join(_PARTS).replace("ai", "comment")}', 'gps']) AS category, unnest([{', '.join(f'{v}::BIGINT' for v in _PARTS.values())}, 0]) AS bytes FROM customer")
def report_categories(spark, sf_dir):
    r = report.inspect(_photos(spark, sf_dir))
    return _key(r.select("file_id", F.explode("categories").alias("category", "v")).select("file_id", "category", F.col("v")["bytes"].alias("bytes")), "c_custkey")


@query("SELECT c_custkey, unnest(range(1, 7)) AS place, unnest(['gps', 'ai', 'exif', 'xmp', 'iptc', 'icc']) AS key, unnest(['GPS', 'Automatic1111 / WebUI', 'EXIF', 'XMP', 'IPTC', 'ICC']) AS label, unnest([NULL, c_name, 'Abc', NULL, NULL, c_name]) AS detail FROM customer")
def detection_lists(spark, sf_dir):
    found = report.detections(report.inspect(_photos(spark, sf_dir)))
    flat = found.select("file_id", F.posexplode("detections").alias("place", "d"))
    return _key(flat.select("file_id", (F.col("place") + 1).cast("long").alias("place"), "d.key", "d.label", "d.detail"), "c_custkey")


@query(f"SELECT c_custkey, unnest(['Adobe colour transform', 'ICC colour profile', 'EXIF']) AS label, unnest([16, greatest(78, {_NAME} + 54), 66])::BIGINT AS bytes, unnest(['It declares a non-default colour transform the decoder needs', 'Kept because its switch is off', 'Kept because its switch is off']) AS reason FROM customer")
def remaining_parts(spark, sf_dir):
    # EXIF stays but for the position, the profile stays, and the colour marker has to
    rows = cleaning.verified(_photos(spark, sf_dir), dims.removed(exif=False))
    return _key(rows.select("file_id", F.explode("remaining").alias("r")).select("file_id", "r.label", "r.bytes", "r.reason"), "c_custkey")


@query(f"SELECT c_custkey, unnest(['xmp', 'iptc', 'ai', 'gps']) AS category, unnest([{_PARTS['xmp']}, {_PARTS['iptc']}, {_PARTS['ai']}, 66])::BIGINT AS bytes FROM customer")
def removal_tallies(spark, sf_dir):
    rows = cleaning.clean(_photos(spark, sf_dir), dims.removed(exif=False))
    return _key(rows.select("file_id", F.explode("removed").alias("r")).select("file_id", "r.category", "r.bytes"), "c_custkey")


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per supplier a TIFF with a packet, captions, a profile and a manifest in tags of their own, and a tag that no table knows."""
    key, name = F.col("s_suppkey"), F.col("s_name")
    values = [(305, 2, F.concat(name, F.lit("\0\0\0\0"))), (700, 1, _packet(name, F.lit("t"))), (33723, 7, _record(80, name)), (34675, 7, _profile(name)), (50000, 2, F.concat(name, F.lit("\0\0\0\0"))), (52545, 7, _manifest(F.lit("c2pa.claim"), name))]
    # values are columns of their own, since lengths and places read them again
    rows = dealt(spark, sf_dir, "supplier", "s_suppkey").select("*", *(value.cast("binary").alias(f"_v{tag}") for tag, _, value in values))
    at, table, behind = F.lit(8 + 2 + 12 * (len(values) + 1) + 4), [_entry(256, 3, 1, _bytes(_big(key % 1000 + 1, 2), b"\0\0"))], []
    for tag, form, value in ((tag, form, F.col(f"_v{tag}")) for tag, form, _ in values):
        table.append(_entry(tag, form, F.octet_length(value), _big(at)))
        behind.append(value)
        at = at + F.octet_length(value)
    return _files(rows, "s_suppkey", _bytes(b"MM\0*", _big(8), _big(len(values) + 1, 2), *table, _big(0), *behind))


@query("SELECT s_suppkey, s_name AS software, s_name AS creator, s_name AS byline, s_name AS profile, s_name AS claim_generator, 'c2pa.claim,c2pa' AS assertions, 7 AS tag_count, s_suppkey % 1000 + 1 AS width, 'TIFF private tag (JUMBF)' AS location FROM supplier")
def tiff_reports(spark, sf_dir):
    r = report.inspect(_scans(spark, sf_dir))
    return _key(r.select("file_id", "exif.software", "xmp.creator", "iptc.byline", F.col("icc.description").alias("profile"), "c2pa.claim_generator", F.array_join("c2pa.assertions", ",").alias("assertions"), "exif.tag_count", "container.width", "c2pa.location"), "s_suppkey")


@query("SELECT label, detail, category, count(*) AS n FROM (SELECT unnest(['Software', 'XMP', 'IPTCNAA', 'InterColorProfile', 'Tag 0xc350', 'Tag 0xcd41']) AS label, unnest([s_name, (147 + strlen(s_name))::VARCHAR || ' byte(s)', (5 + strlen(s_name))::VARCHAR || ' byte(s)', (156 + strlen(s_name))::VARCHAR || ' byte(s)', s_name, (8 + 30 + 8 + 36 + 8 + 17 + strlen(s_name))::VARCHAR || ' byte(s)']) AS detail, unnest(['exif', 'xmp', 'iptc', 'icc', 'other', 'c2pa']) AS category FROM supplier) GROUP BY ALL")
def tag_segments(spark, sf_dir):
    r = report.inspect(_scans(spark, sf_dir)).select(F.explode("segments").alias("s"))
    return r.groupBy("s.label", "s.detail", "s.category").agg(F.count("*").alias("n"))


@query("SELECT name, count(*) AS n FROM (SELECT CASE l_suppkey % 6 WHEN 0 THEN 'Make' WHEN 1 THEN 'Orientation' WHEN 2 THEN 'GPSLatitude' WHEN 3 THEN 'UserComment' WHEN 4 THEN 'Tag 0xbeef' ELSE 'GPSDateStamp' END AS name FROM lineitem) GROUP BY 1")
def tag_names(spark, sf_dir):
    pick = F.col("l_suppkey") % 6
    tag = F.element_at(F.array(*(F.lit(t) for t in (271, 274, 2, 37510, 0xBEEF, 29))), (pick + 1).cast("int"))
    rows = read(spark, sf_dir, "lineitem").select(pick.isin(2, 5).alias("gps"), tag.alias("tag"))
    # the dictionary has one row for each named tag
    named = rows.join(F.broadcast(dims.tags(spark)), ["gps", "tag"], "left")
    unknown = F.concat(F.lit("Tag 0x"), F.lower(F.lpad(F.hex("tag"), 4, "0")))
    return named.select(F.coalesce("name", unknown).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part a PNG with settings, signed by a tool of the same generator or of another one, or by none."""
    name, key = F.col("p_name"), F.col("p_partkey")
    signer = F.when(key % 3 == 0, "ComfyUI 1").when(key % 3 == 1, "DALL-E 3").otherwise("a camera")
    graph = _bytes(b'prompt\0{"1": {"class_type": "KSampler", "inputs": {"seed": ', key.cast("string"), b', "positive": ["2", 0]}}, "2": {"class_type": "CLIPTextEncode", "inputs": {"text": "', name, b'"}}}')
    content = _bytes(png.SIGNATURE, _chunk(b"IHDR", _bytes(_big(2), _big(2), b"\x08\x06\0\0\0")), _chunk(b"tEXt", graph), _chunk(b"caBX", _manifest(F.lit("c2pa.claim"), signer)), _chunk(b"IEND", F.lit("").cast("binary")))
    return _files(dealt(spark, sf_dir, "part", "p_partkey"), "p_partkey", content)


@query("""SELECT p_partkey, unnest(CASE WHEN p_partkey % 3 = 1 THEN ['comfyui', 'openai'] ELSE ['comfyui'] END) AS generator, unnest(CASE WHEN p_partkey % 3 = 1 THEN ['confirmed', 'likely'] ELSE ['confirmed'] END) AS confidence,
 unnest(CASE WHEN p_partkey % 3 = 1 THEN [p_name, NULL] ELSE [p_name] END) AS prompt, unnest(CASE p_partkey % 3 WHEN 0 THEN ['Assertions,Claim generator,Seed'] WHEN 1 THEN ['Seed', 'Assertions,Claim generator'] ELSE ['Seed'] END) AS names FROM part""")
def merged_findings(spark, sf_dir):
    r = report.inspect(_signed(spark, sf_dir)).select("file_id", F.explode("ai").alias("a"))
    return _key(r.select("file_id", "a.generator", "a.confidence", "a.prompt", F.array_join(F.array_sort(F.map_keys("a.fields")), ",").alias("names")), "p_partkey")


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part, by its key: a PNG with EXIF and a packet, or a WebP with EXIF and a packet; pixels are its name."""
    key, name = F.col("p_partkey"), F.col("p_name")
    packet = _packet(name, F.col("p_type"))
    pic = _bytes(png.SIGNATURE, _chunk(b"IHDR", _bytes(_big(2), _big(2), b"\x08\x06\0\0\0")), _chunk(b"eXIf", _camera(key)), _chunk(b"iTXt", _bytes(png.XMP_KEY, b"\0\0\0\0\0", packet)), _chunk(b"IDAT", name.cast("binary")), _chunk(b"IEND", F.lit("").cast("binary")))
    body = _bytes(b"WEBP", _riff(b"VP8X", _bytes(b"\x0c\0\0\0", bytes(6))), _riff(b"VP8L", name.cast("binary")), _riff(b"EXIF", _camera(key)), _riff(b"XMP ", packet))
    return _files(dealt(spark, sf_dir, "part", "p_partkey"), "p_partkey", F.when(key % 2 == 0, pic).otherwise(_bytes(b"RIFF", _little(F.octet_length(body)), body)), "p_name")


@query("""SELECT p_partkey, 'Abc' AS make, (p_partkey % 6400)::VARCHAR AS iso, NULL::DOUBLE AS latitude, p_name AS creator, false AS has_provenance, 66 + strlen('<dcterms:provenance>urn:x</dcterms:provenance>') + CASE WHEN p_partkey % 2 = 1 THEN (strlen(p_name) + strlen(p_type) + 105) % 2 - (strlen(p_name) + strlen(p_type) + 151) % 2 ELSE 0 END AS lost, position(p_name in p_name) AS pixels FROM part""")
def nested_rewrites(spark, sf_dir):
    # the position and the link to a manifest go, the rest of EXIF and of the packet stays
    done = cleaning.read_again(_nested(spark, sf_dir), frozenset(["gps", "c2pa"]), "file_id string, p_name string")
    kept = (F.position(F.col("p_name").cast("binary"), F.col("content")) > 0).cast("long")
    back = report.of_bundles(done.withColumns({"lost": F.col("bytes_removed"), "pixels": kept}).drop("content", "p_name"), "lost", "pixels")
    return _key(back.select("file_id", "exif.make", "exif.iso", "gps.latitude", "xmp.creator", "xmp.has_provenance", "lost", "pixels"), "p_partkey")


@query("SELECT lang, name, sum(30 + strlen(name) + strlen(text)) OVER (PARTITION BY lang ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS place, 30 + strlen(name) + strlen(text) AS bytes FROM (SELECT lang, 'doc-' || doc_id || '.txt' AS name, coalesce(text, '') AS text FROM documents)")
def archive_places(spark, sf_dir):
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    files = read(spark, sf_dir, "documents").select("lang", name.alias("name"), F.col("text").cast("binary").alias("content"))
    # local parts say their name themselves
    found = archive.parts(files, "lang").where(F.substring("data", 1, 4) == F.lit(b"PK\3\4"))
    length = F.conv(F.hex(F.concat(F.substring("data", 28, 1), F.substring("data", 27, 1))), 16, 10).cast("int")
    return found.select("lang", F.substring("data", F.lit(31), length).cast("string").alias("name"), F.when(F.col("at") > 0, F.col("at")).alias("place"), F.length("data").cast("long").alias("bytes"))


@query("SELECT page_id, substr(regexp_replace(url, '[\\\\/:*?\"<>|]', '', 'g'), 1, 24) AS suffix FROM pages")
def file_name_suffixes(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", labels.file_name_suffix(F.col("url")).alias("suffix"))
