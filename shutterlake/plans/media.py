"""Registered queries that build files from the tables, walk them, and hold the result against SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake import dims
from shutterlake.functions import icc, signals, xmp
from shutterlake.operators import exif, generators
from shutterlake.plans.catalog import dealt, query
from shutterlake.sources import jpeg, manifest, png, resources, tiff, webp


def _hex(digits: str) -> Column:
    return F.unhex(F.lit(digits))


def _big(n: Column | int, width: int = 4) -> Column:
    return F.unhex(F.lpad(F.hex(n if isinstance(n, Column) else F.lit(n)), 2 * width, "0"))


def _bytes(*parts: Column | bytes) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, bytes) else p.cast("binary") for p in parts))


def _files(rows: DataFrame, key: str, content: Column, *also: str) -> DataFrame:
    return rows.select(F.col(key).cast("string").alias("file_id"), *also, content.alias("content"))


def _key(rows: DataFrame, name: str) -> DataFrame:
    return rows.withColumn(name, F.col("file_id").cast("long")).drop("file_id")


_SIGNED = "(" + " OR ".join("regexp_matches(text, '" + p.replace("'", "''") + "')" for p in signals.STRONG) + " OR (" + " + ".join("CAST(regexp_matches(text, '" + p.replace("'", "''") + "') AS INT)" for p in signals.WEAK) + ") >= 2)"
_TURN = "conv_id * 1000 + turn"


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JPEG per turn, whose comment is the turn's text."""
    turns = dealt(spark, sf_dir, "conversations", "conv_id").withColumn("id", F.expr(_TURN))
    comment = jpeg.segment(F.lit(jpeg.COM), F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return _files(turns, "id", _bytes(_hex("FFD8FFE000104A46494600010100000100010000"), comment, _hex("FFC0000B080040003001011100FFDA00021234FF005678FFD9")))


@query(f"SELECT id, CASE WHEN strlen(text) >= 6 AND {_SIGNED} THEN 'ai' ELSE 'comment' END AS switch, strlen(text) + 4 AS bytes FROM (SELECT {_TURN} AS id, coalesce(text, '') AS text FROM conversations)")
def jpeg_comments(spark, sf_dir):
    rows = jpeg.decide(jpeg.parts(_pictures(spark, sf_dir)), dims.removed()).where(F.col("marker") == jpeg.COM)
    return _key(rows.select("file_id", "switch", "bytes"), "id")


@query(f"SELECT id, 20 + 13 + 4 + 6 + 2 + CASE WHEN strlen(text) >= 6 AND {_SIGNED} THEN 0 ELSE strlen(text) + 4 END AS n FROM (SELECT {_TURN} AS id, coalesce(text, '') AS text FROM conversations)")
def jpeg_clean_sizes(spark, sf_dir):
    out = jpeg.clean(_pictures(spark, sf_dir), dims.removed(comment=False))
    return _key(out.select("file_id", F.length("content").cast("long").alias("n")), "id")


@query(f"SELECT {_TURN} AS id, 48 AS width, 64 AS height, 1 AS components, 'Grayscale' AS color_space, false AS progressive FROM conversations")
def jpeg_frames(spark, sf_dir):
    found = jpeg.frames(jpeg.parts(_pictures(spark, sf_dir)))
    return _key(found.select("file_id", "width", "height", "components", "color_space", "progressive"), "id")


def _cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An EXIF payload per order: maker, orientation, an inner directory with exposure and speed, and a latitude."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    entry = lambda tag, form, count, value: _bytes(_big(tag, 2), _big(form, 2), _big(count), value)
    main = _bytes(_big(4, 2), entry(271, 2, 2, _bytes(F.col("o_orderstatus"), b"\0\0\0")), entry(274, 3, 1, _bytes(_big(key % 8 + 1, 2), b"\0\0")), entry(34665, 4, 1, _big(62)), entry(34853, 4, 1, _big(100)), _big(0))
    inner = _bytes(_big(2, 2), entry(33434, 5, 1, _big(92)), entry(34855, 3, 1, _bytes(_big(key % 6400, 2), b"\0\0")), _big(0), _big(1), _big(customer % 500 + 2))
    place = _bytes(_big(2, 2), entry(1, 2, 2, _bytes(F.when(key % 2 == 0, "S").otherwise("N"), b"\0\0\0")), entry(2, 5, 3, _big(130)), _big(0), _big(key % 90), _big(1), _big(customer % 60), _big(1), _big((key + customer) % 60), _big(1))
    return _files(dealt(spark, sf_dir, "orders", "o_orderkey"), "o_orderkey", _bytes(b"MM\0*", _big(8), main, inner, place))


_TURNS = "['" + "', '".join(exif.ORIENTATIONS) + "']"


@query(f"SELECT o_orderkey, 8 AS tag_count, 'big' AS byte_order, o_orderstatus AS make, {_TURNS}[CAST(o_orderkey % 8 + 1 AS INT)] AS orientation_label, '1/' || CAST(o_custkey % 500 + 2 AS VARCHAR) || ' s' AS exposure, CAST(o_orderkey % 6400 AS VARCHAR) AS iso FROM orders")
def exif_summary(spark, sf_dir):
    found = exif.summary(tiff.entries(_cameras(spark, sf_dir)))
    return _key(found.select("file_id", "tag_count", "byte_order", "make", "orientation_label", "exposure", "iso"), "o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN -m ELSE m END / 1000000.0::DOUBLE AS latitude, 2 AS tag_count FROM (SELECT o_orderkey, CAST(floor(((o_orderkey % 90) * 3600 + (o_custkey % 60) * 60 + (o_orderkey + o_custkey) % 60) * 1000000 / 3600.0::DOUBLE + 0.5) AS BIGINT) AS m FROM orders)")
def exif_position(spark, sf_dir):
    found = exif.position(tiff.entries(_cameras(spark, sf_dir)))
    return _key(found.select("file_id", "latitude", "tag_count"), "o_orderkey")


@query("SELECT o_orderstatus AS make, 5 AS entries, 0 AS gps, count(*) AS n FROM orders GROUP BY 1")
def exif_without_position(spark, sf_dir):
    out = tiff.rewritten(_cameras(spark, sf_dir), frozenset(["gps"]), embedded=True)
    placed = F.size(F.filter("kinds", lambda k: k == "gps")) + F.size(F.filter("tags", lambda t: t == 34853))
    maker = F.substring(F.get("values", F.nullif(F.array_position("tags", F.lit(271)), F.lit(0)) - 1), 1, 1).cast("string")
    per = out.select(F.size("tags").cast("long").alias("entries"), placed.cast("long").alias("gps"), maker.alias("make"))
    return per.groupBy("make", "entries", "gps").agg(F.count("*").alias("n"))


def _texts(spark: SparkSession, sf_dir: str, text: Column, key: str = "parameters") -> DataFrame:
    return dealt(spark, sf_dir, "part", "p_partkey").select(F.col("p_partkey").cast("string").alias("file_id"), F.lit(0).alias("ord"), F.lit(key).alias("key"), text.alias("text"), F.length(text).cast("long").alias("bytes"))


def _found(rows: DataFrame, *names: str) -> DataFrame:
    return _key(rows.select("file_id", *names), "p_partkey")


@query("SELECT p_partkey, 'automatic1111' AS generator, p_name AS prompt, p_type AS negative, CAST(p_size AS VARCHAR) AS steps, CAST(p_partkey AS VARCHAR) AS seed, p_brand || ', x' AS model FROM part")
def settings_blocks(spark, sf_dir):
    text = F.concat("p_name", F.lit("\nNegative prompt: "), "p_type", F.lit("\nSteps: "), F.col("p_size").cast("string"), F.lit(", Sampler: Euler, Seed: "), F.col("p_partkey").cast("string"), F.lit(', Model: "'), "p_brand", F.lit(', x"'))
    return _found(generators.findings(_texts(spark, sf_dir, text)), "generator", "prompt", "negative", "steps", "seed", "model")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'novelai' WHEN 1 THEN 'fooocus' ELSE 'stable-diffusion' END AS generator, p_name AS prompt, p_type AS negative, CAST(p_size AS VARCHAR) AS steps, CAST(p_size AS VARCHAR) || 'x64' AS size FROM part")
def json_generators(spark, sf_dir):
    shared = lambda *more: F.struct(F.col("p_name").alias("prompt"), F.col("p_size").alias("steps"), F.col("p_size").alias("width"), F.lit(64).alias("height"), *more)
    minus, kind = F.col("p_type"), F.col("p_partkey") % 3
    text = F.when(kind == 0, F.to_json(shared(minus.alias("uc"), F.lit("k").alias("sampler")))).when(kind == 1, F.to_json(shared(minus.alias("negative_prompt"), F.col("p_brand").alias("base_model")))).otherwise(F.to_json(F.struct(shared(minus.alias("negativeprompt")).alias("sui_image_params"))))
    return _found(generators.findings(_texts(spark, sf_dir, text, "x")), "generator", "prompt", "negative", "steps", "size")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'flux' ELSE 'comfyui' END AS generator, p_name AS prompt, p_type AS negative, CAST(p_partkey AS VARCHAR) AS seed FROM part")
def node_graphs(spark, sf_dir):
    node = lambda kind, **inputs: F.struct(F.lit(kind).alias("class_type"), F.struct(*(v.alias(k) for k, v in inputs.items())).alias("inputs"))
    link = lambda n: F.array(F.lit(n), F.lit("0"))
    graph = F.struct(
        node("KSampler", seed=F.col("p_partkey"), positive=link("4"), negative=link("3")).alias("1"),
        node("CLIPTextEncode", text=F.col("p_type")).alias("3"),
        node("ControlNetApply", conditioning=link("5")).alias("4"),
        node("CLIPTextEncode", text=F.col("p_name")).alias("5"),
        node("UNETLoader", unet_name=F.when(F.col("p_size") % 2 == 0, "flux1").otherwise("other")).alias("6"),
    )
    return _found(generators.findings(_texts(spark, sf_dir, F.to_json(graph), "workflow")), "generator", "prompt", "negative", "seed")


@query("""SELECT c_custkey, c_name AS creator, c_mktsegment || ' & co' AS title, true AS has_provenance, 'k' || CAST(c_nationkey AS VARCHAR) AS toolkit, strlen('<x:xmpmeta x:xmptk="k' || CAST(c_nationkey AS VARCHAR) || '"><rdf:RDF><dc:creator><rdf:Seq><rdf:li>' || c_name || '</rdf:li></rdf:Seq></dc:creator><dc:title>' || c_mktsegment || ' &amp; co</dc:title></rdf:RDF></x:xmpmeta>') AS left_bytes FROM customer""")
def xmp_packets(spark, sf_dir):
    body = _bytes(b'junk<x:xmpmeta x:xmptk="k', F.col("c_nationkey").cast("string"), b'"><rdf:RDF><dc:creator><rdf:Seq><rdf:li>', F.col("c_name"), b"</rdf:li></rdf:Seq></dc:creator><dc:title>", F.col("c_mktsegment"), b" &amp; co</dc:title><c2pa:manifest>urn:x</c2pa:manifest></rdf:RDF></x:xmpmeta>tail")
    # the packet is a column of its own, since every field reads it
    packets, text = dealt(spark, sf_dir, "customer", "c_custkey").select("c_custkey", body.alias("body")).select("c_custkey", xmp.packet(F.col("body")).cast("string").alias("text")), F.col("text")
    s = xmp.summary(text)
    return packets.select("c_custkey", s["creator"].alias("creator"), s["title"].alias("title"), s["has_provenance"].alias("has_provenance"), s["toolkit"].alias("toolkit"), F.octet_length(xmp.without_provenance(text)).cast("long").alias("left_bytes"))


_CLASSES, _SPACES = list(icc.CLASSES.items()), list(icc.SPACES.items())
_PICK = lambda col, pairs: f"CASE {col} % 7 " + " ".join(f"WHEN {i} THEN '{v}'" for i, (_, v) in enumerate(pairs)) + " END"


@query(f"SELECT c_custkey, {_PICK('c_custkey', _CLASSES)} AS device_class, {_PICK('c_nationkey', _SPACES)} AS color_space, c_name AS description, '4.2' AS version FROM customer")
def color_profiles(spark, sf_dir):
    code = lambda col, pairs: F.get(F.array(*(F.lit(k) for k, _ in pairs)), (F.col(col) % 7).cast("int"))
    name = F.col("c_name")
    data = _bytes(bytes(4), b"ADBE", b"\x04\x20\0\0", code("c_custkey", _CLASSES), code("c_nationkey", _SPACES), bytes(16), b"acsp", bytes(88), _big(1), b"desc", _big(144), _big(F.octet_length(name) + 12), b"desc", bytes(4), _big(F.octet_length(name)), name)
    s = icc.summary(F.col("data"))
    return dealt(spark, sf_dir, "customer", "c_custkey").select("c_custkey", data.alias("data")).select("c_custkey", *(s[n].alias(n) for n in ("device_class", "color_space", "description", "version")))


@query("SELECT c_custkey, c_name AS byline, c_mktsegment || ';' || CAST(c_nationkey AS VARCHAR) AS keywords, 3 AS field_count FROM customer")
def caption_records(spark, sf_dir):
    record = lambda n, v: _bytes(b"\x1c\x02" + bytes([n]), _big(F.octet_length(v), 2), v)
    iim = _bytes(record(25, F.col("c_mktsegment")), record(25, F.col("c_nationkey").cast("string")), record(80, F.col("c_name")))
    payload = _bytes(resources.LEADS[0], b"8BIM\x04\x04\0\0", _big(F.octet_length(iim)), iim)
    found = resources.resources(_files(dealt(spark, sf_dir, "customer", "c_custkey"), "c_custkey", payload)).where("id = 1028")
    s = resources.caption_summary(resources.records(found.select("file_id", F.col("data").alias("content"))))
    return _key(s.select("file_id", "byline", F.array_join("keywords", ";").alias("keywords"), "field_count"), "c_custkey")


@query("SELECT s_suppkey, s_name || ',c2pa' AS labels, true AS valid, 8 + 30 + 8 + (26 + strlen(s_name)) + (8 + 15 + 2 + strlen(s_name)) AS bytes, s_name AS claim_generator FROM supplier")
def signed_manifests(spark, sf_dir):
    box = lambda kind, *parts: _bytes(_big(F.octet_length(_bytes(*parts)) + 8), kind, *parts)
    about = lambda label: box(b"jumd", bytes(16), b"\x03", label, b"\0")
    name = F.col("s_name")
    claim = box(b"cbor", b"claim_generator", b"\x78", _big(F.octet_length(name), 1), name)
    payload = box(b"jumb", about(F.lit("c2pa")), box(b"jumb", about(name), claim))
    s = manifest.summary(_files(dealt(spark, sf_dir, "supplier", "s_suppkey"), "s_suppkey", payload))
    return _key(s.select("file_id", F.array_join("labels", ",").alias("labels"), "valid", "bytes", "claim_generator"), "s_suppkey")


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'adobe-firefly' WHEN 2 THEN 'generic' END AS generator, CASE WHEN p_size % 4 = 0 THEN 'likely' ELSE 'confirmed' END AS confidence FROM part WHERE p_size % 4 < 3")
def signers(spark, sf_dir):
    kind = F.col("p_size") % 4
    signer = F.when(kind == 0, F.concat(F.lit("DALL-E "), "p_brand")).when(kind == 1, F.concat(F.lit("Adobe Firefly "), "p_brand")).otherwise(F.col("p_brand"))
    found = signals.by_provenance(F.when(kind.between(1, 2), "http://x/trainedAlgorithmicMedia"), signer)
    return dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", found.alias("f")).where("f is not null").select("p_partkey", "f.*")


@query("SELECT p_partkey, 8 + 12 + strlen(p_name) + 2 + 12 AS n, 1 AS dropped FROM part")
def png_clean_sizes(spark, sf_dir):
    chunk = lambda kind, data: _bytes(_big(F.octet_length(data)), kind, data, _big(F.crc32(_bytes(kind, data))))
    files = _files(dealt(spark, sf_dir, "part", "p_partkey"), "p_partkey", _bytes(png.SIGNATURE, chunk(b"iCCP", _bytes(F.col("p_name"), b"\0\0")), chunk(b"eXIf", F.col("p_type")), chunk(b"IEND", F.lit(""))))
    before = png.chunks(files).groupBy("file_id").agg(F.count("*").alias("n0"))
    out = png.clean(files, dims.policy(spark))
    after = png.chunks(out).groupBy("file_id").agg(F.count("*").alias("n1"))
    return _key(out.join(before, "file_id").join(after, "file_id").select("file_id", F.length("content").cast("long").alias("n"), (F.col("n0") - F.col("n1")).alias("dropped")), "p_partkey")


@query("SELECT p_partkey, 12 + 8 + strlen(p_name) + strlen(p_name) % 2 AS n FROM part")
def webp_clean_sizes(spark, sf_dir):
    size = lambda c: F.concat(*(F.unhex(F.lpad(F.hex(F.shiftright(F.octet_length(c), 8 * k).bitwiseAND(255)), 2, "0")) for k in range(4)))
    pad = lambda c: F.when(F.octet_length(c) % 2 == 1, F.lit(b"\0")).otherwise(F.lit(b""))
    chunk = lambda kind, c: _bytes(kind, size(c), c, pad(c))
    body = _bytes(b"WEBP", chunk(b"VP8L", F.col("p_name")), chunk(b"EXIF", F.col("p_type")))
    out = webp.clean(_files(dealt(spark, sf_dir, "part", "p_partkey"), "p_partkey", _bytes(b"RIFF", size(body), body)), dims.policy(spark))
    return _key(out.select("file_id", F.length("content").cast("long").alias("n")), "p_partkey")
