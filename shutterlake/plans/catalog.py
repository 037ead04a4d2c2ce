"""Registered queries of the metadata engine, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake import dims
from shutterlake.functions import binary, captions, labels, xmp
from shutterlake.operators import generators, segments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Event types stand for metadata categories in queries over the given tables.
_AS_CATEGORY = {"click": "exif", "error": "other", "purchase": "icc", "signup": "gps", "view": "xmp"}
_SQL_CATEGORY = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _AS_CATEGORY.items()) + " END"


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Files made of a row are many times its size: so many rows to a task, and more only where tasks get this many.
ROWS_OF_FILES, MOST_TASKS = 2_000, 1_000


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """``read``, its rows dealt over tasks by a key, as a scan cuts a table by its bytes and not by the work of its rows.

    The number of tasks follows the number of rows, which the footers tell.
    """
    rows = read(spark, sf_dir, name)
    n = rows.count()
    return rows.repartition(max(1, min(-(-n // ROWS_OF_FILES), max(MOST_TASKS, -(-n // (10 * ROWS_OF_FILES))))), key)


def _event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in _AS_CATEGORY.items()))
    return read(spark, sf_dir, "events").select("event_id", category.alias("category"), F.floor(F.col("value") * 100).cast("long").alias("bytes"))


@query(f"SELECT {_SQL_CATEGORY} AS category, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS bytes, count(*) AS n FROM events WHERE {_SQL_CATEGORY} <> 'icc' GROUP BY 1")
def category_tally(spark, sf_dir):
    return segments.tally(_event_segments(spark, sf_dir), dims.policy(spark))


@query(f"SELECT event_id, {_SQL_CATEGORY} AS category, CAST(floor(value * 100) AS BIGINT) AS bytes FROM events WHERE {_SQL_CATEGORY} = 'icc'")
def kept_segments(spark, sf_dir):
    return segments.kept(_event_segments(spark, sf_dir), dims.policy(spark)).select("event_id", "category", "bytes")


_HEADS = ["ffd8ffe000104a4649460001", "89504e470d0a1a0a0000000d", "524946460000000057454250", "000000186674797061766966", "0000001866747970686569630000", "49492a000800000000000000", "4d4d002b0008000000000000", "474946383961000000000000", "424d00000000000000000000", "ffd8ff"]
_NAMES = ["jpeg", "png", "webp", "avif", "heic", "tiff", "tiff", "gif", "bmp", "unknown"]


@query("SELECT format, extension, count(*) AS n FROM (SELECT CASE event_id % 10 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END AS format FROM events) JOIN (VALUES " + ", ".join(f"('{f}', '{e}')" for f, e, _ in dims.FORMATS) + ") AS d(format, extension) USING (format) GROUP BY 1, 2")
def sniff_formats(spark, sf_dir):
    heads = F.array(*map(F.lit, _HEADS))
    content = F.unhex(F.element_at(heads, (F.col("event_id") % 10 + 1).cast("int")))
    found = read(spark, sf_dir, "events").select(binary.detect_format(content).alias("format"))
    return found.join(F.broadcast(dims.formats(spark)), "format").groupBy("format", "extension").agg(F.count("*").alias("n"))


@query("SELECT name, size, arrival FROM (SELECT p_name AS name, p_size AS size, p_partkey AS arrival FROM part ORDER BY p_partkey LIMIT 500) QUALIFY row_number() OVER (PARTITION BY name, size ORDER BY arrival) = 1")
def queue_dedup_cap(spark, sf_dir):
    files = read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_partkey").alias("arrival"))
    return segments.queue(files, 500, F.col("arrival"))


@query("SELECT l_returnflag, l_linestatus, l_extendedprice, l_orderkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) = 1")
def keep_largest_label(spark, sf_dir):
    ties = map(F.col, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return segments.largest_of(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_extendedprice"), *ties).select("l_returnflag", "l_linestatus", "l_extendedprice", "l_orderkey")


@query("SELECT o_custkey, o_orderpriority, n FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1")
def dominant_category(spark, sf_dir):
    counts = read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return segments.largest_of(counts, ["o_custkey"], F.col("n"), F.col("o_orderpriority"))


@query("SELECT s AS o_orderstatus, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('cancelled')) AS d(s) LEFT JOIN orders ON o_orderstatus = s GROUP BY 1")
def dense_status_counts(spark, sf_dir):
    statuses = spark.createDataFrame([("F",), ("O",), ("P",), ("cancelled",)], "o_orderstatus string")
    return segments.dense_counts(read(spark, sf_dir, "orders"), "o_orderstatus", statuses)


_RELOCATE = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"


@query(f"SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS size, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY {_RELOCATE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM lineitem")
def offset_relocation(spark, sf_dir):
    parts = read(spark, sf_dir, "lineitem").withColumn("size", F.col("l_quantity").cast("long"))
    return segments.relocate(parts, "l_orderkey", F.col("size"), *map(F.col, _RELOCATE.split(", "))).select("l_orderkey", "l_linenumber", "size", "offset")


@query("SELECT user_id, event_type FROM events WHERE event_type <> 'error' EXCEPT SELECT user_id, event_type FROM events WHERE value > 50")
def before_after_diff(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return segments.gone(e.where("event_type <> 'error'"), e.where("value > 50"), "user_id", "event_type")


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1")
def json_fields(spark, sf_dir):
    k = generators.said(F.try_parse_json("props"), "k").cast("long")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count("*").alias("n"))


def _sql_decimal(x: str) -> str:
    return f"CASE WHEN {x} >= 100 THEN CAST(CAST(floor({x} + 0.5) AS BIGINT) AS VARCHAR) ELSE CAST(CAST(floor({x} * 10 + 0.5) AS BIGINT) // 10 AS VARCHAR) || '.' || CAST(CAST(floor({x} * 10 + 0.5) AS BIGINT) % 10 AS VARCHAR) END"


@query(f"SELECT doc_id, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1048576 THEN {_sql_decimal('(n / 1024.0::DOUBLE)')} || ' KB' WHEN n < 1073741824 THEN {_sql_decimal('(n / 1048576.0::DOUBLE)')} || ' MB' ELSE {_sql_decimal('(n / 1073741824.0::DOUBLE)')} || ' GB' END AS label FROM (SELECT doc_id, n_chars * n_chars AS n FROM documents)")
def format_bytes_labels(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", labels.format_bytes(F.col("n_chars") * F.col("n_chars")).alias("label"))


#: Edges that are white space, for RE2.
_EDGES = r"^[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+|[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+$"
_TRIMMED = lambda x: f"regexp_replace({x}, '{_EDGES}', '', 'g')"


@query(r"""SELECT page_id, CASE WHEN length(s) = 0 THEN 'image' ELSE s END || '_clean.png' AS name FROM (SELECT page_id, """ + _TRIMMED(r"""regexp_replace(regexp_replace(url, '(?s)^(.+)\.[^.]*$', '\1'), '[\\/:*?"<>|]+', '_', 'g')""") + " AS s FROM pages)")
def clean_file_names(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", labels.cleaned_file_name(F.col("url"), F.lit("png")).alias("name"))


@query("SELECT conv_id, turn, role, substr(" + _TRIMMED("text") + ", 1, 60) || CASE WHEN length(text) > 60 THEN '…' ELSE '' END AS preview FROM conversations")
def comment_preview(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", labels.preview(F.col("text")).alias("preview"))


@query(r"SELECT doc_id, CASE WHEN length(c) > 4000 THEN substr(c, 1, 4000) || '…' ELSE c END AS clean, length(c) AS n, md5(c) AS whole_md5 FROM (SELECT doc_id, " + _TRIMMED(r"regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\x00-\x08\x0B-\x1F\x7F-\x{9F}]', '', 'g')") + " AS c FROM documents)")
def sanitize_text(spark, sf_dir):
    whole = labels.sanitized(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", labels.sanitize(F.col("text")).alias("clean"), F.length(whole).cast("long").alias("n"), F.md5(whole.cast("binary")).alias("whole_md5"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN -m ELSE m END / 1000000.0::DOUBLE AS degrees FROM (SELECT o_orderkey, CAST(floor(((o_orderkey % 90) * 3600 + (o_custkey % 60) * 60 + (o_orderkey + o_custkey) % 60) * 1000000 / 3600.0::DOUBLE + 0.5) AS BIGINT) AS m FROM orders)")
def gps_decimal(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return read(spark, sf_dir, "orders").select(o, labels.decimal_degrees(o % 90, c % 60, (o + c) % 60, F.when(o % 2 == 0, "S").otherwise("N")).alias("degrees"))


_SECONDS = "regexp_replace(printf('%.2f', round(a / b::DOUBLE, 2)), '\\.?0+$', '')"


@query(f"SELECT label, count(*) AS n FROM (SELECT CASE WHEN b = 0 THEN NULL WHEN a >= b THEN {_SECONDS} || ' s' ELSE '1/' || CAST(CAST(floor(b / greatest(a, 1)::DOUBLE + 0.5) AS BIGINT) AS VARCHAR) || ' s' END AS label FROM (SELECT l_linenumber AS a, l_orderkey % 400 AS b FROM lineitem)) GROUP BY 1")
def exposure_labels(spark, sf_dir):
    label = labels.exposure_label(F.col("l_linenumber"), F.col("l_orderkey") % 400).alias("label")
    return read(spark, sf_dir, "lineitem").select(label).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, printf('%.1f', round(l_discount * 1000, 1)) || '%' AS share, CASE WHEN l_quantity * l_suppkey = 0 THEN '—' WHEN l_quantity * l_suppkey / 1000.0::DOUBLE < 0.1 THEN printf('%.2f MP', round(l_quantity * l_suppkey / 1000.0::DOUBLE, 2)) ELSE printf('%.1f MP', round(l_quantity * l_suppkey / 1000.0::DOUBLE, 1)) END AS pixels FROM lineitem")
def percent_and_pixel_labels(spark, sf_dir):
    pixels = labels.format_megapixels(F.col("l_quantity").cast("long"), F.col("l_suppkey") * 1000)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", labels.format_percent(F.col("l_discount") * 1000).alias("share"), pixels.alias("pixels"))


@query("SELECT page_id, nullif(regexp_extract(html, '(?i)lang\\s*=\\s*\"([^\"]*)\"', 1), '') AS lang, nullif(trim(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&apos;', chr(39)), '&amp;', '&')), '') AS title FROM pages")
def xmp_like_property(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", xmp.read(F.col("html"), "lang").alias("lang"), xmp.read(F.col("html"), "title").alias("title"))


def _sql_without(html: str, name: str) -> str:
    forms = rf"(?is)\s*<{name}(?:\s[^>]*)?/>|\s*<{name}(?:\s[^>]*)?>.*?</{name}>|\s+{name}\s*=\s*(?:\"[^\"]*\"|''[^'']*'')".replace('\\"', '"')
    return f"regexp_replace({html}, '{forms}', '', 'g')"


@query(f"SELECT page_id, strlen({_sql_without(_sql_without(_sql_without('html', 'title'), 'style'), 'script')}) AS n FROM pages")
def strip_property(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.octet_length(xmp.without(F.col("html"), "title", "style", "script")).cast("long").alias("n"))


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in _AS_CATEGORY) + " FROM events GROUP BY 1")
def pivot_tags(spark, sf_dir):
    return segments.breakdown(read(spark, sf_dir, "events"), "user_id", F.col("event_type"), list(_AS_CATEGORY))


_CAPTION_SQL = "p_name || CASE p_partkey % 4 WHEN 0 THEN ' --ar 16:9 --v 6.1 --seed ' || p_size WHEN 1 THEN ' --seed ' || p_size WHEN 2 THEN ' by Midjourney' ELSE ' --niji 5' END"


def _captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    tail = F.when(kind == 0, F.concat(F.lit(" --ar 16:9 --v 6.1 --seed "), size)).when(kind == 1, F.concat(F.lit(" --seed "), size)).when(kind == 2, " by Midjourney").otherwise(" --niji 5")
    return read(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", tail).alias("text"))


@query(f"SELECT p_partkey, trim(string_split_regex(t, '\\s--')[1]) AS prompt, nullif(regexp_extract(t, '(?i)--(?:v|version)\\s+([^\\s-][^\\s]*)', 1), '') AS version, nullif(regexp_extract(t, '(?i)--(?:ar|aspect)\\s+([^\\s-][^\\s]*)', 1), '') AS aspect, nullif(regexp_extract(t, '(?i)--(?:seed)\\s+([^\\s-][^\\s]*)', 1), '') AS seed, CASE WHEN regexp_matches(t, '(?i)midjourney') THEN 'confirmed' ELSE 'likely' END AS confidence FROM (SELECT p_partkey, {_CAPTION_SQL} AS t FROM part) WHERE regexp_matches(t, '(?i)midjourney') OR regexp_matches(t, '(?i)--(?:v|version|ar|aspect|niji|stylize)\\b')")
def caption_flags(spark, sf_dir):
    found = _captions(spark, sf_dir).select("p_partkey", captions.caption(F.col("text")).alias("m"))
    return found.where("m is not null").select("p_partkey", "m.*")


@query("SELECT p_partkey, list_aggregate(list_distinct(l), 'count') AS n, l[1] AS first FROM (SELECT p_partkey, regexp_extract_all(p_name || ' <lora:' || p_brand || ':0.8> <lora:' || p_brand || ':0.4> <lora:s' || p_size || '>', '<lora:([^:>]+)', 1) AS l FROM part)")
def lora_names(spark, sf_dir):
    brand = F.col("p_brand")
    text = F.concat("p_name", F.lit(" <lora:"), brand, F.lit(":0.8> <lora:"), brand, F.lit(":0.4> <lora:s"), F.col("p_size").cast("string"), F.lit(">"))
    return read(spark, sf_dir, "part").select("p_partkey", captions.lora_names(text).alias("l")).select("p_partkey", F.size("l").cast("long").alias("n"), F.element_at("l", 1).alias("first"))


@query("SELECT f.mime, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents JOIN (VALUES " + ", ".join(f"({i}, '{m}')" for i, (_, _, m) in enumerate(dims.FORMATS)) + ") AS f(k, mime) ON doc_id % 9 = f.k GROUP BY 1")
def mime_lookup(spark, sf_dir):
    names = F.array(*(F.lit(f) for f, _, _ in dims.FORMATS))
    docs = read(spark, sf_dir, "documents").select("n_chars", F.element_at(names, (F.col("doc_id") % 9 + 1).cast("int")).alias("format"))
    return docs.join(F.broadcast(dims.formats(spark)), "format").groupBy("mime").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
