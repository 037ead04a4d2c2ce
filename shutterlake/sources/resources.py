"""Photoshop resource blocks and the caption records inside them, as rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions import binary, text
from shutterlake.sources import walk

#: Leading bytes of a resource payload.
LEADS = (b"Photoshop 3.0\0", b"Adobe_Photoshop2.5\0")
#: Categories of resource ids; others are ``other``.
RESOURCES = {0x0404: "iptc", 0x0425: "iptc", 0x0424: "xmp", 0x0422: "exif", 0x0423: "exif", 0x040F: "icc"}
#: Datasets of the application record.
DATASETS = {"byline": 80, "byline_title": 85, "credit": 110, "source": 115, "copyright": 116, "caption": 120, "headline": 105, "city": 90, "country": 101, "created": 55}


def resources_of(payload: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(id, offset, padded size, data); names and data are padded to even sizes."""
    at = next((len(p) for p in LEADS if payload.startswith(p)), 0)
    while at + 12 <= len(payload) and payload[at : at + 4] == b"8BIM":
        data = at + 6 + (payload[at + 6] + 2) // 2 * 2 + 4
        size = int.from_bytes(payload[data - 4 : data], "big")
        if data + size > len(payload):
            return
        end = min(data + size + size % 2, len(payload))
        yield int.from_bytes(payload[at + 4 : at + 6], "big"), at, end - at, payload[data : data + size]
        at = end


def records_of(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(record, dataset, value); padding between records is passed over."""
    at = 0
    while (at := data.find(b"\x1c", at)) >= 0 and at + 5 <= len(data):
        size, body = int.from_bytes(data[at + 3 : at + 5], "big"), at + 5
        if size & 0x8000:
            wide, size = size & 0x7FFF, 0
            if wide > 4 or body + wide > len(data):
                return
            size, body = int.from_bytes(data[body : body + wide], "big"), body + wide
        if body + size > len(data):
            return
        yield data[at + 1], data[at + 2], data[body : body + size]
        at = body + size


def resources(payloads: DataFrame) -> DataFrame:
    rows = walk.rows_of(payloads, resources_of, "id int, offset long, bytes long, data binary")
    category = F.coalesce(*(F.when(F.col("id") == i, c) for i, c in RESOURCES.items()), F.lit("other"))
    return rows.withColumn("category", category)


def records(payloads: DataFrame) -> DataFrame:
    """Caption records of each (file_id, content), where content is the data of a caption resource."""
    return walk.rows_of(payloads, records_of, "record int, dataset int, value binary")


def caption_summary(rows: DataFrame) -> DataFrame:
    """First value per dataset, all keywords, and the number of fields, per file."""
    value, mine = text.utf8_or_latin1(F.col("value")), rows.where("record = 2")
    first = lambda n: F.nullif(F.min_by(value, F.when(F.col("dataset") == n, F.col("ord"))), F.lit(""))
    words = F.transform(F.array_sort(F.collect_list(F.when((F.col("dataset") == 25) & (value != ""), F.struct("ord", value.alias("v"))))), lambda x: x["v"])
    return mine.groupBy("file_id").agg(*(first(n).alias(name) for name, n in DATASETS.items()), words.alias("keywords"), F.count(F.when(F.col("dataset") != 0, 1)).alias("field_count"))


def caption_of(records: Column) -> Column:
    """The caption summary of a file's own array of (dataset, value); null without records."""
    value = lambda r: text.utf8_or_latin1(r["value"])
    first = lambda n: F.nullif(value(F.get(F.filter(records, lambda r: r["dataset"] == n), F.lit(0))), F.lit(""))
    words = F.filter(F.transform(F.filter(records, lambda r: r["dataset"] == 25), value), lambda v: v != "")
    count = F.size(F.filter(records, lambda r: r["dataset"] != 0)).cast("long")
    return F.when(F.size(records) > 0, F.struct(*(first(n).alias(name) for name, n in DATASETS.items()), words.alias("keywords"), count.alias("field_count")))


def assemble(rows: DataFrame) -> DataFrame:
    """(file_id, content) from resource rows, with empty names and even sizes."""
    size = F.length("data")
    block = F.concat(F.lit(b"8BIM"), F.unhex(F.lpad(F.hex("id"), 4, "0")), F.lit(b"\0\0"), F.unhex(F.lpad(F.hex(size), 8, "0")), F.col("data"), F.when(size % 2 == 1, F.lit(b"\0")).otherwise(F.lit(b"")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", block.alias("raw")))), lambda x: x["raw"])
    return rows.groupBy("file_id").agg(F.concat(F.lit(LEADS[0]), binary.joined(ordered)).alias("content"))
