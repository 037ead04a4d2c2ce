"""Signed manifests (nested boxes) as rows, and their summary."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions import text
from shutterlake.sources import walk

#: Fixed value: the identifier of a manifest box in image containers.
UUID = bytes.fromhex("d8fec3d61b0e483c92975828877ec481")
_DEPTH = 12


def boxes_of(content: bytes) -> Iterator[tuple[int, str, int, int, str | None]]:
    """(depth, type, offset, size, label) of every box; a description lends its label to the box around it."""
    stack = [(0, len(content), 0)]
    while stack:
        at, end, depth = stack.pop()
        while at + 8 <= end:
            size, kind, body = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8], at + 8
            if size == 1:
                size, body = int.from_bytes(content[body : body + 8], "big"), body + 8
            size = size or end - at
            if size < body - at or at + size > end:
                break
            yield depth, kind.decode("latin-1"), at, size, _label(content, body, at + size) if kind == b"jumb" else None
            if kind == b"jumb" and depth < _DEPTH:
                stack.append((at + size, end, depth))
                at, end, depth = body, at + size, depth + 1
            else:
                at += size


def _label(content: bytes, at: int, end: int) -> str | None:
    size = int.from_bytes(content[at : at + 4], "big")
    if content[at + 4 : at + 8] != b"jumd" or size < 25 or at + size > end or not content[at + 24] & 2:
        return None
    return content[at + 25 : at + size].split(b"\0")[0].decode("latin-1").strip() or None


def boxes(payloads: DataFrame) -> DataFrame:
    return walk.rows_of(payloads, boxes_of, "depth int, type string, offset long, bytes long, label string")


def _string_after(near: Column) -> Column:
    """The first CBOR text string of 2 to 200 printable bytes that starts in the first 24 of these bytes (in hex)."""
    byte = lambda i: F.conv(F.substring(near, i * 2 + 1, F.lit(2)), 16, 10).cast("int")

    def told(i: Column, head: Column) -> Column:
        size = F.when(head.between(0x60, 0x77), head - 0x60).when(head == 0x78, byte(i + 1))
        body = F.unhex(F.substring(near, (i + F.when(head == 0x78, 2).otherwise(1)) * 2 + 1, size * 2)).cast("string")
        # the head decides, so that a byte that starts no string costs no more
        return F.when(head.between(0x62, 0x78), F.when(size.between(2, 200), text.once(body, lambda b: F.when((F.length(b) == size) & b.rlike(r"^[\x20-\x7E]+$"), F.trim(b)))))

    return F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: text.once(byte(i), lambda head: told(i, head))), lambda t: t.isNotNull() & (F.length(t) > 1)), F.lit(0))


def claim_generator(content: Column) -> Column:
    """What a claim names as its generator; null where no key is followed by a string."""
    near = lambda key: F.regexp_extract(F.hex(content), rf"^(?:..)*?{key.encode().hex().upper()}((?:..){{0,224}})", 1)
    return F.coalesce(*(text.once(near(k), lambda found: F.when(found != "", _string_after(found))) for k in ("claim_generator_info", "claim_generator")))


def summary(payloads: DataFrame) -> DataFrame:
    """Bytes, distinct labels (inner boxes first), generator and whether a signature is there, per file."""
    held = boxes(payloads).groupBy("file_id").agg(F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct((F.col("offset") + F.col("bytes")).alias("end"), (-F.col("depth")).alias("depth"), "label")))).alias("l"))
    names = F.array_distinct(F.transform("l", lambda x: x["label"]))
    base = payloads.select("file_id", F.length("content").cast("long").alias("bytes"), claim_generator(F.col("content")).alias("claim_generator"))
    return base.join(held.select("file_id", names.alias("labels")), "file_id", "left").withColumn("valid", F.col("labels").isNotNull()).withColumn("has_signature", F.coalesce(F.exists("labels", lambda x: x.contains("signature")), F.lit(False)))
