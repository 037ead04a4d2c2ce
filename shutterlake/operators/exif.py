"""Summaries of TIFF entries: camera, exposure and position, one row per file."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from shutterlake.functions import labels, text
from shutterlake.sources import tiff

#: Names of the eight orientations.
ORIENTATIONS = ["Normal", "Mirrored horizontally", "Rotated 180°", "Mirrored vertically", "Mirrored horizontally, rotated 270°", "Rotated 90° clockwise", "Mirrored horizontally, rotated 90°", "Rotated 270° clockwise"]
TEXTS = tiff.CAMERA_TEXTS


@F.pandas_udf(ArrayType(DoubleType()))
def _numbers(value: pd.Series, form: pd.Series, little: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else [float(x) for x in tiff.numbers_of(v, int(f), bool(e))] for v, f, e in zip(value, form, little, strict=True)])


def _of_rows(kind: str, tag: int, field: str) -> Column:
    """A field of the first such entry of a group of rows, by order in the file."""
    return F.min_by(F.col(field), F.when((F.col("kind") == kind) & (F.col("tag") == tag), F.col("ord")))


def _text(data: Column) -> Column:
    return text.some(text.strip(text.latin1(data)))


def _with_numbers(rows: DataFrame, tags: Sequence[int]) -> DataFrame:
    wanted = F.col("tag").isin(*tags)
    return rows.withColumn("n", _numbers(F.when(wanted, F.col("value")), "type", "little"))


def _camera_values() -> dict[str, Column]:
    """What the summary needs of a group of entry rows."""
    number = lambda kind, tag: F.get(_of_rows(kind, tag, "n"), F.lit(0))
    own = {name: _of_rows(*at, "value") for name, at in (TEXTS | tiff.CAMERA_BYTES).items()} | {name: number(*at) for name, at in tiff.CAMERA_NUMBERS.items()}
    thumb = F.min_by("n", F.when((F.col("path") == "1") & (F.col("tag") == 514), F.col("ord")))
    return own | {"_maker": F.length(_of_rows("exif", 37500, "value")), "_thumb": F.get(thumb, F.lit(0)), "_little": F.first("little"), "tag_count": F.count("*")}


def _camera(c: Callable[[str], Column]) -> list[Column]:
    """Camera, lens, dates, exposure and sizes from the values by name."""
    t = {name: _text(c(name)) for name in TEXTS}
    s, o = c("_exposure"), c("_orientation").cast("int")
    description = F.coalesce(_text(c("_description")), text.strip(text.utf16(c("_xp"), True)))
    exposure = F.when(s >= 1, F.concat(labels.short(s, 2), F.lit(" s"))).when(s > 0, F.concat(F.lit("1/"), F.floor(1 / s + 0.5).cast("string"), F.lit(" s")))
    return [
        c("tag_count").alias("tag_count"),
        F.when(c("_little"), "little").otherwise("big").alias("byte_order"),
        *(t[n].alias(n) for n in ("make", "model", "software", "digitized", "artist", "copyright", "serial", "owner", "body_serial", "lens_serial")),
        F.coalesce(t["taken"], t["modified"]).alias("taken"),
        F.nullif(F.concat_ws(" ", t["lens_make"], t["lens_model"]), F.lit("")).alias("lens"),
        labels.sanitize(description, 600).alias("description"),
        F.nullif(labels.sanitize(text.user_comment(c("_comment")), 1200), F.lit("")).alias("comment"),
        o.alias("orientation"),
        F.coalesce(F.get(F.array(*map(F.lit, ORIENTATIONS)), o - 1), F.concat(F.lit("Orientation "), o.cast("string"))).alias("orientation_label"),
        exposure.alias("exposure"),
        F.when(c("_f") > 0, F.concat(F.lit("f/"), labels.short(c("_f")))).alias("aperture"),
        F.floor(c("_iso") + 0.5).cast("string").alias("iso"),
        F.when(c("_focal") > 0, F.concat(labels.short(c("_focal")), F.lit(" mm"))).alias("focal_length"),
        F.coalesce(c("_maker"), F.lit(0)).cast("long").alias("maker_note_bytes"),
        F.coalesce(c("_thumb"), F.lit(0)).cast("long").alias("thumbnail_bytes"),
    ]


def summary(rows: DataFrame) -> DataFrame:
    """Camera, lens, dates, exposure and sizes per file, from entry rows."""
    raw = _with_numbers(rows, (274, 33434, 33437, 34855, 37386, 514)).groupBy("file_id").agg(*(value.alias(name) for name, value in _camera_values().items()))
    return raw.select("file_id", *_camera(F.col))


def summary_of(camera: Column) -> Column:
    """The same of a file's own values (``tiff.CAMERA``), without a shuffle."""
    return F.when(camera.isNotNull(), F.struct(*_camera(lambda n: camera[n])))


def _place(c: Callable[[str], Column]) -> list[Column]:
    """Coordinates, altitude, time and direction from the values by name."""

    def degrees(tag: int, ref: int) -> Column:
        part = lambda i: F.coalesce(F.get(c(f"_n{tag}"), F.lit(i)), F.lit(0.0))
        found = labels.decimal_degrees(part(0), part(1), part(2), F.coalesce(_text(c(f"_v{ref}")), F.lit("")))
        return F.when(F.size(c(f"_n{tag}")) > 0, found)

    two = lambda i: F.lpad(F.floor(F.get(c("_n7"), F.lit(i))).cast("string"), 2, "0")
    up = F.get(c("_n6"), F.lit(0))
    signed = F.when(F.get(c("_n5"), F.lit(0)) == 1, -up).otherwise(up)
    clock = F.when(F.size(c("_n7")) >= 3, F.concat(two(0), F.lit(":"), two(1), F.lit(":"), two(2), F.lit(" UTC")))
    stamp = F.when(c("_n7").isNull(), _text(c("_v29"))).when(clock.isNotNull(), F.concat_ws(" ", _text(c("_v29")), clock))
    latitude, longitude = degrees(2, 1), degrees(4, 3)
    side = lambda x, plus, minus: F.concat(F.format_string("%.6f ", F.abs(x)), F.when(x >= 0, plus).otherwise(minus))
    return [
        c("tag_count").alias("tag_count"),
        latitude.alias("latitude"),
        longitude.alias("longitude"),
        F.round(signed, 1).alias("altitude"),
        stamp.alias("timestamp_utc"),
        F.concat(labels.short(F.get(c("_n17"), F.lit(0))), F.lit("°")).alias("direction"),
        F.when(latitude.isNotNull() & longitude.isNotNull(), F.concat(side(latitude, "N", "S"), F.lit(", "), side(longitude, "E", "W"))).alias("coordinates"),
    ]


def position(rows: DataFrame) -> DataFrame:
    """Coordinates, altitude, time and direction of files with a GPS directory, from entry rows."""
    values = {f"_v{tag}": _of_rows("gps", tag, "value") for tag in tiff.PLACE_BYTES} | {f"_n{tag}": _of_rows("gps", tag, "n") for tag in tiff.PLACE_NUMBERS}
    gps = _with_numbers(rows.where("kind = 'gps'"), tiff.PLACE_NUMBERS).groupBy("file_id").agg(F.count("*").alias("tag_count"), *(value.alias(name) for name, value in values.items()))
    return gps.select("file_id", *_place(F.col))


def position_of(place: Column) -> Column:
    """The same of a file's own values (``tiff.PLACE``), without a shuffle."""
    return F.when(place.isNotNull(), F.struct(*_place(lambda n: place[n])))


def text_sources(rows: DataFrame) -> DataFrame:
    """(file_id, key, text, bytes) of the fields that generators reuse for their settings."""
    named = F.when((F.col("kind") == "exif") & (F.col("tag") == 37510), "UserComment")
    for tag, key in ((270, "ImageDescription"), (40092, "XPComment"), (40091, "XPTitle"), (40095, "XPSubject"), (305, "Software")):
        named = named.when((F.col("kind") == "ifd0") & (F.col("tag") == tag), key)
    found = rows.withColumn("key", named).where("key is not null")
    return found.select("file_id", "ord", "key", tiff.entry_text(F.col("tag"), F.col("value")).alias("text"), F.length("value").cast("long").alias("bytes")).where("length(trim(text)) > 0")
