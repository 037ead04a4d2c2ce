"""Display labels and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shutterlake.functions import text


def _one_decimal(x: Column) -> Column:
    """One decimal, halves up; none from 100."""
    tenths = F.floor(x * 10 + 0.5)
    return F.when(x >= 100, F.floor(x + 0.5).cast("string")).otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string")))


def format_bytes(n: Column) -> Column:
    """Base-1024 label up to GB."""
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.concat(_one_decimal(n / 1024), F.lit(" KB")))
        .when(n < 1024**3, F.concat(_one_decimal(n / 1024**2), F.lit(" MB")))
        .otherwise(F.concat(_one_decimal(n / 1024**3), F.lit(" GB")))
    )


def cleaned_file_name(name: Column, extension: Column, suffix: str = "_clean") -> Column:
    """Stem before the last dot (one at the very start is part of it), each run of characters that file systems refuse as ``_``, then suffix and extension."""
    stem = F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1")
    safe = text.trim(F.regexp_replace(stem, r'[\\/:*?"<>|]+', "_"))
    return F.concat(F.when(F.length(safe) == 0, "image").otherwise(safe), F.lit(suffix + "."), extension)


def file_name_suffix(asked: Column) -> Column:
    """A suffix as it may be set: without characters that file systems refuse, 24 at most."""
    return F.substring(F.regexp_replace(asked, r'[\\/:*?"<>|]', ""), 1, 24)


def sanitize(words: Column, most: int = 4000) -> Column:
    """Line ends as LF, no control characters but tab and LF, trimmed, cut with an ellipsis."""
    clean = sanitized(words)
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most), F.lit("…"))).otherwise(clean)


def sanitized(words: Column) -> Column:
    """``sanitize`` before its cut."""
    lines = F.regexp_replace(F.regexp_replace(words, r"\r\n", "\n"), r"\r", "\n")
    return text.trim(F.regexp_replace(lines, r"[\x00-\x08\x0B-\x1F\x7F-\x9F]", ""))


def preview(words: Column, most: int = 60) -> Column:
    """The first characters of the trimmed text; the ellipsis tells that the whole text is longer."""
    return F.concat(F.substring(text.trim(words), 1, most), F.when(F.length(words) > most, "…").otherwise(""))


def format_percent(value: Column, digits: int = 1) -> Column:
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, F.concat(F.format_string(f"%.{digits}f", F.round(value, digits)), F.lit("%"))).otherwise("0%")


def megapixels(width: Column, height: Column) -> Column:
    """Null where a side is missing or zero."""
    return F.when((width > 0) & (height > 0), width.cast("double") * height / 1_000_000)


def format_megapixels(width: Column, height: Column) -> Column:
    """Two decimals under a tenth, else one."""
    m = megapixels(width, height)
    return F.when(m.isNull(), "—").when(m < 0.1, F.format_string("%.2f MP", F.round(m, 2))).otherwise(F.format_string("%.1f MP", F.round(m, 1)))


def archive_name(day: Column) -> Column:
    return F.concat(F.lit("cleaned-images-"), F.date_format(day, "yyyy-MM-dd"), F.lit(".zip"))


def decimal_degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds as signed degrees with six decimals, halves up."""
    micro = F.floor((d * 3600 + m * 60 + s) * 1_000_000 / 3600 + 0.5)
    return F.when(F.upper(ref).isin("S", "W"), -micro).otherwise(micro) / 1_000_000


def short(x: Column, digits: int = 1) -> Column:
    """A number with at most so many decimals, without trailing zeros."""
    fixed = F.format_string(f"%.{digits}f", F.round(x, digits))
    return F.regexp_replace(fixed, r"\.?0+$", "") if digits else fixed


def exposure_label(num: Column, den: Column) -> Column:
    """Seconds with at most two decimals from one on, else ``1/n s``; null for a zero denominator."""
    seconds = num / F.nullif(den, F.lit(0))
    return F.when(seconds >= 1, F.concat(short(seconds, 2), F.lit(" s"))).when(seconds.isNotNull(), F.concat(F.lit("1/"), F.floor(den / F.greatest(num, F.lit(1)) + 0.5).cast("string"), F.lit(" s")))
