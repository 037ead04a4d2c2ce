"""Pixels written as PNG: each row by the filter that leaves the smallest values, then deflate."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.sources import walk
from shutterlake.sources.png import SIGNATURE, chunks_of

#: Fixed value: the longest edge that a rebuilt picture may have.
MOST_EDGE = 16384


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of three neighbours the one nearest to left + up - corner; left before up before corner."""
    near = np.stack([np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)])
    return np.choose(near.argmin(axis=0), [left, up, corner])


def filtered(rows: np.ndarray, channels: int) -> bytes:
    """Rows of bytes, each behind the number of its filter; of equal sums the first filter counts.

    Filters look at the picture itself, so whole rows of all five are made at once.
    """
    x = rows.astype(np.int16)
    up = np.zeros_like(x)
    up[1:] = x[:-1]
    left, corner = np.zeros_like(x), np.zeros_like(x)
    left[:, channels:], corner[:, channels:] = x[:, :-channels], up[:, :-channels]
    each = [x - guess for guess in (0, left, up, (left + up) // 2, _paeth(left, up, corner))]
    each = np.stack(each).astype(np.uint8)
    cost = np.minimum(each.astype(np.int64), 256 - each.astype(np.int64)).sum(axis=2)
    best = cost.argmin(axis=0)
    picked = each[best, np.arange(len(rows))]
    return np.concatenate([best.astype(np.uint8)[:, None], picked], axis=1).tobytes()


def encoded(pixels: bytes, width: int, height: int, alpha: bool, level: int = 6) -> bytes:
    """A PNG of RGBA ``pixels``; without ``alpha`` its values go. Sizes that don't fit raise ValueError."""
    if width < 1 or height < 1 or len(pixels) != 4 * width * height:
        raise ValueError("pixels don't fit the size")
    channels = 4 if alpha else 3
    grid = np.frombuffer(pixels, np.uint8).reshape(height, width, 4)[:, :, :channels].reshape(height, width * channels)
    packer, data = zlib.compressobj(level), []
    step = max(1, (4 << 20) // (width * channels))  # rows at a time, each block with the row above it
    for at in range(0, height, step):
        low = max(0, at - 1)
        block = filtered(grid[low : at + step], channels)
        data.append(packer.compress(block[(at - low) * (1 + width * channels) :]))
    data.append(packer.flush())
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    header = struct.pack(">IIBBBBB", width, height, 8, 6 if alpha else 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", b"".join(data)) + chunk(b"IEND", b"")


def encode(pictures: DataFrame, level: int = 6) -> DataFrame:
    """(file_id, content) of (file_id, pixels, width, height, alpha); null where the pixels don't fit or a value is missing."""

    def one(pixels: bytes | None, width: int | None, height: int | None, alpha: bool | None) -> bytes | None:
        try:
            return None if None in (pixels, width, height) else encoded(pixels, width, height, bool(alpha), level)
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                files = [one(*row) for row in zip(*(part[c].to_pylist() for c in ("pixels", "width", "height", "alpha")), strict=True)]
                yield pa.RecordBatch.from_arrays([part["file_id"].cast(pa.string()), pa.array(files, pa.binary())], names=["file_id", "content"])

    cols = pictures.select(F.col("file_id").cast("string").alias("file_id"), "pixels", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "alpha")
    return cols.mapInArrow(run, "file_id string, content binary")


def _summed(kind: int, raw: list[int], above: list[int], step: int) -> list[int]:
    """A row of the average (3) or the nearest-neighbour filter (4) without it."""
    row = [0] * step + raw
    for x, up in enumerate(above):
        left = row[x]
        if kind == 3:
            guess = (left + up) >> 1
        else:
            corner = above[x - step] if x >= step else 0
            a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            guess = left if a <= b and a <= c else up if b <= c else corner
        row[x + step] = (row[x + step] + guess) & 255
    return row[step:]


def decoded(content: bytes) -> bytes:
    """The pixels of a picture with eight bits a channel, row by row, without its filters; others raise ValueError."""
    chunks = chunks_of(content)
    head = next((d for k, _, _, _, d in chunks if k == "IHDR"), b"")
    if len(head) < 13 or head[8] != 8 or head[9] not in (0, 2, 4, 6) or head[12]:
        raise ValueError("not a plain picture")
    width, height = struct.unpack(">II", head[:8])
    step = {0: 1, 2: 3, 4: 2, 6: 4}[head[9]]
    flat = zlib.decompress(b"".join(d for k, _, _, _, d in chunks if k == "IDAT"))
    line = width * step
    if len(flat) != height * (line + 1):
        raise ValueError("pixels don't fit the size")
    above, out = np.zeros(line, np.int64), []
    for y in range(height):
        kind, raw = flat[y * (line + 1)], np.frombuffer(flat, np.uint8, line, y * (line + 1) + 1).astype(np.int64)
        if kind == 1:
            row = np.cumsum(raw.reshape(-1, step), axis=0).ravel()
        elif kind in (0, 2):
            row = raw + above * (kind == 2)
        else:
            # one pixel needs the one before it, so bytes are taken one by one
            row = np.array(_summed(kind, raw.tolist(), above.tolist(), step), np.int64)
        above = row & 255
        out.append(above.astype(np.uint8).tobytes())
    return b"".join(out)


def decode(files: DataFrame) -> DataFrame:
    """(file_id, pixels) of the pictures that ``decoded`` reads; others have null."""

    def run(content: bytes) -> Iterator[tuple]:
        try:
            yield (decoded(content),)
        except (ValueError, struct.error, zlib.error):
            yield (None,)

    return walk.rows_of(files, run, "pixels binary").drop("ord")


def target_format(requested: Column, source: Column) -> Column:
    """(format, substituted) of a rebuilt file: what has no encoder becomes PNG."""
    own = source.isin("jpeg", "png", "webp")
    asked = requested != "original"
    return F.struct(F.when(asked, requested).when(own, source).otherwise("png").alias("format"), (~asked & ~F.coalesce(own, F.lit(False))).alias("substituted"))


def target_size(width: Column, height: Column, most: Column | int | None) -> Column:
    """(width, height) with the longest edge at ``most`` (1 to 16,384), halves up; unchanged without a limit."""
    if most is None:
        return F.struct(width.alias("width"), height.alias("height"))
    cap = F.least(F.lit(MOST_EDGE), F.greatest(F.lit(1), most if isinstance(most, Column) else F.lit(most)))
    longest = F.greatest(width, height)
    scaled = lambda n: F.when(longest <= cap, n).otherwise(F.greatest(F.lit(1), F.floor(n * (cap / longest) + 0.5)))
    return F.struct(scaled(width).cast("long").alias("width"), scaled(height).cast("long").alias("height"))
