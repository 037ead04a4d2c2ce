import zlib

import numpy as np
from pyspark.sql import functions as F

from shutterlake.sources import png, png_encode


def decoded(content):
    """Pixels by a plain reading of the filters, byte for byte."""
    parts = {k: d for k, _, _, _, d in png.chunks_of(content)}
    width, height, kind = int.from_bytes(parts["IHDR"][:4], "big"), int.from_bytes(parts["IHDR"][4:8], "big"), parts["IHDR"][9]
    bpp, raw, above, out = (4 if kind == 6 else 3), zlib.decompress(parts["IDAT"]), None, []
    n = width * bpp
    above = [0] * n
    for y in range(height):
        f, line = raw[y * (n + 1)], list(raw[y * (n + 1) + 1 : (y + 1) * (n + 1)])
        for i in range(n):
            a, b, c = (line[i - bpp] if i >= bpp else 0), above[i], (above[i - bpp] if i >= bpp else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line[i] = (line[i] + (0, a, b, (a + b) // 2, near)[f]) & 255
        out += line
        above = line
    return width, height, bytes(out)


def test_round_trip():
    rng, used = np.random.default_rng(3), set()
    for width, height in ((1, 1), (5, 3), (7, 40), (33, 9)):
        slope = (np.add.outer(np.arange(height) * 3, np.arange(width))[:, :, None] * [1, 2, 3, 4]) % 256
        for pixels in (rng.integers(0, 256, (height, width, 4)), slope, slope + rng.integers(0, 2, slope.shape), np.full((height, width, 4), 9)):
            pixels = (pixels % 256).astype(np.uint8)
            for alpha in (True, False):
                for level in (0, 6, 9):
                    got = png_encode.encoded(pixels.tobytes(), width, height, alpha, level)
                    assert decoded(got) == (width, height, pixels[:, :, : 4 if alpha else 3].tobytes())
                    used |= set(zlib.decompress(got[got.index(b"IDAT") + 4 :])[:: 1 + width * (4 if alpha else 3)]) if level == 9 and width > 1 else set()
    assert used >= {0, 1, 2}
    tall = rng.integers(0, 256, (1100, 1100, 4)).astype(np.uint8)  # over one block of rows
    raw = png_encode.encoded(tall.tobytes(), 1100, 1100, True, 0)
    assert png_encode.filtered(tall.reshape(1100, -1), 4) == zlib.decompress(next(d for k, _, _, _, d in png.chunks_of(raw) if k == "IDAT"))


def test_encode_rows(spark):
    rows = [("a", bytearray(bytes(24)), 3, 2, True), ("bad", bytearray(5), 3, 2, True), ("none", None, 1, 1, False), ("zero", bytearray(), 0, 0, False)]
    out = png_encode.encode(spark.createDataFrame(rows, "file_id string, pixels binary, width int, height int, alpha boolean"))
    got = {r["file_id"]: r["content"] for r in out.collect()}
    assert decoded(bytes(got["a"])) == (3, 2, bytes(24)) and [got[k] for k in ("bad", "none", "zero")] == [None] * 3


def test_targets(spark):
    df = spark.createDataFrame([(4000, 3000, "heic", "original"), (10, 20000, "png", "original"), (3, 1, "gif", "webp")], "w int, h int, f string, r string")
    got = df.select(png_encode.target_size(F.col("w"), F.col("h"), 1000).alias("s"), png_encode.target_format(F.col("r"), F.col("f")).alias("t")).select("s.*", "t.*").collect()
    assert [tuple(r) for r in got] == [(1000, 750, "png", True), (1, 1000, "png", False), (3, 1, "webp", False)]
