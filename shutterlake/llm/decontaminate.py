"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask of word positions; words at ignored positions may differ. The
hashes of all masks at all places of the benchmark are met with those of the
documents, and around each hit the two texts are compared word by word on that
alignment: a document is contaminated where a window of WINDOW words (the whole
item, if that is shorter) agrees in at least ``similarity`` of its words. The
masks hit every 13-word window with two substitutions at least once. An item of
fewer words has seeds of its own: each window is cut into one part more than it
may have substitutions, of which one part must be untouched.

A word is a run of letters and digits; in scripts without spaces each character
is one.

Seeds are met by a join. The documents' side of it is kept small by two bitmaps of
the benchmark's seed hashes (at most 2**28 bits each, whatever the benchmark
has): a place whose seed isn't in both is not emitted. What passes goes
out as segments, the words around hits, once for each text however often it is
repeated; per segment and seed there is one row with all its places, joined with
one row per seed and item, so repetitive texts never multiply their places as
rows. Nothing of the benchmark but the bitmaps and the lengths of short seeds
passes through the driver.

Nulls and edge cases: a null or empty text is clean; null items and items of
under ``min_words`` words are left out (the query and the pipeline leave out none); letters' case and signs
around words don't count; null doc_ids and repeated rows stay; an empty
benchmark leaves every document clean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import group_starts, materialize, spare_names, texts_of

WINDOW, MIN_WORDS = 13, 5
#: Seeds that more benchmark items share are met by whole windows instead.
HOT_ITEMS = 32
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
#: Letters of scripts without spaces: Han, kana, Thai, Lao, Burmese, Khmer.
_DENSE = "\u3005-\u3007\u3041-\u3096\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ecd\u1000-\u103f\u1050-\u109d\u1780-\u17d3"
_WORD = re.compile(rf"[{_DENSE}]|[^\W_{_DENSE}]+")
_SPACED, _HAS_DENSE = re.compile(r"[^\W_]+"), re.compile(f"[{_DENSE}]")
_LEAST_BITS, _MOST_BITS = 24, 28


def words_of(text: str) -> list[str]:
    """What _WORD finds, by a faster pattern where it can."""
    text = text.lower()
    return (_SPACED if text.isascii() or not _HAS_DENSE.search(text) else _WORD).findall(text)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 7)
        if len(self) < 300_000:
            self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def seed_hashes(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """One hash for each place of the mask."""
    n = len(words) - mask[-1]
    out = np.full(max(n, 0), len(mask) + 64 * mask[-1], np.uint64)
    for k in mask if n > 0 else ():
        out = _mix(out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n])
    return out


def parts_of(size: int, window: int, similarity: float) -> list[tuple[int, int]]:
    """(start, length) of the parts of a short item's windows, one of which is untouched in each copy."""
    need = min(window, size)
    parts = 1 + max((k for k in range(need) if need - k >= similarity * need), default=0)
    cuts = [need * k // parts for k in range(parts + 1)]
    return sorted({(s + a, b - a) for s in range(size - need + 1) for a, b in zip(cuts, cuts[1:], strict=False)})


def _hashed(text: str, hashes: _Hashes) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def _places(seeds: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each distinct seed with its places."""
    if not len(seeds):
        return
    order = np.argsort(seeds, kind="stable")
    seeds, at = seeds[order], at[order]
    cuts = np.flatnonzero(np.r_[True, seeds[1:] != seeds[:-1]])
    for lo, hi in zip(cuts, [*cuts[1:], len(seeds)], strict=True):
        yield int(seeds[lo].view(np.int64)), at[lo:hi]


_LONGS = pa.list_(pa.int64())
_HITS = pa.list_(pa.struct([("seed", pa.int64()), ("at", _LONGS)]))


def _items(benchmark: DataFrame, similarity: float, window: int, min_words: int) -> DataFrame:
    """item, item_id, words, seeds (mask number, seed, places): the benchmark's side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            words, seeds, lengths = [], [], []
            for text in b["text"].to_pylist():
                own = _hashed(text, hashes)
                short = len(own) < WINDOW
                wanted = [(at, tuple(range(n))) for at, n in parts_of(len(own), window, similarity)] if short and len(own) else [(0, m) for m in MASKS]
                found, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for at, m in wanted if len(own) >= max(1, min_words) else ():
                    h = seed_hashes(own[at : at + len(m)] if short else own, m)
                    found.append(h)
                    places.append(at + np.arange(len(h)))
                words.append(own.view(np.int64))
                lengths.append(sorted({len(m) for _, m in wanted}) if short and len(own) >= max(1, min_words) else [])
                seeds.append([{"seed": s, "at": at.tolist()} for s, at in _places(np.concatenate(found), np.concatenate(places))])
            yield pa.RecordBatch.from_arrays([b["item"], b["item_id"], pa.array(words, _LONGS), pa.array(lengths, _LONGS), pa.array(seeds, _HITS)], names=["item", "item_id", "words", "lengths", "seeds"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).distinct()
    rows = rows.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text")
    return materialize(rows.mapInArrow(run, "item long, item_id long, words array<long>, lengths array<long>, seeds array<struct<seed: long, at: array<long>>>"), "items")


def _bitmaps(seeds: DataFrame) -> tuple[list[np.ndarray], int]:
    """One bit for each value of the seeds' top bits, and of their low bits; at most twice 2**28 bits (32 MB) reach the driver."""
    n = seeds.agg(F.approx_count_distinct("seed")).first()[0]
    bits = min(_MOST_BITS, max(_LEAST_BITS, (64 * n).bit_length()))
    found = []
    for value in (F.shiftrightunsigned("seed", 64 - bits), F.col("seed").bitwiseAND((1 << bits) - 1)):
        chunks = seeds.select(F.bitmap_bucket_number(value + 1).alias("chunk"), F.bitmap_bit_position(value + 1).alias("bit"))
        out = np.zeros(1 << bits >> 3, np.uint8)
        for r in chunks.groupBy("chunk").agg(F.bitmap_construct_agg("bit").alias("bitmap")).collect():
            raw = np.frombuffer(r["bitmap"], np.uint8)
            lo = (r["chunk"] - 1) * len(raw)
            out[lo : lo + len(raw)] = raw[: len(out) - lo]
        found.append(out)
    return found, bits


def _set_in(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(bitmap[values >> np.uint64(3)] >> (values & np.uint64(7)).astype(np.uint8) & 1)


def _keyed(docs: DataFrame, names: Sequence[str] = ("_h1", "_h2")) -> DataFrame:
    """``docs`` with a 128-bit hash of the text in two columns of these names."""
    return docs.withColumn(names[0], F.xxhash64("text")).withColumn(names[1], F.xxhash64(F.lit(1), "text"))


def allowed(size: int, similarity: float) -> int:
    """Words of a window of this size that may differ."""
    return max((k for k in range(size) if size - k >= similarity * size), default=0)


_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(63, 0x9E3779B97F4A7C15, np.uint64)])


def window_keys(words: np.ndarray, places: np.ndarray, size: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(key, start) of each window of ``size`` words that holds one of these places, once for each choice of words that may differ.

    Two windows share a key just where the words that were not left out are equal (but
    for a hash), so a join on keys meets no pair that isn't similar enough.
    """
    starts = np.unique((places[:, None] - np.arange(size)).ravel())
    starts = starts[(starts >= 0) & (starts + size <= len(words))]
    terms = _mix(words[starts[:, None] + np.arange(size)]) * _POWERS[:size]
    whole, keys = terms.sum(axis=1), []
    for n, gone in enumerate(combinations(range(size), allowed(size, similarity))):
        keys.append(_mix(whole - terms[:, list(gone)].sum(axis=1, dtype=np.uint64) + np.uint64(1 + n + 1000 * size)))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.tile(starts, len(keys))


def _met_by_windows(hits: DataFrame, parts: DataFrame, seeds: DataFrame, items: DataFrame, similarity: float, window: int) -> DataFrame:
    """_h1, _h2, start, item, shift: segments and items that agree in a whole window around places of frequent seeds."""
    own = materialize(seeds.groupBy("item").agg(F.flatten(F.collect_list("places")).alias("places")).join(items.select("item", "words"), "item"), "frequent")
    # at most as many sizes as a window has words
    sizes = sorted(r[0] for r in own.select(F.least(F.size("words"), F.lit(window))).distinct().collect())

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, words, places in zip(b["item"].to_pylist(), b["words"], b["places"], strict=True):
                words = words.values.to_numpy().view(np.uint64)
                keys, at = window_keys(words, np.unique(places.values.to_numpy()), min(window, len(words)), similarity)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), item)), pa.array(at)], names=["seed", "item", "place"])

    keyed = materialize(own.mapInArrow(of_items, "seed long, item long, place long").distinct(), "windows")
    (high, low), bits = _bitmaps(keyed)
    shift, below = np.uint64(64 - bits), np.uint64((1 << bits) - 1)

    def of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h1, h2, start, words, places in zip(*(b[c].to_pylist() for c in ("_h1", "_h2", "start")), b["words"], b["at"], strict=True):
                words, places = words.values.to_numpy().view(np.uint64), np.unique(places.values.to_numpy())
                found = [window_keys(words, places, size, similarity) for size in sizes]
                keys, at = np.concatenate([k for k, _ in found]), np.concatenate([a for _, a in found])
                on = _set_in(high, keys >> shift)
                on = on[_set_in(low, keys[on] & below)]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(on), x)) for x in (h1, h2, start)), pa.array(keys[on].view(np.int64)), pa.array(at[on])], names=["_h1", "_h2", "start", "seed", "at"])

    where = ["_h1", "_h2", "start"]
    segments = hits.groupBy(*where).agg(F.flatten(F.collect_list("at")).alias("at")).join(parts.select(*where, "words"), where)
    rows = segments.mapInArrow(of_parts, "_h1 long, _h2 long, start long, seed long, at long")
    return rows.join(keyed, "seed").select(*where, "item", (F.col("at") - F.col("place")).alias("shift")).distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """_h1, _h2, hits: the texts of ``docs`` that have verified overlaps, by their hashes.

    A hit is the best span of one item: item_id, start_word, end_word, matched.
    """
    items = _items(benchmark, similarity, window, min_words)
    bench = materialize(items.select("item", F.explode("seeds").alias("s")).select("s.seed", "item", F.col("s.at").alias("places")), "seeds")
    hot = materialize(bench.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ITEMS).select("seed"), "hot")
    frequent = bool(hot.take(1))
    (high, low), bits = _bitmaps(bench)
    lengths = sorted(r[0] for r in items.select(F.explode("lengths")).distinct().collect())  # 1 to 12
    masks = [*MASKS, *(tuple(range(n)) for n in lengths)]
    shift, below, around = np.uint64(64 - bits), np.uint64((1 << bits) - 1), max(window, WINDOW)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            rows: list[tuple] = []
            seen = set()
            for h1, h2, text in zip(*(b[c].to_pylist() for c in ("_h1", "_h2", "text")), strict=True):
                if (h1, h2) in seen or not text:
                    continue
                seen.add((h1, h2))
                words = _hashed(text, hashes)
                seeds, at = [], []
                for m in masks:
                    h = seed_hashes(words, m)
                    on = _set_in(high, h >> shift)
                    on = on[_set_in(low, h[on] & below)]
                    seeds.append(h[on])
                    at.append(on)
                seeds, at = np.concatenate(seeds), np.concatenate(at)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                seeds, at = seeds[order], at[order]
                cuts = np.flatnonzero(np.r_[True, at[1:] - at[:-1] > 2 * around + WINDOW])
                for lo, hi in zip(cuts, [*cuts[1:], len(at)], strict=True):
                    first, last = max(0, int(at[lo]) - around), min(len(words), int(at[hi - 1]) + around + WINDOW)
                    rows.append((h1, h2, first, words[first:last].view(np.int64), [{"seed": s, "at": a.tolist()} for s, a in _places(seeds[lo:hi], at[lo:hi] - first)]))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], _LONGS), pa.array(cols[4], _HITS)], names=["_h1", "_h2", "start", "words", "hits"])

    def shifts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct shifts of each row; a product of places only here, in slices."""
        for b in batches:
            keys = [b[c].to_numpy() for c in ("_h1", "_h2", "start", "item")]
            at, places = b["at"].flatten().to_numpy(), b["places"].flatten().to_numpy()
            n, m = (b[c].value_lengths().to_numpy().astype(np.int64) for c in ("at", "places"))
            lo, plo = group_starts(n), group_starts(m)
            one = np.flatnonzero((n == 1) & (m == 1))
            rows, got = [one], [at[lo[one]] - places[plo[one]]]
            for k in np.flatnonzero((n > 1) | (m > 1)).tolist():
                own, of = at[lo[k] : lo[k] + n[k]], places[plo[k] : plo[k] + m[k]]
                step = max(1, 1_000_000 // len(of))
                found = np.unique(np.concatenate([np.unique(own[x : x + step, None] - of) for x in range(0, len(own), step)]))
                rows.append(np.full(len(found), k))
                got.append(found)
            of = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[of]) for x in keys), pa.array(np.concatenate(got).astype(np.int64))], names=["_h1", "_h2", "start", "item", "shift"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h1, h2, start, item, words, own, moved in zip(*(b[c].to_pylist() for c in ("_h1", "_h2", "start", "item_id")), b["words"], b["own"], b["shifts"], strict=True):
                words, own, best = words.values.to_numpy(), own.values.to_numpy(), None
                need = min(window, len(own))
                for shift in moved.values.to_pylist():
                    lo, hi = max(0, -shift), min(len(own), len(words) - shift)
                    if hi - lo < need:
                        continue
                    sums = np.concatenate([[0], np.cumsum(own[lo:hi] == words[lo + shift : hi + shift])])
                    ok = sums[need:] - sums[:-need] >= similarity * need
                    if ok.any():
                        first, last = int(np.argmax(ok)), int(len(ok) - 1 - np.argmax(ok[::-1])) + need
                        row = (int(sums[last] - sums[first]), start + lo + shift + first, start + lo + shift + last)
                        best = row if best is None or row > best else best
                if best:
                    out.append((h1, h2, item, best[1], best[2], best[0]))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["_h1", "_h2", "item_id", "start_word", "end_word", "matched"])

    texts = _keyed(docs.select("text").where(F.col("text").isNotNull()))
    found = texts.mapInArrow(scan, "_h1 long, _h2 long, start long, words array<long>, hits array<struct<seed: long, at: array<long>>>")
    parts = materialize(found.dropDuplicates(["_h1", "_h2", "start"]), "segments")
    hits = parts.select("_h1", "_h2", "start", F.explode("hits").alias("s")).select("_h1", "_h2", "start", "s.seed", "s.at")
    rare = bench.join(hot, "seed", "left_anti") if frequent else bench
    met = hits.join(rare, "seed").select("_h1", "_h2", "start", "item", "at", "places").mapInArrow(shifts, "_h1 long, _h2 long, start long, item long, shift long")
    if frequent:
        met = met.unionByName(_met_by_windows(hits.join(hot, "seed"), parts, bench.join(hot, "seed"), items, similarity, window))
    met = met.groupBy("_h1", "_h2", "start", "item").agg(F.collect_set("shift").alias("shifts"))
    both = met.join(parts.select("_h1", "_h2", "start", "words"), ["_h1", "_h2", "start"]).join(items.select("item", "item_id", F.col("words").alias("own")), "item")
    spans = both.select("_h1", "_h2", "start", "item_id", "words", "own", "shifts").mapInArrow(verify, "_h1 long, _h2 long, item_id long, start_word long, end_word long, matched long")
    hit = F.struct("item_id", "start_word", "end_word", "matched")
    return materialize(spans.groupBy("_h1", "_h2").agg(F.array_sort(F.collect_list(hit)).alias("hits")), "overlaps")


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, contaminated, item_ids, matched_words."""
    keys = _keyed(texts_of(docs)).select("doc_id", "_h1", "_h2")
    return keys.join(overlaps(docs, benchmark, **options), ["_h1", "_h2"], "left").select(
        "doc_id",
        F.col("hits").isNotNull().alias("contaminated"),
        F.coalesce(F.array_distinct(F.transform("hits", lambda h: h["item_id"])), F.array().cast("array<long>")).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["matched"])), F.lit(0)).cast("long").alias("matched_words"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without an overlap, all columns as they were.

    The anti-join's side is one pair of numbers per contaminated text; Spark
    broadcasts it only where it has measured it as small.
    """
    own = spare_names(docs, "_h1", "_h2")
    found = overlaps(docs, benchmark, **options).select(F.col("_h1").alias(own[0]), F.col("_h2").alias(own[1]))
    return _keyed(docs, own).join(found, own, "left_anti").select(docs.columns)
