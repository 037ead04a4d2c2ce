"""SimHash near-duplicates by a self-join of binary tries.

A fingerprint has 64 bits: those set in over half of the XXH64 hashes (seed 42)
of a text's word shingles. Documents with one fingerprint are one node, so
copies never meet in pairs.

The join walks pairs of trie nodes together, adds up the bits in which they
part, and prunes a pair whose errors exceed the budget. A trie over 64 random
bits has many node pairs within the budget near its root, so the bits are
reordered first: of six blocks of bits at least three agree between two
fingerprints within three errors. Each of the 20 choices of three blocks is a
trie of its own with these bits on top; its upper levels, which allow no error,
are one shuffle key, and the walk below goes on inside the task, over sorted
rows. A fingerprint meets those within the budget only, whatever the size of its
group, and what leaves the task is a forest of links. Keys with very many
fingerprints are dealt by pairs of nodes further down their trie.

Nulls and edge cases: a null or empty text, or one of white space only, has
fingerprint zero and is linked as any other; null doc_ids belong to the class of
their fingerprint but never name it (a class of null ids only has a null id);
repeated rows stay, one result row each; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import group_starts, materialize, shuffle_parts, text_batches, texts_of
from shutterlake.llm.components import components

BITS, SEED = 64, 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str, words_each: int = 3) -> list[int]:
    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return []
    if len(words) <= words_each:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(words_each)), strict=False)))
    return list(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)))


def fingerprints_of(texts: list[str], words_each: int = 3) -> np.ndarray:
    return majority([shingle_hashes(t, words_each) for t in texts])


def majority(hashes: list) -> np.ndarray:
    """The fingerprint of each list of hashes."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(sizes)
    lo = 0
    while lo < len(full):  # a bounded number of hashes at a time
        hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[full[lo:]]), 200_000, side="right")))
        some = full[lo:hi]
        flat = np.concatenate([np.array(hashes[i], np.uint64) for i in some])
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, group_starts(sizes[some]), axis=0, dtype=np.int64)
        packed = np.ascontiguousarray(np.packbits(2 * ones > sizes[some][:, None], axis=1, bitorder="little"))
        out[some] = packed.view(np.uint64)[:, 0]
        lo = hi
    return out


def fingerprints(docs: DataFrame, words_each: int = 3) -> DataFrame:
    """doc_id, fp: one row per row of ``docs``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_batches(batches, 1 << 20):
            distinct = {t: i for i, t in enumerate(dict.fromkeys(texts))}
            fps = fingerprints_of(list(distinct), words_each).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps[[distinct[t] for t in texts]])], names=["doc_id", "fp"])

    return texts_of(docs).mapInArrow(run, "doc_id long, fp long")


def tries(errors: int = 3, blocks: int = 6) -> list[tuple[list[int], int]]:
    """(order of the 64 bits, bits of the key) of each trie."""
    cuts = np.array_split(np.arange(BITS), blocks)
    out = []
    for key in combinations(range(blocks), blocks - errors):
        order = [b for k in [*key, *(k for k in range(blocks) if k not in key)] for b in cuts[k].tolist()]
        out.append((order, sum(len(cuts[k]) for k in key)))
    return out


def _reorder(fps: np.ndarray, order: list[int]) -> np.ndarray:
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits[:, order[::-1]], axis=1, bitorder="little")).view(np.uint64)[:, 0]


class Forest:
    """Union-find over row numbers; a root is the smallest number of its class."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, rows: np.ndarray) -> np.ndarray:
        at = self.up[rows]
        while True:
            higher = self.up[at]
            if (higher == at).all():
                self.up[rows] = at
                return at
            at = higher

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
            np.minimum.at(self.up, b, a)


def walk(path: np.ndarray, bits: int, errors: int, first: np.ndarray, second: np.ndarray, chunk: int = 50_000) -> np.ndarray:
    """Smallest linked row of each row; ``path`` is sorted and distinct.

    A node pair is two row ranges; ``first`` and ``second`` (starts and ends) are
    the pairs to begin with, whose rows agree above the low ``bits`` bits. Rows
    link where these bits differ in at most ``errors`` places. What a step costs
    depends on the node pairs in it only, and a row meets no more partners than
    lie within ``errors`` bits of it.
    """
    forest = Forest(len(path))
    stack = [(bits, *first, *second, np.zeros(len(first[0]), np.int64))]
    while stack:
        left, lo1, hi1, lo2, hi2, err = stack.pop()
        if len(lo1) > chunk:
            h = len(lo1) // 2
            stack += [(left, *(x[h:] for x in (lo1, hi1, lo2, hi2, err))), (left, *(x[:h] for x in (lo1, hi1, lo2, hi2, err)))]
            continue
        few = (hi1 - lo1 == 1) & (hi2 - lo2 == 1)
        if few.any():
            i, j = lo1[few], lo2[few]
            near = np.bitwise_count(path[i] ^ path[j]) <= errors
            forest.union(i[near], j[near])
            lo1, hi1, lo2, hi2, err = (x[~few] for x in (lo1, hi1, lo2, hi2, err))
        if not len(lo1):
            continue
        low = np.uint64(left - 1)
        mids = [np.searchsorted(path, (path[lo] >> low | np.uint64(1)) << low) for lo in (lo1, lo2)]
        same = (lo1 == lo2) & (hi1 == hi2)
        children = []
        for p in (0, 1):
            for q in (0, 1):
                l1, h1 = (mids[0], hi1) if p else (lo1, mids[0])
                l2, h2 = (mids[1], hi2) if q else (lo2, mids[1])
                more = err + (p != q)
                keep = (h1 > l1) & (h2 > l2) & (more <= errors) & ~(same & ((p > q) | (p == q) & (h1 - l1 == 1)))
                children.append([x[keep] for x in (l1, h1, l2, h2, more)])
        lo1, hi1, lo2, hi2, err = (np.concatenate(x) for x in zip(*children, strict=True))
        if len(lo1):
            stack.append((left - 1, lo1, hi1, lo2, hi2, err))
    return forest.find(np.arange(len(path)))


#: A key with more fingerprints is dealt by this many further levels of its trie.
HOT_ROWS, HOT_LEVELS = 200_000, 6


def _sub_pairs(errors: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, pair): for each node of the HOT_LEVELS the pairs of nodes it is part of."""
    n = 1 << HOT_LEVELS
    p, q = np.nonzero(np.bitwise_count(np.arange(n)[:, None] ^ np.arange(n)) <= errors)
    return p, np.minimum(p, q) * n + np.maximum(p, q)


def near_links(fps: DataFrame, errors: int = 3, parts: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(a, b): a forest of links between distinct fingerprints within ``errors`` bits.

    Rows are sorted by key in the shuffle and a task holds about one key (or
    200,000 rows) at a time. A key of over ``hot_rows`` fingerprints, as counted
    on one in 64 of them, is dealt by pairs of its nodes some levels further down.
    """
    shapes = tries(errors)
    node_of, pair_of = _sub_pairs(errors)
    pairs_each = len(pair_of) >> HOT_LEVELS
    pair_of = pair_of.reshape(-1, pairs_each)

    def moved(fp: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, int]:
        order, key_bits = shapes[t]
        new, rest = _reorder(fp.view(np.uint64), order), BITS - key_bits
        return (new >> np.uint64(rest)).astype(np.int64), new & np.uint64((1 << rest) - 1), rest

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in range(len(shapes)):
                top = moved(batch.column(0).to_numpy(), t)[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), t, np.int32)), pa.array(top)], names=["trie", "top"])

    distinct = fps.select("fp").distinct()
    some = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(64)) == 0).mapInArrow(keys, "trie int, top long")
    # at most 20 * rows / hot_rows keys
    hot = {(r["trie"], r["top"]) for r in some.groupBy("trie", "top").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, hot_rows // 64)).collect()}
    hot_tops = {t: np.array(sorted(k for u, k in hot if u == t), np.int64) for t in {t for t, _ in hot}}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for t in range(len(shapes)):
                top, rest, bits = moved(fp, t)
                pair, of = np.full(len(top), -1, np.int64), fp
                if t in hot_tops and (split := np.isin(top, hot_tops[t])).any():
                    at = np.r_[np.flatnonzero(~split), np.repeat(np.flatnonzero(split), pairs_each)]
                    pair = np.r_[pair[~split], pair_of[(rest[split] >> np.uint64(bits - HOT_LEVELS)).astype(np.int64)].ravel()]
                    top, rest, of = top[at], rest[at], fp[at]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), t, np.int32)), pa.array(top), pa.array(pair), pa.array(rest.view(np.int64)), pa.array(of)], names=["trie", "top", "pair", "rest", "fp"])

    def linked(t: int, top: np.ndarray, pair: np.ndarray, rest: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        """Links in whole groups of one trie, sorted by top, pair and rest."""
        bits = BITS - shapes[t][1]
        new = np.r_[True, (top[1:] != top[:-1]) | (pair[1:] != pair[:-1])]
        group = np.cumsum(new) - 1
        lo = np.flatnonzero(new)
        hi = np.r_[lo[1:], len(top)]
        path = group.astype(np.uint64) << np.uint64(bits) | rest.view(np.uint64)
        lo1, hi1, lo2, hi2 = lo, hi, lo, hi
        cut = np.flatnonzero(pair[lo] >= 0)
        if len(cut):  # a pair of nodes: its two ranges, or twice the same one
            low, level = np.uint64(bits - HOT_LEVELS), 1 << HOT_LEVELS
            base = cut.astype(np.uint64) << np.uint64(bits)
            p, q = (pair[lo[cut]] // level).astype(np.uint64), (pair[lo[cut]] % level).astype(np.uint64)
            lo1, hi1, lo2, hi2 = (x.copy() for x in (lo1, hi1, lo2, hi2))
            lo1[cut], hi1[cut] = np.searchsorted(path, base + (p << low)), np.searchsorted(path, base + (p + np.uint64(1) << low))
            lo2[cut], hi2[cut] = np.searchsorted(path, base + (q << low)), np.searchsorted(path, base + (q + np.uint64(1) << low))
        some = (hi1 > lo1) & (hi2 > lo2) & ((lo1 != lo2) | (hi1 - lo1 > 1))
        lo1, hi1, lo2, hi2 = (x[some] for x in (lo1, hi1, lo2, hi2))
        label = walk(path, bits, errors, (lo1, hi1), (lo2, hi2))
        on = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(fp[on]), pa.array(fp[label[on]])], names=["a", "b"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            trie, top, pair, rest, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            new = np.flatnonzero(np.r_[True, (trie[1:] != trie[:-1]) | (top[1:] != top[:-1]) | (pair[1:] != pair[:-1])])
            end = len(trie) if last else int(new[-1])  # the last group may go on
            cuts = np.flatnonzero(np.r_[True, trie[1:end] != trie[: max(end - 1, 0)]]).tolist() if end else []
            for lo, hi in zip(cuts, [*cuts[1:], end], strict=True):
                yield linked(int(trie[lo]), top[lo:hi], pair[lo:hi], rest[lo:hi], fp[lo:hi])
            held = [[x[end:] for x in (trie, top, pair, rest, fp)]] if end < len(trie) else []
            size = 0

        for b in batches:
            if b.num_rows:
                held.append([b[c].to_numpy() for c in ("trie", "top", "pair", "rest", "fp")])
                size += b.num_rows
            if size >= 200_000:
                yield from ready(False)
        if held:
            yield from ready(True)

    parts = parts or shuffle_parts(fps.sparkSession)
    dealt = distinct.mapInArrow(deal, "trie int, top long, pair long, rest long, fp long")
    return dealt.repartition(parts, "trie", "top", "pair").sortWithinPartitions("trie", "top", "pair", "rest").mapInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, errors: int = 3, words_each: int = 3) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``."""
    own = materialize(fingerprints(docs, words_each), "fingerprints")
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(near_links(own, errors))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = named.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return own.join(classes, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
