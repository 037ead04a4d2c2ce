"""Token ids in Simple-8b words, written and read back through Spark.

A word is 64 bits: a 4-bit selector and 60 bits of ids. A selector fixes how
many ids the word holds and how many bits each has; selector 15 escapes one id
of over 60 bits into the next word. Ids are cut into blocks of 1,024, each
block starts on a word of its own, and the words' offsets of the blocks are
kept beside them, so that any block decodes alone and all blocks at once.

A file row (a segment) holds whole documents in ascending doc_id order:
``shard, segment, first_id, doc_ids, counts, block_words, words``. Segments are
stored as binary columns by Spark's own writer, so that the files work in any
store that Spark can write to. Texts are range-dealt by doc_id and a hash of the
text into shards of about ``shard_bytes``, so one id (or the null id) may go over
many shards; they are encoded after that, as each shard is written.

Nulls and edge cases: a null text is empty and has only the end id; null
doc_ids come first; rows with equal doc_ids stay separate, in the order of
their texts' hashes; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import group_starts, materialize, shuffle_parts, text_batches, texts_of
from shutterlake.llm.encoding import encoder

#: Selector -> (ids in a word, bits of each); fixed values of the format.
SHAPES = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
BLOCK = 1024


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the offset in words of each block (one more at the end)."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    widths = np.ones(n + 64, np.uint8)
    top = np.frexp(ids.astype(np.float64))[1]
    for bits in np.unique(top[top > 50]):  # floats round up near powers of two
        at = np.flatnonzero(top == bits)
        top[at] = [int(ids[i]).bit_length() for i in at]
    widths[:n] = np.maximum(top, 1)
    widths[n:] = 1
    room = block - np.arange(n) % block
    room = np.minimum(room, n - np.arange(n))
    take, sel = np.ones(n, np.int64), np.full(n, ESCAPE, np.uint64)
    widest, covered = widths.copy(), 1
    for s in range(len(SHAPES) - 1, -1, -1):  # from one id a word to sixty
        count, bits = SHAPES[s]
        while covered < count:
            step = min(covered, count - covered)
            widest[:-step] = np.maximum(widest[:-step], widest[step:])
            covered += step
        fits = (widest[:n] <= bits) & (room >= count)
        take[fits], sel[fits] = count, s
    # every block's chain of words is followed at the same time
    at, starts = np.arange(0, n, block), []
    ends = np.minimum(at + block, n)
    blocks = np.arange(len(at))
    owner = []
    while len(at):
        starts.append(at)
        owner.append(blocks)
        at = at + take[at]
        on = at < ends
        at, ends, blocks = at[on], ends[on], blocks[on]
    start = np.concatenate(starts)
    order = np.argsort(start, kind="stable")
    start, owner = start[order], np.concatenate(owner)[order]
    chosen = sel[start]
    size = np.where(chosen == ESCAPE, 2, 1)
    place = group_starts(size)
    words = np.zeros(int(size.sum()), np.uint64)
    words[place] = chosen << np.uint64(60)
    for s, (count, bits) in enumerate(SHAPES):
        w = np.flatnonzero(chosen == s)
        for k in range(count if len(w) else 0):
            words[place[w]] |= ids[start[w] + k] << np.uint64(k * bits)
    w = np.flatnonzero(chosen == ESCAPE)
    words[place[w] + 1] = ids[start[w]]
    per_block = np.bincount(owner, weights=size, minlength=-(-n // block)).astype(np.int64)
    return words, np.concatenate([[0], np.cumsum(per_block)])


def _raw_words(sel: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which words are the raw halves of escapes.

    In a run of words that look like escapes every other one is, and the word after
    an escape is raw whatever it looks like. No escape crosses a block, so a run
    begins anew at each block's offset.
    """
    like = sel == ESCAPE
    n = len(sel)
    starts = np.zeros(n + 1, bool)
    starts[offsets[:-1]] = True
    begins = like & (starts[:n] | ~np.r_[False, like[:-1]])
    begin = np.maximum.accumulate(np.where(begins, np.arange(n), -1))
    escape = like & ((np.arange(n) - begin) % 2 == 0)
    return np.r_[False, escape[:-1]]


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` ids of all blocks at once."""
    words = np.asarray(words, np.uint64)
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = _raw_words(sel, np.asarray(offsets)) if (sel == ESCAPE).any() else np.zeros(len(words), bool)
    counts = np.array([c for c, _ in SHAPES] + [0, 1])[sel]
    counts[raw] = 0
    start = group_starts(counts)
    for s, (count, bits) in enumerate(SHAPES):
        w = np.flatnonzero((sel == s) & ~raw)
        mask = np.uint64((1 << bits) - 1)
        for k in range(count if len(w) else 0):
            out[start[w] + k] = (words[w] >> np.uint64(k * bits)) & mask
    w = np.flatnonzero((sel == ESCAPE) & ~raw)
    out[start[w]] = words[w + 1]
    return out


def decode_range(words: np.ndarray, offsets: np.ndarray, n: int, lo: int, hi: int, block: int = BLOCK) -> np.ndarray:
    """Ids ``lo`` to ``hi`` of ``n``, from the words of their blocks only."""
    first, last = lo // block, -(-hi // block)
    if hi <= lo:
        return np.zeros(0, np.uint64)
    part = decode(words[offsets[first] : offsets[last]], np.asarray(offsets[first : last + 1]) - offsets[first], min(n, last * block) - first * block, block)
    return part[lo - first * block : hi - first * block]


_SEGMENTS = "shard int, segment int, first_id long, n_ids long, doc_ids array<long>, counts array<long>, block_words array<long>, words binary"


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, segment_ids: int = 1 << 18, shard_bytes: int = 16 << 20) -> DataFrame:
    """Encode whole texts, append ``end_id``, write segments; returns the files' rows."""
    spark = docs.sparkSession
    rows = texts_of(docs)
    shards = max(shuffle_parts(spark), -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))
    tail = np.array([end_id], "<u4").tobytes()
    arrow = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("block_words", pa.list_(pa.int64())), ("words", pa.binary())])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer_path), TaskContext.get().partitionId()
        held: list[tuple[int | None, bytes]] = []
        segment = first = size = 0

        def flush() -> pa.RecordBatch:
            nonlocal segment, first, size
            counts = [len(raw) // 4 for _, raw in held]
            words, offsets = encode(np.frombuffer(b"".join(raw for _, raw in held), "<u4"))
            row = {"shard": shard, "segment": segment, "first_id": first, "n_ids": size, "doc_ids": [d for d, _ in held], "counts": counts, "block_words": offsets.tolist(), "words": words.astype("<u8").tobytes()}
            segment, first, size = segment + 1, first + size, 0
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for ids, texts in text_batches(batches):
            for doc, text in zip(ids, texts, strict=True):
                held.append((doc, enc.encode(text) + tail))
                size += len(held[-1][1]) // 4
                if size >= segment_ids:
                    yield flush()
        if held:
            yield flush()

    keyed = rows.withColumn("hash", F.xxhash64("text"))
    dealt = keyed.repartitionByRange(shards, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")
    return materialize(dealt.select("doc_id", "text").mapInArrow(segments, _SEGMENTS), "tokens")


def read_tokens(files: DataFrame) -> DataFrame:
    """Decode the segments again: doc_id, start, n_tokens, ids (unsigned 32-bit)."""
    totals = {r["shard"]: r["n"] for r in files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}  # one row per shard
    shards = sorted(totals)
    base = dict(zip(shards, group_starts(np.array([totals[s] for s in shards], np.int64)).tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                counts = np.array(row["counts"], np.int64)
                ids = decode(np.frombuffer(row["words"], "<u8"), np.array(row["block_words"]), row["n_ids"]).astype("<u4")
                local = group_starts(counts)
                start = local + base[row["shard"]] + row["first_id"]
                parts = [ids[a : a + n].tobytes() for a, n in zip(local, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(counts), pa.array(parts, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def crc_of_ids(tokens: DataFrame) -> DataFrame:
    """crc32 of each document's ids as little-endian unsigned 32-bit integers."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def ids_crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
