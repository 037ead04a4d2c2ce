"""Best-fit packing of token pieces into sequences of fixed capacity.

Bulk-synchronous best fit. Pieces and gaps are rows. A round takes the pieces of
one range of lengths (a quarter of the range before it, so there are about
log4(capacity) rounds) and all gaps that are left:

1. Pieces and gaps are ranked by size: a counting sort, since sizes are whole
   numbers up to ``capacity``. A row's rank in its size is its number in its task
   plus the counts of earlier tasks.
2. A successor sweep over the two orders, longest pieces first, gives each piece
   the smallest gap that still fits. It runs over ranks, a run of equal gaps at a
   time: (size, first rank, how many) on both sides. Pieces that want one gap are
   told apart by rank; what a run leaves goes back into the order as smaller gaps;
   pieces beyond all gaps open new sequences.
3. Pieces meet their gaps in a join on (size, rank), which says in which sequence
   and where they stand.
4. Gaps shrink by what they got, new ones come in, and the next round begins.

The sweep needs the counts of the sizes only, at most ``capacity`` numbers each;
its runs are at most pairs of a length and a gap. Rows never leave the executors.
The outcome equals best-fit decreasing, piece by piece.

Nulls and edge cases: a null text is empty, so it has just the end id; a null
doc_id stays null; repeated rows are packed once each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.llm.common import bound_batches, materialize, text_batches, texts_of
from shutterlake.llm.encoding import encoder

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local long"
_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """Tokenised pieces with a running number per task and length."""
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, seen = encoder(tokenizer_path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for ids, texts in text_batches(batches):
            rows: list[tuple] = []
            for doc, text in zip(ids, texts, strict=True):
                raw = enc.encode(text) + tail
                n, lo = len(raw) // 4, 0
                first = (n - 1) % capacity + 1
                for k in range(-(-n // capacity)):
                    size = first if k == 0 else capacity
                    rows.append((doc, k, lo, size, zlib.crc32(raw[4 * lo : 4 * (lo + size)]), task, int(seen[size])))
                    seen[size] += 1
                    lo += size
            yield pa.RecordBatch.from_pylist([dict(zip(_names, r, strict=True)) for r in rows], schema=_arrow)

    _arrow = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("local", pa.int64())])
    _names = _arrow.names
    return texts_of(docs).mapInArrow(run, _PIECES)


def best_fit_plan(counts: dict[int, int], capacity: int, gaps: dict[int, int] | None = None) -> tuple[list[tuple[int, int, int, int, int, int, int]], int]:
    """The successor sweep of one round: pieces per length, longest first, over gaps per size.

    Returns rows (length, first rank, pieces, pieces per gap, gap's size, first rank
    of the gaps, filled before) and the number of new sequences, whose size is
    written as 0. A match takes whole runs of equal gaps and splits the last.
    """
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]  # gap left -> [(size, first rank, how many)]
    for size, n in (gaps or {}).items():
        runs[size].append((size, 0, n))
    plan, opened = [], 0
    for length in sorted((k for k, v in counts.items() if v), reverse=True):
        left, rank = counts[length], 0

        def match(gap: int, size: int, first: int, run: int, length: int = length) -> None:
            """Fill a run of gaps that all have this much left."""
            nonlocal left, rank
            each = gap // length
            full = min(run, left // each)
            for some, per in ((full, each), (int(full < run and left - full * each > 0), left - full * each)):
                if some:
                    plan.append((length, rank, some * per, per, size, first, (size or capacity) - gap))
                    if gap - per * length:
                        runs[gap - per * length].append((size, first, some))
                    rank, left, first, run = rank + some * per, left - some * per, first + some, run - some
            if run:
                runs[gap].append((size, first, run))

        for gap in range(length, capacity + 1):
            own, runs[gap] = runs[gap], []
            for k, (size, first, run) in enumerate(own):
                if not left:
                    runs[gap] += own[k:]
                    break
                match(gap, size, first, run)
            if not left:
                break
        if left:
            fresh = -(-left // (capacity // length))
            match(capacity, 0, opened, fresh)
            opened += fresh
    return plan, opened


def _ranked(rows: DataFrame, size: str) -> DataFrame:
    """``rows`` (numbered per task and size) with their rank in the size."""
    before = Window.partitionBy(size).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(size, "task").agg(F.count("*").alias("n")).select(size, "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(base, [size, "task"]).withColumn("rank", F.col("local") + F.col("base")).drop("task", "local", "base")


def _numbered(gaps: DataFrame) -> DataFrame:
    """sequence_id, gap with a running number per task and gap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            gap = b["gap"].to_numpy()
            order = np.argsort(gap, kind="stable")
            sizes, first, n = np.unique(gap[order], return_index=True, return_counts=True)
            had = np.array([seen.get(g, 0) for g in sizes.tolist()], np.int64)
            local = np.empty(len(gap), np.int64)
            local[order] = np.arange(len(gap)) + np.repeat(had - first, n)
            seen.update(zip(sizes.tolist(), (had + n).tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([b["sequence_id"], b["gap"], pa.array(np.full(len(gap), task, np.int32)), pa.array(local)], names=["sequence_id", "gap", "task", "local"])

    return gaps.select("sequence_id", "gap").mapInArrow(run, "sequence_id long, gap long, task int, local long")


def length_ranges(capacity: int) -> list[tuple[int, int]]:
    """(over, up to): quarters of quarters, down to 1."""
    out = []
    while capacity:
        out.append((capacity // 4, capacity))
        capacity //= 4
    return out


_PLACE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32())] + [(c, pa.int64()) for c in ("start", "length", "ids_crc32", "gap", "rank", "filled")])


def _placed(pieces: DataFrame, plan: list[tuple[int, ...]]) -> DataFrame:
    """Ranked pieces with the size and rank of their gap, and what stands before them in it."""
    rows = np.array(sorted(plan), np.int64).reshape(-1, 7)
    keys = rows[:, 0] << 48 | rows[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            at = rows[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            k = rank - at[:, 1]
            found = (at[:, 4], at[:, 5] + k // at[:, 3], at[:, 6] + k % at[:, 3] * length)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in _PLACE.names[:5]), *map(pa.array, found)], schema=_PLACE)

    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, gap long, rank long, filled long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: where it stands in which sequence."""
    spark = docs.sparkSession
    bound_batches(spark)
    pieces = materialize(pieces_of(docs, tokenizer_path, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    ranked = _ranked(pieces, "length")
    gaps, opened, rounds = None, 0, []
    for over, most in length_ranges(capacity):
        own = {k: n for k, n in counts.items() if over < k <= most}
        if not own:
            continue
        sizes = {r["gap"]: r["n"] for r in gaps.groupBy("gap").agg(F.count("*").alias("n")).collect()} if gaps is not None else {}  # at most `capacity` rows
        plan, new = best_fit_plan(own, capacity, sizes)
        placed = _placed(ranked.where((F.col("length") > over) & (F.col("length") <= most)), plan)
        if gaps is not None:
            old = _ranked(gaps, "gap")
            placed = placed.join(old, ["gap", "rank"], "left")
        else:
            placed = placed.withColumn("sequence_id", F.lit(None).cast("long"))
        at = F.coalesce("sequence_id", F.col("rank") + opened)  # a new sequence is numbered by its rank
        room = F.when(F.col("gap") == 0, capacity).otherwise(F.col("gap"))
        placed = placed.select("doc_id", "piece", "start", "length", "ids_crc32", at.alias("sequence_id"), (capacity - room + F.col("filled")).alias("offset"), room.alias("room"))
        placed = materialize(placed, "placed")
        rounds.append(placed)
        opened += new
        if over:
            taken = placed.groupBy("sequence_id").agg((F.max("room") - F.sum("length")).alias("left"))
            if gaps is None:
                rest = taken.select("sequence_id", F.col("left").alias("gap"))
            else:
                rest = gaps.select("sequence_id", "gap").join(taken, "sequence_id", "full").select("sequence_id", F.coalesce("left", "gap").alias("gap"))
            gaps = materialize(_numbered(rest.where("gap > 0")), "gaps")
    if not rounds:
        return spark.createDataFrame([], _PACKED)
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out.drop("room")
