"""Repeated strings: remove bytes covered by a LENGTH-byte string that starts earlier.

Buckets of suffixes, one sorted at a time, with a cover sample. A cover sample has
the property that two equal strings contain a sampled suffix at the same offset;
its ranks (hashes, no suffix order) resolve ties that a bucket's short sort keys
leave open. The buckets of a task arrive sorted, so one of them is held at a time.

1. Cover sample: of each LENGTH-byte string, the leftmost smallest of its K-byte
   substrings (by hash). Equal strings choose the same offset. About 2 of 52
   suffixes are sampled; a periodic difference cover has at least 8 of 57 and its
   samples can't stand for their neighbours (see the README for the figures).
2. Buckets of sampled suffixes, dealt by their K bytes. A sample stands for the
   run of strings that chose it; the run's whole content has a rank of its own
   (hash). One bucket is sorted at a time: of equal runs all but the first are
   repeats as a whole. Where one K-byte string has several contents, their first
   runs hold ties that the ranks can't settle.
3. Only these runs send each of their strings to a second set of buckets, which
   are sorted in turn; all but the first of equal strings are repeats.

Equal rows are combined within a task before each shuffle, so copies and common
lines shrink to one entry per task; K-byte strings that a sample of documents
shows to be very frequent are dealt by content as well. Strings are compared by
64-bit hashes (32 more bits in step 2).

Nulls and edge cases: a null text is empty; a null doc_id comes before all
others; rows that repeat a doc_id don't count as earlier than each other, and
get the same result if their texts are equal; texts under LENGTH bytes lose
nothing; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import group_starts, materialize, shuffle_parts, text_batches, texts_of

LENGTH, K = 100, 50
_LOWEST = np.iinfo(np.int64).min
_U = np.uint64
_TABLE = np.random.default_rng(20_240_501).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x5851F42D4C957F2D


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Hasher:
    """Polynomial hashes of any substring of a buffer."""

    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Hasher._powers) < n:
            size = max(n, 1 << 20)
            base = np.full(size, _BASE, np.uint64)
            back = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            base[0] = back[0] = 1
            Hasher._powers, Hasher._inverse = np.cumprod(base), np.cumprod(back)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_TABLE[data] * Hasher._powers[: n - 1], out=self.sums[1:])

    def __call__(self, start: np.ndarray | slice, size: int | np.ndarray) -> np.ndarray:
        if isinstance(start, slice):
            stop = start.stop
            return (self.sums[start.start + size : stop + size] - self.sums[start]) * Hasher._inverse[start]
        return (self.sums[start + size] - self.sums[start]) * Hasher._inverse[start]


def _leftmost_min(v: np.ndarray, width: int) -> np.ndarray:
    """Offset of the leftmost smallest value in each window."""
    o, span = np.zeros(len(v), np.uint8), 1
    while span < width:
        step = min(span, width - span)
        right = v[step:] < v[: len(v) - step]
        o = np.where(right, o[step:] + np.uint8(step), o[: len(o) - step])
        v = np.where(right, v[step:], v[: len(v) - step])
        span += step
    return o


def sample(data: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """The cover sample of some documents: owner, pos (first string's start), left, span, kh, fh."""
    n, width = len(data), LENGTH - K + 1
    empty = {k: np.zeros(0, t) for k, t in (("owner", np.int64), ("pos", np.int64), ("span", np.int64), ("kh", np.uint64), ("fh", np.uint64))}
    if n < LENGTH:
        return empty
    hashes = Hasher(data)
    h = _mix(hashes(slice(0, n - K + 1), K))
    o = _leftmost_min((h >> _U(32)).astype(np.uint32), width)
    starts = group_starts(sizes)
    windows = np.maximum(sizes - LENGTH + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), windows)
    p = np.arange(int(windows.sum())) - np.repeat(group_starts(windows), windows) + starts[owner]
    if not len(p):
        return empty
    a = p + o[p]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (owner[1:] != owner[:-1])])
    last = np.r_[new[1:], len(p)] - 1
    s, span, at, own = p[new], p[last] - p[new], a[new], owner[new]
    fh = _mix(hashes(s, span + LENGTH) ^ _mix((span * 256 + at - s).astype(np.uint64) + _U(1)))
    return {"owner": own, "pos": s - starts[own], "span": span, "kh": h[at], "fh": fh}


def _firsts(keys: tuple[np.ndarray, ...], doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order by keys, doc and pos, and whether a row (in that order) stands where its group's first does."""
    order = np.lexsort((pos, doc, *reversed(keys)))
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new |= np.r_[True, k[1:] != k[:-1]] if len(k) else new
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else order
    d, q = doc[order], pos[order]
    return order, (d == d[head]) & (q == q[head])


def _pack(**cols: np.ndarray) -> bytes:
    """Columns one after the other, each with its type and length."""
    head = ";".join(f"{k},{v.dtype.str},{len(v)}" for k, v in cols.items()).encode()
    return len(head).to_bytes(4, "little") + head + b"".join(np.ascontiguousarray(v).tobytes() for v in cols.values())


def _unpack(blobs: list[bytes]) -> dict[str, np.ndarray]:
    got: dict[str, list[np.ndarray]] = {}
    for blob in blobs:
        n = int.from_bytes(blob[:4], "little")
        at = 4 + n
        for name, kind, size in (x.split(",") for x in blob[4:at].decode().split(";")):
            a = np.frombuffer(blob, kind, int(size), at)
            at += a.nbytes
            got.setdefault(name, []).append(a)
    return {k: np.concatenate(v) for k, v in got.items()}


def _deal(target: np.ndarray, kind: int, **cols: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(target, kind, blob) for the rows of each target."""
    if not len(target):
        return
    order = np.argsort(target, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(target[order]) != 0])
    for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True):
        yield int(target[order[lo]]), kind, _pack(**{k: v[order[lo:hi]] for k, v in cols.items()})


_BLOB = "target int, kind int, blob binary"
_ARROW = pa.schema([("target", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), _ARROW.types, strict=True)], schema=_ARROW)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(target, blobs) of rows sorted by target: one bucket of a task is held at a time, and what goes on to the parts not at all."""
    now, held = None, []
    for b in batches:
        for target, blob in zip(b["target"].to_pylist(), b["blob"], strict=True):
            if held and (target != now or target < 0):
                yield now, held
                held = []
            now = target
            held.append(blob.as_py())
    if held:
        yield now, held


def _bytes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "replace") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64)


def _part(doc: np.ndarray, parts: int) -> np.ndarray:
    return (_mix(doc.view(np.uint64) + _U(77)) % _U(parts)).astype(np.int32)


REPEAT, RUN, STRING, TEXT = range(4)


def remove_repeats(docs: DataFrame, part_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), one row per row of ``docs``."""
    spark, rows = docs.sparkSession, texts_of(docs)
    total = rows.agg(F.sum(F.length(F.col("text").cast("binary")))).first()[0] or 0
    parts = max(8, -(-total // part_bytes))
    buckets = max(shuffle_parts(spark), parts // 2)
    sampled = max(1, total // (64 << 20))  # documents of about 64 MB tell the most frequent strings
    often = max(2_000, 40 * (64 << 20) // max(1, part_bytes))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_batches(batches):
            kh, n = np.unique(sample(*_bytes_of(list(dict.fromkeys(texts))))["kh"], return_counts=True)
            some = n > 2
            yield pa.RecordBatch.from_arrays([pa.array(kh[some].view(np.int64)), pa.array(n[some])], names=["kh", "n"])

    few = rows if sampled == 1 else rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(sampled)) == 0)
    # at most 64 MB of samples / `often` rows each: a bounded list
    hot = np.sort(np.array([r["kh"] for r in few.mapInArrow(frequent, "kh long, n long").groupBy("kh").agg(F.sum("n").alias("n")).where(F.col("n") >= often).select("kh").collect()], np.int64).view(np.uint64))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_batches(batches):
            doc = np.array([_LOWEST if i is None else i for i in ids], np.int64)
            s = sample(*_bytes_of(texts))
            order, first = _firsts((s["kh"], s["fh"]), doc[s["owner"]], s["pos"])
            d, pos, span, kh, fh = (x[order] for x in (doc[s["owner"]], s["pos"], s["span"], s["kh"], s["fh"]))
            again = ~first
            split = np.isin(kh, hot)
            key = np.where(split, _mix(kh ^ fh), kh)
            target = (key >> _U(32)) % _U(buckets)
            out = list(_deal(_part(d[again], parts), REPEAT, doc=d[again], start=pos[again].astype(np.int32), end=(pos + span + LENGTH)[again].astype(np.int32)))
            out = [(-1 - t, k, b) for t, k, b in out]  # negative targets go on to the parts
            out += _deal(target[first].astype(np.int32), RUN, kh=(kh[first] & _U(0x7FFFFFFF)).astype(np.uint32) | (split[first].astype(np.uint32) << np.uint32(31)), fh=fh[first], doc=d[first], pos=pos[first].astype(np.int32), span=span[first].astype(np.uint8))
            yield _batch(out)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for target, blobs in _buckets(batches):
            if target < 0:
                yield _batch([(-1 - target, REPEAT, blob) for blob in blobs])
                continue
            x = _unpack(blobs)
            order, first = _firsts((x["kh"], x["fh"]), x["doc"], x["pos"])
            kh, fh, d, pos, span = (x[c][order] for c in ("kh", "fh", "doc", "pos", "span"))
            again = ~first
            group = np.cumsum(np.r_[0, kh[1:] != kh[:-1]])
            kinds = np.bincount(group, weights=np.r_[1, (kh[1:] != kh[:-1]) | (fh[1:] != fh[:-1])])
            tied = first & ((kinds[group] > 1) | (kh >> np.uint32(31) > 0))
            end = (pos + span.astype(np.int32) + LENGTH).astype(np.int32)
            yield _batch([*_deal(_part(d[again], parts), REPEAT, doc=d[again], start=pos[again], end=end[again]), *_deal(_part(d[tied], parts), RUN, doc=d[tied], start=pos[tied], end=end[tied])])

    def texts_by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_batches(batches):
            doc = np.array([_LOWEST if i is None else i for i in ids], np.int64)
            data, sizes = _bytes_of(texts)
            starts, part = group_starts(sizes), _part(doc, parts)
            pack, out = zstandard.ZstdCompressor(level=3), []
            for p in np.unique(part):
                mine = np.flatnonzero(part == p)
                body = np.concatenate([data[starts[i] : starts[i] + sizes[i]] for i in mine])
                out.append((int(p), TEXT, pack.compress(_pack(doc=doc[mine], none=np.array([ids[i] is None for i in mine]), size=sizes[mine], data=body))))
            yield _batch(out)

    def open_part(table: pa.Table) -> dict[str, np.ndarray]:
        unpack = zstandard.ZstdDecompressor()
        return _unpack([unpack.decompress(b) for b in table["blob"].to_pylist()])

    def rows_of(x: dict[str, np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each entry of ``doc`` the rows of the part with that id: (entry, row) pairs."""
        order = np.argsort(x["doc"], kind="stable")
        ids = x["doc"][order]
        lo, hi = np.searchsorted(ids, doc), np.searchsorted(ids, doc, side="right")
        entry = np.repeat(np.arange(len(doc)), hi - lo)
        return entry, order[np.repeat(lo, hi - lo) + np.arange(len(entry)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]

    def strings(left: pa.Table, right: pa.Table) -> pa.Table:
        """Each string of the tied runs of one part, equal ones combined."""
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([], _ARROW)
        x, r = open_part(left), _unpack(right["blob"].to_pylist())
        starts, hashes = group_starts(x["size"]), Hasher(x["data"])
        entry, row = rows_of(x, r["doc"])
        fits = r["end"][entry] <= x["size"][row]
        entry, row = entry[fits], row[fits]
        n = (r["end"] - r["start"])[entry].astype(np.int64) - LENGTH + 1
        each = np.repeat(np.arange(len(entry)), n)
        pos = r["start"][entry[each]] + np.arange(len(each)) - np.repeat(group_starts(n), n)
        h = _mix(hashes(starts[row[each]] + pos, LENGTH))
        order, first = _firsts((h,), r["doc"][entry[each]], pos)
        h, d, pos = h[order], r["doc"][entry[each]][order], pos[order].astype(np.int32)
        again = ~first
        out = [(-1 - t, k, b) for t, k, b in _deal(_part(d[again], parts), REPEAT, doc=d[again], start=pos[again], end=pos[again] + np.int32(LENGTH))]
        out += _deal(((h[first] >> _U(32)) % _U(buckets)).astype(np.int32), STRING, h=h[first], doc=d[first], pos=pos[first])
        return pa.Table.from_batches([_batch(out)])

    def equal_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for target, blobs in _buckets(batches):
            if target < 0:
                yield _batch([(-1 - target, REPEAT, blob) for blob in blobs])
                continue
            x = _unpack(blobs)
            order, first = _firsts((x["h"],), x["doc"], x["pos"])
            again = order[~first]
            at = np.lexsort((x["pos"][again], x["doc"][again]))
            d, pos = x["doc"][again][at], x["pos"][again][at]
            yield _batch(list(_deal(_part(d, parts), REPEAT, doc=d, start=pos, end=pos + np.int32(LENGTH))))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([], kept_arrow)
        x = open_part(left)
        starts = group_starts(x["size"])
        cover_change = np.zeros(len(x["data"]) + 1, np.int32)
        if right.num_rows:
            r = _unpack(right["blob"].to_pylist())
            entry, row = rows_of(x, r["doc"])
            lo = np.minimum(r["start"][entry], x["size"][row])
            hi = np.minimum(r["end"][entry], x["size"][row])
            np.add.at(cover_change, starts[row] + lo, 1)
            np.add.at(cover_change, starts[row] + hi, -1)
        gone = np.cumsum(cover_change[:-1]) > 0
        out = []
        for i, (a, n) in enumerate(zip(starts, x["size"], strict=True)):
            g = gone[a : a + n]
            spans = int(np.count_nonzero(g[1:] & ~g[:-1]) + (n > 0 and g[0]))
            out.append((None if x["none"][i] else int(x["doc"][i]), int(n), int(g.sum()), spans, x["data"][a : a + n][~g].tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kept_arrow.types, strict=True)], schema=kept_arrow)

    kept_arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    texts = rows.mapInArrow(texts_by_part, _BLOB).select("target", "blob")
    found = materialize(rows.mapInArrow(cover, _BLOB).repartition(buckets, "target").sortWithinPartitions("target").mapInArrow(runs, _BLOB), "runs")
    tied = found.where(F.col("kind") == RUN).select("target", "blob")
    single = materialize(texts.groupBy("target").cogroup(tied.groupBy("target")).applyInArrow(strings, _BLOB), "strings")
    more = single.repartition(buckets, "target").sortWithinPartitions("target").mapInArrow(equal_strings, _BLOB)
    repeats = found.where(F.col("kind") == REPEAT).unionByName(more).select("target", "blob")
    return texts.groupBy("target").cogroup(repeats.groupBy("target")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
