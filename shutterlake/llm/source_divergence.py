"""Source divergence audit: how far the words of each source are from its language's and from other sources'.

1. Token-start pointers: a task takes slices of its texts' Arrow buffer as they
   are and finds where each term (a run of ASCII letters or non-ASCII bytes) starts.
2. Multikey quicksort of the pointers of a slice, eight bytes a step: pointers are
   ordered by their next eight bytes, and only runs that are still equal and go on
   are ordered by the eight bytes after. Equal runs give, for each source, the
   term's occurrences and documents; a slice leaves one row per (lang, source, term).
3. Rows are added up by (lang, source, term); a window over (lang, term) adds the
   documents of all sources, and terms of under ``least_docs`` documents go.
4. Shares are whole numbers: p = 1 + floor(10^9 (count + 1) / (N + V)). A sum over
   all kept terms is taken apart by what is there: terms that the group alone has
   are summed from a histogram of its counts, likewise the other source's, terms
   that neither has are one product, and terms of both add their difference from
   these, in blocks of sources inside tasks. Pairs of sources are the result's own
   rows; no pairs of documents or terms are made.

Nulls and edge cases: null text, lang and source are ''; only A-Z are lower-cased;
repeated rows count each; a group without terms has N = 0; a language without kept
terms has no ``term`` rows and pairs of value 0; a language of one source has no
pairs; further columns are ignored; an empty table gives an empty result. One text
is held by one task, and so are a term's counts over the sources of a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.llm.common import materialize

SLICE_BYTES = 4 << 20
#: Sources compared at once, and blocks of sums that a task holds before it hands them on.
_SOURCES, _BLOCKS = 512, 32
_FEW = 64
ONE = 1_000_000_000
_IS_TERM = np.zeros(256, bool)
_IS_TERM[ord("A") : ord("Z") + 1] = _IS_TERM[ord("a") : ord("z") + 1] = _IS_TERM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def term_pointers(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of every term of texts that lie between ``cuts``; a term ends with its text."""
    inside = _IS_TERM[data]
    before = np.r_[False, inside[:-1]]
    first = cuts[(cuts > 0) & (cuts < len(data))]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.r_[inside[1:], False]
    after[first - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1 - starts


def _eight(data: np.ndarray, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes at each pointer as one number, zeros behind the end; ``data`` has eight bytes to spare."""
    words = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))[starts].astype(np.uint64)
    gone = (8 - np.clip(left, 1, 8)).astype(np.uint64) * np.uint64(8)
    return np.where(left > 0, words >> gone << gone, np.uint64(0))


def equal_runs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The run of equal terms that each pointer belongs to, numbered in byte order."""
    n = len(starts)
    order = np.arange(n)
    # a slice of the order is open while its pointers are equal so far and go on
    run = np.zeros(n, np.int64)  # by place in the order: where its slice begins
    active, depth = order.copy(), 0
    while len(active):
        at = order[active]
        if depth and len(active) <= _FEW:
            # few long terms are left: their whole rest at once
            rest = [bytes(data[s + depth : s + z]) for s, z in zip(starts[at].tolist(), sizes[at].tolist(), strict=True)]
            rank = {r: i for i, r in enumerate(sorted(set(rest)))}
            key = np.array([rank[r] for r in rest], np.uint64)
        else:
            rest = None
            key = _eight(data, starts[at] + depth, sizes[at] - depth)
        slices = run[active]
        by = np.lexsort((key, slices)) if depth else np.argsort(key)
        order[active] = at[by]
        key, slices = key[by], slices[by]
        new = np.r_[True, (key[1:] != key[:-1]) | (slices[1:] != slices[:-1])]
        head = np.flatnonzero(new)
        run[active] = active[head[np.cumsum(new) - 1]]
        if rest is not None:
            break
        depth += 8
        size = np.diff(np.r_[head, len(active)])
        # a slice stays open while it has several pointers and one that goes on
        longer = np.maximum.reduceat(sizes[order[active]] > depth, head)
        active = active[np.repeat(longer & (size > 1), size)]
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(np.r_[False, run[1:] != run[:-1]][:n])
    return out


def counted(data: np.ndarray, cuts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(group, occurrences, documents, term) for each group and term of some texts (lower-cased, eight bytes to spare)."""
    starts, sizes = term_pointers(data[: cuts[-1]], cuts)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
    run = equal_runs(data, starts, sizes)
    doc = np.searchsorted(cuts, starts, side="right") - 1
    pairs, first, times = np.unique(run * len(group) + doc, return_index=True, return_counts=True)
    run_of, doc_of = pairs // len(group), pairs % len(group)
    groups = int(group.max()) + 1
    key, at, inverse = np.unique(run_of * groups + group[doc_of], return_index=True, return_inverse=True)
    occurrences = np.bincount(inverse, times, len(key)).astype(np.int64)
    where = first[at]
    raw = memoryview(data)
    return key % groups, occurrences, np.bincount(inverse, minlength=len(key)), [raw[s : s + z].tobytes() for s, z in zip(starts[where].tolist(), sizes[where].tolist(), strict=True)]


_TERMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _sorted_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: set[tuple[str, str]] = set()
    for batch in batches:
        text = batch["text"]
        wide = np.int64 if pa.types.is_large_string(text.type) else np.int32
        offsets = np.frombuffer(text.buffers()[1], wide)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        labels = pa.StructArray.from_arrays([batch["lang"], batch["source"]], ["lang", "source"]).to_pylist()
        lo = 0
        while lo < len(text):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, side="right")) - 1)
            data = np.zeros(int(offsets[hi] - offsets[lo]) + 8, np.uint8)
            np.take(_LOWER, raw[offsets[lo] : offsets[hi]], out=data[:-8])
            names = [(x["lang"], x["source"]) for x in labels[lo:hi]]
            known = {g: i for i, g in enumerate(dict.fromkeys(names))}
            every = list(known)
            g, n, docs, terms = counted(data, offsets[lo : hi + 1] - offsets[lo], np.array([known[x] for x in names], np.int64))
            # a group counts even where it has no term
            fresh = [x for x in every if x not in groups]
            groups.update(fresh)
            langs, sources = pa.array([x[0] for x in every], pa.string()), pa.array([x[1] for x in every], pa.string())
            new = len(fresh)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([langs.take(pa.array(g)), pa.array([x[0] for x in fresh], pa.string())]),
                pa.concat_arrays([sources.take(pa.array(g)), pa.array([x[1] for x in fresh], pa.string())]),
                pa.concat_arrays([pa.array(terms, pa.binary()).cast(pa.string()), pa.nulls(new, pa.string())]),
                pa.concat_arrays([pa.array(n), pa.array([0] * new, pa.int64())]),
                pa.concat_arrays([pa.array(docs.astype(np.int64)), pa.array([0] * new, pa.int64())]),
            ], schema=_TERMS)
            lo = hi


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; each occurring group also has a row without a term."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = docs.select(empty("lang"), empty("source"), empty("text")).mapInArrow(_sorted_slices, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + kept)), exact where the product has over 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", (wide(count) + 1) * F.lit(ONE).cast("decimal(10,0)"), wide(total) + wide(kept)) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, value): over terms that both sources have, what they add to the sums of terms that one has."""
    sums: dict[str, np.ndarray] = {}

    def rows(lang: str, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(value)], names=["lang", "a", "b", "value"])

    def held() -> Iterator[pa.RecordBatch]:
        for lang, matrix in sums.items():
            a, b = np.nonzero(matrix)
            yield rows(lang, a, b, matrix[a, b])
        sums.clear()

    for batch in batches:
        lists = batch["of"]
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        sid, p, rest = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("sid", "p", "p0"))
        starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        langs, width = batch["lang"].to_pylist(), batch["width"].to_numpy()
        by: dict[tuple[str, int, int], list[int]] = {}
        for i, key in enumerate(zip(langs, width.tolist(), sizes.tolist(), strict=True)):
            by.setdefault(key, []).append(i)
        for (lang, wide, k), mine in by.items():
            most = max(1, (1 << 21) // min(k, _SOURCES) ** 2)
            for lo in range(0, len(mine), most):
                at = starts[mine[lo : lo + most]][:, None]
                for i in range(0, k, _SOURCES):
                    left = at + np.arange(i, min(i + _SOURCES, k))
                    for j in range(0, k, _SOURCES):
                        right = at + np.arange(j, min(j + _SOURCES, k))
                        pa_, qa = p[left][:, :, None], rest[left][:, :, None]
                        pb, qb = p[right][:, None, :], rest[right][:, None, :]
                        value = (_gap(pa_, pb) - _gap(pa_, qb) - _gap(qa, pb) + _gap(qa, qb)).ravel()
                        key = (sid[left][:, :, None].astype(np.int64) * wide + sid[right][:, None, :]).ravel()
                        if wide <= 2 * _SOURCES:
                            np.add.at(sums.setdefault(lang, np.zeros((wide, wide), np.int64)).reshape(-1), key, value)
                        else:
                            pair, inverse = np.unique(key, return_inverse=True)
                            total = np.zeros(len(pair), np.int64)
                            np.add.at(total, inverse, value)
                            yield rows(lang, pair // wide, pair % wide, total)
            if len(sums) > _BLOCKS:
                yield from held()
    yield from held()


#: Groups that may be sent to every task; more are joined by a shuffle.
BROADCAST_GROUPS = 50_000


def divergence(docs: DataFrame, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: see the module's text."""
    word = Window.partitionBy("lang", "term")
    kept = term_counts(docs).select("lang", "source", "term", "n", F.sum("docs").over(word).alias("_docs"), F.sum("n").over(word).alias("n_lang"), (F.min("source").over(word) == F.col("source")).alias("_first"))
    # rows without a term only say that their group is there
    kept = materialize(kept.where(F.col("term").isNull() | (F.col("_docs") >= least_docs)).drop("_docs"), "terms")
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("term").alias("kinds"), F.count(F.when(F.col("_first"), F.col("term"))).alias("_new"))
    language = Window.partitionBy("lang")
    stats = groups.withColumn("kept", F.sum("_new").over(language)).withColumn("total_lang", F.sum("total").over(language)).withColumn("width", F.count("*").over(language).cast("int")).withColumn("sid", (F.row_number().over(language.orderBy("source")) - 1).cast("int")).drop("_new")
    stats = materialize(stats.withColumn("p0", F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept")))), "groups")
    small = F.broadcast(stats) if stats.count() <= BROADCAST_GROUPS else stats
    counts = kept.where("term is not null").drop("_first").join(small, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))

    over = counts.withColumn("q", share(F.col("n_lang"), F.col("total_lang"), F.col("kept"))).where("p > q")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    of_terms = over.select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most_terms)

    # how often each share occurs in a group
    shares = counts.groupBy("lang", "sid", "p").agg(F.count("*").alias("m")).groupBy("lang", "sid").agg(F.collect_list(F.struct("p", "m")).alias("shares"))
    one, two = (stats.select("lang", F.col("sid").alias(n), F.col("p0").alias(f"p0_{n}"), F.col("kinds").alias(f"kinds_{n}"), *more) for n, more in (("a", ["kept"]), ("b", [])))
    pairs = one.join(F.broadcast(two) if stats.count() <= BROADCAST_GROUPS else two, "lang").where("a <> b").repartition("lang", "a", "b")
    summed = lambda f: F.aggregate("shares", F.lit(0).cast("long"), lambda total, x: total + x["m"] * f(x["p"]))
    key = ["lang", "a", "b"]
    neither = pairs.select(*key, F.coalesce((F.col("kept") - F.col("kinds_a") - F.col("kinds_b")) * gap(F.col("p0_a"), F.col("p0_b")), F.lit(0)).alias("value"))
    mine = pairs.join(shares.withColumnRenamed("sid", "a"), ["lang", "a"]).select(*key, summed(lambda p: gap(p, F.col("p0_b"))).alias("value"))
    theirs = pairs.join(shares.withColumnRenamed("sid", "b"), ["lang", "b"]).select(*key, summed(lambda q: gap(F.col("p0_a"), q)).alias("value"))
    lists = counts.groupBy("lang", "term").agg(F.collect_list(F.struct("sid", "p", "p0")).alias("of"), F.first("width").alias("width")).where(F.size("of") > 1)
    both = lists.select("lang", "of", "width").mapInArrow(_common, "lang string, a int, b int, value long").where("a <> b")
    value = neither.unionByName(mine).unionByName(theirs).unionByName(both).groupBy(*key).agg(F.sum("value").alias("value"))
    name = lambda n, c: stats.select("lang", F.col("sid").alias(n), F.col("source").alias(c))
    of_pairs = value.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(best))
    out = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return out(of_pairs, "pair").unionByName(out(of_terms, "term"))
