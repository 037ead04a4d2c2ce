"""SimHash near-dedup by Jaccard similarity: the links of the trie self-join, and those past its budget, verified exactly.

A text is the set of its five-word shingles (the whole text, if it is shorter).
Texts with one set are one node. The binary tries of ``simhash`` link nodes whose
fingerprints differ in at most three bits; each link is kept if the sets' exact
similarity is 0.8 or more. That similarity lies around ten differing bits, for
which no trie over 64 bits has a selective key, so nodes that the tries leave
apart get candidates from min-hash bands: 25 bands of four values; two nodes with
similarity 0.8 share one with a chance of 1 - (1 - 0.8**4)**25, all but two in a
million.

In each band group of up to BLOCK nodes, nodes of other classes are first compared
with its smallest and its largest node. What is then still in more than one class
is compared inside tasks by counting common shingles; a task returns a forest of
verified links, never its pairs.

Larger groups, which are near copies or texts of one template, are first taken
apart by what their nodes do not have in common. A centre has the shingles of over
half of the nodes; D is where a set differs from it (beyond it or lacking). Two
sets are similar enough if |Dx| + |Dy| - 2 * both <= w * (|x| + |y|), with both =
|Dx & Dy| and w = (1 - 0.8) / (1 + 0.8), so with excess e = |D| - w * n if
2 * both >= ex + ey. Every node is compared with the middle, the node of least
excess. A node that is not similar to the middle has ex + ey > 0 for every other y
(else ex + e of the middle <= 0), so it shares a difference with each node similar
to it, and nodes similar to the middle are one class. So only nodes that share
differences meet, in the groups of these; from them go nodes whose shared
differences can't reach any partner's excess there, again and again while that
helps, and of the rest the differences past a prefix, the rarest first. No pair
that is similar enough is lost.

What is then still over one block is split by a prefix filter over whole sets:
shingles are ordered by how many nodes have them, rarest first, and two sets that
are similar enough must share one of the first n - ceil(0.8 * n) + 1 of each. It is
taken for the groups where it leaves fewer comparisons; the others are compared in
blocks of BLOCK nodes, every block with every other.

Nulls and edge cases: null or empty texts, and those of white space only, are one
class; null doc_ids and repeated rows belong to the class of their text and come
last in the choice of the row that names it; an empty table gives an empty result;
further columns of any type and name are hashed with the row and come through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.llm.common import discard, group_starts, materialize, shuffle_parts, text_batches
from shutterlake.llm.components import components
from shutterlake.llm.simhash import Forest, majority, near_links, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 4
BLOCK = 400
PRUNINGS = 8  # rounds over the groups of differences, at most
_RNG = np.random.default_rng(41)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingle_set(text: str) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, WORDS), np.uint64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key for each band; the same four min-hashes in two bands give two keys."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), 1024):  # stays in the cache
        np.minimum(low, (_FACTORS[:, None] * shingles[lo : lo + 1024] + _TERMS[:, None]).min(axis=1), out=low)
    raw = low.tobytes()
    return np.array([xxhash.xxh64_intdigest(raw[k * 8 * ROWS : (k + 1) * 8 * ROWS], k) for k in range(BANDS)], np.uint64).view(np.int64)


def _hashable(docs: DataFrame, name: str) -> Column:
    """A column as it can be hashed: Spark hashes no maps and variants, so these go as JSON."""
    col, kind = F.col(f"`{name}`"), docs.schema[name].dataType.simpleString()
    return F.to_json(F.struct(col)) if "map<" in kind or "variant" in kind else col


def row_key(docs: DataFrame) -> Column:
    """A 128-bit hash of all columns, in hex; only rows that are equal in each share it."""
    values = [x for c in docs.columns for x in (_hashable(docs, c), F.col(f"`{c}`").isNull())]
    half = lambda *more: F.lpad(F.hex(F.xxhash64(*more)), 16, "0")
    return F.concat(half(*values), half(F.lit(1), *reversed(values)))


def _sketches(docs: DataFrame) -> DataFrame:
    """id (doc_id and row), node, n, fp, keys: one row per row of ``docs``."""
    id_type = pa.struct([("doc_id", pa.int64()), ("row", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in text_batches([batch], 1 << 20):
                sets = [shingle_set(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, id_type),
                        pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(majority(sets).view(np.int64)),
                        pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["id", "node", "n", "fp", "keys"],
                )

    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id struct<doc_id: long, row: string>, node long, n long, fp long, keys array<long>")


def _sets(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """node, shingles: of the texts in the given rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = {}
            for t in dict.fromkeys(batch.column(0).to_pylist()):
                s = shingle_set(t)
                sets[xxhash.xxh64_intdigest(s.tobytes())] = s.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(sets), np.uint64).view(np.int64)), pa.array(list(sets.values()), pa.list_(pa.int64()))], names=["node", "shingles"])

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), row_key(docs).alias("row")).join(rows, "row", "left_semi").select("text")
    return texts.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(left, "a").join(right, "b").where(both >= similarity * (F.size("of_a") + F.size("of_b") - both)).select("a", "b")


def _alike(similarity: float) -> Column:
    """Sets of too unlike sizes can't be similar."""
    return F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")


def _compare(nodes: np.ndarray, roots: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Verified links between other classes: of one block within itself, of two blocks across."""
    order = np.lexsort((nodes, blocks))
    nodes, blocks, sets = nodes[order], blocks[order], [sets[i] for i in order]
    sizes = np.array([len(x) for x in sets], np.int64)
    starts = group_starts(sizes)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    first = np.unique(roots[order], return_inverse=True)[1]
    classes, links = Forest(len(nodes)), []
    heads = np.full(first.max() + 1, len(nodes))
    np.minimum.at(heads, first, np.arange(len(nodes)))
    classes.union(heads[first], np.arange(len(nodes)))
    across = int(np.searchsorted(blocks, blocks[-1])) if blocks[0] != blocks[-1] else 0
    mark = np.zeros(codes.max() + 1, bool)
    for i in range(across or len(nodes) - 1):
        lo = across or i + 1
        others = np.arange(lo, len(nodes))
        apart = classes.find(others) != classes.find(np.array([i]))
        fits = np.minimum(sizes[lo:], sizes[i]) >= similarity * np.maximum(sizes[lo:], sizes[i])
        if not (apart & fits).any():
            continue
        mark[codes[starts[i] : starts[i] + sizes[i]]] = True
        both = np.add.reduceat(mark[codes[starts[lo] :]], starts[lo:] - starts[lo], dtype=np.int64)
        mark[codes[starts[i] : starts[i] + sizes[i]]] = False
        near = others[apart & fits & (both >= similarity * (sizes[lo:] + sizes[i] - both))]
        for j in near.tolist():
            if classes.find(np.array([i]))[0] != classes.find(np.array([j]))[0]:
                classes.union(np.array([i]), np.array([j]))
                links.append((int(nodes[i]), int(nodes[j])))
    return links


def _links_in_groups(left: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links within the groups of ``left`` (key, node, root, size), compared block by block."""
    own = left.withColumn("blocks", F.ceil(F.col("size") / F.lit(block)).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = own.select("key", "node", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", "node", "root", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def ready() -> pa.RecordBatch:
            nodes, roots, blocks = (np.array(x, np.int64) for x in list(zip(*held, strict=True))[:3])
            many = len(held) > 1 and (group[1] == group[2] or len(set(blocks.tolist())) == 2)
            links = _compare(nodes, roots, blocks, [h[3] for h in held], similarity) if many else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            shingles = b["shingles"]
            for i, (key, lo, hi, node, root, of) in enumerate(zip(*(b[c].to_pylist() for c in ("key", "lo", "hi", "node", "root", "block")), strict=True)):
                if held and group != (key, lo, hi):
                    yield ready()
                    held = []
                group = (key, lo, hi)
                held.append((node, root, of, shingles[i].values.to_numpy()))
        if held:
            yield ready()

    rows = dealt.join(sets, "node").select("key", "lo", "hi", "node", "root", "block", "shingles")
    parts = shuffle_parts(left.sparkSession)
    return rows.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "a long, b long")


def _differences(large: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """leader, node, n, excess, diff: how each node of the groups ``large`` (key, node, size) differs from a common centre.

    The leader of a group is its node with the most neighbours; groups with one leader are one. The centre has the
    shingles that over half of the leader's nodes have.
    """
    score = large.groupBy("node").agg(F.sum("size").alias("score"))
    leaders = large.join(score, "node").groupBy("key").agg(F.max(F.struct("score", "node"))["node"].alias("leader"))
    members = large.join(leaders, "key").select("leader", "node").distinct()
    diff = lambda a, b: F.concat(F.array_except(a, b), F.array_except(b, a))
    of_leader = sets.select(F.col("node").alias("leader"), F.col("shingles").alias("of_leader"))
    first = members.join(sets, "node").join(of_leader, "leader").select("leader", "node", F.size("shingles").alias("n"), diff("shingles", "of_leader").alias("diff"))
    first = materialize(first, "first")
    counts = first.select("leader", F.explode("diff").alias("shingle")).groupBy("leader", "shingle").agg(F.count("*").alias("nodes")).where("nodes > 1")
    usual = counts.join(first.groupBy("leader").agg(F.count("*").alias("all")), "leader").where("2 * nodes > all").groupBy("leader").agg(F.collect_list("shingle").alias("usual"))
    usual = first.join(usual, "leader", "left").select("leader", "node", "n", diff("diff", F.coalesce("usual", F.array().cast("array<long>"))).alias("diff"))
    excess = F.size("diff") - F.lit((1 - similarity) / (1 + similarity)) * F.col("n")
    return materialize(usual.select("leader", "node", "n", excess.alias("excess"), "diff"), "differences")


def _middles(diffs: DataFrame) -> DataFrame:
    """leader, middle, n_middle, of_middle: the node of least excess of each leader."""
    least = F.min_by(F.struct("node", "n", "diff"), F.struct("excess", "node")).alias("least")
    return diffs.groupBy("leader").agg(least).select("leader", F.col("least.node").alias("middle"), F.col("least.n").alias("n_middle"), F.col("least.diff").alias("of_middle"))


def _middle_links(diffs: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each middle with the nodes that are similar enough to it."""
    apart = F.size("diff") + F.size("of_middle") - 2 * F.size(F.array_intersect("diff", "of_middle"))
    total = F.col("n") + F.col("n_middle")
    both = (total - apart) / 2
    return diffs.join(_middles(diffs), "leader").where((F.col("node") != F.col("middle")) & (both >= similarity * (total - both))).select(F.col("middle").alias("a"), F.col("node").alias("b"))


def _groups_of_differences(diffs: DataFrame, rooted: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """leader, shingle, node, root, size: the nodes that have still to be compared, by a difference that they share.

    ``shingle`` is null for the leaders whose nodes are cheaper to compare as one group.
    """
    middles = rooted(_middles(diffs).select("leader", "middle"), "middle", "home").select("leader", "home")
    rows = rooted(diffs, "node", "root").join(middles, "leader").select("leader", "node", "root", (F.col("root") == F.col("home")).alias("at_home"), "excess", F.explode("diff").alias("shingle"))
    rows, before = materialize(rows, "differing"), 0
    for _ in range(PRUNINGS):
        # a partner's excess is at most ``reach``: both <= the differences that are left
        each = rows.select("leader", "node", "root", "at_home", "excess", "shingle").withColumn("reach", 2 * F.count("*").over(Window.partitionBy("leader", "node")) - F.col("excess") + 1e-6)
        far = lambda c: F.when(~F.col("at_home"), F.col(c))  # noqa: E731  nodes at home have one class already
        met = each.groupBy("leader", "shingle").agg(
            F.count("*").alias("nodes"), F.min("root").alias("r0"), F.max("root").alias("r1"),
            F.min("excess").alias("low"), F.max("reach").alias("high"), F.min(far("excess")).alias("low_far"), F.max(far("reach")).alias("high_far"),
        )
        met = each.join(met.where("r0 < r1"), ["leader", "shingle"]).withColumn("low", F.when(F.col("at_home"), F.col("low_far")).otherwise(F.col("low")))
        met = met.where((F.col("low") <= F.col("reach")) & (F.col("excess") <= F.when(F.col("at_home"), F.col("high_far")).otherwise(F.col("high"))))
        last, rows = rows, materialize(met.select("leader", "node", "root", "at_home", "excess", "shingle", "nodes", "low"), "differing")
        discard(last)
        now = rows.count()
        if not now or before and now > 0.8 * before:
            break
        before = now
    own = Window.partitionBy("leader", "node")
    least = F.greatest(F.lit(1), F.ceil((F.col("excess") + F.min("low").over(own)) / 2 - 1e-6))
    places = rows.withColumn("needed", F.count("*").over(own) - least + 1).withColumn("place", F.row_number().over(own.orderBy("nodes", "shingle")))
    places = materialize(places.where("place <= needed").select("leader", "shingle", "node", "root"), "places")
    split = places.groupBy("leader", "shingle").agg(F.count("*").alias("size"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("leader", "shingle", "size")
    whole = places.select("leader", "node", "root").distinct()
    wholes = whole.groupBy("leader").agg(F.count("*").alias("size"))
    dear = split.groupBy("leader").agg(F.sum(F.col("size").cast("double") * F.col("size")).alias("cost")).join(wholes, "leader").where(F.col("cost") >= F.col("size").cast("double") * F.col("size")).select("leader", "size")
    dear = materialize(dear, "dear")
    rest = whole.join(dear, "leader").select("leader", F.lit(None).cast("long").alias("shingle"), "node", "root", "size")
    return places.join(split.join(dear, "leader", "left_anti"), ["leader", "shingle"]).select("leader", "shingle", "node", "root", "size").unionByName(rest)


def _split_groups(left: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """``left`` (key, node, root, size) with groups over one block split by the shingles that their nodes' prefixes share.

    ``key`` becomes a struct of the band key and the shared shingle (null where the group stays whole).
    """
    whole = lambda rows: rows.select(F.struct("key", F.lit(None).cast("long").alias("shingle")).alias("key"), "node", "root", "size")
    large = left.where(F.col("size") > block)
    if large.isEmpty():
        return whole(left)
    each = large.select("node").distinct().join(sets, "node").select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count("*").alias("nodes")).where("nodes > 1")
    rarest = Window.partitionBy("node").orderBy(F.coalesce("nodes", F.lit(1)), "shingle")
    needed = F.col("n") - F.ceil(F.col("n") * similarity - 1e-6) + 1
    prefixes = each.join(common, "shingle", "left").withColumn("place", F.row_number().over(rarest)).where(F.col("place") <= needed)
    prefixes = materialize(prefixes.where("nodes is not null").select("node", "shingle"), "prefixes")
    places = large.select("key", "node", "root", "size").join(prefixes, "node")
    shared = places.groupBy("key", "shingle").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1")
    shared = materialize(shared.select("key", "shingle", "n"), "shared")
    dear = shared.groupBy("key").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("cost"))
    dear = large.select("key", "size").distinct().join(dear, "key").where(F.col("cost") >= F.col("size").cast("double") * F.col("size")).select("key")
    split = places.drop("size").join(shared.join(dear, "key", "left_anti"), ["key", "shingle"])
    split = split.select(F.struct("key", "shingle").alias("key"), "node", "root", F.col("n").alias("size"))
    rest = left.where(F.col("size") <= block).unionByName(large.join(dear, "key", "left_semi"))
    return whole(rest.select("key", "node", "root", "size")).unionByName(split)


def first_of_classes(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """doc_id, row: of each class the row with the smallest doc_id (null last), then the smallest row_key."""
    first = F.struct(F.col("id.doc_id").isNull().alias("without"), "id.doc_id", "id.row")
    nodes = materialize(_sketches(docs).groupBy("node").agg(F.min(first).alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "nodes")

    # links of the tries: nodes with one fingerprint, and the first nodes of two linked fingerprints
    heads = nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("same"))
    same = nodes.join(heads.where("same > 1"), "fp").where("node != head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    a, b = (heads.select(F.col("fp").alias(f"fp_{c}"), F.col("head").alias(c)) for c in "ab")
    near = near_links(nodes.select("fp")).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    tried = materialize(near.join(a, "fp_a").join(b, "fp_b").select("a", "b").unionByName(same), "tried")

    places = nodes.select("node", "n", F.explode("keys").alias("key"))
    groups = places.groupBy("key").agg(F.min(F.struct("node", "n")).alias("low"), F.max(F.struct("node", "n")).alias("high"), F.count("*").alias("size")).where("size > 1")
    shared = materialize(places.join(groups, "key"), "shared")
    needed = shared.select("node").union(tried.select(F.explode(F.array("a", "b")))).distinct()
    sets = materialize(_sets(docs, nodes.join(needed, "node", "left_semi").select("first.row")), "sets")
    links = materialize(_verified(tried, sets, similarity), "links")
    roots = materialize(components(links), "roots")

    def rooted(rows: DataFrame, node: str, root: str) -> DataFrame:
        return rows.join(roots.select(F.col("node").alias(node), F.col("root").alias(root)), node, "left").withColumn(root, F.coalesce(root, node))

    small, large = shared.where(F.col("size") <= block), shared.where(F.col("size") > block)
    diffs = None if large.isEmpty() else _differences(large.select("key", "node", "size"), sets, similarity)
    ends = small.select("node", "n", F.explode(F.array("low", "high")).alias("end")).where("node != end.node")
    ends = ends.select(F.least("node", "end.node").alias("a"), F.greatest("node", "end.node").alias("b"), F.col("n").alias("n_a"), F.col("end.n").alias("n_b"))
    ends = rooted(rooted(ends.where(_alike(similarity)).select("a", "b").distinct(), "a", "root_a"), "b", "root_b").where("root_a != root_b").select("a", "b")
    more = _verified(ends, sets, similarity)
    links = materialize(links.unionByName(more if diffs is None else more.unionByName(_middle_links(diffs, similarity))), "links")
    roots = materialize(components(links), "roots")

    left = rooted(small, "node", "root").select("key", "node", "root", "size", ((F.col("node") == F.col("low.node")) | (F.col("node") == F.col("high.node"))).alias("end"))
    still = left.where("size > 3 and not end").groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key")
    none = F.lit(None).cast("long")
    left = left.where("not end").join(still, "key", "left_semi").select(F.struct("key", none.alias("leader"), none.alias("difference")).alias("key"), "node", "root", "size")
    if diffs is not None:
        met = _groups_of_differences(diffs, rooted)
        left = left.unionByName(met.select(F.struct(none.alias("key"), "leader", F.col("shingle").alias("difference")).alias("key"), "node", "root", "size"))
    left = materialize(left, "left")
    roots = components(links.unionByName(_links_in_groups(_split_groups(left, sets, similarity, block), sets, similarity, block)))
    named = nodes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    return named.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.row")
