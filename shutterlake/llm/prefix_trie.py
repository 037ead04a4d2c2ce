"""Conversation prefixes as one trie: how many conversations share each beginning.

Double-array tries over shards of sorted paths, merged where shards touch.

1. A turn is named by 16 bytes (MD5 over role and text) and its text's UTF-8
   length; texts are not shuffled. Conversations are dealt by the group that
   shares a base, and each is rebuilt into its path: the names of its turns.
2. Paths are sorted by (path, conv_id) over range partitions, so a group of
   equal or alike paths is split like any other run of rows. Each partition is
   cut into blocks of about ``block_turns`` turns.
3. Two neighbours in this order share the nodes of their common beginning, and
   no other nodes. A block is told how deep it shares with the block before and
   after it: two numbers for each block, the only rows sent to the driver.
4. A task packs each block into a double array: turns get dense ids in the order
   of a breadth-first walk, a node's children lie at BASE[node] + id, and CHECK
   holds the parent. Every path is walked through it, all paths one depth at a
   time, to count members; totals go up level by level.
5. Nodes inside a block are final. Shared upper nodes leave partial sums that add
   up over blocks: members, children and texts are counted by the first block
   that holds a node. Members that end in a shared node are hashed in order, as
   a stream of pieces.

Nulls and edge cases: a null role or text is empty; a null turn comes first, and
equal turns go by role, then by the MD5 of the text (repeated rows stay); rows
with a null conv_id belong to no conversation and are left out; further columns
are ignored; an empty table gives no node, not even a root. One conversation's
path (24 bytes a turn) is held by one task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from shutterlake.llm.common import group_starts, materialize, shuffle_parts

NAME = 16
#: Conversations of a base, and the most turns taken from it, less one.
GROUP, MOST = 5, 9
#: Shared nodes that may be sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
_NONE = hashlib.sha256(b"").hexdigest()
_TRIES = 64


def cut_point(conv_id: int) -> int:
    """How many turns of its base a conversation is rebuilt with."""
    return zlib.crc32(str(conv_id).encode()) % MOST


def _named_turns(turns: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    name = F.unhex(F.md5(F.concat(F.md5(role.cast("binary")), text).cast("binary")))
    return turns.where("conv_id is not null").select((conv - conv % GROUP).alias("base"), conv.alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), name.alias("name"), F.octet_length(text).cast("long").alias("size"))


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, path, sizes) of each conversation; the rows of a base come first in its group."""
    out: list[tuple[int, bytes, list[int]]] = []
    at = base = None
    lead: list[tuple[bytes, int]] = []
    own: list[tuple[bytes, int]] = []
    held = 0

    def close() -> None:
        nonlocal lead, held
        if at is None:
            return
        if at == base:
            lead = own[: MOST - 1]
        cut = cut_point(at)
        path = lead[:cut] + own[cut:]
        out.append((at, b"".join(n for n, _ in path), [s for _, s in path]))
        held += len(path) + 1

    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PATHS.types, strict=True)], schema=_PATHS)

    for batch in batches:
        for b, c, name, size in zip(*(batch[k].to_pylist() for k in ("base", "conv_id", "name", "size")), strict=True):
            if c != at:
                close()
                if held > 200_000:
                    yield flushed()
                    out, held = [], 0
                lead = lead if b == base else []
                at, base, own = c, b, []
            own.append((name, size))
    close()
    if out:
        yield flushed()


_PATHS = pa.schema([("conv_id", pa.int64()), ("path", pa.binary()), ("sizes", pa.list_(pa.int64()))])


def rebuilt_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): each conversation's turns behind the first ones of its base."""
    named = _named_turns(turns)
    order = [F.col("base"), F.col("conv_id") != F.col("base"), F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("name")]
    return named.repartition("base").sortWithinPartitions(*order).select("base", "conv_id", "name", "size").mapInArrow(_rebuilt, "conv_id long, path binary, sizes array<long>")


def _blocks(block_turns: int):
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first", pa.binary()), ("last", pa.binary()), ("convs", pa.list_(pa.int64())), ("depths", pa.list_(pa.int64())), ("names", pa.binary()), ("sizes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        convs: list[int] = []
        paths: list[bytes] = []
        sizes: list[list[int]] = []
        held, part = 0, 0

        def block() -> pa.RecordBatch:
            row = [part, seq, paths[0], paths[-1], convs, [len(p) // NAME for p in paths], b"".join(paths), [s for one in sizes for s in one]]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types, strict=True)], schema=schema)

        for batch in batches:
            for part, c, p, s in zip(*(batch[k].to_pylist() for k in ("part", "conv_id", "path", "sizes")), strict=True):
                convs.append(c)
                paths.append(p)
                sizes.append(s)
                held += len(s) + 1
                if held >= block_turns:
                    yield block()
                    seq += 1
                    convs, paths, sizes, held = [], [], [], 0
        if convs:
            yield block()

    return run, "part int, seq int, first binary, last binary, convs array<long>, depths array<long>, names binary, sizes array<long>"


def shared_turns(a: bytes | None, b: bytes | None) -> int:
    """How many turns two paths have in common at the front; -1 if one is missing."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // NAME
    x, y = (np.frombuffer(p, np.uint8, n * NAME).reshape(n, NAME) for p in (a, b))
    differ = np.flatnonzero((x != y).any(axis=1))
    return int(differ[0]) if len(differ) else n


@F.pandas_udf(IntegerType())
def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([shared_turns(x, y) for x, y in zip(a, b, strict=True)])


class DoubleArray:
    """BASE and CHECK of a trie whose nodes come in breadth-first order.

    ``parent`` and ``ids`` give each node's parent and the dense id of its last turn
    (for the root -1 and 0). A node's children lie at BASE[slot] + id.
    """

    def __init__(self, parent: np.ndarray, ids: np.ndarray):
        n = len(parent)
        self.slot = np.zeros(n, np.int64)
        used = bytearray(b"\1") + bytearray(2 * n)
        base: dict[int, int] = {}
        free = 1
        starts = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]]) if n else np.zeros(0, int)
        ends = np.r_[starts[1:], n]
        for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
            if parent[lo] < 0:
                continue
            # children of one parent are neighbours; their ids need not be
            kids = ids[lo:hi].tolist()
            least = min(kids)
            off = [k - least for k in kids]
            while free < len(used) and used[free]:
                free += 1
            at, tries = free, 0
            while any(at + o < len(used) and used[at + o] for o in off):
                at = at + 1 if tries < _TRIES else len(used)
                tries += 1
            top = at + max(off) + 1
            if top > len(used):
                used.extend(bytes(top - len(used) + n // 4))
            for o, node in zip(off, range(lo, hi), strict=True):
                used[at + o] = 1
                self.slot[node] = at + o
            base[int(self.slot[parent[lo]])] = at - least
        size = int(self.slot.max()) + 1 if n else 1
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.base[np.fromiter(base, np.int64, len(base))] = np.fromiter(base.values(), np.int64, len(base))
        self.check[self.slot[1:]] = self.slot[parent[1:]]

    def step(self, state: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The slots that these ids lead to; a walk that leaves the trie is an error."""
        to = self.base[state] + ids
        if len(to) and not ((to >= 0) & (to < len(self.check))).all() or not (self.check[to] == state).all():
            raise ValueError("no such turn")
        return to


class Block:
    """The trie of one block of sorted paths, and its counts for each node in breadth-first order."""

    def __init__(self, convs: np.ndarray, depths: np.ndarray, names: np.ndarray, sizes: np.ndarray):
        starts = group_starts(depths)
        names = names.view(f"S{NAME}")  # all of one width, so trailing zeros tell nothing apart wrongly
        n = len(convs)
        # nodes by depth: a path opens one where it leaves the path before it
        parent, name_at, size_of, self.level = [np.array([-1])], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], [0, 1]
        here, same = np.zeros(n, np.int64), np.r_[False, np.ones(max(n - 1, 0), bool)]
        depth, active = 1, np.flatnonzero(depths >= 1)
        while len(active):
            at = starts[active] + depth - 1
            alike = same[active] & np.r_[False, np.diff(active) == 1]
            alike[1:] &= names[at[1:]] == names[at[:-1]]
            same[active] = alike
            # behind a path that is too short there is nothing to share
            opened = np.flatnonzero(~alike)
            parent.append(here[active[opened]])
            name_at.append(at[opened])
            size_of.append(sizes[at[opened]])
            here[active] = self.level[-1] + np.cumsum(~alike) - 1
            self.level.append(self.level[-1] + len(opened))
            depth += 1
            active = active[depths[active] >= depth]
        self.parent = np.concatenate(parent)
        self.size = np.concatenate(size_of)
        # dense ids by first appearance, so that most siblings have neighbouring ids
        every = np.concatenate(name_at)
        if len(every):
            _, first, inverse = np.unique(names[every], return_index=True, return_inverse=True)
            rank = np.empty(len(first), np.int64)
            rank[np.argsort(first)] = np.arange(len(first))
            ids = rank[inverse]
        else:
            ids = np.zeros(0, np.int64)
        self.array = DoubleArray(self.parent, np.r_[0, ids])
        node_of = np.zeros(len(self.array.check), np.int64)
        node_of[self.array.slot] = np.arange(len(self.parent))
        known = names[every] if len(every) else names
        order = np.argsort(known) if len(every) else np.zeros(0, np.int64)
        ids_of = ids[order[np.searchsorted(known[order], names)]] if len(names) else ids
        # every path through the double array, one depth at a time
        total = len(self.parent)
        self.n, self.least = np.zeros(total, np.int64), np.full(total, np.iinfo(np.int64).max)
        self.n[0], self.least[0] = n, convs.min()
        state = np.zeros(n, np.int64)
        for d in range(1, len(self.level) - 1):
            active = np.flatnonzero(depths >= d)
            state[active] = self.array.step(state[active], ids_of[starts[active] + d - 1])
            node = node_of[state[active]]
            self.n += np.bincount(node, minlength=total)
            np.minimum.at(self.least, node, convs[active])
        self.end = node_of[state]
        self.children = np.bincount(self.parent[1:], minlength=total)
        self.depth = np.repeat(np.arange(len(self.level) - 1), np.diff(self.level))

    def totals(self, values: np.ndarray) -> np.ndarray:
        """Sums over each node's subtree."""
        out = values.copy()
        for d in range(len(self.level) - 2, 0, -1):
            lo, hi = self.level[d], self.level[d + 1]
            out += np.bincount(self.parent[lo:hi], out[lo:hi], minlength=len(out)).astype(np.int64) if abs(out[lo:hi]).sum() < 1 << 52 else _exact(self.parent[lo:hi], out[lo:hi], len(out))
        return out

    def on_path(self, row: int) -> list[int]:
        """The nodes of a path from the root on."""
        node, out = int(self.end[row]), []
        while node >= 0:
            out.append(node)
            node = int(self.parent[node])
        return out[::-1]


def _exact(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, at, values)
    return out


_ROW = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()), ("above", pa.list_(pa.binary())), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("ends", pa.binary())])
_ROW_SQL = "kind int, key binary, parent_key binary, above array<binary>, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends binary"
DONE, SHARED, PIECE = range(3)


def _counted(convs: np.ndarray, depths: np.ndarray, raw: bytes, sizes: np.ndarray, before: int, after: int) -> pa.RecordBatch:
    """Rows of a block: finished nodes, partial sums of shared ones, and the members that end in these."""
    b = Block(convs, depths, np.frombuffer(raw, np.uint8), sizes)
    total = len(b.parent)
    starts = group_starts(depths)
    front, back = b.on_path(0)[: before + 1], b.on_path(len(convs) - 1)[: after + 1]
    shared, theirs = np.zeros(total, bool), np.zeros(total, bool)
    shared[front], shared[back], theirs[front] = True, True, True
    mine = ~theirs
    leaves = b.totals(((b.children == 0) & ~shared).astype(np.int64))
    saved = b.totals(b.n * b.size - mine * b.size)
    owned = np.bincount(b.parent[1:], mine[1:], minlength=total).astype(np.int64)
    keys: dict[int, bytes] = {}
    for row, nodes in ((0, front), (len(convs) - 1, back)):
        for d, node in enumerate(nodes):
            keys[node] = hashlib.md5(raw[starts[row] * NAME : (starts[row] + d) * NAME]).digest()
    # members by the node they end in, ascending: equal paths are neighbours and sorted by id
    ends: dict[int, str] = {}
    cuts = np.flatnonzero(np.r_[True, b.end[1:] != b.end[:-1]])
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(convs)], strict=True):
        ends[int(b.end[lo])] = ",".join(map(str, convs[lo:hi].tolist()))
    up = np.where(b.parent >= 0, b.parent, 0)
    over = np.flatnonzero(~shared)
    sha = [hashlib.sha256(ends[i].encode()).hexdigest() if i in ends else _NONE for i in over.tolist()]
    known = ~shared[up[over]] & (b.parent[over] >= 0)
    nothing = [None] * len(over)
    done = [[DONE] * len(over), nothing, [keys.get(i) if i >= 0 else None for i in b.parent[over].tolist()], nothing, b.least[over], b.depth[over], pa.array(b.least[up[over]], mask=~known), b.n[over], b.children[over], leaves[over], saved[over], sha, nothing]
    rows = []
    for node, key in keys.items():
        chain = [keys[i] for i in _above(b, node)]
        rows.append((SHARED, key, chain[-1] if chain else None, [*chain, key] if not b.children[node] else None, int(b.least[node]), int(b.depth[node]), None, int(b.n[node]), int(owned[node]), int(leaves[node]), int(saved[node]), None, None))
        if node in ends:
            rows.append((PIECE, key, None, None, int(ends[node].split(",", 1)[0]), None, None, None, None, None, None, None, ends[node].encode()))
    more = list(zip(*rows, strict=True)) or [()] * len(_ROW)
    columns = [pa.concat_arrays([pa.array(a, t) if not isinstance(a, pa.Array) else a, pa.array(list(m), t)]) for a, m, t in zip(done, more, _ROW.types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=_ROW)


def _above(b: Block, node: int) -> list[int]:
    out = []
    while (node := int(b.parent[node])) >= 0:
        out.append(node)
    return out[::-1]


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) of pieces that come in order; one piece is held at a time."""
    at, digest = None, None
    out: list[tuple[bytes, str]] = []
    for batch in batches:
        for key, piece in zip(batch["key"].to_pylist(), batch["ends"], strict=True):
            if key != at:
                if at is not None:
                    out.append((at, digest.hexdigest()))
                at, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(piece.as_py())
    if at is not None:
        out.append((at, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([s for _, s in out], pa.string())], names=["key", "ends_sha256"])


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(turns: DataFrame, block_turns: int = 1 << 16) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations (columns ``NODE``)."""
    spark = turns.sparkSession
    paths = materialize(rebuilt_paths(turns), "paths")
    run, ddl = _blocks(block_turns)
    ranged = paths.repartitionByRange(shuffle_parts(spark), "path", "conv_id").sortWithinPartitions("path", "conv_id")
    cut = materialize(ranged.select(F.spark_partition_id().alias("part"), "conv_id", "path", "sizes").mapInArrow(run, ddl), "blocks")
    # one row per block: no more than a driver can hold of two numbers each
    order = Window.orderBy("part", "seq")
    touching = cut.select("part", "seq", "first", "last").select("part", "seq", "first", "last", F.lag("last").over(order).alias("prior"), F.lead("first").over(order).alias("next"))
    edges = {(r[0], r[1]): (r[2], r[3]) for r in touching.select("part", "seq", _shared("prior", "first"), _shared("last", "next")).collect()}

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                convs, depths, sizes = (batch[c][i].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("convs", "depths", "sizes"))
                yield _counted(convs, depths, batch["names"][i].as_py(), sizes, *edges[batch["part"][i].as_py(), batch["seq"][i].as_py()])

    found = materialize(cut.mapInArrow(tries, _ROW_SQL), "nodes")
    total = lambda c: F.sum(c).alias(c)
    shared = found.where(F.col("kind") == SHARED).groupBy("key", "parent_key", "depth").agg(F.min("conv_id").alias("conv_id"), *(total(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.first("above", ignorenulls=True).alias("above"))
    shared = materialize(shared, "shared")
    # a shared node without children is one leaf, whichever blocks its copies fill
    ends_here = shared.where("n_children = 0").select(F.explode("above").alias("key")).groupBy("key").agg(F.count("*").alias("more"))
    pieces = found.where(F.col("kind") == PIECE).select("key", "conv_id", "ends").repartition("key").sortWithinPartitions("key", "conv_id").select("key", "ends")
    hashed = pieces.mapInArrow(_hashed_ends, "key binary, ends_sha256 string")
    parents = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_above"))
    parents = F.broadcast(parents) if shared.count() <= BROADCAST_ROWS else parents
    upper = shared.join(ends_here, "key", "left").join(hashed, "key", "left").join(parents, "parent_key", "left")
    upper = upper.select("conv_id", "depth", F.col("_above").alias("parent_conv_id"), "n_convs", "n_children", (F.col("n_leaves") + F.coalesce("more", F.lit(0))).alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"))
    lower = found.where(F.col("kind") == DONE).join(parents, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_above")).select(*NODE)
    return lower.unionByName(upper)
