import hashlib
import random
import zlib

import numpy as np
import pytest

from shutterlake.llm import prefix_trie, queries
from tests.llm.oracle import same_as_sql

SCHEMA = "conv_id long, turn long, role string, text string, key string"


def brute(rows):
    own = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.md5((hashlib.md5(role.encode()).hexdigest() + text).encode()).digest()
            own.setdefault(c, []).append((t is not None, t or 0, role, name, text))
    turns = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members = {}
    for c, p in built.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = set()

    def below(p):
        own = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        found = [below(k) for k in kids.get(p, [])]
        leaves, saved = sum(f[0] for f in found) or 1, own + sum(f[1] for f in found)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(built[c]) == len(p))
        out.add((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        below(())
    return out


def made(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 300), n):
        last = rng.randint(1, 12)
        same = rng.random() < 0.5  # a common opening, or the whole conversation
        for t in range(last):
            text = f"turn {t}" if same and t < rng.choice([2, 30]) else rng.choice(["ä", "", None, f"w{rng.randint(0, 9)}"])
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "user", None]) if not same else "user", text, "x"))
    rows += rows[:5] + [(None, 1, "user", "lost", "x")]
    return rows


@pytest.mark.parametrize("seed,block", [(1, 1 << 16), (2, 7), (3, 25), (4, 1)])
def test_nodes_equal_brute_force(spark, seed, block):
    rows = made(seed)
    got = prefix_trie.nodes(spark.createDataFrame(rows, SCHEMA), block_turns=block).select(prefix_trie.NODE).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == brute(rows)


def test_copies_over_many_blocks(spark):
    rows = [(c, t, "user", f"turn {t}", "x") for c in range(400) for t in range(9)] + [(c, 0, "user", f"only {c % 7}", "x") for c in range(500, 600)]
    got = set(map(tuple, prefix_trie.nodes(spark.createDataFrame(rows, SCHEMA), block_turns=50).collect()))
    assert got == brute(rows)


def test_deep_conversation_and_empty_table(spark):
    rows = [(0, t, "user", "a" * (t % 5), "x") for t in range(3000)] + [(1, 0, "user", "b", "x")]
    got = prefix_trie.nodes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert max(r["depth"] for r in got) == 3000 and len(got) == len({tuple(r) for r in got})
    assert next(r for r in got if r["depth"] == 0)["n_leaves"] == 1 + (prefix_trie.cut_point(1) < 1)
    assert prefix_trie.nodes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_double_array_walks():
    rng = np.random.default_rng(5)
    parent, ids = [-1], [0]
    level = [0]
    for _ in range(4):
        new = []
        for p in level:
            for i in sorted(rng.choice(50, rng.integers(0, 6), replace=False)):
                new.append(len(parent))
                parent.append(p)
                ids.append(i)
        level = new
    a = prefix_trie.DoubleArray(np.array(parent), np.array(ids))
    assert len(set(a.slot)) == len(parent)
    for node in range(1, len(parent)):
        assert a.step(a.slot[[parent[node]]], np.array([ids[node]]))[0] == a.slot[node]
    with pytest.raises(ValueError):
        a.step(np.array([0]), np.array([10_000]))


def test_query_equals_sql(spark):
    same_as_sql(spark, "op13", queries.op13_prefix_trie, queries.ORACLE_SQL["op13_prefix_trie"], "/root/testdata/sf0.001", ["conversations"])
