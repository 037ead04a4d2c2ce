import random
import time

import numpy as np
import pytest
import xxhash

from shutterlake.llm.common import table
from shutterlake.llm.components import components
from shutterlake.llm.simhash import as_hex, fingerprints_of, near_duplicates, near_links, walk

from .fixtures import awkward, empty

SF = "/root/testdata/sf0.01"


def brute_classes(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    arr = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            if a != b:
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_by_hand():
    def slow(text):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
        sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    texts = ["", " \t\n", "One", "one TWO", "a b c", "a b c d", "É Ü x\x0by z w", "to be or not " * 50]
    assert fingerprints_of(texts).tolist() == [slow(t) for t in texts]


def test_table_against_brute_force(spark):
    rows = near_duplicates(table(spark, SF, "documents")).select("doc_id", "fp", as_hex("fp").alias("hex"), "component_id").orderBy("doc_id").collect()
    fps = [int(r["hex"], 16) for r in rows]
    roots = brute_classes(fps)
    low = {}
    for r, root in zip(rows, roots, strict=True):
        low[root] = min(low.get(root, r["doc_id"]), r["doc_id"])
    assert [r["component_id"] for r in rows] == [low[x] for x in roots]


@pytest.mark.parametrize("seed", range(3))
def test_clusters_and_chains(spark, seed):
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(200)] + [0, 2**64 - 1]
    for center in fps[:4]:
        for _ in range(150):
            x = center
            for b in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << b
            fps.append(x)
    x = fps[9]
    for b in range(40):  # a chain: each link is near, its ends are far
        x ^= 1 << b
        fps.append(x)
    fps = list(dict.fromkeys(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r["node"]: r["root"] for r in components(near_links(df)).collect()}
    got = [roots.get(x, x) for x in signed]
    want = brute_classes(fps)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_awkward_and_empty(spark):
    rows = near_duplicates(awkward(spark)).collect()
    assert len(rows) == 8
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fp"] == by[2]["fp"] == 0 and by[2]["component_id"] == 1
    assert by[None]["component_id"] is None
    assert near_duplicates(empty(spark)).collect() == []


def test_hot_keys_are_split(spark):
    rng = random.Random(11)
    fps = {rng.getrandbits(32) for _ in range(1500)}  # one key of every trie whose top blocks are the high ones
    center = rng.getrandbits(64)
    for _ in range(1500):
        x = center
        for b in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute_classes(fps)
    for hot_rows in (64, 10**9):
        roots = {r["node"]: r["root"] for r in components(near_links(df, hot_rows=hot_rows)).collect()}
        got = [roots.get(x, x) for x in signed]
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_many_fingerprints_under_one_key():
    rng = np.random.default_rng(2)
    path = np.unique(rng.integers(0, 1 << 32, 16_000, np.uint64))
    whole = (np.array([0]), np.array([len(path)]))
    began = time.time()
    label = walk(path, 32, 3, whole, whole)
    assert time.time() - began < 30
    some = np.flatnonzero(label != np.arange(len(path)))[:50]
    assert len(some) and all((np.bitwise_count(path ^ path[i]) <= 3).sum() > 1 for i in some)
