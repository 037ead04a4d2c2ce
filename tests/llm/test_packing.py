import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from shutterlake.llm.common import table
from shutterlake.llm.packing import best_fit_plan, pack

from .fixtures import awkward, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def check_layout(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_whole_table_against_tokenizers(spark):
    rows = pack(table(spark, SF, "documents"), PATH).collect()
    sequences = check_layout(rows, 2048)
    tok = Tokenizer.from_file(PATH)
    by = defaultdict(dict)
    for r in rows:
        by[r["doc_id"]][r["piece"]] = r
    docs = table(spark, SF, "documents").collect()
    total = 0
    for d in docs:
        ids = [*tok.encode(d["text"], add_special_tokens=False).ids, 0]
        total += len(ids)
        at = 0
        for k in range(len(by[d["doc_id"]])):
            r = by[d["doc_id"]][k]
            assert (r["start"], r["ids_crc32"]) == (at, zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes()))
            assert k == 0 or r["length"] == 2048 or len(ids) <= 2048
            at += r["length"]
        assert at == len(ids)
    assert sequences <= -(-total // 2048) * 1.02 + 1


def test_plan_is_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(40):
        capacity = rng.choice([7, 50, 200])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
        gaps = []
        for x in sorted(items, reverse=True):
            fit = min((g for g in gaps if g >= x), default=None)
            if fit is None:
                gaps.append(capacity - x)
            else:
                gaps[gaps.index(fit)] = fit - x
        counts = {x: items.count(x) for x in set(items)}
        plan, opened = best_fit_plan(counts, capacity)
        assert opened == len(gaps)
        used = defaultdict(list)
        for length, rank, n, per, size, first, offset in plan:
            assert size == 0
            for k in range(n):
                used[first + k // per].append((offset + k % per * length, length))
        assert sum(map(len, used.values())) == len(items)
        for spans in used.values():
            at = 0
            for o, n in sorted(spans):
                assert o == at
                at += n
            assert at <= capacity


def best_fit(items, capacity):
    gaps = []
    for x in sorted(items, reverse=True):
        fit = min((g for g in gaps if g >= x), default=None)
        if fit is None:
            gaps.append(capacity - x)
        else:
            gaps[gaps.index(fit)] = fit - x
    return sorted(gaps)


def test_rounds_equal_best_fit_decreasing(spark):
    """Over several ranges of lengths the rows' gaps are those of the sequential best fit."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    for capacity in (2048, 100):
        rows = pack(docs, PATH, capacity=capacity).collect()
        check_layout(rows, capacity)
        assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows)
        used = defaultdict(int)
        for r in rows:
            used[r["sequence_id"]] += r["length"]
        assert sorted(capacity - n for n in used.values()) == best_fit([r["length"] for r in rows], capacity)


def test_awkward_and_empty(spark):
    rows = pack(awkward(spark), PATH, capacity=64).collect()
    check_layout(rows, 64)
    assert sum(r["length"] for r in rows if r["doc_id"] in (1, 2)) == 2
    assert len([r for r in rows if r["doc_id"] == 3]) == 2
    assert any(r["doc_id"] is None for r in rows)
    assert pack(empty(spark), PATH).collect() == []
