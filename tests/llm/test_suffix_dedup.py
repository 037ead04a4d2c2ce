import random

import pytest

from shutterlake.llm.common import table
from shutterlake.llm.suffix_dedup import remove_repeats

from .fixtures import awkward, documents, empty


def brute(rows):
    """doc_id -> (n_bytes, n_removed, n_spans, kept), by a dictionary of all strings."""
    first, raws = {}, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        raw = (text or "").encode()
        raws.append((doc, raw))
        for p in range(len(raw) - 99):
            first.setdefault(raw[p : p + 100], (doc, p))
    out = {}
    for doc, raw in raws:
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if first[raw[p : p + 100]] != (doc, p):
                gone[p : p + 100] = b"\x01" * 100
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = (len(raw), sum(gone), spans, bytes(c for c, g in zip(raw, gone, strict=True) if not g))
    return out


def check(df, rows=None):
    got = remove_repeats(df, part_bytes=50_000).collect()
    want = brute(rows or [(r["doc_id"], r["text"]) for r in df.collect()])
    assert len(got) == df.count()
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[r["doc_id"]], r["doc_id"]


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_repeats(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randint(1, 9)))
    passages = ["".join(word() for _ in range(60))[:n] for n in (99, 100, 101, 150, 151, 152, 250, 300)]
    texts = []
    for i in range(120):
        parts = ["".join(word() for _ in range(rng.randint(0, 40))) for _ in range(3)]
        for k in range(2):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        texts.append("".join(parts) if i % 9 else rng.choice(passages))
    texts += ["a" * 99, "a" * 100, "a" * 101, "ab" * 400, "x" * 3000, "", texts[5], texts[5][:140], texts[7][30:]]
    check(documents(spark, texts))


def test_table_against_brute_force(spark):
    check(table(spark, "/root/testdata/sf0.001", "documents").repartition(6))


def test_awkward_and_empty(spark):
    df = awkward(spark).where("doc_id is null or doc_id not in (4, 5)")
    check(df)
    rows = {r["doc_id"]: r for r in remove_repeats(awkward(spark)).collect()}
    assert rows[5]["n_removed"] == 50_000 - 1 and rows[4]["n_removed"] == 330_000 - 11
    assert remove_repeats(empty(spark)).collect() == []
