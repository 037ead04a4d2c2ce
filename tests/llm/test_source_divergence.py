import random
import re
from collections import Counter, defaultdict

import numpy as np

from shutterlake.llm import queries, source_divergence
from tests.llm.oracle import same_as_sql

SCHEMA = "doc_id long, text string, lang string, source string, n long"
_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in _TERM.findall(text or "")]


def brute(rows, most=200):
    docs, counts, groups = defaultdict(set), Counter(), set()
    for i, (_, text, lang, source, *_) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in terms(text):
            docs[lang, t].add(i)
            counts[lang, source, t] += 1
    kept = defaultdict(set)
    for (lang, t), d in docs.items():
        if len(d) >= 3:
            kept[lang].add(t)
    total = lambda lang, source: sum(counts[lang, source, t] for t in kept[lang])
    sources = defaultdict(set)
    for lang, source in groups:
        sources[lang].add(source)
    out = set()
    for lang, source in groups:
        v, n = len(kept[lang]), total(lang, source)
        p = {t: 1 + 10**9 * (counts[lang, source, t] + 1) // (n + v) for t in kept[lang]}
        gap = lambda a, b: (a - b) ** 2 // b
        pairs = []
        for other in sources[lang] - {source}:
            m = total(lang, other)
            pairs.append((-sum(gap(p[t], 1 + 10**9 * (counts[lang, other, t] + 1) // (m + v)) for t in p), other.encode()))
        every = {t: sum(counts[lang, s, t] for s in sources[lang]) for t in p}
        m = sum(every.values())
        found = [(-gap(p[t], 1 + 10**9 * (every[t] + 1) // (m + v)), t.encode()) for t in p if counts[lang, source, t] and p[t] > 1 + 10**9 * (every[t] + 1) // (m + v)]
        out |= {(lang, source, "pair", i.decode(), -x, r) for r, (x, i) in enumerate(sorted(pairs), 1)}
        out |= {(lang, source, "term", i.decode(), -x, r) for r, (x, i) in enumerate(sorted(found)[:most], 1)}
    return out


def made(seed):
    rng = random.Random(seed)
    words = ["a", "An", "abcdefgh", "abcdefghi", "ABCDEFGHI", "abcdefghabcdefghx", "Straße", "straße", "日本語", "x" * 40, "x" * 41, "É", "e" * 8, "z" * 16] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    rows = []
    for i in range(300):
        source = "hot" if rng.random() < 0.4 else rng.choice(["s1", "s2", "é", None, ""])
        text = rng.choice([" ", "-", "1", "\n"]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 20, 60])))
        rows.append((i, text or None, rng.choice(["de", "en", None]), source, 1))
    return [*rows, (400, "only here", "fr", "s1", 1), (401, None, "en", "bare", 1), (402, "one two", "it", "s1", 1), (403, "three", "it", "s2", 1), *rows[:4]]


def test_rows_equal_brute_force(spark):
    rows = made(1)
    got = source_divergence.divergence(spark.createDataFrame(rows, SCHEMA).repartition(7), most_terms=5).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == brute(rows, 5)


def test_many_sources_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "_SOURCES", 3)
    monkeypatch.setattr(source_divergence, "BROADCAST_GROUPS", 0)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(20)), "en", f"s{i % 9}", 1) for i in range(90)]
    got = source_divergence.divergence(spark.createDataFrame(rows, SCHEMA)).collect()
    assert set(map(tuple, got)) == brute(rows)


def test_pointers_and_runs():
    rng = random.Random(4)
    for few in (2, 64):
        source_divergence._FEW, kept = few, source_divergence._FEW
        texts = [" ".join("ab"[rng.random() < 0.2] * rng.choice([1, 7, 8, 9, 16, 17, 40]) for _ in range(50)) for _ in range(9)] + ["", "abc", "def"]
        raw = "".join(texts).encode()
        data = np.r_[np.frombuffer(raw, np.uint8), np.zeros(8, np.uint8)]
        cuts = np.cumsum([0, *(len(t) for t in texts)])
        starts, sizes = source_divergence.term_pointers(data[:-8], cuts)
        found = [raw[s : s + z].decode() for s, z in zip(starts, sizes, strict=True)]
        assert found == [t for x in texts for t in terms(x)]
        run = source_divergence.equal_runs(data, starts, sizes)
        assert [sorted(set(found)).index(f) for f in found] == run.tolist()
        source_divergence._FEW = kept


def test_empty_table(spark):
    assert source_divergence.divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_sql(spark):
    rows = same_as_sql(spark, "op11", queries.op11_source_divergence, queries.ORACLE_SQL["op11_source_divergence"], "/root/testdata/sf0.001", ["documents"])
    assert {r["part"] for r in rows} == {"pair", "term"}
