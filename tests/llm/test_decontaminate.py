import random
import time
from itertools import combinations

from shutterlake.llm import decontaminate
from shutterlake.llm.common import table
from shutterlake.llm.decontaminate import _WORD, MASKS, WINDOW, contamination, keep_clean

from .fixtures import awkward, documents, empty


def brute(text, items, window=WINDOW, similarity=0.8):
    """Item ids with a window that agrees in enough words, on every alignment."""
    words, found = _WORD.findall((text or "").lower()), []
    for item, t in items:
        own = _WORD.findall(t.lower())
        need = min(window, len(own))
        if len(own) < 5:
            continue
        hit = any(
            sum(a == b for a, b in zip(own[i : i + need], words[j : j + need], strict=True)) >= similarity * need
            for j in range(len(words) - need + 1)
            for i in range(len(own) - need + 1)
        )
        if hit:
            found.append(item)
    return found


def test_masks_hit_every_window_with_two_substitutions():
    for wrong in combinations(range(WINDOW), 2):
        assert any(all(o + k not in wrong for k in m) for m in MASKS for o in range(WINDOW - m[-1]))


def test_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(prose(n))) for i, n in enumerate((4, 5, 7, 9, 13, 20, 40))]
    texts = []
    for k in range(120):
        own = items[k % len(items)][1].split()
        lo = rng.randint(0, max(0, len(own) - 14))
        passage = own[lo : lo + rng.randint(8, 20)]
        for at in rng.sample(range(len(passage)), min(len(passage), rng.randint(0, 4))):
            passage[at] = "changed"
        texts.append(" ".join(prose(rng.randint(0, 15)) + [w.upper() + "!" for w in passage] + prose(rng.randint(0, 15))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {k: brute(t, items) for k, t in enumerate(texts)}
    got = {r["doc_id"]: r["item_ids"] for r in contamination(documents(spark, texts), bench).collect()}
    assert got == want


def test_every_window_of_long_items_with_all_allowed_substitutions(spark):
    """Recall against brute force is 1 for items of 13 to 40 words."""
    rng = random.Random(4)
    items = [(n, " ".join(f"v{n}x{k}" for k in range(n))) for n in (13, 14, 20, 40)]
    texts, want = [], []
    for n, t in items:
        own = t.split()
        for lo in range(n - WINDOW + 1):
            for wrong in rng.sample(list(combinations(range(WINDOW), 2)), 12):
                texts.append(" ".join(["a", "b"] + [f"c{k}" if k in wrong else w for k, w in enumerate(own[lo : lo + WINDOW])] + ["d"]))
                want.append([n])
    got = {r["doc_id"]: r["item_ids"] for r in contamination(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_repetitive_texts_and_items(spark):
    """Places of a repeated word don't multiply."""
    texts = ["ha " * 30_000, "ha ho " * 20_000, "ha ho " * 5 + "x", "he " * 12]
    bench = spark.createDataFrame([(1, "ha " * 3000), (2, "ho ha " * 900), (3, "he " * 13)], "item_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in contamination(documents(spark, texts), bench).collect()}
    assert got == {0: [1], 1: [2], 2: [], 3: []}


def test_planted_passages_and_clean_documents(spark):
    sf = "/root/testdata/sf0.001"
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").where("n_chars < 1500").collect()}
    got = {r["doc_id"]: r["item_ids"] for r in contamination(table(spark, sf, "documents").where("n_chars < 1500"), table(spark, sf, "benchmark")).collect()}
    assert {k: v for k, v in got.items() if v} == {k: w for k, t in docs.items() if (w := brute(t, items))}


def test_awkward_and_empty(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g"), (2, None), (None, "x y z u v w"), (3, "")], "item_id long, text string")
    rows = contamination(awkward(spark), bench).collect()
    assert len(rows) == 8 and sorted(r["doc_id"] for r in rows if r["contaminated"]) == [3, 3]
    kept = keep_clean(awkward(spark), bench)
    assert kept.columns == awkward(spark).columns and kept.count() == 6
    assert contamination(empty(spark), bench).collect() == []
    assert contamination(awkward(spark), bench.where("false")).where("contaminated").count() == 0


def test_short_items_are_found_with_every_allowed_substitution(spark):
    items = [(n, " ".join(f"w{n}x{k}" for k in range(n))) for n in range(1, 13)]
    items += [(20, "这是一个没有空格的问题请回答它"), (21, "これはテスト")]
    texts, want = [], []
    for i, t in items:
        own = _WORD.findall(t)
        for k in range(len(own) + 1):
            if min(WINDOW, len(own)) - k < 0.8 * min(WINDOW, len(own)):
                break
            for wrong in combinations(range(len(own)), k):
                words = [f"c{j}" if j in wrong else w for j, w in enumerate(own)]
                texts.append("before, " + " ".join(words) + " after")
                want.append([i])
    texts += ["前" + items[12][1] + "后", "w5x0 w5x1 c w5x3 c", "w4x0 w4x1 w4x2 c"]
    want += [[20], [], []]
    docs = documents(spark, texts)
    for bench in (items, items[::-1]):
        found = contamination(docs, spark.createDataFrame(bench, "item_id long, text string"), min_words=1)
        got = {r["doc_id"]: r["item_ids"] for r in found.collect()}
        assert [got[k] for k in range(len(texts))] == want
    for item in (items[7], items[8], items[9]):  # with no other item in the block
        found = contamination(docs, spark.createDataFrame([item], "item_id long, text string"))
        assert {r["doc_id"] for r in found.where("contaminated").collect()} == {k for k, w in enumerate(want) if w == [item[0]]}


def test_clashing_names_come_through(spark):
    rows = [(1, "a b c d e f g h i j k l m n", 7, 8, {"k": "v"}), (2, "quite another text", 5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _h1 long, _H2 long, meta map<string,string>")
    bench = spark.createDataFrame([(9, "a b c d e f g h i j k l m n")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.keep_clean(docs, bench).collect()] == [rows[1]]
    assert decontaminate.keep_clean(docs, bench.limit(0)).count() == 2


def _similar(a, b):
    """Some alignment has a window of 13 words (or all of b) with 80 % equal words."""
    need = min(13, len(b))
    for shift in range(-len(b) + 1, len(a)):
        same = [0 <= i + shift < len(a) and a[i + shift] == w for i, w in enumerate(b)]
        if any(sum(same[k : k + need]) >= 0.8 * need and 0 <= k + shift and k + need + shift <= len(a) for k in range(len(b) - need + 1)):
            return True
    return False


def test_shared_opening_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "HOT_ITEMS", 3)
    rng = random.Random(8)
    opening = "please read the text below and answer each question".split()
    word = lambda: f"w{rng.randint(0, 4000)}"
    items = [opening + [word() for _ in range(rng.choice([0, 1, 2, 4, 20]))] for _ in range(40)] + [["one", "two", "three", "four", "five"][: rng.randint(2, 5)] + [word()] for _ in range(20)]
    docs = []
    for i in range(80):
        own = list(rng.choice(items))
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = word()
        docs.append([word() for _ in range(rng.randint(0, 9))] + (own if i % 2 else opening + [word() for _ in range(20)]) + [word() for _ in range(9)])
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: set(r["item_ids"]) for r in decontaminate.contamination(d, b, min_words=1).collect()}
    assert got == {i: {k for k, item in enumerate(items) if _similar(t, item)} for i, t in enumerate(docs)}
    assert any(got.values())


def test_many_documents_and_items_with_one_opening(spark):
    opening = "answer the following question with one of the choices given "
    docs = spark.range(2000).selectExpr("id as doc_id", f"concat('{opening}', array_join(transform(sequence(1, 30), i -> concat('d', id, 'x', i)), ' ')) as text")
    bench = spark.range(2000).selectExpr("id as item_id", f"concat('{opening}', array_join(transform(sequence(1, 30), i -> concat('b', id, 'x', i)), ' ')) as text")
    began = time.time()
    assert decontaminate.contamination(docs, bench, min_words=1).where("contaminated").count() == 0
    assert time.time() - began < 60
