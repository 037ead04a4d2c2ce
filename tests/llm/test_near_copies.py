import random

from pyspark.sql import functions as F

import corpus_pipeline
from shutterlake.llm import near_copies
from shutterlake.llm.common import table

from .fixtures import awkward, documents, empty


def brute(docs):
    """Smallest ids of the classes linked by a five-word Jaccard similarity of 0.8, pair by pair."""
    sets, root = [], {i: i for i, _ in docs}
    for i, t in docs:
        w = t.encode("utf-8", "replace").lower().split()
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
                both = len(a & b)
                if 5 * both >= 4 * (len(a) + len(b) - both):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return {find(i) for i in root}


def kept(spark, docs):
    return sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").select("doc_id").collect())


def test_table_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    assert kept(spark, docs) == sorted(brute([(r["doc_id"], r["text"]) for r in docs.collect()]))


def test_copies_at_the_limit_and_chains(spark):
    rng = random.Random(3)
    prose = lambda n: [f"w{rng.randrange(10_000)}" for _ in range(n)]
    texts = []
    for n in (5, 12, 40, 60, 200, 900):
        for _ in range(6):
            words = prose(n)
            for _ in range(5):  # each a little further from the last
                texts.append(" ".join(words))
                words = list(words)
                for at in rng.sample(range(n), max(1, n // rng.choice((20, 50, 90)))):
                    words[at] = "changed"
    one = prose(100)
    for _ in range(150):  # a large group, in which some are near to few others only
        words = list(one)
        for at in rng.sample(range(100), rng.randint(1, 5)):
            words[at] = f"x{rng.randrange(10_000)}"
        texts.append(" ".join(words))
    want = sorted(brute(list(enumerate(texts))))
    assert len(want) < len(texts)
    assert kept(spark, documents(spark, texts)) == want


def test_awkward_and_empty(spark):
    found = corpus_pipeline.drop_near_copies(spark, awkward(spark), "")
    assert found.columns == awkward(spark).columns
    assert corpus_pipeline.drop_near_copies(spark, empty(spark), "").collect() == []


def test_one_row_of_each_class(spark):
    rows = [(None, "unique words without any id at all here"), (None, "shared text of two rows one with id"), (7, "shared text of two rows one with id"), (3, "an exact row that comes twice in it"), (3, "an exact row that comes twice in it"), (5, "first of two texts under one id only"), (5, "something else altogether in the second of the texts"), (2, "something else altogether in the second of the texts"), (None, "copies without ids come to one row"), (None, "copies without ids come to one row")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.drop_near_copies(spark, docs, "")
    got = sorted(((r["doc_id"], r["text"][:6]) for r in found.collect()), key=str)
    assert got == sorted([(None, "unique"), (7, "shared"), (3, "an exa"), (5, "first "), (2, "someth"), (None, "copies")], key=str)
    assert corpus_pipeline.drop_near_copies(spark, awkward(spark), "").count() == 6  # 8 rows, one repeated, two empty texts


def test_blocks_equal_brute_force(spark):
    """A group whose nodes are alike, some under and some over the limit, cut into many blocks."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    texts = []
    for _ in range(200):
        words = list(base)
        for at in rng.sample(range(120), rng.randint(1, 9)):
            words[at] = f"x{rng.randrange(10_000)}"
        texts.append(" ".join(words))
    want = sorted(brute(list(enumerate(texts))))
    docs = documents(spark, texts)
    for block in (7, 400):
        assert sorted(r["doc_id"] for r in near_copies.first_of_classes(docs, block=block).collect()) == want
    assert 1 < len(want) < 200


def template_texts(rng, n):
    """One letter with a body of its own each; every fifth is a near copy of the one before it."""
    letter = [f"w{rng.randrange(10_000)}" for _ in range(80)]
    texts = []
    for i in range(n):
        if i % 5:
            words = [*letter, *(f"x{rng.randrange(1_000_000)}" for _ in range(20))]
        else:
            words = [*words[:-1], "changed"] if texts else list(letter)
        texts.append(" ".join(words))
    return texts


def test_template_groups_equal_brute_force(spark):
    texts = template_texts(random.Random(4), 250)
    want = sorted(brute(list(enumerate(texts))))
    assert 190 < len(want) < 230
    assert sorted(r["doc_id"] for r in near_copies.first_of_classes(documents(spark, texts), block=20).collect()) == want


def test_template_groups_are_split(spark):
    """Letters of one template meet their near copies alone, whatever the size of the group; copies of one text stay whole."""
    for n in (500, 2_000):
        texts = template_texts(random.Random(4), n)
        sets = [near_copies.shingle_set(t).view("int64").tolist() for t in texts]
        left = spark.createDataFrame([(1, i, i, n) for i in range(n)], "key long, node long, root long, size long")
        split = near_copies._split_groups(left, spark.createDataFrame(list(enumerate(sets)), "node long, shingles array<long>"), 0.8, 50).collect()
        assert max(r["size"] for r in split) <= 3 and all(r["key"]["shingle"] is not None for r in split)
        together = {}
        for r in split:
            together.setdefault(r["key"]["shingle"], set()).add(r["node"])
        met = {frozenset(x) for x in together.values()}
        assert all(any({i - 1, i} <= x for x in met) for i in range(5, n, 5))
    same = spark.createDataFrame([(i, [*range(50), 1_000 + i]) for i in range(200)], "node long, shingles array<long>")
    left = spark.createDataFrame([(1, i, i, 200) for i in range(200)] + [(2, i, i, 30) for i in range(30)], "key long, node long, root long, size long")
    split = near_copies._split_groups(left, same, 0.8, 50).collect()
    assert len(split) == 230 and all(r["key"]["shingle"] is None for r in split)


def edited_texts(rng, n):
    """Copies of one lost text, each with words replaced, up to a fifth of them; one in ten is edited once more."""
    base, texts = [f"w{rng.randrange(10_000)}" for _ in range(120)], []
    for _ in range(n):
        words = list(base)
        for at in rng.sample(range(120), min(24, 1 + int(rng.expovariate(0.25)))):
            words[at] = f"x{rng.randrange(10_000)}"
        texts.append(" ".join(words))
        if rng.random() < 0.1:
            words[rng.randrange(120)] = "again"
            texts.append(" ".join(words))
    return texts


def test_large_groups_grow_with_their_size(spark, monkeypatch):
    """Rows that meet in groups grow with the copies, not with their square, and no link is lost."""
    met, dealt = [], near_copies._links_in_groups

    def counted(left, sets, similarity, block):
        met[-1] += left.agg(F.sum(F.ceil(F.col("size") / block))).first()[0] or 0
        return dealt(left, sets, similarity, block)

    monkeypatch.setattr(near_copies, "_links_in_groups", counted)
    for n in (200, 800):
        texts = edited_texts(random.Random(6), n)
        met.append(0)
        want = sorted(brute(list(enumerate(texts))))
        assert 0.1 * n < len(want) < 0.9 * n
        assert sorted(r["doc_id"] for r in near_copies.first_of_classes(documents(spark, texts), block=40).collect()) == want
    assert met[1] <= 6 * max(met[0], 200), met
