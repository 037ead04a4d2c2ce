import numpy as np
from pyspark.sql import functions as F

from shutterlake.llm.common import crc_mod, table
from shutterlake.llm.language import ORDER, codes_of, fit, gram_hashes, keep_identified, language_id, train
from shutterlake.llm import queries
from shutterlake.llm.toxicity import buckets_of, logistic, pooled, score, toxicity, windows, words_of

from .fixtures import awkward, documents, empty

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    found = language_id(docs).join(docs, "doc_id").where("held_out")
    right = found.where("lang = lang_pred").count() / found.count()
    assert right > 0.97
    assert found.where("score < 0 or score > 1").count() == 0
    assert found.where("rejected").count() <= 0.01 * found.count()


def test_kneser_ney_sums_to_one():
    m = fit({"a": ["abab abba baab"] * 3, "b": ["xyz zyx", "abc"]})
    for context in ("abab a", "b", "zy", "qqq", "xyz z"):
        total = np.zeros(2)
        for c in "abcxyz" + "q":  # q stands for every unseen letter
            codes, sizes = codes_of([context + c])
            total += m.chances(gram_hashes(codes, sizes, ORDER), np.array([len(context) + 1]))[0]
        codes, sizes = codes_of([context])
        total += m.chances(gram_hashes(codes, sizes, ORDER), np.array([len(context) + 1]))[0]  # the closing space
        assert np.abs(total - 1).max() < 1e-5


def test_rejection_is_calibrated(spark):
    """Held-out texts are rejected at about the stated rate; random letters are rejected with a low score."""
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    rejected = language_id(docs).where("held_out").select(F.avg(F.col("rejected").cast("int"))).first()[0]
    assert rejected < 0.005
    models = train(docs, crc_mod(F.col("doc_id"), 4) != 2)
    rng = np.random.default_rng(2)
    junk = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 300)) for _ in range(20)]
    assert all(r[2] and r[1] < 0.5 for r in models.predict(junk))


def test_every_language_and_long_texts_are_learned(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}zyx {chr(97 + i % 26)}qqq " * 3, f"l{i}") for i in range(300)]
    rows += [(None, "kolme neljä viisi " * 2000, "long"), (None, "kolme neljä viisi " * 2000, "long"), (7, None, "none"), (8, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = train(docs, F.lit(True))
    assert len(models.languages) == 301 and models.predict(["neljä viisi kolme"])[0][0] == "long"
    assert len(train(docs, F.lit(True), max_texts=5).languages) == 301
    same = [train(docs.repartition(n), F.lit(True), per_language=1, max_chars=50) for n in (1, 5)]
    assert same[0].languages == same[1].languages and all((a.value == b.value).all() for a, b in zip(same[0].alpha, same[1].alpha, strict=True))


def test_rejection_and_awkward(spark):
    docs = table(spark, SF, "documents")
    models = train(docs, crc_mod(F.col("doc_id"), 4) != 2)
    assert models.predict(["", "123 !!", "日本語の文章です。これは長い"])[:2] == [("und", 0.0, True)] * 2
    assert models.predict(["日本語の文章です。これは長い"])[0][2]
    rows = language_id(awkward(spark)).collect()
    assert len(rows) == 8 and {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2)} == {"und"}
    assert language_id(empty(spark)).collect() == []
    assert keep_identified(awkward(spark), models).columns == awkward(spark).columns


def test_misspelling_shares_buckets():
    a, b, c = (set(buckets_of(w, 1 << 16)) for w in ("disgusting", "disgustin", "yellow"))
    assert len(a & b) > 10 and len(a & c) < 2


def test_windows_and_logistic():
    assert windows(np.array([1.0, 3, 5]), 2).tolist() == [2, 4] and windows(np.array([1.0]), 2).tolist() == [1]
    x = np.linspace(-3, 5, 400)
    weights, bias = logistic(np.c_[x, np.full(400, 7.0)], (x > 1).astype(float), np.ones(400))
    assert weights[0] > 2 and abs((bias + 7 * weights[1]) / weights[0] + 1) < 0.2
    rng = np.random.default_rng(1)
    for n in (1, 2, 8, 9, 50):
        s = rng.normal(size=n)
        assert np.allclose(pooled(s), [windows(s).max(), *(np.sort(s)[::-1][:k].mean() for k in (1, 3, 8)), np.log(n)])


def test_long_tokens_are_read_to_their_end(spark):
    word = "".join(chr(0x4E00 + k * 37 % 5000) for k in range(700)) + "_disgusting."
    w = f"<{word.rstrip('.')}>".encode()
    for n in (3, 4, 5, 6):
        assert {w[i : i + n] for i in range(len(w) - n + 1)} <= {p[i : i + n] for p in words_of(word) for i in range(len(p))}
    assert set(buckets_of("disgusting", 1 << 16)) & {b for w in words_of("x" * 200 + "_disgusting") for b in buckets_of(w, 1 << 16)}
    assert words_of("A" * 60 + " b...") == ["a" * 60, "b..."] and words_of("." * 99) == ["." * 99]
    scores = np.zeros(1 << 16, np.float32)
    scores[buckets_of("disgusting", 1 << 16)] = 50
    texts = ["文" * 300, "文" * 300 + "disgusting", "one-" * 40 + "disgusting"]
    found = {r["doc_id"]: r["score"] for r in score(documents(spark, texts), scores, np.array([1.0, 0, 0, 0, 0]), -1.0, 0.1).collect()}
    assert found[0] < found[1] and found[0] < found[2]


def test_toxicity_held_out(spark):
    """The registered query on the whole table."""
    sf = "/root/testdata/sf0.1"
    found = queries.op10_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").select("toxic", "predicted").collect()
    count = {(t, p): sum(r["toxic"] == t and r["predicted"] == p for r in found) for t in (0, 1) for p in (0, 1)}
    print(count)
    assert count[1, 1] >= 0.88 * (count[1, 0] + count[1, 1])
    assert count[0, 1] <= 0.01 * (count[0, 0] + count[0, 1])


def test_toxicity_awkward(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 1), (3, 0, 1), (4, 1, None), (None, 1, 1), (99, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity(awkward(spark), labels).collect()
    assert len(rows) == 8 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert toxicity(empty(spark), labels).collect() == []
    assert toxicity(awkward(spark), labels.where("false")).count() == 8
