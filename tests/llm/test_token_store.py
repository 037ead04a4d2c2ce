import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shutterlake.llm.common import table
from shutterlake.llm.encoding import TextEncoder
from shutterlake.llm.token_store import crc_of_ids, decode, decode_range, encode, ids_crc, read_tokens, write_tokens

from .fixtures import awkward, empty

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("top", [1, 2, 300, 49_408, 2**31, 2**60 - 1, 2**64 - 1])
@pytest.mark.parametrize("n", [0, 1, 59, 1023, 1024, 5000])
def test_round_trip(top, n):
    rng = random.Random(n)
    ids = np.array([rng.randint(0, rng.choice([0, 1, top])) for _ in range(n)], np.uint64)
    words, offsets = encode(ids)
    assert decode(words, offsets, n).tolist() == ids.tolist()
    assert offsets[-1] == len(words) and len(offsets) == -(-n // 1024) + 1
    k = len(offsets) // 2  # any block decodes alone
    if n:
        lo = min(k, len(offsets) - 2)
        part = ids[lo * 1024 : (lo + 1) * 1024]
        assert decode(words[offsets[lo] : offsets[lo + 1]], np.array([0, offsets[lo + 1] - offsets[lo]]), len(part)).tolist() == part.tolist()
        for a, b in ((0, 1), (n // 2, n), (n // 3, n // 3 + 1), (n, n)):
            assert decode_range(words, offsets, n, a, b).tolist() == ids[a:b].tolist()


def test_raw_words_that_look_like_escapes():
    rng = random.Random(6)
    for _ in range(200):
        ids = np.array([rng.choice([0, 7, 2**64 - 1, 15 << 60, (15 << 60) + 3, 2**60]) for _ in range(rng.randint(1, 60))], np.uint64)
        words, offsets = encode(ids, 8)
        assert decode(words, offsets, len(ids), 8).tolist() == ids.tolist()


def test_one_id_over_many_shards(spark):
    docs = spark.createDataFrame([(None, f"text number {i} " * 20) for i in range(400)] + [(5, "end")], "doc_id long, text string")
    files = write_tokens(docs, PATH, 2, shard_bytes=2000)
    assert files.where("doc_ids[0] is null").select("shard").distinct().count() > 8
    got = read_tokens(files).orderBy("start").collect()
    assert len(got) == 401 and [r["doc_id"] for r in got] == [None] * 400 + [5]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))


def test_small_ids_share_words():
    words, _ = encode(np.ones(1020, np.uint64))
    assert len(words) == 17


def test_against_tokenizers(spark):
    docs = table(spark, SF, "documents")
    got = {r["doc_id"]: r for r in crc_of_ids(read_tokens(write_tokens(docs, PATH, 2))).collect()}
    tok, start = Tokenizer.from_file(PATH), 0
    for d in sorted(docs.collect(), key=lambda d: d["doc_id"]):
        ids = [*tok.encode(d["text"], add_special_tokens=False).ids, 2]
        r = got[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), ids_crc(ids))
        start += len(ids)


def test_awkward_and_empty(spark):
    got = read_tokens(write_tokens(awkward(spark), PATH, 2, segment_ids=50)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 3, 4, 5, 6]
    assert [r["n_tokens"] for r in got[1:3]] == [1, 1]
    assert read_tokens(write_tokens(empty(spark), PATH, 2)).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_tokenizers(name):
    enc = TextEncoder(public_tokenizers.path(name), cache_entries=50)
    texts = ["", "  ", " a", "a ", "a\n\nb", "a\n\n\nb c", "a \n b", "\n", "x<|endoftext|>y z", "日本語 text", "ΑΣ ΣΑΣ", "İstanbul ß", "\x1cx y", "t\t\tx", "a\r\nb", "don't I'll", "x" * 5000, "ñandú é " * 99, "a\t b \n\tc", "1234 12.5%***", "é é"]
    for t in texts * 2:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == enc.whole.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_warm_cache_equals_tokenizers(name):
    """Ids don't depend on what the encoder saw before: short texts of words, signs, controls and NUL."""
    rng = random.Random(8)
    enc = TextEncoder(public_tokenizers.path(name))
    parts = ["a", "foo", "Bar", "été", "x1", "12", "'s", "日", "\0", "\1", "\x1f", "\x7f", "​", " ", "  ", "\n", "\t", *"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "!!", "...", "\0!!"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 8))) for _ in range(20_000)]
    for t, whole in zip(texts, enc.whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == whole.ids, repr(t)
