import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from shutterlake.llm import language, pii
from shutterlake.llm.common import crc_mod, table
from shutterlake.llm.decontaminate import _WORD, WINDOW

from .test_near_copies import brute as first_of_classes
from .test_packing import best_fit, check_layout

SF = "/root/testdata/sf0.001"


def contaminated(text, items):
    """Whether some window of an item agrees in enough words, on every alignment of the whole text."""
    words = np.array([zlib.crc32(w.encode()) for w in _WORD.findall(text.lower())], np.int64)
    for own in items:
        need = min(WINDOW, len(own))
        for shift in range(need - len(own), len(words) - need + 1):
            lo, hi = max(0, -shift), min(len(own), len(words) - shift)
            same = np.concatenate([[0], np.cumsum(own[lo:hi] == words[lo + shift : hi + shift])])
            if len(same) > need and (same[need:] - same[:-need] >= 0.8 * need).any():
                return True
    return False


def test_run_against_brute_force(spark):
    """Each stage on all rows that the one before kept, long ones too, down to the tokens of every piece."""
    source = table(spark, SF, "documents")
    models = language.train(source, crc_mod(F.col("doc_id"), 4) != 2)
    docs = sorted((r["doc_id"], r["text"]) for r in source.collect())
    docs = [(i, t) for i, t in docs if not models.predict([t])[0][2]]
    stay = first_of_classes(docs)
    docs = [(i, t) for i, t in docs if i in stay]
    items = [np.array([zlib.crc32(w.encode()) for w in _WORD.findall(r["text"].lower())], np.int64) for r in table(spark, SF, "benchmark").collect()]
    near = set(np.concatenate(items).tolist())
    maybe = lambda t: sum(zlib.crc32(w.encode()) in near for w in set(_WORD.findall(t.lower()))) >= 3
    docs = [(i, t) for i, t in docs if not (maybe(t) and contaminated(t, items))]
    assert len(docs) > 100
    spans = pii.SpanModel({k: sum(1 for _, t in docs for c in pii.candidates(t, pii.base_spans(t)) if c[3] == k) for k in {c[3] for _, t in docs for c in pii.candidates(t, pii.base_spans(t))}})
    clean = {i: pii.redact(t, spans.spans(t)[1]) for i, t in docs}
    assert any("<email>" in t for t in clean.values()) and not any(re.search(r"[a-z]@[a-z]+\.", t) for t in clean.values())

    rows = corpus_pipeline.run(spark, SF).collect()
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r)
    assert set(got) == set(clean)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in clean.items():
        ids, at = [*tok.encode(t, add_special_tokens=False).ids, 0], 0
        for r in sorted(got[i], key=lambda r: r["piece"]):
            assert (r["start"], r["ids_crc32"]) == (at, zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes()))
            at += r["length"]
        assert at == len(ids)
    assert check_layout(rows, 2048) == len(best_fit([r["length"] for r in rows], 2048))


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_clashing_and_odd_columns_come_through(spark):
    """Columns named like the stages' own, and maps, stay as they were; rows that differ in them alone are one class still."""
    text = "a text of several words that is there twice in this table"
    rows = [(1, text, 1, 7, 8, {"k": "v"}), (2, text, 2, 7, 8, {"k": "w"}), (3, "another text altogether with other words in it", 3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row_key long, _H1 long, _h2 long, meta map<string,string>")
    assert sorted(tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [rows[0], rows[2]]
    assert sorted(tuple(r) for r in corpus_pipeline.drop_contaminated(spark, docs, SF).collect()) == rows
