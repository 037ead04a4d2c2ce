"""License scans: blocks of text that hold enough of a license notice's words.

Exact set-similarity join between blocks of all documents and notice templates.

1. Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased.
   A block is a window of ``WINDOW`` words at every ``STRIDE`` words, so that any
   ``STRIDE`` consecutive words lie whole in one block; a shorter text is one block.
2. A first pass counts, over every block of every document, how many blocks hold
   each template word. Words are ordered by this count, rarest first. Words of no
   template can't be part of an overlap, so blocks are cut to template words.
3. A template of n words needs an overlap of o = ceil(threshold * n), a short one
   (under ``SHORT`` words) of all its words, since there one word can make another
   license; variants of a license family share a label for the same reason. Prefix
   filter: its n - o + 1 rarest words can't all be missing, so these alone are
   looked up, and likewise the block's own. Length filter: the block keeps o words
   at least. Positional filter: behind the first common word both sides must have
   enough words left. What remains is counted exactly.

Base phrases (``PHRASES``) are found as consecutive words, each place.

Nulls and edge cases: a null text is empty and has no words; repeated words of a
block count once; equal texts, equal results; rows are kept one for one, with
repeated or null ids; further columns are ignored; an empty table gives an empty
result. Templates are a bounded parameter (``MOST_TEMPLATES``, checked) and go to
every task; one text is held by one task.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import text_batches, texts_of

WINDOW, STRIDE, THRESHOLD, MOST_TEMPLATES = 64, 32, 0.8, 10_000
#: Under so many words a template has to be there whole: one word can tell short licenses apart.
SHORT = 10
#: Phrases and the labels that they prove.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices and the labels that they give; each has at most STRIDE words.
TEMPLATES = [
    ("notice:all-rights-reserved", "All rights reserved. No part of this work may be reproduced without prior written permission of the publisher"),
    ("notice:apache", "Licensed under the Apache License, Version 2.0"),
    ("notice:apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("notice:bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("notice:bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("notice:creative-commons", "Licensed under CC BY 4.0"),
    ("notice:creative-commons", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("notice:creative-commons", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("notice:gnu", "This work is licensed under the GNU General Public License, version 3"),
    ("notice:gnu", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("notice:isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("notice:mit", "Released under the MIT License"),
    ("notice:mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("notice:mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("notice:unlicense", "This is free and unencumbered software released into the public domain"),
]
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str) -> list[bytes]:
    """Words as UTF-8, with A-Z (and no other letter) lower-cased."""
    return _WORD.findall(text.encode("utf-8", "replace").lower())


def window_starts(n: int) -> range:
    """Where the blocks of a text of n words start; none for a text without words."""
    return range(0, max(n - STRIDE, 1), STRIDE) if n else range(0)


def least_overlap(n: int, threshold: float) -> int:
    """Words of a template of n words that a block has to hold; the product is kept from rounding up."""
    return n if n < SHORT else max(1, math.ceil(threshold * n - 1e-9))


class Notices:
    """Templates over words in the global order, and the index of their rarest words."""

    def __init__(self, templates: Sequence[tuple[str, str]], threshold: float, held: dict[bytes, int] | None = None):
        if len(templates) > MOST_TEMPLATES:
            raise ValueError(f"more than {MOST_TEMPLATES} templates")
        self.labels = [label for label, _ in templates]
        sets = [frozenset(words_of(text)) for _, text in templates]
        every = sorted(set().union(*sets), key=lambda w: ((held or {}).get(w, 0), w)) if sets else []
        #: word to rank, from 1 for the rarest; 0 stands for all other words
        self.rank = {w: i for i, w in enumerate(every, 1)}
        self.sorted = [sorted(self.rank[w] for w in s) for s in sets]
        self.least = [least_overlap(len(s), threshold) for s in sets]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for t, (ranks, o) in enumerate(zip(self.sorted, self.least, strict=True)):
            for place, r in enumerate(ranks[: len(ranks) - o + 1]):
                self.index.setdefault(r, []).append((t, place))
        self.sets = [frozenset(s) for s in self.sorted]
        self.probed = np.zeros(len(every) + 1, bool)
        self.probed[list(self.index)] = True

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.rank.get, words, repeat(0)), np.int32, len(words))

    def matches(self, ids: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(template, first word, word behind, containment) of each block that meets the threshold."""
        hits = np.flatnonzero(self.probed[ids])
        if not len(hits):
            return
        n, last = len(ids), len(window_starts(len(ids))) - 1
        near = np.unique(np.r_[np.minimum(hits // STRIDE, last), np.maximum(hits // STRIDE - 1, 0)])
        for start in (near[near <= last] * STRIDE).tolist():
            stop = min(start + WINDOW, n)
            block = np.unique(ids[start:stop])
            block = block[block > 0].tolist()
            tried = set()
            for at, r in enumerate(block):
                for t, place in self.index.get(r, ()):
                    o = self.least[t]
                    # the block's own prefix, its length, and what is left behind the first common word
                    if t in tried or at > len(block) - o:
                        continue
                    tried.add(t)
                    if min(len(self.sorted[t]) - place, len(block) - at) < o:
                        continue
                    common = len(self.sets[t].intersection(block))
                    if common >= o:
                        yield t, start, stop, common / len(self.sorted[t])


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place of every base phrase."""
    out = []
    for phrase, label in PHRASES.items():
        parts = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(parts[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(parts)] == parts:
                out.append((at, label))
    return sorted(out)


_FOUND = "doc_id long, n_words long, base array<struct<word:long,label:string>>, notices array<struct<label:string,template:int,first_word:long,end_word:long,containment:double>>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("base", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))), ("notices", pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("containment", pa.float64())])))])


def block_counts(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> dict[bytes, int]:
    """In how many blocks of all documents each template word is; one row per such word reaches the driver."""
    known = Notices(templates, 1.0)
    names = list(known.rank)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for _, texts in text_batches(batches):
            for text in texts:
                ids = known.ids(words_of(text))
                if ids.any():
                    at = np.flatnonzero(ids)
                    # word i is in block i // STRIDE and the one before, as far as there are such blocks
                    last = len(window_starts(len(ids))) - 1
                    pairs = np.r_[np.minimum(at // STRIDE, last) * (len(names) + 1) + ids[at], np.minimum(np.maximum(at // STRIDE - 1, 0), last) * (len(names) + 1) + ids[at]]
                    ranks, n = np.unique(np.unique(pairs) % (len(names) + 1), return_counts=True)
                    seen.update(dict(zip(ranks.tolist(), n.tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    rows = texts_of(docs).mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {names[r["word"] - 1]: r["n"] for r in rows}


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, base (places of phrases) and notices (blocks that hold a template), one row per row of ``docs``."""
    notices = Notices(templates, threshold, block_counts(docs, templates))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_batches(batches):
            rows = []
            for doc, text in zip(ids, texts, strict=True):
                words = words_of(text)
                base = [{"word": at, "label": label} for at, label in phrase_places(words)]
                found = [dict(zip(("label", "template", "first_word", "end_word", "containment"), (notices.labels[t], t, a, b, c), strict=True)) for t, a, b, c in notices.matches(notices.ids(words))]
                rows.append((doc, len(words), base, found))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

    return texts_of(docs).mapInArrow(run, _FOUND)


def digest(found: DataFrame) -> DataFrame:
    """Counts, labels and score of a scan: a base phrase scores 1, else the largest containment."""
    places, notices = F.col("base"), F.col("notices")
    names = lambda *lists: F.array_join(F.array_sort(F.array_distinct(F.concat(*lists))), ",")
    base_names = F.transform(places, lambda x: x["label"])
    best = F.coalesce(F.array_max(F.transform(notices, lambda x: x["containment"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(F.transform(places, lambda x: x["word"])).alias("first_word"),
        F.array_max(F.transform(places, lambda x: x["word"])).alias("last_word"),
        names(base_names).alias("base_labels"),
        names(base_names, F.transform(notices, lambda x: x["label"])).alias("labels"),
        F.when(F.size(places) > 0, 1.0).otherwise(best).alias("score"),
    )
