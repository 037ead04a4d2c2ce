"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (with word borders) in hashed
buckets; one of over LONG characters, as in scripts without spaces, counts as
several, its pieces, which overlap so that each of its n-grams is in one. The
mean of the words' mean vectors goes into a linear softmax, and embeddings and
softmax are trained jointly in numpy, so an unseen misspelling shares the vectors
of the n-grams it kept. The mean is taken over windows of WINDOW words, as a few
toxic words would vanish in the mean of a long text. N-grams in fewer than ``least`` texts are left out. Training goes in rounds: each takes of every text the window that
the model of the round before scores highest (the first one goes by the words'
log-odds between the classes), and of clean texts a random one too. A softmax of
a mean of linear vectors is a mean of word scores, which is how whole texts are
scored: in one pass, with a bounded cache of words.

The final score pools a text's word scores: its highest window, the means of its
highest one, three and eight words, and the logarithm of its length, as long texts
have higher maxima by chance. The weights of these are learned by logistic
regression on every sixth labelled row, which the embeddings never saw, with the
classes as frequent as they are in all labels, and a missed toxic text counted as
``MISS_COST`` false alarms.

The model is fitted on at most ``per_class`` labelled rows of each class, chosen
by a hash of the id, and of each on at most ``max_chars`` characters (a window at
a place given by the text's hash); class counts cover all labels.

Nulls and edge cases: a null or empty text scores the share of label 1; null
labels and ids without a document are left out; a doc_id labelled more than once
is learned once per pair, equal texts once; without both classes the score is the
share of label 1 (0.5 without labels); null doc_ids and repeated rows stay; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import crc_mod, text_batches, texts_of

LONG, PIECE, OVERLAP = 60, 64, 5
WINDOW = 2
_SIGNS = " \t\r\n!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”…"


def words_of(text: str) -> list[str | bytes]:
    """Words in lower case; a long one as pieces in bytes, with borders at its own ends only."""
    words = text.lower().split()
    if not words or len(max(words, key=len)) <= LONG:
        return words
    out: list[str | bytes] = []
    for word in words:
        if len(word) > LONG and len(bare := word.strip(_SIGNS)) > LONG:
            w = f"<{bare}>".encode("utf-8", "replace")
            out += [w[k : k + PIECE] for k in range(0, len(w) - OVERLAP, PIECE - OVERLAP)]
        else:
            out.append(word)
    return out


def buckets_of(word: str | bytes, buckets: int) -> list[int]:
    if isinstance(word, bytes):
        w = word
    else:
        word = word.strip(_SIGNS)
        if not word:
            return []
        w = f"<{word}>".encode("utf-8", "replace")
    grams = {w[i : i + n] for n in (3, 4, 5, 6) for i in range(max(1, len(w) - n + 1))}
    grams.update(w[:n] for n in (7, 8, 9))  # stems
    grams.add(w)
    return [zlib.crc32(g) % buckets for g in grams]


def windows(scores: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Mean score of each window of words (one window, if there are fewer words)."""
    width = min(width, len(scores))
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    return (sums[width:] - sums[:-width]) / width


#: Words whose mean scores are pooled besides the windows': the highest one, three and eight.
TOPS = (1, 3, 8)
#: How many false alarms a missed toxic text counts for where the final weights are learned.
MISS_COST = 3


def pooled(scores: np.ndarray) -> np.ndarray:
    """A text's words as a few numbers: its highest window, the means of its highest words, and its length."""
    top = np.sort(np.partition(scores, -TOPS[-1])[-TOPS[-1] :] if len(scores) > TOPS[-1] else scores)[::-1]
    return np.array([windows(scores).max(), *(top[:k].mean() for k in TOPS), np.log(len(scores))])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Weights and bias of a weighted, lightly penalised logistic regression, by Newton's method."""
    mid, wide = np.average(x, axis=0, weights=weight), x.std(axis=0)
    wide = np.where(wide > 0, wide, 1.0)
    z = np.c_[(x - mid) / wide, np.ones(len(x))]
    w, few = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], 0.1), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + np.r_[few[:-1] * w[:-1], 0.0]
        hess = (z * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ z + np.diag(few)
        w -= np.clip(np.linalg.solve(hess, grad), -2, 2)
    slopes = w[:-1] / wide
    return slopes, float(w[-1] - slopes @ mid)


class SubwordModel:
    def __init__(self, buckets: int, dim: int = 8, scale: float = 20.0, least: int = 10, seed: int = 13):
        rng = np.random.default_rng(seed)
        self.buckets, self.scale, self.least = buckets, scale, least
        self.vectors = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
        self.softmax = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)

    def fit(self, labels: np.ndarray, texts: list[np.ndarray], grams: list[np.ndarray], rounds: int = 6, epochs: int = 6, batch: int = 64, rate: float = 0.1, decay: float = 1e-4) -> None:
        """``texts`` are word numbers, ``grams`` each word's buckets. Adagrad on class-balanced batches of windows."""
        rng = np.random.default_rng(29)
        by = [np.flatnonzero(labels == k) for k in (0, 1)]
        if not all(map(len, by)):
            return
        seen_in = [np.bincount(np.concatenate([np.unique(texts[i]) for i in k]), minlength=len(grams)) for k in by]
        scores = np.log((seen_in[1] + 0.5) / len(by[1])) - np.log((seen_in[0] + 0.5) / len(by[0]))
        docs = np.zeros(self.buckets, np.int64)
        for words in texts:
            docs[np.unique(np.concatenate([grams[w] for w in np.unique(words)]))] += 1
        few = docs < 1 + min(self.least - 1, len(texts) // 60)
        self.vectors[few] = 0  # n-grams of too few texts say nothing
        grams = [g[~few[g]] for g in grams]
        seen_v = np.full(self.vectors.shape, 1e-6, np.float32)
        seen_w, seen_b = np.full(self.softmax.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)
        for _ in range(rounds):
            chosen = [[], []]
            for i, words in enumerate(texts):
                means = windows(scores[words], WINDOW)
                width = min(WINDOW, len(words))
                places = [int(np.argmax(means))] + [int(rng.integers(len(means)))] * int(labels[i] == 0)
                chosen[labels[i]] += [words[lo : lo + width] for lo in places]
            for _ in range(epochs * max(1, 2 * min(map(len, by)) // batch)):
                some = [chosen[k][i] for k in (0, 1) for i in rng.integers(len(chosen[k]), size=batch // 2)]
                self._step(np.repeat([0, 1], batch // 2), some, grams, seen_v, seen_w, seen_b, rate, decay)
            scores = self.word_scores(grams)

    def _step(self, labels, some, grams, seen_v, seen_w, seen_b, rate: float, decay: float) -> None:
        own = [[grams[w] for w in words] for words in some]
        idx = np.concatenate([g for words in own for g in words])
        sizes = np.array([sum(map(len, words)) for words in own], np.int64)
        val = np.concatenate([np.full(len(g), self.scale / (len(words) * max(1, len(g))), np.float32) for words in own for g in words])
        mean = np.stack([np.bincount(np.repeat(np.arange(len(some)), sizes), weights=self.vectors[idx, k] * val, minlength=len(some)) for k in range(self.vectors.shape[1])], axis=1)
        logit = mean @ self.softmax + self.bias
        g = np.exp(logit - logit.max(axis=1, keepdims=True))
        g /= g.sum(axis=1, keepdims=True)
        g[np.arange(len(some)), labels] -= 1
        g /= len(some)
        d_softmax, d_mean, d_bias = mean.T @ g, g @ self.softmax.T, g.sum(axis=0)
        touched, inverse = np.unique(idx, return_inverse=True)
        d_vec = np.stack([np.bincount(inverse, weights=val * np.repeat(d_mean[:, k], sizes), minlength=len(touched)) for k in range(d_mean.shape[1])], axis=1)
        d_vec += decay * self.vectors[touched]
        for arr, seen, grad, at in ((self.vectors, seen_v, d_vec, touched), (self.softmax, seen_w, d_softmax, slice(None)), (self.bias, seen_b, d_bias, slice(None))):
            seen[at] += grad.astype(np.float32) ** 2
            arr[at] -= rate * grad.astype(np.float32) / np.sqrt(seen[at])

    def word_scores(self, grams: list[np.ndarray]) -> np.ndarray:
        scores = self.bucket_scores()
        return np.array([scores[g].mean() if len(g) else 0.0 for g in grams])

    def bucket_scores(self) -> np.ndarray:
        return (self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0]) * self.scale).astype(np.float32)


class WordScores(dict):
    """Bounded cache: a word's mean bucket score."""

    def __init__(self, scores: np.ndarray):
        super().__init__()
        self.scores, self.buckets = scores.tolist(), len(scores)

    def __missing__(self, word: str | bytes) -> float:
        own = buckets_of(word, self.buckets)
        s = sum(map(self.scores.__getitem__, own)) / len(own) if own else 0.0
        if len(self) < 300_000:
            self[word] = s
        return s


def train(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "toxic", per_class: int = 1500, buckets: int = 1 << 18, max_chars: int = 20_000) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Bucket scores, weights, bias and the share of label 1. ``usable`` marks the label rows to learn from."""
    known = labels.where(usable & F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    share = (n1 + 0.5) / (n0 + n1 + 1)
    some = F.col("label") == 0, F.col("label") == 1
    order = F.xxhash64("doc_id"), "doc_id"
    picked = known.where(some[0]).orderBy(*order).limit(per_class).unionByName(known.where(some[1]).orderBy(*order).limit(per_class))
    # at most 2 * per_class ids are broadcast; a repeated id brings each of its texts once
    text = F.substring("text", 1 + F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.length("text") - max_chars)).cast("int"), F.lit(max_chars))
    chosen = texts_of(docs).join(F.broadcast(picked), "doc_id").select("label", F.xxhash64("doc_id", "text").alias("h"), text.alias("text")).dropDuplicates(["label", "h"])
    order = "h", "text"
    got = chosen.where(some[0]).orderBy(*order).limit(per_class).unionByName(chosen.where(some[1]).orderBy(*order).limit(per_class)).toArrow()
    nothing = np.zeros(buckets, np.float32), np.zeros(2 + len(TOPS)), float(np.log(share / (1 - share))), share
    if not n0 or not n1:
        return nothing
    numbers: dict[str | bytes, int] = {}
    rows = sorted(zip(got["label"].to_pylist(), got["h"].to_pylist(), got["text"].to_pylist(), strict=True))
    rows = [(y, np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)) for y, _, t in rows if (words := words_of(t))]
    grams = [np.array(buckets_of(w, buckets), np.int64) for w in numbers]
    y, held = np.array([r[0] for r in rows], np.int64), np.arange(len(rows)) % 6 == 0
    if min(np.bincount(y[held], minlength=2).min(), np.bincount(y[~held], minlength=2).min()) == 0:
        held[:] = False
    model = SubwordModel(buckets)
    model.fit(y[~held], [r[1] for r, h in zip(rows, held, strict=True) if not h], grams)
    if not held.any():
        held[:] = True
    scores = model.word_scores(grams)
    top = np.array([pooled(scores[r[1]]) for r, h in zip(rows, held, strict=True) if h])
    if len(np.unique(y[held])) < 2:
        return nothing
    weight = np.where(y[held] == 1, MISS_COST * n1 / (y[held] == 1).sum(), n0 / (y[held] == 0).sum()) * held.sum() / (n0 + n1)
    return model.bucket_scores(), *logistic(top, y[held], weight), share


def score(docs: DataFrame, scores: np.ndarray, weights: np.ndarray, bias: float, share: float) -> DataFrame:
    """doc_id, score: whole texts, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordScores(scores)
        for ids, texts in text_batches(batches):
            out = []
            for t in texts:
                words = words_of(t)
                if words:
                    x = float(pooled(np.fromiter(map(cache.__getitem__, words), np.float64, len(words))) @ weights) + bias
                    out.append(1 / (1 + np.exp(-min(50.0, max(-50.0, x)))))
                else:
                    out.append(share)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return texts_of(docs).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, **options) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of the held-out fold are never learned."""
    model = train(docs, labels, crc_mod(F.col("doc_id"), folds) != held_out, **options)
    return score(docs, *model).select("doc_id", (crc_mod(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
