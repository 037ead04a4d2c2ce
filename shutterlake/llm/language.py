"""Language identification by interpolated Kneser-Ney character models.

One model of order ORDER per language, over lower-cased letters with single
spaces between words. All n-grams of all languages share sorted hash arrays per
order: keys, and for each key the (language, value) entries that it has, so that
size grows with what the languages have and not with their product. A text goes
to the language of the lowest cross-entropy per character.

It is rejected where that lies over the language's limit for its length. The limit
is calibrated to a false-rejection rate of ``alpha``: training texts that the
counts never saw are cut into pieces of many lengths n; the excess of a piece over
its language's median, times the square root of n over the spread, has the limit at
its quantile 1 - alpha, over all languages together. Whole texts are as often over it as pieces of their length. The
score is the share of the winner among all languages and a "none of these" whose
cross-entropy is the limit, so it is under one half where a text is rejected.

Models are fitted on the ``per_language`` distinct texts of each language with the
smallest hashes (fewer, if the languages are so many that they would be over
``max_texts``), and of longer ones on ``max_chars`` characters from a place that
their hash gives, so that the model's size is bounded; whole texts of any length
are scored and every language that has a text is learned.

Nulls and edge cases: a null text, or one without a letter, is ``und`` with score 0
and is rejected; rows with a null language are never learned from; null doc_ids and
repeated rows stay; without any training text all is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.llm.common import crc_mod, group_starts, text_batches, texts_of

ORDER, UNKNOWN = 5, "und"
SLICE = 1 << 19  # bytes of text that are scored at once; their n-grams take over a hundred bytes each
BROADCAST_LANGUAGES = 10_000
_OTHER = re.compile(r"[\W\d_]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised texts, each with a space on both ends; their sizes."""
    clean = [" " + _OTHER.sub(" ", t.lower()).strip() + " " for t in texts]
    flat = np.frombuffer("".join(clean).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    return flat, np.array([len(c) for c in clean], np.int64)


def gram_hashes(codes: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """Hash of the n-gram that ends at each character, n from 1 to ``order``.

    Grams that would reach over a text's start are cut short there: they equal
    the longest gram that fits (a space opens every text).
    """
    first = np.repeat(group_starts(sizes), sizes)
    at = np.arange(len(codes))
    h = (codes + np.uint64(1)) * _STEP
    h ^= h >> np.uint64(29)
    out = [h]
    for n in range(1, order):
        longer = out[-1].copy()
        ok = at - n >= first
        prev = h[np.maximum(at - n, 0)]
        mixed = (out[-1] * np.uint64(0xBF58476D1CE4E5B9) + prev) ^ (prev >> np.uint64(7))
        longer[ok] = mixed[ok]
        out.append(longer)
    return out


@dataclass
class Entries:
    """Sorted keys; the entries of key i are ``first[i]`` to ``first[i + 1]``."""

    keys: np.ndarray
    first: np.ndarray
    language: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple[np.ndarray, np.ndarray]]) -> Entries:
        """From the keys and values of each language."""
        key = np.concatenate([k for k, _ in parts])
        language = np.repeat(np.arange(len(parts)), [len(k) for k, _ in parts]).astype(np.int32)
        order = np.lexsort((language, key))
        keys, first = np.unique(key[order], return_index=True)
        return cls(keys, np.append(first, len(key)), language[order], np.concatenate([v for _, v in parts])[order].astype(np.float32))

    def rows(self, keys: np.ndarray, out: np.ndarray) -> np.ndarray:
        """``out`` (keys, languages) with the values that there are."""
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == keys)
            lo, n = self.first[at[hit]], self.first[at[hit] + 1] - self.first[at[hit]]
            entry = np.repeat(lo - group_starts(n), n) + np.arange(int(n.sum()))
            out[np.repeat(hit, n), self.language[entry]] = self.value[entry]
        return out


@dataclass
class CharModels:
    """Per order the grams' discounted probabilities and the contexts' back-off weights."""

    languages: list[str]
    alphabet: int = 1
    alpha: list[Entries] = field(default_factory=list)
    weight: list[Entries] = field(default_factory=list)
    middle: np.ndarray | None = None  # each language's median cross-entropy and spread per character
    spread: np.ndarray | None = None
    limit: float = np.inf  # in spreads
    sharpness: float = 20.0

    def chances(self, grams: list[np.ndarray], where: np.ndarray) -> np.ndarray:
        """Interpolated probability of the character at each place, per language."""
        shape = len(where), len(self.languages)
        p = np.full(shape, 1 / self.alphabet, np.float32)
        for n in range(ORDER):
            context = grams[n - 1][where - 1] if n else np.zeros(len(where), np.uint64)
            p *= self.weight[n].rows(context, np.ones(shape, np.float32))
            p += self.alpha[n].rows(grams[n][where], np.zeros(shape, np.float32))
        return p

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(characters, languages) in nats, without each text's opening space; the number of characters scored."""
        codes, sizes = codes_of(texts)
        grams = gram_hashes(codes, sizes, ORDER)
        scored = np.ones(len(codes), bool)
        scored[group_starts(sizes)] = False
        first, inverse = np.unique(grams[-1][scored], return_index=True, return_inverse=True)[1:]
        where = np.flatnonzero(scored)[first]
        step = max(1, 4_000_000 // max(1, len(self.languages)))
        cost = [-np.log(self.chances(grams, where[lo : lo + step])) for lo in range(0, len(where), step)]
        return np.concatenate(cost).astype(np.float64)[inverse] if cost else np.zeros((0, len(self.languages))), sizes - 1

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) in nats a character; the number of characters scored."""
        cost, n = self.costs(texts)
        return np.add.reduceat(cost, group_starts(n), axis=0) / n[:, None] if len(n) else np.zeros((0, len(self.languages))), n

    def limits(self, language: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The highest cross-entropy that a text of n characters may have."""
        return self.middle[language] + self.limit * self.spread[language] / np.sqrt(n)

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text."""
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        some = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))] if self.languages else []
        if some:
            x, n = self.cross_entropy([texts[i] for i in some])
            best = x.argmin(axis=1)
            low = x[np.arange(len(some)), best]
            most = self.limits(best, n)
            odds = np.exp(-self.sharpness * np.clip(x - low[:, None], 0, 30)).sum(axis=1) + np.exp(-self.sharpness * np.clip(most - low, -30, 30))
            for k, i in enumerate(some):
                out[i] = (self.languages[best[k]], float(1 / odds[k]), bool(low[k] > most[k]))
        return out


def _calibrate(models: CharModels, held: list[list[str]], alpha: float, pieces: tuple[int, ...] = (8, 16, 32, 64, 128, 256, 512, 1024)) -> None:
    """Middle and spread of each language from its held texts' pieces; the limit from those of all languages."""
    models.middle, models.spread, models.limit = np.zeros(len(held)), np.ones(len(held)), np.inf
    pooled: list[list[np.ndarray]] = [[] for _ in range(len(pieces) + 1)]
    for k, texts in enumerate(held):
        own = [t for t in texts if any(map(str.isalpha, t))]
        if not own:
            models.middle[k] = np.inf
            continue
        cost, n = models.costs(own)
        cost, starts = cost[:, k], group_starts(n)
        sums = np.concatenate([[0.0], np.cumsum(cost)])
        means = (sums[starts + n] - sums[starts]) / n
        models.middle[k] = middle = float(np.median(means))
        excess = []
        for size in pieces:
            at = np.concatenate([s + np.arange(0, c - size + 1, size) for s, c in zip(starts, n, strict=True)])
            excess.append(((sums[at + size] - sums[at]) / size - middle) * np.sqrt(size))
        excess.append((means - middle) * np.sqrt(n))
        lower, upper = np.quantile(excess[0] if len(excess[0]) else excess[-1], [0.25, 0.75])
        models.spread[k] = max(1e-3, (upper - lower) / 1.349)
        for x, e in zip(pooled, excess, strict=True):
            x.append(e / models.spread[k])
    # the size that needs most counts; a size must have enough pieces for this quantile
    tails = [float(np.quantile(e, 1 - alpha)) for x in pooled if x and len(e := np.concatenate(x)) * alpha >= 1]
    if any(pooled):
        models.limit = max([4.0, *tails])


def fit(texts_by_language: dict[str, list[str]], alpha: float = 0.001) -> CharModels:
    """Every eighth text calibrates the rejection limit, the others are counted."""
    names = sorted(texts_by_language)
    models = CharModels(names)
    counted, held = [], []
    for name in names:
        texts = sorted(texts_by_language[name])
        held.append(texts[::8] if len(texts) >= 16 else texts)
        counted.append([t for i, t in enumerate(texts) if i % 8] if len(texts) >= 16 else texts)
    tables: list[list[tuple]] = [[] for _ in range(ORDER)]
    letters = set()
    for texts in counted:
        codes, sizes = codes_of(texts)
        letters.update(np.unique(codes).tolist())
        grams = gram_hashes(codes, sizes, ORDER)
        use = np.ones(len(codes), bool)
        use[group_starts(sizes)] = False
        at, left = np.flatnonzero(use), None  # left: distinct characters in front of each shorter gram
        for n in range(ORDER - 1, -1, -1):
            context = grams[n - 1][at - 1] if n else np.zeros(len(at), np.uint64)
            key, index, count = np.unique(grams[n][at], return_index=True, return_counts=True)
            if left is not None:  # lower orders count the distinct grams they continue
                count = np.bincount(np.searchsorted(key, left), minlength=len(key))
            left = grams[n - 1][at[index]] if n else None
            tables[n].append((key[count > 0], count[count > 0].astype(np.float64), context[index][count > 0]))
    models.alphabet = len(letters) + 1
    for n in range(ORDER):
        alphas, weights = [], []
        for key, count, context in tables[n]:
            one, two = (count == 1).sum(), (count == 2).sum()
            discount = one / (one + 2 * two) if one and two else 0.5
            owner, at = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(at, weights=count), np.bincount(at)
            alphas.append((key, (count - discount) / total[at]))
            weights.append((owner, discount * kinds / total))
        models.alpha.append(Entries.of(alphas))
        models.weight.append(Entries.of(weights))
    _calibrate(models, held, alpha)
    return models


def train(docs: DataFrame, usable: Column, lang_col: str = "lang", per_language: int = 300, max_chars: int = 8_000, max_texts: int = 60_000, alpha: float = 0.001) -> CharModels:
    known = docs.where(usable & F.col(lang_col).isNotNull() & F.col("text").isNotNull())
    known = known.select(F.col(lang_col).cast("string").alias("_lang"), F.xxhash64("text").alias("_h"), F.col("text").alias("_text"))
    counts = known.groupBy("_lang").agg(F.approx_count_distinct("_h").alias("_n"))
    few = counts.limit(BROADCAST_LANGUAGES + 1).collect()
    if not few:
        return CharModels([])
    if len(few) <= BROADCAST_LANGUAGES:  # checked: one small row for each language
        counts = F.broadcast(docs.sparkSession.createDataFrame(few, "_lang string, _n long"))
    languages = len(few) if len(few) <= BROADCAST_LANGUAGES else counts.count()
    each = max(1, min(per_language, max_texts // languages))
    # a threshold on the hash takes about twice as many texts, the rank cuts them to `each`
    share = counts.select("_lang", (F.lit(float(1 << 40)) * F.least(F.lit(1.0), F.lit(2.0 * each + 20) / F.greatest("_n", F.lit(1)))).alias("_most"))
    place = 1 + F.pmod(F.xxhash64(F.lit(3), "_text"), F.greatest(F.lit(1), F.length("_text") - max_chars + 1)).cast("int")
    some = known.join(share, "_lang").where(F.pmod("_h", F.lit(1 << 40)) < F.col("_most")).select("_lang", "_h", F.substring("_text", place, F.lit(max_chars)).alias("_text"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.pmod("_h", F.lit(1 << 40)), "_h"))
    got = some.dropDuplicates(["_lang", "_h"]).withColumn("_rank", rank).where(F.col("_rank") <= each).select("_lang", "_text").toArrow()
    by: dict[str, list[str]] = {}
    for lang, text in zip(got["_lang"].to_pylist(), got["_text"].to_pylist(), strict=True):
        by.setdefault(lang, []).append(text)
    return fit(by, alpha)


_FOUND = "doc_id long, lang_pred string, score double, rejected boolean"


def identify(docs: DataFrame, models: CharModels) -> DataFrame:
    """doc_id, lang_pred, score, rejected: one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_batches(batches, SLICE):
            rows = models.predict(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], names=["doc_id", "lang_pred", "score", "rejected"])

    return texts_of(docs).mapInArrow(run, _FOUND)


def keep_identified(docs: DataFrame, models: CharModels) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, all columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([pa.nulls(len(batch)), pc.fill_null(batch.column("text"), "")], names=["id", "text"])
            keep = [not r[2] for _, some in text_batches([texts], SLICE) for r in models.predict(some)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def language_id(docs: DataFrame, folds: int = 4, held_out: int = 2, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; the held-out fold is never learned from."""
    models = train(docs, crc_mod(F.col("doc_id"), folds) != held_out, **options)
    return identify(docs, models).withColumn("held_out", crc_mod(F.col("doc_id"), folds) == held_out)
