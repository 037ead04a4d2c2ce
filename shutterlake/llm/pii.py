"""Personal data by weak supervision.

Base patterns give spans that always stay. Looser patterns give candidates on
which labelers vote: a strict pattern, a checker (Luhn, octets, digit counts),
gazetteers (top-level domains, card issuers, area and country codes), the words in
front, and the characters around. Expectation-maximisation over the counts of vote
patterns in the whole corpus estimates each labeler's reliability. A logistic span
classifier is then trained on the posteriors, with the votes, the span's silhouette
(its runs of digits, letters and signs) and the word in front as features, and
decides which candidates become spans; one that the votes alone leave open is
settled by how spans of its silhouette and in its context fare elsewhere. Votes
and features are numbers of a bounded range (PATTERNS in all), so counting them is
one small aggregation, and detection is a row-local second pass.

Nulls and edge cases: a null text is empty and has no spans; null doc_ids and
repeated rows stay; digits of other scripts don't count; very long runs are read
in linear time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import text_batches, texts_of

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "checker", "gazetteer", "context", "border")

#: Fixed patterns of the base spans (the address part in front of "@" is read backwards).
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Fixed patterns of the candidates; an address in words is read from its "at" in both directions.
_AT = re.compile(r"(?i)\s?[\[(]\s?at\s?[\])]\s?")
_AT_DOMAIN = re.compile(r"(?i)[a-z0-9-]+(?:(?:\.|\s\.\s|\s?[\[(]\s?dot\s?[\])]\s?)[a-z0-9-]+)+")
_LOOSE = (
    (3, re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])")),
    (2, re.compile(r"(?<![0-9])[0-9]{4}(?:[.\x20-][0-9]{4}){3}(?![0-9])")),
)
#: Fixed values of the gazetteers: generic and country domains in wide use, card issuers' first digits,
#: country calling codes, and the first digits of North American area codes.
_ENDINGS = frozenset(
    "com org net edu gov mil int info biz name pro app dev io ai me tv cc online site shop store blog cloud tech xyz"
    " ae ar at au be bg bo br ca ch cl cn co cr cu cy cz de dk do dz ec ee eg es eu fi fr ge gr gt hk hn hr hu id ie il in iq ir is it"
    " jm jo jp ke kr kw kz lb li lk lt lu lv ly ma md mk mt mx my ng ni nl no np nz pa pe ph pk pl pr pt py qa ro rs ru sa se sg si sk sv"
    " th tn tr tw ua ug uk us uy uz ve vn za".split()
)
_ISSUERS = re.compile(r"4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|3(?:0[0-5]|[689])|35(?:2[89]|[3-8])|6(?:011|4[4-9]|5|2)|50|5[6-8]|6[37]")
_COUNTRIES = re.compile(r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-6][0-9]|29[0-9]|35[0-9]|37[0-9]|38[0-9]|42[0-9]|50[0-9]|59[0-9]|67[0-9]|68[0-9]|85[0-9]|88[0-9]|96[0-9]|97[0-9]|99[0-9])")
_AREAS = re.compile(r"\(?[2-9][0-8][0-9]\)?[\x20.-]*[2-9][0-9]{2}")
_CUES = (
    frozenset("mail email e-mail contact write address reach".split()),
    frozenset("ip host server address from client login".split()),
    frozenset("card visa mastercard amex credit debit payment number".split()),
    frozenset("call phone tel telephone mobile cell fax contact number".split()),
)
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in the order of the contract."""
    out: list[tuple[int, int, int]] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", max(end, at + 1))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _votes(text: str, start: int, kind: int, end: int, strict: bool) -> tuple[int, ...]:
    """1 for, 0 against, 2 abstains; in the order of LABELERS. What the candidate's own pattern makes sure of is no vote."""
    span = text[start:end]
    digits = "".join(_DIGITS.findall(span))
    if kind == 0:
        last = re.split(r"[.\])\s]+", span)[-1].lower()
        check, gazetteer = 2, 1 if last in _ENDINGS else 0
    elif kind == 1:
        check, gazetteer = 2, 0 if digits.startswith("0") or span.startswith("127.") else 2
    elif kind == 2:
        check, gazetteer = int(luhn(digits)), 1 if _ISSUERS.match(digits) else 0
    else:
        check, gazetteer = 2 if 9 <= len(digits) <= 15 else 0, int(bool(_COUNTRIES.match(span) if span[0] == "+" else _AREAS.match(span)))
    before = re.findall(r"[A-Za-z-]+", text[max(0, start - 40) : start].lower())[-3:]
    context = 1 if _CUES[kind].intersection(before) else 2
    left, right = text[start - 1 : start], text[end : end + 1]
    border = 0 if left.isalnum() or right.isalnum() or left in ('"', "=") and left else 2
    return (1 if strict else 2, check, gazetteer, context, border)


SHAPES, WORDS = 16, 16
PATTERNS = 3 ** len(LABELERS) * len(KINDS) * SHAPES * WORDS
_RUNS = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")
_FRONT = re.compile(r"([A-Za-z]+)[^A-Za-z]*\Z")


def _features(text: str, start: int, end: int) -> tuple[int, int]:
    """Buckets of the whole span's silhouette and of the word that ends within 24 characters in front of it (0: none)."""
    runs = ("d" * min(4, len(r)) if r[0].isdigit() else "w" if r[0].isalpha() else r for r in _RUNS.findall(text[start:end]))
    word = _FRONT.search(text[max(0, start - 24) : start])
    return zlib.crc32("".join(runs).encode()) % SHAPES, 1 + zlib.crc32(word[1].lower().encode()) % (WORDS - 1) if word else 0


def _joined(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the sorted spans, overlapping ones as one."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in spans:
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def spelled_addresses(text: str) -> list[tuple[int, int]]:
    """(start, end) of addresses whose "@" is a bracketed word, of any length; linear, since no place is read twice."""
    out, end = [], 0
    for m in _AT.finditer(text) if "(" in text or "[" in text else ():
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        while start < m.start() and not text[start].isalnum():
            start += 1
        domain = _AT_DOMAIN.match(text, m.end()) if start < m.start() else None
        if domain and m.start() >= end:
            out.append((start, domain.end()))
            end = domain.end()
        else:
            end = max(end, m.start())
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, pattern) of base spans and of looser matches; a pattern is votes and features in one number."""
    found = [(s, k, e, True) for s, k, e in base]
    starts, ends = _joined([(s, e) for s, _, e in base])
    loose = [(s, 0, e) for s, e in spelled_addresses(text)] + [(m.start(), kind, m.end()) for kind, pattern in _LOOSE for m in pattern.finditer(text)]
    for s, kind, e in loose:
        at = bisect_right(starts, s) - 1
        if not (at >= 0 and ends[at] > s) and not (at + 1 < len(starts) and starts[at + 1] < e):
            found.append((s, kind, e, False))
    out = []
    for s, k, e, strict in found:
        number = 0
        for v in _votes(text, s, k, e, strict):
            number = number * 3 + v
        shape, word = _features(text, s, e)
        out.append((s, k, e, ((number * SHAPES + shape) * WORDS + word) * len(KINDS) + k))
    return out


class SpanModel:
    """EM over vote patterns, then a logistic span classifier on the posteriors."""

    def __init__(self, counts: dict[int, int], rounds: int = 50):
        self.reliability = np.full((len(KINDS), len(LABELERS), 2), 0.7)
        self.weights = np.zeros(len(KINDS) * (1 + 2 * len(LABELERS) + SHAPES + WORDS))
        self.known: dict[int, bool] = {}
        if not counts:
            return
        patterns, n = np.array(sorted(counts), np.int64), np.array([counts[p] for p in sorted(counts)], float)
        kind, votes = self._split(patterns)[:2]
        given, yes = votes < 2, votes == 1
        post = np.where(given, yes, 0).sum(axis=1) / np.maximum(1, given.sum(axis=1))
        for _ in range(rounds):
            prior = np.array([(1 + (n * post)[kind == k].sum()) / (2 + n[kind == k].sum()) for k in range(len(KINDS))])
            for k in range(len(KINDS)):
                own = kind == k
                for c, weight in ((0, n * (1 - post)), (1, n * post)):
                    w = (weight[:, None] * given)[own]
                    agree = (w * (yes[own] == c)).sum(axis=0)
                    trust = 10 + 0.5 * w.sum(axis=0)  # labelers are held near 0.8, lest two of them swap the classes
                    self.reliability[k, :, c] = (agree + 0.8 * trust) / (w.sum(axis=0) + trust)
            r = self.reliability[kind]
            for_yes = np.where(yes, r[:, :, 1], 1 - r[:, :, 1])
            for_no = np.where(yes, 1 - r[:, :, 0], r[:, :, 0])
            odds = np.log(prior[kind] / (1 - prior[kind])) + np.where(given, np.log(for_yes) - np.log(for_no), 0).sum(axis=1)
            post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        active = self._active(patterns)
        share, seen = n / n.sum(), np.full(len(self.weights), 1e-8)
        for _ in range(300):  # each row has the same number of active features
            p = 1 / (1 + np.exp(-self.weights[active].sum(axis=1)))
            grad = np.bincount(active.ravel(), np.repeat(share * (p - post), active.shape[1]), len(self.weights)) + 1e-5 * self.weights
            seen += grad**2
            self.weights -= 0.3 * grad / np.sqrt(seen)

    @staticmethod
    def _split(patterns: np.ndarray) -> tuple[np.ndarray, ...]:
        """kind, votes, shape, word."""
        kind, rest = patterns % len(KINDS), patterns // len(KINDS)
        word, rest = rest % WORDS, rest // WORDS
        shape, rest = rest % SHAPES, rest // SHAPES
        return kind, np.stack([rest // 3 ** (len(LABELERS) - 1 - k) % 3 for k in range(len(LABELERS))], axis=1), shape, word

    def _active(self, patterns: np.ndarray) -> np.ndarray:
        """Numbers of the active features: one bias, one per vote (an abstention is the bias again), silhouette and word."""
        kind, votes, shape, word = self._split(patterns)
        each = len(self.weights) // len(KINDS)
        cols = [np.zeros(len(kind), np.int64)]
        cols += [np.where(votes[:, k] < 2, 1 + 2 * k + votes[:, k], 0) for k in range(len(LABELERS))]
        cols += [1 + 2 * len(LABELERS) + shape, 1 + 2 * len(LABELERS) + SHAPES + word]
        return np.stack(cols, axis=1) + (kind * each)[:, None]

    def accepts(self, pattern: int) -> bool:
        if pattern not in self.known:
            self.known[pattern] = bool(self.weights[self._active(np.array([pattern]))].sum() >= 0)
        return self.known[pattern]

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """(base spans, all spans)."""
        base = base_spans(text)
        kept = set(base)
        return base, sorted(kept | {(s, k, e) for s, k, e, p in candidates(text, base) if self.accepts(p)})


def train(docs: DataFrame) -> SpanModel:
    """One pass over the whole corpus; at most PATTERNS counts reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for _, texts in text_batches(batches):
            for t in texts:
                for c in candidates(t, base_spans(t)):
                    seen[c[3]] = seen.get(c[3], 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    rows = texts_of(docs).mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return SpanModel({r["pattern"]: r["n"] for r in rows})


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_spans(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans."""
    model = model or train(docs)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_batches(batches):
            found = [model.spans(t) for t in texts]
            counts = [pa.array([sum(s[1] == k for s in b) for b, _ in found], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *counts, pa.array([hashlib.sha256(digest(b).encode()).hexdigest() for b, _ in found]), pa.array([digest(a) for _, a in found])], names=names)

    return texts_of(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span (overlapping ones as one) becomes its kind in angle brackets."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of ``text`` replaced; other columns as they were, n_chars anew."""
    model = train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if t is None else redact(t, model.spans(t)[1]) for t in b["text"].to_pylist()]
            cols = {n: b[n] for n in b.schema.names} | {"text": pa.array(texts, b.schema.field("text").type)}
            if "n_chars" in cols:
                had = b["n_chars"].to_pylist()
                cols["n_chars"] = pa.array([h if t is None else len(t) for h, t in zip(had, texts, strict=True)], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
