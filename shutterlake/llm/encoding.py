"""Token ids of whole texts from a public tokenizer file.

The ids are those of the ``tokenizers`` library for the same file. White space
can never lie inside a merge of these vocabularies except in front of a word,
so a text is cut at spaces, and each piece is looked up in a bounded cache;
what the cache lacks is merged once. Anything unusual (special-token strings,
rare scripts, control characters, very long pieces) goes to ``tokenizers``
itself.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import regex
import tiktoken
from tokenizers import Tokenizer

#: Pre-tokenisation patterns of the two public vocabularies (fixed values).
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""

_PLAIN = re.compile(r"[\n\t\r\x20-\x7e¡-ɏ]*\Z")
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LAST = "\u024f"
_LONG = 400
_WORD_END = b"\xff"  # never a byte of UTF-8


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class TextEncoder:
    """``encode(text)`` gives ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cache_entries: int = 300_000):
        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.words = spec["model"].get("end_of_word_suffix") == "</w>"
        to_byte, ranks = _byte_of_char(), {}
        for token, i in spec["model"]["vocab"].items():
            if token in self.specials:
                continue
            ends = self.words and token.endswith("</w>")
            raw = bytes(to_byte[c] for c in (token[:-4] if ends else token))
            ranks[raw + _WORD_END if ends else raw] = i
        self.merge = tiktoken.Encoding(
            "merges", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={}
        )._core_bpe.encode_single_piece
        self.pattern = regex.compile(WORD_PATTERN if self.words else BYTE_PATTERN)
        self.cache: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}  # signs after a word; as a part of its own a tail has other ids
        self.entries = cache_entries

    def _whole(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _pieces(self, text: str) -> bytes:
        if not _PLAIN.match(text):
            return self._whole(text)
        if self.words:
            text = unicodedata.normalize("NFC", text).lower()
        ids: list[int] = []
        for piece in self.pattern.findall(text):
            if len(piece) > _LONG:
                ids += self.whole.encode(piece, add_special_tokens=False).ids
            else:
                raw = piece.encode()
                ids += self.merge(raw + _WORD_END if self.words else raw)
        return array("I", ids).tobytes()

    def _piece(self, part: str) -> bytes:
        """Ids of one piece between spaces: mostly letters with a tail of signs."""
        core = part.rstrip(_SIGNS)
        if not core.isalpha() or len(core) > 40 or not (core.isascii() or max(core) <= _LAST and len(core.lower().encode()) == len(core.encode())):
            return self._pieces(part if self.words or part[:1] == "\n" else " " + part)
        ids = self.cache.get(core)
        if ids is None:
            raw = core.lower().encode() + _WORD_END if self.words else b" " + core.encode()
            ids = array("I", self.merge(raw)).tobytes()
            if len(self.cache) < self.entries:
                self.cache[core] = ids
        if len(core) == len(part):
            return ids
        tail = part[len(core) :]
        end = self.tails.get(tail)
        if end is None:
            end = self._pieces(tail)
            if len(tail) < 12 and len(self.tails) < self.entries:
                self.tails[tail] = end
        ids += end
        if len(self.cache) < self.entries:
            self.cache[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if "<|" in text and any(s in text for s in self.specials):
            return self._whole(text)
        if self.words:
            parts = text.replace("\n", " ").split(" ")
            head = b""
        else:
            if "  " in text or "\n\n" in text or " \n" in text or text[-1:] == " ":
                return self._pieces(text)
            first, *parts = text.replace("\n", " \n").split(" ")
            head = self._pieces(first)
        got = list(map(self.cache.get, parts))
        if None in got:
            for i, ids in enumerate(got):
                if ids is None:
                    got[i] = self._piece(parts[i])
        return head + b"".join(got)


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder per Python worker and file."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]
