"""The settings block under a prompt: ``Key: value`` pairs on its last line."""

from __future__ import annotations

import re

#: A line with two of these keys is a settings line.
KNOWN = frozenset(["steps", "sampler", "cfg scale", "seed", "size", "model", "model hash", "scheduler", "denoising strength", "clip skip", "version", "guidance", "distilled cfg scale"])
_NEGATIVE = "Negative prompt:"
# a quoted run (to the end if it is not closed), an opening, a closing, a comma, or other text
_PIECE = re.compile(r"""("(?:[^"]|(?<=\\)")*(?:"|\Z)|'(?:[^']|(?<=\\)')*(?:'|\Z))|([\[({])|([\])}])|(,)|[^"'\[({\])},]+""")


def split(line: str) -> list[str]:
    """Parts between commas outside quotes and brackets."""
    parts, depth = [""], 0
    for m in _PIECE.finditer(line):
        depth = max(0, depth + bool(m[2]) - bool(m[3]))
        if m[4] and not depth:
            parts.append("")
        else:
            parts[-1] += m[0]
    return [p.strip() for p in parts]


def pairs(line: str) -> dict[str, str]:
    """Values by lower-case key; the last of a key counts, outer quotes go."""
    found = {}
    for part in split(line):
        key, colon, value = part.partition(":")
        value = value.strip()
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        if colon and key.strip() and value:
            found[key.strip().lower()] = value
    return found


def _settings_line(text: str | None) -> tuple[int | None, dict | None]:
    lines = (text or "").replace("\r\n", "\n").strip(" \t\n\x0b\f\r").split("\n")
    for at in range(len(lines) - 1, -1, -1):
        found = pairs(lines[at]) if ":" in lines[at] else {}
        if len(KNOWN & found.keys()) >= 2:
            return at, found
    return None, None


_NETS = re.compile(r"(?i)model:\s*([^,]+)")
_TAGS = re.compile(r"<lora:([^:>]+)")


def read(text: str) -> dict | None:
    """prompt, negative, pairs, loras, control_nets and flux of a settings block; null without a settings line or a negative prompt."""
    text = text.replace("\r\n", "\n").strip(" \t\n\x0b\f\r")
    lines = text.split("\n")
    at, found = _settings_line(text)
    minus = next((i for i, line in enumerate(lines) if line.lstrip(" ").startswith(_NEGATIVE)), None)
    if not text or (at is None and minus is None):
        return None
    p = found or {}
    prompt = "\n".join(lines[: minus if minus is not None else at]).strip(" ")
    behind = "" if minus is None else "\n".join(lines[minus : at if at is not None and at > minus else len(lines)]).strip(" ")
    hashes = p.get("lora hashes", p.get("loras")) or ""
    listed = [n for n in (x.split(":", 1)[0].strip() for x in hashes.split(",")) if n]
    nets = [(m[1] if (m := _NETS.search(v)) else v).strip() for k, v in p.items() if k.startswith("controlnet")]
    named = " ".join(filter(None, (p.get("model"), p.get("module 1"), text[:400]))).lower()
    return {"prompt": prompt, "negative": behind[len(_NEGATIVE) :].strip(" "), "pairs": p, "loras": list(dict.fromkeys([*listed, *(t.strip() for t in _TAGS.findall(prompt))])), "control_nets": list(dict.fromkeys(nets)), "flux": "flux" in named}
