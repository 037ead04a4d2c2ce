"""Image generators behind one metadata text, on plain values.

Most generators write an object; each is a row of ``OBJECTS``: what tells it apart,
and under which keys its values lie. Node graphs, settings blocks and captions have
readers of their own. The first of ``READERS`` that knows a text counts.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from shutterlake.functions import graphs, plain, settings

FIELDS = ["prompt", "negative", "seed", "steps", "cfg", "sampler", "scheduler", "model", "checkpoint", "vae", "clip_skip", "size", "version"]
SHAPE = ["generator", "confidence", *FIELDS, "loras", "control_nets"]
LONG, SHORT = 8000, 2000
Finding = dict[str, object]
_FLAGGED = re.compile(r"(?i)--(?:v|version|ar|aspect|niji|stylize)\b")
_MINUS = re.compile(r"(?i)--no\s+((?:(?!\s--).)+)")


def _found(generator: str, confidence: str, loras: list[str] | None = None, nets: list[str] | None = None, **said: str | None) -> Finding:
    return dict.fromkeys(SHAPE) | {"generator": generator, "confidence": confidence, "loras": loras or [], "control_nets": nets or []} | {k: v or None for k, v in said.items()}


def _at(value: object, path: str) -> object:
    for step in path.split("."):
        value = value.get(step) if isinstance(value, dict) else None
    return value


def _scalar(value: object) -> str | None:
    """A string, number or truth value as text; blanks, lists and objects are none."""
    if isinstance(value, str):
        return value.strip() or None
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float) and math.isfinite(value):
        return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)
    return None


def _first(root: dict, paths: list[str]) -> str | None:
    return next(filter(None, (_scalar(_at(root, p)) for p in paths)), None)


def _names(listed: object, keys: tuple[str, ...]) -> list[str]:
    """Names in a list of strings, of [name, weight] pairs, or of objects by their first key that is there."""
    out = []
    for one in listed if isinstance(listed, list) else ():
        if isinstance(one, dict):
            one = next((one[k] for k in keys if isinstance(one.get(k), str)), None)
        elif isinstance(one, list):
            one = one[0] if one else None
        if isinstance(one, str) and one.strip() not in ("", "None"):
            out.append(one.strip())
    return out


def _size(root: dict, within: str) -> str | None:
    sides = [_at(root, within + k) for k in ("width", "height")]
    numeric = all(isinstance(s, (int, float)) and not isinstance(s, bool) for s in sides)
    return "x".join(_scalar(s) or "" for s in sides) if numeric else None


@dataclass(frozen=True)
class Schema:
    """An object format: its generator, what it must have, and where values lie."""

    generator: str
    holds: Callable[[dict, str | None], bool]
    places: dict[str, list[str]]
    within: str = ""
    loras: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    nets: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    texts: Callable[[dict], str | None] = lambda root: None

    def read(self, root: dict, key: str | None) -> Finding | None:
        if not self.holds(root, key):
            return None
        said = {name: _first(root, [self.within + p for p in paths]) for name, paths in self.places.items()}
        prompt = self.texts(root) or said.get("prompt")
        said |= {"prompt": plain.sanitized(prompt, LONG), "negative": plain.sanitized(said.get("negative"), LONG)}
        said["size"] = said.get("size") or _size(root, self.within)
        loras = [n for path, keys in self.loras for n in _names(_at(root, self.within + path), keys)]
        nets = next((found for path, keys in self.nets if (found := _names(_at(root, path), keys))), [])
        return _found(self.generator, "confirmed", list(dict.fromkeys(loras)), nets, **said)


def _model_of(path: str) -> list[str]:
    return [path, *(f"{path}.{n}" for n in ("model_name", "name", "key", "hash"))]


def _prompt_list(root: dict) -> str | None:
    listed = _at(root, "image.prompt")
    return ", ".join(p for one in listed if isinstance(p := one.get("prompt") if isinstance(one, dict) else one, str)) if isinstance(listed, list) else None


#: What tells the object formats apart, and the keys of their values.
OBJECTS = [
    Schema("novelai", lambda o, k: "uc" in o and ("sampler" in o or ("steps" in o and "scale" in o)), {"prompt": ["prompt", "v4_prompt"], "negative": ["uc"], "seed": ["seed"], "steps": ["steps"], "cfg": ["scale"], "sampler": ["sampler"], "scheduler": ["noise_schedule"], "model": ["request_type", "source"]}),
    Schema("fooocus", lambda o, k: "base_model" in o or "full_prompt" in o or "fooocus" in (_first(o, ["version"]) or "").lower() or k == "fooocus_scheme", {"prompt": ["prompt", "full_prompt"], "negative": ["negative_prompt", "full_negative_prompt"], "seed": ["seed"], "steps": ["steps"], "cfg": ["guidance_scale", "cfg_scale"], "sampler": ["sampler"], "scheduler": ["scheduler"], "model": ["base_model"], "checkpoint": ["refiner_model"], "vae": ["vae_name", "vae"], "size": ["resolution"], "version": ["version"]}, loras=[("loras", ("name", "model", "lora"))]),
    Schema("invokeai", lambda o, k: ("positive_prompt" in o or "negative_prompt" in o) and ("scheduler" in o or "model" in o or k == "invokeai_metadata"), {"prompt": ["positive_prompt"], "negative": ["negative_prompt"], "seed": ["seed"], "steps": ["steps"], "cfg": ["cfg_scale"], "scheduler": ["scheduler"], "model": _model_of("model"), "vae": _model_of("vae"), "clip_skip": ["clip_skip"]}, loras=[("loras", ("model", "lora", "name")), ("loras", ("lora_name",))], nets=[("controlnets", ("control_model", "model", "name")), ("control_layers", ("control_model", "model", "name"))]),
    Schema("invokeai", lambda o, k: "positive_prompt" not in o and "negative_prompt" not in o and isinstance(o.get("image"), dict), {"prompt": ["prompt"], "seed": ["seed"], "steps": ["steps"], "cfg": ["cfg_scale"], "sampler": ["sampler"]}, within="image.", texts=_prompt_list),
]
WRAPPED = Schema("stable-diffusion", lambda o, k: isinstance(o.get("sui_image_params"), dict), {"prompt": ["prompt"], "negative": ["negativeprompt", "negative_prompt"], "seed": ["seed"], "steps": ["steps"], "cfg": ["cfgscale"], "sampler": ["sampler"], "scheduler": ["scheduler"], "model": ["model"], "vae": ["vae"]}, within="sui_image_params.", loras=[("loras", ())])


def _graph(text: str, root: dict | None, key: str | None) -> Finding | None:
    found = graphs.read(text)
    if found is None:
        return None
    g = dict(zip(graphs.NAMES, found, strict=True))
    said = {n: g[n] for n in ("seed", "steps", "cfg", "sampler", "scheduler", "model", "vae", "size")}
    return _found("flux" if "flux" in (g["model"] or "").lower() else "comfyui", "confirmed", g["loras"], g["control_nets"], prompt=plain.sanitized(g["prompt"], LONG), negative=plain.sanitized(g["negative"], LONG), **said)


def _objects(text: str, root: dict | None, key: str | None) -> Finding | None:
    if root is None:
        return None
    found = next(filter(None, (schema.read(root, key) for schema in OBJECTS)), None)
    if found and found["generator"] == "invokeai" and found["model"] is None and isinstance(root.get("image"), dict):
        found["model"] = _first(root, ["model_weights"])
    return found


def _block(text: str, root: dict | None, key: str | None) -> Finding | None:
    b = settings.read(text)
    if b is None:
        return None
    p = lambda *keys: next((b["pairs"][k] for k in keys if k in b["pairs"]), None)
    said = {"seed": p("seed"), "steps": p("steps"), "cfg": p("cfg scale", "distilled cfg scale"), "sampler": p("sampler"), "scheduler": p("schedule type", "scheduler"), "model": p("model", "checkpoint"), "checkpoint": p("model hash", "checkpoint hash"), "vae": p("vae", "vae hash"), "clip_skip": p("clip skip"), "size": p("size"), "version": p("version")}
    return _found("flux" if b["flux"] else "automatic1111", "confirmed", b["loras"], b["control_nets"], prompt=plain.sanitized(b["prompt"], LONG), negative=plain.sanitized(b["negative"], LONG), **said)


def _flag(text: str, *names: str) -> str | None:
    found = re.search(rf"(?i)--(?:{'|'.join(names)})\s+([^\s-][^\s]*)", text)
    return found and found[1]


def _caption(text: str, root: dict | None, key: str | None) -> Finding | None:
    named = "midjourney" in text.lower()
    if len(text) > 4000 or not (named or _FLAGGED.search(text)):
        return None
    minus = _MINUS.search(text)
    return _found("midjourney", "confirmed" if named else "likely", prompt=re.split(r"\s--", text, maxsplit=1)[0].strip(" "), negative=minus and minus[1].strip(" "), seed=_flag(text, "seed"), size=_flag(text, "ar", "aspect"), version=_flag(text, "v", "version"))


def _wrapped(text: str, root: dict | None, key: str | None) -> Finding | None:
    return WRAPPED.read(root, key) if root is not None else None


def _unnamed(text: str, root: dict | None, key: str | None) -> Finding | None:
    return _found("generic", "likely", prompt=text[:SHORT].strip(" ")) if plain.signed(text) or plain.generator_key(key) else None


READERS = [_graph, _objects, _block, _caption, _wrapped, _unnamed]


def detect(text: str | None, key: str | None) -> Finding | None:
    """What the first reader that knows a text finds in it; a text that breaks a reader is not its own."""
    if not text:
        return None
    root = None
    if text.strip(" ").startswith("{"):
        try:
            parsed = json.loads(text)
            root = parsed if isinstance(parsed, dict) else None
        except (ValueError, RecursionError):
            pass
    return next(filter(None, (reader(text, root, key) for reader in READERS)), None)


def findings(sources: list[dict]) -> list[Finding]:
    """One of each (generator, prompt, seed) with the bytes of all; named generators suppress the unnamed one."""
    out: dict[tuple, Finding] = {}
    for s in sources:
        one = detect(s["text"], s["key"])
        if one is None:
            continue
        same = out.setdefault((one["generator"], one["prompt"], one["seed"]), one | {"source": s["origin"], "bytes": 0})
        same["bytes"] += s["bytes"]
    named = [f for f in out.values() if f["generator"] != "generic"]
    return named or list(out.values())
