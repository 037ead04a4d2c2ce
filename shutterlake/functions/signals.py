"""Signs of an image generator in texts, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Any one of these proves a generator.
STRONG = [
    r"(?i)Negative prompt:",
    r"\bSteps:\s*\d+",
    r"(?i)\bSampler:\s*\S",
    r"(?i)\bCFG scale:\s*[\d.]",
    r'"class_type"\s*:',
    r'(?i)"sui_image_params"',
    r'(?i)"invokeai_metadata"|"positive_prompt"\s*:',
    r'(?i)"sd-metadata"|"model_weights"\s*:',
    r'(?i)"fooocus[_ ]scheme"|"base_model"\s*:',
    r"(?i)\bnovelai\b",
    r"(?i)\bstable\s*diffusion\b",
    r"(?i)\bcomfyui\b",
    r"(?i)\bautomatic1111\b",
    r"(?i)\bmidjourney\b",
    r"(?i)\bdall[\s.-]?e\b",
    r"(?i)\badobe\s+firefly\b",
    r"(?i)trainedAlgorithmicMedia",
    r"(?i)<lora:[^:>]+:",
]
#: Two of these do.
WEAK = [
    r"(?i)--(?:v|ar|stylize|niji)\s+\S",
    r'(?i)"seed"\s*:\s*\d',
    r'(?i)"scheduler"\s*:',
    r"(?i)\bDenoising strength:",
    r"(?i)\bModel hash:",
    r"(?i)\bClip skip:",
]
#: Text keys that only generators write.
KEYS = ["parameters", "prompt", "workflow", "negative_prompt", "sd-metadata", "invokeai_metadata", "invokeai_graph", "invokeai_workflow", "fooocus_scheme", "comfy", "aiinfo", "generation_data", "sui_image_params", "extras"]
#: Generators by what signed or wrote the file; the first that matches counts.
SIGNERS = [
    ("adobe-firefly", r"(?i)firefly|adobe\s+express|adobe\s+photoshop\s+\(generative"),
    ("openai", r"(?i)openai|dall[\s.-]?e|gpt[\s-]?image|chatgpt"),
    ("google-imagen", r"(?i)imagen|synthid|google\s+(?:ai|deepmind|gemini)|pixel\s+studio"),
    ("midjourney", r"(?i)midjourney"),
    ("flux", r"(?i)\bflux\b|black\s*forest\s*labs"),
    ("stable-diffusion", r"(?i)stability\s*ai|stable\s*diffusion|dreamstudio"),
    ("comfyui", r"(?i)comfy"),
    ("novelai", r"(?i)novelai"),
]


def has_signature(text: Column) -> Column:
    """Generator metadata rather than a caption, by the first 20,000 characters; false for null or under six."""
    head = F.substring(text, 1, 20000)
    strong = reduce(lambda a, b: a | b, (head.rlike(p) for p in STRONG))
    weak = reduce(lambda a, b: a + b, (head.rlike(p).cast("int") for p in WEAK))
    return F.coalesce((F.length(text) >= 6) & (strong | (weak >= 2)), F.lit(False))


def is_generator_key(key: Column) -> Column:
    return F.coalesce(F.lower(F.trim(key)).isin(KEYS), F.lit(False))


def by_provenance(source_type: Column, *signers: Column) -> Column:
    """(generator, confidence) from what signed the file and its declared source type; null without either."""
    joined = F.concat_ws(" ", *signers)
    named = F.coalesce(*(F.when(joined.rlike(p), g) for g, p in SIGNERS))
    declared = F.coalesce(F.lower(source_type).contains("algorithmicmedia"), F.lit(False))
    sure = F.when(declared, "confirmed").otherwise("likely")
    return F.when(named.isNotNull() | declared, F.struct(F.coalesce(named, F.lit("generic")).alias("generator"), sure.alias("confidence")))
