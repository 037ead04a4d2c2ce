import json

from shutterlake.functions import settings
from shutterlake.operators import generators

BLOCK = 'a cat <lora:detail_slider:0.6>\nNegative prompt: blurry,\nlow\nSteps: 32, Sampler: DPM++ 2M, CFG scale: 7.5, Seed: 284819251, Size: 768x1152, Model: real, Lora hashes: "film: a1, detail_slider: b2", Version: v1.6'
API = {"3": {"class_type": "KSampler", "inputs": {"seed": 5, "steps": 25, "cfg": 8.0, "sampler_name": "euler", "positive": ["9", 0], "negative": ["7", 0]}}, "9": {"class_type": "ControlNetApply", "inputs": {"conditioning": ["6", 0], "control_net_name": "canny"}}, "6": {"class_type": "CLIPTextEncode", "inputs": {"text": "good"}}, "7": {"class_type": "CLIPTextEncode", "inputs": {"text": "bad"}}, "4": {"class_type": "CheckpointLoaderSimple", "inputs": {"ckpt_name": "sdxl"}}, "5": {"class_type": "EmptyLatentImage", "inputs": {"width": 1024, "height": 1024}}}
UI = {"nodes": [{"id": 1, "type": "CLIPTextEncode", "widgets_values": ["first"]}, {"id": 2, "type": "CLIPTextEncode", "widgets_values": ["second"]}, {"id": 3, "type": "KSampler", "widgets_values": [7, "fixed", 20, 6, "euler", "normal", 1]}, {"id": 4, "type": "UNETLoader", "widgets_values": ["flux1-dev"]}]}
CASES = {
    "block": ("parameters", BLOCK, ("automatic1111", "a cat <lora:detail_slider:0.6>", "blurry,\nlow", "284819251", "32", "7.5", "768x1152")),
    "api": ("prompt", json.dumps(API), ("comfyui", "good", "bad", "5", "25", "8", "1024x1024")),
    "ui": ("workflow", json.dumps(UI), ("flux", "first", "second", "7", "20", "6", None)),
    "novel": ("Comment", json.dumps({"prompt": "p", "uc": "n", "steps": 28, "scale": 5, "sampler": "k", "seed": 9, "width": 8, "height": 6}), ("novelai", "p", "n", "9", "28", "5", "8x6")),
    "fooo": ("x", json.dumps({"full_prompt": "p", "negative_prompt": "n", "base_model": "m", "seed": "9", "steps": 3, "guidance_scale": 4.5, "resolution": "(1, 2)", "loras": [["l", 0.5], "None"]}), ("fooocus", "p", "n", "9", "3", "4.5", "(1, 2)")),
    "inv": ("invokeai_metadata", json.dumps({"positive_prompt": "p", "negative_prompt": "n", "seed": 1, "steps": 2, "cfg_scale": 7, "model": {"name": "m"}, "width": 5, "height": 4}), ("invokeai", "p", "n", "1", "2", "7", "5x4")),
    "old": ("sd-metadata", json.dumps({"model_weights": "w", "image": {"prompt": [{"prompt": "a"}, "b"], "seed": 1, "steps": 2, "cfg_scale": 7, "width": 5, "height": 4}}), ("invokeai", "a, b", None, "1", "2", "7", "5x4")),
    "mid": ("Description", "a fox --ar 16:9 --v 6.1 --no text --seed 3", ("midjourney", "a fox", "text", "3", None, None, "16:9")),
    "swarm": ("parameters", json.dumps({"sui_image_params": {"prompt": "p", "negativeprompt": "n", "seed": 3, "steps": 4, "cfgscale": 5, "width": 2, "height": 1}}), ("stable-diffusion", "p", "n", "3", "4", "5", "2x1")),
    "gen": ("parameters", "some words", ("generic", "some words", None, None, None, None, None)),
    "plain": ("Description", '{"hello":"world"}', None),
    "null": (None, None, None),
    "broken": ("c", '{"nodes": [', None),
}


def test_detectors(spark):
    rows = [(k, 0, key, text, 10) for k, (key, text, _) in CASES.items()] + [("block", 1, "parameters", BLOCK, 5), ("block", 2, "extras", "other words", 3)]
    df = spark.createDataFrame(rows, "file_id string, ord int, key string, text string, bytes long")
    found = {r["file_id"]: r for r in generators.findings(df).collect()}
    got = {k: (r["generator"], r["prompt"], r["negative"], r["seed"], r["steps"], r["cfg"], r["size"]) for k, r in found.items()}
    assert got == {k: w for k, (_, _, w) in CASES.items() if w}
    assert found["block"]["bytes"] == 15 and found["block"]["loras"] == ["film", "detail_slider"]
    assert found["api"]["control_nets"] == ["canny"] and found["fooo"]["loras"] == ["l"] and found["inv"]["model"] == "m"


def test_settings_line():
    assert settings.split('a: 1, b: "x, y", c: {"m": [1, 2]}, d: (q, r)') == ["a: 1", 'b: "x, y"', 'c: {"m": [1, 2]}', "d: (q, r)"]
    assert settings.pairs("Seed: 1, seed: 2, : x, Empty:, n: 'q'") == {"seed": "2", "n": "q"}


def test_texts_are_read_once(spark):
    """F16: one Python step and one shuffle from texts to findings."""
    sources = spark.range(20).selectExpr("cast(id % 5 as string) as file_id", "cast(id as int) as ord", "'x' as key", "concat('a, b\\nSteps: 2, Sampler: E, Seed: ', id % 2) as text", "id as bytes")
    found = generators.findings(sources)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan and plan.count(" Exchange ") == 1
    assert {(r["file_id"], r["seed"], r["ord"], r["bytes"]) for r in found.collect()} == {(str(i % 5), str(i % 2), i, 2 * i + 10) for i in range(10)}
