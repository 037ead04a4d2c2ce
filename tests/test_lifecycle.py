import json

from shutterlake.streaming import lifecycle

SCHEMA = "file_id string, seq long, kind string, generation int, error string"


def run(spark, folder):
    events = spark.readStream.schema(SCHEMA).json(f"{folder}/in")
    query = lifecycle.lifecycle(events).writeStream.format("parquet").option("checkpointLocation", f"{folder}/mark").trigger(availableNow=True).outputMode("append").start(f"{folder}/out")
    query.awaitTermination(120)
    return {(r["file_id"], r["seq"]): (r["status"], r["generation"], r["attempts"]) for r in spark.read.parquet(f"{folder}/out").collect()}


def put(folder, name, rows):
    (folder / "in").mkdir(exist_ok=True)
    (folder / "in" / name).write_text("\n".join(json.dumps(dict(zip(("file_id", "seq", "kind", "generation", "error"), r))) for r in rows))


def test_retry_over_restarts(spark, tmp_path):
    put(tmp_path, "1.json", [("a", 1, "add", None, None), ("a", 2, "analyzed", 0, None), ("a", 3, "started", 0, None), ("b", 1, "add", None, None), ("b", 2, "started", 0, None), (None, 1, "add", None, None)])
    first = run(spark, tmp_path)
    assert first == {("a", 1): ("pending", 0, 0), ("a", 2): ("pending", 0, 0), ("a", 3): ("processing", 0, 1), ("b", 1): ("pending", 0, 0)}
    # a new query goes on from the checkpoint; the file fails and is taken again
    put(tmp_path, "2.json", [("a", 5, "retry", None, None), ("a", 4, "failed", 0, "corrupt-container"), ("a", 6, "cleaned", 0, None), ("b", 3, "cancel", None, None), ("b", 4, "analyzed", 0, None)])
    second = run(spark, tmp_path)
    assert {k: v for k, v in second.items() if k not in first} == {("a", 4): ("failed", 0, 1), ("a", 5): ("pending", 1, 1), ("b", 3): ("cancelled", 1, 0)}
    states = spark.read.parquet(str(tmp_path / "out"))
    assert [(r["file_id"], r["next"]) for r in lifecycle.waiting(states).collect()] == [("a", "clean")]
    put(tmp_path, "3.json", [("a", 7, "started", 1, None), ("a", 8, "cleaned", 0, None), ("a", 9, "cleaned", 1, None), ("a", 9, "cleaned", 1, None), ("b", 5, "retry", None, None), ("b", 6, "remove", None, None), ("b", 7, "add", None, None)])
    third = run(spark, tmp_path)
    assert {k: v for k, v in third.items() if k not in second} == {("a", 7): ("processing", 1, 2), ("a", 9): ("done", 1, 2), ("b", 5): ("pending", 2, 0), ("b", 6): ("absent", 3, 0), ("b", 7): ("pending", 3, 0)}
