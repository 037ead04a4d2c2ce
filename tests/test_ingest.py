from pyspark.sql import functions as F

from shutterlake.streaming.ingest import gate, ingest

from .test_png import FILE


def test_each_file_once(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    for name, data in (("a.png", FILE), ("b.jpg", b""), ("c.bin", b"short")):
        (tmp_path / "in" / name).write_bytes(data)
    ingest(spark, source, out, mark).awaitTermination(60)
    (tmp_path / "in" / "d.jpg").write_bytes(b"\xff\xd8\xff\xe0" + bytes(20))
    ingest(spark, source, out, mark).awaitTermination(60)
    rows = {r["file_id"].rpartition("/")[2]: (r["format"], r["error"]) for r in spark.read.parquet(out).collect()}
    assert rows == {"a.png": ("png", None), "c.bin": (None, "corrupt-container"), "d.jpg": ("jpeg", None)}
    assert spark.read.parquet(out).count() == 3


def test_gate(spark):
    rows = spark.createDataFrame([(0,), (11,), (12,), (256 << 20,), ((256 << 20) + 1,)], "n long").select(gate(F.col("n")).alias("e")).collect()
    assert [r["e"] for r in rows] == ["empty-file", "corrupt-container", None, None, "too-large"]
