import duckdb

from shutterlake.operators import cleaning, report
from shutterlake.plans import catalog, inspect
from tests.test_heif import EXIF
from tests.test_heif_write import GONE, build

JPEG = bytes.fromhex("FFD8FFE000104A46494600010100000100010000FFFE00066e6f7465FFC0000B080040003001011100FFDA00021234FF005678FFD9".replace("FFFE00066e6f7465", "FFFE0006" + b"note".hex()))


def test_clean_each_by_its_format(spark):
    rows = [("jpg", JPEG), ("avif", build()), ("gif", b"GIF89a" + bytes(12)), ("small", b"\xff\xd8\xff"), ("empty", b""), ("none", None), ("odd", build(method=2)), ("what", bytes(40))]
    files = spark.createDataFrame([(k, None if c is None else bytearray(c), 1) for k, c in rows], "file_id string, content binary, format int")
    removed = GONE | {"comment"}
    out = cleaning.clean(files, removed).cache()
    got = {r["file_id"]: r for r in out.collect()}
    assert {k: r["error"] for k, r in got.items()} == {"jpg": None, "avif": None, "gif": "unsupported-format", "small": "corrupt-container", "empty": "empty-file", "none": "empty-file", "odd": "corrupt-container", "what": "unsupported-format"}
    assert bytes(got["jpg"]["content"]) == JPEG.replace(b"\xff\xfe\x00\x06note", b"")
    assert got["jpg"]["bytes_removed"] == 8 and abs(got["jpg"]["percent_reduction"] - 800 / len(JPEG)) < 1e-9
    assert got["gif"]["bytes_removed"] is None and got["gif"]["message"].startswith("GIF is not supported")
    assert got["odd"]["message"] == "Items stored inside other items (construction method 2) cannot be relocated. Try rebuild mode."
    rows = cleaning.verified(files, removed)
    seen = {(r["file_id"], r["category"]): (r["n_before"], r["bytes_after"]) for r in cleaning.by_category(rows).collect()}
    icc = ("avif", "icc"), (1, 19)
    assert seen == {("jpg", "comment"): (1, 0), ("avif", "exif"): (1, 0), ("avif", "xmp"): (1, 0), ("avif", "c2pa"): (1, 0), icc[0]: icc[1]}
    assert [(r["file_id"], len(r["remaining"])) for r in rows.where("remaining is not null").orderBy("file_id").collect()] == [("avif", 1), ("jpg", 0)]
    kept = cleaning.verified(files, frozenset(["xmp"])).where("remaining is not null").collect()
    assert sorted((r["file_id"], x["bytes"]) for r in kept for x in r["remaining"]) == [("avif", 19), ("avif", 30), ("avif", len(EXIF) + 21), ("jpg", 8)]


def test_clean_nothing(spark):
    none = spark.createDataFrame([], "file_id string, content binary")
    out = cleaning.clean(none, GONE)
    assert out.count() == 0 and cleaning.verified(none, GONE).count() == 0


def test_read_again_by_the_task_that_cleaned(spark):
    rows = [("jpg", JPEG), ("avif", build()), ("gif", b"GIF89a" + bytes(12)), ("small", b"\xff\xd8\xff"), ("empty", b""), ("none", None), ("odd", build(method=2))]
    files = spark.createDataFrame([(k, None if c is None else bytearray(c), i) for i, (k, c) in enumerate(rows)], "file_id string, content binary, place int")
    told = lambda r: sorted(map(repr, r.collect()))
    for removed in (GONE | {"comment"}, frozenset()):
        done, again = cleaning.clean(files, removed), cleaning.read_again(files, removed, "file_id string, place int")
        assert told(again.select("file_id", "content", "bytes_removed")) == told(done.select("file_id", "content", "bytes_removed"))
        assert told(report.of_bundles(again).drop("place")) == told(report.inspect(done.select("file_id", "content")))
        assert {(r["file_id"], r["place"]) for r in report.of_bundles(again, "place").collect()} == {(k, i) for i, (k, _) in enumerate(rows)}


def test_nested_rewrites_join_nothing(spark, tmp_path):
    """reports of a table's files are far larger than the table, and a join sent them to the driver; a key may be there twice."""
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    part.union(part.where("p_partkey < 3")).write.parquet(f"{tmp_path}/part.parquet")
    rows = inspect.nested_rewrites(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan and plan.count("MapInArrow") == 1
    part = duckdb.sql(f"SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")  # noqa: F841
    want = duckdb.sql(catalog.ORACLE_SQL["nested_rewrites"])
    assert sorted(map(repr, (tuple(r) for r in rows.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))
