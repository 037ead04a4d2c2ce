import io
import zipfile

from pyspark.sql import functions as F

from shutterlake.operators import archive


def joined(parts, group="g"):
    found = {}
    for r in parts.orderBy(group, "at").collect():
        have = found.setdefault(r[group], bytearray())
        assert r["at"] == len(have)
        have += r["data"]
    return {k: zipfile.ZipFile(io.BytesIO(v)) for k, v in found.items()}


def test_archives(spark):
    rows = [(1, "a.png", b"x", 1), (1, "a.png", b"y", 2), (1, "b", b"z", 3), (1, "b", None, 4), (2, "é/ü.png", b"v" * 1000, 5)]
    df = spark.createDataFrame([(g, n, c and bytearray(c), o) for g, n, c, o in rows], "g long, name string, content binary, ord int")
    for files in (archive.BUCKET_FILES, 1):
        out = joined(archive.parts(archive.unique_names(df, "g", "name", "ord"), "g", bucket_files=files))
        assert {n: out[1].read(n) for n in out[1].namelist()} == {"a.png": b"x", "a (2).png": b"y", "b": b"z", "b (2)": b""}
        assert out[2].namelist() == ["é/ü.png"] and out[2].testzip() is None
    assert archive.parts(df.limit(0), "g").count() == 0


def test_ten_thousand_files_in_one_archive(spark, tmp_path):
    files = spark.range(10_000).selectExpr("'all' as g", "concat('f', id, '.bin') as name", "cast(repeat(cast(id as string), 20) as binary) as content")
    saved = archive.save(archive.parts(files, "g", bucket_files=700), "g", str(tmp_path)).collect()
    assert [r["path"] for r in saved] == [f"{tmp_path}/all.zip"] and [p.name for p in tmp_path.iterdir()] == ["all.zip"]
    with zipfile.ZipFile(tmp_path / "all.zip") as z:
        assert len(z.namelist()) == 10_000 and z.testzip() is None and z.read("f123.bin") == b"123" * 20


def test_many_entries_and_far_places(spark):
    wide = spark.createDataFrame([(70_000, 5 << 30, 4_000_000)], "n long, start long, size long").select(archive._end_record("n", "start", "size").alias("e")).first()["e"]
    assert bytes(wide[:4]) == b"PK\6\6" and len(wide) == 56 + 20 + 22
    far = spark.createDataFrame([("x", 5, 1, 6 << 30)], "n string, s long, c long, a long").select(archive._directory_entry("n", "s", "c", "a").alias("e")).first()["e"]
    assert len(far) == 46 + 1 + 12 and int.from_bytes(far[-8:], "little") == 6 << 30


def test_downloads(spark):
    rows = [(1, "done", "a", "a_clean", b"x"), (1, "failed", "b", None, None), (2, "done", "c", None, b"y"), (2, "done", "d", None, b"z"), (3, "pending", "e", None, None)]
    df = spark.createDataFrame([(*r[:4], r[4] and bytearray(r[4])) for r in rows], "g int, status string, name string, output_name string, content binary")
    assert {r["g"]: (r["n"], r["name"]) for r in archive.downloads(df, "g", F.lit("all.zip")).collect()} == {1: (1, "a_clean"), 2: (2, "all.zip"), 3: (0, None)}


def test_files_stand_by_name_in_an_archive_of_many_buckets(spark):
    """places are those of the names' order, whatever the number of buckets."""
    files = spark.range(5000).selectExpr("cast(id % 2 as string) as g", "concat('é', id, '.bin') as name", "cast(repeat('x', cast(id % 7 as int)) as binary) as content")
    found = archive.parts(files, "g", bucket_files=300).where(F.substring("data", 1, 4) == F.lit(b"PK\3\4")).collect()
    assert len(archive._bounds(files, "g", "name", 300)["0"]) > 3
    for g in ("0", "1"):
        at = 0
        mine = sorted((f"é{i}.bin", i % 7) for i in range(5000) if str(i % 2) == g)
        for (name, size), r in zip(mine, sorted((r for r in found if r["g"] == g), key=lambda r: r["at"]), strict=True):
            assert r["at"] == at and bytes(r["data"])[30:].startswith(name.encode())
            at += 30 + len(name.encode()) + size
