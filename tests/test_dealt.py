"""Rows that files are made of are dealt over tasks by their number, and values that are read often are computed once."""

from pyspark.sql import functions as F

from shutterlake.functions import icc, xmp
from shutterlake.operators import report
from shutterlake.plans import catalog, media
from shutterlake.sources import manifest, png_encode, tiff


def test_tasks_follow_rows(spark, tmp_path):
    spark.range(7000).selectExpr("id", "cast(id as string) as v").coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    rows = catalog.dealt(spark, str(tmp_path), "t", "id")
    assert rows.rdd.getNumPartitions() == 4 and rows.count() == 7000
    assert rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2500
    spark.range(0).selectExpr("id").write.parquet(f"{tmp_path}/none.parquet")
    assert catalog.dealt(spark, str(tmp_path), "none", "id").count() == 0


def test_claims_and_profiles(spark):
    claim = b"xxclaim_generator\x78\x05Tool1 tail"
    short, none = b"claim_generator\x01\x02\x64Four", b"nothing here"
    rows = spark.createDataFrame([(bytearray(c),) for c in (claim, short, none)], "c binary").select(manifest.claim_generator(F.col("c")).alias("g"))
    assert [r["g"] for r in rows.collect()] == ["Tool1", "Four", None]
    # a key's bytes are cut out once, not for each byte that a string may start at
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 2
    tags = b"desc" + (144).to_bytes(4, "big") + (16).to_bytes(4, "big")
    profile = bytes(36) + b"acsp" + bytes(88) + (1).to_bytes(4, "big") + tags + b"desc" + bytes(4) + (4).to_bytes(4, "big") + b"Name"
    told = spark.createDataFrame([(bytearray(profile),), (bytearray(profile[:150]),)], "c binary").select(icc.description(F.col("c")).alias("d"))
    assert [r["d"] for r in told.collect()] == ["Name", None]
    assert told._jdf.queryExecution().optimizedPlan().toString().count("sequence(") == 1


def test_rows_of_every_filter_are_read_back():
    import numpy as np

    rng, width, step = np.random.default_rng(1), 7, 4
    above, want = rng.integers(0, 256, width * step), rng.integers(0, 256, width * step)
    left = np.concatenate([np.zeros(step, int), want[:-step]])
    corner = np.concatenate([np.zeros(step, int), above[:-step]])
    for kind, guess in ((3, (left + above) >> 1), (4, png_encode._paeth(left, above, corner))):
        assert png_encode._summed(kind, ((want - guess) & 255).tolist(), above.tolist(), step) == want.tolist()


def test_payloads_cleaned_row_by_row(spark):
    """the same bytes as by shuffled entries, and the entries read again."""
    files = spark.createDataFrame([(str(i), bytearray(c)) for i, c in enumerate(_cameras(spark))] + [("bad", bytearray(b"xx")), ("none", None)], "file_id string, content binary")
    for removed in (frozenset(["gps"]), frozenset(), frozenset(["exif", "gps"]), frozenset(["exif", "gps", "other", "comment"])):
        row = tiff.rewritten(files, removed, embedded=True)
        assert {(r["file_id"], bytes(r["content"])) for r in row.collect()} == {(r["file_id"], bytes(r["content"])) for r in tiff.clean(files, removed, embedded=True).collect()}
        assert "Exchange" not in row._jdf.queryExecution().executedPlan().toString()
        for r in row.collect():
            again = tiff.entries_of(bytes(r["content"]))
            assert list(zip(r["kinds"], r["tags"], map(bytes, r["values"]), strict=True)) == [(e[2], e[3], e[6]) for e in again]


def _cameras(spark):
    return [bytes(r["content"]) for r in media._cameras(spark, "/root/testdata/sf0.001").limit(5).collect()]


def test_reports_have_one_python_step(spark):
    """files are walked in Python once; what is told of them stays with Spark."""
    files = spark.createDataFrame([("a", bytearray(b"GIF89a" + bytes(12)))], "file_id string, content binary")
    plan = report.inspect(files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "PythonUDF" not in plan and "ArrowEvalPython" not in plan


def test_numeric_entities(spark):
    cases = {"a&#65;&#x42;c": "aABc", "&#x1F600;&#xd800;|": "😀�|", "&#X20AC;&#0065;&#1114112;&#99999999999;": "€A��", "&amp;#65; &#;": "&#65; &#;", "&#xfeff;|&#57344;": "﻿|", "&#38;amp;": "&", "plain": "plain", "": "", None: None}
    got = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").select("i", xmp.unescape(F.col("t")).alias("u"))
    assert [r["u"] for r in sorted(got.collect())] == list(cases.values())
