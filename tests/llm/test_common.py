import os
import tracemalloc

import pyarrow as pa
import pytest

import corpus_pipeline
from shutterlake.llm.common import BATCH_BYTES, BATCH_LIMIT, bound_batches, discard, materialize, shared_dir, table, text_batches

SF = "/root/testdata/sf0.001"


class _Elsewhere:
    class conf:
        @staticmethod
        def get(name, default):
            return default

    class sparkContext:
        master = "spark://host:7077"


def test_no_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(_Elsewhere)


def test_materialized_rows_can_be_discarded(spark):
    kept = materialize(spark.range(5), "five")
    path = kept._written_to.removeprefix("file:")
    assert kept.count() == 5 and os.path.isdir(path.replace("//", "/"))
    discard(kept)
    assert not os.path.isdir(path.replace("//", "/"))


def test_a_slice_of_texts_at_a_time_is_in_python():
    texts = [str(i).zfill(4) * 1_000 for i in range(8_000)] + ["", "ä" * 2_000_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    ids, n = [], 0
    tracemalloc.start()
    for own, some in text_batches([batch], 1 << 20):
        assert some == [texts[i] for i in own]
        ids, n = ids + own, n + 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids == list(range(len(texts))) and n > 30
    assert peak < 12 << 20


def test_stages_bound_arrow_batches_by_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset(BATCH_LIMIT)
        stage(spark, table(spark, SF, "documents"), SF)
        got = spark.range(0, 9_000, 1, 1).selectExpr("id", "repeat('x', 4000) AS text").mapInArrow(sizes, "n long").collect()
        assert sum(r["n"] for r in got) > 36_000_000 and max(r["n"] for r in got) < 2 * BATCH_BYTES
    spark.conf.set(BATCH_LIMIT, "1m")
    bound_batches(spark)
    assert spark.conf.get(BATCH_LIMIT) == "1m"
    spark.conf.unset(BATCH_LIMIT)
