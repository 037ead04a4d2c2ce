"""Files as rows: a byte walk per file, run over Arrow batches on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


BATCH_BYTES, BATCH_ROWS = 4 << 20, 10_000


def rows_of(files: DataFrame, walk: Callable[..., Iterable[tuple]], columns: str, keys: str = "file_id string", given: Sequence[str] = ()) -> DataFrame:
    """``keys``, ``ord`` and ``columns`` for every tuple that ``walk`` yields for a row's ``content``.

    The keys named in ``given`` go to ``walk`` as well. A null or unreadable content
    gives no rows. Rows of many files leave in one batch, which ends after the file
    that fills it.
    """
    names = [part.split()[0] for part in keys.split(",")]
    passed = [names.index(n) for n in given]
    ddl = f"{keys}, ord int, {columns}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def gathered() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for *key, content in zip(*(batch[n].to_pylist() for n in names), batch["content"], strict=True):
                found = content.as_py() or b""
                rows += [(*key, at, *one) for at, one in enumerate(walk(found, *(key[i] for i in passed)))]
                size += len(found)
                if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    if rows:
                        yield gathered()
                    rows, size = [], 0
        if rows:
            yield gathered()

    return files.select(*names, "content").mapInArrow(run, ddl)

