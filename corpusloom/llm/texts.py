"""Shared helpers for operators that read whole texts in Arrow batches."""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows and bytes that a step holds at most, whatever the session's batches are (a single longer text is a step of its own).
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20

_HELD: dict[str, Callable[[], None]] = {}


def holds(name: str, drop: Callable[[], None]) -> None:
    """Say that this worker now keeps the caches of operator ``name``, which ``drop`` empties. Workers serve one operator after
    the other: the caches of the others go."""
    if name in _HELD:
        return
    for clear in _HELD.values():
        clear()
    _HELD.clear()
    _HELD[name] = drop
    gc.collect()
    pa.default_memory_pool().release_unused()


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in steps of at most BATCH_ROWS rows and about BATCH_BYTES bytes."""
    start = 0
    while start < batch.num_rows:
        rows = min(BATCH_ROWS, batch.num_rows - start)
        while rows > 1 and batch.slice(start, rows).nbytes > BATCH_BYTES:
            rows //= 2
        yield batch.slice(start, rows)
        start += rows


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: T.StructType) -> DataFrame:
    """Run ``fn`` over steps of Arrow batches: it takes and returns columns as Python lists. No shuffle. A session's larger limit of
    rows in a batch is lowered to BATCH_ROWS, and stays so: batches are held in the JVM and in the worker at once."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(rows, "10000")) <= BATCH_ROWS:
        df.sparkSession.conf.set(rows, str(BATCH_ROWS))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                out = fn({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def sha256(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def spans_text(spans: Iterable[tuple[int, int, str]], kinds: dict[str, int]) -> str:
    """kind:start:end by start, then kind in the order of ``kinds``."""
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], kinds[x[2]], x[1])))
