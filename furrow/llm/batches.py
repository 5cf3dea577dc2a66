"""Small helpers for work on Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of text handled at a time inside a task, and rows that Spark hands to Python at once; both bound the memory of a task.
CHUNK_CHARS, BATCH_ROWS = 2_000_000, 1_000
_LIBC = ctypes.CDLL(None) if sys.platform == "linux" else None


def small_batches(spark: SparkSession) -> None:
    """Texts are long rows: batches of Spark's default of 10,000 would hold tens of megabytes on both sides of each task. A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def release() -> None:
    """Hand memory that is free again back to the system; a worker goes on to the next stage with what it holds."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows whose ``sizes`` add up to about ``most``; a single larger row stays whole."""
    if not len(sizes):
        return
    part = np.cumsum(sizes) // most
    at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    yield from zip(at, at[1:])


def text_slices(texts: pa.Array, most: int = CHUNK_CHARS) -> Iterator[tuple[int, int, list]]:
    """(first, end, texts) of runs of about ``most`` bytes: only one run's texts are Python strings at a time."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for a, b in cuts(sizes, most):
        yield a, b, texts.slice(a, b - a).to_pylist()


def map_texts(df: DataFrame, text: str, new: str, make: Callable[[], Callable[[list], list]], most: int = CHUNK_CHARS, keep: bool = False) -> DataFrame:
    """The columns of ``df`` but ``text`` (with ``keep`` that one too), unchanged, and those of the schema text ``new``.

    ``make`` builds, once in each task, the function of a list of texts (None for null) that returns the new columns as a list of arrays or lists. The other
    columns stay in Arrow, so long ids beside nulls keep every digit.
    """
    fields = T.StructType.fromDDL(new).fields
    kinds = [to_arrow_type(f.dataType) for f in fields]
    old = [f for f in df.schema if keep or f.name != text]
    at = df.columns.index(text)

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            kept = batch.select([k for k in range(batch.num_columns) if keep or k != at])
            for a, b, texts in text_slices(batch.column(at), most):
                made = [x.cast(kind) if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(f(texts), kinds)]
                yield pa.RecordBatch.from_arrays([*kept.slice(a, b - a).columns, *made], [n.name for n in (*old, *fields)])
        release()

    return df.mapInArrow(run, T.StructType([*old, *fields]))


def decide(spark: SparkSession, make: Callable[[], Callable[[list], np.ndarray]], most: int = CHUNK_CHARS):
    """A column function text -> boolean for filters: whole texts go to Python in bounded slices, only the decisions come back.

    ``make`` builds, once in each task, the function of a list of texts (None for null) that returns an array of booleans.
    """

    small_batches(spark)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = make()
        for texts in batches:
            yield pa.array(np.concatenate([np.zeros(0, bool), *(np.asarray(f(part), bool) for _, _, part in text_slices(texts, most))]))
        release()

    return F.arrow_udf(run, "boolean")
