"""Helpers shared by the corpus operators: staging, splits and batch slicing."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.pinning import pinned, shared_dir

__all__ = ["fold", "hold", "pinned", "shared_dir", "slices", "staged", "texts_of", "tokenizer_path", "trim"]

#: Text bytes that one slice of an Arrow batch holds at most (a single longer text is a slice of its own).
SLICE_BYTES = 4 << 20


def staged(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back; it is deleted when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def trim() -> None:
    """Give memory that is free again back to the system: idle workers share an executor with those that work."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library: it keeps its memory


def hold() -> None:
    """Keep up to 64 MB of freed memory for the next arrays of this process until trim(): pages that come anew for every array cost a
    good part of the time of numpy's short steps."""
    import ctypes

    try:
        for name, size in ((-1, 64 << 20), (-3, 32 << 20)):  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD
            ctypes.CDLL(None).mallopt(name, size)
    except (AttributeError, OSError):
        pass  # another C library: it keeps what it likes


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches again, in slices of at most limit bytes of text."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch, sizes
        trim()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file; names with a slash are paths already."""
    if "/" in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))
