"""Small helpers shared by the operators: shared-folder tables, sizes, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickcast.sources.shared import discard, shared_dir, written  # noqa: F401  the operators take them from here

#: Rows per Arrow batch; with documents of a few kilobytes a batch stays within a few megabytes.
ARROW_ROWS = 1000
ARROW_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a Python worker's memory does not follow document sizes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


#: Column of ``numbered``.
ROW = "__row"


def plain_ids(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether every row has an id and no id repeats."""
    return not docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).filter("n > 1 or id is null").limit(1).count()


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a key of its own for every row, in the order of the ids: null ids last, rows of one id by text hash.

    Ids that are unique and never null are the keys; otherwise the sorted rows are written once with their numbers.
    """
    own = F.col(id_col)
    if plain_ids(docs, id_col):
        return docs.withColumn(ROW, own)
    # numbers rise with the ranges of the sort; equal ids fall into several ranges by their texts
    return written(docs.orderBy(own.asc_nulls_last(), F.xxhash64(text_col)).withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def partitions(df: DataFrame) -> int:
    """Number of partitions for work proportional to ``df``: its own, or the session's shuffle setting if larger."""
    return max(df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def blocks(df: DataFrame, text: str, mb: int = 12) -> int:
    """Number of blocks of about ``mb`` MB of text; follows the input's size at every scale."""
    total = df.agg(F.sum(F.length(text))).first()[0] or 0
    return max(1, -(-total // (mb << 20)))


def mapped(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch | pa.Table]], schema) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches):
        for batch in batches:
            for out in fn(batch):
                yield from (out.to_batches() if isinstance(out, pa.Table) else [out])

    return df.mapInArrow(run, schema)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about ``most`` bytes each (one row may be larger)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def pack(a: np.ndarray) -> bytes:
    """An array as compressed bytes; columns of runs shrink to almost nothing."""
    return pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True) if len(a) else b""


def unpack(data: bytes, dtype, n: int) -> np.ndarray:
    """Inverse of ``pack`` for ``n`` elements."""
    if not n:
        return np.zeros(0, dtype)
    size = n * np.dtype(dtype).itemsize
    return np.frombuffer(pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True), dtype)
