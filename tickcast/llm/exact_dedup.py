"""Exact deduplication by Grace hashing.

Every input task first combines its own copies in an open-addressing table; the distinct texts
that are left are dealt out by content hash. A receiving task writes them to spill files by
further hash bits until a bucket fits the table, which compares complete contents.

Defined results: null text counts as empty; texts are equal when they are identical after each run
of ``[\\x20\\x09-\\x0D]+`` became one space; the smallest id of a class stays, null ids after all others;
repeated rows (the same id twice) count as rows, and ``drop_exact_duplicates`` keeps one row of a class; ``kept`` of a null id is null, as in SQL; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickcast.llm.common import ROW, bounded_batches, numbered, partitions

SPACES = r"[\x20\x09-\x0D]+"
#: Bytes of text that one table may hold, and the ways in which a larger bucket is split.
TABLE_BYTES = 48 << 20
FANOUT = 16


class OpenTable:
    """Open addressing with linear probing; equal means equal complete contents."""

    def __init__(self, slots: int = 1024):
        self.at = [-1] * slots
        self.rows: list[list] = []
        self.bytes = 0

    def add(self, h: int, text: str, first: int, count: int) -> None:
        if 2 * len(self.rows) >= len(self.at):
            self._grow()
        mask = len(self.at) - 1
        i = h & mask
        while (k := self.at[i]) >= 0:
            row = self.rows[k]
            if row[0] == h and row[1] == text:
                row[2] = min(row[2], first) if row[2] is not None and first is not None else row[2] if first is None else first
                row[3] += count
                return
            i = (i + 1) & mask
        self.at[i] = len(self.rows)
        self.rows.append([h, text, first, count])
        self.bytes += len(text) + 200

    def _grow(self) -> None:
        self.at = [-1] * (4 * len(self.at))
        mask = len(self.at) - 1
        for k, row in enumerate(self.rows):
            i = row[0] & mask
            while self.at[i] >= 0:
                i = (i + 1) & mask
            self.at[i] = k


def _batch(rows: list[list]) -> pa.RecordBatch:
    h, text, first, count = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(h, pa.int64()), pa.array(text, pa.string()), pa.array(first, pa.int64()), pa.array(count, pa.int64())],
        ["h", "text", "first", "n"],
    )


def _emit(table: OpenTable, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(table.rows), rows):
        yield _batch(table.rows[i : i + rows])


def _records(batches) -> Iterator[tuple[int, str, int, int]]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def combine(batches) -> Iterator[pa.RecordBatch]:
    """One task's own copies: emits each distinct text of a table-full once."""
    table = OpenTable()
    for h, text, first, count in _records(batches):
        table.add(h, text, first, count)
        if table.bytes > TABLE_BYTES:
            yield from _emit(table)
            table = OpenTable()
    yield from _emit(table)


def grace(records, level: int = 0) -> Iterator[OpenTable]:
    """Tables of complete classes. A stream beyond one table goes to spill files by the next hash bits.

    Contents with one and the same hash can't be split further; they are compared in one table.
    """
    table, files = OpenTable(), None
    shift = 60 - 4 * level
    with tempfile.TemporaryDirectory() as folder:
        for record in records:
            if files is None:
                table.add(*record)
                if table.bytes <= TABLE_BYTES or shift < 0:
                    continue
                files = [open(os.path.join(folder, str(i)), "wb") for i in range(FANOUT)]  # noqa: SIM115
                for row in table.rows:
                    pickle.dump(tuple(row), files[(row[0] >> shift) & 15])
                table = OpenTable()
            else:
                pickle.dump(record, files[(record[0] >> shift) & 15])
        if files is None:
            yield table
            return
        for f in files:
            f.close()
        for f in files:
            yield from grace(_spilled(f.name), level + 1)
            os.remove(f.name)


def _spilled(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def _classes(batches) -> Iterator[pa.RecordBatch]:
    for table in grace(_records(batches)):
        yield from _emit(table)


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    The texts travel once, and only one copy per task; members find their class by the
    SHA-256 of the text, a join whose skewed keys Spark can split.
    """
    bounded_batches(docs.sparkSession)
    keyed = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    keyed = keyed.select("doc_id", "text", F.xxhash64("text").alias("h"))
    schema = "h long, text string, first long, n long"
    local = keyed.select("h", "text", F.col("doc_id").alias("first"), F.lit(1).cast("long").alias("n")).mapInArrow(combine, schema)
    dealt = local.repartition(partitions(docs), "h")
    classes = dealt.mapInArrow(_classes, schema).select(
        F.sha2("text", 256).alias("text_sha256"), F.col("first").alias("keep_id"), F.col("n").alias("group_size")
    )
    members = keyed.select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    return members.join(classes, "text_sha256").select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns."""
    own = numbered(docs, id_col, text_col)
    keep = exact_duplicates(own, ROW, text_col).filter("kept").select(F.col("doc_id").alias(ROW))
    return own.join(keep, ROW, "left_semi").select(*docs.columns)
