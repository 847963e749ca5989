"""Token counts of documents in flat token files, found by scanning for the end-of-document separator.

A flat file holds nothing but token ids, document after document, each closed by the separator. It is kept as a
table of fixed-size blocks (shard, block, little-endian 16- or 32-bit ids), which Spark splits freely and which cut documents anywhere.
Each block is searched on its own with one vectorised comparison; documents inside a block are done at
once. A prefix scan over the per-block separator counts numbers the documents of a shard, and the heads and tails of
blocks with one number are summed, so a document may span any number of blocks.

Defined results: null and empty texts are documents of no tokens; the separator itself is not counted; ids after a shard's last separator are
an unfinished document and are reported as such; texts of any length count whole; a written separator string in a text is ordinary text; rows that repeat an id are
counted each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickcast.llm.common import bounded_batches, mapped, written

BLOCK = 1 << 18
SEPARATOR = 50256
_encodings: dict = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoding(path: str):
    """Byte-level BPE of a rank file."""
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def flat_files(docs: DataFrame, path: str, separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """Encode documents into flat token blocks: shard, block, ids; and rows (shard, ordinal, doc_id) of who was written where.

    One shard per task. Both kinds of rows share a table; ids is null in the second kind.
    """
    bounded_batches(docs.sparkSession)
    kind = np.uint16 if separator < 1 << 16 else np.uint32

    def run(batches):
        shard, number, ordinal, rest = TaskContext.get().partitionId(), 0, 0, []
        size = 0
        names = ["shard", "block", "ids", "ordinal", "doc_id"]
        types = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

        def rows(block_no, ids, ordinals, doc_ids):
            n = len(ids) + len(ordinals)
            a, b = [None] * len(ids), [None] * len(ordinals)
            cols = [[shard] * n, block_no + b, ids + b, a + ordinals, a + doc_ids]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = []
            for text in batch.column(1).to_pylist():
                x = np.append(np.array(encoding(path).encode_ordinary(text or ""), np.int64), separator).astype(kind)
                rest.append(x)
                size += len(x)
                if size >= block:
                    flat = np.concatenate(rest)
                    full = len(flat) // block
                    out += [flat[i * block : (i + 1) * block].tobytes() for i in range(full)]
                    rest, size = [flat[full * block :]], len(flat) - full * block
            yield rows(list(range(number, number + len(out))), out, list(range(ordinal, ordinal + len(ids))), ids)
            number, ordinal = number + len(out), ordinal + len(ids)
        if size:
            yield rows([number], [np.concatenate(rest).tobytes()], [], [])

    return docs.select("doc_id", "text").mapInArrow(run, "shard int, block long, ids binary, ordinal long, doc_id long")


def scan(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """shard, ordinal, n_tokens, finished of every document in flat token blocks (shard, block, ids)."""
    kind = np.uint16 if separator < 1 << 16 else np.uint32

    def search(batch: pa.RecordBatch):
        for shard, number, ids in zip(*(c.to_pylist() for c in batch.columns)):
            x = np.frombuffer(ids, kind)
            at = np.flatnonzero(x == separator)
            head = int(at[0]) if len(at) else len(x)
            tail = len(x) - 1 - int(at[-1]) if len(at) else 0
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([head], pa.int64()), pa.array([tail], pa.int64()), pa.array([np.diff(at) - 1 if len(at) > 1 else []], pa.list_(pa.int64()))],
                ["shard", "block", "n", "head", "tail", "inner"],
            )

    # the block's ids are read here only; what goes on is a few numbers a document
    found = mapped(blocks.select("shard", "block", "ids"), search, "shard int, block long, n long, head long, tail long, inner array<long>")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parts = F.concat(
        F.array(F.struct(F.col("first").alias("ordinal"), F.col("head").alias("t"), (F.col("n") > 0).alias("ends"))),
        F.transform("inner", lambda t, i: F.struct((F.col("first") + i + 1).alias("ordinal"), t.alias("t"), F.lit(True).alias("ends"))),
        F.when(F.col("n") > 0, F.array(F.struct((F.col("first") + F.col("n")).alias("ordinal"), F.col("tail").alias("t"), F.lit(False).alias("ends")))).otherwise(
            F.array().cast("array<struct<ordinal:bigint,t:bigint,ends:boolean>>")
        ),
    )
    rows = found.select("shard", F.inline(parts))
    whole = rows.groupBy("shard", "ordinal").agg(F.sum("t").alias("n_tokens"), F.max("ends").alias("finished"))
    return whole.filter("finished or n_tokens > 0")


def document_tokens(docs: DataFrame, path: str | None = None, separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens of every row, by way of flat token files in the shared folder."""
    flat = written(flat_files(docs, path or default_path(), separator, block), "flat-tokens")
    counts = scan(flat.filter(F.col("ids").isNotNull()), separator)
    return flat.filter(F.col("ordinal").isNotNull()).select("shard", "ordinal", "doc_id").join(counts, ["shard", "ordinal"]).select("doc_id", "n_tokens")
