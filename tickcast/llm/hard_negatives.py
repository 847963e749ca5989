"""Hard negatives by a vector-approximation file: of every anchor's many rows only those are scored exactly whose bounds allow a place.

The file is a table of blocks. A block holds the integer vectors of some thousand rows and, for each, the cell that every component
falls in; cells have equal widths between the block's least and greatest value of a dimension. For an anchor a table gives every
dimension's least product with each cell, so a row's lower bound is a sum of looked-up numbers, and its upper bound is that plus a number
of the anchor alone. All bounds are whole numbers, so results are exact.

Anchors meet all rows in a grid: groups of rows by chunks of anchors, each pair of them one group of a cogroup with bounded sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickcast.llm import common

#: Cells of a dimension, rows of a block, rows of a group of blocks, anchors of a pack, anchors of a chunk of packs.
CELLS, BLOCK, GROUP, PACK, CHUNK = 64, 4096, 1 << 18, 128, 1 << 16
#: Scaled components beyond this take no part: their scores could leave 64 bits.
LARGEST = 1 << 23
#: Below every score, with room for bounds.
NONE = np.int64(-(1 << 62))

BLOCKS = "grp int, d int, n int, ids binary, labels binary, cells binary, least binary, width binary, vectors binary, kind string"
PACKS = "chunk int, d int, n int, keys binary, ids binary, labels binary, vectors binary"


def participants(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int, relabel: tuple[int, int] | None) -> DataFrame:
    """id, label, q: rows that take part, with whole-number components; labels of some rows are moved on by one."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double") * scale)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), x.alias("x"))
    fine = F.forall("x", lambda v: F.coalesce(F.abs(v) <= LARGEST, F.lit(False)))  # false for NaN, which is greater than any number
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0) & fine)
    label = F.col("label")
    if relabel is not None:
        every, labels = relabel
        label = F.when(F.col("id") % every == 0, (label + 1) % labels).otherwise(label)
    return rows.select("id", label.alias("label"), F.transform("x", lambda v: F.floor(v).cast("int")).alias("q"))


def _by_length(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, labels and vectors of at most ``most`` rows with vectors of one length."""
    held: dict[int, list] = {}
    for batch in batches:
        ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        q = batch.column(2)
        flat, off = q.flatten().to_numpy(zero_copy_only=False), q.offsets.to_numpy()
        lengths = np.diff(off)
        off = off - off[0] if len(off) else off
        for d in np.unique(lengths):
            rows = np.flatnonzero(lengths == d)
            own = flat[(off[rows][:, None] + np.arange(d))]
            parts = held.setdefault(int(d), [])
            parts.append((ids[rows], labels[rows], own))
            while sum(len(p[0]) for p in parts) >= most:
                whole = [np.concatenate(c) for c in zip(*parts)]
                yield tuple(c[:most] for c in whole)
                held[int(d)] = parts = [tuple(c[most:] for c in whole)]
    for parts in held.values():
        whole = [np.concatenate(c) for c in zip(*parts)]
        if len(whole[0]):
            yield tuple(whole)


def _small(a: np.ndarray) -> tuple[np.ndarray, str]:
    """``a`` in the least type that holds it."""
    kind = next(k for k in ("int8", "int16", "int32") if not a.size or (np.iinfo(k).min <= a.min() and a.max() <= np.iinfo(k).max))
    return a.astype(kind), kind


def _block_rows(batches):
    for ids, labels, q in _by_length(batches, BLOCK):
        least = q.min(axis=0).astype(np.int64)
        width = (q.max(axis=0) - least) // CELLS + 1  # whole values in a cell
        cells = ((q - least) // width).astype(np.uint8)
        vectors, kind = _small(q)
        row = [TaskContext.get().partitionId(), q.shape[1], len(ids), ids.astype(np.int64).tobytes(), labels.astype(np.int64).tobytes(), cells.T.tobytes(), least.tobytes(), width.tobytes(), vectors.tobytes(), kind]
        yield _one_row(BLOCKS, row)


def _pack_rows(batches):
    chunk, n = TaskContext.get().partitionId(), 0
    for ids, labels, q in _by_length(batches, PACK):
        keys = (np.int64(chunk) << 32) + n + np.arange(len(ids))
        n += len(ids)
        yield _one_row(PACKS, [chunk, q.shape[1], len(ids), keys.tobytes(), ids.astype(np.int64).tobytes(), labels.astype(np.int64).tobytes(), q.astype(np.int32).tobytes()])


def _one_row(schema: str, values: list) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    columns = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(values, columns)], names=[c for c, _ in columns])


def approximation_file(rows: DataFrame, total: int) -> tuple[DataFrame, int]:
    """The blocks of all rows, dealt evenly to groups of at most ``GROUP`` rows, and the number of groups."""
    groups = max(1, -(-total // GROUP), min(common.partitions(rows), total // BLOCK))
    return common.written(rows.repartition(groups).mapInArrow(_block_rows, BLOCKS), "va-file"), groups


def anchor_packs(anchors: DataFrame, total: int) -> tuple[DataFrame, int]:
    """Anchors in packs, dealt evenly to chunks of at most ``CHUNK``, and the number of chunks. Each anchor row has a key of its own."""
    chunks = max(1, -(-total // CHUNK))
    return common.written(anchors.repartition(chunks).mapInArrow(_pack_rows, PACKS), "anchors"), chunks


class Block:
    """Rows of a block; bounds of their scores with anchors."""

    def __init__(self, d, n, ids, labels, cells, least, width, vectors, kind):
        self.ids, self.labels = (np.frombuffer(b, np.int64) for b in (ids, labels))
        self.cells = np.frombuffer(cells, np.uint8).reshape(d, n)
        self.least, self.width = (np.frombuffer(b, np.int64) for b in (least, width))
        self.vectors = np.frombuffer(vectors, kind).reshape(n, d)

    def bounds(self, anchors: np.ndarray, rows: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Lower bounds, a row for each of ``anchors`` and a column for each of ``rows``, and what an anchor's upper bounds are above them."""
        q = anchors.astype(np.int64)
        slack = (np.abs(q) * (self.width - 1)).sum(axis=1)
        edges = self.least[:, None] + np.arange(CELLS) * self.width[:, None]  # least value of each cell
        most = (np.abs(q).sum(axis=1) * max(1, int(np.abs(edges).max()) + int(self.width.max()))).max(initial=0)
        kind = np.int32 if most < 1 << 31 else np.int64
        cells = self.cells[:, rows]
        low = np.zeros((cells.shape[1], len(q)), kind)
        for j in range(len(edges)):
            ends = np.where(q[:, j] >= 0, 0, self.width[j] - 1)  # the end of the cell that gives the least product
            table = ((edges[j][:, None] + ends) * q[:, j]).astype(kind)
            low += table[cells[j]]
        return np.ascontiguousarray(low.T), slack.astype(kind)

    def scores(self, rows: np.ndarray, anchors: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact scores of pairs (row, anchor)."""
        out = np.empty(len(rows), np.int64)
        for i in range(0, len(rows), 1 << 14):
            s = slice(i, i + (1 << 14))
            out[s] = np.einsum("ij,ij->i", self.vectors[rows[s]].astype(np.int64), anchors[at[s]].astype(np.int64))
        return out


class Best:
    """The first ``k`` rows of each of ``n`` lists by score, then smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((n, k), NONE), np.full((n, k), NONE)

    def last(self, at: np.ndarray) -> np.ndarray:
        """Score of the last place; no score can be below that of an open one."""
        return self.scores[at, -1]

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(at):
            return
        lists = np.unique(at)
        open_ = self.scores[lists].ravel() != NONE
        at = np.concatenate([np.repeat(lists, self.k)[open_], at])
        scores = np.concatenate([self.scores[lists].ravel()[open_], scores])
        ids = np.concatenate([self.ids[lists].ravel()[open_], ids])
        order = np.lexsort((ids, -scores, at))
        at, scores, ids = at[order], scores[order], ids[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        first = place < self.k
        self.scores[lists], self.ids[lists] = NONE, NONE
        self.scores[at[first], place[first]], self.ids[at[first], place[first]] = scores[first], ids[first]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, place = np.nonzero(self.scores != NONE)
        return at, self.scores[at, place], self.ids[at, place]


def _top(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; nothing is below the answer where there are fewer."""
    n = values.shape[1]
    return np.partition(values, n - k, axis=1)[:, n - k] if n >= k else np.full(len(values), NONE)


def _blocks(table: pa.Table) -> Iterator[Block]:
    for batch in table.to_batches():
        for row in range(batch.num_rows):
            yield Block(*(batch.column(k)[row].as_py() for k in map(batch.schema.get_field_index, ("d", "n", "ids", "labels", "cells", "least", "width", "vectors", "kind"))))


def _packs(table: pa.Table) -> list[dict]:
    out = []
    for r in table.select([c.split()[0] for c in PACKS.split(", ")][1:]).to_pylist():
        out.append({"d": r["d"], "keys": np.frombuffer(r["keys"], np.int64), "ids": np.frombuffer(r["ids"], np.int64), "labels": np.frombuffer(r["labels"], np.int64), "q": np.frombuffer(r["vectors"], np.int32).reshape(r["n"], r["d"])})
    return out


def positives_of(block: Block, pack: dict, best: Best) -> None:
    """Let the block's rows of the anchors' own labels compete for the anchors' positives."""
    for label in np.intersect1d(block.labels, pack["labels"]):
        rows, at = np.flatnonzero(block.labels == label), np.flatnonzero(pack["labels"] == label)
        low, slack = block.bounds(pack["q"][at], rows)
        other = pack["ids"][at][:, None] != block.ids[rows]
        low = np.where(other, low, NONE)
        need = np.maximum(_top(low, best.k), best.last(at)) - slack
        a, r = np.nonzero(other & (low >= need[:, None]))
        best.add(at[a], block.scores(rows[r], pack["q"], at[a]), block.ids[rows[r]])


def negatives_of(block: Block, pack: dict, windows: tuple[np.ndarray, np.ndarray, np.ndarray], best: Best) -> None:
    """Let the block's rows of other labels compete for the places of the windows (anchor of the pack, least and greatest score)."""
    at, least, most = windows
    low, slack = block.bounds(pack["q"])
    other = pack["labels"][:, None] != block.labels
    maybe = np.zeros(low.shape, bool)
    candidates = []
    for w, a in enumerate(at):
        up = low[a] + slack[a]
        may = np.flatnonzero(other[a] & (low[a] <= most[w]) & (up >= max(least[w], best.scores[w, -1])))
        sure = low[a, may][(low[a, may] >= least[w]) & (up[may] <= most[w])]
        if len(sure) >= best.k:  # so many rows are in the window for sure: no row can enter below the last of them
            may = may[up[may] >= np.partition(sure, len(sure) - best.k)[len(sure) - best.k]]
        maybe[a, may] = True
        candidates.append(may)
    a, r = np.nonzero(maybe)
    exact = np.full(low.shape, NONE)
    exact[a, r] = block.scores(r, pack["q"], a)
    lists = np.repeat(np.arange(len(at)), [len(c) for c in candidates])
    rows = np.concatenate([*candidates, np.zeros(0, np.int64)]).astype(np.int64)
    score = exact[at[lists], rows]
    inside = (score >= least[lists]) & (score <= most[lists])
    best.add(lists[inside], score[inside], block.ids[rows[inside]])


def _out(columns: list[np.ndarray], names: list[str]) -> pa.Table:
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)


def hard_negatives(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, relabel: tuple[int, int] | None = None, every: int = 100,
    positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is the integer inner product, higher first, ties by smaller id. Anchors are rows whose id is
    divisible by ``every``; an anchor's positives are its first rows of its label. For each, the first rows of other labels count whose score is
    from window[0] to window[1] hundredths of the positive's.  ``relabel`` (k, m): where the id is divisible by k the label becomes (label + 1) % m.

    Rows with a null id, label or vector, an empty vector, or a component that is null, not finite or beyond 2**23 once scaled take no part. Vectors of
    different lengths do not meet. Rows that share an id are rows of their own, but not each other's positives; each such anchor has its own
    results. Windows of positives with negative scores are empty. An empty table gives an empty result; other columns do not matter.
    """
    common.bounded_batches(df.sparkSession)
    rows = participants(df, id_col, vector_col, label_col, scale, relabel)
    n = rows.agg(F.count("*").alias("all"), F.count_if(F.col("id") % every == 0).alias("asked")).first()
    blocks, groups = approximation_file(rows, n["all"])
    packs, chunks = anchor_packs(rows.filter(F.col("id") % every == 0), n["asked"])
    copies = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    grid = ["grp", "chunk"]
    left, right = blocks.withColumn("chunk", copies(chunks)), packs.withColumn("grp", copies(groups))

    def first(table: pa.Table, asked: pa.Table) -> pa.Table:
        found = _packs(asked)
        best = [Best(len(p["ids"]), positives) for p in found]
        for block in _blocks(table):
            for p, b in zip(found, best):
                if p["d"] == len(block.least):
                    positives_of(block, p, b)
        parts = [(p["keys"][at], p["ids"][at], ids, score) for p, b in zip(found, best) for at, score, ids in [b.rows()]]
        return _out([np.concatenate(c) if parts else np.zeros(0, np.int64) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4, ["key", "anchor_id", "positive_id", "positive_score"])

    near = left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInArrow(first, "key long, anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("key").orderBy(F.desc("positive_score"), "positive_id")
    near = common.written(near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives), "positives")
    # each chunk's windows ride with its packs, as one more row of the right side
    asked = near.withColumn("chunk", F.shiftright("key", 32).cast("int")).groupBy("chunk").agg(F.collect_list(F.struct("key", "place", "positive_score")).alias("w"))
    right = right.unionByName(asked.withColumn("grp", copies(groups)), allowMissingColumns=True)

    def second(table: pa.Table, asked: pa.Table) -> pa.Table:
        full = asked.filter(pc.is_valid(asked["n"]))
        listed = asked.filter(pc.is_valid(asked["w"]))["w"].combine_chunks().flatten()
        keys, places, scores = (listed.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
        found, lists = _packs(full), []
        for p in found:
            mine = np.flatnonzero(np.isin(keys, p["keys"]))
            at = np.searchsorted(p["keys"], keys[mine])
            least, most = -(-window[0] * scores[mine] // 100), window[1] * scores[mine] // 100
            some = least <= most
            lists.append((mine[some], (at[some], least[some], most[some]), Best(int(some.sum()), negatives)))
        for block in _blocks(table):
            for p, (_, w, b) in zip(found, lists):
                if p["d"] == len(block.least):
                    negatives_of(block, p, w, b)
        parts = [(keys[mine[at]], places[mine[at]], ids, score) for mine, _, b in lists for at, score, ids in [b.rows()]]
        return _out([np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4, ["key", "place", "negative_id", "negative_score"])

    far = left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInArrow(second, "key long, place long, negative_id long, negative_score long")
    order = Window.partitionBy("key", "place").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return far.join(near.withColumn("place", F.col("place").cast("long")), ["key", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
