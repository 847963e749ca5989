"""Approximate nearest neighbours over balanced posting lists.

Equal vectors are one content first, with the few least ids that a result can hold. Cells are fitted on a bounded sample; their
centroids are joined by an in-memory neighbour graph that is shipped to the tasks. Each cell is cut into lists around pivots, which are
fitted in the cell on a share of its contents, one for every ``LIST`` of them: lists are as many as the table asks for, of like sizes by that fit. A
cell that would need more than ``FAN`` pivots is first cut into ``PARTS`` parts in the same way, and these again, until no part needs more. Every
content goes to the list of its nearest pivot, and boundary vectors also to further cells, parts and lists that are almost as near. A query searches
the graph for cells, compares the parts and pivots there, and keeps the lists whose distance is within a ratio of the best. A list is scored as
one block against its queries; only the best of a block travel on. Scores are exact cosines in double precision on the original vectors.

Tasks meet a cell's or part's centroids in chunks of ``SALT`` of its vectors. As these are ``FAN`` at most, the copies of centroids are
a fixed share of the vectors at any size, and work for a vector or a query is the graph's, ``PARTS`` or ``FAN`` comparisons a level and, for a
query, ``PROBES`` lists.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do vectors whose
dimension differs from the most frequent one; ties go to the smaller id; a query id that repeats has the best over its vectors, and rows that repeat an id count once
per distinct vector; with fewer candidates than ``k`` all are returned; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickcast.llm.common import bounded_batches, mapped, written

#: Vectors and bytes that cells may be fitted on, and cells at most.
SAMPLE, SAMPLE_BYTES, CENTROIDS = 16_384, 64 << 20, 1024
#: Vectors for a pivot, and for a cell while there are fewer than the most; contents that a pivot is fitted on.
LIST, CELL, FIT = 512, 8192, 16
#: Pivots of a cell or part at most, parts that a larger one is cut into, parts that a query sees of one.
FAN, PARTS, NEAR_PARTS = 256, 64, 12
#: Cells and lists that a vector is in at most, and how much farther than its nearest they may be.
CELLS, LISTS, BOUNDARY = 3, 2, 1.3
#: Cells and lists that a query sees at most, and how much farther than the nearest they may be.
NEAR_CELLS, PROBES, RATIO = 32, 128, 1.6
#: Vectors of a cell that one task meets.
SALT = 20_000
DEGREE = 24


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part, components as doubles."""
    v = F.col(vec_col)
    fine = v.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(fine).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # neither overflow nor underflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means of unit vectors; an empty cluster restarts at the vector that is worst off."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        s = x @ c.T
        near = s.argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.sqrt((total * total).sum(1))
        full = norm > 1e-12
        c[full] = total[full] / norm[full, None]
        if (~full).any():
            c[~full] = x[np.argsort(s.max(1))[: (~full).sum()]]
    return c


class CentroidGraph:
    """Navigable neighbour graph over the centroids: near neighbours and a few far ones for every node."""

    def __init__(self, centroids: np.ndarray, seed: int = 7):
        self.c = centroids
        n = len(centroids)
        near = np.argsort(-(centroids @ centroids.T), axis=1, kind="stable")[:, 1 : DEGREE + 1]
        far = np.random.default_rng(seed).integers(0, n, (n, 4))
        self.links = np.concatenate([near, far], axis=1)
        self.entry = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(int))

    def search(self, x: np.ndarray, want: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``want`` nearest centroids found for each row, nearest first, and their distances 1 - cosine.

        Best-first search for all rows at once: each step opens every row's nearest unopened node of its beam.
        """
        n, m = len(x), len(self.c)
        beam = min(max(beam, want, len(self.entry)), m)
        if m <= beam:
            s = x @ self.c.T
            at = np.argsort(-s, axis=1, kind="stable")[:, :want]
            return at, 1 - np.take_along_axis(s, at, 1)
        seen, opened = np.zeros((n, m), bool), np.zeros((n, m), bool)
        nodes = np.repeat(self.entry[None], n, 0)
        score = x @ self.c[self.entry].T
        seen[:, self.entry] = True
        live = np.arange(n)
        while len(live):
            best = np.where(opened[live[:, None], nodes[live]], -np.inf, score[live])
            pick = best.argmax(1)
            go = best[np.arange(len(live)), pick] > -np.inf
            live, pick = live[go], pick[go]
            if not len(live):
                break
            node = nodes[live, pick]
            opened[live, node] = True
            fresh = self.links[node]
            value = np.einsum("nd,nkd->nk", x[live], self.c[fresh])
            value[np.take_along_axis(seen[live], fresh, 1)] = -np.inf
            seen[live[:, None], fresh] = True
            if nodes.shape[1] < beam:
                pad = beam - nodes.shape[1]
                nodes, score = np.pad(nodes, ((0, 0), (0, pad))), np.pad(score, ((0, 0), (0, pad)), constant_values=-np.inf)
            both_n, both_s = np.concatenate([nodes[live], fresh], 1), np.concatenate([score[live], value], 1)
            keep = np.argsort(-both_s, axis=1, kind="stable")[:, :beam]
            nodes[live], score[live] = np.take_along_axis(both_n, keep, 1), np.take_along_axis(both_s, keep, 1)
        order = np.argsort(-score, axis=1, kind="stable")[:, :want]
        return np.take_along_axis(nodes, order, 1), 1 - np.take_along_axis(score, order, 1)


def near_enough(d: np.ndarray, ratio: float) -> np.ndarray:
    """Which of the rising distances are within the ratio of the first; a quarter always, since near a centre the ratio alone says little."""
    return (d <= ratio * d[:, :1]) | (np.arange(d.shape[1]) < d.shape[1] // 4)


def _pivots(left: pa.Table, right: pa.Table, dims: int):
    """Unit vectors of a cell's rows and pivots, and the pivots' ids; a cell without a pivot is one list, number -1."""
    v = unit(matrix(left["v"].combine_chunks(), dims))
    if not right.num_rows:
        return v, np.zeros((1, dims)), np.array([-1])
    order = np.argsort(right["pid"].to_numpy())
    return v, unit(matrix(right["pv"].combine_chunks(), dims))[order], right["pid"].to_numpy()[order]


def levels_of(size: float, per_list: int, fan: int, parts: int) -> list[float]:
    """Contents of an average cell, and of a part after each level of parts that it needs, until ``fan`` pivots are enough."""
    out = [size]
    while out[-1] > fan * per_list:
        out.append(out[-1] / parts)
    return out


def nearest(
    vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", per_list: int = LIST, per_cell: int = CELL, centroids: int = CENTROIDS, fan: int = FAN, parts: int = PARTS, salt: int = SALT
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    all_rows = usable(vectors, id_col, vec_col)
    shape = all_rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, total = shape["d"], shape["n"]
    rows = all_rows.filter(F.size("v") == dims)
    # no result holds more than the k + 1 least ids of equal vectors (one may be the query's own)
    few = rows.withColumn("place", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("place") <= k + 1)
    contents = few.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).withColumn("cid", F.monotonically_increasing_id())
    contents = written(contents.withColumn("first", F.element_at("ids", 1)), "vector-contents")
    most = min(SAMPLE, max(256, SAMPLE_BYTES // (8 * dims)))
    sample = contents.orderBy(F.xxhash64("first"), "first", "cid").limit(most).select("v").toArrow()  # bounded in rows and bytes
    x = unit(matrix(sample["v"].combine_chunks(), dims))
    graph = CentroidGraph(fit_centroids(x, min(centroids, -(-total // per_cell), len(x))))
    sizes = levels_of(total / len(graph.c), per_list, fan, parts)

    def cells(want: int, ratio: float):
        def run(batch: pa.RecordBatch):
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                at, d = graph.search(unit(matrix(part.column(1), dims)), want, 3 * want)
                row, col = np.nonzero(near_enough(d, ratio))
                yield part.take(pa.array(row)).append_column("cell", pa.array(at[row, col], pa.int64()))

        return run

    def near_centroids(want: int, ratio: float):
        """Rows of a cell or part with its centroids that are near enough, as ``list``."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            v, p, pid = _pivots(left, right, dims)
            left, out = left.drop(["salt"]), []
            for i in range(0, len(v), 1000):
                d = 1 - v[i : i + 1000] @ p.T
                at = np.argsort(d, axis=1, kind="stable")[:, :want]
                row, col = np.nonzero(near_enough(np.take_along_axis(d, at, 1), ratio))
                out.append(left.slice(i, 1000).take(pa.array(row)).append_column("list", pa.array(pid[at[row, col]])))
            return pa.concat_tables(out) if out else left.append_column("list", pa.array([], pa.int64()))

        return run

    def fit_pivots(count):
        def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
            x = unit(matrix(rows["v"].combine_chunks(), dims))
            c = fit_centroids(x, count(len(x)))
            return pa.table({"pcell": pa.array([key[0].as_py()] * len(c), pa.int64()), "pid": np.arange(len(c)), "pv": pa.FixedSizeListArray.from_arrays(c.ravel(), dims).cast(pa.list_(pa.float64()))})

        return run

    def near_lists(left: pa.Table, right: pa.Table) -> pa.Table:
        v, p, pid = _pivots(left, right, dims)
        d = 1 - v @ p.T
        at = np.argsort(d, axis=1, kind="stable")[:, :PROBES]
        row = np.repeat(np.arange(len(v)), at.shape[1])
        return pa.table({"cid": left["cid"].take(pa.array(row)), "cell": left["cell"].take(pa.array(row)), "list": pid[at.ravel()], "d": np.take_along_axis(d, at, 1).ravel()})

    def meet(df: DataFrame, fitted: DataFrame, size: float, fn, schema: str) -> DataFrame:
        """Rows of each cell or part meet its centroids, in chunks of about ``salt`` rows; the centroids are copied to the chunks."""
        salts = max(1, -(-int(CELLS * size) // salt))
        rows = df.withColumn("salt", F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(salts)).cast("int"))
        copies = fitted.withColumn("psalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return rows.groupBy("cell", "salt").cogroup(copies.groupBy("pcell", "psalt")).applyInArrow(fn, schema)

    def some(level: int, step: int) -> DataFrame:
        """One content in ``step`` with its nearest cell."""
        share = contents.filter(F.pmod(F.xxhash64("cid", F.lit(2 + level)), F.lit(max(1, step))) == 0).select("cid", "v")
        return mapped(share, cells(1, 1.0), "cid long, v array<double>, cell long")

    fits = []  # the parts' centroids by level, then the lists' pivots

    def down(df: DataFrame, columns: str, want: int, ratio: float) -> DataFrame:
        """Rows with their cell, down the levels of parts fitted so far."""
        for size, fitted in zip(sizes, fits):
            df = meet(df, fitted, size, near_centroids(want, ratio), f"{columns}, cell long, list long")
            df = df.withColumn("cell", F.col("cell") * parts + F.greatest("list", F.lit(0))).drop("list")
        return df

    narrow, wide = "cid long, v array<double>", "cid long, v array<double>, first long"
    for level, size in enumerate(sizes[:-1]):
        sample_of = down(some(level + 1, int(size / (parts * 4 * FIT))), narrow, 1, 1.0)
        fits.append(written(sample_of.groupBy("cell").applyInArrow(fit_pivots(lambda n: min(parts, n)), "pcell long, pid long, pv array<double>"), "parts"))
    last = down(some(0, per_list // FIT), narrow, 1, 1.0)
    pivots = written(last.groupBy("cell").applyInArrow(fit_pivots(lambda n: -(-n // FIT)), "pcell long, pid long, pv array<double>"), "pivots")  # once, since both sides must see the same
    posted = down(mapped(contents.select("cid", "v", "first"), cells(CELLS, BOUNDARY), f"{wide}, cell long"), wide, LISTS, BOUNDARY)
    lists = meet(posted, pivots, sizes[-1], near_centroids(LISTS, BOUNDARY), f"{wide}, cell long, list long")
    # queries are contents too; many queries may share one
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "v")
    asked = written(asked.join(contents.select("v", "cid"), "v").select("query_id", "cid").distinct(), "asked-vectors")
    own = contents.select("cid", "v").join(asked.select("cid").distinct(), "cid", "left_semi")
    seen = down(mapped(own, cells(NEAR_CELLS, RATIO), f"{narrow}, cell long"), narrow, NEAR_PARTS, RATIO)
    probes = meet(seen, pivots, sizes[-1], near_lists, "cid long, cell long, list long, d double")
    w = Window.partitionBy("cid").orderBy("d", "cell", "list")  # a query's lists in its few cells
    probes = probes.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= PROBES).withColumn("least", F.min("d").over(Window.partitionBy("cid")))
    probes = probes.filter((F.col("d") <= RATIO * F.col("least")) | (F.col("at") <= PROBES // 4))
    probes = probes.join(own, "cid").select(F.col("cid").alias("qid"), F.col("v").alias("q"), F.col("cell").alias("qcell"), F.col("list").alias("qlist"))

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.table({"qid": pa.array([], pa.int64()), "cid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        if left.num_rows and right.num_rows:
            qi, ci, first = left["qid"].to_numpy(), right["cid"].to_numpy(), right["first"].to_numpy()
            q, c = (unit(matrix(t.combine_chunks(), dims)) for t in (left["q"], right["v"]))
            for i in range(0, len(q), 256):
                s = q[i : i + 256] @ c.T
                if s.shape[1] > k + 1:
                    row, col = np.nonzero(s >= np.partition(s, -k - 1, axis=1)[:, -k - 1, None] - 1e-9)
                else:
                    row, col = np.nonzero(s > -np.inf)
                exact = (q[i + row] * c[col]).sum(1)
                order = np.lexsort((first[col], -exact, row))
                row, col, exact = row[order], col[order], exact[order]
                top = np.arange(len(row)) - np.searchsorted(row, row) <= k
                out.append(pa.table({"qid": qi[i + row[top]], "cid": ci[col[top]], "score": exact[top]}))
        return pa.concat_tables(out)

    tops = probes.groupBy("qcell", "qlist").cogroup(lists.groupBy("cell", "list")).applyInArrow(block, "qid long, cid long, score double")
    found = tops.groupBy("qid", "cid").agg(F.max("score").alias("score")).join(contents.select("cid", "ids"), "cid")
    found = found.select("qid", F.explode("ids").alias("vec_id"), "score").groupBy("qid", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k + 1).select(F.col("qid").alias("cid"), "vec_id", "score")
    pairs = asked.join(found, "cid").filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
