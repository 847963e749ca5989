"""Near-duplicate detection with DartMinHash signatures.

A document is a multiset of shingles of five words; similarity is weighted Jaccard (sum of minima over sum of
maxima of the counts), and a link is a similarity of 0.8 or more. Darts are thrown by hashes into each shingle's region, as wide
as its weight; a dart's rank is its arrival time, and each coordinate of the signature keeps its earliest
dart, so two documents agree on a coordinate with the probability of their similarity.

Copies with the same words collapse first. Banded signatures meet by equi-join in a star: every member of a band's group is
paired with the group's pivot, the member that meets most others over all bands. Copies differ least from the text they were
made from, so that text's neighbours are the most and nearly all links of a group end in its pivot. True similarities decide, and components are
found by label propagation. Groups that then still hold several components are completed: members of different components
meet where their sketches allow a link, again verified on the texts. A sketch is a bitmap of hashed shingles; bits that only one of two
documents has bound what they share from above, so no link is lost by it. Pairs inside a component never arise.

Defined results: null and empty texts have no words and form one class of their own copies; texts shorter than a
shingle are one shingle of all their words; texts of any length count whole; white space only separates words; rows that repeat
an id or have none are separate rows with their own texts; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickcast.llm.common import ROW, bounded_batches, discard, mapped, numbered, slices, text_buffer, written
from tickcast.llm.words import bounds, grams, hashes, mix, spans

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 25, 5
#: Slots of the hashed filter that picks candidate texts in the scan; a broadcast of at most so many numbers.
SLOTS = 1 << 20
#: Bits of a sketch, as 64-bit words.
SKETCH = 32
#: Bytes of text that a Python worker takes at once.
PART = 1 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle occurrence, rows in order."""
    s, e, doc = spans(data, offsets)
    w = hashes(data, s, e)
    g = grams(w, k)
    inside = doc[: len(g)] == doc[k - 1 : k - 1 + len(g)] if len(g) else np.zeros(0, bool)
    row, h = doc[: len(g)][inside], g[inside]
    limits = bounds(doc, len(offsets) - 1)
    short = np.flatnonzero((np.diff(limits) > 0) & (np.diff(limits) < k))
    if len(short):
        one = np.array([grams(w[limits[r] : limits[r + 1]], int(limits[r + 1] - limits[r]))[0] for r in short], np.uint64)
        row, h = np.concatenate([row, short]), np.concatenate([h, one])
        order = np.argsort(row, kind="stable")
        row, h = row[order], h[order]
    return row, h


def elements(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The multisets as sets, by row: the c-th copy of a shingle in a row is an element of its own."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    if not len(h):
        return row, h
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    copy = np.arange(len(h)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return row, mix(h + _GOLD * (copy.astype(np.uint64) + np.uint64(1)))


def _salt(k: int) -> np.uint64:
    return np.uint64(int(_GOLD) * k % 2**64)


def _exponential(seed: np.ndarray) -> np.ndarray:
    return -np.log1p(-(mix(seed) >> np.uint64(11)).astype(np.float64) * 2.0**-53)


def dart_signatures(row: np.ndarray, h: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """rows x k earliest darts, and which rows have any shingle.

    The c-th copy of a shingle is a unit region of its own. Its darts arrive in a Poisson stream given by
    hashes alone; a row looks at ranks up to t / weight with t = k ln k + 2k, and further where a coordinate stayed empty.
    """
    out = np.zeros((rows, k), np.uint64)
    row, region = elements(row, h)
    n = np.bincount(row, minlength=rows)
    todo = np.flatnonzero(n)
    t = k * np.log(k) + 2 * k
    while len(todo):
        pick = np.isin(row, todo) if len(todo) < len(n) else slice(None)
        r, reg = row[pick], region[pick]
        limit = t / n[r]
        rank = _exponential(reg)
        # the earliest dart of each cell so far; memory follows cells, not darts
        best, dart_of = np.full(rows * k, np.inf), np.zeros(rows * k, np.uint64)
        arrival = 1
        while True:
            live = rank <= limit
            if not live.all():
                r, reg, rank, limit = r[live], reg[live], rank[live], limit[live]
            if not len(r):
                break
            dart = mix(reg + _salt(2 * arrival))
            cell = r * k + (dart % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, cell, rank)
            first = best[cell] == rank
            dart_of[cell[first]] = dart[first]
            rank = rank + _exponential(reg + _salt(2 * arrival + 1))
            arrival += 1
        full = np.isfinite(best).reshape(rows, k)[todo].all(axis=1)
        out[todo[full]] = dart_of.reshape(rows, k)[todo[full]] | np.uint64(1)
        todo = todo[~full]
        t *= 2
    return out, n > 0


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """row, content (digest of the word sequence), bands (one hash each; empty without words)."""
    bounded_batches(docs.sparkSession)

    def sign(batch: pa.RecordBatch):
        data, offsets = text_buffer(batch.column(1))
        for i, j in slices(offsets, PART):  # at most ARROW_ROWS rows come in a batch
            part = data[offsets[i] : offsets[j]]
            row, h = shingles(part, offsets[i : j + 1] - offsets[i], shingle)
            sig, some = dart_signatures(row, h, j - i, bands * rows)
            key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (j - i, 1))
            for c in range(rows):
                key = mix(key * _GOLD + sig[:, c::rows])
            raw = part.tobytes()
            lo = offsets[i]
            content = [hashlib.md5(b" ".join(raw[a - lo : b - lo].split())).digest() for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1])]
            ends = np.concatenate([[0], np.cumsum(some * bands)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], pa.array(content, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key[some].view(np.int64).ravel()))],
                ["row", "content", "bands"],
            )

    return mapped(docs.select("row", "text"), sign, "row long, content binary, bands array<long>")


def similarity(a_row, a_h, b_row, b_h, pairs: int) -> np.ndarray:
    """Weighted Jaccard of each pair from the flat shingles of both sides."""
    (xr, x), (yr, y) = elements(a_row, a_h), elements(b_row, b_h)
    row, h = np.concatenate([xr, yr]), np.concatenate([x, y])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    both = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=pairs)
    total = np.bincount(row, minlength=pairs)
    return both / np.maximum(total - both, 1)


def linked(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts have a similarity of ``least`` or more."""

    def check(batch: pa.RecordBatch):
        (x, xo), (y, yo) = (text_buffer(batch.column(c)) for c in (2, 3))
        for i, j in slices(xo + yo, PART):
            (ra, ha), (rb, hb) = (shingles(d[o[i] : o[j]], o[i : j + 1] - o[i], shingle) for d, o in ((x, xo), (y, yo)))
            keep = pa.array(similarity(ra, ha, rb, hb, j - i) >= least)
            yield batch.slice(i, j - i).select(["a", "b"]).filter(keep)

    # texts follow the corpus: both joins are shuffles at any size
    both = pairs.join(texts.select(F.col("row").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")
    both = both.join(texts.select(F.col("row").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
    return mapped(both.select("a", "b", "ta", "tb"), check, "a long, b long")


def sketched(texts: DataFrame, shingle: int, words: int = SKETCH) -> DataFrame:
    """row, text, size (shingles), bits (bitmap of the hashed shingles as ``words`` numbers)."""

    def sketch(batch: pa.RecordBatch):
        data, offsets = text_buffer(batch.column(1))
        for i, j in slices(offsets, PART):
            row, h = elements(*shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle))
            bits = np.zeros((j - i, 64 * words), bool)
            bits[row, (h % np.uint64(64 * words)).astype(np.int64)] = True
            flat = np.packbits(bits, axis=1).view(np.int64).ravel()
            limits = pa.array(np.arange(0, len(flat) + 1, words), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(np.bincount(row, minlength=j - i), pa.int64()), pa.ListArray.from_arrays(limits, pa.array(flat))], ["row", "text", "size", "bits"])

    return mapped(texts.select("row", "text"), sketch, "row long, text string, size long, bits array<long>")


def may_link(x: str, y: str, least: float) -> F.Column:
    """Whether sizes and sketches of both sides allow a similarity of ``least``: an upper bound, so it is never wrong on a link."""
    c = lambda side, name: F.col(f"{side}.{name}")
    only = lambda a, b: F.aggregate(F.zip_with(c(a, "bits"), c(b, "bits"), lambda u, v: F.bit_count(u.bitwiseAND(F.bitwise_not(v)))), F.lit(0), lambda s, n: s + n)
    total, low, high = c(x, "size") + c(y, "size"), F.least(c(x, "size"), c(y, "size")), F.greatest(c(x, "size"), c(y, "size"))
    common = F.least(c(x, "size") - only(x, y), c(y, "size") - only(y, x))
    return (low >= least * high - 1e-6) & (common >= least * (total - common) - 1e-6)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label): the least node of each connected component, by rounds of label propagation with jumps.

    Each round is a written table; only whether anything changed comes to the driver.
    """
    both = written(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct(), name)
    labels = written(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")).withColumnRenamed("x", "node"), name)
    while True:
        other = labels.select(F.col("node").alias("y"), F.col("label").alias("l"))
        near = both.join(other, "y").groupBy("x").agg(F.min("l").alias("l")).withColumnRenamed("x", "node")
        step = written(labels.join(near, "node").select("node", "label", F.least("label", "l").alias("new")), name)
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        after = written(step.join(jump, "new").select("node", F.least("new", "far").alias("label"), (F.least("new", "far") < F.col("label")).alias("moved")), name)
        discard(labels, step)
        labels = after
        if not labels.filter("moved").limit(1).count():
            discard(both)
            return labels.select("node", "label")


def joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels`` (node, label) after further edges (a, b) between their nodes or nodes without a label yet."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    ends = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    roots = components(ends, "joined").select(F.col("node").alias("label"), F.col("label").alias("root"))
    moved = labels.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    return moved.unionByName(roots.select(F.col("label").alias("node"), F.col("root").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))


def classes(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILAR, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(row, class_row) for every (row, text); ``row`` is unique and class_row is the least row of the class."""
    sig = written(signatures(docs, shingle, bands, rows), "signatures")
    contents = written(sig.groupBy("content").agg(F.min("row").alias("rep"), F.first("bands").alias("bands")), "contents")
    banded = contents.select("rep", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(banded.join(shared, "key").select("key", "rep", "n"), "members")
    # the star: each group's pivot is the member that meets most others in all its bands
    degree = members.groupBy("rep").agg(F.sum(F.col("n") - 1).alias("degree"))
    pivots = members.join(degree, "rep").groupBy("key").agg(F.max(F.struct("degree", (-F.col("rep")).alias("first"))).alias("top")).select("key", (-F.col("top.first")).alias("pivot"))
    pivots = written(pivots, "pivots")  # so that the join deals both sides itself and can split a large group
    star = members.join(pivots, "key").filter("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))
    pairs = written(star.distinct(), "pairs")
    # texts of candidates (and of a few others that share a slot) are picked in the scan, without a shuffle
    slot = F.pmod(F.xxhash64("row"), F.lit(SLOTS)).cast("int")
    slots_ = pairs.select(F.explode(F.array("a", "b")).alias("row")).select(slot.alias("slot")).distinct()
    texts = docs.select("row", "text", slot.alias("slot")).join(F.broadcast(slots_), "slot", "left_semi")
    texts = written(sketched(texts, shingle), "candidate-texts")
    edges = written(linked(pairs, texts, shingle, least), "edges")
    labels = written(components(edges), "labels")
    # groups that still hold several components: their members meet as far as the sketches allow
    marked = members.select("key", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    several = written(marked.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key"), "several")
    mixed = marked.join(several, "key").join(texts.select(F.col("row").alias("rep"), "size", "bits"), "rep")
    mixed = written(mixed, "mixed")
    met = mixed.alias("x").join(mixed.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.label") < F.col("y.label")) & may_link("x", "y", least))
    rest = met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    rest = written(rest.join(pairs, ["a", "b"], "left_anti"), "rest")
    more = written(linked(rest, texts, shingle, least), "more-edges")
    if more.limit(1).count():
        labels = joined(labels, more)
    final = contents.select("content", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    final = written(final.select("content", F.coalesce("label", "rep").alias("class_row")), "classes")
    discard(contents, members, pivots, pairs, texts, edges, several, mixed, rest, more)
    return sig.select("row", "content").join(final, "content").select("row", "class_row")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILAR, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, class_id (the first doc_id of the class; null if no row of it has one)."""
    own = numbered(docs)
    found = classes(own.select(F.col(ROW).alias("row"), "text"), shingle, least, bands, rows)
    if not hasattr(own, "_written_at"):  # the ids themselves are the keys
        return found.select(F.col("row").alias("doc_id"), F.col("class_row").alias("class_id"))
    ids = own.select(F.col(ROW).alias("row"), "doc_id")
    return found.join(ids, "row").join(ids.select(F.col("row").alias("class_row"), F.col("doc_id").alias("class_id")), "class_row").select("doc_id", "class_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each class, the one with the least id (null ids last), with all its columns."""
    own = numbered(docs)
    keep = classes(own.select(F.col(ROW).alias("row"), "text")).filter("row = class_row").select(F.col("row").alias(ROW))
    return own.join(keep, ROW, "left_semi").select(*docs.columns)
