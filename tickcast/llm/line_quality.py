"""Document quality from a linear-chain conditional random field over lines.

Each line is a node with label good or bad. Its potentials come from its own shape and from the shapes
of the lines before and after it; a transition matrix links neighbouring labels. A document's badness is
the mean of its lines' forward-backward marginals, weighted by length; a logistic map makes it a score.

Defined results: null and empty texts are one empty line and get a score like any other; a text of
any length is scored whole; rows that repeat an id are each scored; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickcast.llm.common import bounded_batches, mapped, slices, text_buffer

#: Labelled documents that training may use at most; they are the first by hash of the id.
SAMPLE = 2000
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*+=<>@^_~`\\{}[]", b"|/", b"!?", b".,;:'\"()-", b" \t"]
_LUT = np.full(256, len(_CLASSES), np.uint8)
for _k, _chars in enumerate(_CLASSES):
    _LUT[list(_chars)] = _k
#: Shape features of one line; a node also sees those of both neighbours.
SHAPES = len(_CLASSES) + 4


def line_shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features with neighbours, weights, lines per row) of all lines of all rows, in order."""
    rows = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    # a row's last line ends at the row's end, every other line at its break
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    counts = 1 + np.diff(np.searchsorted(breaks, offsets))
    size = (ends - starts).astype(np.float64)
    kinds = _LUT[data]
    some = np.maximum(size, 1)
    own = np.zeros((len(starts), SHAPES))
    for k in range(len(_CLASSES)):
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kinds == k, out=total[1:])
        own[:, k] = (total[ends] - total[starts]) / some
    own[:, -4] = np.log1p(size) / 5
    own[:, -3] = np.minimum(1.0 / np.maximum(own[:, len(_CLASSES) - 1], 0.02), 30) / 10  # mean word length
    last = data[np.maximum(ends - 1, 0)] if len(data) else np.zeros(len(ends), np.uint8)
    own[:, -2] = (size > 0) & np.isin(last, np.frombuffer(b".!?:", np.uint8))
    own[:, -1] = size == 0
    first = np.zeros(len(starts), bool)
    first[np.cumsum(counts) - counts] = True
    final = np.zeros(len(starts), bool)
    final[np.cumsum(counts) - 1] = True
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first], after[final] = 0, 0
    x = np.concatenate([own, before, after, first[:, None], np.ones((len(starts), 1))], axis=1)
    assert rows == len(counts)
    return x, size + 1, counts


def _steps(counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows by falling length, and for each step the flat places of the rows that reach it."""
    order = np.argsort(-counts, kind="stable")
    begin = (np.cumsum(counts) - counts)[order]
    long = counts[order]
    alive = np.searchsorted(-long, -np.arange(1, (long[0] if len(long) else 0) + 1), side="right")
    return order, [begin[:n] + t for t, n in enumerate(alive)]


def marginals(unary: np.ndarray, trans: np.ndarray, counts: np.ndarray, pairs: bool = False):
    """P(good) of each line, log Z of each row (by falling length) and, if asked, summed pair marginals."""
    u = np.stack([np.zeros_like(unary), unary], axis=1)
    alpha, beta = np.zeros_like(u), np.zeros_like(u)
    order, steps = _steps(counts)
    for t, at in enumerate(steps):
        if t:
            a = alpha[steps[t - 1][: len(at)]]
            alpha[at] = np.logaddexp(a[:, :1] + trans[0], a[:, 1:] + trans[1]) + u[at]
        else:
            alpha[at] = u[at]
    for t in range(len(steps) - 2, -1, -1):
        nxt = steps[t + 1]
        b = beta[nxt] + u[nxt]
        beta[steps[t][: len(nxt)]] = np.logaddexp(b[:, :1] + trans[:, 0], b[:, 1:] + trans[:, 1])
    z = alpha + beta
    p = 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -60, 60)))
    if not pairs:
        return p
    both = np.zeros((2, 2))
    for t in range(1, len(steps)):
        at, prev = steps[t], steps[t - 1][: len(steps[t])]
        e = alpha[prev][:, :, None] + trans + (u[at] + beta[at])[:, None, :]
        e = np.exp(e - e.reshape(len(at), 4).max(1)[:, None, None])
        both += (e / e.sum((1, 2), keepdims=True)).sum(0)
    return p, both


@dataclass
class LineField:
    """Weights of the field and of the logistic map; a few hundred numbers, so it is shipped with the tasks."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    trans: np.ndarray
    a: float
    b: float

    def badness(self, x: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = marginals((x - self.mean) / self.scale @ self.w, self.trans, counts)
        begin = np.cumsum(counts) - counts
        return np.add.reduceat((1 - p) * weights, begin) / np.add.reduceat(weights, begin), p

    def score(self, bad: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(-(self.a + self.b * bad), -60, 60)))


def fit(examples: list[tuple[int, np.ndarray, np.ndarray]], rounds: int = 3, steps: int = 60) -> LineField:
    """Fit on (label, features, weights) of whole documents.

    Lines begin with their document's label. After each round the lines of bad documents take the label the
    field gives them, but for at least the worst one, since bad documents hold some good lines.
    """
    if not examples or len({y for y, _, _ in examples}) < 2:
        dims = 3 * SHAPES + 2
        p = np.mean([y for y, _, _ in examples]) if examples else 0.5
        return LineField(np.zeros(dims), np.ones(dims), np.zeros(dims), np.zeros((2, 2)), 4.0 * (p - 0.5), 0.0)
    y = np.array([e[0] for e in examples], float)
    x = np.concatenate([e[1] for e in examples])
    weights = np.concatenate([e[2] for e in examples])
    counts = np.array([len(e[1]) for e in examples])
    begin, row = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    mean[-1], scale[-1] = 0, 1
    x = (x - mean) / scale
    lines = np.repeat(y, counts)
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    inner = np.ones(len(x), bool)
    inner[begin] = False
    at = np.flatnonzero(inner)
    for r in range(rounds):
        m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
        pair = lines[at - 1].astype(int) * 2 + lines[at].astype(int)
        seen = np.bincount(pair, minlength=4)[:4].reshape(2, 2)
        for k in range(1, steps + 1):
            p, both = marginals(x @ w, trans, counts, pairs=True)
            g = np.concatenate([x.T @ (lines - p), (seen - both).ravel()]) / len(x) - 1e-3 * np.concatenate([w, trans.ravel()])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
            w, trans = w + step[:-4], trans + step[-4:].reshape(2, 2)
        p = marginals(x @ w, trans, counts)
        worst = np.minimum.reduceat(p, begin)
        if r < rounds - 1:
            lines = np.where(np.repeat(y, counts) > 0, 1.0, ((p > 0.5) & (p > worst[row])).astype(float))
    bad = np.add.reduceat((1 - p) * weights, begin) / np.add.reduceat(weights, begin)
    a, b = 0.0, 0.0
    for _ in range(500):  # ridge logistic regression in one variable, by Newton steps
        q = 1 / (1 + np.exp(-np.clip(a + b * bad, -30, 30)))
        g = np.array([(y - q).sum() - 1e-3 * a, ((y - q) * bad).sum() - 1e-2 * b])
        h = q * (1 - q)
        step = np.linalg.solve([[h.sum() + 1e-3, (h * bad).sum()], [(h * bad).sum(), (h * bad * bad).sum() + 1e-2]], g)
        a, b = a + np.clip(step[0], -2, 2), b + np.clip(step[1], -2, 2)
        if abs(step).max() < 1e-8:
            break
    return LineField(mean, scale, w, trans, float(a), float(b))


def training_examples(docs: DataFrame, labels: DataFrame, label: str, learn, sample: int) -> DataFrame:
    """At most ``sample`` labelled documents (doc_id, text, label) that ``learn`` admits, first by hash of the id."""
    some = labels.filter(learn & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, learn=None, sample: int = SAMPLE) -> LineField:
    """Train on a bounded sample of labelled documents; ``learn`` is a column over doc_id that admits them."""
    bounded_batches(docs.sparkSession)
    chosen = training_examples(docs, labels, "quality", F.lit(True) if learn is None else learn, sample)

    def shapes(batch: pa.RecordBatch):
        x, weights, counts = line_shapes(*text_buffer(batch.column(1)))
        ends = np.cumsum(counts)
        out = [x[e - n : e].astype(np.float32).tobytes() for e, n in zip(ends, counts)]
        wts = [weights[e - n : e].tobytes() for e, n in zip(ends, counts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary()), pa.array(wts, pa.binary())], ["doc_id", "label", "x", "w"])

    found = mapped(chosen.select("doc_id", "text", "label"), shapes, "doc_id long, label int, x binary, w binary").collect()
    found.sort(key=lambda r: (r["doc_id"], r["label"]))
    return fit([(r["label"], np.frombuffer(r["x"], np.float32).reshape(-1, 3 * SHAPES + 2).astype(float), np.frombuffer(r["w"])) for r in found])


def score_quality(docs: DataFrame, model: LineField) -> DataFrame:
    """doc_id, score, bad_share (length-weighted), n_lines, n_bad_lines of every row; no shuffle."""
    bounded_batches(docs.sparkSession)

    def score(batch: pa.RecordBatch):
        data, offsets = text_buffer(batch.column(1))
        for i, j in slices(offsets, 6 << 20):
            x, weights, counts = line_shapes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            bad, p = model.badness(x, weights, counts)
            n_bad = np.add.reduceat((p < 0.5).astype(np.int64), np.cumsum(counts) - counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], pa.array(model.score(bad)), pa.array(bad), pa.array(counts.astype(np.int64)), pa.array(n_bad)],
                ["doc_id", "score", "bad_share", "n_lines", "n_bad_lines"],
            )

    return mapped(docs.select("doc_id", "text"), score, "doc_id long, score double, bad_share double, n_lines long, n_bad_lines long")


def keep_good(docs: DataFrame, model: LineField, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns; one pass, no shuffle."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def keep(batch: pa.RecordBatch):
        data, offsets = text_buffer(batch.column(at))
        for i, j in slices(offsets, 6 << 20):
            x, weights, counts = line_shapes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield batch.slice(i, j - i).filter(pa.array(model.score(model.badness(x, weights, counts)[0]) >= least))

    return mapped(docs, keep, docs.schema)
