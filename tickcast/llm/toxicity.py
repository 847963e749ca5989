"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

Landmarks are short character strings mined from a bounded labelled sample. The gap-weighted subsequence kernel
of order ``ORDER`` compares every distinct word with every landmark, so gaps and inserted characters lower
a value without removing it. A sentence's value for a landmark is the largest of its words'; the Nystroem map
(inverse root of the landmarks' kernel matrix) feeds a linear support vector machine trained on sentences:
in toxic documents the sentence that scores highest, in others all. A document scores as its worst sentence.

A kernel value counts only where a word holds the landmark's letters (all but one of six or more) and the value
reaches ``LEAST``; lower values are zero. Runs of single letters ("i d i o t") of one
document are also read as one word, over line and sentence ends too; each part counts for the sentence that it starts in.

Defined results: null and empty texts score as a text without any match; texts of any length are read whole; words and runs over 24 bytes
are read in overlapping parts; rows that repeat an id are each scored; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickcast.llm.common import bounded_batches, mapped, slices, text_buffer
from tickcast.llm.words import bounds, hashes, spans

#: Labelled documents of each class used to find landmarks and to train, at most; the first by hash of the id.
MINE, TRAIN = 500, 1000
LANDMARKS, ORDER, DECAY, LEAST = 64, 4, 0.6, 0.3
_PART = 24
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BIT = np.zeros(256, np.uint64)
for _b in range(1, 256):
    _BIT[_b] = np.uint64(1) << np.uint64(_b - 97 if 97 <= _b <= 122 else 26 + _b % 38)


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters in UTF-8."""
    out = _LOWER[data]
    if len(out) > 1:
        latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
        out[latin] += 32
    return out


def subsequence_kernel(words: np.ndarray, landmark: bytes, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of each row of ``words`` (bytes, zero padded) with the landmark."""
    t = np.frombuffer(landmark, np.uint8)
    n, size = words.shape
    steps = np.subtract.outer(np.arange(len(t)), np.arange(len(t))).T
    spread = np.where(steps >= 0, decay ** np.maximum(steps, 0), 0).astype(np.float32)
    prime = [np.ones((n, len(t) + 1), np.float32)] + [np.zeros((n, len(t) + 1), np.float32) for _ in range(order - 1)]
    total = np.zeros(n, np.float32)
    for s in range(size):
        same = (words[:, s : s + 1] == t).astype(np.float32) * np.float32(decay * decay)
        if not same.any():
            for i in range(1, order):
                prime[i] *= np.float32(decay)
            continue
        total += (same * prime[order - 1][:, :-1]).sum(1)
        for i in range(order - 1, 0, -1):
            prime[i] *= np.float32(decay)
            prime[i][:, 1:] += (same * prime[i - 1][:, :-1]) @ spread
    return total


def _rows(strings: list[bytes]) -> np.ndarray:
    out = np.zeros((len(strings), max(map(len, strings), default=1)), np.uint8)
    for i, x in enumerate(strings):
        out[i, : len(x)] = np.frombuffer(x, np.uint8)
    return out


def _self_values(landmarks: list[bytes]) -> np.ndarray:
    return np.array([subsequence_kernel(_rows([x]), x)[0] for x in landmarks], np.float32)


def word_values(words: np.ndarray, landmarks: list[bytes], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows with any value, their values by landmark), 1 for a landmark that is found whole."""
    masks = np.zeros(len(words), np.uint64)
    for c in range(words.shape[1]):
        masks |= _BIT[words[:, c]]
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    some = np.zeros(len(words), bool)
    for k, x in enumerate(landmarks):
        letters = np.bitwise_or.reduce(_BIT[np.frombuffer(x, np.uint8)])
        spare = 1 if bin(int(letters)).count("1") >= 6 else 0
        at = np.flatnonzero(np.bitwise_count(~masks & letters) <= spare)
        if len(at):
            v = np.minimum(subsequence_kernel(words[at], x) / own[k], 1)
            keep = v >= LEAST
            if keep.any():
                found.append((k, at[keep], v[keep]))
                some[at[keep]] = True
    rows = np.flatnonzero(some)
    number = np.cumsum(some) - 1
    out = np.zeros((len(rows), len(landmarks)), np.float32)
    for k, at, v in found:
        out[number[at], k] = v
    return rows, out


def _parts(low: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words in overlapping parts of 24 bytes, each with marks for the word's start (1) and end (2): (rows, word, place in the word)."""
    parts = 1 + np.maximum(0, -(-(size - _PART) // (_PART // 2)))
    word = np.repeat(np.arange(len(start)), parts)
    within = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = within * (_PART // 2)
    length = np.minimum(size[word] - begin, _PART)
    m = np.zeros((len(word), _PART + 2), np.uint8)
    col = np.arange(_PART)
    inside = col < length[:, None]
    m[:, 1 : _PART + 1] = np.where(inside, low[np.minimum((start[word] + begin)[:, None] + col, len(low) - 1)], 0)
    m[:, 0] = within == 0
    last = begin + length == size[word]
    m[np.flatnonzero(last), length[last] + 1] = 2
    return m, word, begin


def sentence_values(data: np.ndarray, offsets: np.ndarray, landmarks: list[bytes], own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, values by landmark) of every sentence that has any value, rows in order; words of each row."""
    low = lower(data)
    s, e, doc = spans(low, offsets)
    n_words = np.diff(bounds(doc, len(offsets) - 1))
    none = np.zeros(0, np.int64), np.zeros((0, len(landmarks)), np.float32), n_words
    if not len(s) or not landmarks:
        return none
    lines = np.cumsum(data == 10)
    stop = np.isin(data[e - 1], np.frombuffer(b".!?", np.uint8))
    begins = np.ones(len(s), bool)
    begins[1:] = (doc[1:] != doc[:-1]) | stop[:-1] | (lines[s[1:]] != lines[s[:-1]])
    sentence = np.cumsum(begins) - 1
    h = hashes(low, s, e)
    # runs of three or more single letters of one document are also one word
    letters = np.flatnonzero(e - s == 1)
    spelled = np.flatnonzero((np.diff(letters, prepend=-2) != 1) | (np.diff(doc[letters], prepend=-1) != 0))
    many = np.diff(spelled, append=len(letters))
    spelled, many = spelled[many >= 3], many[many >= 3]
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    start, size = s[first], e[first] - s[first]
    m, word, _ = _parts(low, start, size)
    at, values = word_values(m, landmarks, own)
    best = np.full(len(first), -1, np.int64)
    if len(at):
        w = word[at]
        cut = np.flatnonzero(np.diff(w, prepend=-1))
        best[w[cut]] = np.arange(len(cut))
        values = np.maximum.reduceat(values, cut, axis=0)
    where = np.flatnonzero(best[inverse] >= 0)
    of, got = sentence[where], values[best[inverse[where]]] if len(at) else values
    if len(spelled):
        m, run, begin = _parts(low[s[letters]], spelled, many)
        xa, xv = word_values(m, landmarks, own)
        of = np.concatenate([of, sentence[letters[(spelled[run] + begin)[xa]]]]) if len(xa) else of
        got = np.concatenate([got, xv]) if len(xa) else got
    if not len(of):
        return none
    order = np.argsort(of, kind="stable")
    of, got = of[order], got[order]
    cut = np.flatnonzero(np.diff(of, prepend=-1))
    return doc[np.flatnonzero(begins)[of[cut]]], np.maximum.reduceat(got, cut, axis=0), n_words


def _grams(text: str) -> set[bytes]:
    low = lower(np.frombuffer((text or "").encode(), np.uint8)).tobytes()
    out = set()
    for w in set(low.split()):
        w = b"\1" + w + b"\2"
        for n in (5, 6, 7, 8):
            out.update(w[i : i + n] for i in range(len(w) - n + 1))
    return out


def mine(texts: list[str], labels: list[int], most: int = LANDMARKS) -> list[bytes]:
    """Strings of 5 to 8 characters that mark toxic texts: greedy weighted cover, each cover halves a text's weight."""
    toxic = [_grams(t) for t, y in zip(texts, labels) if y]
    clean = [t for t, y in zip(texts, labels) if not y]
    seen = Counter(g for s in toxic for g in s)
    least = max(2, len(toxic) // 150)
    some = {g: k for k, g in enumerate(sorted(g for g, n in seen.items() if n >= least))}
    if not some:
        return []
    other = np.zeros(len(some))
    for t in clean:
        for g in _grams(t):
            k = some.get(g)
            if k is not None:
                other[k] += 1
    good = [g for g, k in some.items() if other[k] / max(1, len(clean)) <= 0.1 * seen[g] / max(1, len(toxic))]
    has = np.array([[g in s for s in toxic] for g in good], np.float32).reshape(len(good), len(toxic))
    penalty = np.array([2.0 * other[some[g]] * len(toxic) / max(1, len(clean)) for g in good])
    weight, chosen = np.ones(len(toxic), np.float32), []
    for _ in range(min(most, len(good))):
        gain = has @ weight - penalty
        k = int(np.argmax(gain))
        if gain[k] <= 0.5:
            break
        chosen.append(good[k])
        weight[has[k] > 0] *= 0.5
        has[k] = 0
    return chosen


@dataclass
class ToxicModel:
    """Landmarks, weights on their kernel values and the map to a probability: at most 64 strings and numbers."""

    landmarks: list[bytes]
    own: np.ndarray
    v: np.ndarray
    b: float
    last: np.ndarray

    def margins(self, row: np.ndarray, values: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        return summary(row, values @ self.v + self.b, self.b, n_words)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(-(x @ self.last), -60, 60)))


def summary(row: np.ndarray, f: np.ndarray, b: float, n_words: np.ndarray) -> np.ndarray:
    """Per document: 1, its worst sentence's margin, how much its sentences exceed the plain margin, its length."""
    x = np.zeros((len(n_words), 4))
    x[:, 0], x[:, 1], x[:, 3] = 1, b, np.log1p(n_words)
    np.maximum.at(x[:, 1], row, f)
    x[:, 2] = np.log1p(np.bincount(row, np.maximum(f - b, 0), len(n_words)))
    return x


def fit(examples: list[tuple[int, np.ndarray, int]], landmarks: list[bytes], rounds: int = 4, steps: int = 400) -> ToxicModel:
    """Support vector machine over sentences (label of the document, values of its sentences, its words)."""
    own = _self_values(landmarks)
    share = np.mean([e[0] for e in examples]) if examples else 0.5
    if not landmarks or share in (0, 1):
        return ToxicModel([], np.zeros(0, np.float32), np.zeros(0), 0.0, np.array([4 * (share - 0.5), 0, 0, 0]))
    gram = np.array([np.minimum(subsequence_kernel(_rows(landmarks), x) / own[k], 1) for k, x in enumerate(landmarks)])
    gram = (gram + gram.T) / 2
    val, vec = np.linalg.eigh(gram)
    root = vec / np.sqrt(np.maximum(val, 1e-2)) @ vec.T
    y = np.array([e[0] for e in examples])
    values = [np.concatenate([np.zeros((1, len(landmarks))), e[1]]) for e in examples]
    counts = np.array([len(x) for x in values])
    phi = np.concatenate(values) @ root
    begin, doc = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
    w, b = root @ np.ones(len(landmarks)) / len(landmarks), 0.0
    for _ in range(rounds):
        f = phi @ w + b
        top = np.maximum.reduceat(f, begin)
        witness = (f == top[doc]) & (y[doc] == 1) & (np.arange(len(f)) != begin[doc])
        use = witness | (y[doc] == 0)
        x, t = phi[use], np.where(witness[use], 1.0, -1.0)
        weight = np.where(t > 0, 0.5 / max(1, (t > 0).sum()), 0.5 / max(1, (t < 0).sum()))
        w, b, mw, mb = np.zeros_like(w), 0.0, np.zeros_like(w), 0.0
        for k in range(1, steps + 1):  # averaged subgradient steps on the hinge loss
            active = (t * (x @ w + b) < 1) * weight * t
            rate = 4.0 / np.sqrt(k)
            w = w + rate * (x.T @ active - 1e-4 * w)
            b = b + rate * active.sum()
            mw, mb = mw + w * k, mb + b * k
        w, b = mw * 2 / (steps * (steps + 1)), mb * 2 / (steps * (steps + 1))
    rest = np.arange(len(doc)) != begin[doc]
    x = summary(doc[rest], (phi @ w + b)[rest], float(b), np.array([e[2] for e in examples]))
    last = np.zeros(4)
    for _ in range(200):  # ridge logistic regression by Newton steps
        q = 1 / (1 + np.exp(-np.clip(x @ last, -30, 30)))
        g = x.T @ (y - q) - 1e-2 * last
        step = np.linalg.solve(x.T * (q * (1 - q)) @ x + 1e-2 * np.eye(4), g)
        last = last + np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return ToxicModel(landmarks, own, root @ w, float(b), last)


def _sample(docs: DataFrame, labels: DataFrame, learn, each: int) -> DataFrame:
    some = labels.filter(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("label"))
    parts = [some.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for y in (0, 1)]
    return docs.select("doc_id", "text").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")


def train(docs: DataFrame, labels: DataFrame, learn=None, mine_each: int = MINE, train_each: int = TRAIN) -> ToxicModel:
    """Train on bounded samples of labelled documents; ``learn`` is a column over doc_id that admits them."""
    bounded_batches(docs.sparkSession)
    learn = F.lit(True) if learn is None else learn

    def find(t: pa.Table) -> pa.Table:
        t = t.sort_by("doc_id")
        return pa.table({"landmark": pa.array(mine(t["text"].to_pylist(), t["label"].to_pylist()), pa.binary())})

    landmarks = [bytes(r[0]) for r in _sample(docs, labels, learn, mine_each).withColumn("one", F.lit(0)).groupBy("one").applyInArrow(find, "landmark binary").collect()]
    own = _self_values(landmarks)

    def values(batch: pa.RecordBatch):
        row, v, n_words = sentence_values(*text_buffer(batch.column(1)), landmarks, own)
        cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
        out = [v[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary()), pa.array(n_words, pa.int64())], ["doc_id", "label", "v", "n"])

    found = mapped(_sample(docs, labels, learn, train_each).select("doc_id", "text", "label"), values, "doc_id long, label int, v binary, n long").collect()
    found.sort(key=lambda r: (r["doc_id"], r["label"]))
    model = fit([(r["label"], np.frombuffer(r["v"], np.float32).reshape(-1, len(landmarks)).astype(float) if landmarks else np.zeros((0, 0)), r["n"]) for r in found], landmarks)
    # the sample holds toxic documents beyond their share among all labels
    share, here = labels.filter(learn).agg(F.avg(F.col("toxic").cast("double"))).first()[0], np.mean([r["label"] for r in found]) if found else 0
    if share and 0 < share < 1 and 0 < here < 1:
        model.last[0] += np.log(share / (1 - share)) - np.log(here / (1 - here))
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, score, margin of every row; one pass, no shuffle."""
    bounded_batches(docs.sparkSession)

    def score(batch: pa.RecordBatch):
        data, offsets = text_buffer(batch.column(1))
        for i, j in slices(offsets, 4 << 20):
            x = model.margins(*sentence_values(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], model.landmarks, model.own))
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(model.probability(x)), pa.array(x[:, 1].copy())], ["doc_id", "score", "margin"])

    return mapped(docs.select("doc_id", "text"), score, "doc_id long, score double, margin double")
