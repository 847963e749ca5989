"""Substring deduplication with repeated-phrase automata.

A window is ``WINDOW`` consecutive words of one document. A word goes if some window over it has a word
sequence that also starts earlier (smaller id, or same document and earlier start).

1. Winnowing gives each window one phrase of ``PHRASE`` words (the least hash among its phrases), so equal
   windows have equal phrases. Each block of documents sends the hashes of its distinct chosen phrases, packed by hash range, with
   one place where each stands.
2. Phrases that recur anywhere are confirmed, and the places go back to their blocks. A block compiles its confirmed phrases into an
   Aho-Corasick automaton over the words' hashes and streams all its documents through it, which locates every occurrence of every one.
   The blocks are the automata's shards: a phrase that can occur in a document is in the one automaton that the document meets.
3. The windows around the occurrences are compared across blocks by the MD5 digests of their words; only a block's first
   occurrence of a digest travels, and one bit pair per digest comes back.
4. Covered words go.

Memory is bounded by the block size; every shuffle is by block or by hash range, so that a passage held by a
third of all documents weighs one entry per block. A message holds all entries that a block has for a hash range, and none is empty.

Defined results: null and empty texts have no words; documents below ``WINDOW`` words keep all; windows never cross documents;
of documents that share one id the words count as separate documents, in an arbitrary order, those without an id after all others; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickcast.llm.common import blocks, bounded_batches, pack, partitions, slices, text_buffer, unpack, written
from tickcast.llm.words import bounds, grams, hashes, spans

WINDOW, PHRASE = 20, 10
#: MB of text in a block.
BLOCK_MB = 4
#: Symbols of four bits that stand for a word in the automata; small alphabets keep their nodes narrow.
SYMBOLS = 4


def _block(n: int):
    """Rows of one id may fall into several blocks, so that no id fills one."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")


def _words(column: pa.Array):
    """Hashes and per-row limits of a column's words, a few MB of text at a time."""
    data, offsets = text_buffer(column)
    found, limits = [], [np.zeros(1, np.int64)]
    for i, j in slices(offsets):
        part = data[offsets[i] : offsets[j]]
        s, e, doc = spans(part, offsets[i : j + 1] - offsets[i])
        found.append(hashes(part, s, e))
        limits.append(bounds(doc, j - i)[1:] + limits[-1][-1])
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.concatenate(limits)


def _inside(limits: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of the n-k+1 runs of k words lie in one row."""
    ok = np.ones(max(0, n - k + 1), bool)
    for e in limits[1:-1]:
        ok[max(0, e - k + 1) : e] = False
    return ok


def _designated(w: np.ndarray, limits: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the place of each one's phrase, and all phrase hashes. Ties: the first."""
    g = grams(w, phrase)
    ok = _inside(limits, len(w), window)
    if not ok.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), g
    n = len(ok)
    least, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window - phrase + 1):
        x = g[j : j + n]
        better = x < least
        least[better] = x[better]
        at[better] = j
    starts = np.flatnonzero(ok)
    return starts, starts + at[starts], g


def _by_range(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _cuts(own: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of the runs in a sorted array of buckets."""
    at = np.flatnonzero(np.diff(own, prepend=-1))
    return list(zip(own[at].tolist(), at.tolist(), [*at[1:].tolist(), len(own)]))


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)


def _ordered(rows: pa.Table) -> pa.Table:
    """A block's rows in the order of their documents; nulls last."""
    return rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])


_CHOSEN = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("h", pa.binary()), ("at", pa.binary()), ("twice", pa.binary())])


def _chosen_phrases(buckets: int, window: int, phrase: int):
    """One block: for each hash range the hashes of its chosen phrases, a place of each, and whether it occurs twice or more."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        w, limits = _words(_ordered(rows)["text"])
        _, at, g = _designated(w, limits, window, phrase)
        places = np.unique(at)
        h, first, n = np.unique(g[places], return_index=True, return_counts=True)
        first = places[first].astype(np.int32)
        own = _by_range(h << np.uint64(32), buckets)  # by the lower half: chosen hashes are the least ones
        to = np.argsort(own, kind="stable")
        own, h, first, n = own[to], h[to], first[to], n[to]
        out = []
        for b, i, j in _cuts(own):
            out.append((b, key[0].as_py(), h[i:j].tobytes(), first[i:j].tobytes(), np.packbits(n[i:j] > 1).tobytes()))
        return _table(_CHOSEN, out)

    return run


def _recurring(rows: pa.Table) -> pa.Table:
    """One hash range: for each block the places of its phrases that occur twice or more anywhere."""
    h = [np.frombuffer(x.as_py(), np.uint64) for x in rows["h"]]
    at = [np.frombuffer(x.as_py(), np.int32) for x in rows["at"]]
    twice = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(p)) for x, p in zip(rows["twice"], h)]
    _, inverse = np.unique(np.concatenate(h), return_inverse=True)
    again = (np.bincount(inverse, 1 + np.concatenate(twice)) >= 2)[inverse]
    ends = np.cumsum([0, *map(len, h)])
    mine = [p[again[i:j]] for p, i, j in zip(at, ends[:-1], ends[1:])]
    out = [(b, p.tobytes()) for b, p in zip(rows["block"].to_pylist(), mine) if len(p)]
    return _table(pa.schema([("block", pa.int32()), ("at", pa.binary())]), out)


def occurrences(w: np.ndarray, at: np.ndarray, phrase: int) -> np.ndarray:
    """Starts of all occurrences, in the word sequence, of the phrases that stand at the given places: one pass of an automaton."""
    symbols = np.stack([(w >> np.uint64(60 - 4 * k)).astype(np.uint8) & np.uint8(15) for k in range(SYMBOLS)], axis=1).tobytes().decode("latin-1")
    auto = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in at.tolist():
        auto.add_word(symbols[SYMBOLS * p : SYMBOLS * (p + phrase)])
    auto.make_automaton()
    ends = np.fromiter((end for end, _ in auto.iter(symbols)), np.int64) + 1
    return ends[ends % SYMBOLS == 0] // SYMBOLS - phrase


def _digests(column: pa.Array, starts: np.ndarray, window: int) -> np.ndarray:
    """MD5 of the words of each window, one space between words, as n x 2 numbers; starts rise."""
    data, offsets = text_buffer(column)
    out, first = [], 0
    for i, j in slices(offsets):
        part = data[offsets[i] : offsets[j]]
        s, e, _ = spans(part, offsets[i : j + 1] - offsets[i])
        mine = starts[np.searchsorted(starts, first) : np.searchsorted(starts, first + len(s))] - first
        first += len(s)
        if not len(mine):
            continue
        size = e - s + 1
        ends = np.cumsum(size)
        flat = np.full(ends[-1], 32, np.uint8)
        flat[np.arange(len(flat)) - np.repeat(ends - size, size) < np.repeat(size - 1, size)] = part[np.repeat(s - (ends - size) + np.arange(len(s)), size - 1) + np.arange(len(flat) - len(s))]
        raw = memoryview(flat.tobytes())
        md5 = hashlib.md5
        out.append(b"".join([md5(raw[a:b]).digest() for a, b in zip((ends - size)[mine].tolist(), (ends[mine + window - 1] - 1).tolist())]))
    return np.frombuffer(b"".join(out), np.uint64).reshape(-1, 2)


_FOUND = pa.schema([("kind", pa.int32()), ("block", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])


def _locate(buckets: int, window: int, phrase: int):
    """One block: candidate windows. Rows of kind 0 carry digests to a hash range, rows of kind 1 stay with the block."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        block = key[0].as_py()
        if not left.num_rows or not right.num_rows:
            return _table(_FOUND, [])
        left = _ordered(left)
        ids, null = left["doc_id"].fill_null(0).to_numpy(), left["doc_id"].is_null().to_numpy()
        w, limits = _words(left["text"])
        hits = occurrences(w, np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in right["at"]]), phrase)
        # windows that hold an occurrence and lie in one document
        begin, size = np.maximum(hits - (window - phrase), 0), len(w) + 1
        edge = np.bincount(begin, minlength=size) - np.bincount(hits + 1, minlength=size)
        starts = np.flatnonzero((np.cumsum(edge)[: max(0, len(w) - window + 1)] > 0) & _inside(limits, len(w), window))
        if not len(starts):
            return _table(_FOUND, [])
        k1, k2 = _digests(left["text"], starts, window).T
        by = np.lexsort((k2, k1))  # stable, so each key's first place comes first
        new = np.ones(len(by), bool)
        new[1:] = (np.diff(k1[by]) != 0) | (np.diff(k2[by]) != 0)
        first, inverse = by[new], np.empty(len(by), np.int64)
        inverse[by] = np.cumsum(new) - 1
        n = np.bincount(inverse)
        # keys in order of their first place: documents and starts then pack to almost nothing
        order = np.argsort(first, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        first, n, number = first[order], n[order], rank[inverse]
        keys = np.stack([k1[first], k2[first]], axis=1)
        row = np.searchsorted(limits, starts[first], side="right") - 1
        own = _by_range(keys[:, 0], buckets)
        many = (n > 1).astype(np.uint8) | (null[row].astype(np.uint8) << 1)
        to = np.argsort(own, kind="stable")
        out = [(0, block, b, j - i, keys[to[i:j]].tobytes(), pack(ids[row[to[i:j]]]), pack(many[to[i:j]]), b"") for b, i, j in _cuts(own[to])]
        out.append((1, block, -1, len(starts), pack(np.diff(starts, prepend=0)), pack(np.diff(number, prepend=0)), pack(own.astype(np.int32)), pack(first)))
        return _table(_FOUND, out)

    return run


def _firsts(rows: pa.Table) -> pa.Table:
    """One hash range: for each block, in the order it sent, whether a digest recurs and whether its first place is there."""
    sizes = rows["n"].to_pylist()
    keys = np.concatenate([np.frombuffer(x.as_py(), np.uint64).reshape(-1, 2) for x in rows["a"]])
    doc = np.concatenate([unpack(x.as_py(), np.int64, n) for x, n in zip(rows["b"], sizes)])
    many = np.concatenate([unpack(x.as_py(), np.uint8, n) for x, n in zip(rows["c"], sizes)])
    order = np.lexsort((np.repeat(rows["block"].to_numpy(), sizes), doc, many >> 1, keys[:, 1], keys[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
    group = np.cumsum(new) - 1
    again = (np.bincount(group, 1 + (many[order] & 1)) >= 2)[group]
    flags = np.zeros(len(order), np.uint8)
    flags[order] = again.astype(np.uint8) | (new.astype(np.uint8) << 1)
    cut = np.cumsum([0, *sizes])
    return _table(_FOUND, [(2, a, b, n, pack(flags[i:j]), b"", b"", b"") for a, b, n, i, j in zip(rows["block"].to_pylist(), rows["bucket"].to_pylist(), sizes, cut[:-1], cut[1:])])


def _remove(window: int, with_text: bool):
    """One block: the documents without their covered words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = _ordered(left)
        texts = [(x.as_py() or "").encode() for x in left["text"]]
        total = sum(len(x.split()) for x in texts) if right.num_rows else 0
        gone = np.zeros(total + 1, np.int64)
        place = next((r for r in right.to_pylist() if r["kind"] == 1), None)
        if place:
            n = place["n"]
            starts, number = np.cumsum(unpack(place["a"], np.int64, n)), np.cumsum(unpack(place["b"], np.int64, n))
            keys = int(number.max()) + 1
            own, first = unpack(place["c"], np.int32, keys), unpack(place["d"], np.int64, keys)
            flags = np.zeros(keys, np.uint8)
            answers = sorted((r["bucket"], r["n"], r["a"]) for r in right.to_pylist() if r["kind"] == 2)
            flags[np.argsort(own, kind="stable")] = np.concatenate([unpack(x, np.uint8, k) for _, k, x in answers])
            f = flags[number]
            stays = (f & 2 > 0) & (first[number] == np.arange(n))
            dead = starts[(f & 1 > 0) & ~stays]
            np.add.at(gone, dead, 1)
            np.add.at(gone, np.minimum(dead + window, total), -1)
        covered = np.cumsum(gone) > 0
        at, n_words, n_removed, digests, kept_texts = 0, [], [], [], []
        for x in texts:
            words = x.split()
            mask = covered[at : at + len(words)] if place else None
            at += len(words)
            n_words.append(len(words))
            n_removed.append(int(mask.sum()) if place else 0)
            kept = b" ".join(compress(words, ~mask) if place and n_removed[-1] else words)
            digests.append(hashlib.sha256(kept).hexdigest())
            # untouched documents keep their text as it is
            kept_texts.append((kept if n_removed[-1] else x).decode() if with_text else None)
        out = {"doc_id": left["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(out | ({"kept_text": pa.array(kept_texts, pa.string())} if with_text else {}))

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of every document."""
    if not 0 < phrase < window:
        raise ValueError("phrase must be shorter than window")
    spark = docs.sparkSession
    bounded_batches(spark)
    n_blocks, buckets = blocks(docs, "text", BLOCK_MB), partitions(docs)
    # all three uses read the same columns, so one exchange serves them
    dealt = docs.select(_block(n_blocks).alias("block"), "text", "doc_id").repartition(n_blocks, "block")
    phrases = dealt.groupBy("block").applyInArrow(_chosen_phrases(buckets, window, phrase), "bucket int, block int, h binary, at binary, twice binary")
    again = phrases.groupBy("bucket").applyInArrow(_recurring, "block int, at binary")
    rows = "kind int, block int, bucket int, n long, a binary, b binary, c binary, d binary"
    found = written(dealt.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(_locate(buckets, window, phrase), rows), "phrases")
    flags = found.filter("kind = 0").groupBy("bucket").applyInArrow(_firsts, rows)
    back = found.filter("kind = 1").unionByName(flags)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_remove(window, with_text), schema)
