"""Best-fit packing of tokenised documents into fixed-length sequences.

Token counts come from one pass over the texts. The plan needs only the histogram of piece lengths, whose
size is bounded by the sequence length: large pieces are packed by a configuration linear program over
length classes, solved by multiplicative weights with a knapsack dynamic program as pricing oracle and rounded
down; what is left, and all small pieces, go best-fit by falling length into exact free space. Pieces
then take their places by their number within their length, which Spark computes without gathering a length.

Defined results: a null text counts as empty and is one piece with the end token alone; texts of any length are cut only beyond a
sequence; rows that repeat an id are packed each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickcast.llm.common import bounded_batches, mapped, partitions, slices, text_buffer, written
from tickcast.llm.words import hashes, spans

SEQUENCE, END = 4096, 1
#: Distinct parts of words that a Python worker remembers with their ids, at most, and the places of its hash table.
CACHE_PARTS, TABLE_BITS = 600_000, 21
#: Parts over so many bytes are hashed by a digest, since longer ones could be built to collide.
LONG = 128
_LATIN = regex.compile("[\x21-\x7e\xa1-\xac\xae-\xff]+")
_BAD, _LETTER, _DIGIT, _OTHER, _SPACE = range(5)
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _OTHER
_KIND[48:58] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[ord("'"), ord("<")]] = _BAD  # contractions and special tokens
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of texts by a tokenizer that never joins across ASCII white space: each distinct part of a word is encoded once.

    Words of ASCII and Latin-1 letters, digits and marks are lowered and cut into runs of letters, single digits and runs of marks,
    as the tokenizer's pattern does, all words of a buffer at once; a part is given to its model directly. All other words,
    also those with an apostrophe or "<", are one part each and go through the pattern or the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        plain = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        plain = plain and [s.get("type") for s in steps] == ["Split", "ByteLevel"] and not steps[1]["add_prefix_space"]
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"]) if plain else None
        # only where the pattern cuts by these kinds are words cut here
        self.cuts = bool(plain) and self.pattern.findall('ab1é2#$%-x"..ñÿß9.5') == ["ab", "1", "é", "2", "#$%-", "x", '"..', "ñÿß", "9", ".", "5"]
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        # byte-level models write the bytes that don't print as the characters from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        self._clear()

    def _clear(self) -> None:
        self.keys, self.values = np.zeros(1 << TABLE_BITS, np.uint64), np.full(1 << TABLE_BITS, -1, np.int32)
        self.flat, self.sizes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)
        self.begin, self.used, self.known = np.zeros(1 << 16, np.int64), 0, 0

    def _ids(self, word: str) -> list[int]:
        if self.pattern is None or not (word.isascii() and word.isprintable() or _LATIN.fullmatch(word)) or "<" in word and self.special.search(word):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        return [t.id for part in self.pattern.findall(word.lower()) for t in self.model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(self.letters))]

    def _learn(self, parts: list[bytes], whole: list[bool]) -> np.ndarray:
        """Numbers of new parts; ``whole`` marks words that are one part."""
        flat: list[int] = []
        sizes: list[int] = []
        tokenize = self.model.tokenize
        for part, w in zip(parts, whole):
            if w:
                ids = self._ids(part.decode())
            else:
                ids = [t.id for t in tokenize(part.decode() if part.isascii() else part.decode("latin-1").translate(self.letters))]
            flat += ids
            sizes.append(len(ids))
        k, n = self.known, len(parts)
        while k + n > len(self.sizes):
            self.sizes, self.begin = np.concatenate([self.sizes] * 2), np.concatenate([self.begin] * 2)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat] * 2)
        self.flat[self.used : self.used + len(flat)] = flat
        self.sizes[k : k + n] = sizes
        self.begin[k : k + n] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.known += n
        return np.arange(k, k + n, dtype=np.int32)

    def _parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lowered bytes, starts and ends of all parts, and which of them are whole words."""
        low, kind = _LOWER[data], _KIND[data]
        lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))  # Latin-1 letters
        kind[lead] = kind[lead + 1] = _LETTER
        low[lead + 1] += (data[lead + 1] <= 0x9E).astype(np.uint8) * np.uint8(32)
        if not self.cuts:
            kind[kind != _SPACE] = _BAD
        space = kind == _SPACE
        s, e, _ = spans(data, offsets)
        start = np.ones(len(data), bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        start[space] = False
        start[s] = True
        bad = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind == _BAD, out=bad[1:])
        hard = bad[e] > bad[s]
        edge = np.zeros(len(data) + 1, np.int8)
        edge[s[hard]] += 1
        edge[e[hard]] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        start[inside] = False
        start[s] = True
        low[inside] = data[inside]
        end = ~space
        end[:-1] &= start[1:] | space[1:]
        begin = np.flatnonzero(start)
        return low, begin, np.flatnonzero(end) + 1, inside[begin]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows of a UTF-8 buffer in order, and the rows' limits in them."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        low, begin, end, whole = self._parts(data, offsets)
        h = hashes(low, begin, end) ^ whole.astype(np.uint64)
        for k in np.flatnonzero(end - begin > LONG).tolist():
            h[k] = int.from_bytes(hashlib.blake2b(low[begin[k] : end[k]].tobytes(), digest_size=8, salt=bytes([int(whole[k])])).digest(), "little")
        if self.known > CACHE_PARTS:
            self._clear()
        slot = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        at = self.values[slot]
        new = np.flatnonzero((self.keys[slot] != h) | (at < 0))
        if len(new):
            u, first, inverse = np.unique(h[new], return_index=True, return_inverse=True)
            first = new[first]
            raw = low.tobytes()
            numbers = self._learn([raw[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist())], whole[first].tolist())
            at[new] = numbers[inverse]
            self.keys[slot[first]], self.values[slot[first]] = u, numbers
        n = self.sizes[at]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        ids = self.flat[np.repeat(self.begin[at] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(begin, offsets)]


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str, length: int = SEQUENCE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; one pass, no shuffle."""
    bounded_batches(docs.sparkSession)

    def cut(batch: pa.RecordBatch):
        data, offsets = text_buffer(batch.column(1))
        for i, j in slices(offsets, 1 << 20):
            ids, limits = encoder(path)(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            sizes = np.diff(limits) + 1
            first = np.cumsum(sizes) - sizes
            own = np.full(int(sizes.sum()), end, "<u4")
            own[np.arange(len(ids)) + np.repeat(np.arange(j - i), sizes - 1)] = ids
            n = -(-sizes // length)
            doc = np.repeat(np.arange(j - i), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * length
            size = np.minimum(sizes[doc] - start, length)
            begin = first[doc] + start
            crc = [zlib.crc32(own[a:b]) for a, b in zip(begin.tolist(), (begin + size).tolist())]
            cols = [batch.column(0)[i:j].take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return mapped(docs.select("doc_id", "text"), cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def knapsack(value: np.ndarray, sizes: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """Copies of each size (sizes rise) of greatest total value within the capacity; ``most`` limits each."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        k = int(np.searchsorted(sizes, c, side="right"))
        best[c], choice[c] = best[c - 1], -1
        if k:
            v = value[:k] + best[c - sizes[:k]]
            i = int(np.argmax(v))
            if v[i] > best[c]:
                best[c], choice[c] = v[i], i
    take, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            take[choice[c]] += 1
            c -= sizes[choice[c]]
    return np.minimum(take, most)


def configurations(demand: dict[int, int], capacity: int, rounds: int, eps: float = 0.15) -> list[tuple[tuple[tuple[int, int], ...], float]]:
    """Fractional cover of the demand by configurations, by multiplicative weights, fullest first.

    Each round prices sizes by how little of their demand is covered so far and adds the best-priced
    configuration as often as its scarcest size allows.
    """
    sizes = np.array(sorted(demand))
    need = np.array([demand[s] for s in sizes], float)
    log_price, used, cover = -np.log(need), defaultdict(float), np.zeros(len(sizes))
    for _ in range(rounds):
        price = np.exp(log_price - log_price.max())
        take = knapsack(price, sizes, need.astype(np.int64), capacity)
        some = take > 0
        if not some.any():
            break
        step = (need[some] / take[some]).min()
        share = take * step / need
        log_price -= eps * share
        cover += share
        used[tuple((int(s), int(k)) for s, k in zip(sizes[some], take[some]))] += step
    scale = 1 / max(np.median(cover), 1e-9)
    return sorted(((c, x * scale) for c, x in used.items()), key=lambda e: (-sum(s * k for s, k in e[0]), e[0]))


class Plan:
    """Groups of equal bins: (lengths in the bin, how many such bins), keyed by free space."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_free: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.some = np.zeros(capacity + 1, bool)

    def add(self, lengths: tuple[int, ...], count: int) -> None:
        if count:
            free = self.capacity - sum(lengths)
            self.by_free[free].append([lengths, count])
            self.some[free] = True

    def best_fit(self, length: int, n: int) -> None:
        """Place n pieces of one length, each where the least space stays free; open bins when none fits."""
        while n:
            free = length + int(np.argmax(self.some[length:])) if self.some[length:].any() else -1
            if free < 0 or free == self.capacity:
                per = self.capacity // length
                self.add((length,) * per, n // per)
                self.add((length,) * (n % per), 1 if n % per else 0)
                return
            lengths, count = self.by_free[free].pop()
            k = min(n, count)
            if count > k:
                self.by_free[free].append([lengths, count - k])
            self.some[free] = bool(self.by_free[free])
            # as many copies as the space takes go in at once: after the first, this bin is the best fit
            per = min(free // length, n // k) or 1
            self.add(lengths + (length,) * per, k)
            n -= k * per

    def groups(self) -> list[tuple[tuple[int, ...], int]]:
        merged: dict[tuple[int, ...], int] = defaultdict(int)
        for level in self.by_free:
            for lengths, count in level:
                merged[tuple(sorted(lengths, reverse=True))] += count
        return sorted(merged.items())


def pack(histogram: dict[int, int], capacity: int = SEQUENCE, classes: int = 128, rounds: int = 1200) -> list[tuple[tuple[int, ...], int]]:
    """Bins for a histogram {length: pieces}: groups (lengths, count) that use every piece exactly once.

    Its work depends on the number of distinct lengths, not on the number of pieces.
    """
    rest, plan = {k: v for k, v in histogram.items() if v}, Plan(capacity)
    unit = max(1, capacity // classes)
    by_class: dict[int, list[int]] = defaultdict(list)
    for x in sorted(rest, reverse=True):
        if capacity > x > capacity // 8:
            by_class[-(-x // unit)].append(x)
    demand = {c: sum(rest[x] for x in xs) for c, xs in by_class.items()}
    left = dict(demand)
    for config, times in configurations(demand, capacity // unit, rounds) if demand else []:
        bins = min(int(times), *(left[c] // k for c, k in config))
        if bins <= 0:
            continue
        slots = [c for c, k in config for _ in range(k)]
        for c, k in config:
            left[c] -= k * bins
        while bins:  # runs of bins in which each slot takes one exact length
            heads = [by_class[c][0] for c in slots]
            run = min(bins, *(rest[x] // heads.count(x) for x in set(heads)))
            if run == 0:
                heads = []
                for c in slots:  # some length is nearly used up: one bin with what there is
                    x = by_class[c][0]
                    rest[x] -= 1
                    heads.append(x)
                    if not rest[x]:
                        by_class[c].pop(0)
                plan.add(tuple(heads), 1)
                bins -= 1
                continue
            plan.add(tuple(heads), run)
            for x in heads:
                rest[x] -= run
            for c in set(slots):
                while by_class[c] and not rest[by_class[c][0]]:
                    by_class[c].pop(0)
            bins -= run
    for x in sorted((x for x, n in rest.items() if n), reverse=True):
        plan.best_fit(x, rest[x])
    return plan.groups()


def slots(groups: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length rows (first number, copies in the bin, first bin, offset in the bin)."""
    out, used, base = defaultdict(list), defaultdict(int), 0
    for lengths, count in groups:
        at = 0
        for x in dict.fromkeys(lengths):
            k = lengths.count(x)
            out[x].append((used[x], k, base, at))
            used[x] += k * count
            at += k * x
        base += count
    return {x: np.array(rows, np.int64) for x, rows in out.items()}


def place(cut: DataFrame, tasks: int, capacity: int = SEQUENCE) -> DataFrame:
    """Give every row of ``cut`` (doc_id, piece, length, ...) its sequence_id and offset."""
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    where = slots(pack(histogram, capacity))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(tasks)).cast("int"))
    counts = salted.groupBy("salt", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    # names of their own: both sides of the cogroup come from one table
    firsts = counts.select(F.col("salt").alias("task"), F.col("length").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def number(left: pa.Table, right: pa.Table) -> pa.Table:
        first = dict(zip(right["of"].to_pylist(), right["first"].to_pylist()))
        length = left["length"].to_numpy()
        bins, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.lexsort((left["piece"].to_numpy(), left["doc_id"].to_numpy(), length))
        cuts = np.flatnonzero(np.diff(length[order], prepend=-1))
        for i, j in zip(cuts, [*cuts[1:], len(order)]):
            at, x = order[i:j], int(length[order[i]])
            n = first[x] + np.arange(j - i)
            row = where[x][np.searchsorted(where[x][:, 0], n, side="right") - 1]
            k = n - row[:, 0]
            bins[at] = row[:, 2] + k // row[:, 1]
            offset[at] = row[:, 3] + k % row[:, 1] * x
        return left.drop(["salt"]).append_column("sequence_id", pa.array(bins)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return salted.groupBy("salt").cogroup(firsts.groupBy("task")).applyInArrow(number, schema)


def pack_documents(docs: DataFrame, path: str | None = None, length: int = SEQUENCE, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = written(pieces(docs, path or default_path(), length, end), "pieces")
    return place(cut, partitions(docs), length)
