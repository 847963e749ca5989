"""SentencePiece encoding and decoding by a relational lattice.

Texts are split into words where no piece can cross (before a space mark that follows other text, and around control characters
that stand in no longer piece). Documents are dealt into blocks; each block names the words it holds, and every distinct word of the table
gives its lattice once: substrings of bounded length are exploded, equi-joined to the piece table, grouped by word and folded
with ``aggregate`` (``word_ids``). Ids go back to the blocks that hold the word, one row for each word and block.

The given vocabulary is byte-pair encoded: its right result is the one of the merges, which differs from the best sum of
scores that a Viterbi fold finds. Edges are therefore folded in order of score, leftmost first: an edge is taken where it
spans exactly two current pieces. (For a vocabulary whose merges are ordered, this equals merging pair by pair.)
``viterbi`` is the fold for unigram vocabularies.

The state of a fold is a bitmap of a word's piece borders. Words of more than 60 characters don't fit one; they are cut at every border that
no piece found in them spans, which changes no result, and their parts go the same way. A part that is still longer (long runs of letters
without a free border) is encoded whole where its text lies, by the same lattice and fold over Arrow batches (``merge_fold``).

Defined results: null and empty texts have no ids; characters without a piece become byte pieces; a literal U+2581 is read as a space, as
the library reads it; texts and words of any length are encoded whole; repeated rows are encoded each; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickcast.llm.common import blocks, bounded_batches, mapped, partitions, text_buffer
from tickcast.llm.words import hashes, prefix_sums, span_hashes

SPACE = "▁"
_BLOOM = 22
#: Longest word, in characters, whose borders are one bitmap.
LONGEST_WORD = 60
#: Characters of text that are split and hashed at once.
_PART = 1 << 20
#: Characters of text that travel as one compressed pack, and MB of text whose words are named once.
_PACK = 4 << 20
BLOCK_MB = 48
#: Characters of a substring that tell which longer substrings can be pieces.
_AHEAD = 3
_tables: dict[str, PieceTable] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class PieceTable:
    """The vocabulary as sorted hashes; a few MB, whatever the corpus."""

    texts: list[bytes]
    key: np.ndarray
    rank: np.ndarray
    by_rank: np.ndarray
    size: np.ndarray
    bloom: np.ndarray
    single: dict[bytes, int]
    byte_ids: np.ndarray
    longest: int
    isolated: np.ndarray
    spaces: dict[int, int]

    def space_runs(self, n: int) -> list[int]:
        """Pieces of n spaces: from the left, each pair of neighbours that forms a piece is joined at once."""
        out: list[int] = []
        for _ in range(n):
            out.append(1)
            while len(out) > 1 and out[-1] + out[-2] in self.spaces:
                out[-2:] = [out[-1] + out[-2]]
        return out

    @classmethod
    def load(cls, path: str) -> PieceTable:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        texts = [b""] * sp.get_piece_size()
        for i in normal:
            texts[i] = sp.id_to_piece(i).replace(SPACE, " ").encode()
        byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        for b, i in enumerate(byte_ids):
            texts[i] = bytes([b])
        # best score first; equal scores (the runs of spaces) count as one rank, so that place decides
        scores = {i: sp.get_score(i) for i in normal}
        level = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        spaces = {len(texts[i]): i for i in normal if len(texts[i]) > 1 and not texts[i].strip(b" ")}
        long = [i for i in normal if len(texts[i].decode()) > 1 and texts[i].strip(b" ")]
        buffer = np.frombuffer(b"".join(texts[i] for i in long), np.uint8)
        size = np.array([len(texts[i]) for i in long])
        ends = np.cumsum(size)
        key = hashes(buffer, ends - size, ends)
        order = np.argsort(key)
        bloom = np.zeros(1 << _BLOOM, bool)
        bloom[(key >> np.uint64(64 - _BLOOM)).astype(np.int64)] = True
        inner = {c for i in long for c in texts[i]}
        isolated = np.zeros(256, bool)
        isolated[[c for c in range(32) if c not in inner]] = True
        return cls(
            texts, key[order], np.array([level[scores[long[k]]] for k in order]), np.array(long)[order], size[order], bloom,
            {texts[i]: i for i in normal if len(texts[i].decode()) == 1}, byte_ids, max(len(texts[i].decode()) for i in long), isolated, spaces,
        )


def piece_table(path: str) -> PieceTable:
    if path not in _tables:
        _tables[path] = PieceTable.load(path)
    return _tables[path]


def lattice(table: PieceTable, data: np.ndarray, limits: np.ndarray):
    """Edges of all words of ``data`` (words lie between ``limits``): (word, first character, characters, piece), by word and rank.

    Also the characters' byte starts with a final end, and each word's first character number.
    """
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    byte = np.append(begin, len(data))
    first = np.searchsorted(begin, limits)
    word = np.repeat(np.arange(len(limits) - 1), np.diff(first))
    place = np.arange(len(begin)) - first[word]
    room = first[word + 1] - np.arange(len(begin))
    parts, sums = [], prefix_sums(data)
    at = np.arange(len(begin))
    for n in range(2, table.longest + 1):
        at = at[room[at] >= n]  # explode: substrings of n characters
        if not len(at):
            break
        h = span_hashes(sums, byte[at], byte[at + n])
        likely = np.flatnonzero(table.bloom[(h >> np.uint64(64 - _BLOOM)).astype(np.int64)])
        if not len(likely):
            continue
        a, x = at[likely], h[likely]
        k = np.minimum(np.searchsorted(table.key, x), len(table.key) - 1)  # join to the piece table
        good = (table.key[k] == x) & (table.size[k] == byte[a + n] - byte[a])
        parts.append((a[good], np.full(good.sum(), n), k[good]))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none, byte, first
    a, n, k = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((place[a] * 64 + n, word[a] * (1 << 20) + table.rank[k]))  # group by word, in order of the fold
    a, n, k = a[order], n[order], k[order]
    return word[a], a, n, k, byte, first


def merge_fold(table: PieceTable, data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, flat, and the words' limits in them. All words take their k-th edge in step k."""
    word, a, n, k, byte, first = lattice(table, data, limits)
    chars = len(byte) - 1
    ids = np.empty(chars, np.int64)
    wide = byte[1:] - byte[:-1]
    one = wide == 1
    small = np.array([table.single.get(bytes([c]), -1) for c in range(256)])
    ids[one] = small[data[byte[:-1][one]]]
    raw = data.tobytes()
    ids[~one] = [table.single.get(raw[s:e], -1) for s, e in zip(byte[:-1][~one].tolist(), byte[1:][~one].tolist())]
    nxt, alive = np.arange(1, chars + 2), np.ones(chars + 1, bool)
    n_edges = np.bincount(word, minlength=len(limits) - 1)
    start = np.cumsum(n_edges) - n_edges
    by = np.argsort(-n_edges, kind="stable")
    counts = -n_edges[by]
    for step in range(int(n_edges.max(initial=0))):
        e = start[by[: np.searchsorted(counts, -step, side="left")]] + step
        s, end = a[e], a[e] + n[e]
        mid = nxt[s]
        ok = alive[s] & (mid < end)
        ok[ok] = nxt[mid[ok]] == end[ok]
        s, mid = s[ok], mid[ok]
        nxt[s] = end[ok]
        alive[mid] = False
        ids[s] = table.by_rank[k[e[ok]]]
    _merge_spaces(table, data, byte, first, nxt, alive, ids)
    at = np.flatnonzero(alive[:chars])
    ids = ids[at]
    lost = ids < 0
    size = np.where(lost, wide[at], 1)
    ends = np.cumsum(size)
    out = np.repeat(ids, size)
    if lost.any():
        spots = np.flatnonzero(np.repeat(lost, size))
        inside = spots - (ends - size)[np.repeat(np.arange(len(at)), size)[spots]]
        out[spots] = table.byte_ids[data[byte[at[np.repeat(np.arange(len(at)), size)[spots]]] + inside]]
    return out, np.concatenate([[0], ends])[np.searchsorted(at, first)]


def _merge_spaces(table: PieceTable, data, byte, first, nxt, alive, ids) -> None:
    """Runs of spaces, whose pieces all have one score: always the leftmost pair that forms a piece."""
    begin = first[:-1][first[1:] - first[:-1] > 1]
    for s in begin[(data[byte[begin]] == 32) & (data[byte[begin + 1]] == 32)].tolist():
        n = 0
        while s + n < len(ids) and alive[s + n] and nxt[s + n] == s + n + 1 and data[byte[s + n]] == 32 and (n == 0 or s + n not in first):
            n += 1
        at = s
        for size in table.space_runs(n):
            if size > 1:
                alive[at + 1 : at + size] = False
                ids[at] = table.spaces[size]
            at += size


def split(table: PieceTable, texts: list[str | None]):
    """Bytes of all texts with their space marks, starts and ends of their words, and the texts' limits in the words."""
    raw = [b" " + t.replace(SPACE, " ").encode() if t else b"" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    docs = np.cumsum([0, *map(len, raw)])
    space, alone = data == 32, table.isolated[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
    cut[docs[:-1][docs[:-1] < len(data)]] = True
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], len(data))[: len(begin)]
    long = _long(data, begin, end)
    if long.any():
        some, limits = gather(data, begin[long], end[long])
        free = free_borders(table, some, limits)
        word = np.searchsorted(limits, free, side="right") - 1
        cut[begin[long][word] + free - limits[word]] = True
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(data))
    return data, begin, end, np.searchsorted(begin, docs)


def free_borders(table: PieceTable, data: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Bytes at which a character begins that no edge of the words of ``data`` joins to the one before."""
    _, a, n, _, byte, _ = lattice(table, data, limits)
    chars = len(byte) - 1
    inside = np.cumsum(np.bincount(a + 1, minlength=chars + 1) - np.bincount(a + n, minlength=chars + 1))[:chars] > 0
    space = data[byte[:-1]] == 32
    inside[1:] |= space[1:] & space[:-1]
    return byte[:-1][~inside]


def gather(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the given spans, one behind the other, and their limits."""
    limits = np.concatenate([[0], np.cumsum(end - begin)])
    return data[np.repeat(begin - limits[:-1], end - begin) + np.arange(limits[-1])], limits


def _long(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which words have more than ``LONGEST_WORD`` characters."""
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return chars[end] - chars[begin] > LONGEST_WORD


def fold_words(table: PieceTable, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the given words, flat, and the number of each word's ids."""
    flat, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(begin), 40_000):
        ids, lim = merge_fold(table, *gather(data, begin[i : i + 40_000], end[i : i + 40_000]))
        flat.append(ids)
        sizes.append(np.diff(lim))
    return np.concatenate(flat), np.concatenate(sizes)


def place(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words of all texts, given the number of each in the distinct words, and the texts' limits."""
    first = np.cumsum(sizes) - sizes
    n = sizes[which]
    ends = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat(first[which] - ends[:-1], n) + np.arange(ends[-1])], ends[docs]


def encode_texts(table: PieceTable, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of all texts, flat, and the texts' limits, without Spark."""
    data, begin, end, docs = split(table, texts)
    _, one, which = np.unique(hashes(data, begin, end), return_index=True, return_inverse=True)
    return place(*fold_words(table, data, begin[one], end[one]), which, docs)


def decode_ids(table: PieceTable, ids: np.ndarray, limits: np.ndarray) -> list[str]:
    """Texts of flat ids; bytes that form no character become U+FFFD."""
    pieces = list(map(table.texts.__getitem__, ids.tolist()))
    out = []
    for i, j in zip(limits[:-1], limits[1:]):
        text = b"".join(pieces[i:j]).decode("utf-8", "replace")
        out.append(text[1:] if text[:1] == " " else text)
    return out


def _parts(texts: list, most: int = 4 << 20):
    i, size = 0, 0
    for j, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def word_ids(words: DataFrame, path: str | None = None) -> DataFrame:
    """word, ids of distinct words of at most ``LONGEST_WORD`` characters: their lattices as rows, folded by ``aggregate``.

    The state of a word's fold is a bitmap of its current piece borders; an edge that spans exactly two pieces removes the border
    between them. The pieces left are the edges whose ends are borders and that have none inside. Grouping keeps the partitions of ``words``.
    """
    table = piece_table(path or default_path())
    level = {int(i): int(r) for i, r in zip(table.by_rank, table.rank)}
    last = max(level.values(), default=0) + 1
    as_bytes = set(table.byte_ids.tolist())
    rows = [(t.decode(), i, level.get(i, last)) for i, t in enumerate(table.texts) if t and i not in as_bytes]
    known = words.sparkSession.createDataFrame(rows, "piece string, id int, rank int")  # the vocabulary: tens of thousands of rows
    known = known.select(F.xxhash64("piece").alias("key"), F.col("piece").alias("known"), "id", "rank")
    sizes: dict[str, set[int]] = {}
    for t, _, _ in rows:
        if len(t) >= _AHEAD:
            sizes.setdefault(t[:_AHEAD], set(range(1, _AHEAD))).add(len(t))
    ahead = words.sparkSession.createDataFrame([(t, sorted(n)) for t, n in sizes.items()], "begins string, ahead array<int>")
    ahead = ahead.select(F.xxhash64("begins").alias("begin_key"), "begins", "ahead")
    subs = words.select("word", F.length("word").alias("size"))
    subs = subs.select("word", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("s"))
    # substrings are as long as some piece that begins with the same characters; all of fewer characters than that are tried
    subs = subs.withColumn("first", F.substring("word", F.col("s") + 1, F.lit(_AHEAD))).withColumn("first_key", F.xxhash64("first"))
    subs = subs.join(F.broadcast(ahead), (F.col("first_key") == F.col("begin_key")) & (F.col("first") == F.col("begins")), "left")
    tried = F.coalesce("ahead", F.array(*map(F.lit, range(1, _AHEAD))))
    subs = subs.select("word", "size", "s", F.explode(F.filter(tried, lambda n: F.col("s") + n <= F.col("size"))).alias("n"))
    subs = subs.select("word", "size", "s", (F.col("s") + F.col("n")).alias("e"), F.substring("word", F.col("s") + 1, F.col("n")).alias("piece"))
    # a number is looked up much faster than a string; the pieces themselves decide
    edges = subs.withColumn("key", F.xxhash64("piece")).join(F.broadcast(known), "key", "left").filter("known = piece or e = s + 1")
    edges = edges.withColumns({c: F.when(F.col("known") == F.col("piece"), F.col(c)) for c in ("id", "rank")})
    codes = F.array(*map(F.lit, table.byte_ids.tolist())).cast("array<int>")
    # one number orders a word's edges: rank, then place; runs of spaces have one score: from the left, neighbours that form a piece are joined at once
    spaces = F.trim("piece") == ""
    place_ = F.when(spaces, F.expr("e * 64L + 63 - s")).otherwise(F.expr("s * 64L + e"))
    turn = (F.coalesce("rank", F.lit(last)).cast("long") * 4096 + place_).alias("turn")
    ends, inner = F.expr("shiftleft(1L, s) | shiftleft(1L, e)").alias("ends"), F.expr("shiftleft(1L, e) - shiftleft(1L, s + 1)").alias("inner")
    unknown = F.when(F.col("id").isNull(), F.encode("piece", "UTF-8")).alias("raw")
    # a partition holds some ten thousand words: grouped by hash, not sorted
    words.sparkSession.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(1 << 16))
    lattices = edges.select("word", "size", F.struct(turn, "s", ends, inner, "id", unknown).alias("edge")).groupBy("word", "size").agg(F.sort_array(F.collect_list("edge")).alias("edges"))

    def step(borders, x):
        held = borders.bitwiseAND(x["inner"])
        two = (borders.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(held) == 1)
        return F.when(two, borders.bitwiseXOR(held)).otherwise(borders)

    def spelled(raw):
        return F.transform(F.sequence(F.lit(1), F.octet_length(raw)), lambda i: F.element_at(codes, F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int") + 1))

    def left(borders):
        # inside the fold: as a column of its own it would be worked out anew for every edge
        pieces = F.filter("edges", lambda x: borders.bitwiseAND(x["ends"].bitwiseOR(x["inner"])) == x["ends"])
        return F.sort_array(F.transform(pieces, lambda x: F.struct(x["s"].alias("s"), x["id"].alias("id"), x["raw"].alias("raw"))))

    taken = lattices.select("word", F.aggregate("edges", F.expr("shiftleft(1L, size + 1) - 1"), step, left).alias("taken"))
    plain = F.transform("taken", lambda x: x["id"])
    mixed = F.flatten(F.transform("taken", lambda x: F.when(x["id"].isNull(), spelled(x["raw"])).otherwise(F.array(x["id"]))))
    return taken.select("word", F.when(F.exists("taken", lambda x: x["id"].isNull()), mixed).otherwise(plain).alias("ids"))


def _packed(n: int):
    """Rows of (doc_id, text) as compressed packs of about ``_PACK`` characters, each dealt to one of ``n`` blocks by its content."""

    def pack(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
            for r in rows:
                out.write_batch(r)
        data = sink.getvalue().to_pybytes()
        return pa.RecordBatch.from_arrays([pa.array([zlib.crc32(data) % n], pa.int64()), pa.array([data], pa.binary())], ["block", "pack"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= _PACK:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)

    return run


def _unpacked(pack: bytes):
    """The rows of a pack, some at a time: (doc_ids, texts)."""
    with pa.ipc.open_stream(pack) as rows:
        for batch in rows:
            texts = batch.column(1).to_pylist()
            for i, j in _parts(texts, _PART):
                yield batch.column(0)[i:j], texts[i:j]


def _by_home(batches):
    """(home, word, ids) rows as one compressed row for each home and 2^16 rows: sizes of the words in bytes and in ids, ids, words."""

    def packs(rows: list[pa.RecordBatch]):
        found = pa.Table.from_batches(rows).sort_by([("home", "ascending"), ("word", "ascending")]).combine_chunks()
        words, ids = found.column("word").combine_chunks(), found.column("ids").combine_chunks()
        data, limits = text_buffer(words)
        counts = pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, ends = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.concatenate([[0], np.cumsum(counts)])
        homes, first = np.unique(found.column("home").to_numpy(), return_index=True)
        sizes, counts = np.diff(limits).astype("<u2"), counts.astype("<u2")
        out = []
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(sizes)]):
            raw = sizes[i:j].tobytes() + counts[i:j].tobytes() + flat[ends[i] : ends[j]].tobytes() + data[limits[i] : limits[j]].tobytes()
            out.append((j - i, len(raw), pa.compress(raw, codec="zstd", asbytes=True)))
        n, size, raw = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(homes, pa.int64()), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(raw, pa.binary())], ["home", "n", "size", "data"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= 1 << 16:
            yield from packs(held)
            held, n = [], 0
    if n:
        yield from packs(held)


def _known(right: pa.Table):
    """Words and ids of the packs of ``_by_home``: bytes, limits, flat ids, ids of each word, and the words' sorted hashes with their order."""
    words, sizes, counts, flat = [b""], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n, size, data in zip(*(right.column(c).to_pylist() for c in ("n", "size", "data"))):
        raw = pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)
        sizes.append(np.frombuffer(raw, "<u2", n).astype(np.int64))
        counts.append(np.frombuffer(raw, "<u2", n, 2 * n).astype(np.int64))
        m = int(counts[-1].sum())
        flat.append(np.frombuffer(raw, "<u4", m, 4 * n).astype(np.int64))
        words.append(raw[4 * n + 4 * m :])
    known = np.frombuffer(b"".join(words), np.uint8)
    limits = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    key = hashes(known, limits[:-1], limits[1:])
    order = np.argsort(key)
    return known, limits, np.concatenate(flat), np.concatenate(counts), key[order], order


def looked_up(known, limits, key, order, data, begin, end) -> tuple[np.ndarray, np.ndarray]:
    """The place of each word of ``data`` among the known words, and which words aren't there: found by hash, then compared byte by byte."""
    which, here = np.zeros(len(begin), np.int64), np.ones(len(begin), bool)
    if not len(key):
        return which, here
    h = hashes(data, begin, end)
    at = np.minimum(np.searchsorted(key, h), len(key) - 1)
    which = order[at]
    here = (key[at] != h) | (limits[which + 1] - limits[which] != end - begin)
    there = np.flatnonzero(~here)
    mine, ends = gather(data, begin[there], end[there])
    other, _ = gather(known, limits[which[there]], limits[which[there] + 1])
    here[there[np.searchsorted(ends, np.flatnonzero(mine != other), side="right") - 1]] = True
    return which, here


def _encoded(docs: DataFrame, path: str, finish, schema: str) -> DataFrame:
    """``finish(table, doc_ids, texts, ids, limits)`` of all rows, by blocks of documents.

    Texts and words are shuffled once each: the words' exchange serves their distinct rows, their lattices and the way back. Texts and ids travel
    compressed. Words are looked up by a hash and then compared; one that differs is encoded where it lies.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n = blocks(docs, "text", BLOCK_MB)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_packed(n), "block long, pack binary").repartition(n, "block")

    def held(batches):
        table, seen = piece_table(path), {}
        for batch in batches:
            for b, pack in zip(batch.column(0).to_pylist(), batch.column(1)):
                for _, texts in _unpacked(pack.as_py()):
                    data, begin, end, _ = split(table, texts)
                    h, one = np.unique(hashes(data, begin, end), return_index=True)
                    before = seen.get(b, np.zeros(0, np.uint64))
                    at = np.minimum(np.searchsorted(before, h), max(0, len(before) - 1))
                    new = ~_long(data, begin[one], end[one]) & (before[at] != h if len(before) else True)
                    seen[b] = np.sort(np.concatenate([before, h[new]]))
                    some, limits = gather(data, begin[one[new]], end[one[new]])
                    words = pa.Array.from_buffers(pa.string(), int(new.sum()), [None, pa.py_buffer(limits.astype(np.int32)), pa.py_buffer(some)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), b)), words], ["home", "word"])

    named = dealt.mapInArrow(held, "home long, word string").repartition(max(24 * n, partitions(docs)), "word")  # lattices are many times the words
    # no home is negative; the filter makes both uses of the words read the same columns, hence one exchange
    distinct = named.groupBy("word").agg(F.max("home").alias("home")).filter("home >= 0").select("word")
    back = named.join(word_ids(distinct, path), "word").select("home", "word", "ids").mapInArrow(_by_home, "home long, n long, size long, data binary")

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        table, out = piece_table(path), []
        known, limits, flat, sizes, key, order = _known(right)
        for pack in left.column("pack"):
            for doc_ids, texts in _unpacked(pack.as_py()):
                data, begin, end, rows = split(table, texts)
                which, here = looked_up(known, limits, key, order, data, begin, end)
                which[here] = len(order) + np.arange(here.sum())
                more, more_sizes = fold_words(table, data, begin[here], end[here])
                got, lim = place(np.concatenate([flat, more]), np.concatenate([sizes, more_sizes]), which, rows)
                out.append(finish(table, doc_ids, texts, got, lim))
        return pa.Table.from_batches(out)

    return dealt.groupBy("block").cogroup(back.groupBy("home")).applyInArrow(assemble, schema)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids of every row."""

    def finish(table, doc_ids, texts, ids, limits):
        return pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return _encoded(docs, path or default_path(), finish, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of every row of ids."""
    bounded_batches(encoded.sparkSession)
    path = path or default_path()

    def run(batch: pa.RecordBatch):
        ids = batch.column(1)
        limits = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
        texts = decode_ids(piece_table(path), ids.flatten().to_numpy(zero_copy_only=False), limits)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return mapped(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), decoded_equal of every row."""

    def finish(table, doc_ids, texts, ids, limits):
        back, raw = decode_ids(table, ids, limits), ids.astype("<u4")
        crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(limits[:-1], limits[1:])]
        same = [(t or "").replace(SPACE, " ") == b for t, b in zip(texts, back)]
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(limits), pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], ["doc_id", "n_pieces", "ids_crc32", "decoded_equal"])

    return _encoded(docs, path or default_path(), finish, "doc_id long, n_pieces long, ids_crc32 long, decoded_equal boolean")


def viterbi(words: DataFrame, pieces: DataFrame, longest: int, unknown: float = -100.0) -> DataFrame:
    """word, pieces: the best sum of scores for each distinct word under a unigram table (piece, score).

    Substrings are exploded, joined to the (bounded) piece table and folded by ``aggregate`` over end positions.
    """
    distinct = words.select("word").filter("length(word) > 0").distinct()
    spans_ = distinct.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("s"))
    spans_ = spans_.select("word", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("s")))).alias("n"))
    subs = spans_.select("word", "s", "n", F.substring("word", F.col("s") + 1, F.col("n")).alias("piece"))
    edges = subs.join(F.broadcast(pieces.select("piece", F.col("score").cast("double").alias("score"))), "piece", "left")
    edges = edges.filter(F.col("score").isNotNull() | (F.col("n") == 1)).select("word", F.struct((F.col("s") + F.col("n")).alias("e"), "s", "piece", F.coalesce("score", F.lit(unknown)).alias("score")).alias("edge"))
    lattices = edges.groupBy("word").agg(F.array_sort(F.collect_list("edge")).alias("edges"))
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("path")))

    def step(state, edge):
        before = F.element_at(state, edge["s"] + 1)
        new = F.struct((before["score"] + edge["score"]).alias("score"), F.concat(before["path"], F.array(edge["piece"])).alias("path"))
        here = F.element_at(state, -1)
        return F.when(F.size(state) <= edge["e"], F.concat(state, F.array(new))).when(new["score"] > here["score"], F.concat(F.slice(state, 1, F.size(state) - 1), F.array(new))).otherwise(state)

    return lattices.select("word", F.element_at(F.aggregate("edges", start, step), -1)["path"].alias("pieces"))
