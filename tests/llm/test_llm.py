"""Small tests of the training-data operators against brute force, with hostile rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickcast.llm import exact_dedup, line_dedup, line_quality, near_dedup, neighbours, packing, phrases, pieces, token_counts, toxicity

SCHEMA = "doc_id long, text string, block int, h string, n long"
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "mu", "nu"]


def words(seed, n):
    r = random.Random(seed)
    return [r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n)]


def texts():
    base = words(1, 60)
    near = [*base]
    near[30] = "changed"
    return [
        (0, " ".join(base)), (1, "\t".join(base)), (2, " ".join(near)), (3, None), (4, ""), (5, "  "), (6, "one two"), (7, "one\x0btwo"),
        (8, " ".join(words(2, 25) + base[5:40] + words(3, 25))), (9, " ".join(words(4, 3000))), (10, "a\nb\nc\nx\na\nb\nc\nd"), (11, "q\na\nb\nc"), (12, "é 漢字 ▁x\n"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns have names that operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in texts()], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(docs, empty):
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert got[1] == got[0] == (0, 2) and got[3] == got[4] == (3, 2) and got[5] == (5, 1) and got[7] == got[6] == (6, 2)
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_duplicates(docs).collect()) == [0, 2, 3, 5, 6, 8, 9, 10, 11, 12]


def test_grace_spills_and_compares_contents(monkeypatch):
    monkeypatch.setattr(exact_dedup, "TABLE_BYTES", 2000)
    rows = [(h, f"text {t} " + "y" * 50, i, 1) for i, (h, t) in enumerate((random.Random(i).choice([5, 5, -9, 1 << 61]), i % 20) for i in range(400))]
    got = sorted((r[0], r[1], r[2], r[3]) for t in exact_dedup.grace(iter(rows)) for r in t.rows)
    want = {}
    for h, t, i, _ in rows:
        first, n = want.get((h, t), (i, 0))
        want[h, t] = (min(first, i), n + 1)
    assert got == sorted((h, t, f, n) for (h, t), (f, n) in want.items())


def test_phrases(docs, empty):
    split = {i: [w for w in (t or "").replace("\t", " ").replace("\x0b", " ").replace("\n", " ").split(" ") if w] for i, t in texts()}
    first, gone = {}, {i: set() for i in split}
    for i in sorted(split):
        for s in range(len(split[i]) - 19):
            key = tuple(split[i][s : s + 20])
            if key in first:
                gone[i].update(range(s, s + 20))
            first.setdefault(key, (i, s))
    got = {r.doc_id: (r.n_words, r.n_removed) for r in phrases.remove_repeats(docs).collect()}
    assert got == {i: (len(w), len(gone[i])) for i, w in split.items()} and got[8][1] > 0
    assert phrases.remove_repeats(empty).count() == 0


def test_phrases_on_random_words_equal_brute_force(spark, monkeypatch):
    """Small blocks and few words, so that phrases recur inside and across blocks; several rows share an id or have none."""
    monkeypatch.setattr(phrases, "blocks", lambda docs, text, mb: 5)
    r = random.Random(4)
    parts = [[r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.randint(5, 40))] for _ in range(12)]
    some = [(i, " ".join(w for _ in range(r.randint(0, 4)) for w in r.choice(parts))) for i in range(60)]
    got = {r_.doc_id: (r_.n_words, r_.n_removed, r_.kept_text) for r_ in phrases.remove_repeats(spark.createDataFrame(some, "doc_id long, text string"), 8, 4, with_text=True).collect()}
    first = {}
    for i, t in some:
        x, gone = t.split(), set()
        for k in range(len(x) - 7):
            if first.setdefault(tuple(x[k : k + 8]), (i, k)) != (i, k):
                gone.update(range(k, k + 8))
        assert got[i] == (len(x), len(gone), " ".join(w for k, w in enumerate(x) if k not in gone) if gone else t)
    t = " ".join(map(str, range(30)))
    again = spark.createDataFrame([(1, t), (1, t), (1, t + " x"), (None, t), (None, t + " y")], "doc_id long, text string")
    assert sorted(r_.n_words - r_.n_removed for r_ in phrases.remove_repeats(again).collect()) in ([0, 0, 0, 1, 31], [0, 0, 1, 1, 30])


def test_automaton_finds_all_occurrences():
    r = np.random.default_rng(5)
    w = np.array([11 << 48, 12 << 48, 13 << 52, 14 << 52], np.uint64)[r.integers(0, 4, 400)] | np.uint64(5 << 60)
    at = np.array([3, 50, 51, 390])
    want = [i for i in range(len(w) - 2) if any((w[i : i + 3] == w[p : p + 3]).all() for p in at)]
    assert sorted(phrases.occurrences(w, at, 3).tolist()) == want


def test_lines(docs, empty):
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.remove_repeated_lines(docs).collect()}
    assert got[10] == (8, 3, "a\nb\nc\nx\nd") and got[11] == (4, 3, "q") and got[3] == (1, 0, "")
    assert line_dedup.remove_repeated_lines(empty).count() == 0


def test_short_runs_of_lines(spark):
    long = " ".join(words(5, 9))
    some = [
        (0, f"a\n{long}\nb\nfew words\nc"), (1, f"q\n{long}\nr\nfew words\ns"), (2, long), (3, "x one two three four\ny one two three four\nz"),
        (4, "p\nx one two three four\ny one two three four\np2"), (5, "short text"), (6, "short text"), (7, "u\nv"), (8, "u\nv"), (9, "\n\n.\n\n"),
    ]
    texts = spark.createDataFrame(some, "doc_id long, text string")

    def brute(alone):
        first, gone = {}, {i: set() for i, _ in some}
        for i, t in some:
            x = t.split("\n")
            for n in range(1, 4):
                for s in range(len(x) - n + 1):
                    w = tuple(x[s : s + n])
                    if n == 3 or alone and (len(x) == n or len(" ".join(w).split()) >= alone):
                        if first.setdefault(w, (i, s)) != (i, s):
                            gone[i].update(range(s, s + n))
        return {i: "\n".join(y for k, y in enumerate(t.split("\n")) if k not in gone[i]) for i, t in some}

    for alone in (8, None):
        assert {r.doc_id: r.kept_text for r in line_dedup.remove_repeated_lines(texts, alone=alone).collect()} == brute(alone)
    assert brute(8)[1] == "q\nr\nfew words\ns" and brute(8)[2] == "" == brute(8)[8] and brute(8)[4] == "p\np2"


def test_near(docs, empty):
    def grams(t):
        w = (t or "").split()
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])

    g, label = {i: grams(t) for i, t in texts()}, {i: i for i, _ in texts()}
    for a in g:
        for b in g:
            both = sum((g[a] & g[b]).values())
            if a < b and both >= 0.8 * (sum(g[a].values()) + sum(g[b].values()) - both):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()} == label and label[2] == 0
    assert near_dedup.near_duplicates(empty).count() == 0


def test_dart_agreement_follows_similarity():
    row = np.repeat([0, 1], 400)
    h = np.concatenate([np.arange(400), np.arange(40, 440)]).astype(np.uint64) * np.uint64(2654435761)
    sig, some = near_dedup.dart_signatures(row, h, 2, 2000)
    assert some.all() and abs((sig[0] == sig[1]).mean() - 360 / 440) < 0.04


def test_packing(docs, empty):
    rows = packing.pack_documents(docs, length=64).collect()
    tok = packing.encoder(packing.default_path()).tokenizer
    for i, t in texts():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        assert own == [(k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == list(np.cumsum([0] + [n for _, n in b])[:-1]) and sum(n for _, n in b) <= 64
    assert packing.pack_documents(empty).count() == 0
    packed = packing.pack_documents(docs, length=64)
    assert packed.count() == len(rows) and packed.select("sequence_id").distinct().count() == len(bins)
    assert {r.doc_id: r["count"] for r in packed.groupBy("doc_id").count().collect()} == Counter(r.doc_id for r in rows)


def test_word_encoder_equals_the_tokenizer():
    r = random.Random(2)
    some = ["a", "B", "Zé", "É", "ñ", "×", "÷", "ÿ", "ß", "1", "23", ".", "...", "#$", "'s", "'", "'LL", "<", "<|endoftext|>", "<|ENDOFTEXT|>", "don't", "\x01", "\x7f", "\u0301", "漢字", "ǅ", "İ", "\xa0", "¿", "ª", "\xad", "-", "_", "𝒳"]
    texts = ["".join(r.choice([*some, " ", " ", "\n", "\x0b", "\t"]) for _ in range(r.randint(0, 40))) for _ in range(800)] + ["ab" * 200, "x" * 129 + " " + "x" * 130, ""]
    e = packing.WordEncoder(packing.default_path())
    data = [t.encode() for t in texts]
    for _ in range(2):  # learning, then remembered
        ids, limits = e(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        assert [ids[a:b].tolist() for a, b in zip(limits[:-1], limits[1:])] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once_and_tightly(seed):
    r = random.Random(seed)
    hist = Counter(min(4096, int(r.expovariate(1 / 900)) + 1) for _ in range(3000))
    used, total = Counter(), 0
    groups = packing.pack(dict(hist))
    for lengths, count in groups:
        assert sum(lengths) <= 4096
        for x in lengths:
            used[x] += count
        total += count
    assert used == hist and total <= 1.02 * -(-sum(k * v for k, v in hist.items()) // 4096) + 1


def test_neighbours(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 8))
    x[100:130] = x[100]
    rows = [(i, [float(v) for v in x[i]], None) for i in range(600)] + [(700, None, 1), (750, [0.0] * 8, 1), (800, [float("nan")] * 8, 1), (850, [1.0, None] * 4, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list int")
    got = {}
    for q in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(q.query_id, []).append(q.vec_id)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in range(0, 600, 50):
        s = np.round(u @ u[q], 12)
        s[q] = -2
        want = np.lexsort((np.arange(600), -s))[:5].tolist()
        hits += len(set(want) & set(got[q]))
        if q == 100:
            assert got[q] == [101, 102, 103, 104, 105]
    assert set(got) == set(range(0, 600, 50)) and hits >= 0.9 * 60
    assert neighbours.nearest(df.filter("false")).count() == 0


@pytest.mark.parametrize(("n", "per_list"), [(2000, 8), (6000, 16)])
def test_recall_with_more_lists_than_probes(spark, n, per_list):
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 16))[r.integers(0, 60, n)] + 0.7 * r.normal(size=(n, 16))
    x[n // 2 : n // 2 + n // 3] = x[7]  # one vector holds a third of all rows
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    found = neighbours.nearest(df, per_list=per_list, per_cell=10 * per_list).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in range(0, n, 50):
        s = np.round(u @ u[q], 12)
        s[q] = -2
        hits += len(set(np.lexsort((np.arange(n), -s))[:5].tolist()) & {f.vec_id for f in found if f.query_id == q})
    assert len(found) == n // 50 * 5 and hits >= 0.9 * len(found)


def test_levels_of_parts_keep_recall_and_copies_in_proportion(spark, monkeypatch):
    """With few cells, parts of parts are needed; copies of centroids grow with the vectors, not with their square."""
    keep, small = neighbours.written, dict(per_list=8, per_cell=100, centroids=4, fan=8, parts=4, salt=100)
    copies, recall = {}, {}
    for n in (2000, 8000):
        made = []
        monkeypatch.setattr(neighbours, "written", lambda df, name: made.append((name, out := keep(df, name))) or out)
        r = np.random.default_rng(2)
        x = r.normal(size=(60, 16))[r.integers(0, 60, n)] + 0.7 * r.normal(size=(n, 16))
        found = neighbours.nearest(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), **small).collect()
        u = x / np.linalg.norm(x, axis=1)[:, None]
        want = {(q, int(i)) for q in range(0, n, 50) for i in np.argsort(-np.where(np.arange(n) == q, -2, u @ u[q]), kind="stable")[:5]}
        recall[n] = len(want & {(f.query_id, f.vec_id) for f in found}) / len(want)
        fitted = [df.count() for name, df in made if name in ("parts", "pivots")]
        sizes = neighbours.levels_of(n / 4, 8, 8, 4)
        assert len(fitted) == len(sizes) > 2
        copies[n] = sum(c * max(1, -(-int(neighbours.CELLS * s) // 100)) for c, s in zip(fitted, sizes))
    assert min(recall.values()) >= 0.9, recall
    assert copies[8000] <= 6 * copies[2000], copies


def test_token_counts(docs, empty):
    e = token_counts.encoding(token_counts.default_path())
    want = {i: len(e.encode_ordinary(t or "")) for i, t in texts()}
    for block in (7, 1 << 18):
        assert {r.doc_id: r.n_tokens for r in token_counts.document_tokens(docs, block=block).collect()} == want
    assert token_counts.document_tokens(empty).count() == 0


def test_pieces(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    enc = pieces.encode(docs)
    assert {r.doc_id: r.ids for r in enc.collect()} == {i: sp.encode(t or "") for i, t in texts()}
    assert {r.doc_id: r.text for r in pieces.decode(enc).collect()} == {i: (t or "").replace("▁", " ") for i, t in texts()}
    assert all(r.decoded_equal for r in pieces.round_trip(docs).collect()) and pieces.encode(empty).count() == 0
    some = [" " * n + "x" for n in range(70)] + ["y" * 3000]
    ids, lim = pieces.encode_texts(pieces.piece_table(pieces.default_path()), some)
    assert [ids[a:b].tolist() for a, b in zip(lim[:-1], lim[1:])] == [sp.encode(t) for t in some]


def test_relational_lattice_equals_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    some = texts()[2:9] + texts()[10:] + [(20 + n, " " * n + "Hello,  world" + " " * n) for n in range(0, 70, 3)] + [(100, "tab\tand\nline  \n x"), (101, "naïve 漢字𝒳 x"), (102, "\x01 a\x02b")]
    some += [(110 + n, "z" * n + " " + "漢" * n + " " + "ab" * n) for n in (29, 30, 59, 60, 61, 62, 500)]
    got = pieces.encode(spark.createDataFrame(some, "doc_id long, text string"))
    assert {r.doc_id: r.ids for r in got.collect()} == {i: sp.encode(t or "") for i, t in some}
    words = spark.createDataFrame([(" hello",), ("   x",), ("naïve",), ("𝒳",), ("\x01",), ("a" * 60,)], "word string")
    want = {r.word: pieces.encode_texts(pieces.piece_table(pieces.default_path()), [r.word[1:]])[0].tolist() for r in words.collect() if r.word[0] == " "}
    assert {r.word: r.ids for r in pieces.word_ids(words).collect() if r.word[0] == " "} == want and pieces.word_ids(words).count() == 6


def test_long_words_are_cut_where_no_piece_crosses(spark):
    import random

    import sentencepiece

    sp, table, r = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path()), pieces.piece_table(pieces.default_path()), random.Random(4)
    some = ["".join(r.choice(a) for _ in range(n)) for a in ("漢字文書処理言語大規模学習", "0123456789abcdef", "ab漢é.-/_:", "etaoinshrdlu ", "  \tx𝒳") for n in (59, 61, 270, 900)]
    data, begin, end, _ = pieces.split(table, some[:4])
    assert not pieces._long(data, begin, end).any() and len(begin) > 100
    data, begin, end, docs = pieces.split(table, some)
    assert begin[0] == 0 and end[-1] == len(data) and (begin[1:] == end[:-1]).all() and len(docs) == len(some) + 1
    got = pieces.encode(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"))
    assert {x.doc_id: x.ids for x in got.collect()} == {i: sp.encode(t) for i, t in enumerate(some)}


def test_words_of_one_hash_are_compared(monkeypatch):
    """Packed words come back whole; where all words of one length share a hash, a word takes the ids of its own text alone."""
    import pyarrow as pa

    words = [" ab", " xyz", " cd", "é"]
    home = pa.table({"home": [1, 0, 1, 1], "word": words, "ids": pa.array([[5], [70000, 3], [6, 7], [8]], pa.list_(pa.int32()))})
    for same in (False, True):
        if same:
            monkeypatch.setattr(pieces, "hashes", lambda data, begin, end: (np.asarray(end) - np.asarray(begin)).astype(np.uint64))
        packs = pa.Table.from_batches(pieces._by_home(home.to_batches()))
        assert packs.column("home").to_pylist() == [0, 1]
        known, limits, flat, sizes, key, order = pieces._known(packs)
        first = np.cumsum(sizes) - sizes
        asked = [" cd", " ab", " xyz", "ü", "é", " xyw"]
        raw = [w.encode() for w in asked]
        ends = np.cumsum([0, *map(len, raw)])
        which, here = pieces.looked_up(known, limits, key, order, np.frombuffer(b"".join(raw), np.uint8), ends[:-1], ends[1:])
        got = {w: flat[first[i] : first[i] + sizes[i]].tolist() for w, i, h in zip(asked, which, here) if not h}
        want = {" ab": [5], " xyz": [70000, 3], " cd": [6, 7], "é": [8]}
        assert got.items() <= want.items() and (got == want or same) and {" xyw", "ü"}.isdisjoint(got)


def test_viterbi(spark):
    table = {"a": -1.0, "b": -1.5, "ab": -2.2, "ba": -1.2, "aba": -2.0, "c": -3.0}

    def best(w):
        if not w:
            return 0.0, []
        return max((table.get(w[:n], -100.0) + best(w[n:])[0], [w[:n], *best(w[n:])[1]]) for n in range(1, min(3, len(w)) + 1) if w[:n] in table or n == 1)

    some = ["abab", "aba", "cab", "bab", "xa"]
    df = spark.createDataFrame([(w,) for w in [*some, *some, ""]], "word string")
    got = {r.word: r.pieces for r in pieces.viterbi(df, spark.createDataFrame(list(table.items()), "piece string, score double"), 3).collect()}
    cost = lambda p: sum(table.get(x, -100.0) for x in p)
    assert {w: pytest.approx(cost(p)) for w, p in got.items()} == {w: best(w)[0] for w in some} and all("".join(p) == w for w, p in got.items())


def labelled(spark, bad, good, column):
    rows = [(i, bad(i) if i % 3 == 0 else good(i), int(i % 3 == 0)) for i in range(240)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - y if column == "quality" else y) for i, _, y in rows] + [(902, None)], f"doc_id long, {column} int")
    return docs, labels, {i: y for i, _, y in rows}


def test_quality(spark, empty):
    docs, labels, bad = labelled(spark, lambda i: "Some line.\n" + "\n".join("###$$$ || " + w for w in words(i, 12)), lambda i: "\n".join(" ".join(words(i + k, 9)) + "." for k in range(6)), "quality")
    model = line_quality.train(docs, labels, F.col("doc_id") % 2 == 0)
    got = {r.doc_id: r.score for r in line_quality.score_quality(docs, model).collect()}
    assert np.mean([(got[i] < 0.5) == bool(y) for i, y in bad.items() if i % 2]) > 0.95 and 0 <= got[900] == got[901] <= 1
    assert line_quality.score_quality(empty, model).count() == 0 and line_quality.keep_good(docs, model).columns == docs.columns


def test_marginals_equal_enumeration():
    r = np.random.default_rng(3)
    u, t = r.normal(size=5), r.normal(size=(2, 2))
    weight = lambda y: np.exp(sum(u[i] * y[i] for i in range(5)) + sum(t[y[i], y[i + 1]] for i in range(4)))
    paths = [tuple(k >> i & 1 for i in range(5)) for k in range(32)]
    z = sum(map(weight, paths))
    assert line_quality.marginals(u, t, np.array([5])) == pytest.approx([sum(weight(y) for y in paths if y[i]) / z for i in range(5)])


def test_toxicity(spark, empty):
    insults = ["grobnik", "flozzel"]
    docs, labels, bad = labelled(spark, lambda i: " ".join(words(i, 20)) + f" you {insults[i // 6 % 2]}. " + " ".join(words(i + 7, 20)), lambda i: " ".join(words(i, 40)) + ".", "toxic")
    model = toxicity.train(docs, labels, F.col("doc_id") % 2 == 0)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, y in bad.items() if i % 2]) > 0.95 and got[900] == got[901] < 0.5
    odd = spark.createDataFrame([(0, "some grob-nik here"), (1, "some g r o b n i k here")], "doc_id long, text string")
    assert all(r.margin > model.b for r in toxicity.score_toxicity(odd, model).collect())
    assert toxicity.score_toxicity(empty, model).count() == 0


def spelled_values(*texts):
    data = [t.encode() for t in texts]
    marks = [b"grobnik", b"\1flozz"]
    row, v, _ = toxicity.sentence_values(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), marks, toxicity._self_values(marks))
    out = np.zeros((len(texts), 2))
    np.maximum.at(out, row, v)
    return out


def test_spelled_words_are_read_whole_and_within_documents():
    assert spelled_values("x " * 300 + "g r o b n i k " + "y " * 50)[0, 0] > 0.9
    assert spelled_values("g\nr\no\nb\nn\ni\nk")[0, 0] > 0.9  # over line ends
    assert (spelled_values("say g r o", "b n i k you") == np.concatenate([spelled_values("say g r o"), spelled_values("b n i k you")])).all()


def test_mining_reads_whole_words():
    long = "z" * 100 + "grobnik"
    found = toxicity.mine([long + str(i) for i in range(20)] + ["fine words"] * 20, [1] * 20 + [0] * 20)
    assert any(x in b"grobnik" for x in toxicity._grams(long)) and any(b"rob" in x for x in toxicity._grams(long)) and found


def test_kernel_equals_enumeration():
    from itertools import combinations

    def brute(s, t, n, lam):
        total = 0.0
        for a in combinations(range(len(s)), n):
            for b in combinations(range(len(t)), n):
                if [s[i] for i in a] == [t[i] for i in b]:
                    total += lam ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
        return total

    for s, t in ((b"abcab", b"acb"), (b"gatta", b"cata"), (b"xyz", b"abc")):
        got = toxicity.subsequence_kernel(np.frombuffer(s, np.uint8)[None], t, 3, 0.6)[0]
        assert got == pytest.approx(brute(s, t, 3, 0.6), rel=1e-5)
