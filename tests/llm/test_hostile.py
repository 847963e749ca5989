"""Every registered query over tables with null and repeated ids, null, empty and long texts, ties and clashing columns, and over empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickcast.llm import line_dedup, pieces, queries, token_counts

EXTRA = ["block", "h", "n", "row", "key", "label", "score", "list", "kind", "salt", "length", "piece", "ids", "x", "content", "bands", "shard", "first"]
LONG = " ".join(f"w{i % 701} v{i}" for i in range(15_000)) + "\n" + "\n".join(f"line {i} of many words that nobody reads twice over" for i in range(800))


def word(i, n=40):
    return " ".join(f"a{i}b{k}" for k in range(n))


def rows():
    out = [(i, word(i % 20) if i % 5 else word(i % 20) + " ### $$$\n|||", i % 2) for i in range(60)]
    out += [(7, word(7), 0), (7, word(300), 0), (7, word(7), 1), (None, word(3), 0), (None, word(3), 0), (None, word(301), 1), (None, None, 0), (-4, None, 0), (-5, "", 0), (-6, "  \n\t", 0)]
    return out + [(1 << 62, LONG, 0), (-(1 << 62), LONG + " end", 0), (61, "\x00\x1c\x7f é̈ 漢字 ▁ <|endoftext|> don't", 0), (62, "\n" * 50, 0)]


@pytest.fixture(scope="module", params=["hostile", "empty"])
def tables(request, spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp(request.param))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t, _ in rows()], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1 - y, y) for i, _, y in rows()] + [(None, None, None), (7, None, 1), (999, 1, 0)], "doc_id long, quality int, toxic int")
    x = np.random.default_rng(3).normal(size=(300, 6))
    x[40:60] = x[40]
    vec = [(i, v.tolist()) for i, v in enumerate(x)] + [(50, x[1].tolist()), (50, x[2].tolist()), (None, x[0].tolist()), (350, None), (400, [0.0] * 6), (450, [1.0, None] * 3), (500, [float("inf")] * 6), (550, [1.0, 2.0])]
    vectors = spark.createDataFrame(vec, "vec_id long, embedding array<double>")
    vectors = vectors.withColumn("label", (F.coalesce(F.col("vec_id"), F.lit(1)) % 3).cast("int"))
    pages = spark.createDataFrame([(i, None if i == 62 else f"http://x/{i}", t) for i, t, _ in rows()], "page_id long, url string, html string")
    if request.param == "empty":
        docs, labels, vectors, pages = docs.limit(0), labels.limit(0), vectors.limit(0), pages.limit(0)
    clash = {c: F.lit("z") for c in EXTRA}
    some = {c: F.lit("z") for c in EXTRA if c != "label"}
    for name, df in (("documents", docs.withColumns(clash)), ("labels", labels.withColumns({"score": F.lit(2.0), "h": F.lit(1)})), ("embeddings", vectors.withColumns(some)), ("pages", pages.withColumns(clash))):
        df.repartition(3).write.parquet(f"{at}/{name}.parquet")
    return request.param, at


def in_order():
    """Rows as the operators order them: by id, none last; rows of one id hold no windows or lines of each other unless they are equal."""
    return sorted(((i, t or "") for i, t, _ in rows()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def removed(units, window, joint):
    """(number of units, number removed, digest of what is left) of every row of ``units``, windows by ``window(row)`` as (start, length)."""
    seen, out = set(), []
    for i, x in units:
        gone = set()
        for s, n in window(x):
            key = tuple(x[s : s + n])
            if key in seen:
                gone.update(range(s, s + n))
            seen.add(key)
        out.append((i, len(x), len(gone), sha(joint.join(u for k, u in enumerate(x) if k not in gone))))
    return out


def line_windows(x):
    words_ = [len(WORD.findall(y)) for y in x]
    return [(s, n) for s in range(len(x)) for n in (1, 2, 3) if s + n <= len(x) and (n == 3 or len(x) == n or sum(words_[s : s + n]) >= 8)]


WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(name):
    """Values of a query by a plain loop over the hostile rows."""
    if name == "op4_substring_dedup":
        return removed([(i, WORD.findall(t)) for i, t in in_order()], lambda x: [(s, 20) for s in range(len(x) - 19)], " ")
    if name == "op5_line_dedup":
        return removed([(i, t.split("\n")) for i, t in in_order()], line_windows, "\n")
    if name == "op10_token_counts":
        e = token_counts.encoding(token_counts.default_path())
        return [(i, len(e.encode_ordinary(t))) for i, t in in_order()]
    if name == "op1_sentencepiece":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
        ids = [(i, sp.encode(t)) for i, t in in_order()]
        return [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids]
    return None


@pytest.mark.parametrize("name", ["op1_sentencepiece", "op4_substring_dedup", "op5_line_dedup", "op10_token_counts"])
def test_values_on_hostile_rows(spark, tables, name):
    kind, at = tables
    want = [] if kind == "empty" else plain(name)
    columns = queries.queries()[name](spark, at).columns[: len(want[0]) if want else 2]
    found = queries.queries()[name](spark, at).select(columns).collect()
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("seed", range(2))
def test_lines_of_random_texts_equal_a_loop(spark, seed):
    r = random.Random(seed)
    pool = ["", "a", "b", "one two three four", "five six seven eight nine ten eleven twelve", "q r s t u v w x y", " ", "c d e f"]
    some = [(i, "\n".join(r.choices(pool, k=r.randrange(1, 9)))) for i in range(150)]
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(7)
    got = line_dedup.remove_repeated_lines(df).collect()
    want = removed([(i, t.split("\n")) for i, t in some], line_windows, "\n")
    assert sorted((g.doc_id, g.n_lines, g.n_removed, sha(g.kept_text)) for g in got) == sorted(want)


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, tables, name):
    kind, at = tables
    df = queries.queries()[name](spark, at)
    found = df.collect()
    if name == "op8_neighbours":
        asked = {} if kind == "empty" else {i: 5 for i in range(0, 300, 50)}
        assert {q: sum(r.query_id == q for r in found) for q in {r.query_id for r in found}} == asked
        assert all(r.vec_id != r.query_id and -1 - 1e-9 <= r.score <= 1 + 1e-9 for r in found)
        return
    if name == "op13_hard_negatives":
        assert (not found) == (kind == "empty") and {r.anchor_id for r in found} <= {0, 100, 200, 400}
        return
    want = [] if kind == "empty" else sorted(str(i) for i, _, _ in rows())
    if name == "op11_warc":
        assert sorted(str(r.page_id) for r in found) == want
        assert all(r.payload_bytes > 0 or r.page_id in (None, -4, -5) for r in found) and all((r.refers_to is None) == (r.record_type == "response") for r in found)
        return
    if name == "op7_packing":
        assert sorted(str(r.doc_id) for r in found if r.piece == 0) == want
    else:
        assert sorted(str(r.doc_id) for r in found) == want
    if name in ("op3_quality", "op9_toxicity"):
        n, held = (3, 1) if name == "op3_quality" else (5, 0)
        for r in found:
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
            assert r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % n == held)
    if name == "op2_exact_dedup" and kind == "hostile":
        assert all(r.keep_id == 3 for r in found if r.doc_id is None and r.group_size == 4 + 1)
    if name == "op6_near_dedup" and kind == "hostile":
        classes = {}
        for r in found:
            classes.setdefault(r.class_id, []).append(r.doc_id)
        assert sorted(classes[-(1 << 62)]) == [-(1 << 62), 1 << 62] and len(classes[7]) >= 5
    if name in ("op7_packing", "op2_exact_dedup"):
        assert df.count() == len(found) and len(df.select(df.columns[-1]).collect()) == len(found)


def test_pipeline(spark, tables):
    """Rows without an id or with a repeated one are rows of their own; a null text is empty."""
    kind, at = tables
    found = corpus_pipeline.run(spark, at).collect()
    assert (not found) == (kind == "empty")
    if found:
        starts = [str(r.doc_id) for r in found if r.piece == 0]
        texts = {}
        for i, t, _ in rows():
            texts.setdefault(" ".join((t or "").split()), []).append(str(i))
        # at most one document of each text is left, and the texts of words stay
        assert all(sum(x in ids for ids in texts.values()) >= starts.count(x) for x in set(starts))
        assert {"1", "2", "3", "4"} <= set(starts) and len(starts) <= len(texts)
