"""The pipeline end to end on the smallest tables: each stage against what it must keep."""

import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tickcast.llm import common, exact_dedup, line_quality, near_dedup, packing, phrases

SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def near_classes(texts):
    """{id: least id of its class} by comparing every two texts that share a shingle."""
    grams, where = {}, defaultdict(list)
    for i in sorted(texts):
        w = (texts[i] or "").split()
        grams[i] = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
        for g in grams[i]:
            where[g].append(i)
    label = {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in sorted(texts):
        for b in {x for g in grams[a] for x in where[g] if x > a}:
            both = sum((grams[a] & grams[b]).values())
            if both >= 0.8 * (grams[a].total() + grams[b].total() - both):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(i) for i in texts}


def without_repeats(texts):
    """Texts without words under a window of 20 words that starts earlier too."""
    seen, out = {}, {}
    for i in sorted(texts):
        w, gone = (texts[i] or "").split(), set()
        for k in range(len(w) - 19):
            if seen.setdefault(tuple(w[k : k + 20]), (i, k)) != (i, k):
                gone.update(range(k, k + 20))
        out[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else texts[i]
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    """Each stage against a brute-force version on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, docs, SF), name)
        rows = out.collect()
        if name == "packing":
            assert out.count() == len(rows) and out.select("sequence_id").count() == len(rows)
            break
        got = {r.doc_id: r.text for r in rows}
        assert out.columns == columns and len(rows) == len(got)
        if name == "quality":
            score = {r.doc_id: r.score for r in line_quality.score_quality(docs, line_quality.train(docs, labels)).collect()}
            assert got == {i: t for i, t in texts.items() if score[i] >= 0.5}
            good = {r.doc_id for r in labels.filter("quality = 1").collect()}
            assert len(good - set(got)) <= 0.02 * len(good)
        if name == "exact":
            first = {}
            for i in sorted(texts):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i] or ""), i)
            assert got == {i: texts[i] for i in first.values()}
        if name == "near":
            assert got == {i: texts[i] for i, c in near_classes(texts).items() if i == c}
        if name == "substring":
            assert got == without_repeats(texts) and all(r.n_chars == len(r.text or "") for r in rows)
        docs, texts = out, got
    tok, bins, own = packing.encoder(packing.default_path()).tokenizer, defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        own[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == list(np.cumsum([0] + [n for _, n in b])[:-1]) and sum(n for _, n in b) <= 4096
    for i, t in texts.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert sorted(own[i]) == [(k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    total = sum(n for b in bins.values() for _, n in b)
    assert len(bins) <= 1.02 * -(-total // 4096) + 1


@pytest.mark.skipif(not os.path.isdir(MORE), reason="no test tables")
def test_near_duplicates_equal_all_pairs(spark):
    """Recall against all pairs on a thousand documents: no class differs."""
    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    want = near_classes({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()} == want and len(set(want.values())) < len(want)


def test_stages_with_null_and_repeated_ids(spark):
    def text(name, n=60):
        return " ".join(f"{name}{i}" for i in range(n))

    a, b, c = text("a"), text("b"), text("c")
    rows = [(None, a, 1), (None, a, 2), (None, b, 3), (7, c, 4), (7, a, 5), (7, text("d"), 6), (3, c, 7), (None, b.replace("b30", "x"), 8), (9, text("e", 30) + " " + text("f", 30), 9), (None, text("f", 30), 10)]
    docs = spark.createDataFrame([(i, t, len(t), k) for i, t, k in rows], "doc_id long, text string, n_chars long, k int")
    exact = common.written(corpus_pipeline.exact(spark, docs, ""), "exact")
    got = {r.k for r in exact.collect()}
    assert exact.count() == 7 and got == {3, 5, 6, 7, 8, 9, 10} and exact.columns == docs.columns
    near = common.written(corpus_pipeline.near(spark, exact, ""), "near")
    assert {r.k for r in near.collect()} - {3, 8} == {5, 6, 7, 9, 10} and near.count() == 6  # one of 3 and 8 stays
    out = {r.k: r for r in corpus_pipeline.substring(spark, near, "").collect()}
    assert len(out) == near.count() and out[9].text.endswith("f29") and out[10].text == "" and out[10].doc_id is None and out[10].n_chars == 0
    assert out[5].text == a and out[5].doc_id == out[6].doc_id == 7


def test_null_ids_come_last_in_every_operator(spark):
    t = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(None, t), (-5, t), (1 << 62, t), (None, t)], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(docs).collect()} == {(i, -5, 4) for i in (None, -5, 1 << 62)}
    assert sorted((str(r.doc_id), r.n_removed) for r in phrases.remove_repeats(docs).collect()) == sorted([("None", 40), ("None", 40), ("-5", 0), (str(1 << 62), 40)])
