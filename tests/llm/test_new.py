"""WARC archives, fill-in-the-middle texts and hard negatives against plain versions, on hostile rows too."""

import base64
import gzip
import hashlib
import itertools
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, Not, StringStartsWith

from tickcast.llm import fill_in_middle, hard_negatives, warc

PAGE = "page_id long, url string, html string, payload string, sha1 string, record_type string"


def page_rows():
    rows = [(i, f"http://a.example/{i}", f"<p>{i % 7}</p>" if i % 3 else f"own {i} é漢", "x", "y", "z") for i in range(60)]
    rows += [(100 + i, "http://hot.example/", "hot " * 50, "x", "y", "z") for i in range(80)]
    rows += [(5, "http://again/", "twice", "", "", ""), (5, "http://again/", "twice", "", "", ""), (4, None, "twice", "", "", ""), (None, "http://none/", "twice", "", "", ""), (None, None, "lonely", "", "", "")]
    rows += [(-3, "http://x/ y\r\nWARC-Type: forged", None, "", "", ""), (-2, "", "", "", "", ""), (900, "http://big/", "line\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 20_000, "", "", "")]
    return rows


def plain_pages(rows, least=0):
    body = [(r[2] or "").encode() for r in rows]
    first = {}
    for r, b in zip(rows, body):
        if len(b) >= least and r[0] is not None:
            first[b] = max(first.get(b, r[0]), r[0])
    out = []
    for r, b in zip(rows, body):
        f = first.get(b)
        again = f is not None and r[0] != f
        out.append((r[0], len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def parsed(data):
    """Records of decoded archive bytes: header text and block, by Content-Length alone."""
    while data:
        head, data = data.split(b"\r\n\r\n", 1)
        n = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
        yield head.decode(), data[:n]
        assert data[n : n + 4] == b"\r\n\r\n"
        data = data[n + 4 :]


def test_archived_pages(spark, tmp_path):
    df = spark.createDataFrame(page_rows(), PAGE).repartition(5)
    found = warc.archived_pages(df, str(tmp_path / "w"))
    assert sorted(map(tuple, found.collect()), key=str) == plain_pages(page_rows())
    names = [f"{d}/{x}" for d, _, xs in os.walk(tmp_path / "w") for x in xs if x.endswith(".gz")]
    own = [r for x in names for r in parsed(gzip.open(x).read())]
    assert len(own) == len(page_rows()) and len({re.search("Record-ID: (.*)", h)[1] for h, _ in own}) == len({r[0] for r in page_rows()}) + 1
    for head, block in own:
        http, payload = block.split(b"\r\n\r\n", 1)
        if "\r\nWARC-Type: response" in head:
            assert re.search("Payload-Digest: sha1:(.*)", head)[1].strip() == warc.base32_sha1(payload) and f"Content-Length: {len(payload)}".encode() in http
        else:
            assert not payload and "WARC-Refers-To: <urn:page:" in head
    assert not any("_temporary" in d for d, _, _ in os.walk(tmp_path / "w"))


@pytest.mark.parametrize("least", [6, 1000])
def test_small_payloads_stay_responses(spark, least):
    df = spark.createDataFrame(page_rows(), PAGE)
    got = warc.with_revisits(df, least_bytes=least).select("page_id", "payload_size", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == plain_pages(page_rows(), least)


def test_no_pages(spark, tmp_path):
    assert warc.archived_pages(spark.createDataFrame([], PAGE), str(tmp_path / "w")).collect() == []


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("warc") / "a")
    warc.write_pages(spark.createDataFrame(page_rows(), PAGE).repartition(3), at)
    return at


def test_pushed_filters_decide_in_the_reader(spark, archive):
    df = warc.read_warc(spark, archive)
    every = df.collect()
    assert {r.record_type for r in every} == {"response", "revisit"} and all((r.payload is None) == (r.record_type == "revisit") for r in every)
    assert all(r.payload_size == len(r.payload) == r.http_length and r.payload_sha1 == r.payload_digest for r in every if r.payload is not None)
    for sql in ("record_type = 'revisit'", "record_type <> 'revisit' and target_uri like 'http://a.example/1%'", "target_uri is null", "not (target_uri <=> 'http://hot.example/')", "content_length > 60 and record_id in ('urn:page:3', 'urn:page:150')"):
        want = spark.createDataFrame(every, df.schema).filter(sql)
        got = df.filter(sql)
        assert "Filter" not in got._jdf.queryExecution().optimizedPlan().toString().replace("PushedFilters", "").replace("pushedFilters", ""), sql
        assert sorted(r.record_id for r in got.collect()) == sorted(r.record_id for r in want.collect()), sql
    mixed = df.filter("http_status = 200 and record_type = 'revisit'").select("record_id")
    assert mixed.count() == sum(r.record_type == "revisit" for r in every)


def test_skipped_payloads_are_not_read(archive):
    """Bytes that a scan of headers reads: the large page is passed over by one seek, with ``sl`` fields and in plain files alike."""

    class Counted:
        def __init__(self, data):
            self.data, self.at, self.read_bytes = data, 0, 0

        def seek(self, at):
            self.at = at

        def read(self, n):
            out = self.data[self.at : self.at + n]
            self.at += len(out)
            self.read_bytes += len(out)
            return out

    big = bytes(np.random.default_rng(1).integers(0, 256, 3_000_000, np.uint8))
    made = [warc.record("response", f"urn:page:{i}", "http://x/", "2024-01-01T00:00:00Z", big if i == 1 else b"small", 5, warc.base32_sha1(b"small"), None) for i in range(3)]
    forms = {"sl": b"".join(warc.member(r, 6) for r in made), "foreign": b"".join(gzip.compress(r) for r in made), "plain": b"".join(made)}
    for form, data in forms.items():
        file = Counted(data)
        rows = list(warc.records(file, len(data), form != "plain", {"record_id"}, lambda r: True))
        assert [r["record_id"] for r in rows] == ["urn:page:0", "urn:page:1", "urn:page:2"], form
        assert (file.read_bytes < 500_000) == (form != "foreign"), form
        full = list(warc.records(Counted(data), len(data), form != "plain", {"payload", "payload_size"}, lambda r: r["record_id"] != "urn:page:0"))
        assert [r["payload"] for r in full] == [big, b"small"], form
        with pytest.raises(ValueError):
            list(warc.records(Counted(data[:-40]), len(data) - 40, form != "plain", {"payload"}, lambda r: True))


def test_conditions_follow_sql():
    row = {"record_type": "response", "target_uri": None}
    test = lambda f: warc.header_test(f)(row)
    assert test(EqualTo(("record_type",), "response")) is True and test(Not(EqualTo(("target_uri",), "x"))) is None
    assert test(In(("record_type",), ("a", None))) is None and test(StringStartsWith(("record_type",), "resp")) is True
    assert warc.header_test(EqualTo(("payload_size",), 1)) is None and warc.header_test(EqualTo(("record_type", "x"), 1)) is None


def test_sql_view_over_archives(spark, archive):
    warc.register(spark)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW archived USING warc OPTIONS (path '{archive}')")
    assert spark.sql("SELECT count(*) FROM archived WHERE record_type = 'revisit'").first()[0] == sum(r[3] == "revisit" for r in plain_pages(page_rows()))


# fill in the middle


def plain_fim(i, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return i, n, "plain", None, None, text
    a, b = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if d % 100 < 20 else (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark):
    random.seed(5)
    signs = ["a", "Zb", " ", "\n", "é", "漢", "<", "P", ">", "S", "M", "\x00", "<P", "𝄞", "\r\n"]
    rows = [(i, "".join(random.choices(signs, k=random.randrange(40))), "clash") for i in range(400)]
    rows += [(None, "none here", ""), (None, None, ""), (7, "again", ""), (7, "again", ""), (-1, "", ""), (1 << 62, "word " * 200_000, ""), (8, "x <M> y", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(4)
    out = fill_in_middle.fill_in_middle(df)
    got = out.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    want = sorted((plain_fim(i, t) for i, t, _ in rows), key=str)
    assert sorted((tuple(r)[:6] for r in got), key=str) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    texts = sorted((str(i), t or "") for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.back) for r in got) == texts
    assert fill_in_middle.fill_in_middle(df.limit(0)).collect() == []


def test_cuts_hold_no_units():
    import tracemalloc

    text = "ab, " * 300_000
    tracemalloc.start()
    n = fill_in_middle.count_units(text)
    at = fill_in_middle.cuts(text, 3, n - 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 900_000 and at == (4, len(text) - 1) and peak < 100_000
    assert fill_in_middle.cuts(text, 0, 0) == (0, 0) and fill_in_middle.cuts("", 0, 0) == (0, 0) and fill_in_middle.cuts("a b", 3, 3) == (3, 3)


# hard negatives


def plain_negatives(rows, every=10, npos=5, nneg=10):
    use = []
    for i, v, label in rows:
        if i is None or v is None or not v or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        use.append((i, np.floor(256 * np.asarray(v, float)).astype(int), (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for k, (i, q, label) in enumerate(use):
        if i % every:
            continue
        scored = [(-int(q @ p), j, other) for m, (j, p, other) in enumerate(use) if m != k and len(p) == len(q)]
        for s, j, _ in sorted(x for x in scored if x[2] == label and x[1] != i)[:npos]:
            inside = sorted((t, n) for t, n, other in scored if other != label and 30 * -s <= 100 * -t <= 90 * -s)[:nneg]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(inside)]
    return sorted(out)


def vectors(n, d=8, seed=1, labels=4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, d))
    x = (centre[rng.integers(0, 5, n)] + rng.normal(size=(n, d)) * 0.5).round(3)
    return [(int(i), [float(v) for v in x[i]], int(rng.integers(0, labels))) for i in range(n)]


def test_hard_negatives(spark, monkeypatch):
    rows = vectors(700)
    rows += [(1000 + i, rows[20][1], i % 3) for i in range(60)]  # one vector of many rows, so all tied
    rows += [(None, rows[1][1], 1), (2000, None, 1), (2010, rows[1][1], None), (2020, [1.0, None] * 4, 1), (2030, [float("inf")] * 8, 1), (2040, [float("nan")] * 8, 1), (2050, [], 1)]
    rows += [(2060, [0.0] * 8, 1), (2070, [1.0, 2.0], 1), (2080, [1.5, 2.5], 1), (2090, [1.0, 2.0], 2), (30, rows[30][1], 1), (30, rows[30][1], 1), (2100, [-x for x in rows[3][1]], 0)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<double>, label int, q string, id int").repartition(6)
    want = plain_negatives(rows)
    for group, block, chunk, pack in ((1 << 18, 4096, 1 << 16, 128), (100, 16, 20, 3)):
        for name, value in (("GROUP", group), ("BLOCK", block), ("CHUNK", chunk), ("PACK", pack)):
            monkeypatch.setattr(hard_negatives, name, value)
        got = sorted(tuple(r) for r in hard_negatives.hard_negatives(df, relabel=(7, 10), every=10).collect())
        assert got == want
    assert hard_negatives.hard_negatives(df.limit(0), relabel=(7, 10)).collect() == []


def test_bounds_hold_and_few_rows_are_scored():
    rng = np.random.default_rng(3)
    q = np.floor(256 * rng.normal(size=(3000, 32)) / 6).astype(np.int32)
    batch = hard_negatives.pa.RecordBatch.from_arrays(
        [hard_negatives.pa.array(range(3000)), hard_negatives.pa.array([i % 2 for i in range(3000)]), hard_negatives.pa.array(list(q), hard_negatives.pa.list_(hard_negatives.pa.int32()))], names=["id", "label", "q"]
    )
    ids, labels, flat = next(hard_negatives._by_length(iter([batch]), 4096))
    assert (flat == q).all()
    least = q.min(axis=0).astype(np.int64)
    width = (q.max(axis=0) - least) // hard_negatives.CELLS + 1
    cells = ((q - least) // width).astype(np.uint8)
    block = hard_negatives.Block(32, 3000, ids.tobytes(), labels.astype(np.int64).tobytes(), cells.T.tobytes(), least.tobytes(), width.tobytes(), q.tobytes(), "int32")
    anchors = q[:20]
    low, slack = block.bounds(anchors)
    exact = anchors.astype(np.int64) @ q.T.astype(np.int64)
    assert (low <= exact).all() and (exact <= low + slack[:, None]).all()
    scored = []
    block.scores = lambda rows, a, at: scored.append(len(rows)) or exact[at, rows]
    best = hard_negatives.Best(20, 5)
    pack = {"q": anchors, "ids": ids[:20], "labels": labels[:20]}
    hard_negatives.positives_of(block, pack, best)
    assert sum(scored) < 20 * 1500 / 10
    for a in range(20):
        want = sorted((-exact[a, i], i) for i in range(3000) if i != a and i % 2 == a % 2)[:5]
        assert [(-s, i) for s, i in zip(best.scores[a], best.ids[a])] == want


def test_best_keeps_the_first_of_every_list():
    rng = np.random.default_rng(7)
    best, every = hard_negatives.Best(6, 3), []
    for _ in range(20):
        n = int(rng.integers(0, 15))
        at, score, ids = rng.integers(0, 6, n), rng.integers(-4, 4, n), rng.integers(0, 1000, n)
        best.add(at, score, ids)
        every += zip(at.tolist(), score.tolist(), ids.tolist())
    for a in range(6):
        want = sorted((-s, i) for x, s, i in every if x == a)[:3]
        assert list(itertools.islice(zip(-best.scores[a], best.ids[a]), len(want))) == want
