"""Exact selection by counts against sorting, and sessions, places and lanes against plain loops."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickcast.jobs import backtest, training
from tickcast.operators import bars as B
from tickcast.operators import days, moves, scan, selection, states
from tickcast.sources import shared

KEYS = ["contract"]
BAR = "contract string, time timestamp_ntz, open double, high double, low double, close double, volume double"


def test_search_in_a_sorted_array(spark):
    for values in ([], [1.0], [1.0, 2.0, 2.0, 5.0], [float(i) for i in range(64)]):
        df = spark.createDataFrame([(values, x) for x in (0.0, 1.0, 1.5, 2.0, 5.0, 63.0, 99.0)], "v array<double>, x double")
        for r in df.select("x", selection.count_below(F.col("v"), F.col("x"), 64).alias("a"), selection.count_below(F.col("v"), F.col("x"), 64, True).alias("b")).collect():
            assert (r.a, r.b) == (sum(v < r.x for v in values), sum(v <= r.x for v in values))


@pytest.mark.parametrize("kind", ["distinct", "ties", "one", "few"])
@pytest.mark.parametrize("longest", [4096, 7])
def test_order_statistics_of_ranges(spark, kind, longest):
    rng = random.Random(3)
    make = {"distinct": lambda i: rng.random(), "ties": lambda i: rng.choice([0.5, 0.5, 0.5, rng.random()]), "one": lambda i: 2.0, "few": lambda i: float(rng.randrange(3))}[kind]
    series = {s: [make(i) for i in range(n)] for s, n in (("A", 900), ("B", 40), ("C", 1))}
    values = spark.createDataFrame([(s, i, x) for s, v in series.items() for i, x in enumerate(v)], "contract string, pos long, x double").repartition(4)
    asked, want = [], {}
    for q in range(120):
        s = rng.choice("ABC")
        lo = rng.randrange(len(series[s]) + 1)
        hi = rng.randrange(lo, len(series[s]) + 1)
        k = rng.randrange(hi - lo + 2)
        asked.append((s, q, lo, hi, k))
        if k < hi - lo:
            want[q] = sorted(series[s][lo:hi])[k]
    got = selection.order_statistics(values, KEYS, spark.createDataFrame(asked, "contract string, id int, lo long, hi long, k long"), ["id"], edges=8, longest=longest)
    found = got.collect()
    assert len(found) == len(want) and {r.id: r.x for r in found} == want


def test_quantiles_of_a_hundred_prefixes_equal_percentile(spark):
    n = 3000
    rng = np.random.default_rng(1)
    rows = [(c, int(i), float(a), float(b), float(d)) for c in "AB" for i, (a, b, d) in enumerate(zip(rng.normal(size=n), rng.integers(0, 40, n), rng.random(n).round(2)))]
    feats = spark.createDataFrame(rows, "contract string, bar_seq long, v_ewma double, sigma_ewma double, delta_x_ewma double")
    asked = spark.createDataFrame([(c, k, 40 + 29 * k + (c == "B")) for c in "AB" for k in range(100)], "contract string, id int, n_bars long")
    asked = states.with_burn_in(asked, 10, (3, 4, 2))
    got = states.prefix_boundaries(feats, KEYS, asked, ["id"], (3, 4, 2)).collect()
    plain = feats.join(asked, KEYS).filter("bar_seq >= j_s AND bar_seq < n_bars").groupBy("contract", "id").agg(
        F.percentile("v_ewma", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("a"), F.percentile("sigma_ewma", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("b"), F.percentile("delta_x_ewma", F.array(F.lit(0.5))).alias("c")
    )
    want = {(r.contract, r.id): (r.a, r.b, r.c) for r in plain.collect()}
    assert len(got) == 200 and {(r.contract, r.id): (r.volume_bounds, r.volatility_bounds, r.price_change_bounds) for r in got} == want


def test_one_long_series_is_selected_by_counts(spark):
    """A million bars with ties: equal to ``percentile``, and no gathered group is longer than a bracket."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit("A").alias("contract"), F.col("id").alias("bar_seq"), (F.hash("id") % 100_003 / 7).alias("v_ewma"), F.floor(F.sqrt(F.pmod(F.hash(F.col("id") + 1), F.lit(250_000)))).cast("double").alias("sigma_ewma"), F.when(F.col("id") % 3 == 0, 1.5).otherwise(F.pmod(F.hash("id"), F.lit(9))).alias("delta_x_ewma"))
    starts = states.burn_in(rows, KEYS, 10, (3, 3, 2))
    one = states.boundaries(rows, KEYS, starts, (3, 3, 2)).first()
    two = states.boundaries(rows, KEYS, starts, (3, 3, 2), long_series=1000).first()
    assert one.asDict() == two.asDict() and one.status == "ok"


def plain_sessions(times):
    out, last, session, place = [], None, 0, 0
    for t in times:
        session, place = (session + 1, 1) if last is None or t - last > timedelta(hours=4) else (session, place + 1)
        out.append((session, place))
        last = t
    return out


def random_times(rng, n):
    t, out = datetime(2024, 1, 1, 3), []
    for _ in range(n):
        t += timedelta(minutes=rng.choice([1, 1, 7, 60, 239, 240, 241, 600, 1500] if rng.random() < 0.4 else [1, 5, 20]))
        out.append(t)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_sessions_bars_and_places_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    times = {c: random_times(rng, 150) for c in "AB"}
    df = spark.createDataFrame([(c, t, *([float(i)] * 4), 1.0) for c, ts in times.items() for i, t in enumerate(ts)], BAR).repartition(5)
    tau = 3
    got = {(r.contract, r.time): (r.session_id, r.place, r.i) for r in days.positions(days.sessions(df, KEYS, "4 hours", "place"), KEYS, "i").collect()}
    bars = {(r.contract, r.bar_seq): (r.session_id, r.bar_idx, r.open, r.close) for r in B.tau_bars(df, KEYS, tau).collect()}
    want = {}
    for c, ts in times.items():
        seen = plain_sessions(ts)
        assert [got[c, t] for t in ts] == [(*x, i) for i, x in enumerate(seen)]
        whole = [i for i, (_, place) in enumerate(seen) if place % tau == 0]
        want |= {(c, k): (seen[i][0], seen[i][1] // tau - 1, float(i - tau + 1), float(i)) for k, i in enumerate(whole)}
    assert bars == want


def test_rates_of_their_own_go_in_one_pass(spark):
    values = [((i * 37) % 101) / 7 for i in range(700)]
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate(values)], "contract string, bar_seq long, x double")
    rates = {"a": 0.5, "b": 0.9, "c": 0.9995}
    out = scan.affine_scan(df, KEYS, {n: F.col("x") - F.coalesce("_b", F.lit(0.0)) if n != "c" else F.col("x") for n in rates}, rates, before={"_b": "x"}).orderBy("bar_seq").collect()
    for name, lam in rates.items():
        s, prev = 0.0, 0.0
        for r, v in zip(out, values):
            s = lam * s + (v - prev if name != "c" else v)
            prev = v
            assert r[name] == pytest.approx(s, rel=1e-9, abs=1e-9)
    live = scan.live_features(spark.createDataFrame([("A", datetime(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0)], BAR), KEYS)
    live.collect()
    plan = live._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    assert sum("Exchange hashpartitioning" in x and "Reused" not in x for x in plan) <= 8


def test_tau_bars_scan_bars_at_most_twice(spark, tmp_path):
    rng = random.Random(9)
    spark.createDataFrame([("A", t, 1.0, 1.0, 1.0, 1.0, 1.0) for t in random_times(rng, 300)], BAR).write.parquet(str(tmp_path / "b"))
    df = B.tau_bars(spark.read.parquet(str(tmp_path / "b")), KEYS, 5, 0.5)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Scan parquet") <= 2, final


def test_lanes_equal_bars_of_the_kept_days(spark):
    rng = random.Random(4)
    rows = [(c, t, *([float(i % 17)] * 4), 1.0) for c in "AB" for i, t in enumerate(random_times(rng, 260))]
    df = spark.createDataFrame(rows, BAR)
    dates = sorted({(r[0], r[1].date()) for r in rows})
    kept = [(c, lane, d) for lane in ("0", "1", "2") for c, d in dates if rng.random() > {"0": 0.0, "1": 0.15, "2": 0.5}[lane]]
    kept = spark.createDataFrame(kept, f"contract string, lane string, {days.DAY} date")
    for tau in (1, 3):
        got = backtest.lane_bars(df, kept, tau)
        series = df.withColumn(days.DAY, F.to_date("time")).join(kept, ["contract", days.DAY])
        want = B.tau_bars(series, ["contract", "lane"], tau)
        columns = ["contract", "lane", "bar_seq", "time", "open", "close", "volume"]
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_plans_of_cutoffs_equal_a_loop(spark):
    rng = random.Random(6)
    rows = [("A", t) for t in random_times(rng, 300)] + [("B", datetime(2024, 1, d)) for d in range(2, 12)] + [("B", datetime(2024, 1, d, 5, m)) for d in (3, 4, 8) for m in range(3)]
    df = spark.createDataFrame([(c, t, 1.0, 1.0, 1.0, 1.0, 1.0) for c, t in rows], BAR)
    asked = [(c, datetime(2024, 1, d)) for c in "AB" for d in range(1, 29)]
    got = {(r.contract, r.cutoff): (r.threshold, r.drop_rank, r.shared) for r in backtest.cutoff_plans(df, spark.createDataFrame(asked, "contract string, cutoff timestamp_ntz"), 0.9).collect()}
    want = {}
    for c, cut in asked:
        counts, every = {}, {}
        for k, t in rows:
            if k == c:
                every[t.date()] = every.get(t.date(), 0) + 1
                if t <= cut:
                    counts[t.date()] = counts.get(t.date(), 0) + 1
        if counts:
            threshold = float(np.median(list(counts.values()))) * 0.9
            want[c, cut] = (pytest.approx(threshold), sum(n < threshold for n in every.values()), cut.date() not in counts or threshold > 1)
    assert got == want


def test_ranks_of_prefixes_do_not_multiply_rows(spark):
    """Rows of the written tables follow bars plus cutoffs."""
    made = {}
    keep = selection.written

    def counted(df, name):
        out = keep(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    feats = spark.range(4000).select(F.lit("A").alias("contract"), F.col("id").alias("bar_seq"), F.rand(1).alias("v_ewma"), F.rand(2).alias("sigma_ewma"), F.rand(3).alias("delta_x_ewma"))
    asked = states.with_burn_in(spark.range(200).select(F.lit("A").alias("contract"), F.col("id"), (F.col("id") * 15 + 1000).alias("n_bars")), 10, (3, 3, 2))
    selection.written = counted
    try:
        assert states.prefix_boundaries(feats, KEYS, asked, ["id"], (3, 3, 2)).count() == 200
    finally:
        selection.written = keep
    assert made["dealt"] == 3 * 4000 and made["picks"] <= 10 * 200


def test_training_of_a_long_series_is_the_same(spark, monkeypatch):
    rng = random.Random(2)
    df = spark.createDataFrame([("A", datetime(2024, 1, 1) + timedelta(minutes=i), x, x + rng.randrange(3), x - rng.randrange(3), x, float(rng.randrange(20))) for i in range(700) for x in [50.0 + rng.randrange(10)]], BAR)
    p = training.Params(tau=2, sizes=(2, 3, 2))
    one = training.fit(df, KEYS, p)["pmf"].collect()
    monkeypatch.setattr(states.boundaries, "__defaults__", (None, 10))
    assert sorted(map(str, training.fit(df, KEYS, p)["pmf"].collect())) == sorted(map(str, one))


def test_counts_by_moves_equal_counting_every_prefix(spark):
    """Two lanes, a hundred prefixes, ties and degenerate boundaries among them; rows follow bars plus moves."""
    rng = np.random.default_rng(8)
    n = 900
    rows = [("A", lane, i, float(a), float(b), float(c), int(x), int(x // 2), int(x % 3)) for lane in ("0", "1") for i, (a, b, c, x) in enumerate(zip(np.sin(np.arange(n) / 40) + rng.normal(size=n) / 4, np.where(np.arange(n) < 60, 5, rng.integers(0, 9, n)), rng.normal(size=n), rng.integers(0, 30, n)))]
    feats = spark.createDataFrame(rows, "contract string, lane string, bar_seq long, v_ewma double, sigma_ewma double, delta_x_ewma double, r long, r_up long, r_dn long").repartition(4)
    asked = spark.createDataFrame([("A", str(k % 2), datetime(2024, 1, 1) + timedelta(days=k), 3 + 8 * k) for k in range(110)], "contract string, lane string, cutoff timestamp_ntz, n_bars long")
    asked = states.with_burn_in(asked, 10, (3, 3, 2))
    bounds = states.prefix_boundaries(feats, ["contract", "lane"], asked, ["cutoff"], (3, 3, 2))
    assert {r.status for r in bounds.collect()} == {"ok", "degenerate_bins"}
    one = backtest.cutoff_frequencies(feats, bounds, many=0)
    two = backtest.cutoff_frequencies(feats, bounds, many=1 << 40)
    columns = ["contract", "cutoff", "m", "n", "k", "direction", "ell", "n_seen"]
    assert sorted(map(tuple, one.select(columns).collect())) == sorted(map(tuple, two.select(columns).collect()))
    prefixes = moves.numbered(bounds, ["contract", "lane"], "cutoff")
    given = backtest.classified(feats, bounds).filter("bar_seq >= j_s").count()
    assert moves.stays(feats, ["contract", "lane"], prefixes).count() < given / 3


def test_backtests_by_moves_are_the_same(spark, monkeypatch):
    rng = random.Random(5)
    rows = [("A", datetime(2024, 1, 1) + timedelta(days=d, minutes=9 * i), x, x + rng.randrange(4), x - rng.randrange(3), x, float(rng.randrange(30))) for d in range(15) for i in range(60 if d % 5 else 40) for x in [50.0 + rng.randrange(8)]]
    bars = spark.createDataFrame(rows, BAR)
    asked = spark.createDataFrame([("A", datetime(2024, 1, d, 7, 30), float((-1) ** d)) for d in range(2, 16)], "contract string, timestamp timestamp_ntz, signal double")
    p = training.Params(tau=3, sizes=(2, 3, 2))
    one = sorted(map(str, backtest.place(bars, asked, p).collect()))
    monkeypatch.setattr(backtest, "MANY_BARS", 0)
    two = sorted(map(str, backtest.place(bars, asked, p).collect()))
    assert one == two and any("status='ok'" in x for x in one)


def test_tables_of_a_stage_are_deleted(spark):
    import os

    at = lambda df: df._written_at.removeprefix("file:")
    with shared.scratch() as keep:
        one = shared.written(spark.range(3), "one")
        with shared.scratch() as inner:
            two, three = inner(shared.written(spark.range(4), "two")), shared.written(spark.range(5), "three")
        assert os.path.exists(at(two)) and not os.path.exists(at(three))
        four = keep(shared.written(one.join(two, "id"), "four"))
    assert four.count() == 3 and [os.path.exists(at(t)) for t in (one, two, four)] == [False, False, True]
