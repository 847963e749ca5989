"""Fixtures with golden numbers, edge cases and invariants of the range library."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickcast.functions import instruments as I  # noqa: E741
from tickcast.jobs import backtest, training
from tickcast.operators import bars as B
from tickcast.operators import model as M
from tickcast.operators import days, scan, signals, states

KEYS = ["contract"]
BAR = "contract string, time timestamp_ntz, open double, high double, low double, close double, volume double"


def bars(spark, times, contract="A"):
    return spark.createDataFrame([(contract, t, 10.0, 11.0, 9.0, 10.5, 1.0) for t in times], BAR)


def series(spark, values):
    return spark.createDataFrame([("A", i, float(v)) for i, v in enumerate(values)], "contract string, bar_seq long, x double")


@pytest.mark.parametrize(
    ("eta", "h", "mean", "std"),
    [
        ([10, 20, 30, 40, 50], 2, [0, 10, 15.857864376, 22.265409197, 29.191197710], [0, 0, 3.170253356, 5.709809522, 8.092905227]),
        ([10, 20, 999, 40, 50], 2, [0, 10, 15.857864376, 461.301711500, 296.773159003], [0, 0, 3.170253356, 361.939592678, 324.945698448]),
        ([5, 10, 15, 20, 25], 3, [0, 5, 7.787533330, 10.763389491, 13.922651234], [0, 0, 1.651968528, 3.001449947, 4.308159937]),
    ],
)
def test_shifted_average(spark, eta, h, mean, std):
    df = scan.shifted_std(scan.shifted_means(series(spark, eta), KEYS, h, {"x": "mean"}), KEYS, h, "x", "mean", "std")
    got = df.orderBy("bar_seq").collect()
    assert [r["mean"] for r in got] == pytest.approx(mean, abs=1e-8)
    assert [r["std"] for r in got] == pytest.approx(std, abs=1e-8)


def test_scan_over_many_blocks_equals_a_loop(spark):
    values = [math.sin(i) * 5 + i % 7 for i in range(900)]
    got = [r["s"] for r in scan.affine_scan(series(spark, values), KEYS, {"s": F.col("x")}, 0.5).orderBy("bar_seq").collect()]
    s, want = 0.0, []
    for v in values:
        s = 0.5 * s + v
        want.append(s)
    assert got == pytest.approx(want, rel=1e-12)


def test_shifted_scan_and_previous_rows_over_blocks(spark):
    values = [math.cos(i) * 3 + i % 5 for i in range(300)]
    df = scan.previous(scan.affine_scan(series(spark, values), KEYS, {"s": F.col("x")}, 0.5, shift=True), KEYS, {"p": "x"}, size=7)
    got = df.orderBy("bar_seq").collect()
    s, want = 0.0, []
    for v in values:
        want.append(s)
        s = 0.5 * s + v
    assert [r["s"] for r in got] == pytest.approx(want, rel=1e-12) and [r["p"] for r in got] == [None, *values[:-1]]


def test_positions_sessions_and_as_of_over_days(spark):
    t = datetime(2024, 1, 1)
    times = [t + timedelta(hours=h) for h in (0, 3, 20, 23, 26, 28, 80, 83, 87, 92, 120)]
    b = bars(spark, times).repartition(3)
    got = [(r.session_id, r.place) for r in days.sessions(b, KEYS, "4 hours", "place").orderBy("time").collect()]
    want, last, place, session = [], None, 0, 0
    for x in times:
        session, place = (session + 1, 1) if last is None or x - last > timedelta(hours=4) else (session, place + 1)
        want.append((session, place))
        last = x
    assert got == want and [r.i for r in days.positions(b, KEYS, "i").orderBy("time").collect()] == list(range(len(times)))
    at = [t + timedelta(hours=h) for h in (-1, 0, 1, 50, 80, 81, 200)]
    asked = spark.createDataFrame([("A", x, k) for k, x in enumerate(at)], "contract string, at timestamp_ntz, id int")
    found = {r.id: r.time for r in signals.as_of_prior(asked, b, KEYS, "at", "time", ["time"]).collect()}
    assert found == {k: max((y for y in times if y < x), default=None) for k, x in enumerate(at)}


def test_session_gap_of_exactly_four_hours_does_not_split(spark):
    t = datetime(2024, 1, 1)
    df = B.with_sessions(bars(spark, [t, t + timedelta(hours=4), t + timedelta(hours=8, minutes=1)]), KEYS)
    assert [r.session_id for r in df.orderBy("time").collect()] == [1, 1, 2]


def test_tau_bars_drop_unfinished(spark):
    t = datetime(2024, 1, 1)
    times = [t + timedelta(minutes=i) for i in range(3)] + [t + timedelta(hours=9, minutes=i) for i in range(4)]
    got = B.tau_bars(bars(spark, times), KEYS, 2)
    assert sorted((r.session_id, r.bar_idx, r.bar_seq) for r in got.collect()) == [(1, 0, 0), (2, 0, 1), (2, 1, 2)]
    assert B.tau_bars(bars(spark, times), KEYS, 1).count() == 7


def test_ranges_round_half_to_even(spark):
    df = spark.createDataFrame([(0.0, 0.5, 0.0), (0.0, 1.5, 0.0), (0.0, 2.5, 0.0)], "open double, high double, low double")
    assert sorted(r.r for r in B.tick_ranges(df, 1.0).collect()) == [0, 2, 2]


def test_bins_at_boundaries(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "x double").withColumn("b", F.array(F.lit(2.0)))
    got = df.select("x", states.right_closed(F.col("x"), F.col("b")).alias("t"), states.left_closed(F.col("x"), F.col("b")).alias("l")).collect()
    assert {r.x: (r.t, r.l) for r in got if r.x} == {1.0: (1, 1), 2.0: (1, 2), 3.0: (2, 2)}
    assert next(r.l for r in got if r.x is None) == 1


@pytest.mark.parametrize(("n", "want"), [(1000, 150), (120, 60)])
def test_burn_in(spark, n, want):
    assert states.burn_in(series(spark, range(n)), KEYS, 10, (3, 3, 2)).first().j_s == want


@pytest.mark.parametrize(("counts", "kept"), [([100, 100, 89, 90], 4), ([100, 100, 100, 89], 3)])
def test_sparse_days(spark, counts, kept):
    t = datetime(2024, 1, 1)
    times = [t + timedelta(days=d, minutes=i) for d, n in enumerate(counts) for i in range(n)]
    assert B.daily_counts(bars(spark, times), KEYS).filter("is_kept").count() == kept


def test_cutoff_is_inclusive_and_as_of_is_strict(spark):
    t = datetime(2024, 1, 2)
    b = bars(spark, [t - timedelta(minutes=1), t, t + timedelta(minutes=1)])
    assert B.until_cutoff(b, "2024-01-02 00:00:00").count() == 2
    asked = spark.createDataFrame([("A", t + timedelta(minutes=1), 1)], "contract string, at timestamp_ntz, id int")
    assert signals.as_of_prior(asked, b, KEYS, "at", "time", ["time", "close"]).first().time == t


def frame(spark):
    rows = [("A", 1, 1, 1, 5, 3, 2)] * 3 + [("A", 2, 1, 1, 10, 7, 3)] * 2
    df = spark.createDataFrame(rows, "contract string, m int, n int, k int, r long, r_up long, r_dn long")
    return df.withColumns({"bar_seq": F.lit(1), "j_s": F.lit(0)})


def test_smoothing_and_queries(spark):
    freq = M.frequencies(frame(spark), KEYS)
    smooth, raw = M.pmf(freq, KEYS, "smoothed", 1.0), M.pmf(freq, KEYS, "raw")
    got = {(r.m, r.direction, r.ell): (r.prob, r.denominator) for r in smooth.collect()}
    assert got[1, "range", 5] == pytest.approx((4 / 9, 9)) and got[2, "range_up", 7] == pytest.approx((3 / 10, 10))
    asked = spark.createDataFrame([("A", 1, 1, 1, "range", e) for e in (0, 5, 6, 15, 16, -1)] + [("A", 9, 9, 9, "range", 0)], "contract string, m int, n int, k int, direction string, ell long")
    p = {(r.m, r.ell): r.prob for r in M.query_pdf(asked, smooth, KEYS, True).collect()}
    assert [p[1, e] for e in (6, 15, 16, -1)] == pytest.approx([1 / 9, 1 / 9, 0, 0]) and p[9, 0] == 0
    q = {(r.m, r.ell): r.prob for r in M.query_pdf(asked, raw, KEYS, False).collect()}
    assert (q[1, 5], q[1, 6], q[1, 0]) == (1.0, 0.0, 0.0)
    c = {r.ell: r.cum_prob for r in M.reverse_cdf(smooth, KEYS).filter("m = 1 AND direction = 'range_dn'").collect()}
    assert c == pytest.approx({2: 4 / 6, 1: 5 / 6, 0: 1.0})
    with pytest.raises(ValueError):
        M.pmf(freq, KEYS, "other")
    odd = spark.createDataFrame([("A", 1, 1, 1, d, 1) for d in ("range", "up", None)], "contract string, m int, n int, k int, direction string, ell long")
    got = M.query_cdf(M.query_pdf(odd, smooth, KEYS, True).withColumnRenamed("query_status", "first"), M.steps(smooth, KEYS), KEYS).collect()
    assert {r.direction: (r.first, r.query_status, r.prob is None, r.cum_prob) for r in got} == {"range": ("ok", "bad_direction", False, None), "up": ("bad_direction", "bad_direction", True, None), None: ("bad_direction", "bad_direction", True, None)}
    with pytest.raises(Exception, match="no such direction"):
        M.query_cdf(odd, M.steps(smooth, KEYS), KEYS, strict=True).collect()


@pytest.mark.parametrize("method", ["raw", "smoothed"])
@pytest.mark.parametrize("bins", [0, 5, 1000])
def test_stored_levels_and_steps_equal_a_loop(spark, method, bins):
    """Negative, missing and only negative levels; every bin count at which levels are filled."""
    cases = {(1, "range_up"): [0, 2, 2, 5], (2, "range_up"): [3], (3, "range_up"): [-2, -2, 4], (4, "range_up"): [-3, -1], (5, "range_dn"): [7, 900_000], (6, "range"): [1, 1], (7, "range_dn"): [0]}
    df = spark.createDataFrame([("A", m, 1, 1, d, e) for (m, d), v in cases.items() for e in v], "contract string, m int, n int, k int, direction string, ell long")
    freq = df.groupBy("contract", "m", "n", "k", "direction", "ell").agg(F.count("*").alias("n_seen"))
    alpha = 0.5 if method == "smoothed" else 0.0
    pmf = M.pmf(freq, KEYS, method, 0.5, bins)
    got = {}
    for r in pmf.collect():
        assert (r.m, r.direction, r.ell) not in got
        got[r.m, r.direction, r.ell] = r.prob
    want, cum = {}, {}
    for (m, d), v in cases.items():
        n = max(v) + 1
        levels = {*v, 0} | (set(range(n)) if method == "smoothed" and 0 < n <= bins else set())
        for e in levels:
            want[m, d, e] = (v.count(e) + alpha) / (len(v) + alpha * n)
        for e in (0, 1, 2, 5, 899_999, 900_000, 900_001, -1):
            top = max(*v, 0)  # level 0 is always stored
            cum[m, d, e] = (sum(x >= e for x in v) + alpha * (top - e + 1)) / (len(v) + alpha * n) if d != "range" and 0 <= e <= top else 0.0
    assert got == pytest.approx(want)
    asked = spark.createDataFrame([("A", m, 1, 1, d, e) for m, d, e in cum if d != "range"], "contract string, m int, n int, k int, direction string, ell long")
    steps = M.steps(pmf, KEYS)
    assert {(r.m, r.direction, r.ell): r.cum_prob for r in M.query_cdf(asked, steps, KEYS).collect()} == pytest.approx({k: v for k, v in cum.items() if k[1] != "range"})
    assert steps.agg(F.max(F.size("levels"))).first()[0] <= max(bins, 4)


def test_issues_are_listed(spark):
    by = "contract string, m int, n int, k int, direction string, ell long"
    pmf = spark.createDataFrame([("A", 1, 1, 1, "range", e, p, 2, 0.1) for e, p in ((0, 0.5), (1, 0.5))] + [("A", 2, 1, 1, "range_up", 0, 0.5, 3, 0.2)], by + ", prob double, num_bins long, base_prob double")
    cdf = spark.createDataFrame([("A", 2, 1, 1, "range_up", e, c) for e, c in ((0, 0.9), (1, 0.4), (2, 0.6))], by + ", cum_prob double")
    got = [(r.m, r.direction, r.issue, r.ell, round(r.value, 6)) for r in M.issues(pmf, cdf, KEYS).orderBy("issue").collect()]
    assert got == [(2, "range_up", "bad_step", 1, 0.2), (2, "range_up", "bad_sum", None, 0.9)]
    r = M.validate(pmf, cdf, KEYS).first()
    assert (r.n_distributions, r.bad_sums, r.bad_steps, r.is_valid) == (2, 1, 1, False)


def test_sparse_storage_keeps_the_cumulative(spark):
    freq = M.frequencies(frame(spark), KEYS)
    dense, sparse = (M.reverse_cdf(M.pmf(freq, KEYS, "smoothed", 1.0, bins), KEYS) for bins in (1000, 1))
    by = ["m", "direction", "ell"]
    a, b = ({tuple(r[x] for x in by): r.cum_prob for r in d.collect()} for d in (dense, sparse))
    assert a == pytest.approx(b)


@pytest.mark.parametrize(
    ("cum", "want"),
    [([1.0, 0.8, 0.6, 0.5], (3, 2, 0.6)), ([0.9] * 10, (9, 9, 0.9)), ([], (0, 0, 0.0))],
)
def test_level_search(spark, cum, want):
    schema = "contract string, m int, n int, k int, direction string, ell long, cum_prob double"
    cdf = spark.createDataFrame([("A", 1, 1, 1, "range_dn", e, c) for e, c in enumerate(cum)], schema)
    asked = spark.createDataFrame([(7, "A", 1, 1, 1, "range_dn")], "id int, contract string, m int, n int, k int, direction string")
    by = ["contract", "m", "n", "k", "direction"]
    steps = cdf.groupBy(*by).agg(F.lit(0.0).alias("base_prob"), F.array_sort(F.collect_list(F.struct("ell", "cum_prob"))).alias("s")).select(*by, "base_prob", F.col("s.ell").alias("levels"), F.col("s.cum_prob").alias("cums"))
    r = signals.placement_levels(asked, steps, KEYS, 0.6).first()
    assert (r.level, r.accepted_level, r.accepted_prob) == want


def test_file_names(spark):
    df = spark.createDataFrame([("d/VGH22.csv",), ("ESM2020.csv",), ("6EH22.csv",), ("foo.csv",)], "path string")
    got = {r.path: r for r in I.parse_symbol(I.contract_details(df, "path").drop("symbol", "tick_size"), "path").collect()}
    assert (got["d/VGH22.csv"].symbol, got["d/VGH22.csv"].month, got["d/VGH22.csv"].year) == ("VG", 3, 22)
    assert (got["ESM2020.csv"].month, got["ESM2020.csv"].year) == (6, 20)
    assert got["6EH22.csv"].parse_status == "unknown_symbol" and got["foo.csv"].parse_status == "no_match"


def test_inventory_signals(spark):
    t = datetime(2024, 1, 1, 20)
    values = [1, 1, 3, 0, None, 4, 4, 7]
    df = spark.createDataFrame([("A", t + timedelta(hours=3 * i), v) for i, v in enumerate(values)], "market string, timestamp timestamp_ntz, inventory int").repartition(3)
    got = signals.inventory_signals(df, ["market"], ["timestamp"]).orderBy("timestamp").collect()
    assert [(r.inventory, r.signal) for r in got] == [(3, 2.0), (0, -3.0), (7, 3.0)]


def test_backtest_without_data_keeps_every_signal(spark):
    t = datetime(2024, 1, 2, 12)
    asked = spark.createDataFrame([("A", t, 1.0), ("B", t, -1.0)], "contract string, timestamp timestamp_ntz, signal double")
    got = backtest.place(bars(spark, [t - timedelta(minutes=1)]), asked, training.Params()).collect()
    assert {r.contract: r.status for r in got} == {"A": "no_bars", "B": "no_prior_bar"} and all(r.opti_price is None for r in got)
