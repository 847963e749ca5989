"""Readers and writers on files: names of columns, folders, refusals, and the jobs from folders to folders."""

import math
import re
from datetime import datetime, timedelta
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from tickcast.functions import instruments as I  # noqa: E741
from tickcast.jobs import backtest, folders, training
from tickcast.sources import files, store
from tickcast.streaming import score as stream

HEADER = "day,hour,min,price,inventory,date,timestamp,minute,main_contract,main_volume,main_contract_clean"


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_bars_are_read_by_name(spark, tmp_path):
    put(tmp_path / "Gold + more" / "GCH22.csv", "time,open,high,low,close,volume\n2024-01-01 00:00:00,1,4,0.5,2,10\n")
    put(tmp_path / "Oil" / "CLH22.csv", "volume,extra,time,low,high,close,open\n11,x,2024-01-01 00:01:00,0.25,5,3,2\n")
    put(tmp_path / "Oil" / "AIAgent_Oil.csv", "inventory,timestamp\n1,2024-01-01 00:00:00\n")
    got = {r.contract: tuple(r)[0:1] + tuple(r)[3:] for r in files.read_bars(spark, str(tmp_path)).collect()}
    assert got == {"GCH22.csv": ("Gold + more", 1.0, 4.0, 0.5, 2.0, 10.0), "CLH22.csv": ("Oil", 2.0, 5.0, 0.25, 3.0, 11.0)}
    found = {(r.market, r.filename) for r in files.discover_files(spark, str(tmp_path)).collect()}
    assert found == {("Gold + more", "GCH22.csv"), ("Oil", "CLH22.csv")}
    put(tmp_path / "Oil" / "CLM22.csv", "time,open,high,low,close\n2024-01-01 00:00:00,1,4,0.5,2\n")
    with pytest.raises(ValueError, match="CLM22.csv lacks volume"):
        files.read_bars(spark, str(tmp_path))


def test_headers_are_found_without_reading_files(spark, tmp_path):
    long = ",".join(f"column{i}" for i in range(4000))  # longer than a block
    texts = {
        "plain.csv": "a,b\n1,2\n" * 3, "blank.csv": "\n \r\n\na,b\r\n1,2\r\n", "empty.csv": "", "spaces.csv": " \n\n", "one.csv": "a,b", "old.csv": "c,d\r1,2\r",
        "mark.csv": "\ufeffa,b\n1,2\n", "long.csv": long + "\n1\n", "é [1] 5% + x.csv": "ü,b\n", "late.csv": "\n" * 3 * files.HEAD_BYTES + "e,f\n1,2\n",
    }
    for name, text in texts.items():
        (tmp_path / "Gold = 1").mkdir(exist_ok=True)
        (tmp_path / "Gold = 1" / name).write_bytes(text.encode())
    (tmp_path / "other.txt").write_text("x,y\n")
    first = files.first_lines(spark, str(tmp_path))
    got = {r.path: r.header for r in first.collect()}
    named = {unquote(p.rsplit("/", 1)[1]): h for p, h in got.items()}
    assert named == {n: "" if not t.strip() else t.strip(" \r\n\ufeff").replace("\r", "\n").split("\n")[0] for n, t in texts.items() if t}
    assert {r.path: r.header for r in files.first_lines_by_scan(spark, str(tmp_path)).collect()} == got
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "Format: text" not in plan and "ReadSchema: struct<>" in plan


def test_a_storage_that_only_spark_opens_is_read_by_a_scan(spark, tmp_path, monkeypatch):
    put(tmp_path / "Gold" / "GCH22.csv", "time,open,high,low,close,volume\n2024-01-01 00:00:00,1,4,0.5,2,10\n")
    first = files.first_lines
    monkeypatch.setattr(files, "first_lines", lambda *a: first(*a).withColumn("header", F.lit(None).cast("string")))
    assert [r.close for r in files.read_bars(spark, str(tmp_path)).collect()] == [2.0]


def test_blank_lines_come_before_a_header(spark, tmp_path):
    put(tmp_path / "Gold" / "GCH22.csv", "\n\nvolume,time,open,high,low,close\n10,2024-01-01 00:00:00,1,4,0.5,2\n")
    put(tmp_path / "Gold" / "GCM22.csv", "")
    bars, rejects = files.sorted_bars(spark, str(tmp_path))
    assert [tuple(r)[3:] for r in bars.collect()] == [(1.0, 4.0, 0.5, 2.0, 10.0)] and not rejects.count()


def test_header_and_blank_lines_of_a_refused_file_are_no_rows(spark, tmp_path):
    put(tmp_path / "Gold" / "GCH22.csv", '\n"time", open,high, low,close\n2024-01-01 00:00:00,1,4,0.5,2\n\n2024-01-01 00:01:00,1,4,0.5,2\n')
    bars, rejects = files.sorted_bars(spark, str(tmp_path))
    assert not bars.count() and sorted(r.raw for r in rejects.collect()) == ["2024-01-01 00:00:00,1,4,0.5,2", "2024-01-01 00:01:00,1,4,0.5,2"]


def test_names_with_signs_of_patterns_and_addresses(spark, tmp_path):
    names = ["é [1] 5% + x.csv", "{a,b}?.csv", "*.csv", "a%20b.csv", "back\\slash.csv"]
    for i, name in enumerate(names):
        put(tmp_path / "Gold [2]" / name, f"time,open,high,low,close,volume\n2024-01-01 00:00:00,1,4,0.5,2,{i}\n")
    bars = files.read_bars(spark, str(tmp_path))
    assert {(r.market, r.contract): r.volume for r in bars.collect()} == {("Gold [2]", n): float(i) for i, n in enumerate(names)}
    assert {(r.market, r.filename) for r in files.discover_files(spark, str(tmp_path)).collect()} == {("Gold [2]", n) for n in names}


def test_written_folders_are_read_back(spark, tmp_path):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(f"M {i % 2}", f"C{i % 3}.csv", t + timedelta(minutes=i), float(i)) for i in range(12)], "market string, filename string, time timestamp_ntz, x double")
    df = df.select("market", "filename", "time", *(F.col("x").alias(c) for c in files.OHLCV))
    files.write_by(df, str(tmp_path / "out"), ["market", "filename"], "csv")
    back = files.read_bars(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert {(r.market, r.filename) for r in files.discover_files(spark, str(tmp_path / "out")).collect()} == {(f"M {i % 2}", f"C{i % 3}.csv") for i in range(12)}


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_written_times_keep_their_microseconds(spark, tmp_path, fmt):
    times = [datetime(2024, 1, 9, 9, 20, 0, us) for us in (0, 1, 425, 999, 1000, 123456, 999999)]
    df = spark.createDataFrame([("M", t) for t in times], "market string, ntz timestamp_ntz").withColumn("zoned", F.col("ntz").cast("timestamp"))
    files.write_by(df, str(tmp_path), "market", fmt, ["ntz"])
    back = spark.read.schema("ntz timestamp_ntz, zoned timestamp").option("header", True).option("mode", "FAILFAST").format(fmt).load(str(tmp_path))
    assert sorted(r.ntz for r in back.collect()) == times
    assert back.filter("zoned = cast(ntz as timestamp)").count() == len(times)


def table(spark, markets, n=6):
    t = datetime(2024, 1, 1)
    rows = [(m, f"{m}{k}.csv", t + timedelta(minutes=i), *([float(i)] * 5)) for m in markets for k in range(2) for i in reversed(range(n))]
    return spark.createDataFrame(rows, "market string, filename string, time timestamp_ntz, open double, high double, low double, close double, volume double").repartition(3)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_other_markets_stay_and_a_repeated_run_changes_nothing(spark, tmp_path, fmt):
    out, by = str(tmp_path / "out"), ["market", "filename"]
    read = lambda: sorted(map(str, spark.read.option("header", True).format(fmt).load(out).collect()))
    files.write_by(table(spark, "X"), out, by, fmt, ["time"])
    files.write_by(table(spark, "Y"), out, by, fmt, ["time"])
    both = read()
    assert len(both) == 24
    files.write_by(table(spark, "Y"), out, by, fmt, ["time"])
    assert read() == both
    files.write_by(table(spark, "Y", 3), out, by, fmt, ["time"])
    assert len(read()) == 18
    files.write_by(table(spark, "Y").limit(0), out, by, fmt, ["time"])
    assert len(read()) == 18


def test_large_folders_are_split_in_order(spark, tmp_path):
    files.write_by(table(spark, "X", 400), str(tmp_path / "out"), ["market", "filename"], "csv", ["time"], rows=50)
    for k in range(2):
        parts = sorted((tmp_path / "out" / "market=X" / f"filename=X{k}.csv").glob("*.csv"))
        lines = [x for p in parts for x in p.read_text().splitlines() if not x.startswith("time")]
        assert len(parts) >= 8 and len(lines) == 400 and lines == sorted(lines)


def test_rejects_and_status_of_files(spark, tmp_path):
    head = "time,open,high,low,close,volume\n"
    put(tmp_path / "Oil" / "CLH22.csv", head + "2024-01-01 00:00:00,1,4,0.5,2,10\n2024-01-01 00:01:00,1,4,0.5,abc,10\n2024-01-01 00:02:00,1,4,,2,10\n2024-01-01 00:00:00,1,4,0.5,1.5,10\nnot a time,1,4,0.5,2,10\n2024-01-01 00:03:00,1,4\n")
    put(tmp_path / "Oil" / "CLM22.csv", "time,open,high,low,close\n2024-01-01 00:00:00,1,4,0.5,2\n2024-01-01 00:01:00,1,4,0.5,2\n")
    put(tmp_path / "Gold" / "GCH22.csv", head + "2024-01-01 00:00:00,1,4,0.5,2,10\n")
    put(tmp_path / "Gold" / "GCM22.csv", head)
    put(tmp_path / "Gold" / "AIAgent_Gold.csv", "inventory,timestamp\nxyz,2024-01-01 00:00:00\n")
    good, bad = files.sorted_bars(spark, str(tmp_path))
    assert sorted((r.contract, r.time.minute, r.close) for r in good.collect()) == [("CLH22.csv", 0, 1.5), ("GCH22.csv", 0, 2.0)]
    found = sorted(((r.contract, r.reason, r.time.minute if r.time else None) for r in bad.collect()), key=str)
    want = [("CLH22.csv", "missing_value", 2), ("CLH22.csv", "repeated_time", 0), ("CLH22.csv", "unparsable", 1), ("CLH22.csv", "unparsable", 3), ("CLH22.csv", "unparsable", None), ("CLM22.csv", "missing_column", None), ("CLM22.csv", "missing_column", None)]
    assert found == want
    assert {r.raw for r in bad.filter("reason = 'unparsable'").collect()} == {"2024-01-01 00:01:00,1,4,0.5,abc,10", "not a time,1,4,0.5,2,10", "2024-01-01 00:03:00,1,4"}
    status = {r.contract: (r.n_rows, r.n_bars, r.n_rejects, r.status) for r in files.file_status(spark, str(tmp_path), good, bad).collect()}
    assert status == {"CLH22.csv": (6, 1, 5, "some_rejected"), "CLM22.csv": (2, 0, 2, "missing_column"), "GCH22.csv": (1, 1, 0, "ok"), "GCM22.csv": (0, 0, 0, "no_rows")}
    (tmp_path / "Oil" / "CLM22.csv").unlink()
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_bars(spark, str(tmp_path)).collect()
    assert files.sorted_bars(spark, str(tmp_path / "none").replace("none", "Gold"))[1].count() == 0


def small_model(spark, shift=0.0):
    rows = [("VGH22.csv", datetime(2024, 1, 1) + timedelta(minutes=i), x, x + i % 4, x - i % 3, x, 10.0 + i % 7) for i in range(300) for x in [50.0 + shift + (i * i) % 11]]
    rows += [("ESM22.csv", *r[1:]) for r in rows]
    df = spark.createDataFrame(rows, "contract string, time timestamp_ntz, open double, high double, low double, close double, volume double")
    return training.fit(df, ["contract"], training.Params(tau=2, sizes=(2, 2, 1)))


def test_models_are_versions_side_by_side(spark, tmp_path):
    path, keys = str(tmp_path / "m"), ["contract"]
    with pytest.raises(ValueError, match="No model"):
        store.load_model(spark, path)
    m = small_model(spark)
    assert store.save_model(m, path, keys) == 1
    answers = lambda model: sorted(map(str, model["cdf"].collect()))
    first = answers(store.load_model(spark, path))
    assert first == answers(m)
    # a crash between two tables: nothing is published, readers keep the old model
    broken = dict(m, cdf=m["cdf"].withColumn("cum_prob", F.raise_error(F.lit("disk full")).cast("double")))
    with pytest.raises(Exception, match="disk full"):
        store.save_model(broken, path, keys)
    assert store.versions(spark, path) == [1] and answers(store.load_model(spark, path)) == first
    held = store.load_model(spark, path)["pmf"]
    assert store.save_model(small_model(spark, 3.0), path, keys) == 2 and held.count() == m["pmf"].count()
    assert answers(store.load_model(spark, path, version=1)) == first
    assert store.retire(spark, path, 1) == [1] and store.versions(spark, path) == [2]
    with pytest.raises(ValueError, match="not fitted"):
        store.save_model({k: v for k, v in m.items() if k != "bounds"}, path, keys)
    with pytest.raises(ValueError, match="lacks"):
        store.save_model(dict(m, steps=m["steps"].drop("cums")), path, keys)


def test_loading_one_symbol_reads_its_folder_alone(spark, tmp_path):
    path = str(tmp_path / "m")
    store.save_model(small_model(spark), path, ["contract"])
    one = store.load_model(spark, path, ["VG"])["pmf"]
    assert {r.contract for r in one.collect()} == {"VGH22.csv"}
    assert re.search(r"PartitionFilters: \[[^\]]*symbol#\d+ = VG", one._jdf.queryExecution().executedPlan().toString())
    spark.createDataFrame([("ES", 1), ("XX", 2)], "symbol string, k int").write.parquet(str(tmp_path / "s"))
    some = store.load_model(spark, path, spark.read.parquet(str(tmp_path / "s")).filter("k < 3"))["cdf"]
    assert {r.contract for r in some.collect()} == {"ESM22.csv"}
    assert "dynamicpruning" in some._jdf.queryExecution().executedPlan().toString()


def test_a_stream_follows_the_published_model(spark, tmp_path):
    """Two versions and a restart in between: each batch says which model it was scored with, and no reading is lost or comes twice."""
    path, keys, out = str(tmp_path / "m"), ["contract"], str(tmp_path / "out")
    schema = "contract string, id int, volume double, volatility double, price_change double, direction string, ell long"
    put_in = lambda name, ids: spark.createDataFrame([("VGH22.csv", i, 12.0, 2.0, 0.0, "range_up", 1) for i in ids], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: stream.start_scoring(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), path, out, str(tmp_path / "at"), keys, availableNow=True).awaitTermination()
    store.save_model(small_model(spark), path, keys)
    put_in("a", range(5))
    run()
    store.save_model(small_model(spark, 9.0), path, keys)
    put_in("b", range(5, 8))
    run()
    run()
    got = spark.read.parquet(out)
    assert sorted((r.id, r.model_version) for r in got.collect()) == [(i, 1 + (i > 4)) for i in range(8)]
    # the last batch again, as after a crash before its end was noted
    last = max(p.name for p in (tmp_path / "at" / "commits").iterdir() if p.name.isdigit())
    (tmp_path / "at" / "commits" / last).unlink()
    (tmp_path / "at" / "commits" / f".{last}.crc").unlink(missing_ok=True)
    run()
    again = spark.read.parquet(out)
    assert sorted(r.id for r in again.collect()) == list(range(8)) and {"state_exists", "sample_count", "max_range_up", "cum_prob"} <= set(again.columns)


def test_from_inventories_to_signals(spark, tmp_path):
    row = "44564,4,0,4324.0,{},2022-01-03,2022-01-03 0{}:00:00,2022-01-03 04:00:00,VGH22.csv,838,VGH22.csv\n"
    put(tmp_path / "data" / "EuroStoxx" / "AIAgent_EuroStoxx.csv", HEADER + "\n" + "".join(row.format(v, k) for k, v in enumerate([0, -2, -2, 3])))
    put(tmp_path / "data" / "Gold" / "AIAgent_Gold.csv", HEADER + "\n" + "".join(row.format(v, k) for k, v in enumerate([5, 4])))
    folders.write_signals(spark, str(tmp_path / "data"), str(tmp_path / "signals"))
    got = files.read_signals(spark, str(tmp_path / "signals"))
    assert {(r.filename, r.timestamp.hour, r.inventory, r.signal) for r in got.collect()} == {("AIAgent_EuroStoxx.csv", 1, -2, -2.0), ("AIAgent_EuroStoxx.csv", 3, 3, 5.0), ("AIAgent_Gold.csv", 1, 4, -1.0)}
    assert got.first().date.isoformat() == "2022-01-03" and got.first().day == 44564
    put(tmp_path / "plain" / "AIAgent_Gold.csv", HEADER + ",signal\n" + row.format(5, 1).strip() + ",2.0\n")
    assert [(r.filename, r.signal) for r in files.read_signals(spark, str(tmp_path / "plain")).collect()] == [("AIAgent_Gold.csv", 2.0)]


def minute_rows(days, n=40):
    t = datetime(2024, 1, 1, 9)
    for d in range(days):
        for i in range(n if d % 4 != 2 else n // 2):
            x = 100 + round(8 * math.sin(d * 7 + i / 3)) / 2
            yield t + timedelta(days=d, minutes=i), x, x + (i * d) % 4 / 2, x - (i + d) % 3 / 2, x + 0.5 * ((i * i + d) % 3 - 1), 10.0 + (i * 7 + d) % 11


def test_from_signals_to_placements(spark, tmp_path):
    for market, name in (("EuroStoxx", "VGH22.csv"), ("Nasdaq", "NQH22.csv")):
        put(tmp_path / "data" / market / name, "time,open,high,low,close,volume\n" + "".join(",".join(map(str, r)) + "\n" for r in minute_rows(12)))
    ask = "1,1,1,1.0,1,2024-01-09,2024-01-{:02d} 09:20:30,2024-01-09 09:20:00,x,1,{},{}\n"
    put(tmp_path / "signals" / "AIAgent_A.csv", HEADER + ",signal\n" + "".join(ask.format(d, c, s) for d in (1, 9, 12) for c, s in (("VGH22.csv", 1.0), ("NQH22.csv", -2.0), ("XXH22.csv", 1.0))))
    p = training.Params(tau=2, sizes=(2, 2, 2))
    folders.write_placements(spark, str(tmp_path / "signals"), str(tmp_path / "data"), str(tmp_path / "out"), p)
    got = {(r.main_contract_clean, r.timestamp.day): r for r in spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "out")).collect()}
    assert len(got) == 9 and got["XXH22.csv", 12].status == "no_prior_bar" and got["VGH22.csv", 1].status == "no_bars" and got["NQH22.csv", 12].status == "ok"
    for (name, day), r in got.items():
        if r.status == "ok":  # prices move in the contract's own ticks
            close = next(x[4] for x in minute_rows(12) if x[0] == datetime(2024, 1, day, 9, 20))
            assert r.opti_price == pytest.approx(close - r.level * 0.5 if name == "VGH22.csv" else close + r.level * 0.25)


def test_a_signal_microseconds_after_a_bar_is_priced_by_it(spark, tmp_path):
    put(tmp_path / "data" / "EuroStoxx" / "VGH22.csv", "time,open,high,low,close,volume\n" + "".join(",".join(map(str, r)) + "\n" for r in minute_rows(12)))
    asked = [("AIAgent_A.csv", datetime(2024, 1, 12, 9, minute, 0, us), "VGH22.csv", 1.0) for minute in range(10, 20) for us in (0, 1, 425, 999)]
    signals = spark.createDataFrame(asked, "filename string, timestamp timestamp_ntz, main_contract_clean string, signal double")
    files.write_by(signals, str(tmp_path / "signals"), "filename", "csv", ["timestamp"])
    folders.write_placements(spark, str(tmp_path / "signals"), str(tmp_path / "data"), str(tmp_path / "out"), training.Params(tau=2, sizes=(2, 2, 2)))
    got = files.read_named(spark, str(tmp_path / "out"), "timestamp timestamp_ntz, level int, opti_price double, status string", ["timestamp"]).collect()
    assert sorted(r.timestamp for r in got) == [t for _, t, _, _ in asked] and {r.status for r in got} == {"ok"}
    closes = [(r[0], r[4]) for r in minute_rows(12)]
    for r in got:
        close = next(c for t, c in reversed(closes) if t < r.timestamp)
        assert r.opti_price == pytest.approx(close - r.level * 0.5)


def test_latest_override_counts_once(spark):
    df = spark.createDataFrame([("ES",), ("CL",)], "symbol string")
    own = spark.createDataFrame([("es", 0.5, 1), ("ES", 0.75, 2), ("ES", 0.1, 0)], "symbol string, tick_size double, registered_at int")
    assert {r.symbol: r.tick_size for r in I.with_tick_size(df, "symbol", own).collect()} == {"ES": 0.75, "CL": 0.01}
    assert I.with_tick_size(df, "symbol", own.drop("registered_at")).count() == 2


def test_shared_cutoffs_equal_training_alone(spark):
    """Also where a bar stands at midnight: there its day of one row is dropped or, with a threshold below one row, kept."""
    rows = [("A", *r) for r in minute_rows(14)] + [("B", datetime(2024, 1, d), 1.0, 2.0, 0.5, 1.5, 1.0) for d in range(1, 12)]
    rows += [("A", datetime(2024, 1, 8), 100.0, 101.0, 99.0, 100.0, 5.0)]
    bars = spark.createDataFrame(rows, "contract string, time timestamp_ntz, open double, high double, low double, close double, volume double")
    asked = spark.createDataFrame([(c, datetime(2024, 1, d)) for c in "AB" for d in (2, 5, 8, 9, 14)], "contract string, cutoff timestamp_ntz")
    p = training.Params(tau=2, sizes=(2, 2, 1))
    keys = ["contract", "cutoff"]
    plans = {(r.contract, r.cutoff.day): r.shared for r in backtest.cutoff_plans(bars, asked, 0.9).collect()}
    assert not plans["B", 9] and plans["A", 8] and plans["A", 9]
    for q in (p, training.Params(tau=1, sizes=(2, 2, 1))):
        columns = [*keys, "time", "bar_seq", "r", "v_ewma", "sigma_ewma", "delta_x_ewma"]
        one = backtest.cutoff_features(bars, asked, q).select(columns).collect()
        two = training.featured(training.ranged(backtest.training_sets(bars, asked), keys, q), keys, q).select(columns).collect()
        by = lambda found: {tuple(r)[:5]: pytest.approx(tuple(r)[5:]) for r in found}
        assert len(one) == len(two) and {tuple(r)[:5]: tuple(r)[5:] for r in one} == by(two)
