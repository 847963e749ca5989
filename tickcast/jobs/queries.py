"""The registered queries: operators over whole tables, on bars, signals and names derived from them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickcast.functions import instruments as I  # noqa: E741
from tickcast.jobs import backtest, folders, training
from tickcast.operators import bars as B
from tickcast.operators import model as M
from tickcast.operators import scan, signals, states
from tickcast.sources import files, store, tables
from tickcast.sources.shared import shared_dir, written
from tickcast.streaming import score as stream

KEYS = ["contract"]
#: The SQL rounds features to nine digits before binning, so that the last bits of two engines can't flip a state.
P = training.Params(digits=9)
RAW = training.Params(method="raw", digits=9)
SPARSE = training.Params(tick=0.1, digits=9)
#: Cutoff of the queries that train as of a date.
CUTOFF = "2024-01-12 00:00:00"


def r6(df: DataFrame) -> DataFrame:
    """Doubles to six digits, as the SQL gives them."""
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


def bars_of(spark, sf_dir):
    return tables.event_bars(spark, sf_dir)


def ranged_of(spark, sf_dir):
    return written(training.ranged(bars_of(spark, sf_dir), KEYS, P), "ranged")


def load_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(files.checked_bars(bars_of(spark, sf_dir), KEYS))


def discover_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract files are written from the event bars and found again."""
    root = f"{shared_dir(spark)}/contract-files-{uuid.uuid4().hex}"
    files.write_by(bars_of(spark, sf_dir).select("contract", "time", *files.OHLCV).withColumn("market", F.col("contract")).drop("contract"), root, "market", "csv")
    found = files.discover_files(spark, root)
    return found.groupBy("market").agg(F.count("*").alias("n_files"))


def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that is saved and loaded answers as before."""
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    model = training.fit(bars_of(spark, sf_dir), KEYS, P)
    store.save_model(model, path, KEYS)
    back = store.load_model(spark, path)
    by = [*KEYS, "m", "n", "k", "direction", "ell"]
    return r6(back["cdf"].select(*by, "cum_prob"))


def model_of_one_symbol(spark, sf_dir):
    """Of a stored model of all contracts the one that comes first by name is loaded: its folders alone are read."""
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    store.save_model(training.fit(bars_of(spark, sf_dir), KEYS, P), path, KEYS)
    first = tables.table(spark, sf_dir, "events").agg(F.min("event_type").alias("symbol")).filter("symbol is not null")
    m = store.load_model(spark, path, first)
    return r6(m["cdf"].filter("ell <= 9").join(m["models"].select(*KEYS, "n_bars", "j_s"), KEYS))


def tick_size_lookup(spark, sf_dir):
    return I.with_tick_size(tables.contract_names(spark, sf_dir), "name").select("o_orderkey", "name", "tick_size")


def parse_symbol(spark, sf_dir):
    return I.parse_symbol(tables.contract_names(spark, sf_dir), "path").select("o_orderkey", "path", "symbol", "tick_size", "parse_status")


def contract_details(spark, sf_dir):
    return I.contract_details(tables.contract_names(spark, sf_dir), "path").select("o_orderkey", "symbol", "month_code", "month", "year", "contract_code", "tick_size")


def tick_override(spark, sf_dir):
    own = spark.createDataFrame([("es", 0.5), ("XX", 2.0)], "symbol string, tick_size double")
    return I.with_tick_size(tables.contract_names(spark, sf_dir), "name", own).select("o_orderkey", "name", "tick_size")


def signal_route(spark, sf_dir):
    named = tables.contract_names(spark, sf_dir).withColumn("main_contract_clean", I.base_name(F.col("path")))
    return I.route_signal(named, "main_contract_clean").select("o_orderkey", "main_contract_clean", "route_symbol", "market")


def train_cutoff(spark, sf_dir):
    b = bars_of(spark, sf_dir)
    kept = B.until_cutoff(b, CUTOFF).groupBy(*KEYS).agg(F.count("*").alias("n_kept"), F.max("time").alias("last_time"))
    return b.groupBy(*KEYS).agg(F.count("*").alias("n_all")).join(kept, KEYS, "left").select("contract", "n_all", "n_kept", "last_time")


def daily_completeness(spark, sf_dir):
    return r6(B.daily_counts(bars_of(spark, sf_dir), KEYS))


def sparse_days(spark, sf_dir):
    return r6(B.drop_sparse_days(bars_of(spark, sf_dir), KEYS))


def user_bars(spark, sf_dir):
    """Raw events of each user as bars: many series with long gaps."""
    e = tables.table(spark, sf_dir, "events")
    first = e.groupBy(F.col("user_id").alias("contract"), F.col("ts").alias("time")).agg(F.min("value").alias("value"))
    return first.select("contract", "time", *(F.col("value").alias(c) for c in ("open", "high", "low", "close")), F.lit(1.0).alias("volume"))


def gap_sessions(spark, sf_dir):
    return B.with_sessions(user_bars(spark, sf_dir), KEYS).groupBy("contract", "session_id").agg(F.count("*").alias("n_rows"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


def tau_bars(spark, sf_dir):
    return r6(B.tau_bars(bars_of(spark, sf_dir), KEYS, P.tau, P.min_completeness).drop("bar_seq"))


def tick_ranges(spark, sf_dir):
    return training.ranged(bars_of(spark, sf_dir), KEYS, P).select("contract", "time", "bar_seq", "r", "r_up", "r_dn")


def range_quality(spark, sf_dir):
    return B.quality_report(bars_of(spark, sf_dir), KEYS, P.tau, P.tick)


def burn_in(spark, sf_dir):
    return states.burn_in(ranged_of(spark, sf_dir), KEYS, P.halflife, P.sizes)


def ewma_shifted(spark, sf_dir):
    return r6(scan.shifted_means(ranged_of(spark, sf_dir), KEYS, P.halflife, {"volume": "v_ewma"}).select("contract", "bar_seq", "v_ewma"))


def ewm_std(spark, sf_dir):
    df = scan.shifted_means(ranged_of(spark, sf_dir), KEYS, P.halflife, {"volume": "v_ewma"})
    return r6(scan.shifted_std(df, KEYS, P.halflife, "volume", "v_ewma", "v_std").select("contract", "bar_seq", "v_std"))


def ewma_features(spark, sf_dir):
    df = scan.features(ranged_of(spark, sf_dir), KEYS, P.halflife)
    return r6(df.select("contract", "bar_seq", "v_ewma", "sigma_ewma", "delta_x", "delta_x_ewma"))


def live(column):
    def query(spark, sf_dir):
        return r6(scan.live_features(bars_of(spark, sf_dir), KEYS).select("contract", "time", column))

    return query


def state_boundaries(spark, sf_dir):
    _, b = training.classified(bars_of(spark, sf_dir), KEYS, P)
    at = lambda c, i: F.element_at(c, i)
    return r6(b.select("contract", "n_bars", "j_s", at("volume_bounds", 1).alias("v1"), at("volume_bounds", 2).alias("v2"), at("volatility_bounds", 1).alias("s1"), at("volatility_bounds", 2).alias("s2"), at("price_change_bounds", 1).alias("d1"), "status"))


def assign_states(spark, sf_dir):
    rows, _ = training.classified(bars_of(spark, sf_dir), KEYS, P)
    return rows.select("contract", "bar_seq", "m", "n", "k")


def state_histogram(spark, sf_dir):
    rows, _ = training.classified(bars_of(spark, sf_dir), KEYS, P)
    return states.histogram(rows, KEYS, P.sizes)


def range_frequency(spark, sf_dir):
    rows, _ = training.classified(bars_of(spark, sf_dir), KEYS, P)
    return M.frequencies(rows, KEYS)


def pmf_of(p):
    def query(spark, sf_dir):
        out = training.fit(bars_of(spark, sf_dir), KEYS, p)["pmf"]
        return r6(out.select("contract", "m", "n", "k", "direction", "ell", "prob", "base_prob", "num_bins"))

    return query


def reverse_cdf(spark, sf_dir):
    return r6(training.fit(bars_of(spark, sf_dir), KEYS, P)["cdf"])


def reverse_cdf_sparse(spark, sf_dir):
    """To nine digits: sums that end on half a digit in the sixth would round apart in two engines."""
    c = training.fit(bars_of(spark, sf_dir), KEYS, SPARSE)["cdf"]
    return c.withColumn("cum_prob", F.round("cum_prob", 9))


def state_statistics(spark, sf_dir):
    return M.statistics(training.fit(bars_of(spark, sf_dir), KEYS, P)["pmf"], KEYS)


def validate_model(spark, sf_dir):
    m = training.fit(bars_of(spark, sf_dir), KEYS, P)
    return M.validate(m["pmf"], m["cdf"], KEYS)


def model_report(spark, sf_dir):
    return training.report(bars_of(spark, sf_dir), KEYS, P)


def market_report(spark, sf_dir):
    """Bars of four rows, as the multi-market report with its own parameters."""
    return training.report(bars_of(spark, sf_dir), KEYS, training.Params(tau=4, digits=9))


def fit_models(spark, sf_dir):
    m = training.fit(bars_of(spark, sf_dir), KEYS, P)
    first = m["cdf"].filter("ell = 1").groupBy(*KEYS).agg(F.sum("cum_prob").alias("fill_at_1"))
    return r6(m["models"].join(first, KEYS, "left").select("contract", "n_bars", "j_s", "status", "states_observed", "least_samples", "most_samples", "fill_at_1"))


def fit_with_cutoff(spark, sf_dir):
    m = training.fit(B.until_cutoff(bars_of(spark, sf_dir), CUTOFF), KEYS, P)
    return r6(m["cdf"])


def answer_at_cutoff(spark, sf_dir):
    """A model of the bars up to the cutoff answers for the market at that time: its state and fill probabilities at levels 0 to 9 both ways."""
    got = training.answer_as_of(bars_of(spark, sf_dir), KEYS, CUTOFF, P)
    return r6(got)


def readings(spark, sf_dir):
    """Live values of every bar as readings."""
    return scan.live_features(bars_of(spark, sf_dir), KEYS).select("contract", "time", *(F.round(c, 9).alias(c) for c in backtest.LIVE))


def live_states(spark, sf_dir):
    _, b = training.classified(bars_of(spark, sf_dir), KEYS, P)
    return states.live_states(readings(spark, sf_dir), b, KEYS, backtest.LIVE).select("contract", "time", "m", "n", "k")


def asked_levels(spark, sf_dir):
    """Every bar's range asked in its own state and in states next to it, some unknown."""
    rows, _ = training.classified(bars_of(spark, sf_dir), KEYS, P)
    one = rows.select("contract", "m", "n", (F.col("bar_seq") % 3 + 1).cast("int").alias("k"), F.lit("range_dn").alias("direction"), (F.col("r") % 400 + F.col("bar_seq") % 20 - 5).alias("ell"))
    return one.distinct()


def query_pdf(spark, sf_dir):
    return r6(M.query_pdf(asked_levels(spark, sf_dir), training.fit(bars_of(spark, sf_dir), KEYS, P)["pmf"], KEYS, True))


def query_cdf(spark, sf_dir):
    return r6(M.query_cdf(asked_levels(spark, sf_dir), training.fit(bars_of(spark, sf_dir), KEYS, P)["steps"], KEYS))


def query_cdf_sparse(spark, sf_dir):
    """Ticks ten thousand times too small: the largest level is in the millions, and no level is made that does not occur. To five digits."""
    p = training.Params(tick=0.0001, digits=9)
    rows, _ = training.classified(bars_of(spark, sf_dir), KEYS, p)
    steps = M.steps(M.pmf(M.frequencies(rows, KEYS), KEYS, p.method, p.alpha, dense_bins=0), KEYS)
    asked = rows.select("contract", "m", "n", (F.col("bar_seq") % 3 + 1).cast("int").alias("k"), F.lit("range_dn").alias("direction"), (F.col("r_dn") + (F.col("bar_seq") % 5 - 2) * 5000).alias("ell")).distinct()
    return M.query_cdf(asked, steps, KEYS).withColumn("cum_prob", F.round("cum_prob", 5))


def bad_directions(spark, sf_dir):
    """Every state of the table asked for directions that exist for it and some that don't."""
    m = training.fit(bars_of(spark, sf_dir), KEYS, P)
    names = F.array(*map(F.lit, ("range", "range_up", "range_dn", "sideways")))
    asked = m["pmf"].select(*KEYS, "m", "n", "k").distinct().withColumn("direction", F.explode(names)).withColumn("ell", F.lit(2).cast("long"))
    pdf = M.query_pdf(asked, m["pmf"], KEYS, True).withColumnRenamed("query_status", "pdf_status")
    return r6(M.query_cdf(pdf, m["steps"], KEYS).withColumnRenamed("query_status", "cdf_status"))


def model_issues(spark, sf_dir):
    """A model spoilt in every third distribution: its sums and steps are listed one by one."""
    m = training.fit(bars_of(spark, sf_dir), KEYS, P)
    bad = (F.col("m") + F.col("n") + F.col("k")) % 3 == 0
    pmf = m["pmf"].withColumn("prob", F.when(bad & (F.col("ell") == 1), F.col("prob") + 0.25).otherwise(F.col("prob")))
    cdf = m["cdf"].withColumn("cum_prob", F.when(bad & (F.col("ell") == 2), F.col("cum_prob") + 0.5).otherwise(F.col("cum_prob")))
    return r6(M.issues(pmf, cdf, KEYS))


def full_distribution(spark, sf_dir):
    """The distributions of each contract's state at its last bar."""
    m = training.fit(bars_of(spark, sf_dir), KEYS, P)
    now = readings(spark, sf_dir).groupBy("contract").agg(F.max_by(F.struct(*backtest.LIVE), "time").alias("x")).select("contract", "x.*")
    now = states.live_states(now, m["bounds"], KEYS, backtest.LIVE).select("contract", "m", "n", "k")
    return r6(m["pmf"].join(now, ["contract", "m", "n", "k"], "left_semi").select("contract", "m", "n", "k", "direction", "ell", "prob"))


def compare_methods(spark, sf_dir):
    rows, _ = training.classified(bars_of(spark, sf_dir), KEYS, P)
    freq = M.frequencies(rows, KEYS)
    raw, smooth = M.pmf(freq, KEYS, "raw"), M.pmf(freq, KEYS, "smoothed", 1.0)
    asked = freq.select("contract", "m", "n", "k", "direction").distinct().withColumn("ell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    by = ["contract", "m", "n", "k", "direction", "ell"]
    a = M.query_pdf(asked, raw, KEYS, False).withColumnRenamed("prob", "raw_prob").drop("query_status")
    return r6(a.join(M.query_pdf(asked, smooth, KEYS, True).withColumnRenamed("prob", "smoothed_prob").drop("query_status"), by))


def top_levels(spark, sf_dir):
    m = training.fit(bars_of(spark, sf_dir), KEYS, P)
    return r6(M.top_levels(m["pmf"], m["cdf"], KEYS))


def inventory_signals(spark, sf_dir):
    return signals.inventory_signals(tables.event_inventory(spark, sf_dir), ["market"], ["timestamp", "event_id"]).select("market", "event_id", "inventory", "signal")


def infer_tick(spark, sf_dir):
    return r6(signals.inferred_ticks(bars_of(spark, sf_dir), KEYS, KEYS))


def all_signals(spark, sf_dir):
    return signals.inventory_signals(tables.event_inventory(spark, sf_dir), ["market"], ["timestamp", "event_id"])


def asof_prior_bar(spark, sf_dir):
    got = signals.as_of_prior(all_signals(spark, sf_dir), bars_of(spark, sf_dir), KEYS, "timestamp", "time", ["time", "close"])
    return r6(got.select("contract", "event_id", F.col("time").alias("bar_time"), "close"))


def cutoff_training_sets(spark, sf_dir):
    asked = all_signals(spark, sf_dir).withColumn("cutoff", F.date_trunc("DAY", "timestamp").cast("timestamp_ntz"))
    return backtest.training_sets(bars_of(spark, sf_dir), asked).groupBy("contract", "cutoff").agg(F.count("*").alias("n_rows"), F.max("time").alias("last_time"))


def level_case(spark, sf_dir):
    m = training.fit(bars_of(spark, sf_dir), KEYS, P)
    asked = readings(spark, sf_dir)
    asked = states.live_states(asked, m["bounds"], KEYS, backtest.LIVE).select("contract", "time", "m", "n", "k").withColumn("direction", F.explode(F.array(F.lit("range_up"), F.lit("range_dn"))))
    return signals.placement_levels(asked, m["steps"], KEYS, 0.97)


def placement_level(spark, sf_dir):
    return r6(level_case(spark, sf_dir).select("contract", "time", "direction", "level", "accepted_level", "accepted_prob"))


def placement_price(spark, sf_dir):
    b = bars_of(spark, sf_dir).select("contract", "time", "close")
    got = level_case(spark, sf_dir).join(b, ["contract", "time"])
    return r6(got.select("contract", "time", "direction", signals.limit_price(F.col("close"), F.col("level"), F.lit(0.25), F.col("direction")).alias("opti_price")))


def placement_backtest(spark, sf_dir):
    got = backtest.place(bars_of(spark, sf_dir), all_signals(spark, sf_dir), P)
    return r6(got.select("contract", "event_id", "signal", "direction", "m", "n", "k", "level", "accepted_level", "accepted_prob", "opti_price", "status"))


def symbol_ticks(spark, sf_dir):
    """contract, tick_size: each event type trades as a symbol; ticks come from the table of symbols and an override."""
    named = tables.table(spark, sf_dir, "events").select(F.col("event_type").alias("contract")).distinct().withColumn("symbol", tables.event_symbol(F.col("contract")))
    own = spark.createDataFrame([("XX", 1.0)], "symbol string, tick_size double")
    return I.with_tick_size(named, "symbol", own).select("contract", "tick_size")


def fit_by_symbol(spark, sf_dir):
    """Models of contracts with tick sizes of their own."""
    p = P.with_ticks(symbol_ticks(spark, sf_dir))
    m = training.fit(bars_of(spark, sf_dir), KEYS, p)
    top = m["pmf"].groupBy(*KEYS).agg(F.max("ell").alias("max_ell"), F.sum("prob").alias("total"))
    return r6(m["models"].join(top, KEYS, "left").select("contract", "n_bars", "j_s", "status", "states_observed", "max_ell", "total"))


def report_by_symbol(spark, sf_dir):
    return training.report(bars_of(spark, sf_dir), KEYS, P.with_ticks(symbol_ticks(spark, sf_dir)))


def placement_by_symbol(spark, sf_dir):
    """The backtest with ranges and prices in each contract's own ticks."""
    got = backtest.place(bars_of(spark, sf_dir), all_signals(spark, sf_dir), P.with_ticks(symbol_ticks(spark, sf_dir)))
    return r6(got.select("contract", "event_id", "direction", "m", "n", "k", "level", "accepted_prob", "opti_price", "status"))


def market_files(spark, sf_dir) -> str:
    """Folders of contract and inventory files of the events, columns in an order of their own; their root."""
    root = f"{shared_dir(spark)}/market-files-{uuid.uuid4().hex}"
    b = bars_of(spark, sf_dir).select("volume", "close", "contract", "low", "high", "open", "time")
    files.write_by(b.withColumns({"market": F.col("contract"), "filename": F.concat("contract", F.lit(".csv"))}).drop("contract"), f"{root}/data", ["market", "filename"], "csv")
    inv = tables.event_inventory(spark, sf_dir).select(F.col("event_id").cast("int").alias("main_volume"), "inventory", "timestamp", F.concat("market", F.lit(".csv")).alias("main_contract_clean"), "market", F.concat(F.lit("AIAgent_"), "market", F.lit(".csv")).alias("filename"))
    files.write_by(inv, f"{root}/inventories", ["market", "filename"], "csv")
    return root


def read_bar_files(spark, sf_dir):
    return r6(files.read_bars(spark, f"{market_files(spark, sf_dir)}/data"))


def folder_ticks(spark, sf_dir):
    return r6(folders.tick_sizes(spark, f"{market_files(spark, sf_dir)}/data"))


INVENTORY = "timestamp timestamp_ntz, inventory int, main_volume int, main_contract_clean string"


def folder_signals(spark, sf_dir):
    """Signals of all inventory files, written as signal files by the job and read again."""
    root = market_files(spark, sf_dir)
    folders.write_signals(spark, f"{root}/inventories", f"{root}/signals", ("timestamp", "main_volume"), INVENTORY)
    got = files.read_signals(spark, f"{root}/signals")
    return got.select("filename", F.col("main_volume").cast("long").alias("event_id"), "main_contract_clean", "inventory", "signal")


PLACED = "main_volume long, main_contract_clean string, signal double, direction string, level int, opti_price double, status string"


def folder_placements(spark, sf_dir):
    """From files to files: contract files and signal files in, placement files out, read again. Contracts trade as symbols with tick sizes of their own."""
    root = f"{shared_dir(spark)}/placements-{uuid.uuid4().hex}"
    name = tables.event_contract(F.col("contract"))
    routed = I.route_signal(bars_of(spark, sf_dir).withColumn("filename", name), "filename")
    files.write_by(routed.select("market", "filename", "time", *files.OHLCV), f"{root}/data", ["market", "filename"], "csv", ["time"])
    asked = all_signals(spark, sf_dir).withColumns({"main_contract_clean": name, "main_volume": F.col("event_id").cast("int"), "filename": F.concat(F.lit("AIAgent_"), name)})
    files.write_by(asked.select("timestamp", "inventory", "main_volume", "main_contract_clean", "signal", "filename"), f"{root}/signals", "filename", "csv", ["timestamp"])
    folders.write_placements(spark, f"{root}/signals", f"{root}/data", f"{root}/out", P)
    got = files.read_named(spark, f"{root}/out", PLACED, [c.split()[0] for c in PLACED.split(", ")])
    return r6(got.select(F.col("main_volume").alias("event_id"), "main_contract_clean", "signal", "direction", "level", "opti_price", "status"))


def spoilt_files(spark, sf_dir) -> str:
    """Contract files of which some rows are unreadable, empty in a column, or repeated, and one file lacks a column; their root."""
    root = f"{shared_dir(spark)}/spoilt-{uuid.uuid4().hex}"
    b = bars_of(spark, sf_dir).withColumn("_m", F.minute("time") + F.hour("time"))
    text = b.select("contract", "_m", *(F.col(c).cast("string").alias(c) for c in ("time", *files.OHLCV)))
    text = text.withColumns({"close": F.when(F.col("_m") % 7 == 1, "abc").otherwise(F.col("close")), "low": F.when(F.col("_m") % 7 == 2, None).otherwise(F.col("low"))})
    text = text.unionByName(text.filter("_m % 7 = 3").withColumn("volume", F.lit("0.0")))
    named = text.withColumns({"market": F.lit("m"), "filename": F.concat("contract", F.lit(".csv"))}).drop("contract", "_m")
    files.write_by(named, f"{root}/data", ["market", "filename"], "csv", ["time"])
    files.write_by(named.drop("volume").withColumn("market", F.lit("short")), f"{root}/data", ["market", "filename"], "csv", ["time"])
    return f"{root}/data"


def rejected_rows(spark, sf_dir):
    """Why rows of the files are not taken, and how many are."""
    good, bad = files.sorted_bars(spark, spoilt_files(spark, sf_dir))
    every = good.select("market", "contract", F.lit("taken").alias("reason"), "volume").unionByName(bad.select("market", "contract", "reason", "volume"))
    return r6(every.groupBy("market", "contract", "reason").agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume")))


def file_status(spark, sf_dir):
    root = spoilt_files(spark, sf_dir)
    return files.file_status(spark, root, *files.sorted_bars(spark, root))


def two_runs(spark, sf_dir):
    """Markets written one after the other, the first again at the end: all are there, each once, in the order of their files."""
    root = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    b = bars_of(spark, sf_dir).withColumns({"market": F.col("contract"), "filename": F.concat("contract", F.lit(".csv"))}).drop("contract")
    early = F.crc32("market") % 2 == 0
    for part in (early, ~early, early):
        files.write_by(b.filter(part), root, ["market", "filename"], "csv", ["time"], rows=100)
    back = files.read_bars(spark, root)
    return r6(back.groupBy("market", "contract").agg(F.count("*").alias("n_rows"), F.sum("volume").alias("volume"), F.min("time").alias("first_time"), F.max("time").alias("last_time")))


def stream_score(spark, sf_dir):
    """Readings of all bars, written as files and scored as a stream with the stored model; the rows of the finished stream."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    asked = readings(spark, sf_dir).select("contract", "time", F.col("volume_ewma").alias("volume"), F.col("volatility_ewma").alias("volatility"), F.col("ewma_delta_x").alias("price_change"), F.lit("range_up").alias("direction"), F.lit(1).cast("long").alias("ell"))
    asked.write.mode("overwrite").parquet(f"{root}/readings")
    store.save_model(training.fit(bars_of(spark, sf_dir), KEYS, P), f"{root}/model", KEYS)
    arriving = spark.readStream.schema(asked.schema).parquet(f"{root}/readings")
    stream.start_scoring(arriving, f"{root}/model", f"{root}/out", f"{root}/progress", KEYS, availableNow=True).awaitTermination()
    return r6(spark.read.parquet(f"{root}/out").select("contract", "time", "m", "n", "k", "state_exists", "sample_count", "max_range", "max_range_up", "max_range_dn", "cum_prob", "model_version"))


def queries() -> dict:
    named = [
        load_bars, discover_files, model_roundtrip, tick_size_lookup, parse_symbol, contract_details, tick_override, signal_route, train_cutoff, daily_completeness,
        sparse_days, gap_sessions, tau_bars, tick_ranges, range_quality, burn_in, ewma_shifted, ewm_std, ewma_features, state_boundaries, assign_states, state_histogram,
        range_frequency, reverse_cdf, reverse_cdf_sparse, state_statistics, validate_model, model_report, market_report, fit_models, fit_with_cutoff, live_states, query_pdf,
        query_cdf, query_cdf_sparse, bad_directions, model_issues, answer_at_cutoff, full_distribution, compare_methods, top_levels, inventory_signals, infer_tick, asof_prior_bar, cutoff_training_sets, placement_level, placement_price,
        placement_backtest, stream_score, fit_by_symbol, report_by_symbol, placement_by_symbol, read_bar_files, folder_ticks, folder_signals, folder_placements, rejected_rows, file_status, two_runs, model_of_one_symbol,
    ]
    out = {f.__name__: f for f in named}
    out |= {"live_volume": live("volume_ewma"), "live_volatility": live("volatility_ewma"), "live_delta": live("ewma_delta_x")}
    return out | {"pmf_raw": pmf_of(RAW), "pmf_smoothed": pmf_of(P), "pmf_smoothed_sparse": pmf_of(SPARSE)}
