"""Limit-price placement for all signals of all series, each priced by a model that knew only the past."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickcast.jobs import training
from tickcast.operators import bars as B
from tickcast.operators import days as days_
from tickcast.operators import model as M
from tickcast.operators import moves, scan, selection, signals, states
from tickcast.sources.shared import scratch, written

LIVE = ("volume_ewma", "volatility_ewma", "ewma_delta_x")


def training_sets(bars: DataFrame, asked: DataFrame) -> DataFrame:
    """contract, cutoff and bars with time <= cutoff, once for each distinct (contract, cutoff) of ``asked``.

    Cutoffs are days, so they are few beside bars; the equi-join on the contract carries the time as a condition.
    """
    cutoffs = asked.select("contract", "cutoff").distinct()
    return bars.join(cutoffs, "contract").filter(F.col("time") <= F.col("cutoff"))


def days_before(days: DataFrame, cutoffs: DataFrame, count: Column, name: str) -> DataFrame:
    """``cutoffs`` (keys, cutoff, ...) with ``name``: the last ``count`` of ``days`` (keys, date, ...) on a day before the cutoff's; one pass over both in order."""
    keys = [c for c in days.columns if c in cutoffs.columns and c != "date"]
    one = days.select(*keys, "date", F.lit(1).alias("_kind"), count.alias("_count"))
    two = cutoffs.withColumns({"date": F.to_date("cutoff"), "_kind": F.lit(0)})
    order = Window.partitionBy(*keys).orderBy("date", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = two.unionByName(one, allowMissingColumns=True).withColumn(name, F.last("_count", ignorenulls=True).over(order))
    return both.filter("_kind = 0").select(*cutoffs.columns, name)


def cutoff_plans(bars: DataFrame, asked: DataFrame, min_completeness: float) -> DataFrame:
    """contract, cutoff, threshold, drop_rank, shared for each distinct (contract, cutoff): which days a training up to the cutoff drops.

    A day goes if its count is below ``threshold``. ``drop_rank`` counts such days among all days of the contract, so cutoffs of one
    rank drop the same days and can share all work that looks only back. A bar at the cutoff's midnight is a day of one row; where
    that day would stay, ``shared`` is false. Medians are order statistics of prefixes of the days, ranks come from a contract's histogram of
    counts, so no cutoff meets the days one by one.
    """
    midnight = F.col("time") == F.date_trunc("DAY", "time").cast("timestamp_ntz")
    days = written(bars.groupBy("contract", F.to_date("time").alias("date")).agg(F.count("*").alias("n"), F.max(midnight).alias("midnight")), "days")
    placed = days.withColumn("pos", F.row_number().over(Window.partitionBy("contract").orderBy("date")) - 1)
    cutoffs = days_before(placed, asked.select("contract", "cutoff").distinct(), F.col("pos") + 1, "earlier")
    own = days.filter("midnight").select("contract", F.col("date").alias("_last"), F.lit(1).alias("_one"))
    cutoffs = cutoffs.withColumn("_last", F.to_date("cutoff")).join(own, ["contract", "_last"], "left")
    cutoffs = cutoffs.select("contract", "cutoff", F.coalesce("earlier", F.lit(0)).alias("earlier"), F.coalesce("_one", F.lit(0)).alias("_one"))
    cutoffs = written(cutoffs.withColumn("_at", (F.col("earlier") + F.col("_one") - 1) / 2).filter("_at >= 0"), "cutoffs")
    # a day of one row at midnight comes first among the counts
    ranks = cutoffs.select("contract", "cutoff", F.lit(0).alias("lo"), F.col("earlier").alias("hi"), F.posexplode(F.array(F.floor("_at") - F.col("_one"), F.ceil("_at") - F.col("_one"))).alias("_side", "k"))
    got = selection.order_statistics(placed.select("contract", "pos", F.col("n").alias("x")), ["contract"], ranks, ["cutoff", "_side"])
    side = lambda k: F.coalesce(F.max(F.when(F.col("_side") == k, F.col("x"))), F.lit(1)).cast("double")
    found = cutoffs.join(got, ["contract", "cutoff"], "left").groupBy("contract", "cutoff", "_at", "_one").agg(side(0).alias("_low"), side(1).alias("_high"))
    found = found.withColumn("threshold", selection.interpolated(F.col("_low"), F.col("_high"), F.col("_at")) * min_completeness)
    counts = days.groupBy("contract", "n").agg(F.count("*").alias("c")).groupBy("contract").agg(F.collect_list(F.struct("n", "c")).alias("_counts"))
    rank = F.aggregate(F.filter("_counts", lambda d: d["n"] < F.col("threshold")), F.lit(0).cast("long"), lambda s, d: s + d["c"])
    return found.join(counts, "contract").select("contract", "cutoff", "threshold", rank.alias("drop_rank"), ((F.col("_one") == 0) | (F.col("threshold") > 1)).alias("shared"))


def lane_bars(bars: DataFrame, kept: DataFrame, tau: int) -> DataFrame:
    """Tau bars of every lane of ``kept`` (contract, lane, _day: the days that a lane keeps), with bar_seq in the lane and ``_end``.

    A session never bridges a dropped day, so a bar is told by its session's first row and its place in it, whatever the lane. Rows are
    rolled up once for each such session (where lanes begin one at different rows, once for each beginning); a lane then takes bars by the
    days they end on. So rows of bars are read anew only in sessions that a dropped day touches.
    """
    key, lane = ["contract"], ["contract", "lane"]
    inside = days_.inside_days(bars.select("contract", "time", *B.OHLCV), key, B.GAP, tau)
    table = days_.carried(days_.day_summaries(inside, key).join(kept, ["contract", days_.DAY]), lane, B.GAP, tau)
    table = written(table.withColumn("_before", F.col("_base") - F.col("_from.row") + 1), "lane-days")
    if tau == 1:
        out = inside.join(table.select(*lane, days_.DAY, "_base"), ["contract", days_.DAY])
        return out.select(*lane, "time", *B.OHLCV, (F.col("_base") + F.col("_p") - 1).cast("long").alias("bar_seq"), F.col("time").alias("_end"))
    heads = table.select("contract", days_.DAY, F.col("_from.day").alias("_day0"), F.col("_from.at").alias("_at0"), "_before").distinct()
    heads = heads.withColumn("_one", F.row_number().over(Window.partitionBy("contract", days_.DAY).orderBy("_day0", "_at0")) == 1)
    head = F.col("_s").isNull()
    rows = inside.join(heads, ["contract", days_.DAY]).filter(head | F.col("_one"))
    rows = rows.withColumns({
        "session_id": F.struct(F.when(head, F.col("_day0")).otherwise(F.col(days_.DAY)).alias("day"), F.when(head, F.col("_at0")).otherwise(F.col("_s")).cast("long").alias("at")),
        "place": F.when(head, F.col("_before") + F.col("_p")).otherwise(F.col("_p") - F.col("_s") + 1),
    }).withColumns({"bar_idx": F.floor((F.col("place") - 1) / tau), "bar_seq": F.col("_c")})
    whole = B.rolled_up(rows, key, tau, "_end")
    ends = table.select(*lane, days_.DAY, F.col("_from.day").alias("_day0"), F.col("_from.at").alias("_at0"), "_bars", "_head_bars")
    out = whole.withColumnRenamed("bar_seq", "_c").withColumn(days_.DAY, F.to_date("_end")).join(ends, ["contract", days_.DAY])
    of_head = (F.col("session_id.day") == F.col("_day0")) & (F.col("session_id.at") == F.col("_at0"))
    own = (F.col("session_id.day") == F.col(days_.DAY)) & (F.col("session_id.at") > 1)
    out = out.filter(of_head | own).withColumn("bar_seq", (F.col("_bars") + F.when(of_head, 0).otherwise(F.col("_head_bars") + F.col("_c")) + F.col("bar_idx")).cast("long"))
    return out.select(*lane, "time", *B.OHLCV, "bar_seq", "_end")


def lanes(bars: DataFrame, asked: DataFrame, p: training.Params) -> tuple[DataFrame, DataFrame]:
    """(tau bars with features by contract and lane, cutoffs with their lane and n_bars): a cutoff's bars are the first n_bars of its lane.

    A lane is a drop rank: sessions, tau bars and smoothed features are made once for it, whatever the number of cutoffs. Cutoffs that can't
    share have a lane of their own, trained alone.
    """
    lane = ["contract", "lane"]
    plans = written(cutoff_plans(bars, asked, p.min_completeness), "cutoff-plans")
    name = F.when(F.col("shared"), F.col("drop_rank").cast("string")).otherwise(F.concat(F.lit("alone "), F.col("cutoff").cast("string")))
    plans = plans.withColumn("lane", name)
    drops = plans.filter("shared").groupBy(*lane).agg(F.max("threshold").alias("threshold"))
    counts = bars.groupBy("contract", F.to_date("time").alias(days_.DAY)).agg(F.count("*").alias("_rows"))
    kept = counts.join(drops, "contract").filter("_rows >= threshold").select(*lane, days_.DAY)
    out = training.in_ticks(lane_bars(bars, kept, p.tau), p)
    alone = plans.filter("not shared").select("contract", "cutoff", "lane")
    some_alone = bool(alone.limit(1).count())
    if some_alone:
        plain = training.ranged(training_sets(bars, alone).join(alone, ["contract", "cutoff"]).drop("cutoff"), lane, p)
        out = out.unionByName(plain.withColumn("_end", F.lit(None).cast("timestamp_ntz")).select(*out.columns))
    feats = written(training.featured(out, lane, p), "lane-features")
    ends = feats.filter("_end is not null").groupBy(*lane, F.to_date("_end").alias("date")).agg(F.max("bar_seq").alias("_last"))
    cutoffs = days_before(ends, plans.filter("shared").select(*lane, "cutoff"), F.col("_last") + 1, "n_bars")
    if some_alone:
        cutoffs = cutoffs.unionByName(alone.join(feats.groupBy(*lane).agg(F.count("*").alias("n_bars")), lane))
    return feats, cutoffs.filter("n_bars > 0")


def cutoff_features(bars: DataFrame, asked: DataFrame, p: training.Params) -> DataFrame:
    """Tau bars with features of every (contract, cutoff), as training on the bars up to each cutoff would give them."""
    feats, cutoffs = lanes(bars, asked, p)
    return feats.join(cutoffs, ["contract", "lane"]).filter(F.col("bar_seq") < F.col("n_bars"))


#: Bars of all cutoffs together beyond which states are counted by moves.
MANY_BARS = 20_000_000


def bounded_cutoffs(bars: DataFrame, asked: DataFrame, p: training.Params) -> tuple[DataFrame, DataFrame]:
    """(tau bars with features by lane, boundaries with status of every cutoff, selected from one dealing of the lane's bars)."""
    with scratch() as keep:
        feats, cutoffs = lanes(bars, asked, p)
        starts = states.with_burn_in(written(cutoffs, "cutoff-bars"), p.halflife, p.sizes)
        bounds = states.prefix_boundaries(feats, ["contract", "lane"], starts, ["cutoff"], p.sizes, p.digits)
        return keep(feats), keep(written(bounds, "bounds"))


def classified(feats: DataFrame, bounds: DataFrame) -> DataFrame:
    """Every cutoff's bars with their states, by a join; for reports and where there are few of them."""
    rows = feats.join(bounds.filter("status = 'ok'").drop("status"), ["contract", "lane"]).filter(F.col("bar_seq") < F.col("n_bars"))
    return rows.withColumns({s: states.right_closed(F.col(f), F.col(b)) for s, (f, b) in states.FEATURES.items()}).drop(*(b for _, b in states.FEATURES.values()))


def cutoff_frequencies(feats: DataFrame, bounds: DataFrame, many: int | None = None) -> DataFrame:
    """contract, cutoff, state, direction, ell, n_seen. Bars beyond ``many`` in all are counted by moves between states, fewer in the join that
    gives them to their cutoffs, summed before the shuffle; both give the same."""
    if (bounds.agg(F.sum("n_bars")).first()[0] or 0) > (MANY_BARS if many is None else many):
        return moves.frequencies(feats, ["contract", "lane"], bounds, ["cutoff"]).drop("lane")
    return M.frequencies(classified(feats, bounds), ["contract", "cutoff"])


def fit_cutoffs(bars: DataFrame, asked: DataFrame, p: training.Params = training.Params()) -> dict[str, DataFrame]:
    """Model tables keyed by (contract, cutoff), equal to ``training.fit`` on ``training_sets``."""
    feats, bounds = bounded_cutoffs(bars, asked, p)
    return training.modelled(classified(feats, bounds), bounds, ["contract", "cutoff"], p, cutoff_frequencies(feats, bounds))


def place(bars: DataFrame, asked: DataFrame, p: training.Params = training.Params(), risk: float = 0.6, level: str = "first_failing") -> DataFrame:
    """All columns of ``asked`` (contract, timestamp, signal, ...) with cutoff, state, level, accepted level and opti_price.

    ``level`` is first_failing or last_accepted. Signals without a model or an earlier bar have a status and a null price.
    """
    if level not in ("first_failing", "last_accepted"):
        raise ValueError("level must be first_failing or last_accepted")
    keys = ["contract", "cutoff"]
    asked = asked.withColumn("cutoff", F.date_trunc("DAY", "timestamp").cast("timestamp_ntz"))
    bars, asked = written(bars, "bars"), written(asked, "asked")
    feats, bounds = bounded_cutoffs(bars, asked, p)
    # prices need the cumulatives alone, and these the levels that occur
    steps = M.steps(M.pmf(cutoff_frequencies(feats, bounds), keys, p.method, p.alpha, dense_bins=0), keys)
    live = written(scan.live_features(bars, ["contract"], p.halflife), "live")
    seen = signals.as_of_prior(asked, live, ["contract"], "timestamp", "time", ["time", "close", *LIVE])
    known = bounds.select(*keys, "status", *(b for _, b in states.FEATURES.values()))
    out = seen.join(known, keys, "left").withColumn("direction", signals.side(F.col("signal")))
    out = out.withColumns({s: F.when(F.col("status") == "ok", states.left_closed(F.col(r) if p.digits is None else F.round(r, p.digits), F.col(b))) for (s, (_, b)), r in zip(states.FEATURES.items(), LIVE)})
    status = F.when(F.col("close").isNull(), "no_prior_bar").when(F.col("status").isNull(), "no_bars").otherwise(F.col("status"))
    out = signals.placement_levels(out.withColumn("status", status), steps, keys, risk)
    used = F.col("level" if level == "first_failing" else "accepted_level")
    out, tick = p.ticked(out)
    price = F.when(F.col("status") == "ok", signals.limit_price(F.col("close"), used, tick, F.col("direction")))
    keep = lambda c: F.when(F.col("status") == "ok", F.col(c)).alias(c)
    return out.select(*asked.columns, "direction", "m", "n", "k", keep("level"), keep("accepted_level"), keep("accepted_prob"), price.alias("opti_price"), "status")
