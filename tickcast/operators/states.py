"""Market states: burn-in, exact quantile boundaries, right-closed training bins and left-closed live bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickcast.operators import selection

#: Bars of a series beyond which boundaries are selected by counts instead of in one group.
LONG_SERIES = 1 << 20
FEATURES = {"m": ("v_ewma", "volume_bounds"), "n": ("sigma_ewma", "volatility_bounds"), "k": ("delta_x_ewma", "price_change_bounds")}


def burn_in(df: DataFrame, keys: list[str], halflife: float, sizes: tuple[int, int, int]) -> DataFrame:
    """keys, n_bars, j_s: the first position used; half the series where it is too short."""
    return with_burn_in(df.groupBy(*keys).agg(F.count("*").alias("n_bars")), halflife, sizes)


def with_burn_in(counts: DataFrame, halflife: float, sizes: tuple[int, int, int]) -> DataFrame:
    """Add j_s to rows with n_bars."""
    wanted = max(100, int(3 * halflife), 50 * max(sizes))
    return counts.withColumn("j_s", F.when(F.lit(wanted) >= F.col("n_bars"), F.floor(F.col("n_bars") / 2)).otherwise(F.lit(wanted)).cast("long"))


def rounded(df: DataFrame, digits: int | None) -> DataFrame:
    return df if digits is None else df.withColumns({f: F.round(f, digits) for f, _ in FEATURES.values()})


def boundaries(df: DataFrame, keys: list[str], starts: DataFrame, sizes: tuple[int, int, int], digits: int | None = None, long_series: int = LONG_SERIES) -> DataFrame:
    """keys, n_bars, j_s, three arrays of exact interpolated quantiles, and status (ok or degenerate_bins).

    ``percentile`` gathers the values of a series in one group; where a series has more than ``long_series`` bars all are selected by counts instead.
    """
    if (starts.agg(F.max("n_bars")).first()[0] or 0) > long_series:
        return prefix_boundaries(df, keys, starts, [], sizes, digits)
    used = df.join(starts, keys).filter(F.col("bar_seq") >= F.col("j_s"))
    cut = lambda c, n: F.percentile(c, F.array(*(F.lit(i / n) for i in range(1, n)))) if n > 1 else F.first(F.array().cast("array<double>"))
    q = used.groupBy(*keys).agg(*(cut(f, n).alias(b) for (f, b), n in zip(FEATURES.values(), sizes)))
    return _with_status(starts.join(q, keys), digits)


def prefix_boundaries(df: DataFrame, keys: list[str], asked: DataFrame, ids: list[str], sizes: tuple[int, int, int], digits: int | None = None, **limits: int) -> DataFrame:
    """As ``boundaries``, for many prefixes of each series: ``asked`` holds keys, ids, n_bars and j_s; bars from j_s to n_bars count.

    Bars are dealt into buckets once for all prefixes; no bar is given to a prefix.
    """
    cuts = {f: [i / n for i in range(1, n)] for (f, _), n in zip(FEATURES.values(), sizes)}
    values = df.select(*keys, F.col("bar_seq").alias("pos"), F.explode(F.array(*(F.struct(F.lit(f).alias("_feature"), F.col(f).cast("double").alias("x")) for f in cuts))).alias("_v")).select(*keys, "pos", "_v.*")
    shares = F.array(*(F.struct(F.lit(f).alias("_feature"), F.array(*map(F.lit, c)).cast("array<double>").alias("_shares")) for f, c in cuts.items() if c))
    ranges = asked.select(*keys, *ids, F.col("j_s").alias("lo"), F.col("n_bars").alias("hi"))
    if not any(cuts.values()):
        return _with_status(asked.withColumns({b: F.array().cast("array<double>") for _, b in FEATURES.values()}), digits)
    ranges = ranges.select(*keys, *ids, "lo", "hi", F.explode(shares).alias("_s")).select(*keys, *ids, "lo", "hi", "_s.*")
    got = selection.range_quantiles(values, [*keys, "_feature"], ranges, ids, F.col("_shares"), **limits)
    q = got.groupBy(*keys, *ids).agg(*(F.coalesce(F.max(F.when(F.col("_feature") == f, F.col("quantiles"))), F.array().cast("array<double>")).alias(b) for f, b in FEATURES.values()))
    return _with_status(asked.join(q, [*keys, *ids]), digits)


def _with_status(bounds: DataFrame, digits: int | None) -> DataFrame:
    if digits is not None:
        bounds = bounds.withColumns({b: F.transform(b, lambda x: F.round(x, digits)) for _, b in FEATURES.values()})
    tied = lambda b: F.size(F.array_distinct(b)) < F.size(b)
    some = tied("volume_bounds") | tied("volatility_bounds") | tied("price_change_bounds")
    return bounds.withColumn("status", F.when(some, "degenerate_bins").otherwise("ok"))


def right_closed(x: Column, bounds: Column) -> Column:
    return (1 + F.size(F.filter(bounds, lambda b: x > b))).cast("int")


def left_closed(x: Column, bounds: Column) -> Column:
    """A null value is in the first bin."""
    return (1 + F.size(F.filter(bounds, lambda b: F.coalesce(x >= b, F.lit(False))))).cast("int")


def assign(df: DataFrame, keys: list[str], bounds: DataFrame) -> DataFrame:
    """Add j_s, m, n, k to every row of series with usable boundaries."""
    out = df.join(bounds.filter("status = 'ok'").drop("n_bars", "status"), keys)
    return out.withColumns({s: right_closed(F.col(f), F.col(b)) for s, (f, b) in FEATURES.items()}).drop(*(b for _, b in FEATURES.values()))


def live_states(df: DataFrame, bounds: DataFrame, on: list[str], readings: tuple[str, str, str]) -> DataFrame:
    """Add m, n, k of current readings by the boundaries of their model."""
    out = df.join(bounds.select(*on, *(b for _, b in FEATURES.values())), on)
    return out.withColumns({s: left_closed(F.col(r), F.col(b)) for (s, (_, b)), r in zip(FEATURES.items(), readings)}).drop(*(b for _, b in FEATURES.values()))


def histogram(states: DataFrame, keys: list[str], sizes: tuple[int, int, int]) -> DataFrame:
    """keys, states_observed, states_possible, least and most samples of a state, over rows past the burn-in."""
    per = states.filter("bar_seq >= j_s").groupBy(*keys, "m", "n", "k").agg(F.count("*").alias("samples"))
    return per.groupBy(*keys).agg(
        F.count("*").alias("states_observed"), F.lit(sizes[0] * sizes[1] * sizes[2]).cast("long").alias("states_possible"), F.min("samples").alias("least_samples"), F.max("samples").alias("most_samples")
    )
