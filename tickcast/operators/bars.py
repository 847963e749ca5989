"""Cleaning bars, sessions, roll-up to tau bars, ranges in ticks.

All functions work on many series at once; ``keys`` names a series. Long windows go by series and day. Times should be unique in a
series; rows of one time are taken in the order of their other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickcast.operators import days

OHLCV = ["open", "high", "low", "close", "volume"]

def until_cutoff(bars: DataFrame, cutoff: Column | str) -> DataFrame:
    """Bars up to and including the cutoff; a plain filter, pushed to the scan."""
    return bars.filter(F.col("time") <= (F.to_timestamp_ntz(F.lit(cutoff)) if isinstance(cutoff, str) else cutoff))


GAP = "4 hours"


def daily_counts(bars: DataFrame, keys: list[str], min_completeness: float = 0.9) -> DataFrame:
    """keys, date, n_bars, expected (exact median of the days), is_kept. Aggregated to days before anything else."""
    counts = bars.groupBy(*keys, F.to_date("time").alias("date")).agg(F.count("*").alias("n_bars"))
    return counts.withColumn("expected", days.median_of_days(counts, keys, "n_bars")).withColumn("is_kept", F.col("n_bars") >= F.col("expected") * min_completeness)


def drop_sparse_days(bars: DataFrame, keys: list[str], min_completeness: float = 0.9) -> DataFrame:
    """Bars of days that hold at least ``min_completeness`` of the median day. The day table is small: one row a series and day."""
    kept = daily_counts(bars, keys, min_completeness).filter("is_kept").select(*keys, F.col("date").alias("_date"))
    return bars.withColumn("_date", F.to_date("time")).join(kept, [*keys, "_date"], "left_semi").drop("_date")


def with_sessions(bars: DataFrame, keys: list[str], gap: str = GAP) -> DataFrame:
    """Add session_id (from 1): a new session starts after a gap of more than ``gap``."""
    return days.sessions(bars, keys, gap, "_rn").drop("_rn")


def tau_bars(bars: DataFrame, keys: list[str], tau: int, min_completeness: float | None = None) -> DataFrame:
    """Bars of ``tau`` consecutive rows of a session, with bar_seq (position in the series from 0); an unfinished last bar goes.

    With ``min_completeness`` sparse days go first, told by the same table of days that carries the sessions. tau=1 passes bars through, without
    sessions. Bars are sorted into (series, day) once; rows are summed to bars before the next shuffle.
    """
    if tau == 1:
        kept = bars if min_completeness is None else drop_sparse_days(bars, keys, min_completeness)
        return days.positions(kept, keys, "bar_seq").select(*keys, "time", *OHLCV, "bar_seq")
    inside = days.inside_days(bars.select(*keys, "time", *OHLCV), keys, GAP, tau)
    table = days.day_summaries(inside, keys)
    if min_completeness is not None:
        table = table.withColumn("_expected", days.median_of_days(table, keys)).filter(F.col("_n") >= F.col("_expected") * min_completeness).drop("_expected")
    return rolled_up(days.placed(inside, days.carried(table, keys, GAP, tau), keys, tau), keys, tau)


def rolled_up(placed: DataFrame, keys: list[str], tau: int, end: str | None = None) -> DataFrame:
    """Whole bars of rows with session_id, place, bar_idx and bar_seq; ``end`` names a column for the time of a bar's last row."""
    out = placed.groupBy(*keys, "session_id", "bar_idx").agg(
        F.min("time").alias("time"), F.min_by("open", "place").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "place").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("_n"), F.min("bar_seq").alias("bar_seq"),
        *([F.max("time").alias(end)] if end else []),
    )
    return out.filter(F.col("_n") == tau).withColumn("completeness", F.lit(1.0)).drop("_n")


def tick_ranges(bars: DataFrame, tick: Column | float) -> DataFrame:
    """Add r, r_up, r_dn: whole ticks from low to high, open to high, low to open; halves go to the even number."""
    tick = F.lit(tick) if isinstance(tick, (int, float)) else tick
    ticks = lambda d: F.rint(d / tick).cast("long")
    return bars.withColumns({"r": ticks(F.col("high") - F.col("low")), "r_up": ticks(F.col("high") - F.col("open")), "r_dn": ticks(F.col("open") - F.col("low"))})


def quality_report(bars: DataFrame, keys: list[str], tau: int, tick: Column | float, min_completeness: float = 0.9) -> DataFrame:
    """keys, n_rows, n_days, n_sparse_days, n_kept_rows, n_bars, n_discrepant: what each stage lets through."""
    counts = daily_counts(bars, keys, min_completeness).groupBy(*keys).agg(
        F.sum("n_bars").alias("n_rows"), F.count("*").alias("n_days"), F.count_if(~F.col("is_kept")).alias("n_sparse_days"), F.sum(F.when(F.col("is_kept"), F.col("n_bars")).otherwise(0)).alias("n_kept_rows")
    )
    ranged = tick_ranges(tau_bars(bars, keys, tau, min_completeness), tick)
    per = ranged.groupBy(*keys).agg(F.count("*").alias("n_bars"), F.count_if(F.abs(F.col("r") - (F.col("r_up") + F.col("r_dn"))) > 1).alias("n_discrepant"))
    return counts.join(per, keys, "left").fillna(0, ["n_bars", "n_discrepant"])
