"""Positions and sessions along long series without a window over a whole series.

Rows are numbered inside their day; a table of one row a series and day carries counts and last values over the days. Only that
table has windows by series alone, so a long series is many (series, day) groups. What a day says about its sessions
(``day_summaries``) does not depend on other days, and ``carried`` composes days, so any set of days can be put together from it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = "_day"
#: Columns of a row inside its day, of a day by itself, and of a day among the days before.
INSIDE, SUMMARY, CARRIED = ["_p", "_k", "_s", "_c"], ["_n", "_first", "_last", "_starts", "_at_last", "_closed", "_head"], ["_base", "_ids", "_from", "_bars", "_head_bars"]


def _before(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(DAY).rowsBetween(Window.unboundedPreceding, -1)


def positions(df: DataFrame, keys: list[str], name: str, time: str = "time") -> DataFrame:
    """Add ``name``, the place in the series by time, from 0."""
    days = df.groupBy(*keys, F.to_date(time).alias(DAY)).agg(F.count("*").alias("_n"))
    days = days.select(*keys, DAY, F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)).alias("_base"))
    d = df.withColumn(DAY, F.to_date(time))
    d = d.withColumn(name, F.row_number().over(Window.partitionBy(*keys, DAY).orderBy(time)))
    return d.join(days, [*keys, DAY]).withColumn(name, (F.col("_base") + F.col(name) - 1).cast("long")).drop("_base", DAY)


def inside_days(df: DataFrame, keys: list[str], gap: str, tau: int = 1) -> DataFrame:
    """Add the day and, inside it: place ``_p``, number ``_k`` of gaps so far, place ``_s`` of the row after the last one, whole bars ``_c`` between gaps.

    Rows of one time are ordered by their other columns, so that a repeated run numbers them alike. Rows without a key or time go; the summary
    and the rows then need one and the same exchange.
    """
    ties = [c for c in df.columns if c not in (*keys, "time")]
    day = Window.partitionBy(*keys, DAY).orderBy("time", *ties)
    so_far, earlier = day.rowsBetween(Window.unboundedPreceding, 0), day.rowsBetween(Window.unboundedPreceding, -1)
    d = df.withColumn(DAY, F.to_date("time")).filter(reduce(Column.__and__, (F.col(c).isNotNull() for c in (*keys, DAY))))
    d = d.withColumns({"_p": F.row_number().over(day), "_prev": F.lag("time").over(day)})
    d = d.withColumn("_at", F.when(F.col("time") - F.col("_prev") > F.expr(f"INTERVAL {gap}"), F.col("_p"))).drop("_prev")
    d = d.withColumns({"_k": F.count("_at").over(so_far), "_s": F.max("_at").over(so_far), "_s0": F.max("_at").over(earlier)})
    whole = F.when(F.col("_at").isNotNull(), F.floor((F.col("_p") - F.col("_s0")) / tau))
    return d.withColumn("_c", F.coalesce(F.sum(whole).over(so_far), F.lit(0))).drop("_s0")


def day_summaries(inside: DataFrame, keys: list[str]) -> DataFrame:
    """One row a series and day: rows, edge times, gaps inside, place after the last gap, whole bars between gaps, rows before the first gap."""
    return inside.groupBy(*keys, DAY).agg(
        F.count("*").alias("_n"), F.min("time").alias("_first"), F.max("time").alias("_last"), F.max("_k").alias("_starts"), F.max("_s").alias("_at_last"),
        F.max("_c").alias("_closed"), F.coalesce(F.min("_at") - 1, F.count("*")).alias("_head"),
    )


def carried(days: DataFrame, keys: list[str], gap: str, tau: int = 1) -> DataFrame:
    """Days of ``day_summaries`` (all, or those that stay) with what the days before them say.

    ``_base`` rows came before; the day begins in session ``_ids``, which started at ``_from`` (row of the series from 1, its day, its place in
    that day) and has ``_bars`` whole bars before it; it has ``_head_bars`` whole bars itself if it ends inside the day.
    """
    by, before = Window.partitionBy(*keys).orderBy(DAY), _before(keys)
    col, zero = F.col, F.lit(0)
    d = days.withColumns({"_base": F.coalesce(F.sum("_n").over(before), zero), "_eve": F.lag("_last").over(by)})
    d = d.withColumn("_opens", (col("_eve").isNull() | (col("_first") - col("_eve") > F.expr(f"INTERVAL {gap}"))).cast("int"))
    start = lambda at: F.struct((col("_base") + at).cast("long").alias("row"), col(DAY).alias("day"), F.lit(at).cast("long").alias("at") if isinstance(at, int) else at.cast("long").alias("at"))
    d = d.withColumn("_start", F.when(col("_starts") > 0, start(col("_at_last"))).when(col("_opens") == 1, start(1)))
    d = d.withColumns({
        "_from": F.when(col("_opens") == 1, start(1)).otherwise(F.max("_start").over(before)),
        "_ids": (F.coalesce(F.sum(col("_starts") + col("_opens")).over(before), zero) + col("_opens")).cast("int"),
    })
    d = d.withColumn("_run", col("_base") + col("_head") - col("_from.row") + 1)
    d = d.withColumns({"_head_bars": F.floor(col("_run") / tau), "_open": F.when(col("_starts") > 0, col("_n") - col("_at_last") + 1).otherwise(col("_run"))})
    ended = F.when(col("_starts") > 0, col("_head_bars") + col("_closed")).otherwise(zero)
    left = F.when(col("_opens") == 1, F.coalesce(F.floor(F.lag("_open").over(by) / tau), zero)).otherwise(zero)
    d = d.withColumns({"_ended": ended, "_left": left})
    bars = F.coalesce(F.sum("_ended").over(before), zero) + F.sum("_left").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("_bars", bars).drop("_eve", "_opens", "_start", "_run", "_open", "_ended", "_left")


def placed(inside: DataFrame, days: DataFrame, on: list[str], tau: int = 1) -> DataFrame:
    """Rows of ``inside`` on the days of ``days`` (joined by ``on``), with session_id, place in the session from 1, bar_idx and bar_seq."""
    d = inside.drop("_at").join(days.drop(*SUMMARY), [*on, DAY])
    head = F.col("_s").isNull()
    d = d.withColumn("place", F.when(head, F.col("_base") + F.col("_p") - F.col("_from.row") + 1).otherwise(F.col("_p") - F.col("_s") + 1))
    d = d.withColumns({"session_id": (F.col("_ids") + F.col("_k")).cast("int"), "bar_idx": F.floor((F.col("place") - 1) / tau).cast("int")})
    d = d.withColumn("bar_seq", (F.col("_bars") + F.when(head, 0).otherwise(F.col("_head_bars") + F.col("_c")) + F.col("bar_idx")).cast("long"))
    return d.drop(DAY, *INSIDE, *CARRIED)


def sessions(df: DataFrame, keys: list[str], gap: str, place: str) -> DataFrame:
    """Add session_id (from 1; a new one after a gap of more than ``gap``) and ``place``, the row's number in its session from 1."""
    inside = inside_days(df, keys, gap)
    d = placed(inside, carried(day_summaries(inside, keys), keys, gap), keys).drop("bar_idx", "bar_seq")
    return d.withColumnRenamed("place", place)


def median_of_days(days: DataFrame, keys: list[str], count: str = "_n") -> Column:
    """Exact median of the days' counts, over the table of days."""
    return F.percentile(count, 0.5).over(Window.partitionBy(*keys))


def last_before(both: DataFrame, keys: list[str], time: str, order: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the last non-null ``value`` up to each row of ``both`` in its day, or else of the last earlier day that has one."""
    b = both.withColumn(DAY, F.to_date(time))
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
    days = b.groupBy(*keys, DAY).agg(last.alias("_end"))
    days = days.select(*keys, DAY, F.last("_end", ignorenulls=True).over(_before(keys)).alias("_carry"))
    inside = Window.partitionBy(*keys, DAY).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn(name, F.last(value, ignorenulls=True).over(inside)).join(days, [*keys, DAY])
    return b.withColumn(name, F.coalesce(name, "_carry")).drop(DAY, "_carry")
