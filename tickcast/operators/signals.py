"""Signals from inventory changes, tick sizes from prices, as-of rows and limit prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickcast.operators import days
from tickcast.operators import model as M

LEVELS = 10


def inventory_signals(inventory: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows whose inventory changed, with signal = change; the first row and rows with any null go.

    ``order`` begins with a time; a file is gone through by days, the last row of a day is carried to the next one.
    """
    day = Window.partitionBy(*by, days.DAY)
    rows = inventory.withColumn(days.DAY, F.to_date(order[0]))
    ends = rows.groupBy(*by, days.DAY).agg(F.max_by(F.struct("inventory"), F.struct(*order)).alias("_end"))
    ends = ends.select(*by, days.DAY, F.lag("_end").over(Window.partitionBy(*by).orderBy(days.DAY)).alias("_eve"))
    rows = rows.withColumns({"_here": F.row_number().over(day.orderBy(*order)), "_before": F.lag("inventory").over(day.orderBy(*order))})
    rows = rows.join(ends, [*by, days.DAY]).withColumn("_before", F.when(F.col("_here") == 1, F.col("_eve.inventory")).otherwise(F.col("_before")))
    change = (F.col("inventory") - F.col("_before")).cast("double")
    return rows.withColumn("signal", change).select(*inventory.columns, "signal").filter("signal <> 0").dropna("any")


def inferred_ticks(bars: DataFrame, by: list[str], files: list[str], digits: int = 9) -> DataFrame:
    """by, tick_size: the least positive step between sorted distinct prices of one column of one file; prices shrink to grids first."""
    grid = bars.select(*dict.fromkeys([*by, *files]), F.explode(F.create_map(*[x for c in ("open", "high", "low", "close") for x in (F.lit(c), F.col(c))])).alias("side", "price")).distinct()
    step = F.col("price") - F.lag("price").over(Window.partitionBy(*dict.fromkeys([*by, *files]), "side").orderBy("price"))
    return grid.withColumn("step", F.round(step, digits)).filter("step > 0").groupBy(*by).agg(F.min("step").alias("tick_size"))


def as_of_prior(left: DataFrame, right: DataFrame, keys: list[str], time: str, right_time: str, columns: list[str]) -> DataFrame:
    """Add the columns of the last right row strictly before each left row's time; sorted by key and day, no range join."""
    lcols = [c for c in left.columns if c not in keys]
    l = left.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_kind"), F.struct(*lcols).alias("_left"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("_right"))  # noqa: E741
    r = right.select(*keys, F.col(right_time).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(l.schema["_left"].dataType).alias("_left"), F.struct(*columns).alias("_right"))
    both = days.last_before(l.unionByName(r), keys, "_t", ["_t", "_kind"], "_right", "_last").filter("_kind = 0")
    return both.select(*keys, *(F.col(f"_left.{c}").alias(c) for c in lcols), *(F.col(f"_last.{c}").alias(c) for c in columns))


def side(signal: Column) -> Column:
    return F.when(signal > 0, "range_dn").otherwise("range_up")


def placement_levels(asked: DataFrame, steps: DataFrame, keys: list[str], risk: float, most: int = LEVELS) -> DataFrame:
    """Add level, accepted_level, accepted_prob: the first of levels 0..9 whose probability is below ``risk``, or 9.

    ``asked`` holds keys, m, n, k, direction; ``steps`` are cumulative step functions, searched once a level for each
    distribution before the join. A level beyond them has probability 0.
    """
    by = [*keys, "m", "n", "k", "direction"]
    tried = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda x: M.cum_at(x.cast("long")))
    out = asked.join(steps.select(*by, tried.alias("_p")), by, "left").withColumn("_p", F.coalesce("_p", F.array_repeat(F.lit(0.0), most)))
    fails = F.array_position(F.transform("_p", lambda p: p < risk), True).cast("int")
    out = out.withColumn("level", F.when(fails == 0, most - 1).otherwise(fails - 1)).withColumn("accepted_level", F.when(fails == 0, most - 1).when(fails == 1, 0).otherwise(fails - 2))
    return out.withColumn("accepted_prob", F.when(fails == 1, 0.0).otherwise(F.element_at("_p", F.col("accepted_level") + 1))).drop("_p")


def limit_price(close: Column, level: Column, tick: Column, direction: Column) -> Column:
    return F.when(direction == "range_dn", close - level * tick).otherwise(close + level * tick)
