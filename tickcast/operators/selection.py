"""Exact order statistics of ranges of positions, for many ranges of a series at once and for series of any length.

The values of a series are put into buckets between a few approximate quantiles; a value that equals one of these is in a bucket of its
own, so a value with many rows never fills a bucket with others. Rows are counted by bucket and by stretch between the asked positions; a range's
counts are differences of running counts, which tell the bucket that holds the wanted rank. Only the rows of such buckets are looked at again:
sorted in an array where they are few, by the same step where they are many. So rows grow with the values plus the ranges, not their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickcast.sources.shared import written

#: Approximate quantiles of a series; rows of a bucket that one array may hold.
EDGES, LONGEST = 64, 4096


def count_below(values: Column, x: Column, most: int, equal: bool = False) -> Column:
    """How many of a sorted array's elements (at most ``most``) are less than ``x``, or not greater with ``equal``: a binary search."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(most.bit_length()))))
    less = lambda at: F.get(values, at - 1) <= x if equal else F.get(values, at - 1) < x
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.coalesce(less(n + step), F.lit(False)), n + step).otherwise(n))


def order_statistics(values: DataFrame, keys: list[str], asked: DataFrame, ids: list[str], edges: int = EDGES, longest: int = LONGEST) -> DataFrame:
    """keys, ids, x: for each row of ``asked`` (keys, ids, lo, hi, k) the k-th smallest value, from 0, among those with lo <= pos < hi.

    ``values`` holds keys, pos and x (no nulls). A rank outside its range gives no row. ``asked`` may hold thousands of ranges a series.
    """
    marks = values.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("x", [i / edges for i in range(1, edges)], 100 * edges)).alias("_edges"))
    ends = asked.select(*keys, F.explode(F.array("lo", "hi")).alias("_end")).groupBy(*keys).agg(F.array_sort(F.collect_set("_end")).alias("_ends"))
    most = 1 << 24
    below = count_below(F.col("_edges"), F.col("x"), edges)
    dealt = values.join(marks, keys).join(ends, keys).withColumns({"_i": below, "_seg": count_below(F.col("_ends"), F.col("pos"), most, equal=True)})
    on_edge = F.coalesce(F.get("_edges", F.col("_i")) == F.col("x"), F.lit(False))
    dealt = written(dealt.select(*keys, "pos", "x", "_seg", (2 * F.col("_i") + on_edge.cast("int")).alias("_bucket")), "dealt")

    cells = dealt.groupBy(*keys, "_bucket", "_seg").agg(F.count("*").alias("_n"))
    every = cells.select(*keys, "_bucket").distinct().join(ends, keys).select(*keys, "_bucket", F.explode(F.sequence(F.lit(0), F.size("_ends"))).alias("_seg"), F.lit(0).cast("long").alias("_n"))
    grid = cells.unionByName(every).groupBy(*keys, "_bucket", "_seg").agg(F.sum("_n").alias("_n"))
    up_to = Window.partitionBy(*keys, "_bucket").orderBy("_seg").rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.select(*keys, "_bucket", (F.col("_seg") + 1).alias("_t"), F.sum("_n").over(up_to).alias("_upto"))

    at = lambda c: (count_below(F.col("_ends"), F.col(c), most, equal=True)).alias("_t")  # noqa: E731  the place of an end among the sorted ends, from 1
    ranges = asked.select(*keys, "lo", "hi").distinct().join(ends, keys)
    signed = ranges.select(*keys, "lo", "hi", F.explode(F.array(F.struct(at("lo"), F.lit(-1).alias("_sign")), F.struct(at("hi"), F.lit(1).alias("_sign")))).alias("_e")).select(*keys, "lo", "hi", "_e.*")
    counts = signed.join(grid, [*keys, "_t"]).groupBy(*keys, "lo", "hi", "_bucket").agg(F.sum(F.col("_sign") * F.col("_upto")).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys, "lo", "hi").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).filter("_n > 0")
    picks = asked.select(*keys, *ids, "lo", "hi", "k").join(counts, [*keys, "lo", "hi"]).filter("k >= _before AND k < _before + _n")
    picks = written(picks.select(*keys, *ids, "lo", "hi", "_bucket", (F.col("k") - F.col("_before")).alias("k")), "picks")

    known = picks.filter("_bucket % 2 = 1").join(marks, keys).select(*keys, *ids, F.get("_edges", F.floor(F.col("_bucket") / 2).cast("int")).alias("x"))
    wanted = picks.filter("_bucket % 2 = 0").select(*keys, "_bucket").distinct()
    sizes = written(cells.join(wanted, [*keys, "_bucket"], "left_semi").groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_size")), "sizes")
    few = dealt.join(sizes.filter(F.col("_size") <= longest), [*keys, "_bucket"])
    few = few.groupBy(*keys, "_bucket").agg(F.array_sort(F.collect_list(F.struct("x", "pos"))).alias("_rows"))
    inside = F.filter("_rows", lambda r: (r["pos"] >= F.col("lo")) & (r["pos"] < F.col("hi")))
    found = picks.join(few, [*keys, "_bucket"]).select(*keys, *ids, F.get(inside, F.col("k").cast("int"))["x"].alias("x"))
    out = known.unionByName(found)
    many = sizes.filter(F.col("_size") > longest).drop("_size")
    if many.limit(1).count():
        level = f"_bucket{len(keys)}"
        named = lambda df: df.join(many, [*keys, "_bucket"], "left_semi").withColumnRenamed("_bucket", level)
        deeper = order_statistics(named(dealt).drop("_seg"), [*keys, level], named(picks), ids, edges, longest)
        out = out.unionByName(deeper.drop(level))
    return out


def interpolated(lower: Column, higher: Column, position: Column) -> Column:
    """The value at a fractional rank between its two neighbours, as Spark's ``percentile`` computes it."""
    whole = F.floor(position)
    return F.when((whole == position) | (lower == higher), lower).otherwise((whole + 1 - position) * lower + (position - whole) * higher)


def range_quantiles(values: DataFrame, keys: list[str], asked: DataFrame, ids: list[str], fractions: Column, **limits: int) -> DataFrame:
    """keys, ids, quantiles: an array of exact interpolated quantiles of the values with lo <= pos < hi for each row of ``asked`` (keys, ids, lo, hi).

    ``fractions`` is an array over the keys and ids. Positions count from 0 without gaps and no value is null.
    """
    wanted = asked.select(*keys, *ids, "lo", "hi", F.posexplode(fractions).alias("_f", "_share"))
    wanted = wanted.withColumn("_at", (F.col("hi") - F.col("lo") - 1) * F.col("_share"))
    both = F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))
    ranks = wanted.select(*keys, *ids, "lo", "hi", "_f", "_at", F.posexplode(both).alias("_side", "k"))
    got = order_statistics(values, keys, ranks, [*ids, "_f", "_at", "_side"], **limits)
    side = lambda n: F.max(F.when(F.col("_side") == n, F.col("x")))
    got = got.groupBy(*keys, *ids, "_f", "_at").agg(side(0).alias("_low"), F.coalesce(side(1), side(0)).alias("_high"))
    one = interpolated(F.col("_low"), F.col("_high"), F.col("_at"))
    return got.groupBy(*keys, *ids).agg(F.transform(F.array_sort(F.collect_list(F.struct("_f", one.alias("q")))), lambda r: r["q"]).alias("quantiles"))
