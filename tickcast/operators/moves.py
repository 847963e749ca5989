"""How often each range occurs in each state, for many prefixes of a series whose state boundaries differ, by moves between states.

From one prefix to the next a bar changes its state only if a boundary passes its value, and it comes in or goes out once. So a bar gives a row
for its first state and one for each move; counts at a prefix are running sums of what came and went. Rows follow bars plus moves, where giving every
prefix its bars would follow their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickcast.operators import selection, states
from tickcast.operators.model import STATE

#: Approximate quantiles that values and moving boundaries meet by.
EDGES = 256
MOST = 1 << 24


def numbered(bounds: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Usable prefixes of each series with their number ``_c``, shortest first."""
    fine = bounds.filter("status = 'ok'")
    return fine.withColumn("_c", F.row_number().over(Window.partitionBy(*keys).orderBy("n_bars", order)) - 1)


def spans(feats: DataFrame, keys: list[str], prefixes: DataFrame) -> DataFrame:
    """Bars with the numbers of the first prefix that they count in and of the first after it that they don't; other bars go."""
    ends = prefixes.groupBy(*keys).agg(F.array_sort(F.collect_list("n_bars")).alias("_ends"), F.array_sort(F.collect_list("j_s")).alias("_starts"))
    upto = lambda c: selection.count_below(F.col(c), F.col("bar_seq"), MOST, equal=True)
    out = feats.join(ends, keys).withColumns({"_enter": upto("_ends"), "_leave": upto("_starts")})
    return out.drop("_ends", "_starts").filter("_enter < _leave")


def boundary_moves(prefixes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _feature, _c, _low, _high, _by: values in (_low, _high] lie on the other side of a boundary from prefix _c on; _by is +1 or -1."""
    each = Window.partitionBy(*keys, "_feature", "_i").orderBy("_c")
    named = F.array(*(F.struct(F.lit(f).alias("_feature"), F.col(b).alias("_b")) for f, b in states.FEATURES.values()))
    one = prefixes.select(*keys, "_c", F.explode(named).alias("_n")).select(*keys, "_c", "_n._feature", F.posexplode("_n._b").alias("_i", "_now"))
    one = one.withColumn("_was", F.lag("_now").over(each)).filter("_was <> _now")
    return one.select(*keys, "_feature", "_c", F.least("_was", "_now").alias("_low"), F.greatest("_was", "_now").alias("_high"), F.when(F.col("_now") > F.col("_was"), -1).otherwise(1).alias("_by"))


def bar_moves(bars: DataFrame, keys: list[str], moved: DataFrame, edges: int = EDGES) -> DataFrame:
    """keys, bar_seq, _c, m, n, k: by how much a bar's state changes at prefix _c, while it counts.

    Values and moved boundaries meet in buckets between approximate quantiles; only bars whose value was passed come out.
    """
    values = bars.select(*keys, "bar_seq", "_enter", "_leave", F.explode(F.array(*(F.struct(F.lit(f).alias("_feature"), F.col(f).cast("double").alias("_x")) for f, _ in states.FEATURES.values()))).alias("_v"))
    values = values.select(*keys, "bar_seq", "_enter", "_leave", "_v.*")
    by = [*keys, "_feature"]
    marks = values.groupBy(*by).agg(F.array_distinct(F.percentile_approx("_x", [i / edges for i in range(1, edges)], 10 * edges)).alias("_edges"))
    place = lambda c: selection.count_below(F.col("_edges"), F.col(c), edges)
    values = values.join(marks, by).withColumn("_bucket", place("_x")).drop("_edges")
    moved = moved.join(marks, by).withColumn("_bucket", F.explode(F.sequence(place("_low"), place("_high")))).drop("_edges")
    passed = (F.col("_x") > F.col("_low")) & (F.col("_x") <= F.col("_high")) & (F.col("_c") > F.col("_enter")) & (F.col("_c") < F.col("_leave"))
    met = values.join(moved, [*by, "_bucket"]).filter(passed)
    change = lambda f: F.sum(F.when(F.col("_feature") == f, F.col("_by")).otherwise(0)).cast("int")
    return met.groupBy(*keys, "bar_seq", "_c").agg(*(change(f).alias(s) for s, (f, _) in states.FEATURES.items()))


def stays(feats: DataFrame, keys: list[str], prefixes: DataFrame) -> DataFrame:
    """keys, bar_seq, r, r_up, r_dn, m, n, k, _c, _until: from prefix _c to before _until a bar counts in one state."""
    bars = spans(feats, keys, prefixes)
    first = bars.join(prefixes.select(*keys, F.col("_c").alias("_enter"), *(b for _, b in states.FEATURES.values())), [*keys, "_enter"])
    whole = ["r", "r_up", "r_dn"]
    first = first.select(*keys, "bar_seq", F.col("_enter").alias("_c"), *(states.right_closed(F.col(f), F.col(b)).alias(s) for s, (f, b) in states.FEATURES.items()), "_leave", *whole)
    events = first.unionByName(bar_moves(bars, keys, boundary_moves(prefixes, keys)), allowMissingColumns=True)
    life = Window.partitionBy(*keys, "bar_seq").orderBy("_c")
    so_far, whole_life = life.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys, "bar_seq")
    until = F.coalesce(F.lead("_c").over(life), F.max("_leave").over(whole_life))
    return events.select(*keys, "bar_seq", *(F.max(c).over(whole_life).alias(c) for c in whole), *(F.sum(s).over(so_far).cast("int").alias(s) for s in STATE), "_c", until.alias("_until"))


def frequencies(feats: DataFrame, keys: list[str], bounds: DataFrame, ids: list[str]) -> DataFrame:
    """keys, ids, state, direction, ell, n_seen for every usable prefix of ``bounds``; equal to counting each prefix's bars."""
    prefixes = numbered(bounds, keys, ids[0])
    sign: Column = F.explode(F.array(F.struct(F.col("_c").alias("_at"), F.lit(1).alias("_by")), F.struct(F.col("_until").alias("_at"), F.lit(-1).alias("_by"))))
    ways = F.explode(F.create_map(F.lit("range"), "r", F.lit("range_up"), "r_up", F.lit("range_dn"), "r_dn")).alias("direction", "ell")
    came = stays(feats, keys, prefixes).select(*keys, *STATE, "_c", "_until", ways).select(*keys, *STATE, "direction", "ell", sign.alias("_s"))
    cell = [*keys, *STATE, "direction", "ell"]
    changes = came.groupBy(*cell, F.col("_s._at").alias("_c")).agg(F.sum("_s._by").alias("_by")).filter("_by <> 0")
    over = Window.partitionBy(*cell).orderBy("_c")
    counts = changes.withColumns({"n_seen": F.sum("_by").over(over.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.lead("_c").over(over)}).filter("n_seen > 0")
    counts = counts.withColumn("_c", F.explode(F.sequence(F.col("_c"), F.col("_next") - 1)))
    return counts.join(prefixes.select(*keys, *ids, "_c"), [*keys, "_c"]).select(*keys, *ids, *STATE, "direction", "ell", "n_seen")
