"""Conditional range distributions as long tables (keys, m, n, k, direction, ell, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickcast.operators import selection

STATE = ["m", "n", "k"]
#: Up to so many bins every level is stored; beyond, only observed levels and level 0.
DENSE_BINS = 1000


def frequencies(states: DataFrame, keys: list[str]) -> DataFrame:
    """keys, state, direction, ell, n: how often each range occurs past the burn-in; partial sums before the shuffle."""
    rows = states.filter("bar_seq >= j_s").select(*keys, *STATE, F.explode(F.create_map(F.lit("range"), "r", F.lit("range_up"), "r_up", F.lit("range_dn"), "r_dn")).alias("direction", "ell"))
    return rows.groupBy(*keys, *STATE, "direction", "ell").agg(F.count("*").alias("n_seen"))


def pmf(freq: DataFrame, keys: list[str], method: str, alpha: float = 0.5, dense_bins: int = DENSE_BINS) -> DataFrame:
    """keys, state, direction, ell, prob and the smoothing columns (base_prob 0 for raw), max_ell, num_bins, n_total.

    One window over each distribution: a level brings the unobserved ones up to the next level along, so nothing is joined. With
    ``dense_bins`` 0 observed levels and level 0 alone are stored, which is all that ``steps`` needs.
    """
    if method not in ("raw", "smoothed"):
        raise ValueError(f"method is raw or smoothed, not {method!r}")
    by = [*keys, *STATE, "direction"]
    whole = Window.partitionBy(*by)
    order = whole.orderBy("ell")
    col, zero = F.col, F.lit(0).cast("long")
    df = freq.withColumns({"n_total": F.sum("n_seen").over(whole), "max_ell": F.max("ell").over(whole), "_next": F.lead("ell").over(order), "_first": F.lag("ell").over(order).isNull()})
    df = df.withColumn("num_bins", col("max_ell") + 1)
    if method == "raw":
        alpha, dense = 0.0, F.lit(False)
        df = df.withColumns({"denominator": col("n_total").cast("double"), "base_prob": F.lit(0.0)})
    else:
        dense = (col("num_bins") <= dense_bins) & (col("max_ell") >= 0)
        df = df.withColumn("denominator", col("n_total") + alpha * col("num_bins")).withColumn("base_prob", alpha / col("denominator"))
    span = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<long>"))
    below = F.when(col("_first") & (col("ell") > 0), span(zero, F.when(dense, col("ell") - 1).otherwise(zero))).otherwise(F.array().cast("array<long>"))
    only_zero = (col("ell") < 0) & F.coalesce(col("_next") > 0, F.lit(True))
    above = F.when(dense, F.when(col("_next").isNotNull(), span(F.greatest(col("ell") + 1, zero), col("_next") - 1))).when(only_zero, F.array(zero))
    empty = F.transform(F.concat(below, F.coalesce(above, F.array().cast("array<long>"))), lambda x: F.struct(x.alias("ell"), zero.alias("n_seen")))
    rows = df.withColumn("_l", F.explode(F.concat(F.array(F.struct("ell", "n_seen")), empty)))
    prob = (col("_l.n_seen") + alpha) / col("denominator")
    return rows.select(*by, col("_l.ell").alias("ell"), "n_total", "max_ell", "num_bins", "denominator", "base_prob", prob.alias("prob"))


def steps(pmf_: DataFrame, keys: list[str]) -> DataFrame:
    """keys, state, direction, base_prob, levels, cums: the cumulative of range_up and range_dn as a sorted array of stored levels and its value there.

    Between stored levels the value follows from ``base_prob``; ``cum_at`` looks it up. Rows follow the stored levels, whatever the largest one.
    """
    by = [*keys, *STATE, "direction"]
    p = pmf_.filter((F.col("direction") != "range") & (F.col("ell") >= 0))
    up = Window.partitionBy(*by).orderBy(F.desc("ell"))
    gaps = F.coalesce(F.lag("ell").over(up) - F.col("ell") - 1, F.lit(0))
    p = p.withColumn("_gap", gaps).withColumn("_cum", F.sum(F.col("prob") + F.col("_gap") * F.col("base_prob")).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.groupBy(*by).agg(F.max("base_prob").alias("base_prob"), F.array_sort(F.collect_list(F.struct("ell", "_cum"))).alias("_s"))
    return p.select(*by, "base_prob", F.col("_s.ell").alias("levels"), F.col("_s._cum").alias("cums"))


def cum_at(ell: Column, most: int = 1 << 24) -> Column:
    """The cumulative at a level by the columns of ``steps``: a binary search; 0 below 0, beyond the largest level and where there is no row."""
    at = selection.count_below(F.col("levels"), ell, most)
    value = F.get("cums", at) + (F.get("levels", at) - ell) * F.col("base_prob")
    return F.when(ell >= 0, F.coalesce(value, F.lit(0.0))).otherwise(F.lit(0.0))


def reverse_cdf(pmf_: DataFrame, keys: list[str]) -> DataFrame:
    """keys, state, direction, ell, cum_prob for range_up and range_dn: probability of at least ell ticks, ell = 0..max.

    Only stored levels pass the window; levels between two stored ones follow in closed form from the base probability.
    """
    by = [*keys, *STATE, "direction"]
    p = pmf_.filter((F.col("direction") != "range") & (F.col("ell") >= 0))
    up = Window.partitionBy(*by).orderBy(F.desc("ell"))
    gaps = F.coalesce(F.lag("ell").over(up) - F.col("ell") - 1, F.lit(0))
    stored = p.withColumn("_gap", gaps)
    stored = stored.withColumn("cum_prob", F.sum(F.col("prob") + F.col("_gap") * F.col("base_prob")).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    # between this level and the stored one below it
    below = F.coalesce(F.lead("ell").over(up), F.lit(-1))
    stored = stored.withColumn("_low", F.when(F.lead("ell").over(up).isNull(), F.col("ell")).otherwise(below + 1))
    filled = stored.withColumn("_level", F.explode(F.sequence("_low", F.col("ell"))))
    return filled.select(*by, F.col("_level").alias("ell"), (F.col("cum_prob") + (F.col("ell") - F.col("_level")) * F.col("base_prob")).alias("cum_prob"))


def statistics(pmf_: DataFrame, keys: list[str]) -> DataFrame:
    """keys, state, sample_count, max_range, max_range_up, max_range_dn."""
    top = lambda d: F.max(F.when(F.col("direction") == d, F.col("ell")))
    return pmf_.groupBy(*keys, *STATE).agg(F.max("n_total").alias("sample_count"), top("range").alias("max_range"), top("range_up").alias("max_range_up"), top("range_dn").alias("max_range_dn"))


def issues(pmf_: DataFrame, cdf: DataFrame, keys: list[str]) -> DataFrame:
    """keys, state, direction, issue, ell, value: a row for each sum beyond 1e-6 + 1e-5 of 1 (bad_sum) and each rise of a cumulative (bad_step, at its lower level)."""
    by = [*keys, *STATE, "direction"]
    sums = _sums(pmf_, by).filter(F.abs(F.col("total") - 1) > TOLERANCE)
    sums = sums.select(*by, F.lit("bad_sum").alias("issue"), F.lit(None).cast("long").alias("ell"), F.col("total").alias("value"))
    rises = _rises(cdf, by).filter("_next > cum_prob").select(*by, F.lit("bad_step").alias("issue"), "ell", (F.col("_next") - F.col("cum_prob")).alias("value"))
    return sums.unionByName(rises)


#: How far a sum may be from 1.
TOLERANCE = 1.1e-5


def _sums(pmf_: DataFrame, by: list[str]) -> DataFrame:
    return pmf_.groupBy(*by).agg((F.sum("prob") + F.greatest(F.first("num_bins") - F.count("*"), F.lit(0)) * F.first("base_prob")).alias("total"))


def _rises(cdf: DataFrame, by: list[str]) -> DataFrame:
    return cdf.withColumn("_next", F.lead("cum_prob").over(Window.partitionBy(*by).orderBy("ell")))


def validate(pmf_: DataFrame, cdf: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_distributions, bad_sums, bad_steps, is_valid: how many of the ``issues`` a model has."""
    by = [*keys, *STATE, "direction"]
    sums = _sums(pmf_, by).groupBy(*keys).agg(F.count("*").alias("n_distributions"), F.count_if(F.abs(F.col("total") - 1) > TOLERANCE).alias("bad_sums"))
    steps_ = _rises(cdf, by).groupBy(*keys).agg(F.count_if(F.col("_next") > F.col("cum_prob")).alias("bad_steps"))
    return sums.join(steps_, keys, "left").fillna(0, ["bad_steps"]).withColumn("is_valid", (F.col("bad_sums") == 0) & (F.col("bad_steps") == 0))


#: Directions of a distribution, and those with a cumulative.
DIRECTIONS, CUMULATIVE = ("range", "range_up", "range_dn"), ("range_up", "range_dn")


def _answer(direction: Column, allowed: tuple[str, ...], value: Column, strict: bool) -> tuple[Column, Column]:
    """(value, status): of a direction that can't be asked the value is null and the status bad_direction; ``strict`` stops the job there."""
    fine = F.coalesce(direction.isin(*allowed), F.lit(False))
    bad = F.raise_error(F.concat(F.lit("no such direction: "), F.coalesce(direction, F.lit("null")))).cast("double") if strict else F.lit(None).cast("double")
    return F.when(fine, value).otherwise(bad), F.when(fine, "ok").otherwise("bad_direction")


def query_pdf(asked: DataFrame, pmf_: DataFrame, keys: list[str], smoothed: bool, strict: bool = False) -> DataFrame:
    """Add prob and query_status to (keys, state, direction, ell): stored value, base probability up to 10 ticks past the maximum, else 0."""
    by = [*keys, *STATE, "direction"]
    meta = pmf_.groupBy(*by).agg(F.first("base_prob").alias("_base"), F.first("max_ell").alias("_max"))
    out = asked.join(meta, by, "left").join(pmf_.select(*by, "ell", F.col("prob").alias("_p")), [*by, "ell"], "left")
    near = F.when((F.col("ell") >= 0) & (F.col("ell") <= F.col("_max") + 10), F.col("_base")) if smoothed else F.lit(None).cast("double")
    prob, status = _answer(F.col("direction"), DIRECTIONS, F.coalesce("_p", near, F.lit(0.0)), strict)
    return out.withColumns({"prob": prob, "query_status": status}).drop("_base", "_max", "_p")


def query_cdf(asked: DataFrame, steps_: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Add cum_prob and query_status to (keys, state, direction, ell); 0 for unknown states and levels out of range. A row a distribution is joined, not one a level."""
    by = [*keys, *STATE, "direction"]
    cum, status = _answer(F.col("direction"), CUMULATIVE, cum_at(F.col("ell")), strict)
    out = asked.join(steps_.select(*by, "base_prob", "levels", "cums"), by, "left")
    return out.withColumns({"cum_prob": cum, "query_status": status}).drop("base_prob", "levels", "cums")


def top_levels(pmf_: DataFrame, cdf: DataFrame, keys: list[str], most: int = 10) -> DataFrame:
    """The first ``most`` stored levels of each fill distribution with prob and cum_prob."""
    by = [*keys, *STATE, "direction"]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("ell"))
    first = pmf_.filter("direction <> 'range'").withColumn("_k", rank).filter(F.col("_k") <= most)
    return first.select(*by, "ell", "prob").join(cdf, [*by, "ell"], "left")
