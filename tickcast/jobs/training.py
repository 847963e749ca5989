"""Training for many series and cutoffs at once, and reports on the models."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickcast.operators import bars as B
from tickcast.operators import model as M
from tickcast.operators import scan, states
from tickcast.sources.shared import scratch, written


@dataclass(frozen=True)
class Params:
    tau: int = 5
    sizes: tuple[int, int, int] = (3, 3, 2)
    halflife: float = 10
    method: str = "smoothed"
    alpha: float = 0.5
    min_completeness: float = 0.9
    #: One tick size for all series, or a column over the series' keys and prices.
    tick: float | Column = 1.0
    #: Tick sizes by contract (contract, tick_size); series without one have no bars. They come before ``tick``.
    ticks: DataFrame | None = None
    #: Digits that features and boundaries are rounded to before binning; None keeps them as they are.
    digits: int | None = None

    def with_ticks(self, ticks: DataFrame) -> Params:
        return replace(self, ticks=ticks)

    def ticked(self, df: DataFrame) -> tuple[DataFrame, Column]:
        """``df`` and each row's tick size; the column ``_tick`` is joined by contract where ticks differ."""
        if self.ticks is not None:
            one = self.ticks.groupBy("contract").agg(F.max("tick_size").alias("_tick"))
            return df.join(one, "contract", "left"), F.col("_tick")
        return df, F.lit(self.tick) if isinstance(self.tick, (int, float)) else self.tick


def in_ticks(bars: DataFrame, p: Params) -> DataFrame:
    """Tau bars with their ranges."""
    df, tick = p.ticked(bars)
    return B.tick_ranges(df.filter(tick.isNotNull()), tick).drop("_tick")


def ranged(bars: DataFrame, keys: list[str], p: Params) -> DataFrame:
    """Cleaned tau bars with ranges and positions."""
    return in_ticks(B.tau_bars(bars, keys, p.tau, p.min_completeness), p)


def featured(rows: DataFrame, keys: list[str], p: Params) -> DataFrame:
    """Tau bars of ``ranged`` with the features of their states; each looks at earlier bars only."""
    return states.rounded(scan.features(written(rows, "ranged"), keys, p.halflife), p.digits)


def binned(feats: DataFrame, keys: list[str], p: Params, keep=lambda t: t) -> tuple[DataFrame, DataFrame]:
    """(rows with states, boundaries with status) of a written table of features; ``keep`` is told the table of boundaries."""
    bounds = written(states.boundaries(feats, keys, states.burn_in(feats, keys, p.halflife, p.sizes), p.sizes, p.digits), "bounds")
    return states.assign(feats, keys, keep(bounds)), bounds


def classified(bars: DataFrame, keys: list[str], p: Params) -> tuple[DataFrame, DataFrame]:
    """(rows with states, boundaries with status)."""
    with scratch() as keep:
        return binned(keep(written(featured(ranged(bars, keys, p), keys, p), "features")), keys, p, keep)


def modelled(rows: DataFrame, bounds: DataFrame, keys: list[str], p: Params, freq: DataFrame | None = None) -> dict[str, DataFrame]:
    """Model tables of classified rows, counted here unless ``freq`` is given. ``steps`` are the cumulatives as step functions, ``cdf`` the same with every level, made on demand."""
    pmf = written(M.pmf(M.frequencies(rows, keys) if freq is None else freq, keys, p.method, p.alpha), "pmf")
    models = bounds.select(*keys, "n_bars", "j_s", "status").join(states.histogram(rows, keys, p.sizes), keys, "left")
    return {"bounds": bounds, "states": rows, "pmf": pmf, "steps": M.steps(pmf, keys), "cdf": M.reverse_cdf(pmf, keys), "models": models}


def fit(bars: DataFrame, keys: list[str], p: Params = Params()) -> dict[str, DataFrame]:
    """Each stage that others read is a written table. Model tables: bounds, states (rows), pmf, steps, cdf, models (one row a model with its status and counts)."""
    return modelled(*classified(bars, keys, p), keys, p)


def answer_as_of(bars: DataFrame, keys: list[str], cutoff: str, p: Params, most: int = 10) -> DataFrame:
    """keys, m, n, k, sample_count, direction, ell, cum_prob: what a model of the bars up to ``cutoff`` says about the market at that time.

    The state comes from the live averages of the last bar up to the cutoff; levels go from 0 to ``most`` - 1. Series whose boundaries tie have no answer.
    """
    known = B.until_cutoff(bars, cutoff)
    m = fit(known, keys, p)
    live = ("volume_ewma", "volatility_ewma", "ewma_delta_x")
    now = scan.live_features(known, keys, p.halflife).groupBy(*keys).agg(F.max_by(F.struct(*live), "time").alias("_x")).select(*keys, "_x.*")
    now = now if p.digits is None else now.withColumns({c: F.round(c, p.digits) for c in live})
    now = states.live_states(now, m["bounds"].filter("status = 'ok'"), keys, live).drop(*live)
    now = now.join(M.statistics(m["pmf"], keys).select(*keys, *M.STATE, "sample_count"), [*keys, *M.STATE], "left").fillna(0, ["sample_count"])
    asked = now.withColumn("direction", F.explode(F.array(*map(F.lit, M.CUMULATIVE)))).withColumn("ell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))))
    return M.query_cdf(asked, m["steps"], keys).drop("query_status")


def report(bars: DataFrame, keys: list[str], p: Params) -> DataFrame:
    """keys, n_rows, n_bars, j_s, states_observed, states_possible, is_valid, probe_ok, status: one row a series, errors as a status."""
    model = fit(bars, keys, p)
    rows = bars.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    valid = M.validate(model["pmf"], model["cdf"], keys)
    probes = model["cdf"].filter("ell <= 9").groupBy(*keys).agg(F.min((F.col("cum_prob") >= 0) & (F.col("cum_prob") <= 1 + 1e-9)).alias("probe_ok"))
    out = rows.join(model["models"], keys, "left").join(valid.select(*keys, "is_valid"), keys, "left").join(probes, keys, "left")
    status = F.when(F.col("n_bars").isNull(), "no_bars").otherwise(F.col("status"))
    return out.select(*keys, "n_rows", F.coalesce("n_bars", F.lit(0)).alias("n_bars"), "j_s", "states_observed", "states_possible", "is_valid", "probe_ok", status.alias("status"))
