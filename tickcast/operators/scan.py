"""Exponentially weighted averages as a blocked scan in Spark expressions.

S[j] = lam * S[j-1] + x[j] along a series. Inside a block of rows the sum has a closed form over a window; per block only its last
value travels, and a block's carry needs the last few blocks alone, since lam ** block is 2 ** -25.6. So a long series is many
(key, block) windows plus a small table of blocks, instead of one sequential pass. The row before a block is in it as row -1, so that
differences need no join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickcast.operators import days

#: Binary digits that a carry still holds, far below double precision, and most blocks back for that in one pass.
DIGITS, MOST_BACK = 153.6, 24


def block_size(lam: float) -> int:
    """Rows after which a weight falls to 2 ** -25.6."""
    return max(2, math.ceil(25.6 / -math.log2(lam)))


def blocks_back(lam: float, size: int) -> int:
    """Blocks of ``size`` rows whose weight a carry still holds."""
    return max(1, math.ceil(DIGITS / (-math.log2(lam) * size)))


def affine_scan(
    df: DataFrame, keys: list[str], terms: dict[str, Column], lam: float | dict[str, float], seq: str = "bar_seq", shift: bool = False, before: dict[str, str] | None = None
) -> DataFrame:
    """Add, for each name in ``terms``, S of that column, with ``shift`` S of the row before; nulls count as 0. ``seq`` counts from 0.

    ``lam`` is one rate or a rate for each name; all go in one pass while their rates allow blocks of one size. ``before`` adds columns of the
    row before, {new name: source}, null in the first row; terms can use them.
    """
    rates = {n: lam[n] if isinstance(lam, dict) else lam for n in terms}
    size = min(block_size(r) for r in rates.values())
    late = [n for n in terms if blocks_back(rates[n], size) > MOST_BACK]
    now = {n: c for n, c in terms.items() if n not in late}
    block = F.floor(F.col(seq) / size)
    if before:
        block = F.explode(F.when(F.col(seq) % size == size - 1, F.array(block, block + 1)).otherwise(F.array(block)))
    x = df.withColumn("_block", block).withColumn("_p", F.col(seq) - F.col("_block") * size)
    in_order = Window.partitionBy(*keys, "_block").orderBy("_p")
    if before:
        x = x.withColumns({new: F.lag(old).over(in_order) for new, old in before.items()})
    own = F.col("_p") >= 0
    x = x.withColumns({f"_x_{n}": F.when(own, F.coalesce(c.cast("double"), F.lit(0.0))).otherwise(F.lit(0.0)) for n, c in now.items()})
    back = 1 if shift else 0
    inside = in_order.rowsBetween(Window.unboundedPreceding, -back)
    part = lambda n: F.sum(F.col(f"_x_{n}") * F.pow(F.lit(rates[n]), -F.col("_p")))
    tails = x.groupBy(*keys, "_block").agg(*((part(n) * F.pow(F.lit(rates[n]), F.max("_p"))).alias(f"_t_{n}") for n in now))
    order = Window.partitionBy(*keys).orderBy("_block")
    lags = lambda n: (F.coalesce(F.lag(f"_t_{n}", k).over(order), F.lit(0.0)) * rates[n] ** (size * (k - 1)) for k in range(1, blocks_back(rates[n], size) + 1))
    carries = tails.select(*keys, "_block", *(sum(lags(n), F.lit(0.0)).alias(f"_c_{n}") for n in now))
    x = x.withColumns({f"_s_{n}": F.pow(F.lit(rates[n]), F.col("_p") - back) * F.coalesce(part(n).over(inside), F.lit(0.0)) for n in now})
    out = (x.filter(own) if before else x).join(carries, [*keys, "_block"])
    out = out.withColumns({n: F.col(f"_s_{n}") + F.col(f"_c_{n}") * F.pow(F.lit(rates[n]), F.col("_p") + 1 - back) for n in now})
    out = out.drop("_block", "_p", *(f"_{a}_{n}" for n in now for a in "xsc"))
    return affine_scan(out, keys, {n: terms[n] for n in late}, {n: rates[n] for n in late}, seq, shift) if late else out


def previous(df: DataFrame, keys: list[str], columns: dict[str, str], seq: str = "bar_seq", size: int = 4096) -> DataFrame:
    """Add the values of the row before, {new name: source}, by blocks of rows that begin with the row before them; ``seq`` counts from 0."""
    block = F.floor(F.col(seq) / size)
    b = df.withColumn("_block", F.explode(F.when(F.col(seq) % size == size - 1, F.array(block, block + 1)).otherwise(F.array(block))))
    inside = Window.partitionBy(*keys, "_block").orderBy(seq)
    b = b.withColumns({new: F.lag(old).over(inside) for new, old in columns.items()})
    return b.filter(F.col(seq) >= F.col("_block") * size).drop("_block")


def _weight(lam: float, seq: str) -> Column:
    return (1 - F.pow(F.lit(lam), F.col(seq))) / (1 - lam)


def _means(df: DataFrame, names: list[str], lam: float, seq: str) -> DataFrame:
    return df.withColumns({n: F.when(F.col(seq) == 0, 0.0).otherwise(F.col(n) / _weight(lam, seq)) for n in names})


def shifted_means(df: DataFrame, keys: list[str], halflife: float, columns: dict[str, str], seq: str = "bar_seq") -> DataFrame:
    """Add weighted means that look only at earlier rows: {source: new name}; row 0 is 0."""
    lam = 2.0 ** (-1.0 / halflife)
    out = affine_scan(df, keys, {new: F.col(old) for old, new in columns.items()}, lam, seq, shift=True)
    return _means(out, list(columns.values()), lam, seq)


def shifted_std(df: DataFrame, keys: list[str], halflife: float, column: str, mean: str, name: str, seq: str = "bar_seq") -> DataFrame:
    """Add the matching deviation around the current mean; rows 0 and 1 are 0."""
    lam = 2.0 ** (-1.0 / halflife)
    term = F.when(F.col(seq) > 0, F.pow(F.col("_before") - F.col(mean), F.lit(2)))
    out = affine_scan(df, keys, {name: term}, lam, seq, before={"_before": column}).drop("_before")
    return out.withColumn(name, F.when(F.col(seq) == 0, 0.0).otherwise(F.sqrt(F.greatest(F.col(name) / _weight(lam, seq), F.lit(0.0)))))


def features(ranged: DataFrame, keys: list[str], halflife: float = 10) -> DataFrame:
    """Add bar_seq's delta_x and the means v_ewma, sigma_ewma, delta_x_ewma of volume, range and price change, in one pass."""
    lam, change = 2.0 ** (-1.0 / halflife), F.coalesce(F.col("open") - F.col("_open"), F.lit(0.0))
    terms = {"v_ewma": F.col("volume"), "sigma_ewma": F.col("r"), "delta_x_ewma": change}
    df = affine_scan(ranged, keys, terms, lam, shift=True, before={"_open": "open"})
    return _means(df.withColumn("delta_x", change).drop("_open"), list(terms), lam, "bar_seq")


def recursive_terms(columns: dict[str, tuple[Column, float, int]], seq: str = "bar_seq") -> tuple[dict[str, Column], dict[str, float]]:
    """Terms and rates of y[first] = x[first], y = (1 - alpha) * y + alpha * x (current row included), from {name: (x, alpha, first)}."""
    terms = {n: F.when(F.col(seq) > first, x * alpha).when(F.col(seq) == first, x) for n, (x, alpha, first) in columns.items()}
    return terms, {n: 1 - alpha for n, (_, alpha, _) in columns.items()}


def live_features(bars: DataFrame, keys: list[str], halflife: float = 10, span: int = 20) -> DataFrame:
    """Add volume_ewma, volatility_ewma and ewma_delta_x of the bars as they come, all bars of a series, in one pass; null where there is no earlier bar."""
    df = days.positions(bars, keys, "bar_seq")
    a, prev = 1 - 2.0 ** (-1.0 / halflife), F.col("_prev")
    ret = F.col("close") / F.nullif(prev, F.lit(0.0)) - 1
    columns = {"volume_ewma": (F.col("volume"), a, 0), "volatility_ewma": (ret * ret, a, 1), "ewma_delta_x": (F.col("close") - prev, 2.0 / (span + 1), 1)}
    df = affine_scan(df, keys, *recursive_terms(columns), before={"_prev": "close"}).drop("_prev")
    later = lambda c: F.when(F.col("bar_seq") >= 1, c)
    return df.withColumns({"volatility_ewma": later(F.sqrt("volatility_ewma")), "ewma_delta_x": later(F.col("ewma_delta_x"))})
