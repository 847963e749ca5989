"""Instrument reference data: tick sizes, symbols in file names, month codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tick size of each symbol.
TICK_SIZES = {
    "ES": 0.25, "NQ": 0.25, "CL": 0.01, "HO": 0.01, "GC": 0.10, "SI": 0.005, "HG": 0.0005, "TY": 0.015625, "RX": 0.01,
    "S": 0.25, "ZS": 0.25, "EC": 0.0001, "6E": 0.0001, "BP": 0.01, "JY": 0.005, "VG": 0.50,
}
#: Futures month codes in month order.
MONTH_CODES = "FGHJKMNQUVXZ"
#: Folder of each routed symbol.
MARKETS = {
    "VG": "EuroStoxx", "BP": "GBP - British Pound", "RX": "German Bunds - German Government Bonds", "GC": "Gold",
    "HO": "HeatingOil", "JY": "JPY - Japanese Yen", "NQ": "Nasdaq",
}
CONTRACT = rf"([A-Z]{{1,2}})([{MONTH_CODES}])(\d{{2}})"


def tick_table(spark: SparkSession, overrides: DataFrame | None = None) -> DataFrame:
    """(symbol, tick_size): the fixed table; rows of ``overrides`` replace or extend it.

    Of several overrides of a symbol the one with the greatest ``registered_at`` counts, without that column the greatest tick size.
    """
    base = spark.createDataFrame(list(TICK_SIZES.items()), "symbol string, tick_size double")
    if overrides is None:
        return base
    tick = F.col("tick_size").cast("double")
    latest = F.max_by(tick, "registered_at") if "registered_at" in overrides.columns else F.max(tick)
    own = overrides.groupBy(F.upper("symbol").alias("symbol")).agg(latest.alias("tick_size"))
    return base.join(own, "symbol", "left_anti").unionByName(own)


def with_tick_size(df: DataFrame, symbol: str = "symbol", overrides: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Add tick_size by the upper-case symbol; unknown symbols get null, or stop the job when ``strict``."""
    ticks = tick_table(df.sparkSession, overrides).withColumnRenamed("symbol", "_symbol")
    ticks = F.broadcast(ticks) if overrides is None else ticks  # the fixed table alone has a known size
    out = df.join(ticks, F.upper(F.col(symbol)) == F.col("_symbol"), "left").drop("_symbol")
    if strict:
        out = out.withColumn("tick_size", F.coalesce("tick_size", F.raise_error(F.concat(F.lit("unknown symbol "), F.coalesce(F.col(symbol), F.lit("null")))).cast("double")))
    return out


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def contract_parts(path: Column) -> list[Column]:
    """symbol, month_code, month, year and contract_code of a contract's file name; nulls where the name holds none."""
    part = lambda k: F.nullif(F.regexp_extract(base_name(path), CONTRACT, k), F.lit(""))
    months = F.create_map(*[F.lit(x) for k, c in enumerate(MONTH_CODES) for x in (c, k + 1)])
    return [
        part(1).alias("symbol"), part(2).alias("month_code"), F.try_element_at(months, part(2)).cast("int").alias("month"),
        part(3).cast("int").alias("year"), F.concat(part(1), part(2), part(3)).alias("contract_code"),
    ]


def parse_symbol(df: DataFrame, path: str) -> DataFrame:
    """Add symbol, tick_size and parse_status (ok, no_match, unknown_symbol)."""
    out = with_tick_size(df.withColumn("symbol", contract_parts(F.col(path))[0]))
    status = F.when(F.col("symbol").isNull(), "no_match").when(F.col("tick_size").isNull(), "unknown_symbol").otherwise("ok")
    return out.withColumn("parse_status", status)


def contract_details(df: DataFrame, path: str) -> DataFrame:
    """Add symbol, month_code, month, year, contract_code and tick_size."""
    return with_tick_size(df.select("*", *contract_parts(F.col(path))))


def route_signal(df: DataFrame, contract: str) -> DataFrame:
    """Add route_symbol (the first two characters) and its market folder, null where there is none."""
    markets = df.sparkSession.createDataFrame(list(MARKETS.items()), "route_symbol string, market string")
    return df.withColumn("route_symbol", F.substring(contract, 1, 2)).join(F.broadcast(markets), "route_symbol", "left")
