"""Bars, signals and names derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """15-minute bars of events: contract is the event type, prices are values, volume is the count."""
    e = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    order = F.struct("ts", "event_id")
    return (
        e.groupBy(F.col("event_type").alias("contract"), F.window("ts", "15 minutes").alias("w"))
        .agg(
            F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
            F.max_by("value", order).alias("close"), F.count("*").cast("double").alias("volume"),
        )
        .select("contract", F.col("w.start").alias("time"), "open", "high", "low", "close", "volume")
    )


def event_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """market, contract, timestamp, event_id, inventory: whole values of events as an inventory in time order."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("market"), F.col("event_type").alias("contract"), F.col("ts").alias("timestamp"), "event_id", F.floor("value").cast("int").alias("inventory")
    )


def contract_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order key and a contract file path made of order columns; some match no contract."""
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    key = F.col("o_orderkey")
    symbols = ["ES", "NQ", "CL", "HO", "VG", "S", "6E", "XX", "es", "BP", "JY", "GC", "foo", "RX"]
    months = ["F", "H", "M", "U", "Z", "A"]
    path = F.concat(F.lit("data/m/"), pick(symbols, key), pick(months, F.floor(key / 7)), F.lpad((key % 100).cast("string"), 2, "0"), F.lit(".csv"))
    return table(spark, sf_dir, "orders").select("o_orderkey", pick(symbols, key).alias("name"), path.alias("path"))


#: Symbols that event types trade as, by the length of their names.
EVENT_SYMBOLS = ["ES", "VG", "XX"]


def event_symbol(contract):
    return F.element_at(F.array(*map(F.lit, EVENT_SYMBOLS)), F.length(contract) % len(EVENT_SYMBOLS) + 1)


#: Symbols and months of the contract files that event types are written to.
FILE_SYMBOLS, FILE_MONTHS = ["GC", "NQ", "VG"], "FGHJKMN"


def event_contract(contract):
    """The name of a contract file for an event type, of a routed symbol; each type has its own."""
    h = (2 * F.length(contract) + F.ascii(contract)) % 7
    return F.concat(F.element_at(F.array(*map(F.lit, FILE_SYMBOLS)), h % 3 + 1), F.substr(F.lit(FILE_MONTHS), h + 1, F.lit(1)), F.lit("24.csv"))
