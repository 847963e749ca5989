"""Jobs from folders of files to folders of files: signals, tick sizes, placements of all markets at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickcast.functions import instruments as I  # noqa: E741
from tickcast.jobs import backtest, training
from tickcast.operators import signals
from tickcast.sources import files


def signals_of_inventories(spark: SparkSession, root: str, order: tuple[str, ...] = ("timestamp",), schema: str = files.SIGNAL_SCHEMA) -> DataFrame:
    """Signals of every inventory file below ``root``, with market and filename; changes never cross files. ``order`` begins with the time."""
    return signals.inventory_signals(files.read_inventories(spark, root, schema), ["market", "filename"], list(order))


def write_signals(spark: SparkSession, root: str, out: str, order: tuple[str, ...] = ("timestamp",), schema: str = files.SIGNAL_SCHEMA) -> None:
    """A folder of signals for every inventory file, rows in order; folders of other files stay."""
    files.write_by(signals_of_inventories(spark, root, order, schema), out, ["market", "filename"], "csv", list(order))


def tick_sizes(spark: SparkSession, root: str) -> DataFrame:
    """market, tick_size: the least price step in any contract file of each market."""
    return signals.inferred_ticks(files.read_bars(spark, root), ["market"], ["market", "contract"])


def placements(spark: SparkSession, signal_folder: str, root: str, p: training.Params = training.Params(), risk: float = 0.6) -> DataFrame:
    """All signals of a folder with their limit prices from the contract files below ``root``; ticks by the symbol that routes a signal.

    A signal's contract is the file ``main_contract_clean`` in the market folder of its first two characters.
    """
    asked = I.with_tick_size(I.route_signal(files.read_signals(spark, signal_folder), "main_contract_clean"), "route_symbol")
    bars = files.read_bars(spark, root)
    bars = bars.withColumn("contract", F.concat_ws("/", "market", "contract")).drop("market")
    asked = asked.withColumn("contract", F.concat_ws("/", "market", "main_contract_clean"))
    ticks = asked.filter("tick_size is not null").select("contract", "tick_size").distinct()
    return backtest.place(bars, asked.drop("tick_size", "route_symbol"), p.with_ticks(ticks), risk)


def write_placements(spark: SparkSession, signal_folder: str, root: str, out: str, p: training.Params = training.Params(), risk: float = 0.6) -> None:
    """A folder of placements for every signal file, rows by time; folders of other files stay."""
    files.write_by(placements(spark, signal_folder, root, p, risk), out, "filename", "csv", ["timestamp"])
