"""Readers and writers of bars, inventories, signals and placements."""

from __future__ import annotations

import csv
import re
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tickcast.sources.shared import written

OHLCV = ["open", "high", "low", "close", "volume"]
BAR_SCHEMA = "time timestamp_ntz, open double, high double, low double, close double, volume double"
SIGNAL_SCHEMA = (
    "day int, hour int, min int, price double, inventory int, date date, timestamp timestamp_ntz, minute timestamp_ntz, "
    "main_contract string, main_volume int, main_contract_clean string"
)


def checked_bars(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, time and OHLCV of ``df``; a missing column raises."""
    missing = [c for c in ["time", *OHLCV] if c not in df.columns]
    if missing:
        raise ValueError(f"bars lack {', '.join(missing)}")
    return df.select(*keys, "time", *(F.col(c).cast("double").alias(c) for c in OHLCV))


def decoded(path: Column) -> Column:
    """A file's path from its address."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def named_part(path: Column, key: str, otherwise: int) -> Column:
    """The value of a folder ``key=value``, as ``write_by`` names folders, or else the path's element at the negative place ``otherwise``."""
    folder = F.nullif(F.regexp_extract(path, f"/{key}=([^/]*)/", 1), F.lit(""))
    return F.coalesce(decoded(folder), F.element_at(F.split(path, "/"), otherwise))


def _placed(df: DataFrame) -> DataFrame:
    """Add market (folder) and filename of each row's file by its column ``path``."""
    return df.withColumn("path", decoded(F.col("path"))).withColumns({"market": named_part(F.col("path"), "market", -2), "filename": named_part(F.col("path"), "filename", -1)})


#: Bytes at a file's beginning that are read at once in search of its header.
HEAD_BYTES = 1 << 14

#: Columns of a row that was not taken: why, and its text where the reader has it.
REASON, RAW = "reason", "raw"


def first_lines(spark: SparkSession, root: str) -> DataFrame:
    """path (as Spark addresses it) and header, the first line that isn't blank, of every CSV file below ``root``; files are read up to that line alone.

    A file without such a line has an empty header, one without a byte no row; a file in a storage that pyarrow can't open has null, see ``first_lines_by_scan``.
    """
    block = HEAD_BYTES

    def head(address: str) -> str | None:
        try:
            fs, path = pafs.FileSystem.from_uri(quote(re.sub("^s3[an]:", "s3:", address), safe="/:@%!$&'()*+,;=~"))  # what Spark leaves plain
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError, ImportError):
            return None
        text = b""
        with fs.open_input_stream(path, compression=None) as f:
            while more := f.read(block):
                text = (text + more).lstrip()
                if re.search(rb"[\r\n]", text):
                    break
        return re.split(rb"[\r\n]", text, maxsplit=1)[0].decode("utf-8", "replace").lstrip("\ufeff")

    def heads(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([head(a) for a in batch.column(0).to_pylist()], pa.string())], ["path", "header"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root)
    return files.select(F.col("_metadata.file_path").alias("path")).mapInArrow(heads, "path string, header string")


def first_lines_by_scan(spark: SparkSession, root: str) -> DataFrame:
    """The rows of ``first_lines`` by a pass over all lines, for storages that only Spark can open."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(root)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = lines.select(F.col("_metadata.file_path").alias("path"), "value", F.when(~F.rlike("value", F.lit(r"^\s*$")), at).alias("at"))
    return lines.groupBy("path").agg(F.coalesce(F.ltrim(F.min_by("value", "at")), F.lit("")).alias("header"))


def _header_kinds(spark: SparkSession, root: str, required: list[str], only: Column | None) -> list[tuple[list[str], str, list[str], list[str]]]:
    """(paths, header, names in it, required names that are missing) for each kind of header among the CSV files below ``root``."""

    def by_header(first: DataFrame):
        first = _placed(first)
        first = first if only is None else first.filter(only)
        first = first.withColumn("path", F.regexp_replace("path", r"([\[\]{}*?\\])", r"\\$1"))  # Spark reads these signs as patterns
        return first.groupBy("header").agg(F.collect_list("path").alias("paths")).collect()  # a row for each kind of header, with file names alone

    found = by_header(first_lines(spark, root))
    if any(row["header"] is None for row in found):
        found = by_header(first_lines_by_scan(spark, root))
    kinds = []
    for row in found:
        names = [x.strip() for x in next(csv.reader([row["header"]]), [])]
        kinds.append((row["paths"], row["header"], names, [c for c in required if c not in names]))
    return kinds


def read_checked(spark: SparkSession, root: str, schema: str, required: list[str], only: Column | None = None, strict: bool = False) -> DataFrame:
    """All rows of the CSV files below ``root``, columns found by the names in each file's own header, plus market, filename, reason and raw.

    ``only`` is a condition on market and filename. Columns that a file lacks are null. ``reason`` is null for a good row; else missing_column (the
    file lacks one of ``required``), unparsable (a value is not of its column's type, or the row has other columns than the header) or
    missing_value (one of ``required`` is empty). With ``strict`` a file without a required column and an unparsable row stop the job,
    and empty values stay.
    """
    wanted = StructType.fromDDL(schema)
    parts = []
    for paths, header, names, missing in _header_kinds(spark, root, required, only):
        path = F.col("_metadata.file_path").alias("path")
        if missing and strict:
            raise ValueError(f"{min(paths)} lacks {', '.join(missing)}")
        if missing:
            text = spark.read.text(paths).select(F.col("value").alias(RAW), path)
            text = text.filter(~F.rlike(RAW, F.lit(r"^\s*$")) & (F.ltrim(F.translate(RAW, "\ufeff", "")) != F.lit(header)))
            parts.append(_placed(text.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in wanted), F.lit("missing_column").alias(REASON), RAW, "path")))
            continue
        first = [n if n in wanted.names and n not in names[:i] else f"_unused{i}" for i, n in enumerate(names)]
        own = StructType([wanted[n] if n in wanted.names else StructField(n, StringType()) for n in first] + [StructField(RAW, StringType())])
        read = spark.read.schema(own).option("header", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("columnNameOfCorruptRecord", RAW).csv(paths)
        columns = [F.col(f.name) if f.name in first else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted]
        reason = F.when(F.col(RAW).isNotNull(), "unparsable")
        for c in [] if strict else required:
            reason = reason.when(F.col(c).isNull(), "missing_value")
        parts.append(_placed(read.select(*columns, reason.alias(REASON), RAW, path)))
    if not parts:
        text = [StructField(c, StringType()) for c in ("market", "filename", REASON, RAW)]
        return spark.createDataFrame([], StructType([*wanted, *text]))
    return reduce(DataFrame.unionByName, parts).drop("path")


def read_named(spark: SparkSession, root: str, schema: str, required: list[str], only: Column | None = None) -> DataFrame:
    """The rows of ``read_checked`` where every file and value must be readable; anything else stops the job."""
    return read_checked(spark, root, schema, required, only, strict=True).drop(REASON, RAW)


def _inventory(filename: str = "filename") -> Column:
    return F.contains(F.col(filename), F.lit("AI"))


def read_bars(spark: SparkSession, root: str) -> DataFrame:
    """All contract files below ``root`` (folder = market, file = contract, inventories left out) as one table; unreadable values stop the job."""
    raw = read_named(spark, root, BAR_SCHEMA, ["time", *OHLCV], ~_inventory())
    return checked_bars(raw.withColumnRenamed("filename", "contract"), ["market", "contract"])


def sorted_bars(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(bars, rejects) of all contract files below ``root``: every row is in one of them.

    Rejects hold market, contract, reason, time, open to volume as far as they could be read, and raw. Besides the reasons of ``read_checked``
    there is repeated_time: of rows of one contract and time the first by its prices and volume stays. Rows are read, sorted out and written once.
    """
    rows = read_checked(spark, root, BAR_SCHEMA, ["time", *OHLCV], ~_inventory()).withColumnRenamed("filename", "contract")
    same = Window.partitionBy("market", "contract", "time", F.col(REASON).isNull()).orderBy(*OHLCV)
    again = F.col(REASON).isNull() & (F.row_number().over(same) > 1)
    rows = written(rows.withColumn(REASON, F.when(again, "repeated_time").otherwise(F.col(REASON))), "sorted-bars")
    columns = ["time", *OHLCV]
    return rows.filter(F.col(REASON).isNull()).select("market", "contract", *columns), rows.filter(F.col(REASON).isNotNull()).select("market", "contract", REASON, *columns, RAW)


def file_status(spark: SparkSession, root: str, bars: DataFrame, rejects: DataFrame) -> DataFrame:
    """market, contract, n_rows, n_bars, n_rejects, status of every contract file: ok, missing_column, no_rows, or some_rejected."""
    by = ["market", "contract"]
    named = discover_files(spark, root).filter(~_inventory()).select("market", F.col("filename").alias("contract"))
    one = bars.groupBy(*by).agg(F.count("*").alias("n_bars"))
    two = rejects.groupBy(*by).agg(F.count("*").alias("n_rejects"), F.count_if(F.col(REASON) == "missing_column").alias("_columns"))
    out = named.distinct().join(one, by, "left").join(two, by, "left").fillna(0, ["n_bars", "n_rejects", "_columns"])
    status = F.when(F.col("_columns") > 0, "missing_column").when(F.col("n_bars") + F.col("n_rejects") == 0, "no_rows").when(F.col("n_rejects") > 0, "some_rejected").otherwise("ok")
    return out.select(*by, (F.col("n_bars") + F.col("n_rejects")).alias("n_rows"), "n_bars", "n_rejects", status.alias("status"))


def discover_files(spark: SparkSession, root: str) -> DataFrame:
    """market, filename, path of the contract files below ``root``; only names are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root).select(F.col("_metadata.file_path").alias("path"))
    return _placed(files).filter(~F.startswith("filename", F.lit("AIAgent_"))).select("market", "filename", "path")


def read_inventories(spark: SparkSession, root: str, schema: str = SIGNAL_SCHEMA) -> DataFrame:
    """Files whose name holds AI, in all market folders, with market and filename."""
    return read_named(spark, root, schema, ["timestamp", "inventory"], _inventory())


def read_signals(spark: SparkSession, folder: str) -> DataFrame:
    """All signal files of a folder as one table, with filename."""
    return read_named(spark, folder, SIGNAL_SCHEMA + ", signal double", ["timestamp", "main_contract_clean", "signal"]).drop("market")


#: Rows of a written file; a folder with more has several, in order.
FILE_ROWS = 1 << 20

#: Times in written text, to the microsecond as tables hold them; by default Spark cuts them to milliseconds.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_by(df: DataFrame, path: str, by: str | list[str], fmt: str = "parquet", order: list[str] | None = None, rows: int = FILE_ROWS) -> None:
    """A folder per value of ``by``; the readers above find market and filename in the folders' names.

    Only folders that ``df`` has rows for are replaced, so another market's output stays and a repeated run gives the same. Rows are dealt
    by ranges of ``by`` and ``order``, so a folder with very many rows is written by several tasks, and its files are in order by their names.
    Times keep their microseconds in every format.
    """
    by = [by] if isinstance(by, str) else by
    keys = [*by, *(order or [])]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    out = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows)
    out = out.option("timestampNTZFormat", TIME_FORMAT).option("timestampFormat", TIME_FORMAT + "XXX")
    out.format(fmt).partitionBy(*by).option("header", True).save(path)
