"""A store of fitted models: versions side by side, one of them published.

A version is a folder of tables, each partitioned by symbol; a manifest that names its tables and their schemas is published last, by a rename. Until
then readers see the version before, and what they have listed is never overwritten.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickcast.functions import instruments as I  # noqa: E741

#: Tables of a model and the columns that each must have besides the keys.
MODEL_TABLES = {
    "models": ["n_bars", "j_s", "status"],
    "states": ["bar_seq", "m", "n", "k"],
    "pmf": ["m", "n", "k", "direction", "ell", "prob", "base_prob", "max_ell", "n_total"],
    "steps": ["m", "n", "k", "direction", "base_prob", "levels", "cums"],
    "cdf": ["m", "n", "k", "direction", "ell", "cum_prob"],
    "bounds": ["volume_bounds", "volatility_bounds", "price_change_bounds", "status"],
}
SYMBOL = "symbol"


def symbol_of(contract: str) -> Column:
    """The symbol in a contract's name, or the whole name where it holds none."""
    return F.coalesce(I.contract_parts(F.col(contract))[0], F.col(contract))


def _storage(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, oldest first."""
    fs, at = _storage(spark, path)
    folder = at(f"{path}/manifests")
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))


def _checked(tables: dict[str, list[str]], keys: list[str]) -> None:
    for name, needed in MODEL_TABLES.items():
        if name not in tables:
            raise ValueError(f"Model is not fitted: no {name}")
        missing = [c for c in (*keys, *needed) if c not in tables[name]]
        if missing:
            raise ValueError(f"Not a model of this library: {name} lacks {', '.join(missing)}")


def save_model(model: dict[str, DataFrame], path: str, keys: list[str]) -> int:
    """Write a fitted model's tables as a new version and publish it; an incomplete model is refused. Returns the version.

    Two writers at once get versions of their own; the later rename wins as the latest.
    """
    _checked({t: df.columns for t, df in model.items()}, keys)
    spark = model["pmf"].sparkSession
    folder = f"snapshots/{uuid.uuid4().hex}"
    for t in MODEL_TABLES:
        df = model[t].withColumn(SYMBOL, symbol_of(keys[0]))
        df.repartition(SYMBOL).write.partitionBy(SYMBOL).parquet(f"{path}/{folder}/{t}")
    return _publish(spark, path, {"folder": folder, "keys": keys, "schemas": {t: model[t].schema.jsonValue() for t in MODEL_TABLES}})


def _publish(spark: SparkSession, path: str, manifest: dict) -> int:
    fs, at = _storage(spark, path)
    draft = at(f"{path}/manifests/draft-{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    version = max(versions(spark, path), default=0) + 1
    while fs.exists(at(f"{path}/manifests/v{version:08d}.json")) or not fs.rename(draft, at(f"{path}/manifests/v{version:08d}.json")):
        version += 1
    return version


def manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict]:
    """The latest version (or the one asked for) and its manifest."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"No model{'' if version is None else f' of version {version}'} at {path}")
    version = known[-1] if version is None else version
    return version, json.loads(spark.read.option("wholetext", True).text(f"{path}/manifests/v{version:08d}.json").first()[0])


def load_model(spark: SparkSession, path: str, symbols: list[str] | DataFrame | None = None, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of the latest (or the given) version; anything else at the path raises.

    ``symbols`` is a list, or a table with a column symbol; folders of other symbols are not read (for a table Spark prunes them as the query runs).
    """
    _, found = manifest(spark, path, version)
    schemas = {t: StructType.fromJson(s) for t, s in found["schemas"].items()}
    _checked({t: s.names for t, s in schemas.items()}, found["keys"])
    model = {}
    for t, schema in schemas.items():
        df = spark.read.schema(StructType(schema.fields).add(SYMBOL, "string")).parquet(f"{path}/{found['folder']}/{t}")
        if isinstance(symbols, DataFrame):
            df = df.join(symbols.select(SYMBOL).distinct(), SYMBOL, "left_semi")
        elif symbols is not None:
            df = df.filter(F.col(SYMBOL).isin(*symbols))
        model[t] = df.select(*schema.names)
    return model


def retire(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Delete all versions but the last ``keep``; only for versions that nothing reads any more. Returns those deleted."""
    old = versions(spark, path)[: -keep if keep else None]
    fs, at = _storage(spark, path)
    for v in old:
        folder = manifest(spark, path, v)[1]["folder"]
        fs.delete(at(f"{path}/manifests/v{v:08d}.json"), False)
        fs.delete(at(f"{path}/{folder}"), True)
    return old
