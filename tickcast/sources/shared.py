"""Tables written once into the folder that all executors share, so that later steps read them instead of repeating a plan."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset a local master gets a temporary folder; a cluster is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        # a running session doesn't take the setting itself
        if not spark.sparkContext.getCheckpointDir():
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: one execution, short lineage, safe against lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written_at = path
    if _open:
        _open[-1].append(back)
    return back


#: Tables written inside each open ``scratch``.
_open: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are deleted at the end, except those that are passed to the given function; these fall to a scratch around this one."""
    kept: list[DataFrame] = []
    _open.append([])
    try:
        yield lambda t: kept.append(t) or t
    finally:
        tables = _open.pop()
        discard(*(t for t in tables if not any(t is k for k in kept)))
        if _open:
            _open[-1].extend(kept)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made; only for those that no plan reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
