"""Streaming scores: readings arrive and get a state, its sample count and a fill probability from a stored model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickcast.operators import model as M
from tickcast.operators import states
from tickcast.sources import store


def score(readings: DataFrame, bounds: DataFrame, stats: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """Stateless stream-static joins; ``readings`` holds keys, direction, ell and the three smoothed values. Append mode.

    Adds the state, all its statistics (state_exists, sample_count, largest range of each direction) and the fill probability.
    """
    by = [*keys, "m", "n", "k"]
    out = states.live_states(readings, bounds, keys, ("volume", "volatility", "price_change"))
    out = out.join(stats.select(*by, "sample_count", "max_range", "max_range_up", "max_range_dn"), by, "left")
    out = M.query_cdf(out, steps, keys)
    return out.withColumns({"state_exists": F.col("sample_count").isNotNull(), "sample_count": F.coalesce("sample_count", F.lit(0))})


def score_batch(batch: DataFrame, model_path: str, keys: list[str]) -> DataFrame:
    """A batch of readings scored with the model that is published now, with its model_version."""
    version, _ = store.manifest(batch.sparkSession, model_path)
    model = store.load_model(batch.sparkSession, model_path, version=version)
    return score(batch, model["bounds"], M.statistics(model["pmf"], keys), model["steps"], keys).withColumn("model_version", F.lit(version))


def start_scoring(readings: DataFrame, model_path: str, out: str, checkpoint: str, keys: list[str], **trigger) -> StreamingQuery:
    """Score a stream of readings, with a model that may be published anew meanwhile: each batch takes the version of its start.

    A batch's rows go to a folder of its own, which a restart writes again as a whole; so no row comes twice and none is lost.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        score_batch(batch, model_path, keys).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = readings.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (stream.trigger(**trigger) if trigger else stream).start()
