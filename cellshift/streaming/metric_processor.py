"""Metric state as a keyed stateful processor: fed batch by batch, stopped, resumed and read back.

A key's state is one row of pair moments and high-effect counts.  A micro-batch adds its
sums to it; the state lives in the checkpointed store, so a restarted stream goes on
where it stopped, a batch that failed half way is replayed on the state before it, and
the scores are read from the store itself rather than from an output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cellshift.session import scratch_path
from cellshift.streaming.running_metrics import state_scores

FIELDS = ("n", "sx", "sy", "sxx", "syy", "sxy", "n_high_true", "n_high_pred", "n_high_hit")
COUNTS = ("n", "n_high_true", "n_high_pred", "n_high_hit")
STATE = ", ".join(f"{name} {'bigint' if name in COUNTS else 'double'}" for name in FIELDS)
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VARIABLE = "moments"


def batch_sums(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple:
    """Moments and high-effect counts of the pairs that have both values; high effects count on their own."""
    high_x, high_y = np.abs(x) > threshold, np.abs(y) > threshold
    both = ~(np.isnan(x) | np.isnan(y))
    hit = high_x & high_y & (np.sign(x) == np.sign(y))
    a, b = x[both], y[both]
    return (int(both.sum()), float(a.sum()), float(b.sum()), float(a @ a), float(b @ b), float(a @ b), int((high_y & both).sum()), int((high_x & both).sum()), int((hit & both).sum()))


class MetricProcessor(StatefulProcessor):
    """Adds each micro-batch's sums of (prediction, truth) to the key's state and emits it."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.moments = handle.getValueState(VARIABLE, STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total = self.moments.get() if self.moments.exists() else (0,) * len(FIELDS)
        for frame in rows:
            part = batch_sums(frame["prediction"].to_numpy(float), frame["truth"].to_numpy(float), self.threshold)
            total = tuple(a + b for a, b in zip(total, part, strict=True))
        total = tuple(int(v) if name in COUNTS else float(v) for name, v in zip(FIELDS, total, strict=True))
        self.moments.update(total)
        yield pd.DataFrame({"key": [key[0]], **{name: [v] for name, v in zip(FIELDS, total, strict=True)}})

    def close(self) -> None:
        pass


def metric_stream(pairs: DataFrame, threshold: float) -> DataFrame:
    """Running state of a stream of (key, prediction, truth); one row per key that a batch touched."""
    return pairs.groupBy("key").transformWithStateInPandas(MetricProcessor(threshold), f"key string, {STATE}", outputMode="Update", timeMode="None")


def advance(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None] = lambda frame, batch: None) -> list[int]:
    """Run a stream over what has arrived since its checkpoint; returns the batches it ran."""
    spark = stream.sparkSession
    ran: list[int] = []

    def take(frame: DataFrame, batch: int) -> None:
        frame.write.format("noop").mode("overwrite").save()
        each(frame, batch)
        ran.append(batch)

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        running = stream.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        running.awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return ran


def stored_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, moments, counts) of every key as the state store holds them after the last batch."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", VARIABLE).load()
        return state.select("key.key", "value.*")
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def resumed_scores(pairs: DataFrame, threshold: float, parts: int = 4) -> DataFrame:
    """Scores per key of (id, key, prediction, truth), fed in ``parts`` arrivals by id digest.

    The first half arrives and is processed, the stream stops, the rest arrives and a new
    run resumes from the checkpoint, one file per micro-batch.
    """
    spark = pairs.sparkSession
    arrivals, checkpoint = scratch_path(spark, "arrivals"), scratch_path(spark, "metric-checkpoint")
    dealt = pairs.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(parts))).select("_part", F.col("key").cast("string").alias("key"), "prediction", "truth")
    stream = None
    for low, high in ((0, parts // 2), (parts // 2, parts)):
        for part in range(low, high):
            dealt.filter(F.col("_part") == part).drop("_part").coalesce(1).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema("key string, prediction double, truth double").option("maxFilesPerTrigger", 1).parquet(arrivals)
        advance(metric_stream(stream, threshold), checkpoint)
    return state_scores(stored_state(spark, checkpoint), "key")
