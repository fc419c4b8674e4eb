"""Metric state over a stream of scored pairs.

The state of a key is the six pair moments and the high-effect counts, so it has
constant size; scores are read from it at any time.  Keys live for the whole
stream, hence no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellshift.functions.moments import high_effect_counts, moment_aggs, pearson_from_moments
from cellshift.functions.numbers import r6
from cellshift.session import scratch_path


def metric_state(pairs: DataFrame, key: str, prediction: str, truth: str, threshold: float = 1.0) -> DataFrame:
    """Aggregate that works the same on a batch and on a stream."""
    return pairs.groupBy(key).agg(*moment_aggs(prediction, truth), *high_effect_counts(prediction, truth, threshold))


def state_scores(state: DataFrame, key: str) -> DataFrame:
    """Scores read from the state."""
    return state.select(key, "n", pearson_from_moments(std_floor=1e-8).alias("pcc"), "n_high_true", "n_high_pred", "n_high_hit")


def run_to_completion(stream_state: DataFrame, label: str, output_mode: str = "complete") -> str:
    """Drive a stream over all available files; every batch overwrites its own folder.

    Rewriting ``batch=<id>`` makes a retried batch harmless.  Returns the folder.
    """
    spark = stream_state.sparkSession
    target = scratch_path(spark, label)

    def save(frame: DataFrame, batch_id: int) -> None:
        frame.write.mode("overwrite").parquet(f"{target}/batch={batch_id:08d}")

    running = (
        stream_state.writeStream.outputMode(output_mode)
        .foreachBatch(save)
        .option("checkpointLocation", scratch_path(spark, f"{label}-progress"))
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return target


def latest_state(spark: SparkSession, folder: str) -> DataFrame:
    """State after the last batch (complete output keeps every key in each batch)."""
    batches = spark.read.parquet(folder)
    last = batches.agg(F.max("batch")).scalar()
    return batches.filter(F.col("batch") == last).drop("batch")


def running_scores(spark: SparkSession, events_path: str, threshold: float = 1.0, files_per_batch: int = 1) -> DataFrame:
    """Stream the events table: prediction ``props.k`` against ``value`` per event type."""
    schema = spark.read.parquet(events_path).schema
    folder, _, name = events_path.rpartition("/")
    source = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", name)
        .parquet(folder)
    )
    pairs = source.select("event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    folder = run_to_completion(metric_state(pairs, "event_type", "k", "value", threshold), "metric-state")
    return state_scores(latest_state(spark, folder), "event_type").withColumn("pcc", r6("pcc"))
