"""Incremental forms: resumable ingest, per-batch workers, late results, and event-time counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def ingest(spark: SparkSession, source: str, schema: StructType | str, sink: str, state: str, fingerprint: str, change: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Append what is new in a folder of JSON lines to a Parquet sink, then stop.

    The checkpoint is named after the configuration's fingerprint: another configuration begins
    anew and never mixes with rows of the first.
    """
    rows = spark.readStream.schema(schema).json(source).withColumn("fingerprint", F.lit(fingerprint))
    return change(rows).writeStream.format("parquet").option("checkpointLocation", f"{state}/{fingerprint}").option("path", f"{sink}/{fingerprint}").trigger(availableNow=True).start()


def each_batch(source: DataFrame, work: Callable[[DataFrame], DataFrame], sink: str, state: str) -> StreamingQuery:
    """Run a worker over each micro-batch; a batch that is repeated replaces its own output."""

    def step(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return source.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start()


def latest_results(source: DataFrame, line: str = "line") -> DataFrame:
    """Late duplicates: the last line of each (item, index) wins."""
    return source.groupBy("item_id", "sample_index").agg(F.max_by(F.struct("status", "score"), line).alias("r")).select("item_id", "sample_index", "r.*")


def window_counts(events: DataFrame, ts: str, late: str, width: str, slide: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts and sums of ``value`` in tumbling or sliding windows, state kept until ``late`` has passed."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width, slide), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, ts: str, late: str, gap: str, key: str) -> DataFrame:
    """Count of each session of a key: events at most ``gap`` apart."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


def retried(first: DataFrame, second: DataFrame) -> DataFrame:
    """The retry's record where there is one, else the first; the first status stays beside it."""
    again = second.select("sample_id", F.col("status").alias("_status"))
    return first.join(again, "sample_id", "left").select("sample_id", F.coalesce("_status", "status").alias("status"), F.col("status").alias("first_attempt_status"), F.col("_status").alias("retry_status"))
