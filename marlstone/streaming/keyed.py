"""Results that arrive late, twice, or after a retry, as state per key that is kept across batches and expires."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HELD = "held binary"
CHANGES = "item_id string, sample_index long, line long, status string, score double, first_status string, action string"
RETRIED = ("TIMEOUT",)
# Spark's watermark starts at the epoch, and what isn't after it counts as late (microseconds). Keys are
# dealt to so many groups by hash, whose records are held together: a call of Python and a read of state cost far more than a record.
EARLIEST = 1
BUCKETS = 4096


def latest_result(keep_ms: int, retried: tuple[str, ...]) -> Callable:
    """The record of the highest line of each key (item, index) of a bucket, whatever the order in which lines arrive.

    Each change is emitted with an action: ``retry`` the first time that a key's record has a status to be tried again
    (it is asked for once, whatever comes later), else ``keep``. When the watermark has passed ``keep_ms`` behind the latest
    event of a key, its record is emitted once more as ``final`` and dropped. Held of a key: line, status, score, whether
    a retry was asked for, the status that asked, and until when it is kept.
    """

    def of(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple] = pickle.loads(state.get[0]) if state.exists else {}
        best: dict[tuple, tuple] = {}
        for batch in batches:
            for item, index, line, status, score, ms in zip(*[batch[c].tolist() for c in ("item_id", "sample_index", "line", "status", "score", "event_ms")]):
                key, rank = (item, index), _rank(line, status, score)
                before = best.get(key)
                if before is None:
                    best[key] = rank, (line, status, score), ms
                else:
                    best[key] = *((rank, (line, status, score)) if rank > before[0] else before[:2]), max(ms, before[2])
        out = []
        for key, (rank, record, latest) in best.items():
            before = held.get(key)
            asked, first, until = before[3:] if before else (False, None, 0)
            changed = before is None or rank > _rank(*before[:3])
            line, status, score = record if changed else before[:3]
            ask = changed and not asked and status in retried
            first = status if ask else first
            held[key] = (line, status, None if score != score else score, asked or ask, first, max(latest + keep_ms, until))
            if changed:
                out.append((*key, line, status, score, first, "retry" if ask else "keep"))
        mark = state.getCurrentWatermarkMs()
        for key, (line, status, score, _, first, until) in list(held.items()):
            if until < mark:
                del held[key]
                out.append((*key, line, status, score, first, "final"))
        if held:
            state.update((pickle.dumps(held, pickle.HIGHEST_PROTOCOL),))
            state.setTimeoutTimestamp(max(min(x[5] for x in held.values()), mark, 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in CHANGES.split(", ")]).astype({"score": "float64"})

    return of


def _rank(line: int, status: str | None, score: float | None) -> tuple:
    return line, status or "", float("-inf") if score is None or score != score else score


def keyed_results(results: DataFrame, ts: str, late: str, keep_ms: int = 3_600_000, retried: tuple[str, ...] = RETRIED) -> DataFrame:
    """Changes of the latest record of each (item_id, sample_index) of a stream with line, status, score and an event time.

    The session's state store is set to the one that this kind of state needs, where it is the default.
    Rows without a key or a line are dropped: they could win nothing. State is bounded by the keys of ``keep_ms`` and the watermark's delay.
    Event times up to the epoch count as just after it: they are late only when the watermark has moved.
    """
    spark = results.sparkSession
    if spark.conf.get(PROVIDER) == spark.newSession().conf.get(PROVIDER):
        spark.conf.set(PROVIDER, ROCKS)
    rows = results.where("item_id is not null and sample_index is not null and line is not null")
    at, earliest = F.col(ts).cast("timestamp"), F.timestamp_micros(F.lit(EARLIEST))
    rows = rows.withColumn(ts, F.when(at < earliest, earliest).otherwise(at)).withWatermark(ts, late)
    rows = rows.select(F.col("item_id").cast("string").alias("item_id"), F.col("sample_index").cast("long").alias("sample_index"), F.col("line").cast("long").alias("line"), "status", F.col("score").cast("double").alias("score"), F.unix_millis(ts).alias("event_ms"), ts)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("item_id", "sample_index"), F.lit(BUCKETS)))
    return rows.groupBy("bucket").applyInPandasWithState(latest_result(keep_ms, retried), CHANGES, HELD, "update", GroupStateTimeout.EventTimeTimeout)


def settled(changes: DataFrame) -> DataFrame:
    """(item_id, sample_index, status, score, first_status): what the changes of a stream come to, the last of each key."""
    last = F.max_by(F.struct("status", "score", "first_status"), F.struct("line", F.col("status"), "score", (F.col("action") == "final").cast("int")))
    return changes.groupBy("item_id", "sample_index").agg(last.alias("r")).select("item_id", "sample_index", "r.*")
