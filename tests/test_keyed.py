"""State across batches against the batch result: lines in any order, one retry a key, state that expires."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marlstone.plans import io_queries
from marlstone.streaming import jobs, keyed
from tests.oracles import SMALL

START = datetime(2024, 1, 1)
SHAPE = "item_id string, sample_index long, line long, status string, score double, ts timestamp"


def run(spark, folder, batches, **how):
    """All changes of a stream that gets a batch at a time, restarted for each."""
    out = []
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SHAPE).parquet(f"{folder}/in")
        query = keyed.keyed_results(stream, "ts", "10 minutes", **how).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(lambda b, n, number=number: b.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/out")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    out = spark.read.parquet(f"{folder}/out")
    return out


def test_batches_equal_the_whole(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"i{rng.randrange(12)}", rng.randrange(2), n, rng.choice(["PASSED", "FAILED", "TIMEOUT"]), rng.choice([None, rng.random()]), START + timedelta(seconds=n)) for n in range(120)]
    shuffled = rng.sample(rows, len(rows))
    changes = run(spark, tmp_path, [shuffled[:50], shuffled[50:90], shuffled[90:]])
    expected = jobs.latest_results(spark.createDataFrame(rows, SHAPE)).collect()
    assert {tuple(r)[:4] for r in keyed.settled(changes).collect()} == {tuple(r) for r in expected} and len(expected) > 20
    asked = {tuple(r) for r in changes.where("action = 'retry'").groupBy("item_id", "sample_index").count().collect()}
    assert asked and {n for *_, n in asked} == {1}


def test_retry_once_and_late_lines(spark, tmp_path):
    at = lambda line, status: ("a", 0, line, status, None, START + timedelta(seconds=line))
    changes = run(spark, tmp_path, [[at(5, "TIMEOUT")], [at(3, "PASSED")], [at(6, "TIMEOUT"), (None, 0, 9, "PASSED", 1.0, START), ("b", 1, None, "PASSED", 1.0, START)], [at(8, "PASSED"), at(8, "PASSED")]])
    rows = [(r.batch, r.line, r.status, r.first_status, r.action) for r in changes.orderBy("batch").collect()]
    assert rows == [(0, 5, "TIMEOUT", "TIMEOUT", "retry"), (2, 6, "TIMEOUT", "TIMEOUT", "keep"), (3, 8, "PASSED", "TIMEOUT", "keep")]


def test_state_expires(spark, tmp_path):
    row = lambda item, line, minutes: (item, 0, line, "PASSED", 1.0, START + timedelta(minutes=minutes))
    changes = run(spark, tmp_path, [[row("a", 1, 0), row("b", 1, 50)], [row("c", 1, 75)], [row("c", 2, 76)]], keep_ms=60_000)
    assert {(r.item_id, r.action) for r in changes.collect()} >= {("a", "final"), ("b", "final"), ("c", "keep")}
    assert not changes.where("item_id = 'c' and action = 'final'").count()
    assert keyed.settled(changes).count() == 3


def test_events_at_and_before_1970_count(spark, tmp_path):
    at = lambda item, line, ts: (item, 0, line, "PASSED", float(line), ts)
    epoch, old = datetime(1970, 1, 1), datetime(1965, 5, 1)
    changes = run(spark, tmp_path, [[at("a", 1, epoch), at("b", 1, old), at("b", 2, old)], [at("a", 2, epoch), at("c", 1, epoch - timedelta(seconds=1))]])
    assert {(r.item_id, r.score) for r in keyed.settled(changes).collect()} == {("a", 2.0), ("b", 2.0), ("c", 1.0)}


def test_first_of_one_line_and_event_times_from_zero(spark, tmp_path):
    item = spark.read.parquet(f"{SMALL}/lineitem.parquet").limit(1).collect()[0].asDict()
    keys = [item | {"l_orderkey": 1 + n // 2, "l_partkey": 1 + n // 20, "l_suppkey": 3, "l_linenumber": 1, "l_extendedprice": float(-n), "l_returnflag": "ARN"[n % 3]} for n in range(2400)]  # lines in pairs
    spark.createDataFrame(keys, spark.read.parquet(f"{SMALL}/lineitem.parquet").schema).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = io_queries.QUERIES["r8_keyed_results"](spark, str(tmp_path)).collect()
    status = {"A": "FAILED", "R": "PASSED", "N": "TIMEOUT"}
    assert {tuple(r) for r in found} == {(str(1 + n // 20), 0, status["ARN"[n % 3]], float(-n)) for n in range(18, 2400, 20)}


def test_keys_share_state(spark, tmp_path, monkeypatch):
    """Calls of Python are as many as buckets at most, whatever the number of keys, and keys of one bucket stay apart."""
    monkeypatch.setattr(keyed, "BUCKETS", 3)
    rng = random.Random(8)
    row = lambda item, line: (f"i{item}", item % 2, line, rng.choice(["PASSED", "FAILED", "TIMEOUT", None]), rng.choice([None, float("nan"), rng.random()]), START + timedelta(minutes=line))
    batches = [[row(rng.randrange(40), n) for n in range(60)], [row(rng.randrange(30, 70), n) for n in range(60, 130)], [row(99, 200)], [row(99, 201)]]
    changes = run(spark, tmp_path, batches, keep_ms=60_000)
    lasts = {}
    for rows in batches:
        for r in rows:
            lasts[r[:2]] = max(lasts.get(r[:2], r), r, key=lambda x: x[2])
    finals = sorted(changes.where("action = 'final'").collect(), key=lambda r: r.line)  # a key that comes back is final again
    found = {(r.item_id, r.sample_index): r for r in finals}
    assert found.keys() == lasts.keys() - {("i99", 1)} and all(found[k].line == lasts[k][2] and found[k].status == lasts[k][3] for k in found)
    assert len({(r.item_id, r.line) for r in finals}) == len(finals)
    plan = keyed.keyed_results(spark.readStream.schema(SHAPE).parquet(f"{tmp_path}/in"), "ts", "1 hour")._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "bucket#" in plan


def test_store_of_the_caller_is_kept(spark):
    before = spark.conf.get(keyed.PROVIDER)
    assert before == keyed.ROCKS or pytest.skip("this session was not streamed yet")
