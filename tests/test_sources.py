"""Scans, the store, and streams."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from marlstone.sources import readers
from marlstone.sources.store import Store, latex
from marlstone.streaming import jobs

SCHEMA = StructType([StructField("id", LongType()), StructField("x", StringType())])


def test_required_columns(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    with pytest.raises(readers.MissingColumns, match="no column y"):
        readers.read_parquet(spark, str(tmp_path / "t"), ["id", "y"])
    assert readers.read_parquet(spark, str(tmp_path / "t"), ["id"]).count() == 3
    with pytest.raises(ValueError, match="3 rows, 4 declared"):
        readers.checked_rows(spark.range(3), 4, "t")


def test_json_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": 1, "x": "a"}\n\n{"id": 2, "x": null}\n')
    assert readers.read_json_lines(spark, str(path), SCHEMA, ["id"]).count() == 2
    with pytest.raises(Exception, match="a line has no"):
        readers.read_json_lines(spark, str(path), SCHEMA, ["id", "x"]).collect()
    path.write_text('{"id": 1, "x": "a"}\n{"id": 2, "x"')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_json_lines(spark, str(path), SCHEMA, ["id"]).collect()
    assert [r.id for r in readers.read_growing_json_lines(spark, str(path), SCHEMA).collect()] == [1]
    path.write_text('{"id": 1, "x"\n{"id": 2, "x": "b"}\n')
    with pytest.raises(Exception, match="malformed line"):
        readers.read_growing_json_lines(spark, str(path), SCHEMA).collect()


def test_exclusions_and_groups(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    readers.check_not_excluded(keys, keys.where("false"), "k", "t")
    with pytest.raises(ValueError, match="excluded keys"):
        readers.check_not_excluded(keys, keys.where("k = 'b'"), "k", "t")
    groups = readers.groups_of_ids(spark.createDataFrame([("s1,s2 s1",), ("s3",), ("",)], "l string"), "l", r"s\d")
    assert sorted(r.id for r in readers.group_index(groups).collect()) == ["s1", "s2"]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    table = spark.range(5)
    with pytest.raises(FileNotFoundError):
        store.read("t", "a")
    with pytest.raises(ValueError, match="5 rows written, 6 expected"):
        store.write("t", "a", table, expected=6)
    assert not store.exists("t", "a")
    store.write("t", "a", table, expected=5)
    digest = store.digest("t", "a")
    store.write("t", "b", table, inputs=[("t", "a")])
    assert store.count("t", "b") == 5 and store.verify("t", "a", digest)
    assert store.manifests.where("path = 'b'").first().inputs == {"t/a": digest}
    store.supersede("t", "a")
    assert store.exists("t", "a") and store.manifests.where("path = 'a'").first().superseded
    store.write_document("d", "one", {"x": 1})
    assert store.read_document("d", "one") == {"x": 1}
    with pytest.raises(ValueError, match="outside the store"):
        store.path("t", "../x")


def test_store_overwrites(spark, tmp_path, monkeypatch):
    """A failed write leaves no artifact, a good one replaces it; readers keep what they have; damage is seen."""
    store = Store(spark, str(tmp_path / "s"))
    store.write("t", "a", spark.range(5))
    held = store.read("t", "a")
    with pytest.raises(ValueError, match="7 rows written, 6 expected"):
        store.write("t", "a", spark.range(7), expected=6)
    assert not store.exists("t", "a") and held.count() == 5
    with pytest.raises(FileNotFoundError):
        store.read("t", "a")
    store.write("t", "a", spark.range(7))
    assert store.count("t", "a") == 7 and store.verify("t", "a")
    store.write("t", "a", store.read("t", "a").where("id < 3"))  # from itself
    assert store.count("t", "a") == 3 and store.manifests.where("path = 'a'").first().version == 3
    store.clean("t", "a")
    folder = tmp_path / "s" / "t" / "a"
    assert len(list(folder.iterdir())) == 1
    part = next(p for p in folder.rglob("part-*.parquet") if p.stat().st_size > 100)
    data = part.read_bytes()
    part.write_bytes(data[:60] + bytes([data[60] ^ 255]) + data[61:])
    assert store.exists("t", "a") and not store.verify("t", "a")
    part.write_bytes(data + b"garbage")
    assert not store.exists("t", "a")
    store.write("t", "a", spark.range(2))
    monkeypatch.setattr(Store, "_hash", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.write_document("d", "x", {})
    assert not store.exists("d", "x")


def test_groups_of_files(spark):
    files = spark.createDataFrame([("s1 s2\r\ns3\n\n s4\ns5\n",), ("s6,s7\ns8\ns9 s0",), ("",), (None,)], "t string")
    got = sorted(sorted(r.ids) for r in readers.groups_of_files(files, "t", r"s\d").collect())
    assert got == [["s0", "s9"], ["s1", "s2", "s3"], ["s4", "s5"], ["s6", "s7"]]


def test_latex(spark):
    out = latex(spark.createDataFrame([("a_b", 5)], "n string, v int"), "50 %")
    assert r"a\_b & 5 \\" in out and r"50 \%" in out


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 50:02d}:00", float(i)) for i in range(200)]
    frame = spark.createDataFrame(rows, "user long, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    frame.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    q = jobs.window_counts(stream, "ts", "2 hours", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    expected = frame.groupBy(F.window("ts", "10 minutes")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    assert sorted(map(str, spark.table("w").collect())) == sorted(map(str, expected.collect()))
    late = spark.createDataFrame([("a", 0, 1, "FAILED", 0.0), ("a", 0, 2, "OK", 1.0)], "item_id string, sample_index int, line int, status string, score double")
    assert jobs.latest_results(late).first().status == "OK"
