"""Growing JSON lines and the artifact sink: files that grow between triggers, tasks that fail in mid-write."""

import glob
import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marlstone.sources import artifacts
from marlstone.sources.artifacts import Artifact
from marlstone.sources.growing import GrowingJsonLines

SHAPE = "id long, name string, tags array<string>"


@pytest.fixture(scope="module")
def known(spark):
    spark.dataSource.register(GrowingJsonLines)
    spark.dataSource.register(Artifact)
    return spark


def lines(first, last):
    return "".join(json.dumps({"id": i, "name": "é" * (i % 7), "tags": [str(i)] * (i % 3), "other": 1}) + "\n" for i in range(first, last))


def batch(spark, path, chunk=97):
    return spark.read.format("growing_json_lines").schema(SHAPE).option("chunk", chunk).load(str(path))


@pytest.mark.parametrize("chunk", [7, 97, 1 << 20])
def test_every_line_once_whatever_the_ranges(known, tmp_path, chunk):
    (tmp_path / "a.json").write_text(lines(0, 40) + "\n  \n" + lines(40, 50))
    (tmp_path / "b.json").write_text(lines(50, 51)[:-1])  # no end, but whole
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "_hidden").write_text("{")
    rows = batch(known, tmp_path, chunk).orderBy("id").collect()
    assert [(r.id, r.name, r.tags) for r in rows] == [(i, "é" * (i % 7), [str(i)] * (i % 3)) for i in range(51)]


def test_only_an_unended_last_line_may_be_broken(known, tmp_path):
    path = tmp_path / "x.json"
    path.write_text(lines(0, 5) + '{"id": 5, "na')
    assert batch(known, path).count() == 5
    path.write_text(lines(0, 5) + '{"id": 5, "na\n')
    with pytest.raises(PySparkException, match="does not decode"):
        batch(known, path).collect()
    path.write_text('{"id": 1}\n{"name": "x", "id": null}\n')
    assert {(r.id, r.name, r.tags) for r in batch(known, path).collect()} == {(1, None, None), (None, "x", None)}
    path.write_text("")
    assert batch(known, path).count() == 0


def test_a_stream_of_files_that_grow(known, tmp_path):
    folder, rng = tmp_path / "in", random.Random(2)
    folder.mkdir()
    text = {f"f{k}.json": lines(100 * k, 100 * k + 60) for k in range(3)}
    done = dict.fromkeys(text, 0)
    for turn in range(6):  # a restart each time; files end in the middle of lines
        for name, whole in text.items():
            done[name] = len(whole) if turn == 5 else min(len(whole), done[name] + rng.randint(0, 900))
            (folder / name).write_text(whole[: done[name]])
        stream = known.readStream.format("growing_json_lines").schema(SHAPE).option("chunk", 200).load(str(folder))
        query = stream.writeStream.format("artifact").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination(120)
        seen = [r.id for r in known.read.format("artifact").load(str(tmp_path / "out")).collect()] if artifacts.manifest_of(str(tmp_path / "out")) else []
        expected = [json.loads(x)["id"] for name, whole in text.items() for x in whole[: done[name]].split("\n")[:-1]]
        assert sorted(seen) == sorted(expected)
    assert len(seen) == 180


def broken(spark, n):
    """n rows over four partitions, of which one fails when it has given some."""

    def of(batches):
        for b in batches:
            yield b
            if 3 in b.column("id").to_pylist():
                raise RuntimeError("lost")

    return spark.range(0, n, 1, 4).mapInArrow(of, "id long")


def test_a_failed_write_leaves_the_old_artifact_or_none(known, tmp_path):
    path = str(tmp_path / "a")
    with pytest.raises(PySparkException):
        broken(known, 100).write.format("artifact").mode("append").save(path)
    assert artifacts.manifest_of(path) is None and not glob.glob(f"{path}/data-*")
    with pytest.raises(PySparkException, match="no complete artifact"):
        known.read.format("artifact").load(path).count()
    known.range(10).write.format("artifact").mode("append").save(path)
    for mode in ("append", "overwrite"):
        with pytest.raises(PySparkException):
            broken(known, 100).write.format("artifact").mode(mode).save(path)
        assert known.read.format("artifact").load(path).count() == 10 and len(glob.glob(f"{path}/data-*")) == 1


def test_manifests_versions_and_checks(known, tmp_path):
    path = str(tmp_path / "a")
    table = known.range(0, 100, 1, 4).select("id", F.lit("x").alias("s"), F.array(F.col("id")).alias("l"))
    table.write.format("artifact").mode("append").save(path)
    table.write.format("artifact").mode("append").save(path)
    found = known.read.format("artifact").option("verify", "true").load(path)
    assert found.schema.simpleString() == table.schema.simpleString() and found.count() == 200
    with pytest.raises(PySparkException, match="other columns"):
        known.range(3).write.format("artifact").mode("append").save(path)
    table.limit(7).write.format("artifact").mode("overwrite").save(path)
    told = artifacts.manifest_of(path)
    assert (told["version"], told["rows"], told["status"]) == (3, 7, "complete") and known.read.format("artifact").load(path).count() == 7
    assert artifacts.clean(path) == 2 and known.read.format("artifact").load(path).count() == 7  # the refused one is gone
    file = f"{path}/{told['files'][0]['file']}"
    data = open(file, "rb").read()
    open(file, "wb").write(data[:-9] + bytes([data[-9] ^ 1]) + data[-8:])
    with pytest.raises(PySparkException, match="not what the manifest lists"):
        known.read.format("artifact").option("verify", "true").load(path).count()
    open(file, "wb").write(data[:-1])
    with pytest.raises(PySparkException, match="not what the manifest lists"):
        known.read.format("artifact").load(path).count()


def test_an_empty_table(known, tmp_path):
    path = str(tmp_path / "e")
    known.range(0).write.format("artifact").mode("append").save(path)
    assert known.read.format("artifact").load(path).count() == 0


def test_a_batch_that_is_repeated_is_appended_once(known, tmp_path):
    shape = known.range(1).schema
    path = str(tmp_path / "s")
    import pyarrow as pa

    def once(first, number):
        writer = artifacts.StreamWriter(path, shape)
        message = writer.write(iter([pa.RecordBatch.from_pydict({"id": [first, first + 1]})]))
        writer.commit([message, None], number)

    once(0, 0)
    once(2, 1)
    once(2, 1)
    assert sorted(r.id for r in known.read.format("artifact").load(path).collect()) == [0, 1, 2, 3]
    assert len(glob.glob(f"{path}/data-*/*.parquet")) == 2
