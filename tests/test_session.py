"""Scratch tables, the shared folder, and the session's settings."""

import os

import pytest

from marlstone import session


def test_scratch_removes_what_is_not_kept(spark):
    paths = []
    with session.scratch(spark) as outer:
        with session.scratch(spark) as inner:
            one = session.written(spark.range(3), "one")
            two = inner.keep(session.written(spark.range(4), "two"))
            paths += [p for _, p in inner.tables + outer.tables]
        assert one.columns == ["id"] and not os.path.exists(paths[0])
        assert two.count() == 4 and [p for _, p in outer.tables] == paths[1:]
    assert not any(map(os.path.exists, paths))


def test_a_failed_step_keeps_its_tables(spark):
    with pytest.raises(ZeroDivisionError), session.scratch(spark) as own:
        session.written(spark.range(3), "one")
        1 / 0  # noqa: B018
    assert os.path.exists(own.tables[0][1])
    own.clear()


def test_batches(spark):
    before = spark.conf.get(session.BATCH_BYTES)
    with session.batches_as_before(spark):
        session.bounded_batches(spark, "4m")
        assert spark.conf.get(session.BATCH_BYTES) == "4m"
        session.bounded_batches(spark, "8m")
        assert spark.conf.get(session.BATCH_BYTES) == "4m"
    assert spark.conf.get(session.BATCH_BYTES) == before


def test_no_local_folder_on_a_cluster():
    class Conf:
        @staticmethod
        def get(*_):
            return None

    class Option:
        isDefined = staticmethod(lambda: False)

    class Context:
        master = "spark://host:7077"

        class _jsc:  # noqa: N801
            sc = staticmethod(lambda: type("C", (), {"getCheckpointDir": staticmethod(lambda: Option)}))

    class Session:
        conf, sparkContext = Conf, Context  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session)


def test_free_name(spark):
    assert session.free_name(spark.range(1).selectExpr("id as _ROW", "id as _row1"), "row") == "_row2"
