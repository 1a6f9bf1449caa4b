"""Table functions keep order and isolate failures; aggregates equal built-ins however rows are dealt."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import users


class Letters(users.PromptFunction):
    def rows_of(self, item_id, prompt, n):
        for i in range(n):
            if prompt == "bad" and i == 1:
                raise ValueError("no more")
            yield None if prompt is None else prompt * (i + 1)


def test_rows_of_prompts(spark):
    rows = [("k1", 2, "b", "x", 2), ("k1", 1, "a", "y", 3), ("k2", 1, "c", "bad", 3), ("k2", 2, "d", None, 1), (None, 1, "e", "z", 1), ("k1", 3, "f", "w", 0)]
    table = spark.createDataFrame(rows, "k string, o int, i string, p string, n int").repartition(4)
    got = sorted(map(tuple, users.prompted(table, Letters, "k", "o", "i", "p", "n").collect()), key=str)
    expected = [("k1", "a", 0, 0, "y", "OK"), ("k1", "a", 1, 1, "yy", "OK"), ("k1", "a", 2, 2, "yyy", "OK"), ("k1", "b", 0, 3, "x", "OK"), ("k1", "b", 1, 4, "xx", "OK")]
    expected += [("k2", "c", 0, 0, "bad", "OK"), ("k2", "c", 1, 1, "no more", "FAILED"), ("k2", "d", 0, 2, None, "OK"), (None, "e", 0, 0, "z", "OK")]
    assert got == sorted(expected, key=str)
    assert users.prompted(table.limit(0), Letters, "k", "o", "i", "p", "n").count() == 0


@pytest.mark.parametrize("held", [1 << 12, 2])
def test_mean_interval(spark, monkeypatch, held):
    monkeypatch.setattr(users, "HELD", held)
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None, "c"]), rng.choice([None, rng.gauss(5, 2)])) for _ in range(900)] + [("one", 4.0), ("none", None)]
    table = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: tuple(r)[1:] for r in users.estimated(table, ["g"], users.MeanInterval("v")).collect()}
    for g in ("a", "b", "c", None):
        own = [v for h, v in rows if h == g and v is not None]
        half = 1.959963984540054 * np.std(own, ddof=1) / len(own) ** 0.5
        assert got[g] == (len(own), pytest.approx(np.mean(own)), pytest.approx(np.mean(own) - half), pytest.approx(np.mean(own) + half))
    assert got["one"] == (1, 4.0, None, None) and got["none"] == (0, None, None, None) and len(got) == 6
    whole = users.estimated(table, [], users.MeanInterval("v")).first()
    assert whole.n == sum(v is not None for _, v in rows)
    assert users.estimated(table.where(F.lit(False)), ["g"], users.MeanInterval("v")).count() == 0
