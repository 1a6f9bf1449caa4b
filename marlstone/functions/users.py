"""Table functions and aggregates of users: the contracts that their code fills, and how Spark runs it."""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HELD = 1 << 12  # groups whose states a task holds before it passes them on


class PromptFunction:
    """A table function of prompts: gets the rows of a partition in order, gives any number of rows for each.

    ``rows_of`` is what a user fills; ``position`` counts the rows given in the partition so far. A row that fails gives one
    row with status FAILED and the reason, and the partition goes on.
    """

    def __init__(self) -> None:
        self.position = 0

    def rows_of(self, item_id: str, prompt: str | None, n: int) -> Iterator[str | None]:
        raise NotImplementedError

    def eval(self, row):
        key, item_id, prompt, n = row["partition_key"], row["item_id"], row["prompt"], row["n"]
        given = 0
        try:
            for text in self.rows_of(item_id, prompt, n):
                yield key, item_id, given, self.position, text, "OK"
                given, self.position = given + 1, self.position + 1
        except Exception as e:  # noqa: BLE001  a user's code
            yield key, item_id, given, self.position, str(e)[:200], "FAILED"
            self.position += 1


GIVEN = "partition_key string, item_id string, sample_index int, position long, text string, status string"


def prompted(table: DataFrame, function: type[PromptFunction], partition_key: str, order: str, item_id: str, prompt: str, n: str) -> DataFrame:
    """What a table function gives for each prompt: partitions by key, rows in order within one."""
    rows = table.select(F.col(partition_key).cast("string").alias("partition_key"), F.col(order).alias("_order"), F.col(item_id).cast("string").alias("item_id"), F.col(prompt).alias("prompt"), F.col(n).cast("int").alias("n"))
    return F.udtf(function, returnType=GIVEN)(rows.asTable().partitionBy("partition_key").orderBy("_order", "item_id"))


class Estimator:
    """An aggregate of users: a state is a list of doubles, made of rows and of other states.

    ``merged`` must be associative and commutative up to rounding: states are made in the tasks that read the rows, and only they are shuffled.
    """

    columns: tuple[str, ...] = ()
    schema = ""

    def state_of(self, rows: pd.DataFrame) -> list[float]:
        raise NotImplementedError

    def merged(self, a: list[float], b: list[float]) -> list[float]:
        raise NotImplementedError

    def finished(self, state: list[float]) -> tuple:
        raise NotImplementedError


class MeanInterval(Estimator):
    """Number, mean and normal interval of a column; nulls don't count; null bounds below two values."""

    schema = "n long, mean double, ci_low double, ci_high double"

    def __init__(self, value: str, z: float = 1.959963984540054) -> None:
        self.columns, self.z = (value,), z

    def state_of(self, rows: pd.DataFrame) -> list[float]:
        x = rows[self.columns[0]].dropna().astype(float)
        return [float(len(x)), float(x.mean()), float(((x - x.mean()) ** 2).sum())] if len(x) else [0.0, 0.0, 0.0]

    def merged(self, a: list[float], b: list[float]) -> list[float]:
        n = a[0] + b[0]
        if not n:
            return a
        gap = b[1] - a[1]
        return [n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n]

    def finished(self, state: list[float]) -> tuple:
        n, mean, squares = state
        if n < 2:
            return int(n), mean if n else None, None, None
        half = self.z * sqrt(squares / (n - 1) / n)
        return int(n), mean, mean - half, mean + half


def estimated(table: DataFrame, group: list[str], estimator: Estimator) -> DataFrame:
    """(group, the estimator's columns): states of each task's rows, then the states of each group merged. Null groups count."""
    shape = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in group)
    columns, most = list(estimator.columns), HELD

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[float]] = {}
        given = lambda: pd.DataFrame([(*k, s) for k, s in held.items()], columns=[*group, "_state"])
        for batch in batches:
            parts = batch.groupby(group, dropna=False) if group else [((), batch)]
            for key, rows in parts:
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                state = estimator.state_of(rows[columns])
                held[key] = estimator.merged(held[key], state) if key in held else state
            if len(held) > most:
                yield given()
                held = {}
        if held:
            yield given()

    def finish(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for state in rows["_state"]:
            whole = list(state) if whole is None else estimator.merged(whole, list(state))
        return pd.DataFrame([(*(None if pd.isna(k) else k for k in key), *estimator.finished(whole))], columns=[*group, *[c.split(" ")[0] for c in estimator.schema.split(", ")]])

    lead = f"{shape}, " if shape else ""
    made = table.select(*group, *columns).mapInPandas(states, f"{lead}_state array<double>")
    return made.groupBy(*group).applyInPandas(finish, f"{lead}{estimator.schema}")
