"""The worker contract: a class with a set-up and a batch method, run in each partition.

Models, sandboxes and external tools stay outside; this is where they plug in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

RESULT = "item_id string, sample_index long, status string, raw_output string, code string, score double, extra string, error string, elapsed_s double"


class Worker:
    """Set up once per partition; ``run`` gets an Arrow batch of items and yields a dict for each result."""

    def __init__(self, settings: dict) -> None:
        self.settings = settings

    def setup(self) -> None:
        pass

    def run(self, items: pd.DataFrame) -> Iterator[dict]:
        raise NotImplementedError


class Echo(Worker):
    """Gives back its items: a stand-in for tests. Text with the word ``fail`` fails."""

    def run(self, items: pd.DataFrame) -> Iterator[dict]:
        for row in items.to_dict("records"):
            if "fail" in (row["code"] or ""):
                raise RuntimeError(f"told to fail on {row['item_id']}")
            for i in range(int(row["n"])):
                yield {"item_id": row["item_id"], "sample_index": i, "status": "OK", "code": row["code"], "score": float(len(row["code"] or ""))}


def _failed(items: pd.DataFrame, error: Exception) -> Iterator[dict]:
    for row in items.to_dict("records"):
        for i in range(int(row["n"])):
            yield {"item_id": row["item_id"], "sample_index": i, "status": "FAILED", "error": str(error)[:500]}


def run_workers(items: DataFrame, worker: type[Worker], settings: dict) -> DataFrame:
    """Results of all items (item_id, code, n). A batch that fails is tried again item by item, so that one bad item
    fails alone; partition by partition, retried by Spark as any task."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = worker(settings)
        own.setup()
        names = [x.split()[0] for x in RESULT.split(", ")]
        for batch in batches:
            try:
                rows = list(own.run(batch))
            except Exception:  # noqa: BLE001  any fault of a worker is a FAILED row
                rows = []
                for i in range(len(batch)):
                    one = batch.iloc[i : i + 1]
                    try:
                        rows += list(own.run(one))
                    except Exception as e:  # noqa: BLE001
                        rows += list(_failed(one, e))
            yield pd.DataFrame({x: pd.Series([r.get(x) for r in rows], dtype=object) for x in names})

    return items.mapInPandas(of, RESULT)
