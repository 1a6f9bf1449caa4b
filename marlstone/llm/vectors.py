"""What the vector searches share: numbered rows, blocks of bounded size, and merged results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import written

FOUND = "query_row long, query_id long, vec_id long, known boolean, score double"


def finite(vector: str | Column) -> Column:
    """The vector is there and holds neither nulls nor anything that isn't a finite number."""
    inside = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector, inside), F.lit(False))


def numbered(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(row, key, known, v): the usable vectors as doubles, each row with a number of its own; written.

    A null id is 0 with ``known`` false, so that ids stay whole numbers in the workers.
    """
    usable = vectors.select(F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("key"), F.col(key).isNotNull().alias("known"), F.col(vector).cast("array<double>").alias("v")).where(finite("v"))
    return written(written(usable, label).select(F.monotonically_increasing_id().alias("row"), "key", "known", "v"), f"{label}-rows")


def matrix(frame: pd.DataFrame, width: int) -> np.ndarray:
    """The vectors of a block; shorter ones end in zeros."""
    out = np.zeros((len(frame), width))
    for row, v in zip(out, frame["v"], strict=True):
        row[: len(v)] = v
    return out


def best(scores: np.ndarray, names: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id (null ids last), best first."""
    if scores.size > k:
        least = np.partition(scores, scores.size - k)[scores.size - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(scores.size)
    return at[np.lexsort((names[at], ~known[at], -scores[at]))[:k]]


def merged(found: DataFrame, k: int, score: Column, by: Column | None = None) -> DataFrame:
    """The k best of each query over all blocks, by ``by`` or else the score: query_id, rank, vec_id, score."""
    order = Window.partitionBy("query_row").orderBy(F.desc("_by"), F.desc("known"), "vec_id")
    ranked = found.withColumn("_by", score if by is None else by).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("known"), F.col("vec_id")).alias("vec_id"), score.alias("score"))
