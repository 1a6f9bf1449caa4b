"""Approximate nearest neighbours with learned partitions.

Fit (on the driver, on ``SAMPLE`` rows at most): the sample's neighbour graph is cut into
equal parts by repeated balanced bisection (order along the second eigenvector, split in the
middle, then swaps that save edges), and a small network learns to tell from a vector how its
neighbours are spread over the parts. Tables of more than ``DEEP`` rows a part have a second
level: each part is cut and learnt again, on a sample of its own rows, by one task a part. The
number of parts a query is routed to is the smallest at which queries kept out of the fit find
``AIM`` of their neighbours in the sample.

Search: every row goes to its most probable part, a query to its most probable parts (of both
levels together), and candidates there are reranked by the exact cosine of the original vectors.
Parts are cut into blocks of bounded size by row number, so a part that holds a third of all
rows, or one vector many times over, is many groups; a row is copied only where a part is asked
by more than ``QUERIES_IN_BLOCK`` queries.

The samples are chosen by a hash of the vectors, copies once, so the answer does not depend on
how the rows are laid out.

Defined results: vectors null, zero, or holding null or non-finite components take no part;
shorter vectors count as ending in zeros; a row never finds itself, but rows that repeat it do
find each other; equal scores go to the smaller id, null ids last; rows with a null id are no
queries; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.vectors import FOUND, best, matrix, merged, numbered
from marlstone.session import read_table, written

SAMPLE = 8192  # rows that a partition is fitted on at most
HELD_OUT = 1024  # of them, rows that only choose the number of probes
NEIGHBOURS = 10
PARTS = (8, 32)  # a part for about 200 sampled rows and 1,000 rows, within these, on either level
DEEP = 1 << 15  # rows in a part from which on it is cut again
AIM = 0.93
HIDDEN = 128
EPOCHS = 40
ROWS = (512, 1 << 15)  # candidates in a block: a share of BLOCKS, within these
BLOCKS = 128
QUERIES_IN_BLOCK = 1 << 14


class Router(NamedTuple):
    """A network of one hidden layer that tells parts from vectors of unit length."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, unit: np.ndarray) -> np.ndarray:
        return np.maximum(unit @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def chances(self, unit: np.ndarray) -> np.ndarray:
        """Logarithms of the parts' probabilities."""
        z = self.logits(unit)
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


class Parts(NamedTuple):
    """The router of the first level, and of the second by part, where there is one; parts are numbered through."""

    top: Router
    below: dict[int, Router]

    @property
    def width(self) -> int:
        return max([1, *(len(r.b2) for r in self.below.values())])

    def homes(self, unit: np.ndarray) -> np.ndarray:
        """The part that a row goes to."""
        first = self.top.logits(unit).argmax(axis=1)
        second = np.zeros_like(first)
        for p, r in self.below.items():
            own = first == p
            if own.any():
                second[own] = r.logits(unit[own]).argmax(axis=1)
        return first * self.width + second

    def order(self, unit: np.ndarray) -> np.ndarray:
        """All parts, the most probable first."""
        first = self.top.chances(unit)
        every = np.full((*first.shape, self.width), -np.inf)
        for p in range(first.shape[1]):
            if p in self.below:
                own = self.below[p].chances(unit)
                every[:, p, : own.shape[1]] = first[:, p, None] + own
            else:
                every[:, p, 0] = first[:, p]
        return np.argsort(-every.reshape(len(unit), -1), axis=1, kind="stable")

    @property
    def count(self) -> int:
        return sum(len(self.below[p].b2) if p in self.below else 1 for p in range(len(self.top.b2)))


def unit(points: np.ndarray) -> np.ndarray:
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def nearest(queries: np.ndarray, points: np.ndarray, k: int, same: bool) -> np.ndarray:
    """Places of the k nearest points by cosine; with ``same`` a point isn't its own neighbour."""
    out = []
    for at in range(0, len(queries), 512):
        near = queries[at : at + 512] @ points.T
        if same:
            near[np.arange(len(near)), at + np.arange(len(near))] = -np.inf
        out.append(np.argpartition(-near, min(k, near.shape[1] - 1) - 1, axis=1)[:, :k])
    return np.concatenate(out)


def _bisected(edges: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """A side for each of n nodes, the sides equal in size, with few edges between them."""
    a, b = np.concatenate([edges, edges[:, ::-1]]).T
    root = np.sqrt(np.bincount(a, minlength=n) + 1.0)
    x = rng.normal(size=n)
    for _ in range(60):
        x -= root * (x @ root) / (root @ root)
        x = x + np.bincount(a, x[b] / (root[a] * root[b]), n)
        x /= np.linalg.norm(x) or 1
    side = np.zeros(n, np.int64)
    side[np.argsort(x / root, kind="stable")[n // 2 :]] = 1
    for _ in range(12):
        gain = np.bincount(a, np.where(side[a] != side[b], 1.0, -1.0), n)
        left, right = (np.flatnonzero(side == s) for s in (0, 1))
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        swap = np.flatnonzero(gain[left[:m]] + gain[right[:m]] > 1)[: max(1, m // 20)]
        if not swap.size:
            break
        cut = (side[a] != side[b]).sum()
        side[left[swap]], side[right[swap]] = 1, 0
        if (side[a] != side[b]).sum() >= cut:
            side[left[swap]], side[right[swap]] = 0, 1
            break
    return side


def partition(graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A part for each node of a neighbour graph (row i: i's neighbours), of equal sizes."""
    n = len(graph)
    edges = np.column_stack([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])
    part = np.zeros(n, np.int64)
    done = 1
    while done < parts:
        for p in range(done):
            own = np.flatnonzero(part == p)
            place = np.full(n, -1)
            place[own] = np.arange(len(own))
            inside = place[edges]
            part[own] = 2 * p + _bisected(inside[(inside >= 0).all(axis=1)], len(own), rng) if len(own) > 1 else 2 * p
            part[own] += parts * 4  # not to be taken for a part that is still to be cut
        part -= parts * 4
        done *= 2
    return part


def parts_for(sampled: int, n: int) -> int:
    parts = PARTS[0]
    while parts < PARTS[1] and 2 * parts * 200 <= sampled and 2 * parts * 1000 <= n:
        parts *= 2
    return parts


def kept_out(points: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The sample as unit vectors: those that only choose the number of probes, and those to fit on."""
    x = unit(points)[np.random.default_rng(seed).permutation(len(points))]
    n = min(HELD_OUT, len(x) // 5)
    return x[:n], x[n:]


def fit(x: np.ndarray, parts: int, seed: int = 7) -> Router:
    """Partition the neighbour graph of unit vectors, and learn to route."""
    rng = np.random.default_rng(seed)
    graph = nearest(x, x, min(NEIGHBOURS, len(x) - 1), same=True) if len(x) > 1 else np.zeros((len(x), 0), np.int64)
    part = partition(graph, parts, rng)
    aim = np.eye(parts)[part]
    if graph.size:
        aim = (aim + np.eye(parts)[part[graph]].sum(axis=1)) / (1 + graph.shape[1])
    return _trained(x, aim, parts, rng)


def probes_for(parts: Parts, asking: np.ndarray, x: np.ndarray) -> int:
    """The number of parts to ask so that ``asking`` find AIM of their neighbours among ``x``."""
    if not len(asking) or len(x) < 2:
        return parts.count
    wanted = parts.homes(x)[nearest(asking, x, min(5, len(x)), same=False)]
    ranks = np.argsort(parts.order(asking), axis=1)
    asked = np.sort(np.take_along_axis(ranks, wanted, axis=1).ravel())
    return int(asked[int(np.ceil(AIM * asked.size)) - 1]) + 1


def _trained(x: np.ndarray, aim: np.ndarray, parts: int, rng: np.random.Generator) -> Router:
    """Cross entropy against the spread of neighbours, by Adam."""
    width = x.shape[1]
    values = [rng.normal(size=(width, HIDDEN)) * (2 / max(width, 1)) ** 0.5 * 2, np.zeros(HIDDEN), rng.normal(size=(HIDDEN, parts)) * HIDDEN**-0.5, np.zeros(parts)]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    t = 0
    for epoch in range(EPOCHS):
        for own in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            w1, b1, w2, b2 = values
            h = np.maximum(x[own] @ w1 + b1, 0)
            z = h @ w2 + b2
            z = np.exp(z - z.max(axis=1, keepdims=True))
            off = (z / z.sum(axis=1, keepdims=True) - aim[own]) / len(own)
            back = (off @ w2.T) * (h > 0)
            t += 1
            rate = 4e-3 * (1 - epoch / EPOCHS) * (1 - 0.999**t) ** 0.5 / (1 - 0.9**t)
            for i, g in enumerate((x[own].T @ back, back.sum(axis=0), h.T @ off, off.sum(axis=0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                values[i] = values[i] - rate * first[i] / (np.sqrt(second[i]) + 1e-8)
    return Router(*values)


def routed(vector: str | Column, parts: Parts, width: int, probes: int | None, spark) -> Column:
    """The ``probes`` most probable parts of a vector column, or its home if there is no such number."""
    shared = spark.sparkContext.broadcast(parts)

    @F.pandas_udf("array<int>")
    def of(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in vectors:
            x = unit(matrix(pd.DataFrame({"v": s}), width))
            found = shared.value.homes(x)[:, None] if probes is None else shared.value.order(x)[:, :probes]
            yield pd.Series(list(found.astype(np.int32)), dtype=object)

    return of(vector)


def rerank(queries: pd.DataFrame, rows: pd.DataFrame, width: int, k: int) -> pd.DataFrame:
    """The k best rows of a block by cosine for each query of a block.

    A matrix product finds who may be among the best; their scores are then summed one by
    one, so that equal vectors have equal scores wherever they stand.
    """
    q, p = matrix(queries, width), matrix(rows, width)
    names, known = rows["key"].to_numpy(np.int64), rows["known"].to_numpy(bool)
    own, numbers = rows["row"].to_numpy(np.int64), queries["row"].to_numpy(np.int64)
    q_norm, p_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((p * p).sum(axis=1))
    out = []
    for at in range(0, len(q), 256) if len(p) else ():
        near = (q[at : at + 256] / q_norm[at : at + 256, None]) @ (p / p_norm[:, None]).T
        near[numbers[at : at + 256, None] == own[None, :]] = -np.inf
        least = np.partition(near, len(p) - k, axis=1)[:, len(p) - k] if len(p) > k else np.full(len(near), -np.inf)
        for i, row in enumerate(near):
            may = np.flatnonzero((row >= least[i] - 1e-9) & (row > -np.inf))
            score = (p[may] * q[at + i]).sum(axis=1) / (p_norm[may] * q_norm[at + i])
            top = best(score, names[may], known[may], k)
            out.append((np.full(top.size, at + i), may[top], score[top]))
    which, found = (np.concatenate([np.zeros(0, np.int64), *[x[j] for x in out]]) for j in (0, 1))
    score = np.concatenate([np.zeros(0), *[x[2] for x in out]])
    return pd.DataFrame({"query_row": numbers[which], "query_id": queries["key"].to_numpy(np.int64)[which], "vec_id": names[found], "known": known[found], "score": score})


def _sampled(rows: DataFrame, rate: Column | float) -> DataFrame:
    """About a share of the different vectors of ``rows`` (a copy is in whenever the other is), with a column ``at`` to order them by."""
    at = F.xxhash64(F.lit("ann"), "v")
    others = [c for c in rows.columns if c not in ("row", "key", "known", "v")]
    chosen = rows.where(F.pmod(at, F.lit(1 << 30)) < rate * (1 << 30)).select(*others, at.alias("at"), "v")
    return chosen.groupBy(*others, "at").agg(F.first("v").alias("v"))


def learnt(rows: DataFrame, n: int, width: int) -> tuple[Parts, int]:
    """The parts of a table of numbered rows, and how many of them a query has to ask."""
    spark = rows.sparkSession
    sample = _sampled(rows, F.lit(min(1.0, SAMPLE / n))).orderBy("at").limit(SAMPLE).toPandas()
    asking, x = kept_out(matrix(sample, width))
    parts = Parts(fit(x, parts_for(len(sample), n)), {})
    if n > DEEP * parts.count:
        homed = written(rows.withColumn("part", routed("v", parts, width, None, spark)[0]), "ann-first")
        sizes = homed.groupBy("part").agg(F.count("*").alias("n"))  # a row per part
        large = homed.join(F.broadcast(sizes.where(F.col("n") > DEEP)), "part").withColumn("rate", F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("n")))

        def again(own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values("at").head(SAMPLE)
            router = fit(unit(matrix(own, width)), parts_for(len(own), int(own["n"].iloc[0])))
            return pd.DataFrame({"part": own["part"].iloc[:1], "router": [pickle.dumps(router)]})

        below = _sampled(large, F.col("rate")).groupBy("part").applyInPandas(again, "part int, router binary").collect()  # PARTS[1] routers at most
        parts = Parts(parts.top, {r["part"]: pickle.loads(r["router"]) for r in below})  # noqa: S301
    return parts, probes_for(parts, asking, x)


def nearest_neighbours(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query row.

    ``queries``: a condition on the column ``key`` that picks the query rows.
    """
    spark = vectors.sparkSession
    usable = vectors.where(F.exists(F.col(vector), lambda x: x != 0))
    all_rows = numbered(usable, key, vector, "ann")
    n, width = all_rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts, probes = learnt(all_rows, n, width)

    homes = written(all_rows.withColumn("part", routed("v", parts, width, None, spark)[0]), "ann-rows")
    asked = written(all_rows.where(queries & F.col("known")).withColumn("probed", routed("v", parts, width, probes, spark)), "ann-queries")
    asked = asked.select("row", "key", "v", F.explode("probed").alias("part"))

    def blocks(frame: DataFrame, most: int, name: str) -> DataFrame:
        return frame.groupBy("part").agg(F.ceil(F.count("*") / most).cast("int").alias(name))

    many = written(blocks(homes, min(max(n // BLOCKS, ROWS[0]), ROWS[1]), "row_blocks").join(blocks(asked, QUERIES_IN_BLOCK, "query_blocks"), "part"), "ann-blocks")  # a row per part
    part_of = lambda c: F.pmod(F.xxhash64("row"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    right = homes.join(F.broadcast(many), "part").select("part", "row", "key", "known", "v", part_of("row_blocks").alias("b"), every("query_blocks").alias("a"))
    left = asked.join(F.broadcast(many), "part").select("part", "row", "key", "v", part_of("query_blocks").alias("a"), every("row_blocks").alias("b"))

    def of(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        return rerank(queries, rows, width, k)

    group = ["part", "a", "b"]
    return merged(left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(of, FOUND), k, F.col("score"))


def op4_ann(spark, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"), F.col("key") % 50 == 0)


QUERIES = {"op4_ann": op4_ann}
