"""Exact top-k inner products by dual-tree search over cover trees.

Rows are dealt to cells by the nearest of a bounded number of pivots, so that a cell's covering
radius is small, and cells are cut into blocks of bounded size; queries likewise. Each pair of a
query block and a row block is one group (a stated query set against all rows, in blocks). A task
builds a cover tree over either side and walks both together: the inner products of a pair of
nodes are at most <a, b> + |a| rb + |b| ra + ra rb, with a, b the centres and ra, rb the
covering radii; the pair is left out when that is below the worst kth score of all the
queries under the query node.

A first pass holds each query block against one block of its own cell. The kth scores found are
lower bounds: pairs of cells that can't reach them are never brought together, and in the second
pass no tree node is opened below them. There, queries of several cells share a block as far as
they fit, so that a row is sent once to each block of queries that may reach its cell, and its
tree is built once for all of them. The k best of each block are then merged.

A node's children are the centre and further points taken farthest first, so they lie at
least as far apart as the radius they cover (separation), each point is under its nearest
child (covering), and the centre is its own first child (nesting).

Scores are exact: products of doubles are whole numbers while they stay below 2^53; beyond that,
products (of vectors scaled by a power of two) only propose, with a bound on their error, and
Python's integers decide.

Defined results: vectors null or holding null or non-finite components take no part, nor do
those that are not finite once scaled; shorter vectors count as ending in zeros; a row never
finds itself, but rows that repeat it do find each other; rows with a null id are no queries
and come last among equals; repeated query rows give their k rows each; fewer candidates than k
give as many; a score too large for a long is ranked rightly and shown as null; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.vectors import best, finite, matrix, merged, numbered
from marlstone.session import read_table, written

ROWS = 1 << 16  # rows in a block at most, about
BLOCKS = 32  # row blocks at least, so that small tables use many tasks too
QUERIES_IN_BLOCK = 1 << 15
CELLS = 256  # pivots at most; one for each CELL_ROWS rows below that
CELL_ROWS = 1 << 13
SAMPLE = 1 << 13  # rows that pivots are chosen among; any choice gives the same result
LEAF, CHILDREN = 128, 8
QUERY_LEAF = 64
EXACT = 1 << 53
FOUND = "query_row long, query_id long, vec_id long, known boolean, score long, ordered binary"


class CoverTree:
    """Nodes as arrays: ``order[lo:hi]`` are the points under a node."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.order = np.arange(len(points))
        self.center: list[np.ndarray] = []
        self.norm: list[float] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        self.points, self.leaf = points, leaf
        if len(points):
            todo = [self._node(0, len(points), points[np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1))])]
            while todo:
                todo += self._split(todo.pop())

    def _node(self, lo: int, hi: int, center: np.ndarray) -> int:
        own = self.points[self.order[lo:hi]]
        self.center.append(center)
        self.norm.append(float(np.linalg.norm(center)))
        self.radius.append(float(np.sqrt(((own - center) ** 2).sum(axis=1).max())))
        self.span.append((lo, hi))
        self.children.append([])
        return len(self.center) - 1

    def _split(self, node: int) -> list[int]:
        lo, hi = self.span[node]
        if hi - lo <= self.leaf or self.radius[node] == 0:
            return []
        rows = self.order[lo:hi]
        own = self.points[rows]
        centers, nearest = [self.center[node]], np.zeros(len(rows), np.int64)
        gap = ((own - self.center[node]) ** 2).sum(axis=1)
        while len(centers) < CHILDREN and gap.max() > 0:
            far = own[np.argmax(gap)]
            to = ((own - far) ** 2).sum(axis=1)
            nearest[to < gap] = len(centers)
            gap = np.minimum(gap, to)
            centers.append(far)
        by = np.argsort(nearest, kind="stable")
        self.order[lo:hi] = rows[by]
        counts = np.bincount(nearest, minlength=len(centers))
        for c, n in zip(centers, counts, strict=True):
            if n:
                self.children[node].append(self._node(lo, lo + n, c))
                lo += n
        return self.children[node]


class Scale(NamedTuple):
    """What holds for the whole table: vectors are floor(factor * x); ``bits`` of 2 bring them below one."""

    width: int
    factor: float
    bits: int
    wide: bool

    def whole(self, frame: pd.DataFrame) -> np.ndarray:
        return np.floor(self.factor * matrix(frame, self.width))

    def near(self, whole: np.ndarray) -> np.ndarray:
        return np.ldexp(whole, -self.bits) if self.wide else whole

    def below(self, score: int) -> float:
        """A double no larger than an exact score, in the units of ``near``."""
        return float(np.nextafter(np.nextafter(score / (1 << 2 * self.bits), -np.inf), -np.inf)) if self.wide else float(score)

    def ordered(self, score: int) -> bytes:
        """Bytes in the order of the scores."""
        size = (2 * self.bits + self.width.bit_length() + 2) // 8 + 1
        return (score + (1 << 8 * size - 1)).to_bytes(size, "big")


def scale_of(width: int, factor: float, largest: float) -> Scale:
    most = int(np.floor(factor * largest)) + 1
    return Scale(width, factor, most.bit_length(), most * most * width >= EXACT)


class _Search:
    def __init__(self, queries: pd.DataFrame, rows: pd.DataFrame, scale: Scale, k: int) -> None:
        q, p = scale.whole(queries), scale.whole(rows)
        self.q, self.p = CoverTree(scale.near(q), QUERY_LEAF), CoverTree(scale.near(p), LEAF)
        self.whole_q, self.whole_p = q[self.q.order], p[self.p.order]
        self.queries, self.points = self.q.points[self.q.order], self.p.points[self.p.order]
        self.query_rows, self.query_names = (queries[c].to_numpy(np.int64)[self.q.order] for c in ("row", "key"))
        self.rows, self.names = (rows[c].to_numpy(np.int64)[self.p.order] for c in ("row", "key"))
        self.known = rows["known"].to_numpy(bool)[self.p.order]
        self.k, self.scale, n = k, scale, len(queries)
        self.worst = queries["worst"].to_numpy(float)[self.q.order].copy()
        largest = np.sqrt((self.points**2).sum(axis=1)).max(initial=0)
        self.slack = np.sqrt((self.queries**2).sum(axis=1)) * largest * (scale.width + 4) * 2.0**-52 + 1e-300 if scale.wide else np.zeros(n)
        self.found: list[np.ndarray] = [np.zeros(0, np.int64)] * n  # places among the rows
        self.scores: list[np.ndarray] = [np.zeros(0)] * n  # of them, exact

    def bound(self, a: int, b: int) -> float:
        q, p = self.q, self.p
        most = float(q.center[a] @ p.center[b]) + q.norm[a] * p.radius[b] + p.norm[b] * q.radius[a] + q.radius[a] * p.radius[b]
        size = (q.norm[a] + q.radius[a]) * (p.norm[b] + p.radius[b])
        return most + 1e-9 * size + 1e-300  # rounding never makes it too small

    def run(self) -> None:
        todo = [(self.bound(0, 0), 0, 0)] if len(self.queries) and len(self.points) else []
        while todo:
            bound, a, b = todo.pop()
            lo, hi = self.q.span[a]
            if bound < self.worst[lo:hi].min():
                continue
            qs, ps = self.q.children[a], self.p.children[b]
            if not qs and not ps:
                self._compare(a, b)
                continue
            if ps and (not qs or self.p.radius[b] >= self.q.radius[a]):
                pairs = [(a, c) for c in ps]
            else:
                pairs = [(c, b) for c in qs]
            todo += sorted((self.bound(*x), *x) for x in pairs)  # the most promising is taken next

    def _compare(self, a: int, b: int) -> None:
        (qlo, qhi), (plo, phi) = self.q.span[a], self.p.span[b]
        scores = self.queries[qlo:qhi] @ self.points[plo:phi].T
        scores[self.query_rows[qlo:qhi, None] == self.rows[None, plo:phi]] = -np.inf
        least = self.worst[qlo:qhi] - self.slack[qlo:qhi]
        for i in np.flatnonzero(scores.max(axis=1) >= least):
            at = np.flatnonzero((scores[i] >= least[i]) & (scores[i] > -np.inf))
            self._keep(qlo + i, plo + at, scores[i, at])

    def _keep(self, i: int, places: np.ndarray, scores: np.ndarray) -> None:
        if self.scale.wide:
            own = [int(x) for x in self.whole_q[i]]
            scores = np.array([sum(x * int(y) for x, y in zip(own, self.whole_p[j], strict=True)) for j in places], object)
            places, scores = np.concatenate([self.found[i], places]), np.concatenate([self.scores[i], scores])
            top = np.array(sorted(range(len(places)), key=lambda j: (-scores[j], not self.known[places[j]], self.names[places[j]]))[: self.k], np.int64)
        else:
            places, scores = np.concatenate([self.found[i], places]), np.concatenate([self.scores[i], scores])
            top = best(scores, self.names[places], self.known[places], self.k)
        self.found[i], self.scores[i] = places[top], scores[top]
        if top.size == self.k:
            self.worst[i] = max(self.worst[i], self.scale.below(int(self.scores[i][-1])))

    def result(self) -> pd.DataFrame:
        n = [x.size for x in self.found]
        places = np.concatenate([*self.found, np.zeros(0, np.int64)])
        scores = [int(x) for own in self.scores for x in own]
        long = [x if -(1 << 63) <= x < 1 << 63 else None for x in scores]
        return pd.DataFrame({
            "query_row": np.repeat(self.query_rows, n), "query_id": np.repeat(self.query_names, n), "vec_id": self.names[places], "known": self.known[places],
            "score": pd.array(long, dtype="Int64"), "ordered": pd.Series([self.scale.ordered(x) if self.scale.wide else None for x in scores], dtype=object),
        })


def search(queries: pd.DataFrame, rows: pd.DataFrame, scale: Scale, k: int) -> pd.DataFrame:
    """The k best rows of a block for each query of a block, of those that reach the query's ``worst``."""
    s = _Search(queries, rows, scale, k)
    s.run()
    return s.result()


def pivots_of(sample: np.ndarray, n: int) -> np.ndarray:
    """Of a sample, ``n`` centres: starts drawn evenly, then a few rounds of k-means."""
    centers = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(np.int64)] if len(sample) else np.zeros((1, sample.shape[1]))
    for _ in range(6):
        home = np.argmin((centers**2).sum(axis=1) - 2 * sample @ centers.T, axis=1) if len(sample) else np.zeros(0, np.int64)
        for c in np.unique(home):
            centers[c] = sample[home == c].mean(axis=0)
    return centers


def _celled(rows: DataFrame, pivots: np.ndarray, scale: Scale) -> DataFrame:
    """Each row's nearest pivot, and how far it lies from it."""
    shared = rows.sparkSession.sparkContext.broadcast((pivots, scale))

    @F.pandas_udf("cell int, far double")
    def of(vectors: pd.Series) -> pd.DataFrame:
        centers, own = shared.value
        points = own.near(own.whole(pd.DataFrame({"v": vectors})))
        cell = np.argmin((centers**2).sum(axis=1) - 2 * points @ centers.T, axis=1)
        return pd.DataFrame({"cell": cell.astype(np.int32), "far": np.sqrt(((points - centers[cell]) ** 2).sum(axis=1))})

    return rows.withColumn("_at", of("v")).select(*rows.columns, "_at.cell", "_at.far")


def exact_top_k(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: float = 256) -> DataFrame:
    """query_id, rank, vec_id, score (long): the k largest inner products of floor(scale * x).

    ``queries``: a condition on the column ``key`` that picks the query rows. What reaches the driver:
    a bounded sample, and a row per cell (``CELLS`` at most).
    """
    spark = vectors.sparkSession
    all_rows = numbered(vectors.where(finite(F.transform(F.col(vector).cast("array<double>"), lambda x: x * scale))), key, vector, "topk")
    n, width, largest = all_rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0)))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    of_all = scale_of(width, scale, largest)
    drawn = F.pmod(F.xxhash64(F.lit("topk"), "key", "v"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30))
    sample = all_rows.where(drawn).select("v").limit(2 * SAMPLE).toPandas()  # of a row's content, however rows are dealt
    pivots = pivots_of(of_all.near(of_all.whole(sample)), min(CELLS, max(1, n // CELL_ROWS)))

    rows = written(_celled(all_rows, pivots, of_all), "topk-cells")
    asked = written(rows.where(queries & F.col("known")), "topk-asked")
    told = {r["cell"]: r for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.count_if(queries & F.col("known")).alias("asked")).collect()}
    size = min(ROWS, max(1, -(-n // BLOCKS)))
    blocks = {c: -(-r["n"] // size) for c, r in told.items()}
    query_blocks = {c: -(-r["asked"] // QUERIES_IN_BLOCK) for c, r in told.items() if r["asked"]}

    def held(pairs: list[tuple[int, int, int, int]], left: DataFrame, right: DataFrame) -> DataFrame:
        """The best of each pair (query cell, row cell, first row block, row blocks), in blocks of either."""
        shape = lambda: F.broadcast(spark.createDataFrame([(a, b, lo, m, query_blocks[a]) for a, b, lo, m in pairs], "a int, b int, lo int, blocks int, query_blocks int"))  # noqa: E731  CELLS^2 rows at most
        part = lambda c: F.pmod(F.xxhash64("row"), F.col(c)).cast("int")
        every = lambda lo, m: F.explode(F.sequence(lo, lo + m - 1))
        total = F.create_map(*[F.lit(x) for c, m in blocks.items() for x in (c, m)])
        p = right.withColumn("block", F.pmod(F.xxhash64("row"), total[F.col("cell")]).cast("int")).join(shape(), F.col("cell") == F.col("b"))
        p = p.where((F.col("block") >= F.col("lo")) & (F.col("block") < F.col("lo") + F.col("blocks"))).select("a", "b", "block", every(F.lit(0), F.col("query_blocks")).alias("part"), "row", "key", "known", "v")
        q = left.join(shape(), F.col("cell") == F.col("a")).select("a", "b", part("query_blocks").alias("part"), every(F.col("lo"), F.col("blocks")).alias("block"), "row", "key", "worst", "v")
        group = ["a", "b", "part", "block"]
        return q.groupBy(*group).cogroup(p.groupBy(*group)).applyInPandas(lambda x, y: search(x, y, of_all, k), FOUND)

    first = held([(c, c, c % blocks[c], 1) for c in query_blocks], asked.withColumn("worst", F.lit(float("-inf"))), rows)
    shape = "row long, worst double"
    if of_all.wide:
        least = first.groupBy("query_row").applyInPandas(lambda own: pd.DataFrame({"row": own["query_row"][:1], "worst": of_all.below(min(int.from_bytes(x, "big") for x in own["ordered"]) - _zero(of_all)) if len(own) == k else -np.inf}), shape)
    else:
        least = first.groupBy(F.col("query_row").alias("row")).agg(F.when(F.count("*") == k, F.min("score").cast("double")).otherwise(float("-inf")).alias("worst"))
    seeded = written(asked.join(written(least, "topk-seeds"), "row", "left").withColumn("worst", F.coalesce("worst", F.lit(float("-inf")))), "topk-queries")

    cells = {r["cell"]: (r["far"], r["worst"]) for r in seeded.groupBy("cell").agg(F.max("far").alias("far"), F.min("worst").alias("worst")).collect()}
    norm = np.linalg.norm(pivots, axis=1)
    pairs = []
    for a, (far, worst) in cells.items():
        for b, r in told.items():
            most = float(pivots[a] @ pivots[b]) + norm[a] * r["far"] + norm[b] * far + far * r["far"]
            if most + 1e-9 * (norm[a] + far) * (norm[b] + r["far"]) + 1e-300 >= worst:
                pairs.append((a, b, 0, blocks[b]))
    group_of = _packed({c: r["asked"] for c, r in told.items() if r["asked"]})
    for c, g in group_of.items():
        query_blocks[g] = query_blocks.get(g, 0) + told[c]["asked"]
    query_blocks |= {g: -(-query_blocks[g] // QUERIES_IN_BLOCK) for g in set(group_of.values())}
    reached = sorted({(group_of[a], b, lo, m) for a, b, lo, m in pairs})
    grouped = seeded.withColumn("cell", F.create_map(*[F.lit(x) for pair in group_of.items() for x in pair])[F.col("cell")]) if group_of else seeded
    found = held(reached, grouped, rows)
    return merged(found, k, F.col("score"), F.col("ordered") if of_all.wide else None)


def _packed(asked: dict[int, int]) -> dict[int, int]:
    """A group for each cell with queries, numbered below zero: cells share one while their queries fit a block."""
    out, group, held = {}, -1, 0
    for cell in sorted(asked):
        if held and held + asked[cell] > QUERIES_IN_BLOCK:
            group, held = group - 1, 0
        out[cell] = group
        held += asked[cell]
    return out


def _zero(scale: Scale) -> int:
    """What ``ordered`` adds to a score."""
    return int.from_bytes(scale.ordered(0), "big")


def op8_topk(spark, sf_dir: str) -> DataFrame:
    return exact_top_k(read_table(spark, sf_dir, "embeddings"), F.col("key") % 50 == 0)


_SQL = """
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
          FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

QUERIES = {"op8_topk": op8_topk}
ORACLES = {"op8_topk": _SQL}
