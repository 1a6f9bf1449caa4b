"""Vector searches against all pairs: exact for top-k, by recall for the learned partitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows(n, width=12, seed=0):
    rng = np.random.default_rng(seed)
    out = [(i, [float(x) for x in rng.normal(size=width).astype(np.float32)], i % 3) for i in range(n)]
    same = [0.5] * width
    return out + [(1000 + i, same, 0) for i in range(150)]


def odd(width=12):
    return [(5000, None, 1), (5050, [float("nan")] * width, 1), (5100, [1.0] * (width - 1) + [None], 1), (5150, [float("inf")] * width, 1), (None, [0.25] * width, 1), (5200, [1.0, 2.0], None)]


def usable(found):
    return [(i, np.array(v, np.float32).astype(float)) for i, v, _ in found if v is not None and all(x is not None and np.isfinite(x) for x in v)]


def exact(found, score, k=5, width=12):
    pad = [(i, np.concatenate([v, np.zeros(width - len(v))])) for i, v in usable(found)]
    out = set()
    for a, (i, v) in enumerate(pad):
        if i is None or i % 50:
            continue
        others = sorted((-score(v, w), j if j is not None else 2**63, b) for b, (j, w) in enumerate(pad) if b != a)
        out |= {(i, r + 1, None if j == 2**63 else j, -s) for r, (s, j, _) in enumerate(others[:k])}
    return out


def test_inner_products(spark, monkeypatch):
    found = rows(400) + odd() + [(0, [0.1] * 12, 9)]
    monkeypatch.setattr(topk, "LEAF", 8)
    got = topk.exact_top_k(spark.createDataFrame(found, SCHEMA), F.col("key") % 50 == 0).collect()
    whole = lambda v, w: int(np.floor(256 * v) @ np.floor(256 * w))
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == exact(found, whole)


@pytest.mark.parametrize("size", [2.0**22, 2.0**60, 2.0**300])
def test_products_beyond_doubles(spark, size):
    rng = np.random.default_rng(3)
    found = [(i, [float(x) for x in size + rng.integers(-900, 900, 6) * size / 2**20]) for i in range(220)]
    found += [(400 + i, [size + (i + 1) * size / 2**45, *[size] * 5]) for i in range(9)]  # scores that differ in their last bits
    found += [(600, [1.0, -2.0, 0.5, 0.0, 0.0, 0.0]), (650, [-size] * 6), (None, found[3][1])]
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in found]
    expected = set()
    for a, (i, v) in enumerate(whole):
        if i is not None and i % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j is None, j or 0, b) for b, (j, w) in enumerate(whole) if b != a)
            expected |= {(i, r + 1, None if none else j, -s if -(1 << 63) <= -s < 1 << 63 else None) for r, (s, none, j, _) in enumerate(scores[:5])}
    got = topk.exact_top_k(spark.createDataFrame(found, "vec_id long, embedding array<double>"), F.col("key") % 50 == 0).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == expected


def test_the_largest_id_is_an_id(spark):
    most = 2**63 - 1
    frame = spark.createDataFrame([(most, [1.0, 0.5]), (1, [1.0, 0.25]), (None, [1.0, 0.5])], "vec_id long, embedding array<double>")
    for search in (topk.exact_top_k, ann.nearest_neighbours):
        got = {(r.query_id, r["rank"], r.vec_id) for r in search(frame, F.col("key") == most).collect()}
        assert got == {(most, 1, None), (most, 2, 1)}
        got = {(r.query_id, r["rank"], r.vec_id) for r in search(frame, F.col("key") == 1).collect()}
        assert got == {(1, 1, most), (1, 2, None)}


def test_many_cells_and_blocks(spark, monkeypatch):
    """Clustered rows in many cells and blocks, one vector a third of all rows."""
    for name, value in {"CELL_ROWS": 64, "ROWS": 40, "QUERIES_IN_BLOCK": 3}.items():
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(8)
    centers = 4 * rng.normal(size=(9, 12))
    found = [(i, [float(x) for x in (centers[i % 9] + 0.2 * rng.normal(size=12)).astype(np.float32)], 0) for i in range(600)]
    found += [(1000 + i, found[0][1], 0) for i in range(300)]
    whole = lambda v, w: int(np.floor(256 * v) @ np.floor(256 * w))
    got = topk.exact_top_k(spark.createDataFrame(found, SCHEMA), F.col("key") % 50 == 0).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == exact(found, whole)


def test_tree_invariants():
    points = np.random.default_rng(1).normal(size=(500, 6))
    tree = topk.CoverTree(points, 16)
    for node, (lo, hi) in enumerate(tree.span):
        own = points[tree.order[lo:hi]]
        assert np.linalg.norm(own - tree.center[node], axis=1).max() <= tree.radius[node] + 1e-12
        if tree.children[node]:
            assert [tree.span[c] for c in tree.children[node]][0][0] == lo and sum(b - a for a, b in (tree.span[c] for c in tree.children[node])) == hi - lo
            assert (tree.center[tree.children[node][0]] == tree.center[node]).all()
    assert sorted(tree.order) == list(range(500))


@pytest.mark.parametrize("probes_all", [True, False, "deep"])
def test_recall_and_exact_scores(spark, monkeypatch, probes_all):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 16))
    found = [(i, [float(x) for x in (centers[i % 12] + 0.3 * rng.normal(size=16)).astype(np.float32)], 0) for i in range(2400)]
    found += [(3000 + i, found[7][1], 1) for i in range(40)] + [(4000, [0.0] * 16, 0)]
    monkeypatch.setattr(ann, "AIM", 1.0 if probes_all is True else 0.97)
    if probes_all == "deep":
        monkeypatch.setattr(ann, "DEEP", 200)
        parts, probes = ann.learnt(ann.numbered(spark.createDataFrame(found[:2400], SCHEMA), "vec_id", "embedding", "test"), 2400, 16)
        assert parts.below and parts.count > 8 and probes < parts.count / 2
    got = ann.nearest_neighbours(spark.createDataFrame(found + odd(16), SCHEMA), F.col("key") % 50 == 0).collect()
    cosine = lambda v, w: float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum())))
    pairs = {(r.query_id, r.vec_id) for r in got}
    expected = exact([x for x in found if any(x[1])] + odd(16), cosine, width=16)
    assert len(pairs & {(q, v) for q, _, v, _ in expected}) >= 0.95 * len(expected) and len(got) == len(expected)
    vectors = {i: np.pad(v, (0, 16 - len(v))) for i, v in usable(found + odd(16))}
    for r in random.Random(0).sample(got, 60):
        assert abs(r.score - cosine(vectors[r.query_id], vectors[r.vec_id])) < 1e-12
    for q in {r.query_id for r in got}:
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id or 2**63) for r in own)


def test_balanced_partition():
    x = ann.unit(np.random.default_rng(2).normal(size=(640, 8)))
    part = ann.partition(ann.nearest(x, x, 8, same=True), 8, np.random.default_rng(0))
    assert (np.bincount(part) == 80).all()
    graph = ann.nearest(x, x, 8, same=True)
    assert (part[graph] == part[:, None]).mean() > 0.3  # an eighth by chance


def test_few_and_none(spark):
    ask = F.col("key") % 50 == 0
    for search in (lambda v: topk.exact_top_k(v, ask), lambda v: ann.nearest_neighbours(v, ask)):
        assert search(spark.createDataFrame([], SCHEMA)).count() == 0
        assert search(spark.createDataFrame([(0, [1.0, 0.0], 1)], SCHEMA)).count() == 0
        three = search(spark.createDataFrame([(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (3, [0.0, 1.0], 1)], SCHEMA)).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in three) == [(0, 1, 0), (0, 1, 0), (0, 2, 3), (0, 2, 3)]


def test_layout_does_not_matter(spark):
    frame = spark.createDataFrame(rows(1500, 16), SCHEMA)
    ask = F.col("key") % 50 == 0
    one, other = (sorted(map(tuple, ann.nearest_neighbours(x, ask).collect())) for x in (frame, frame.repartition(5, "label").sortWithinPartitions("vec_id", ascending=False)))
    assert one == other


def test_recall_on_the_supplied_vectors(spark):
    """At least 0.9 of the five nearest, by brute force; scores as they are."""
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.op4_ann(spark, "/root/testdata/sf0.1")
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    found = {(r.query_id, r.vec_id) for r in got.collect()}
    cosine = lambda v, w: float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum())))
    expected = {(q, v) for q, _, v, _ in exact([tuple(r) for r in frame.select("vec_id", "embedding", "label").collect()], cosine, width=64)}
    assert len(found & expected) >= 0.9 * len(expected)


def test_empty_vectors_and_clashing_columns(spark):
    """Vectors without components score 0 with each other; columns named as the search's own are ignored."""
    schema, ask = "vec_id long, embedding array<float>, row int, v string, cell int, part int, known string", F.col("key") % 50 == 0
    more = (1, "a", 2, 3, "x")
    empty = spark.createDataFrame([(0, [], *more), (50, [], *more), (3, [], *more)], schema)
    assert sorted(map(tuple, topk.exact_top_k(empty, ask).collect())) == [(0, 1, 3, 0), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 3, 0)]
    assert ann.nearest_neighbours(empty, ask).count() == 0
    nulls = spark.createDataFrame([(0, None, *more), (None, None, *more)], schema)
    assert topk.exact_top_k(nulls, ask).count() == ann.nearest_neighbours(nulls, ask).count() == 0


def test_query_cells_share_blocks(monkeypatch):
    """Cells are packed in order while their queries fit, so rows are sent once to as few blocks as queries need."""
    monkeypatch.setattr(topk, "QUERIES_IN_BLOCK", 10)
    assert topk._packed({3: 4, 1: 4, 2: 2, 7: 1, 9: 25, 11: 1}) == {1: -1, 2: -1, 3: -1, 7: -2, 9: -3, 11: -4}
    assert topk._packed({}) == {}
    monkeypatch.setattr(topk, "QUERIES_IN_BLOCK", 1 << 15)
    assert set(topk._packed(dict.fromkeys(range(256), 100)).values()) == {-1}
