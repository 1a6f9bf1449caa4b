"""Predicates, views and closed-form statistics, with the known values of the reference's own cases."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import hashing, scores
from marlstone.operators import stats


@pytest.mark.parametrize(("values", "n", "tau"), [(range(1000), 1000, 990.0), ([0.0, 0.5, 1.0] * 300 + [0.0] * 100, 1000, math.inf), ([1.0] * 2 + [0.0] * 198, 200, 1.0), ([1.0] * 98 + [0.0] * 2, 100, math.inf), ([-math.inf] * 50 + list(range(50)), 100, 49.0)])
def test_threshold(spark, values, n, tau):
    row = stats.fit_threshold(spark.createDataFrame([(float(v),) for v in values], "score double"), []).first()
    assert (row.threshold, row.n_negatives, row.underpowered) == (tau, n, n < 1000)


@pytest.mark.parametrize("bad", [None, math.nan])
def test_threshold_refuses_missing_scores(spark, bad):
    with pytest.raises(Exception, match="no score"):
        stats.fit_threshold(spark.createDataFrame([(1.0,), (bad,)], "score double"), []).collect()


def test_threshold_of_nothing_has_no_row(spark):
    assert stats.fit_threshold(spark.createDataFrame([], "g string, score double"), ["g"]).count() == 0


def test_detected(spark):
    rows = [(1.0, "OK", "OK", True), (1.0, "OK", None, True), (0.4, "OK", "OK", False), (1.0, "FAILED", "OK", False), (1.0, "OK", "FAILED", False), (None, "OK", "OK", False), (math.nan, "OK", "OK", False), (1.0, None, "OK", False)]
    frame = spark.createDataFrame(rows, "score double, status string, embed string, expected boolean")
    assert all(r.hit == r.expected for r in frame.withColumn("hit", scores.detected(F.col("score"), F.col("status"), F.col("embed"), 0.5)).collect())


def test_views(spark):
    rows = [(1, 0.3, "OK", '{"z": 2.5, "a": true, "b": false, "spaces": true}'), (2, 0.3, "OK", '{"z": null}'), (3, 0.1, "FAILED", "{}"), (4, 0.1, "OK", "no json")]
    frame = spark.createDataFrame(rows, "i int, score double, status string, extra_json string")
    assert [(r.score, r.native_score, r.status) for r in scores.primary_view(frame, "z").orderBy("i").collect()] == [(2.5, 0.3, "OK"), (None, 0.3, "FAILED"), (None, 0.1, "FAILED"), (None, 0.1, "FAILED")]
    share = spark.createDataFrame([('{"a": true, "b": false, "x": true}',), ("{}",), (None,)], "f string").select(scores.flag_share(F.col("f"), ["x"]).alias("s")).collect()
    assert [r.s for r in share] == [0.5, None, None]


def test_intervals(spark):
    one = spark.createDataFrame([(50, 100), (0, 1000), (0, 0), (10, 10)], "k long, n long")
    rows = one.withColumn("w", scores.wilson(F.col("k"), F.col("n"))).withColumn("c", scores.clopper_pearson(F.col("k"), F.col("n"))).collect()
    assert (round(rows[0].w.low, 4), round(rows[0].w.high, 4)) == (0.4038, 0.5962)
    assert round(rows[1].c.high, 6) == 0.003682 and rows[1].c.low == 0 and rows[3].c.high == 1
    assert rows[2].w is None and rows[2].c.low is None


def test_exact_intervals_of_many_cells(monkeypatch):
    """A pair (k, n) is solved once a worker, and a tail of many trials takes the terms that count only."""
    calls, tail = [], scores._tail
    monkeypatch.setattr(scores, "_tail", lambda *x: calls.append(x) or tail(*x))
    first = scores.exact_bounds(7, 33, 0.05)
    once = len(calls)
    assert scores.exact_bounds(7, 33, 0.05) == first and 0 < once == len(calls)
    for k, n in ((7, 33), (2, 150), (90, 100)):
        low, high = scores.exact_bounds(k, n, 0.05)
        pmf = lambda i, p: math.comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i)  # noqa: E731, B023
        assert float(1 - sum(pmf(i, low) for i in range(k)) if k < n / 2 else sum(pmf(i, low) for i in range(k, n + 1))) == pytest.approx(0.025)
        assert float(sum(pmf(i, high) for i in range(k + 1)) if k < n / 2 else 1 - sum(pmf(i, high) for i in range(k + 1, n + 1))) == pytest.approx(0.025)
    terms, log = [], math.lgamma
    monkeypatch.setattr(scores.math, "lgamma", lambda x: terms.append(x) or log(x))
    assert tail(100, 1_000_000, 0.0001) == pytest.approx(0.5133, abs=2e-4) and len(terms) < 2000


def test_auroc_and_ks(spark):
    rows = [("a", 1.0, True), ("a", 0.5, True), ("a", 0.5, False), ("a", 0.0, False), ("a", 1.0, False), ("b", -math.inf, True), ("b", math.inf, False)]
    frame = spark.createDataFrame(rows, "g string, s double, p boolean")
    found = {r.g: r.auroc for r in stats.auroc(frame, ["g"], "s", F.col("p")).collect()}
    assert found == {"a": pytest.approx(4 / 6), "b": 0.0}
    gaps = {r.g: r.ks for r in stats.ks(frame, ["g"], "s", F.col("p")).collect()}
    assert gaps["b"] == 1.0 and gaps["a"] == pytest.approx(1 / 3)
    assert stats.auroc(frame.where("p"), ["g"], "s", F.col("p")).first().auroc is None


def test_bootstrap_covers_the_mean_and_repeats(spark):
    rows = [(f"c{i}", "g" if i % 2 else None, float(i % 7 < 3)) for i in range(60) for _ in range(3)]
    frame = spark.createDataFrame(rows, "cluster string, g string, hit double")
    first, second = (sorted(map(tuple, stats.ratio_interval(frame, ["g"], "cluster", F.col("hit"), n=200).collect()), key=str) for _ in range(2))
    assert first == second and len(first) == 2
    assert all(low <= value <= high for _, value, _, low, high in first)


def test_bits(spark):
    half = "101010101010"
    frame = spark.createDataFrame([(half + half, half), (half, half), ("", ""), (half + "010101010101" + half, "1")], "a string, b string")
    rows = frame.withColumn("r", scores.decode_rounds(F.col("a"))).withColumn("m", scores.bit_matches(F.col("a"), F.col("b"))).collect()
    assert [r.r for r in rows] == [["0" * 12], [], [], ["1" * 12]]
    assert [r.m for r in rows] == [12, 12, 0, 1]


def test_seed_and_ids(spark):
    import hashlib

    frame = spark.createDataFrame([("a", None, 3)], "x string, y string, z int")
    expected = int.from_bytes(hashlib.sha256(b"split|a|None|3").digest()[:8], "big") % (2**31 - 1)
    row = frame.select(hashing.seed(F.lit("split"), "a" and F.col("x"), F.col("y"), F.col("z")).alias("s"), hashing.sample_id(source=F.col("x"), sample_index=F.col("z")).alias("i"), hashing.fingerprint(F.lit(" a\t b\n")).alias("f"), hashing.fingerprint(F.lit("a b")).alias("g")).first()
    assert row.s == expected and row.i == hashlib.md5(b"a|||||||3|||").hexdigest() and row.f == row.g


def test_split_draws_add_up_and_are_even():
    """Every replicate draws as many as there are; the counts' mean and spread are those of a multinomial, in blocks of any size."""
    n = 4000
    for clusters in (1, 6, 7, 8, 50, 61):
        blocks = [stats._block_draws("x", clusters, b, n, 7) for b in range(-(-clusters // 7))]
        counts = np.hstack([c for _, c in blocks])
        assert counts.shape == (n, clusters) and (counts.sum(axis=1) == clusters).all()
        ahead = np.zeros(n, int)
        for before, own in blocks:
            assert (before == ahead).all()
            ahead += own.sum(axis=1)
        assert abs(counts.mean(axis=0) - 1).max() < 0.1
        if clusters > 1:
            assert abs(counts.var(axis=0) - (1 - 1 / clusters)).max() < 0.15
            off = np.corrcoef(counts.T)[~np.eye(clusters, dtype=bool)]
            assert abs(off.mean() + 1 / (clusters - 1)) < 0.02


@pytest.mark.parametrize("block", [4, 1 << 10])
def test_split_replicates_and_medians(spark, monkeypatch, block):
    """Sums and medians of the same draws, put together by hand."""
    monkeypatch.setattr(stats, "BLOCK", block)
    rng = random.Random(8)
    rows = [(g, f"c{i:03}", rng.randrange(9) / 2) for g, k in (("a", 23), (None, 8), ("one", 1)) for i in range(k)]
    frame = spark.createDataFrame(rows, "g string, c string, v double")
    sums = {(r.g, r.replicate): r.v for r in stats.split_replicates(frame, ["g"], "c", ["v"], 50, "t").collect()}
    medians = {(r.g, r.replicate): r.median for r in stats.split_medians(frame, ["g"], "c", "v", 50, "t").collect()}
    for g in ("a", None, "one"):
        own = [r for r in rows if r[0] == g]
        name = "t|42|" + ('{"_":0}' if g is None else f'{{"_":0,"g":"{g}"}}')
        counts = np.hstack([stats._block_draws(name, len(own), b, 50, block)[1] for b in range(-(-len(own) // block))])
        by_name = np.array([v for _, _, v in sorted(own, key=lambda r: r[1])])
        by_value = np.array([v for _, _, v in sorted(own, key=lambda r: (r[2], r[1]))])
        for k in range(50):
            assert sums[g, k] == pytest.approx(counts[k] @ by_name)
            assert medians[g, k] == pytest.approx(np.median(np.repeat(by_value, counts[k])))
    assert len(sums) == len(medians) == 150


def test_split_intervals_agree_with_drawn_ones(spark):
    rng = random.Random(5)
    rows = [(f"c{i}", rng.gauss(3, 1) + j / 10) for i in range(300) for j in range(3)]
    frame = spark.createDataFrame(rows, "cluster string, v double")
    for interval, plain in ((stats.mean_interval, stats.replicates), (stats.statistic_interval, stats.drawn_medians)):
        value = F.col("v") if interval is stats.mean_interval else "v"
        a, b = (interval(frame, [], "cluster", value, n=400, **how).first() for how in ({}, {"resampled": plain}))
        assert a.value == b.value and a.n == b.n == 300
        assert abs(a.ci_low - b.ci_low) < 0.05 and abs(a.ci_high - b.ci_high) < 0.05 and a.ci_low < a.value < a.ci_high


def test_exact_quantiles(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([None, *range(40)])) for g, n in (("a", 300), (None, 7), ("one", 1)) for _ in range(n)] + [("none", None)]
    frame = spark.createDataFrame(rows, "g string, v int")
    shares = {"low": 0.1, "mid": 0.5, "high": 0.975, "least": 0.0, "most": 1.0}
    found = {r.g: r for r in stats.exact_quantiles(frame, ["g"], "v", shares).collect()}
    assert set(found) == {"a", None, "one", "none"}
    for g in found:
        held = [v for h, v in rows if h == g and v is not None]
        for name, share in shares.items():
            assert found[g][name] == (pytest.approx(np.quantile(held, share)) if held else None)
    assert stats.exact_quantiles(frame, [], "v", {"mid": 0.5}).first().mid == pytest.approx(np.median([v for _, v in rows if v is not None]))
