"""Queries and operators that do the whole job, whatever the size of a group."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import gates, metrics, stats
from marlstone.plans.queries import QUERIES
from marlstone.plans.views import executions
from tests.oracles import SMALL


def test_gap_means_against_all_pairs(spark):
    rng = random.Random(4)
    sides = [[(rng.choice("abc"), rng.choice([None, *range(9)])) for _ in range(40)] + [("a", 3)] * 200 for _ in range(2)]
    sides[0] += [("only marked", 1), ("one", 2)]
    sides[1] += [("only reference", 1), ("only reference", 4), ("one", 5)]
    mean = lambda xs: sum(xs) / len(xs) if xs else None
    expected = {}
    for p in {p for side in sides for p, _ in side}:
        m, r = ([v for q, v in side if q == p and v is not None] for side in sides)
        cross = mean([mean([abs(a - b) for b in r]) for a in m]) if r else None
        expected[p] = (cross, mean([mean([abs(a - b) for j, b in enumerate(r) if i != j]) for i, a in enumerate(r)]) if len(r) > 1 else None)
    frames = [spark.createDataFrame(side, "p string, v int") for side in sides]
    got = {r.p: (r.cross_mean, r.within_mean) for r in metrics.gap_means(*frames, "p", "v").collect()}
    rounded = lambda found: {p: tuple(x if x is None else round(x, 9) for x in v) for p, v in found.items()}
    assert rounded(got) == rounded(expected)


def test_a25_has_every_problem(spark):
    found = {r[0] for r in QUERIES["a25_cross_and_within_mean"](spark, SMALL).select("problem_key").collect()}
    sides = executions(spark, SMALL).groupBy("problem_key").agg({"*": "count"}).count()
    assert len(found) > 0.9 * sides and any(not p.endswith("0") for p in found)


def test_auroc_interval_against_a_plain_bootstrap(spark):
    """Positives drawn by cluster, negatives by row; the draws are seeds, so both sides make the same ones."""
    rng = random.Random(7)
    rows = [(rng.randrange(9), rng.randrange(30) / 2, rng.random() < 0.4) for _ in range(90)]
    frame = spark.createDataFrame(rows, "c int, score double, pos boolean").coalesce(1).withColumn("g", F.lit("x"))
    units = {True: {}, False: {}}
    for c, score, pos in rows:
        units[pos].setdefault(f"c{c}" if pos else f"r{len(units[False])}", []).append(score)  # negatives are numbered among themselves
    seed = lambda *parts: int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:16], 16) % 2147483647

    def area(p, n):
        return sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n))

    def drawn(pos, replicate):
        names = sorted(units[pos])
        picks = [seed("auroc", str(pos).lower(), replicate, j) % len(names) for j in range(len(names))]
        return [v for k in picks for v in units[pos][names[k]]]

    values = [area(drawn(True, r), drawn(False, r)) for r in range(200)]
    got = stats.auroc_interval(frame, ["g"], "c", "score", F.col("pos"), n=200).first()
    all_of = {pos: [v for xs in units[pos].values() for v in xs] for pos in units}
    assert got.auroc == pytest.approx(area(all_of[True], all_of[False]))
    assert (got.ci_low, got.ci_high) == pytest.approx(tuple(np.quantile(values, [0.025, 0.975])))


@pytest.mark.parametrize(("name", "least"), [("m5_auroc_interval", 1000), ("m6_ratio_interval_2000", 2000), ("m8_mean_interval_2000", 2000), ("m9_median_interval_1000", 1000)])
def test_replicates_of_interval_queries(spark, monkeypatch, name, least):
    """Each query's replicates, as percentile_interval gets them, number at least those of the operator or the reference."""
    seen, interval = [], stats.percentile_interval

    def counted(samples, group, value, alpha=0.05):
        sizes = samples.groupBy(*group).agg(F.countDistinct("replicate").alias("n")).agg(F.min("n")).first()[0]
        seen.append(sizes)
        return interval(samples, group, value, alpha)

    monkeypatch.setattr(stats, "percentile_interval", counted)
    QUERIES[name](spark, SMALL)
    assert min(seen) >= least


def test_indexed_quantiles_gather_no_group(spark):
    """Values at places of the sorted group, nulls left out; no aggregate holds a group's values."""
    rng = random.Random(6)
    rows = [(g, rng.choice([None, *range(50)])) for g in ("a", None) for _ in range(101)] + [("b", 7), ("c", None)]
    wanted = {}
    for g in {g for g, _ in rows}:
        if held := sorted(v for h, v in rows if h == g and v is not None):
            n = len(held)
            wanted[g] = (held[9 * (n - 1) // 10], (held[(n - 1) // 2] + held[n // 2]) / 2)
    found = stats.indexed_quantiles(spark.createDataFrame(rows, "g string, v int"), ["g"], "v").collect()
    assert {r.g: (r.p90, r.p50) for r in found} == wanted
    plan = QUERIES["g12_indexed_quantiles"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(word in plan for word in ("collect_list", "percentile", "median"))


def test_freeze_compares_counts(spark):
    """A cell's hashes differ from its method's if some are missing; copies of a hash don't count twice."""
    cells = "method string, model_id string, language string, config_hash string"
    candidates = spark.createDataFrame([("m", "a", "py", h) for h in "xxyz"] + [("m", "b", "py", h) for h in "xyzz"] + [("m", "c", "py", h) for h in "xyyy"] + [("k", "a", "py", "w")], cells)
    selected = candidates.groupBy("method", "model_id", "language").agg(F.min("config_hash").alias("config_hash")).select("*", F.lit(False).alias("provisional"), F.array(F.lit("L1")).alias("levels"), F.lit(False).alias("not_applicable"))
    thresholds = selected.select("method", "model_id", "language", "config_hash", F.lit(1.0).alias("threshold"), F.lit(False).alias("provisional"))
    found = gates.freeze_violations(selected, thresholds, candidates, ["L1"])
    assert [tuple(r) for r in found.collect()] == [("m", "c", "py", "candidates differ between cells")]
    assert "collect_set" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_split_areas_are_those_of_their_draws(spark):
    """Each replicate's area by plain sums over the draws of all blocks; ties, null groups, several blocks of either kind; no row for a draw."""
    rng, n = random.Random(9), 12
    rows = [(g, rng.randrange(2500), float(rng.randrange(s)), rng.random() < 0.45) for g, s in (("a", 400), (None, 3)) for _ in range(4000)] + [("p", 1, 2.0, True), ("q", 1, 2.0, False)]
    frame = spark.createDataFrame(rows, "g string, c int, _score double, _positive boolean")
    found = {}
    for r in stats.split_areas(frame, ["g"], "c", n, "x").collect():
        found.setdefault(r.g, {})[r.replicate] = r.auroc
    assert found.keys() == {"a", None, "p", "q"} and all(len(x) == n for x in found.values()) and {*found["p"].values(), *found["q"].values()} == {None}
    for g, name in (("a", '{"_":0,"g":"a"}'), (None, '{"_":0}')):
        own = [r for r in rows if r[0] == g]
        clusters, negatives = sorted({r[1] for r in own if r[3]}), sorted(r[2] for r in own if not r[3])
        drawn = lambda kind, k: np.concatenate([stats._uniform_draws(f"x|42|{kind}|{name}", k, b, n)[1] for b in range(-(-k // stats.BLOCK))])  # noqa: E731, B023
        of_clusters, of_negatives = drawn("positive", len(clusters)), drawn("negative", len(negatives))
        assert len(clusters) > stats.BLOCK and len(negatives) > stats.BLOCK and (of_clusters.sum(axis=0) == len(clusters)).all() and (of_negatives.sum(axis=0) == len(negatives)).all()
        until = np.concatenate([np.zeros((1, n)), of_negatives.cumsum(axis=0)])
        won, total = np.zeros(n), np.zeros(n)
        for _, c, score, positive in own:
            if positive:
                times = of_clusters[clusters.index(c)]
                won += times * (until[np.searchsorted(negatives, score)] + until[np.searchsorted(negatives, score, "right")]) / 2
                total += times
        assert [found[g][r] for r in range(n)] == pytest.approx(list(won / (total * len(negatives))))
    assert QUERIES["m5_auroc_interval"].__code__.co_names.count("split_areas") == 1
